"""Sessions: named frames that several queries share, held for a while."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame


@dataclass
class Sessions:
    """Frames by name. One that is opened again within `ttl` seconds of its last use is the same persisted frame, so queries over it
    plan one scan; after that it is dropped and built anew. At most `most` are held: the longest unused goes first. Partitions are
    kept in memory and on disk, and are computed again if an executor is lost."""

    ttl: float = 3600.0
    most: int = 8
    clock: Callable[[], float] = time.monotonic
    _held: dict[str, tuple[DataFrame, float]] = field(default_factory=dict)

    def open(self, name: str, load: Callable[[], DataFrame]) -> DataFrame:
        self.expire()
        frame = self._held[name][0] if name in self._held else load().persist(StorageLevel.MEMORY_AND_DISK)
        self._held.pop(name, None)  # the last used stands last
        self._held[name] = (frame, self.clock())
        while len(self._held) > self.most:
            self.close(next(iter(self._held)))
        return frame

    def close(self, name: str) -> None:
        if name in self._held:
            self._held.pop(name)[0].unpersist()

    def expire(self) -> None:
        now = self.clock()
        for name in [n for n, (_, used) in self._held.items() if now - used > self.ttl]:
            self.close(name)

    def names(self) -> list[str]:
        return list(self._held)
