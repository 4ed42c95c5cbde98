"""Words, word hashes and shingles of whole Arrow batches of texts, as numpy arrays.

Texts arrive as UTF-8 bytes. A word is a run of bytes outside 0x20 and 0x09-0x0D, so it never splits a character.
All hashes are 64 bits wide; equal words or shingles always get equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
IN_WORD = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, of n entries at least."""
    if len(_powers.get("up", ())) < n:
        n = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(n, np.uint64(base))
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of some texts: word i is bytes[starts[i]:ends[i]] and belongs to text doc[i]; text d has words first[d]:first[d+1]."""

    bytes: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        up, down = _power_table(len(self.bytes) + 1)
        sums = np.zeros(len(self.bytes) + 1, np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * up[: len(self.bytes)], out=sums[1:])
        lengths = (self.ends - self.starts).astype(np.uint64)
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + lengths * np.uint64(0xD6E8FEB86659FD93))


def pieces(column: pa.Array, most: int = 600_000) -> Iterator[tuple[int, int]]:
    """Row ranges of a binary column that hold about `most` bytes each; a longer text is a range of its own."""
    sizes = np.diff(_offsets(column))
    lo, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def words(column: pa.Array, lower: bool = False) -> Words:
    """Words of each text; a null text has none. lower: A-Z become a-z first."""
    if column.null_count:
        column = column.fill_null(b"")
    off = _offsets(column)
    data = column.buffers()[2] if len(column) else None
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    if lower:
        buf = LOWER[buf]
    inside = IN_WORD[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    before = np.zeros(len(buf), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(buf), bool)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(buf, off, starts, ends, np.searchsorted(off, starts, side="right") - 1, np.searchsorted(starts, off))


def windows(hashes: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and hashes of all runs of `width` words within one text."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(doc[:n] == doc[width - 1 :])
    total = np.zeros(len(at), np.uint64)
    for j in range(width):
        total += hashes[at + j] * np.uint64(pow(0xC2B2AE3D27D4EB4F, j + 1, 1 << 64))
    return at, mix(total)


def shingle_sets(w: Words, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of 1 to width-1 words has one, of the whole sequence."""
    hashes = w.hashes()
    at, shingles = windows(hashes, w.doc, width)
    cuts = np.searchsorted(at, w.first)
    out = []
    for d in range(len(w.first) - 1):
        lo, hi = cuts[d], cuts[d + 1]
        if hi > lo:
            s = np.sort(shingles[lo:hi])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif w.first[d + 1] > w.first[d]:
            own, n = hashes[w.first[d] : w.first[d + 1]], w.first[d + 1] - w.first[d]
            total = sum(int(h) * pow(0xC2B2AE3D27D4EB4F, j + 1, 1 << 64) for j, h in enumerate(own)) + int(n) * 0xA0761D6478BD642F
            out.append(mix(np.array([total & _MASK], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
