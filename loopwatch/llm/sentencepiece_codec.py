"""Encoding and decoding with a public SentencePiece model file, by a streaming Viterbi search.

The search walks over a text's characters and keeps, for each position in a window as long as the longest piece, the best
piece that ends there. Whenever the backpointer paths of all positions in the window meet in one boundary, the ids before it
are final and leave the window, so memory doesn't grow with the text. What "best" means follows the model's kind:

* unigram: the path with the greatest sum of piece scores (ties: the longer last piece).
* BPE: scores are merge ranks, so a greatest sum would give other ids than the model's merges. A piece may follow another
  only if merging the two together leaves them apart; of the pieces that end at a position exactly one passes this test
  along its path, and the surviving path spells the ids of the merges.

Words between spaces, across which no piece of the model reaches, are encoded once per task and looked up again. New words
of a batch are searched in sorted order, and the search of a word goes on where it parts from the word before.

Only models whose normalisation is the identity are read; others raise. Encoding adds the model's dummy prefix and decoding
takes it off. Null text: null ids, 0 tokens, exact. Empty text: no ids. The character U+2581 stands for the space in such
models and decodes to one, as in any implementation; `exact` is false for such texts. Ids that are no piece raise
IndexError. Repeated rows are encoded alike; an empty table gives an empty result; extra columns are carried by `encode`.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, BYTE = 1, 2, 6
UNIGRAM, BPE = 1, 2
#: Words that a task remembers in each of two generations.
MOST_WORDS = 250_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        x = shift = 0
        while True:
            b = data[at]
            at += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + n]
        at += n


class Model:
    """Pieces of a model file and the search over them."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.fallback, self.prefix, self.squeeze, charsmap = UNIGRAM, False, True, True, b""
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif number == 2:
                own = dict(_fields(value))
                self.kind, self.fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
            elif number == 3:
                own = dict(_fields(value))
                self.prefix, self.squeeze, charsmap = bool(own.get(3, 1)), bool(own.get(4, 1)), own.get(2, b"")
        if charsmap or self.squeeze or self.kind not in (UNIGRAM, BPE) or any(t == 4 for *_, t in self.pieces):
            raise ValueError("only BPE and unigram models without normalisation or user-defined pieces are read")
        self.ids = {p: i for i, (p, _, t) in enumerate(self.pieces) if t == NORMAL}
        self.score = {p: s for p, s, t in self.pieces if t == NORMAL}
        self.unknown = next((i for i, (*_, t) in enumerate(self.pieces) if t == UNKNOWN), 0)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.longest = max(map(len, self.ids), default=1)
        self.unknown_score = min(self.score.values(), default=0.0) - 10
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in joined)
        crossed = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        #: Parts that no piece reaches across; None if pieces reach across spaces.
        self.words = None if crossed else re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else ""))
        self.bytes = [bytes([int(p[3:5], 16)]) if t == BYTE else b" \xe2\x81\x87 " if t == UNKNOWN else b"" if t == 3 else p.replace(SPACE, " ").encode() for p, _, t in self.pieces]
        self.apart: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: The last short text searched, and the piece that ends at each of its positions.
        self.searched: tuple[str, list[str]] = ("", [""])
        #: Lengths of the pieces that end in four characters, longest first, and in three where no longer piece ends; two and one
        #: are always tried.
        self.three = {p: (3, 2, 1) for p in self.ids if len(p) == 3}
        sizes: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 3:
                sizes.setdefault(p[-4:], set(self.three.get(p[-3:], (2, 1)))).add(len(p))
        self.sizes = {end: tuple(sorted(x, reverse=True)) for end, x in sizes.items()}

    def merged(self, text: str) -> list[str]:
        """Parts of a short text after all merges: the best-ranked neighbours first, the left ones on ties."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _follows(self, left: str, right: str) -> bool:
        got = self.apart.get((left, right))
        if got is None:
            if len(self.apart) > 500_000:
                self.apart.clear()
            got = self.apart[left, right] = self.merged(left + right) == [left, right]
        return got

    def _short_bpe(self, text: str) -> list[str]:
        """The search for a text that fits in one window: all boundaries are held, and the path is read at the end. What ends at a
        position depends on the text up to it, so the search goes on where this text parts from the one before."""
        n, sizes, three, score, apart = len(text), self.sizes, self.three, self.score, self.apart
        before, last = self.searched
        same, most = 0, min(n, len(before))
        while same < most and text[same] == before[same]:
            same += 1
        last = last[: same + 1] + [""] * (n - same)
        self.searched = text, last
        for i in range(same + 1, n + 1):
            fit = sizes.get(text[i - 4 : i]) if i > 3 else None
            for size in fit or three.get(text[i - 3 : i], (2, 1)):
                lo = i - size
                if lo < 0:
                    continue
                piece = text[lo:i]
                if size > 1 and piece not in score:
                    continue
                if lo:
                    ok = apart.get((last[lo], piece))
                    if ok or ok is None and self._follows(last[lo], piece):
                        last[i] = piece
                        break
                elif i == 1 or self._whole(piece):
                    last[i] = piece
                    break
        out = []
        while n:
            out.append(last[n])
            n -= len(last[n])
        return out[::-1]

    def _whole(self, piece: str) -> bool:
        """Whether merging the characters of a piece makes the piece."""
        got = self.apart.get(("", piece))
        if got is None:
            got = self.apart["", piece] = self.merged(piece) == [piece]
        return got

    def stream(self, text: str) -> Iterator[str]:
        """Pieces of a text; only the window between the last committed boundary and the position is held."""
        n, longest, bpe = len(text), self.longest, self.kind == BPE
        if bpe and n <= 2 * longest:
            yield from self._short_bpe(text)
            return
        done = 0
        back: dict[int, int] = {0: 0}
        total: dict[int, float] = {0: 0.0}
        for i in range(1, n + 1):
            best = None
            for lo in range(max(done, i - longest), i):
                if lo not in back:
                    continue
                piece = text[lo:i]
                s = self.score.get(piece)
                if s is None:
                    if i - lo > 1:
                        continue
                    s = self.unknown_score
                if bpe:
                    before = text[back[lo] : lo]
                    if before and not self._follows(before, piece) or not before and len(piece) > 1 and not self._whole(piece):
                        continue
                    back[i] = lo
                    break
                if best is None or total[lo] + s > best:
                    best, back[i] = total[lo] + s, lo
            if best is not None:
                total[i] = best
            if i - done >= 2 * longest and i % longest == 0 or i == n:
                # a committed boundary stays the start of the window; the piece before it still decides what may follow in BPE
                ends = [i] if i == n else [j for j in range(i - longest + 1, i + 1) if j in back]
                meet = self._meeting(back, ends, done)
                if bpe and i != n:
                    meet = back[meet] if meet > done else done
                if meet > done:
                    out, j = [], meet
                    while j > done:
                        out.append(text[back[j] : j])
                        j = back[j]
                    yield from reversed(out)
                    for j in [j for j in back if j < meet]:
                        del back[j]
                        total.pop(j, None)
                    base = total.get(meet, 0.0)
                    total = {j: x - base for j, x in total.items()}
                    if not bpe:
                        back[meet] = meet
                    done = meet

    @staticmethod
    def _meeting(back: dict[int, int], ends: list[int], done: int) -> int:
        """The last boundary that lies on the paths of all ends."""
        paths = set(ends)
        while len(paths) > 1:
            j = max(paths)
            if j <= done:
                return done
            paths.discard(j)
            paths.add(back[j])
        return paths.pop()

    def encode_part(self, text: str) -> bytes:
        out: list[int] = []
        gap = False
        short = self.kind == BPE and len(text) <= 2 * self.longest
        for piece in self._short_bpe(text) if short else self.stream(text):
            i = self.ids.get(piece)
            if i is not None:
                out.append(i)
            elif self.fallback:
                out += [self.byte_ids[b] for b in piece.encode()]
            elif not gap:
                out.append(self.unknown)
            gap = i is None
        return struct.pack(f"<{len(out)}i", *out)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. New words are searched in sorted order, so that those with a common beginning share its search."""
        lead = SPACE if self.prefix else ""
        texts = [lead + t.replace(" ", SPACE) if t else "" for t in texts]
        if self.words is None or not self.fallback:  # runs of unknown characters join into one id, also across parts
            return [np.frombuffer(self.encode_part(t), "<i4") for t in texts]
        parts = [self.words.findall(t) for t in texts]
        met = set().union(*parts)
        got = {w: x for w in met if (x := self.known.get(w) or self.older.get(w))}
        for w in sorted(met - got.keys()):
            got[w] = self.encode_part(w)
        if len(self.known) >= MOST_WORDS:  # words not met again since the last change go
            self.older, self.known = self.known, {}
        self.known.update((w, x) for w, x in got.items() if len(w) < 64)
        return [np.frombuffer(b"".join(map(got.__getitem__, p)), "<i4") for p in parts]

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        if self.prefix and data.startswith(b" "):
            data = data[1:]
        return data.decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(data: bytes) -> Model:
    return Model(data)


def read_model(path: str = DEFAULT_MODEL) -> bytes:
    """A model file of some hundred kilobytes, read by the driver and sent with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def encode(spark: SparkSession, docs: DataFrame, text: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """docs with ids, n_tokens and exact (whether decoding the ids gives the text back)."""
    shared = spark.sparkContext.broadcast(read_model(model))
    docs = docs.drop("ids", "n_tokens", "exact")
    names, place = docs.columns, docs.columns.index(text)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]

    def run(batches):
        m = load(shared.value)
        for b in batches:
            step = 256
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                texts = [t or "" for t in part.column(place).to_pylist()]
                ids = m.encode_all(texts)
                exact = [m.decode(x) == t for x, t in zip(ids, texts, strict=True)]
                sizes = np.array([len(x) for x in ids], np.int32)
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                nulls = part.column(place).is_null()
                if part.column(place).null_count:
                    import pyarrow.compute as pc

                    lists = pc.if_else(nulls, pa.scalar(None, lists.type), lists)
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(sizes.astype(np.int64)), pa.array(exact)], names=[*names, "ids", "n_tokens", "exact"])

    return docs.mapInArrow(run, ", ".join([*fields, "ids array<int>", "n_tokens long", "exact boolean"]))


def decode(spark: SparkSession, coded: DataFrame, ids: str = "ids", model: str = DEFAULT_MODEL) -> DataFrame:
    """coded with `decoded`, the text of its ids; null ids give a null text."""
    shared = spark.sparkContext.broadcast(read_model(model))
    coded = coded.drop("decoded")
    names, place = coded.columns, coded.columns.index(ids)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields]

    def run(batches):
        m = load(shared.value)
        for b in batches:
            texts = [None if x is None else m.decode(np.array(x, np.int32)) for x in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    return coded.mapInArrow(run, ", ".join([*fields, "decoded string"]))
