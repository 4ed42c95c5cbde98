"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRU layers read the bytes of a word from either end; a softmax over both states labels every position. A document pools
its positions: the probabilities of a document are the normalised product of its words' evidence, a word's being the mean of
its positions' log-probabilities. States start anew at each word, so equal words have equal labels, and a task computes the
labels of a word once and keeps them by hash; every position of every whole text still counts.

Training is plain numpy, backpropagation through time with Adam, on the driver, on a bounded sample of labelled rows:
`DOCS_PER_LANGUAGE` documents of each language and `WORDS_PER_DOC` words of each, spread over the whole text. Everything else
covers all rows. The model's parameters are a few ten thousand numbers.

A null text, or one without a letter, is `und` with score 0. Null labels and null doc_ids are never learned from. With no
labelled row at all every text is `und`. Ties between languages go to the first by name. Words beyond 32 bytes are labelled
in runs of 32. Repeated rows get equal predictions. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopwatch.llm.textarrays import Words, pieces, words

DOCS_PER_LANGUAGE, WORDS_PER_DOC = 300, 150
HIDDEN, LONGEST, STEPS, BATCH, RATE, SEED = 16, 32, 250, 512, 0.015, 3
#: Words that a task remembers.
MOST_WORDS = 300_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _gru(x: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of all positions. x: input parts of the gates (n, length, 3 * hidden); masked positions keep the state."""
    n, length, width = x.shape
    hid = width // 3
    h = np.zeros((n, hid), np.float32)
    out = np.empty((n, length, hid), np.float32)
    for t in range(length):
        rec = h @ u
        z, r = _sigmoid(x[:, t, :hid] + rec[:, :hid]), _sigmoid(x[:, t, hid : 2 * hid] + rec[:, hid : 2 * hid])
        cand = np.tanh(x[:, t, 2 * hid :] + r * rec[:, 2 * hid :])
        m = mask[:, t, None]
        new = h + m * (1 - z) * (cand - h)
        if keep is not None:
            keep.append((h, z, r, cand, rec[:, 2 * hid :]))
        h = new
        out[:, t] = h
    return out


def _gru_back(grad: np.ndarray, mask: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input parts and of u, given those of the states."""
    n, length, hid = grad.shape
    dx, du = np.zeros((n, length, 3 * hid), np.float32), np.zeros_like(u)
    dh = np.zeros((n, hid), np.float32)
    for t in reversed(range(length)):
        h, z, r, cand, rec = kept[t]
        dh = dh + grad[:, t]
        m = mask[:, t, None]
        dn = dh * m
        dcand = dn * (1 - z) * (1 - cand * cand)
        dz = dn * (h - cand) * z * (1 - z)
        dr = dcand * rec * r * (1 - r)
        dx[:, t] = np.concatenate((dz, dr, dcand), 1)
        drec = np.concatenate((dz, dr, dcand * r), 1)
        du += h.T @ drec
        dh = dh * (1 - m) + dn * z + drec @ u.T
    return dx, du


class Network:
    """Parameters of the network and the languages of its outputs."""

    def __init__(self, languages: list[str], seed: int = SEED):
        rng, h = np.random.default_rng(seed), HIDDEN
        init = lambda *s: (rng.standard_normal(s) * 0.2).astype(np.float32)
        self.languages = languages
        self.p = {"wf": init(257, 3 * h), "wb": init(257, 3 * h), "uf": init(h, 3 * h), "ub": init(h, 3 * h), "v": init(2 * h, len(languages)), "c": np.zeros(len(languages), np.float32)}

    def _forward(self, codes: np.ndarray, keep: tuple[list, list] | None = None):
        mask = (codes < 256).astype(np.float32)
        f = _gru(self.p["wf"][codes], mask, self.p["uf"], keep and keep[0])
        b = _gru(self.p["wb"][codes[:, ::-1]], mask[:, ::-1], self.p["ub"], keep and keep[1])[:, ::-1]
        both = np.concatenate((f, b), 2)
        logits = both @ self.p["v"] + self.p["c"]
        logits -= logits.max(2, keepdims=True)
        return mask, both, logits - np.log(np.exp(logits).sum(2, keepdims=True))

    def evidence(self, codes: np.ndarray) -> np.ndarray:
        """For each word (row of byte codes, 256 past its end) the sums of its positions' log-probabilities."""
        mask, _, logp = self._forward(codes)
        return (logp * mask[:, :, None]).sum(1)

    def fit(self, codes: np.ndarray, label: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            at = rng.integers(0, len(codes), batch)
            x = codes[at]
            x = x[:, : max(1, int((x < 256).sum(1).max()))]
            keep: tuple[list, list] = ([], [])
            mask, both, logp = self._forward(x, keep)
            d = np.exp(logp)
            d[np.arange(batch), :, label[at]] -= 1
            d *= (mask / mask.sum())[:, :, None]
            g = {"v": both.reshape(-1, both.shape[2]).T @ d.reshape(-1, d.shape[2]), "c": d.sum((0, 1))}
            ds = d @ self.p["v"].T
            h = HIDDEN
            dxf, g["uf"] = _gru_back(ds[:, :, :h], mask, self.p["uf"], keep[0])
            dxb, g["ub"] = _gru_back(ds[:, ::-1, h:], mask[:, ::-1], self.p["ub"], keep[1])
            for name, dx, order in (("wf", dxf, x), ("wb", dxb, x[:, ::-1])):
                g[name] = np.zeros_like(self.p[name])
                np.add.at(g[name], order.ravel(), dx.reshape(-1, 3 * h))
            for k in self.p:
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.001 * (g[k] ** 2 - second[k])
                self.p[k] -= rate * (1 - step / (steps + 1)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)


def codes_of(w: Words, at: np.ndarray) -> np.ndarray:
    """Byte codes of the words at the places given (of LONGEST bytes at most), padded with 256."""
    n = (w.ends - w.starts)[at]
    place = np.arange(int(n.max(initial=1)))
    index = np.minimum(w.starts[at][:, None] + place, max(0, len(w.bytes) - 1))
    return np.where(place < n[:, None], w.bytes[index].astype(np.int64), 256)


def short_words(w: Words) -> Words:
    """Words longer than LONGEST bytes as runs of so many."""
    n = w.ends - w.starts
    if not (n > LONGEST).any():
        return w
    parts = -(-n // LONGEST)
    of = np.repeat(np.arange(len(n)), parts)
    k = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = w.starts[of] + k * LONGEST
    return Words(w.bytes, w.offsets, starts, np.minimum(starts + LONGEST, w.ends[of]), w.doc[of], np.searchsorted(starts, w.offsets))


_known: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _evidence(net: Network, digest: str, w: Words) -> np.ndarray:
    """Evidence of every word, by way of the words met before."""
    hashes = w.hashes()
    own, where, back = np.unique(hashes, return_index=True, return_inverse=True)
    keys, table = _known.get(digest, (np.zeros(0, np.uint64), np.zeros((0, len(net.languages)), np.float32)))
    spot = np.searchsorted(keys, own)
    have = keys[np.minimum(spot, len(keys) - 1)] == own if len(keys) else np.zeros(len(own), bool)
    values = np.empty((len(own), len(net.languages)), np.float32)
    values[have] = table[spot[have]]
    fresh = np.flatnonzero(~have)
    fresh = fresh[np.argsort((w.ends - w.starts)[where[fresh]], kind="stable")]
    for lo in range(0, len(fresh), 4096):
        part = fresh[lo : lo + 4096]
        values[part] = net.evidence(codes_of(w, where[part]))
    if len(fresh):
        if len(keys) + len(fresh) > MOST_WORDS:
            keys, table = own, values
        else:
            fresh = np.sort(fresh)
            at = np.searchsorted(keys, own[fresh])
            keys, table = np.insert(keys, at, own[fresh]), np.insert(table, at, values[fresh], axis=0)
        _known.clear()
        _known[digest] = keys, table
    return values[back]


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predict_batch(net: Network, digest: str, column: pa.Array) -> tuple[list[str], list[float]]:
    langs: list[str] = []
    scores: list[float] = []
    letter = np.zeros(256, bool)
    letter[[*range(65, 91), *range(97, 123)]] = True
    for lo, hi in pieces(column):
        part = column.slice(lo, hi - lo)
        w = short_words(words(part))
        n, c = hi - lo, len(net.languages)
        total, size = np.zeros((n, c)), (w.ends - w.starts)
        if len(size) and c:
            e = _evidence(net, digest, w) / size[:, None]
            for j in range(c):
                total[:, j] = np.bincount(w.doc, e[:, j], minlength=n)
        plain = np.concatenate(([0], np.cumsum(letter[w.bytes])))
        plain = plain[w.offsets[1:]] > plain[w.offsets[:-1]]
        for i in range(n):
            if not c or not (plain[i] or _has_letter(w.bytes[w.offsets[i] : w.offsets[i + 1]].tobytes())):
                langs.append("und")
                scores.append(0.0)
                continue
            p = np.exp(total[i] - total[i].max())
            best = int(p.argmax())
            langs.append(net.languages[best])
            scores.append(float(p[best] / p.sum()))
    return langs, scores


def is_held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(spark: SparkSession, docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE, words_per_doc: int = WORDS_PER_DOC) -> Network:
    """A network fitted on a bounded sample of the rows that are not held out."""
    labelled = docs.where(~is_held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Network([])
    languages = sorted(counts)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.2 * per_language / n))])
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < 1_000_003 * F.element_at(share, F.col("lang")))

    def spread(batches):
        for b in batches:
            w = short_words(words(b.column(1)))
            out, langs = [], []
            for d, lang in enumerate(b.column(0).to_pylist()):
                lo, hi = w.first[d], w.first[d + 1]
                for i in np.unique(np.linspace(lo, hi - 1, min(words_per_doc, hi - lo)).astype(np.int64)) if hi > lo else ():
                    out.append(w.bytes[w.starts[i] : w.ends[i]].tobytes())
                    langs.append(lang)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], names=["lang", "word"])

    sample = chosen.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(spread, "lang string, word binary")
    rows = sample.toArrow().to_pydict()
    order = sorted(range(len(rows["word"])), key=lambda i: (rows["lang"][i], rows["word"][i]))  # the same for any order of tasks
    label = np.array([languages.index(rows["lang"][i]) for i in order], np.int64)
    codes = np.full((len(order), LONGEST), 256, np.int64)
    for k, i in enumerate(order):
        codes[k, : len(rows["word"][i])] = np.frombuffer(rows["word"][i], np.uint8)
    net = Network(languages)
    if len(codes):
        # languages weigh the same, whatever their share of the sample
        even = np.random.default_rng(SEED)
        pick = [np.flatnonzero(label == j) for j in range(len(languages)) if (label == j).any()]
        most = max(map(len, pick))
        at = np.concatenate([even.choice(p, most) for p in pick])
        net.fit(codes[at], label[at])
    return net


def predict(spark: SparkSession, docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    digest = hashlib.sha256(b"".join(net.p[k].tobytes() for k in sorted(net.p)) + repr(net.languages).encode()).hexdigest()

    def run(batches):
        for b in batches:
            langs, scores = predict_batch(net, digest, b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
