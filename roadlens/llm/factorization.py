"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, checkpoint, col, crc_mod, map_text
from .labelled import labelled_sample

#: Words share this many buckets; each statistic has STEPS values of its own behind them.
BUCKETS, STEPS = 1 << 15, 16
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = b"#*$%&<>"
N_STATS = 11
SIZE = BUCKETS + N_STATS * STEPS


def _ratio(a: float, b: float) -> int:
    """The step of a share: 0 for none, then by powers of two from 1/4096 on."""
    return 0 if a <= 0 else int(min(STEPS - 1, max(1, 13 + np.log2(a / max(b, 1)))))


def _scale(n: float) -> int:
    return int(min(STEPS - 1, np.log2(n + 1)))


def statistics(t: bytes, words: list[bytes], distinct: int, n_chars: float | None) -> list[int]:
    """The step of each structure statistic; the last is metadata, the length that the row claims."""
    n, size = len(words), len(t)
    lines = t.split(b"\n")
    return [
        _scale(n),
        _scale((size - n) / max(n, 1) * 100),
        _ratio(size - len(t.translate(None, _UPPER)), size),
        _ratio(size - len(t.translate(None, _DIGITS)), size),
        _ratio(size - len(t.translate(None, _SYMBOLS)), size),
        _ratio(t.count(b"|"), n),
        _ratio(t.count(b"!"), n),
        _ratio(n - distinct, n),
        _ratio(len(lines) - len(set(lines)), len(lines)),
        _scale(len(lines)),
        _scale(size if n_chars is None or n_chars != n_chars else max(n_chars, 0)),
    ]


class Features:
    """Feature numbers and values of documents, flat, with the count of each document."""

    def __init__(self):
        self.hash = WordHash()

    def of(self, texts: list[bytes], n_chars: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat, counts = [], []
        base = BUCKETS + STEPS * np.arange(N_STATS)
        for t, c in zip(texts, n_chars, strict=True):
            words = t.lower().split()
            some = list(set(words))
            ids = np.unique(self.hash.of(some) % np.uint64(BUCKETS)).astype(np.int32)
            flat += [ids, (base + statistics(t, words, len(some), c)).astype(np.int32)]
            counts.append(len(ids) + N_STATS)
        if not texts:
            return np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(0, np.int64)
        counts = np.array(counts, np.int64)
        return np.concatenate(flat), values_of(counts), counts


def values_of(counts: np.ndarray) -> np.ndarray:
    """The values of documents with so many features: words share one, statistics, which come last, have 0.3."""
    words = counts - N_STATS
    each = np.stack([1 / np.sqrt(np.maximum(words, 1)), np.full(len(counts), 0.3)], 1).astype(np.float32)
    return np.repeat(each.ravel(), np.stack([words, np.full(len(counts), N_STATS)], 1).ravel())


@dataclass
class Machine:
    """score = sigmoid(bias + linear part + pairwise part)."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    trained: bool = True

    def logits(self, ids: np.ndarray, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """All pairs at once: half of (sum of v x) squared less the sum of (v x) squared, for each factor."""
        if not len(counts):
            return np.zeros(0)
        at = np.cumsum(counts) - counts
        vx = self.factors[ids] * x[:, None]
        s = np.add.reduceat(vx, at)
        pairs = 0.5 * (s * s - np.add.reduceat(vx * vx, at)).sum(1)
        return self.bias + np.add.reduceat(self.linear[ids] * x, at) + pairs


def train(ids: np.ndarray, x: np.ndarray, counts: np.ndarray, y: np.ndarray, rank: int = 8, updates: int = 1500, rate: float = 0.08, l2: float = 2e-5, batch: int = 64, seed: int = 7) -> Machine:
    """Logistic loss, AdaGrad on about ``updates`` shuffled batches, in 2 to 60 rounds.

    With one class only, the smoothed share of label 1.
    """
    prior = (y.sum() + 1) / (len(y) + 2)
    m = Machine(float(np.log(prior / (1 - prior))), np.zeros(SIZE, np.float32), np.zeros((SIZE, rank), np.float32), False)
    if len(set(y.tolist())) < 2:
        return m
    rng = np.random.default_rng(seed)
    m.factors = rng.normal(0, 0.05, (SIZE, rank)).astype(np.float32)
    m.trained = True
    gw, gv, gb = np.full(SIZE, 1e-6, np.float32), np.full((SIZE, rank), 1e-6, np.float32), 1e-6
    ends = np.cumsum(counts)
    rounds = min(60, max(2, updates * batch // len(y)))
    for _ in range(rounds):
        for chosen in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            n = counts[chosen]
            at = np.concatenate([np.arange(e - c, e) for e, c in zip(ends[chosen], n, strict=True)])
            i, v = ids[at], x[at]
            first = np.cumsum(n) - n
            vx = m.factors[i] * v[:, None]
            s = np.add.reduceat(vx, first)
            z = m.bias + np.add.reduceat(m.linear[i] * v, first) + 0.5 * (s * s - np.add.reduceat(vx * vx, first)).sum(1)
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[chosen]) / len(chosen)
            e_each = np.repeat(e, n).astype(np.float32) * v
            used = np.unique(i)
            g = np.bincount(i, e_each, SIZE)[used] + l2 * m.linear[used]
            gw[used] += g * g
            m.linear[used] -= rate * g / np.sqrt(gw[used])
            d = e_each[:, None] * (np.repeat(s, n, 0) - vx)
            for f in range(rank):
                g = np.bincount(i, d[:, f], SIZE)[used] + l2 * m.factors[used, f]
                gv[used, f] += g * g
                m.factors[used, f] -= rate * 0.5 * g / np.sqrt(gv[used, f])
            g = float(e.sum())
            gb += g * g
            m.bias -= rate * g / np.sqrt(gb)
    return m


def _inputs(docs: DataFrame, text_col: str, chars_col: str | None, keep: list[str]) -> DataFrame:
    n = col(chars_col).cast("double") if chars_col and chars_col in docs.columns else F.lit(None).cast("double")
    return docs.select(*[col(k) for k in keep], n.alias("__n"), col(text_col).alias("__t"))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, where=None, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", label_col: str = "quality", max_values: int = 20_000_000) -> Machine:
    """A machine from at most ``max_rows`` rows of as many labelled ids, and at most ``max_values`` of their feature values.

    Both bound what the driver gathers: 12 bytes a row to count its values, then 2 a value, the feature's number; what
    it is worth follows from the row's count. Rows come by hash of their id.
    """
    some = labelled_sample(docs, labels, max_rows, where, id_col, label_col)
    some = some.withColumn("__h", F.xxhash64(col(id_col)))

    def make():
        features = Features()

        def f(texts, batch):
            ids, _, counts = features.of(texts, batch.column(2).to_pylist())
            ids, ends = ids.astype("<u2"), np.concatenate(([0], np.cumsum(counts)))
            return [[ids[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]]

        return f

    got = map_text(_inputs(some, text_col, chars_col, ["__label", "__h"]), ["__label", "__h", "__n"], "i binary", make, "__t").drop("__n")
    got = checkpoint(got.orderBy("__h", "i", "__label").limit(max_rows))
    sizes = got.select("__h", "i", "__label", F.expr("length(i) div 2").alias("n")).orderBy("__h", "i", "__label").select("n").toPandas().n.to_numpy(np.int64)
    got = got.orderBy("__h", "i", "__label").limit(int(np.searchsorted(np.cumsum(sizes), max_values, "right"))).toPandas()
    got = got.sort_values(["__h", "i"], kind="stable")
    counts = np.array([len(b) // 2 for b in got.i], np.int64)
    return train(np.frombuffer(b"".join(got.i), "<u2"), values_of(counts), counts, got["__label"].to_numpy(np.float64))


def score(docs: DataFrame, machine: Machine, keep: list[str], text_col: str = "text", chars_col: str | None = "n_chars", out: str = "score") -> DataFrame:
    """Kept columns and ``out``, 0 to 1, higher where label 1 is likelier.

    Inputs are the text and the claimed length (missing or null: the text's own);
    never ids, labels, language or source. Null and empty texts get the score of
    a text without words. Whole texts count; equal rows get equal scores, no rows give none.
    """

    def make():
        features = Features()

        def f(texts, batch):
            z = machine.logits(*features.of(texts, batch.column(len(keep)).to_pylist()))
            return [pc.divide(1.0, pc.add(1.0, pa.array(np.exp(-np.clip(z.astype(np.float64), -30, 30)))))]

        return f

    return map_text(_inputs(docs, text_col, chars_col, keep), [*keep, "__n"], f"`{out}` double", make, "__t").drop("__n")


def held_out(id_col: str = "doc_id"):
    return crc_mod(id_col, 4) == 2
