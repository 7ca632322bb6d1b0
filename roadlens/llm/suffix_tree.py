"""Language-model scoring by a probabilistic suffix tree over words."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, crc_mod, mix64, pack, saved, slices, unpack

#: The token after the last word of every text; it also stands before the first. No word has a space.
END = b" "
#: Words in a context at most.
DEPTH = 4
#: Numbers of words: 0 stands for what is before a text's start, 1 for END, then those of the dictionary; words that it lacks have RARE and 40 bits of their hash.
RARE = 1 << 40
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _differences(sorted_keys: np.ndarray) -> bytes:
    return pack(np.diff(sorted_keys, prepend=sorted_keys.dtype.type(0)))


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    u, at = np.unique(np.concatenate(keys), return_inverse=True)
    return u, np.bincount(at, np.concatenate(counts), len(u)).astype(np.int64)


def _hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


@dataclass
class Model:
    """What all tasks know: numbers of tokens, the dictionary, and the states of contexts too frequent for one task.

    Hot contexts form a tree of their own: ``child`` maps parent * width + word to a context,
    and ``entry`` context * width + next word to its explicit probability. Context 0
    is the empty one.
    """

    total: int = 0
    distinct: int = 0
    every: int = 0
    discount: float = 0.5
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    rare: float = 1.0
    unseen: float = 1.0
    segments: int = 1
    depth: int = DEPTH
    least: int = 2
    p_min: float = 2e-3
    penalty: float = 2.0
    child: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    child_at: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    entry: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    entry_p: np.ndarray = field(default_factory=lambda: np.zeros(0))
    lam: np.ndarray = field(default_factory=lambda: np.ones(1))
    kept: np.ndarray = field(default_factory=lambda: np.ones(1, bool))
    seen: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))

    @property
    def width(self) -> int:
        return len(self.hashes) + 2

    @functools.cached_property
    def root(self) -> np.ndarray:
        """Probability by number of the words in the dictionary."""
        c = np.concatenate(([0], self.counts))
        return np.where(c > 0, (c - self.discount) / max(self.total, 1), self.unseen)

    def root_of(self, x: np.ndarray) -> np.ndarray:
        """Probability of words at the root; those outside of the dictionary that were seen share theirs evenly."""
        common = x < RARE
        return np.where(common, self.root[np.where(common, x, 0)], self.rare)

    def reached(self, words: list[np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray]:
        """Places whose ``order`` nearest words are a hot context, and that context."""
        live, at = np.arange(len(words[0])), np.zeros(len(words[0]), np.int64)
        for m in range(order):
            w = words[m][live]
            to = find(self.child, np.where((w > 0) & (w < RARE), at * self.width + w, -1))
            live, at = live[to >= 0], self.child_at[to[to >= 0]]
        return live, at

    def walk(self, words: list[np.ndarray], x: np.ndarray, p0: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For contexts (nearest word first) and next words: the longest hot context, its order, the next word's probability by the
        longest hot state over that at the root, and how often that state was seen."""
        n = len(x)
        at, order, ratio, seen = np.zeros(n, np.int64), np.zeros(n, np.int8), np.ones(n), np.full(n, self.total)
        live = np.arange(n) if len(self.child) else np.zeros(0, np.int64)
        for m in range(self.depth):
            w = words[m][live]
            live = live[(w > 0) & (w < RARE)]
            to = find(self.child, at[live] * self.width + words[m][live])
            live, to = live[to >= 0], to[to >= 0]
            if not len(live):
                break
            at[live], order[live] = self.child_at[to], m + 1
            state = live[self.kept[at[live]]]
            e = find(self.entry, np.where(x[state] < RARE, at[state] * self.width + x[state], -1))
            p = np.where(e >= 0, np.append(self.entry_p, 0.0)[e], 0.0)
            ratio[state] = self.lam[at[state]] * ratio[state] + p / p0[state]
            seen[state] = self.seen[at[state]]
        return at, order, ratio, seen


def find(keys: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Places of ``k`` in sorted ``keys``, -1 for those that it lacks."""
    if not len(keys):
        return np.full(len(k), -1, np.int64)
    i = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
    return np.where(keys[i] == k, i, -1)


class WordNumbers:
    """Numbers of words by their hashes."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.sorted]

    def of(self, h: np.ndarray) -> np.ndarray:
        u, at = np.unique(h, return_inverse=True)
        i = find(self.hashes, u)
        return np.where(i >= 0, self.sorted[i] + 1, RARE | (u >> np.uint64(24)).astype(np.int64))[at]


_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Longer words, in bytes, are hashed one at a time.
_LONG = 64


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, END after each text's last, and tokens of each text."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    lower = (raw.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes() if raw is not None else b"").lower()
    ends = ends - ends[0]
    data = np.frombuffer(lower + bytes(8), np.uint8)
    inside = ~_SPACE[data]
    inside[len(lower) :] = False
    begins, finishes = inside.copy(), inside[: len(lower)].copy()
    begins[1:] &= ~inside[:-1]
    begins[ends] = inside[ends]
    finishes &= ~inside[1 : len(lower) + 1]
    finishes[ends[ends > 0] - 1] = inside[ends[ends > 0] - 1]
    start = np.flatnonzero(begins)
    size = np.flatnonzero(finishes) + 1 - start
    h = mix64(size.astype(np.uint64) * _STEP)
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    live = np.flatnonzero(size <= _LONG)
    for done in range(0, _LONG, 8):
        live = live[size[live] > done]
        h[live] = mix64(h[live] * _STEP ^ eights[start[live] + done] & _BYTES[np.minimum(size[live] - done, 8)])
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = _hash(lower[start[i] : start[i] + size[i]])
    n = np.diff(np.searchsorted(start, ends))
    out = np.full(len(h) + len(n), _hash(END), np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
    return out, n + 1


def _source(docs: DataFrame, train: Column | None, text_col: str, *more: Column) -> DataFrame:
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    return docs.select(*more, (F.lit(True) if train is None else F.coalesce(train, F.lit(False))).alias("__train"), text.alias("__t"))


def word_counts(docs: DataFrame, train: Column | None = None, text_col: str = "text", segments: int = 64, most: int = 2_000_000) -> DataFrame:
    """A row for each segment of the 64-bit word hashes: hashes and counts of the words in training rows (END included), packed, and all rows' tokens.

    Tasks and segments add up sorted arrays, so a word costs some bytes a task, and one that is everywhere no more.
    """

    def run(batches):
        held, every = [], 0

        def out():
            k, c = _summed(*zip(*held, strict=True)) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            held.clear()
            s = (k >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)
            cut = np.searchsorted(s, np.arange(segments + 1))
            some = [i for i in range(segments) if cut[i] < cut[i + 1] or not i]
            rows = [[i, _differences(k[cut[i] : cut[i + 1]]), pack(c[cut[i] : cut[i + 1]]), every * (i == 0)] for i in some]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["s", "keys", "counts", "every"])

        for b in slices(batches, 1):
            words, n = _words(b.column(1))
            every += len(words)
            words = words[np.repeat(b.column(0).to_numpy(zero_copy_only=False), n)]
            if len(words):
                held.append(np.unique(words, return_counts=True))
                if sum(len(k) for k, _ in held) > most:
                    held[:] = [_summed(*zip(*held, strict=True))]
                    if len(held[0][0]) > most:
                        yield out()
                        every = 0
        yield out()

    def merge(t: pa.Table) -> pa.Table:
        k, c = _summed([np.cumsum(unpack(x, np.uint64), dtype=np.uint64) for x in t.column("keys").to_pylist()], [unpack(x, np.int64) for x in t.column("counts").to_pylist()])
        of = lambda x: pa.array([int(x)], pa.int64())
        return pa.table({"keys": pa.array([_differences(k)], pa.binary()), "counts": pa.array([pack(c)], pa.binary()), "every": of(sum(t.column("every").to_pylist())), "total": of(c.sum()), "n": of(len(c)), "n1": of((c == 1).sum()), "n2": of((c == 2).sum())})

    rows = _source(docs, train, text_col).mapInArrow(run, "s int, keys binary, counts binary, every long")
    return saved(rows.groupBy("s").applyInArrow(lambda t: merge(t), "keys binary, counts binary, every long, total long, n long, n1 long, n2 long"))


def _first(batch: pa.RecordBatch, at: int, numbers: WordNumbers, depth: int):
    """Of all texts of a batch in one array: next words, contexts (nearest word first), and tokens of each text."""
    hashes, n = _words(batch.column(at))
    x = numbers.of(hashes)
    place = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
    words = []
    for m in range(1, depth + 1):
        w = np.zeros_like(x)
        w[m:] = x[:-m]
        words.append(np.where(place >= m, w, np.where(place == m - 1, 1, 0)))
    return x, words, n


def fit(docs: DataFrame, train: Column | None = None, text_col: str = "text", depth: int = DEPTH, share: float = 1e-7, hot_rows: int = 400_000, segment_rows: int = 400_000, least: int = 2, p_min: float = 2e-3, penalty: float = 2.0) -> Model:
    """Counts of the training rows' words, and the states of hot contexts.

    The dictionary has the words with ``share`` of all tokens, 1 / share at most; the
    rest share the root's probability of words seen so seldom evenly. Contexts seen in ``hot_rows`` places
    or more, and in share / p_min of all, are counted here, order by order, and their states
    held by all tasks: hot contexts are few, and each has 1 / ``p_min`` explicit entries
    at most. All other contexts are counted where they are used.
    """
    counts = word_counts(docs, train, text_col)
    every, total, distinct, n1, n2 = (int(x or 0) for x in counts.agg(*[F.sum(c) for c in ("every", "total", "n", "n1", "n2")]).first())
    floor = max(2, int(np.ceil(share * total)))

    def top(batches):
        for b in batches:
            for keys, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                k, c = np.cumsum(unpack(keys, np.uint64), dtype=np.uint64), unpack(c, np.int64)
                some = (c >= floor) | (k == np.uint64(_hash(END)))
                yield pa.RecordBatch.from_arrays([pa.array([pack(k[some])], pa.binary()), pa.array([pack(c[some])], pa.binary())], names=["k", "c"])

    got = counts.select("keys", "counts").mapInArrow(top, "k binary, c binary").collect()
    k, c = (np.concatenate([np.zeros(0, t), *[unpack(r[i], t) for r in got]]) for i, t in ((0, np.uint64), (1, np.int64)))
    order = np.lexsort((k, -c, k != np.uint64(_hash(END))))
    k, c = k[order], c[order]
    if not len(k) or k[0] != np.uint64(_hash(END)):
        k, c = np.concatenate(([np.uint64(_hash(END))], k)), np.concatenate(([0], c))
    discount = min(0.9, max(0.1, n1 / max(n1 + 2 * n2, 1)))
    seldom = distinct - int((c > 0).sum())
    rare = (total - int(c.sum()) - discount * seldom) / seldom / max(total, 1) if seldom else 1.0
    model = Model(total, distinct, every, discount, k, c, rare, discount * distinct / total if total else 1.0, max(1, -(-every // segment_rows)), depth, least, p_min, penalty)
    hot = max(hot_rows, int(np.ceil(share / p_min * total)))
    new = np.flatnonzero(c >= hot) + 1
    parent, seen = np.zeros(len(new), np.int64), c[new - 1]
    for m in range(1, depth + 1):
        if not len(new):
            break
        base = len(model.lam)
        at = np.arange(base, base + len(new))
        model = _grown(model, parent, new, at, seen)
        keys, n = _hot_counts(docs, train, text_col, model, base, m, hot)
        state, word = keys // model.width, keys % model.width
        _settle(model, at, state, word, n)
        deeper = (n >= hot) & (word > 1)
        if m < depth:
            parent, new, seen = _as_contexts(model, state[deeper], word[deeper], n[deeper])
    return model


def _paths(model: Model, state: np.ndarray) -> list[np.ndarray]:
    """The words of hot contexts of one order, nearest first, and zeros up to the depth."""
    up, last = np.zeros((2, len(model.lam)), np.int64)
    up[model.child_at], last[model.child_at] = model.child // model.width, model.child % model.width
    out = []
    while len(state) and state[0]:
        out.append(last[state])
        state = up[state]
    return out[::-1] + [np.zeros(len(state), np.int64)] * (model.depth - len(out))


def _as_contexts(model: Model, state: np.ndarray, word: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences of a context and what followed it, read as contexts: the hot context of all but their first word, that word, and the count."""
    words = [word, *_paths(model, state)]
    order = sum(bool(len(w) and w[0]) for w in words)
    at, ok = np.zeros(len(word), np.int64), np.ones(len(word), bool)
    for w in words[: order - 1]:
        to = find(model.child, at * model.width + w)
        ok &= to >= 0
        at = np.append(model.child_at, 0)[to]
    return at[ok], words[order - 1][ok], seen[ok]


def _grown(model: Model, parent, word, at, seen) -> Model:
    keys = np.concatenate((model.child, parent * model.width + word))
    order = np.argsort(keys)
    model.child, model.child_at = keys[order], np.concatenate((model.child_at, at))[order]
    model.lam, model.kept, model.seen = np.concatenate((model.lam, np.ones(len(at)))), np.concatenate((model.kept, np.ones(len(at), bool))), np.concatenate((model.seen, seen))
    return model


def _hot_counts(docs: DataFrame, train, text_col: str, model: Model, base: int, order: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (context * width + next word) and counts of what follows the hot contexts of one order often enough for an entry."""

    def run(batches):
        numbers, held = WordNumbers(model.hashes), []

        def out():
            k, c = _summed(*zip(*held, strict=True))
            held.clear()
            names, cut = np.unique(k // model.width, return_index=True)
            parts = list(zip(np.split(k, cut[1:]), np.split(c, cut[1:]), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([_differences(a) for a, _ in parts], pa.binary()), pa.array([pack(b) for _, b in parts], pa.binary())], names=["s", "keys", "counts"])

        for b in slices(batches, 0):
            x, words, _ = _first(b, 0, numbers, order)
            some, at = model.reached(words, order)
            some, at = some[x[some] < RARE], at[x[some] < RARE]
            if len(some):
                held.append(np.unique(at * model.width + x[some], return_counts=True))
            if sum(len(k) for k, _ in held) > 1_000_000:
                held[:] = [_summed(*zip(*held, strict=True))]
                if len(held[0][0]) > 1_000_000:
                    yield out()
        if held:
            yield out()

    def merge(t: pa.Table) -> pa.Table:
        k, c = _summed([np.cumsum(unpack(x, np.int64)) for x in t.column("keys").to_pylist()], [unpack(x, np.int64) for x in t.column("counts").to_pylist()])
        s = t.column("s")[0].as_py()
        some = c >= max(model.least, min(hot, model.p_min * model.seen[s]))
        return pa.table({"k": pa.array([pack(k[some])], pa.binary()), "c": pa.array([pack(c[some])], pa.binary())})

    rows = _source(docs, train, text_col).where("__train").select("__t").mapInArrow(run, "s long, keys binary, counts binary")
    got = rows.groupBy("s").applyInArrow(lambda t: merge(t), "k binary, c binary").collect()
    k, c = (np.concatenate([np.zeros(0, np.int64), *[unpack(r[i], np.int64) for r in got]]) for i in (0, 1))
    order_ = np.argsort(k)
    return k[order_], c[order_]


def _settle(model: Model, at: np.ndarray, state: np.ndarray, word: np.ndarray, n: np.ndarray) -> None:
    """Tests the hot contexts ``at`` of one order by what followed them, and enters those that stay."""
    explicit = n >= np.maximum(model.least, model.p_min * model.seen[state])
    state, word, n = state[explicit], word[explicit], n[explicit]
    p0 = model.root[word]
    model.kept[at] = False  # so that a walk gives their longest suffix that is a state
    above = model.walk(_paths(model, state), word, p0)[2] * p0
    parent_seen = model.walk(_paths(model, at), np.ones_like(at), np.ones(len(at)))[3]
    local = state - at[0]
    lam, keep, p = divergence(local, n, model.seen[at], above, parent_seen, model)
    model.lam[at], model.kept[at] = lam, keep
    some = keep[local]
    keys = np.concatenate((model.entry, state[some] * model.width + word[some]))
    order = np.argsort(keys)
    model.entry, model.entry_p = keys[order], np.concatenate((model.entry_p, p[some]))[order]


def divergence(of: np.ndarray, n: np.ndarray, seen: np.ndarray, above: np.ndarray, parent_seen: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For contexts with explicit entries (context ``of``, count ``n``, probability ``above`` by the parent): lam, whether each stays, and the entries' explicit probabilities.

    The parent is the longest suffix that is a state. A context stays if its count times
    the divergence of what followed it from its parent's distribution exceeds half a
    logarithm of its count for each entry, and a penalty for the state. One that was
    seen wherever its parent was stays out.
    """
    size = len(seen)
    each = lambda v: np.bincount(of, v, size).astype(float)
    known, entries = each(n), each(np.ones(len(n)))
    p = (n - model.discount) / seen[of]
    lam = np.maximum(1 - each(p), 1e-9)
    gain = each(n * np.log(n / seen[of] / above))
    rest, left = seen - known, np.maximum(1 - each(above), 1e-12)
    gain += np.where(rest > 0, rest * np.log(np.maximum(rest, 1) / np.maximum(seen, 1) / left), 0.0)
    keep = (entries > 0) & (seen >= model.least) & (seen < parent_seen) & (gain > 0.5 * entries * np.log(np.maximum(seen, 2)) + model.penalty)
    return lam, keep, p


def grow(model: Model, words: list[np.ndarray], x: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of each next word's probability over that at the root, and how often training rows have the nearest context word.

    ``words`` and ``x`` are all places of some contexts; ``train`` says which of them count. Contexts
    grow by one word at a time for as long as they were seen ``least`` times, since one
    that is no state may have longer ones that are.
    """
    p0 = model.root_of(x)
    _, order, ratio, above = model.walk(words, x, p0)
    live = np.arange(len(x))
    key = np.zeros(len(x), np.uint64)
    nearest = np.zeros(len(x), np.int64)
    for m in range(1, model.depth + 1):
        key = mix64(key * _STEP + words[m - 1].astype(np.uint64))
        here = live[(order[live] < m) & (words[m - 1][live] > 0)]
        later = live[order[live] >= m]
        if not len(here):
            live = later
            continue
        _, context = np.unique(key[here], return_inverse=True)
        seen = np.bincount(context, train[here]).astype(np.int64)
        if m == 1:
            nearest[here] = seen[context]
        some = seen[context] >= model.least
        here, context = here[some], context[some]
        entry_keys, first, entry = np.unique(mix64(key[here] * _STEP + x[here].astype(np.uint64)), return_index=True, return_inverse=True)
        n = np.bincount(entry, train[here], len(entry_keys))
        of = context[first]
        explicit = n >= np.maximum(model.least, model.p_min * seen[of])
        e = np.flatnonzero(explicit)
        parent_seen = np.zeros(len(seen), np.int64)
        parent_seen[context] = above[here]
        lam, keep, p = divergence(of[e], n[e], seen, (ratio[here] * p0[here])[first[e]], parent_seen, model)
        every_p = np.zeros(len(entry_keys))
        every_p[e] = p
        live = np.concatenate((here, later))
        some = keep[context]
        here, context, entry = here[some], context[some], entry[some]
        ratio[here] = lam[context] * ratio[here] + every_p[entry] / p0[here]
        above[here] = seen[context]
    return np.log10(ratio), nearest


_SHORT = (1 << 32) - 1


def _shortened(w: np.ndarray) -> np.ndarray:
    """Numbers with 32 bits of the hashes of words that the dictionary lacks: enough to tell a context's longer forms apart."""
    return np.where(w >= RARE, RARE | w & _SHORT, w)


def _alike(s: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Keys in whose order places lie by segment, and there by their nearest words as far as 64 bits tell, so that they pack well."""
    left = 64 - max(1, int(s.max(initial=0)).bit_length())
    number = lambda w, bits: np.where(w < RARE, np.minimum(w, (1 << bits) - 1), 1 << bits | w >> 40 - bits & (1 << bits) - 1)
    one = min(24, left // 2 - 1)
    two = left - one - 2
    return s.astype(np.uint64) << np.uint64(left) | number(near, one).astype(np.uint64) << np.uint64(two + 1) | number(far, two).astype(np.uint64)


#: Sums come back in whole multiples of one over this.
_FINE = 1 << 24
_PLACES = "s int, slice long, own binary, w1 binary, w2 binary, w3 binary, w4 binary, x binary, doc binary"
_SUMS = "slice long, own binary, docs binary, sums binary, rare binary, base binary, known binary"


def score(docs: DataFrame, model: Model, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, base_score and score of every row.

    ``score`` is the tree's log10 probability of the words and the end, each given the
    longest suffix of up to ``depth`` words before it that is a state; ``base_score``
    takes each token alone, with one imagined sighting of every word and of an unseen
    one. The tree is that of the rows for which ``train`` holds, which must be
    those of ``fit``. Each place of each text, a next word with the words before
    it, goes to the segment of its nearest context that is not hot. There, all
    places of that context and of its longer ones meet, so a segment grows its
    part of the tree and scores its places by it at once. Sums go back to the slice of
    texts that they came from, to 24 binary places for each segment; base scores are
    in double precision.

    ``docs`` should be a table or a checkpoint: a slice is known by its place in its
    partition, which must be the same when a task runs again. Null text has the end
    only. Repeated rows each get their row; null ids stay null. An empty table
    gives an empty result. Other columns are not read.
    """
    if not 1 <= model.depth <= 4:
        raise ValueError("depth must be 1 to 4")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    total, distinct, segments = model.total, model.distinct, model.segments
    src = _source(docs, train, text_col, col(id_col).cast("long").alias("id"))
    names = [p.split()[0] for p in _PLACES.split(", ")]
    kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 7)

    def run(batches):
        import pickle

        from pyspark import TaskContext

        m, number = shared.value, TaskContext.get().partitionId() << 32
        numbers = WordNumbers(m.hashes)
        counts = np.concatenate(([0], m.counts))
        base_of = np.append(np.log10((counts + 1) / (total + distinct + 1)), 0.0)
        root_of = np.append(np.log10(m.root), 0.0)
        seen_of = np.append(counts > 0, False)
        for b in slices(batches, 2):
            x, words, n = _first(b, 2, numbers, m.depth)
            first = np.cumsum(n) - n
            _, order, ratio, _ = m.walk(words, x, m.root_of(x))
            dealt, key, seg = np.zeros(len(x), bool), np.zeros(len(x), np.uint64), np.zeros(len(x), np.uint64)
            for k in range(m.depth):
                key = mix64(key * _STEP + words[k].astype(np.uint64))
                now = (order == k) & (words[k] > 0)  # its context of k + 1 words is not hot
                seg[now] = key[now]
                dealt |= now
            lone = np.where(x < RARE, x, -1)
            score_ = root_of[lone] + np.where(dealt, 0.0, np.log10(ratio))
            sums = [np.add.reduceat(v, first) for v in (seen_of[lone].astype(np.int64), base_of[lone], score_)]
            trained = np.array(b.column(1).to_pylist(), np.uint32)
            rows = [[number % segments, number, pickle.dumps((b.column(0).to_pylist(), n, *sums)), *[b""] * 6]]
            at = np.flatnonzero(dealt)
            s = (mix64(seg[at]) % np.uint64(segments)).astype(np.int32)
            perm = np.argsort(_alike(s, words[0][at], words[min(1, m.depth - 1)][at]))
            at, s = at[perm], s[perm]
            doc = np.repeat(np.arange(len(n), dtype=np.uint32), n)[at]
            doc = doc * np.uint32(2) + trained[doc]
            sent = [words[0][at], *[_shortened(w[at]) for w in words[1:]]]
            x = _shortened(x[at])
            which, cut = np.unique(s, return_index=True)
            for name, i, j in zip(which.tolist(), cut, np.append(cut[1:], len(s)), strict=True):
                rows.append([name, number, b"", *[pack(w[i:j]) for w in sent], *[b""] * (4 - m.depth), pack(x[i:j]), pack(doc[i:j])])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            number += 1

    def grown(t: pa.Table) -> pa.Table:
        m = shared.value
        cols = {c: t.column(c).to_pylist() for c in t.column_names[1:]}
        rows = [[cols["slice"][i], own, *[b""] * 5] for i, own in enumerate(cols["own"]) if own]
        some = [i for i, own in enumerate(cols["own"]) if not own]
        if some:
            x, *words = (np.concatenate([unpack(cols[c][i], np.int64) for i in some]) for c in ("x", "w1", "w2", "w3", "w4")[: m.depth + 1])
            refs = [unpack(cols["doc"][i], np.uint32) for i in some]
            trained = (np.concatenate(refs) & np.uint32(1)).astype(np.int64)
            lp, near = grow(m, words, x, trained)
            lone = words[0] >= RARE
            lp += np.where(lone, np.log10(np.where(near > 0, m.rare, m.unseen)), 0.0)
            base = np.log10((near + 1) / (total + distinct + 1))
            a = 0
            for i, ref in zip(some, refs, strict=True):
                z, ref = a + len(ref), ref >> np.uint32(1)
                docs_, at = np.unique(ref, return_inverse=True)
                alone = lone[a:z]
                rare, at2 = np.unique(ref[alone], return_inverse=True)
                sums = np.rint(np.bincount(at, lp[a:z]) * _FINE).astype(np.int64)
                sums = (sums << 1) ^ (sums >> 63)  # small where near zero on either side
                more = np.bincount(at2, base[a:z][alone], len(rare)), np.bincount(at2, near[a:z][alone] > 0, len(rare)).astype(np.uint32)
                rows.append([cols["slice"][i], b"", _differences(docs_), pack(sums), _differences(rare), pack(more[0]), pack(more[1])])
                a = z
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), *[pa.binary()] * 6), strict=True)], names=[p.split()[0] for p in _SUMS.split(", ")])

    def joined(t: pa.Table) -> pa.Table:
        import pickle

        cols = {c: t.column(c).to_pylist() for c in t.column_names}
        ids, n, known, base, lp = pickle.loads(next(o for o in cols["own"] if o))
        known, base, lp = known.copy(), base.copy(), lp.copy()
        for i in sorted((i for i, o in enumerate(cols["own"]) if not o), key=lambda i: cols["docs"][i]):
            v = unpack(cols["sums"][i], np.int64)
            lp[np.cumsum(unpack(cols["docs"][i], np.uint32))] += ((v >> 1) ^ -(v & 1)) / _FINE
            rare = np.cumsum(unpack(cols["rare"][i], np.uint32))
            base[rare] += unpack(cols["base"][i], np.float64)
            known[rare] += unpack(cols["known"][i], np.uint32).astype(np.int64)
        return pa.table([pa.array(ids, pa.int64()), n, known, base, lp], names=["id", "n_tokens", "n_known", "base_score", "score"])

    places = src.mapInArrow(run, _PLACES)
    sums = places.groupBy("s").applyInArrow(lambda t: grown(t), _SUMS)
    out = sums.groupBy("slice").applyInArrow(lambda t: joined(t), "id long, n_tokens long, n_known long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    return crc_mod(id_col, 7) == 2
