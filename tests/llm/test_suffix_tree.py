import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from roadlens.llm import suffix_tree as st

WORD = re.compile(r"[^\x20\x09-\x0D]+")
END = " "


def tokens(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [*WORD.findall(low), END]


def trained(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 7 != 2


def corpus(n=400):
    r = random.Random(8)
    follow = {f"w{i}": [f"w{r.randrange(40)}" for _ in range(3)] for i in range(40)}
    rows = []
    for i in range(n):
        w, out = f"w{r.randrange(40)}", []
        for _ in range(r.randrange(0, 40)):
            out.append(w.upper() if r.random() < 0.2 else w)
            w = r.choice(follow[w]) if r.random() < 0.9 else f"rare{r.randrange(2000)}"
            if w not in follow:
                out.append(w)
                w = f"w{r.randrange(40)}"
            elif len(out) > 2 and out[-1].lower() == "w3" and out[-3].lower() in ("w1", "w5", "w9"):
                w = "w7"  # what follows depends on the word three places back
        rows.append((i, " \n".join(out)))
    # what follows "u v" depends on one or two words before it
    far = [(2000 + i, " ".join(f"z{a} k{b} u v end{b if b else 10 + a}" for a, b in ((r.randrange(4), r.randrange(4)) for _ in range(12)))) for i in range(30)]
    twice = [(700 + i, " ".join(f"own{j}" if j % 3 else "w2" for j in range(30))) for i in range(4)]
    return [*rows, *far, *twice, (1000, None), (1001, ""), (1002, "new words only"), (1003, "w1 " * 5000), (None, "w1 w2"), (5, "w1 w2 é"), (5, "w1 w2 é")]


class Plain:
    """The same tree by dictionaries: every context is tested alone, against its longest suffix that is a state."""

    def __init__(self, rows, depth, share, least=2, p_min=2e-3, penalty=2.0):
        seqs = [tokens(t) for i, t in rows if trained(i)]
        self.c = Counter(x for s in seqs for x in s)
        self.n, self.depth = sum(self.c.values()), depth
        n1, n2 = (sum(v == k for v in self.c.values()) for k in (1, 2))
        d = self.d = min(0.9, max(0.1, n1 / max(n1 + 2 * n2, 1)))
        floor = max(2, math.ceil(share * self.n))
        seldom = [w for w, v in self.c.items() if v < floor and w != END]
        self.rare = (sum(self.c[w] for w in seldom) - d * len(seldom)) / max(len(seldom), 1) / self.n
        self.seldom = set(seldom)
        follow = defaultdict(Counter)
        for s in seqs:
            for i, x in enumerate(s):
                before = [END, *s[:i]][::-1]
                for m in range(1, min(depth, len(before)) + 1):
                    follow[tuple(before[:m])][x] += 1
        self.states = {}
        for s in sorted(follow, key=len):
            parent = next((s[:m] for m in range(len(s) - 1, 0, -1) if s[:m] in self.states), ())
            seen = sum(follow[s].values())
            e = {x: v for x, v in follow[s].items() if v >= max(least, p_min * seen)}
            if not e or seen < least or seen >= (sum(follow[parent].values()) if parent else self.n):
                continue
            up = {x: self.p(x, parent) for x in e}
            gain = sum(v * math.log(v / seen / up[x]) for x, v in e.items())
            rest = seen - sum(e.values())
            gain += rest * math.log(rest / seen / (1 - sum(up.values()))) if rest else 0
            if gain > 0.5 * len(e) * math.log(seen) + penalty:
                p = {x: (v - d) / seen for x, v in e.items()}
                self.states[s] = (1 - sum(p.values()), p)

    def root(self, x):
        return self.rare if x in self.seldom else (self.c[x] - self.d) / self.n if self.c[x] else self.d * len(self.c) / self.n

    def p(self, x, before):
        """Probability of x after words, nearest first."""
        out = self.root(x)
        for m in range(1, min(self.depth, len(before)) + 1):
            if tuple(before[:m]) in self.states:
                lam, p = self.states[tuple(before[:m])]
                out = lam * out + p.get(x, 0.0)
        return out

    def score(self, t):
        s = tokens(t)
        return sum(math.log10(self.p(x, [END, *s[:i]][::-1])) for i, x in enumerate(s))


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", True) for i, t in rows], "doc_id long, text string, score string, __train boolean").repartition(3)
    model = st.fit(df, ~st.held_out(), **options)
    return model, st.score(df, model, ~st.held_out()).collect()


def check(got, rows, plain):
    texts = defaultdict(set)
    for i, t in rows:
        texts[i].add(t)
    assert len(got) == len(rows)
    better = 0
    for x in got:
        fits = [t for t in texts[x.doc_id] if len(tokens(t)) == x.n_tokens]
        assert len(fits) == 1
        t = tokens(fits[0])
        assert x.n_known == sum(plain.c[w] > 0 for w in t)
        assert math.isclose(x.base_score, sum(math.log10((plain.c[w] + 1) / (plain.n + len(plain.c) + 1)) for w in t), rel_tol=1e-9)
        assert math.isclose(x.score, plain.score(fits[0]), rel_tol=1e-6, abs_tol=1e-6), (x, plain.score(fits[0]))  # sums by segment have 24 binary places
        better += x.score - x.base_score
    return better


def test_scores_equal_a_plain_tree(spark):
    rows = corpus()
    plain = Plain(rows, 4, 1e-7)
    orders = Counter(map(len, plain.states))
    assert orders[1] > 20 and orders[2] > 10 and orders[3] > 2 and orders[4] > 2
    model, got = run(spark, rows, segment_rows=2000)
    assert (model.total, model.distinct) == (plain.n, len(plain.c)) and model.segments > 5
    assert check(got, rows, plain) > 1000
    # texts that occur more than once are told apart from ones with as usual words
    copies = [x for x in got if x.doc_id in (700, 701, 702, 703)]
    assert all(x.score > 0.4 * x.base_score for x in copies)


def test_hot_contexts_and_a_small_dictionary_change_no_result(spark):
    rows = corpus(200)
    for depth in (4, 2):
        plain = Plain(rows, depth, 0.0005, p_min=0.1)
        model, got = run(spark, rows, depth=depth, hot_rows=60, share=0.0005, p_min=0.1, segment_rows=1500)
        assert len(model.lam) > 30 and len(model.entry) > 30 and (model.child // model.width > 0).any()
        assert len(model.hashes) < len(plain.c)
        check(got, rows, plain)


def test_every_state_sums_to_one():
    rows = corpus(150)
    plain = Plain(rows, 4, 1e-7)
    for s in [(), *random.Random(1).sample(sorted(plain.states), 40), ("never",)]:
        assert math.isclose(sum(plain.p(w, s) for w in plain.c) + plain.p("\0never", s), 1.0, rel_tol=1e-9)


def test_empty_and_untrained(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = st.fit(none)
    assert st.score(none, model).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = st.fit(some, st.F.lit(False))
    got = st.score(some, model, st.F.lit(False)).first()
    assert (got.n_tokens, got.n_known, got.base_score, got.score) == (3, 0, 0.0, 0.0)
    assert np.isfinite(got.score)


def test_packed_arrays_come_back():
    for a in (np.arange(5, dtype=np.int64) - 2, np.zeros(0, np.uint64), np.array([2**63 + 5], np.uint64), np.array([0.5, -1e300])):
        assert (st.unpack(st.pack(a), a.dtype) == a).all() and st.unpack(st.pack(a), a.dtype).dtype == a.dtype


def test_the_query_against_the_plain_tree(spark, sf_dir):
    from roadlens.llm.queries import op9_suffix_tree_scoring

    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    plain = Plain(rows, 4, 1e-7)
    got = op9_suffix_tree_scoring(spark, sf_dir).collect()
    check(got, rows, plain)
    assert all(x.held_out != trained(x.doc_id) and x.train_tokens == plain.n for x in got)
    assert all(math.isclose(x.gain * x.n_tokens, x.score - x.base_score, rel_tol=1e-9, abs_tol=1e-9) for x in got)


def test_words_are_hashed_by_arrays():
    import sys

    import pyarrow as pa

    r = random.Random(2)
    letters = [*"aBé漢", " ", "\n", "\x1c", "\x85", " ", "\t", "\x0b", "\f", "\r", "\0"]
    texts = ["", " ", "x" * 200, "X" * 200 + " y", *("".join(r.choice(letters) for _ in range(r.randrange(80))) for _ in range(400)), "", ""]
    for some in (pa.array(texts), pa.array(texts).slice(2, 90), pa.array(texts[::-1], pa.large_string()), pa.array([], pa.string()), pa.array(["", ""])):
        h, n = st._words(some)
        want = [t.encode().lower().split() + [b" "] for t in some.to_pylist()]
        assert n.tolist() == [len(w) for w in want]
        of = dict(zip((w for s in want for w in s), h.tolist(), strict=True))
        assert [of[w] for s in want for w in s] == h.tolist() and len(set(of.values())) == len(of)
    # numbers of new words take no call of a function each
    batch = pa.record_batch({"t": [" ".join(f"word{i}" for i in range(20_000))]})
    calls = []
    sys.setprofile(lambda _, event, __: calls.append(event))
    x, _, n = st._first(batch, 0, st.WordNumbers(np.array([st._hash(st.END)], np.uint64)), 4)
    sys.setprofile(None)
    assert len(set(x.tolist())) == 20_001 and n.tolist() == [20_001] and len(calls) < 2_000
