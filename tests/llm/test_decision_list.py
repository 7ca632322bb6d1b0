import random
import re

import numpy as np

from roadlens.llm import decision_list as dl
from roadlens.llm.common import crc_mod

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(t):
    t = t or ""
    w = WORD.findall(t)
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {j for i, x in enumerate(win) if win.count(x) > 1 for j in (i, i + 1, i + 2)}
    lines, dup, seen = t.split("\n"), 0, set()
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_statistics_equal_plain_ones(spark):
    r = random.Random(1)
    parts = ["a", "b", "é", "漢字", " ", " ", "\n", "\t", "#*", "A!", "|", "\xa0", "\x0b", "\r", "🙂"]
    texts = [None, "", " ", "\n\n", *["".join(r.choice(parts) for _ in range(r.randrange(60))) for _ in range(300)], "a b c " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: tuple(x)[1:6] for x in dl.word_stats(df, ["doc_id"]).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_learned_conjunctions_reject_the_planted_kind():
    rng = np.random.default_rng(0)
    n = 3000
    stats = {k.split()[0]: rng.integers(1, 500, n) for k in dl.STATS.split(", ")}
    bad = (stats["n_symbols"] >= 2 * stats["n_words"]) | ((stats["n_words"] < 100) & (stats["n_marks"] > 4 * stats["n_words"]))
    rules = dl.learn(stats, bad)
    x = dl.measured(stats)
    hit = np.any([dl._hits(r, x) for r in rules], 0)
    assert bad[hit].mean() > 0.95 and hit[bad].mean() > 0.9
    assert all(1 <= len(r) <= 4 for r in rules)
    assert dl.learn(stats, np.zeros(n, bool)) == [] and dl.learn(stats, np.ones(n, bool)) == []


def test_spark_expressions_equal_numpy(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["x", "y!", "##", "Zed"]) for _ in range(r.randrange(0, 30))), "clash") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    rules = [(dl.Condition("symbols_a_word", True, 0.5),), (dl.Condition("words", False, 12.0), dl.Condition("upper", True, 0.25))]
    got = dl.judged(df, rules, ["doc_id"]).toPandas().sort_values("doc_id")
    x = dl.measured({k: got[k].to_numpy() for k in got.columns if k.startswith(("n_", "word_"))})
    first, second = dl._hits(rules[0], x), dl._hits(rules[1], x)
    want = np.where(first, 1, np.where(second, 2, 0))
    assert (got["rule"].fillna(0).to_numpy() == want).all() and len(set(want)) == 3


def test_fit_and_the_query(spark, sf_dir):
    from roadlens.llm.queries import op3_learned_decision_list as q

    got = q(spark, sf_dir).collect()
    docs = {x.doc_id: x.text for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(got) == len(docs)
    for x in got:
        assert tuple(x)[1:6] == plain(docs[x.doc_id])
        assert x.base_failed == (x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words)
        assert x.kept == (not x.base_failed and x.rule is None)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert dl.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), none) == []
    assert dl.judged(spark.createDataFrame([], "doc_id long, text string"), [], ["doc_id"]).count() == 0


def test_implied_conditions_go():
    c = dl.Condition
    rule = (c("words", True, 5.0), c("upper", False, 0.6), c("words", True, 9.0), c("upper", False, 0.7), c("upper", True, 0.1))
    short = dl.tightest(rule)
    assert short == (c("words", True, 9.0), c("upper", False, 0.6), c("upper", True, 0.1))
    x = {"words": np.arange(20.0), "upper": np.linspace(0, 1, 20)}
    assert (dl._hits(rule, x) == dl._hits(short, x)).all()


def test_held_out_labels(spark):
    """Fitted on three quarters of 1,500 documents; bad ones repeat few words or are full of symbols."""
    r = random.Random(8)
    rows = []
    for i in range(1500):
        y, n = int(r.random() < 0.7), r.randrange(40, 200)
        words = [f"w{r.randrange(4000)}" for _ in range(n)]
        if not y:
            words = [r.choice(words[:12]) for _ in words] if i % 2 else [w + r.choice(["", "##", "$|"]) for w in words]
        rows.append((i, " ".join(words), y))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    held = crc_mod("doc_id", 4) == 2
    rules = dl.fit(df.select("doc_id", "text"), df.select("doc_id", "quality").where(~held))
    got = dl.judged(df.where(held), rules, ["doc_id", "quality"]).toPandas()
    bad, out = got.quality == 0, got.rule.notna()
    assert len(got) > 300 and out[bad].mean() >= 0.95 and out[~bad].mean() <= 0.02


def test_repeated_rows_each_get_their_verdict(spark):
    df = spark.createDataFrame([(1, "# # #"), (1, "# # #"), (None, "a b"), (2, None)], "doc_id long, text string")
    got = sorted(((x.doc_id, x.rule) for x in dl.judged(df, [(dl.Condition("symbols_a_word", True, 0.5),)], ["doc_id"]).collect()), key=str)
    assert got == [(1, 1), (1, 1), (2, None), (None, None)]
