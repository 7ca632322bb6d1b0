import random
import re

from roadlens.llm.components import components
from roadlens.llm.minmax_dedup import near_duplicates, remaining_pairs, shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        k = min(width, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus():
    r = random.Random(3)
    rows, base = [], [[f"w{r.randrange(60)}" for _ in range(r.randrange(30, 90))] for _ in range(12)]
    for i in range(160):
        w = list(r.choice(base))
        for _ in range(r.randrange(0, 6)):
            w[r.randrange(len(w))] = f"x{r.randrange(40)}"
        rows.append((i * 3, " ".join(w) if i % 3 else "  ".join(w).upper()))
    return [*rows, (1, None), (2, ""), (4, " \n\t"), (5, "one"), (7, "ONE"), (8, "one two"), (10, "é É"), (11, "É É"), (13, "a b c " * 3000)]


def test_components_match_union_find_and_ignore_loops(spark):
    got = components(spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (2, 10), (None, 3)], "u long, v long"))
    assert sorted(map(tuple, got.collect())) == [(2, 2), (3, 2), (4, 2), (5, 2), (8, 8), (9, 8), (10, 2)]
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for width, percent in ((3, 85), (5, 80)):
        got = {tuple(x) for x in near_duplicates(df, width, percent).collect()}
        assert got == brute(rows, width, percent)


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "a b c d e f", 1, "x"), (3, "a b c d e f", 2, "y"), (3, "a b c d e f", 2, "y")], "doc_id long, text string, kept int, n_shingles string")
    got = sorted((tuple(x) for x in near_duplicates(df).collect()), key=str)
    assert got == [(3, 2, 3, True), (3, 2, 3, True), (None, 2, None, True)]


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_chain_behind_a_foreign_pivot_is_found(spark):
    """Many near copies share buckets with a smaller id that links to none of them."""
    words = [f"t{i}" for i in range(100)]
    rows = [(0, " ".join(words[:62]))]
    for i in range(1, 25):
        w = list(words)
        w[50 + i] = f"y{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(x) for x in near_duplicates(df, 3, 85).collect()} == brute(rows, 3, 85)


def test_repeated_rows_and_ids_with_two_texts_stay_in_remaining_pairs(spark):
    """Two sets of 100 shingles share 92; one comes in a repeated row, or its id has another text too."""
    a = [f"t{i}" for i in range(100)]
    b = a[:92] + [f"u{i}" for i in range(8)]
    rest = spark.createDataFrame([(1, 100, 1), (2, 100, 2), (3, 100, 2)], "id long, n long, label long")
    others = (3, " ".join([*a[8:], *(f"v{i}" for i in range(8))]))
    for more in ((1, " ".join(a).upper()), (1, " ".join(f"{x}" for x in [*a[:40], "z1", "z2"]))):
        rows = [(1, " ".join(a)), more, (2, " ".join(b)), others]
        sets = shingle_sets(spark.createDataFrame(rows, "id long, text string"), 1, "id", "text")
        got = {tuple(x) for x in remaining_pairs(rest, sets, 85).collect()}
        assert {(u, v) for u, v, _, linked in brute_pairs(rows, 85) if linked and u == 1} <= got


def brute_pairs(rows, percent):
    out = []
    for i, s in rows:
        for j, t in rows:
            if i < j:
                x, y = set(s.lower().split()), set(t.lower().split())
                out.append((i, j, len(x & y), 100 * len(x & y) >= percent * len(x | y)))
    return out


def test_near_copies_that_repeat_equal_brute_force(spark):
    rows = corpus()
    rows += [(i, t.upper() if t else t) for i, t in rows[::2]] + rows[::3]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [tuple(x) for x in near_duplicates(df, 3, 85).collect()]
    assert len(got) == len(rows) and set(got) == brute(rows, 3, 85)


def test_few_edges_take_few_tasks(spark, monkeypatch):
    from roadlens.llm import components as c

    seen, plain = [], c.checkpoint
    monkeypatch.setattr(c, "checkpoint", lambda df: seen.append(plain(df)) or seen[-1])
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = c.components(spark.createDataFrame([(i, i + 1) for i in range(30) if i % 10], "u long, v long"))
        assert {tuple(x) for x in got.collect()} == {(i, i // 10 * 10 + 1 if i % 10 else i - 9) for i in range(1, 31)}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(seen) > 3 and max(df.rdd.getNumPartitions() for df in seen[1:]) <= spark.sparkContext.defaultParallelism
