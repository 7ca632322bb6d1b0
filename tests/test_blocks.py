import numpy as np
import pytest
from pyspark.sql import functions as F
from roadlens.operators import blocks, vectors


@pytest.fixture(scope="module")
def frames(spark):
    r = np.random.default_rng(3)
    v = r.integers(-3, 4, (700, 5)).astype(float)  # small integers: many equal scores
    v[600:] = v[0]  # a hot vector
    rows = [(i * 3 % 701, str(i), f"p/{i}.jpg", None if i % 97 == 5 else [None, *map(float, x[1:])] if i % 97 == 6 else [float(y) for y in x]) for i, x in enumerate(v)]
    corpus = spark.createDataFrame(rows, "corpus_pos bigint, image_id string, image_path string, embedding array<float>").repartition(7).cache()
    asked = [(q, p, [float(x) for x in r.integers(-2, 3, 5)]) for q in range(9) for p in range(1 + q % 3)]
    queries = spark.createDataFrame([*asked, (77, 0, None)], "query_id bigint, query_pos int, vector array<double>")
    return [x for x in rows if x[3] and None not in x[3]], asked, corpus, queries


def plain(rows, asked, k, least=None, skip_self=False):
    """Full lists by loops: (query_id, rank, image_id, score)."""
    out = []
    for q in sorted({a[0] for a in asked}):
        mine = [np.array(v) for a, _, v in asked if a == q]
        scored = [(max(float(np.dot(v, e)) for v in mine), float(np.dot(mine[0], e)), pos, i) for pos, i, _, e in rows if not (skip_self and i == str(q))]
        scored = sorted((s for s in scored if least is None or s[0] >= least), key=lambda s: (-s[0], -s[1], s[2]))
        out += [(q, n + 1, i, s) for n, (s, _, _, i) in enumerate(scored[:k])]
    return out


def found(df):
    return [(x.query_id, x.rank, x.image_id, x.score) for x in df.orderBy("query_id", "rank").collect()]


@pytest.mark.parametrize("way", ["held", "blocks"])
def test_nearest_equals_full_rankings(frames, monkeypatch, way):
    rows, asked, corpus, queries = frames
    if way == "blocks":
        monkeypatch.setattr(blocks, "MOST_BROADCAST", 2)
        monkeypatch.setattr(blocks, "BUCKETS", 3)
        monkeypatch.setattr(blocks, "BLOCK", 4)
    monkeypatch.setattr(blocks, "PRODUCTS", 500)
    for k, least, skip in ((1, None, False), (30, None, True), (650, 2.0, True), (2000, None, False)):
        got = blocks.nearest(corpus, queries, k, least, skip)
        assert got.columns == ["query_id", "rank", "image_id", "image_path", "score"]
        assert found(got) == plain(rows, asked, k, least, skip)


def test_nothing_to_search(frames, spark):
    _, _, corpus, queries = frames
    assert blocks.nearest(corpus.limit(0), queries, 3).count() == 0 and blocks.nearest(corpus, queries.limit(0), 3).count() == 0
    assert blocks.nearest(corpus, queries.where("query_id = 77"), 3).count() == 0
    with pytest.raises(Exception, match="5 and 2 components"):
        blocks.nearest(corpus, spark.createDataFrame([(1, [1.0, 2.0])], "query_id int, vector array<double>"), 3).count()


@pytest.mark.parametrize("most", [None, 40])
def test_counted_ranks_equal_places_in_full_rankings(frames, spark, monkeypatch, most):
    rows, asked, corpus, queries = frames
    monkeypatch.setattr(blocks, "PRODUCTS", 900)
    if most:
        monkeypatch.setattr(blocks, "MOST_BROADCAST", 4)
    pos = {i: p for p, i, _, _ in rows}
    for skip in (False, True):
        full = {(q, pos[i]): n for q, n, i, _ in plain(rows, asked, None, None, skip)}
        want = [(q, p) for q in range(9) for p in range(0, 701, 5)] + [(3, 9999), (55, 0)]
        wanted = spark.createDataFrame(want, "query_id bigint, corpus_pos bigint")
        got = {(x.query_id, x.corpus_pos): x["rank"] for x in blocks.ranks(corpus, queries, wanted, skip, most).collect()}
        assert got == {w: full[w] for w in want if w in full} and len(got) > 1000
    assert blocks.ranks(corpus, queries, wanted.limit(0)).count() == 0


def test_the_plan_makes_no_pair_of_rows(frames):
    _, _, corpus, queries = frames
    plan = vectors.embedding_search(corpus, queries.drop("query_pos"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and plan.count("MapInArrow") == 1


def test_struct_ids(frames):
    _, asked, corpus, queries = frames
    got = blocks.nearest(corpus, queries.withColumn("query_id", F.struct("query_id", "query_pos")), 2)
    assert got.count() == 2 * len(asked)


def test_wanted_rows_take_few_bytes_in_tasks(spark, monkeypatch):
    """A score and a short place each, and counts given some at a time; ranks as by sorting."""
    import pickle

    from pyspark import SparkContext

    r = np.random.default_rng(2)
    have = r.integers(-2, 3, (3000, 4)).astype(float)
    corpus = spark.createDataFrame([(i * 10**10, str(i), v.tolist()) for i, v in enumerate(have)], "corpus_pos long, image_id string, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(i, have[i].tolist()) for i in range(3)], "query_id long, vector array<double>")
    wanted = spark.range(3).toDF("query_id").crossJoin(corpus.select("corpus_pos"))
    sizes, broadcast = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sizes.append(len(pickle.dumps(value))) or broadcast(self, value))
    monkeypatch.setattr(blocks, "COUNTS", 700, raising=False)
    got = {(x.query_id, x.corpus_pos): x["rank"] for x in blocks.ranks(corpus, queries, wanted).collect()}
    assert max(sizes) < 9000 * 12 + 3000 * 8 + 5000
    for i in range(3):
        order = sorted(range(3000), key=lambda j: (-(have[j] @ have[i]), j))
        assert [got[i, j * 10**10] for j in order] == list(range(1, 3001))
