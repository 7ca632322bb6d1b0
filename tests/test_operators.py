import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from roadlens.operators import blocks, compare, dedup, evaluate, fusion, lexical, sample, vectors
from roadlens.operators.rank import top_k
from roadlens.plans import queries as engine

RANKED = "query_id bigint, rank int, image_id string, image_path string, score double"


def ranked(spark, ids, q=1, scores=None, prefix=""):
    return spark.createDataFrame([(q, i, x, prefix + x, float(scores[i - 1]) if scores else 1.0 / i) for i, x in enumerate(ids, 1)], RANKED)


def ids(df):
    return [x.image_id for x in df.orderBy("query_id", "rank").collect()]


def test_rrf_order_and_repeated_ids(spark):
    assert ids(fusion.rrf(ranked(spark, "ab"), ranked(spark, "bc"), 3, 0)) == ["b", "a", "c"]
    r = random.Random(1)
    for _ in range(6):
        s, l = [r.choice("abcdef") for _ in range(7)], [r.choice("abcdef") for _ in range(7)]
        score, place = defaultdict(float), {}
        for b, side in enumerate((s, l)):
            for i, x in enumerate(side[:5], 1):
                score[x] += 1 / (60 + i)
                place.setdefault(x, (b, i))
        want = sorted(score, key=lambda x: (-round(score[x], 12), place[x]))[:5]
        assert ids(fusion.rrf(ranked(spark, s), ranked(spark, l), 5)) == want


def test_tail_rerank(spark):
    ten = [str(i) for i in range(1, 11)]
    assert ids(fusion.tail_rerank(ranked(spark, ten), ranked(spark, ["9", "7", "6"]), 5, 10, 3)) == ["1", "2", "3", "4", "5", "9", "7", "6", "8", "10"]
    got = ids(fusion.tail_rerank(ranked(spark, ten), ranked(spark, ["external", "8", "7"]), 5, 10, 3))
    assert got == ["1", "2", "3", "4", "5", "8", "7", "6", "9", "10"]
    r = random.Random(2)
    for _ in range(6):
        s, l = [r.choice("abcdefg") for _ in range(9)], [r.choice("abcdefgx") for _ in range(6)]
        tail, lex = s[2:], {x: i for i, x in enumerate(l[:4], 1)}
        last = {x: i for i, x in enumerate(tail)}
        want = s[:2] + [x for _, x in sorted(enumerate(tail), key=lambda t: (t[1] not in lex, lex.get(t[1], 0), last[t[1]], t[0]))]
        assert ids(fusion.tail_rerank(ranked(spark, s), ranked(spark, l), 2, 9, 4)) == want
    with pytest.raises(ValueError):
        fusion.tail_rerank(ranked(spark, ten), ranked(spark, ten), 6, 5)


def test_rank_gate(spark):
    g = lambda s, l, *a: ids(fusion.rank_gate(ranked(spark, s), ranked(spark, l), *a))
    assert g("abcd", "cax", 4, 3, 2, 3) == ["a", "c"]
    assert g("abc", "bx", 3, 3, 2, 3) == ["b"]
    assert g("abcde", "xbyc", 5, 3, 4, 3) == ["b", "c"]
    assert g("abc", "xyz", 3, 3, 3, 3) == []


def test_max_merge_takes_the_earliest_of_equals(spark):
    rows = [(1, 0, 1, "a", "p", 0.5), (1, 0, 2, "b", "q", 0.4), (1, 1, 1, "c", "q", 0.9), (1, 1, 2, "d", "p", 0.5), (1, 2, 1, "e", "r", 0.5)]
    df = spark.createDataFrame(rows, "query_id bigint, query_pos int, rank int, image_id string, image_path string, score double")
    assert ids(fusion.max_merge(df, 5)) == ["c", "a", "e"]


CAPTIONS = ["red car at night", "", "blue car, blue road", "the the the car", "night rain night", "red bus", "red bus"]


def corpus(spark, texts):
    return spark.createDataFrame([(i, str(i), f"p/{i}.jpg", t) for i, t in enumerate(texts)], "corpus_pos bigint, image_id string, image_path string, caption string")


def asked(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id bigint, search_query string")


def plain_bm25(texts, query):
    import re

    toks = [re.findall("[a-z0-9]+", t.lower()) for t in texts]
    n, avg = len(texts), sum(map(len, toks)) / len(texts)
    df = Counter(t for d in toks for t in set(d))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in raw.items()}
    return [sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in re.findall("[a-z0-9]+", query.lower())) for d in toks]


def test_bm25_scores_order_and_zeros(spark):
    index = lexical.bm25_index(corpus(spark, CAPTIONS))
    qs = ["red night", "red red bus", "unknown", "car", "???"]
    got = lexical.bm25_search(index, asked(spark, qs), 6).collect()
    for q, text in enumerate(qs[:4]):
        s = plain_bm25(CAPTIONS, text)
        want = sorted(range(len(s)), key=lambda i: (-round(s[i], 9), i))[:6]
        mine = sorted((x for x in got if x.query_id == q), key=lambda x: x.rank)
        assert [int(x.image_id) for x in mine] == want
        assert all(abs(x.score - s[int(x.image_id)]) < 1e-9 for x in mine)
    assert not [x for x in got if x.query_id == 4]
    assert lexical.bm25_search(index, asked(spark, qs).limit(0), 3).count() == 0


def test_bm25_where_matches_score_nothing_or_less(spark):
    texts = ["a b", "a b c", "a", "b a", "a b d", "zz"]
    got = lexical.bm25_search(lexical.bm25_index(corpus(spark, texts)), asked(spark, ["a b", "c"]), 6).collect()
    for q, text in enumerate(["a b", "c"]):
        s = plain_bm25(texts, text)
        want = sorted(range(len(s)), key=lambda i: (-round(s[i], 9), i))
        assert [int(x.image_id) for x in sorted((x for x in got if x.query_id == q), key=lambda x: x.rank)] == want


def test_tfidf_of_equal_texts_is_one(spark):
    index = lexical.tfidf_index(corpus(spark, CAPTIONS))
    got = lexical.tfidf_search(index, asked(spark, ["Red bús", "zzz"]), 3).collect()
    first = sorted((x for x in got if x.query_id == 0), key=lambda x: x.rank)
    assert [x.image_id for x in first][:2] == ["5", "6"] and abs(first[0].score - 1) < 1e-9
    assert [x.image_id for x in sorted((x for x in got if x.query_id == 1), key=lambda x: x.rank)] == ["0", "1", "2"]


def test_embedding_search_and_the_many_query_path(spark, monkeypatch):
    rows = [(i, str(i), f"{i}.jpg", [float(i % 3), float(i)]) for i in range(9)]
    c = spark.createDataFrame(rows, "corpus_pos bigint, image_id string, image_path string, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "query_id bigint, vector array<float>")
    few = vectors.embedding_search(c, q, 3).collect()
    assert [x.image_id for x in sorted(few, key=lambda x: (x.query_id, x.rank))] == ["2", "5", "8", "8", "7", "6"]
    monkeypatch.setattr(blocks, "MOST_BROADCAST", 1)
    assert sorted(map(tuple, vectors.embedding_search(c, q, 3).collect())) == sorted(map(tuple, few))
    assert vectors.embedding_search(c, q, 9, least=2.0).where("query_id = 0").count() == 3


def test_models_on_workers(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b")], "i int, t string")
    got = {x.i: x.embedding for x in vectors.embed(df, "t", vectors.HashEmbedder, batch=2).collect()}
    assert got[1] == got[3] and abs(sum(v * v for v in got[1]) - 1) < 1e-6 and not any(got[2])

    def load():
        def infer(path, prompt):
            if path == "bad":
                raise ValueError("no")
            return path + "!"

        return infer

    rows = vectors.caption(spark.createDataFrame([("x",), ("bad",)], "image_path string"), load).collect()
    assert {(x.image_path, x.success, x.caption, x.error) for x in rows} == {("x", True, "x!", None), ("bad", False, None, "ValueError: no")}


def test_dedup_keeps_first_and_unites_labels(spark):
    rows = [(0, "r/a/1", "one", "h1", "a"), (1, "r/b/1", "two", "h1", "b"), (2, "r/b/2", "three", "h2", None)]
    records = spark.createDataFrame(rows, "corpus_pos bigint, image_path string, caption string, image_hash string, label string")
    d = dedup.deduplicated(records, paths=True)
    got = {x.image_id: x for x in d.collect()}
    assert (got["h1"].caption, got["h1"].duplicate_paths, got["h1"].labels, got["h1"].duplicate_count) == ("one", ["r/a/1", "r/b/1"], ["a", "b"], 2)
    assert got["h2"].labels == []
    paths = dedup.hash_by_path(records)
    ask = spark.createDataFrame([("r/b/1",)], "image_path string")
    assert dedup.lookup(ask, paths, "image_path", "hash").first().image_hash == "h1"
    with pytest.raises(Exception, match="hash not found: nope"):
        dedup.lookup(spark.createDataFrame([("nope",)], "image_path string"), paths, "image_path", "hash").collect()


def test_recalls(spark):
    r = ranked(spark, ["x", "a", "b", "y"], prefix="d/")
    gt = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "query_id bigint, gt_key string")
    got = {x.top_k: (x.candidate_count, x.recalled_gt_count, x.recall, x.missed) for x in evaluate.topk_recall(r, gt, [1, 2, 9]).collect()}
    assert got == {1: (1, 0, 0.0, ["a", "b", "c"]), 2: (2, 1, 0.333333, ["b", "c"]), 9: (4, 2, 0.666667, ["c"])}
    paths = gt.withColumn("gt_key", F.concat(F.lit("d/"), "gt_key"))
    total = spark.createDataFrame([(4,)], "total bigint")
    p = {x.percent: (x.candidate_count, x.recalled) for x in evaluate.percentile_recall(r, paths, [50, 100], total).collect()}
    assert p == {50: (2, ["d/a"]), 100: (4, ["d/a", "d/b"])}
    odd = paths.withColumn("gt_key", F.concat(F.lit("x/.././"), "gt_key")).union(paths)
    p = {x.percent: (x.gt_count, x.recalled) for x in evaluate.percentile_recall(r.withColumn("image_path", F.concat(F.lit(".//"), "image_path")), odd, [50, 100], total).collect()}
    assert p == {50: (3, ["d/a"]), 100: (3, ["d/a", "d/b"])}
    j = evaluate.judged(r, paths)
    assert [x.is_gt for x in j.orderBy("rank").collect()] == [False, True, True, False]
    x = evaluate.precision_at(j, [3]).first()
    assert (x.hits, x.precision, x.reciprocal_rank) == (2, 0.666667, 0.5)
    with pytest.raises(Exception, match="no ground truth for query 2"):
        evaluate.require_truth(spark.createDataFrame([(2,)], "query_id bigint"), gt).collect()


def test_manifests(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id bigint")
    m = {x.query_id: x for x in compare.comparison_manifest(q, ranked(spark, "abc"), ranked(spark, "acd")).collect()}
    assert (m[1].intersection_image_ids, m[1].only_embedding_image_ids, m[1].only_hybrid_image_ids) == (["a", "c"], ["b"], ["d"])
    assert m[2].embedding_image_ids == []
    f = compare.filter_manifest(q, ranked(spark, "abcd"), ranked(spark, "bxa"), ranked(spark, "ab"), 4, 3).where("query_id = 1").first()
    assert (f.embedding_top3_image_ids, f.filtered_out_image_ids, f.final_result_count) == (["a", "b", "c"], ["c"], 2)


def test_samples(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"))
    a = sample.stratified_sample(df, "g", "k", 20).collect()
    assert Counter(x.g for x in a) == {0: 20, 1: 20, 2: 20} and {x.candidate_count for x in a} == {166, 167}
    assert sorted(map(tuple, a)) == sorted(map(tuple, sample.stratified_sample(df.repartition(7), "g", "k", 20).collect()))
    assert sample.stratified_sample(df, "g", "k", 0).count() == 500


def test_top_k_breaks_ties_by_place(spark):
    df = spark.createDataFrame([(1, i, str(i), "", 1.0 + 1e-12 * i) for i in range(5)], "query_id bigint, corpus_pos bigint, image_id string, image_path string, score double")
    assert ids(top_k(df, 3)) == ["0", "1", "2"]


def test_percentile_recall_ranks_past_a_million(spark, tmp_path):
    """Vector 0 asks; scores fall with the id, so the top half of 2,100,000 ends at id 1,050,000."""
    n = 2_100_000
    label = F.when(F.col("id").isin(0, 5, 1_020_000, 2_000_000), 1).otherwise(0)
    v = F.array((1 - F.col("id") / n).cast("double"))
    spark.range(n).select(F.col("id").alias("vec_id"), v.alias("embedding"), label.alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(0, "x")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x.percent: (x.candidate_count, x.recalled_gt_count) for x in engine.percentile_recall(spark, str(tmp_path)).collect()}
    assert got == {10: (210_000, 1), 20: (420_000, 1), 30: (630_000, 1), 50: (1_050_000, 2)}


def test_hashes_by_path_as_it_is_and_resolved(spark):
    rows = [(0, "/r/a/1.jpg", "one", "h1", "a"), (1, "/r/b/2.jpg", "two", "h2", "b")]
    records = spark.createDataFrame(rows, "corpus_pos bigint, image_path string, caption string, image_hash string, label string")
    ask = spark.createDataFrame([("/r/a/1.jpg",), ("/r/x/../b//./2.jpg",)], "image_path string")
    assert {x.image_path: x.image_hash for x in dedup.hashes_of(ask, records).collect()} == {"/r/a/1.jpg": "h1", "/r/x/../b//./2.jpg": "h2"}
    with pytest.raises(Exception, match="hash not found: /r/a/3.jpg"):
        dedup.hashes_of(spark.createDataFrame([("/r/a/3.jpg",)], "image_path string"), records).collect()


def test_whole_groups_are_numbered_by_ranges(spark):
    df = spark.createDataFrame([("hot" if i % 10 else None, i * 7919 % 1000) for i in range(1000)], "g string, k int")
    got = sample.stratified_sample(df.where("g is not null"), "g", "k", 0).collect()
    assert [x.sample_index for x in sorted(got, key=lambda x: x.k)] == list(range(1, 901))
    assert {x.candidate_count for x in got} == {900}


def test_counted_terms(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), ([],), (["c"],)], "t array<string>")
    assert [[tuple(y) for y in x.n] for x in df.select(lexical.counted(F.col("t")).alias("n")).collect()] == [[("a", 1), ("b", 2)], [], [("c", 1)]]


def test_an_embedder_is_loaded_from_a_file(spark, tmp_path):
    script = f"{tmp_path}/model.py"
    with open(script, "w") as f:
        f.write("class Two:\n    def __init__(self, model_name_or_path, torch_dtype):\n        self.n = float(len(model_name_or_path)), float(torch_dtype == 'float16')\n"
                "    def process(self, inputs, normalize=True):\n        return [[*self.n, float(len(x['text']))] for x in inputs]\n")
    df = spark.createDataFrame([("ab",), ("",)], "t string")
    got = vectors.embed(df, "t", vectors.load_embedder(script, "four", "float16", "Two"))
    assert sorted(x.embedding for x in got.collect()) == [[4.0, 1.0, 0.0], [4.0, 1.0, 2.0]]
    with pytest.raises(Exception, match="No such file|no embedder"):
        vectors.embed(df, "t", vectors.load_embedder(f"{tmp_path}/none.py", "x")).collect()


def test_an_embedder_gets_its_texts_from_arrow_some_at_a_time(spark):
    """No batch becomes a pandas series of strings; sizes that don't divide a batch, null texts and empty frames."""
    from pyspark.util import PythonEvalType

    class Sizes:
        def process(self, inputs, normalize=True):
            assert len(inputs) <= 3 and all(isinstance(x["text"], str) for x in inputs)
            return [[float(len(x["text"])), float(len(inputs))] for x in inputs]

    df = spark.createDataFrame([(i, None if i == 5 else "x" * i) for i in range(10)], "i int, t string").coalesce(1)
    got = vectors.embed(df, "t", Sizes, batch=3)
    assert f"], {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}" in got._jdf.queryExecution().executedPlan().toString()
    assert [x.embedding[0] for x in got.orderBy("i").collect()] == [0, 1, 2, 3, 4, 0, 6, 7, 8, 9] and dict(got.dtypes)["embedding"] == "array<float>"
    assert vectors.embed(df.where("i > 99"), "t", Sizes).collect() == []
