import random

import pytest
from pyspark.sql import functions as F
from roadlens.operators import fusion, lexical, vectors
from roadlens.plans import retrieval

WORDS = ["rain", "car", "bus", "night", "red", "road", "lane", "dog"]


@pytest.fixture(scope="module")
def frames(spark):
    r = random.Random(8)
    texts = [" ".join(r.choice(WORDS) for _ in range(r.randint(0, 5))) for _ in range(90)] + ["rain car"] * 25
    rows = [(i * 7 % 211, str(i), f"p/{i}.jpg", t) for i, t in enumerate(texts)]
    corpus = spark.createDataFrame(rows, "corpus_pos bigint, image_id string, image_path string, caption string").repartition(5).cache()
    asked = [("rain", ["rain car", "dog", "???"]), ("x", ["  ", "???", "bus bus", "rain"]), ("none", ["zebra", "yak"]), ("one", ["red road"]), ("two", ["zebra", "night lane", "lane"])]
    queries = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "query_id bigint, search_query string, expanded array<string>")
    return corpus, queries


def merged_from_full_rankings(backend, queries, k, n):
    """Each phrasing's ranking of the whole corpus, then the maximum by path."""
    each = queries.select("query_id", F.posexplode("expanded").alias("query_pos", "search_query")).where("trim(search_query) <> ''")
    each = each.select(F.struct("query_id", "query_pos").alias("query_id"), "search_query")
    found = backend.search(each, n).withColumn("query_pos", F.col("query_id.query_pos")).withColumn("query_id", F.col("query_id.query_id"))
    return fusion.max_merge(found, k)


def listed(df):
    return [(x.query_id, x["rank"], x.image_path, round(x.score, 9)) for x in df.orderBy("query_id", "rank").collect()]


@pytest.mark.parametrize("name", ["bm25", "tfidf_faiss", "qwen3vl_embedding_faiss"])
def test_expanded_queries_equal_merged_full_rankings(frames, name):
    corpus, queries = frames
    b = retrieval.backend(name, corpus, vectors.HashEmbedder)
    for k in (1, 4, 40, 200):
        got = retrieval.retrieve(b, queries, k, expanded=True)
        assert listed(got) == listed(merged_from_full_rankings(b, queries, k, 115))
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Cross" not in plan
    assert listed(retrieval.retrieve(b, queries, 4, expanded=True, depth=115)) == listed(got.where("rank <= 4"))


def test_a_path_of_several_rows_is_listed_once(frames, monkeypatch):
    """With the best of its rows, in whichever tasks they are."""
    corpus, queries = frames
    hot = corpus.withColumn("image_path", F.when(F.col("image_id").cast("int") % 3 > 0, "p/hot.jpg").otherwise(F.col("image_path")))
    for name in ("bm25", "qwen3vl_embedding_faiss"):
        got = listed(retrieval.retrieve(retrieval.backend(name, hot, vectors.HashEmbedder), queries, 20, expanded=True))
        want = {}
        for q, n, path, score in listed(retrieval.retrieve(retrieval.backend(name, corpus, vectors.HashEmbedder), queries, 200, expanded=True)):
            i = int(path[2:-4])
            want.setdefault(q, {}).setdefault("p/hot.jpg" if i % 3 else path, (n, score))
        assert [(q, p, s) for q, _, p, s in got] == [(q, p, s) for q in sorted(want) for p, (_, s) in sorted(want[q].items(), key=lambda x: x[1])[:20]]


def test_queries_in_parts_and_blocks_of_rows(frames, monkeypatch):
    corpus, queries = frames
    index = lexical.bm25_index(corpus)
    want = listed(lexical.bm25_search(index, queries, 30))
    whole = [x for x in listed(lexical.bm25_search(index, queries, None)) if x[1] <= 30]
    assert want == whole
    monkeypatch.setattr(lexical, "MOST_PHRASINGS", 2)
    monkeypatch.setattr(lexical.blocks, "PRODUCTS", 17)
    assert listed(lexical.bm25_search(index, queries, 30)) == want


def test_norms_with_few_terms_held(frames, monkeypatch):
    corpus, _ = frames
    rows = lambda: {x.corpus_pos: [round(w, 12) for w in x.weight] for x in lexical.tfidf_index(corpus).rows.select("corpus_pos", "weight").collect()}
    want = rows()
    assert len(want) == 115 and any(want.values())
    for most in (60, 5, 0):
        monkeypatch.setattr(lexical, "MOST_IDF", most)
        assert rows() == want


def test_only_the_best_rows_leave_a_task(frames):
    corpus, queries = frames
    got = lexical.bm25_search(lexical.bm25_index(corpus), queries, 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Generate" not in plan and "NestedLoop" not in plan


def test_hybrid_needs_a_depth(frames):
    corpus, queries = frames
    b = retrieval.backend("hybrid_embedding_bm25", corpus, vectors.HashEmbedder)
    with pytest.raises(ValueError, match="depth"):
        retrieval.retrieve(b, queries, 3, expanded=True)
    assert retrieval.retrieve(b, queries, 3, expanded=True, depth=20).count() > 0


def test_a_stored_index_reads_the_blocks_that_matter(spark, tmp_path, monkeypatch):
    """A common word everywhere and rare ones in a few stretches: most ranges can't reach the tenth score."""
    from roadlens.operators import stored

    r = random.Random(3)
    texts = []
    for i in range(4000):
        words = ["road", *(r.choice(WORDS) for _ in range(r.randint(1, 30)))]
        texts.append(" ".join(words + ["tram"] * (3 if i % 1000 < 9 else 0) + ["comet"] * (i == 77)))
    corpus = spark.createDataFrame([(i * 3, str(i), f"p/{i}.jpg", t) for i, t in enumerate(texts)], "corpus_pos bigint, image_id string, image_path string, caption string").repartition(6)
    monkeypatch.setattr(stored, "RANGE", 100)
    index = lexical.bm25_index(corpus)
    index.write(f"{tmp_path}/ix")
    back = lexical.Postings.read(spark, f"{tmp_path}/ix")
    ask = ["tram on a road", "road tram tram night", "comet", "road", "zebra", "???", "dog bus"]
    queries = spark.createDataFrame(list(enumerate(ask)), "query_id bigint, search_query string")
    for k in (1, 10, 60):
        assert listed(lexical.bm25_search(back, queries, k)) == listed(lexical.bm25_search(index, queries, k))
    tf = lexical.tfidf_index(corpus.limit(500))
    tf.write(f"{tmp_path}/tf")
    assert listed(lexical.tfidf_search(lexical.Postings.read(spark, f"{tmp_path}/tf"), queries, 5)) == listed(lexical.tfidf_search(tf, queries, 5))
    # rows read for the first query: its blocks in the ranges that are needed, of all that its terms have
    terms = index.terms.where("term in ('tram', 'road')").select(F.lit(0).cast("bigint").alias("q"), "term", F.col("idf").alias("w"))
    blocks = stored.Blocks(f"{tmp_path}/ix/blocks", terms, ["tram", "road"])
    seeds, rest, _ = stored.needed(blocks, 10)
    every = blocks.scan(spark).count()
    read = blocks.scan(spark).join(seeds.select("q", "range").union(rest), "range").count()
    assert every >= 44 and read <= every / 4
    plan = blocks.bounds()._jdf.queryExecution().executedPlan().toString()
    assert "pos:array" not in plan and "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    monkeypatch.setattr(stored, "MOST_NAMED", 1)
    assert listed(lexical.bm25_search(back, queries, 10)) == listed(lexical.bm25_search(index, queries, 10))


def test_hashed_grams_are_those_of_the_column_function(spark):
    """Their equality, counts and order of magnitude: odd letters, white space and line ends inside a text, and texts side by side."""
    from roadlens.functions.text import grams as by_column
    from roadlens.operators.grams import Grams

    texts = ["Tiếng Việt ﬁre café", "Ǆ ½½ ㎏ Å ẞß İi", "한국어 가나 中文字", "ｆｕｌｌ ＷＩＤＴＨ", "ΟΔΟΣ ΟΔΟΣ σας", "", "\n", "red\nbus\n\nred bus a_b", "a b c", "x1 ١٢ ⅷⅷ éé 🚌bus", "red bus"] + [f"w{i} W{i % 7}" for i in range(300)]
    named = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", by_column(F.col("t")).alias("g")).orderBy("i").collect()
    for hashes in (Grams().of(texts), [Grams().of([t])[0] for t in texts]):
        number = {}
        assert [len(h) for h in hashes] == [len(x.g) for x in named]
        for x, h in zip(named, hashes, strict=True):
            for term, v in zip(x.g, h.tolist(), strict=True):
                assert number.setdefault(term, v) == v
        assert len(set(number.values())) == len(number)


def test_norms_of_packed_postings_in_many_groups(frames, monkeypatch):
    """Against plain sums, with none, few or all terms held and a group for every few postings; also joined instead of broadcast. No strings are shuffled."""
    import math
    from collections import Counter

    from roadlens.operators import grams

    corpus, _ = frames
    texts = {x.corpus_pos: x.caption.split() for x in corpus.collect()}
    count = {p: Counter(w + [" ".join(x) for x in zip(w, w[1:])]) for p, w in texts.items()}
    df = Counter(t for c in count.values() for t in c)
    want = {p: round(math.sqrt(sum((n * (math.log(116 / (1 + df[t])) + 1)) ** 2 for t, n in c.items())), 9) for p, c in count.items()}
    for held, size, norms in ((0, 7, 0), (9, 50, 10**6), (10**6, 10**6, 0)):
        monkeypatch.setattr(grams, "POSTINGS", size)
        monkeypatch.setattr(grams, "MOST_NORMS", norms)
        rows, terms = grams.index(corpus, "caption", held)
        assert {x.corpus_pos: round(x.norm, 9) for x in rows.select("corpus_pos", "norm").collect()} == want
        assert sorted(x.df for x in terms.collect()) == sorted(df.values()) and dict(terms.dtypes)["term"] == "bigint"


def test_blocks_are_made_where_a_range_is(spark, frames, tmp_path, monkeypatch):
    """Each of a range's postings is in one block of its term, without a shuffle of single postings."""
    from roadlens.operators import stored

    corpus, _ = frames
    monkeypatch.setattr(stored, "RANGE", 20)
    index = lexical.bm25_index(corpus)
    plans, write = [], stored.saved
    monkeypatch.setattr(stored, "saved", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    stored.write_blocks(index.rows, f"{tmp_path}/b")
    assert "Generate" not in plans[0] and "Aggregate" not in plans[0] and plans[0].count("Exchange") == 1
    got = spark.read.parquet(f"{tmp_path}/b").collect()
    want = sorted((x.term, x.corpus_pos, x.weight) for x in index.postings.collect())
    assert sorted((x.term, p, w) for x in got for p, w in zip(x.pos, x.weight, strict=True)) == want
    assert len({(x.term, x.range) for x in got}) == len(got) and len({x.range for x in got}) > 3
    assert all(x.most == max(x.weight) and x.least == min(x.weight) and x.pos == sorted(x.pos) for x in got)


def test_scoring_takes_some_terms_at_a_time(spark, frames, monkeypatch):
    """However many rows an Arrow batch has, with the same best rows."""
    corpus, _ = frames
    asked = spark.createDataFrame([(0, "x", [0])], "q long, query_id string, places array<int>")
    each = spark.createDataFrame([(0, 0, "rain", 1.0), (0, 0, "dog", 2.0)], "n long, query_pos int, term string, q double")
    run = lexical._scored(asked, each, 12, False)
    batch = lexical.bm25_index(corpus).rows.select("corpus_pos", "image_id", "image_path", "terms", "weight").toArrow().combine_chunks().to_batches()[0]
    best = lambda: sorted((x["corpus_pos"], x["score"]) for b in run(iter([batch])) for x in b.to_pylist())
    want, seen, scores = best(), [], lexical._Held.scores
    monkeypatch.setattr(lexical, "SLICE", 20)
    monkeypatch.setattr(lexical._Held, "scores", lambda self, terms, *a: seen.append(len(terms)) or scores(self, terms, *a))
    assert best() == want and len(want) == 12
    assert len(seen) > 5 and max(seen) <= 20


def test_the_view_index_scores_as_an_index_of_the_lexical_view(spark):
    """Captions with headings, plates, times, stopwords, repeats, CJK and odd letters; its terms are hashes that no string term is made for."""
    texts = [
        "## Lighting: a red bus, the red road", "  - **Overall**\nbus over 东京 东京塔 road", "plate AB123C at 2024-01-02 03:04:05 on ch07, x1 y", "٣ bus ab٣ red", "K9 Kilo İstanbul ΟΔΟΣ café ﬁre",
        "the a an", "", None, "bus*road**red\u00a0night\u3000dog", "main road\nmain: road\nMAIN – bus", "red bus\nbackground\nred bus", "spatial and lighting. dog", "\n\nlighting dog", "kilo", "2 bus", "İmmediate: dog Immediate: dog",
    ]
    corpus = spark.createDataFrame([(i, str(i), f"p/{i}.jpg", t) for i, t in enumerate(texts)], "corpus_pos bigint, image_id string, image_path string, caption string")
    ask = ["red bus", "东京 road", "2024 ab123c x1 y 9 kilo", "lighting overall main background dog", "the", "???", "stanbul caf re i immediate ab"]
    queries = spark.createDataFrame(list(enumerate(ask)), "query_id bigint, search_query string")
    index, plain = lexical.bm25_view_index(corpus), lexical.bm25_index(retrieval.lexical_view(corpus))
    assert dict(index.rows.dtypes)["terms"] == "array<bigint>" and dict(index.terms.dtypes)["term"] == "bigint"
    for k in (3, 20, None):
        assert listed(lexical.bm25_search(index, queries, k)) == listed(lexical.bm25_search(plain, queries, k))
    stats = lambda x: sorted((t.df, round(t.idf, 9)) for t in x.terms.collect())
    sizes = lambda x: {r.corpus_pos: (r.dl, len(r.terms), [round(w, 12) for w in sorted(r.weight)]) for r in x.rows.collect()}
    assert stats(index) == stats(plain) and sizes(index) == sizes(plain)


def test_searches_weigh_only_what_they_look_up(frames):
    """No weight of a whole row is made in the plan of a search; with the same scores as by stored weights."""
    from dataclasses import replace

    corpus, queries = frames
    for index, search in ((lexical.bm25_index(corpus), lexical.bm25_search), (lexical.tfidf_index(corpus), lexical.tfidf_search)):
        got = search(index, queries, 30)
        assert "lambda" not in got._jdf.queryExecution().executedPlan().toString()
        assert listed(got) == listed(search(replace(index, rule=None), queries, 30))


def test_places_of_hashes_in_a_table():
    import numpy as np
    from roadlens.operators.grams import _Lookup

    r = np.random.default_rng(4)
    for n in (0, 1, 2, 5000):
        known = np.unique(np.append(r.integers(0, 2**64, n, dtype=np.uint64), np.array([2**64 - 1], np.uint64)[: n % 2]))
        x = np.concatenate((known[::2], r.integers(0, 2**64, 99, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)))
        at, here = _Lookup(known)(x.view(np.int64))
        assert (here == np.isin(x, known)).all() and (known[at[here]] == x[here]).all()


def test_the_frozen_flows_index_the_view_by_hashes(spark, sf_dir, monkeypatch):
    from roadlens.plans import queries as engine

    def strings(*_):
        raise AssertionError("string terms were counted")

    monkeypatch.setattr(lexical, "term_rows", strings)
    rows = engine.frozen_hybrid(spark, sf_dir).collect()
    assert {x["rank"] for x in rows} == set(range(1, 21)) and len(rows) == 20 * engine.asked(spark, sf_dir).count()


def test_hashed_rows_are_stored_and_searched_packed(frames):
    """A row's terms are one binary value in what is stored and what searches read; arrays are made only of rows that are asked for, with the same scores."""
    from dataclasses import replace

    import numpy as np

    corpus, queries = frames
    corpus = corpus.withColumn("caption", F.when(F.col("corpus_pos") % 7 == 3, "").otherwise(F.col("caption")))
    for index, search in ((lexical.bm25_view_index(corpus), lexical.bm25_search), (lexical.tfidf_index(corpus), lexical.tfidf_search)):
        assert dict(index.packed.dtypes)["terms"] == dict(index.packed.dtypes)["tf"] == "binary"
        rows = {x.corpus_pos: x for x in index.rows.collect()}
        packed = index.packed.collect()
        assert len(packed) == len(rows) == corpus.count()
        for x in packed:
            assert rows[x.corpus_pos].terms == np.frombuffer(x.terms, np.int64).tolist() and rows[x.corpus_pos].tf == np.frombuffer(x.tf, np.int32).tolist()
        got = search(index, queries, 30)
        assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        assert listed(got) == listed(search(replace(index, packed=None), queries, 30))


def test_sums_of_norms_are_passed_on_packed(spark, monkeypatch):
    """Nearly each document has terms in nearly each group, so no row is made of a document in a group: a bucket of documents gets one from each."""
    import math

    from roadlens.operators import grams

    words = [[f"w{(i * 7 + j * j) % 90}" for j in range(30)] for i in range(60)]
    corpus = spark.createDataFrame([(i * 3 - 50, str(i), "p", " ".join(w)) for i, w in enumerate(words)], "corpus_pos bigint, image_id string, image_path string, caption string")
    monkeypatch.setattr(grams, "POSTINGS", 100)
    rows = grams.counted(corpus.select("corpus_pos", "caption"), "caption", packed=True).localCheckpoint()
    terms = grams.document_counts(rows, 60 * 59).localCheckpoint()
    assert terms.where("df = 1").count() < terms.count()
    got = grams.norms(rows, terms, 60, 0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "HashAggregate" not in plan
    df = {x.term: x.df for x in terms.collect()}
    plain = {x.corpus_pos: math.sqrt(sum((n * (math.log(61 / (1 + df[t])) + 1)) ** 2 for t, n in zip(x.terms, x.tf, strict=True))) for x in grams.unpacked(rows).collect()}
    assert {x.corpus_pos: round(x.norm, 9) for x in got.collect()} == {k: round(v, 9) for k, v in plain.items()}
