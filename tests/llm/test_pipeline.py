import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F
from roadlens.llm import decision_list, factorization, pii

from .test_minmax_dedup import brute


def test_each_stage_on_its_own_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    columns = docs.columns
    ids = lambda df: {x.doc_id for x in df.select("doc_id").collect()}

    good = cp.quality_classifier(spark, docs, sf_dir)
    m = factorization.fit(docs, labels, where=lambda c: ~factorization.held_out(c))
    assert good.columns == columns
    assert ids(good) == {x.doc_id for x in factorization.score(docs, m, ["doc_id"]).collect() if x.score >= 0.7}

    ruled = cp.quality_rules(spark, docs, sf_dir)
    rules = decision_list.fit(docs, labels)
    assert ruled.columns == columns and rules
    assert ids(ruled) == {x.doc_id for x in decision_list.judged(docs, rules, ["doc_id"]).collect() if x["rule"] is None}

    unique = cp.near_dedup(spark, docs, sf_dir)
    rows = [(x.doc_id, x.text) for x in docs.collect()]
    assert unique.columns == columns
    assert ids(unique) == {i for i, _, _, kept in brute(rows, 5, 80) if kept}

    clean = cp.personal_data(spark, docs, sf_dir)
    assert clean.columns == columns and dict(clean.dtypes) == dict(docs.dtypes)
    texts = dict(rows)
    changed = 0
    for x in clean.collect():
        assert not pii.base_spans(x.text) and x.n_chars == len(x.text)
        spans = pii.base_spans(texts[x.doc_id])
        changed += x.text != texts[x.doc_id]
        assert not spans or x.text != texts[x.doc_id]
    assert 0 < changed < 60

    packed = cp.packing(spark, docs, sf_dir).collect()
    n = {}
    for x in packed:
        n[x.doc_id] = n.get(x.doc_id, 0) + x.length
    assert n == {i: len(t.encode().split()) + 1 for i, t in rows}


def test_the_run_and_odd_rows(spark, sf_dir, tmp_path):
    out = cp.run(spark, sf_dir)
    assert 50 < len({x.doc_id for x in out.collect()}) < 200
    rows = [(1, None, None, None, None, "x"), (None, "", "en", "s", 0, "y"), (3, "a b c", "en", "s", 5, "z"), (3, "a b c", "en", "s", 5, "z")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and got.count() == 4
    assert cp.run(spark, str(tmp_path)).count() == 4
    docs.limit(0).write.parquet(f"{tmp_path}/e/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/e/labels.parquet")
    assert cp.run(spark, f"{tmp_path}/e").count() == 0


def test_a_stopped_run_resumes(spark, sf_dir, tmp_path, monkeypatch):
    """Stages that are whole are not run again; one that was lost is."""
    ran = []

    def stage(name):
        def f(spark, docs, sf_dir):
            ran.append(name)
            if name == "c" and ran.count("c") == 1:
                raise RuntimeError("lost")
            return docs.where(f"doc_id % {2 + len(name)} >= 0")

        return name, f

    monkeypatch.setattr(cp, "STAGES", [stage(n) for n in "abcde"])
    with pytest.raises(RuntimeError):
        cp.run(spark, sf_dir, f"{tmp_path}/stages")
    assert cp.run(spark, sf_dir, f"{tmp_path}/stages").count() == 200
    assert ran == ["a", "b", "c", "c", "d", "e"]


def test_columns_with_the_names_of_the_operators_own(spark, sf_dir, monkeypatch):
    """The PII stage keeps them, and its texts equal those without them."""
    monkeypatch.setattr(pii, "train", lambda x, y: pii.Network.fresh())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(50).cache()
    own = ["__id", "__text", "__label", "__n", "__t", "__h", "c0"]
    more = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(own)])
    got = cp.personal_data(spark, more, sf_dir)
    assert got.columns == more.columns
    rows = got.collect()
    assert all(x[c] == i for x in rows for i, c in enumerate(own))
    assert {(x.doc_id, x.text, x.n_chars) for x in rows} == {(x.doc_id, x.text, x.n_chars) for x in cp.personal_data(spark, docs, sf_dir).collect()}
