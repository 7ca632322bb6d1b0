import numpy as np

from roadlens.llm import factorization as fm


def test_pairs_by_the_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    m = fm.Machine(0.3, rng.normal(size=fm.SIZE).astype(np.float32), rng.normal(size=(fm.SIZE, 4)).astype(np.float32))
    ids, counts = np.array([5, 9, 40, 7, 9], np.int32), np.array([3, 2])
    x = rng.normal(size=5).astype(np.float32)
    want = []
    for a, b in ((0, 3), (3, 5)):
        i, v = ids[a:b], x[a:b]
        pairs = sum(float(m.factors[i[j]] @ m.factors[i[k]]) * v[j] * v[k] for j in range(b - a) for k in range(j))
        want.append(0.3 + float(m.linear[i] @ v) + pairs)
    assert np.allclose(m.logits(ids, x, counts), want, atol=1e-4)


def corpus(n=600):
    rng = np.random.default_rng(3)
    good, bad = [f"good{i}" for i in range(80)], [f"bad{i}" for i in range(80)]
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.6)
        words = rng.choice(good if y else bad, 6).tolist() + [f"w{k}" for k in rng.integers(0, 300, 30)]
        rows.append((i, " ".join(words), y))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "en", "s", 7) for i, t, _ in rows], "doc_id long, text string, lang string, source string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    m = fm.fit(df, labels, where=lambda c: ~fm.held_out(c), chars_col=None)
    got = fm.score(df, m, ["doc_id"]).withColumn("held", fm.held_out()).toPandas()
    got["y"] = got.doc_id.map({i: y for i, _, y in rows})
    out = got[got.held]
    assert len(out) > 80 and ((out.score > 0.5) == (out.y == 1)).mean() > 0.95
    again = fm.fit(df.repartition(7), labels, where=lambda c: ~fm.held_out(c), chars_col=None)
    assert np.allclose(again.linear, m.linear)


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", 0), (None, "a b", -5), (4, "x" * 200_000, 9), (4, "x" * 200_000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1), (4, 7)], "doc_id long, quality int")
    m = fm.fit(df, labels)
    got = fm.score(df, m, ["doc_id"]).collect()
    assert len(got) == 5 and all(0 <= x.score <= 1 for x in got)
    untrained = fm.fit(df, labels.limit(0))
    assert not untrained.trained and {x.score for x in fm.score(df, untrained, ["doc_id"]).collect()} == {0.5}
    assert fm.score(df.limit(0), m, ["doc_id"]).count() == 0


def test_the_query(spark, sf_dir):
    import zlib

    from roadlens.llm.queries import op8_factorisation_machine

    labels = {x.doc_id: x.quality for x in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = op8_factorisation_machine(spark, sf_dir).collect()
    assert sorted(x.doc_id for x in got) == sorted(x.doc_id for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    for x in got:
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7)
    # labels of held-out rows change nothing (23 of them are too few for a figure of accuracy)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    flipped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels.items()], "doc_id long, quality int")
    m = fm.fit(docs, flipped, where=lambda c: ~fm.held_out(c))
    assert {x.doc_id: x.score for x in fm.score(docs, m, ["doc_id"]).collect()} == {x.doc_id: x.score for x in got}


def test_the_driver_gathers_two_bytes_a_value(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    df = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j) % 300}" for j in range(200))) for i in range(60)], "doc_id long, text string")
    got, whole = [], DataFrame.toPandas
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: got.append(whole(self)) or got[-1])
    assert fm.fit(df, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")).trained
    _, x, counts = fm.Features().of([t.text.encode() for t in df.collect()], [None] * 60)
    values = [f[c].map(len).sum() for f in got for c in f.columns if f[c].dtype == object]
    assert sum(values) == 2 * counts.sum() > 20_000
    one = counts[0] - fm.N_STATS
    assert np.allclose(x[:one], one**-0.5) and np.allclose(x[one : counts[0]], 0.3)
