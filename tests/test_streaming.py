import json
import os

import pytest
from pyspark.sql import functions as F
from roadlens.operators import lexical
from roadlens.sources.captions import read_captions
from roadlens.streaming import captioning, ingest


def put(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)


def row(path, caption, success=True):
    return {"image_path": path, "success": success, "caption": caption}


def run(spark, d):
    ingest.append_captions_to(f"{d}/ix", ingest.caption_stream(spark, f"{d}/in"), f"{d}/ck").awaitTermination()


def found(index, spark, k=10):
    q = spark.createDataFrame([(0, "red car"), (1, "bus at night"), (2, "zebra")], "query_id bigint, search_query string")
    return [(x.query_id, x["rank"], x.image_path, round(x.score, 9)) for x in lexical.bm25_search(index, q, k).orderBy("query_id", "rank").collect()]


def test_a_stream_can_be_searched_after_each_trigger(spark, tmp_path):
    d = str(tmp_path)
    assert ingest.live_corpus(spark, f"{d}/ix").count() == 0 if os.path.isdir(f"{d}/ix/corpus") else True
    put(f"{d}/in", "1", [row(f"/a/{i}.jpg", f"red car {i % 5}") for i in range(12)] + [row("/x.jpg", "lost", False), row("/y.jpg", "  ")])
    run(spark, d)
    corpus = ingest.live_corpus(spark, f"{d}/ix")
    assert sorted((x.image_path, x.caption) for x in corpus.collect()) == sorted((min(f"/a/{i}.jpg" for i in range(12) if i % 5 == c), f"red car {c}") for c in range(5))
    assert found(ingest.live_index(spark, f"{d}/ix"), spark) == found(lexical.bm25_index(corpus), spark)
    put(f"{d}/in", "2", [row(f"/b/{i}.jpg", f"bus at night {i % 3}") for i in range(9)] + [row("/b/z.jpg", "red car 3")])
    run(spark, d)
    corpus = ingest.live_corpus(spark, f"{d}/ix")
    assert corpus.count() == 8 and corpus.select("corpus_pos").distinct().count() == 8
    assert [x.image_path for x in corpus.orderBy("corpus_pos").collect()] == ["/a/0.jpg", "/a/1.jpg", "/a/2.jpg", "/a/3.jpg", "/a/4.jpg", "/b/0.jpg", "/b/1.jpg", "/b/2.jpg"]
    got = found(ingest.live_index(spark, f"{d}/ix"), spark)
    assert got == found(lexical.bm25_index(corpus), spark) and len(got) == 24


def test_each_content_once_without_state(spark, tmp_path):
    """Repeats within a batch, in the next, and long after; a batch that runs again; one that failed half way; and a stream without dropDuplicates."""
    d = str(tmp_path)
    for n in range(4):
        put(f"{d}/in", str(n), [row(f"/{n}/{i}.jpg", f"caption {i}") for i in range(n * 10, n * 10 + 15)] * 2)
        run(spark, d)
    put(f"{d}/in", "9", [row("/late.jpg", "caption 2"), row("/new.jpg", "caption 999")])
    run(spark, d)
    ix = f"{d}/ix"
    corpus = ingest.live_corpus(spark, ix)
    assert sorted(x.caption for x in corpus.collect()) == sorted([f"caption {i}" for i in range(45)] + ["caption 999"])
    log = {x.number: x for x in ingest.log(spark, ix).collect()}
    assert [log[n].rows for n in sorted(log)] == [15, 10, 10, 10, 1]
    again = corpus.limit(3).drop("corpus_pos")
    assert ingest.append(again, ix, log[0].source, 2) is None
    assert ingest.append(again, ix, "other", 0) == 6 and ingest.live_corpus(spark, ix).count() == 46
    # a batch that wrote all but its log's row is as if it had not been, and is done again under its number
    more = spark.createDataFrame([("n", "/n.jpg", "never seen", "ab" * 32)], "image_id string, image_path string, caption string, caption_hash string")
    assert ingest.append(more, ix, "other", 1) == 7
    os.rename(f"{ix}/log/seq=7", f"{tmp_path}/gone")
    assert ingest.live_corpus(spark, ix).count() == 46
    assert ingest.append(more, ix, "other", 1) == 7 and ingest.live_corpus(spark, ix).count() == 47
    stream = ingest.caption_stream(spark, f"{d}/in")
    assert "Deduplicate" not in stream._jdf.queryExecution().analyzed().toString()


def test_filters_spare_folders_and_lose_no_hash(spark, tmp_path, monkeypatch):
    ix = f"{tmp_path}/ix"
    rows = spark.range(3000).select(F.col("id").cast("string").alias("image_id"), F.concat(F.lit("/"), "id").alias("image_path"), F.col("id").cast("string").alias("caption"))
    rows = rows.withColumn("caption_hash", F.sha2("caption", 256)).cache()
    monkeypatch.setattr(ingest, "FILTER_DIGITS", 1)
    for i in range(3):
        ingest.append(rows.where(F.col("image_id").cast("int") % 3 == i), ix, "s", i)
    assert ingest._unseen(rows, ix).count() == 0
    new = rows.withColumn("caption_hash", F.sha2(F.concat(F.lit("x"), "caption"), 256)).limit(5)
    read = []
    real = ingest.saved
    monkeypatch.setattr(ingest, "saved", lambda df: read.append(real(df)) or read[-1])
    assert ingest._unseen(new, ix).count() == 5
    assert read[0].count() <= 2  # of 48 folders
    some = new.unionByName(rows.where("image_id = '7'"))
    assert ingest._unseen(some, ix).count() == 5 and 1 <= read[1].count() <= 3


class Model:
    """Writes down what it is asked; one image stops the whole application's job."""

    def __init__(self, seen, deadly):
        self.seen, self.deadly = seen, deadly

    def __call__(self):
        def infer(path, prompt):
            name = os.path.basename(path)
            if self.deadly and name == self.deadly:
                raise SystemExit("lost")
            with open(f"{self.seen}/{name}", "a") as f:
                f.write("x")
            if name.startswith("bad"):
                raise ValueError("unreadable")
            return f"{prompt} {name}"

        return infer


def test_captioning_resumes(spark, tmp_path):
    images, out, seen, ck = (f"{tmp_path}/{n}" for n in ("images", "out", "seen", "ck"))
    os.makedirs(seen)
    names = [f"{i}.jpg" for i in range(8)] + ["bad1.png", "note.txt"]
    for i, n in enumerate(names):
        os.makedirs(f"{images}/{i % 2}", exist_ok=True)
        with open(f"{images}/{i % 2}/{n}", "w") as f:
            f.write("x")
        os.utime(f"{images}/{i % 2}/{n}", (1000 + i, 1000 + i))
    start = lambda deadly, **more: captioning.caption_stream_to(out, captioning.image_stream(spark, images, 2), Model(seen, deadly), ck, "See", **more)
    with pytest.raises(Exception, match="lost|crashed|exited"):
        start("6.jpg").awaitTermination()
    have = {os.path.basename(x.image_path) for x in captioning.stored(spark, out).collect()}
    assert {"0.jpg", "1.jpg", "2.jpg", "3.jpg"} <= have < set(names)
    start(None).awaitTermination()
    rows = captioning.stored(spark, out).collect()
    assert sorted(os.path.basename(x.image_path) for x in rows) == sorted(names[:-1])
    asked = {n: len(open(f"{seen}/{n}").read()) for n in os.listdir(seen)}
    assert all(asked[n] == 1 for n in have)
    assert {x.caption for x in rows if x.success} == {f"See {i}.jpg" for i in range(8)} and [x.error for x in rows if not x.success] == ["ValueError: unreadable"]
    s = captioning.summary(spark, out).first()
    assert (s.total_images, s.success_images, s.failed_images) == (9, 8, 1)
    assert read_captions(spark, out, lines=True).count() == 8
    # another run over the same images, by a new query: nothing is asked but what failed, on request
    again = captioning.caption_stream_to(out, captioning.image_stream(spark, images, 100), Model(seen, None), f"{ck}2", "See", retry=True)
    again.awaitTermination()
    assert {n: len(open(f"{seen}/{n}").read()) for n in os.listdir(seen)} == asked | {"bad1.png": 2}
    assert captioning.summary(spark, out).first().total_images == 9
