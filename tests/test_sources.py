import json
import os

import pytest
from pyspark.sql import functions as F

from roadlens.plans import retrieval
from roadlens.operators import lexical, vectors
from roadlens.sources import captions as cs
from roadlens.sources import queries as qs
from roadlens.sources import sinks
from roadlens.sources.folders import _Writer, _Written, copy_folders


def put(path, value):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))
    return str(path)


ROWS = [
    {"image_path": "/r/rain/a.b.jpg", "success": True, "caption": " red car ", "inference_seconds": 1.5},
    {"image_path": "/r/rain/x.jpg", "success": False, "error": "boom"},
    {"image_path": " ", "success": True, "caption": "no path"},
    {"image_path": "/r/y.jpg", "success": True, "caption": None},
    {"image_path": "/r/z.jpg", "success": "false", "caption": "text false"},
    {"image_path": "/r/night/.jpg", "success": True, "caption": "night"},
]


def test_caption_files(spark, tmp_path):
    p = put(f"{tmp_path}/c.json", {"summary": {"total_images": 6}, "results": ROWS})
    got = [(x.corpus_pos, x.image_id, x.image_path, x.caption) for x in cs.read_captions(spark, p).orderBy("corpus_pos").collect()]
    assert got == [(0, "a.b", "/r/rain/a.b.jpg", "red car"), (5, ".jpg", "/r/night/.jpg", "night")]
    lines = put(f"{tmp_path}/c.jsonl", "\n".join(json.dumps(r) for r in ROWS if r["success"] != "false"))
    assert [x.image_id for x in cs.read_captions(spark, lines).orderBy("corpus_pos").collect()] == ["a.b", ".jpg"]
    with pytest.raises(Exception, match="list named results"):
        cs.read_captions(spark, put(f"{tmp_path}/bad.json", {"summary": {}})).collect()


def test_query_files(spark, tmp_path):
    items = ["  rain ", {"zh_query": "雨", "en_query": "rain"}, {"display_query": "only"}, {"search_query": "s"}, {}, 3, None, "  ", {"query": " ", "display_query": "d", "english_query": "e"}]
    p = put(f"{tmp_path}/q.json", {"queries": items})
    read = lambda m: [(x.display_query, x.search_query) for x in qs.read_queries(spark, query_file=p, mode=m).orderBy("query_id").collect()]
    assert read("search") == [("rain", "rain"), ("雨", "rain"), ("only", "only"), ("s", "s"), ("3", "3"), ("d", "e")]
    assert read("eval") == [("rain", "rain"), ("雨", "rain"), ("only", "only"), ("s", "s"), ("d", "e")]
    assert read("demo") == [("rain", "rain"), ("only", "only"), ("s", "s"), ("d", "e")]
    assert qs.read_queries(spark).count() == 3
    assert qs.read_queries(spark, " x ").first().search_query == "x"
    for bad in ({"queries": [" "]}, {"other": 1}, {"queries": {"a": 1}}):
        with pytest.raises(Exception):
            qs.read_queries(spark, query_file=put(f"{tmp_path}/b.json", bad)).collect()
    with pytest.raises(ValueError):
        qs.read_queries(spark, "a", p)


def test_images_truth_and_migration(spark, tmp_path):
    root = f"{tmp_path}/raw"
    for name in ("rain/1.jpg", "rain/deep/2.PNG", "night/3.webp", "night/skip.txt", "top.bmp"):
        put(f"{root}/{name}", name)
    got = {x.image_path.removeprefix(root): x.label for x in cs.read_images(spark, root).collect()}
    assert got == {"/rain/1.jpg": "rain", "/rain/deep/2.PNG": "rain", "/night/3.webp": "night", "/top.bmp": "top.bmp"}
    assert [x.image_path.removeprefix(root) for x in cs.read_images(spark, root, max_images=2).collect()] == ["/night/3.webp", "/rain/1.jpg"]
    assert cs.read_images(spark, root, "rain").count() == 2
    assert cs.read_truth(spark, root, {7: "rain"}).count() == 2
    with pytest.raises(ValueError, match="fog"):
        cs.read_truth(spark, root, {7: "fog"})
    c = spark.createDataFrame([("/old/input/raw/a.jpg",), ("/old/input/raw/b.jpg",), ("/new/keep.jpg",)], "image_path string")
    have = spark.createDataFrame([("/new/input/raw/a.jpg",), ("/new/keep.jpg",)], "image_path string")
    assert sorted(x.image_path for x in cs.migrated(c, have, "/new").collect()) == ["/new/input/raw/a.jpg", "/new/keep.jpg", "/old/input/raw/b.jpg"]
    b = cs.image_bytes(spark.createDataFrame([("data:image/png;base64,aGk=",), ("aGk=",)], "image_b64 string"))
    assert {bytes(x.content) for x in b.collect()} == {b"hi"}
    with pytest.raises(Exception, match="blank image"):
        cs.image_bytes(spark.createDataFrame([(" ",)], "image_b64 string")).collect()


def small(spark):
    rows = [(i, str(i), f"/r/{'rain' if i % 2 else 'night'}/{i}.jpg", t) for i, t in enumerate(["red car", "blue car rain", "night road", "rain rain", "bus"])]
    return spark.createDataFrame(rows, "corpus_pos bigint, image_id string, image_path string, caption string")


def test_reports_go_round(spark, tmp_path):
    c = small(spark)
    q = qs.read_queries(spark, "rain car").withColumn("expanded", F.array(F.lit("rain car"), F.lit("bus")))
    r = retrieval.retrieve(retrieval.backend("bm25", c), q, 3)
    sinks.write_json(sinks.report(r, q, {"backend": "bm25"}), f"{tmp_path}/rep")
    back = spark.read.json(f"{tmp_path}/rep").first()
    assert back.recall_count == 3 and back.summary.backend == "bm25" and [x.rank for x in back["items"]] == [1, 2, 3]
    p = put(f"{tmp_path}/frozen.json", {"query_results": [{"query": "rain car", "items": [{"rank": n, "image_id": i, "image_path": f"/r/{i}.jpg", "score": 0.5} for n, i in (("1", "3"), (None, "1"), ("x", "0"))]}]})
    frozen = cs.read_report(spark, p)
    assert [(x.rank, x.image_id) for x in frozen.orderBy("rank").collect()] == [(1, "3"), (2, "1"), (3, "0")]
    view = lexical.bm25_index(retrieval.lexical_view(c))
    hybrid, manifest = retrieval.frozen_hybrid(frozen, view, q.withColumn("query_id", F.lit(0).cast("bigint")), 3, 1, 2)
    assert [x.image_id for x in hybrid.orderBy("rank").collect()][0] == "3" and manifest.first().only_hybrid_image_ids == []
    kept, _ = retrieval.frozen_gate(frozen, view, q)
    assert {x.image_id for x in kept.collect()} <= {"3", "1", "0"}
    with pytest.raises(ValueError):
        retrieval.frozen_gate(frozen, view, q, output_max_k=5)
    two = spark.createDataFrame([(0, "rain", "rain"), (9, "car", "car")], "query_id bigint, display_query string, search_query string")
    with pytest.raises(Exception, match="frozen ranking of query not found: 9"):
        retrieval.frozen_gate(frozen.withColumn("query_id", F.lit(0).cast("bigint")), view, two)[0].collect()
    with pytest.raises(Exception, match="query of a frozen ranking not found: 9"):
        retrieval.frozen_gate(frozen.withColumn("query_id", F.lit(9).cast("bigint")), view, two.where("query_id = 0"))[0].collect()
    listed = spark.createDataFrame([(0,), (9,)], "query_id bigint")
    assert retrieval.frozen_gate(frozen.withColumn("query_id", F.lit(0).cast("bigint")), view, two, asked=listed)[1].count() == 2
    from roadlens.operators.evaluate import recall_rows

    sinks.write_csv(recall_rows(r, q), f"{tmp_path}/csv")
    rows = spark.read.option("header", True).csv(f"{tmp_path}/csv").collect()
    assert len(rows) == 3 and {x.expanded_english_queries for x in rows} == {"rain car | bus"}


def test_copies_are_placed(spark, tmp_path):
    src = put(f"{tmp_path}/a/1.jpg", "x")
    r = spark.createDataFrame([(0, 1, "1", src, 1.0), (0, 2, "2", f"{tmp_path}/a/none.jpg", 0.5)], "query_id bigint, rank int, image_id string, image_path string, score double")
    q = spark.createDataFrame([(0, "rain/ now", "rain")], "query_id bigint, display_query string, search_query string")
    placed = sinks.placed(r, q, "hybrid")
    rows = placed.withColumnRenamed("query_dir", "folder")
    got = {(x.target, x.status) for x in copy_folders(rows, f"{tmp_path}/out").collect()}
    assert got == {("rain_ now/hybrid/01_1.jpg", "copied"), ("rain_ now/hybrid/02_none.jpg", "missing")}
    assert os.path.isfile(f"{tmp_path}/out/rain_ now/hybrid/01_1.jpg")
    with pytest.raises(Exception, match="none.jpg"):
        copy_folders(rows, f"{tmp_path}/out", strict=True).collect()


def test_flows(spark):
    c = small(spark)
    q = qs.read_queries(spark, "rain car")
    for name in ("bm25", "tfidf_faiss", "qwen3vl_embedding_faiss", "hybrid_embedding_bm25"):
        assert retrieval.retrieve(retrieval.backend(name, c, vectors.HashEmbedder), q, 2).count() == 2
    many = q.withColumn("expanded", F.array(F.lit("bus"), F.lit(" "), F.lit("rain")))
    got = retrieval.retrieve(retrieval.backend("bm25", c), many, 2, expanded=True)
    assert {x.image_id for x in got.collect()} == {"4", "3"}
    with pytest.raises(ValueError):
        retrieval.backend("faiss", c)
    with pytest.raises(ValueError):
        retrieval.retrieve(retrieval.backend("bm25", c), q, 0)
    with pytest.raises(Exception, match="not English"):
        retrieval.retrieve(retrieval.backend("bm25", c), q.withColumn("search_query", F.lit("雨")), 2).collect()
    hashed = c.withColumn("image_hash", F.sha2("caption", 256)).withColumn("label", F.split("image_path", "/")[2])
    truth = spark.createDataFrame([(0, "rain")], "query_id bigint, label string")
    rec = retrieval.strict_dedup_recall(hashed, truth, {"bm25": lambda d: retrieval.Bm25(lexical.bm25_index(d))}, q, [1, 5])
    assert {(x.top_k, x.gt_count, x.recalled_gt_count) for x in rec.collect()} == {(1, 2, 1), (5, 2, 2)}


def test_index_round_trip(spark, tmp_path):
    c = small(spark)
    q = qs.read_queries(spark, "rain car")
    index = lexical.bm25_index(c)
    index.write(f"{tmp_path}/ix")
    assert sorted(map(tuple, lexical.bm25_search(lexical.Postings.read(spark, f"{tmp_path}/ix"), q, 3).collect())) == sorted(map(tuple, lexical.bm25_search(index, q, 3).collect()))


def test_folders_are_cleared_and_written(spark, tmp_path):
    src = put(f"{tmp_path}/a/1.jpg", "x")
    put(f"{tmp_path}/out/rain/hybrid/old.jpg", "x")
    put(f"{tmp_path}/out/other/keep.jpg", "x")
    r = spark.createDataFrame([(0, 1, "1", src, 1.0), (0, 2, "2", f"{tmp_path}/a/none.jpg", 0.5)], "query_id bigint, rank int, image_id string, image_path string, score double")
    q = spark.createDataFrame([(0, "rain", "rain")], "query_id bigint, display_query string, search_query string")
    got = sinks.organize({"embedding": r, "hybrid": r.where("rank = 1")}, q, f"{tmp_path}/out")
    assert {(x.part, x["rank"], x.status) for x in got.collect()} == {("embedding", 1, "copied"), ("embedding", 2, "missing"), ("hybrid", 1, "copied")}
    assert os.listdir(f"{tmp_path}/out/rain/hybrid") == ["01_1.jpg"] and os.path.isfile(f"{tmp_path}/out/other/keep.jpg")
    with pytest.raises(Exception, match="not a folder"):
        copy_folders(spark.createDataFrame([("../a", None, None)], "folder string, source_path string, target string"), f"{tmp_path}/out")
    assert os.path.isfile(src)


def tree(base):
    return {os.path.relpath(os.path.join(d, f), base): open(os.path.join(d, f)).read() for d, _, fs in os.walk(base) for f in fs}


def test_a_failed_write_leaves_all_folders_as_they_were(spark, tmp_path):
    base = f"{tmp_path}/out"
    for n in range(30):
        put(f"{tmp_path}/src/{n}.jpg", f"new {n}")
        put(f"{base}/d{n}/old.jpg", "old")
    before = tree(base)
    ddl = "folder string, source_path string, target string"
    rows = [(f"d{n}", f"{tmp_path}/src/{n}.jpg", f"d{n}/x/{n}.jpg") for n in range(30)]
    bad = spark.createDataFrame([*rows, ("d7", f"{tmp_path}/src/none.jpg", "d7/y.jpg")], ddl)
    with pytest.raises(Exception, match="none.jpg"):
        copy_folders(bad, base, strict=True)
    assert tree(base) == before and not [d for d in os.listdir(base) if d.startswith("_")]
    for folder, target in (("d1", "d1/../d2/a.jpg"), ("d1", "d2/a.jpg"), ("d1/a", "d1/a/b.jpg"), ("..", "../x.jpg")):
        with pytest.raises(Exception, match="not a f"):
            copy_folders(spark.createDataFrame([*rows, (folder, f"{tmp_path}/src/1.jpg", target)], ddl), base)
    assert tree(base) == before
    # rows of each folder, repeated and null ones among them, with one that gets nothing; by URI as by path
    more = [*rows[:20], rows[3], ("d20", None, None), ("d21", None, "d21/z.jpg"), ("new", f"file://{tmp_path}/src/5.jpg", "new/5.jpg"), ("tie", f"{tmp_path}/src/1.jpg", "tie/t.jpg"), ("tie", f"{tmp_path}/src/2.jpg", "tie/t.jpg")]
    got = copy_folders(spark.createDataFrame(more, ddl).repartition(5), f"file://{base}")
    assert sorted((x.target, x.status) for x in got.collect()) == sorted([(r[2], "copied") for r in rows[:20]] + [("d21/z.jpg", "missing"), ("new/5.jpg", "copied"), ("tie/t.jpg", "copied"), ("tie/t.jpg", "copied")])
    want = {f"d{n}/x/{n}.jpg": f"new {n}" for n in range(20)} | {f"d{n}/old.jpg": "old" for n in range(22, 30)} | {"new/5.jpg": "new 5", "tie/t.jpg": "new 2"}
    assert tree(base) == want
    assert copy_folders(spark.createDataFrame([], ddl), base).count() == 0 and tree(base) == want


def test_commits_take_one_attempt_and_undo_a_half(spark, tmp_path, monkeypatch):
    """A task that ran twice, and a commit that fails half way and is aborted."""
    base, status = f"{tmp_path}/out", f"{tmp_path}/status"
    row = lambda n: type("R", (), {"folder": f"d{n}", "source_path": put(f"{tmp_path}/s/{n}.jpg", f"new {n}"), "target": f"d{n}/{n}.jpg"})
    for n in range(3):
        put(f"{base}/d{n}/old.jpg", "old")
    w = _Writer(base, status, True)
    w.write(iter([row(0)]))  # lost, and done again
    told = [w.write(iter([row(0)])), w.write(iter([row(1)])), None]
    w.commit(told)
    assert tree(base) == {"d0/0.jpg": "new 0", "d1/1.jpg": "new 1", "d2/old.jpg": "old"}
    assert sorted(os.listdir(status)) == sorted(f"{m.attempt}.parquet" for m in told[:2])
    again = _Writer(base, status, True)
    with pytest.raises(ValueError, match="several tasks"):
        again.commit([_Written("a", ["d0"]), _Written("b", ["d0"])])
    from roadlens.sources import folders

    move, seen = folders._move, []

    def failing(fs, old, new):
        seen.append(new)
        if new.endswith("/out/d2"):
            raise OSError("lost")
        move(fs, old, new)

    third = again.write(iter([row(2)]))
    monkeypatch.setattr(folders, "_move", failing)
    with pytest.raises(OSError):
        again.commit([third])
    assert not os.path.exists(f"{base}/d2")
    monkeypatch.setattr(folders, "_move", move)
    again.abort([third])
    assert tree(base) == {"d0/0.jpg": "new 0", "d1/1.jpg": "new 1", "d2/old.jpg": "old"} and sorted(os.listdir(base)) == ["d0", "d1", "d2"]


def test_issue_samples(spark, tmp_path):
    from roadlens.operators.sample import stratified_sample

    root = f"{tmp_path}/src"
    for n in range(3):
        put(f"{root}/issue1/frames/{n}.jpg", "x")
    put(f"{root}/issue2/readme.txt", "x")
    put(f"{root}/other/frames/9.jpg", "x")
    put(f"{tmp_path}/out/issue1/old.jpg", "x")
    issues = cs.issue_dirs(spark, root, "issue*")
    assert [tuple(x) for x in issues.collect()] == [("issue1", f"{root}/issue1/frames", True), ("issue2", f"{root}/issue2/frames", False)]
    m = sinks.sample_manifest(issues, stratified_sample(cs.read_frames(spark, root, "issue*"), "issue", "image_path", 2))
    got = {x.issue: x for x in m.collect()}
    assert (got["issue1"].candidate_count, got["issue1"].sampled_count, got["issue1"].status) == (3, 2, "ok")
    assert (got["issue2"].candidate_count, got["issue2"].status, got["issue2"].samples) == (0, "missing_frames_dir", [])
    assert sinks.copy_samples(m, f"{tmp_path}/out").count() == 2
    assert sorted(os.listdir(f"{tmp_path}/out/issue1")) == [s.target.split("/")[1] for s in got["issue1"].samples]
    with pytest.raises(ValueError):
        cs.issue_dirs(spark, root, "none*")


def test_one_caption(spark, tmp_path):
    assert sinks.write_caption(spark, {"caption": "a bus", "image_path": "x"}, f"{tmp_path}/t", f"{tmp_path}/j") == "a bus"
    assert spark.read.text(f"{tmp_path}/t").first().value == "a bus"
    assert spark.read.option("multiLine", True).json(f"{tmp_path}/j").first().image_path == "x"


def test_prompts_and_expansion(spark):
    from roadlens.functions.prompts import caption_messages

    chat = caption_messages("img", "What?", examples=[{"role": "user", "content": "e"}])
    assert [m["role"] for m in chat] == ["system", "user", "user"] and chat[2]["content"][1]["text"] == "What?"
    q = qs.read_queries(spark, "rain")
    good = lambda: lambda p: '{"english_queries": ["a", "b", "c"]}'
    assert vectors.expand(q, good, 3).first().expanded == ["a", "b", "c"]
    for many, text in ((4, "rain"), (3, " ")):
        with pytest.raises(Exception):
            vectors.expand(q.withColumn("display_query", F.lit(text)), good, many).collect()
    with pytest.raises(ValueError):
        vectors.expand(q, good, 1)


def test_one_json_document_is_shared_by_tasks(spark, tmp_path):
    nasty = ['a "image_path": "x"', 'b}, {"image_path"', "c\\", "d\n]}", "é😀 \"image_path\"", "{", "  "]
    results = [{"image_path": f"/p/{i}.jpg", "success": i % 11 > 0, "inference_seconds": i / 8, "caption": nasty[i % 7] + f" {i}" * (i % 7 < 6), "error": None} for i in range(400)]
    for n, indent in ((0, 2), (1, None)):
        put(f"{tmp_path}/in/{n}.json", json.dumps({"summary": {"total_images": 400}, "results": results[n:]}, indent=indent, ensure_ascii=n == 0))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = cs.read_captions(spark, f"{tmp_path}/in", split=True)
        assert got.rdd.getNumPartitions() > 20 or got.count()
        rows = sorted(map(tuple, got.collect()))
        put(f"{tmp_path}/bad.json", json.dumps({"results": [{"success": True, "image_path": f"/{i}.jpg", "caption": "x"} for i in range(3)]}))
        with pytest.raises(Exception, match="must lead"):
            cs.read_captions(spark, f"{tmp_path}/bad.json", split=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert rows == sorted(map(tuple, cs.read_captions(spark, f"{tmp_path}/in").collect())) and len(rows) > 600


def test_a_summary_is_observed_as_rows_are_written(spark, tmp_path):
    from roadlens.operators import evaluate

    rows = spark.createDataFrame([("/1", True, 1.5, "a", None), ("/2", True, None, "b", None), ("/3", False, 9.0, None, "x"), ("/4", None, 2.0, None, "y"), ("/5", True, 0.25, "c", None)], "image_path string, success boolean, inference_seconds double, caption string, error string")
    told = sinks.write_captions(rows, f"{tmp_path}/out")
    assert told == evaluate.caption_summary(rows).first().asDict() and told["average_inference_seconds"] == 0.875
    assert spark.read.json(f"{tmp_path}/out").count() == 5
    assert sinks.write_captions(rows.limit(0), f"{tmp_path}/none") == {"total_images": 0, "success_images": 0, "failed_images": 0, "average_inference_seconds": None}
