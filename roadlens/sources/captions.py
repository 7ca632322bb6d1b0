"""Readers: caption results, frozen reports, image folders, configurations."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.guards import one_image
from ..functions.text import label_of, stem, stripped
from ..schema import CAPTION_FILE, CAPTION_ROW, REPORT

IMAGES = r"(?i)\.(jpe?g|png|bmp|webp)$"


def require(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """``df``, failing in the job on a row for which ``ok`` does not hold."""
    return df.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def as_corpus(rows: DataFrame, source: Column) -> DataFrame:
    """Corpus of rows (corpus_pos, image_path, caption, success): successful ones with a path and a caption that aren't blank.

    A null caption or path counts as blank, a text ``success`` by its truth as a word.
    """
    ok = F.lower(F.trim(F.col("success").cast("string"))).isin("true", "1", "yes")
    path, text = stripped(F.col("image_path")), stripped(F.col("caption"))
    kept = rows.where(ok & (path != "") & (text != ""))
    return kept.select("corpus_pos", stem(path).alias("image_id"), path.alias("image_path"), text.alias("caption"), source.alias("source_result_file"))


def read_captions(spark: SparkSession, path: str, lines: bool | None = None, split: bool = False) -> DataFrame:
    """Corpus of caption result files: one JSON document each with a list ``results``, or JSON ``lines`` of its elements (default: by the name ``.jsonl``).

    A document is one task's work, unless it is read ``split``: then it is cut at the key image_path, which must
    lead each element, so that tasks share it by bytes, as they share lines. Elements that don't fit fail the job.
    corpus_pos is the place in the list; lists of several files share places, which
    ties then leave to the path.
    """
    if path.endswith(".jsonl") if lines is None else lines:
        rows = spark.read.schema(CAPTION_ROW).json(path).select("*", F.monotonically_increasing_id().alias("corpus_pos"), F.col("_metadata.file_path").alias("file"))
        return as_corpus(rows, F.col("file"))
    if split:
        return as_corpus(_elements(spark, path), F.col("file"))
    files = spark.read.schema(CAPTION_FILE).option("multiLine", True).json(path).select("results", F.col("_metadata.file_path").alias("file"))
    # inside the generator: a filter before it would give way to the one that the generator implies
    results = F.coalesce("results", F.raise_error(F.lit("a caption file must have a list named results")))
    rows = files.select("file", F.posexplode(results).alias("pos", "r")).select("file", "pos", "r.*")
    return as_corpus(rows.withColumn("corpus_pos", F.col("pos").cast("bigint")), F.col("file"))


def _elements(spark: SparkSession, path: str) -> DataFrame:
    """file, corpus_pos and the fields of each element of the ``results`` of documents, read as text between two keys.

    Within a JSON string the key's quotes have backslashes before them, so that the bytes of the key are the key.
    Places are counted by split: each split's elements come after those of the splits before it.
    """
    key = '"image_path"'
    text = spark.read.option("lineSep", key).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
    splits = text.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = text.join(splits.select("file", "block", "first", before.alias("before")), ["file", "block"])
    # what comes before the first key is no element
    placed = placed.withColumn("corpus_pos", F.col("before") + F.col("i") - F.col("first") - 1)
    placed = placed.withColumn("value", F.when(F.col("corpus_pos") >= 0, F.col("value"))).where("value is not null")
    placed = require(placed, F.col("value").isNull() | F.col("value").rlike(r"\{\s*$|\]\s*(,[^\[\]]*)?\}\s*$"), "image_path must lead each element of results")
    one = F.from_json(F.concat(F.lit("{" + key), F.col("value")), "image_path string, success string, inference_seconds double, caption string, error string", {"mode": "FAILFAST"})
    return placed.select("file", "corpus_pos", one.alias("r")).select("file", "corpus_pos", "r.*")


def migrated(corpus: DataFrame, existing: DataFrame, root: str, marker: str = "/input/raw/") -> DataFrame:
    """``corpus`` with paths that ``existing`` (image_path) lacks moved under ``root``, where the moved path exists.

    Only paths with ``marker`` move: what follows its first occurrence stays.
    """
    at = F.instr("image_path", marker)
    moved = F.when(at > 0, F.concat(F.lit(root.rstrip("/") + marker), F.substring("image_path", at + len(marker), F.length("image_path"))))
    here = existing.select(F.col("image_path").alias("__p")).distinct()
    out = corpus.withColumn("__moved", moved).join(here.withColumn("__here", F.lit(True)), F.col("image_path") == F.col("__p"), "left").drop("__p")
    out = out.join(here.withColumn("__there", F.lit(True)), F.col("__moved") == F.col("__p"), "left").drop("__p")
    take = F.col("__here").isNull() & F.col("__there").isNotNull()
    return out.withColumn("image_path", F.when(take, F.col("__moved")).otherwise(F.col("image_path"))).drop("__moved", "__here", "__there")


def read_images(spark: SparkSession, root: str, subdir_glob: str = "", max_images: int = 0, content: bool = False) -> DataFrame:
    """image_path, label (first folder below ``root``) and, on request, content of all images under ``root``.

    ``subdir_glob`` limits the first-level folders. ``max_images`` takes the first in
    order of path components. No image is an error.
    """
    path = f"{root.rstrip('/')}/{subdir_glob}" if subdir_glob else root
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    clean = F.regexp_replace("path", "^file:/*(?=/)", "")
    out = files.select(clean.alias("image_path"), *(["content"] if content else [])).where(F.col("image_path").rlike(IMAGES))
    out = out.withColumn("label", label_of(F.col("image_path"), root))
    if max_images > 0:
        out = out.orderBy(F.split("image_path", "/")).limit(max_images)
    if out.isEmpty():
        raise ValueError(f"no images under {path}")
    return out


def issue_dirs(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """issue, frames_dir and has_frames of the first-level folders of ``root`` that match; none is an error."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.globStatus(hadoop.Path(f"{root.rstrip('/')}/{glob}")) or [] if s.isDirectory()]
    if not found:
        raise ValueError(f"no folders {glob} under {root}")
    rows = [(p.getName(), f"{root.rstrip('/')}/{p.getName()}/frames", fs.isDirectory(hadoop.Path(p, "frames"))) for p in found]
    return spark.createDataFrame(sorted(rows), "issue string, frames_dir string, has_frames boolean")


def read_frames(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(issue, image_path) of the images below the frames folder of each issue."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root.rstrip('/')}/{glob}/frames")
    out = files.select(F.regexp_replace("path", "^file:/*(?=/)", "").alias("image_path")).where(F.col("image_path").rlike(IMAGES))
    return out.select(label_of(F.col("image_path"), root).alias("issue"), "image_path")


def read_truth(spark: SparkSession, label_root: str, labels: dict[int, str]) -> DataFrame:
    """(query_id, gt_key): the image paths under the folder of each query's label; a label without images is an error."""
    have = read_images(spark, label_root).select("label", F.col("image_path").alias("gt_key"))
    asked = spark.createDataFrame(sorted(labels.items()), "query_id bigint, label string")
    missing = asked.join(have.select("label").distinct(), "label", "left_anti").take(1)
    if missing:
        raise ValueError(f"no images for label {missing[0].label}")
    return asked.join(have, "label").select("query_id", "gt_key").distinct()


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The frozen ranking of an earlier report, with its query text; ranks that don't parse fall back to the place in the list."""
    from ..functions.text import fallback_rank

    rows = spark.read.schema(REPORT).option("multiLine", True).json(path).select(F.posexplode("query_results").alias("query_id", "q"))
    rows = rows.select(F.col("query_id").cast("bigint"), F.col("q.query").alias("query"), F.posexplode("q.items").alias("pos", "item"))
    return rows.select("query_id", "query", fallback_rank(F.col("item.rank"), F.col("pos") + 1).alias("rank"), "item.image_id", "item.image_path", "item.score")


def image_bytes(df: DataFrame, b64: str = "image_b64") -> DataFrame:
    """``df`` with content, from base64 text that may start with a data URL's head; text that isn't base64 is an error in the job."""
    body = F.regexp_replace(F.col(b64), r"^data:[^,]*,", "")
    ok = F.length(stripped(body)) > 0
    return require(df, ok, "blank image data").withColumn("content", F.unbase64(stripped(body)))


def image_payload(image_path: str | None = None, image_b64: str | None = None) -> dict[str, str]:
    one_image(image_path, image_b64)
    return {"image_path": image_path} if image_path else {"image_b64": image_b64}


def read_config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        out = json.load(f)
    if not isinstance(out, dict):
        raise ValueError("a configuration must be a JSON object")
    return out
