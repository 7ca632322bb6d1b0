"""Writers: reports, recall tables, captions, manifests with copied images. Spark's writers do the work."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import dir_name, file_name
from ..storage import checkpoint
from .folders import copy_folders

#: The columns of the recall tables.
PERCENTILE_COLUMNS = ("query", "backend", "percent", "candidate_count", "gt_count", "recalled_gt_count", "recall")
TOPK_COLUMNS = ("query", "backend", "top_k", "corpus_unique_count", "gt_count", "recalled_gt_count", "recall", "query_seconds")


def report(ranked: DataFrame, queries: DataFrame, summary: dict[str, str] | None = None) -> DataFrame:
    """One row a query, ready for ``write.json``: query, its texts, items in rank order, recalled lists and the run's summary."""
    item = F.struct("rank", "image_id", "image_path", "score")
    items = F.array_sort(F.collect_list(item))
    rows = ranked.groupBy("query_id").agg(items.alias("items"))
    q = queries.select("query_id", F.col("display_query").alias("query"), "search_query", *(c for c in ("expanded",) if c in queries.columns))
    out = q.join(rows, "query_id", "left").withColumn("items", F.coalesce("items", F.array().cast("array<struct<rank:int,image_id:string,image_path:string,score:double>>")))
    out = out.withColumn("recalled_image_paths", F.col("items.image_path")).withColumn("recalled_image_ids", F.col("items.image_id"))
    out = out.withColumn("recalled_image_filenames", F.transform("items.image_path", file_name)).withColumn("recall_count", F.size("items"))
    return out.withColumn("summary", F.create_map(*[F.lit(x) for kv in sorted((summary or {}).items()) for x in kv]).cast("map<string,string>"))


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def append_captions(rows: DataFrame, folder: str) -> None:
    """Caption rows as JSON lines, added to those that are there, so that a stopped run loses only its last batch."""
    rows.write.mode("append").json(folder)


def write_captions(rows: DataFrame, folder: str, seconds: str = "inference_seconds") -> dict:
    """As ``append_captions``; returns what ``evaluate.caption_summary`` says of ``rows``, observed as they are written."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    seen = Observation()
    told = rows.observe(seen, F.count(F.lit(1)).alias("total_images"), F.count_if(ok).alias("success_images"), F.sum(F.when(ok, F.col(seconds))).alias("seconds"), F.count(F.when(ok, F.col(seconds))).alias("timed"))
    append_captions(told, folder)
    x = seen.get
    mean = round(x["seconds"] / x["timed"], 6) if x["timed"] else None
    return {"total_images": x["total_images"], "success_images": x["success_images"], "failed_images": x["total_images"] - x["success_images"], "average_inference_seconds": mean or None}


def write_csv(df: DataFrame, folder: str, columns: tuple[str, ...] | None = None) -> None:
    (df.select(*columns) if columns else df).write.mode("overwrite").option("header", True).csv(folder)


def placed(ranked: DataFrame, queries: DataFrame, part: str) -> DataFrame:
    """Where each item's copy goes: query_dir / part / rank_name. Queries whose folder names are equal share one, the greatest id staying."""
    dirs = queries.select("query_id", dir_name(F.col("display_query")).alias("query_dir"))
    last = dirs.groupBy("query_dir").agg(F.max("query_id").alias("query_id"))
    name = F.concat(F.lpad(F.col("rank").cast("string"), 2, "0"), F.lit("_"), file_name(F.col("image_path")))
    rank = F.when(F.col("rank") > 99, F.concat(F.col("rank").cast("string"), F.lit("_"), file_name(F.col("image_path")))).otherwise(name)
    return ranked.join(last, "query_id").select("query_id", "query_dir", F.lit(part).alias("part"), "rank", F.col("image_path").alias("source_path"), F.concat_ws("/", "query_dir", F.lit(part), rank).alias("target"))


def placed_parts(parts: dict[str, DataFrame], queries: DataFrame) -> DataFrame:
    """``placed`` for each named ranking, in one frame."""
    out = None
    for name, ranked in parts.items():
        one = placed(ranked, queries, name)
        out = one if out is None else out.unionByName(one)
    return out


def organize(parts: dict[str, DataFrame], queries: DataFrame, base: str, strict: bool = False) -> DataFrame:
    """Writes a folder a query with a folder for each ranking of ``parts``, in place of those that were there; returns the manifest with status.

    Missing sources are left out with status missing; ``strict`` makes them an error, which leaves all folders as they were (``copy_folders``).
    """
    rows = checkpoint(placed_parts(parts, queries))
    none = F.lit(None).cast("string")
    folders = queries.select(dir_name(F.col("display_query")).alias("folder"), none.alias("source_path"), none.alias("target"))
    status = copy_folders(folders.union(rows.select("query_dir", "source_path", "target")), base, strict)
    same = (rows["target"] == status["target"]) & rows["source_path"].eqNullSafe(status["source_path"])
    return rows.join(status, same).select(rows["*"], "status")


def sample_manifest(issues: DataFrame, sampled: DataFrame) -> DataFrame:
    """One row an issue: issue, frames_dir, candidate_count, sampled_count, status (ok or missing_frames_dir) and its samples in order.

    ``issues`` is of ``issue_dirs``, ``sampled`` has issue, sample_index, image_path and candidate_count. A sample's target is its
    index and name in the issue's folder. Lists are as long as the samples drawn.
    """
    name = F.concat(F.when(F.col("sample_index") < 10, F.lit("0")).otherwise(F.lit("")), F.col("sample_index").cast("string"), F.lit("_"), file_name(F.col("image_path")))
    one = F.struct(F.col("sample_index").alias("index"), F.col("image_path").alias("source_path"), F.concat_ws("/", "issue", name).alias("target"))
    have = sampled.groupBy("issue").agg(F.max("candidate_count").alias("candidate_count"), F.array_sort(F.collect_list(one)).alias("samples"))
    zero = F.lit(0).cast("bigint")
    out = issues.join(have, "issue", "left").withColumn("status", F.when(F.col("has_frames"), "ok").otherwise("missing_frames_dir"))
    count = F.when(F.col("samples").isNull(), zero).otherwise(F.size("samples").cast("bigint")).alias("sampled_count")
    none = F.array().cast("array<struct<index:int,source_path:string,target:string>>")
    return out.select("issue", "frames_dir", F.coalesce("candidate_count", zero).alias("candidate_count"), count, "status", F.coalesce("samples", none).alias("samples"))


def copy_samples(manifest: DataFrame, base: str) -> DataFrame:
    """Copies the samples of a manifest below ``base``, in place of the folders of its issues that have frames; a missing source fails and changes nothing."""
    none = F.lit(None).cast("string")
    # the issue's own row names its folder, also where nothing was drawn
    own = F.struct(none.alias("source_path"), none.alias("target"))
    each = F.concat(F.array(own), F.transform("samples", lambda s: F.struct(s["source_path"].alias("source_path"), s["target"].alias("target"))))
    rows = manifest.where("status = 'ok'").select(F.col("issue").alias("folder"), F.inline(each))
    return copy_folders(rows, base, strict=True).select("target", "status")


def write_lexical_view(view: DataFrame, folder: str) -> None:
    """The corpus of ``lexical_view`` as JSON lines, which ``read_captions`` reads as any caption rows."""
    view.select("image_path", F.lit(True).alias("success"), "caption", "source_caption", "source_result_file").write.mode("overwrite").json(folder)


def write_caption(spark: SparkSession, row: dict, text_file: str | None = None, json_file: str | None = None) -> str:
    """One caption result: its text is returned, and written to ``text_file``, or with all fields to ``json_file``, where these (folders, as Spark writes) are named."""
    for path, body in ((text_file, row["caption"]), (json_file, json.dumps(row, ensure_ascii=False, indent=2))):
        if path:
            spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)
    return row["caption"]
