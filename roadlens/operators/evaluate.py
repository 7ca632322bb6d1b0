"""Recall of rankings against ground truth, and summaries of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guards import positive_int
from ..functions.text import candidate_count, file_name, tokens
from . import blocks
from .dedup import resolved


def _cut_recall(ranked: DataFrame, truth: DataFrame, cuts: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """Per query and cut: gt_count, recalled_gt_count, recall and the sorted keys recalled and missed.

    ``cuts`` has query_id, ``by`` and candidate_count. Each key's best rank is taken
    once; then every (key, cut) row is a comparison, reduced in one aggregation.
    """
    best = ranked.groupBy("query_id", F.col(key).alias("gt_key")).agg(F.min("rank").alias("best"))
    keys = truth.select("query_id", "gt_key").distinct().join(best, ["query_id", "gt_key"], "left")
    hit = F.coalesce(F.col("best") <= F.col("candidate_count"), F.lit(False))
    out = keys.join(cuts, "query_id").groupBy("query_id", *by, "candidate_count").agg(
        F.count("*").alias("gt_count"),
        F.count_if(hit).alias("recalled_gt_count"),
        F.array_sort(F.collect_list(F.when(hit, F.col("gt_key")))).alias("recalled"),
        F.array_sort(F.collect_list(F.when(~hit, F.col("gt_key")))).alias("missed"),
    )
    return out.withColumn("recall", F.round(F.col("recalled_gt_count") / F.col("gt_count"), 6))


def _values(spark, name: str, values: Sequence[int]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(positive_int(name, v)) for v in values])).alias(name))


def percentile_recall(ranked: DataFrame, truth: DataFrame, percents: Sequence[int], totals: DataFrame) -> DataFrame:
    """Recall at top percentages by resolved path. ``totals`` has one row, total: the corpus size. candidate_count is nominal.

    ``ranked`` (query_id, image_path, rank) need only have the rows of the ground truth, with their
    ranks in the whole corpus: see ``embedding_truth_ranks``. Both sides' paths are resolved, so that other spellings of a path are one,
    with the best of their ranks. Queries without ground truth have no rows; ``require_truth`` makes that an error.
    """
    p = _values(ranked.sparkSession, "percent", percents)
    truth = truth.select("query_id", resolved(F.col("gt_key")).alias("gt_key")).distinct()
    cuts = truth.select("query_id").distinct().crossJoin(F.broadcast(p)).crossJoin(F.broadcast(totals))
    cuts = cuts.select("query_id", "percent", candidate_count(F.col("total"), F.col("percent")).alias("candidate_count"))
    return _cut_recall(ranked.withColumn("image_path", resolved(F.col("image_path"))), truth, cuts, "image_path", ["percent"])


def embedding_truth_ranks(corpus: DataFrame, queries: DataFrame, truth: DataFrame, skip_self: bool = False) -> DataFrame:
    """(query_id, image_path, rank) of the ground truth's rows in exact embedding search, counted without a ranking of the corpus (``blocks.ranks``)."""
    paths = corpus.select("corpus_pos", "image_path", resolved(F.col("image_path")).alias("gt_key"))
    wanted = truth.select("query_id", resolved(F.col("gt_key")).alias("gt_key")).distinct().join(paths, "gt_key")
    return blocks.ranks(corpus, queries, wanted, skip_self).join(corpus.select("corpus_pos", "image_path"), "corpus_pos").select("query_id", "image_path", "rank")


def topk_recall(ranked: DataFrame, truth: DataFrame, top_ks: Sequence[int]) -> DataFrame:
    """Recall at fixed cuts by content hash (image_id). candidate_count is the length of the cut list."""
    k = _values(ranked.sparkSession, "top_k", top_ks)
    n = ranked.groupBy("query_id").agg(F.count("*").alias("n"))
    cuts = truth.select("query_id").distinct().join(n, "query_id", "left").crossJoin(F.broadcast(k))
    cuts = cuts.select("query_id", "top_k", F.least(F.col("top_k").cast("bigint"), F.coalesce("n", F.lit(0))).alias("candidate_count"))
    return _cut_recall(ranked, truth, cuts, "image_id", ["top_k"])


def require_truth(queries: DataFrame, truth: DataFrame) -> DataFrame:
    """``queries``, failing in the job if one has no ground truth."""
    has = truth.select("query_id").distinct().withColumn("__has", F.lit(True))
    miss = F.raise_error(F.concat(F.lit("no ground truth for query "), F.col("query_id").cast("string"))).cast("boolean")
    return queries.join(has, "query_id", "left").withColumn("__has", F.coalesce("__has", miss)).where("__has").drop("__has")


def judged(ranked: DataFrame, truth: DataFrame, key: str = "image_path") -> DataFrame:
    """Ranked rows with image_filename and is_gt."""
    gt = truth.select("query_id", F.col("gt_key").alias(key)).distinct().withColumn("__gt", F.lit(True))
    out = ranked.join(gt, ["query_id", key], "left").withColumn("is_gt", F.coalesce("__gt", F.lit(False))).drop("__gt")
    return out.withColumn("image_filename", file_name(F.col("image_path")))


def precision_at(judged_rows: DataFrame, top_ks: Sequence[int]) -> DataFrame:
    """query_id, top_k, hits, precision (over the ranks that there are) and reciprocal_rank of the first hit."""
    k = _values(judged_rows.sparkSession, "top_k", top_ks)
    rows = judged_rows.crossJoin(F.broadcast(k)).where(F.col("rank") <= F.col("top_k"))
    first = F.min(F.when(F.col("is_gt"), F.col("rank")))
    return rows.groupBy("query_id", "top_k").agg(
        F.count_if("is_gt").alias("hits"),
        F.round(F.count_if("is_gt") / F.count("*"), 6).alias("precision"),
        F.round(F.coalesce(1.0 / first, F.lit(0.0)), 6).alias("reciprocal_rank"),
    )


def zero_recall(recall: DataFrame, by: str) -> DataFrame:
    """Per cut: queries, those that recall nothing, and the mean recall."""
    return recall.groupBy(by).agg(
        F.count("*").alias("query_count"), F.count_if(F.col("recalled_gt_count") == 0).alias("zero_recall_queries"), F.round(F.avg("recall"), 6).alias("mean_recall")
    )


def recall_summary(ranked: DataFrame) -> DataFrame:
    """Per query, in rank order: paths, file names and ids, and recall_count; blank ones are left out."""

    def ordered(c: Column, name: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.trim(c) != "", F.struct(F.col("rank"), F.trim(c).alias("x")))))
        return F.transform(rows, lambda r: r["x"]).alias(name)

    path = F.col("image_path")
    out = ranked.groupBy("query_id").agg(ordered(path, "recalled_image_paths"), ordered(file_name(path), "recalled_image_filenames"), ordered(F.col("image_id"), "recalled_image_ids"))
    return out.withColumn("recall_count", F.size("recalled_image_paths"))


def recall_rows(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """Flat rows for a CSV: query, expanded phrasings in one text, rank, file name, path, id and score."""
    q = queries.select("query_id", F.col("display_query").alias("query"), F.array_join("expanded", " | ").alias("expanded_english_queries"))
    return ranked.join(q, "query_id").select("query", "expanded_english_queries", "rank", file_name(F.col("image_path")).alias("image_filename"), "image_path", "image_id", "score")


def recall_table(recall: DataFrame, queries: DataFrame, backend: str) -> DataFrame:
    """``recall`` with its query's text and the back end's name, as the CSV tables have them."""
    q = queries.select("query_id", F.col("display_query").alias("query"))
    return recall.drop("backend").join(q, "query_id").withColumn("backend", F.lit(backend))


def topk_table(recall: DataFrame, queries: DataFrame, backend: str, unique: DataFrame, seconds: float | None = None) -> DataFrame:
    """As ``recall_table``, with the number of distinct contents (``unique``, a row each) and the seconds that a query took, if measured."""
    n = unique.agg(F.count("*").alias("corpus_unique_count"))
    return recall_table(recall, queries, backend).crossJoin(F.broadcast(n)).withColumn("query_seconds", F.lit(seconds).cast("double"))


def keyword_coverage(ranked: DataFrame, queries: DataFrame, corpus: DataFrame, top_k: int) -> DataFrame:
    """query_id, keywords (distinct tokens of the query), covered (those in a caption of the ``top_k``) and their share.

    Queries without tokens have no rows.
    """
    words = lambda c: F.explode(F.array_distinct(tokens(F.coalesce(c, F.lit(""))))).alias("term")
    asked = queries.select("query_id", words(F.col("search_query"))).distinct()
    top = ranked.where(F.col("rank") <= positive_int("top_k", top_k)).select("query_id", "image_path")
    seen = top.join(corpus.select("image_path", "caption"), "image_path").select("query_id", words(F.col("caption"))).distinct().withColumn("seen", F.lit(1))
    out = asked.join(seen, ["query_id", "term"], "left").groupBy("query_id").agg(F.count("*").alias("keywords"), F.count("seen").alias("covered"))
    return out.withColumn("coverage", F.round(F.col("covered") / F.col("keywords"), 6))


def score_ranges(ranked: DataFrame, label: Column) -> DataFrame:
    """Per query and label: rows, and the range of scores."""
    return ranked.groupBy("query_id", label.alias("label")).agg(F.count("*").alias("n"), F.round(F.min("score"), 6).alias("min_score"), F.round(F.max("score"), 6).alias("max_score"))


def caption_summary(rows: DataFrame, seconds: str = "inference_seconds") -> DataFrame:
    """Totals of a captioning run, and the mean seconds of its successes (null for none, or zero)."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    mean = F.nullif(F.round(F.avg(F.when(ok, F.col(seconds))), 6), F.lit(0.0))
    return rows.agg(F.count("*").alias("total_images"), F.count_if(ok).alias("success_images"), F.count_if(~ok).alias("failed_images"), mean.alias("average_inference_seconds"))
