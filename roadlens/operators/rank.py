"""Ranked frames: (query_id, rank, image_id, image_path, score) and how rows become them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANKED = ("query_id", "rank", "image_id", "image_path", "score")


def top_k(scored: DataFrame, k: int | None, tie: str = "corpus_pos", digits: int = 9) -> DataFrame:
    """The ``k`` best rows of each query as a ranked frame, in one window that is cut before the shuffle; all rows where ``k`` is None.

    Scores are compared to ``digits`` places, so that sums in another order don't
    break ties differently; those go to the smaller ``tie``.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", digits)), F.asc(tie))
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return (ranked if k is None else ranked.where(F.col("rank") <= k)).select(*RANKED)


def whole(scores: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Every row of ``corpus``, ranked for each query: at its score (query_id, corpus_pos, score), else at 0. Its size is the product of both."""
    rest = queries.select("query_id").distinct().crossJoin(corpus.select("corpus_pos", "image_id", "image_path")).join(scores, ["query_id", "corpus_pos"], "left")
    return top_k(rest.withColumn("score", F.coalesce("score", F.lit(0.0))), None)


def at_least(scored: DataFrame, least: float) -> DataFrame:
    """Rows that score ``least`` or more; to be applied to all scores, before the cut."""
    return scored.where(F.col("score") >= least)
