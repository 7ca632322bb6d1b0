"""Fusions of rankings. Inputs and outputs are ranked frames; all queries are fused in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import gate_bounds, positive_int, rerank_bounds
from .rank import RANKED

RRF_K = 60


def rrf(semantic: DataFrame, lexical: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion by image_id of two rankings cut at the same k.

    An id adds up all of its places, also several in one branch. The path is that
    of its first place, semantic before lexical, which also orders equal scores.
    """
    positive_int("k", k)
    c = max(0, rrf_k)
    both = semantic.where(F.col("rank") <= k).select(*RANKED, F.lit(0).alias("branch")).unionByName(lexical.where(F.col("rank") <= k).select(*RANKED, F.lit(1).alias("branch")))
    place = F.struct("branch", "rank")
    fused = both.groupBy("query_id", "image_id").agg(F.sum(1.0 / (c + F.col("rank"))).alias("score"), F.min(place).alias("place"), F.min_by("image_path", place).alias("image_path"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "place")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*RANKED)


def max_merge(expanded: DataFrame, k: int) -> DataFrame:
    """One ranking from those of several phrasings: ``expanded`` is ranked, with query_pos, the phrasing's place.

    Each image_path keeps its greatest score, and the item of the first phrasing
    that reached it; equal scores (to nine places) come in the order in which paths were first seen. Where rankings
    are of the whole corpus, searches of phrasings (query_pos) give the same from each document's scores alone.
    """
    positive_int("k", k)
    first = F.struct("query_pos", "rank")
    best = F.struct(F.round("score", 9).alias("s"), (-F.col("query_pos")).alias("q"), (-F.col("rank")).alias("r"))
    merged = expanded.groupBy("query_id", "image_path").agg(F.max("score").alias("score"), F.max_by("image_id", best).alias("image_id"), F.min(first).alias("seen"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "seen")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*RANKED)


def tail_rerank(semantic: DataFrame, lexical: DataFrame, freeze_top_n: int = 5, final_top_k: int = 20, lexical_top_n: int = 10) -> DataFrame:
    """The semantic ranking with its head frozen and its tail ordered by lexical support.

    Supported ids come first, by lexical rank; then the others, by semantic rank.
    An id that occurs again counts with its last rank in either. Scores stay the
    semantic ones, so they need not fall along the result.
    """
    rerank_bounds(freeze_top_n, final_top_k, lexical_top_n)
    head = F.col("rank") <= freeze_top_n
    sem = semantic.where(F.col("rank") <= final_top_k)
    lex = lexical.where(F.col("rank") <= lexical_top_n).groupBy("query_id", "image_id").agg(F.max("rank").alias("lexical_rank"))
    last = F.max("rank").over(Window.partitionBy("query_id", "image_id", head))
    both = sem.withColumn("last", last).join(lex, ["query_id", "image_id"], "left")
    none = F.lit(None).cast("int")
    order = Window.partitionBy("query_id").orderBy(
        F.when(head, 0).otherwise(1),
        F.when(head, F.col("rank")),
        F.asc_nulls_last(F.when(head, none).otherwise(F.col("lexical_rank"))),
        "last",
        "rank",
    )
    return both.withColumn("rank", F.row_number().over(order)).select(*RANKED)


def rank_gate(semantic: DataFrame, lexical: DataFrame, candidate_top_k: int = 20, semantic_top_n: int = 10, lexical_top_n: int = 8, output_max_k: int = 10) -> DataFrame:
    """The semantic top that the lexical top has too, in semantic order; nothing is filled up, so a query may have no rows."""
    gate_bounds(candidate_top_k, semantic_top_n, lexical_top_n, output_max_k)
    sem = semantic.where((F.col("rank") <= semantic_top_n) & (F.col("rank") <= candidate_top_k))
    kept = sem.join(lexical.where(F.col("rank") <= lexical_top_n).select("query_id", "image_id"), ["query_id", "image_id"], "left_semi")
    order = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("new", F.row_number().over(order)).where(F.col("new") <= output_max_k).withColumn("rank", F.col("new")).select(*RANKED)
