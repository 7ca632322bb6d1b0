"""Manifests that set rankings against each other: semi and anti joins on (query_id, image_id), then lists in rank order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ids_in_order(ranked: DataFrame, name: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("rank", "image_id")))
    return ranked.groupBy("query_id").agg(F.transform(rows, lambda r: r["image_id"]).alias(name))


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` whose id ``b`` has."""
    return a.join(b.select("query_id", "image_id").distinct(), ["query_id", "image_id"], "left_semi")


def only(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` whose id ``b`` lacks."""
    return a.join(b.select("query_id", "image_id").distinct(), ["query_id", "image_id"], "left_anti")


def _manifest(queries: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    out = reduce(lambda d, kv: d.join(ids_in_order(kv[1], kv[0]), "query_id", "left"), parts.items(), queries.select("query_id").distinct())
    none = F.array().cast("array<string>")
    return out.select("query_id", *[F.coalesce(k, none).alias(k) for k in parts])


def comparison_manifest(queries: DataFrame, embedding: DataFrame, hybrid: DataFrame) -> DataFrame:
    parts = comparison_parts(embedding, hybrid)
    order = ("embedding", "hybrid", "intersection", "only_embedding", "only_hybrid")
    return _manifest(queries, {f"{k}_image_ids": {**parts, "intersection": both(hybrid, embedding)}[k] for k in order})


def comparison_parts(embedding: DataFrame, hybrid: DataFrame) -> dict[str, DataFrame]:
    """The rankings that a comparison shows in a folder each."""
    return {"embedding": embedding, "hybrid": hybrid, "only_embedding": only(embedding, hybrid), "only_hybrid": only(hybrid, embedding)}


def filter_manifest(queries: DataFrame, embedding: DataFrame, lexical: DataFrame, final: DataFrame, candidate_top_k: int = 20, semantic_top_n: int = 10, lexical_top_n: int = 8) -> DataFrame:
    parts = filter_parts(embedding, lexical, final, candidate_top_k, semantic_top_n, lexical_top_n)
    names = (f"embedding_top{candidate_top_k}", f"embedding_top{semantic_top_n}", f"bm25_top{lexical_top_n}", "final_filtered", "filtered_out")
    out = _manifest(queries, {f"{n}_image_ids": d for n, d in zip(names, parts.values(), strict=True)})
    return out.withColumn("final_result_count", F.size("final_filtered_image_ids"))


def filter_parts(embedding: DataFrame, lexical: DataFrame, final: DataFrame, candidate_top_k: int = 20, semantic_top_n: int = 10, lexical_top_n: int = 8) -> dict[str, DataFrame]:
    """The rankings that a rank gate's comparison shows in a folder each."""
    top = embedding.where(F.col("rank") <= candidate_top_k)
    head = top.where(F.col("rank") <= semantic_top_n)
    return {
        f"embedding_top{candidate_top_k}": top,
        f"embedding_top{semantic_top_n}": head,
        f"bm25_top{lexical_top_n}_candidates": lexical.where(F.col("rank") <= lexical_top_n),
        "final_filtered": final,
        f"filtered_out_from_embedding_top{semantic_top_n}": only(head, final),
    }
