"""Seeded samples of each group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import checkpoint


def _numbered(rows: DataFrame, group: str, key: str) -> DataFrame:
    """``rows`` with sample_index, each group's places by key from 1, without one task that has a whole group.

    Rows are dealt by ranges of (group, key) and kept; places within a range are then
    moved by how many rows of the group lie in earlier ranges.
    """
    dealt = checkpoint(rows.repartitionByRange(F.col(group), F.col(key)).withColumn("__p", F.spark_partition_id()))
    n = dealt.groupBy("__p", group).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = n.select("__p", F.col(group).alias("__g"), before.alias("__before"))
    here = dealt.withColumn("__i", F.row_number().over(Window.partitionBy("__p", group).orderBy(key)))
    out = here.join(F.broadcast(moved), (here["__p"] == moved["__p"]) & here[group].eqNullSafe(moved["__g"]))
    return out.withColumn("sample_index", (F.col("__i") + F.col("__before")).cast("int")).select(*rows.columns, "sample_index")


def stratified_sample(rows: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows of each group, all for n <= 0, with candidate_count and sample_index (from 1, by key).

    Which rows are drawn depends on md5 of seed and key, so not on their order. The
    window is cut before the shuffle; counts come from a reduced aggregation, and where
    all rows stay they are numbered by ranges, so a hot group never gathers in one task.
    """
    counts = rows.groupBy(group).agg(F.count("*").alias("candidate_count"))
    if n <= 0:
        return _numbered(rows, group, key).join(counts, group)
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    order = Window.partitionBy(group).orderBy("__d", key)
    picked = rows.withColumn("__d", draw).withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__r", "__d")
    picked = picked.withColumn("sample_index", F.row_number().over(Window.partitionBy(group).orderBy(key)))
    return picked.join(counts, group)
