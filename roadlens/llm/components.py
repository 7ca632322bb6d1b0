"""Connected components by contraction, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Edges or labels that a partition has at least, where there are more partitions than cores.
FEWEST = 20_000


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, label) for every node of an edge; label is the smallest node that it reaches.

    Every round maps each node to the smallest of its closed neighbourhood and
    rewrites the edges between the images, until none is left. At least half of
    the nodes of a component that has edges go each round. A node with very many
    neighbours is reduced before the shuffle (``min``) and met in plain joins,
    which adaptive execution can split. Null ends and loops are ignored. Edges
    are counted each round, so that what few are left does not take a task for
    each of many shuffle partitions, which the driver would have to keep.
    """
    cores = edges.sparkSession.sparkContext.defaultParallelism
    fewer = lambda df, n: checkpoint(df.coalesce(max(1, cores, n // FEWEST)))
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where(F.col("u") != F.col("v"))
    e = checkpoint(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    labels = e.select(F.col("u").alias("node")).union(e.select("v")).distinct().withColumn("label", F.col("node"))
    first = n = e.count()
    while n:
        both = e.union(e.select("v", "u"))
        near = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("r"))
        near = fewer(near, n)
        e = e.join(near, e.u == near.x).select(F.col("r").alias("u"), "v")
        e = e.join(near, e.v == near.x).select("u", F.col("r").alias("v")).where("u <> v")
        e = fewer(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), n)
        labels = labels.join(near, labels.label == near.x, "left").select("node", F.coalesce("r", "label").alias("label"))
        labels, n = fewer(labels, first), e.count()
    return labels
