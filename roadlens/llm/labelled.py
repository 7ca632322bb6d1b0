"""Bounded, repeatable samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int, where=None, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Documents with ``__label`` (0 or 1) for at most ``max_rows`` labelled ids, those with the smallest hash of the id.

    Labels other than 0 and 1 and null ids don't count; ids labelled both ways
    count as 0. ``where`` further limits the ids. The ids are broadcast: they are
    ``max_rows`` at most. Which ids come first does not depend on the rows' order.
    An id may have many rows: what gathers them must limit the rows as well.
    """
    fresh = "__label"
    if fresh in docs.columns or "__id" in docs.columns:
        docs = docs.drop(fresh, "__id")
    few = labels.select(col(id_col).alias("__id"), col(label_col).cast("int").alias("__label")).where("__id is not null and __label in (0, 1)")
    if where is not None:
        few = few.where(where("__id"))
    few = few.groupBy("__id").agg(F.min("__label").alias("__label"))
    few = few.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    return docs.join(F.broadcast(few), col(id_col) == F.col("__id")).drop("__id")
