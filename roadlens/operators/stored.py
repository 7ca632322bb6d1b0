"""An index on disk that answers a search from the blocks that can matter."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import checkpoint, saved
from .rank import RANKED

#: About so many documents, neighbours by place, are a range; a term's postings in one are a block. Blocks lie in folders by hash of the term.
RANGE, BUCKETS = 2048, 64
#: Of each query so many ranges with the highest bounds are read first.
SEEDS = 3
#: Up to so many terms are named in the scan's filter; searches with more read whole rows instead.
MOST_NAMED = 2000
_BLOCKS = "term string, range int, most double, least double, pos array<bigint>, weight array<double>, bucket int"


def _bucket(term: str = "term") -> F.Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def write_blocks(rows: DataFrame, folder: str, width: int | None = None) -> None:
    """Postings of index rows (corpus_pos, terms, weight) as blocks: (term, range, most, least: the bounds of its weights, pos and weight arrays).

    Ranges are dealt by place, so a block has as many postings as a range has documents at most. Rows are sorted by
    term and range, so that filters on them skip row groups and pages of a folder's files.
    """
    n = rows.count()
    dealt = rows.select(F.col("corpus_pos").cast("long"), "terms", "weight").repartitionByRange(max(1, math.ceil(n / (width or RANGE))), "corpus_pos")
    blocks = saved(dealt.mapInArrow(_packed, "term string, range int, most double, least double, pos array<bigint>, weight array<double>").withColumn("bucket", _bucket()))
    blocks.repartitionByRange("bucket", "term", "range").sortWithinPartitions("bucket", "term", "range").write.mode("overwrite").partitionBy("bucket").parquet(folder)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of a partition's rows, which are a range: they are made where the rows are, so that no posting is shuffled by itself."""
    kept = [b for b in batches if b.num_rows]
    if not kept:
        return
    terms = pa.chunked_array([b.column(1).flatten() for b in kept]).combine_chunks().dictionary_encode()
    weight = np.concatenate([b.column(2).flatten().to_numpy(zero_copy_only=False) for b in kept])
    pos = np.concatenate([np.repeat(b.column(0).to_numpy(zero_copy_only=False), np.diff(b.column(1).offsets.to_numpy())) for b in kept])
    code = terms.indices.to_numpy(zero_copy_only=False)
    if not len(code):
        return
    order = np.lexsort((pos, code))
    weight, starts = weight[order], np.flatnonzero(np.diff(code[order], prepend=-1))
    ends = pa.array(np.append(starts, len(order)).astype(np.int32))
    lists = (pa.ListArray.from_arrays(ends, pa.array(x)) for x in (pos[order], weight))
    n = len(starts)
    yield pa.RecordBatch.from_arrays(
        [terms.dictionary, pa.array(np.full(n, TaskContext.get().partitionId(), np.int32)), pa.array(np.maximum.reduceat(weight, starts)), pa.array(np.minimum.reduceat(weight, starts)), *lists],
        names=["term", "range", "most", "least", "pos", "weight"],
    )


@dataclass
class Blocks:
    """Blocks for queries (q, term, w: a weight): what the scan reads is limited to the queries' terms, their folders and the columns that are used."""

    folder: str
    asked: DataFrame
    terms: list[str]

    def scan(self, spark: SparkSession) -> DataFrame:
        buckets = spark.createDataFrame([(t,) for t in self.terms], "term string").select(_bucket().alias("b")).distinct().collect()
        read = spark.read.schema(_BLOCKS).parquet(self.folder)
        return read.where(F.col("bucket").isin([x.b for x in buckets]) & F.col("term").isin(self.terms))

    def bounds(self) -> DataFrame:
        """(q, range, bound): no document of the range scores more for the query. Reads no postings."""
        part = F.greatest(F.col("w") * F.when(F.col("w") > 0, F.col("most")).otherwise(F.col("least")), F.lit(0.0))
        meta = self.scan(self.asked.sparkSession).select("term", "range", "most", "least")
        return meta.join(F.broadcast(self.asked), "term").groupBy("q", "range").agg(F.sum(part).alias("bound"))

    def scores(self, ranges: DataFrame) -> DataFrame:
        """(q, corpus_pos, score) of the documents in ``ranges`` (q, range) that have a term of the query."""
        read = self.scan(self.asked.sparkSession).select("term", "range", "pos", "weight").join(F.broadcast(self.asked), "term").join(ranges.select("q", "range"), ["q", "range"])
        each = read.select("q", "w", F.explode(F.arrays_zip(F.col("pos").alias("p"), F.col("weight").alias("v"))).alias("x"))
        return each.groupBy("q", F.col("x.p").alias("corpus_pos")).agg(F.sum(F.col("w") * F.col("x.v")).alias("score"))


def needed(blocks: Blocks, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ranges read first, those that must be read after them, and the first ones' scores.

    The k-th best score of the first ranges is a floor of the result's; a range whose
    bound is lower can't add to it. Queries that have fewer scores there have no floor.
    """
    bounds = checkpoint(blocks.bounds())
    order = Window.partitionBy("q").orderBy(F.desc("bound"), "range")
    seeds = checkpoint(bounds.withColumn("r", F.row_number().over(order)).where(F.col("r") <= SEEDS))
    first = checkpoint(blocks.scores(seeds))
    best = first.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("r") == k)
    floor = best.select("q", (F.col("score") - 1e-8).alias("floor"))
    rest = bounds.join(seeds.select("q", "range"), ["q", "range"], "left_anti").join(floor, "q", "left")
    return seeds, checkpoint(rest.where(F.col("bound") >= F.coalesce("floor", F.lit(-1.0))).select("q", "range")), first


def search(blocks: Blocks, asked: DataFrame, corpus: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The ranked frame of the queries ``asked`` (q, query_id) that have k positive scores, and (q) of those that don't."""
    _, rest, first = needed(blocks, k)
    found = first if rest.isEmpty() else first.unionByName(blocks.scores(rest))
    order = Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "corpus_pos")
    best = checkpoint(found.where(F.round("score", 9) > 0).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    full = best.groupBy("q").agg(F.count("*").alias("n")).where(F.col("n") == k).select("q")
    named = best.join(full, "q", "left_semi").join(asked.select("q", "query_id"), "q").join(corpus.select("corpus_pos", "image_id", "image_path"), "corpus_pos")
    return named.select(*RANKED), asked.select("q").join(full, "q", "left_anti")
