"""Captions as they arrive: JSON lines appended to a folder become an index that can be searched, each content once."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import stem, stripped
from ..operators import lexical
from ..schema import CAPTION_ROW
from ..storage import saved

#: Hex digits of a hash that name the folder it lies in, and those that name its Bloom filter.
FOLDER_DIGITS, FILTER_DIGITS = 1, 3
#: Bits of a Bloom filter for each hash, and how many of them a hash sets: one in some 150 hashes that were never seen passes.
BITS, SET = 12, 5
#: Places of a batch's rows are numbered below this power of two; the batch's own number lies above.
PLACE_BITS = 36
_LOG = "source string, number bigint, rows bigint, total bigint, seq int"


def caption_stream(spark: SparkSession, folder: str, files_a_trigger: int = 100) -> DataFrame:
    """Successful captions with their content hash, as they arrive and with repeats; without state."""
    rows = spark.readStream.schema(CAPTION_ROW).option("maxFilesPerTrigger", files_a_trigger).json(folder)
    path, text = stripped(F.col("image_path")), stripped(F.col("caption"))
    kept = rows.where(F.col("success") & (path != "") & (text != ""))
    return kept.select(stem(path).alias("image_id"), path.alias("image_path"), text.alias("caption"), F.sha2(text, 256).alias("caption_hash"))


def append_captions_to(folder: str, stream: DataFrame, checkpoint: str):
    """Starts a query that adds each batch to the index in ``folder``; runs what is there and stops."""
    source = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    return stream.writeStream.foreachBatch(lambda batch, number: append(batch, folder, source, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _there(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def log(spark: SparkSession, folder: str) -> DataFrame:
    """One row a batch that is whole: its source and number there, rows, the sum of their lengths, and seq, its number here."""
    if not _there(spark, f"{folder}/log"):
        return spark.createDataFrame([], _LOG)
    return spark.read.schema(_LOG).parquet(f"{folder}/log")


def append(batch: DataFrame, folder: str, source: str, number: int) -> int | None:
    """Adds captions (image_id, image_path, caption, caption_hash) whose hash is new; the batch's seq, or None where the log has it already.

    The log's row is written last. A batch that failed before is done again in its own folders, and
    readers know only what the log has. One writer at a time is expected.
    """
    spark = batch.sparkSession
    done = log(spark, folder).select("source", "number", "seq").collect()
    if any((x.source, x.number) == (source, number) for x in done):
        return None
    seq = max((x.seq for x in done), default=0) + 1
    at = lambda name: f"{folder}/{name}/seq={seq}"
    first = batch.groupBy("caption_hash").agg(F.min(F.struct("image_path", "image_id", "caption")).alias("x")).select("caption_hash", "x.*")
    fresh = _unseen(saved(first), folder)
    dealt = saved(fresh.orderBy("image_path", "caption_hash").withColumn("part", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.lit(seq << PLACE_BITS) + F.col("before") + F.col("i")
    dealt.join(F.broadcast(before), "part").select(place.alias("corpus_pos"), "image_id", "image_path", "caption", "caption_hash").write.mode("overwrite").parquet(at("corpus"))
    corpus = spark.read.parquet(at("corpus"))
    lexical.term_rows(corpus, lexical.bm25_terms()).write.mode("overwrite").parquet(at("rows"))
    rows = spark.read.parquet(at("rows"))
    lexical.document_counts(rows).write.mode("overwrite").parquet(at("df"))
    hashes = corpus.select("caption_hash", F.substring("caption_hash", 1, FOLDER_DIGITS).alias("prefix"))
    hashes.repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(at("hashes"))
    _filters(corpus).write.mode("overwrite").parquet(at("filters"))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    spark.createDataFrame([(source, number, n, total)], "source string, number bigint, rows bigint, total bigint").coalesce(1).write.mode("overwrite").parquet(at("log"))
    return seq


def _part() -> F.Column:
    return F.substring("caption_hash", 1, FILTER_DIGITS)


def _bits(hashes: list[str], size: int) -> np.ndarray:
    """The bits that each hash sets in a filter of ``size`` bits, a row each."""
    raw = np.frombuffer(bytes.fromhex("".join(hashes)), np.uint64).reshape(len(hashes), -1)
    return ((raw[:, 1:2] + np.arange(SET, dtype=np.uint64) * (raw[:, 2:3] | np.uint64(1))) % np.uint64(size)).astype(np.int64)


def _filters(corpus: DataFrame) -> DataFrame:
    """(part, size, bits): a Bloom filter for the hashes of a batch that share their first digits; a 4,096th of the batch each."""

    def build(t: pa.Table) -> pa.Table:
        hashes = t.column("caption_hash").to_pylist()
        size = max(64, BITS * len(hashes))
        bits = np.zeros(size, bool)
        bits[_bits(hashes, size).ravel()] = True
        return pa.table({"part": [hashes[0][:FILTER_DIGITS]], "size": pa.array([size], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    return corpus.select("caption_hash").groupBy(_part().alias("part")).applyInArrow(build, "part string, size bigint, bits binary")


def _unseen(batch: DataFrame, folder: str) -> DataFrame:
    """Rows of ``batch``, one a hash, whose hash no batch of the log has.

    Bloom filters name the folders (batch and first digit) that may have one of the hashes, which are
    a few where little repeats; only these are read and met.
    """
    spark = batch.sparkSession
    known = log(spark, folder).select("seq")
    if known.isEmpty():
        return batch
    filters = spark.read.schema("part string, size bigint, bits binary, seq int").parquet(f"{folder}/filters").join(F.broadcast(known), "seq")

    def tested(hashes: pa.Table, held: pa.Table) -> pa.Table:
        asked = hashes.column("caption_hash").to_pylist()
        out = []
        for seq, size, bits in zip(held.column("seq").to_pylist(), held.column("size").to_pylist(), held.column("bits").to_pylist(), strict=True) if asked else ():
            at = _bits(asked, size)
            hit = ((np.frombuffer(bits, np.uint8)[at >> 3] >> (7 - (at & 7)) & 1) == 1).all(1)
            out += sorted({(seq, asked[i][:FOLDER_DIGITS]) for i in np.flatnonzero(hit)})
        return pa.table({"seq": pa.array([x[0] for x in out], pa.int32()), "prefix": pa.array([x[1] for x in out], pa.string())})

    pairs = batch.select("caption_hash", _part().alias("part")).groupBy("part").cogroup(filters.groupBy("part")).applyInArrow(tested, "seq int, prefix string")
    folders = saved(pairs.distinct())
    stored = spark.read.schema("caption_hash string, seq int, prefix string").parquet(f"{folder}/hashes")
    return batch.join(stored.join(F.broadcast(folders), ["seq", "prefix"]).select("caption_hash"), "caption_hash", "left_anti")


def live_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(corpus_pos, image_id, image_path, caption, caption_hash) of all batches of the log: in their order, and within one by path."""
    return _whole(spark, folder, "corpus", "corpus_pos bigint, image_id string, image_path string, caption string, caption_hash string")


def _whole(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema + ", seq int").parquet(f"{folder}/{name}").join(F.broadcast(log(spark, folder).select("seq")), "seq").drop("seq")


def live_index(spark: SparkSession, folder: str) -> lexical.Postings:
    """A BM25 index of all batches so far. Their statistics are added up, and weights follow from them, so no batch is written again."""
    rows = _whole(spark, folder, "rows", "corpus_pos bigint, image_id string, image_path string, dl bigint, terms array<string>, tf array<bigint>")
    df = _whole(spark, folder, "df", "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    n, total = log(spark, folder).agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    return lexical.bm25_weighed(live_corpus(spark, folder), rows, df, n, total)
