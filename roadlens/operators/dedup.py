"""Content-hash deduplication of a corpus, and lookups that must not miss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deduplicated(records: DataFrame, paths: bool = False) -> DataFrame:
    """One row a content hash of ``records`` (corpus_pos, image_path, caption, image_hash, label): its first record and its labels.

    corpus_pos is that of the first record, image_id the hash. Labels are sorted;
    null labels are none. ``paths`` adds duplicate_paths, all of a hash's paths in corpus order
    with repeats; that gathers a hash's records in one row, so it is for output, and
    ``members`` has the same as rows.
    """
    first = lambda c: F.min_by(c, "corpus_pos").alias(c)
    lists = F.transform(F.array_sort(F.collect_list(F.struct("corpus_pos", "image_path"))), lambda x: x["image_path"])
    out = records.groupBy("image_hash").agg(
        F.min("corpus_pos").alias("corpus_pos"),
        first("image_path"),
        first("caption"),
        *([lists.alias("duplicate_paths")] if paths else []),
        F.array_sort(F.collect_set("label")).alias("labels"),
        F.count("*").cast("int").alias("duplicate_count"),
    )
    return out.withColumn("image_id", F.col("image_hash"))


def members(records: DataFrame) -> DataFrame:
    """(image_hash, corpus_pos, image_path) of every record: the duplicates as rows."""
    return records.select("image_hash", "corpus_pos", "image_path")


def hash_by_path(records: DataFrame) -> DataFrame:
    """(image_path, image_hash), once each; no hash gathers its paths."""
    return records.select("image_path", "image_hash").distinct()


def resolved(path: Column) -> Column:
    """A path without repeated slashes, and without . and .. components, whose parent they drop."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    none = F.array().cast("array<string>")
    walked = F.aggregate(parts, none, lambda done, x: F.when(x != "..", F.array_append(done, x)).otherwise(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))))
    return F.concat(F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(walked, "/"))


def hashes_of(left: DataFrame, records: DataFrame, on: str = "image_path") -> DataFrame:
    """``left`` with image_hash, by its path as it is, else by its resolved path; one that neither finds fails the job, naming it."""
    have = hash_by_path(records)
    as_is = have.select(F.col("image_path").alias(on), F.col("image_hash").alias("__h"))
    far = have.select(resolved(F.col("image_path")).alias("__p"), F.col("image_hash").alias("__r")).groupBy("__p").agg(F.min("__r").alias("__r"))
    both = left.join(as_is, on, "left").withColumn("__p", resolved(F.col(on))).join(far, "__p", "left")
    miss = F.raise_error(F.concat(F.lit("hash not found: "), F.coalesce(F.col(on).cast("string"), F.lit("null")))).cast("string")
    return both.withColumn("image_hash", F.coalesce("__h", "__r", miss)).drop("__h", "__p", "__r")


def lookup(left: DataFrame, right: DataFrame, on: str, what: str) -> DataFrame:
    """Inner join on ``on`` that fails, naming a key, if a row of ``left`` has no match. The miss is raised by the job itself; nothing is collected."""
    found = right.withColumn("__found", F.lit(True))
    joined = left.join(found, on, "left")
    miss = F.raise_error(F.concat(F.lit(f"{what} not found: "), F.coalesce(F.col(on).cast("string"), F.lit("null"))))
    return joined.withColumn("__found", F.when(F.col("__found"), True).otherwise(miss.cast("boolean"))).where("__found").drop("__found")
