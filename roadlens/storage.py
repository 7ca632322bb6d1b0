"""Checkpoints in the folder that all executors share, and scans that feed all cores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder in spark.checkpoint.dir; a temporary one only where that is unset on a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(folder)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared checkpoint folder: computed once, and not again for a lost executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def saved(df: DataFrame, **options: str) -> DataFrame:
    """``df`` as Parquet in the shared checkpoint folder, which takes less room than a checkpoint and is read by column."""
    ensure_checkpoint_dir(df.sparkSession)
    folder = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over the cores where its scan has fewer splits than there are cores, as with one small row group; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
