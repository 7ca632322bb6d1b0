"""Captioning that can be stopped and started again: each image is captioned and stored once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, vectors
from ..schema import CAPTION_ROW
from ..sources import sinks
from .ingest import _there

IMAGES = "*.{jpg,jpeg,png,bmp,webp,JPG,JPEG,PNG,BMP,WEBP}"


def image_stream(spark: SparkSession, folder: str, files_a_trigger: int = 100) -> DataFrame:
    """(image_path) of the image files below a folder, some at a time. Only their names are read here; models read the files."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", IMAGES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_a_trigger)
    return files.load(folder).select(F.regexp_replace("path", "^file:/*", "/").alias("image_path"))


def path_stream(spark: SparkSession, folder: str, files_a_trigger: int = 1) -> DataFrame:
    """(image_path) from JSON lines with that field."""
    return spark.readStream.schema("image_path string").option("maxFilesPerTrigger", files_a_trigger).json(folder).where("image_path is not null")


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The caption rows in ``folder``, of all runs."""
    return spark.read.schema(CAPTION_ROW).json(folder) if _there(spark, folder) else spark.createDataFrame([], CAPTION_ROW)


def caption_stream_to(folder: str, images: DataFrame, load: Callable, checkpoint: str, prompt: str = "Describe the scene.", retry: bool = False):
    """Starts a query that captions each batch's images and appends the rows to ``folder``; does what is there and stops.

    Images that have a row are left out, those whose row is a failure only without ``retry``. So when a batch is done again,
    after the job or the whole application was lost, nothing that is stored goes to the model, and no image
    has two rows. A batch is the unit of storing: what it had not committed is done again.
    """

    def add(batch: DataFrame, _: int) -> None:
        have = stored(batch.sparkSession, folder)
        todo = batch.select("image_path").distinct().join((have.where("success") if retry else have).select("image_path"), "image_path", "left_anti")
        rows = vectors.caption(todo, load, prompt=prompt)
        sinks.append_captions(rows.select("image_path", "success", F.col("seconds").alias("inference_seconds"), "caption", "error"), folder)

    return images.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summary(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of all runs, one row an image: a success where it has one."""
    best = stored(spark, folder).groupBy("image_path").agg(F.max_by(F.struct("success", "inference_seconds"), F.col("success")).alias("x"))
    return evaluate.caption_summary(best.select("x.*"))
