"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.llm import decision_list, factorization, pii
from roadlens.llm.common import ensure_checkpoint_dir, table
from roadlens.llm.minmax_dedup import near_duplicates
from roadlens.llm.packing import best_fit, word_lengths

#: Scores under this are rejected.
LEAST_SCORE = 0.7


def _shielded(docs: DataFrame) -> DataFrame:
    """``docs`` with columns c0, c1, ..., so that no operator's column can clash with one of its own."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def _at(docs: DataFrame, name: str) -> str | None:
    return f"c{docs.columns.index(name)}" if name in docs.columns else None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores at LEAST_SCORE or more; all, where labels of one class or none leave it untrained.

    It is fitted on the labelled rows of the raw documents, whatever ``docs`` has.
    """
    machine = factorization.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), where=lambda c: ~factorization.held_out(c))
    if not machine.trained:
        return docs
    own = _shielded(docs)
    scored = factorization.score(own, machine, own.columns, _at(docs, "text"), _at(docs, "n_chars"))
    return scored.where(F.col("score") >= LEAST_SCORE).select(own.columns).toDF(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no learned rule rejects.

    The rules are learned from the labelled rows of the raw documents: those that an
    earlier stage kept have hardly a bad one left to learn from.
    """
    rules = decision_list.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    own = _shielded(docs)
    return decision_list.judged(own, rules, own.columns, _at(docs, "text")).where("rule is null").select(own.columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, the one with the smallest id; five-word shingles, similarity 0.8."""
    own = _shielded(docs)
    number, text = _at(docs, "doc_id"), _at(docs, "text")
    dropped = near_duplicates(own, id_col=number, text_col=text).where("not kept").select(F.col(number).alias("dropped")).distinct()
    return own.join(dropped, F.col(number) == F.col("dropped"), "left_anti").toDF(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text."""
    own, text, size = _shielded(docs), _at(docs, "text"), _at(docs, "n_chars")
    out = pii.redact(own, pii.fit(own, id_col=_at(docs, "doc_id"), text_col=text), text_col=text)
    if size:
        out = out.withColumn(size, F.coalesce(F.char_length(text).cast("long"), F.col(size)))
    return out.toDF(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 512 to 8192 words."""
    return best_fit(word_lengths(docs))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("PII", personal_data),
    ("best-fit packing", packing),
]

#: Learned models and greedy packing have no SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The stages over all documents, each written to the shared folder and read again as the next one's input.

    ``folder``: where they are written, by default a new one. A run that names the folder of one that was
    stopped goes on after the last stage that is whole there. Folders stay until they are deleted, since the result is read from the last.
    """
    ensure_checkpoint_dir(spark)
    folder = folder or f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        if i == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        if not _whole(spark, f"{folder}/{i}"):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs


def _whole(spark: SparkSession, folder: str) -> bool:
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)
