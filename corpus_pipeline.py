"""The corpus pipeline: toxicity filter, near-copy and passage dedup, mixing, tokenisation."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import mixing, pieces, simhash, toxicity, units
from lodestone.llm.common import set_checkpoints, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the documents and labels given, doesn't find toxic; rows with a null doc_id are judged too, null or empty texts stay."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near copies, that with the least doc_id; rows with a null doc_id or no word stay."""
    return simhash.drop_near_copies(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds; one that had text and keeps none goes.

    n_chars, where docs has it, follows the text that was cut. Null and empty texts stay, repeated rows are cut
    alike, columns of any name pass through, and an empty table gives an empty table.
    """
    cut = units.cut(docs)
    left = cut.where((F.size("removed") == 0) | F.col("text").rlike(r"\S"))
    row = F.col("row")
    length = lambda c: F.when(F.size("removed") > 0, F.length("text")).otherwise(row[c]).cast(docs.schema[c].dataType).alias(c)
    return left.select(*[F.col("text") if c == "text" else length(c) if c == "n_chars" else row[c].alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the fitted rates say; labels whose documents are gone are not used. Rows with a null doc_id stay once."""
    return mixing.mix_documents(docs, table(spark, sf_dir, "labels"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids and the best segmentations of every row, null and empty texts included."""
    return pieces.encoded(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_copies),
    ("substring_dedup", without_repeats),
    ("mixing", mixed),
    ("sentencepiece", tokenised),
]

#: Classifiers and lattices have no SQL form; tests/llm/test_pipeline.py holds run() against stages by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared folder and read again.

    A stage's folder is deleted when the next stage has been written, so that one copy of the corpus is held beside
    the documents; the last one stays for the caller to read. Null, empty and very long texts, repeated rows and
    empty tables go through as the stages say.
    """
    set_checkpoints(spark)
    folder = posixpath.join(spark.sparkContext._jsc.sc().getCheckpointDir().get(), f"pipeline-{uuid.uuid4().hex}")
    docs, before = table(spark, sf_dir, "documents"), None
    for number, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        docs, before = spark.read.parquet(at), at
    return docs
