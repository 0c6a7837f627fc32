"""Sinks: index tables, caches, snapshots, JSON lines, splits."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval


def save_index(chunks: DataFrame, folder: str) -> None:
    """Chunks and the lexical index over them (postings, statistics, idf) as Parquet tables."""
    chunks.write.mode("overwrite").parquet(os.path.join(folder, "chunks"))
    stored = chunks.sparkSession.read.parquet(os.path.join(folder, "chunks"))
    retrieval.postings(stored, "chunk_id").write.mode("overwrite").parquet(os.path.join(folder, "postings"))
    retrieval.corpus_stats(stored).write.mode("overwrite").parquet(os.path.join(folder, "stats"))
    read = lambda name: chunks.sparkSession.read.parquet(os.path.join(folder, name))
    retrieval.terms_with_idf(read("postings"), read("stats")).write.mode("overwrite").parquet(os.path.join(folder, "idf"))


def save_vectors(vectors: DataFrame, folder: str) -> None:
    """A dense index: vectors (id, v) scaled to length 1, zero vectors as they are."""
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = vectors.withColumn("_s", size).select("id", F.transform("v", lambda x: F.when(F.col("_s") > 0, x / F.col("_s")).otherwise(x.cast("double"))).alias("v"))
    unit.write.mode("overwrite").parquet(os.path.join(folder, "vectors"))


def search_index(spark: SparkSession, folder: str, queries: DataFrame, k: int = 10) -> DataFrame:
    """BM25 top k of queries (query_id, query) from the tables that save_index() wrote, without reading a text."""
    return retrieval.bm25_indexed(spark.read.parquet(os.path.join(folder, "postings")), spark.read.parquet(os.path.join(folder, "stats")), queries, k)


def save_documents(docs: DataFrame, path: str) -> None:
    """Document metadata (doc_id, source_path, doc_type, title, page_count, chunk_count) as JSON lines."""
    docs.select("doc_id", "source_path", "doc_type", "title", "page_count", "chunk_count").write.mode("overwrite").json(path)


def joined_lines(spark: SparkSession, paths: list[str], to: str) -> int:
    """Text lines of several files or folders as one folder; the number of lines that aren't blank."""
    lines = spark.read.text(paths).where("trim(value) <> ''")
    lines.write.mode("overwrite").text(to)
    return spark.read.text(to).count()


def clear_index(spark: SparkSession, folder: str) -> None:
    """Replace the tables of an index by empty ones."""
    for name in ("chunks", "postings", "stats", "idf"):
        path = os.path.join(folder, name)
        spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)


def append_cache(fresh: DataFrame, folder: str) -> None:
    """New cache rows (hash, v), partitioned by the hash's first two digits."""
    fresh.withColumn("prefix", F.substring("hash", 1, 2)).write.mode("append").partitionBy("prefix").parquet(folder)


def save_snapshot(snapshot: DataFrame, path: str) -> None:
    snapshot.coalesce(1).write.mode("append").json(path)


def json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def save_splits(rows: DataFrame, folder: str) -> None:
    """Examples (kind, split, ..) under kind=../split=.., one write for all outputs."""
    rows.write.mode("overwrite").partitionBy("kind", "split").json(folder)


def export_symbols(symbols: DataFrame, path: str, how: str = "csv") -> None:
    flat = symbols.select(*[F.concat_ws(";", c).alias(c) if t.startswith("array") else F.col(c) for c, t in symbols.dtypes])
    if how == "csv":
        flat.write.mode("overwrite").option("header", "true").csv(path)
    elif how == "json":
        symbols.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"how must be csv or json, not {how}")


def clone_index(spark: SparkSession, source: str, target: str) -> None:
    for name in ("chunks", "postings", "stats", "idf"):
        spark.read.parquet(os.path.join(source, name)).write.mode("overwrite").parquet(os.path.join(target, name))
