"""Files as tables: discovery, text with an encoding ladder, logs, chat JSON lines, indexes."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as tx

TEXT_EXTENSIONS = ("pdf", "txt", "md", "tex", "rst")
CODE_EXTENSIONS = ("py", "r", "R", "c", "h", "cpp", "cc", "cxx", "hpp", "h++")


def binary(spark: SparkSession, path: str, extensions: tuple[str, ...] = (), recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length, content) of the files below a path; only what is selected is read."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if extensions:
        read = read.option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
    return read.load(path)


def discover(spark: SparkSession, path: str, extensions: tuple[str, ...] = TEXT_EXTENSIONS + CODE_EXTENSIONS + ("ipynb", "html")) -> DataFrame:
    """(path, size, doc_type, language, doc_id) without reading contents."""
    found = binary(spark, path, extensions)
    return found.select("path", F.col("length").alias("size"), tx.document_type(F.col("path")).alias("doc_type"), tx.language(F.col("path")).alias("language"), tx.document_id(F.col("path")).alias("doc_id"))


def texts(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("txt", "md", "tex", "rst")) -> DataFrame:
    """(path, text, encoding): UTF-8 where a file is valid, else Latin-1, which any bytes are."""
    content = F.col("content")
    utf8 = F.try_validate_utf8(content.cast("string"))
    return binary(spark, path, extensions).select("path", F.coalesce(utf8, F.decode(content, "ISO-8859-1")).alias("text"), F.when(utf8.isNotNull(), "utf-8").otherwise("latin-1").alias("encoding"))


def code(spark: SparkSession, path: str) -> DataFrame:
    """(path, source, language) of code files."""
    return texts(spark, path, CODE_EXTENSIONS).select("path", F.col("text").alias("source"), tx.language(F.col("path")).alias("language")).where("language <> 'unknown'")


def paged(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, pages, title, error): PDF pages behind [PAGE n] markers, where a PDF library is installed.

    The title is the file's own or its stem; an unreadable file has null text and the error's message.
    """

    def run(frames):
        import io

        import pandas as pd
        from pypdf import PdfReader

        for f in frames:
            out = []
            for at, data in zip(f["path"], f["content"]):
                stem = os.path.splitext(os.path.basename(at))[0]
                try:
                    reader = PdfReader(io.BytesIO(data))
                    pages = [p.extract_text() or "" for p in reader.pages]
                    text = "\n".join(f"[PAGE {i}]\n{t}" for i, t in enumerate(pages, 1) if t.strip())
                    out.append((at, text, len(pages), (reader.metadata or {}).get("/Title") or stem, None))
                except Exception as e:  # noqa: BLE001 - a damaged file is a row with its error
                    out.append((at, None, None, stem, str(e)))
            yield pd.DataFrame(out, columns=["path", "text", "pages", "title", "error"])

    return binary(spark, path, ("pdf",)).select("path", "content").mapInPandas(run, "path string, text string, pages int, title string, error string")


def is_scanned(pages: DataFrame, least: int = 100) -> DataFrame:
    """(path, scanned) for pages (path, page, text): fewer than `least` characters a page on average."""
    return pages.groupBy("path").agg((F.avg(F.length(F.coalesce("text", F.lit("")))) < least).alias("scanned"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of log files, line numbers from 1."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def tail(lines: DataFrame, n: int) -> DataFrame:
    from pyspark.sql import Window

    last = F.max("line_no").over(Window.partitionBy("path"))
    return lines.withColumn("_last", last).where(F.col("line_no") > F.col("_last") - n).drop("_last")


def chats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MESSAGES).json(path)


def index(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a saved index: chunks, postings, documents, cache."""
    return spark.read.parquet(os.path.join(folder, name))


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SNAPSHOT).json(path).orderBy(F.desc("snapshot_id"))


def jdbc(spark: SparkSession, url: str, table: str) -> DataFrame:
    """A relational catalog table, where its driver is on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table).load()


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest snapshot, one row or none."""
    return snapshots(spark, path).limit(1)


def stage_done(spark: SparkSession, folder: str) -> bool:
    """Whether a stage's Parquet output is complete."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def collision_free(names: DataFrame) -> DataFrame:
    """names (name, seq) plus stored: name, name_1, name_2.. for repeated names in order of seq."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("name").orderBy("seq")) - 1
    stem, ext = F.regexp_replace("name", "\\.[^.]*$", ""), F.regexp_extract("name", "(\\.[^.]*)$", 1)
    return names.withColumn("_n", n).withColumn("stored", F.when(F.col("_n") == 0, F.col("name")).otherwise(F.concat(stem, F.lit("_"), F.col("_n").cast("string"), ext))).drop("_n")


def unexpired(sessions: DataFrame, now, hours: int = 24) -> DataFrame:
    return sessions.where(F.col("updated_at") >= now - F.expr(f"INTERVAL {hours} HOURS"))
