"""Structure and chunking: lines, headings, sections, and the sequential packers.

The packers are inherently sequential, so the lengths of each document's sentences are folded in an Arrow batch where the
document lies, in time linear in their number; texts don't go to Python, and nothing is shuffled.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line): trimmed lines, pos from 0."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.trim(F.regexp_replace("line", "^[ \\t\\r]+|[ \\t\\r]+$", "")))


def headings(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line, level) of the lines that look like headings."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    marked = lines(docs).withColumn("before", F.lag("line").over(w)).withColumn("after", F.lead("line").over(w))
    return marked.where(tx.is_heading(F.col("line"), F.col("before"), F.col("after"))).select("doc_id", "pos", "line", tx.heading_level(F.col("line")).alias("level"))


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section_no, title, level, start_line, end_line, content): bodies under headings, page markers and
    blank lines left out; lines before the first heading form section 0 without a title."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    marked = lines(docs).withColumn("before", F.lag("line").over(w)).withColumn("after", F.lead("line").over(w))
    flag = tx.is_heading(F.col("line"), F.col("before"), F.col("after")) & ~F.col("line").rlike("^\\[PAGE [0-9]+\\]$")
    numbered = marked.withColumn("head", flag).withColumn("section_no", F.sum(F.col("head").cast("int")).over(w))
    body = F.when(~F.col("head") & (F.col("line") != "") & ~F.col("line").rlike("^\\[PAGE [0-9]+\\]$"), F.struct("pos", "line"))
    found = numbered.groupBy("doc_id", "section_no").agg(
        F.max(F.when(F.col("head"), F.col("line"))).alias("title"),
        F.min("pos").alias("start_line"),
        F.max("pos").alias("end_line"),
        F.array_join(F.transform(F.array_sort(F.collect_list(body)), lambda x: x["line"]), "\n").alias("content"),
    )
    return found.select("doc_id", "section_no", "title", F.when(F.col("title").isNotNull(), tx.heading_level(F.col("title"))).alias("level"), "start_line", "end_line", "content")


def markdown_headings(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, level, line) of '#' headings."""
    found = lines(docs).where(F.col("line").rlike("^#+"))
    return found.select("doc_id", "pos", F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), F.regexp_extract("line", "^#+[ \\t]*(.*)$", 1).alias("line"))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def _paths(levels: pd.Series) -> pd.Series:
    """For each heading the places of those on its path."""
    out = []
    for own in levels:
        stack, paths = [], []
        for i, level in enumerate(own):
            while stack and own[stack[-1]] >= level:
                stack.pop()
            stack.append(i)
            paths.append(list(stack))
        out.append(paths)
    return pd.Series(out, dtype=object)


def hierarchy(found: DataFrame) -> DataFrame:
    """found (doc_id, pos, line, level) plus path: the nearest preceding headings of ever smaller levels, outermost first.

    Only levels go to Python, and places come back."""
    grouped = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line", "level"))).alias("hs"))
    placed = grouped.withColumn("paths", _paths(F.transform("hs", lambda h: h["level"])))
    both = placed.select("doc_id", "hs", F.posexplode("paths").alias("i", "own"))
    return both.select("doc_id", F.get("hs", F.col("i")).alias("h"), F.transform("own", lambda j: F.get("hs", j)["line"]).alias("path")).select("doc_id", "h.pos", "h.line", "h.level", "path")


def _tail(lengths: list[int], first: int, last: int, budget: int) -> int:
    """Where the trailing sentences of first..last begin whose tokens together stay within the budget."""
    total, at = 0, last
    while at > first and total + lengths[at - 1] // 4 <= budget:
        at -= 1
        total += lengths[at] // 4
    return at


def _joined(lengths: list[int], first: int, last: int) -> int:
    """Tokens of sentences first..last joined by blanks."""
    return (sum(lengths[first:last]) + max(0, last - first - 1)) // 4


def places(lengths: list[int], target: int, most: int, overlap: int) -> list[tuple[int, int]]:
    """The chunks of a list of sentences, by their lengths: (first, end) of each.

    A sentence that would take the current chunk over `most` tokens closes it first; reaching `target` closes it
    after; each chunk begins with the sentences of the last that fit the overlap; what remains is a chunk.
    """
    first, tokens, out = 0, 0, []
    for i, n in enumerate(lengths):
        if first < i and tokens + n // 4 > most:
            out.append((first, i))
            first = _tail(lengths, first, i, overlap)
            tokens = _joined(lengths, first, i + 1)
        else:
            tokens += n // 4
        if tokens >= target:
            out.append((first, i + 1))
            first = _tail(lengths, first, i + 1, overlap)
            tokens = _joined(lengths, first, i + 1)
    return [*out, (first, len(lengths))] if first < len(lengths) else out


def places_paper(lengths: list[int], target: int = 600, most: int = 800, least: int = 200, overlap: int = 50) -> list[tuple[int, int]]:
    """places() by the papers' packer: token sums are not recounted; the last chunk needs `least`."""
    first, tokens, out = 0, 0, []
    total = lambda a, b: sum(n // 4 for n in lengths[a:b])
    for i, n in enumerate(lengths):
        if first < i and tokens + n // 4 > most:
            out.append((first, i))
            first = _tail(lengths, first, i, overlap)
            tokens = total(first, i)
        tokens += n // 4
        if tokens >= target:
            out.append((first, i + 1))
            first = _tail(lengths, first, i + 1, overlap)
            tokens = total(first, i + 1)
    return [*out, (first, len(lengths))] if tokens >= least and first < len(lengths) else out


def packed(sentences: list[str], target: int, most: int, overlap: int) -> list[str]:
    """Chunks of a sentence list, by places()."""
    return [" ".join(sentences[a:b]) for a, b in places([len(s) for s in sentences], target, most, overlap)]


def packed_paper(sentences: list[str], target: int = 600, most: int = 800, least: int = 200, overlap: int = 50) -> list[str]:
    """Chunks of the sentences of more than 10 characters, by places_paper()."""
    long = [s for s in sentences if len(s.strip(" ")) > 10]
    return [" ".join(long[a:b]) for a, b in places_paper([len(s) for s in long], target, most, least, overlap)]


_PLACES = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _chunked(rows: DataFrame, sentences: Column, find, index: str, text: str) -> DataFrame:
    """rows with (index, text) of each chunk that find(lengths) places in an array of sentences; only lengths go to Python."""

    def run(column: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else find(x.tolist()) for x in column], dtype=object)

    own = [c for c in rows.columns if c not in ("text", "content")]
    split = rows.select(*own, sentences.alias("_s"))
    placed = split.withColumn("_p", F.pandas_udf(run, _PLACES)(F.transform("_s", lambda s: F.length(s))))
    whole = lambda c: F.array_join(F.transform(F.sequence(c["first"], c["end"] - 1), lambda i: F.get("_s", i)), " ")
    return placed.select(*own, F.posexplode(F.transform("_p", whole)).alias(index, text))


def pack(rows: DataFrame, sentences: Column, target: int, most: int, overlap: int) -> DataFrame:
    """rows, but their text or content, with the chunks (i, raw) of their sentences, by places()."""
    return _chunked(rows, sentences, lambda n: places(n, target, most, overlap), "i", "raw")


def pack_paper(rows: DataFrame, sentences: Column) -> DataFrame:
    """rows, but their text, with the chunks (chunk_index, content) of their sentences of more than 10 characters, by places_paper()."""
    return _chunked(rows, F.filter(sentences, lambda s: F.length(F.trim(s)) > 10), places_paper, "chunk_index", "content")


def rag_chunks(docs: DataFrame, kind: str = "default") -> DataFrame:
    """(doc_id, chunk_index, text, token_count): chunks of documents under a type's token limits.

    Chunks below the minimum are dropped before and after cleaning, and the rest numbered from 0.
    """
    target, least, most = tx.STRATEGIES[kind]
    target = target or most
    parts = F.filter(tx.sentences(F.col("text")), lambda s: F.length(F.trim(s)) > 0)
    raw = pack(docs.select("doc_id", "text"), parts, target, most, int(0.1 * target))
    cleaned = raw.where(tx.token_count(F.col("raw")) >= least).withColumn("text", tx.clean(F.col("raw"))).where(tx.token_count(F.col("text")) >= least)
    w = Window.partitionBy("doc_id").orderBy("i")
    return cleaned.select("doc_id", (F.row_number().over(w) - 1).alias("chunk_index"), "text", tx.token_count(F.col("text")).alias("token_count"))


def paper_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, content, token_count, prev_preview, next_preview)."""
    raw = pack_paper(docs.select("doc_id", "text"), tx.sentences(F.col("text")))
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    return raw.select("doc_id", "chunk_index", "content", tx.token_count(F.col("content")).alias("token_count"), F.substring(F.lag("content").over(w), 1, 150).alias("prev_preview"), F.substring(F.lead("content").over(w), 1, 150).alias("next_preview"))


def paragraph_chunks(docs: DataFrame, most: int = 1000) -> DataFrame:
    """(doc_id, chunk_index, text): paragraphs joined up to `most` characters, the last two sentences repeated."""
    none = "cast(array() as array<string>)"

    def step(a: Column, p: Column) -> Column:
        over = (F.length(a["cur"]) + F.length(p) > most) & (a["cur"] != "")
        parts = F.split(a["cur"], "\\. ")
        tail = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, -2, 2), ". ")).otherwise("")
        return F.struct(
            F.when(over, F.concat(tail, F.lit(" "), p)).when(a["cur"] != "", F.concat(a["cur"], F.lit("\n\n"), p)).otherwise(p).alias("cur"),
            F.when(over, F.concat(a["out"], F.array(F.trim(a["cur"])))).otherwise(a["out"]).alias("out"),
        )

    start = F.struct(F.lit("").alias("cur"), F.expr(none).alias("out"))
    packed = F.aggregate(F.split("text", "\n[ \\t\\r\\n]*\n"), start, step, lambda a: F.when(F.trim(a["cur"]) != "", F.concat(a["out"], F.array(F.trim(a["cur"])))).otherwise(a["out"]))
    return docs.select("doc_id", F.posexplode(packed).alias("chunk_index", "text"))


def page_numbers(chunks: DataFrame) -> DataFrame:
    """chunks (doc_id, chunk_index, text) plus page: the last [PAGE n] marker seen up to the chunk."""
    marks = F.regexp_extract_all("text", F.lit("\\[PAGE ([0-9]+)\\]"), 1)
    w = Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return chunks.withColumn("page", F.last(F.try_element_at(marks, F.lit(-1)).cast("int"), ignorenulls=True).over(w))


def windows(chunks: DataFrame, size: int) -> DataFrame:
    """(doc_id, window_no, indices): complete runs of `size` consecutive chunks that don't overlap."""
    grouped = chunks.groupBy("doc_id", F.floor(F.col("chunk_index") / size).alias("window_no")).agg(F.array_sort(F.collect_list("chunk_index")).alias("indices"))
    return grouped.where(F.size("indices") == size)


def structured(docs: DataFrame) -> DataFrame:
    """(doc_id, section_no, title, path, content): the sections of documents (doc_id, doc_type, text) by type.

    Markdown is cut at '#' headings, everything else at lines that look like headings; a document without any is one
    section without a title. path holds the titles above a section, its own last.
    """
    marked = F.col("doc_type") == "md"
    own = sections(docs.where(~F.coalesce(marked, F.lit(False)))).select("doc_id", "section_no", "title", "level", F.col("start_line").alias("pos"), "content")
    w = Window.partitionBy("doc_id").orderBy("pos")
    numbered = lines(docs.where(marked)).withColumn("head", F.col("line").rlike("^#+")).withColumn("section_no", F.sum(F.col("head").cast("int")).over(w))
    body = F.when(~F.col("head") & (F.col("line") != ""), F.struct("pos", "line"))
    head = F.max(F.when(F.col("head"), F.col("line")))
    notes = numbered.groupBy("doc_id", "section_no").agg(head.alias("h"), F.min("pos").alias("pos"), F.array_join(F.transform(F.array_sort(F.collect_list(body)), lambda x: x["line"]), "\n").alias("content"))
    notes = notes.select("doc_id", "section_no", F.regexp_extract("h", "^#+[ \\t]*(.*)$", 1).alias("title"), F.length(F.regexp_extract("h", "^(#+)", 1)).alias("level"), "pos", "content")
    every = own.unionByName(notes)
    paths = hierarchy(every.where("title IS NOT NULL").select("doc_id", "pos", F.col("title").alias("line"), "level")).select("doc_id", "pos", "path")
    return every.join(paths, ["doc_id", "pos"], "left").select("doc_id", "section_no", "title", "path", "content")


def section_chunks(docs: DataFrame, kind: str = "default") -> DataFrame:
    """(doc_id, section_no, title, path, chunk_index, text, token_count): each section of documents (doc_id, doc_type, text)
    packed by itself under a type's limits; chunks are numbered through the document, and no chunk spans two sections."""
    target, least, most = tx.STRATEGIES[kind]
    target = target or most
    parts = F.filter(tx.sentences(F.col("content")), lambda s: F.length(F.trim(s)) > 0)
    raw = pack(structured(docs), parts, target, most, int(0.1 * target))
    cleaned = raw.withColumn("text", tx.clean(F.col("raw"))).where(tx.token_count(F.col("text")) >= least)
    w = Window.partitionBy("doc_id").orderBy("section_no", "i")
    return cleaned.select("doc_id", "section_no", "title", "path", (F.row_number().over(w) - 1).alias("chunk_index"), "text", tx.token_count(F.col("text")).alias("token_count"))
