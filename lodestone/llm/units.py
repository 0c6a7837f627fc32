"""Operator 5: substring dedup by hashing normalised lines and paragraphs.

A text is cut into units: at line ends and, for texts that hold much in one line, after sentence ends ('.', '!'
or '?' before white space) and before a capitalised word. From each unit on, as few units as make `least` words
are a paragraph, and so are as few as make `least` words before the text's end; a text of fewer words is one
paragraph. A paragraph's digest is 128 bits over its words in lower case without punctuation. Among
equal digests the occurrence that ranks first by (doc_id, offset) stays and the others are removed. So what goes
is always a passage of `least` words or more (or a whole text) that was seen before, and of a longer
passage pasted into other texts all goes but what is less than a paragraph at its edges.

The first occurrence of each digest is an aggregate that combines before its shuffle, and is joined back to
the occurrences; AQE splits the join where a digest is hot. No group is gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_row, buffers, lean, mix, slices, word_hashes

LEAST = 25
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True


def unit_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which a unit starts, sorted, for the concatenated texts."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    space, stop = _SPACE[raw], _STOP[raw]
    start = np.zeros(n + 1, bool)
    start[offsets[:-1]] = True
    line = raw == 10
    start[1:] |= line
    # after a stop and the white space that follows it
    run = np.flatnonzero(space & np.concatenate([[False], stop[:-1]]))
    if len(run):
        solid = np.flatnonzero(np.append(~space, True))
        start[solid[np.searchsorted(solid, run)]] = True
    capital = (raw >= 65) & (raw <= 90)
    latin = raw == 0xC3
    latin[:-1] &= (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    latin[-1] = False
    start[1:n] |= (capital | latin)[1:] & (raw[:-1] == 32)
    return np.flatnonzero(start[:n])


def _keys(text: pa.Array, least: int) -> dict[str, np.ndarray]:
    """Paragraphs (row, start, end, k1, k2) of one slice, in characters of the row's text."""
    raw, offsets = buffers(text)
    starts = unit_starts(raw, offsets)
    ends = np.append(starts[1:], len(raw))
    row = np.searchsorted(offsets, starts, "right") - 1
    words, _ = word_hashes(text)
    # word positions in the original bytes: a word starts where a word byte follows another byte
    inside = ((raw >= 48) & (raw <= 57)) | ((raw >= 65) & (raw <= 90)) | ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(raw)]
    first[edge] = inside[edge]
    at = np.flatnonzero(first)
    assert len(at) == len(words)
    low, high = np.searchsorted(at, starts), np.searchsorted(at, ends)
    has = high > low
    starts, ends, row, low, high = (x[has] for x in (starts, ends, row, low, high))
    count = np.cumsum((raw & 0xC0) != 0x80)
    chars = lambda b: np.where(b > 0, count[b - 1], 0)
    base = chars(offsets[row])
    start, end = chars(starts) - base, chars(ends) - base
    m = len(low)
    head = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if m else low
    tail = np.append(head[1:], m) - 1 if m else low
    last = np.minimum(np.searchsorted(high, low + least, "left"), m - 1)
    ahead = np.flatnonzero((high[last] - low >= least) & (row[last] == row)) if m else last
    whole = high[tail] - low[head] < least
    final = np.maximum(np.searchsorted(low, high[tail] - least, "right") - 1, 0)  # the last paragraph's first unit
    final = np.where(whole, head, final)
    extra = whole | (last[final] != tail) if m else whole
    a, b = np.concatenate([ahead, final[extra]]), np.concatenate([last[ahead], tail[extra]])
    out = []
    with np.errstate(over="ignore"):
        for base_ in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words), base_, np.uint64)]))
            down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words), pow(base_, -1, 1 << 64), np.uint64)]))
            total = np.concatenate([[np.uint64(0)], np.cumsum(words * up[:-1])])
            out.append(mix((total[high[b]] - total[low[a]]) * down[low[a]]).view(np.int64))
    return {"row": row[a], "start": start[a], "end": end[b], "k1": out[0], "k2": out[1]}


def _rows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, version, text = batch.columns
            for at, to in slices(text):
                x = _keys(text.slice(at, to - at), least)
                row = pa.array(x["row"] + at)
                yield pa.record_batch({"k1": pa.array(x["k1"]), "k2": pa.array(x["k2"]), "doc_id": ids.take(row), "version": version.take(row), "start": pa.array(x["start"].astype(np.int32)), "end": pa.array(x["end"].astype(np.int32))})

    return lean(run)


def paragraphs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(k1, k2, doc_id, version, start, end): the digest and place of every paragraph; rows with a null doc_id or text have none.

    version is xxhash64(text), so rows that share a doc_id but not a text are told apart.
    """
    keyed = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), F.col("text").cast("string").alias("text"))
    return keyed.mapInArrow(_rows(least), "k1 long, k2 long, doc_id long, version long, start int, end int")


def repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, version, start, end): the paragraphs to remove; start and end are offsets into the original text.

    All rows with the same doc_id and text are one document: repeated rows don't make each other's
    paragraphs repeats, and a paragraph that overlaps the occurrence that stays is left.
    """
    every = paragraphs(docs, least)
    first = every.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "version", "start", "end")).alias("f"), F.count("*").alias("n")).where("n > 1").select("k1", "k2", "f")
    after = "doc_id > f.doc_id OR (doc_id = f.doc_id AND (version > f.version OR (version = f.version AND start >= f.end)))"
    return every.join(first.hint("merge"), ["k1", "k2"]).where(after).select("doc_id", "version", "start", "end")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, text, spans) to (row, text, removed): spans that overlap or touch become one, and go."""
    for batch in batches:
        row, texts, spans = batch.columns
        kept, starts, ends, sizes = [], [], [], []
        for text, own in zip(texts.to_pylist(), spans.to_pylist()):
            at, parts, n = 0, [], 0
            for s in sorted((s["start"], s["end"]) for s in own or ()):
                if n and s[0] <= ends[-1]:
                    ends[-1] = max(ends[-1], s[1])
                else:
                    starts.append(s[0])
                    ends.append(s[1])
                    n += 1
            for a, b in zip(starts[len(starts) - n :], ends[len(ends) - n :]):
                parts.append(text[at:a])
                at = b
            kept.append(text if not n else "".join([*parts, text[at:]]))
            sizes.append(n)
        removed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["start", "end"]))
        yield pa.record_batch([row, pa.array(kept, pa.string()), removed], ["row", "text", "removed"])


def cut(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(row, text, removed) for every row of docs: row holds its columns, text what is left of its text.

    removed is array<struct<start,end>>, offsets in characters into the original text, in order and apart; it is
    empty where nothing went. Every row stays, also one whose text becomes empty. Rows that share doc_id and
    text are cut alike. A null doc_id or text is left as it is; an empty text, or one without words, has
    no paragraph; an empty table gives an empty table.
    """
    spans = repeats(docs, least).groupBy("doc_id", "version").agg(F.collect_set(F.struct("start", "end")).alias("_spans")).select(F.col("doc_id").alias("_doc"), F.col("version").alias("_version"), "_spans")
    text = F.col("row.text").cast("string")
    joined = as_row(docs).join(spans, (F.col("row.doc_id") == F.col("_doc")) & (F.xxhash64(F.col("row.text")) == F.col("_version")), "left").select("row", text.alias("text"), "_spans")
    schema = T.StructType([joined.schema["row"], T.StructField("text", T.StringType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
    return joined.mapInArrow(lean(_cut), schema)


def drop_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with text cut down to what was not seen earlier, and `removed`: array<struct<start,end>> (see cut()).

    Other columns pass through; one whose name is `removed` in any case is replaced.
    """
    done = cut(docs, least)
    return done.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c.lower() != "removed"], "removed")
