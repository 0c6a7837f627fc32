"""Operator 4: near-duplicate documents by SimHash, all pairs within the threshold by pigeonring filtering.

A document's signature has 256 bits, each the sign of the sum over its distinct words of a +1/-1 drawn
from the word's hash. Two documents are near copies when at most `most` bits differ. The bits are a ring of
m boxes. Of a pair within `most`, some box starts a chain that keeps every proportional budget: after i boxes at
most i / m of `most` bits differ (the pigeonring principle). So from each box in turn, values of that box within
most / m bits are looked up in a table of the box's values, and what is met goes on if the 64 bits from there on keep
their budget too; what is left is compared whole. No pair within the threshold is lost, at any number of documents.

Signatures are dealt into blocks, and each two blocks meet in one task, which holds no more than these two: a row
travels once for each block. Most pairs of unrelated signatures cost nothing and a few in a hundred a lookup: the work
grows as n^2 by a small constant.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, lean, local_components, mix, ragged, saved, slices, word_hashes

BITS = 256
MOST = 45
LEAST_WORDS = 8
_WIDTH = 16
_WORDS = BITS // 64
_BLOCK = 1 << 15
_BLOCK_ROWS = 1 << 19
_SPREAD = 8
_BRUTE = 1 << 20
_PAIRS = 1 << 19


def _signatures(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signatures, distinct words, and a hash of the word sequence, for each row."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(n), lengths)
    order = np.lexsort((words, row))
    kept = np.ones(len(words), bool)
    ordered = words[order]
    kept[1:] = (ordered[1:] != ordered[:-1]) | (row[1:] != row[:-1])
    words_, row_ = ordered[kept], row[kept]
    count = np.bincount(row_, minlength=n)
    ends = np.cumsum(count)
    out = np.zeros((n, BITS // 64), np.uint64)
    some = count > 0
    sums = np.zeros((n, 64), np.int32)
    with np.errstate(over="ignore"):
        for k in range(BITS // 64):
            drawn = mix(words_ + np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            sums[:] = 0
            at = 0
            while at < n:  # whole rows, about _BLOCK words at a time
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _BLOCK, "right")))
                low, high = (ends[at - 1] if at else 0), ends[to - 1]
                own = np.flatnonzero(some[at:to]) + at
                if len(own):
                    bits = np.unpackbits(drawn[low:high].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    sums[own] = np.add.reduceat(bits, ends[own] - count[own] - low, axis=0, dtype=np.int32)
                at = to
            out[:, k] = np.packbits(2 * sums > count[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        place = mix(np.arange(int(lengths.max()) if n else 0, dtype=np.uint64))
        at_word = np.arange(len(words)) - np.repeat(offsets[:-1], lengths)
        total = np.concatenate([[np.uint64(0)], np.cumsum(words * (place[at_word] | np.uint64(1)))])
        whole = mix(total[offsets[1:]] - total[offsets[:-1]])
    return out, count, whole


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, text = batch.column(0), batch.column(1)
        for at, to in slices(text):
            words, offsets = word_hashes(text.slice(at, to - at))
            found, count, whole = _signatures(words, offsets)
            short = count < LEAST_WORDS
            key = found.copy()
            key[short] = 0
            key[short, 0] = whole[short]
            yield pa.record_batch(
                {
                    "doc_id": ids.slice(at, to - at),
                    "signature": pa.FixedSizeBinaryArray.from_buffers(pa.binary(BITS // 8), to - at, [None, pa.py_buffer(np.ascontiguousarray(key))]).cast(pa.binary()),
                    "words": pa.array(count.astype(np.int32)),
                    "short": pa.array(short),
                    **{name: batch.column(name).slice(at, to - at) for name in batch.schema.names[2:]},
                }
            )


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, signature, words, short): one row for each row of docs with at least one word.

    words counts distinct words. A document with fewer than LEAST_WORDS of them is `short`: a signature
    of so few words says little, so it holds a hash of the word sequence instead and only equal
    sequences match. Null, empty and wordless texts have no row. A long `version`, where docs has one, passes through.
    """
    more = [c for c in docs.columns if c == "version"]
    schema = "doc_id long, signature binary, words int, short boolean" + ", version long" * len(more)
    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more).mapInArrow(lean(_sign), schema).where("words > 0")


def layout(n: int) -> tuple[int, int]:
    """Width of a box and number of blocks for n signatures: blocks have about _BLOCK_ROWS, or fewer so that many cores have work."""
    return _WIDTH, max(1, math.ceil(n / _BLOCK_ROWS), min(_SPREAD, math.ceil(n / _BLOCK)))


def cut(bits: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """Segment values along a ring; the bits that the segments leave over are one more column."""
    n, m = len(bits), BITS // width
    power = np.float64(2) ** np.arange(width)
    held = bits[:, order].astype(np.float64)
    rest = held[:, m * width :]
    return np.concatenate([(held[:, : m * width].reshape(n, m, width) @ power), (rest @ power[: rest.shape[1]])[:, None]], axis=1).astype(np.uint64)


def _segments(width: int, count: int, parts: int):
    """Signatures once for each of the `count` blocks they meet: in step k block x meets block k - x, and that block x.

    value names the two blocks, the lesser in its upper half; block is the row's own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bits = batch.column(0), batch.column(1)
            own = (mix(ids.to_numpy().astype(np.int64).view(np.uint64) + np.uint64(width)) % np.uint64(count)).astype(np.int64)
            for k in range(count):
                other = (k - own) % count
                value = np.minimum(own, other) << 32 | np.maximum(own, other)
                group = mix(value.view(np.uint64)) % np.uint64(parts)
                yield pa.record_batch({"part": pa.array(group.astype(np.int32)), "block": pa.array(own.astype(np.int32)), "value": pa.array(value), "doc_id": ids, "bits": bits})

    return lean(run)


def chain(boxes: np.ndarray, a: np.ndarray, b: np.ndarray, most: int, start: int = 0, slack: float = 1.0) -> np.ndarray:
    """Indices of the pairs (rows a, b of the boxes' values) that keep every prefix budget from box `start` on.

    After i of m boxes at most i / m * most * slack bits may differ, after all of them `most`. Each step looks only at
    the pairs that the steps before kept; the last is the full check.
    """
    m = boxes.shape[1]
    alive, total = np.arange(len(a)), np.zeros(len(a), np.int64)
    for step in range(1, m + 1):
        s = (start + step - 1) % m
        total = total + np.bitwise_count(boxes[a, s] ^ boxes[b, s])
        good = total * m <= step * most * (slack if step < m else 1)
        alive, total, a, b = alive[good], total[good], a[good], b[good]
    return alive


def _starts(words: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each box of the ring, its bits and the 64 bits of every signature from it on; the last box of a word has the bits left over."""
    for k in range(_WORDS):
        for at in range(0, 64 - width + 1, width):
            head = words[:, k] >> np.uint64(at) | words[:, (k + 1) % _WORDS] << np.uint64(64 - at) if at else words[:, k]
            yield (width if at + 2 * width <= 64 else 64 - at), head


def _near(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a row of `a` and one of `b` (rows of `words`) with at most `most` differing bits; a is b: of its rows.

    A pair may come more than once. Pairs are looked at _PAIRS at a time, or one row's at a time.
    """

    def whole(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, j = (i[i != j], j[i != j]) if a is b else (i, j)
        good = np.bitwise_count(words[i] ^ words[j]).sum(axis=1) <= most
        return i[good], j[good]

    if len(a) * len(b) <= _BRUTE:
        yield whole(np.repeat(a, len(b)), np.tile(b, len(a)))
        return
    per_word = 64 // width
    budget, ahead = most // (per_word * _WORDS), most // _WORDS
    for (bits, head_a), (_, head_b) in zip(_starts(words[a], width), _starts(words[b], width)):
        low = np.uint64((1 << bits) - 1)
        by_a, by_b = (np.argsort(h & low, kind="stable") for h in (head_a, head_b))
        head_a, head_b = head_a[by_a], head_b[by_b]
        value = (head_a & low).astype(np.int64)
        sizes = np.bincount((head_b & low).astype(np.int64), minlength=1 << bits)
        firsts = np.cumsum(sizes) - sizes
        left, right, held = [], [], 0
        for flips in range(min(budget, bits) + 1):
            for mask in itertools.combinations(range(bits), flips):
                sought = value ^ sum(1 << x for x in mask)
                size = sizes[sought]
                some = np.flatnonzero(size)
                size = size[some]
                ends = np.cumsum(size)
                shift, mine, at = firsts[sought[some]] - ends + size, head_a[some], 0
                while at < len(some):
                    done = ends[at - 1] if at else 0
                    to = len(some) if ends[-1] - done <= _PAIRS else max(at + 1, int(np.searchsorted(ends, done + _PAIRS, "right")))
                    part = size[at:to]
                    j = np.repeat(shift[at:to], part) + np.arange(done, ends[to - 1])
                    good = np.flatnonzero(np.bitwise_count(np.repeat(mine[at:to], part) ^ head_b[j]) <= ahead)
                    left.append(some[np.searchsorted(ends, good + done, "right")])
                    right.append(j[good])
                    held, at = held + len(good), to
                    if held > _PAIRS:
                        yield whole(a[by_a[np.concatenate(left)]], b[by_b[np.concatenate(right)]])
                        left, right, held = [], [], 0
        if held:
            yield whole(a[by_a[np.concatenate(left)]], b[by_b[np.concatenate(right)]])


def _meet(most: int, width: int = _WIDTH):
    def run(table: pa.Table) -> pa.Table:
        value, block, ids = (table[c].to_numpy() for c in ("value", "block", "doc_id"))
        packed = table["bits"].combine_chunks()
        packed = pa.concat_arrays(packed.chunks) if isinstance(packed, pa.ChunkedArray) else packed
        words = np.frombuffer(packed.buffers()[2] or b"", np.uint64)[packed.offset * _WORDS :][: len(packed) * _WORDS].reshape(-1, _WORDS)
        known, code = np.unique(ids, return_inverse=True)
        left, right, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for pair in np.unique(value):
            rows = np.flatnonzero(value == pair)
            a = rows[block[rows] == pair >> 32]
            b = a if pair >> 32 == pair & 0xFFFF_FFFF else rows[block[rows] != pair >> 32]
            for i, j in _near(words, a, b, most, width):
                left.append(code[i])
                right.append(code[j])
                held += len(i)
                if held > max(1 << 20, 2 * len(known)):  # links within a component say no more than its members
                    low = local_components(len(known), np.concatenate(left), np.concatenate(right))
                    left, right, held = [np.arange(len(known))], [low], len(known)
        low = local_components(len(known), np.concatenate(left), np.concatenate(right))
        member = np.flatnonzero(low != np.arange(len(known)))
        return pa.table({"a": pa.array(known[member]), "b": pa.array(known[low[member]])})

    return run


def _classes(signed: DataFrame, key: list[str], most: int, tied: bool) -> DataFrame:
    """(*key, first) for each text of signed (*key, signature, short): first is the least key of the text's near-copy group.

    Nodes are the different signatures, so that each text of a doc_id has its own links. tied: texts of one doc_id are linked.
    """
    signed = saved(signed.select(*key, "signature", "short").distinct())
    same = saved(signed.groupBy("signature", "short").agg(F.min(F.struct(*key)).alias("least")).withColumn("id", F.monotonically_increasing_id()))
    long = same.where("NOT short").select(F.col("id").alias("doc_id"), "signature")
    n = long.count()
    width, count = layout(n)
    parts = count * (count + 1) // 2
    edges = (
        long.mapInArrow(_segments(width, count, parts), "part int, block int, value long, doc_id long, bits binary")
        .repartition(parts, "part")
        .groupBy("part")
        .applyInArrow(_meet(most, width), "a long, b long")
    )
    if tied:
        own = signed.join(same, ["signature", "short"]).select("doc_id", "id")
        several = own.groupBy("doc_id").agg(F.min("id").alias("b"), F.max("id").alias("m")).where("b < m").select("doc_id", "b")
        edges = edges.union(own.join(several, "doc_id").where("id <> b").select(F.col("id").alias("a"), "b"))
    part = same.join(connected_components(edges), "id", "left").select("signature", "short", "least", F.coalesce("component", "id").alias("component"))
    first = part.groupBy("component").agg(F.min("least").alias("first"))
    return signed.join(part.join(first, "component").select("signature", "short", "first"), ["signature", "short"]).select(*key, "first")


def near_copies(docs: DataFrame, most: int = MOST) -> DataFrame:
    """(doc_id, group_id, kept) for every document with a word; docs needs doc_id and text.

    No near pair is left out; copies with equal signatures are linked by one of them. group_id is the least doc_id of the near-copy group (connected components of near pairs), kept is
    true for that document alone. Unrelated documents are groups of one. Rows with a null doc_id are
    ignored; null, empty and wordless texts are in no group and have no row; rows of one doc_id are one document,
    linked by each of its texts. Columns other than doc_id and text are ignored.
    """
    first = _classes(signatures(docs.drop("version")), ["doc_id"], most, True)
    return first.groupBy("doc_id").agg(F.min("first.doc_id").alias("group_id")).withColumn("kept", F.col("doc_id") == F.col("group_id"))


def drop_near_copies(docs: DataFrame, most: int = MOST) -> DataFrame:
    """One text of each near-copy group, with all columns of docs, whatever these are named: that of the least doc_id.

    Each text is linked for itself, so that of rows which share a doc_id but not a text those go that have a near copy
    with a lesser doc_id; among near texts of the least doc_id the least xxhash64(text) stays. Rows with a null doc_id, and null, empty and
    wordless texts, stay; rows with equal doc_id and text go or stay together; an empty table gives an empty table.
    """
    version = F.xxhash64(docs["text"].cast("string"))
    first = _classes(signatures(docs.withColumn("version", version)), ["doc_id", "version"], most, False)
    out = first.where("doc_id <> first.doc_id OR version <> first.version").select(F.col("doc_id").alias("_dropped"), F.col("version").alias("_version"))
    return docs.join(out, (docs["doc_id"] == out["_dropped"]) & (version == out["_version"]), "left_anti")
