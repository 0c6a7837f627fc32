"""Shared pieces of the training-data operators: columnar word hashing, connected components, worker memory."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import saved, set_checkpoints

__all__ = ["as_row", "buffers", "connected_components", "lean", "local_components", "mix", "ragged", "saved", "set_checkpoints", "slices", "table", "trim", "word_hashes"]

SLICE_BYTES = 1 << 20
_BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _powers(base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(_BLOCK + 1, base, np.uint64)
        out[0] = 1
        return np.cumprod(out)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


@functools.cache
def _libc() -> ctypes.CDLL | None:
    """The C library, told to map arrays above 256 KB on their own, which it otherwise does less with use."""
    try:
        library = ctypes.CDLL(None)
        library.mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD
        library.malloc_trim
        return library
    except (OSError, AttributeError):  # not glibc
        return None


def trim() -> None:
    """Give freed memory back to the system."""
    if library := _libc():
        pa.default_memory_pool().release_unused()
        library.malloc_trim(0)


def lean(run: Callable) -> Callable:
    """A batch function after each of whose batches freed memory is given back: workers are reused by later stages,
    which must not find what earlier ones left."""

    def own(batches: Iterator) -> Iterator:
        trim()
        for out in run(batches):
            yield out
            trim()

    return own


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; nulls count as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes, or of one longer row."""
    offsets = buffers(column)[1]
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to
        at = to


def _long_hash(raw: np.ndarray) -> int:
    """Hash of one word of any length, a block at a time."""
    total, power = 0, 1
    with np.errstate(over="ignore"):
        for at in range(0, len(raw), _BLOCK):
            part = raw[at : at + _BLOCK]
            total = (total + int((_VALUE[part] * _UP[: len(part)]).sum(dtype=np.uint64)) * power) & _M64
            power = power * pow(_BASE, _BLOCK, 1 << 64) & _M64
    return total


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of every text, in order, and row offsets into them.

    A word is a maximal run of ASCII letters, digits and bytes above 127, in lower case. It is
    found and hashed by array operations over the column's UTF-8 buffer, without a Python string.
    """
    raw, offsets = buffers(pc.utf8_lower(pc.fill_null(column, "")))
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = _WORD[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < n]
    first[edge] = inside[edge]
    last = np.empty(n, bool)
    last[:-1] = inside[:-1] & (~inside[1:])
    last[-1] = inside[-1]
    before = edge[edge > 0] - 1
    last[before] = inside[before]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    found, at = np.empty(len(start), np.uint64), 0
    with np.errstate(over="ignore"):
        while at < len(start):  # whole words, about a block of bytes at a time
            base = start[at]
            to = int(np.searchsorted(end, base + _BLOCK, "right"))
            if to == at:
                found[at] = _long_hash(raw[base : end[at]])
                at += 1
                continue
            size = int(end[to - 1] - base)
            total = np.zeros(size + 1, np.uint64)
            np.cumsum(_VALUE[raw[base : base + size]] * _UP[:size], out=total[1:])
            found[at:to] = (total[end[at:to] - base] - total[start[at:to] - base]) * _DOWN[start[at:to] - base]
            at = to
        found = mix(found)
    return found, np.searchsorted(start, offsets)


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .. for each length, concatenated."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int64) - np.repeat(ends - lengths, lengths)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of the component of each of n nodes, by hooking and pointer jumping."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges (a, b); the component is its least id.

    Alternates large-star and small-star steps, which keep the number of edges bounded and end after
    about log^2 rounds whatever the diameter. Each round is checkpointed. Self-loops are allowed;
    an empty table gives an empty table; repeated edges do no harm.
    """
    both = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    nodes = saved(both.distinct())
    current, before = nodes.where("a <> b"), None
    while True:
        # large star: larger neighbours of every node point at the least of its neighbourhood
        mirrored = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = mirrored.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = mirrored.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours, and the node itself, point at the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        current = saved(small)
        state = current.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
        if before == (state["n"], state["s"]):
            break
        before = (state["n"], state["s"])
    ids = nodes.select(F.col("a").alias("id")).union(nodes.select(F.col("b").alias("id"))).distinct()
    roots = current.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return ids.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def as_row(df: DataFrame) -> DataFrame:
    """df as one struct column `row`, beside which names of our own can't clash with df's; select("row.*") undoes it."""
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("row"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
