"""Column expressions over arrays of numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .memory import trim

#: rows and bytes counted at a time
ROWS, BYTES = 1024, 1 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def hashed_terms(terms: Column, size: int = 256) -> Column:
    """Term counts in `size` hash buckets: the built-in encoder where no model is at hand."""
    return _counted(F.transform(terms, lambda t: F.pmod(F.xxhash64(t), F.lit(size)).cast("int")), F.lit(size))


def text_vector(text: Column) -> Column:
    """The built-in encoder of a text: its lexical terms, hashed."""
    return hashed_terms(F.regexp_extract_all(F.lower(text), F.lit("\\p{L}{2,}"), 0))


def _lists(rows: np.ndarray, given: pa.Array, kind: pa.DataType) -> pa.Array:
    """rows as lists, null where the given value is."""
    held = given.is_valid().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(held * rows.shape[1])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows[held].ravel(), kind), mask=pa.array(~held))


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _counted(buckets: pa.Array, size: pa.Array) -> pa.Array:
    n = size[0].as_py() if len(size) else 1
    out = np.zeros((len(buckets), n), np.float32)
    for at in range(0, len(buckets), ROWS):
        some = buckets.slice(at, ROWS)
        owner = np.repeat(np.arange(len(some)), some.value_lengths().fill_null(0).to_numpy())
        out[at : at + ROWS] = np.bincount(owner * n + some.flatten().to_numpy(), minlength=len(some) * n).reshape(-1, n)
    made = _lists(out, buckets, pa.float32())
    trim()
    return made


_LETTER = np.full(256, 26, np.uint8)
_LETTER[97:123] = np.arange(26)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def counted_letters(low: pa.Array) -> pa.Array:
    """How often each of a to z occurs in a lower-case text; null for null."""
    ends = np.frombuffer(low.buffers()[1], np.int32)[low.offset : low.offset + len(low) + 1].astype(np.int64) if len(low) else np.zeros(1, np.int64)
    data = np.frombuffer(low.buffers()[2] or b"", np.uint8)
    out, first = np.zeros((len(low), 26)), 0
    while first < len(low):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + BYTES, "right")) - 1)
        owner = np.repeat(np.arange(last - first), np.diff(ends[first : last + 1]))
        out[first:last] = np.bincount(owner * 27 + _LETTER[data[ends[first] : ends[last]]], minlength=(last - first) * 27).reshape(-1, 27)[:, :26]
        first = last
    made = _lists(out, low, pa.float64())
    trim()
    return made
