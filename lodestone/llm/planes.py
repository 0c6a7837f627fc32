"""Operator 8: near-duplicate embeddings by random hyperplanes.

Each of several tables signs every vector against its own random hyperplanes; vectors that share a
table's whole code meet. A table's row carries its vector in 8 bits an element with the length of the rounding
error, which bounds every cosine from both sides: pairs surely at or above the threshold are edges, and those
that the bounds leave open are sent back as pairs of ids, once each, and verified on the whole vectors. The
edges go to distributed connected components. Code length grows with log2 of the number of vectors, so
that a bucket holds about as many unrelated vectors at every size, and the number of tables is what
the wanted recall at the threshold then needs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, lean, local_components, mix, saved

THRESHOLD = 0.9
_BLOCK = 2048
_PART_ROWS = 1 << 18


def layout(n: int, threshold: float = THRESHOLD, recall: float = 0.95) -> tuple[int, int]:
    """Hyperplanes per table and tables, for n vectors and a recall at the threshold."""
    bits = min(60, max(6, math.ceil(math.log2(max(n, 2))) - 3))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def usable(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): one finite nonzero vector for each id, scaled to length 1.

    Left out are a null id, a null or empty vector, one with a null, NaN or infinite element, and the
    zero vector. Of several rows with one id the vector that sorts first counts.
    """
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    good = (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    one = df.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & good)
    return one.groupBy("id").agg(F.min("v").alias("v")).withColumn("_n", norm).where((F.col("_n") > 0) & (F.col("_n") < float("inf"))).select("id", F.transform("v", lambda x: x / F.col("_n")).alias("v"))


def _codes(bits: int, tables: int, parts: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(), batch.column(1)
            lengths = np.diff(vectors.offsets.to_numpy())
            flat, offsets = vectors.values.to_numpy(), vectors.offsets.to_numpy()
            for d in np.unique(lengths):
                own = np.flatnonzero(lengths == d)
                x = flat[offsets[own][:, None] + np.arange(d)]
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, int(d)]).standard_normal((d, tables * bits))
                sign = (x @ planes[d] > 0).reshape(len(own), tables, bits)
                code = (sign.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
                scale = np.abs(x).max(axis=1) / 127
                small = np.rint(x / scale[:, None]).astype(np.int8)
                error = np.linalg.norm(x - small * scale[:, None], axis=1)
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(int(d)), len(own), [None, pa.py_buffer(np.ascontiguousarray(small))]).cast(pa.binary())
                for t in range(tables):
                    key = mix(code[:, t] + np.uint64(int(d) << 44)) ^ mix(np.uint64([t + 1]))
                    yield pa.record_batch({"part": pa.array((mix(key) % np.uint64(parts)).astype(np.int32)), "key": pa.array(key.view(np.int64)), "id": pa.array(ids[own]), "v": packed, "scale": pa.array(scale), "error": pa.array(error)})

    return lean(run)


def bounded(small: np.ndarray, scale: np.ndarray, error: np.ndarray, threshold: float, at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows at..to against all rows: the pairs (as matrices) surely at or above the threshold, and those that may be."""
    x = small.astype(np.float32) * scale[:, None].astype(np.float32)
    cosine = (x[at:to] @ x.T).astype(np.float64)
    off = error[at:to, None] * (1 + error[None]) + error[None] + 1e-5  # both roundings, and that of the product
    return cosine - off >= threshold, cosine + off >= threshold


def _verify(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        key, ids, scale, error = (table[c].to_numpy() for c in ("key", "id", "scale", "error"))
        order = np.lexsort((ids, key))
        key, ids, scale, error = key[order], ids[order], scale[order], error[order]
        held = table["v"].take(pa.array(order)).to_pylist()
        known, code = np.unique(ids, return_inverse=True)
        firsts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(firsts, len(key)))
        left, right, open_ = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
        for at, size in zip(firsts[sizes > 1], sizes[sizes > 1]):
            rows = held[at : at + size]
            lengths = np.array([len(r) for r in rows])
            for d in np.unique(lengths):
                own = np.flatnonzero(lengths == d)
                small, where = np.frombuffer(b"".join(rows[i] for i in own), np.int8).reshape(len(own), -1), code[at + own]
                for b in range(0, len(own), _BLOCK):
                    sure, maybe = bounded(small, scale[at + own], error[at + own], threshold, b, b + _BLOCK)
                    i, j = np.nonzero(maybe)
                    i, j, yes = i[i + b < j], j[i + b < j], sure[i, j][i + b < j]
                    left.append(where[i[yes] + b])
                    right.append(where[j[yes]])
                    open_.append(np.stack([where[i[~yes] + b], where[j[~yes]]], axis=1))
        low = local_components(len(known), np.concatenate(left), np.concatenate(right))
        member = np.flatnonzero(low != np.arange(len(known)))
        asked = np.unique(np.sort(np.concatenate(open_), axis=1), axis=0)
        asked = asked[low[asked[:, 0]] != low[asked[:, 1]]]  # within a component nothing depends on them
        return pa.table({"a": pa.array(np.append(known[member], known[asked[:, 0]])), "b": pa.array(np.append(known[low[member]], known[asked[:, 1]])), "sure": pa.array(np.arange(len(member) + len(asked)) < len(member))})

    return run


def near_vectors(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, recall: float = 0.95, seed: int = 7) -> DataFrame:
    """(id, group_id, size, kept) for every usable vector.

    group_id is the least id that a chain of near pairs leads to, size the number of members, kept true
    for the group's least id. Vectors of different lengths are never near. Equal vectors are grouped
    before the search, so any number of exact copies costs one. Unusable rows (see usable) have no row.
    """
    vectors = saved(usable(df, id_column, vector))
    same = vectors.groupBy("v").agg(F.min("id").alias("b"))
    copies = vectors.join(same.hint("shuffle_hash"), "v").where("id <> b").select(F.col("id").alias("a"), "b")
    distinct = same.select(F.col("b").alias("id"), "v")
    n = distinct.count()
    bits, tables = layout(n, threshold, recall)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n * tables / _PART_ROWS))
    met = saved(distinct.mapInArrow(_codes(bits, tables, parts, seed), "part int, key long, id long, v binary, scale double, error double").groupBy("part").applyInArrow(_verify(threshold), "a long, b long, sure boolean"))
    held = lambda c: distinct.select(F.col("id").alias(c), F.col("v").alias(f"v{c}"))
    cosine = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    checked = met.where("NOT sure").select("a", "b").distinct().join(held("a"), "a").join(held("b"), "b").where(cosine >= threshold).select("a", "b")
    groups = connected_components(copies.union(met.where("sure").select("a", "b")).union(checked))
    named = vectors.select("id").join(groups, "id", "left").select("id", F.coalesce("component", "id").alias("group_id"))
    size = named.groupBy("group_id").agg(F.count("*").alias("size"))
    return named.join(size, "group_id").select("id", "group_id", "size", (F.col("id") == F.col("group_id")).alias("kept"))
