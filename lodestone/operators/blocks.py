"""Exact vector search and similar pairs by blocks of rows.

Few queries are sent to where the vectors lie. Otherwise vectors and queries are normalised once, packed a block to a row
and put into groups of at most GROUP bytes; a task holds one group of queries and one of vectors, and only the best or
the near leave it. A row is sent once for each group of the other side, not for each block. No pair of vectors is ever a
row. Products are taken in single precision, and what they leave open is counted in double.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import saved
from ..functions.memory import lean

ROWS = 2048
GROUP = 48 << 20
FEW = 4 << 20
#: sides of the products, and pairs of vectors gathered at a time
ASKED, SEEN, GATHERED = 512, 8192, 1 << 15
_PACKED = "ids binary, x binary, d int"


def _unit(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, unit vectors) of the rows (id, v), at most ROWS of one length at a time; a zero vector stays zero, null and empty ones are left out."""
    ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    lengths = vectors.value_lengths().fill_null(0).to_numpy()
    offsets, values = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[lengths > 0]):
        own = np.flatnonzero(lengths == d)
        for at in range(0, len(own), ROWS):
            some = own[at : at + ROWS]
            x = values[offsets[some][:, None] + np.arange(d)].astype(np.float64)
            size = np.linalg.norm(x, axis=1, keepdims=True)
            yield ids[some].astype(np.int64), np.divide(x, size, out=np.zeros_like(x), where=size > 0)


@lean
def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, x in _unit(batch):
            yield pa.record_batch([pa.array([ids.tobytes()]), pa.array([x.tobytes()]), pa.array([x.shape[1]], pa.int32())], ["ids", "x", "d"])


def _rows(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    return rows.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v"))


def packed(rows: DataFrame, id_column: str = "id", vector: str = "v") -> DataFrame:
    """Blocks (ids, x, d, part) of at most ROWS vectors, written to the shared folder."""
    some = _rows(rows, id_column, vector)
    n = some.count()
    spread = max(math.ceil(n / ROWS), min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / 256)), 1)
    return saved(some.repartition(spread, "id").mapInArrow(_pack, _PACKED).withColumn("part", F.spark_partition_id()))


def _extent(blocks: DataFrame) -> tuple[int, int]:
    """Bytes of the vectors, and the parts that hold some."""
    r = blocks.agg(F.coalesce(F.sum(F.octet_length("x")), F.lit(0)), F.coalesce(F.max("part") + 1, F.lit(1))).first()
    return r[0], r[1]


def _group(groups: int, parts: int) -> Column:
    return F.floor(F.col("part") * groups / parts).cast("int")


def _gathered(batches: Iterator[pa.RecordBatch], side: str) -> dict[int, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """(ids, vectors) by side by length of the blocks of a task."""
    held: dict[int, dict[int, tuple[list, list]]] = {}
    for batch in batches:
        ids, x, d, sides = (batch.column(batch.schema.get_field_index(c)) for c in ("ids", "x", "d", side))
        for i in range(batch.num_rows):
            own = held.setdefault(d[i].as_py(), {}).setdefault(sides[i].as_py(), ([], []))
            own[0].append(np.frombuffer(ids[i].as_buffer(), np.int64))
            own[1].append(np.frombuffer(x[i].as_buffer(), np.float64).reshape(-1, d[i].as_py()))
    return {d: {s: (np.concatenate(own[0]), np.concatenate(own[1])) for s, own in sides.items()} for d, sides in held.items()}


def _slack(d: int) -> float:
    """More than the error of a single-precision product of unit vectors and of a rounding to nine digits."""
    return 1e-6 + d * 1.2e-7


def _exact(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of the unit vectors q[i] and x[j], at nine digits."""
    if len(i) * 16 > len(q) * len(x):
        return np.round((q @ x.T)[i, j], 9)
    parts = [np.einsum("ij,ij->i", q[i[at : at + GATHERED]], x[j[at : at + GATHERED]]) for at in range(0, len(i), GATHERED)]
    return np.round(np.concatenate(parts), 9) if parts else np.zeros(0)


class Kept:
    """The k best (id, score) of each of n rows, ties by id."""

    def __init__(self, n: int, k: int, kind=np.int64):
        self.ids, self.scores = np.zeros((n, k), kind), np.full((n, k), -np.inf)

    def add(self, i: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Offer row i[m] ids[m] at scores[m]."""
        last, k = self.scores[i, -1], self.scores.shape[1]
        better = (scores > last) | ((scores == last) & (ids < self.ids[i, -1]))
        rows, at = np.unique(i[better], return_inverse=True)
        if ids.dtype != self.ids.dtype:  # longer strings
            self.ids = self.ids.astype(np.promote_types(ids.dtype, self.ids.dtype))
        all_ids = np.concatenate([self.ids[rows].ravel(), ids[better]])
        all_scores = np.concatenate([self.scores[rows].ravel(), scores[better]])
        owner = np.concatenate([np.repeat(np.arange(len(rows)), k), at])
        order = np.lexsort((all_ids, -all_scores, owner))
        first = np.searchsorted(owner[order], np.arange(len(rows)))
        best = order[first[:, None] + np.arange(k)]
        self.ids[rows], self.scores[rows] = all_ids[best], all_scores[best]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, r = np.nonzero(self.scores > -np.inf)
        return i, self.ids[i, r], self.scores[i, r]


class Best:
    """The k best of all vectors shown so far for each query."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, k: int):
        self.q_ids, self.q, self.q32, self.k, self.slack, self.kept = q_ids, q, q.astype(np.float32), k, _slack(q.shape[1]), Kept(len(q), k)

    def see(self, ids: np.ndarray, x: np.ndarray) -> None:
        x32 = x.astype(np.float32)
        for at in range(0, len(self.q), ASKED):
            for start in range(0, len(x), SEEN):
                self._meet(at, ids[start : start + SEEN], x[start : start + SEEN], x32[start : start + SEEN])

    def _meet(self, at: int, ids: np.ndarray, x: np.ndarray, x32: np.ndarray) -> None:
        near = self.q32[at : at + ASKED] @ x32.T
        least = self.kept.scores[at : at + ASKED, -1] - self.slack
        if len(x) > self.k and np.isneginf(least).any():
            least = np.maximum(least, np.partition(near, len(x) - self.k, axis=1)[:, len(x) - self.k] - self.slack)
        i, j = np.nonzero(near >= least.astype(np.float32)[:, None])
        if len(i):
            self.kept.add(i + at, ids[j], _exact(self.q[at : at + ASKED], x, i, j))

    def rows(self) -> pa.RecordBatch:
        i, ids, scores = self.kept.rows()
        return pa.record_batch([pa.array(self.q_ids[i]), pa.array(ids), pa.array(scores)], ["query_id", "id", "score"])


def top(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): for each query the k best of every split or group of vectors by cosine, ties by id.

    vectors is (id, v), queries (query_id, v). Each query's k best overall are among these rows.
    """
    asked = packed(queries, "query_id")
    size, parts = _extent(asked)
    out = "query_id long, id long, score double"
    if size <= FEW:
        few = {d: sides[0] for d, sides in _gathered(iter(asked.withColumn("side", F.lit(0)).toArrow().to_batches()), "side").items()}

        @lean
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = {d: Best(ids, q, k) for d, (ids, q) in few.items()}
            for batch in batches:
                for ids, x in _unit(batch):
                    if x.shape[1] in best:
                        best[x.shape[1]].see(ids, x)
            for b in best.values():
                yield b.rows()

        return _rows(vectors, "id", "v").mapInArrow(scan, out)

    @lean
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sides in _gathered(batches, "side").values():
            if len(sides) == 2:
                best = Best(*sides[0], k)
                best.see(*sides[1])
                yield best.rows()

    data = packed(vectors)
    bytes_, split = _extent(data)
    down = max(1, math.ceil(bytes_ / GROUP))
    across = min(parts, max(math.ceil(size / GROUP), math.ceil(2 * vectors.sparkSession.sparkContext.defaultParallelism / down)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = data.select("ids", "x", "d", F.lit(1).alias("side"), _group(down, split).alias("a"), each(across).alias("b"))
    right = asked.select("ids", "x", "d", F.lit(0).alias("side"), _group(across, parts).alias("b"), each(down).alias("a"))
    cells = left.unionByName(right).withColumn("cell", F.col("a") * across + F.col("b"))
    return cells.repartitionById(down * across, F.col("cell")).mapInArrow(meet, out)


def _near(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray] | None, threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs of one group and another, or within one."""
    (ids, x), (others, y) = left, right or left
    y32, least = y.astype(np.float32), np.float32(threshold - _slack(x.shape[1]))
    for at in range(0, len(x), ASKED):
        q = x[at : at + ASKED]
        q32 = q.astype(np.float32)
        for start in range(0 if right else at, len(y), SEEN):
            i, j = np.nonzero(q32 @ y32[start : start + SEEN].T >= least)
            a, b = ids[at + i], others[start + j]
            once = (a != b) if right else (a != b) & (start + j > at + i)
            i, j, a, b = i[once], j[once], a[once], b[once]
            s = _exact(q, y[start : start + SEEN], i, j)
            keep = s >= threshold
            yield pa.record_batch([pa.array(np.minimum(a, b)[keep]), pa.array(np.maximum(a, b)[keep]), pa.array(s[keep])], ["a", "b", "similarity"])


def pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) for all pairs a < b of (id, v) whose cosine, at 9 digits, is at or above the threshold."""
    blocks = packed(vectors)
    size, parts = _extent(blocks)
    n = max(math.ceil(size / GROUP), min(parts, math.ceil((4 * vectors.sparkSession.sparkContext.defaultParallelism) ** 0.5)))

    @lean
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sides in _gathered(batches, "side").values():
            if 0 in sides and 1 in sides:
                yield from _near(sides[0], sides[1], threshold)
            elif 2 in sides:
                yield from _near(sides[2], None, threshold)

    both = blocks.select("ids", "x", "d", _group(n, parts).alias("own"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
    cell = (low * n - F.floor(low * (low - 1) / 2) + high - low).cast("int")
    cells = both.select("ids", "x", "d", side.alias("side"), cell.alias("cell"))
    return cells.repartitionById(n * (n + 1) // 2, F.col("cell")).mapInArrow(meet, "a long, b long, similarity double")
