"""Operator 3: exact top-k search with a KD-tree for each shard.

All vectors are put into shards by the leaves of a top tree of median splits, whose cuts come from a bounded
sample and bear on speed alone. Each shard builds a KD-tree: median splits on the widest dimension, and a tight
bounding box at every node. A query descends a tree best first: a queue holds nodes by the distance of their
boxes to the query, opens the nearest, and ends where that bound exceeds the query's kth distance so far.

The queries are a stated set, the vectors whose id is divisible by `every`, searched against all vectors. A
query starts in its own shard. Queries of neighbouring shards then form blocks; a block visits groups of the
shards whose boxes are closer than its worst kth distance, nearest shard first, and each visit starts from the kth
distances that those before left. A task holds one block and a few shards, whatever the number of
vectors. In many dimensions without clusters boxes prune little, and a block visits nearly every shard.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

K = 10
EVERY = 100
LEAF = 256
SHARD = 8192
_BLOCK = 1024
_VISITS = 8
_SAMPLE = 20_000
_SLACK = 1e-9


@dataclass
class Tree:
    """Vectors in leaf order and the nodes: boxes, children (-1 for leaves) and ranges of rows."""

    x: np.ndarray
    ids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    children: np.ndarray
    rows: np.ndarray


def build(x: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> Tree:
    """Split at the median of the widest dimension down to `leaf` vectors, or to equal ones."""
    order, todo = np.arange(len(x)), [(0, len(x), -1)]
    low, high, children, rows = [], [], [], []
    while todo:
        at, to, parent = todo.pop()
        own = x[order[at:to]]
        node = len(rows)
        if parent >= 0:
            children[parent].append(node)
        low.append(own.min(axis=0))
        high.append(own.max(axis=0))
        rows.append((at, to))
        children.append([])
        wide = int(np.argmax(high[-1] - low[-1]))
        if to - at > leaf and high[-1][wide] > low[-1][wide]:
            half = (to - at) // 2
            order[at:to] = order[at:to][np.argpartition(own[:, wide], half)]
            todo += [(at + half, to, node), (at, at + half, node)]
    return Tree(x[order], ids[order], np.array(low), np.array(high), np.array([c or [-1, -1] for c in children]), np.array(rows))


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance from a point to each box."""
    return (np.maximum(np.maximum(low - q, q - high), 0) ** 2).sum(axis=-1)


class Best:
    """A query's k nearest so far, sorted by (distance, id); `bound` is a kth distance known from elsewhere."""

    def __init__(self, k: int, bound: float = math.inf) -> None:
        self.k, self.bound, self.distance, self.ids = k, bound, np.zeros(0), np.zeros(0, np.int64)

    def kth(self) -> float:
        return min(self.bound, self.distance[-1]) if len(self.distance) == self.k else self.bound

    def offer(self, distance: np.ndarray, ids: np.ndarray) -> None:
        d, i = np.concatenate([self.distance, distance]), np.concatenate([self.ids, ids])
        order = np.lexsort((i, d))[: self.k]
        self.distance, self.ids = d[order], i[order]


def search(tree: Tree, q: np.ndarray, q_id: int, best: Best) -> int:
    """Offer the tree's vectors to best, but the query itself, by best-first traversal; the number of leaves read."""
    reach = lambda d: d <= best.kth() * (1 + 1e-12) + _SLACK
    queue, read = [(float(box_distance(q, tree.low[0], tree.high[0])), 0)], 0
    while queue:
        bound, node = heapq.heappop(queue)
        if not reach(bound):
            break
        pair = tree.children[node]
        if pair[0] >= 0:
            for d, child in zip(box_distance(q, tree.low[pair], tree.high[pair]).tolist(), pair.tolist()):
                if reach(d):
                    heapq.heappush(queue, (d, child))
            continue
        at, to = tree.rows[node]
        read += 1
        d, ids = ((tree.x[at:to] - q) ** 2).sum(axis=1), tree.ids[at:to]
        near = np.flatnonzero((d <= best.kth()) & (ids != q_id))
        if len(near):
            best.offer(d[near], ids[near])
    return read


def top_tree(sample: np.ndarray, shards: int) -> list[tuple[int, float]]:
    """Median splits of the space into about `shards` cells, as a heap of (dimension, cut)."""
    depth = max(0, math.ceil(math.log2(max(shards, 1))))
    out, cells = [], [sample]
    for _ in range(depth):
        grown = []
        for own in cells:
            d = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if len(own) else 0
            cut = float(np.median(own[:, d])) if len(own) else 0.0
            out.append((d, cut))
            grown += [own[own[:, d] < cut], own[own[:, d] >= cut]]
        cells = grown
    return out


def _assign(tree: list[tuple[int, float]]):
    dims, cuts = np.array([d for d, _ in tree], int), np.array([c for _, c in tree])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.stack(f["v"].to_numpy()) if len(f) else np.zeros((0, 1))
            at = np.zeros(len(f), int)
            while len(dims) and len(at) and at[0] < len(dims):
                at = 2 * at + 1 + (x[np.arange(len(x)), dims[at]] >= cuts[at])
            yield pd.DataFrame({"id": f["id"], "v": f["v"], "cell": at})

    return run


_PACKED = "shard long, cell long, piece long, ids binary, x binary, low array<double>, high array<double>"


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard as one row: ids, vectors and box."""
    pdf = pdf.sort_values("id")
    x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
    first = pdf.iloc[0]
    return pd.DataFrame({"shard": [int(first["shard"])], "cell": [int(first["cell"])], "piece": [int(first["piece"])], "ids": [pdf["id"].to_numpy().astype(np.int64).tobytes()], "x": [x.tobytes()], "low": [x.min(axis=0)], "high": [x.max(axis=0)]})


def _arrays(ids: bytes, x: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(x, np.float64).reshape(len(i), -1)


_BLOCKS = "cells long, piece long, homes binary, q_ids binary, q binary, bound binary, low array<double>, high array<double>, worst double"
_HOMES = _BLOCKS + ", hits array<struct<query_id:long,neighbor_id:long,d2:double>>"


def _block(homes: np.ndarray, ids: np.ndarray, x: np.ndarray, bound: np.ndarray) -> dict:
    return {"homes": [homes.tobytes()], "q_ids": [ids.tobytes()], "q": [x.tobytes()], "bound": [bound.tobytes()], "low": [x.min(axis=0)], "high": [x.max(axis=0)], "worst": [float(bound.max())]}


def _hits(q_ids: np.ndarray, found: list[Best]) -> list[tuple]:
    return [(int(q), int(i), float(d)) for q, b in zip(q_ids, found) for i, d in zip(b.ids, b.distance)]


def _home(k: int, every: int, per: int):
    """Each shard's own queries searched in it: their kth distances, and what was found."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.to_dict("records"):
                ids, x = _arrays(r["ids"], r["x"])
                asked = np.flatnonzero(ids % every == 0)
                if not len(asked):
                    continue
                tree, found = build(x, ids), [Best(k) for _ in asked]
                for i, b in zip(asked, found):
                    search(tree, x[i], ids[i], b)
                bound = np.array([b.kth() for b in found])
                own = _block(np.full(len(asked), r["shard"]), ids[asked], x[asked], bound)
                yield pd.DataFrame({"cells": [r["cell"] // per], "piece": [r["piece"]], **own, "hits": [_hits(ids[asked], found)]})

    return run


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """The queries of some neighbouring shards as one block."""
    pdf = pdf.sort_values("homes")
    parts = [_arrays(a, b) for a, b in zip(pdf["q_ids"], pdf["q"])]
    homes, bound = np.concatenate([np.frombuffer(h, np.int64) for h in pdf["homes"]]), np.concatenate([np.frombuffer(b) for b in pdf["bound"]])
    own = _block(homes, np.concatenate([i for i, _ in parts]), np.concatenate([x for _, x in parts]), bound)
    return pd.DataFrame({"cells": [int(pdf["cells"].iloc[0])], "piece": [int(pdf["piece"].iloc[0])], **own})


def _visit(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = pdf[pdf["role"] == 0].iloc[0]
        q_ids, q = _arrays(block["q_ids"], block["q"])
        homes, found = np.frombuffer(block["homes"], np.int64), [Best(k, b) for b in np.frombuffer(block["bound"])]
        middle = (q.min(axis=0) + q.max(axis=0)) / 2
        shards = [(r, *_arrays(r["ids"], r["x"])) for r in pdf[pdf["role"] == 1].to_dict("records")]
        for r, ids, x in sorted(shards, key=lambda s: (box_distance(middle, s[2].min(axis=0), s[2].max(axis=0)), s[0]["shard"])):
            tree = build(x, ids)
            for i in np.flatnonzero(homes != r["shard"]):
                search(tree, q[i], q_ids[i], found[i])
        return pd.DataFrame(_hits(q_ids, found), columns=["query_id", "neighbor_id", "d2"])

    return run


def usable(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    good = (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    one = df.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & good)
    return one.groupBy("id").agg(F.min("v").alias("v"))


def nearest(df: DataFrame, k: int = K, id_column: str = "vec_id", vector: str = "embedding", every: int = EVERY, shard: int = SHARD, seed: int = 3) -> DataFrame:
    """(query_id, neighbor_id, distance, rank): the k nearest others of each query, by Euclidean distance, then id.

    The queries are the vectors whose id is divisible by `every` (1: all); they are searched against all vectors.
    Left out are a null id and a null, empty or not finite vector; of rows that share an id the vector
    that sorts first counts. All vectors must then have one length. With k or fewer others all of them are
    returned; a single vector has none, and an empty table gives an empty table. Equal vectors are each
    other's neighbours at distance 0, and any number of them is split over shards. Other columns don't matter.
    """
    vectors = saved(usable(df, id_column, vector))
    facts = vectors.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("a"), F.max(F.size("v")).alias("b")).first()
    if facts["n"] and facts["a"] != facts["b"]:
        raise ValueError(f"vectors of {facts['a']} to {facts['b']} dimensions")
    n = facts["n"]
    rate = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, _SAMPLE / max(n, 1)))
    sample = vectors.where(rate).select("v").toPandas()["v"] if n > shard else []
    tree = top_tree(np.stack(list(sample)), math.ceil(n / shard)) if len(sample) else []
    celled = vectors.mapInPandas(_assign(tree), "id long, v array<double>, cell long")
    sizes = celled.groupBy("cell").agg(F.count("*").alias("m"))
    split = F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.ceil(F.col("m") / (2 * shard))))  # a cell with many more than its share, as of equal vectors
    placed = celled.join(sizes, "cell").withColumn("piece", split).withColumn("shard", F.xxhash64("cell", "piece"))
    packed = saved(placed.select("id", "v", "cell", "piece", "shard").groupBy("shard").applyInPandas(_pack, _PACKED))
    per = max(1, _BLOCK * every // (2 * shard))
    home = saved(packed.mapInPandas(_home(k, every, per), _HOMES))
    merged = saved(home.drop("hits").groupBy("cells", "piece").applyInPandas(_merge, _BLOCKS).withColumn("block", F.xxhash64("cells", "piece")))
    gap = F.aggregate(F.arrays_zip("a_low", "a_high", "low", "high"), F.lit(0.0), lambda s, z: s + F.pow(F.greatest(F.lit(0.0), z["low"] - z["a_high"], z["a_low"] - z["high"]), 2))
    asking = merged.select("block", F.col("low").alias("a_low"), F.col("high").alias("a_high"), "worst")
    groups = F.pmod(F.xxhash64("shard"), F.lit(max(1, math.ceil(n / shard / _VISITS))))
    pairs = asking.join(packed.select("shard", "low", "high"), gap <= F.col("worst") * (1 + 1e-12) + _SLACK).select("block", "shard", groups.alias("visit"))
    pairs = saved(pairs)
    none = lambda *names: [F.lit(None).cast("binary").alias(c) for c in names]
    left = pairs.select("block", "visit").distinct().join(merged, "block").select("block", "visit", F.lit(0).alias("role"), F.lit(0).cast("long").alias("shard"), "q_ids", "q", "homes", "bound", *none("ids", "x"))
    right = pairs.join(packed, "shard").select("block", "visit", F.lit(1).alias("role"), "shard", *none("q_ids", "q", "homes", "bound"), "ids", "x")
    away = left.union(right).groupBy("block", "visit").applyInPandas(_visit(k), "query_id long, neighbor_id long, d2 double")
    own = home.select(F.explode("hits").alias("h")).select("h.*")
    order = Window.partitionBy("query_id").orderBy("d2", "neighbor_id")
    ranked = own.union(away).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "neighbor_id", F.round(F.sqrt("d2"), 6).alias("distance"), "rank")


SQL = f"""
SELECT query_id, neighbor_id, round(sqrt(d2), 6) AS distance, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, neighbor_id) AS rank FROM (
    SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)) AS d2
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0))
WHERE rank <= {K}
"""
