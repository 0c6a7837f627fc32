"""Operator 10: mixing to target weights with soft domain membership.

A softmax classifier, trained in numpy on a bounded sample of the label table, gives every document
posteriors over the domains. Projected-gradient least squares then fits a nonnegative rate r for every
document so that the expected domain token totals, sum of tokens * posterior * rate, meet the targets.
A round is one distributed aggregation, whose result, one short vector, is all that the next one needs; rates
are replayed from the vectors of the last rounds, and written to the shared folder every few rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_row, buffers, lean, saved, slices, word_hashes

SAMPLE_ROWS = 4000
SAMPLE_CHARS = 1 << 26
DOMAINS = ("low", "high")
TARGETS = {"high": 0.95, "low": 0.05}
_HASHED = 1 << 14
_DENSE = 256 + 2
_FOLD = 6


@dataclass
class Softmax:
    hashed: np.ndarray  # _HASHED, k
    dense: np.ndarray  # _DENSE, k
    names: tuple[str, ...]


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, row offsets into them, and dense features: byte frequencies, distinct-word share, constant."""
    words, offsets = word_hashes(text)
    raw, edges = buffers(text)
    n = len(edges) - 1
    length, count = np.diff(edges), np.diff(offsets)
    row = np.repeat(np.arange(n, dtype=np.int64), length)
    freq = np.bincount(row * 256 + raw, minlength=n * 256).reshape(n, 256) / np.maximum(length, 1)[:, None]
    at = np.repeat(np.arange(n), count)
    order = np.lexsort((words, at))
    w = words[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (at[1:] != at[:-1])
    distinct = np.bincount(at[new], minlength=n) / np.maximum(count, 1)
    dense = np.concatenate([np.sqrt(freq), distinct[:, None], np.ones((n, 1))], axis=1)
    return (words % np.uint64(_HASHED)).astype(np.int32), offsets, dense


def posteriors(model: Softmax, ids: np.ndarray, offsets: np.ndarray, dense: np.ndarray) -> np.ndarray:
    n, k = len(offsets) - 1, len(model.names)
    count = np.diff(offsets)
    logits = dense @ model.dense
    some = np.flatnonzero(count > 0)
    if len(some):
        for j in range(k):
            logits[some, j] += np.add.reduceat(model.hashed[:, j][ids], offsets[some]) / np.sqrt(count[some])
    logits -= logits.max(axis=1, keepdims=True)
    e = np.exp(logits)
    return e / e.sum(axis=1, keepdims=True)


def _fit(ids: np.ndarray, offsets: np.ndarray, dense: np.ndarray, y: np.ndarray, names: tuple[str, ...], steps: int = 150, rate: float = 0.1, decay: float = 1e-3) -> Softmax:
    """Full-batch Adam on the log loss with weight decay."""
    k, n, count = len(names), len(y), np.diff(offsets)
    model = Softmax(np.zeros((_HASHED, k)), np.zeros((dense.shape[1], k)), names)
    row, hot = np.repeat(np.arange(n), count), np.eye(k)[y]
    memory = [[np.zeros_like(v), np.zeros_like(v)] for v in (model.hashed, model.dense)]
    for t in range(1, steps + 1):
        error = (posteriors(model, ids, offsets, dense) - hot) / n
        spread = (error / np.sqrt(np.maximum(count, 1))[:, None])[row]
        g_hashed = np.stack([np.bincount(ids, spread[:, j], minlength=_HASHED) for j in range(k)], axis=1)
        for value, grad, (m, v) in zip((model.hashed, model.dense), (g_hashed, dense.T @ error), memory):
            grad = grad + decay * value
            m += 0.1 * (grad - m)
            v += 0.01 * (grad**2 - v)
            value -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", names: tuple[str, ...] = DOMAINS, rows: int = SAMPLE_ROWS, seed: int = 13) -> Softmax | None:
    """Classifier for the label column, whose values index `names`; None without two classes.

    The sample holds about `rows` labelled documents, as even over classes as they allow, chosen by a
    hash of doc_id, and fewer where they would hold more than about SAMPLE_CHARS characters; of rows that share a
    doc_id the greatest text counts. The classes' prior odds in the labels are put back into the intercept.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).between(0, len(names) - 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("y"))
    lengths = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.length("text").cast("long")).alias("chars"))
    here = known.join(lengths, "doc_id")
    strata = here.groupBy("y").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).collect()
    size = {r["y"]: r["n"] for r in strata}
    if len(size) < 2:
        return None
    share, left = {}, rows
    for k, (y, n) in enumerate(sorted(size.items(), key=lambda x: x[1])):
        share[y] = min(n, left // (len(size) - k))
        left -= share[y]
    chars = sum(share[r["y"]] * r["chars"] / r["n"] for r in strata)
    share = {y: n * min(1.0, SAMPLE_CHARS / max(chars, 1)) for y, n in share.items()}
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = here.where(u < F.coalesce(*[F.when(F.col("y") == y, F.lit(share[y] / n)) for y, n in size.items()]))
    text = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(batch.column(2)):
                ids, offsets, dense = features(batch.column(2).slice(at, to - at))
                cells = [ids[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.record_batch([batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), pa.array(cells, pa.binary()), pa.array([d.tobytes() for d in dense], pa.binary())], ["doc_id", "y", "ids", "dense"])

    got = text.join(F.broadcast(chosen), F.col("_id") == chosen["doc_id"]).groupBy("doc_id", "y").agg(F.max("text").alias("text")).mapInArrow(lean(pack), "doc_id long, y int, ids binary, dense binary").toPandas().sort_values(["doc_id", "ids"], kind="stable")
    y = got["y"].to_numpy()
    if len(set(y)) < 2:
        return None
    ids = [np.frombuffer(x, np.int32) for x in got["ids"]]
    model = _fit(np.concatenate(ids), np.cumsum([0, *map(len, ids)]), np.stack([np.frombuffer(x) for x in got["dense"]]), y, names)
    drawn = np.bincount(y, minlength=len(names))
    for c in range(len(names)):
        model.dense[-1, c] += np.log(max(size.get(c, 0), 0.5) / max(drawn[c], 0.5))
    return model


def _scorer(model: Softmax, counts: bool = True):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(batch.column(1)):
                ids, offsets, dense = features(batch.column(1).slice(at, to - at))
                p = posteriors(model, ids, offsets, dense)
                yield pa.record_batch([batch.column(0).slice(at, to - at), pa.array(np.diff(offsets).astype(np.int64)), *(pa.array(p[:, j]) for j in range(p.shape[1]))], ["doc_id", "tokens", *(f"p{j}" for j in range(p.shape[1]))])

    return lean(run)


def scored(docs: DataFrame, model: Softmax) -> DataFrame:
    """(doc_id, tokens, p0, ..): words in the text and posteriors, one row for each doc_id.

    Repeated rows of one doc_id count once: the row with most tokens, then the largest posteriors.
    """
    k = len(model.names)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("tokens", T.LongType()), *[T.StructField(f"p{j}", T.DoubleType()) for j in range(k)]])
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scorer(model), schema)
    return rows.groupBy("doc_id").agg(F.max(F.struct("tokens", *[f"p{j}" for j in range(k)])).alias("s")).select("doc_id", "s.*")


def _onward(start: Column, steps: list[np.ndarray]) -> Column:
    """A document's rate after the given steps from `start`, from its posteriors."""
    r = start
    for c in steps:
        r = F.greatest(F.lit(0.0), r - sum((F.col(f"p{j}") * float(x) for j, x in enumerate(c)), F.lit(0.0)))
    return r


def solve(scores: DataFrame, targets: np.ndarray, tolerance: float = 1e-6) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """scores with the fitted column `rate`, the domain totals T that were asked for, and those reached.

    Rounds of r <- max(0, r - s P M^-1 (A r - T)): A has tokens * posterior, P posteriors, and M = A P' summed
    over the documents whose rate is not held at 0, which is k by k. This is projected gradient descent on the squared
    residual in the metric M^-1, where a document weighs as its tokens; as M follows the documents in
    play, the step s = 1 meets T at once where no more of them are clipped, and few rounds are needed where
    they are. s is halved until the residual falls. It ends when totals are within `tolerance` of T (as a share of
    all), or when no step lowers the residual any more: then T is out of reach of nonnegative rates, and the
    totals reached are returned beside it. T is `targets` (weights) times the largest total for which no
    domain needs more tokens than it has; a start at rates of 1 leads to rates near 1.
    """
    k = len(targets)
    p = [F.col(f"p{j}") for j in range(k)]

    def facts(rate: Column) -> tuple[np.ndarray, np.ndarray]:
        """Totals, and M of the documents in play, at these rates."""
        live = F.when(rate > 0, F.col("tokens")).otherwise(0)
        row = scores.agg(*[F.sum(F.col("tokens") * a * rate).alias(f"a{i}") for i, a in enumerate(p)], *[F.sum(live * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(k)]).first()
        return np.array([row[f"a{i}"] or 0.0 for i in range(k)]), np.array([[row[f"m{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)])

    scores = scores.withColumn("_r", F.lit(1.0))
    total, gram = facts(F.col("_r"))
    goal = targets * min((total[i] / targets[i] for i in range(k) if targets[i] > 0), default=0.0)
    size, steps, length = max(float(goal.sum()), 1.0), [], 1.0
    metric = np.linalg.pinv(gram, rcond=1e-12)
    loss = lambda x: float((x - goal) @ metric @ (x - goal))
    while np.abs(total - goal).max() > tolerance * size:
        step = length * (np.linalg.pinv(gram, rcond=1e-12) @ (total - goal))
        new, new_gram = facts(_onward(F.col("_r"), [*steps, step]))
        if loss(new) < loss(total) * (1 - 1e-3 * length):
            moved = np.abs(new - total).max()
            total, gram, length = new, new_gram, min(1.0, 2 * length)
            steps.append(step)
            if moved <= 1e-3 * tolerance * size:
                break
            if len(steps) == _FOLD:  # a long replay is folded into a written column
                scores, steps = saved(scores.withColumn("_r", _onward(F.col("_r"), steps))), []
        elif length < 1e-4:
            break
        else:
            length /= 2
    return scores.withColumn("rate", _onward(F.col("_r"), steps)).drop("_r"), goal, total


def mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, column: str = "quality", names: tuple[str, ...] = DOMAINS, seed: int = 17) -> DataFrame:
    """(doc_id, tokens, p_<domain> .., rate, copies) for every doc_id.

    targets gives each domain's wanted share of tokens (scaled to sum to 1; a domain not named gets 0).
    The total is the largest that repeats no domain. copies, rate rounded to a whole number up or down by
    a hash of doc_id so that its expectation is the rate, is how often the document is to be used. Without labels of two classes the posteriors
    are even and every rate is 1. A null or wordless text has no tokens and moves no total; it is rated
    like any other by its posteriors. Rows with a null doc_id have no row; other columns don't matter.
    """
    model = fit(docs, labels, column, names)
    if model is None:
        model = Softmax(np.zeros((_HASHED, len(names))), np.zeros((_DENSE, len(names))), names)
        rated = scored(docs, model).withColumn("rate", F.lit(1.0))
    else:
        weights = np.array([max(0.0, targets.get(n, 0.0)) for n in names])
        if weights.sum() <= 0:
            raise ValueError("targets name no domain with a positive weight")
        rated, _, _ = solve(saved(scored(docs, model)), weights / weights.sum())
    # floating-point noise alone must not drop or repeat a document
    near = F.when(F.abs(F.col("rate") - F.round("rate")) <= 1e-9, F.round("rate")).otherwise(F.col("rate"))
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rated.select("doc_id", "tokens", *[F.round(f"p{j}", 6).alias(f"p_{n}") for j, n in enumerate(names)], F.round("rate", 6).alias("rate"), F.floor(near + u).cast("int").alias("copies"))


def mix_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs with every row of a document as often as mixture() says, with all its columns, whatever these are named.

    Rows with a null doc_id stay once; null and empty texts are rated like others; repeated rows are each drawn as
    often as their doc_id; an empty table gives an empty table.
    """
    times = mixture(docs, labels, **options).where("copies <> 1").select(F.col("doc_id").alias("_id"), "copies")
    joined = as_row(docs).join(times, F.col("row.doc_id") == F.col("_id"), "left")
    return joined.where("coalesce(copies, 1) > 0").select("row", F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1))))).select("row.*")
