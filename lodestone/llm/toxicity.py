"""Operator 2: toxicity by a convolutional text classifier over hashed word embeddings.

Words are hashed twice into embedding tables whose rows add up, so a rare word that shares a bucket
with a telling one does so in one table only. Filters of widths 1, 2 and 3 run over the embeddings, the
maximum of each over the whole text is kept, and a logistic unit weighs the maxima. Training reads every labelled
document but those held out: they are dealt into lanes by a hash of doc_id, each epoch every lane trains in numpy from
the same weights, and the driver joins what the lanes learnt. A threshold is calibrated for each language on all
held-out documents. Training and scoring read whole texts on the executors.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_row, lean, saved, slices, trim, word_hashes

SAMPLE_ROWS = 8000
SAMPLE_CHARS = 1 << 26
EPOCHS = 12
LANES = 6
LANE_ROWS = 4000
FEW = 1 << 20
_LANE_WORDS = 1 << 22
_BUCKETS = 1 << 16
_DIM = 16
_FILTERS = 12
_WIDTHS = (1, 2, 3)
_PAD = max(_WIDTHS) - 1


def buckets(words: np.ndarray) -> np.ndarray:
    """The two buckets of each word; row 0 of both tables is the padding."""
    return np.stack([(words & np.uint64(0xFFFF_FFFF)) % np.uint64(_BUCKETS - 1), (words >> np.uint64(32)) % np.uint64(_BUCKETS - 1)]).astype(np.int32) + 1


@dataclass
class Model:
    """Weights, and thresholds by language; `None` holds the one for languages with too few examples."""

    tables: np.ndarray  # 2, buckets, dim
    filters: np.ndarray  # dim, sum of widths * filters
    bias: np.ndarray
    out: np.ndarray
    shift: float
    thresholds: dict = field(default_factory=lambda: {None: 0.5})


def _responses(x: np.ndarray, filters: np.ndarray) -> list[np.ndarray]:
    """For each width, the filters' response at every start; the last _PAD rows of x are padding."""
    n, at, out = len(x) - _PAD, 0, []
    for w in _WIDTHS:
        total = x[:n] @ filters[:, at : at + _FILTERS]
        for j in range(1, w):
            total += x[j : n + j] @ filters[:, at + j * _FILTERS : at + (j + 1) * _FILTERS]
        at += w * _FILTERS
        out.append(total)
    return out


def _padded(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket pairs with _PAD padding words after every text, where each text starts, and their lengths."""
    n = np.diff(offsets)
    starts = offsets[:-1] + _PAD * np.arange(len(n))
    out = np.zeros((2, len(words) + _PAD * len(n)), np.int32)
    place = np.arange(len(words)) + _PAD * np.repeat(np.arange(len(n)), n)
    out[:, place] = buckets(words)
    return out, starts, n


def score(model: Model, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of toxicity of each text; a text without words gets that of all maxima at zero."""
    pairs, starts, n = _padded(words, offsets)
    some = np.flatnonzero(n > 0)
    pooled = np.zeros((len(n), len(_WIDTHS) * _FILTERS), np.float32)
    if len(some):
        x = np.take(model.tables[0], pairs[0], axis=0) + np.take(model.tables[1], pairs[1], axis=0)
        ends = starts + n
        for k, y in enumerate(_responses(x, model.filters)):
            edges = np.stack([starts[some], ends[some]], axis=1).ravel()
            edges = edges[:-1] if edges[-1] >= len(y) else edges
            pooled[some, k * _FILTERS : (k + 1) * _FILTERS] = np.maximum.reduceat(y, edges, axis=0)[::2]
    hidden = np.maximum(pooled + model.bias, 0)
    hidden[n == 0] = 0
    return 1 / (1 + np.exp(-(hidden @ model.out + model.shift).astype(np.float64)))


def _pooled(responses: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts of at least one word, each filter's maximum over the text and the first place that has it."""
    best, where = [], []
    for y in responses:
        edges = np.stack([starts, ends], axis=1).ravel()
        edges = edges[:-1] if edges[-1] >= len(y) else edges
        most = np.maximum.reduceat(y, edges, axis=0)
        at = np.where(y == np.repeat(most, np.diff(np.append(edges, len(y))), axis=0), np.arange(len(y), dtype=np.int32)[:, None], np.int32(len(y)))
        best.append(most[::2])
        where.append(np.minimum.reduceat(at, edges, axis=0)[::2])
    return np.concatenate(best, axis=1), np.concatenate(where, axis=1)


@dataclass
class Weights:
    """What training moves: tables, filters, bias, out and shift, and Adagrad's sums of squares for each (one for a row of a table)."""

    values: list[np.ndarray]
    squares: list[np.ndarray]


def start(draw: np.random.Generator) -> Weights:
    size = sum(_WIDTHS) * _FILTERS
    tables = (draw.standard_normal((2, _BUCKETS, _DIM)) * 0.05).astype(np.float32)
    tables[:, 0] = 0
    filters = (draw.standard_normal((_DIM, size)) * 0.3).astype(np.float32)
    pooled_n = len(_WIDTHS) * _FILTERS
    values = [tables, filters, np.zeros(pooled_n, np.float32), (draw.standard_normal(pooled_n) * 0.3).astype(np.float32), np.zeros(1)]
    return Weights(values, [np.full((2, _BUCKETS), 1e-2, np.float32), *(np.full_like(v, 1e-2) for v in values[1:])])


def epoch(weights: Weights, texts: list[np.ndarray], labels: np.ndarray, draw: np.random.Generator, rate: float = 0.05) -> None:
    """Move the weights by Adagrad on the log loss, once over the texts; only the positions that win a maximum carry gradient."""
    (tables, filters, bias, out, shift), (g_tables, *_) = weights.values, weights.squares
    columns = np.arange(_FILTERS)
    first_column = np.cumsum([0, *(w * _FILTERS for w in _WIDTHS)])
    order = draw.permutation(len(texts))
    for b in range(0, len(order), 32):
        batch = order[b : b + 32]
        own = [texts[i] for i in batch if len(texts[i])]
        if not own:
            continue
        rows, cols, grads = [], [], []
        d_filters = np.zeros_like(filters)
        pairs, starts, lengths = _padded(np.concatenate(own), np.cumsum([0, *map(len, own)]))
        x = np.take(tables[0], pairs[0], axis=0) + np.take(tables[1], pairs[1], axis=0)
        best, where = _pooled(_responses(x, filters), starts, starts + lengths)
        hidden = np.maximum(best + bias, 0)
        error = (1 / (1 + np.exp(-np.clip(hidden @ out + shift, -30, 30))) - labels[[i for i in batch if len(texts[i])]]).astype(np.float32)
        d_out, d_shift = error @ hidden, float(error.sum())
        back = error[:, None] * out * (best + bias > 0)
        d_bias = back.sum(axis=0)
        for k, w in enumerate(_WIDTHS):
            part = slice(k * _FILTERS, (k + 1) * _FILTERS)
            for j in range(w):
                c = first_column[k] + j * _FILTERS + columns
                at = where[:, part] + j
                d_filters[:, c] += np.einsum("mfd,mf->df", x[at], back[:, part])
                rows.append(pairs[0][at].ravel())
                cols.append(pairs[1][at].ravel())
                grads.append((filters[:, c].T[None] * back[:, part, None]).reshape(-1, _DIM))
        n = len(batch)
        d = np.concatenate(grads) / n
        for t, ids in enumerate((np.concatenate(rows), np.concatenate(cols))):
            by = np.argsort(ids, kind="stable")
            begins = np.flatnonzero(np.append(True, np.diff(ids[by]) != 0))
            touched, total = ids[by][begins], np.add.reduceat(d[by], begins, axis=0)
            g_tables[t, touched] += (total**2).sum(axis=1)
            tables[t, touched] -= rate * total / np.sqrt(g_tables[t, touched])[:, None]
        tables[:, 0] = 0
        for value, grad, memory in zip(weights.values[1:], (d_filters, d_bias, d_out, np.array([d_shift])), weights.squares[1:]):
            grad = grad / n
            memory += grad**2
            value -= rate * grad / np.sqrt(memory)


def model_of(weights: Weights) -> Model:
    tables, filters, bias, out, shift = weights.values
    return Model(tables, filters, bias, out, float(shift[0]))


def train(texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.05, seed: int = 5) -> Model:
    """Fit to texts that are at hand."""
    draw = np.random.default_rng(seed)
    weights = start(draw)
    for _ in range(epochs):
        epoch(weights, texts, labels, draw, rate)
    return model_of(weights)


def _cut(s: np.ndarray, hits: np.ndarray, rows: np.ndarray) -> float:
    """best_threshold() of falling scores s, each with its numbers of toxic and of all rows."""
    f1 = 2 * np.cumsum(hits) / (np.cumsum(rows) + hits.sum())
    k = int(np.argmax(f1))
    return float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k] / 2)


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The cut with the highest F1, in the middle of the gap it falls in; the highest such cut on ties."""
    s, place, rows = np.unique(-scores, return_inverse=True, return_counts=True)
    return _cut(-s, np.bincount(place, labels), rows)


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic): the greatest label of every document."""
    return labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))


def labelled(docs: DataFrame, labels: DataFrame, few: bool = False) -> DataFrame:
    """(doc_id, lang, toxic, text): every labelled document that has a text; of what rows that share a doc_id say the greatest counts.

    few says that the labels' ids can be sent to every executor, so that only labelled texts are shuffled.
    """
    known = known_labels(labels)
    told = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"))
    return told.join(F.broadcast(known) if few else known, "doc_id").groupBy("doc_id", "toxic").agg(F.max("lang").alias("lang"), F.max("text").alias("text")).select("doc_id", "lang", "toxic", "text")


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 11) -> DataFrame:
    """(doc_id, lang, toxic, text): about `rows` labelled documents, as even over language and label as they allow.

    Fewer where they would hold more than about SAMPLE_CHARS characters. Of rows that share a doc_id the greatest
    (lang, text) counts. Of texts the driver sees the sample alone.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    told = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("lang").cast("string"), F.lit(""))).alias("lang"), F.max(F.length("text").cast("long")).alias("chars"))
    both = known.join(told, "doc_id").select("doc_id", "toxic", "lang", "chars")
    counted = both.groupBy("lang", "toxic").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).collect()
    strata = {(r["lang"], r["toxic"]): r["n"] for r in counted}
    if not strata:
        return both.join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id").select("doc_id", "lang", "toxic", "text")
    share, left, todo = {}, rows, sorted(strata.items(), key=lambda x: x[1])
    for k, (key, n) in enumerate(todo):
        share[key] = min(n, left // (len(todo) - k))
        left -= share[key]
    chars = sum(share[r["lang"], r["toxic"]] * r["chars"] / r["n"] for r in counted)
    share = {key: n * min(1.0, SAMPLE_CHARS / max(chars, 1)) for key, n in share.items()}
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    quota = F.coalesce(*[F.when((F.col("lang") == k[0]) & (F.col("toxic") == k[1]), F.lit(share[k] / n)) for k, n in strata.items()], F.lit(0.0))
    chosen = both.where(u < quota)
    text = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    found = text.where("text IS NOT NULL").join(F.broadcast(chosen), F.col("_id") == chosen["doc_id"])  # at most about SAMPLE_ROWS ids
    return found.groupBy("doc_id", "lang", "toxic").agg(F.max("text").alias("text"))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as the words' two buckets, 16 bits each."""
    for batch in batches:
        for at, to in slices(batch.column(3)):
            words, offsets = word_hashes(batch.column(3).slice(at, to - at))
            packed = (buckets(words) - 1).T.astype(np.uint16)
            cells = pa.array([packed[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())
            yield pa.record_batch([batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), batch.column(2).slice(at, to - at), cells], ["doc_id", "lang", "toxic", "words"])


def _words(cell: bytes) -> np.ndarray:
    """Words that have the buckets told."""
    pair = np.frombuffer(cell, np.uint16).reshape(-1, 2).astype(np.uint64)
    return pair[:, 0] | pair[:, 1] << np.uint64(32)


def _lane(shared, number: int):
    """One epoch over the rows (lane, toxic, words) of each lane, which lie together, LANE_ROWS at a time: (lane, rows, weights reached)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, own, draw, texts, y, held, rows = None, None, None, [], [], 0, 0
        weights = shared.value

        def learn() -> None:
            nonlocal texts, y, held, rows
            if texts:
                epoch(own, texts, np.array(y, np.float32), draw)
            rows += len(texts)
            texts, y, held = [], [], 0

        def reached() -> pa.RecordBatch:
            learn()
            touched = own.squares[0] != weights.squares[0]
            state = pickle.dumps((np.packbits(touched), own.values[0][touched], own.squares[0][touched], own.values[1:], own.squares[1:]), protocol=5)
            return pa.record_batch({"lane": pa.array([lane], pa.int32()), "rows": pa.array([rows], pa.int64()), "state": pa.array([state], pa.binary())})

        for batch in batches:
            for at, toxic, cell in zip(*(c.to_pylist() for c in batch.columns)):
                if at != lane:
                    if lane is not None:
                        yield reached()
                    lane, rows, draw = at, 0, np.random.default_rng([5, number, at])
                    own = Weights([v.copy() for v in weights.values], [v.copy() for v in weights.squares])
                texts.append(_words(cell))
                y.append(toxic)
                held += len(texts[-1])
                if len(texts) == LANE_ROWS or held > _LANE_WORDS:
                    learn()
        if lane is not None:
            yield reached()

    return lean(run)


def _joined(weights: Weights, lanes: pa.Table) -> Weights:
    """The weights moved by the sum of what the lanes moved them, and squares with all that they added; one lane is unpacked at a time.

    As Adagrad's steps shrink with the squares, of which a lane saw its own only, the sum is scaled by what the joined
    squares shrink a step by: near the place that one lane would reach that takes all the steps in turn.
    """
    moves, squares = ([np.zeros_like(v) for v in x] for x in (weights.values, weights.squares))
    share = np.zeros_like(weights.squares[0])
    for k in np.argsort(lanes["lane"].to_numpy(), kind="stable").tolist():
        packed, table, table_squares, rest, rest_squares = pickle.loads(lanes["state"][k].as_buffer())
        touched = np.unpackbits(packed, count=share.size).view(bool).reshape(share.shape)
        share[touched] += 1
        moves[0][touched] += table - weights.values[0][touched]
        squares[0][touched] += table_squares - weights.squares[0][touched]
        for total, own, before in zip(moves[1:] + squares[1:], rest + rest_squares, weights.values[1:] + weights.squares[1:]):
            total += own - before
        del packed, table, table_squares, rest, rest_squares, touched
    values = []
    for value, move, before, added, lanes_of in zip(weights.values, moves, weights.squares, squares, [np.maximum(share, 1), *[lanes.num_rows] * 4]):
        scale = np.sqrt((before + added / lanes_of) / (before + added))
        values.append((value + move * scale.reshape(scale.shape + (1,) * (move.ndim - scale.ndim))).astype(value.dtype))
    return Weights(values, [(v + d).astype(v.dtype) for v, d in zip(weights.squares, squares)])


def _held_scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                texts = [_words(c) for c in batch.column(2).slice(at, 64).to_pylist()]
                found = score(model, np.concatenate(texts), np.cumsum([0, *map(len, texts)]))
                yield pa.record_batch([batch.column(0).slice(at, 64), batch.column(1).slice(at, 64), pa.array(found)], ["lang", "toxic", "score"])

    return lean(run)


def _threshold(counts: pa.Table) -> pa.Table:
    """(lang, cut, toxic, clean) of the rows (lang, score, hits, rows) of one language, each score once."""
    score, hits, rows = (counts[c].to_numpy() for c in ("score", "hits", "rows"))
    order, toxic = np.argsort(-score), int(hits.sum())
    return pa.table({"lang": pa.array([counts["lang"][0].as_py()], pa.string()), "cut": pa.array([_cut(score[order], hits[order], rows[order])]), "toxic": pa.array([toxic], pa.int64()), "clean": pa.array([int(rows.sum()) - toxic], pa.int64())})


def fit(docs: DataFrame, labels: DataFrame, least: int = 8) -> Model | None:
    """Train on about seven tenths of all labelled documents and calibrate on all others; None without examples of both labels.

    A language with fewer than `least` held-out examples of either label uses the threshold of all. Training goes in at
    most LANES lanes, so that what the driver gathers in an epoch doesn't grow with the documents. It comes as Arrow
    batches, which neither the JVM nor Python turns into rows. Calibration counts the scores by their first six decimals
    and is done on the executors: the driver sees the thresholds alone. Both parts hold all documents if one of them would
    lack a label.
    """
    known, told = known_labels(labels), docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < int(0.3 * (1 << 30))
    counted = told.join(known, "doc_id").distinct().groupBy(held.alias("held"), "toxic").count().collect()
    if len({r["toxic"] for r in counted}) < 2:
        return None
    split = len(counted) == 4
    n = sum(r["count"] for r in counted if not (split and r["held"]))
    lanes = min(LANES, -(-n // LANE_ROWS))
    lane = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(lanes)).cast("int")
    few = known.limit(FEW + 1).count() <= FEW
    packed = labelled(docs, labels, few).mapInArrow(lean(_tokens), "doc_id long, lang string, toxic int, words binary").withColumn("held", held).withColumn("lane", lane)
    texts = saved(packed.repartitionById(lanes, F.col("lane")).sortWithinPartitions("lane", "doc_id"))
    learnt = (texts.where("NOT held") if split else texts).select("lane", "toxic", "words")
    weights, context = start(np.random.default_rng(5)), docs.sparkSession.sparkContext
    for number in range(EPOCHS):
        shared = context.broadcast(weights)
        reached = learnt.mapInArrow(_lane(shared, number), "lane int, rows long, state binary").toArrow()
        shared.destroy()
        weights = _joined(weights, reached)
        del reached
        trim()
    model = model_of(weights)
    check = (texts.where("held") if split else texts).select("lang", "toxic", "words").mapInArrow(_held_scores(model), "lang string, toxic int, score double")
    found = saved(check.groupBy("lang", F.round("score", 6).alias("score")).agg(F.sum("toxic").alias("hits"), F.count("*").alias("rows")))
    every = found.union(found.groupBy(F.lit(None).cast("string").alias("lang"), "score").agg(F.sum("hits").alias("hits"), F.sum("rows").alias("rows")))
    cuts = every.groupBy("lang").applyInArrow(_threshold, "lang string, cut double, toxic long, clean long").toArrow().to_pylist()
    model.thresholds = {None: next(r["cut"] for r in cuts if r["lang"] is None)}
    model.thresholds |= {r["lang"]: r["cut"] for r in sorted((r for r in cuts if r["lang"] is not None), key=lambda r: r["lang"]) if min(r["toxic"], r["clean"]) >= least}
    return model


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [score(model, *word_hashes(batch.column(0).slice(at, to - at))) for at, to in slices(batch.column(0), 1 << 20)]
            yield pa.record_batch([pa.array(np.concatenate(parts) if parts else np.zeros(0)), *batch.columns[1:]], ["toxicity", *batch.schema.names[1:]])

    return lean(run)


def scored(docs: DataFrame, labels: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """(row, toxicity, threshold, is_toxic) for every row of docs; row holds the `carried` columns, by default all."""
    model = fit(docs, labels)
    whole = as_row(docs.select(*dict.fromkeys([*(docs.columns if carried is None else carried), "lang"])))
    if model is None:
        return whole.select("row", F.lit(0.0).alias("toxicity"), F.lit(0.5).alias("threshold"), F.lit(False).alias("is_toxic"))
    text = docs["text"].cast("string")
    given = docs.select(text.alias("_text"), F.struct(*[docs[c] for c in whole.schema["row"].dataType.names]).alias("row"), F.coalesce(text.rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"), F.lit(False)).alias("has"))
    out = given.mapInArrow(_scorer(model), T.StructType([T.StructField("toxicity", T.DoubleType()), *given.schema.fields[1:]]))
    cut = F.coalesce(*[F.when(F.col("row.lang") == k, F.lit(v)) for k, v in model.thresholds.items() if k], F.lit(model.thresholds[None]))
    value = F.when(F.col("has"), F.round("toxicity", 6)).otherwise(0.0)
    return out.select("row", value.alias("toxicity"), cut.alias("threshold"), (F.col("has") & (F.col("toxicity") >= cut)).alias("is_toxic"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, toxicity, threshold, is_toxic) for every row of docs.

    labels is (doc_id, toxic 0/1); other columns of either table don't matter. The score covers the whole
    text. A null or wordless text, and every text if the labels lack one of the two classes, has
    toxicity 0 and is not toxic. A null or unknown language uses the threshold of all languages.
    Rows with equal text get equal scores; an empty table gives an empty table.
    """
    return scored(docs, labels, ["doc_id"]).select("row.doc_id", "row.lang", "toxicity", "threshold", "is_toxic")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't toxic, with all their columns, whatever these are named.

    Rows with a null doc_id are scored like others; null, empty and wordless texts stay; repeated rows go or stay
    together; an empty table gives an empty table.
    """
    return scored(docs, labels).where("NOT is_toxic").select("row.*")
