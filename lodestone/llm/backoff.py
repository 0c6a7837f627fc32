"""Operator 6: language-model scores by stupid backoff, relationally.

S(w | context) is count(context w) / count(context) where the corpus holds the n-gram at least `least`
times, else alpha times the score under the context shortened by a word; a word seen less often than
that has 1/N. Counts cover all documents.

The n-gram count tables are partitioned by 64-bit n-gram hash, and n-grams travel in columns: a row is not one
n-gram but those that a chunk of documents and a partition have in common. A chunk explodes its documents'
n-grams, combines equal ones and sends each partition its distinct ones with their counts, as one sorted and
compressed column; the partition sums the counts over chunks, which is its share of the count table,
and joins it back to every chunk's column; the chunk then joins the counts to its documents' n-grams and sums
per document. Hot n-grams are combined within a chunk first, so none can make a partition large. Rows are
at most chunks times partitions, and never more than the distinct n-grams of the chunks, as none is empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, mix, slices, trim, word_hashes

ORDER = 3
ALPHA = 0.4
LEAST = 2
_CHUNK_CHARS = 5 << 20
_GATHERED = 4096
_PART_CHUNKS = 2  # chunks' worth of n-grams in a partition


def _squeezed(values: np.ndarray) -> bytes:
    """Byte planes of 64-bit values, compressed, after their number: planes of zeros vanish."""
    planes = np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _expanded(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, "zstd"), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def _pack(values: np.ndarray) -> bytes:
    """Sorted values, by their differences."""
    return _squeezed(np.diff(values, prepend=np.uint64(0)))


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(_expanded(data), dtype=np.uint64)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, doc_id, text) of a batch as one row for each chunk: ids, byte lengths and compressed text."""
    for batch in batches:
        chunk = batch.column(0).to_numpy()
        for c in np.unique(chunk):
            own = pa.array(np.flatnonzero(chunk == c))
            for at in range(0, len(own), _GATHERED):
                some = own.slice(at, _GATHERED)
                text = batch.column(2).take(some).cast(pa.large_binary())
                data = b"".join(text.to_pylist())
                ids, sizes = batch.column(1).take(some), pc.binary_length(text).cast(pa.int64())
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.record_batch([pa.array([int(c)], pa.int32()), one(ids), one(sizes), pa.array([pa.compress(data, "zstd", asbytes=True)], pa.binary())], ["chunk", "ids", "sizes", "data"])


_GATHER = "chunk int, ids array<long>, sizes array<long>, data binary"


def _texts(table: pa.Table) -> Iterator[pa.Array]:
    for sizes, data in zip(table["sizes"].to_pylist(), table["data"]):
        offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
        raw = pa.decompress(data.as_py(), int(offsets[-1]), "zstd") if offsets[-1] else b""
        yield pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(raw))


def _ids(table: pa.Table) -> pa.Array:
    return pa.concat_arrays([x for c in table["ids"].chunks for x in [c.flatten()]]) if table.num_rows else pa.array([], pa.int64())


def _grams(table: pa.Table, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """64-bit n-gram hashes of every order at every word (its last word), positions in the text, and text lengths."""
    found, lengths = [], []
    for part in _texts(table):
        for at, to in slices(part):
            words, offsets = word_hashes(part.slice(at, to - at))
            found.append(words)
            lengths.append(np.diff(offsets))
    words = np.concatenate(found) if found else np.zeros(0, np.uint64)
    lengths = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
    place = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    full, out = words, []
    for n in range(1, order + 1):
        if n > 1:
            with np.errstate(over="ignore"):
                full = mix(np.concatenate([full[:1], full[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + words)
        out.append(full)
    return out, place, lengths


def _bounds(parts: int) -> np.ndarray:
    return np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)


def _ask(order: int, parts: int):
    bounds = _bounds(parts)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        grams, place, _ = _grams(table, order)
        rows = [(0, 0, b"", np.array([len(place)], np.int64).tobytes())]
        for n, g in enumerate(grams, 1):
            keys, counts = np.unique(g[place >= n - 1], return_counts=True)
            cuts = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])
            rows += [(p, n, _pack(keys[a:b]), _squeezed(counts[a:b])) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
        trim()
        part, orders, keys, counts = zip(*rows)
        return pa.table({"part": pa.array(part, pa.int32()), "chunk": pa.array([key[0].as_py()] * len(rows), pa.int32()), "n": pa.array(orders, pa.int32()), "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary())})

    return run


def _answer(least: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        chunk, n = table["chunk"].to_numpy(), table["n"].to_numpy()
        keys, counts = table["keys"].to_pylist(), table["counts"].to_pylist()
        out = []
        for order in np.unique(n):
            own = np.flatnonzero(n == order)
            if order == 0:
                total = sum(int(np.frombuffer(counts[i], np.int64)[0]) for i in own)
                out += [(int(chunk[i]), 0, key[0].as_py(), np.array([total], np.int64).tobytes()) for i in own]
                continue
            columns = [_unpack(keys[i]) for i in own]
            known, code = np.unique(np.concatenate(columns), return_inverse=True)
            sums = np.bincount(code, weights=np.concatenate([_expanded(counts[i]) for i in own]), minlength=len(known)).astype(np.uint64)
            sums = np.where(sums >= least, sums, 0)
            ends = np.cumsum([len(c) for c in columns])
            out += [(int(chunk[i]), int(order), key[0].as_py(), _squeezed(sums[code[e - len(c) : e]])) for i, c, e in zip(own, columns, ends)]
        trim()
        chunk, n, part, counts = zip(*out)
        return pa.table({"chunk": pa.array(chunk, pa.int32()), "n": pa.array(n, pa.int32()), "part": pa.array(part, pa.int32()), "counts": pa.array(counts, pa.binary())})

    return run


def _score(order: int, alpha: float):
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        grams, place, lengths = _grams(docs, order)
        n, part, got = answers["n"].to_numpy(), answers["part"].to_numpy(), answers["counts"].to_pylist()
        total = int(np.frombuffer(got[int(np.flatnonzero(n == 0)[0])], np.int64)[0])
        counts = []
        for k in range(1, order + 1):
            own = np.flatnonzero(n == k)
            sums = np.concatenate([np.zeros(0, np.uint64), *(_expanded(got[i]) for i in own[np.argsort(part[own])])])
            for i in own:
                got[i] = b""
            g, grams[k - 1] = grams[k - 1], None  # freed order by order
            here, at = np.zeros(len(place), np.float64), np.flatnonzero(place >= k - 1).astype(np.int32)
            at = at[np.argsort(g[at], kind="stable")]
            g = g[at]
            if len(at):
                here[at] = sums[np.cumsum(np.append(False, g[1:] != g[:-1]))]
            counts.append(here)
            del g, at, sums
        possible = np.minimum(place + 1, order)
        level = np.ones(len(place), np.int64)
        value = np.log(np.maximum(counts[0], 1) / max(total, 1))
        for k in range(2, order + 1):
            seen = counts[k - 1] > 0
            context = np.concatenate([counts[k - 2][:1], counts[k - 2][:-1]])
            # a context holds every n-gram that it begins; the greatest keeps this so should hashes meet
            value[seen] = np.log(counts[k - 1][seen] / np.maximum(context, counts[k - 1])[seen])
            level[seen] = k
        value += (possible - level) * math.log(alpha)
        row = np.repeat(np.arange(len(lengths)), lengths)
        score = np.bincount(row, weights=value, minlength=len(lengths))
        backed = np.bincount(row, weights=possible > level, minlength=len(lengths))
        mean = pa.array(np.round(score / np.maximum(lengths, 1), 6), mask=lengths == 0)
        trim()
        return pa.table({"doc_id": _ids(docs), "tokens": pa.array(lengths), "log_score": pa.array(np.round(score, 4)), "mean_log_score": mean, "backed_off": pa.array(backed.astype(np.int64))})

    return run


def scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, least: int = LEAST) -> DataFrame:
    """(doc_id, tokens, log_score, mean_log_score, backed_off) for every row of docs.

    log_score sums the natural logs of the words' scores, backed_off counts words scored under a shortened
    context. A null, empty or wordless text has no tokens, log_score 0 and a null mean. Every row counts
    towards the corpus, repeated rows too, and has a row in the result, also with a null doc_id. Other
    columns don't matter; an empty table gives an empty table. n-grams don't cross texts; very long texts count whole.
    Should two n-grams share a 64-bit hash, a context counts at least as much as what it begins.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chars = texts.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    chunks = max(1, math.ceil(chars / _CHUNK_CHARS))
    parts = math.ceil(chunks / _PART_CHUNKS)
    placed = texts.withColumn("chunk", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.xxhash64("text")), F.lit(chunks)).cast("int"))
    placed = placed.select("chunk", "doc_id", "text").mapInArrow(lean(_gather), _GATHER).repartition(2 * chunks, "chunk")
    asked = placed.groupBy("chunk").applyInArrow(_ask(order, parts), "part int, chunk int, n int, keys binary, counts binary").repartition(2 * parts, "part")
    answers = asked.groupBy("part").applyInArrow(_answer(least), "chunk int, n int, part int, counts binary")
    return placed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(order, alpha), "doc_id long, tokens long, log_score double, mean_log_score double, backed_off long")


SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+'), 1) AS i
  FROM documents WHERE text IS NOT NULL
), near AS (
  SELECT doc_id, i, w, lag(w, 1) OVER d AS v, lag(w, 2) OVER d AS u FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), c1 AS (SELECT w, count(*) AS n FROM words GROUP BY 1
), c2 AS (SELECT v, w, count(*) AS n FROM near WHERE i >= 2 GROUP BY 1, 2 HAVING count(*) >= 2
), c3 AS (SELECT u, v, w, count(*) AS n FROM near WHERE i >= 3 GROUP BY 1, 2, 3 HAVING count(*) >= 2
), total AS (SELECT count(*) AS n FROM words
), scored AS (
  SELECT t.doc_id,
    CASE WHEN c3.n IS NOT NULL THEN ln(c3.n::DOUBLE / x2.n)
         WHEN c2.n IS NOT NULL THEN ln(c2.n::DOUBLE / x1.n) + CASE WHEN i >= 3 THEN ln(0.4) ELSE 0 END
         ELSE ln(CASE WHEN c1.n >= 2 THEN c1.n ELSE 1 END::DOUBLE / total.n) + (least(i, 3) - 1) * ln(0.4) END AS s,
    CASE WHEN c3.n IS NOT NULL OR (i = 2 AND c2.n IS NOT NULL) OR i = 1 THEN 0 ELSE 1 END AS b
  FROM near t CROSS JOIN total
  LEFT JOIN c3 ON c3.u = t.u AND c3.v = t.v AND c3.w = t.w
  LEFT JOIN c2 x2 ON x2.v = t.u AND x2.w = t.v
  LEFT JOIN c2 ON c2.v = t.v AND c2.w = t.w
  LEFT JOIN c1 x1 ON x1.w = t.v
  LEFT JOIN c1 ON c1.w = t.w
), summed AS (SELECT doc_id, count(*) AS tokens, sum(s) AS s, sum(b) AS b FROM scored GROUP BY doc_id)
SELECT d.doc_id, coalesce(tokens, 0)::BIGINT AS tokens, round(coalesce(s, 0), 4) AS log_score, round(s / tokens, 6) AS mean_log_score, coalesce(b, 0)::BIGINT AS backed_off
FROM documents d LEFT JOIN summed USING (doc_id)
"""
