"""Operator 1: SentencePiece encoding and decoding with N-best segmentation.

A text is encoded over the lattice of a model's pieces, scored by the sum of the pieces' scores. No piece
spans a word start, so the lattice of a text is a chain of word lattices. Forward Viterbi runs by array
operations over all distinct words of a slice of texts, and a backward Viterbi pass beside it gives each
word's exact distance to its second-best segmentation. A text's N best segmentations can differ from
the best one only in the N-1 words with the least such distance; for these, backward A-star search over the
piece lattice, with the forward scores as exact heuristics, gives the N best, and the text's are
merged from them.

The trie over the pieces is a double array of a few megabytes, so that a worker holds little beside its texts.
Words of up to _LONGEST bytes run together by length. A longer one (an address, or a line of a script
without spaces) runs alone through the same search, once for each distinct word, at some 3 seconds a megabyte.

Scores are those in the model file. For a model of BPE kind they are negative merge ranks, so that the best
segmentation is the best by rank sum and need not be the one that greedy merges give.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, lean, ragged, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BEST = 4
_LONGEST = 48
_SLICE = 2 << 20
_NONE = -1e300
_SPACE = 0x20
_MARK = "▁"


def _varint(b: bytes, i: int) -> tuple[int, int]:
    shift = out = 0
    while True:
        out |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return out, i


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        if key & 7 == 0:
            value, i = _varint(b, i)
        elif key & 7 == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        else:
            n = 8 if key & 7 == 1 else 4
            value, i = b[i : i + n], i + n
        yield key >> 3, value


@dataclass
class Vocabulary:
    """Pieces of a model file and a byte trie over the normal ones, in which a space stands for the word mark."""

    pieces: list[str]
    kinds: list[int]
    ids: dict[bytes, int]
    scores: np.ndarray
    unknown_score: float
    unknown_id: int
    bytes_at: list[int]  # id of each byte piece, or unknown
    base: np.ndarray  # node's child by a byte is base + byte, if `owner` there is the node
    owner: np.ndarray
    ends: np.ndarray  # node -> id or -1
    longest: int
    spelled: np.ndarray  # bytes of all pieces, one after the other, a space for each word mark
    spelled_at: np.ndarray

    def step(self, nodes: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes that letters lead to, and whether there are such."""
        to = self.base[nodes] + letters
        return to, self.owner[to] == nodes


def _double_array(words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, owner and ends of a trie; node 0 is the root."""
    children: list[dict[int, int]] = [{}]
    value = [-1]
    for word, i in words.items():
        at = 0
        for b in word:
            if b not in children[at]:
                children[at][b] = len(children)
                children.append({})
                value.append(-1)
            at = children[at][b]
        value[at] = i
    size = 2 * len(children) + 1024
    used, base, owner, ends, place = np.zeros(size, bool), np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32), np.zeros(len(children), np.int64)
    used[:256], low, roomy, todo = True, 256, 256, [0]
    for node in todo:
        letters = np.array(sorted(children[node]), np.int64)
        if not len(letters):
            continue
        at, tries = low if len(letters) == 1 else max(low, roomy), 0  # several children look where the last ones found room
        while True:
            tries += 1
            free = np.flatnonzero(~used[at : at + 512]) + at
            free = free[free + 256 < size]
            good = ~used[free[:, None] + (letters - letters[0])].any(axis=1)
            if good.any():
                start = int(free[np.argmax(good)]) - int(letters[0])
                if len(letters) > 1 and tries > 2:
                    roomy = at
                break
            at += 512
            if at + 1024 > size:
                grow = lambda x, v: np.concatenate([x, np.full(size, v, x.dtype)])
                used, base, owner, ends = grow(used, False), grow(base, 0), grow(owner, -1), grow(ends, -1)
                size *= 2
        slots = start + letters
        used[slots] = True
        base[place[node]], owner[slots] = start, place[node]
        for b, slot in zip(letters.tolist(), slots.tolist()):
            place[children[node][b]] = slot
            ends[slot] = value[children[node][b]]
            todo.append(children[node][b])
        while used[low]:
            low += 1
    top = int(np.flatnonzero(used)[-1]) + 257
    fit = lambda x, v: np.concatenate([x[:top], np.full(max(0, top - len(x)), v, x.dtype)])
    return fit(base, 0), fit(owner, -1), fit(ends, -1)


def load(path: str = MODEL) -> Vocabulary:
    with open(path, "rb") as f:
        data = f.read()
    pieces, scores, kinds = [], [], []
    for field, value in _fields(data):
        if field == 1:
            own = dict(_fields(value))
            pieces.append(own[1].decode())
            scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
            kinds.append(own.get(3, 1))
    ids = {p.replace(_MARK, " ").encode(): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k in (1, 4)}
    if any(b" " in p.lstrip(b" ") for p in ids):
        raise ValueError("a piece spans a word start")
    base, owner, ends = _double_array(ids)
    unknown = kinds.index(2)
    by_byte = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == 6}
    score = np.array(scores)
    spelled = [bytes([int(p[1:-1], 16)]) if k == 6 else p.replace(_MARK, " ").encode() for p, k in zip(pieces, kinds)]
    return Vocabulary(pieces, kinds, ids, score, float(score[list(ids.values())].min()) - 10, unknown, [by_byte.get(b, unknown) for b in range(256)], base, owner, ends, max(map(len, ids)), np.frombuffer(b"".join(spelled), np.uint8), np.append(0, np.cumsum([len(x) for x in spelled])))


def _edges(v: Vocabulary, word: bytes) -> list[list[tuple[int, int, float]]]:
    """For each end position, the (start, id, score) of the pieces that end there; id -1 is an unknown character."""
    n, out = len(word), [[] for _ in range(len(word) + 1)]
    for s in range(n):
        if word[s] & 0xC0 == 0x80:
            continue
        char = s + 1
        while char < n and word[char] & 0xC0 == 0x80:
            char += 1
        at, alone = 0, False
        for e in range(s + 1, min(n, s + v.longest) + 1):
            to = int(v.base[at]) + word[e - 1]
            if v.owner[to] != at:
                break
            at = to
            if (i := v.ends[at]) >= 0:
                out[e].append((s, int(i), float(v.scores[i])))
                alone |= e == char
        if not alone:
            out[char].append((s, -1, v.unknown_score))
    return out


def _expand(v: Vocabulary, word: bytes, path: list[tuple[int, int, int]]) -> list[int]:
    out = []
    for s, e, i in path:
        if i >= 0:
            out.append(i)
        elif v.bytes_at[0] == v.unknown_id:
            out.append(v.unknown_id)
        else:
            out.extend(v.bytes_at[b] for b in (word[s:e].replace(b" ", _MARK.encode())))
    return out


def nbest(v: Vocabulary, word: bytes, n: int) -> list[tuple[float, list[int]]]:
    """The n best (score, ids) of one word, best first, by A-star search from the end of the lattice.

    A partial path from a position to the end has priority (its score + forward Viterbi score of the
    position), which is exactly the best total through it, so paths leave the queue in order of their
    final scores. Of equal ones the path that has come furthest leaves first, so that a word of which very many
    segmentations tie is searched in depth and costs no more than another.
    """
    edges = _edges(v, word)
    forward = [0.0] + [_NONE] * len(word)
    for e in range(1, len(word) + 1):
        for s, _, score in edges[e]:
            forward[e] = max(forward[e], forward[s] + score)
    queue: list = [(-forward[-1], len(word), 0, 0.0, None)]
    count, out = 1, []
    while queue and len(out) < n:
        _, at, _, tail, path = heapq.heappop(queue)
        if at == 0:
            steps = []
            while path is not None:
                steps.append(path[0])
                path = path[1]
            out.append((tail, _expand(v, word, steps)))
            continue
        for s, i, score in edges[at]:
            if forward[s] > _NONE / 2:
                heapq.heappush(queue, (-(forward[s] + score + tail), s, count, score + tail, ((s, at, i), path)))
                count += 1
    return out


def _viterbi(v: Vocabulary, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For words of one length (rows of bytes): best scores, gaps to the second best, and the best paths.

    A path is given by the back pointer (start, id) of each end position.
    """
    w, n = chars.shape
    forward, back, piece = np.full((w, n + 1), _NONE), np.full((w, n + 1), -1, np.int8), np.full((w, n + 1), -2, np.int32)
    forward[:, 0] = 0
    found: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
    lead = (chars & 0xC0) != 0x80
    # length of the character that starts at each byte
    span = np.zeros((w, n), np.int8)
    reach = np.full(w, n, np.int64)
    for s in range(n - 1, -1, -1):
        span[:, s] = reach - s
        reach = np.where(lead[:, s], s, reach)

    def offer(s: int, e: int, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        found.append((s, e, rows, ids, scores))
        value = forward[rows, s] + scores
        better = value > forward[rows, e]
        won = rows[better]
        forward[won, e], back[won, e], piece[won, e] = value[better], s, ids[better]

    for s in range(n):
        rows = np.flatnonzero(lead[:, s] & (forward[:, s] > _NONE / 2))
        if not len(rows):
            continue
        node, alone, all_rows = np.zeros(len(rows), np.int64), np.zeros(w, bool), rows
        for e in range(s + 1, min(n, s + v.longest) + 1):
            node, on = v.step(node, chars[rows, e - 1])
            rows, node = rows[on], node[on]
            if not len(rows):
                break
            ids = v.ends[node]
            hit = ids >= 0
            if hit.any():
                offer(s, e, rows[hit], ids[hit], v.scores[ids[hit]])
                alone[rows[hit & (span[rows, s] == e - s)]] = True
        rest = all_rows[~alone[all_rows]]
        for size in np.unique(span[rest, s]) if len(rest) else ():
            own = rest[span[rest, s] == size]
            offer(s, s + int(size), own, np.full(len(own), -1, np.int32), np.full(len(own), v.unknown_score))
    on_path = np.zeros((w, n + 1), bool)
    at, everyone = np.full(w, n), np.arange(w)
    while (live := at > 0).any():
        on_path[everyone[live], at[live]] = True
        at = np.where(live, back[everyone, at], 0)
    backward, gap = np.full((w, n + 1), _NONE), np.full(w, np.inf)
    backward[:, n] = 0
    for s, e, rows, ids, scores in sorted(found, key=lambda x: -x[0]):
        value = scores + backward[rows, e]
        backward[rows, s] = np.maximum(backward[rows, s], value)
    for s, e, rows, ids, scores in found:
        through = forward[rows, s] + scores + backward[rows, e]
        off = ~(on_path[rows, e] & (back[rows, e] == s) & (piece[rows, e] == ids))
        np.minimum.at(gap, rows[off], np.maximum(forward[rows[off], n] - through[off], 0))
    gap[gap > 1e200] = np.inf
    return forward[:, n], gap, back, piece


def _paths(v: Vocabulary, chars: np.ndarray, back: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the best paths, concatenated, and how many each word has."""
    w, n = chars.shape
    at, everyone, columns = np.full(w, n), np.arange(w), []
    while (live := at > 0).any():
        s = np.where(live, back[everyone, at], 0)
        i = np.where(live, piece[everyone, at], -2)
        columns.append((i, s, at))
        at = s
    columns.reverse()
    ids = np.stack([i for i, _, _ in columns], axis=1)
    count = (ids >= 0).sum(axis=1)
    odd = np.flatnonzero((ids == -1).any(axis=1))
    if not len(odd):
        return ids[ids >= 0], count
    own = {int(r): _expand(v, chars[r].tobytes(), [(int(s[r]), int(e[r]), int(i[r])) for i, s, e in columns if i[r] != -2]) for r in odd}
    for r, found in own.items():
        count[r] = len(found)
    out, begin = np.empty(int(count.sum()), np.int32), np.cumsum(count) - count
    even = (ids != -1).all(axis=1)
    out[np.repeat(begin[even], count[even]) + ragged(count[even])] = ids[even][ids[even] >= 0]
    for r, found in own.items():
        out[begin[r] : begin[r] + len(found)] = found
    return out, count


def normalise(text: pa.Array) -> pa.Array:
    """Every text behind one space, with a space for every word mark; null and empty texts stay without any."""
    text = pc.replace_substring(pc.fill_null(text, ""), _MARK, " ")
    return pc.if_else(pc.equal(pc.binary_length(text), 0), "", pc.binary_join_element_wise("", text, " "))


def encode(v: Vocabulary, text: pa.Array, best: int = BEST) -> list[tuple[np.ndarray, list[tuple[float, list[tuple[int, int, list[int]]]]]]]:
    """For each text its best ids and its up to `best` segmentations, best first, as (score, edits).

    An edit (at, drop, ids) replaces `drop` ids of the best segmentation at index `at`.
    """
    raw, offsets = buffers(normalise(text))
    n_texts = len(offsets) - 1
    if not len(raw):
        return [(np.zeros(0, np.int32), [(0.0, [])]) for _ in range(n_texts)]
    space = raw == _SPACE
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[offsets[:-1][offsets[:-1] < len(raw)]] = True
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(raw)))
    # distinct words: by length, as rows of bytes
    score, gap = np.zeros(len(starts)), np.full(len(starts), np.inf)
    held = np.zeros(len(starts), np.int64)  # index of the word's ids
    chunks, counts, total = [], [], 0
    group = np.minimum(sizes, _LONGEST + 1).astype(np.uint8)
    cache: dict[bytes, list] = {}
    by_size = np.argsort(group, kind="stable")
    edges = np.flatnonzero(np.append(True, np.diff(group[by_size].astype(np.int16)) > 0))
    for a, b in zip(edges, np.append(edges[1:], len(by_size))):
        own = by_size[a:b]
        n = int(sizes[own[0]])
        if n > _LONGEST:
            for k in own:
                word = raw[starts[k] : starts[k] + sizes[k]].tobytes()
                if word not in cache:
                    cache[word] = nbest(v, word, max(best, 2))
                found = cache[word]
                score[k], gap[k] = found[0][0], found[0][0] - found[1][0] if len(found) > 1 else np.inf
                held[k] = total
                chunks.append(np.array(found[0][1], np.int32))
                counts.append(np.array([len(found[0][1])]))
                total += 1
            continue
        chars = raw[starts[own][:, None] + np.arange(n)]
        kinds, code = np.unique(np.ascontiguousarray(chars).view(f"V{n}").ravel(), return_inverse=True)
        chars = kinds.view(np.uint8).reshape(-1, n)
        s, g, back, piece = _viterbi(v, chars)
        ids, count = _paths(v, chars, back, piece)
        score[own], gap[own], held[own] = s[code], g[code], total + code
        chunks.append(ids)
        counts.append(count)
        total += len(kinds)
    pool, count = np.concatenate(chunks).astype(np.int32), np.concatenate(counts)
    at_pool = np.cumsum(count) - count
    each = count[held]
    ids = pool[np.repeat(at_pool[held], each) + ragged(each)]
    id_at = np.append(0, np.cumsum(each))
    word_at = np.searchsorted(starts, offsets)
    out = []
    for a, b in zip(word_at[:-1], word_at[1:]):
        whole = float(score[a:b].sum())
        own = gap[a:b]
        near = np.argsort(own, kind="stable")[: best - 1] if b - a < 64 else _least(own, best - 1)
        options = []
        for k in sorted(int(x) for x in near if np.isfinite(own[x])):
            word = raw[starts[a + k] : starts[a + k] + sizes[a + k]].tobytes()
            if word not in cache:
                cache[word] = nbest(v, word, best)
            begin, base = int(id_at[a + k]), cache[word][0][0]
            held_ids = ids[begin : begin + int(each[a + k])].tolist()
            other = [(base - s, i) for s, i in cache[word] if i != held_ids][: best - 1]  # of ties, the search may list another first
            options.append((begin - int(id_at[a]), len(held_ids), other))
        out.append((ids[id_at[a] : id_at[b]], [(whole - loss, edits) for loss, edits in _merge(options, best)]))
    return out


def _least(gap: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k least gaps; of equal ones the first."""
    cut = np.partition(gap, k - 1)[k - 1]
    below = np.flatnonzero(gap < cut)
    return np.append(below, np.flatnonzero(gap == cut)[: k - len(below)])


def _merge(options: list[tuple[int, int, list[tuple[float, list[int]]]]], best: int) -> list[tuple[float, list[tuple[int, int, list[int]]]]]:
    """The `best` cheapest choices of one alternative or none for each word; equal losses keep word order."""
    found: list[tuple[float, list]] = [(0.0, [])]
    for at, drop, other in options:
        grown = found + [(loss + extra, [*edits, (at, drop, ids)]) for loss, edits in found for extra, ids in other]
        found = sorted(grown, key=lambda x: x[0])[:best]
    return found


def apply_edits(ids: list[int], edits: list) -> list[int]:
    """The full ids of an alternative."""
    out, at = [], 0
    for start, drop, new in edits:
        out.extend(ids[at:start])
        out.extend(new)
        at = start + drop
    return out + list(ids[at:])


def decode(v: Vocabulary, ids) -> str:
    """The text of ids: pieces joined, runs of byte pieces as UTF-8, word marks as spaces, without the first space."""
    text = decoded(v, np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def decoded(v: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of the pieces, first space included."""
    size = np.diff(v.spelled_at)[ids]
    return v.spelled[np.repeat(v.spelled_at[ids], size) + ragged(size)]


def restored(v: Vocabulary, ids: np.ndarray, lengths: np.ndarray, text: pa.Array) -> pa.Array:
    """For each text whether its ids (concatenated, so many for each) decode to it; null for null."""
    raw, offsets = buffers(text)
    back = decoded(v, ids)
    size = np.append(0, np.cumsum(np.diff(v.spelled_at)[ids]))
    ends = np.cumsum(lengths)
    at, to = size[ends - lengths], size[ends]
    at = at + ((to > at) & (np.append(back, 0)[at] == _SPACE))
    same = to - at == np.diff(offsets)
    n = np.where(same, np.diff(offsets), 0)
    differ = back[np.repeat(at, n) + ragged(n)] != raw[np.repeat(offsets[:-1], n) + ragged(n)]
    wrong = np.bincount(np.repeat(np.arange(len(n)), n)[differ], minlength=len(n)) > 0
    return pa.array(same & ~wrong, mask=pc.is_null(text).to_numpy(zero_copy_only=False))


SCHEMA = "doc_id long, ids array<int>, n_pieces int, nbest array<struct<score:double,edits:array<struct<at:int,drop:int,ids:array<int>>>>>, restored boolean"


def _lists(lengths: list[int] | np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), values)


def _nbest_column(found: list) -> pa.Array:
    """The segmentations of encode() as a nested column, from flat arrays."""
    per_text = [len(n) for _, n in found]
    options = [x for _, n in found for x in n]
    edits = [e for _, own in options for e in own]
    ids = _lists([len(i) for _, _, i in edits], pa.array([x for _, _, i in edits for x in i], pa.int32()))
    edit = pa.StructArray.from_arrays([pa.array([a for a, _, _ in edits], pa.int32()), pa.array([d for _, d, _ in edits], pa.int32()), ids], ["at", "drop", "ids"])
    option = pa.StructArray.from_arrays([pa.array([s for s, _ in options], pa.float64()), _lists([len(own) for _, own in options], edit)], ["score", "edits"])
    return _lists(per_text, option)


_vocabularies: dict[str, Vocabulary] = {}


def _encoder(path: str, best: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _vocabularies:
            _vocabularies[path] = load(path)
        v = _vocabularies[path]
        for batch in batches:
            for at, to in slices(batch.column(1), _SLICE):
                text = batch.column(1).slice(at, to - at)
                got = encode(v, text, best)
                lengths = np.array([len(i) for i, _ in got])
                ids = np.concatenate([i for i, _ in got]).astype(np.int32)
                yield pa.record_batch([batch.column(0).slice(at, to - at), _lists(lengths, pa.array(ids)), pa.array(lengths.astype(np.int32)), _nbest_column(got), restored(v, ids, lengths, text)], ["doc_id", "ids", "n_pieces", "nbest", "restored"])

    return lean(run)


def encoded(docs: DataFrame, model: str = MODEL, best: int = BEST) -> DataFrame:
    """(doc_id, ids, n_pieces, nbest, restored) for every row of docs.

    ids is the best segmentation; nbest lists up to `best` of them, best first, each as its score and the
    edits that turn ids into it (the first has none); restored says whether decoding ids gives the text
    back, which fails only for texts that hold the word mark U+2581 itself. A null text has no ids, one
    empty segmentation and a null `restored`; an empty text the same but restored. Repeated rows are
    encoded alike; very long texts and words are encoded whole; other columns don't matter; an empty table gives an empty table. Characters without
    a piece become their UTF-8 byte pieces. `model` is a path that every executor can read.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encoder(model, best), SCHEMA)
