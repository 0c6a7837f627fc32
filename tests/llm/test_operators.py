"""The training-data operators against SQL, brute force and planted cases, and on awkward tables."""

import itertools
import math
import pickle
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import backoff, common, htmlpaths, kdtree, mixing, pieces, planes, preference, queries, simhash, toxicity, units

from ..compare import SF, rows, sql_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: names that the operators use themselves
CLASHING = "_id _copies copies _copy _doc _version version _spans removed start end _rank rank k1 k2 part place value signature short words s w a b component group_id kept _dropped toxicity threshold is_toxic _text _has toxic tokens p0 p1 rate chunk id v cell m shard".split()
LONG = "lorem ipsum dolor sit amet consectetur " * 20000


def awkward(spark):
    texts = [(1, "The quick brown fox jumps over the lazy dog near the old river bank today."), (1, "The quick brown fox jumps over the lazy dog near the old river bank today."), (2, None), (3, ""), (None, "a text without an id"), (None, None), (4, LONG), (5, "the quick brown fox jumps over the lazy dog near the old river bank today"), (6, "?! ..."), (7, " \n\t "), (8, "naïve ▁ Ünïcode \U0001f600 " * 3)]
    base = spark.createDataFrame([(i, t, None if i == 5 else "en", None, None) for i, t in texts], DOCS)
    return base.selectExpr("*", *[f"'{c}' AS `{c}`" for c in CLASHING])


def labels(spark, pairs=()):
    return spark.createDataFrame([*pairs], "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS text", "'y' AS lang", "1 AS y")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    assert rows(queries.queries()[name](spark, SF)) == sql_rows(queries.oracle_sql()[name])


# 1


def every_path(v, word):
    edges = pieces._edges(v, word)

    def back(at):
        if at == 0:
            yield 0.0, []
        for s, i, score in edges[at]:
            for total, ids in back(s):
                yield total + score, [*ids, (s, at, i)]

    return sorted(((t, pieces._expand(v, word, p)) for t, p in back(len(word))), key=lambda x: -x[0])


@pytest.mark.parametrize("word", [b" a", b" the", b" thethe", " Größe".encode(), b" aaaaaa", b" zq\xe2\x98\x83x", b" 12345"])
def test_nbest_equals_enumeration(word):
    v = pieces.load()
    want = every_path(v, word)
    got = pieces.nbest(v, word, 6)
    assert [s for s, _ in got] == [s for s, _ in want[:6]]
    assert all((s, i) in want for s, i in got) and len({tuple(i) for _, i in got}) == len(got)


def test_text_nbest_equals_product_of_words():
    v = pieces.load()
    text = "aaaa the thethe"
    ids, found = pieces.encode(v, pa.array([text]), 4)[0]
    each = [every_path(v, w) for w in (b" aaaa", b" the", b" thethe")]
    want = sorted((-sum(s for s, _ in combo) for combo in itertools.product(*each)))[:4]
    assert [-s for s, _ in found] == want
    alternatives = [tuple(pieces.apply_edits(list(ids), e)) for _, e in found]
    assert len(set(alternatives)) == 4 and all(pieces.decode(v, a) == text for a in alternatives)


def test_tied_segmentations_end():
    v = pieces.load()
    found = pieces.nbest(v, b" " + b"a" * 2000, 4)
    assert len(found) == 4 and len({tuple(i) for _, i in found}) == 4


def test_encoded_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = pieces.encoded(docs).collect()
    v, text = pieces.load(), {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(got) == len(text)
    for r in got:
        assert r["restored"] and r["n_pieces"] == len(r["ids"]) and pieces.decode(v, r["ids"]) == text[r["doc_id"]]
        assert 1 <= len(r["nbest"]) <= 4 and r["nbest"][0]["edits"] == [] and [n["score"] for n in r["nbest"]] == sorted((n["score"] for n in r["nbest"]), reverse=True)


def test_encoded_awkward(spark):
    got = pieces.encoded(awkward(spark)).collect()
    assert len(got) == 11
    assert all(r["ids"] == [] and r["restored"] is None for r in got if r["doc_id"] == 2)
    assert all(r["ids"] == [] and r["restored"] for r in got if r["doc_id"] == 3)
    assert all(r["restored"] for r in got if r["doc_id"] in (1, 4, 5, 6, 7)) and not next(r for r in got if r["doc_id"] == 8)["restored"]
    assert pieces.encoded(awkward(spark).limit(0)).count() == 0


# 2


def naive_maxima(model, words):
    """Each filter's maximum and place, one window at a time."""
    pairs = toxicity.buckets(np.array(words, np.uint64)).T.tolist() + [[0, 0]] * toxicity._PAD
    x = [model.tables[0][a] + model.tables[1][b] for a, b in pairs]
    out, at = [], 0
    for w in toxicity._WIDTHS:
        for f in range(toxicity._FILTERS):
            column = [model.filters[:, at + j * toxicity._FILTERS + f] for j in range(w)]
            values = [float(sum(x[i + j] @ column[j] for j in range(w))) for i in range(len(words))]
            out.append((max(values), int(np.argmax(values))))
        at += w * toxicity._FILTERS
    return out


def naive_score(model, words):
    if not words:
        return 1 / (1 + math.exp(-model.shift))
    hidden = [max(0.0, m + b) for (m, _), b in zip(naive_maxima(model, words), model.bias)]
    return 1 / (1 + math.exp(-(sum(h * o for h, o in zip(hidden, model.out)) + model.shift)))


def random_model(seed):
    draw = np.random.default_rng(seed)
    columns, n = sum(toxicity._WIDTHS) * toxicity._FILTERS, len(toxicity._WIDTHS) * toxicity._FILTERS
    tables = draw.standard_normal((2, toxicity._BUCKETS, toxicity._DIM)).astype(np.float32)
    tables[:, 0] = 0
    return toxicity.Model(tables, draw.standard_normal((toxicity._DIM, columns)).astype(np.float32) * 0.3, draw.standard_normal(n).astype(np.float32), draw.standard_normal(n).astype(np.float32) * 0.1, 0.2)


def test_toxicity_score_equals_naive_convolution():
    draw, model = np.random.default_rng(14), random_model(15)
    texts = [draw.integers(0, 2**64, n, dtype=np.uint64) for n in (1, 2, 3, 0, 40, 7, 0)]
    got = toxicity.score(model, np.concatenate(texts), np.cumsum([0, *map(len, texts)]))
    assert got == pytest.approx([naive_score(model, t.tolist()) for t in texts], abs=1e-5)
    some = [t for t in texts if len(t)]
    pairs, starts, n = toxicity._padded(np.concatenate(some), np.cumsum([0, *map(len, some)]))
    best, where = toxicity._pooled(toxicity._responses(model.tables[0][pairs[0]] + model.tables[1][pairs[1]], model.filters), starts, starts + n)
    for i, t in enumerate(some):
        want = naive_maxima(model, t.tolist())
        assert best[i] == pytest.approx([m for m, _ in want], abs=1e-4) and (where[i] - starts[i]).tolist() == [at for _, at in want]


def test_training_step_follows_the_gradient(monkeypatch):
    """One batch of Adagrad from a known start moves every weight against the loss's difference quotient."""
    draw = np.random.default_rng(18)
    texts = [draw.integers(0, 2**64, n, dtype=np.uint64) for n in (9, 4, 6, 1, 12)]
    labels_ = np.array([1, 0, 1, 0, 1], np.float32)
    start = toxicity.train(texts, labels_, epochs=0)
    after = toxicity.train(texts, labels_, epochs=1)

    def loss(model):
        s = [naive_score(model, t.tolist()) for t in texts]
        return -np.mean([math.log(p) if y else math.log(1 - p) for p, y in zip(s, labels_)])

    for name, tried in (("filters", [(3, 5), (0, 20), (7, 60)]), ("bias", [(2,), (20,)]), ("out", [(1,), (30,)])):
        for at in tried:
            value = getattr(start, name)
            held, step = value[at], 1e-2
            value[at] = held + step
            up = loss(start)
            value[at] = held - step
            down = loss(start)
            value[at] = held
            slope = (up - down) / (2 * step)
            moved = float(getattr(after, name)[at] - held)
            want = -0.05 * slope / math.sqrt(1e-2 + slope**2)
            assert moved == pytest.approx(want, abs=2e-3)
    assert loss(after) < loss(start)


def test_best_threshold_equals_scan():
    draw = np.random.default_rng(20)
    for _ in range(20):
        s, y = np.round(draw.random(40), 1), (draw.random(40) < 0.4).astype(float)
        y[0] = 1
        f1 = lambda cut: 2 * y[s >= cut].sum() / ((s >= cut).sum() + y.sum())
        assert f1(toxicity.best_threshold(s, y)) == pytest.approx(max(f1(c) for c in [*s, *(s - 0.05)]))


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 50, "word " * 100 + str(i), "en", "s", 0) for i in range(5000)], DOCS)
    known = labels(spark, [(i % 50, 1, i % 2) for i in range(200)])
    assert toxicity.sample(docs, known).count() == 50  # one row for each doc_id, however often it occurs
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 10 * 505)
    assert 1 <= toxicity.sample(docs, known).count() <= 25


def test_toxicity_learns_from_every_labelled_document(spark, monkeypatch):
    """Each telling word is in a few documents, so that a model of some of them misses most words; several lanes, none of which has all."""
    monkeypatch.setattr(toxicity, "LANE_ROWS", 300, raising=False)
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 200)
    monkeypatch.setattr(toxicity.sample, "__defaults__", (200, 11))
    monkeypatch.setattr(toxicity.fit, "__defaults__", (200, 8) if len(toxicity.fit.__defaults__) == 2 else (8,))
    draw = np.random.default_rng(2)
    words, telling = [f"w{i}" for i in range(400)], [f"zorg{i}" for i in range(60)]
    text = lambda i: " ".join([*draw.choice(words, 20), *([telling[i // 2 % 60]] if i % 2 else [])])
    made = [(i, text(i), "en" if i % 3 else "de", "s", 0) for i in range(3600)]
    docs = spark.createDataFrame(made, DOCS)
    model = toxicity.fit(docs, labels(spark, [(i, 1, i % 2) for i in range(3000)]))
    hashed, offsets = common.word_hashes(pa.array([r[1] for r in made[3000:]]))
    found = toxicity.score(model, hashed, offsets) >= model.thresholds[None]
    assert np.mean(found == (np.arange(3000, 3600) % 2 == 1)) >= 0.9


def test_toxicity_sends_no_large_rows_to_the_driver(spark, monkeypatch):
    """Rows are held several times over by the JVM and Python: weights come as Arrow batches, of scores the thresholds alone."""
    monkeypatch.setattr(toxicity, "LANE_ROWS", 300)
    frame, as_rows, as_arrow = type(spark.range(1)), [], []
    for name, size, seen in (("collect", lambda x: len(pickle.dumps(x)), as_rows), ("toPandas", lambda x: len(pickle.dumps(x)), as_rows), ("toArrow", lambda x: x.nbytes, as_arrow)):
        monkeypatch.setattr(frame, name, lambda self, real=getattr(frame, name), size=size, seen=seen: [x := real(self), seen.append(size(x))][0])
    draw = np.random.default_rng(3)
    made = [(i, " ".join(f"w{x}" for x in draw.integers(0, 10**6, 60)) + " zorg" * (i % 2), "en" if i % 3 else "de", "s", 0) for i in range(1500)]
    model = toxicity.fit(spark.createDataFrame(made, DOCS), labels(spark, [(i, 1, i % 2) for i in range(1500)]))
    assert set(model.thresholds) == {None, "de", "en"}
    assert max(as_rows) < 1 << 14 and max(as_arrow, default=0) < 4 * 9_200_000 and min(as_arrow) < 1 << 10


def test_toxicity_held_out(spark):
    draw = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    made = [(i, " ".join([*draw.choice(words, 40), *(["zorg", "blat"] if i % 4 == 0 else [])]), "en" if i % 2 else "de", "s", 0) for i in range(1200)]
    docs = spark.createDataFrame(made, DOCS)
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels(spark, [(i, 1, int(i % 4 == 0)) for i in range(800)])).collect()}
    held = range(800, 1200)
    right = sum(got[i]["is_toxic"] == (i % 4 == 0) for i in held)
    assert len(got) == 1200 and right >= 392


def test_toxicity_reads_whole_texts(spark):
    made = [(i, ("plain words only here " * 5) + ("zorg blat" if i % 2 else ""), "en", "s", 0) for i in range(300)]
    docs = spark.createDataFrame([*made, (999, LONG + " zorg blat", "en", "s", 0)], DOCS)
    got = {r["doc_id"]: r["is_toxic"] for r in toxicity.toxicity(docs, labels(spark, [(i, 1, i % 2) for i in range(300)])).collect()}
    assert got[999] and not got[0]


def test_toxicity_awkward(spark):
    docs = awkward(spark)
    for known in ([], [(1, 1, 0), (5, 0, 1)], [(None, 1, 1), (1, None, None), (4, 0, 1), (1, 1, 0)]):
        got = toxicity.toxicity(docs, labels(spark, known)).collect()
        assert len(got) == 11 and all(r["toxicity"] == 0 and not r["is_toxic"] for r in got if r["doc_id"] in (2, 3, 6, 7))
    kept = toxicity.drop_toxic(docs, labels(spark, [(1, 1, 0), (5, 0, 1)]))
    assert kept.columns == docs.columns and kept.where("text IS NULL").count() == 2
    assert toxicity.toxicity(docs.limit(0), labels(spark)).count() == 0


# 3


def test_topk_brute_force_with_ties(spark):
    draw = np.random.default_rng(2)
    x = np.concatenate([draw.integers(0, 4, (300, 5)), np.zeros((40, 5), int)]).astype(float)
    df = spark.createDataFrame([(i, [float(a) for a in v], "z") for i, v in enumerate(x)], "vec_id long, embedding array<float>, shard string")
    got = {}
    for r in kdtree.nearest(df, k=4, every=1, shard=32).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["neighbor_id"], r["distance"]))
    asked = {r["query_id"] for r in kdtree.nearest(df, k=4, every=7, shard=32).collect()}
    assert asked == set(range(0, len(x), 7))
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    for i in range(len(x)):
        want = sorted((d[i, j], j) for j in range(len(x)) if j != i)[:4]
        assert [(j, round(math.sqrt(s), 6)) for s, j in want] == [(j, s) for _, j, s in sorted(got[i])]


def test_tree_prunes_and_stays_exact():
    draw = np.random.default_rng(12)
    x = np.concatenate([c + 0.01 * draw.standard_normal((256, 8)) for c in draw.standard_normal((16, 8))])
    tree = kdtree.build(x, np.arange(len(x)), leaf=32)
    inner = tree.children[:, 0] >= 0
    for node in np.flatnonzero(~inner):
        a, b = tree.rows[node]
        assert np.array_equal(tree.low[node], tree.x[a:b].min(axis=0)) and np.array_equal(tree.high[node], tree.x[a:b].max(axis=0))
    for i in range(0, len(x), 97):
        best = kdtree.Best(5)
        assert kdtree.search(tree, x[i], i, best) <= 12  # of 128 leaves
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        assert sorted(best.ids) == sorted(np.argsort(d)[:5])
        known = kdtree.Best(5, best.kth())
        assert kdtree.search(tree, x[i], i, known) <= 12 and np.array_equal(known.ids, best.ids)


def test_topk_awkward(spark):
    schema = "vec_id long, embedding array<float>, id string, v int"
    bad = [(None, [1.0, 2.0]), (5, None), (6, []), (7, [float("nan"), 1.0]), (8, [None, 1.0])]
    good = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [3.0, 4.0])]
    got = kdtree.nearest(spark.createDataFrame([(*r, "x", 1) for r in bad + good], schema), every=1).collect()
    assert sorted((r["query_id"], r["neighbor_id"], r["distance"]) for r in got) == [(1, 2, 5.0), (2, 1, 5.0)]
    assert kdtree.nearest(spark.createDataFrame([(1, [1.0], "x", 1)], schema), every=1).count() == 0
    assert kdtree.nearest(spark.createDataFrame([], schema)).count() == 0


# 4


def test_simhash_recall(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    signed = simhash.signatures(docs).where("NOT short").collect()
    bits = np.stack([np.frombuffer(r["signature"], np.uint64) for r in signed])
    ids = [r["doc_id"] for r in signed]
    group = {r["doc_id"]: r["group_id"] for r in simhash.near_copies(docs).collect()}
    d = np.bitwise_count(bits[:, None] ^ bits[None]).sum(2)
    a, b = np.nonzero(np.triu(d <= simhash.MOST, 1))
    assert len(a) > 50 and np.mean([group[ids[i]] == group[ids[j]] for i, j in zip(a, b)]) >= 0.9
    # nothing is grouped that brute force doesn't chain together
    low = common.local_components(len(ids), a, b)
    where = {x: ids[low[i]] for i, x in enumerate(ids)}
    assert all(where[g] == where[x] for x, g in group.items() if x in where)


def test_simhash_near_copy_and_chain(spark):
    draw = np.random.default_rng(4)
    words = [f"w{i}" for i in draw.integers(0, 100000, 300)]
    near = words[:100] + ["changed"] + words[101:]
    far = [f"v{i}" for i in draw.integers(0, 100000, 300)]
    docs = spark.createDataFrame([(3, " ".join(words), "", "", 0), (2, " ".join(near), "", "", 0), (9, " ".join(far), "", "", 0), (1, "too short", "", "", 0), (4, "too  SHORT!", "", "", 0), (5, "short too", "", "", 0)], DOCS)
    got = {r["doc_id"]: (r["group_id"], r["kept"]) for r in simhash.near_copies(docs).collect()}
    assert got == {3: (2, False), 2: (2, True), 9: (9, True), 1: (1, True), 4: (1, False), 5: (5, True)}


def test_pigeonring_budgets_lose_no_chain():
    draw = np.random.default_rng(5)
    bits = draw.integers(0, 2, (200, simhash.BITS)).astype(np.uint8)
    flip = draw.random((200, simhash.BITS)) < 0.15
    both = np.concatenate([bits, bits ^ flip])
    values = simhash.cut(both, np.arange(simhash.BITS), 8)
    a, b = np.arange(200), np.arange(200) + 200
    near = flip.sum(1) <= simhash.MOST
    hit = np.zeros(200, bool)
    for s in range(32):
        hit[simhash.chain(values[:, :32], a, b, simhash.MOST, s)] = True
    assert np.array_equal(hit, near)  # some start keeps all budgets exactly for the near pairs


@pytest.mark.parametrize("n", [10**4, 10**6, 10**8])
@pytest.mark.parametrize("distance", [38, 42, 45])
def test_simhash_pairs_meet_at_every_size(n, distance):
    draw = np.random.default_rng(n + distance)
    width, count = simhash.layout(n)
    bits = draw.integers(0, 2, (1000, simhash.BITS)).astype(np.uint8)
    other = bits.copy()
    for x in other:
        x[draw.choice(simhash.BITS, distance, replace=False)] ^= 1
    packed = [np.packbits(x, bitorder="little").tobytes() for x in np.concatenate([bits, other])]
    batch = pa.record_batch({"doc_id": pa.array(np.arange(2000)), "signature": pa.array(packed, pa.binary())})
    met = np.zeros(1000, bool)
    for out in simhash._segments(width, count, 1)([batch]):
        value = out.column("value").to_numpy()
        same = np.flatnonzero(value[:1000] == value[1000:])
        # the group in which this segment's pairs meet
        group = pa.Table.from_batches([out.take(pa.array(np.concatenate([same, same + 1000])))])
        found = simhash._meet(simhash.MOST)(group).to_pandas()
        met[found["b"][found["a"] == found["b"] + 1000]] = True
    assert met.mean() >= 0.9


@pytest.mark.parametrize("distance", [20, 45])
@pytest.mark.parametrize("width", [16, 21])
def test_simhash_loses_no_pair(monkeypatch, distance, width):
    monkeypatch.setattr(simhash, "_BRUTE", 0, raising=False)  # lookups, also for few signatures
    monkeypatch.setattr(simhash, "_PAIRS", 1 << 12, raising=False)
    draw = np.random.default_rng(distance)
    bits = draw.integers(0, 2, (1500, simhash.BITS)).astype(np.uint8)
    other = bits.copy()
    for x in other:
        x[draw.choice(simhash.BITS, distance, replace=False)] ^= 1
    packed = [np.packbits(x, bitorder="little").tobytes() for x in np.concatenate([bits, other])]
    batch = pa.record_batch({"doc_id": pa.array(np.arange(3000)), "signature": pa.array(packed, pa.binary())})
    every = pa.Table.from_batches(simhash._segments(width, 3, 1)([batch]))
    found = simhash._meet(simhash.MOST, width)(every).to_pandas()
    assert sorted(zip(found["b"], found["a"])) == [(i, i + 1500) for i in range(1500)]


def test_simhash_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_BLOCK", 250)  # eight blocks
    monkeypatch.setattr(simhash, "_BRUTE", 1000, raising=False)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    signed = sorted(simhash.signatures(docs).collect(), key=lambda r: r["doc_id"])
    bits = np.stack([np.frombuffer(r["signature"], np.uint64) for r in signed])
    short = np.array([r["short"] for r in signed])
    near = np.bitwise_count(bits[:, None] ^ bits[None]).sum(2) <= np.where(short[:, None] | short[None], 0, simhash.MOST)
    low = common.local_components(len(signed), *np.nonzero(near & (short[:, None] == short[None])))
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_copies(docs).collect()}
    assert got == {r["doc_id"]: signed[low[i]]["doc_id"] for i, r in enumerate(signed)}


def test_simhash_links_every_pair_at_the_threshold(spark, monkeypatch):
    draw = np.random.default_rng(45)
    bits = draw.integers(0, 2, (2000, simhash.BITS)).astype(np.uint8)
    other = bits.copy()
    for x in other:
        x[draw.choice(simhash.BITS, simhash.MOST, replace=False)] ^= 1
    packed = [np.packbits(x, bitorder="little").tobytes() for x in np.concatenate([bits, other])]
    made = spark.createDataFrame([(i, bytearray(x), 9, False) for i, x in enumerate(packed)], "doc_id long, signature binary, words int, short boolean")
    large = simhash.layout(10**6)
    monkeypatch.setattr(simhash, "layout", lambda *n: large)
    monkeypatch.setattr(simhash, "signatures", lambda docs: docs)
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_copies(made).collect()}
    assert got == {i: i % 2000 for i in range(4000)}


def test_simhash_links_each_text_of_a_repeated_id(spark):
    draw = np.random.default_rng(48)
    a, b, c = (" ".join(f"w{i}" for i in draw.integers(0, 10**6, 120)) for _ in range(3))
    near = lambda t: t.replace(" w", " changed w", 1)
    made = [(2, a), (2, b), (2, c), (3, near(a)), (4, near(b)), (5, near(c)), (1, "too short"), (6, "too short"), (6, near(near(c))), (9, "other words here")]
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_copies(spark.createDataFrame([(*r, "", "", 0) for r in made], DOCS)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 9: 9}


def test_simhash_awkward(spark):
    docs = awkward(spark)
    got = {r["doc_id"]: (r["group_id"], r["kept"]) for r in simhash.near_copies(docs).collect()}
    assert got == {1: (1, True), 4: (4, True), 5: (1, False), 8: (8, True)}
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns and left.count() == 10
    assert simhash.near_copies(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 5


def test_passage_is_removed_whole(spark):
    draw = np.random.default_rng(16)
    sentence = lambda n: " ".join(f"w{i}" for i in draw.integers(0, 10**9, n)).capitalize() + "."
    passage = " ".join(sentence(n) for n in (9, 4, 12, 7, 11, 10))
    own = [sentence(40) for _ in range(4)]
    texts = [(2, f"{own[0]}\n{passage}\n{own[1]}"), (1, f"{passage}\n{own[2]}"), (3, own[3]), (4, f"glued words {passage} {own[3]}")]
    got = {r["doc_id"]: r for r in units.drop_repeats(spark.createDataFrame([(*t, "", "", 0) for t in texts], DOCS)).collect()}
    assert got[1]["removed"] == [] and got[3]["removed"] == []
    assert got[2]["text"] == f"{own[0]}\n{own[1]}" and got[4]["text"] == "glued words "
    for i, t in texts:
        spans = [(s["start"], s["end"]) for s in got[i]["removed"]]
        kept = [t[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(t)])]
        assert "".join(kept) == got[i]["text"] and all(e < s for (_, e), (s, _) in zip(spans, spans[1:]))


def test_short_common_lines_stay(spark):
    draw = np.random.default_rng(17)
    words = lambda n: " ".join(f"w{i}" for i in draw.integers(0, 10**9, n))
    texts = [(i, f"{words(40)}\nAll rights of this page are reserved by its owner.\n{words(30)}") for i in range(40)]
    got = units.drop_repeats(spark.createDataFrame([(*t, "", "", 0) for t in texts], DOCS))
    assert got.where("size(removed) > 0").count() == 0


def test_passages_of_short_units_are_removed(spark):
    draw = np.random.default_rng(6)
    words = lambda n: [f"w{i}" for i in draw.integers(0, 10**9, n)]
    capitals = " ".join(words(155)).upper()
    lines = "\n".join(" ".join(words(5)) for _ in range(10)) + "\n"
    own = [" ".join(words(5)) + "\n" for _ in range(4)]
    period = "Buy Now " * 40
    texts = [(1, capitals), (2, own[0] + lines + own[1]), (3, capitals), (4, own[2] + lines + own[3]), (5, "Tiny Text"), (6, "tiny text!"), (7, "tiny"), (8, period), (9, period)]
    got = {r["doc_id"]: r["text"] for r in units.drop_repeats(spark.createDataFrame([(*t, "", "", 0) for t in texts], DOCS)).collect()}
    assert got[1] == capitals and got[3] == "" and got[2] == own[0] + lines + own[1] and got[4] == own[2] + own[3]
    assert got[5] == "Tiny Text" and got[6] == "" and got[7] == "tiny"
    assert got[8].split() == ["Buy", "Now"] * 13 and got[9] == ""  # the occurrences that stay, one word apart, stay whole


def test_planted_passages_go_and_clean_documents_stay(spark):
    """Passages of 50 words and more that documents share, against documents that share and repeat none, by plain Python."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: len(r["removed"]) for r in units.drop_repeats(docs).collect()}
    first, later, shared = {}, set(), set()
    short = Counter()
    texts = {r["doc_id"]: __import__("re").findall(r"[0-9a-z\x80-\U0010ffff]+", (r["text"] or "").lower()) for r in docs.collect()}
    for i in sorted(texts):
        w = texts[i]
        short[tuple(w)] += 1
        for at in range(len(w) - 49):
            seen = first.setdefault(tuple(w[at : at + 50]), i)
            if seen != i:
                later.add(i)
                shared |= {i, seen}
        own = {}
        if any(at - own.setdefault(tuple(w[at : at + 25]), at) >= 25 for at in range(len(w) - 24)):
            shared.add(i)  # repeats itself
    clean = [i for i in texts if i not in shared and short[tuple(texts[i])] == 1]
    assert len(later) > 50 and np.mean([got[i] > 0 for i in later]) >= 0.95
    assert len(clean) > 300 and np.mean([got[i] == 0 for i in clean]) >= 0.95


def test_units_awkward(spark):
    docs = awkward(spark)
    got = units.drop_repeats(docs)
    assert got.count() == 11 and got.columns == [*[c for c in docs.columns if c != "removed"], "removed"]
    assert units.drop_repeats(docs.drop("removed").withColumn("Removed", F.lit(1))).columns[-1] == "removed"
    by = {}
    for r in got.select("doc_id", "text", "removed").collect():
        by.setdefault(r["doc_id"], []).append((r["text"], len(r["removed"])))
    assert by[1] == by[1][:1] * 2 and by[1][0][1] == 0 and by[5] == [("", 1)]
    assert by[2] == [(None, 0)] and by[3] == [("", 0)] and by[4][0][0] == LONG
    assert units.drop_repeats(docs.limit(0)).count() == 0


# 6


def brute_scores(texts, alpha=0.4, least=2):
    docs = [[w for w in __import__("re").findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())] for t in texts]
    counts = Counter(tuple(d[i : i + n]) for d in docs for n in (1, 2, 3) for i in range(len(d) - n + 1))
    counts = Counter({k: c for k, c in counts.items() if c >= least})
    total = sum(map(len, docs))
    out = []
    for d in docs:
        score = 0.0
        for i, w in enumerate(d):
            n, factor = min(i + 1, 3), 1.0
            while n > 1 and not counts[tuple(d[i - n + 1 : i + 1])]:
                n, factor = n - 1, factor * alpha
            score += math.log(factor * (counts[tuple(d[i - n + 1 : i + 1])] / counts[tuple(d[i - n + 1 : i])] if n > 1 else max(counts[w,], 1) / total))
        out.append(round(score, 3))
    return out


def test_backoff_brute_force(spark):
    texts = ["a b c a b c a b d", "a b c", "", None, "d d d d", "A, b. C! é é x", "q"]
    docs = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: round(r["log_score"], 3) for r in backoff.scores(docs).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(brute_scores(texts), abs=0.002)


def test_backoff_is_finite_and_equals_sql_at_a_larger_size(spark):
    folder = "/root/testdata/sf0.1"
    got = backoff.scores(spark.read.parquet(f"{folder}/documents.parquet"))
    assert got.where("isnan(log_score) OR abs(log_score) = double('Infinity')").count() == 0
    assert rows(got) == sql_rows(backoff.SQL, folder)


def test_backoff_awkward(spark):
    got = backoff.scores(awkward(spark)).collect()
    assert len(got) == 11
    assert all(r["tokens"] == 0 and r["log_score"] == 0 and r["mean_log_score"] is None for r in got if r["doc_id"] in (2, 3, 6, 7))
    assert backoff.scores(awkward(spark).limit(0)).count() == 0


# 7


def test_preference_awkward(spark):
    schema = "conv_id long, turn long, role string, text string, c string"
    chosen = spark.createDataFrame([(1, 0, "user", "hi", ""), (1, 0, "user", "hi", ""), (1, 1, "assistant", "good", ""), (2, 0, "user", None, ""), (None, 0, "user", "x", ""), (3, None, "user", "x", ""), (4, 0, None, "only", "")], schema)
    rejected = spark.createDataFrame([(1, 0, "user", "hi", ""), (1, 1, "assistant", "bad one", ""), (2, 0, "user", "", "")], schema)
    got = {r["conv_id"]: r for r in preference.formatted(chosen, rejected).collect()}
    assert set(got) == {1, 2}
    one = got[1]
    assert (one["n_shared"], one["prompt"]) == (1, "<|user|>\nhi<|end|>\n")
    for text, mask, want in ((one["chosen"], one["chosen_mask"], "good<|end|>\n"), (one["rejected"], one["rejected_mask"], "bad one<|end|>\n")):
        a, b = map(int, mask.split("-"))
        assert text[a:b] == want
    assert (got[2]["n_shared"], got[2]["chosen"], got[2]["chosen_mask"]) == (1, "", "")
    assert preference.formatted(chosen.limit(0), rejected).count() == 0


def test_preference_pairs_of_awkward_tables(spark):
    schema = "conv_id long, turn long, role string, text string, turns string, _last int, t string"
    made = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, 2, "user", "again"), (1, 3, "assistant", "b"), (1, 4, "user", "unanswered"), (2, 0, "user", "alone"), (3, 0, "assistant", None), (4, 0, "user", "echo me"), (4, 1, "assistant", "only"), (None, 0, "assistant", "x"), (5, None, "assistant", "x"), (6, 0, None, None), (6, 1, "assistant", LONG)]
    chosen, rejected = preference.pairs_of(spark.createDataFrame([(*r, "x", 1, "y") for r in made], schema))
    turns = lambda df: {i: [(r["turn"], r["role"], r["text"]) for r in sorted(df.where(f"conv_id = {i}").collect(), key=lambda r: r["turn"])] for i in (1, 2, 3, 4, 5, 6)}
    good, bad = turns(chosen), turns(rejected)
    assert good[1] == [(0, "user", "q"), (1, "assistant", "a"), (2, "user", "again"), (3, "assistant", "b")] and bad[1] == [*good[1][:3], (3, "assistant", "a")]
    assert good[2] == bad[2] == good[5] == [] and good[3] == bad[3] == [(0, "assistant", "")]
    assert bad[4] == [(0, "user", "echo me"), (1, "assistant", "echo me")]
    assert good[6] == [(0, "", ""), (1, "assistant", LONG)] and bad[6] == [(0, "", ""), (1, "assistant", "")]
    got = {r["conv_id"]: r for r in preference.formatted(chosen, rejected).collect()}
    assert set(got) == {1, 3, 4, 6} and got[6]["chosen"] == f"<|assistant|>\n{LONG}<|end|>\n" and got[6]["chosen_mask"] == f"14-{14 + len(LONG) + 8}"
    empty = preference.pairs_of(spark.createDataFrame([], schema))
    assert empty[0].count() == empty[1].count() == preference.formatted(*empty).count() == 0


# 8


def test_planes_recall(spark):
    draw = np.random.default_rng(6)
    x = draw.standard_normal((400, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x + 0.05 * draw.standard_normal(x.shape)
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    every = np.concatenate([x, near, x[:10]])
    got = {r["id"]: r["group_id"] for r in planes.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(every)], "vec_id long, embedding array<double>")).collect()}
    a, b = np.nonzero(np.triu(every @ every.T >= planes.THRESHOLD, 1))
    assert len(a) > 200 and np.mean([got[i] == got[j] for i, j in zip(a.tolist(), b.tolist())]) >= 0.9
    low = common.local_components(len(every), a, b)
    assert all(low[i] == low[g] for i, g in got.items())


def test_rounded_vectors_bound_every_cosine():
    draw = np.random.default_rng(22)
    x = draw.standard_normal((300, 24))
    x[150:] = x[:150] + 0.3 * draw.standard_normal((150, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    batch = pa.record_batch({"id": pa.array(np.arange(300)), "v": pa.array(x.tolist(), pa.list_(pa.float64()))})
    out = next(planes._codes(4, 1, 1, 7)(iter([batch])))
    small = np.frombuffer(b"".join(out["v"].to_pylist()), np.int8).reshape(300, -1)
    exact, sure_n, open_n = x @ x.T, 0, 0
    for threshold in (0.5, 0.9, 0.95):
        sure, maybe = planes.bounded(small, out["scale"].to_numpy(), out["error"].to_numpy(), threshold, 0, 300)
        assert not (sure & (exact < threshold)).any() and not (~maybe & (exact >= threshold)).any()
        sure_n, open_n = sure_n + sure.sum(), open_n + (maybe & ~sure).sum()
    assert open_n < 0.2 * sure_n


def test_planes_verify_pairs_that_rounding_leaves_open(spark):
    draw = np.random.default_rng(23)
    x = np.linalg.qr(draw.standard_normal((64, 64)))[0]
    made = []
    for i in range(0, 60, 2):  # pairs just at either side of the threshold
        c = planes.THRESHOLD + (1e-4 if i % 4 else -1e-4)
        made += [x[i], c * x[i] + math.sqrt(1 - c * c) * x[i + 1]]
    got = {r["id"]: r["group_id"] for r in planes.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made)], "vec_id long, embedding array<double>"), recall=0.99999).collect()}
    assert all((got[i] == got[i + 1]) == (i % 4 == 2) for i in range(0, 60, 2))


def test_planes_awkward(spark):
    schema = "vec_id long, embedding array<float>, id string, v int, group_id string"
    made = [(None, [1.0, 2.0]), (5, None), (6, []), (7, [float("nan"), 1.0]), (8, [0.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0])]
    got = planes.near_vectors(spark.createDataFrame([(*r, "x", 1, "y") for r in made], schema)).collect()
    assert sorted((r["id"], r["group_id"], r["size"], r["kept"]) for r in got) == [(1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True), (4, 4, 1, True)]
    assert planes.near_vectors(spark.createDataFrame([], schema)).count() == 0


# 9


def test_backoff_counts_beyond_32_bits():
    column = lambda v, kind: pa.array(v, kind)
    keys, counts = backoff._pack(np.array([5, 9], np.uint64)), backoff._squeezed(np.array([3 * 10**9, 7]))
    asked = pa.table({"part": column([0, 0], pa.int32()), "chunk": column([1, 2], pa.int32()), "n": column([1, 1], pa.int32()), "keys": column([keys] * 2, pa.binary()), "counts": column([counts] * 2, pa.binary())})
    for r in backoff._answer(2)((pa.scalar(0),), asked)["counts"].to_pylist():
        assert backoff._expanded(r).tolist() == [6 * 10**9, 14]


def test_consensus_overrules_a_page(spark):
    body = "<p>The main text of page {0}, of which there is quite a lot to read here.</p>" * 3
    page = "<html><body><div class='side'>{1}</div><div class='post x{0}'>" + body + "</div></body></html>"
    made = [(i, "http://User@Site.org:80/a", page.format(i, "menu " * (200 if i == 0 else 2))) for i in range(5)]
    got = {r["page_id"]: r for r in htmlpaths.extracted(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    assert all(r["host"] == "site.org" and r["agreed"] and r["path"] == "html>body>div.post.x#" for r in got.values())
    assert "menu" not in got[0]["text"] and got[0]["text"].startswith("The main text of page 0")


def test_nested_containers_are_extracted(spark):
    body = "<p>The main text of this page, of which there is quite a lot to read here.</p>" * 5
    nested = "<ul><li>item one<li>item two</ul><table><tr><td>cell a<td>cell b</table><blockquote>a quote</blockquote><pre>code()</pre><section><h2>head</h2><div>deep</div></section><nav>menu</nav>"
    page = f"<body><div class=side>side</div><article>{body}{nested}<p>The end.</p></article></body>"
    got = htmlpaths.extracted(spark.createDataFrame([(i, "http://x.y/", page) for i in range(3)], "page_id long, url string, html string")).collect()
    for r in got:
        lines = r["text"].split("\n")
        assert r["path"] == "body>article" and r["agreed"]
        assert lines[5:] == ["item one", "item two", "cell a", "cell b", "a quote", "code()", "head", "deep", "The end."]


def test_html_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    host = {r["page_id"]: r["host"] for r in htmlpaths.hosts(pages).collect()}
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    votes = Counter()
    for i, h in html.items():
        own = Counter()
        for c in htmlpaths.containers(h or ""):
            own[c.path] += c.score()
        for path, s in own.items():
            votes[host[i], path] += round(s / sum(own.values()) * 1e6) if s else 0
    best = Counter()
    for (h, _), n in votes.items():
        best[h] = max(best[h], n)
    won = {h: sorted(p for (g, p), n in votes.items() if g == h and n and n >= best[h] / 2) for h in best}
    assert {r["host"]: r["paths"] for r in htmlpaths.winning_paths(pages).collect()} == {h: p for h, p in won.items() if p}
    for r in htmlpaths.extracted(pages).collect():
        text = [t for c in htmlpaths.containers(html[r["page_id"]] or "") if c.path in won[r["host"]] and (t := c.text())]
        assert not r["agreed"] or r["text"] == "\n".join(text)


def test_reading_a_page_is_linear():
    def took(page):
        begun = time.process_time()
        found = htmlpaths.containers(page)
        for c in found:
            c.score(), c.path
        return time.process_time() - begun, found

    for make in (lambda n: "<a " * n, lambda n: "<div class='abcdefgh'>x" * n, lambda n: "<!x " * n, lambda n: "<div>" * n + "</section>" * n, lambda n: '<a b="' * n, lambda n: "<script " * n, lambda n: "<p class" + " " * n, lambda n: "<!-- " * n):
        small, large = took(make(5_000))[0], took(make(50_000))[0]
        assert large < 40 * max(small, 0.02)
    deep = took("<div class='abcdefgh'>x" * 50_000)[1]
    assert len(deep) == 50_001 and max(len(c.path) for c in deep[::1000]) < htmlpaths.DEEP * (htmlpaths.LONG + 1) + 20
    assert deep[10].path == ">".join(["div.abcdefgh"] * 10) and deep[300].path != deep[301].path
    wide = took("<div class='" + "c" * 5000 + "'>x")[1]
    assert len(wide[1].path) < 30


def test_consensus_on_a_megabyte_page(spark):
    deep = "<div class='abcdefgh'>x" * 50_000
    made = [(1, "http://x.y/", deep), (2, "http://x.y/", "<a " * 350_000), (3, "http://x.y/", "<p>" + "some text " * 100_000)]
    got = {r["page_id"]: r["text"] for r in htmlpaths.extracted(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    assert len(got) == 3 and len(got[3]) == 999_999


def test_pages_without_a_winning_path_use_their_best(spark):
    main = "<article class=main>" + "<p>Words of the main text of a page.</p>" * 9 + "</article>"
    odd = "<div class=a>short</div><div class=b>Here is what the odd page has to say, at some length.</div>"
    made = [(i, "http://x.y/", main) for i in range(5)] + [(9, "http://x.y/", odd)]
    got = {r["page_id"]: r for r in htmlpaths.extracted(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    assert (got[9]["agreed"], got[9]["path"], got[9]["text"]) == (False, "div.b", "Here is what the odd page has to say, at some length.")


def test_containers_equal_the_standard_parser(spark):
    """Paths and text of well-formed pages against the standard library's parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.stack, self.size, self.skip = [], Counter(), 0

        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style", "noscript", "template", "title"):
                self.skip += 1
            elif tag in htmlpaths._CONTAINERS:
                names = sorted({__import__("re").sub(r"\d+", "#", c.lower()) for c in (dict(attrs).get("class") or "").split()})
                self.stack.append(".".join([tag, *names]))

        def handle_endtag(self, tag):
            if tag in ("script", "style", "noscript", "template", "title"):
                self.skip -= 1
            elif tag in htmlpaths._CONTAINERS:
                self.stack.pop()

        def handle_data(self, data):
            if not self.skip and data.strip():
                self.size[">".join(self.stack)] += len(data.strip())

    seen = 0
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        reader = Reader()
        try:
            reader.feed(r["html"])
        except IndexError:  # not well-formed
            continue
        own = Counter()
        for c in htmlpaths.containers(r["html"]):
            own[c.path] += sum(len(__import__("html").unescape(p).strip()) for p in c.parts if isinstance(p, str))
        seen += 1
        assert {k for k, n in own.items() if n} == set(reader.size)
    assert seen > 20


def test_html_awkward(spark):
    schema = "page_id long, url string, html string, host string, paths string, path string"
    made = [(1, None, "<p>a</p>"), (2, "nonsense", None), (3, "http://x.y/", ""), (None, "http://x.y/", "<div><div><b>open text"), (4, "http://x.y/", "</div></div><div>" * 500 + "deep"), (5, "http://x.y/", "<script>only()</script><!-- never closed")]
    got = htmlpaths.extracted(spark.createDataFrame([(*r, "h", "p", "q") for r in made], schema)).collect()
    by = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 6 and by[1] == "a" and by[2] is None and by[3] == "" and by[5] == "" and by[4].endswith("deep")
    assert htmlpaths.extracted(spark.createDataFrame([], schema)).count() == 0


# 10


def test_mixing_meets_targets(spark):
    draw = np.random.default_rng(8)
    low, high = [f"l{i}" for i in range(60)], [f"h{i}" for i in range(60)]
    made = [(i, " ".join(draw.choice(high if i % 3 else low, draw.integers(5, 60))), "", "", 0) for i in range(900)]
    docs, known = spark.createDataFrame(made, DOCS), labels(spark, [(i, int(i % 3 > 0), 0) for i in range(600)])
    got = mixing.mixture(docs, known, {"high": 0.8, "low": 0.2}).toPandas()
    held = got[got.doc_id >= 600]
    assert ((held.p_high > 0.5) == (held.doc_id % 3 > 0)).mean() > 0.97
    a, b = (got.tokens * got.p_low * got.rate).sum(), (got.tokens * got.p_high * got.rate).sum()
    assert (got.rate >= 0).all() and b / (a + b) == pytest.approx(0.8, abs=1e-3)
    # rounding to copies keeps the expected totals
    assert (got.tokens * got.copies).sum() == pytest.approx((got.tokens * got.rate).sum(), rel=0.1)


def test_mixing_copies_keep_small_rates(spark, monkeypatch):
    n, tokens = 20000, 20
    pure = lambda i, low: float(low == (i % 20 > 0)) * 0.998 + 0.001
    scores = spark.createDataFrame([(i, tokens, *(pure(i, d == "low") for d in mixing.DOMAINS)) for i in range(n)], "doc_id long, tokens long, p0 double, p1 double")
    monkeypatch.setattr(mixing, "fit", lambda *_: mixing.Softmax(np.zeros((1, 2)), np.zeros((1, 2)), mixing.DOMAINS))
    monkeypatch.setattr(mixing, "scored", lambda *_: scores)
    got = mixing.mixture(None, None, {"high": 0.95, "low": 0.05}).toPandas()
    own = got[got.doc_id % 20 > 0]
    assert len(own) == 19000 and ((own.rate > 0) & (own.rate < 0.01)).all()
    for p in ("p_low", "p_high"):
        weight, part = tokens * got[p], got.rate % 1
        noise = np.sqrt((weight**2 * part * (1 - part)).sum())
        assert abs((weight * got.copies).sum() - (weight * got.rate).sum()) <= 3 * noise
    assert own.copies.sum() == pytest.approx(own.rate.sum(), abs=3 * np.sqrt(own.rate.sum()))


def test_solve_equals_dense_descent(spark):
    """Far-off targets, which clip most rates: they are met, with the rates of a dense descent that runs till it ends."""
    draw = np.random.default_rng(9)
    p, t = draw.dirichlet([0.3, 0.3, 0.3], 200), draw.integers(1, 100, 200)
    frame = spark.createDataFrame([(i, int(t[i]), *map(float, p[i])) for i in range(200)], "doc_id long, tokens long, p0 double, p1 double, p2 double")
    rated, goal, total = mixing.solve(frame, np.array([0.9, 0.09, 0.01]))
    a = (p * t[:, None]).T
    assert goal == pytest.approx(np.array([0.9, 0.09, 0.01]) * min(a.sum(1) / [0.9, 0.09, 0.01])) and total == pytest.approx(goal, rel=1e-3)
    r = np.array([x["rate"] for x in rated.orderBy("doc_id").collect()])
    assert (r >= 0).all() and a @ r == pytest.approx(total, rel=1e-9) and (r == 0).mean() > 0.3
    dense, step = np.ones(200), 1.0
    loss = lambda x: float((a @ x - goal) @ metric @ (a @ x - goal))
    metric = np.linalg.pinv(a @ p, rcond=1e-12)
    while np.abs(a @ dense - goal).max() > 1e-6 * goal.sum():
        live = (dense > 0) * t
        new = np.maximum(0, dense - step * p @ np.linalg.pinv((p * live[:, None]).T @ p, rcond=1e-12) @ (a @ dense - goal))
        step, dense = (min(1.0, 2 * step), new) if loss(new) < loss(dense) * (1 - 1e-3 * step) else (step / 2, dense)
    assert r == pytest.approx(dense, abs=1e-6)


def test_solve_ends_where_targets_are_out_of_reach(spark):
    frame = spark.createDataFrame([(i, 10, 0.6, 0.4) for i in range(50)], "doc_id long, tokens long, p0 double, p1 double")
    rated, goal, total = mixing.solve(frame, np.array([0.1, 0.9]))
    r = np.array([x["rate"] for x in rated.collect()])
    a = np.array([6.0, 4.0])
    assert r == pytest.approx(np.full(50, r[0])) and r[0] > 0 and total == pytest.approx(a * r.sum(), rel=1e-9) and abs(total - goal).max() > 1


def test_domain_posteriors_equal_naive_softmax():
    draw = np.random.default_rng(19)
    text = pa.array(["Some words here, some more", "", None, "één  twee! drie"])
    model = mixing.Softmax(draw.standard_normal((mixing._HASHED, 2)), draw.standard_normal((mixing._DENSE, 2)), mixing.DOMAINS)
    ids, offsets, dense = mixing.features(text)
    got = mixing.posteriors(model, ids, offsets, dense)
    for i, t in enumerate(text.to_pylist()):
        raw = (t or "").encode()
        words = common.word_hashes(pa.array([t], pa.string()))[0].tolist()
        x = [math.sqrt(raw.count(bytes([b])) / max(1, len(raw))) for b in range(256)] + [len(set(words)) / max(1, len(words)), 1.0]
        logit = [sum(f * model.dense[k, j] for k, f in enumerate(x)) + sum(model.hashed[w % mixing._HASHED, j] for w in words) / math.sqrt(max(1, len(words))) for j in range(2)]
        assert got[i, 1] == pytest.approx(1 / (1 + math.exp(logit[0] - logit[1])), rel=1e-9)


def test_mixing_awkward(spark):
    docs = awkward(spark)
    for known in ([], [(1, 1, 0), (5, 0, 1), (None, 1, 1), (4, None, 0), (4, 7, 0)]):
        got = mixing.mixture(docs, labels(spark, known)).collect()
        assert sorted(r["doc_id"] for r in got) == [1, 2, 3, 4, 5, 6, 7, 8] and all(r["rate"] >= 0 for r in got)
        out = mixing.mix_documents(docs, labels(spark, known))
        assert out.columns == docs.columns and out.where("doc_id IS NULL").count() == 2
    assert mixing.mix_documents(docs, labels(spark)).count() == 11
    assert mixing.mix_documents(docs.limit(0), labels(spark)).count() == 0
