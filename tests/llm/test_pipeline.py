"""The corpus pipeline: each stage on awkward tables, and the whole against its operators by hand."""

import pytest

import corpus_pipeline
from lodestone.llm import pieces

from ..compare import SF
from .test_operators import awkward, labels

BY_NAME = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    labels(spark, [(1, 1, 0), (5, 0, 1), (4, 0, 0)]).write.parquet(f"{at}/labels.parquet")
    return str(at)


@pytest.mark.parametrize("name", BY_NAME)
def test_stage_on_awkward_and_empty_tables(spark, folder, name):
    docs = awkward(spark)
    for own in (docs, docs.limit(0), docs.select("doc_id", "text", "lang", "source", "n_chars")):
        got = BY_NAME[name](spark, own, folder)
        got.collect()
        if name != "sentencepiece":
            assert got.dtypes == own.dtypes


def test_stages_take_effect(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        seen[name] = (docs, spark.read.parquet(f"{tmp_path}/{name}"))
        docs = seen[name][1]
    ids = {k: ({r["doc_id"] for r in a.select("doc_id").collect()}, {r["doc_id"] for r in b.select("doc_id").collect()}) for k, (a, b) in seen.items()}
    assert all(b <= a for a, b in ids.values())
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    gone = ids["toxicity"][0] - ids["toxicity"][1]
    assert len(gone & toxic) >= 0.5 * len(toxic & ids["toxicity"][0])
    texts = [r["text"].lower().split() for r in seen["simhash_near_dedup"][1].collect()]
    assert len({tuple(t) for t in texts}) == len(texts)
    before = {r["doc_id"]: r["text"] for r in seen["substring_dedup"][0].collect()}
    assert all(len(r["text"]) <= len(before[r["doc_id"]]) and r["n_chars"] == len(r["text"]) for r in seen["substring_dedup"][1].collect())
    v, last = pieces.load(), {r["doc_id"]: r["text"] for r in seen["mixing"][1].collect()}
    final = seen["sentencepiece"][1].collect()
    assert len(final) == seen["mixing"][1].count()
    assert all(pieces.decode(v, r["ids"]) == last[r["doc_id"]] for r in final)


def by_hand(spark, docs, known):
    """What run() should give for the small corpus below: each stage restated in plain Python over whole texts."""
    import re

    import numpy as np

    from lodestone.llm import mixing, simhash, toxicity

    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    # toxicity: the fitted model, scored by the naive convolution of test_operators
    from ..llm.test_operators import naive_score

    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    model = toxicity.fit(frame, known)
    left = []
    for r in docs:
        from lodestone.llm.common import word_hashes
        import pyarrow as pa

        hashed = word_hashes(pa.array([r[1]], pa.string()))[0].tolist()
        if not hashed or naive_score(model, hashed) < model.thresholds.get(r[2], model.thresholds[None]):
            left.append(r)
    # near copies: all pairs of signatures, by brute force
    frame = spark.createDataFrame(left, frame.schema)
    signed = simhash.signatures(frame).collect()
    bits = np.array([np.unpackbits(np.frombuffer(r["signature"], np.uint8)) for r in signed])
    near = (bits[:, None] != bits[None]).sum(2) <= simhash.MOST
    short = np.array([r["short"] for r in signed])
    same = (bits[:, None] != bits[None]).sum(2) == 0
    near = np.where(short[:, None] | short[None], same & (short[:, None] == short[None]), near)
    label = np.arange(len(signed))
    for _ in signed:
        label = np.array([label[near[i]].min() for i in range(len(signed))])
    ids = [r["doc_id"] for r in signed]
    dropped = {ids[i] for i in range(len(ids)) if min(ids[j] for j in range(len(ids)) if label[j] == label[i]) != ids[i]}
    left = [r for r in left if r[0] not in dropped]
    # repeated passages: each line is a unit here, of 25 words or more
    seen, cut = set(), []
    for r in sorted(left):
        kept = []
        for line in (r[1] or "").splitlines(True):
            key = tuple(words(line))
            if len(key) < 25 or key not in seen:
                kept.append(line)
            seen.add(key)
        text = "".join(kept)
        if text.strip() or not (r[1] or "").strip():
            cut.append((*r[:1], text if r[1] is not None else None, *r[2:4], len(text) if text != r[1] and r[1] is not None else r[4]))
    # mixing: copies by the rates of a dense descent are compared in test_operators; here the rates are asked for
    frame = spark.createDataFrame(cut, frame.schema)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixture(frame, known).collect()}
    return sorted((r[0], r[1]) for r in cut for _ in range(copies.get(r[0], 1)))


def test_run_equals_the_stages_by_hand(spark, tmp_path):
    import numpy as np

    draw = np.random.default_rng(21)
    line = lambda n, low=0, high=3000: " ".join(f"w{i}" for i in draw.integers(low, high, n))
    shared = line(60, 10**6, 2 * 10**6)
    docs, known = [], []
    for i in range(240):
        toxic, good = i % 6 == 0, i % 5 > 0
        text = "\n".join([line(40) + (" zorg blat" if toxic else "") + (" fine prose" if good else " dull stuff") for _ in range(3)])
        if i % 10 == 3:
            text += "\n" + shared
        docs.append((i, text, "en" if i % 2 else "de", "s", len(text)))
        if i % 4 < 3:
            known.append((i, int(good), int(toxic)))
    for i in (7, 8, 9):  # a copy and a near copy
        docs.append((300 + i, docs[i][1], docs[i][2], "s", docs[i][4]))
        docs.append((400 + i, docs[i][1].replace(" w", " changed w", 1), docs[i][2], "s", docs[i][4]))
    docs += [(500, None, "en", None, None), (501, "", None, None, 0), (502, "word " * 30000, "en", "s", 150000)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, known).write.parquet(f"{tmp_path}/labels.parquet")
    v = pieces.load()
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    back = sorted((r["doc_id"], None if r["restored"] is None else pieces.decode(v, r["ids"])) for r in got)
    want = by_hand(spark, docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert [i for i, _ in back] == [i for i, _ in want] and back == want
    kept = {i for i, _ in want}
    assert 100 < len(kept) < 240 and not kept & {i for i in range(0, 240, 6)} and not any(i > 300 for i in kept if i < 500)
    assert sum(shared in (t or "") for _, t in want) <= max(1, sum(i == min(i for i, t in want if shared in (t or "")) for i, _ in want))


def test_run_on_awkward_and_empty_tables(spark, tmp_path):
    for name, docs in (("awkward", awkward(spark)), ("empty", awkward(spark).limit(0)), ("plain", awkward(spark).select("doc_id", "text", "lang", "source", "n_chars"))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels(spark, [(1, 1, 0), (5, 0, 1), (4, 0, 0)]).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert (len(got) == 0) == (name == "empty")
        assert name == "empty" or {2, 3} <= {r["doc_id"] for r in got} and sum(r["doc_id"] is None for r in got) == 2


def test_copies_at_the_threshold_go(spark, monkeypatch):
    """Documents whose signatures differ in as many bits as near copies may, in the layout for 10^6 of them."""
    import numpy as np

    from lodestone.llm import simhash

    draw = np.random.default_rng(46)
    bits = draw.integers(0, 2, (2000, simhash.BITS)).astype(np.uint8)
    other = bits.copy()
    for x in other:
        x[draw.choice(simhash.BITS, simhash.MOST, replace=False)] ^= 1
    packed = [np.packbits(x, bitorder="little").tobytes() for x in np.concatenate([bits, other])]
    docs = spark.createDataFrame([(i, "", bytearray(x), False) for i, x in enumerate(packed)], "doc_id long, text string, signature binary, short boolean")
    large = simhash.layout(10**6)
    monkeypatch.setattr(simhash, "layout", lambda *n: large)
    monkeypatch.setattr(simhash, "signatures", lambda docs: docs)
    left = corpus_pipeline.without_copies(spark, docs, "")
    assert sorted(r["doc_id"] for r in left.select("doc_id").collect()) == list(range(2000))


def test_each_text_of_a_repeated_id_keeps_its_links(spark, tmp_path):
    """Of rows that share a doc_id, each text goes if it has a near copy with a lesser doc_id, and no other text goes with it."""
    import numpy as np

    draw = np.random.default_rng(47)
    text = lambda: " ".join(f"w{i}" for i in draw.integers(0, 10**6, 120))
    near = lambda t: t.replace(" w", " changed w", 1)
    a, b, c, d, e = (text() for _ in range(5))
    made = [(1, a), (2, near(a)), (2, b), (2, c), (3, near(b)), (4, near(c)), (5, d), (5, near(d)), (5, d), (6, e), (6, None), (7, near(e)), (7, None), (7, "?!")]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in made], "doc_id long, text string, lang string, source string, n_chars long")
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.without_copies(spark, docs, "").collect()]
    own = [r for r in left if r[0] == 5]
    assert sorted(own) in ([(5, d)] * 2, [(5, near(d))])
    assert sorted(map(str, (r for r in left if r[0] != 5))) == sorted(map(str, [(1, a), (2, b), (2, c), (6, e), (6, None), (7, None), (7, "?!")]))
