"""Operators on small tables written by hand, with values worked out by hand."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import assemble, blocks, catalog, chunking, code, dedup, evidence, generate, quality, retrieval
from lodestone.sources import files, sinks
from lodestone.streaming import incremental

PY = '''class Box:
    """Holds things."""

    def add(self, item, count=1):
        # keep it
        if count > 0:
            for i in range(count):
                self.items.append(item)
        return len(self.items)

    def __len__(self):
        return 0


def _hidden(a: int, *rest):
    return a
'''
R = "my.fun <- function(x, y = 2) {\n  if (x > y) {\n    x\n  }\n}\n.secret = function() { 1 }\n"
C = "struct Point {\n  int x;\n};\nstatic int add(int a, const char *b) {\n  if (a) { return 1; }\n  return 0;\n}\nvoid stop(void) {\n"
CPP = "class Shape {\n public:\n  double area(double w) {\n    return w;\n  }\n};\n"


def one(df):
    return df.collect()[0]


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_document_types_and_languages(spark):
    want = {"a/x.py": ("py", "code", "python"), "X.R": ("r", "code", "r"), "y.h": ("h", "default", "c"), "z.h++": ("h++", "default", "cpp"), "q.hh": ("hh", "default", "unknown"), "n.md": ("md", "protocol", "unknown"), "n.TXT": ("txt", "protocol", "unknown"), "s.key": ("key", "slides", "unknown"), "d.docx": ("docx", "default", "unknown"), "http://site.org": ("", "default", "unknown"), "http://site.org/a.ts?v=1.py": ("ts", "code", "unknown"), ".bashrc": ("", "default", "unknown"), "dir.d/file": ("", "default", "unknown")}
    df = spark.createDataFrame([(p,) for p in want], "path string").select("path", tx.extension(F.col("path")), tx.document_type(F.col("path")), tx.language(F.col("path")))
    assert {r[0]: tuple(r)[1:] for r in df.collect()} == want
    cut = spark.createDataFrame([("paper", "section"), ("code", "section"), ("slides", "slide"), ("web", "cell")], "k string, b string").select(tx.may_cut(F.col("k"), F.col("b")))
    assert [r[0] for r in cut.collect()] == [True, False, True, False]


def test_symbols(spark):
    rows = [("b.py", PY, "python"), ("m.R", R, "r"), ("p.c", C, "c"), ("s.cpp", CPP, "cpp"), ("n", None, "c"), ("o", "x", "unknown")]
    got = by(code.symbols(spark.createDataFrame(rows, "path string, source string, language string")), "path", "name")
    assert set(got) == {("b.py", n) for n in ("Box", "add", "__len__", "_hidden")} | {("m.R", n) for n in ("my.fun", ".secret")} | {("p.c", n) for n in ("Point", "add", "stop")} | {("s.cpp", n) for n in ("Shape", "area")}
    add = got["b.py", "add"]
    assert (add["type"], add["start_line"], add["end_line"], list(add["parameters"]), add["parent"]) == ("function", 4, 9, ["item", "count"], "Box")
    assert got["b.py", "_hidden"]["is_private"] and list(got["b.py", "_hidden"]["parameters"]) == ["a", "rest"] and got["b.py", "Box"]["end_line"] == 12
    assert list(got["m.R", "my.fun"]["parameters"]) == ["x", "y"] and got["m.R", "my.fun"]["end_line"] == 5 and got["m.R", ".secret"]["is_private"]
    assert list(got["p.c", "add"]["parameters"]) == ["a", "b"] and list(got["p.c", "stop"]["parameters"]) == [] and got["p.c", "Point"]["type"] == "struct"
    assert (got["s.cpp", "area"]["type"], got["s.cpp", "area"]["parent"]) == ("method", "Shape")


def test_metrics_importance_and_filters(spark):
    m = code.metrics(F.col("s"))
    r = one(spark.createDataFrame([("if (a) {\n  for (;;) { x }\n}\n# note\n\nelse if b",)], "s string").select(*[c.alias(k) for k, c in m.items()]))
    assert (r["conditionals"], r["loops"], r["depth"], r["lines"]) == (4, 1, 2, 5)  # if, else, if, and 'else if' once more
    assert r["comment_density"] == 0.2 and r["complexity"] == pytest.approx(2 * 4 + 2 * 1 + 3 * 2 + 0.1 * 5)
    rows = [("class", False, 5.0, ["a"], 20, "python", "Box", 100, 2, 3), ("function", True, 30.0, [], 60, "r", "__x", 0, 0, 0)]
    s = spark.createDataFrame(rows, "type string, is_private boolean, complexity double, parameters array<string>, lines int, language string, name string, doc int, comments int, calls int")
    got = [r[0] for r in s.select(code.importance(F.col("doc"), F.col("comments"), F.col("calls"))).collect()]
    assert got == [pytest.approx(10 + 5 + (3 + 1) + 1 + 1 + 0.5 + 0.3 + 2 + 1), pytest.approx(8 + 0 + 0 + 0 + 3 + 0 + 0 + 0 + 1.2 - 2)]
    keep = spark.createDataFrame([("python", False, 3, 30), ("python", True, 9, 90), ("java", False, 9, 90), ("c", False, 2, 90), ("r", False, 9, 29)], "language string, is_private boolean, lines int, tokens int").select(code.worth_keeping())
    assert [r[0] for r in keep.collect()] == [True, False, False, False, False]
    names = one(spark.createDataFrame([(PY,)], "s string").select(code.method_names(F.col("s"))))[0]
    assert names == ["add", "_hidden"]
    tiers = spark.createDataFrame([(9.9,), (10.0,), (25.0,), (50.0,)], "c double").select(code.tier(F.col("c")))
    assert [r[0] for r in tiers.collect()] == ["simple", "moderate", "complex", "very_complex"]


def test_bugs_and_versions(spark):
    source = "def f(a, b):\n    if a <= b and a:\n        return a\n    return b\n"
    rows = spark.createDataFrame([("p", "f", source, "python"), ("p", "g", "x", "python"), ("p", "h", None, "c")], "path string, name string, source string, language string")
    got = by(rows.select("name", generate.injected(F.col("source"), F.col("language"), F.lit(2)).alias("b")), "name")
    kinds = [b["bug_type"] for b in got["f"]["b"]]
    assert kinds == ["comparison", "logic"] and got["g"]["b"] == got["h"]["b"] == []
    assert got["f"]["b"][0]["buggy"] == source.replace("<=", "<") and got["f"]["b"][0]["line"] == 2
    assert got["f"]["b"][1]["buggy"] == source.replace("<=", "<").replace(" and ", " or ")
    made = by(generate.versions(rows), "task")
    assert set(made) == {"compare", "step_1", "step_2"}
    assert made["compare"]["original"] == source and made["step_2"]["original"] == made["step_1"]["buggy"] != made["step_2"]["buggy"]
    where = spark.createDataFrame([("a\nb\nc", "a\nx\nc"), ("a", "a")], "a string, b string").select(generate.changed_line(F.col("a"), F.col("b")))
    assert [r[0] for r in where.collect()] == [2, 0]
    names = one(spark.createDataFrame([("a = 1\nfor i in x:\n    b = a\n",)], "s string").select(generate.variable_names(F.col("s"))))[0]
    assert set(names) == {"a", "b", "i"}


def test_negatives_traps_and_task_counts(spark):
    s = spark.createDataFrame([("p", "f", "function", ["timeout"])], "path string, name string, type string, parameters array<string>")
    got = generate.negatives(s, per_symbol=10).collect()
    assert {r["negative_type"] for r in got} == {k for k, on, _ in generate.NEGATIVES if "function" in on.split(",")}
    assert all(r["trap"] is None or (r["trap"] != "timeout" and r["trap"] in r["question"]) for r in got)
    q = spark.createDataFrame([("How does the performance of `f` compare with the version that everybody used first?", "f", "performance_claim"), ("Why `g`?", "f", "nonexistent_method")], "q string, n string, k string")
    r = q.select(generate.traps(F.col("q"), F.col("n"), F.col("k")), generate.cues(F.col("q"), F.col("k"))).collect()
    assert list(r[0]) == [["real_name", "technical", "detailed", "asks_for_numbers"], ["outside_words", "comparison"]]
    assert list(r[1]) == [[], ["outside_words", "absent_element"]]
    assert generate.adversarial(s).count() == 2
    counts = spark.createDataFrame([("simple",), ("very_complex",), ("other",)], "t string").select("t", *generate.task_counts(F.col("t")))
    assert [tuple(r)[1:] for r in counts.collect()] == [(2, 1), (5, 3), (2, 1)]
    stats = {tuple(r) for r in generate.task_stats(s, "type", "name").collect()}
    assert stats == {("type", "function", 1), ("name", "f", 1)}
    shares = spark.createDataFrame([(1,), (20,), (100,)], "n int").select(generate.negative_share(F.col("n")))
    assert [r[0] for r in shares.collect()] == [1, 3, 15]


def test_answers_and_integration(spark):
    r = one(spark.createDataFrame([("x QUESTION: why? \nANSWER: so\nit is",)], "r string").select(*generate.parsed_answer(F.col("r"))))
    assert (r["question"], r["answer"]) == ("why?", "so\nit is")
    kinds = spark.createDataFrame([(["introduction", "conclusion"],), (["methods", "results"],), (["a", "b"],), (["a", "a"],)], "s array<string>").select(generate.integration_type(F.col("s")))
    assert [r[0] for r in kinds.collect()] == ["contextual", "sequential", "synthesis", "comparison"]


def test_markdown_pages_and_paragraphs(spark):
    md = "# A\nintro\n## B\nbody\n### C\n## B\nagain\n# D\nlast"
    docs = spark.createDataFrame([(1, "md", md), (2, "txt", "Introduction\n[PAGE 1]\nwords under it.\n"), (3, "md", "plain"), (4, None, None)], "doc_id long, doc_type string, text string")
    got = by(chunking.structured(docs), "doc_id", "section_no")
    assert [(got[1, n]["title"], got[1, n]["path"], got[1, n]["content"]) for n in range(1, 6)] == [("A", ["A"], "intro"), ("B", ["A", "B"], "body"), ("C", ["A", "B", "C"], ""), ("B", ["A", "B"], "again"), ("D", ["D"], "last")]
    assert got[3, 0]["content"] == "plain" and got[3, 0]["title"] is None and got[2, 1]["content"] == "words under it."
    heads = [(r["level"], r["line"]) for r in chunking.markdown_headings(docs.where("doc_id = 1")).orderBy("pos").collect()]
    assert heads == [(1, "A"), (2, "B"), (3, "C"), (2, "B"), (1, "D")]
    long = "A sentence of some twenty words that goes on for a while so that it has tokens enough to count here. " * 30
    parts = chunking.section_chunks(spark.createDataFrame([(1, "md", f"# One\n{long}\n# Two\n{long}")], "doc_id long, doc_type string, text string")).collect()
    assert {r["title"] for r in parts} == {"One", "Two"} and sorted(r["chunk_index"] for r in parts) == list(range(len(parts))) and all(150 <= r["token_count"] <= 650 for r in parts)
    pages = spark.createDataFrame([(1, 0, "a [PAGE 1] b"), (1, 1, "c"), (1, 2, "[PAGE 2] [PAGE 3]"), (2, 0, "none")], "doc_id long, chunk_index int, text string")
    assert {k: r["page"] for k, r in by(chunking.page_numbers(pages), "doc_id", "chunk_index").items()} == {(1, 0): 1, (1, 1): 1, (1, 2): 3, (2, 0): None}


def test_packers():
    s = ["x" * 39 + "."] * 10  # 10 tokens each
    assert chunking.packed(s, 30, 40, 10) == [" ".join(s[:3])] * 4 + [" ".join(s[:2])]  # three sentences make 30; each chunk repeats the last of the one before
    assert chunking.packed(["y" * 400, "z" * 8], 30, 40, 10) == ["y" * 400, "z" * 8]
    assert chunking.packed([], 30, 40, 10) == []
    assert chunking.packed_paper(["x" * 40] * 3, target=100, most=100, least=31) == [] and len(chunking.packed_paper(["x" * 40] * 3, target=100, most=100, least=30)) == 1
    assert chunking.packed_paper(["tiny"] * 500) == []


def test_chunk_filter_edges(spark):
    texts = ["a" * 119, "a" * 120, "a" * 2403, "a" * 2404, "é" * 60 + "a" * 140, "é" * 61 + "a" * 139, "1" * 101 + "a" * 19, "1" * 100 + "a" * 20, None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tx.passes_chunk_filter(F.col("t"))).collect()]
    assert got == [False, True, True, False, True, False, False, True, False]


def test_sentences_and_spans(spark):
    text = "One sentence stands here.  Another one follows it!\nThe last."
    got = evidence.sentence_offsets(spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string"), "id").collect()
    mine = sorted((r["start"], r["end"], r["sentence"]) for r in got if r["id"] == 1)
    assert [s for *_, s in mine] == ["One sentence stands here.", "Another one follows it!", "The last."] and all(text[a:b] == s for a, b, s in mine)
    assert [tuple(r)[1:] for r in got if r["id"] == 3] == [(0, "", 0, 0)] and not any(r["id"] == 2 for r in got)
    spans = spark.createDataFrame([(1, 0, 10, "a", 0.5), (1, 20, 30, "b", 0.9), (1, 41, 50, "c", 0.7), (1, 42, 45, "d", 0.8), (1, 41, 50, "c", 0.7)], "id long, start int, end int, text string, confidence double")
    assert sorted(tuple(r) for r in evidence.merge_spans(spans).select("start", "end", "text", "confidence").collect()) == [(0, 30, "a", 0.9), (41, 50, "c", 0.8)]  # gaps of 10 and 11
    marked = one(spark.createDataFrame([("abcdef", [(4, 5), (0, 2)])], "t string, s array<struct<start:int,end:int>>").select(evidence.highlight(F.col("t"), F.col("s"))))[0]
    assert marked == "**ab**cd**e**f"
    ok = spark.createDataFrame([(0, 2, "ab"), (0, 9, "ab"), (3, 3, ""), (1, 3, "ab")], "a int, b int, t string").select(evidence.valid_span(F.col("a"), F.col("b"), F.col("t"), F.lit("abcdef")))
    assert [r[0] for r in ok.collect()] == [True, False, False, False]


def test_claims_and_verification(spark):
    answers = spark.createDataFrame([(1, "Sales rose 12 percent in 3 years. Ada Lovelace wrote to Charles Babbage. Rain causes floods here. Nothing much."), (2, "Short.")], "answer_id long, text string")
    got = {(r["kind"], r["claim"]) for r in evidence.claims(answers).collect()}
    assert ("numeric", "12 percent") in got and ("numeric", "3 years") in got
    assert ("entity", "Ada Lovelace wrote to Charles Babbage.") in got and ("relationship", "Rain causes floods here.") in got
    pairs = [(1, "Ada Lovelace wrote the first program", "entity", 7, "the first program was written by ada lovelace herself"), (1, "Ada Lovelace wrote the first program", "entity", 8, "nothing in common"), (2, "Rain causes floods", "relationship", 7, "rain often causes floods"), (3, "of it", "numeric", 8, "of it")]
    checked = by(evidence.verified(spark.createDataFrame(pairs, "claim_id long, claim string, kind string, id long, text string")), "claim_id")
    # words: ada lovelace wrote the first program, of which 'wrote' is missing; the entity is there
    assert checked[1]["is_verified"] and checked[1]["best"] == pytest.approx(0.6 * 5 / 6 + 0.4) and checked[1]["citations"] == "7" and checked[1]["method"] == "entity"
    assert checked[2]["is_verified"] and checked[2]["best"] == pytest.approx(0.8) and checked[2]["method"] == "lexical"
    assert not checked[3]["is_verified"] and checked[3]["citations"] == "" and checked[3]["method"] == "none"
    told = by(evidence.report(spark.createDataFrame([(1, "numeric", True)] * 4 + [(1, "entity", False), (2, "numeric", False)], "answer_id long, kind string, is_verified boolean")), "answer_id")
    assert (told[1]["status"], told[1]["score"], told[1]["guidance"]) == ("passed", 0.8, "Verify named entities") and told[2]["regenerate"]
    best = spark.createDataFrame([("rain floods", "Sun shines. Rain floods the town. Rain falls."), ("zzz", "Sun shines.")], "c string, t string").select(evidence.supporting_sentence(F.col("c"), F.col("t")))
    assert [r[0] for r in best.collect()] == ["Rain floods the town.", "Sun shines...."]
    cites = one(spark.createDataFrame([("See line 3 and lines 4-7; `x = 1` but not `y`. Line 3.", "a\nx = 1\n")], "a string, s string").select(evidence.answer_citations(F.col("a"), F.col("s"))))[0]
    assert cites == ["line 3", "line 4-7", "code: x = 1"]


def test_claims_everywhere_equal_all_pairs(spark):
    claims = spark.createDataFrame([(1, "amber falcons circle above harbours", "numeric"), (2, "copper lanterns", "relationship"), (3, "of it", "numeric"), (4, "zzz yyy", "numeric")], "claim_id long, claim string, kind string")
    texts = spark.createDataFrame([(7, "Amber falcons circle above some harbours today."), (8, "The copper lanterns glow."), (9, None), (10, "copper"), (11, "falcons above")], "id long, text string")
    plain = lambda df: sorted(map(tuple, df.collect()))
    assert plain(evidence.verified_everywhere(claims, texts)) == plain(evidence.verified(texts.crossJoin(claims)))


def test_vectors_blocks_and_leaders(spark):
    draw = np.random.default_rng(2)
    x = draw.standard_normal((70, 6))
    x[5] = 0
    x[10] = x[11]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None), (98, [])], "id long, v array<float>")
    f = x.astype(np.float32).astype(float)
    unit = f / np.where(np.linalg.norm(f, axis=1, keepdims=True) > 0, np.linalg.norm(f, axis=1, keepdims=True), 1)
    cos = np.round(unit @ unit.T, 9)
    got = {}
    for r in retrieval.dense(rows, rows.select(F.col("id").alias("query_id"), "v"), 4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    for i in range(70):
        want = sorted(range(70), key=lambda j: (-cos[i, j], j))[:4]
        assert {j for _, j in got[i]} == set(want) or cos[i, want[3]] == pytest.approx(cos[i, sorted(j for _, j in got[i])[-1]], abs=2e-9)
    pairs = {(r["a"], r["b"]) for r in dedup.similar_pairs(rows, 0.6).collect()}
    assert pairs == {(i, j) for i in range(70) for j in range(i + 1, 70) if cos[i, j] >= 0.6} and (10, 11) in pairs
    assert blocks.pairs(rows.limit(0), 0.5).count() == 0 and retrieval.dense(rows.limit(0), rows.select(F.col("id").alias("query_id"), "v"), 3).count() == 0
    assert retrieval.apart(np.array([[1.0, 0], [0.99, 0.1], [0, 1], [0, 0], [0, 0]]), 0.85) == [0, 2, 3, 4]
    chain = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 2, [0.95, 0.3122]), (3, 3, [0.8, 0.6])], "id long, pos long, v array<double>")
    lead = by(dedup.leader_clusters(chain, 0.92), "id")  # 1 and 2 are near, 2 and 3 too, but 3 isn't near the leader 1
    assert [(lead[i]["leader"], lead[i]["size"]) for i in (1, 2, 3)] == [(1, 2), (1, 2), (3, 1)]


def test_fusion_ties_and_k(spark):
    lists = spark.createDataFrame([("q", "dense", 1, 0.9, 1), ("q", "dense", 2, 0.9, 2), ("q", "sparse", 2, 3.0, 1), ("q", "sparse", 3, 1.0, 2), ("r", "dense", 1, 0.5, 1)], "query_id string, method string, id long, score double, rank int")
    assert [(r["id"], r["score"]) for r in retrieval.reciprocal_rank(lists).where("query_id = 'q'").orderBy("rank").collect()] == [(2, pytest.approx(1 / 62 + 1 / 61)), (1, pytest.approx(1 / 61)), (3, pytest.approx(1 / 62))]
    linear = by(retrieval.linear_fusion(lists, {"dense": 0.6, "sparse": 0.4}).where("query_id = 'q'"), "id")
    assert {i: r["score"] for i, r in linear.items()} == {1: 0.6, 2: 1.0, 3: 0.0}  # a constant list counts as 1
    ranks = by(retrieval.rank_sum(lists, 2, 5).where("query_id = 'q'"), "id")
    assert {i: r["score"] for i, r in ranks.items()} == {1: -7.0, 2: -3.0, 3: -8.0}
    shared = one(retrieval.overlap(lists))
    assert (shared["shared"], shared["either"], shared["jaccard"], shared["overlap_ratio"]) == (1, 3, pytest.approx(1 / 3), 0.5)
    tails = [("flat", 0.5, i) for i in range(1, 11)] + [("steep", 1 - i / 11, i) for i in range(1, 11)] + [("short", 0.5, i) for i in range(1, 5)]
    fused = spark.createDataFrame([(q, i, s, i) for q, s, i in tails], "query_id string, id long, score double, rank int")
    asked = spark.createDataFrame([("flat", "plain"), ("steep", "alpha versus beta"), ("short", "plain"), ("none", "difference between both")], "query_id string, query string")
    k = by(retrieval.adaptive_k(fused, asked, 10), "query_id")
    assert {q: (r["k"], r["compares"], r["flat_tail"]) for q, r in k.items()} == {"flat": (20, False, True), "steep": (20, True, False), "short": (10, False, False), "none": (20, True, False)}
    assert retrieval.configured("technical", k=5, unknown=1) == retrieval.SearchConfig(k=5, dense_k=30, sparse_k=20, expand=True, expansions=3, fusion="linear", dense_weight=0.7, sparse_weight=0.3)
    assert retrieval.configured().depth == 30 and retrieval.configured(rerank=False).depth == 20


def test_search_end_to_end(spark):
    words = ["amber falcons circle", "copper lanterns glow", "silver rivers run", "quiet forests sleep", "amber lanterns"]
    chunks = spark.createDataFrame([(i, f"{w} number {i}. The {w} are described here at length.", f"s{i}", "intro" if i % 2 else None) for i, w in enumerate(words * 3)], "id long, text string, source string, section string")
    queries = spark.createDataFrame([(1, "amber falcons"), (2, "difference between copper lanterns"), (3, "zzz")], "query_id long, query string")
    got = retrieval.search(chunks, queries, retrieval.configured("research", k=2, diversity=1.0)).collect()
    mine = {q: sorted((r["rank"], r["id"]) for r in got if r["query_id"] == q) for q in (1, 2, 3)}
    assert [i % 5 for _, i in mine[1]] == [0] * len(mine[1]) and 2 <= len(mine[1]) <= 4 and len(mine[2]) == 4 and {i % 5 for _, i in mine[2][:3]} == {1}
    first = next(r for r in got if r["query_id"] == 1 and r["rank"] == 1)
    assert first["score"] == 1.0 and first["source"] == f"s{first['id']}" and first["section"] == ("intro" if first["id"] % 2 else "N/A") and first["page"] == "N/A"
    assert first["spans"] and all(first["text"][s["start"] : s["end"]] == s["text"] for s in first["spans"])
    assert all(r["k"] == 4 for r in got if r["query_id"] == 2) and all(r["added_terms"] >= 0 for r in got)
    close = retrieval.search(chunks, queries, retrieval.configured(k=3, diversity=0.7, auto_k=False)).where("query_id = 1").collect()
    assert len({r["id"] % 5 for r in close}) == len(close)  # near copies of a kept hit are left out
    none = retrieval.search(chunks.limit(0), queries)
    assert none.count() == 0 and retrieval.search(chunks, queries.limit(0)).count() == 0


def test_expansion_and_cache(spark):
    found = spark.createDataFrame([(1, "Copper: lanterns glow, the night", 1), (1, "ignored below rank three", 9)], "query_id long, text string, rank int")
    q = spark.createDataFrame([(1, "lanterns at night")], "query_id long, query string")
    terms = [r["term"] for r in retrieval.expansion_terms(found, q, tx.letter_counts, count=5).collect()]
    assert set(terms) == {"copper", "glow"}  # not the query's words, nor stop-words, nor short ones
    assert one(retrieval.expanded(q, retrieval.expansion_terms(found, q, tx.letter_counts)))["query"].startswith("lanterns at night ")
    chunks = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, text string")
    cache = chunks.where("text = 'a'").select(F.sha2("text", 256).alias("hash"), F.array(F.lit(7.0)).alias("v")).distinct()
    got = by(retrieval.with_cache(chunks, cache, lambda c: F.array(F.length(c).cast("double"))), "id")
    assert {i: r["v"] for i, r in got.items()} == {1: [7.0], 2: [1.0], 3: [7.0]}
    assert retrieval.cache_misses(chunks, cache).count() == 1


def test_snapshots(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x"), ("b", None)], "doc_id string, text string")
    s = retrieval.snapshot(docs, "m").withColumn("snapshot_id", F.lit("s1")).withColumn("timestamp", F.lit("t")).withColumn("chunk_count", F.lit(3).cast("long"))
    sinks_path = str(tmp_path / "snaps")
    s.select("snapshot_id", "timestamp", "model", "doc_count", "chunk_count", "doc_hashes").write.mode("append").json(sinks_path)
    s.withColumn("snapshot_id", F.lit("s2")).select("snapshot_id", "timestamp", "model", "doc_count", "chunk_count", "doc_hashes").write.mode("append").json(sinks_path)
    back = one(files.latest_snapshot(spark, sinks_path))
    assert back["snapshot_id"] == "s2" and back["doc_count"] == 2 and back["doc_hashes"]["b"].startswith("ERROR") and len(back["doc_hashes"]["a"]) == 64
    a = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "doc_id string, hash string")
    b = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "doc_id string, hash string")
    assert {r["doc_id"]: r["change"] for r in retrieval.hash_diff(a, b).collect()} == {"b": "changed", "c": "missing_in_b", "d": "missing_in_a"}


def test_saved_index_answers_like_the_texts(spark, tmp_path):
    chunks = spark.createDataFrame([(f"c{i}", t, "s") for i, t in enumerate(["amber falcons circle the town", "copper lanterns glow", "amber lanterns", "", "falcons falcons falcons"])], "chunk_id string, text string, source_path string")
    folder = str(tmp_path / "index")
    sinks.save_index(chunks, folder)
    q = spark.createDataFrame([(1, "amber falcons"), (2, "lanterns")], "query_id long, query string")
    want = sorted(map(tuple, retrieval.bm25(chunks, q, 3, "chunk_id").collect()))
    assert want and sorted(map(tuple, sinks.search_index(spark, folder, q, 3).collect())) == want
    idf = by(files.index(spark, folder, "idf"), "term")
    assert idf["amber"]["df"] == 2 and idf["amber"]["idf"] == pytest.approx(np.log(1 + (5 - 2 + 0.5) / 2.5))
    sinks.save_vectors(spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id long, v array<double>"), folder)
    assert {r["id"]: r["v"] for r in files.index(spark, folder, "vectors").collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0]}
    sinks.clone_index(spark, folder, str(tmp_path / "copy"))
    assert files.index(spark, str(tmp_path / "copy"), "chunks").count() == 5
    sinks.clear_index(spark, folder)
    assert files.index(spark, folder, "postings").count() == 0 and files.stage_done(spark, f"{folder}/chunks")


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# Grüße\n", encoding="utf-8")
    (tmp_path / "b.txt").write_bytes("Grüße".encode("latin-1"))
    (tmp_path / "sub" / "c.py").write_text("x = 1\n")
    (tmp_path / "run.log").write_text("Epoch 1.0\nStep 5/10\n'loss': 0.5\nStep 8/10 loss: 0.25\nError: bad\n")
    found = {r["path"].rpartition("/")[2]: r for r in files.discover(spark, str(tmp_path)).collect()}
    assert {k: (r["doc_type"], r["language"]) for k, r in found.items()} == {"a.md": ("protocol", "unknown"), "b.txt": ("protocol", "unknown"), "c.py": ("code", "python")} and found["c.py"]["size"] == 6
    text = {r["path"].rpartition("/")[2]: (r["text"], r["encoding"]) for r in files.texts(spark, str(tmp_path)).collect()}
    assert text == {"a.md": ("# Grüße\n", "utf-8"), "b.txt": ("Grüße", "latin-1")}
    assert [r["source"] for r in files.code(spark, str(tmp_path)).collect()] == ["x = 1\n"]
    lines = files.log_lines(spark, str(tmp_path / "run.log"))
    m = one(catalog.log_metrics(lines))
    assert (m["step"], m["steps"], m["progress"], m["epoch"], m["min_loss"], m["last_loss"], m["last_losses"], m["failed"]) == (8, 10, 80.0, 1.0, 0.25, 0.25, [0.5, 0.25], True)
    assert files.tail(lines, 2).count() == 2
    names = by(files.collision_free(spark.createDataFrame([("a.txt", 1), ("a.txt", 2), ("b", 3), ("a.txt", 4)], "name string, seq int")), "seq")
    assert [names[i]["stored"] for i in (1, 2, 3, 4)] == ["a.txt", "a_1.txt", "b", "a_2.txt"]
    pages = spark.createDataFrame([("p", 1, "x" * 50), ("p", 2, None), ("q", 1, "y" * 100)], "path string, page int, text string")
    assert {r["path"]: r["scanned"] for r in files.is_scanned(pages).collect()} == {"p": True, "q": False}
    now = F.lit("2026-01-02 00:00:00").cast("timestamp")
    s = spark.createDataFrame([("old", "2025-12-31 23:59:59"), ("new", "2026-01-01 00:00:00")], "id string, t string").select("id", F.col("t").cast("timestamp").alias("updated_at"))
    assert [r["id"] for r in files.unexpired(s, now).collect()] == ["new"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("qa", "train", "x"), ("qa", "val", "y"), ("debug", "train", "z")], "kind string, split string, text string")
    sinks.save_splits(rows, str(tmp_path / "splits"))
    assert spark.read.json(str(tmp_path / "splits/kind=qa/split=val")).collect()[0]["text"] == "y"
    sinks.json_lines(rows, str(tmp_path / "lines"))
    assert sum(1 for p in (tmp_path / "lines").glob("*.json") for x in p.read_text().splitlines() if json.loads(x)) == 3
    sinks.export_symbols(spark.createDataFrame([("f", ["a", "b"])], "name string, parameters array<string>"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()[0]["parameters"] == "a;b"
    with pytest.raises(ValueError):
        sinks.export_symbols(rows, str(tmp_path / "x"), "xml")
    (tmp_path / "1.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    (tmp_path / "2.jsonl").write_text('{"a": 3}\n')
    assert sinks.joined_lines(spark, [str(tmp_path / "1.jsonl"), str(tmp_path / "2.jsonl")], str(tmp_path / "all")) == 3
    docs = spark.createDataFrame([("d", "p", "code", "t", 1, 2, "more")], "doc_id string, source_path string, doc_type string, title string, page_count int, chunk_count int, x string")
    sinks.save_documents(docs, str(tmp_path / "docs"))
    assert spark.read.json(str(tmp_path / "docs")).columns == sorted(["doc_id", "source_path", "doc_type", "title", "page_count", "chunk_count"])
    sinks.append_cache(spark.createDataFrame([("ab1", [1.0])], "hash string, v array<double>"), str(tmp_path / "cache"))
    assert spark.read.parquet(str(tmp_path / "cache")).collect()[0]["prefix"] == "ab"


def test_catalog(spark):
    log = spark.createDataFrame([(1, 1, "A", None), (1, 2, None, "draft"), (1, 3, "B", None), (2, 1, None, None)], "id long, at long, title string, status string")
    s = by(catalog.project_state(log, "id", ("title", "status"), "at"), "id")
    assert (s[1]["title"], s[1]["status"], s[1]["created_at"], s[1]["updated_at"]) == ("B", "draft", 1, 3) and s[2]["title"] is None
    p = spark.createDataFrame([(1, True), (2, True), (3, None)], "id long, rag_completed boolean")
    held = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    a = by(catalog.availability(p, held(1, 1), held(2, 3)), "id")
    assert {i: (r["has_model"], r["has_rag"]) for i, r in a.items()} == {1: (True, False), 2: (False, True), 3: (False, False)}
    d = spark.createDataFrame([(1, "A", "old", None, 1), (1, "A", "new", '["r"]', 2), (1, "B", "b", "broken", 1)], "project_id long, section string, content string, citations string, version int")
    drafts = one(catalog.drafts_by_section(d))["drafts"]
    assert drafts["A"].asDict() == {"content": "new", "citations": ["r"], "version": 2} and drafts["B"]["citations"] == []
    projects = spark.createDataFrame([(1, False, False, False), (2, True, True, True)], "project_id long, rag_completed boolean, data_generation_completed boolean, training_completed boolean")
    done = spark.createDataFrame([(1, "data_generation")], "project_id long, pipeline string")
    marked = catalog.marked_complete(projects, done)
    jobs = spark.createDataFrame([(1, "j1", "rag", "running", 1), (1, "j2", "rag", "failed", 2), (1, "j3", "training", "pending", 1)], "project_id long, job_id string, job_type string, status string, created_at long")
    st = by(catalog.project_status(marked, jobs), "project_id")
    assert (st[1]["active"], st[1]["last_rag"], st[1]["last_training"], st[1]["can_training"], st[1]["can_chat"], st[1]["missing_grant"]) == (2, "failed", "pending", True, False, ["rag", "training"])
    assert st[2]["active"] == 0 and st[2]["can_grant"] and st[2]["last_rag"] is None
    with pytest.raises(Exception, match="unknown pipeline"):
        catalog.marked_complete(projects, spark.createDataFrame([(1, "x")], "project_id long, pipeline string")).collect()
    states = spark.createDataFrame([("j1", "t1", "running", 10, 1), ("j1", "t1", "completed", 100, 2), ("j2", "t2", "running", 5, 1)], "job_id string, task_id string, status string, progress int, created_at long")
    assert [(r["status"], r["progress"]) for r in catalog.job_by_task(states, spark.createDataFrame([("t1",)], "task_id string")).collect()] == [("completed", 100)]
    missing = one(spark.createDataFrame([(["chunks", "x"],)], "f array<string>").select(catalog.missing_files(F.col("f"))))[0]
    assert missing == ["postings", "stats"]


def test_quality(spark):
    raw = ['{"groundedness": 0.8, "clarity": 1}', 'so: {"groundedness": 0.5} ok', '"groundedness": 0.25, and "clarity": .', "none", None]
    got = [tuple(r)[:1] + (r["clarity"],) for r in spark.createDataFrame([(x,) for x in raw], "r string").select(*quality.parsed_scores(F.col("r"))).collect()]
    assert got == [(0.8, 1.0), (0.5, 0.0), (0.25, 0.0), (0.0, 0.0), (0.0, 0.0)]
    row = spark.createDataFrame([(0.9, 0.4, 0.6, 0.7, 0.5, 0.5)], ", ".join(f"{f} double" for f in quality.FIELDS))
    assert one(row.select(quality.overall(*[F.col(f) for f in quality.FIELDS])))[0] == pytest.approx(0.27 + 0.08 + 0.12 + 0.105 + 0.05 + 0.025)
    told = one(row.select(*quality.feedback(F.lit(0.65), F.lit(False), F.lit(False))))
    assert len(told["strengths"]) == 1 and len(told["weaknesses"]) == len(told["suggestions"]) == 2 and told["verdict"] == "good"
    outside = ["It is typically so.", "See documentation for more.", "As we know, it holds.", "NOT_IN_CONTEXT, usually", "plain"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in outside], "t string").select(quality.external_knowledge(F.col("t"))).collect()] == [True, True, False, False, False]
    facts = one(spark.createDataFrame([(["line 1", "code: x", "other"], "Sum of the items", "the items add up")], "c array<string>, a string, s string").select(*quality.citation_facts(F.col("c"), F.col("a"), F.col("s"))))
    assert tuple(facts) == (True, 3, 1, 1, 0.5)
    needs = spark.createDataFrame([("Please ELABORATE",), ("shorten it",), ("recovery",)], "t string").select(quality.needs_context(F.col("t")))
    assert [r[0] for r in needs.collect()] == [True, False, True]
    kept = quality.grounded(spark.createDataFrame([("yes",), ("NOT_IN_CONTEXT",), (None,)], "answer string"))
    assert [r[0] for r in kept.collect()] == ["yes"]
    rubric = spark.createDataFrame([("Background", "Short."), ("Background", "There is a gap. " * 20), ("Specific Aims", "Aim 1 is set. " * 160), ("Objectives", "nothing to see. " * 20)], "s string, t string").select(quality.five_point(F.col("s"), F.col("t")))
    assert [r[0] for r in rubric.collect()] == [1.0, 5.0, 4.5, 4.0]
    scored = quality.evaluated(spark.createDataFrame([(1,)], "i int"), lambda r: r.withColumns({f: F.lit(0.8) for f in quality.FIELDS}))
    assert one(scored)["passes"] and one(scored)["overall"] == 0.8


def test_assembly(spark):
    symbols = spark.createDataFrame([("p", "f"), ("p", "g")], "path string, name string")
    qa = spark.createDataFrame([("p", "f", "q?", "a")], "path string, name string, question string, answer string")
    debug = spark.createDataFrame([], "path string, name string, prompt string")
    nested = assemble.entries(symbols, qa, debug).collect()
    assert len(nested) == 1 and nested[0]["qa_pairs"][0]["question"] == "q?"
    rows = spark.createDataFrame([("p", "ctx", [("q1", "a1"), ("", "a2"), ("q3", None)])], "path string, context string, qa_pairs array<struct<question:string,answer:string>>")
    made = assemble.examples(rows, form="paper").collect()
    assert len(made) == 1 and [m["role"] for m in made[0]["messages"]] == ["system", "user", "assistant"] and made[0]["metadata"] == {"path": "p", "form": "paper", "position": "0"}
    assert made[0]["messages"][1]["content"] == "Context:\nctx\n\nQuestion: What follows is from a paper. q1"
    context = one(assemble.numbered_context(spark.createDataFrame([(1, 2, "B", "tb"), (1, 1, "A", "ta")], "query_id long, rank int, citation string, text string")))
    assert context["context"] == "[1] A\nta\n\n[2] B\ntb"
    neg = one(assemble.negatives_as_qa(spark.createDataFrame([("p", "f", "q")], "path string, name string, question string")))
    assert neg["answer"] == "NOT_IN_CONTEXT" and neg["is_negative"]
    kept = one(assemble.budgeted(spark.createDataFrame([(1, 1, "aaaa"), (1, 2, "bbbb"), (1, 3, "cc")], "id long, n int, t string"), "id", "n", "t", 9))
    assert kept["context"] == "aaaa\nbbbb"
    forms = spark.createDataFrame([("Ann Lee. On x (1999)",), ("On x (1999)",), ("my_file.pdf",), ("Some source",)], "s string").select(tx.mla(F.col("s")))
    assert [r[0] for r in forms.collect()] == ["Ann Lee. On x. 1999.", "On x. 1999.", '"my file." Document.', "Some source."]


def test_filters_and_stats(spark):
    now = F.lit("2026-01-31").cast("timestamp")
    c = spark.createDataFrame([(1, 0.5, "2026-01-30", "pdf", "intro"), (2, 0.3, "2026-01-30", "pdf", None), (3, 0.9, "2025-01-01", "pdf", None), (4, 0.9, "2026-01-30", "html", None), (5, None, "2026-01-30", "pdf", None), (6, 0.9, "2026-01-30", "pdf", "references")], "id int, quality double, t string, doc_type string, section string").withColumn("updated_at", F.col("t").cast("timestamp"))
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(retrieval.filtered(c, 0.4, now, 30, ("pdf",), ("references",))) == [1] and ids(retrieval.filtered(c, None)) == [1, 2, 3, 4, 5, 6] and ids(retrieval.filtered(c)) == [1, 2, 3, 4, 6]
    s = one(retrieval.search_stats(spark.createDataFrame([(1.0, 2, 0, False, 3, 1), (3.0, 4, 2, True, 0, 0)], "seconds double, words int, added_terms int, raised boolean, hits int, misses int")))
    assert (s["searches"], s["mean_seconds"], s["mean_added_terms"], s["raised"], s["hit_rate"]) == (2, 2.0, 2.0, 1, 0.75)
    p = retrieval.paragraph_hits(spark.createDataFrame([(1, "aaa bbb\n\n\n\nzzz\n\n aab ")], "doc_id long, text string"), spark.createDataFrame([(9, "aaa")], "query_id long, query string"), tx.letter_counts, 2).orderBy("rank").collect()
    assert [(r["text"], r["rank"]) for r in p] == [("aab", 1), ("aaa bbb", 2)]


def test_streaming(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("2026-01-01 00:00:00", "a"), ("2026-01-01 00:00:01", "a"), ("2026-01-01 00:00:02", "b")], "ts string, text string").select(F.col("ts").cast("timestamp").alias("ts"), "text").write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, text string").parquet(source)
    query = incremental.index_incrementally(incremental.new_texts(stream), str(tmp_path / "out"), str(tmp_path / "ck"), lambda b: b.select("text"))
    query.awaitTermination(120)
    assert sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "out/chunks")).collect()) == ["a", "b"]
    e = spark.createDataFrame([(1, "2026-01-01 00:00:00"), (1, "2026-01-01 00:20:00"), (1, "2026-01-01 01:00:00"), (2, "2026-01-01 00:00:00")], "user_id long, t string").select("user_id", F.col("t").cast("timestamp").alias("ts"))
    assert sorted((r["user_id"], r["n"]) for r in incremental.sessions(e).collect()) == [(1, 1), (1, 2), (2, 1)]
