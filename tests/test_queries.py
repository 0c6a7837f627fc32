"""Every query that SQL can state against DuckDB, and the others' contracts."""

import numpy as np
import pytest

from lodestone.operators import catalog, evidence
from lodestone.plans import QUERIES, SQL

from .compare import SF, rows, sql_rows


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert rows(QUERIES[name](spark, SF)) == sql_rows(SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_alike_twice(spark, name):
    first = rows(QUERIES[name](spark, SF))
    assert first[1] and first == rows(QUERIES[name](spark, SF))


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_lineage_reaches_every_ancestor(spark):
    parent = {i: i - 1 if i % 41 else None for i in range(90)} | {100: 7, 101: 100, 200: 999}
    want = set()
    for i, at in parent.items():
        n = 1
        while at is not None:
            want.add((i, at, n))
            at, n = parent.get(at), n + 1
    got = catalog.lineage(spark.createDataFrame([*parent.items()], "id long, parent_id long")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want and max(n for _, _, n in want) == 40
    with pytest.raises(ValueError):
        catalog.lineage(spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 1)], "id long, parent_id long"))


def cosines(spark):
    found = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, v = np.array([r["vec_id"] for r in found]), np.array([r["embedding"] for r in found], float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    return ids, np.round(v @ v.T, 9)


def best(ids, scores, k):
    return [sorted(zip(-row, ids))[:k] for row in scores]


def test_knn_batch_asks_for_every_row(spark):
    ids, scores = cosines(spark)
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in QUERIES["knn_batch"](spark, SF).collect()}
    want = {(q, n): (x, -s) for q, top in zip(ids, best(ids, scores, 10)) for n, (s, x) in enumerate(top, 1)}
    assert set(got) == set(want) and all(got[k][1] == pytest.approx(want[k][1], abs=2e-9) for k in want)
    assert sum(got[k][0] != want[k][0] for k in want) <= len(want) // 1000  # ties at the last digit


def test_diversity_filter_asks_for_every_row(spark):
    ids, scores = cosines(spark)
    place = {x: i for i, x in enumerate(ids)}
    got = {}
    for r in QUERIES["diversity_filter"](spark, SF).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    assert set(got) == set(ids)
    for q, top in zip(ids, best(ids, scores, 20)):
        kept = []
        for n, (_, x) in enumerate(top, 1):
            if all(scores[place[x], place[y]] < 0.3 for _, y in kept):
                kept.append((n, x))
        assert sorted(got[q]) == kept


def test_cited_spans_searches_every_document(spark):
    claims = spark.createDataFrame([(1, "Amber falcons circle above northern harbours"), (2, "copper lanterns"), (3, "of it")], "claim_id long, claim string")
    texts = spark.createDataFrame([(7, "Nothing of use stands here. Amber falcons circle above some harbours today."), (8, "The copper lanterns glow. Copper lanterns and amber falcons circle above northern harbours."), (9, None), (10, "lanterns of copper")], "id long, text string")
    pairs = claims.crossJoin(texts)
    for threshold in (0.6, 0.2, 0.5):
        want = rows(evidence.cited_spans(pairs, threshold=threshold))
        assert want[1] and rows(evidence.cited_everywhere(claims, texts, threshold)) == want
    got = QUERIES["cited_spans"](spark, SF)
    read = lambda t, i, c: spark.read.parquet(f"{SF}/{t}.parquet").orderBy(i).limit(60).selectExpr(f"{i} AS {c[0]}", f"text AS {c[1]}")
    some, docs = read("benchmark", "item_id", ("claim_id", "claim")), read("documents", "doc_id", ("id", "text"))
    kept = got.join(some.select("claim_id"), "claim_id", "left_semi").join(docs.select("id"), "id", "left_semi")
    assert rows(kept) == rows(evidence.cited_spans(some.crossJoin(docs)))
