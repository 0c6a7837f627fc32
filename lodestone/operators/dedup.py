"""Exact, lexical and semantic dedup of examples, with representatives and diversity reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import blocks


def exact_groups(docs: DataFrame) -> DataFrame:
    """(hash, doc_id, copies): texts that occur more than once, by sha256, with their least id."""
    return docs.groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).where("copies > 1")


def lexical_first(rows: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """Rows whose normalised text no row before them (by `order`) has."""
    w = Window.partitionBy("_norm").orderBy(order)
    return rows.withColumn("_norm", tx.normalised(F.col(text))).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_norm", "_n")


def similar_pairs(vectors: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, similarity) for pairs a < b of (id, v) at or above the threshold, exact, by products of blocks."""
    return blocks.pairs(vectors, threshold)


def _leaders(threshold: float, key: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        size = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
        leaders: list[int] = []
        owner = np.empty(len(x), int)
        for i in range(len(x)):
            near = np.flatnonzero(x[leaders] @ x[i] >= threshold) if leaders else ()
            owner[i] = leaders[near[0]] if len(near) else i
            if not len(near):
                leaders.append(i)
        total, count = np.zeros(len(x)), np.zeros(len(x), int)
        for lead in leaders:
            own = np.flatnonzero(owner == lead)
            s = x[own].sum(axis=0)
            n = len(own)
            total[own] = 1.0 if n == 1 else (s @ s - (x[own] ** 2).sum()) / (n * (n - 1))
            count[own] = n
        out = pdf[[*key, "id", "pos"]].copy()
        out["leader"], out["size"], out["similarity"] = pdf["id"].to_numpy()[owner], count, np.round(total, 9)
        return out

    return run


def leader_clusters(rows: DataFrame, threshold: float = 0.92, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., id, pos, leader, size, similarity): each row joins the first earlier leader it is near, or leads.

    rows is (by.., id bigint, pos bigint, v). Order decides, so a group is one sequential pass; groups given
    by `by` (a symbol, or complexity, focus and sign) are independent and run apart. similarity is the mean
    over the cluster's pairs.
    """
    keys = list(by)
    schema = ", ".join([*(f"{k} {dict(rows.dtypes)[k]}" for k in keys), "id bigint, pos bigint, leader bigint, size int, similarity double"])
    return rows.groupBy(*keys).applyInPandas(_leaders(threshold, keys), schema)


def representative_score(confidence: Column, negative: Column, citations: Column, answer: Column, focus: Column) -> Column:
    length = F.when(answer == "NOT_IN_CONTEXT", 0.0).otherwise(F.least(F.length(answer) / 500, F.lit(1.0)))
    return 5 * confidence + F.when(negative, 0).otherwise(2) + F.when(citations > 0, 1).otherwise(0) + length + F.when(focus != "general", 0.5).otherwise(0)


def representatives(rows: DataFrame, cluster: str, score: Column, order: str) -> DataFrame:
    """The best row of each cluster; of equals the first in order."""
    w = Window.partitionBy(cluster).orderBy(F.desc("_s"), order)
    return rows.withColumn("_s", F.round(score, 9)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").withColumnRenamed("_s", "score")


def similarity_text(question: Column, answer: Column) -> Column:
    return F.concat(F.lit("Q: "), question, F.lit(" A: "), answer)


def diversity(rows: DataFrame, text: str, *kinds: str) -> DataFrame:
    """(kind, value, n): row counts for each value of each column, and for kind 'distinct' the distinct normalised texts."""
    parts = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in kinds])).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))
    distinct = rows.agg(F.countDistinct(tx.normalised(F.col(text))).alias("n")).select(F.lit("distinct").alias("kind"), F.lit(text).alias("value"), "n")
    return parts.unionByName(distinct)
