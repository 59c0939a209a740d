"""Fusion, reranking, final lists and diversification."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores


def fuse(dense: DataFrame, sparse: DataFrame, how: str = "left", key: str = "doc") -> DataFrame:
    """(q, key, vector, bm25, combined, rank): documents that only BM25 finds are left out unless how='full'."""
    both = dense.select("q", key, F.col("score").alias("vector")).join(sparse.select("q", key, F.col("score").alias("bm25")), ["q", key], how)
    both = both.withColumns({"vector": F.coalesce("vector", F.lit(0.0)), "bm25": F.coalesce("bm25", F.lit(0.0))})
    order = Window.partitionBy("q").orderBy(F.desc("combined"), key)
    return both.withColumn("combined", scores.fused("vector", "bm25")).withColumn("rank", F.row_number().over(order))


def rerank(results: DataFrame, key: str = "doc") -> DataFrame:
    """results with question, content, section and flags: adds rerank, which alone decides the new rank."""
    s = scores.rerank_score("question", "content", "section", "has_formulas", "has_code", "has_citations")
    order = Window.partitionBy("q").orderBy(F.desc("rerank"), key)
    return results.withColumn("rerank", s).withColumn("rank", F.row_number().over(order))


def final_list(first: DataFrame, second: DataFrame, size: int = 5, enough: int = 3, key: str = "doc") -> DataFrame:
    """First lists of at least ``enough`` rows stand alone; shorter ones are filled up from the second."""
    have = first.groupBy("q").agg(F.count("*").alias("have"))
    tail = second.join(have, "q", "left").where(F.coalesce("have", F.lit(0)) < enough)
    both = first.select("q", key, "rank", F.lit(0).alias("part")).unionByName(tail.select("q", key, "rank", F.lit(1).alias("part")))
    order = Window.partitionBy("q").orderBy("part", "rank", key)
    return both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)


def diverse(results: DataFrame, threshold: float = 0.8, key: str = "doc") -> DataFrame:
    """Greedy by rank: a row goes if its word set is closer than the threshold to one that stays.

    The lists of a question are short (top-k), so one question is one group.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", key])
        sets = [set(str(t).lower().split()) for t in pdf["content"]]
        kept: list[int] = []
        for i, s in enumerate(sets):
            if all(len(s & sets[j]) <= threshold * len(s | sets[j]) for j in kept):
                kept.append(i)
        return pdf.iloc[kept].assign(rank=range(1, len(kept) + 1))

    cols = results.select("q", key, "content", F.col("rank").cast("int").alias("rank"))
    return cols.groupBy("q").applyInPandas(pick, cols.schema)


def _weights(texts: list[str], most: int) -> np.ndarray:
    """Rows of length 1: counts times ln((1+n)/(1+df))+1 over the most frequent words, ties alphabetical."""
    stop = set(_STOP)
    rows = [Counter(w for w in re.findall(r"\b\w\w+\b", t.lower()) if w not in stop) for t in texts]
    total = Counter()
    for r in rows:
        total.update(r)
    vocabulary = sorted(sorted(total), key=lambda w: -total[w])[:most]
    m = np.array([[r[w] for w in vocabulary] for r in rows], dtype=float).reshape(len(rows), len(vocabulary))
    idf = np.log((1 + len(rows)) / (1 + (m > 0).sum(axis=0))) + 1
    m *= idf
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


#: English words without content, for the weights of mmr.
_STOP = "a about after all also an and any are as at be because been before being both but by can could did do does for from had has have he her here him his how i if in into is it its me more most my no nor not of on only or other our out over own same she so some such than that the their them then there these they this those through to too under up very was we were what when where which while who why will with would you your".split()


def mmr(results: DataFrame, k: int = 5, weight: float = 0.7, most: int = 100, key: str = "doc") -> DataFrame:
    """Maximal marginal relevance: the first by rank, then again and again the best of weight * combined less
    (1 - weight) * similarity to what is chosen. Lists of at most k rows stay as they are."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", key]).reset_index(drop=True)
        if len(pdf) <= k:
            return pdf.assign(rank=range(1, len(pdf) + 1))
        m = _weights([str(t) for t in pdf["content"]], most)
        if m.shape[1] == 0:
            return pdf.head(k)
        alike = m @ m.T
        gain = pdf["combined"].to_numpy(dtype=float)
        chosen = [0]
        while len(chosen) < k:
            worth = weight * gain - (1 - weight) * alike[:, chosen].max(axis=1)
            worth[chosen] = -np.inf
            chosen.append(int(worth.argmax()))
        return pdf.iloc[chosen].assign(rank=range(1, k + 1))

    cols = results.select("q", key, "content", F.col("combined").cast("double").alias("combined"), F.col("rank").cast("int").alias("rank"))
    return cols.groupBy("q").applyInPandas(pick, cols.schema)
