"""Exact nearest neighbours for batches of query vectors, thresholds and adaptive cuts."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import scores


@dataclass(frozen=True)
class RetrievalConfig:
    top_k: int = 5
    max_top_k: int = 50
    min_top_k: int = 1
    threshold: float = 0.3
    high: float = 0.5
    low: float = 0.1
    metric: str = "cosine"
    drop: float = 0.15
    diversity: float = 0.8
    adaptive: bool = True
    diverse: bool = False

    def update(self, **changes: Any) -> RetrievalConfig:
        return replace(self, **changes)

    def clamp(self, k: int | None) -> int:
        return min(max(k or self.top_k, self.min_top_k), self.max_top_k)

    def fetch(self, k: int) -> int:
        """Candidates to rank before the adaptive cut."""
        return max(2 * k, 20) if self.adaptive else k


#: Question vectors that are shipped to every task at most, rows that meet them at once, candidates held before they are sorted out.
BLOCK, SLICE, HELD = 1024, 256, 500_000


class Best:
    """The k best of each question, ties by id, from slices of rows that come one after the other."""

    def __init__(self, names: Sequence[Any], vectors: Sequence[Sequence[float]], k: int) -> None:
        self.names, self.k = names, k
        self.by_size = {}
        for size in {len(v) for v in vectors}:
            own = [i for i, v in enumerate(vectors) if len(v) == size]
            m = np.array([vectors[i] for i in own], dtype=np.float64)
            self.by_size[size] = np.array(own), m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        self.least = np.full(len(names), -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        if x.shape[1] not in self.by_size:
            return
        own, m = self.by_size[x.shape[1]]
        for a in range(0, len(x), SLICE):
            part = x[a : a + SLICE]
            part = part / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-300)
            c = np.round(m @ part.T, 9)  # equal vectors tie
            self.take(own, ids[a : a + SLICE], c, c >= self.least[own][:, None])

    def take(self, own: np.ndarray, ids: np.ndarray, c: np.ndarray, good: np.ndarray) -> None:
        """Candidates: where good, ids (columns) of the questions own (rows) with scores c."""
        i, j = np.nonzero(good)
        self.parts.append((own[i], c[i, j], ids[j]))
        self.held += len(i)
        if self.held > max(HELD, 2 * self.k * len(self.names)):
            self.sort_out()

    def sort_out(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=object)
        q, c, ids = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        order = np.lexsort((np.unique(ids, return_inverse=True)[1], -c, q))
        q, c, ids = q[order], c[order], ids[order]
        first = np.searchsorted(q, q)
        place = np.arange(len(q)) - first
        self.least[q[place == self.k - 1]] = c[place == self.k - 1]
        keep = place < self.k
        self.parts, self.held = [(q[keep], c[keep], ids[keep])], int(keep.sum())
        return self.parts[0]

    def rows(self, q_type: pa.DataType, key_type: pa.DataType) -> pa.RecordBatch:
        q, c, ids = self.sort_out()
        return pa.RecordBatch.from_arrays([pa.array([self.names[i] for i in q], q_type), pa.array(ids.tolist(), key_type), pa.array(c, pa.float64())], ["q", "id", "cosine"])


def _listed(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of rows with vectors of one length."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat, names = vectors.flatten(), ids.to_numpy(zero_copy_only=False)
    values, starts = flat.to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(sizes) - sizes
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        if size:
            yield names[own], values[starts[own][:, None] + np.arange(size)]


def top_k(store: DataFrame, queries: DataFrame, k: int, where: Mapping[str, Any] | None = None, key: str = "vec_id", vector: str = "embedding", q: str = "q", block: int = BLOCK) -> DataFrame:
    """(q, key, cosine, rank): metadata is filtered before ranking, so pushdown and pruning apply.

    Up to ``block`` questions are shipped to every task, which multiplies slices of its rows with them and keeps a
    running k of each. More of them are dealt into blocks and the store into tiles, and each block meets each tile in a
    group of its own. What is shuffled for the ranking is k rows for each question and task or tile.

    Null and empty vectors, those with null or NaN components and those of another length match nothing; a zero vector
    has cosine 0 with all. Repeated questions are one by their name; repeated ids each count.
    """
    for name, value in (where or {}).items():
        store = store.where(F.col(name) == value)
    rows = store.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("size(v) > 0")
    asked = queries.select(F.col(q).alias("q"), F.col(vector).cast("array<double>").alias("v")).where("size(v) > 0 AND NOT exists(v, x -> x IS NULL)")
    kinds = to_arrow_schema(rows.select("id").schema).field(0).type, to_arrow_schema(asked.select("q").schema).field(0).type
    schema = f"q {asked.schema['q'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, cosine double"
    first = asked.limit(block + 1).collect()
    found = _shipped(rows, first, k, kinds, schema) if len(first) <= block else _tiled(rows, asked, k, block, kinds, schema)
    order = Window.partitionBy("q").orderBy(F.desc("cosine"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", F.col("id").alias(key), "cosine", "rank")


def _shipped(rows: DataFrame, asked: Sequence[Any], k: int, kinds: tuple, schema: str) -> DataFrame:
    names, wanted = [r["q"] for r in asked], [r["v"] for r in asked]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(names, wanted, k)
        for b in batches:
            for ids, x in _listed(b.column(0), b.column(1)):
                best.meet(ids, x)
        yield best.rows(kinds[1], kinds[0])

    return rows.mapInArrow(run, schema)


def _tiled(rows: DataFrame, asked: DataFrame, k: int, block: int, kinds: tuple, schema: str) -> DataFrame:
    blocks = -(-asked.count() // block)
    tiles = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("tile", F.pmod(F.xxhash64("id", "v"), F.lit(tiles)).cast("int")).withColumn("block", every(blocks))
    right = asked.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")).withColumn("tile", every(tiles))

    def meet(t: pa.Table, asks: pa.Table) -> pa.Table:
        best = Best(asks.column("q").to_pylist(), asks.column("v").to_pylist(), k)
        for b in t.to_batches():
            for ids, x in _listed(b.column("id"), b.column("v")):
                best.meet(ids, x)
        return pa.Table.from_batches([best.rows(kinds[1], kinds[0])])

    return left.groupBy("block", "tile").cogroup(right.groupBy("block", "tile")).applyInArrow(meet, schema)


def above(results: DataFrame, threshold: float, score: str = "cosine", key: str = "vec_id") -> DataFrame:
    """Rows of at least the threshold, ranked anew, with a flag."""
    order = Window.partitionBy("q").orderBy(F.desc(score), key)
    return results.where(F.col(score) >= threshold).withColumns({"rank": F.row_number().over(order), "is_above_threshold": F.lit(True)})


def adaptive(results: DataFrame, target: int, drop: float = 0.15, least: int = 1, score: str = "cosine", key: str = "vec_id") -> DataFrame:
    """Cut before the first fall of more than ``drop`` if that comes before ``target`` rows, else at ``target``.

    A question with a single row keeps it; a cut leaves at least ``least`` rows.
    """
    order = Window.partitionBy("q").orderBy(F.desc(score), key)
    group = Window.partitionBy("q")
    ranked = results.withColumn("rank", F.row_number().over(order)).withColumn("_fall", F.lag(score).over(order) - F.col(score))
    cut = ranked.withColumn("_cut", F.min(F.when(F.col("_fall") > drop, F.col("rank") - 1)).over(group))
    keep = F.when(F.col("_cut") < target, F.greatest(F.col("_cut"), F.lit(least))).otherwise(F.lit(target))
    return cut.where(F.col("rank") <= keep).drop("_fall", "_cut")


def retrieve(store: DataFrame, queries: DataFrame, config: RetrievalConfig = RetrievalConfig(), k: int | None = None, where: Mapping[str, Any] | None = None) -> DataFrame:
    """Over-fetch, similarity, threshold, adaptive cut: (q, vec_id, cosine, similarity, rank)."""
    k = config.clamp(k)
    found = top_k(store, queries, config.fetch(k), where)
    found = found.withColumn("similarity", scores.similarity(1 - F.col("cosine"), config.metric))
    found = above(found, config.threshold, "similarity")
    if config.adaptive:
        return adaptive(found, k, config.drop, config.min_top_k, "similarity")
    return found.where(F.col("rank") <= k)


def sweep(results: DataFrame, thresholds: tuple[float, ...] = (0.1, 0.3, 0.5), score: str = "cosine") -> DataFrame:
    """(threshold, q, n): rows of each question at each threshold, zeros included."""
    counts = results.groupBy("q").agg(*(F.count_if(F.col(score) >= t).alias(f"t{i}") for i, t in enumerate(thresholds)))
    return counts.select("q", F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("n")) for i, t in enumerate(thresholds)))).alias("x")).select("q", "x.threshold", "x.n")


def stats(results: DataFrame, threshold: float, score: str = "cosine") -> DataFrame:
    return results.groupBy("q").agg(F.count("*").alias("n"), F.min(score).alias("low"), F.max(score).alias("high"), F.avg(score).alias("mean"), F.count_if(F.col(score) >= threshold).alias("n_above"))


def counted(text: Column, size: int = 64) -> Column:
    """Token counts by hash: whole numbers, so that their cosines are the same however they are summed.

    A token's slot is the first 32 bits of its MD5 modulo size. Slots are counted in two steps, rows of slots first, so
    that a token is compared with the square root of size slots and not with all.
    """
    from ..functions.text import bound, letters_tokens

    wide = math.isqrt(size - 1) + 1
    slots = F.transform(letters_tokens(text), lambda t: (F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("long") % size).cast("int"))

    def counts(held: Column) -> Column:
        def row(i: Column) -> Column:
            own = F.filter(held, lambda s: F.floor(s / wide) == i)
            return bound(own, lambda x: F.transform(F.sequence(F.lit(0), F.lit(wide - 1)), lambda j: F.size(F.filter(x, lambda s: s % wide == j)).cast("double")))

        return F.slice(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(wide - 1)), row)), 1, size)

    return bound(slots, counts)


def hashed(text: Column, size: int = 64) -> Column:
    """A stand-in for a language model's vector: token counts by hash, at length 1. It holds no meaning."""
    from ..functions.text import bound

    def scaled(counts: Column) -> Column:
        length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
        return bound(length, lambda n: F.transform(counts, lambda x: F.when(n > 0, x / n).otherwise(0.0)))

    return bound(counted(text, size), scaled)


def concatenated(vectors: list[Column]) -> Column:
    """Vectors of several models, end to end."""
    return F.concat(*vectors)
