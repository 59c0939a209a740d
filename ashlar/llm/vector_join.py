"""Embedding near-dedup by a subspace pigeonhole join.

Vectors of one label are brought to length 1 and turned by a random rotation, and their coordinates are split into
blocks. Two vectors of cosine c are at squared distance 2 - 2c; if that is within the threshold's budget, then at
least one block holds no more than its proportional part of it. Each block is range-joined under that part: vectors
lie in cells as wide as the block's radius along its first axes, and only the same or neighbouring cells can match.
Only a block's own coordinates travel to its cells; vectors with a candidate there are fetched whole, and the union of
candidates of all blocks is verified on the given vectors in double precision.

A pair belongs to the first block whose budget it meets, so it is verified and counted once though no pair leaves the
task that compares it; a task gives back counts of links and a spanning forest. Large cells are compared tile against
tile over many tasks. Exact copies with the same label are one node with a multiplicity.

Vectors that are null, empty, zero or hold null or non-finite components, and those with a null label, are linked with
nothing. Vectors of different lengths are never linked. Rows with a null id get null results. Different vectors that
share an id have links of their own and are of one component. Extra columns stay out.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, by_group, components, cut, forest, releasing, spread


@dataclass(frozen=True)
class Config:
    """blocks: of the rotated coordinates; grid: axes of a block that cells use (None: by the largest label); tile: side of what one task compares."""

    threshold: float = 0.93
    blocks: int = 4
    grid: int | None = None
    tile: int = 2048
    seed: int = 5

    @property
    def budget(self) -> float:
        return 2 - 2 * self.threshold

    def axes(self, most: int) -> int:
        """With each axis a vector has three times as many neighbouring cells, and cells have fewer members."""
        return self.grid or (2 if most < 300_000 else 3 if most < 30_000_000 else 4)


#: Above the exact budget, against rounding in the rotation; and against that of coordinates that travel in single precision.
SLACK, COARSE = 1e-6, 1e-5


@lru_cache(maxsize=4)
def rotation(size: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def split(size: int, blocks: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, size, min(blocks, size) + 1).astype(int)
    return list(itertools.pairwise(edges.tolist()))


def turned(x: np.ndarray, seed: int) -> np.ndarray:
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return unit @ rotation(x.shape[1], seed)


def half_neighbours(axes: int) -> list[tuple[int, ...]]:
    """Of each pair of opposite steps to a neighbouring cell, one."""
    return [s for s in itertools.product((-1, 0, 1), repeat=axes) if s > (0,) * axes]


def _vectors(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(rows, -1)


def close_in(own: np.ndarray, mine: np.ndarray, home: np.ndarray, across: bool, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (left, right) within the limit in one block, left first, one of them at home; in portions."""
    square = (own * own).sum(axis=1)
    for i in range(0, len(own), 256):
        d = square[i : i + 256, None] + square[None, i:] - 2 * (own[i : i + 256] @ own[i:].T)
        left, right = np.nonzero(d <= limit)
        left, right = left + i, right + i
        ok = (left < right) & (home[left] | home[right])
        if across:
            ok &= mine[left] != mine[right]
        yield left[ok], right[ok]


def limits(size: int, c: Config) -> list[float]:
    """The part of the budget that each block has."""
    return [c.budget * (b - a) / size * (1 + SLACK) + 1e-12 for a, b in split(size, c.blocks)]


def found_in(x: np.ndarray, mine: np.ndarray, home: np.ndarray, across: bool, block: int, c: Config) -> tuple[np.ndarray, np.ndarray]:
    """Rows (left, right) of the links that belong to this block, among those at home here or met by one at home."""
    z = turned(x, c.seed)
    spans, most = split(x.shape[1], c.blocks), limits(x.shape[1], c)
    norm = np.sqrt((x * x).sum(axis=1))
    lefts, rights = [], []
    for left, right in close_in(z[:, slice(*spans[block])], mine, home, across, most[block] + 1e-9):
        for k, (p, q) in enumerate(spans[: block + 1]):
            meets = ((z[left, p:q] - z[right, p:q]) ** 2).sum(axis=1) <= most[k]
            keep = meets if k == block else ~meets
            left, right = left[keep], right[keep]
        linked = (x[left] * x[right]).sum(axis=1) / (norm[left] * norm[right]) >= c.threshold
        lefts.append(left[linked])
        rights.append(right[linked])
    return np.concatenate(lefts), np.concatenate(rights)


def near_duplicates(vectors: DataFrame, c: Config = Config(), key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept): links are of at least the threshold's cosine within a label."""
    spark = vectors.sparkSession
    bounded(spark)
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    live = F.col("v").isNotNull() & F.col("label").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("string").alias("label"))
    rows = rows.withColumn("live", F.coalesce(live, F.lit(False)))
    sound = rows.where("live and id is not null").select("id", "v", "label")
    nodes = sound.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("times"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    most = nodes.groupBy("label").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    grid = c.axes(most)
    steps = [(0,) * grid, *half_neighbours(grid)]

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            sizes = np.diff(whole_batch.column("v").offsets.to_numpy())
            for size in np.unique(sizes).tolist():
                b = whole_batch.filter(pa.array(sizes == size))
                for i in range(0, b.num_rows, 500):
                    part = b.slice(i, 500)
                    n = part.num_rows
                    z = turned(_vectors(part.column("v"), n), c.seed)
                    for k, (p, q) in enumerate(split(size, c.blocks)):
                        radius = np.sqrt(c.budget * (q - p) / size * (1 + SLACK)) + 1e-9
                        axes = min(grid, q - p)
                        at = np.zeros((n, grid), dtype=np.int64)
                        at[:, :axes] = np.floor(z[:, p : p + axes] / radius)
                        raw = z[:, p:q].astype("<f4").tobytes()
                        width = 4 * (q - p)
                        own = pa.array([raw[j : j + width] for j in range(0, len(raw), width)], pa.binary())
                        for step in steps:
                            if any(step[axes:]):
                                continue
                            cell = pa.array([",".join(map(str, r)) for r in (at - np.array(step)).tolist()])
                            yield pa.RecordBatch.from_arrays(
                                [part.column("label"), pa.array(np.full(n, size, np.int32)), pa.array(np.full(n, k, np.int32)), cell, pa.array(np.full(n, not any(step))), part.column("node"), own],
                                ["label", "size", "block", "cell", "home", "node", "own"],
                            )

    placed = nodes.select("node", "label", "v").mapInArrow(releasing(place), "label string, size int, block int, cell string, home boolean, node long, own binary")
    placed = placed.select(F.xxhash64("label", "size", "block", "cell").alias("place"), "size", "block", "home", "node", "own")
    # cells without anyone at home, or with a single member, can have no link
    counts = placed.groupBy("place").agg(F.count("*").alias("n"), F.max("home").alias("any")).where("n > 1 and any").drop("any")
    tiles = F.ceil(F.col("n") / c.tile).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit("tile")), tiles).cast("int")
    spots = placed.join(counts, "place").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    bucket = F.xxhash64("place", F.least("mine", "other"), F.greatest("mine", "other"))
    spots = spots.select(bucket.alias("bucket"), "size", "block", "mine", (F.col("mine") != F.col("other")).alias("across"), "home", "node", "own")

    def groups(t: pa.Table) -> Iterator[pa.Table]:
        bucket = t.column("bucket").to_numpy()
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for a, b in itertools.pairwise([0, *cuts.tolist(), len(bucket)]):
            yield t.slice(a, b - a)

    def screen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each cell the vectors with a candidate in it."""
        names = ["bucket", "block", "mine", "across", "home", "node"]
        for t in by_group(batches, "bucket", 5000):
            keep = []
            for g in groups(t):
                block, size = g.column("block")[0].as_py(), g.column("size")[0].as_py()
                own = np.frombuffer(b"".join(g.column("own").to_pylist()), dtype="<f4").reshape(g.num_rows, -1)
                mine, home = (g.column(k).to_numpy() for k in ("mine", "home"))
                hit = np.zeros(g.num_rows, dtype=bool)
                for left, right in close_in(own, mine, home, g.column("across")[0].as_py(), limits(size, c)[block] + COARSE):
                    hit[left] = hit[right] = True
                keep.append(hit)
            yield from t.select(names).filter(pa.array(np.concatenate(keep))).combine_chunks().to_batches()

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, "bucket", 1000):
            for g in groups(t):
                x = _vectors(g.column("v").combine_chunks(), g.num_rows)
                nodes, ids, times, mine, home = (g.column(k).to_numpy() for k in ("node", "id", "times", "mine", "home"))
                left, right = found_in(x, mine, home, g.column("across")[0].as_py(), g.column("block")[0].as_py(), c)
                if len(left):
                    yield forest(nodes, ids, times, left, right)

    parts = spread(spark)
    screened = spots.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(releasing(screen), "bucket long, block int, mine int, across boolean, home boolean, node long")
    spots = cut(screened).join(nodes.select("node", "id", "times", "v"), "node")
    found = cut(spots.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(releasing(compare), "node long, id long, links long, root long"))
    tops = components(found.select(F.col("id").alias("src"), F.col("root").alias("dst"))).withColumnRenamed("node", "id")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.join(links, "node", "left").join(tops, "id", "left").select(
        "label", "v", F.coalesce("component", "id").alias("top"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n")
    )
    out = rows.where("id is not null").select("id", F.when(F.col("live"), F.col("label")).alias("label"), F.when(F.col("live"), F.col("v")).alias("v"))
    out = out.join(known, ["label", "v"], "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("top", "id").alias("component_id"))
    out = out.unionByName(rows.where("id is null").select("id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id")))
    return out.select(F.col("id").alias(key), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
