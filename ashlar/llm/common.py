"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import BATCH, bounded, cut, numbered, shared_folder  # noqa: F401 - for the operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(column: str | Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def spread(spark: SparkSession, least: int = 12) -> int:
    """Number of partitions for work that is heavy per row."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def components(edges: DataFrame, src: str = "src", dst: str = "dst", most: int = 60) -> DataFrame:
    """Connected components: (node, component), the component being the smallest node reachable.

    edges may hold links in one direction, both or twice; only nodes that occur in a link are returned. Each
    round replaces the links by links to smaller representatives (alternating large-star and small-star), so that
    the number of links never grows and rounds are few even on long chains. Both steps group with partial
    aggregation and join back, which AQE can split for skewed nodes.
    """
    links = cut(
        edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).where("a <> b").distinct()
    )
    seen = None
    for _ in range(most):
        # large star: every neighbour above a node moves to the smallest node of its neighbourhood
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: the neighbours below a node, and the node itself, move to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        links = cut(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    tops = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        tops.select("node", F.col("node").alias("component"))
    )


def give_back(collect: bool = True) -> None:
    """Returns a worker's unused memory to the system: workers serve task after task and else keep the most any took."""
    import ctypes
    import gc

    import pyarrow as pa

    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(run):
    """run, an Arrow function over batches; when it ends, the worker gives its unused memory back to the system."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def releasing_group(run):
    """run, an Arrow function of a group or of two that meet; what the last group took is given back before the next."""

    def wrapped(t):
        give_back(collect=False)
        return run(t)

    def wrapped_pair(t, u):
        give_back(collect=False)
        return run(t, u)

    return wrapped if run.__code__.co_argcount == 1 else wrapped_pair


def by_group(batches, column: str, most: int = 200_000):
    """Arrow batches sorted by column -> tables that hold whole groups, of about ``most`` rows."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held: list = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < most:
            continue
        t = pa.Table.from_batches(held)
        last = t.column(column)[-1]
        n = t.num_rows - pc.sum(pc.equal(t.column(column), last)).as_py()
        if n:
            yield t.slice(0, n).combine_chunks()
        rest = t.slice(n)
        held, rows = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def by_size(batches, column: int, most: int = 4_000_000):
    """Slices of Arrow batches with about ``most`` bytes of text in the column, at least a row each."""
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        sums = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            done = sums[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sums, done + most, side="right")))
            yield b.slice(at, to - at)
            at = to


def roots(n: int, left, right):
    """The lowest member of each of n nodes' components under the links (left, right)."""
    import numpy as np

    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def forest(nodes, ids, times, left, right):
    """An Arrow batch (node, id, links, root) of linked nodes: links counts neighbours with their multiplicity, root is the lowest id."""
    import numpy as np
    import pyarrow as pa

    n = np.bincount(left, times[right], minlength=len(ids)) + np.bincount(right, times[left], minlength=len(ids))
    order = np.argsort(ids, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    root = order[roots(len(ids), place[left], place[right])[place]]
    hit = n > 0
    arrays = [pa.array(nodes[hit]), pa.array(ids[hit]), pa.array(n[hit].astype(np.int64)), pa.array(ids[root[hit]])]
    return pa.RecordBatch.from_arrays(arrays, ["node", "id", "links", "root"])
