"""N-gram Jaccard join by chosen paths.

Texts are sets of word shingles. In each run, all sets start in one bucket, and a bucket is split by a sampled shared
token: its members go to sub-buckets by their minimum shingle under the next of the run's random orders. Small buckets
are compared by brute force; the others are split again, to a fixed depth. A pair of similarity s stays together over d
splits with probability s**d, and runs are repeated until a pair at the threshold is met with the target recall.
Buckets that stay large (thousands of mutual near copies) are compared whole, tile against tile over many tasks.

A pair belongs to the first run in which its members end in the same bucket, so it is verified and counted once, though
no pair leaves the task that compares it. Minimum shingles screen pairs; those that pass are verified on whole shingle
sets. Each task gives back counts of links and a spanning forest of what it found.

Exact copies of a text are one node with a multiplicity. Words are what ASCII white space parts, case and punctuation
kept; texts of fewer words than a shingle have one shingle of all their words. Null texts and those without words are
linked with nothing, not even with their copies. Rows with a null id get null results. Ids are integers; rows that
share an id are one document of several texts: each text has its own links, which count rows, and all that have words
are of one class.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, by_group, by_size, components, cut, releasing, roots, spread, whole
from .pieces import mixed, ragged


@dataclass(frozen=True)
class Config:
    """words: in a shingle; depth: splits at most; limit: members up to which a bucket is not split; tile: side of what one task compares."""

    words: int = 5
    threshold: float = 0.8
    recall: float = 0.999
    depth: int = 3
    limit: int = 128
    tile: int = 512
    seed: int = 3

    @property
    def runs(self) -> int:
        return math.ceil(math.log(1 - self.recall) / math.log(1 - self.threshold**self.depth))

    @property
    def least(self) -> int:
        """Equal minimum shingles below which a pair is not verified: 4.5 deviations under what the threshold gives."""
        k, t = self.runs * self.depth, self.threshold
        return max(1, math.floor(k * t - 4.5 * math.sqrt(k * t * (1 - t))))


def _random(seed: int, n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingles(texts: list[bytes], words: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(shingles of each text, with repeats; their 64-bit hashes end to end)."""
    blob = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    space = SPACE[blob]
    first = ~space
    first[1:] &= space[:-1]
    start = np.flatnonzero(first)
    if not len(start):
        return np.zeros(len(texts), dtype=np.int64), np.zeros(0, dtype=np.uint64)
    table = _random(seed, 256)
    table[SPACE] = 0
    step = np.arange(len(blob))  # place of each byte in its word
    step[start[0] :] -= np.repeat(start, np.diff(start, append=len(blob)))
    power = np.cumprod(np.full(int(step.max()) + 1, 0xD6E8FEB86659FD93, dtype=np.uint64))
    word = mixed(np.add.reduceat(table[blob] * power[step], start))
    owner = np.searchsorted(np.cumsum(size), start, side="right")
    n = np.bincount(owner, minlength=len(texts))
    factors = _random(seed + 1, words) | np.uint64(1)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    head = ragged(np.cumsum(n) - n, count)  # the first word of each shingle
    width = np.repeat(np.minimum(n, words), count)
    out = np.zeros(len(head), dtype=np.uint64)
    padded = np.concatenate([word, np.zeros(words, dtype=np.uint64)])
    for k in range(words):
        out += np.where(width > k, padded[head + k], np.uint64(0)) * factors[k]
    return count.astype(np.int64), mixed(out + width.astype(np.uint64))


def sketches(count: np.ndarray, hashes: np.ndarray, size: int, seed: int) -> np.ndarray:
    """texts x size: for each of size random orders the first shingle, as 32 bits of it; 0 without shingles."""
    out = np.zeros((len(count), size), dtype=np.int32)
    full = np.flatnonzero(count)
    if len(full):
        start = (np.cumsum(count) - count)[full]
        for k, factor in enumerate(_random(seed + 2, size) | np.uint64(1)):
            low = np.minimum.reduceat(hashes * factor, start)
            out[full, k] = (mixed(low) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def _raw(texts: pa.Array) -> list[bytes]:
    return pc.fill_null(texts, "").cast(pa.large_binary()).to_pylist()


def digest(documents: DataFrame, c: Config, key: str, text: str) -> DataFrame:
    """(doc, same, n, sketch): same names the text, n counts its shingles."""
    size = c.runs * c.depth

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_size(batches, 2, 500_000):
            count, hashes = shingles(_raw(part.column(2)), c.words, c.seed)
            s = sketches(count, hashes, size, c.seed)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, s.size + 1, size, dtype=np.int32)), pa.array(s.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(count), lists], ["doc", "same", "n", "sketch"])

    t = whole(text)
    rows = documents.select(F.col(key).cast("long").alias("doc"), F.md5(t.cast("binary")).alias("same"), t.alias("text")).where("doc is not null")
    return rows.mapInArrow(releasing(run), "doc long, same string, n long, sketch array<int>")


def leaves(nodes: DataFrame, c: Config) -> DataFrame:
    """(node, r, leaf, size): the bucket of more than one member in which each node ends in each run."""
    path = F.col("r")
    keys = []
    for d in range(c.depth):
        path = F.xxhash64(path, F.element_at("sketch", F.col("r") * c.depth + d + 1))
        keys.append(path.alias(f"k{d}"))
    rows = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(c.runs - 1))).alias("r"), "sketch").select("node", "r", *keys)
    out = None
    for d in range(c.depth):
        # written, so that both sides of the join are shuffled for it, and a hot token's rows can be split over tasks
        sizes = cut(rows.groupBy(f"k{d}").agg(F.count("*").alias("size")).where("size > 1"))
        rows = cut(rows.drop("size").join(sizes, f"k{d}"))
        done = rows if d == c.depth - 1 else rows.where(F.col("size") <= c.limit)
        done = done.select("node", "r", F.col(f"k{d}").alias("leaf"), "size")
        out = done if out is None else out.unionByName(done)
        rows = rows.where(F.col("size") > c.limit)
    return out


def _numpy(t: pa.Table, name: str, width: int = 0) -> np.ndarray:
    c = t.column(name)
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy().reshape(-1, width) if width else c.to_numpy(zero_copy_only=False)


def _pairs(t: pa.Table, c: Config, most: int = 30_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (left, right) of the pairs that belong to this run and pass the screen."""
    bucket, r, mine, across = (_numpy(t, x) for x in ("bucket", "r", "mine", "across"))
    leaf, sketch = _numpy(t, "leafs", c.runs), _numpy(t, "sketch", c.runs * c.depth)
    node = _numpy(t, "node")
    stop = np.searchsorted(bucket, bucket, side="right")
    after = stop - np.arange(len(bucket)) - 1
    done = np.concatenate([[0], np.cumsum(after)])
    at = 0
    while at < len(bucket):
        to = max(at + 1, int(np.searchsorted(done, done[at] + most, side="right")) - 1)
        left = np.repeat(np.arange(at, to), after[at:to])
        right = ragged(np.arange(at, to) + 1, after[at:to])
        at = to
        ok = (node[left] != node[right]) & (~across[left] | (mine[left] != mine[right]))
        left, right = left[ok], right[ok]
        same = (leaf[left] == leaf[right]) & (leaf[left] != 0)
        ok = same.argmax(axis=1) == r[left]
        left, right = left[ok], right[ok]
        ok = (sketch[left] == sketch[right]).sum(axis=1) >= c.least
        yield left[ok], right[ok]


def _linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of shingle sets have a Jaccard similarity of at least the threshold."""
    size = np.array([len(s) for s in sets])
    if len(left) < 2000:
        shared = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right, strict=True)])
    else:  # a dense product over the shingles that more than one of them has
        _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), size)
        keep = times[at] > 1
        row, at = row[keep], np.unique(at[keep], return_inverse=True)[1]
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        both = np.zeros((len(sets), len(sets)), dtype=np.float32)
        for i in range(0, int(at.max(initial=-1)) + 1, 8192):
            a, b = np.searchsorted(at, [i, i + 8192])
            m = np.zeros((len(sets), 8192), dtype=np.float32)
            m[row[a:b], at[a:b] - i] = 1
            both += m @ m.T
        shared = both[left, right]
    return shared * (1 + threshold) >= threshold * (size[left] + size[right]) - 1e-9


def join(documents: DataFrame, c: Config = Config(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, n_links, n_shingles): class_id is the smallest id that links lead to, n_links counts the other rows of at least the threshold's similarity."""
    spark = documents.sparkSession
    bounded(spark)
    parts = spread(spark)
    rows = cut(digest(documents, c, key, text))
    texts = rows.groupBy("same").agg(F.min("doc").alias("doc"), F.count("*").alias("times"))
    # a node is a text; an id may name several of them, and a row may be there more than once
    nodes = rows.where("n > 0").select("same", "doc", "sketch").join(texts, ["same", "doc"])
    nodes = nodes.groupBy("same").agg(*(F.first(x).alias(x) for x in ("doc", "sketch", "times")), F.count("*").alias("rows"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    leaf = cut(leaves(nodes, c))
    ends = leaf.groupBy("node", "r").agg(F.min("leaf").alias("leaf")).groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("r", "leaf"))).alias("m"))
    ends = ends.select("node", F.transform(F.sequence(F.lit(0), F.lit(c.runs - 1)), lambda r: F.coalesce(F.try_element_at("m", r), F.lit(0))).cast("array<long>").alias("leafs"))
    tiles = F.ceil(F.col("size") / c.tile).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit("tile")), tiles).cast("int")
    spots = leaf.select("node", "r", "leaf", mine.alias("mine"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
    spots = spots.select("node", "r", "mine", F.xxhash64("r", "leaf", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket"), (F.col("mine") != F.col("other")).alias("across"))
    members = nodes.select("node", "doc", "same", "sketch", "times").join(ends, "node")
    wide = spots.join(members.drop("doc", "same", "times"), "node")

    def screen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, "bucket", 20_000):
            keep = np.zeros(t.num_rows, dtype=bool)
            for left, right in _pairs(t, c):
                keep[left] = keep[right] = True
            names = ["node", "r", "mine", "bucket", "across"]
            yield from t.select(names).filter(pa.array(keep)).combine_chunks().to_batches()

    screened = cut(
        wide.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(releasing(screen), "node long, r int, mine int, bucket long, across boolean")
    )
    spot = F.collect_list(F.struct("bucket", "r", "mine", "across")).alias("spots")
    wanted = screened.groupBy("node").agg(spot).join(members, "node")
    t = whole(text)
    wanted = documents.select(F.col(key).cast("long").alias("doc"), F.md5(t.cast("binary")).alias("same"), t.alias("text")).join(wanted, ["doc", "same"])
    if not nodes.where("rows > 1").isEmpty():  # repeated rows: times has them already
        wanted = wanted.dropDuplicates(["node"])
    kinds = "bucket long, r int, mine int, across boolean, node long, doc long, times long, leafs array<long>, sketch array<int>, shingles binary"

    at = wanted.columns.index("text")

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, at, 500_000):
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                count, hashes = shingles(_raw(part.column("text")), c.words, c.seed)
                ends = np.cumsum(count)
                packed = pa.array([np.unique(hashes[e - n : e]).tobytes() for e, n in zip(ends, count, strict=True)], pa.binary())
                spots = part.column("spots")
                own = pa.array(np.repeat(np.arange(part.num_rows), np.diff(spots.offsets.to_numpy())))
                flat = spots.flatten()
                fields = [flat.field(x) for x in ("bucket", "r", "mine", "across")]
                rest = [part.column(x).take(own) for x in ("node", "doc", "times", "leafs", "sketch")]
                for j in range(0, len(own), 500):
                    yield pa.RecordBatch.from_arrays([x.slice(j, 500) for x in [*fields, *rest, packed.take(own)]], [k.split()[0] for k in kinds.split(", ")])

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, "bucket", 1500):
            node, doc, times, bucket = (_numpy(t, x) for x in ("node", "doc", "times", "bucket"))
            found = [p for p in _pairs(t, c) if len(p[0])]
            if not found:
                continue
            left, right = (np.concatenate([p[k] for p in found]) for k in (0, 1))
            order = np.argsort(bucket[left], kind="stable")
            left, right = left[order], right[order]
            ok = np.zeros(len(left), dtype=bool)
            packed = t.column("shingles").combine_chunks() if isinstance(t.column("shingles"), pa.ChunkedArray) else t.column("shingles")
            cuts = np.flatnonzero(np.diff(bucket[left])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(left)], strict=True):
                own, at = np.unique(np.concatenate([left[a:b], right[a:b]]), return_inverse=True)
                sets = [np.frombuffer(packed[int(i)].as_py(), dtype=np.uint64) for i in own]
                ok[a:b] = _linked(sets, at[: b - a], at[b - a :], c.threshold)
            left, right = left[ok], right[ok]
            n = np.bincount(left, times[right], minlength=len(doc)) + np.bincount(right, times[left], minlength=len(doc))
            # rows of a bucket by id, so that the lowest row of a component has its lowest id
            rank = np.lexsort((doc, bucket))
            place = np.empty_like(rank)
            place[rank] = np.arange(len(rank))
            root = rank[roots(len(doc), place[left], place[right])[place]]
            hit = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(doc[hit]), pa.array(n[hit].astype(np.int64)), pa.array(doc[root[hit]])], ["node", "doc", "links", "root"])

    found = cut(wanted.mapInArrow(releasing(fill), kinds).repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(releasing(verify), "node long, doc long, links long, root long"))
    edges = found.select(F.col("doc").alias("src"), F.col("root").alias("dst"))
    several = rows.where("n > 0").groupBy("doc").agg(F.min("same").alias("a"), F.max("same").alias("b")).where("a <> b").select("doc")
    several = cut(rows.where("n > 0").select("doc", "same").join(several, "doc"))
    if not several.isEmpty():  # a text links its documents, too, where they have other ones
        first = texts.select("same", F.col("doc").alias("dst"))
        edges = edges.unionByName(several.withColumnRenamed("doc", "src").join(first, "same").select("src", "dst"))
    classes = components(edges).withColumnRenamed("node", "doc")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("same", "doc", "node", "times").join(links, "node", "left").join(classes, "doc", "left")
    known = known.select("same", F.coalesce("component", "doc").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    out = rows.select("doc", "same", "n").join(known, "same", "left")
    out = out.select(F.col("doc").alias(key), F.coalesce("class_id", "doc").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("n").alias("n_shingles"))
    lost = documents.where(F.col(key).isNull()).select(*(F.lit(None).cast("long").alias(x) for x in (key, "class_id", "n_links", "n_shingles")))
    return out.unionByName(lost)
