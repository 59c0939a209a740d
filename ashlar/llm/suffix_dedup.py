"""Suffix-array dedup of byte strings that recur across or within documents.

Every byte covered by a ``span``-byte string that also starts earlier (smaller id, or same document and earlier start)
is removed; strings are judged on the input.

1. Suffixes. Of the suffixes of all documents those are kept that start at an anchor: the place with the smallest
   hash of ``LEAD`` bytes in some window of ``span`` bytes. Equal windows have their anchor at the same place, so each
   repeat shows among anchors, of which there are some 2.6 in a hundred bytes. All suffixes would be forty times the
   text to move.
2. Partition. Splitters sampled from anchors cut the order of suffixes (by their ``LEAD`` leading bytes, eight at a
   time, then by a hash of their surroundings) into ranges; a lead with more than a range's share is cut, too. A range
   is sorted by multikey quicksort. Neighbours with the same lead and equal surroundings (``span`` bytes on, and as far
   back as windows reach) are repeats outright; those that share only their lead, or share it with the neighbour across
   a range's border, are compared further.
3. Comparison. Those anchors' surroundings are gathered by lead; the bytes after and before the anchor are sorted by
   multikey quicksort, common prefixes of neighbours give for every reach which suffixes agree, and a window is a
   repeat where both sides agree with an earlier one. For a lead with more than a range's share, hashes of its
   windows are dealt out by value instead, which no single key can make uneven.

What is equal by bytes: leads, and windows of anchors that share their lead only. What is equal by hash: surroundings
under one lead (64 bits besides the lead's 24 bytes of text) and windows of hot leads (128 bits). Two different
surroundings of one lead are taken for equal with a chance of 2**-64 a pair.

Text moves over the network once; the pieces that meet it are keyed by document. Null texts count as empty. Rows with
a null id match nothing. Rows that share an id are documents of their own, in the order of their texts' hashes; of
repeated rows one stays first. Copies inside one Arrow slice are settled before anything is shuffled. Ids are integers.
Extra columns stay out unless ``keep`` names them.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, by_size, cut, numbered, releasing, releasing_group, spread, whole
from .pieces import mixed, ragged


#: Leading bytes of a suffix by which it is sorted as text: whole words of eight.
LEAD = 24
WORDS = ("w0", "w1", "w2")


@dataclass(frozen=True)
class Config:
    """sample: documents at least whose anchors give the splitters; share: bytes of text for each group of text rows and each range."""

    span: int = 100
    sample: int = 1000
    share: int = 8_000_000
    seed: int = 9

    @property
    def reach(self) -> int:
        """Windows start so many bytes before their anchor at most."""
        return self.span - LEAD


BASE = np.uint64(0xA0761D6478BD642F | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes of text in a slice of a batch.
SLICE = 1 << 21
#: Texts longer than this are worked on in overlapping stretches.
STRETCH = 1 << 20
#: Stretches that end in the same so many bytes are worked on at once: with a stretch's overlaps still below 2**24.
BLOB = 1 << 20
#: Splitters at most, and anchors that a sampled text gives at most; beyond so many ranges each is dealt out by its leads.
SPLITTERS, GIVEN = 1 << 16, 256


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    out = []
    for base in (BASE, INVERSE):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    m, size = v, 1
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(m) - (width - size)], m[width - size :]) if width > size else m


@dataclass
class Anchors:
    w0: np.ndarray
    w1: np.ndarray
    w2: np.ndarray
    around: np.ndarray
    doc: np.ndarray
    at: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def take(self, i: np.ndarray) -> Anchors:
        return Anchors(*(getattr(self, f)[i] for f in FIELDS))


FIELDS = {"w0": np.uint64, "w1": np.uint64, "w2": np.uint64, "around": np.uint64, "doc": np.int64, "at": np.int32, "left": np.uint8, "right": np.uint8}


def anchors(docs: np.ndarray, texts: Sequence[bytes], c: Config) -> Anchors:
    """The anchors of whole texts: the words of the lead, a hash of the surroundings, and where they are."""
    parts: list[bytes] = []
    spans: list[tuple[int, int, int, int, int]] = []  # document, bytes before the part, first and last window in it, length of the text
    for d, t in zip(docs.tolist(), texts, strict=True):
        windows = len(t) - c.span + 1
        for first in range(0, max(windows, 0), STRETCH):
            last = min(windows, first + STRETCH)
            begin = max(0, first - c.reach)
            parts.append(t[begin : last + c.reach + c.span])
            spans.append((d, begin, first - begin, last - begin, len(t)))
    if not parts:
        return Anchors(*(np.zeros(0, dtype=k) for k in FIELDS.values()))
    # blobs stay far below the 24 bits of a place, however long the texts are
    lot = (np.cumsum([len(x) for x in parts]) - 1) // BLOB
    edges = [0, *(np.flatnonzero(np.diff(lot)) + 1).tolist(), len(parts)]
    found = [_anchors(parts[i:j], spans[i:j], c) for i, j in itertools.pairwise(edges)]
    a = Anchors(*(np.concatenate([getattr(x, f) for x in found]) for f in FIELDS))
    new = np.ones(len(a.at), dtype=bool)  # stretches of one text may share an anchor
    new[1:] = (a.doc[1:] != a.doc[:-1]) | (a.at[1:] != a.at[:-1])
    return a.take(new)


def _anchors(parts: Sequence[bytes], spans: Sequence[tuple[int, int, int, int, int]], c: Config) -> Anchors:
    """The anchors of stretches that follow each other; two of one text may both have the anchor where they meet."""
    blob = np.frombuffer(b"".join(parts), dtype=np.uint8)
    doc, begin, first, last, length = (np.array(x, dtype=np.int64) for x in zip(*spans, strict=True))
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    start = np.cumsum(size) - size
    n = len(blob)
    up, down = _powers(n + 1)
    values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(c.seed))
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values[blob] * up[:n], out=sums[1:])
    h = sums[LEAD:] - sums[: n + 1 - LEAD]
    h *= down[: len(h)]
    # ties between equal leads go to the leftmost: the place fills the low bits
    h *= np.uint64(0x9FB21C651E98DF25)
    h &= ~np.uint64((1 << 24) - 1)
    h |= np.arange(len(h), dtype=np.uint64)
    low = _sliding_min(h, c.reach + 1)
    del h
    p = (low[ragged(start + first, last - first)] & np.uint64((1 << 24) - 1)).astype(np.int64)
    p = p[np.concatenate([[True], np.diff(p) > 0])]
    own = np.searchsorted(start + size, p, side="right")
    at = p - start[own] + begin[own]
    left = np.minimum(c.reach, at)
    right = np.minimum(c.span, length[own] - at)
    around = (sums[p + right] - sums[p - left]) * down[p - left]
    around = mixed(around ^ mixed((left * 256 + right).astype(np.uint64)))
    words = blob[p[:, None] + np.arange(LEAD)].view(">u8").astype(np.uint64).reshape(-1, len(WORDS)).T
    return Anchors(*(np.ascontiguousarray(w) for w in words), around, doc[own], at.astype(np.int32), left.astype(np.uint8), right.astype(np.uint8))


def multikey(keys: Sequence[np.ndarray]) -> np.ndarray:
    """Order by several keys, quicksort on one key at a time: only rows that tie so far are sorted by the next."""
    order = np.argsort(keys[0], kind="quicksort")
    tied = np.zeros(len(order), dtype=bool)  # whether a row equals the one before, so far
    tied[1:] = keys[0][order[1:]] == keys[0][order[:-1]]
    for key in keys[1:]:
        both = tied.copy()
        both[:-1] |= tied[1:]
        place = np.flatnonzero(both)
        if not len(place):
            break
        run = np.cumsum(~tied[place])
        rows = order[place]
        by = np.argsort(key[rows], kind="quicksort")
        by = by[np.argsort(run[by], kind="stable")]
        rows = rows[by]
        order[place] = rows
        same = np.zeros(len(place), dtype=bool)
        same[1:] = (key[rows[1:]] == key[rows[:-1]]) & tied[place[1:]]
        tied[place] = same
    return order


def _settle(a: Anchors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, whether a row shares its lead with the one before, whether an earlier row has the same surroundings)."""
    order = multikey([a.w0, a.w1, a.w2, a.around, a.doc, a.at])
    s = a.take(order)
    lead, full = np.zeros(len(order), dtype=bool), np.zeros(len(order), dtype=bool)
    lead[1:] = (s.w0[1:] == s.w0[:-1]) & (s.w1[1:] == s.w1[:-1]) & (s.w2[1:] == s.w2[:-1])
    full[1:] = lead[1:] & (s.around[1:] == s.around[:-1])
    return order, lead, _later(full, s.doc, s.at)


def _later(same: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which rows equal the one before (as same says) and stand elsewhere than the first of their run."""
    if not len(same):
        return same
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
    return same & ((doc != doc[first]) | (at != at[first]))


def _packed(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(a) for a in arrays], dtype="<i8").tobytes(), *(a.tobytes() for a in arrays)])


def _unpacked(blobs: Iterable[bytes], kinds: Sequence) -> list[np.ndarray]:
    found: list[list[np.ndarray]] = [[] for _ in kinds]
    for blob in blobs:
        sizes = np.frombuffer(blob, dtype="<i8", count=len(kinds))
        at = 8 * len(kinds)
        for k, (kind, n) in enumerate(zip(kinds, sizes.tolist(), strict=True)):
            found[k].append(np.frombuffer(blob, dtype=kind, count=n, offset=at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(f) if f else np.zeros(0, dtype=k) for f, k in zip(found, kinds, strict=True)]


def _dealt(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, rows with it) for the values that key has, in their order."""
    if not len(key):
        return
    order = np.argsort(key, kind="stable")
    held = key[order]
    edges = [0, *(np.flatnonzero(held[1:] != held[:-1]) + 1).tolist(), len(held)]
    for i, j in itertools.pairwise(edges):
        yield int(held[i]), order[i:j]


def _group_of(docs: np.ndarray, groups: int) -> np.ndarray:
    """The group of text rows to which a document belongs; as in ``_grouped``."""
    own, back = np.unique(docs, return_inverse=True)
    return np.array([zlib.crc32(str(d).encode()) % groups for d in own.tolist()], dtype=np.int64)[back]


def _grouped(rows: DataFrame, groups: int) -> DataFrame:
    return rows.withColumn("grp", F.pmod(F.crc32(F.col("doc").cast("string").cast("binary")), F.lit(groups)).cast("int"))


def _leads(a: Anchors) -> np.ndarray:
    """A hash of each anchor's lead."""
    return mixed(mixed(mixed(a.w0) + a.w1) + a.w2)


class Ranges:
    """Splitters over (lead, surroundings); leads cut by several splitters are hot. parts: into which each range is dealt by lead."""

    def __init__(self, splitters: np.ndarray, parts: int = 1) -> None:
        self.s, self.parts = splitters, parts  # n x 4, sorted
        self.first = splitters[:, 0]
        leads = splitters[:, :3]
        self.cut = {tuple(x) for x in leads.tolist()}
        again = leads[1:][(leads[1:] == leads[:-1]).all(axis=1)]
        self.hot = {tuple(x) for x in again.tolist()}
        self.count = (len(splitters) + 1) * parts

    def of(self, a: Anchors) -> np.ndarray:
        """The bucket of each anchor: how many splitters are not above it, and its part of that range."""
        out = np.searchsorted(self.first, a.w0, side="left")
        for t in np.unique(a.w0[np.isin(a.w0, self.first)]).tolist():
            own = np.flatnonzero(a.w0 == t)
            w1, w2, around = a.w1[own], a.w2[own], a.around[own]
            for _, x, y, z in self.s[np.searchsorted(self.first, t) : np.searchsorted(self.first, t, side="right")]:
                out[own] += (w1 > x) | (w1 == x) & ((w2 > y) | (w2 == y) & (around >= z))
        return out if self.parts == 1 else out * self.parts + (_leads(a) % np.uint64(self.parts)).astype(np.int64)


def splitters(sample: Sequence[np.ndarray], ranges: int) -> np.ndarray:
    """Rows (lead, surroundings) that cut a sample of them into ranges of equal size."""
    if not len(sample[0]) or ranges < 2:
        return np.zeros((0, 4), dtype=np.uint64)
    order = multikey(sample)
    at = order[(np.arange(1, ranges) * len(order)) // ranges]
    rows = np.column_stack([k[at] for k in sample])
    keep = np.ones(len(rows), dtype=bool)
    keep[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    return rows[keep]


FULL = [np.int64, np.int32, np.int32]
OPEN = [np.int64, np.int32]


def _words(m: np.ndarray) -> list[np.ndarray]:
    """Columns of eight bytes, most significant first, of rows of bytes."""
    wide = np.zeros((len(m), -(-m.shape[1] // 8) * 8), dtype=np.uint8)
    wide[:, : m.shape[1]] = m
    return list(wide.view(">u8").astype(np.uint64).T)


def _agreement(lead: list[np.ndarray], m: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common bytes with the row before; -1 where the lead differs) for rows of bytes of given lengths."""
    order = multikey([*lead, *_words(m), size])
    a, b = m[order[1:]], m[order[:-1]]
    differs = a != b
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), m.shape[1])
    common = np.minimum(common, np.minimum(size[order[1:]], size[order[:-1]]))
    same = np.ones(len(order) - 1, dtype=bool)
    for k in lead:
        same &= k[order[1:]] == k[order[:-1]]
    return order, np.concatenate([[-1], np.where(same, common, -1)])


def compared(doc: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, before: np.ndarray, after: np.ndarray, c: Config) -> tuple[np.ndarray, np.ndarray]:
    """(first, stop): the bytes that each anchor's repeated windows cover, relative to the anchor; 0, 0 if none.

    before: the bytes to the left, nearest first. Rows must be in order of place.
    """
    n = len(doc)
    lowest, highest = np.full(n, -1), np.full(n, -1)
    if n < 2:
        return np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    lead = _words(after[:, :LEAD])
    by_right, common_right = _agreement(lead, after, right.astype(np.int64))
    by_left, common_left = _agreement(lead, before, left.astype(np.int64))
    rid, lid = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for d in range(c.reach + 1):
        need = c.span - d
        rid[by_right] = np.cumsum(common_right < need)
        lid[by_left] = np.cumsum(common_left < d)
        fits = (left >= d) & (right >= need)
        fits &= (np.bincount(rid[fits], minlength=n + 1)[rid] > 1) & (np.bincount(lid[fits], minlength=n + 1)[lid] > 1)
        rows = np.flatnonzero(fits)
        if len(rows) < 2:
            continue
        _, first = np.unique(rid[rows] * (n + 1) + lid[rows], return_index=True)
        again = np.ones(len(rows), dtype=bool)
        again[first] = False
        rows = rows[again]
        lowest[rows] = np.where(lowest[rows] < 0, d, lowest[rows])
        highest[rows] = d
    hit = highest >= 0
    return np.where(hit, -highest, 0), np.where(hit, c.span - lowest, 0)


def removed_runs(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that the stretches [lo, hi) cover."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    starts = np.flatnonzero(new)
    return lo[starts], hi[np.concatenate([starts[1:], [len(lo)]]) - 1]


def _identified(documents: DataFrame, key: str, text: str, keep: Sequence[str]) -> tuple[DataFrame, int, int]:
    """(rows (doc, id, text, keep...) with a number of their own in doc, bytes of text, rows).

    The number is the id where ids are unique. Where they are not, rows are written with a number and ranked by id, hash
    of the text and number.
    """
    columns = [F.col(key).cast("long").alias("id"), whole(text).alias("text"), *(F.col(k).alias(f"keep_{i}") for i, k in enumerate(keep))]
    rows = documents.where(F.col(key).isNotNull()).select(*columns)
    by_id = rows.groupBy("id").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n"))
    total, count, most = by_id.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if most > 1:
        rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
        ranks = numbered(rows.select("id", "row", F.md5(F.col("text").cast("binary")).alias("hash")), "id", "hash", "row", name="doc")
        return rows.join(ranks.select("row", "doc"), "row").drop("row"), total, count
    return rows.withColumn("doc", F.col("id")), total, count


def dedup(documents: DataFrame, c: Config = Config(), key: str = "doc_id", text: str = "text", keep: Sequence[str] = (), as_text: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept, keep...): kept holds the remaining bytes.

    as_text: kept is a string; of characters that a cut splits nothing stays. keep: further columns to carry along.
    """
    spark = documents.sparkSession
    bounded(spark)
    parts = spread(spark)
    rows, total, count = _identified(documents, key, text, keep)
    groups = max(parts, -(-total // c.share))
    ranges = max(4 * parts, -(-total // c.share))
    coarse = min(ranges, SPLITTERS)
    least = max(c.sample, coarse)  # a text has some fifty anchors
    given = max(8, min(GIVEN, 2_000_000 // least))

    def sampled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, 1, SLICE):
            blobs = []
            for doc, raw in zip(b.column(0).to_numpy(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                a = anchors(np.array([doc]), [raw], c)
                some = np.argsort(mixed(a.around), kind="stable")[:given]
                blobs.append(_packed(*(getattr(a, k)[some] for k in (*WORDS, "around"))))
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary())], ["blob"])

    every = max(1, count // least)
    # the splitters only level the ranges; which rows are sampled changes no result
    some = rows.select("doc", "text").where(F.pmod(F.xxhash64("doc", F.lit("splitters")), F.lit(every)) == 0).limit(2 * least)
    sample = _unpacked([r[0] for r in some.mapInArrow(releasing(sampled), "blob binary").collect()], [np.uint64] * 4)
    edges = Ranges(splitters(sample, coarse), -(-ranges // coarse))

    def suffixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, 1, SLICE):
            a = anchors(b.column(0).to_numpy(), b.column(1).cast(pa.binary()).to_pylist(), c)
            if not len(a.w0):
                continue
            order, _, full = _settle(a)
            a = a.take(order)
            bucket = edges.of(a)
            # what is settled here only passes through: it is dealt out evenly and not by its key
            bucket[full] = a.doc[full] % edges.count
            names, blobs = [], []
            for i, own in _dealt(bucket):
                first, again = own[~full[own]], own[full[own]]
                f, s = a.take(first), a.take(again)
                names.append(i)
                blobs.append(_packed(*(getattr(f, k) for k in FIELDS), s.doc, (s.at - s.left).astype(np.int32), (s.at + s.right).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def settle(t: pa.Table) -> pa.Table:
        got = _unpacked(t.column("blob").to_pylist(), [*FIELDS.values(), *FULL])
        a, (doc, lo, hi) = Anchors(*got[: len(FIELDS)]), got[len(FIELDS) :]
        del got
        order, shares, full = _settle(a)
        a = a.take(order)
        # the first of a surroundings stays open if its lead has another one, here or across the border
        run = np.cumsum(~shares)
        kinds = np.bincount(run, ~full, minlength=run[-1] + 1 if len(run) else 1)
        wide = kinds[run] > 1
        for i in (0, len(run) - 1) if len(run) else ():
            if (int(a.w0[i]), int(a.w1[i]), int(a.w2[i])) in edges.cut:
                wide |= run == run[i]
        left, right = a.at - a.left.astype(np.int32), a.at + a.right.astype(np.int32)
        doc, lo, hi = (np.concatenate(x) for x in ((doc, a.doc[full]), (lo, left[full]), (hi, right[full])))
        pending = np.flatnonzero(wide & ~full)
        return _for_groups(doc, lo, hi, a.doc[pending], a.at[pending])

    def _for_groups(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, open_doc: np.ndarray, open_at: np.ndarray) -> pa.Table:
        full = dict(_dealt(_group_of(doc, groups))) if len(doc) else {}
        pending = dict(_dealt(_group_of(open_doc, groups))) if len(open_doc) else {}
        nothing = np.zeros(0, dtype=np.int64)
        names = sorted(full.keys() | pending.keys())
        blobs = []
        for g in names:
            f, p = full.get(g, nothing), pending.get(g, nothing)
            blobs.append(_packed(doc[f], lo[f].astype(np.int32), hi[f].astype(np.int32), open_doc[p], open_at[p].astype(np.int32)))
        return pa.table({"grp": pa.array(names, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    ordered = rows.select("doc", "text").mapInArrow(releasing(suffixes), "bucket int, blob binary")
    marks = cut(ordered.groupBy("bucket").applyInArrow(releasing_group(settle), "grp int, blob binary"))
    carried = [f"keep_{i}" for i in range(len(keep))]
    texts = _grouped(rows, int(groups)).select("grp", "doc", "text", "id", *carried)
    hot = np.array(sorted({x[0] for x in edges.hot}), dtype=np.uint64)

    def surroundings(t: pa.Table, m: pa.Table) -> pa.Table:
        doc, at = _unpacked(m.column("blob").to_pylist(), [*FULL, *OPEN])[3:]
        names, blobs = [], []
        if len(doc):
            raw = dict(zip(t.column("doc").to_pylist(), t.column("text").cast(pa.large_binary()).to_pylist(), strict=True))
            own, back = np.unique(doc, return_inverse=True)
            whole_texts = [raw[d] for d in own.tolist()]
            size = np.fromiter(map(len, whole_texts), dtype=np.int64, count=len(own))
            blob = np.frombuffer(b"".join([*whole_texts, bytes(c.span)]), dtype=np.uint8)
            start = np.cumsum(size) - size
            for i in range(0, len(doc), 10_000):
                d, a, k = doc[i : i + 10_000], at[i : i + 10_000].astype(np.int64), back[i : i + 10_000]
                left, right = np.minimum(c.reach, a), np.minimum(c.span, size[k] - a)
                p = start[k] + a
                after = blob[np.minimum(p[:, None] + np.arange(c.span), len(blob) - 1)] * (np.arange(c.span) < right[:, None])
                before = blob[np.maximum(p[:, None] - 1 - np.arange(c.reach), 0)] * (np.arange(c.reach) < left[:, None])
                words = _words(after[:, :LEAD])
                name = mixed(mixed(mixed(words[0]) + words[1]) + words[2])
                is_hot = np.isin(words[0], hot)
                for b, rows_ in _dealt((name % np.uint64(ranges)).astype(np.int64)):
                    rows_ = rows_[~is_hot[rows_]]
                    if len(rows_):
                        names.append(b)
                        blobs.append(_packed(*_contexts(d, a, left, right, before, after, rows_), *([np.zeros(0, dtype=np.uint64)] * 2), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)))
                if is_hot.any():
                    j = np.flatnonzero(is_hot)
                    for b, part in _windows(d[j], a[j], left[j], right[j], before[j], after[j], c, int(ranges)):
                        names.append(b)
                        blobs.append(part)
        return pa.table({"bucket": pa.array(names, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    kinds = [np.int64, np.int32, np.uint8, np.uint8, np.uint8, np.uint8, np.uint64, np.uint64, np.int64, np.int32]

    def compare(t: pa.Table) -> pa.Table:
        doc, at, left, right, before, after, h1, h2, wdoc, wat = _unpacked(t.column("blob").to_pylist(), kinds)
        order = np.lexsort((at, doc))
        order = order[np.concatenate([[True], (np.diff(doc[order]) != 0) | (np.diff(at[order]) != 0)])] if len(order) else order
        before, after = before.reshape(-1, c.reach)[order], after.reshape(-1, c.span)[order]
        doc, at, left, right = doc[order], at[order], left[order], right[order]
        first, stop = compared(doc, at, left, right, before, after, c)
        hit = stop > first
        doc, lo, hi = doc[hit], (at + first)[hit], (at + stop)[hit]
        if len(h1):
            order = multikey([h1, h2, wdoc, wat])
            again = np.zeros(len(order), dtype=bool)
            again[1:] = (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]])
            w = order[_later(again, wdoc[order], wat[order])]
            doc, lo, hi = np.concatenate([doc, wdoc[w]]), np.concatenate([lo, wat[w]]), np.concatenate([hi, wat[w] + c.span])
        nothing = np.zeros(0, dtype=np.int64)
        return _for_groups(doc, lo, hi, nothing, nothing)

    def remove(t: pa.Table, m: pa.Table) -> pa.Table:
        """A row for each document: what is left of its text."""
        doc, lo, hi = _unpacked(m.column("blob").to_pylist(), [*FULL, *OPEN])[:3]
        order = np.argsort(doc, kind="stable")
        doc, lo, hi = doc[order], lo[order], hi[order]
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for d, raw in zip(t.column("doc").to_pylist(), t.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
            a, b = np.searchsorted(doc, [d, d + 1]) if d < 2**63 - 1 else (np.searchsorted(doc, d), len(doc))
            gone = 0
            spans = 0
            left = raw
            if b > a:
                x, y = removed_runs(lo[a:b], np.minimum(hi[a:b], len(raw)))
                x, y = x[y > x].tolist(), y[y > x].tolist()
                left = b"".join(raw[i:j] for i, j in zip([0, *y], [*x, len(raw)], strict=True))
                gone, spans = len(raw) - len(left), len(x)
            n_bytes.append(len(raw))
            n_removed.append(gone)
            n_spans.append(spans)
            kept.append(left.decode("utf-8", "ignore") if as_text else left)
        made = [pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)]
        made.append(pa.array(kept, pa.string() if as_text else pa.binary()))
        return pa.table([t.column("id"), *made, *(t.column(k) for k in carried)], names=["id", "n_bytes", "n_removed", "n_spans", "kept", *carried])

    by_grp = texts.groupBy("grp")
    found = by_grp.cogroup(marks.groupBy("grp")).applyInArrow(releasing_group(surroundings), "bucket int, blob binary")
    found = found.groupBy("bucket").applyInArrow(releasing_group(compare), "grp int, blob binary")
    kinds_kept = "".join(f", keep_{i} {documents.schema[k].dataType.simpleString()}" for i, k in enumerate(keep))
    schema = f"id long, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}{kinds_kept}"
    out = by_grp.cogroup(marks.unionByName(found).groupBy("grp")).applyInArrow(releasing_group(remove), schema)
    out = out.select(F.col("id").alias(key), "n_bytes", "n_removed", "n_spans", "kept", *(F.col(f"keep_{i}").alias(k) for i, k in enumerate(keep)))
    t = whole(text).cast("binary")
    lost = documents.where(F.col(key).isNull()).select(F.lit(None).cast("long").alias(key), F.octet_length(t).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), (whole(text) if as_text else t).alias("kept"), *keep)
    return out.unionByName(lost)


def _contexts(d: np.ndarray, a: np.ndarray, left: np.ndarray, right: np.ndarray, before: np.ndarray, after: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    return d[rows], a[rows].astype(np.int32), left[rows].astype(np.uint8), right[rows].astype(np.uint8), before[rows].ravel(), after[rows].ravel()


def _windows(d: np.ndarray, a: np.ndarray, left: np.ndarray, right: np.ndarray, before: np.ndarray, after: np.ndarray, c: Config, ranges: int) -> Iterator[tuple[int, bytes]]:
    """For anchors of a hot lead: two hashes of each of their windows, dealt out by the first."""
    line = np.concatenate([before[:, ::-1], after], axis=1)
    sums = []
    for seed in (1, 2):
        values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed + 64 * c.seed))
        up, down = _powers(line.shape[1] + 1)
        s = np.zeros((len(line), line.shape[1] + 1), dtype=np.uint64)
        np.cumsum(values[line] * up[: line.shape[1]], axis=1, out=s[:, 1:])
        sums.append((s, down))
    h: list[list[np.ndarray]] = [[], []]
    docs, starts = [], []
    for k in range(c.reach + 1):
        p = c.reach - k
        ok = np.flatnonzero((left >= k) & (right >= c.span - k))
        for x, (s, down) in zip(h, sums, strict=True):
            x.append(mixed((s[ok, p + c.span] - s[ok, p]) * down[p]))
        docs.append(d[ok])
        starts.append((a[ok] - k).astype(np.int32))
    h1, h2, doc, start = np.concatenate(h[0]), np.concatenate(h[1]), np.concatenate(docs), np.concatenate(starts)
    none = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32), *([np.zeros(0, dtype=np.uint8)] * 4))
    for b, rows in _dealt((h1 % np.uint64(ranges)).astype(np.int64)):
        yield b, _packed(*none, h1[rows], h2[rows], doc[rows], start[rows])


def with_sha(kept: DataFrame) -> DataFrame:
    return kept.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
