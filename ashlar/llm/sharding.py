"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Equal texts form a group. A group's load is the largest of its shares of all bytes, tokens and rows, measured in fair
shares of one shard. A group above one fair share is cut into pieces of a 64th of it (no shard can hold it and stay
level); groups above a 64th are packed as they are; all smaller ones are dealt by their hash into a fixed number of
lots. What is packed is so a bounded list of vectors whatever the size of the corpus. Groups, lots and pieces are packed
from the largest down, each into the shard where the dot product of its vector with the shard's residual capacity is
highest, among those whose capacity it overruns least.

Null text counts as empty: 16 bytes, no tokens; a null id is an id like any other. Repeated rows each get a slot of
their own. Which rows of a cut group lie in which piece follows from the order in which rows are read. An empty table
gives an empty result. Extra columns stay out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, whole

#: Bytes that each row takes besides its text.
ROW_BYTES = 16
#: Lots for each shard, pieces of a cut group for each shard's share, and the parts in which rows of an item are numbered.
LOTS, PIECES, PARTS = 64, 64, 16
#: Dimensions that are balanced.
BALANCED = ("bytes", "tokens", "n")


def digest(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What packing needs of each document: (key, size, text_crc32, tokens, grp); grp is a 64-bit hash of the text."""
    t = whole(text)
    spaces = F.length(t) - F.length(F.replace(F.replace(t, F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")))
    return documents.select(
        F.col(key),
        (F.octet_length(t) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.when(t == "", 0).otherwise(spaces + 1).cast("long").alias("tokens"),
        F.xxhash64(t).alias("grp"),
    )


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each row of items (n x dimensions), by the highest dot product with residual capacity.

    Dimensions are scaled by their totals; a shard's capacity is its fair share in each. Among shards, those in which
    the item overruns the share least come first; dot product decides among the rest, then the lowest number.
    """
    total = np.maximum(items.sum(axis=0), 1).astype(float)
    load = items / total * shards
    left = np.ones((shards, items.shape[1]))
    out = np.zeros(len(items), dtype=int)
    for i in np.lexsort((np.arange(len(items)), -load.max(axis=1))):
        over = np.maximum(load[i] - left, 0).max(axis=1)
        fits = over <= over.min() + 1e-12
        score = np.where(fits, left @ load[i], -np.inf)
        out[i] = int(np.argmax(score))
        left[out[i]] -= load[i]
    return out


def _loads(rows: DataFrame, shards: int) -> dict[int, float]:
    """Of the groups above a 64th of a shard's share: their load. There are 3 * 64 * shards of them at most."""
    groups = rows.groupBy("grp").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    totals = rows.agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")).first()
    share = {d: max(totals[d] or 0, 1) / shards for d in BALANCED}
    load = F.greatest(*(F.col(d) / F.lit(float(share[d])) for d in BALANCED))
    return {g: x for g, x in groups.select("grp", load.alias("load")).where(F.col("load") > 1 / PIECES).collect()}


def shard(documents: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, tokens, shard, slot): slots number each shard's rows from 0 without gaps."""
    spark = documents.sparkSession
    # written once: what follows reads digests and not texts, and a row keeps its number
    rows = cut(digest(documents, key, text).withColumn("row", F.monotonically_increasing_id()))
    loads = _loads(rows, shards)
    lot = F.concat(F.lit("lot"), F.pmod("grp", F.lit(shards * LOTS)))
    if loads:
        # a piece of a cut group holds what a 64th of a share does; a bounded table, see _loads
        known = spark.createDataFrame([(g, int(x * PIECES) + 1 if x > 1 else 1) for g, x in sorted(loads.items())], "grp long, pieces int")
        piece = F.pmod(F.xxhash64("row", F.lit("piece")), "pieces")
        rows = rows.join(F.broadcast(known), "grp", "left")
        rows = rows.withColumn("item", F.when(F.col("pieces").isNull(), lot).otherwise(F.concat(F.lit("group"), "grp", F.lit(":"), piece)))
    else:
        rows = rows.withColumn("item", lot)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row", F.lit("part")), F.lit(PARTS)).cast("int"))
    parts = rows.groupBy("item", "part").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()
    # bounded: (lots + groups + pieces) x parts, whatever the input
    names = sorted({p["item"] for p in parts})
    at = {n: i for i, n in enumerate(names)}
    vectors = np.zeros((len(names), len(BALANCED)))
    for p in parts:
        vectors[at[p["item"]]] += [p[d] for d in BALANCED]
    place = pack(vectors, shards)
    start, used = [], [0] * shards
    for p in sorted(parts, key=lambda p: (p["item"], p["part"])):
        s = int(place[at[p["item"]]])
        start.append((p["item"], p["part"], s, used[s]))
        used[s] += p["n"]
    starts = spark.createDataFrame(start, "item string, part int, shard int, base long")
    # rows of one item and part: a fixed fraction of a shard, numbered apart from the others
    own = Window.partitionBy("item", "part").orderBy("row")
    ranked = rows.withColumn("rn", F.row_number().over(own))
    return ranked.join(F.broadcast(starts), ["item", "part"]).select(
        key, "size", "text_crc32", "tokens", "shard", (F.col("base") + F.col("rn") - 1).alias("slot")
    )
