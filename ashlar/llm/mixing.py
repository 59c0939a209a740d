"""Mixing sources to target weights by iterative proportional fitting, in DataFrame and SQL functions only.

Documents fall into cells (source, language, topic). The cells' token counts are the seed; raking scales them until
their sums over sources, languages and topics meet the targets. Each document is then kept with the probability of its
cell, calibrated to the budget. Without a budget the sample is the largest that meets the targets: the cell with the
highest ratio of fitted to held weight is kept whole, ``p = ratio / highest ratio``. With one, the expected tokens of
the sample meet it: ``min(1, f * fitted / tokens)``, with f found exactly from the sorted cells; a budget above the
largest one that the targets allow pulls the sample towards what is held (``shares`` tells how far). The draw is a
keyed hash of the id, so runs agree and a larger budget keeps a superset.

A topic is any column expression over documents; by default it is one of form (table rows, short notes, long reads,
prose), as there is no column for it. Every value without a target of its own counts as ``other``, so the number of
cells is bounded by the targets given and not by the data. Null source, language or text: ``other`` / ``other`` / the
topic of an empty text. Copies with equal ids share their draw; null ids share one, too. Empty tables give empty
results. Input columns named ``_source``, ``_lang``, ``_topic``, ``_tokens`` or ``_p`` give way to the operator's.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, whole

DIMENSIONS = ("source", "lang", "topic")
OTHER = "other"


@dataclass(frozen=True)
class Mix:
    """Targets: value -> share for each dimension; what is left to 1 goes to ``other``, which keeps the share it holds if
    nothing is left.

    budget: share of all tokens, None for the most that meets the targets. boost: a value's share grows to so many times
    what it holds at most, and the others take the rest, so that a rare value does not shrink the sample. rounds: of raking.
    """

    source: Mapping[str, float]
    lang: Mapping[str, float]
    topic: Mapping[str, float]
    budget: float | None = None
    boost: float = 2.0
    rounds: int = 24
    seed: int = 7

    def shares(self, dimension: str) -> dict[str, float]:
        given = dict(getattr(self, dimension))
        if any(v < 0 for v in given.values()) or sum(given.values()) > 1 + 1e-9:
            raise ValueError(f"shares of {dimension} must be at least 0 and add up to 1 at most")
        given[OTHER] = max(0.0, round(1 - sum(v for k, v in given.items() if k != OTHER), 9))
        return given


#: All sources alike, whichever of them is hot; languages and topics near what a balanced corpus of prose holds.
DEFAULT = Mix(
    source={f"src{i}": 0.05 for i in range(20)},
    lang={"en": 0.6, "fr": 0.15, "de": 0.15, "es": 0.1},
    topic={"long": 0.35, "short": 0.02, "prose": 0.62, "table": 0.01},
)


def tokens(text: Column) -> Column:
    """Words as spaces and line ends part them; 0 for an empty text."""
    bare = F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(bare) + 1).cast("long")


def topic(text: Column) -> Column:
    """A topic by form, in native functions: table rows, short notes, long reads, prose."""
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when(F.length(text) < 600, "short")
        .when(F.length(text) >= 6000, "long")
        .otherwise("prose")
    )


def _of(column: Column, known: Mapping[str, float]) -> Column:
    return F.when(column.isin([k for k in known if k != OTHER]), column).otherwise(OTHER)


def celled(documents: DataFrame, mix: Mix, by: Column | None = None) -> DataFrame:
    """documents with the columns _source, _lang, _topic (by: its expression), _tokens."""
    t = whole("text")
    return documents.withColumns(
        {
            "_source": _of(F.col("source"), mix.shares("source")),
            "_lang": _of(F.col("lang"), mix.shares("lang")),
            "_topic": _of(topic(t) if by is None else by, mix.shares("topic")),
            "_tokens": tokens(t),
        }
    )


def rake(documents: DataFrame, mix: Mix = DEFAULT, by: Column | None = None) -> DataFrame:
    """(_source, _lang, _topic, tokens, docs, fitted, p): cells with fitted weights and sampling probability.

    Shares whose value does not occur are spread over the values that do; without a share for any of them, they keep what
    they hold. The fitting runs over the cells, which the
    targets bound, as array functions in one row.
    """
    # written: the documents are read once, and what follows reads a row for each cell
    cells = cut(celled(documents, mix, by).groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("docs")).where("tokens > 0"))
    row = cells.groupBy().agg(F.array_sort(F.collect_list(F.struct("_source", "_lang", "_topic", "tokens", "docs"))).alias("cells"), F.sum("tokens").alias("total"))
    row = row.where(F.size("cells") > 0).withColumn("w", F.transform("cells", lambda c: c["tokens"] / F.col("total")))
    for d in DIMENSIONS:
        row = _aligned(row.crossJoin(F.broadcast(goals(cells, d, mix))), d)  # one row each
    row = cut(row)

    def one(w: Column, _: Column) -> Column:
        for d in DIMENSIONS:
            w = _step(w, d)
        return w

    row = row.withColumn("fit", F.aggregate(F.sequence(F.lit(1), F.lit(mix.rounds)), F.col("w"), one))
    flat = row.select("total", F.explode(F.arrays_zip("cells", "fit")).alias("c")).select("total", "c.cells.*", F.col("c.fit").alias("fitted"))
    return calibrated(flat, mix.budget)


#: Rounds in which values are settled at their bound.
SETTLED = 3


def goals(cells: DataFrame, d: str, mix: Mix) -> DataFrame:
    """One row, goals_: a map from the values of dimension d that occur to the shares that they are to have."""
    shares = mix.shares(d)
    given = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])
    every = Window.partitionBy()  # over values, which the targets bound
    t = cells.groupBy(F.col(f"_{d}").alias("v")).agg(F.sum("tokens").alias("n"))
    t = t.select("v", (F.col("n") / F.sum("n").over(every)).alias("h"), F.coalesce(F.try_element_at(given, "v"), F.lit(0.0)).alias("g"))
    # val: the share of a settled value; the others divide what is left by their targets, and those that would grow too far are settled
    t = t.withColumn("val", F.when(F.lit(shares[OTHER] == 0) & (F.col("v") == OTHER), F.col("h")))
    left = F.greatest(1 - F.sum(F.coalesce("val", F.lit(0.0))).over(every), F.lit(0.0)) / F.nullif(F.sum(F.when(F.col("val").isNull(), F.col("g")).otherwise(0.0)).over(every), F.lit(0.0))
    for _ in range(SETTLED):
        t = t.withColumn("s", left).withColumn("val", F.coalesce("val", F.when(F.col("g") * F.col("s") > mix.boost * F.col("h"), mix.boost * F.col("h"))))
    t = t.withColumn("s", left).withColumn("e", F.coalesce("val", F.col("g") * F.col("s"), "h"))
    t = t.withColumn("share", F.col("e") / F.sum("e").over(every))
    return t.agg(F.map_from_entries(F.collect_list(F.struct("v", "share"))).alias(f"goals_{d}"))


def _aligned(row: DataFrame, d: str) -> DataFrame:
    """Adds v_: the values that occur; i_: each cell's index in them; g_: the shares that they are to have."""
    row = row.withColumn(f"v_{d}", F.array_sort(F.array_distinct(F.col(f"cells._{d}"))))
    row = row.withColumn(f"i_{d}", F.transform(f"cells._{d}", lambda x: F.array_position(f"v_{d}", x).cast("int")))
    return row.withColumn(f"g_{d}", F.transform(f"v_{d}", lambda x: F.element_at(f"goals_{d}", x))).drop(f"goals_{d}")


def _step(weights: Column, d: str) -> Column:
    """weights scaled so that their sums over dimension d meet its shares."""

    def scaled(w: Column) -> Column:
        pairs = F.arrays_zip(w.alias("w"), F.col(f"i_{d}").alias("i"))
        scale = F.transform(
            F.sequence(F.lit(1), F.size(f"v_{d}")),
            lambda k: F.element_at(f"g_{d}", k) / F.nullif(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + F.when(x["i"] == k, x["w"]).otherwise(0.0)), F.lit(0.0)),
        )
        # one-element arrays bind a value to a name, so that it is computed once and not for each cell
        return F.element_at(F.transform(F.array(scale), lambda z: F.zip_with(w, F.col(f"i_{d}"), lambda x, i: x * F.coalesce(F.element_at(z, i), F.lit(0.0)))), 1)

    return F.element_at(F.transform(F.array(weights), scaled), 1)


def calibrated(cells: DataFrame, budget: float | None) -> DataFrame:
    """Adds p. With a budget, cells in falling order of fitted/tokens are kept whole while the factor would exceed 1 for them."""
    c = cells.withColumn("ratio", F.col("fitted") / F.col("tokens"))
    kept = ("_source", "_lang", "_topic", "tokens", "docs", "fitted")
    every = Window.partitionBy()  # over cells, which the targets bound
    if budget is None:
        return c.select(*kept, F.coalesce(F.col("ratio") / F.nullif(F.max("ratio").over(every), F.lit(0.0)), F.lit(0.0)).alias("p"))
    order = Window.orderBy(F.desc("ratio"), "_source", "_lang", "_topic")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    c = c.withColumn("f", (F.lit(budget) * F.col("total") - F.coalesce(F.sum("tokens").over(before), F.lit(0))) / F.sum("fitted").over(onward))
    factor = F.max(F.when(F.col("f") * F.col("ratio") <= 1, F.col("f"))).over(every)
    p = F.least(F.lit(1.0), F.coalesce(factor, F.lit(float("inf"))) * F.col("ratio"))
    return c.select(*kept, F.when(F.col("ratio") > 0, p).otherwise(0.0).alias("p"))


def shares(cells: DataFrame, mix: Mix = DEFAULT) -> DataFrame:
    """(dimension, value, target, held, got) from what ``rake`` gives: target shares, scaled to the values that occur, those of all tokens and those expected of the sample.

    The fitted shares, with ``other`` and ``boost`` taken into account, are the sums of ``fitted`` in ``rake``.
    """
    out = None
    for d in DIMENSIONS:
        goals = F.create_map(*[F.lit(x) for kv in mix.shares(d).items() for x in kv])
        one = cells.groupBy(F.lit(d).alias("dimension"), F.col(f"_{d}").alias("value")).agg(F.sum("tokens").alias("held"), F.sum(F.col("tokens") * F.col("p")).alias("got"))
        one = one.withColumn("target", F.coalesce(F.try_element_at(goals, "value"), F.lit(0.0)))
        out = one if out is None else out.unionByName(one)
    by = Window.partitionBy("dimension")
    return out.select("dimension", "value", *((F.col(c) / F.sum(c).over(by)).alias(c) for c in ("target", "held", "got")))


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 52 bits of a keyed MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def mix_sources(documents: DataFrame, mix: Mix = DEFAULT, key: str = "doc_id", by: Column | None = None) -> DataFrame:
    """The sampled documents with all their columns, and _source, _lang, _topic, _tokens, _p. by: the topic's expression."""
    cells = rake(documents, mix, by).select("_source", "_lang", "_topic", F.col("p").alias("_p"))
    # a row for each combination of target values at most
    joined = celled(documents.drop("_p"), mix, by).join(F.broadcast(cells), ["_source", "_lang", "_topic"], "left")
    return joined.where(draw(F.coalesce(F.col(key).cast("string"), F.lit("")), mix.seed) < F.coalesce("_p", F.lit(1.0)))
