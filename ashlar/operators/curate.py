"""Curation of paper collections: admission, deduplication, scores, orders and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.text import normal_title
from ..shared import cut, numbered


def admit(papers: DataFrame, title: int = 10, abstract: int = 50) -> DataFrame:
    return papers.where((F.length("title") >= title) & (F.length("abstract") >= abstract))


def collected(papers: DataFrame) -> DataFrame:
    """Papers as collected: at most five authors, dates and ids filled in; short titles and abstracts left out."""
    date = F.coalesce(F.nullif(F.col("published"), F.lit("")), F.concat(F.col("year").cast("string"), F.lit("-01-01")))
    return admit(papers).withColumns(
        {"authors": F.slice("authors", 1, 5), "published": date, "id": F.coalesce(F.nullif(F.col("id"), F.lit("")), F.hex(F.xxhash64("title")))}
    )


def standardised(papers: DataFrame) -> DataFrame:
    t, a = F.trim(F.coalesce("title", F.lit(""))), F.trim(F.coalesce("abstract", F.lit("")))
    out = papers.withColumns({"title": t, "abstract": a, "source": F.coalesce("source", F.lit("collected")), "published": F.coalesce("published", "publicationDate")})
    return admit(out, 5, 20)


def first_seen(batches: DataFrame, key: str = "id", order: str = "batch") -> DataFrame:
    """Of each id the row of the earliest batch; of several there, the one with the lowest hash. Aggregated before the shuffle."""
    row = F.struct(*batches.columns)
    return batches.groupBy(F.col(key).alias("_key")).agg(F.min_by(row, F.struct(order, F.xxhash64(F.to_json(row)))).alias("_row")).select("_row.*")


def not_duplicates(new: DataFrame, old: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Rows of new that no row of old repeats: by id, by normalised title, or by a title that holds the other and is
    not much longer.

    The first two are equi joins. In the third, the shorter title covers the core of the longer one, the part that is
    left without what it may lack at either end: the longer is filed under the piece of its core with the lowest hash,
    and the shorter looks up the lowest piece of each stretch of its own as long as the shortest such core, two or
    three as a rule. So a title travels a few times whatever its length, and only pairs that share a piece are compared.
    """
    if ratio < 0.8:
        raise ValueError("ratio must be at least 0.8: the pieces are sized for it")
    # both sides are met several times: titles are normalised once, and written
    n = cut(new.select("id", normal_title("title").alias("nt")))
    o = cut(old.select(F.col("id").alias("oid"), normal_title("title").alias("ot")))
    fresh = n.join(o.select(F.col("oid").alias("id")).distinct(), "id", "left_anti").join(o.select(F.col("ot").alias("nt")).distinct(), "nt", "left_anti")
    left = fresh.select("id", "nt").where("nt <> ''")
    right = o.select("ot").distinct().where("ot <> ''")
    inside = _pieces(left, "nt", ratio).join(_core(right, "ot", ratio), "piece").where("length(nt) <= length(ot) AND contains(ot, nt)")
    around = _core(left, "nt", ratio).join(_pieces(right, "ot", ratio), "piece").where("length(ot) <= length(nt) AND contains(nt, ot)")
    close = inside.select("id", "nt", "ot").unionByName(around.select("id", "nt", "ot"))
    close = close.where(F.least(F.length("nt"), F.length("ot")) / F.greatest(F.length("nt"), F.length("ot")) > ratio).select("id").distinct()
    return new.join(fresh.select("id"), "id", "left_semi").join(close, "id", "left_anti")


#: (least, below, piece): how many characters titles of a length are filed under.
PIECES = ((1, 5, 1), (5, 16, 4), (16, 32, 8), (32, 64, 16), (64, 256, 32), (256, 1 << 30, 128))


def _lacks(n: int, ratio: float) -> int:
    """The most characters that a title within one of n may lack."""
    d = int(n * (1 - ratio)) + 1
    while d and (n - d) / n <= ratio:
        d -= 1
    return d


def _hashes(t: str, k: int) -> np.ndarray:
    """A hash of each piece of k characters."""
    h = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    h, have, power = h * np.uint64(0x9E3779B97F4A7C15), 1, 0x9E3779B97F4A7C15
    h ^= h >> np.uint64(29)
    while have < k:  # k is a power of two
        h = h[:-have] * np.uint64(power | 1) + h[have:]
        power, have = power * 0xBF58476D1CE4E5B9 % (1 << 64), have * 2
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _filed(t: str, ratio: float) -> list[tuple[int, int]]:
    n, d = len(t), _lacks(len(t), ratio)
    k = next(k for least, below, k in PIECES if least <= n < below)
    return [(k, int(_hashes(t[d : n - d], k).min().view(np.int64)))]


def _looked_up(t: str, ratio: float) -> list[tuple[int, int]]:
    n, found = len(t), []
    for least, below, k in PIECES:
        # lengths of titles of this class that t can be within; the core is shortest for one of them
        low, high = max(n, least), min(below - 1, int(n / ratio) + 1)
        if low > high:
            continue
        # cores grow with the length but for steps of two, so the shortest is among the first
        width = min(m - 2 * _lacks(m, ratio) for m in range(low, min(high, low + 64) + 1)) - k + 1
        h = _hashes(t, k) if n >= k else np.zeros(0, dtype=np.uint64)
        if len(h) < width or width < 1:
            continue
        lows, size = h, 1
        while size < width:  # the lowest of width neighbours, by doubling
            step = min(size, width - size)
            lows = np.minimum(lows[:-step], lows[step:])
            size += step
        found += [(k, int(x)) for x in np.unique(lows).view(np.int64)]
    return found


def _core(titles: DataFrame, c: str, ratio: float) -> DataFrame:
    return _with_pieces(titles, c, lambda t: _filed(t, ratio))


def _pieces(titles: DataFrame, c: str, ratio: float) -> DataFrame:
    return _with_pieces(titles, c, lambda t: _looked_up(t, ratio))


def _with_pieces(titles: DataFrame, c: str, of: Callable[[str], list[tuple[int, int]]]) -> DataFrame:
    """titles with each of their pieces, its length and hash."""
    at = titles.columns.index(c)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*row, f"{k} {h}") for row in pdf.itertuples(index=False, name=None) for k, h in of(row[at])]
            yield pd.DataFrame(rows, columns=[*pdf.columns, "piece"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in titles.schema)
    return titles.mapInPandas(run, f"{fields}, piece string")


def integrate(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(not_duplicates(standardised(new), old), allowMissingColumns=True)


def ordered(papers: DataFrame) -> DataFrame:
    return papers.orderBy(scores.corpus_score("citationCount", "quality_score", "year").desc(), "id")


def collected_order(papers: DataFrame) -> DataFrame:
    """The order of a collection before it is integrated."""
    return papers.orderBy(scores.collected_score("citationCount", "quality_score").desc(), "id")


def statistics(papers: DataFrame, by: tuple[str, ...] = ("year", "venue", "category"), citations: str = "citationCount", quality: str = "quality_score") -> DataFrame:
    """(by, value, n, avg_citations, avg_quality) of each value of each column, nulls apart, in one pass."""
    g = papers.groupingSets([[F.col(k)] for k in by], *by).agg(F.grouping_id().alias("_g"), F.count("*").alias("n"), F.avg(citations).alias("avg_citations"), F.avg(quality).alias("avg_quality"))
    mine = [F.col("_g").bitwiseAND(1 << (len(by) - 1 - i)) == 0 for i in range(len(by))]
    value = F.coalesce(*(F.when(m, F.col(k).cast("string")) for m, k in zip(mine, by, strict=True)))
    name = F.coalesce(*(F.when(m, F.lit(k)) for m, k in zip(mine, by, strict=True)))
    return g.select(name.alias("by"), value.alias("value"), "n", "avg_citations", "avg_quality").where("value IS NOT NULL")


def distribution(papers: DataFrame, by: str) -> DataFrame:
    return papers.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"))


def report(papers: DataFrame, citations: str = "citationCount", quality: str = "quality_score") -> DataFrame:
    c = F.col(citations)
    return papers.agg(
        F.count("*").alias("total"),
        F.count_if(c > 0).alias("cited"),
        F.avg(F.when(c > 0, c)).alias("avg_citations"),
        F.max(F.when(c > 0, c)).alias("max_citations"),
        F.count_if(c >= 100).alias("highly_cited"),
        F.avg(quality).alias("avg_quality"),
    )


def top_years(papers: DataFrame, year: str = "year", n: int = 5) -> DataFrame:
    return distribution(papers, year).orderBy(F.desc("n"), F.desc(year)).limit(n)


def quotas(batches: DataFrame, target: int, floors: tuple[int, ...] = (100, 50, 20), keyword: str = "keyword", citations: str = "citations") -> DataFrame:
    """The batch form of collecting by keywords: in each third of them another floor of citations, and the best rows
    up to each keyword's share, between 10 and 100."""
    words = batches.select(keyword).where(F.col(keyword).isNotNull()).distinct()
    place = numbered(words, keyword, name="_place").withColumn("_place", F.col("_place") - 1)
    rows = batches.join(place, keyword).crossJoin(F.broadcast(words.agg(F.count("*").alias("k"))))  # one row
    floor = F.element_at(F.array(*map(F.lit, floors)), F.least((F.col("_place") * len(floors) / F.col("k")).cast("int"), F.lit(len(floors) - 1)) + 1)
    share = F.least(F.greatest((F.lit(target) / F.col("k")).cast("int"), F.lit(10)), F.lit(100))
    w = Window.partitionBy(keyword).orderBy(F.desc(citations), "id")
    return rows.where(F.col(citations) >= floor).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= share).drop("_place", "k", "_n")
