"""Scalar scores and classifiers as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import any_of, col, word_set


def cascade(text: str | Column, classes: list, default: str) -> Column:
    """The first class of which the lower-case text holds a word."""
    t = F.lower(col(text))
    return F.coalesce(*(F.when(any_of(t, ws), F.lit(c)) for c, ws in classes), F.lit(default))


def query_type(q: str | Column) -> Column:
    return cascade(q, K.QUERY_TYPES, "general")


def difficulty(q: str | Column) -> Column:
    return cascade(q, K.DIFFICULTIES, "medium")


def category(q: str | Column) -> Column:
    return cascade(q, K.CATEGORIES, "general")


def intent_points(q: str | Column) -> dict[str, Column]:
    t = F.lower(col(q))
    return {i: reduce(lambda a, b: a + b, (t.rlike(p).cast("int") for p in ps)) for i, ps in K.INTENTS.items()}


def intent(q: str | Column) -> Column:
    """struct(intent, confidence): most points win, the earlier among equals; points over patterns."""
    points = intent_points(q)
    best = F.greatest(*points.values())
    choice = F.coalesce(*(F.when((best > 0) & (p == best), F.struct(F.lit(i).alias("intent"), (p / len(K.INTENTS[i])).alias("confidence"))) for i, p in points.items()))
    return F.coalesce(choice, F.struct(F.lit("general").alias("intent"), F.lit(1.0).alias("confidence")))


def expanded(q: str | Column, most: int = 3) -> Column:
    """The question with the first expansions of the terms it holds."""
    t = F.lower(col(q))
    hits = F.flatten(F.array(*(F.when(F.contains(t, F.lit(k)), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in K.EXPANSIONS.items())))
    return F.when(F.size(hits) > 0, F.concat_ws(" ", col(q), F.array_join(F.slice(hits, 1, most), " "))).otherwise(col(q))


def domains(text: str | Column) -> Column:
    t = F.lower(col(text))
    return F.filter(F.array(*(F.when(any_of(t, ws), F.lit(d)) for d, ws in K.DOMAINS.items())), lambda x: x.isNotNull())


def lookup(section: str | Column, values: dict[str, float], default: float) -> Column:
    return reduce(lambda c, kv: c.when(col(section) == kv[0], kv[1]), list(values.items())[1:], F.when(col(section) == next(iter(values)), next(iter(values.values())))).otherwise(default)


def overlap(a: str | Column, b: str | Column) -> Column:
    """Share of a's distinct words that b has; 0 without words."""
    x = word_set(a)
    return F.when(F.size(x) > 0, F.size(F.array_intersect(x, word_set(b))) / F.size(x)).otherwise(0.0)


def jaccard(a: str | Column, b: str | Column) -> Column:
    x, y = word_set(a), word_set(b)
    both = F.size(F.array_union(x, y))
    return F.when(both > 0, F.size(F.array_intersect(x, y)) / both).otherwise(0.0)


def similarity(distance: str | Column, metric: str = "cosine") -> Column:
    d = col(distance)
    return {"euclidean": 1 / (1 + d), "dot": d}.get(metric, F.greatest(F.lit(0.0), 1 - d))


def length_score(n: str | Column) -> Column:
    n = col(n)
    return F.when(n < 100, 0.3).when(n > 1500, 0.6).otherwise(1 - F.abs(n - 500) / 500 * 0.3)


def _flag(c: str | Column, value: float) -> Column:
    return F.when(col(c), value).otherwise(0.0)


def quality(formulas: str | Column, code: str | Column, citations: str | Column) -> Column:
    return F.least(F.lit(1.0), F.lit(0.5) + _flag(formulas, 0.2) + _flag(code, 0.1) + _flag(citations, 0.2))


def rerank_score(question: str | Column, content: str | Column, section: str | Column, formulas: str | Column, code: str | Column, citations: str | Column) -> Column:
    return (
        0.3 * overlap(question, content)
        + 0.2 * lookup(section, K.SECTION_RELEVANCE, 0.5)
        + 0.2 * quality(formulas, code, citations)
        + 0.1 * length_score(F.length(col(content)))
        + 0.1 * 0.5
        + 0.1 * F.when(col(citations), 1.0).otherwise(0.5)
    )


def fused(vector: str | Column, bm25: str | Column) -> Column:
    return 0.7 * col(vector) + 0.3 * F.least(col(bm25) / 10, F.lit(1.0))


def context_relevance(question: str | Column, content: str | Column, section: str | Column, base: str | Column, formulas: str | Column, citations: str | Column, code: str | Column) -> Column:
    w = lookup(section, K.SECTION_WEIGHTS, 1.0)
    bonus = _flag(formulas, 0.1) + _flag(citations, 0.1) + _flag(code, 0.05)
    return F.least(F.lit(1.0), (col(base) * 0.4 + overlap(question, content) * 0.4 + w * 0.1 + bonus * 0.1) * w)


def context_class(section: str | Column, title: str | Column) -> Column:
    s, t = F.lower(col(section)), F.lower(col(title))
    return F.when(any_of(s, ["abstract", "introduction"]), "overview").when(any_of(s, ["method", "algorithm"]), "technical").when(any_of(t, ["comparison", "vs"]), "comparison").otherwise("paper")


def priority(score: str | Column, qtype: str | Column, ctype: str | Column, section: str | Column) -> Column:
    q, c, s = col(qtype), col(ctype), F.lower(col(section))
    by_type = F.when((q == "technical") & (c == "technical"), 20).when((q == "definition") & (c == "overview"), 15).when((q == "comparison") & (c == "comparison"), 25).otherwise(0)
    by_section = F.when((q == "definition") & F.contains(s, F.lit("abstract")), 10).when((q == "technical") & F.contains(s, F.lit("method")), 15).otherwise(0)
    return (col(score) * 100).cast("int") + by_type + by_section


def citation_floor(year: str | Column, least: int) -> Column:
    y = F.coalesce(col(year), F.lit(0))
    return F.when(y >= 2020, max(least // 3, 10)).when(y >= 2018, least // 2).otherwise(least)


def in_venues(venue: str | Column) -> Column:
    return any_of(F.lower(F.coalesce(col(venue), F.lit(""))), [v.lower() for v in K.VENUES])


def quality_a(citations: str | Column, year: str | Column, title: str | Column, abstract: str | Column, venue: str | Column, now: int) -> Column:
    base = F.least(F.coalesce(col(citations), F.lit(0)) / 1000, F.lit(1.0))
    age = 1 / (1 + F.greatest(F.lit(now) - F.coalesce(col(year), F.lit(2020)), F.lit(1)) * 0.1)
    content = F.lit(1.0) + _flag(F.length(F.coalesce(col(abstract), F.lit(""))) > 500, 0.1) + _flag(any_of(F.lower(F.coalesce(col(title), F.lit(""))), K.TITLE_WORDS_A), 0.1)
    return F.least(F.lit(2.0), base * age * F.when(col(venue), 1.2).otherwise(1.0) * content)


def quality_b(citations: str | Column, title: str | Column, abstract: str | Column) -> Column:
    t, n = F.lower(F.coalesce(col(title), F.lit(""))), F.length(F.coalesce(col(abstract), F.lit("")))
    hits = reduce(lambda a, b: a + b, (F.contains(t, F.lit(w)).cast("int") for w in K.TITLE_WORDS_B))
    return F.least(F.coalesce(col(citations), F.lit(0)) / 10000, F.lit(2.0)) + 0.1 * hits + F.when(n > 1000, 0.2).when(n > 500, 0.1).otherwise(0.0)


def corpus_score(citations: str | Column, q: str | Column, year: str | Column) -> Column:
    return F.coalesce(col(citations), F.lit(0)) * 0.6 + F.coalesce(col(q), F.lit(0)) * 100 * 0.3 + (F.coalesce(col(year), F.lit(0)) - 2015) / 10 * 10


def collected_score(citations: str | Column, q: str | Column) -> Column:
    return F.coalesce(col(citations), F.lit(0)) * 0.7 + F.coalesce(col(q), F.lit(0)) * 100 * 0.3


def arxiv_id(name: str | Column) -> Column:
    """Without its version."""
    return F.regexp_replace(col(name), r"v\d+$", "")


def arxiv_urls(name: str | Column) -> dict[str, Column]:
    return {"url": F.concat(F.lit("https://arxiv.org/abs/"), arxiv_id(name)), "pdf_url": F.concat(F.lit("https://arxiv.org/pdf/"), arxiv_id(name), F.lit(".pdf"))}


def year_of(date: str | Column) -> Column:
    return F.substring(col(date), 1, 4).try_cast("int")


def cited_year(date: str | Column) -> Column:
    y = F.regexp_extract(F.coalesce(col(date), F.lit("")), r"\d{4}", 0)
    return F.when(y == "", "2024").otherwise(y)


def apa(authors: str | Column, year: str | Column, title: str | Column, paper: str | Column) -> Column:
    a = col(authors)
    names = F.when(F.size(a) == 1, a[0]).when(F.size(a) == 2, F.concat(a[0], F.lit(" & "), a[1])).when(F.size(a) > 2, F.concat(a[0], F.lit(" et al."))).otherwise("Unknown Author")
    return F.concat(names, F.lit(" ("), col(year), F.lit("). "), col(title), F.lit(". Retrieved from arXiv:"), col(paper))


def ieee(authors: str | Column, year: str | Column, title: str | Column, paper: str | Column) -> Column:
    a = col(authors)
    names = F.when(F.size(a) > 3, F.concat(a[0], F.lit(" et al."))).when(F.size(a) > 0, F.array_join(a, ", ")).otherwise("Unknown Author")
    return F.concat(names, F.lit(', "'), col(title), F.lit('," arXiv preprint arXiv:'), col(paper), F.lit(", "), col(year), F.lit("."))


def ladder(value: str | Column, steps: list[tuple[float, str]], default: str) -> Column:
    return F.coalesce(*(F.when(col(value) >= v, F.lit(s)) for v, s in steps), F.lit(default))


def confidence_label(v: str | Column) -> Column:
    return ladder(v, [(0.8, "high"), (0.6, "medium"), (0.4, "low")], "very low")


def recommendation(v: str | Column) -> Column:
    return ladder(v, [(0.8, "use as is"), (0.6, "verify key facts"), (0.4, "verify further"), (0.0, "gather more")], "gather more")


def grade(v: str | Column) -> Column:
    return ladder(v, [(0.8, "excellent"), (0.7, "good"), (0.6, "fair"), (0.5, "pass")], "needs work")


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    """0 with a zero vector. One root of the product of squares: whole numbers, such as counts, meet no error before it."""
    squares = dot(a, a) * dot(b, b)
    n = F.when(squares.between(1e-280, 1e280), F.sqrt(squares)).otherwise(norm(a) * norm(b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def clip(v: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))


def overall(relevance: str | Column, faithfulness: str | Column, answer: str | Column, precision: str | Column, recall: str | Column) -> Column:
    return clip(0.25 * col(relevance) + 0.3 * col(faithfulness) + 0.25 * col(answer) + 0.15 * col(precision) + 0.05 * col(recall))
