"""Claims, their support in sources, citations and answer quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scores
from ..functions.text import word_set
from ..shared import numbered


def claims(answers: DataFrame, q: str = "q", text: str = "answer", longer: int = 20, most: int = 10) -> DataFrame:
    """(q, claim_no, claim): sentences that state something, pattern by pattern in order, each once, ten at most."""
    found = F.flatten(F.array(*(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)) for p in K.CLAIMS)))
    kept = F.slice(F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: F.length(x) > longer)), 1, most)
    return answers.select(F.col(q).alias("q"), F.posexplode(kept).alias("claim_no", "claim"))


def support(stated: DataFrame, sources: DataFrame, least: float = 0.3) -> DataFrame:
    """(q, claim_no, claim, supporting, contradicting, confidence, level) over the sources (q, doc, content) of the same question."""
    pairs = stated.join(sources, "q", "left")
    mine = word_set("claim")
    rel = F.size(F.array_intersect(mine, word_set("content"))) / F.size(mine)
    low = F.lower("content")
    count = lambda ws: sum((F.contains(low, F.lit(w)).cast("int") for w in ws[1:]), F.contains(low, F.lit(ws[0])).cast("int"))
    pairs = pairs.withColumns({"relevance": F.when(rel > least, rel), "side": F.signum((count(K.SUPPORT) - count(K.CONTRADICT)).cast("double"))})
    near = F.col("relevance").isNotNull()
    g = pairs.groupBy("q", "claim_no", "claim").agg(
        F.count_if(near & (F.col("side") > 0)).alias("supporting"), F.count_if(near & (F.col("side") < 0)).alias("contradicting"), F.avg("relevance").alias("avg_relevance")
    )
    total = F.col("supporting") + F.col("contradicting")
    g = g.withColumn("confidence", F.when(total > 0, F.col("supporting") / total * F.col("avg_relevance")).otherwise(0.0))
    level = (
        F.when(total == 0, "insufficient_data")
        .when(F.col("confidence") >= 0.8, "strong")
        .when(F.col("confidence") >= 0.6, "moderate")
        .when(F.col("confidence") >= 0.4, "weak")
        .when(F.col("contradicting") > 0, "contradicted")
        .otherwise("weak")
    )
    return g.withColumn("level", level).drop("avg_relevance")


def citations(sources: DataFrame, style: str = "APA") -> DataFrame:
    """One citation for each paper, the first source wins; numbered by first author."""
    first = F.min_by(F.struct("title", "authors", "published"), F.struct("rank", "title"))
    s = sources.groupBy("paper_id").agg(first.alias("s")).select("paper_id", "s.*")
    s = s.withColumns({"year": scores.cited_year("published"), "first": F.coalesce(F.try_element_at("authors", F.lit(1)), F.lit("Unknown"))})
    form = scores.ieee if style == "IEEE" else scores.apa
    s = s.select("paper_id", "authors", "year", form("authors", "year", "title", "paper_id").alias("citation"), "first")
    return numbered(s, "first", "paper_id").drop("first")


def answer_quality(confidence: DataFrame, cited: DataFrame, checked: DataFrame) -> DataFrame:
    """(q, source_quality, fact_score, overall, recommendation)."""
    c = cited.groupBy("q").agg(F.count("*").alias("n_citations"))
    f = checked.groupBy("q").agg((F.count_if(F.col("level") == "strong") / F.count("*")).alias("fact"))
    out = confidence.join(c, "q", "left").join(f, "q", "left")
    out = out.withColumns({"source_quality": F.least(F.coalesce("n_citations", F.lit(0)) / 3, F.lit(1.0)), "fact_score": F.coalesce("fact", F.lit(0.5))})
    out = out.withColumn("overall", 0.4 * F.col("confidence") + 0.3 * F.col("source_quality") + 0.3 * F.col("fact_score"))
    return out.select("q", "source_quality", "fact_score", "overall", scores.recommendation("overall").alias("recommendation"))
