"""A batch of questions from retrieval to answers as one plan; evaluate.evaluate_system takes it through the metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import bm25, prompt, ranking, vectors, verify

Embed = Callable[[Column], Column]


def answer(questions: DataFrame, chunks: DataFrame, index: bm25.Index, embed: Embed, config: vectors.RetrievalConfig = vectors.RetrievalConfig(top_k=8), diversify: bool = True) -> dict[str, DataFrame]:
    """questions (q, question) over chunks (doc, content, title, authors array, published, section, has_formulas,
    has_code, has_citations, embedding).

    Dense hits with threshold and adaptive cut come first; lists of fewer than three are filled up from fused,
    reranked and diversified ones. The result has contexts, prompts, answers by rule, citations and confidence.
    """
    asked = questions.withColumn("embedding", embed(F.col("question")))
    store = chunks.select(F.col("doc").alias("vec_id"), "embedding")
    dense = vectors.retrieve(store, asked, config).select("q", F.col("vec_id").alias("doc"), F.col("similarity").alias("score"), "rank")
    grown = questions.withColumn("question", scores.expanded("question"))
    wide = vectors.top_k(store, grown.withColumn("embedding", embed(F.col("question"))), 10)
    wide = wide.select("q", F.col("vec_id").alias("doc"), F.col("cosine").alias("score"), "rank")
    fused = ranking.fuse(wide, bm25.search(index, grown, 10))
    texts = chunks.drop("embedding")
    again = ranking.rerank(fused.drop("rank").join(texts, "doc").join(questions, "q"))
    if diversify:
        again = ranking.mmr(again.select("q", "doc", "content", F.col("combined"), "rank"))
    final = ranking.final_list(dense, again.select("q", "doc", "rank"))
    score = dense.select("q", "doc", "score").unionByName(fused.select("q", "doc", F.col("combined").alias("score"))).groupBy("q", "doc").agg(F.max("score").alias("score"))
    rows = final.select("q", "doc", F.col("place").alias("rank")).join(score, ["q", "doc"]).join(texts, "doc").join(questions, "q")
    chosen = prompt.contexts(rows)
    entries = prompt.within(chosen.withColumn("entry", prompt.entry("place", "title", F.array_join("authors", ", "), "section", "content")), 4000)
    said = entries.groupBy("q", "question").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "content"))), lambda x: x["content"]), " ").alias("content"))
    answers = said.select("q", "question", prompt.fallback("question", "content", scores.query_type("question")).alias("answer"))
    relevance = scores.context_relevance("question", "content", "section", "score", "has_formulas", "has_citations", "has_code")
    trusted = prompt.confidence(chosen.withColumn("relevance", relevance).where("relevance >= 0.3"))
    first = Window.partitionBy("q", "doc").orderBy("place")
    cited = chosen.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    year = scores.cited_year("published")
    cited = cited.select("q", "doc", "place", scores.apa("authors", year, "title", F.col("doc").cast("string")).alias("citation"))
    checked = verify.support(verify.claims(answers), chosen.select("q", "doc", "content"))
    return {
        "contexts": chosen,
        "entries": entries,
        "answers": answers,
        "response": prompt.assembled(answers.select("q", "answer"), cited),
        "citations": cited,
        "confidence": trusted,
        "claims": checked,
        "quality": verify.answer_quality(trusted, cited, checked),
    }


def system(chunks: DataFrame, index: bm25.Index, embed: Embed, config: vectors.RetrievalConfig = vectors.RetrievalConfig(top_k=8)) -> Callable[[DataFrame], DataFrame]:
    """The plan as a system that evaluate.evaluate_system can ask: (case_id, question) -> (case_id, contexts, answer, error)."""

    def run(cases: DataFrame) -> DataFrame:
        got = answer(cases.select(F.col("case_id").alias("q"), "question"), chunks, index, embed, config)
        held = got["contexts"].groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", "content"))).alias("c"))
        held = held.select("q", F.transform("c", lambda x: x["content"]).alias("contexts"))
        out = cases.select(F.col("case_id").alias("q")).join(held, "q", "left").join(got["answers"].select("q", "answer"), "q", "left")
        return out.select(F.col("q").alias("case_id"), "contexts", "answer", F.when(F.col("answer").isNull(), "no answer").alias("error"))

    return run


def replied(prompts: DataFrame, model: Callable[[DataFrame], DataFrame] | None, fallback: DataFrame) -> DataFrame:
    """Answers of a model (a function from (q, prompt) to (q, text)) where there are any, else those by rule."""
    if model is None:
        return fallback.select("q", "answer", F.lit("rules").alias("by"))
    made = model(prompts.select("q", "prompt")).select("q", F.col("text").alias("_text"))
    out = fallback.join(made, "q", "left")
    return out.select("q", F.coalesce("_text", "answer").alias("answer"), F.when(F.col("_text").isNull(), "rules").otherwise("model").alias("by"))
