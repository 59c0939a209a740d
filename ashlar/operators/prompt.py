"""Contexts, budgets, prompts and rule-based answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.text import clean_prompt, words

#: (query type, system, layout); wording of our own. 'general' stands in for unknown types.
TEMPLATES = [
    ("definition", "You explain terms from papers.", "Define what is asked.\n{context}\nQuestion: {query}\nAnswer:"),
    ("comparison", "You compare methods from papers.", "Weigh the alternatives.\n{context}\nQuestion: {query}\nAnswer:"),
    ("explanation", "You explain how things work.", "Explain step by step.\n{context}\nQuestion: {query}\nAnswer:"),
    ("summarization", "You summarise papers.", "Give the main points.\n{context}\nQuestion: {query}\nAnswer:"),
    ("application", "You describe uses of methods.", "Name uses and their limits.\n{context}\nQuestion: {query}\nAnswer:"),
    ("technical", "You describe algorithms.", "Describe the method exactly.\n{context}\nQuestion: {query}\nAnswer:"),
    ("general", "You answer from papers.", "Use only these sources.\n{context}\nQuestion: {query}\nAnswer:"),
]


#: By intent, for answers with named sources; wording of our own.
CITED = [
    ("definition", "You define terms and cite.", "Define the term and cite the sources by number.\n{context}\nQuestion: {query}\nAnswer:"),
    ("comparison", "You compare and cite.", "Compare point by point and cite the sources by number.\n{context}\nQuestion: {query}\nAnswer:"),
    ("method", "You explain methods and cite.", "Describe the steps and cite the sources by number.\n{context}\nQuestion: {query}\nAnswer:"),
    ("recent_work", "You report recent work and cite.", "Report what is new, the latest first, and cite the sources by number.\n{context}\nQuestion: {query}\nAnswer:"),
    ("general", "You answer and cite.", "Answer from the sources and cite them by number.\n{context}\nQuestion: {query}\nAnswer:"),
]


def templates(spark: SparkSession, custom: list[tuple[str, str, str]] | None = None, base: list[tuple[str, str, str]] = TEMPLATES) -> DataFrame:
    """The template table; custom rows replace those of their type."""
    rows = {t[0]: t for t in [*base, *(custom or [])]}
    return spark.createDataFrame(list(rows.values()), "query_type string, system string, layout string")


def template_info(table: DataFrame) -> DataFrame:
    """(query_type, system_length, layout_length, fields): what each template is made of."""
    return table.select("query_type", F.length("system").alias("system_length"), F.length("layout").alias("layout_length"), F.regexp_extract_all("layout", F.lit(r"\{(\w+)\}"), F.lit(1)).alias("fields"))


def cited_prompts(entries: DataFrame, spark: SparkSession) -> DataFrame:
    """Prompts by the intent of the question, over the templates that cite. entries: (q, question, place, entry)."""
    rows = entries.withColumn("query_type", scores.intent("question")["intent"])
    return prompts(rows, templates(spark, base=CITED))


def assembled(answers: DataFrame, citations: DataFrame, most: int = 3) -> DataFrame:
    """answers (q, answer) and citations (q, place, citation) -> (q, answer, n_citations): the first three follow the answer."""
    c = citations.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", "citation"))).alias("c"))
    c = c.select("q", F.transform(F.slice("c", 1, most), lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["citation"])).alias("lines"))
    out = answers.join(c, "q", "left").withColumn("n_citations", F.greatest(F.size("lines"), F.lit(0)))
    return out.select("q", F.when(F.col("n_citations") > 0, F.concat("answer", F.lit("\n\nSources:\n"), F.array_join("lines", "\n"))).otherwise(F.col("answer")).alias("answer"), "n_citations")


def contexts(results: DataFrame, k: int = 5) -> DataFrame:
    """results (q, question, doc, content, title, section, score, rank) -> the k of highest priority, with their place."""
    r = results.withColumns({"query_type": scores.query_type("question"), "context_type": scores.context_class("section", "title")})
    r = r.withColumn("priority", scores.priority("score", "query_type", "context_type", "section"))
    order = Window.partitionBy("q").orderBy(F.desc("priority"), "rank", "doc")
    return r.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def entry(place: str | Column, title: str | Column, authors: str | Column, section: str | Column, content: str | Column) -> Column:
    """A source line, the cleaned content and a line end each."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    by = F.when(F.coalesce(c(authors), F.lit("")) == "", "").otherwise(F.concat(F.lit(" (authors: "), F.substring(c(authors), 1, 50), F.when(F.length(c(authors)) > 50, "...").otherwise(""), F.lit(")")))
    part = F.when(F.coalesce(c(section), F.lit("")).isin("", "content"), "").otherwise(F.concat(F.lit(" ["), c(section), F.lit("]")))
    return F.concat(F.lit("[source "), c(place).cast("string"), F.lit("] "), F.coalesce(c(title), F.lit("untitled")), by, part, F.lit("\n"), clean_prompt(c(content)), F.lit("\n"))


def within(entries: DataFrame, most: int = 2000) -> DataFrame:
    """Entries in order of place while their running length stays within the budget; the first always."""
    run = Window.partitionBy("q").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("length", F.length("entry")).withColumn("used", F.sum("length").over(run)).where((F.col("used") <= most) | (F.col("place") == 1))


def prompts(entries: DataFrame, table: DataFrame) -> DataFrame:
    """(q, question, query_type, n_contexts, context_length, prompt)."""
    rows = entries.groupBy("q", "question", "query_type").agg(F.array_sort(F.collect_list(F.struct("place", "entry"))).alias("e"))
    rows = rows.select("q", "question", "query_type", F.array_join(F.transform("e", lambda x: x["entry"]), "\n").alias("context"), F.size("e").alias("n_contexts"))
    general = table.where("query_type = 'general'").select(F.col("layout").alias("general"))
    rows = rows.join(F.broadcast(table.select("query_type", "layout")), "query_type", "left").crossJoin(F.broadcast(general))
    layout = F.coalesce("layout", "general")
    # the question goes in last: braces in a context are no fields
    text = F.replace(F.replace(layout, F.lit("{query}"), F.col("question")), F.lit("{context}"), F.col("context"))
    return rows.select("q", "question", "query_type", "n_contexts", F.length("context").alias("context_length"), text.alias("prompt"))


def token_budget(rows: DataFrame, most: int = 2048) -> DataFrame:
    """rows (q, question, doc, content, place) -> those that start within the budget; the one that overruns it is cut.

    A row costs three quarters of its words; the question its words and two.
    """
    spent = F.size(words("question")) + 2
    rows = rows.withColumn("tokens", (F.size(words("content")) * 0.75).cast("int"))
    before = Window.partitionBy("q").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", spent + F.coalesce(F.sum("tokens").over(before), F.lit(0))).where(F.col("before") < most)
    room = F.lit(most) - F.col("before")
    cut = F.col("tokens") > room
    text = F.when(cut, F.concat(F.array_join(F.slice(words("content"), 1, (room / 0.75).cast("int")), " "), F.lit("..."))).otherwise(F.col("content"))
    return rows.withColumns({"text": text, "truncated": cut})


def confidence(rows: DataFrame, relevance: str = "relevance") -> DataFrame:
    """(q, n, avg_relevance, confidence, papers, passed): confidence is capped at 1; passed is the gate at 0.3."""
    c = rows.groupBy("q").agg(F.count("*").alias("n"), F.avg(relevance).alias("avg_relevance"), F.count_distinct("doc").alias("papers"))
    return c.withColumn("confidence", F.least(F.lit(1.0), F.col("avg_relevance") * F.col("n") / 5)).withColumn("passed", F.col("confidence") >= 0.3)


def main_points(content: str | Column, longer: int = 20, most: int = 5) -> Column:
    c = F.col(content) if isinstance(content, str) else content
    return F.slice(F.filter(F.transform(F.split(c, r"\."), lambda s: F.trim(s)), lambda s: F.length(s) > longer), 1, most)


def fallback(question: str | Column, content: str | Column, intent: str | Column) -> Column:
    """An answer by rule: the first sentences in the layout of the question's intent."""
    q, i = (F.col(x) if isinstance(x, str) else x for x in (question, intent))
    low, points = F.lower(q), main_points(content)
    kind = (
        F.when((i == "definition") | F.contains(low, F.lit("what is")), "Definition")
        .when((i == "comparison") | F.contains(low, F.lit("difference")) | F.contains(low, F.lit("compare")), "Comparison")
        .when((i == "methodology") | F.contains(low, F.lit("how to")) | F.contains(low, F.lit("method")), "Method")
        .otherwise("Findings")
    )
    most = F.when(kind == "Method", 4).when(kind == "Findings", 5).otherwise(3)
    body = F.array_join(F.transform(F.slice(points, F.lit(1), most), lambda p, n: F.concat((n + 1).cast("string"), F.lit(". "), p)), "\n")
    return F.when(F.size(points) == 0, F.concat(F.lit("No source answers: "), q)).otherwise(F.concat(kind, F.lit(" for: "), q, F.lit("\n"), body))


def simple_fallback(question: str | Column, context: str | Column) -> Column:
    """The first three sentences of lines that hold 'Content:'."""
    q, c = (F.col(x) if isinstance(x, str) else x for x in (question, context))
    held = F.filter(F.split(c, "\n"), lambda x: F.contains(x, F.lit("Content:")))
    texts = F.filter(F.transform(held, lambda x: F.trim(F.regexp_replace(x, "^[^:]*:", ""))), lambda x: F.length(x) > 20)
    said = F.slice(main_points(F.array_join(texts, " "), 15, 3), 1, 3)
    return F.when(F.size(said) == 0, F.concat(F.lit("No source answers: "), q)).otherwise(F.concat(q, F.lit("\n"), F.array_join(said, ".\n"), F.lit(".")))
