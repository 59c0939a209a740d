"""JSON, CSV, XML and binary sources and sinks.

Paths are whatever Spark can read; nothing here opens a file in Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..shared import numbered

PAPER = (
    "id string, title string, abstract string, authors array<string>, published string, publicationDate string, pdf_url string, venue string, url string, source string, "
    "category string, categories array<string>, year int, citationCount bigint, estimated_citations bigint, quality_score double, pdf_processed boolean, "
    "processed_chunks array<struct<text:string, metadata:struct<chunk_id:string, paper_id:string, title:string, section_type:string, word_count:int, char_count:int, "
    "has_formulas:boolean, has_code:boolean, has_citations:boolean, section_title:string, page_range:string, language:string, total_pages:int, processing_version:string>>>"
)
CASE = "id string, question string, contexts array<string>, ground_truth_answer string, relevant_contexts array<string>, difficulty string, category string, metadata map<string,string>"


def papers(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of papers, or an object whose ``papers`` holds one; optional fields are null."""
    raw = spark.read.option("multiLine", True).schema(f"papers array<struct<{_fields(PAPER)}>>, {PAPER}").json(path)
    wrapped = raw.where("papers is not null").select(F.inline("papers"))
    return wrapped.unionByName(raw.where("papers is null").drop("papers"))


def _fields(ddl: str) -> str:
    """The DDL of columns as that of a struct's fields."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString()[len("struct<") : -1]


def optional_papers(spark: SparkSession, path: str) -> DataFrame:
    """As papers; without a file an empty relation."""
    try:
        return papers(spark, path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], PAPER)


def wrapped_papers(spark: SparkSession, path: str) -> DataFrame:
    """The layout with ``papers`` is required: a file without it raises when it is read."""
    raw = spark.read.option("multiLine", True).schema(f"papers array<struct<{_fields(PAPER)}>>").json(path)
    return raw.select(F.inline(_required("papers", raw.schema["papers"].dataType.simpleString(), "no papers in the file")))


def _required(column: str, kind: str, message: str) -> Column:
    return F.coalesce(F.col(column), F.raise_error(F.lit(message)).cast(kind))


def processed_chunks(papers_: DataFrame) -> DataFrame:
    return papers_.select("id", F.explode_outer("processed_chunks").alias("c")).select("id", "c.text", "c.metadata.*")


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases; a missing file, a malformed record and one without all eight keys raise."""
    raw = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(CASE).json(path)
    return raw.select(*(_required(f.name, f.dataType.simpleString(), f"a case without {f.name}").alias(f.name) for f in raw.schema))


def sample_cases(spark: SparkSession) -> DataFrame:
    """Two cases with all keys, to try an evaluation on."""
    rows = [
        ("sample_001", "What is self-attention?", ["Self-attention relates all places of one sequence to each other."], "It relates the places of a sequence to each other.", ["Self-attention relates all places of one sequence to each other."], "easy", "definition", {"source": "sample"}),
        ("sample_002", "How does dropout reduce overfitting?", ["Dropout leaves out random units in training, so that none relies on the others."], "Units that are left out at random cannot rely on each other.", ["Dropout leaves out random units in training, so that none relies on the others."], "medium", "method", {"source": "sample"}),
    ]
    return spark.createDataFrame(rows, CASE)


def custom_cases(rows: DataFrame) -> DataFrame:
    """Cases with defaults: a numbered id, relevant contexts as given, medium, general."""
    rows = numbered(rows, "question", name="_number")
    have = set(rows.columns)
    get = lambda c, d: F.coalesce(F.col(c), d) if c in have else d
    contexts = get("contexts", F.array().cast("array<string>"))
    return rows.select(
        get("id", F.concat(F.lit("custom_"), (F.col("_number") - 1).cast("string"))).alias("id"), "question", contexts.alias("contexts"), get("ground_truth_answer", F.lit("")).alias("ground_truth_answer"),
        get("relevant_contexts", contexts).alias("relevant_contexts"), get("difficulty", F.lit("medium")).alias("difficulty"), get("category", F.lit("general")).alias("category"),
    )


def files(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """(path, id): the id is the name before its ending and before its version."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path")
    stem = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)
    return f.withColumns({"stem": stem, "id": F.split(stem, "v")[0]})


def atom_entry(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """Title, summary, authors, date and categories of a feed's first entry; rows without title or summary go."""
    first = "/*[local-name()='feed']/*[local-name()='entry'][1]/*[local-name()='{}']"
    get = lambda n, tail="": F.trim(F.regexp_replace(F.xpath_string(xml, F.lit(first.format(n) + tail)), r"\s+", " "))
    out = documents.withColumns(
        {
            "title": get("title"),
            "abstract": get("summary"),
            "authors": F.xpath(xml, F.lit(first.format("author") + "/*[local-name()='name']/text()")),
            "published": F.substring(get("published"), 1, 10),
            "categories": F.xpath(xml, F.lit(first.format("category") + "/@term")),
        }
    )
    return out.where("title <> '' and abstract <> ''")


def paper_documents(papers_: DataFrame) -> DataFrame:
    """(doc_id, text, authors) as the paper-level index holds them."""
    text = F.concat(F.lit("Title: "), F.coalesce("title", F.lit("")), F.lit("\n\nAbstract: "), F.coalesce("abstract", F.lit("")))
    return papers_.select(F.concat(F.lit("paper_"), "id").alias("doc_id"), text.alias("text"), F.array_join("authors", ", ").alias("authors"))


def classic_list(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of papers to fetch (arxiv_id, title, estimated_citations, category), with their page and file."""
    rows = spark.read.option("multiLine", True).schema("arxiv_id string, title string, estimated_citations bigint, category string").json(path)
    return rows.withColumns(scores.arxiv_urls("arxiv_id"))


def flat_metadata(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Arrays to joined strings, structs and maps to JSON, the rest to strings."""
    kinds = dict(rows.dtypes)
    make = lambda c: F.array_join(c, ", ") if kinds[c].startswith("array<string") else F.to_json(c) if kinds[c].startswith(("struct", "map", "array")) else F.col(c).cast("string")
    return rows.withColumns({c: make(c) for c in columns})


def write_versioned(df: DataFrame, base: str, version: str, form: str = "json") -> str:
    """Writes to a folder of its own under base, so what was there before stays as the backup; returns the folder."""
    path = f"{base.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").format(form).save(path)
    return path


def write_report(cases_: DataFrame, path: str) -> None:
    """The flat CSV report; its schema is that of evaluate.report_rows."""
    cases_.write.mode("overwrite").option("header", True).csv(path)


def write_papers(papers_: DataFrame, statistics: DataFrame, base: str, version: str) -> str:
    """The corpus and its statistics as JSON, side by side in a folder of their own; returns the folder."""
    write_versioned(statistics, f"{base.rstrip('/')}/statistics", version)
    return write_versioned(papers_, f"{base.rstrip('/')}/papers", version)


def write_cases(cases_: DataFrame, path: str) -> None:
    """A dataset that ``cases`` reads back: one record a line, all keys present."""
    cases_.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def write_evaluation(found: dict[str, DataFrame], base: str, version: str) -> list[str]:
    """What ``evaluate.evaluate_system`` gives: details and summaries as JSON, a folder each."""
    return [write_versioned(df, f"{base.rstrip('/')}/{name}", version) for name, df in found.items()]
