"""Full texts of papers: which files belong to which paper, sections with their contents, chunks, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def with_files(papers: DataFrame, files: DataFrame) -> DataFrame:
    """Papers that have a file, with its path: by id. Several files of an id give several rows."""
    return papers.join(files.select("id", "path"), "id")


def without_files(papers: DataFrame, files: DataFrame) -> DataFrame:
    return papers.join(files.select("id"), "id", "left_anti")


def unprocessed(papers: DataFrame, chunks: str = "processed_chunks", section: str = "section_type") -> DataFrame:
    """Papers without full text so far: at most one chunk, or none but abstracts."""
    held = F.coalesce(F.size(chunks), F.lit(0))
    other = F.exists(chunks, lambda c: F.coalesce(c["metadata"][section], F.lit("abstract")) != "abstract")
    return papers.where(~((held > 1) & F.coalesce(other, F.lit(False))))


def section_contents(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """lines (doc, line_no, line) -> (doc, start, stop, section, title, confidence, content).

    A heading starts a section, which holds the lines up to the next one; what stands before the first heading, and
    sections without anything but blanks, are left out. One window by document gives every line its heading, so lines
    meet their section without a range join.
    """
    order = Window.partitionBy(doc).orderBy("line_no")
    at = F.when(T.heading_of("line").isNotNull(), F.col("line_no"))
    rows = lines.withColumn("start", F.last(at, ignorenulls=True).over(order)).where("start IS NOT NULL")
    head = F.col("line_no") == F.col("start")
    body = F.array_sort(F.collect_list(F.when(~head, F.struct("line_no", "line"))))
    g = rows.groupBy(doc, "start").agg(F.max(F.when(head, F.col("line"))).alias("line"), F.max("line_no").alias("stop"), body.alias("body"))
    g = g.withColumns({"section": T.heading_of("line"), "title": F.trim("line"), "content": F.trim(F.array_join(F.transform("body", lambda x: x["line"]), "\n"))})
    g = g.withColumn("confidence", T.heading_confidence("line", "section")).where(F.col("content").rlike(r"\S"))
    return g.select(doc, "start", "stop", "section", "title", "confidence", "content")


def long_sections(sections: DataFrame, longer: int = 200) -> DataFrame:
    """Sections worth to be cut into chunks."""
    return sections.where(F.length(F.trim("content")) > longer)


def enriched(chunks: DataFrame) -> DataFrame:
    """What chunks of full texts have besides the features of their text."""
    return chunks.withColumns({"has_citations": F.contains(F.lower("text"), F.lit("references")), "has_code": F.lit(False), "processing_version": F.lit("2.0")})


def report(papers: DataFrame, chunks: str = "processed_chunks") -> DataFrame:
    """(processed, avg_chunks): papers with a full text, and chunks of those."""
    n = F.size(chunks)
    return papers.where((n > 1) & F.col("pdf_processed")).agg(F.count("*").alias("processed"), F.avg(n).alias("avg_chunks"))


def status(papers: DataFrame, chunks: DataFrame, paper: str = "paper_id") -> DataFrame:
    """(papers, chunks, with_chunks, chunks_per_paper): one row."""
    p = papers.agg(F.count("*").alias("papers"))
    c = chunks.agg(F.count("*").alias("chunks"), F.count_distinct(paper).alias("with_chunks"))
    return p.crossJoin(c).withColumn("chunks_per_paper", F.col("chunks") / F.greatest("papers", F.lit(1)))  # one row each
