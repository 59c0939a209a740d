"""Keyword search and point lookups over a REST service as a Spark data source, and page texts of PDF files.

``spark.dataSource.register(PaperSearch)``, then ``spark.read.format("papers").option("keywords", "a;b").load()``, or
with ``ids`` in place of ``keywords`` for single papers. One partition a keyword or id; a failing or throttled request
gives no rows. The fetch function can be replaced, which is how it runs without a network.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import scores
from ..operators import curate

FIELDS = "keyword string, id string, title string, abstract string, venue string, year int, citations bigint"


def fetch(url: str, timeout: float = 30, pause: float = 5) -> dict:
    """The JSON of a URL; {} if throttled (after a pause) or failing."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:
            return json.load(r)
    except urllib.error.HTTPError as e:
        if e.code == 429:
            time.sleep(pause)
        return {}
    except (OSError, ValueError):
        return {}


class Keyword(InputPartition):
    def __init__(self, keyword: str) -> None:
        self.keyword = keyword


class PaperReader(DataSourceReader):
    """Options: url; keywords, years and limit, or ids; least: citations that a paper found by keyword must have."""

    def __init__(self, options: dict, get: Callable[[str], dict] = fetch) -> None:
        self.keywords, self.ids = ([k for k in options.get(name, "").split(";") if k] for name in ("keywords", "ids"))
        self.base, self.limit, self.least = options.get("url", ""), int(options.get("limit", "20")), int(options.get("least", "0"))
        self.years, self.get = options.get("years", ""), get

    def partitions(self) -> list[Keyword]:
        return [Keyword(k) for k in self.ids or self.keywords] or [Keyword("")]

    def read(self, partition: Keyword) -> Iterator[tuple]:
        if not partition.keyword:
            return
        if self.ids:
            found = [self.get(f"{self.base}/{urllib.parse.quote(partition.keyword, safe='')}")]
        else:
            q = urllib.parse.urlencode({"query": partition.keyword, "limit": self.limit, "year": self.years})
            found = self.get(f"{self.base}?{q}").get("data", []) or []
        for p in found:
            if p.get("paperId") and (self.ids or (p.get("citationCount") or 0) >= self.least):
                yield (partition.keyword, p["paperId"], p.get("title"), p.get("abstract"), p.get("venue"), p.get("year"), p.get("citationCount"))


class PaperSearch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "papers"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema: object) -> PaperReader:
        return PaperReader(dict(self.options))


def wanted(found: DataFrame, seen: DataFrame, venues_only: bool = False) -> DataFrame:
    """Papers found that are not seen yet, each once, with an abstract; venues_only: those of the known venues."""
    rows = found.where("length(trim(coalesce(abstract, ''))) > 0")
    if venues_only:
        rows = rows.where(scores.in_venues("venue"))
    return curate.first_seen(rows.join(seen.select("id"), "id", "left_anti"), "id", "keyword")


def atom_documents(ids: DataFrame, get: Callable[[str], str], base: str) -> DataFrame:
    """ids (id) -> (id, xml) from a feed by id, for ``files.atom_entry``; a failing request gives an empty document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i in pdf["id"]:
                try:
                    rows.append((i, get(f"{base}?{urllib.parse.urlencode({'id_list': i})}")))
                except (OSError, ValueError):
                    rows.append((i, ""))
            yield pd.DataFrame(rows, columns=["id", "xml"])

    return ids.select("id").mapInPandas(run, "id string, xml string")


PAGES = "path string, page int, text string"


def pdf_texts(pages: DataFrame) -> DataFrame:
    """(path, total_pages, text): the whole text of each file."""
    g = pages.groupBy("path").agg(F.count("*").alias("total_pages"), F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return g.select("path", "total_pages", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))


def pdf_pages(files: DataFrame) -> DataFrame:
    """binaryFile rows -> (path, page, text); unreadable or blank files give no rows. Needs PyMuPDF on the workers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    texts = [p.get_text() for p in fitz.open(stream=bytes(content), filetype="pdf")]
                except (RuntimeError, ValueError):
                    continue
                if any(t.strip() for t in texts):
                    rows += [(path, i + 1, t) for i, t in enumerate(texts)]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    return files.select("path", "content").mapInPandas(run, PAGES)
