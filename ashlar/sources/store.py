"""A vector collection and an embedding cache as Parquet tables in versions.

Adding rows writes a new version with the old rows whose ids are not among the new ones; readers take the latest
complete version, so a lost executor or a failed write never shows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, document string, embedding array<float>, paper_id string, section string, has_formulas boolean, has_code boolean, has_citations boolean"
Embed = Callable[[Column], Column]


class Collection:
    """A table of documents with vectors and metadata under one folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        """Versions whose rows are complete: the committer's mark is there. Lists through Hadoop, as Spark does."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        glob = jvm.org.apache.hadoop.fs.Path(f"{self.path}/v=*/rows/_SUCCESS")
        found = glob.getFileSystem(conf).globStatus(glob) or []
        return sorted(int(re.search(r"/v=(\d+)/", f.getPath().toString())[1]) for f in found)

    def read(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.parquet(f"{self.path}/v={versions[-1]}/rows")

    def _write(self, rows: DataFrame) -> None:
        n = (self._versions() or [0])[-1] + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/v={n}/rows")

    def add(self, rows: DataFrame, embed: Embed) -> None:
        """Upserts rows (id, document, metadata...): a row replaces the one with its id; repeated ids keep one row."""
        fields = [x.split()[0] for x in SCHEMA.split(", ")]
        new = rows.dropDuplicates(["id"]).withColumn("embedding", embed(F.col("document")).cast("array<float>"))
        for f in fields:
            if f not in new.columns:
                new = new.withColumn(f, F.lit(None))
        new = new.select(*(F.col(f).cast(t) for f, t in (x.split(" ", 1) for x in SCHEMA.split(", "))))
        old = self.read()
        self._write(old.join(new.select("id"), "id", "left_anti").select(*fields).unionByName(new))

    def rebuild(self, embed: Embed) -> None:
        """Vectors of another model for all rows, as a new version."""
        self._write(self.read().withColumn("embedding", embed(F.col("document")).cast("array<float>")))

    def clear(self) -> None:
        self._write(self.spark.createDataFrame([], SCHEMA))

    def statistics(self) -> DataFrame:
        return statistics(self.read())

    def state(self, config: object) -> DataFrame:
        """(count, config, error): one row; where the rows cannot be read, the error and no count."""
        try:
            n, error = self.read().count(), None
        except AnalysisException as e:
            n, error = None, str(e)[:200]
        return self.spark.createDataFrame([(n, repr(config), error)], "count long, config string, error string")


def statistics(rows: DataFrame) -> DataFrame:
    """(section, total, papers, and how many have each flag); rows without a section are unknown."""
    s = F.coalesce("section", F.lit("unknown"))
    flags = [F.count_if(F.col(c)).alias(c) for c in ("has_formulas", "has_code", "has_citations")]
    return rows.groupBy(s.alias("section")).agg(F.count("*").alias("total"), F.count_distinct("paper_id").alias("papers"), *flags)


def cache_key(model: str, text: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{model}:"), text).cast("binary"))


def cached(texts: DataFrame, cache: DataFrame, model: str, embed: Embed, column: str = "text") -> DataFrame:
    """texts with embedding and hit: known vectors by a join, the rest computed, each text once."""
    keyed = texts.withColumn("_key", cache_key(model, F.col(column)))
    known = cache.select(F.col("key").alias("_key"), F.col("embedding").alias("_known"))
    missed = keyed.select("_key", column).dropDuplicates(["_key"]).join(known, "_key", "left_anti").withColumn("_made", embed(F.col(column))).select("_key", "_made")
    out = keyed.join(known, "_key", "left").join(missed, "_key", "left")
    return out.withColumns({"embedding": F.coalesce("_known", "_made"), "hit": F.col("_known").isNotNull()}).drop("_known", "_made").withColumnRenamed("_key", "key")


def by_sections(collection: DataFrame, sections: Sequence[str]) -> DataFrame:
    return collection.where(F.col("section").isin(list(sections)))
