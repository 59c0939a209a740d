"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

1. toxicity: documents that the tagger scores at 0.5 or more go. Trained on the labelled documents that are there.
2. near duplicates: of each class of the n-gram Jaccard join the document with the smallest id stays, and of repeated
   rows one. Different texts that share an id are one document and stay or go together.
3. suffix-array dedup: every byte of a repeated 100-byte string but its first goes from the texts; all rows stay, and a
   character that a cut splits goes whole. Rows that share an id are judged each by itself.
4. mixing: documents are sampled by calibrated probabilities, so that sources, languages and topics meet their targets.
5. SentencePiece coding with merge-dropout: packed ids take the place of the text.

All but the last return the columns of documents (n_chars counted anew where the text changed); extra columns go. Null
texts pass as empty ones or nulls, null ids are never duplicates, and empty tables go through as empty tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.llm import chosen_path, mixing, pieces, suffix_dedup, toxicity
from ashlar.llm.common import table
from ashlar.shared import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.tag(docs, model, keep=COLUMNS, spans=False)
    return scored.where("score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = chosen_path.join(docs)
    gone = classes.where("doc_id <> class_id").select("doc_id").distinct()
    return _once(docs).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def _once(docs: DataFrame) -> DataFrame:
    """docs with repeated rows (of one id and text) once; only rows whose id repeats are compared."""
    many = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if many.isEmpty():
        return docs
    some = docs.join(many, "doc_id", "left_semi").withColumn("_same", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return docs.join(many, "doc_id", "left_anti").unionByName(some.dropDuplicates(["doc_id", "_same"]).drop("_same"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.dedup(docs, keep=("lang", "source"), as_text=True)
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    vocabulary = pieces.Vocabulary.load(pieces.MODEL)
    return pieces.encode(docs, vocabulary, dropout=0.1, seed=1, variants=4, keep=("doc_id", "lang", "source"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", drop_repeats),
    ("mixing", mix),
    ("pieces", encode),
]

#: Learned scores and exact byte repeats are beyond SQL; tests hold each stage against brute force on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; each result is written to the shared folder and read again."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
