"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chosen_path, html_text, media, mixing, pieces, sharding, suffix_dedup, toxicity, url_filters, vector_join
from .common import table

Query = Callable[[SparkSession, str], DataFrame]

#: Rules of the URL query: (verdict, host, path).
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.col("_source").alias("source_cell"),
        F.col("_lang").alias("lang_cell"),
        F.col("_topic").alias("topic_cell"),
        F.col("_tokens").alias("tokens"),
        F.round("_p", 6).alias("p"),
    )


def op2_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), shards=40)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens"
    )


def op3_media_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.read_media(media.to_media(table(spark, sf_dir, "documents")))
    return out.drop("error")


def op4_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = pieces.Vocabulary.load(pieces.MODEL)
    out = pieces.encode(table(spark, sf_dir, "documents"), vocabulary, dropout=0.1, seed=1, variants=4, verify=True)
    return out.select("doc_id", "n_bytes", "n_pieces", F.crc32("ids").alias("ids_crc32"), "lossless")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity.tag(docs, toxicity.train(docs, labels))
    return out.select(
        "doc_id",
        (toxicity.bucket(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_toxic",
        F.size("spans").alias("n_spans"),
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.join(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.with_sha(suffix_dedup.dedup(table(spark, sf_dir, "documents")))


def op6_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filters.host_rule(*r) for r in URL_RULES]
    out = url_filters.filter_urls(table(spark, sf_dir, "pages"), rules)
    return out.select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Query] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_shard_documents": op2_shard_documents,
    "op3_media_png": op3_media_png,
    "op4_merge_dropout": op4_merge_dropout,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_vector_join": op6_vector_join,
    "op7_url_filter": op7_url_filter,
    "op8_toxicity": op8_toxicity,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_html_text": op10_html_text,
}
