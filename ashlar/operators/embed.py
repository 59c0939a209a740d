"""Embedding models: configuration, a registry of encoders, batches, and a report of their speed."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .vectors import concatenated, hashed

Encoder = Callable[[list[str]], Sequence[Sequence[float]]]


@dataclass(frozen=True)
class EmbeddingConfig:
    """What a collection's vectors were made with; fixed defaults of the system."""

    model_name: str = "all-mpnet-base-v2"
    model_type: str = "sentence_transformers"
    batch_size: int = 16
    normalize: bool = True
    max_length: int = 512
    dimension: int = 768


#: Known models with their dimension and speed.
MODELS = [
    ("all-MiniLM-L6-v2", 384, "fast"), ("all-mpnet-base-v2", 768, "medium"), ("paraphrase-multilingual-MiniLM-L12-v2", 384, "fast"),
    ("paraphrase-multilingual-mpnet-base-v2", 768, "medium"), ("shibing624/text2vec-base-chinese", 768, "medium"), ("allenai/specter", 768, "slow"),
]


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, "model string, dimension int, speed string")


#: Parameters in which two configurations must agree for their vectors to be compared.
CRITICAL = ("model_name", "model_type", "normalize", "max_length")


def differences(config: EmbeddingConfig, other: EmbeddingConfig = EmbeddingConfig()) -> list[str]:
    """The critical parameters in which they differ; empty if vectors can be mixed."""
    return [f.name for f in fields(config) if f.name in CRITICAL and getattr(config, f.name) != getattr(other, f.name)]


def encoded(texts: DataFrame, load: Callable[[], Encoder], column: str = "text", batch: int = 16, normalize: bool = True) -> DataFrame:
    """texts with embedding. load makes the encoder once in each Python worker task; rows keep their order in a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for pdf in batches:
            out: list[list[float]] = []
            for i in range(0, len(pdf), batch):
                for v in encode([t or "" for t in pdf[column].iloc[i : i + batch]]):
                    v = [float(x) for x in v]
                    length = sum(x * x for x in v) ** 0.5
                    out.append([x / length for x in v] if normalize and length > 0 else v)
            yield pdf.assign(embedding=out)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)
    return texts.mapInPandas(run, f"{kept}, embedding array<double>")


def manager(kind: str, size: int = 64) -> Callable[[Column], Column]:
    """Encoders that are column expressions, by kind: 'hash', or 'hybrid' for two of them end to end."""
    if kind == "hash":
        return lambda text: hashed(text, size)
    if kind == "hybrid":
        return lambda text: concatenated([hashed(text, size), hashed(F.reverse(text), size)])
    raise ValueError(f"unknown kind {kind!r}")


def device(prefer: Sequence[str] = ("cuda", "mps", "cpu")) -> str:
    """The first device that torch can use on this machine, cpu without torch. Called in an encoder's ``load``, on the worker."""
    try:
        import torch
    except ImportError:
        return "cpu"
    there = {"cuda": torch.cuda.is_available(), "mps": torch.backends.mps.is_available(), "cpu": True}
    return next(d for d in (*prefer, "cpu") if there.get(d))


def encoder_stats(report: DataFrame) -> DataFrame:
    """(total, seconds, per_text) over the rows of ``benchmark``: one row."""
    total, seconds = F.sum("n"), F.coalesce(F.sum("seconds"), F.lit(0.0))
    return report.agg(total.alias("total"), seconds.alias("seconds"), (seconds / F.greatest(total, F.lit(1))).alias("per_text"))


def benchmark(texts: DataFrame, models: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(model, n, seconds, per_text, error): each model encodes all texts; one that fails is a row with its error."""
    rows = []
    for name, encode in models.items():
        began = time.time()
        try:
            n = encode(texts).select(F.sum(F.size("embedding") * 0 + 1)).first()[0] or 0
            took = time.time() - began
            rows.append((name, int(n), took, took / max(n, 1), None))
        except Exception as e:  # noqa: BLE001 - the report is of failures, too
            rows.append((name, 0, None, None, str(e)[:200]))
    return texts.sparkSession.createDataFrame(rows, "model string, n long, seconds double, per_text double, error string")
