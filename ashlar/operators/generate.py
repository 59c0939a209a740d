"""Language models behind HTTP or any function, in batches; rows without an answer fall back to rules."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPLY = "q long, text string, success boolean, error string, model string"
Ask = Callable[[str], str]


def http(base: str, model: str, tokens: int = 512, temperature: float = 0.7, timeout: float = 60) -> Ask:
    """A function that asks a local completion service."""

    def ask(prompt: str) -> str:
        body = {"model": model, "prompt": prompt, "stream": False, "options": {"num_predict": tokens, "temperature": temperature}}
        request = urllib.request.Request(f"{base}/api/generate", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return json.load(r).get("response", "")

    return ask


def models(base: str, timeout: float = 5) -> list[str]:
    """Names of the models that a local completion service has; none if it does not answer."""
    try:
        with urllib.request.urlopen(f"{base}/api/tags", timeout=timeout) as r:
            return [m["name"] for m in json.load(r).get("models", [])]
    except (OSError, ValueError, KeyError):
        return []


def chosen(wanted: str, have: list[str], others: tuple[str, ...] = ()) -> str | None:
    """The model wanted if it is there, else the first of the others, else any; None without models."""
    return next((m for m in (wanted, *others) if m in have), have[0] if have else None)


def replies(prompts: DataFrame, ask: Ask, model: str = "") -> DataFrame:
    """(q, text, success, error, model) for prompts (q, prompt); a failing call is a row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for q, p in zip(pdf["q"], pdf["prompt"], strict=True):
                try:
                    text = ask(p)
                    rows.append((q, text or None, bool(text), None if text else "empty", model))
                except Exception as e:  # noqa: BLE001 - whatever a model raises is its row's error
                    rows.append((q, None, False, f"{type(e).__name__}: {e}"[:200], model))
            yield pd.DataFrame(rows, columns=["q", "text", "success", "error", "model"])

    return prompts.select(F.col("q").cast("long").alias("q"), "prompt").mapInPandas(run, REPLY)


def questions(chunks: DataFrame, ask: Ask, n: int, seed: int = 0, per_paper: int = 3) -> DataFrame:
    """Synthetic question-answer pairs: n papers by seeded order, two to four chunks of each, kept if both parts are long enough."""
    from pyspark.sql import Window

    draw = F.xxhash64(F.lit(seed), "paper_id")
    papers = chunks.select("paper_id").distinct().orderBy(draw, "paper_id").limit(n)
    w = Window.partitionBy("paper_id").orderBy(F.xxhash64(F.lit(seed), "chunk_id"))
    # two chunks of a paper at least, and up to per_paper + 1, by its hash
    some = chunks.join(papers, "paper_id").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= 2 + F.pmod(F.xxhash64(F.lit(seed + 1), "paper_id"), F.lit(per_paper)))
    context = some.groupBy("paper_id").agg(F.array_sort(F.collect_list("text")).alias("contexts"))
    asked = context.withColumns({"q": F.xxhash64("paper_id"), "prompt": F.concat(F.lit('Write one question and its answer as JSON with "question" and "answer" about:\n'), F.array_join("contexts", "\n"))})
    got = replies(asked, ask).select("q", F.from_json(F.regexp_extract("text", r"(?s)\{.*\}", 0), "question string, answer string").alias("j"))
    out = asked.join(got, "q").select("paper_id", "contexts", "j.question", "j.answer")
    return out.where("length(question) > 10 AND length(answer) > 20")
