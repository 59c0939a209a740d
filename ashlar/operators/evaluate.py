"""Retrieval and answer metrics, their summaries and reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.text import words
from ..shared import numbered

Embed = Callable[[Column], Column]

METRICS = ("context_relevance", "faithfulness", "answer_relevance", "context_precision", "context_recall", "overall_score")


def context_metrics(pairs: DataFrame, case: str = "case_id", cosine: str = "cosine") -> DataFrame:
    """pairs (case, cosine of question and context) -> context_relevance, context_precision (strictly over 0.5)."""
    c = F.col(cosine)
    return pairs.groupBy(case).agg(scores.clip(0.7 * F.avg(c) + 0.3 * F.max(c)).alias("context_relevance"), F.avg((c > 0.5).cast("double")).alias("context_precision"))


def recall(pairs: DataFrame, case: str = "case_id", relevant: str = "relevant_id", cosine: str = "cosine", least: float = 0.7) -> DataFrame:
    """pairs (case, relevant, retrieved, cosine) -> share of relevant ones with a retrieved one of over 0.7."""
    best = pairs.groupBy(case, relevant).agg(F.max(cosine).alias("best"))
    return best.groupBy(case).agg(F.avg((F.col("best") > least).cast("double")).alias("context_recall"))


#: Questions and relevant vectors that meet in one group, and pairs of vectors held at once.
ASKED, TILE, HELD = 1024, 8192, 2_000_000


def label_recall(questions: DataFrame, store: DataFrame, least: float = 0.7, asked: int = ASKED, tile: int = TILE) -> DataFrame:
    """questions (q, label, found: array of vectors), store (relevant_id, label, embedding) -> (q, context_recall).

    Relevant to a question are all other vectors of its label; its recall is the share of them that one of the found
    vectors meets with a cosine of over 0.7. This compares all pairs within a label by its nature: questions and vectors
    of a label are dealt into blocks and tiles, each block meets each tile in a group of its own, and only two counts
    for each question and tile leave it. Vectors without a cosine (null, empty, of another length) do not count;
    non-finite ones are met by none. Rows of one id are one.
    """
    store = store.where("label IS NOT NULL AND size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL)")
    sizes = store.groupBy("label").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    sizes = sizes.join(questions.groupBy("label").agg(F.ceil(F.count("*") / asked).cast("int").alias("blocks")), "label")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = questions.join(F.broadcast(sizes), "label").withColumn("block", F.pmod(F.xxhash64("q"), "blocks").cast("int")).withColumn("tile", every("tiles"))
    right = store.join(F.broadcast(sizes), "label").withColumn("tile", F.pmod(F.xxhash64("relevant_id"), "tiles").cast("int")).withColumn("block", every("blocks"))
    left = left.select("label", "block", "tile", "q", F.col("found").cast("array<array<double>>").alias("found"))
    right = right.select(F.col("label").alias("own"), "block", "tile", "relevant_id", F.col("embedding").cast("array<double>").alias("v"))
    kind = left.schema["q"].dataType.simpleString()

    def unit(m: np.ndarray) -> np.ndarray:
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def meet(asks: pa.Table, rows: pa.Table) -> pa.Table:
        names = asks.column("q").to_pylist()
        good, total = np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=np.int64)
        found, kept = asks.column("found").to_pylist(), rows.column("relevant_id").combine_chunks()
        vs = rows.column("v").combine_chunks()
        widths, flat = np.diff(vs.offsets.to_numpy()), vs.flatten().to_numpy(zero_copy_only=False)
        starts = np.cumsum(widths) - widths
        ids = np.unique(kept.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        mine = np.array(kept.to_pylist(), dtype=object)
        for width in np.unique(widths).tolist():
            near = [[v for v in f or () if v is not None and len(v) == width and None not in v] for f in found]
            own = [i for i, f in enumerate(near) if f]
            if not own:
                continue
            m, ends = unit(np.array([v for i in own for v in near[i]], dtype=np.float64)), np.cumsum([0] + [len(near[i]) for i in own])[:-1]
            spots = np.flatnonzero(widths == width)
            spots = spots[np.argsort(ids[spots], kind="stable")]
            first = np.flatnonzero(np.r_[True, np.diff(ids[spots]) > 0])
            step = max(1, HELD // len(m))
            for a in range(0, len(first), step):  # whole ids at a time
                some = first[a : a + step]
                part = spots[some[0] : first[a + step] if a + step < len(first) else len(spots)]
                with np.errstate(invalid="ignore", over="ignore"):
                    c = np.round(m @ unit(flat[starts[part][:, None] + np.arange(width)]).T, 9)
                c = np.maximum.reduceat(np.nan_to_num(c, nan=-1.0, posinf=-1.0, neginf=-1.0), ends, axis=0)
                c = np.maximum.reduceat(c, some - some[0], axis=1)
                good[own] += (c > least).sum(axis=1)
                total[own] += c.shape[1]
                # the question itself is not relevant to it
                where = {x: j for j, x in enumerate(mine[spots[some]].tolist())}
                for at, i in enumerate(own):
                    j = where.get(names[i])
                    if j is not None:
                        good[i] -= int(c[at, j] > least)
                        total[i] -= 1
        return pa.table({"q": pa.array(names, asks.schema.field("q").type), "good": good, "total": total})

    counts = left.groupBy("label", "block", "tile").cogroup(right.groupBy("own", "block", "tile")).applyInArrow(meet, f"q {kind}, good long, total long")
    return counts.groupBy("q").agg((F.sum("good") / F.nullif(F.sum("total"), F.lit(0))).alias("context_recall"))


def lexical(cases: DataFrame, answer: str = "answer", context: str = "context") -> DataFrame:
    """Adds overlap (share of the answer's words in the context), coverage (of the context's in the answer), counts."""
    return cases.withColumns({"overlap": scores.overlap(answer, context), "coverage": scores.overlap(context, answer), "answer_words": F.size(F.filter(F.split(F.col(answer), r"\s+"), lambda w: w != ""))})


def overall(cases: DataFrame) -> DataFrame:
    return cases.withColumn("overall_score", scores.overall(*METRICS[:5]))


def faithfulness(cosine: str | Column, overlap: str | Column) -> Column:
    """Of an answer: its cosine to the joined contexts, and the share of its words that they have."""
    c, o = (F.col(x) if isinstance(x, str) else x for x in (cosine, overlap))
    return scores.clip(0.7 * c + 0.3 * o)


def evaluate_cases(cases: DataFrame, embed: Embed) -> DataFrame:
    """cases (case_id, question, contexts array, answer, relevant array, ...) with the five metrics, overall_score and details.

    A case without contexts has relevance, precision and faithfulness by words alone 0; one without relevant contexts
    has recall 0. Null contexts and answers count as empty. All metrics of all cases come from one plan. Cosines with
    contexts are rounded to nine places, as thresholds decide on them: one of 0.5 is not over 0.5 by its last bit.
    """
    none = F.array().cast("array<string>")
    c = cases.withColumns({"contexts": F.coalesce("contexts", none), "relevant": F.coalesce("relevant", none), "answer": F.coalesce("answer", F.lit(""))})
    c = c.withColumn("_joined", F.array_join("contexts", " "))
    c = c.withColumns({"_q": embed(F.col("question")), "_a": embed(F.col("answer")), "_c": F.transform("contexts", lambda t: embed(t)), "_r": F.transform("relevant", lambda t: embed(t)), "_j": embed(F.col("_joined"))})
    c = c.withColumns({"_cos": F.transform("_c", lambda v: F.round(scores.cosine("_q", v), 9)), "_near": F.transform("_r", lambda r: F.coalesce(F.array_max(F.transform("_c", lambda v: F.round(scores.cosine(r, v), 9))), F.lit(0.0)))})
    n = F.size("contexts")
    total = F.aggregate("_cos", F.lit(0.0), lambda s, x: s + x)
    share = lambda a, least: F.size(F.filter(a, lambda x: x > least)) / F.size(a)
    counted = F.aggregate("contexts", F.lit(0), lambda s, x: s + F.size(words(x)))
    out = c.withColumns(
        {
            "context_relevance": F.when(n > 0, scores.clip(0.7 * total / n + 0.3 * F.array_max("_cos"))).otherwise(0.0),
            "faithfulness": F.when(n > 0, faithfulness(scores.cosine("_a", "_j"), scores.overlap("answer", "_joined"))).otherwise(0.0),
            "answer_relevance": scores.clip(scores.cosine("_q", "_a")),
            "context_precision": F.when(n > 0, share("_cos", 0.5)).otherwise(0.0),
            "context_recall": F.when(F.size("relevant") > 0, share("_near", 0.7)).otherwise(0.0),
            "answer_words": F.size(words("answer")),
            "context_count": n,
            "context_words": F.when(n > 0, counted / n).otherwise(0.0),
        }
    )
    return overall(out).drop("_joined", "_q", "_a", "_c", "_r", "_j", "_cos", "_near")


def evaluate_system(system: Callable[[DataFrame], DataFrame], dataset: DataFrame, embed: Embed, judge: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """The whole loop: dataset (id, question, ground truths, relevant_contexts, difficulty, category) through a system.

    system: from (case_id, question) to (case_id, contexts, answer, error); a case that it does not answer has no
    contexts, an empty answer and its error, and is left out of the summary. judge: from (q, prompt) to (q, reply).
    """
    asked = dataset.select(F.col("id").alias("case_id"), "question", F.col("relevant_contexts").alias("relevant"), "difficulty", "category")
    said = system(asked.select("case_id", "question")).select("case_id", "contexts", "answer", "error")
    cases = evaluate_cases(asked.join(said, "case_id", "left"), embed)
    if judge is not None:
        asks = cases.select(F.col("case_id").alias("q"), judge_prompt("question", "contexts", "answer").alias("prompt"))
        marks = judged(judge(asks)).select(F.col("q").alias("case_id"), *(F.col(k).alias(f"judge_{k}") for k in JUDGED))
        cases = cases.join(marks, "case_id", "left")
    good = cases.where("error IS NULL")
    return {"cases": cases, "summary": summary(good), "groups": group_stats(good), "best": top_cases(good), "worst": top_cases(good, False)}


def _stats(metrics: Sequence[str]) -> list:
    out = [F.count("*").alias("n")]
    for m in metrics:
        out += [F.avg(m).alias(f"avg_{m}"), F.stddev_pop(m).alias(f"std_{m}"), F.min(m).alias(f"min_{m}"), F.max(m).alias(f"max_{m}")]
    return out


def summary(cases: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    return cases.agg(*_stats(metrics))


def group_stats(cases: DataFrame, keys: Sequence[str] = ("difficulty", "category"), metrics: Sequence[str] = METRICS) -> DataFrame:
    """(key, value, n, avg_, std_, min_, max_...) for all keys in one pass of grouping sets."""
    g = cases.groupingSets([[F.col(k)] for k in keys], *keys).agg(F.grouping_id().alias("_g"), *_stats(metrics))
    width = len(keys)
    key = F.coalesce(*(F.when(F.col("_g").bitwiseAND(1 << (width - 1 - i)) == 0, F.lit(k)) for i, k in enumerate(keys)))
    value = F.coalesce(*(F.when(F.col("_g").bitwiseAND(1 << (width - 1 - i)) == 0, F.col(k).cast("string")) for i, k in enumerate(keys)))
    return g.withColumns({"key": key, "value": value}).drop("_g", *keys)


def top_cases(cases: DataFrame, best: bool = True, n: int = 3, score: str = "overall_score", case: str = "case_id") -> DataFrame:
    q = F.when(F.length("question") > 100, F.concat(F.substring("question", 1, 100), F.lit("..."))).otherwise(F.col("question"))
    return cases.orderBy(F.desc(score) if best else F.asc(score), case).limit(n).select(case, q.alias("question"), score)


def histogram(cases: DataFrame, score: str = "overall_score", bins: int = 20) -> DataFrame:
    """(bin, n) over equal widths between the lowest and the highest; the last bin is closed."""
    ends = cases.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    place = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col(score) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))
    return cases.where(F.col(score).isNotNull()).crossJoin(F.broadcast(ends)).select(place.cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def correlations(cases: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(a, b, r) for all pairs of metrics, in one pass."""
    row = cases.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a in metrics for b in metrics))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a in metrics for b in metrics))).alias("x")).select("x.*")


#: Marks that a judge gives.
JUDGED = ("context_relevance", "faithfulness", "answer_relevance", "completeness", "clarity")


def judge_prompt(question: str | Column, contexts: str | Column, answer: str | Column) -> Column:
    q, c, a = (F.col(x) if isinstance(x, str) else x for x in (question, contexts, answer))
    keys = ", ".join(f'"{k}": n' for k in JUDGED)
    return F.concat(
        F.lit("Judge the answer by its sources. Give each mark from 1 (worst) to 5 (best) and reply with JSON only: {" + keys + "}\n"),
        F.lit("Question: "), q, F.lit("\nSources:\n"), F.array_join(c, "\n"), F.lit("\nAnswer: "), a,
    )


def judged(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """The five marks of a judge's reply, from the JSON between its first { and last }, brought from 1..5 to 0..1."""
    js = F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), ", ".join(f"{k} double" for k in JUDGED))
    return replies.withColumn("_j", js).withColumns({k: (F.col(f"_j.{k}") - 1) / 4 for k in JUDGED}).drop("_j")


def printed(summary_: DataFrame, groups: DataFrame, best: DataFrame) -> str:
    """The summary as lines: mean and deviation of each metric, means of each group, the best cases. All three are small."""
    s = summary_.first()
    lines = [f"cases: {s['n']}"]
    lines += [f"{m}: {s[f'avg_{m}']:.3f} +- {s[f'std_{m}']:.3f}" for m in METRICS if s["n"]]
    lines += [f"{g['key']} {g['value']}: {g['avg_overall_score']:.3f} ({g['n']})" for g in groups.orderBy("key", "value").collect()]
    lines += [f"{i}. {r['overall_score']:.3f} {r['question']}" for i, r in enumerate(best.collect(), 1)]
    return "\n".join(lines)


def report_rows(cases: DataFrame) -> DataFrame:
    """The flat rows of the CSV report."""
    return cases.select("case_id", "difficulty", "category", F.length("question").alias("question_length"), F.length("answer").alias("answer_length"), F.size("contexts").alias("context_count"), *METRICS)


def ranked(cases: DataFrame, score: str = "overall_score") -> DataFrame:
    return numbered(cases, F.desc(score), "case_id", name="rank")
