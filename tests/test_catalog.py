"""Queries against their SQL on the smallest tables."""

import os
from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")
SOME = (
    "tokenize_stats", "bm25_topk", "bm25_short_questions", "knn_adaptive_k", "hybrid_fusion_full", "final_merge_fill", "intent_scores", "prompt_build", "token_budget", "context_recall",
    "case_metrics", "evaluation_loop", "eval_group_stats", "judge_parse", "quality_score_a", "corpus_sort", "corpus_statistics", "search_filter", "dedup_theta_anti", "seen_filter",
    "fixed_chunks_closed_form", "section_split", "section_contents", "document_detectors", "title_abstract", "content_features", "store_statistics", "embedding_cache", "papers_files",
    "unprocessed_papers", "claim_support", "citations_apa_ieee", "answer_assembly", "cited_prompts", "hash_embed",
)
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p}{'/*.parquet' if Path(p).is_dir() else ''}'")
    return c


def rows(df, names):
    def plain(x):
        x = x.item() if hasattr(x, "item") else x
        return None if x is None or x is pd.NA or x != x else x

    frame = df[names].astype(object)
    return Counter(tuple(plain(x) for x in r) for r in frame.where(frame.notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", SOME)
def test_same_as_sql(spark, duck, name):
    from ashlar.plans import catalog

    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    assert rows(got, names) == rows(want, names)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["q", "doc", "score", "rank"]
    assert set(e.oracle_sql()) <= set(e.queries())
