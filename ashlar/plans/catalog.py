"""Queries over the driver's tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scores, text
from ..operators import bm25, chunk, curate, evaluate, fulltext, prompt, ranking, vectors, verify
from ..shared import numbered
from ..sources import remote, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literals(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple], names: str) -> str:
    def one(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        if isinstance(x, list):
            return "[" + ", ".join(map(one, x)) + "]"
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        return repr(x)

    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({names})"


# --- fixtures ------------------------------------------------------------------------------------------------------
QUESTIONS = [
    (0, "What is the Transformer architecture?"), (1, "compare CNN and RNN for image processing"), (2, "latest developments in generative models"),
    (3, "what is transformer attention mechanism"), (4, "How to implement a new algorithm?"), (5, "Why does GAN training fail"),
    (6, "show the summary of results"), (7, "explain how BERT works in NLP"), (8, "list an application of ML because of its use"),
    (9, "discuss which method is better or worse"), (10, "hello world"), (11, ""),
]
PAPERS = [
    ("p1", "Attention Is All You Need", "a" * 600, ["A. Vaswani", "N. Shazeer", "N. Parmar"], "2017-06-12", 2017, 50000, 2.0, "NeurIPS 2017", "s2"),
    ("p2", "Deep Residual Learning for Image Recognition", "b" * 1200, ["K. He", "X. Zhang"], "2015-12-10", 2015, 45000, 1.9, "CVPR", "s2"),
    ("p3", "Graph Attention Networks", "c" * 300, ["P. Velickovic"], "2017-10-30", 2017, 500, 0.7, "iclr workshop", "arxiv"),
    ("p4", "A note", "d" * 100, [], None, None, None, None, None, "arxiv"),
    ("p5", "On the sizes of small sets", "e" * 40, ["B. Beta", "C. Gamma", "D. Delta", "E. Epsilon"], "n.d.", 2021, 40, 0.1, "Journal", "s2"),
    ("p6", "GPT and BERT for neural translation", "f" * 501, ["Z. Zeta"], "2020-01-01", 2020, 12000, 1.2, "Nature Machine", None),
]
PAPER_SCHEMA = "id string, title string, abstract string, authors array<string>, published string, year int, citations long, quality double, venue string, source string"
PAPER_NAMES = "id, title, abstract, authors, published, year, citations, quality, venue, source"
PAGE = "Neural Methods for Everything\nA. Author\nAbstract\nWe show that it works well.\nIt is fast.\n\n\n1. Introduction\nmethod matters here\nResults show gains.\n2. Methods\nWe use $x = y$ and Table 3.\n3 Results\nFigure 2 shows all.\nDiscussion follows\nReferences\n[1] A paper (Smith, 2020)."
TEXTS = [(1, PAGE), (2, "def f(x): return {x}\nsee http://example.org and [1, 2]"), (3, "第一章 方法\n我们研究了图 3 的结果"), (4, "plain words only"), (5, "")]
SOURCES = [
    ("A. Vaswani", "p1", "The model shows that attention is enough and demonstrates gains.", 0.9, "abstract", 1),
    ("B. Beta", "p2", "However the method is slow but it works.", 0.5, "content", 2),
    ("C. Gamma", "p3", "Attention is a mechanism of the model that shows and proves and confirms gains of 5 points.", 0.7, "methodology", 3),
]
ANSWER = "The model shows that attention is enough for gains. It was slow. The method of the paper improves results a lot! Nothing else."

# --- tokens and BM25 -----------------------------------------------------------------------------------------------
TOKENS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}_]+'), lambda t: regexp_full_match(t, '[a-z]+'))".format
WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda t: t <> '')".format
WORDSET = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda t: t <> ''))".format
OVERLAP = "CASE WHEN len({a}) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / len({a}) ELSE 0 END".format


@query("tokenize_stats", f"SELECT doc_id, len({TOKENS('text')}) AS n_tokens, len(list_distinct({TOKENS('text')})) AS n_distinct FROM documents")
def tokenize_stats(spark, sf):
    t = text.letters_tokens("text")
    return table(spark, sf, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


BM25_CTE = f"""tok AS (SELECT doc_id AS doc, unnest({TOKENS('text')}) AS term FROM documents),
len AS (SELECT doc_id AS doc, len({TOKENS('text')}) AS len FROM documents),
st AS (SELECT count(*) AS n, avg(len) AS avgdl FROM len),
post AS (SELECT doc, term, count(*) AS tf FROM tok GROUP BY ALL),
idf AS (SELECT term, count(*) AS df, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post, st GROUP BY term)"""
BM25_SCORE = """asked AS (SELECT q, term, count(*) AS times FROM (SELECT q, unnest({tok}) AS term FROM qs) GROUP BY ALL),
sc AS (SELECT q, post.doc, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 9) AS score
  FROM asked JOIN post USING (term) JOIN idf USING (term) JOIN len ON len.doc = post.doc, st GROUP BY q, post.doc),
grid AS (SELECT q, len.doc, coalesce(score, 0) AS score FROM qs CROSS JOIN len LEFT JOIN sc USING (q, doc)),
top AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM grid)""".format(tok=TOKENS("question"))
BENCH_Q = "qs AS (SELECT item_id AS q, text AS question FROM benchmark)"


def _asked(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("q"), F.col("text").alias("question"))


@query("bm25_avgdl", f"WITH {BM25_CTE} SELECT n, round(avgdl, 6) AS avgdl FROM st")
def bm25_avgdl(spark, sf):
    return bm25.build(table(spark, sf, "documents")).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


@query("bm25_idf", f"WITH {BM25_CTE} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_idf(spark, sf):
    return bm25.build(table(spark, sf, "documents")).write().terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query("bm25_topk", f"WITH {BM25_CTE}, {BENCH_Q}, {BM25_SCORE} SELECT q, doc, round(score, 6) AS score, rank FROM top WHERE rank <= 5")
def bm25_topk(spark, sf):
    found = bm25.search(bm25.build(table(spark, sf, "documents")), _asked(spark, sf), 5)
    return found.select("q", "doc", F.round("score", 6).alias("score"), "rank")


@query("bm25_short_questions", f"WITH {BM25_CTE}, qs AS (SELECT q, question FROM {values(QUESTIONS, 'q, question')}), {BM25_SCORE} SELECT q, doc, round(score, 6) AS score, rank FROM top WHERE rank <= 5")
def bm25_short_questions(spark, sf):
    found = bm25.search(bm25.build(table(spark, sf, "documents")), literals(spark, QUESTIONS, "q int, question string"), 5)
    return found.select("q", "doc", F.round("score", 6).alias("score"), "rank")


# --- vectors ---------------------------------------------------------------------------------------------------------
KNN_CTE = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
sim AS (SELECT a.vec_id AS q, b.vec_id, b.label, round(list_cosine_similarity(a.e, b.e), 9) AS cosine FROM v a, v b WHERE a.vec_id % 20 = 0),
top AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, vec_id) AS rank FROM sim{where})"""


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    # the stated query set of a search: every row whose id is divisible by 20
    return e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), "embedding")


@query("knn_topk", f"WITH {KNN_CTE.format(where='')} SELECT q, vec_id, round(cosine, 6) AS cosine, rank FROM top WHERE rank <= 10")
def knn_topk(spark, sf):
    return vectors.top_k(*_vectors(spark, sf), 10).withColumn("cosine", F.round("cosine", 6))


@query("knn_metadata_filter", f"WITH {KNN_CTE.format(where=' WHERE label = 3')} SELECT q, vec_id, round(cosine, 6) AS cosine, rank FROM top WHERE rank <= 5")
def knn_metadata_filter(spark, sf):
    return vectors.top_k(*_vectors(spark, sf), 5, {"label": 3}).withColumn("cosine", F.round("cosine", 6))


@query("knn_threshold", f"WITH {KNN_CTE.format(where='')} SELECT q, vec_id, round(cosine, 6) AS cosine, rank, true AS is_above_threshold FROM top WHERE rank <= 20 AND cosine >= 0.2")
def knn_threshold(spark, sf):
    return vectors.above(vectors.top_k(*_vectors(spark, sf), 20), 0.2).withColumn("cosine", F.round("cosine", 6))


@query(
    "knn_adaptive_k",
    f"""WITH {KNN_CTE.format(where='')}, f AS (SELECT *, lag(cosine) OVER (PARTITION BY q ORDER BY rank) - cosine AS fall FROM top WHERE rank <= 20),
c AS (SELECT *, min(CASE WHEN fall > 0.05 THEN rank - 1 END) OVER (PARTITION BY q) AS cut FROM f)
SELECT q, vec_id, round(cosine, 6) AS cosine, rank FROM c WHERE rank <= CASE WHEN cut < 8 THEN greatest(cut, 1) ELSE 8 END""",
)
def knn_adaptive_k(spark, sf):
    return vectors.adaptive(vectors.top_k(*_vectors(spark, sf), 20), 8, 0.05).withColumn("cosine", F.round("cosine", 6))


@query("threshold_sweep", f"WITH {KNN_CTE.format(where='')} SELECT q, threshold, count(*) FILTER (cosine >= threshold) AS n FROM top, (VALUES (0.1::DOUBLE), (0.3), (0.5)) AS t(threshold) WHERE rank <= 20 GROUP BY ALL")
def threshold_sweep(spark, sf):
    return vectors.sweep(vectors.top_k(*_vectors(spark, sf), 20))


@query("retrieval_stats", f"WITH {KNN_CTE.format(where='')} SELECT q, count(*) AS n, round(min(cosine), 6) AS low, round(max(cosine), 6) AS high, round(avg(cosine), 6) AS mean, count(*) FILTER (cosine >= 0.3) AS n_above FROM top WHERE rank <= 20 GROUP BY q")
def retrieval_stats(spark, sf):
    s = vectors.stats(vectors.top_k(*_vectors(spark, sf), 20), 0.3)
    return s.select("q", "n", *(F.round(c, 6).alias(c) for c in ("low", "high", "mean")), "n_above")


@query("distance_metrics", f"WITH {KNN_CTE.format(where='')} SELECT q, vec_id, round(greatest(0, 1 - d), 6) AS cosine, round(1 / (1 + d), 6) AS euclidean, round(d, 6) AS dot FROM (SELECT *, round(1 - cosine, 9) AS d FROM top WHERE rank <= 20)")
def distance_metrics(spark, sf):
    d = vectors.top_k(*_vectors(spark, sf), 20).withColumn("d", F.round(1 - F.col("cosine"), 9))
    return d.select("q", "vec_id", *(F.round(scores.similarity("d", m), 6).alias(m) for m in ("cosine", "euclidean", "dot")))


@query("multi_model_concat", "SELECT vec_id, len(embedding) * 2 AS size, round(list_sum(list_concat(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[]))), 6) AS total FROM embeddings")
def multi_model_concat(spark, sf):
    e = F.col("embedding").cast("array<double>")
    both = table(spark, sf, "embeddings").select("vec_id", vectors.concatenated([e, F.reverse(e)]).alias("v"))
    return both.select("vec_id", F.size("v").alias("size"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


# --- fusion and ranking -----------------------------------------------------------------------------------------------
FUSE_CTE = f"""{BM25_CTE}, {BENCH_Q}, {BM25_SCORE},
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
sim AS (SELECT a.vec_id AS q, b.vec_id AS doc, round(list_cosine_similarity(a.e, b.e), 9) AS score FROM v a JOIN benchmark ON item_id = a.vec_id, v b),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM sim) WHERE rank <= 10),
sparse AS (SELECT * FROM top WHERE rank <= 10),
fu AS (SELECT q, doc, coalesce(d.score, 0) AS vector, coalesce(s.score, 0) AS bm25 FROM dense d @HOW@ JOIN sparse s USING (q, doc)),
fused AS (SELECT *, 0.7 * vector + 0.3 * least(bm25 / 10, 1) AS combined FROM fu)"""
FUSE_OUT = "SELECT q, doc, round(vector, 6) AS vector, round(bm25, 6) AS bm25, round(combined, 6) AS combined, row_number() OVER (PARTITION BY q ORDER BY combined DESC, doc) AS rank FROM fused"


def _dense_sparse(spark, sf, k=10):
    e, items = table(spark, sf, "embeddings"), table(spark, sf, "benchmark")
    asked = e.join(items.select(F.col("item_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("q"), "embedding")
    dense = vectors.top_k(e, asked, k).select("q", F.col("vec_id").alias("doc"), F.col("cosine").alias("score"), "rank")
    return dense, bm25.search(bm25.build(table(spark, sf, "documents")), _asked(spark, sf), k)


def _fused(spark, sf, how):
    f = ranking.fuse(*_dense_sparse(spark, sf), how)
    return f.select("q", "doc", *(F.round(c, 6).alias(c) for c in ("vector", "bm25", "combined")), "rank")


@query("hybrid_fusion", f"WITH {FUSE_CTE.replace('@HOW@', 'LEFT')} {FUSE_OUT}")
def hybrid_fusion(spark, sf):
    return _fused(spark, sf, "left")


@query("hybrid_fusion_full", f"WITH {FUSE_CTE.replace('@HOW@', 'FULL')} {FUSE_OUT}")
def hybrid_fusion_full(spark, sf):
    return _fused(spark, sf, "full")


@query(
    "final_merge_fill",
    f"""WITH {FUSE_CTE.replace('@HOW@', 'LEFT')}, a AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM dense WHERE score >= 0.25),
h AS (SELECT q, count(*) AS have FROM a GROUP BY q),
u AS (SELECT q, doc, rank, 0 AS part FROM a UNION ALL SELECT q, doc, rank, 1 FROM sparse LEFT JOIN h USING (q) WHERE coalesce(have, 0) < 3)
SELECT * FROM (SELECT q, doc, rank, part, row_number() OVER (PARTITION BY q ORDER BY part, rank, doc) AS place FROM u) WHERE place <= 5""",
)
def final_merge_fill(spark, sf):
    dense, sparse = _dense_sparse(spark, sf)
    first = vectors.above(dense, 0.25, "score", "doc")
    return ranking.final_list(first, sparse).select("q", "doc", "rank", "part", "place")


PAIRS_SQL = """pairs AS (SELECT u.conv_id AS q, u.turn AS doc, u.text AS question, a.text AS content,
  (['abstract', 'methodology', 'results', 'introduction', 'conclusion', 'content', 'other'])[(u.turn % 7 + 1)::INT] AS section,
  contains(a.text, '=') AS has_formulas, contains(a.text, 'the') AS has_code, contains(a.text, 'a') AS has_citations
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""


def _pairs(spark, sf):
    """Each user turn with the assistant's reply, and metadata derived from them."""
    c = table(spark, sf, "conversations")
    names = F.array(*map(F.lit, ["abstract", "methodology", "results", "introduction", "conclusion", "content", "other"]))
    a = c.where("role = 'assistant'").select(F.col("conv_id").alias("q"), (F.col("turn") - 1).alias("doc"), F.col("text").alias("content"))
    u = c.where("role = 'user'").select(F.col("conv_id").alias("q"), F.col("turn").alias("doc"), F.col("text").alias("question"))
    p = u.join(a, ["q", "doc"]).withColumn("section", F.element_at(names, (F.col("doc") % 7 + 1).cast("int")))
    return p.withColumns({k: F.contains("content", F.lit(v)) for k, v in (("has_formulas", "="), ("has_code", "the"), ("has_citations", "a"))})


def _case(column: str, values_: dict, default: float) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v}::DOUBLE" for k, v in values_.items()) + f" ELSE {default} END"


QA_OVERLAP = OVERLAP(a=WORDSET("question"), b=WORDSET("content"))


@query(
    "rerank_features",
    f"""WITH {PAIRS_SQL}, s AS (SELECT *, {QA_OVERLAP} AS ov, {_case('section', K.SECTION_RELEVANCE, 0.5)} AS sr,
  least(1, 0.5 + CASE WHEN has_formulas THEN 0.2 ELSE 0 END + CASE WHEN has_code THEN 0.1 ELSE 0 END + CASE WHEN has_citations THEN 0.2 ELSE 0 END)::DOUBLE AS qu,
  CASE WHEN length(content) < 100 THEN 0.3 WHEN length(content) > 1500 THEN 0.6 ELSE 1 - abs(length(content) - 500) / 500.0::DOUBLE * 0.3 END AS le FROM pairs),
r AS (SELECT *, round(0.3 * ov + 0.2 * sr + 0.2 * qu + 0.1 * le + 0.05 + 0.1 * CASE WHEN has_citations THEN 1.0 ELSE 0.5 END, 6) AS rerank FROM s)
SELECT q, doc, rerank, row_number() OVER (PARTITION BY q ORDER BY rerank DESC, doc) AS rank FROM r""",
)
def rerank_features(spark, sf):
    s = scores.rerank_score("question", "content", "section", "has_formulas", "has_code", "has_citations")
    order = Window.partitionBy("q").orderBy(F.desc("rerank"), "doc")
    return _pairs(spark, sf).select("q", "doc", F.round(s, 6).alias("rerank")).withColumn("rank", F.row_number().over(order))


# --- questions ---------------------------------------------------------------------------------------------------------
def _questions(spark, sf):
    fixed = literals(spark, QUESTIONS, "q long, question string")
    return fixed.unionByName(_asked(spark, sf).withColumn("q", F.col("q") + 1000))


Q_SQL = f"qs AS (SELECT q::BIGINT AS q, question FROM {values(QUESTIONS, 'q, question')} UNION ALL SELECT item_id + 1000, text FROM benchmark)"


def _cascade_sql(classes: list, default: str) -> str:
    when = " ".join("WHEN " + " OR ".join(f"contains(lower(question), '{w}')" for w in ws) + f" THEN '{c}'" for c, ws in classes)
    return f"CASE {when} ELSE '{default}' END"


def _points(name: str) -> str:
    return " + ".join(f"regexp_matches(lower(question), '{p}')::INT" for p in K.INTENTS[name])


_INTENT_CASE = " ".join(f"WHEN best > 0 AND p_{i} = best THEN {{}}".format(f"'{i}'") for i in K.INTENTS)
_CONF_CASE = " ".join(f"WHEN best > 0 AND p_{i} = best THEN p_{i} / {len(ps)}::DOUBLE" for i, ps in K.INTENTS.items())


@query(
    "intent_scores",
    f"""WITH {Q_SQL}, p AS (SELECT q, question, {', '.join(f'{_points(i)} AS p_{i}' for i in K.INTENTS)} FROM qs),
b AS (SELECT *, greatest({', '.join(f'p_{i}' for i in K.INTENTS)}) AS best FROM p)
SELECT q, CASE {_INTENT_CASE} ELSE 'general' END AS intent, round(CASE {_CONF_CASE} ELSE 1 END, 6) AS confidence FROM b""",
)
def intent_scores(spark, sf):
    return _questions(spark, sf).select("q", scores.intent("question").alias("i")).select("q", "i.intent", F.round("i.confidence", 6).alias("confidence"))


@query("query_type", f"WITH {Q_SQL} SELECT q, {_cascade_sql(K.QUERY_TYPES, 'general')} AS query_type FROM qs")
def query_type(spark, sf):
    return _questions(spark, sf).select("q", scores.query_type("question").alias("query_type"))


@query("difficulty_category", f"WITH {Q_SQL} SELECT q, {_cascade_sql(K.DIFFICULTIES, 'medium')} AS difficulty, {_cascade_sql(K.CATEGORIES, 'general')} AS category FROM qs")
def difficulty_category(spark, sf):
    return _questions(spark, sf).select("q", scores.difficulty("question").alias("difficulty"), scores.category("question").alias("category"))


_EXPANDED = "list_concat(" * (len(K.EXPANSIONS) - 1) + ", ".join(f"CASE WHEN contains(lower(question), '{k}') THEN {v!r} ELSE [] END" + (")" if n else "") for n, (k, v) in enumerate(K.EXPANSIONS.items()))


@query("query_expansion", f"WITH {Q_SQL}, e AS (SELECT q, question, {_EXPANDED} AS x FROM qs) SELECT q, CASE WHEN len(x) > 0 THEN question || ' ' || array_to_string(x[1:3], ' ') ELSE question END AS expanded FROM e")
def query_expansion(spark, sf):
    return _questions(spark, sf).select("q", scores.expanded("question").alias("expanded"))


@query("keywords", f"WITH {Q_SQL} SELECT q, array_to_string(list_filter({TOKENS('question')}, lambda t: length(t) > 2 AND NOT list_contains({K.STOP_WORDS!r}, t)), ' ') AS keywords FROM qs")
def keywords(spark, sf):
    return _questions(spark, sf).select("q", F.array_join(text.keywords("question"), " ").alias("keywords"))


@query("domain_terms", f"WITH {Q_SQL} SELECT q, " + " || ".join(f"CASE WHEN {' OR '.join(f'''contains(lower(question), '{w}')''' for w in ws)} THEN '{d};' ELSE '' END" for d, ws in K.DOMAINS.items()) + " AS domains FROM qs")
def domain_terms(spark, sf):
    return _questions(spark, sf).select("q", F.array_join(F.transform(scores.domains("question"), lambda d: F.concat(d, F.lit(";"))), "").alias("domains"))


@query("literal_keywords", f"SELECT keyword, length(keyword) AS n FROM {values([(k,) for k in K.KEYWORDS], 'keyword')}")
def literal_keywords(spark, sf):
    return literals(spark, [(k,) for k in K.KEYWORDS], "keyword string").select("keyword", F.length("keyword").cast("long").alias("n"))


# --- contexts, prompts, answers -----------------------------------------------------------------------------------------
CONTEXT_SQL = f"""{PAIRS_SQL}, cx AS (SELECT *, 'Part ' || section || ' vs rest' AS title, {QA_OVERLAP} AS score, doc AS rank FROM pairs),
ty AS (SELECT *, {_cascade_sql(K.QUERY_TYPES, 'general')} AS qt, CASE WHEN contains(section, 'abstract') OR contains(section, 'introduction') THEN 'overview'
  WHEN contains(section, 'method') OR contains(section, 'algorithm') THEN 'technical' WHEN contains(lower(title), 'comparison') OR contains(lower(title), 'vs') THEN 'comparison' ELSE 'paper' END AS ct FROM cx),
pr AS (SELECT *, trunc(score * 100)::INT + CASE WHEN qt = 'technical' AND ct = 'technical' THEN 20 WHEN qt = 'definition' AND ct = 'overview' THEN 15 WHEN qt = 'comparison' AND ct = 'comparison' THEN 25 ELSE 0 END
  + CASE WHEN qt = 'definition' AND contains(section, 'abstract') THEN 10 WHEN qt = 'technical' AND contains(section, 'method') THEN 15 ELSE 0 END AS priority FROM ty),
pl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY priority DESC, rank, doc) AS place FROM pr) WHERE place <= 5)"""
ENTRY_SQL = r"""en AS (SELECT *, '[source ' || place || '] ' || title || CASE WHEN section IN ('', 'content') THEN '' ELSE ' [' || section || ']' END || chr(10)
  || CASE WHEN length(cl) > 800 THEN cl[:800] || '...' ELSE cl END || chr(10) AS entry
  FROM (SELECT *, regexp_replace(trim(regexp_replace(content, '\s+', ' ', 'g')), '[^\p{L}\p{N}\p{M}_\s.,;:!?()\[\]{}\-]', '', 'g') AS cl FROM pl))"""


def _contexts(spark, sf):
    r = _pairs(spark, sf).withColumns({"title": F.concat(F.lit("Part "), F.col("section"), F.lit(" vs rest")), "score": scores.overlap("question", "content"), "rank": F.col("doc")})
    return prompt.contexts(r)


@query("context_priority_topk", f"WITH {CONTEXT_SQL} SELECT q, doc, qt AS query_type, ct AS context_type, priority, place FROM pl")
def context_priority_topk(spark, sf):
    return _contexts(spark, sf).select("q", "doc", "query_type", "context_type", "priority", "place")


def _entries(spark, sf):
    return _contexts(spark, sf).withColumn("entry", prompt.entry("place", "title", F.lit(""), "section", "content"))


@query("prompt_budget", f"WITH {CONTEXT_SQL}, {ENTRY_SQL}, r AS (SELECT *, sum(length(entry)) OVER (PARTITION BY q ORDER BY place) AS used FROM en) SELECT q, place, length(entry) AS length, used::BIGINT AS used, md5(entry) AS entry_md5 FROM r WHERE used <= 700 OR place = 1")
def prompt_budget(spark, sf):
    return prompt.within(_entries(spark, sf), 700).select("q", "place", F.col("length").cast("long").alias("length"), "used", F.md5(F.col("entry").cast("binary")).alias("entry_md5"))


_LAYOUT = " ".join(f"WHEN '{t}' THEN '{l.replace(chr(39), chr(39) * 2)}'" for t, _, l in prompt.TEMPLATES)


@query(
    "prompt_build",
    f"""WITH {CONTEXT_SQL}, {ENTRY_SQL}, r AS (SELECT *, sum(length(entry)) OVER (PARTITION BY q ORDER BY place) AS used FROM en),
g AS (SELECT q, question, qt, string_agg(entry, chr(10) ORDER BY place) AS context, count(*) AS n FROM r WHERE used <= 2000 OR place = 1 GROUP BY ALL)
SELECT q, qt AS query_type, n AS n_contexts, length(context) AS context_length, md5(replace(replace(CASE qt {_LAYOUT} END, '{{query}}', question), '{{context}}', context)) AS prompt_md5 FROM g""",
)
def prompt_build(spark, sf):
    p = prompt.prompts(prompt.within(_entries(spark, sf), 2000), prompt.templates(spark))
    return p.select("q", "query_type", F.col("n_contexts").cast("long").alias("n_contexts"), F.col("context_length").cast("long").alias("context_length"), F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


@query(
    "token_budget",
    f"""WITH {CONTEXT_SQL}, t AS (SELECT *, {WORDS('content')} AS w, len({WORDS('question')}) + 2 AS spent FROM pl),
k AS (SELECT *, trunc(len(w) * 0.75)::BIGINT AS tokens FROM t),
b AS (SELECT *, spent + coalesce(sum(tokens) OVER (PARTITION BY q ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT q, place, tokens, before::BIGINT AS before, tokens > 120 - before AS truncated,
  md5(CASE WHEN tokens > 120 - before THEN array_to_string(w[1:trunc((120 - before) / 0.75)::INT], ' ') || '...' ELSE content END) AS text_md5 FROM b WHERE before < 120""",
)
def token_budget(spark, sf):
    b = prompt.token_budget(_contexts(spark, sf), 120)
    return b.select("q", "place", F.col("tokens").cast("long").alias("tokens"), F.col("before").cast("long").alias("before"), "truncated", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_W = _case("section", K.SECTION_WEIGHTS, 1.0)
RELEVANCE_SQL = f"least(1, (0.5 * 0.4 + ({QA_OVERLAP}) * 0.4 + {_W} * 0.1 + (CASE WHEN has_formulas THEN 0.1 ELSE 0 END + CASE WHEN has_citations THEN 0.1 ELSE 0 END + CASE WHEN has_code THEN 0.05 ELSE 0 END) * 0.1) * {_W})"


@query("context_relevance", f"WITH {PAIRS_SQL} SELECT q, doc, round({RELEVANCE_SQL}, 6) AS relevance FROM pairs")
def context_relevance(spark, sf):
    r = scores.context_relevance("question", "content", "section", F.lit(0.5), "has_formulas", "has_citations", "has_code")
    return _pairs(spark, sf).select("q", "doc", F.round(r, 6).alias("relevance"))


@query(
    "context_confidence",
    f"""WITH {PAIRS_SQL}, r AS (SELECT q, doc, {RELEVANCE_SQL} AS relevance FROM pairs), f AS (SELECT * FROM r WHERE relevance >= 0.3)
SELECT q, count(*) AS n, round(avg(relevance), 6) AS avg_relevance, count(DISTINCT doc) AS papers, round(least(1, avg(relevance) * count(*) / 5), 6) AS confidence, least(1, avg(relevance) * count(*) / 5) >= 0.3 AS passed FROM f GROUP BY q""",
)
def context_confidence(spark, sf):
    r = scores.context_relevance("question", "content", "section", F.lit(0.5), "has_formulas", "has_citations", "has_code")
    c = prompt.confidence(_pairs(spark, sf).withColumn("relevance", r).where("relevance >= 0.3"))
    return c.select("q", "n", F.round("avg_relevance", 6).alias("avg_relevance"), "papers", F.round("confidence", 6).alias("confidence"), "passed")


@query(
    "fallback_answer",
    f"""WITH {PAIRS_SQL}, p AS (SELECT q, doc, question, {_cascade_sql(K.QUERY_TYPES, 'general')} AS intent,
  list_filter(list_transform(string_split(content, '.'), lambda s: trim(s)), lambda s: length(s) > 20)[1:5] AS pts FROM pairs),
k AS (SELECT *, CASE WHEN intent = 'definition' OR contains(lower(question), 'what is') THEN 'Definition' WHEN intent = 'comparison' OR contains(lower(question), 'difference') OR contains(lower(question), 'compare') THEN 'Comparison'
  WHEN intent = 'methodology' OR contains(lower(question), 'how to') OR contains(lower(question), 'method') THEN 'Method' ELSE 'Findings' END AS kind FROM p)
SELECT q, doc, md5(CASE WHEN len(pts) = 0 THEN 'No source answers: ' || question ELSE kind || ' for: ' || question || chr(10) ||
  array_to_string(list_transform(pts[1:CASE kind WHEN 'Method' THEN 4 WHEN 'Findings' THEN 5 ELSE 3 END], lambda x, i: i || '. ' || x), chr(10)) END) AS answer_md5 FROM k""",
)
def fallback_answer(spark, sf):
    a = prompt.fallback("question", "content", scores.query_type("question"))
    return _pairs(spark, sf).select("q", "doc", F.md5(a.cast("binary")).alias("answer_md5"))


# --- evaluation ---------------------------------------------------------------------------------------------------------
EVAL_KNN = f"{KNN_CTE.format(where=' WHERE q <> vec_id')}, near AS (SELECT * FROM top WHERE rank <= 5)"


def _near(spark, sf, k=5):
    near = vectors.top_k(*_vectors(spark, sf), k + 1).where("q <> vec_id")
    order = Window.partitionBy("q").orderBy("rank")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@query("context_precision", f"WITH {EVAL_KNN} SELECT q, round(least(1, greatest(0, 0.7 * avg(cosine) + 0.3 * max(cosine))), 6) AS context_relevance, round(avg((cosine > 0.5)::INT), 6) AS context_precision FROM near GROUP BY q")
def context_precision(spark, sf):
    m = evaluate.context_metrics(_near(spark, sf), "q")
    return m.select("q", F.round("context_relevance", 6).alias("context_relevance"), F.round("context_precision", 6).alias("context_precision"))


@query(
    "context_recall",
    f"""WITH {EVAL_KNN}, qs AS (SELECT vec_id AS q, label, e FROM v WHERE vec_id % 20 = 0),
rel AS (SELECT qs.q, v.vec_id AS relevant_id, v.e FROM qs JOIN v ON v.label = qs.label AND v.vec_id <> qs.q),
best AS (SELECT rel.q, relevant_id, max(round(list_cosine_similarity(rel.e, v.e), 9)) AS best FROM rel JOIN near ON near.q = rel.q JOIN v ON v.vec_id = near.vec_id GROUP BY ALL)
SELECT qs.q, coalesce(r, 0) AS context_recall FROM qs LEFT JOIN (SELECT q, round(avg((best > 0.7)::INT), 6) AS r FROM best GROUP BY q) USING (q)""",
)
def context_recall(spark, sf):
    """Relevant: all other vectors of the question's label; a question without any has 0."""
    e, q = _vectors(spark, sf)
    near = _near(spark, sf).select("q", "vec_id").join(e.select("vec_id", "embedding"), "vec_id").groupBy("q").agg(F.collect_list("embedding").alias("found"))
    labels = e.select(F.col("vec_id").alias("q"), "label").join(q.select("q"), "q")
    asked = labels.join(near, "q")
    r = evaluate.label_recall(asked, e.select(F.col("vec_id").alias("relevant_id"), "label", "embedding"))
    return labels.select("q").join(r, "q", "left").select("q", F.round(F.coalesce("context_recall", F.lit(0.0)), 6).alias("context_recall"))


def hashed_sql(text: str, size: int = 64) -> str:
    """The token counts of vectors.hashed, not scaled: cosines do not see the difference."""
    slots = f"list_transform({TOKENS(text)}, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % {size})"
    return f"(SELECT list_transform(range({size}), lambda i: len(list_filter(s, lambda x: x = i))::DOUBLE) FROM (SELECT {slots} AS s))"


def _cos(a: str, b: str) -> str:
    return f"(CASE WHEN list_sum({a}) > 0 AND list_sum({b}) > 0 THEN list_cosine_similarity({a}, {b}) ELSE 0 END)"


CASES_SQL = f"""{PAIRS_SQL}, cc AS (SELECT q, list(content ORDER BY doc) AS contexts FROM pairs GROUP BY q),
c0 AS (SELECT p.q * 1000 + p.doc AS case_id, question, content AS answer, {_cascade_sql(K.DIFFICULTIES, 'medium')} AS difficulty, section AS category, contexts, array_to_string(contexts, ' ') AS joined FROM pairs p JOIN cc USING (q)),
h0 AS MATERIALIZED (SELECT case_id, {hashed_sql('question')} AS hq, {hashed_sql('answer')} AS ha, {hashed_sql('joined')} AS hj FROM c0),
x0 AS MATERIALIZED (SELECT case_id, {hashed_sql('x')} AS hx FROM (SELECT case_id, unnest(contexts) AS x FROM c0)),
x1 AS MATERIALIZED (SELECT case_id, list(round({_cos('hq', 'hx')}, 9)) AS cs FROM x0 JOIN h0 USING (case_id) GROUP BY case_id),
m AS MATERIALIZED (SELECT case_id, question, answer, difficulty, category, contexts, least(1, greatest(0, 0.7 * list_sum(cs) / len(cs) + 0.3 * list_max(cs))) AS context_relevance,
  least(1, greatest(0, 0.7 * {_cos('ha', 'hj')} + 0.3 * {OVERLAP(a=WORDSET('answer'), b=WORDSET('joined'))})) AS faithfulness, least(1, greatest(0, {_cos('hq', 'ha')})) AS answer_relevance,
  len(list_filter(cs, lambda c: c > 0.5))::DOUBLE / len(cs) AS context_precision, (list_max(cs) > 0.7)::INT::DOUBLE AS context_recall,
  len({WORDS('answer')}) AS answer_words, len(contexts) AS context_count, list_sum(list_transform(contexts, lambda t: len({WORDS('t')}))) / len(contexts)::DOUBLE AS context_words
  FROM c0 JOIN h0 USING (case_id) JOIN x1 USING (case_id)),
cases AS (SELECT *, least(1, greatest(0, 0.25 * context_relevance + 0.3 * faithfulness + 0.25 * answer_relevance + 0.15 * context_precision + 0.05 * context_recall)) AS overall_score FROM m)"""


def _cases(spark, sf):
    """A case for each user turn: the reply is the answer, all replies of the conversation are the contexts, the question itself what is to be found."""
    p = _pairs(spark, sf)
    held = p.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("doc", "content"))).alias("c")).select("q", F.transform("c", lambda x: x["content"]).alias("contexts"))
    c = p.join(held, "q").select(
        (F.col("q") * 1000 + F.col("doc")).alias("case_id"), "question", "contexts", F.col("content").alias("answer"), F.array("question").alias("relevant"),
        scores.difficulty("question").alias("difficulty"), F.col("section").alias("category"),
    )
    return evaluate.evaluate_cases(c, vectors.counted)


@query("case_metrics", f"WITH {CASES_SQL} SELECT case_id, {', '.join(f'round({m}, 6) AS {m}' for m in evaluate.METRICS)}, answer_words, context_count, round(context_words, 6) AS context_words FROM cases")
def case_metrics(spark, sf):
    return _cases(spark, sf).select("case_id", *(F.round(m, 6).alias(m) for m in evaluate.METRICS), "answer_words", "context_count", F.round("context_words", 6).alias("context_words"))


@query("evaluation_loop", f"WITH {CASES_SQL}, f AS (SELECT *, answer_words % 7 = 0 AS failed FROM cases) SELECT count(*) AS n, round(avg(overall_score), 6) AS avg_overall_score, round(min(answer_relevance), 6) AS min_answer_relevance, round(max(faithfulness), 6) AS max_faithfulness FROM f WHERE NOT failed")
def evaluation_loop(spark, sf):
    """The loop over a system that gives the replies as they are, and fails on some."""
    known = _cases(spark, sf).select("case_id", "question", "contexts", "answer", "relevant", "difficulty", "category", "answer_words")
    data = known.select(F.col("case_id").alias("id"), "question", F.col("relevant").alias("relevant_contexts"), "difficulty", "category")
    error = F.when(F.col("answer_words") % 7 == 0, "failed")
    found = evaluate.evaluate_system(lambda asked: asked.join(known.select("case_id", "contexts", "answer", error.alias("error")), "case_id"), data, vectors.counted)
    return found["summary"].select("n", *(F.round(c, 6).alias(c) for c in ("avg_overall_score", "min_answer_relevance", "max_faithfulness")))


@query("answer_labels", f"WITH {CASES_SQL} SELECT case_id, CASE WHEN overall_score >= 0.8 THEN 'high' WHEN overall_score >= 0.6 THEN 'medium' WHEN overall_score >= 0.4 THEN 'low' ELSE 'very low' END AS label, CASE WHEN overall_score >= 0.8 THEN 'use as is' WHEN overall_score >= 0.6 THEN 'verify key facts' WHEN overall_score >= 0.4 THEN 'verify further' ELSE 'gather more' END AS recommendation FROM cases")
def answer_labels(spark, sf):
    return _cases(spark, sf).select("case_id", scores.confidence_label("overall_score").alias("label"), scores.recommendation("overall_score").alias("recommendation"))


@query("faithfulness_lexical", f"WITH {PAIRS_SQL} SELECT q, doc, round({OVERLAP(a=WORDSET('content'), b=WORDSET('question'))}, 6) AS overlap, round({QA_OVERLAP}, 6) AS coverage, len({WORDS('content')}) AS answer_words FROM pairs")
def faithfulness_lexical(spark, sf):
    r = evaluate.lexical(_pairs(spark, sf), "content", "question")
    return r.select("q", "doc", F.round("overlap", 6).alias("overlap"), F.round("coverage", 6).alias("coverage"), "answer_words")


@query("overall_score", f"WITH {CASES_SQL} SELECT case_id, round(overall_score, 6) AS overall_score, CASE WHEN overall_score >= 0.8 THEN 'excellent' WHEN overall_score >= 0.7 THEN 'good' WHEN overall_score >= 0.6 THEN 'fair' WHEN overall_score >= 0.5 THEN 'pass' ELSE 'needs work' END AS grade FROM cases")
def overall_score(spark, sf):
    return _cases(spark, sf).select("case_id", F.round("overall_score", 6).alias("overall_score"), scores.grade("overall_score").alias("grade"))


_STATS = ", ".join(f"round({f}({m}), 6) AS {a}_{m}" for m in evaluate.METRICS for a, f in (("avg", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")))


def _rounded(df, keep):
    return df.select(*keep, *(F.round(c, 6).alias(c) for c in df.columns if c not in keep))


@query("eval_summary", f"WITH {CASES_SQL} SELECT count(*) AS n, {_STATS} FROM cases")
def eval_summary(spark, sf):
    return _rounded(evaluate.summary(_cases(spark, sf)), ["n"])


@query("eval_group_stats", f"WITH {CASES_SQL} SELECT CASE WHEN grouping(difficulty) = 0 THEN 'difficulty' ELSE 'category' END AS key, coalesce(difficulty, category) AS value, count(*) AS n, {_STATS} FROM cases GROUP BY GROUPING SETS ((difficulty), (category))")
def eval_group_stats(spark, sf):
    return _rounded(evaluate.group_stats(_cases(spark, sf)), ["key", "value", "n"])


@query(
    "eval_best_worst",
    f"""WITH {CASES_SQL}, r AS (SELECT case_id, CASE WHEN length(question) > 100 THEN question[:100] || '...' ELSE question END AS question, round(overall_score, 9) AS s FROM cases)
SELECT * FROM (SELECT 'best' AS side, case_id, question, round(s, 6) AS overall_score FROM r ORDER BY s DESC, case_id LIMIT 3) UNION ALL SELECT * FROM (SELECT 'worst', case_id, question, round(s, 6) FROM r ORDER BY s, case_id LIMIT 3)""",
)
def eval_best_worst(spark, sf):
    c = _cases(spark, sf).withColumn("overall_score", F.round("overall_score", 9))
    both = evaluate.top_cases(c).withColumn("side", F.lit("best")).unionByName(evaluate.top_cases(c, False).withColumn("side", F.lit("worst")))
    return both.withColumn("overall_score", F.round("overall_score", 6))


@query("score_histogram", f"WITH {CASES_SQL}, e AS (SELECT min(overall_score) AS lo, max(overall_score) AS hi FROM cases) SELECT CASE WHEN hi = lo THEN 0 ELSE least(floor((overall_score - lo) / (hi - lo) * 20), 19) END::INT AS bin, count(*) AS n FROM cases, e GROUP BY 1")
def score_histogram(spark, sf):
    return evaluate.histogram(_cases(spark, sf))


_CORR = ("context_relevance", "faithfulness", "answer_relevance", "context_precision")


@query("metric_corr", f"WITH {CASES_SQL} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM cases" for a in _CORR for b in _CORR))
def metric_corr(spark, sf):
    return evaluate.correlations(_cases(spark, sf), _CORR).select("a", "b", F.round("r", 6).alias("r"))


@query("csv_report", f"WITH {CASES_SQL} SELECT case_id, difficulty, category, length(question) AS question_length, length(answer) AS answer_length, len(contexts) AS context_count, {', '.join(f'round({m}, 6) AS {m}' for m in evaluate.METRICS)} FROM cases")
def csv_report(spark, sf):
    return _rounded(evaluate.report_rows(_cases(spark, sf)), ["case_id", "difficulty", "category", "question_length", "answer_length", "context_count"])


REPLIES = [(-1, 'Sure: {"context_relevance": 5, "faithfulness": 4, "answer_relevance": 3, "completeness": 2, "clarity": 1} ok'), (-2, "no json"), (-3, '{"context_relevance": 1}')]
REPLY_SQL = f"""re AS (SELECT q::BIGINT AS q, reply FROM {values(REPLIES, 'q, reply')} UNION ALL
SELECT doc_id, 'Marks {{{{"context_relevance": ' || (1 + quality * 4) || ', "faithfulness": 3, "answer_relevance": ' || (1 + doc_id % 5) || ', "completeness": 2, "clarity": ' || (1 + toxic * 4) || '}}}} so' FROM labels)""".replace("{{", "{").replace("}}", "}")


@query("judge_parse", f"WITH {REPLY_SQL} SELECT q, round((try_cast(j ->> '$.context_relevance' AS DOUBLE) - 1) / 4, 6) AS context_relevance, round((try_cast(j ->> '$.answer_relevance' AS DOUBLE) - 1) / 4, 6) AS answer_relevance, round((try_cast(j ->> '$.clarity' AS DOUBLE) - 1) / 4, 6) AS clarity FROM (SELECT q, try_cast(nullif(regexp_extract(reply, '(?s)\\{{.*\\}}'), '') AS JSON) AS j FROM re)")
def judge_parse(spark, sf):
    marks = table(spark, sf, "labels").select(
        F.col("doc_id").alias("q"),
        F.concat(F.lit('Marks {"context_relevance": '), (1 + F.col("quality") * 4).cast("string"), F.lit(', "faithfulness": 3, "answer_relevance": '), (1 + F.col("doc_id") % 5).cast("string"), F.lit(', "completeness": 2, "clarity": '), (1 + F.col("toxic") * 4).cast("string"), F.lit("} so")).alias("reply"),
    )
    j = evaluate.judged(literals(spark, REPLIES, "q long, reply string").unionByName(marks))
    return j.select("q", *(F.round(c, 6).alias(c) for c in ("context_relevance", "answer_relevance", "clarity")))


# --- curation -----------------------------------------------------------------------------------------------------------
def _papers(spark, sf):
    """The literal papers, and every document as a paper: its first line is the title, its text the abstract, the rest follows from its numbers."""
    d = table(spark, sf, "documents")
    n, i = F.col("n_chars"), F.col("doc_id")
    venues = F.array(*map(F.lit, K.VENUES))
    made = d.select(
        F.concat(F.lit("d"), i.cast("string")).alias("id"), F.split("text", "\n")[0].alias("title"), F.col("text").alias("abstract"),
        F.slice(F.array("source", "lang", F.lit("X. Xi"), F.lit("Y. Ypsilon")), F.lit(1), (i % 5).cast("int")).alias("authors"),
        F.when(i % 7 != 0, F.concat((2010 + n % 15).cast("string"), F.lit("-01-01"))).otherwise("n.d.").alias("published"), F.when(i % 11 != 0, (2010 + n % 15).cast("int")).alias("year"),
        (n * 7 % 60000).cast("long").alias("citations"), ((n % 200) / 100).alias("quality"), F.concat(F.element_at(venues, (i % 32 % 16 + 1).cast("int")), F.lit(" "), (i % 3).cast("string")).alias("venue"), "source",
    )
    return literals(spark, PAPERS, PAPER_SCHEMA).unionByName(made)


P_SQL = f"""p AS (SELECT id, title, abstract, authors, published, year::INT AS year, citations::BIGINT AS citations, quality::DOUBLE AS quality, venue, source FROM {values(PAPERS, PAPER_NAMES)}
UNION ALL SELECT 'd' || doc_id, string_split(text, chr(10))[1], text, ([source, lang, 'X. Xi', 'Y. Ypsilon'])[1:(doc_id % 5)], CASE WHEN doc_id % 7 <> 0 THEN (2010 + n_chars % 15) || '-01-01' ELSE 'n.d.' END,
  CASE WHEN doc_id % 11 <> 0 THEN (2010 + n_chars % 15)::INT END, (n_chars * 7 % 60000)::BIGINT, (n_chars % 200) / 100.0::DOUBLE, ({K.VENUES!r})[(doc_id % 32 % 16 + 1)] || ' ' || (doc_id % 3), source FROM documents)"""


@query("corpus_filter", f"WITH {P_SQL} SELECT id, md5('Title: ' || title || chr(10) || chr(10) || 'Abstract: ' || abstract) AS content_md5 FROM p WHERE length(title) >= 10 AND length(abstract) >= 50")
def corpus_filter(spark, sf):
    return curate.admit(_papers(spark, sf)).select("id", F.md5(F.concat(F.lit("Title: "), "title", F.lit("\n\nAbstract: "), "abstract").cast("binary")).alias("content_md5"))


@query(
    "quality_score_a",
    f"""WITH {P_SQL} SELECT id, round(least(2, least(coalesce(citations, 0) / 1000::DOUBLE, 1) / (1 + greatest(2024 - coalesce(year, 2020), 1) * 0.1::DOUBLE)
  * CASE WHEN {' OR '.join(f"contains(lower(coalesce(venue, '')), '{v.lower()}')" for v in K.VENUES)} THEN 1.2 ELSE 1 END
  * (1 + CASE WHEN length(abstract) > 500 THEN 0.1 ELSE 0 END + CASE WHEN {' OR '.join(f"contains(lower(title), '{w}')" for w in K.TITLE_WORDS_A)} THEN 0.1 ELSE 0 END)), 6) AS score FROM p""",
)
def quality_score_a(spark, sf):
    p = _papers(spark, sf).withColumn("top_venue", scores.in_venues("venue"))
    return p.select("id", F.round(scores.quality_a("citations", "year", "title", "abstract", "top_venue", 2024), 6).alias("score"))


@query("quality_score_b", f"WITH {P_SQL} SELECT id, round(least(coalesce(citations, 0) / 10000::DOUBLE, 2) + 0.1::DOUBLE * ({' + '.join(f'''contains(lower(title), '{w}')::INT''' for w in K.TITLE_WORDS_B)}) + CASE WHEN length(abstract) > 1000 THEN 0.2 WHEN length(abstract) > 500 THEN 0.1 ELSE 0 END, 6) AS score FROM p")
def quality_score_b(spark, sf):
    return _papers(spark, sf).select("id", F.round(scores.quality_b("citations", "title", "abstract"), 6).alias("score"))


@query("corpus_sort", f"WITH {P_SQL}, s AS (SELECT id, round(coalesce(citations, 0) * 0.6::DOUBLE + coalesce(quality, 0) * 30 + (coalesce(year, 0) - 2015), 6) AS score FROM p) SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS place FROM s")
def corpus_sort(spark, sf):
    s = _papers(spark, sf).select("id", F.round(scores.corpus_score("citations", "quality", "year"), 6).alias("score"))
    return numbered(s, F.desc("score"), "id", name="place")


@query("collected_sort", f"WITH {P_SQL}, s AS (SELECT id, round(coalesce(citations, 0) * 0.7::DOUBLE + coalesce(quality, 0) * 30, 6) AS score FROM p) SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS place FROM s")
def collected_sort(spark, sf):
    s = _papers(spark, sf).select("id", F.round(scores.collected_score("citations", "quality"), 6).alias("score"))
    return numbered(s, F.desc("score"), "id", name="place")


@query("corpus_statistics", f"WITH {P_SQL} SELECT 'year' AS by, year::VARCHAR AS value, count(*) AS n, round(avg(citations), 6) AS avg_citations, round(avg(quality), 6) AS avg_quality FROM p WHERE year IS NOT NULL GROUP BY year UNION ALL SELECT 'venue', venue, count(*), round(avg(citations), 6), round(avg(quality), 6) FROM p WHERE venue IS NOT NULL GROUP BY venue")
def corpus_statistics(spark, sf):
    s = curate.statistics(_papers(spark, sf), ("year", "venue"), "citations", "quality")
    return s.select("by", "value", "n", F.round("avg_citations", 6).alias("avg_citations"), F.round("avg_quality", 6).alias("avg_quality"))


@query("paper_urls", "SELECT doc_id, 'https://arxiv.org/abs/' || doc_id AS url, 'https://arxiv.org/pdf/' || doc_id || '.pdf' AS pdf_url FROM documents")
def paper_urls(spark, sf):
    name = F.concat(F.col("doc_id").cast("string"), F.lit("v"), (F.col("doc_id") % 3 + 1).cast("string"))
    return table(spark, sf, "documents").select("doc_id", *(c.alias(k) for k, c in scores.arxiv_urls(name).items()))


@query("search_filter", f"""WITH {P_SQL}, f AS (SELECT id, min(source) AS keyword FROM p WHERE length(trim(coalesce(abstract, ''))) > 0 AND ({' OR '.join(f"contains(lower(coalesce(venue, '')), '{v.lower()}')" for v in K.VENUES)}) AND id NOT IN (SELECT 'd' || doc_id FROM labels) GROUP BY id) SELECT id, keyword FROM f""")
def search_filter(spark, sf):
    found = _papers(spark, sf).withColumn("keyword", F.col("source"))
    seen = table(spark, sf, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"))
    return remote.wanted(found, seen, venues_only=True).select("id", "keyword")


@query("integration_report", f"WITH {P_SQL} SELECT count(*) AS total, count(*) FILTER (citations > 0) AS cited, round(avg(citations) FILTER (citations > 0), 6) AS avg_citations, max(citations) AS max_citations, count(*) FILTER (citations >= 100) AS highly_cited, round(avg(quality), 6) AS avg_quality FROM p")
def integration_report(spark, sf):
    r = curate.report(_papers(spark, sf), "citations", "quality")
    return r.select("total", "cited", F.round("avg_citations", 6).alias("avg_citations"), "max_citations", "highly_cited", F.round("avg_quality", 6).alias("avg_quality"))


@query("top_years", f"WITH {P_SQL} SELECT year, count(*) AS n FROM p WHERE year IS NOT NULL GROUP BY year ORDER BY n DESC, year DESC LIMIT 5")
def top_years(spark, sf):
    return curate.top_years(_papers(spark, sf))


@query("citation_floor", f"WITH {P_SQL} SELECT id, CASE WHEN coalesce(year, 0) >= 2020 THEN 16 WHEN coalesce(year, 0) >= 2018 THEN 25 ELSE 50 END AS floor, substr(published, 1, 4) AS prefix, try_cast(CASE WHEN regexp_full_match(substr(published, 1, 4), '\\d+') THEN substr(published, 1, 4) END AS INT) AS y FROM p")
def citation_floor(spark, sf):
    return _papers(spark, sf).select("id", scores.citation_floor("year", 50).alias("floor"), F.substring("published", 1, 4).alias("prefix"), scores.year_of("published").alias("y"))


@query("year_source_distribution", "SELECT 'source' AS by, source AS value, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source UNION ALL SELECT 'lang', lang, count(*) FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def year_source_distribution(spark, sf):
    d = table(spark, sf, "documents")
    parts = [curate.distribution(d, c).select(F.lit(c).alias("by"), F.col(c).alias("value"), "n") for c in ("source", "lang")]
    return parts[0].unionByName(parts[1])


NORMAL = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}\p{{M}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))".format


@query("title_normalize", f"SELECT doc_id, {NORMAL('string_split(text, chr(10))[1]')} AS title FROM documents")
def title_normalize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.normal_title(F.split("text", "\n")[0]).alias("title"))


@query("exact_dedup", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def exact_dedup(spark, sf):
    # texts meet by their hash: only ids and hashes are shuffled
    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return d.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query(
    "dedup_theta_anti",
    f"""WITH t AS (SELECT d.doc_id AS id, {NORMAL('string_split(text, chr(10))[1]')} AS nt, l.doc_id IS NOT NULL AS old FROM documents d LEFT JOIN labels l USING (doc_id)),
n AS (SELECT * FROM t WHERE NOT old), o AS (SELECT * FROM t WHERE old)
SELECT id FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.nt = n.nt OR (length(o.nt) > 0 AND length(n.nt) > 0 AND (contains(o.nt, n.nt) OR contains(n.nt, o.nt)) AND least(length(o.nt), length(n.nt))::DOUBLE / greatest(length(o.nt), length(n.nt)) > 0.8))""",
)
def dedup_theta_anti(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.split("text", "\n")[0].alias("title"))
    known = table(spark, sf, "labels").select(F.col("doc_id").alias("id")).distinct()
    return curate.not_duplicates(d.join(known, "id", "left_anti"), d.join(known, "id", "left_semi")).select("id")


@query("seen_filter", "SELECT source AS id, min(doc_id) AS batch, arg_min(lang, doc_id) AS lang FROM documents GROUP BY source")
def seen_filter(spark, sf):
    return curate.first_seen(table(spark, sf, "documents").select(F.col("source").alias("id"), F.col("doc_id").alias("batch"), "lang"))


@query("downloaded_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def downloaded_anti_join(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


# --- text ---------------------------------------------------------------------------------------------------------------
CHUNKS_SQL = "ch AS (SELECT doc_id, unnest(range(0, greatest(ceil((length(text) - 100) / 500.0), 1)::INT)) AS i, text AS t FROM documents WHERE length(text) > 0), sp AS (SELECT doc_id, i AS chunk_index, i * 500 AS start_char, least(i * 500 + 600, length(t)) AS end_char, substr(t, (i * 500 + 1)::BIGINT, 600) AS text FROM ch)"


@query("fixed_chunks_closed_form", f"WITH {CHUNKS_SQL} SELECT doc_id, chunk_index, start_char, end_char, md5(text) AS text_md5 FROM sp")
def fixed_chunks_closed_form(spark, sf):
    return chunk.spans(table(spark, sf, "documents"), 600, 100).select("doc_id", "chunk_index", "start_char", "end_char", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("chunk_stats", f"WITH {CHUNKS_SQL} SELECT count(*) AS chunks, round(avg(length(text)), 6) AS avg_chars, min(length(text)) AS min_chars, max(length(text)) AS max_chars, round(avg(len({WORDS('text')})), 6) AS avg_words, sum(length(text))::BIGINT AS chars, sum(len({WORDS('text')}))::BIGINT AS words, 1 AS sections FROM sp")
def chunk_stats(spark, sf):
    s = chunk.stats(chunk.spans(table(spark, sf, "documents"), 600, 100).withColumn("section", F.lit("content")))
    return s.withColumns({"avg_chars": F.round("avg_chars", 6), "avg_words": F.round("avg_words", 6)})


@query("clean_chunk_text", r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '[^\p{L}\p{N}\p{M}_\s.,!?:;\-()\[\]"''/\\$%#@&*+=<>~`]', ' ', 'g'))) AS text_md5 FROM documents""")
def clean_chunk_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.clean_chunk("text").cast("binary")).alias("text_md5"))


T_SQL = f"tx AS (SELECT doc_id::BIGINT AS doc_id, text FROM {values(TEXTS, 'doc_id, text')} UNION ALL SELECT doc_id + 1000, text FROM documents)"
LINES_SQL = f"{T_SQL}, l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM tx))"
HEADING_SQL = "CASE WHEN length(trim(line)) BETWEEN 3 AND 100 THEN CASE " + " ".join("WHEN " + " OR ".join(f"regexp_matches(trim(line), '(?i){p}')" for p in ps) + f" THEN '{k}'" for k, ps in K.SECTION_LINES.items()) + " END END"
CONFIDENCE_SQL = (
    r"round(least(1, 0.5 + CASE WHEN regexp_matches(h, '^\d+\.?\s*') THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(h, '\p{L}') AND (upper(h) = h OR regexp_matches(h, '^[^\p{L}]*(\p{Lu}\p{Ll}*[^\p{L}]+)*\p{Lu}\p{Ll}*[^\p{L}]*$')) THEN 0.1 ELSE 0 END"
    " + CASE WHEN (section = 'abstract' AND contains(lower(h), 'abstract')) OR (section = 'reference' AND (contains(lower(h), 'reference') OR contains(lower(h), 'bibliography'))) THEN 0.3 ELSE 0 END), 6)::DOUBLE"
)


def _texts(spark, sf):
    return literals(spark, TEXTS, "doc_id long, text string").unionByName(table(spark, sf, "documents").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))


@query("section_split", f"WITH {LINES_SQL}, s AS (SELECT *, CASE " + " ".join(f"WHEN regexp_matches(trim(lower(line)), '^({p})') THEN '{k}'" for k, p in K.SECTION_STARTS) + " END AS section FROM l) SELECT doc_id, line_no::INT AS line_no, section, (sum((section IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY line_no))::BIGINT AS section_no FROM s")
def section_split(spark, sf):
    order = Window.partitionBy("doc_id").orderBy("line_no")
    s = chunk.lines_of(_texts(spark, sf)).withColumn("section", text.section_of("line"))
    return s.select("doc_id", "line_no", "section", F.sum(F.col("section").isNotNull().cast("int")).over(order).alias("section_no"))


@query("heading_sections", f"WITH {LINES_SQL}, s AS (SELECT *, trim(line) AS h, {HEADING_SQL} AS section FROM l) SELECT doc_id, line_no::INT AS line_no, section, lead(line_no::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS next_line, {CONFIDENCE_SQL} AS confidence FROM s WHERE section IS NOT NULL")
def heading_sections(spark, sf):
    lines = chunk.lines_of(_texts(spark, sf)).withColumn("section", text.heading_of("line")).where("section is not null")
    order = Window.partitionBy("doc_id").orderBy("line_no")
    return lines.select("doc_id", "line_no", "section", F.lead("line_no").over(order).alias("next_line"), F.round(text.heading_confidence("line", "section"), 6).alias("confidence"))


CONTENT_SQL = f"""{LINES_SQL}, s AS (SELECT *, trim(line) AS h, {HEADING_SQL} AS section FROM l),
b AS (SELECT *, {CONFIDENCE_SQL} AS confidence, lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS next_line FROM s WHERE section IS NOT NULL),
sc AS (SELECT b.doc_id, b.line_no AS start, b.section, b.h AS title, b.confidence, trim(string_agg(l.line, chr(10) ORDER BY l.line_no)) AS content FROM b JOIN l ON l.doc_id = b.doc_id AND l.line_no > b.line_no AND (b.next_line IS NULL OR l.line_no < b.next_line) GROUP BY ALL)"""


@query("section_contents", f"WITH {CONTENT_SQL} SELECT doc_id, start::INT AS start, section, title, confidence, content FROM sc WHERE regexp_matches(content, '\\S')")
def section_contents(spark, sf):
    s = fulltext.section_contents(chunk.lines_of(_texts(spark, sf)))
    return s.select("doc_id", "start", "section", "title", F.round("confidence", 6).alias("confidence"), "content")


@query("long_sections", f"WITH {CONTENT_SQL} SELECT doc_id, start::INT AS start, length(content)::INT AS length FROM sc WHERE length(trim(content)) > 20")
def long_sections(spark, sf):
    s = fulltext.long_sections(fulltext.section_contents(chunk.lines_of(_texts(spark, sf))), 20)
    return s.select("doc_id", "start", F.length("content").alias("length"))


# --- full texts of papers ------------------------------------------------------------------------------------------------
FILES_SQL = "fl AS (SELECT 'd' || page_id AS id, 'files/d' || page_id || 'v' || (page_id % 3) || '.pdf' AS path FROM pages)"


def _files(spark, sf):
    i = F.col("page_id").cast("string")
    path = F.concat(F.lit("files/d"), i, F.lit("v"), (F.col("page_id") % 3).cast("string"), F.lit(".pdf"))
    return table(spark, sf, "pages").select(path.alias("path")).withColumn("id", F.regexp_extract("path", r"([^/]*)v\d+\.[^./]*$", 1))


@query("papers_files", f"WITH {FILES_SQL} SELECT doc_id, path FROM documents JOIN fl ON fl.id = 'd' || doc_id UNION ALL SELECT doc_id, NULL FROM documents WHERE 'd' || doc_id NOT IN (SELECT id FROM fl)")
def papers_files(spark, sf):
    p = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"))
    files = _files(spark, sf)
    return fulltext.with_files(p, files).select("doc_id", "path").unionByName(fulltext.without_files(p, files).select("doc_id", F.lit(None).cast("string").alias("path")))


PROCESSED_SQL = "pp AS (SELECT conv_id AS id, count(*) AS n, count(*) FILTER (turn % 4 <> 0 AND conv_id % 5 <> 0) AS other, bool_or(role = 'assistant') AS pdf_processed FROM conversations GROUP BY conv_id)"


def _processed(spark, sf):
    """Conversations as papers: each turn is a chunk, every fourth of an abstract; in every fifth conversation all are."""
    section = F.struct(F.when((F.col("turn") % 4 == 0) | (F.col("conv_id") % 5 == 0), "abstract").otherwise("content").alias("section_type"))
    c = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id"))
    return c.agg(F.collect_list(F.struct(F.col("text"), section.alias("metadata"))).alias("processed_chunks"), F.bool_or(F.col("role") == "assistant").alias("pdf_processed"))


@query("unprocessed_papers", f"WITH {PROCESSED_SQL} SELECT id FROM pp WHERE NOT (n > 1 AND other > 0)")
def unprocessed_papers(spark, sf):
    return fulltext.unprocessed(_processed(spark, sf)).select("id")


@query("fulltext_report", f"WITH {PROCESSED_SQL} SELECT count(*) AS processed, round(avg(n), 6) AS avg_chunks FROM pp WHERE n > 1 AND pdf_processed")
def fulltext_report(spark, sf):
    return fulltext.report(_processed(spark, sf)).select("processed", F.round("avg_chunks", 6).alias("avg_chunks"))


@query("system_status", "SELECT (SELECT count(*) FROM documents) AS papers, count(*) AS chunks, count(DISTINCT conv_id) AS with_chunks, round(count(*)::DOUBLE / greatest((SELECT count(*) FROM documents), 1), 6) AS chunks_per_paper FROM conversations")
def system_status(spark, sf):
    s = fulltext.status(table(spark, sf, "documents"), table(spark, sf, "conversations"), "conv_id")
    return s.withColumn("chunks_per_paper", F.round("chunks_per_paper", 6))


@query("chunk_enrichment", "SELECT doc_id, contains(lower(text), 'references') AS has_citations, false AS has_code, '2.0' AS processing_version FROM documents")
def chunk_enrichment(spark, sf):
    return fulltext.enriched(table(spark, sf, "documents")).select("doc_id", "has_citations", "has_code", "processing_version")


_FEATURES = {"has_formulas": K.HAS_FORMULAS, "has_code": K.HAS_CODE, "has_citations": K.HAS_CITATIONS, "has_numbers": K.HAS_NUMBERS, "has_urls": K.HAS_URLS}


@query("content_features", f"WITH {T_SQL} SELECT doc_id, " + ", ".join(f"regexp_matches(text, '{'(?i)' * (k in ('has_formulas', 'has_code'))}{p}') AS {k}" for k, p in _FEATURES.items()) + r", len(list_filter(string_split(text, chr(10) || chr(10)), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g')) <> '')) AS paragraph_count, len(regexp_extract_all(text, '[.!?]+')) AS sentence_count FROM tx")
def content_features(spark, sf):
    return _texts(spark, sf).select("doc_id", *(v.alias(k) for k, v in text.content_features("text").items()))


@query("document_detectors", f"WITH {T_SQL} SELECT doc_id, {' OR '.join(f'''regexp_matches(text, '{p}')''' for p in K.FORMULA_MARKS)} AS formulas, {' OR '.join(f'''regexp_matches(text, '(?i){p}')''' for p in K.TABLE_MARKS)} AS tables, {' OR '.join(f'''regexp_matches(text, '(?i){p}')''' for p in K.FIGURE_MARKS)} AS figures FROM tx")
def document_detectors(spark, sf):
    return _texts(spark, sf).select("doc_id", text.has_formulas("text").alias("formulas"), text.has_tables("text").alias("tables"), text.has_figures("text").alias("figures"))


@query("language_detect", f"WITH {T_SQL} SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[一-鿿]')) > len(list_filter(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Za-z]+'))) * 0.5 THEN 'zh' ELSE 'en' END AS language FROM tx")
def language_detect(spark, sf):
    return _texts(spark, sf).select("doc_id", text.language("text").alias("language"))


@query("title_abstract", f"WITH {T_SQL} SELECT doc_id, coalesce(list_filter(list_transform(string_split(text, chr(10))[1:20], lambda x: trim(x)), lambda x: length(x) > 10 AND length(x) < 200 AND NOT ({' OR '.join(f'''contains(lower(x), '{w}')''' for w in K.NOT_TITLES)}))[1], 'Unknown Title') AS title, substr(trim(regexp_replace(regexp_extract(text, '(?is)abstract\\s*[:\\-]?\\s*\\n(.*?)\\n\\s*(?:1\\.?\\s*introduction|keywords|key\\s*words|\\n\\s*\\n)', 1), '\\s+', ' ', 'g')), 1, 2000) AS abstract FROM tx")
def title_abstract(spark, sf):
    return _texts(spark, sf).select("doc_id", text.title_of("text").alias("title"), text.abstract_of("text").alias("abstract"))


@query("page_title_paragraphs", "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages")
def page_title_paragraphs(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<p>")).alias("paragraphs"))


@query("store_statistics", f"SELECT coalesce(nullif(lang, 'en'), 'unknown') AS section, count(*) AS total, count(DISTINCT source) AS papers, " + ", ".join(f"count(*) FILTER (regexp_matches(text, '{'(?i)' * (k != 'has_citations')}{_FEATURES[k]}')) AS {k}" for k in ("has_formulas", "has_code", "has_citations")) + " FROM documents GROUP BY 1")
def store_statistics(spark, sf):
    flags = text.content_features("text")
    rows = table(spark, sf, "documents").select(F.nullif(F.col("lang"), F.lit("en")).alias("section"), F.col("source").alias("paper_id"), *(flags[k].alias(k) for k in ("has_formulas", "has_code", "has_citations")))
    return store.statistics(rows)


@query("embedding_cache", "WITH k AS (SELECT DISTINCT md5('hash64:' || text) AS key FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) SELECT d.doc_id, md5('hash64:' || text) AS key, k.key IS NOT NULL AS hit, CASE WHEN k.key IS NOT NULL THEN -1 ELSE length(text) END::DOUBLE AS first FROM documents d LEFT JOIN k ON k.key = md5('hash64:' || text)")
def embedding_cache(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    known = d.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    cache = known.select(store.cache_key("hash64", F.col("text")).alias("key")).distinct().withColumn("embedding", F.array(F.lit(-1.0)))
    return store.cached(d, cache, "hash64", lambda t: F.array(F.length(t).cast("double"))).select("doc_id", "key", "hit", F.col("embedding")[0].alias("first"))


# --- claims and citations -------------------------------------------------------------------------------------------------
_CLAIMS = "list_concat(list_concat({0}, {1}), {2})".format(*(f"regexp_extract_all(answer, '{p}', 0)" for p in K.CLAIMS))
CLAIM_SQL = f"""an AS (SELECT q::BIGINT AS q, answer FROM {values([(-1, ANSWER)], 'q, answer')} UNION ALL SELECT conv_id, string_agg(text, ' ' ORDER BY turn) FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
al AS (SELECT q, list_filter(list_transform({_CLAIMS}, lambda x: trim(x)), lambda x: length(x) > 20) AS l FROM an),
cl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY pos) AS n FROM (SELECT q, list_position(l, claim) AS pos, claim FROM (SELECT q, l, unnest(list_distinct(l)) AS claim FROM al))) WHERE n <= 10),
src AS (SELECT -1::BIGINT AS q, content FROM {values(SOURCES, 'author, paper, content, score, section, rank')} UNION ALL SELECT conv_id, text FROM conversations)"""


@query(
    "claim_support",
    f"""WITH {CLAIM_SQL}, pr AS (SELECT q, claim, {OVERLAP(a=WORDSET('claim'), b=WORDSET('content'))} AS rel,
  sign(({' + '.join(f"contains(lower(content), '{w}')::INT" for w in K.SUPPORT)}) - ({' + '.join(f"contains(lower(content), '{w}')::INT" for w in K.CONTRADICT)})) AS side FROM cl JOIN src USING (q)),
g AS (SELECT q, claim, count(*) FILTER (rel > 0.3 AND side > 0) AS supporting, count(*) FILTER (rel > 0.3 AND side < 0) AS contradicting, avg(rel) FILTER (rel > 0.3) AS r FROM pr GROUP BY q, claim),
h AS (SELECT *, CASE WHEN supporting + contradicting > 0 THEN supporting::DOUBLE / (supporting + contradicting) * r ELSE 0 END AS confidence FROM g)
SELECT q, claim, supporting, contradicting, round(confidence, 6) AS confidence, CASE WHEN supporting + contradicting = 0 THEN 'insufficient_data' WHEN confidence >= 0.8 THEN 'strong' WHEN confidence >= 0.6 THEN 'moderate' WHEN confidence >= 0.4 THEN 'weak' WHEN contradicting > 0 THEN 'contradicted' ELSE 'weak' END AS level FROM h""",
)
def claim_support(spark, sf):
    """The replies of a conversation as one answer, all its turns as sources."""
    c = table(spark, sf, "conversations")
    said = c.where("role = 'assistant'").groupBy(F.col("conv_id").alias("q")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    said = said.select("q", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("answer"))
    stated = verify.claims(literals(spark, [(-1, ANSWER)], "q long, answer string").unionByName(said))
    src = literals(spark, SOURCES, "author string, doc string, content string, score double, section string, rank int").select(F.lit(-1).cast("long").alias("q"), "doc", "content")
    src = src.unionByName(c.select(F.col("conv_id").alias("q"), F.col("turn").cast("string").alias("doc"), F.col("text").alias("content")))
    return verify.support(stated, src).select("q", "claim", "supporting", "contradicting", F.round("confidence", 6).alias("confidence"), "level")


@query("answer_assembly", f"""WITH {CONTEXT_SQL}, a AS (SELECT q, max(question) AS question FROM pl GROUP BY q),
t AS (SELECT q, '[' || row_number() OVER (PARTITION BY q ORDER BY place) || '] ' || title AS line, place FROM pl)
SELECT a.q, question || chr(10) || chr(10) || 'Sources:' || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY place) FROM t WHERE t.q = a.q AND starts_with(line, '[') AND substr(line, 2, 1)::INT <= 3) AS answer, (SELECT least(3, count(*)) FROM t WHERE t.q = a.q)::INT AS n_citations FROM a""")
def answer_assembly(spark, sf):
    c = _contexts(spark, sf)
    return prompt.assembled(c.groupBy("q").agg(F.max("question").alias("answer")), c.select("q", "place", F.col("title").alias("citation")))


@query("template_info", "SELECT query_type, length(system)::INT AS system_length, length(layout)::INT AS layout_length, array_to_string(regexp_extract_all(layout, '\\{(\\w+)\\}', 1), ',') AS fields FROM " + values([*prompt.TEMPLATES, *(("cited " + t[0], *t[1:]) for t in prompt.CITED)], "query_type, system, layout"))
def template_info(spark, sf):
    both = prompt.templates(spark, [("cited " + t[0], *t[1:]) for t in prompt.CITED])
    return prompt.template_info(both).withColumn("fields", F.array_join("fields", ","))


_CITED_LAYOUT = " ".join(f"WHEN '{t}' THEN '{l}'" for t, _, l in prompt.CITED)


@query(
    "cited_prompts",
    f"""WITH {CONTEXT_SQL}, {ENTRY_SQL}, p AS (SELECT q, question, {', '.join(f'{_points(i)} AS p_{i}' for i in K.INTENTS)}, string_agg(entry, chr(10) ORDER BY place) AS context, count(*) AS n FROM en GROUP BY q, question),
b AS (SELECT *, greatest({', '.join(f'p_{i}' for i in K.INTENTS)}) AS best FROM p), i AS (SELECT *, CASE {_INTENT_CASE} ELSE 'general' END AS intent FROM b)
SELECT q, intent AS query_type, n AS n_contexts, md5(replace(replace(CASE intent {_CITED_LAYOUT} END, '{{query}}', question), '{{context}}', context)) AS prompt_md5 FROM i""",
)
def cited_prompts(spark, sf):
    p = prompt.cited_prompts(_entries(spark, sf), spark)
    return p.select("q", "query_type", F.col("n_contexts").cast("long").alias("n_contexts"), F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


@query(
    "citations_apa_ieee",
    f"""WITH {P_SQL}, y AS (SELECT *, coalesce(nullif(regexp_extract(coalesce(published, ''), '\\d{{4}}'), ''), '2024') AS yr, len(authors) AS n FROM p)
SELECT id AS paper_id, CASE WHEN n = 1 THEN authors[1] WHEN n = 2 THEN authors[1] || ' & ' || authors[2] WHEN n > 2 THEN authors[1] || ' et al.' ELSE 'Unknown Author' END || ' (' || yr || '). ' || title || '. Retrieved from arXiv:' || id AS apa,
  CASE WHEN n > 3 THEN authors[1] || ' et al.' WHEN n > 0 THEN array_to_string(authors, ', ') ELSE 'Unknown Author' END || ', "' || title || '," arXiv preprint arXiv:' || id || ', ' || yr || '.' AS ieee,
  row_number() OVER (ORDER BY coalesce(authors[1], 'Unknown'), id) AS number FROM y""",
)
def citations_apa_ieee(spark, sf):
    p = _papers(spark, sf).select(F.col("id").alias("paper_id"), "title", "authors", "published", F.lit(1).alias("rank"))
    a, i = verify.citations(p), verify.citations(p, "IEEE")
    return a.select("paper_id", F.col("citation").alias("apa"), "number").join(i.select("paper_id", F.col("citation").alias("ieee")), "paper_id")


# --- without SQL: greedy state ----------------------------------------------------------------------------------------------
def _listed(spark, sf, k=10):
    """Fused lists with their texts: (q, doc, content, combined, rank)."""
    fused = ranking.fuse(*_dense_sparse(spark, sf, k), "full")
    return fused.join(table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("content")), "doc")


@query("mmr_topk")
def mmr_topk(spark, sf):
    return ranking.mmr(_listed(spark, sf)).select("q", "doc", "rank")


@query("jaccard_diversity")
def jaccard_diversity(spark, sf):
    return ranking.diverse(_listed(spark, sf)).select("q", "doc", "rank")


@query("sentence_chunks")
def sentence_chunks(spark, sf):
    return chunk.finish(chunk.chunk(table(spark, sf, "documents"), chunk.ChunkConfig("fixed_size", 600, 100, 150, 1200))).drop("text")


@query("semantic_chunks")
def semantic_chunks(spark, sf):
    docs = literals(spark, TEXTS, "doc_id long, text string").unionByName(table(spark, sf, "documents").select("doc_id", "text"))
    return chunk.chunk(docs, chunk.ChunkConfig("semantic", 300, 30)).drop("text")


@query("hybrid_chunks")
def hybrid_chunks(spark, sf):
    return chunk.chunk(table(spark, sf, "documents"), chunk.ChunkConfig("hybrid", 250, 40, 100, 1000)).drop("text")


@query("hash_embed", f"SELECT doc_id, 64 AS size, CASE WHEN list_sum(h) > 0 THEN 1 ELSE 0 END::DOUBLE AS norm, CASE WHEN list_sum(h) > 0 THEN round(list_sum(list_transform(h, lambda x, i: x * i)) / sqrt(list_sum(list_transform(h, lambda x: x * x))), 6) ELSE 0 END AS weighed FROM (SELECT doc_id, {hashed_sql('text')} AS h FROM documents)")
def hash_embed(spark, sf):
    v = table(spark, sf, "documents").select("doc_id", vectors.hashed(F.col("text")).alias("v"))
    weighed = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return v.select("doc_id", F.size("v").alias("size"), F.round(scores.norm("v"), 6).alias("norm"), F.round(weighed, 6).alias("weighed"))
