import math

import pytest
from ashlar.functions import scores, text
from pyspark.sql import functions as F


def one(spark, schema, row, *cols):
    return spark.createDataFrame([row], schema).select(*cols).first()


def test_tokenizer_drops_words_with_other_letters(spark):
    assert one(spark, "t string", ("étude bert3 self-attention naïve abc_d x",), text.letters_tokens("t"))[0] == ["self", "attention", "x"]


@pytest.mark.parametrize(
    ("q", "intent", "confidence"),
    [("what is transformer attention mechanism", "definition", 0.5), ("compare CNN and RNN for image processing", "comparison", 1 / 3), ("latest developments in generative models", "recent_work", 0.5), ("hello", "general", 1.0), ("", "general", 1.0)],
)
def test_intent(spark, q, intent, confidence):
    got = one(spark, "q string", (q,), scores.intent("q").alias("i"))["i"]
    assert got["intent"] == intent and got["confidence"] == pytest.approx(confidence)


def test_expansion_and_keywords(spark):
    q = "what is transformer attention mechanism"
    got = one(spark, "q string", (q,), scores.expanded("q"), text.keywords("q"))
    assert got[0] == q + " attention mechanism self-attention multi-head attention"
    assert got[1] == ["what", "transformer", "attention", "mechanism"]
    assert one(spark, "q string", ("zzz",), scores.expanded("q"))[0] == "zzz"


def test_quality_scores(spark):
    row = one(spark, "c int, y int, t string, a string, v boolean", (500, 2020, "Deep nets", "x" * 501, True), scores.quality_a("c", "y", "t", "a", "v", 2024))
    assert row[0] == pytest.approx(0.514286, abs=1e-6)
    row = one(spark, "c int, t string, a string", (50000, "On attention", "x" * 1001), scores.quality_b("c", "t", "a"))
    assert row[0] == pytest.approx(2.3)
    row = one(spark, "c int, q double, y int", (100, 1.5, 2019), scores.corpus_score("c", "q", "y"))
    assert row[0] == pytest.approx(109.0)
    assert one(spark, "c int, y int, t string, a string, v boolean", (None, None, None, None, None), scores.quality_a("c", "y", "t", "a", "v", 2024))[0] == 0


def test_overall_and_rerank(spark):
    assert one(spark, "a double", (0.6,), scores.overall("a", F.lit(0.8), F.lit(0.5), F.lit(0.5), F.lit(1.0)))[0] == pytest.approx(0.64)
    row = one(spark, "q string", ("",), scores.overlap("q", F.lit("a b")))
    assert row[0] == 0


def test_citations(spark):
    a = "array<string>"
    get = lambda names: one(spark, f"n {a}", (names,), scores.apa("n", F.lit("2020"), F.lit("T"), F.lit("1")), scores.ieee("n", F.lit("2020"), F.lit("T"), F.lit("1")))
    assert get(["A", "B"])[0] == "A & B (2020). T. Retrieved from arXiv:1"
    assert get(["A", "B", "C", "D"])[1] == 'A et al., "T," arXiv preprint arXiv:1, 2020.'
    assert get([])[0].startswith("Unknown Author")
    assert one(spark, "d string", ("n.d.",), scores.cited_year("d"))[0] == "2024"


def test_cleaning(spark):
    row = one(spark, "t string", ("  a\n\tb§c  ",), text.clean_chunk("t"), text.clean_prompt("t"), text.clean_page("t"))
    assert row[0] == "a b c" and row[1] == "a bc" and row[2] == "a b§c"
    assert one(spark, "t string", ("x" * 900,), text.clean_prompt("t"))[0] == "x" * 800 + "..."
    assert one(spark, "t string", ("Attention Is All -- You Need!",), text.normal_title("t"))[0] == "attention is all you need"


def test_similarity(spark):
    row = one(spark, "d double", (1.5,), *(scores.similarity("d", m) for m in ("cosine", "euclidean", "dot", "other")))
    assert row[0] == 0 and row[1] == pytest.approx(0.4) and row[2] == 1.5 and row[3] == 0
    assert math.isclose(one(spark, "v array<float>", ([3.0, 4.0],), scores.norm("v"))[0], 5.0)
