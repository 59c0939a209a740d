import json

import pytest
from ashlar.operators.vectors import hashed
from ashlar.sources import files, store
from ashlar.streaming import ingest


def test_papers_in_both_layouts(spark, tmp_path):
    rows = [{"id": "1", "title": "A", "authors": ["x"]}, {"id": "2", "title": "B", "year": 2020}]
    (tmp_path / "bare.json").write_text(json.dumps(rows))
    (tmp_path / "wrapped.json").write_text(json.dumps({"papers": rows, "statistics": {}}))
    for name in ("bare", "wrapped"):
        got = files.papers(spark, str(tmp_path / f"{name}.json")).orderBy("id").collect()
        assert [r["title"] for r in got] == ["A", "B"] and got[1]["year"] == 2020
    assert files.optional_papers(spark, str(tmp_path / "none.json")).count() == 0


def test_cases_fail_fast(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"id": 1, "contexts": 5}, {"id": ')
    with pytest.raises(Exception):  # noqa: B017
        files.cases(spark, str(tmp_path / "c.json")).collect()
    got = files.custom_cases(spark.createDataFrame([("why?", ["a"])], "question string, contexts array<string>")).first()
    assert got["id"] == "custom_0" and got["relevant_contexts"] == ["a"] and got["difficulty"] == "medium"


def test_atom(spark):
    xml = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>A\n B</title><summary>s</summary><author><name>X</name></author><published>2020-01-02T00:00:00Z</published><category term='cs'/></entry></feed>"
    got = files.atom_entry(spark.createDataFrame([(xml,), ("<feed/>",)], "xml string")).collect()
    assert len(got) == 1 and got[0]["title"] == "A B" and got[0]["authors"] == ["X"] and got[0]["published"] == "2020-01-02" and got[0]["categories"] == ["cs"]


def test_collection(spark, tmp_path):
    c = store.Collection(spark, str(tmp_path / "store"))
    assert c.read().count() == 0
    embed = lambda t: hashed(t, 8)
    c.add(spark.createDataFrame([("1", "a b", "method"), ("2", "c", None)], "id string, document string, section string"), embed)
    c.add(spark.createDataFrame([("2", "d e", "result"), ("2", "d e", "result")], "id string, document string, section string"), embed)
    got = {r["id"]: r for r in c.read().collect()}
    assert got.keys() == {"1", "2"} and got["2"]["document"] == "d e" and len(got["1"]["embedding"]) == 8
    assert {r["section"]: r["total"] for r in c.statistics().collect()} == {"method": 1, "result": 1}
    c.clear()
    assert c.read().count() == 0


def test_cache(spark):
    from pyspark.sql import functions as F

    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "i int, text string")
    cache = spark.createDataFrame([("a",)], "t string").select(store.cache_key("m", F.col("t")).alias("key"), F.array(F.lit(9.0)).alias("embedding"))
    got = {r["i"]: (r["embedding"], r["hit"]) for r in store.cached(texts, cache, "m", lambda t: F.array(F.length(t).cast("double"))).collect()}
    assert got == {1: ([9.0], True), 2: ([1.0], False), 3: ([9.0], True)}


def test_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.sql("select id, timestamp'2020-01-01' as ts from values ('a'), ('a'), ('b') as t(id)").write.parquet(src)
    q = ingest.into(ingest.unseen(ingest.arriving(spark, src, "id string, ts timestamp")), out, str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_remote_reader_and_replies(spark):
    from ashlar.operators import generate
    from ashlar.sources import remote

    r = remote.PaperReader({"keywords": "a;b", "url": "http://x"}, lambda url: {"data": [{"paperId": url[-1], "year": 2020}]} if "query=a" in url else {})
    assert [len(list(r.read(p))) for p in r.partitions()] == [1, 0]
    spark.dataSource.register(remote.PaperSearch)
    assert spark.read.format("papers").load().count() == 0

    def ask(prompt):
        if "bad" in prompt:
            raise ValueError("no")
        return prompt.upper()

    got = {x["q"]: x for x in generate.replies(spark.createDataFrame([(1, "hi"), (2, "bad")], "q int, prompt string"), ask, "m").collect()}
    assert got[1]["text"] == "HI" and got[2]["error"].startswith("ValueError") and not got[2]["success"]


def test_question_plan(spark):
    from ashlar.operators import bm25
    from ashlar.operators.vectors import RetrievalConfig
    from ashlar.plans import question
    from pyspark.sql import functions as F

    rows = [(i, f"The method shows that topic{i % 3} is a good idea for networks. It works well on all of the data sets.", f"T{i}", ["A"], "2020", "abstract", False, False, True) for i in range(8)]
    chunks = spark.createDataFrame(rows, "doc long, content string, title string, authors array<string>, published string, section string, has_formulas boolean, has_code boolean, has_citations boolean")
    embed = lambda t: hashed(t, 16)
    chunks = chunks.withColumn("embedding", embed(F.col("content")))
    asked = spark.createDataFrame([(1, "what is the method"), (2, "zzz")], "q int, question string")
    got = question.answer(asked, chunks, bm25.build(chunks, "doc", "content"), embed, RetrievalConfig(top_k=3))
    assert got["answers"].where("q = 1").count() == 1
    assert got["contexts"].where("q = 1").count() <= 5
    assert question.replied(got["entries"], None, got["answers"]).first()["by"] == "rules"
    assert got["quality"].where("q = 1").count() == 1


def test_embedding_hooks(spark, tmp_path):
    from ashlar.operators import embed

    assert embed.differences(embed.EmbeddingConfig()) == []
    assert embed.differences(embed.EmbeddingConfig(model_name="x", batch_size=1)) == ["model_name"]
    texts = spark.createDataFrame([(1, "ab"), (2, None)], "i int, text string")
    made = embed.encoded(texts, lambda: lambda ts: [[3.0 * len(t), 4.0] for t in ts])
    assert {r["i"]: [round(x, 2) for x in r["embedding"]] for r in made.collect()} == {1: [0.83, 0.55], 2: [0.0, 1.0]}
    with pytest.raises(ValueError, match="kind"):
        embed.manager("nope")
    ok = lambda t: t.withColumn("embedding", embed.manager("hybrid", 4)(t["text"]))
    bad = lambda t: t.select("missing")
    got = {r["model"]: r for r in embed.benchmark(texts, {"ok": ok, "bad": bad}).collect()}
    assert got["ok"]["n"] >= 1 and got["bad"]["error"]
    (tmp_path / "c.json").write_text('[{"arxiv_id": "1", "title": "T", "estimated_citations": 5, "category": "c"}]')
    assert files.classic_list(spark, str(tmp_path / "c.json")).first()["pdf_url"] == "https://arxiv.org/pdf/1.pdf"


def test_required_keys(spark, tmp_path):
    files.write_cases(files.sample_cases(spark), str(tmp_path / "good"))
    assert files.cases(spark, str(tmp_path / "good")).count() == 2
    (tmp_path / "short.json").write_text(json.dumps([{"id": "1", "question": "why?"}]))
    with pytest.raises(Exception, match="without contexts"):
        files.cases(spark, str(tmp_path / "short.json")).collect()
    (tmp_path / "bare.json").write_text(json.dumps([{"id": "1"}]))
    with pytest.raises(Exception, match="no papers"):
        files.wrapped_papers(spark, str(tmp_path / "bare.json")).collect()


def test_lookups_and_search_filters(spark):
    from ashlar.sources import remote

    asked = []

    def get(url):
        asked.append(url)
        if "query=" in url:
            return {"data": [{"paperId": "1", "citationCount": 60}, {"paperId": "2", "citationCount": 3}, {"citationCount": 99}]}
        return {"paperId": url[-1], "title": "t"} if url.endswith("7") else {}

    search = remote.PaperReader({"keywords": "a b", "url": "u", "least": "50"}, get)
    assert [r[1] for p in search.partitions() for r in search.read(p)] == ["1"]
    single = remote.PaperReader({"ids": "7;8", "url": "u"}, get)
    assert [r[1] for p in single.partitions() for r in single.read(p)] == ["7"] and asked[-1] == "u/8"
    found = spark.createDataFrame([("k1", "1", "x", "ICML 2020"), ("k2", "1", "x", "ICML 2020"), ("k1", "2", " ", "ICML"), ("k1", "3", "y", "none"), ("k1", "4", "z", "Nature")], "keyword string, id string, abstract string, venue string")
    seen = spark.createDataFrame([("4",)], "id string")
    assert sorted(r["id"] for r in remote.wanted(found, seen).collect()) == ["1", "3"]
    assert [(r["id"], r["keyword"]) for r in remote.wanted(found, seen, venues_only=True).collect()] == [("1", "k1")]
    docs = remote.atom_documents(spark.createDataFrame([("5",)], "id string"), lambda url: f"<feed>{url}</feed>", "b").first()
    assert docs["xml"] == "<feed>b?id_list=5</feed>"


def test_evaluation_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "n int, s string")
    paths = files.write_evaluation({"cases": df, "summary": df}, str(tmp_path), "1")
    assert [spark.read.json(p).count() for p in paths] == [1, 1]
    files.write_papers(df, df, str(tmp_path / "corpus"), "2")
    assert spark.read.json(str(tmp_path / "corpus/statistics/version=2")).count() == 1
    state = store.Collection(spark, str(tmp_path / "none")).state({"model": "m"}).first()
    assert state["count"] == 0 and state["error"] is None
