import zlib
from collections import defaultdict

import numpy as np
import pytest
from ashlar.llm import mixing, sharding
from pyspark.sql import functions as F


def test_pack_balances_all_dimensions():
    items = np.random.default_rng(0).pareto(2.0, (2000, 3)) + 0.1
    place = sharding.pack(items, 8)
    for d in range(3):
        load = np.bincount(place, items[:, d], minlength=8)
        assert load.max() / load.mean() < 1.05


def test_shards(spark):
    texts = [f"text {i} " * (1 + i % 9) for i in range(400)] + ["copy"] * 30 + ["hot " * 50] * 500 + [None, ""]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, shard string")
    rows = sharding.shard(df, 4).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    slots, sizes, groups = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in rows:
        t = texts[r["doc_id"]] or ""
        assert r["size"] == len(t.encode()) + 16 and r["text_crc32"] == zlib.crc32(t.encode())
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        groups[t].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) < 1.1 * sum(sizes.values()) / 4
    assert len(groups["copy"]) == 1 and len(groups["hot " * 50]) > 1
    assert sharding.shard(df.limit(0), 4).count() == 0


def test_bytes_are_level_under_hot_groups_of_any_kind(spark):
    rng = np.random.default_rng(1)
    cases = {
        "many empty": [f"{i:04d} " * 400 for i in range(1000)] + [""] * 3000,
        "one hot": [f"{i} " * int(rng.integers(5, 60)) for i in range(1500)] + ["x y " * 30] * 800,
        "middle groups": [f"{i // 12:03d} " * 200 for i in range(1200)] + [None] * 500,
        "token heavy": ["a " * 500] * 200 + [f"{'b' * 900}{i}" for i in range(600)],
    }
    for name, texts in cases.items():
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = sharding.shard(df, 4).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
        size = np.array([r["b"] for r in got])
        assert len(got) == 4 and size.max() - size.min() < 0.05 * size.mean(), (name, size)


def test_repeated_ids_and_null_ids(spark):
    rows = [(None, "same text")] * 300 + [(7, "same text")] * 300 + [(i, f"text {i}") for i in range(100)]
    got = sharding.shard(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, item int, part int"), 3).collect()
    assert len(got) == 700 and all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got))) for s in range(3))
    assert max(sum(r["shard"] == s for r in got) for s in range(3)) < 260


def packed_plainly(items, shards):
    """The same rule, one comparison at a time."""
    total = [max(sum(x[d] for x in items), 1) for d in range(len(items[0]))]
    load = [[x[d] / total[d] * shards for d in range(len(x))] for x in items]
    left, place = [[1.0] * len(total) for _ in range(shards)], {}
    for i in sorted(range(len(items)), key=lambda i: (-max(load[i]), i)):
        over = [max(max(a - b, 0) for a, b in zip(load[i], s, strict=True)) for s in left]
        fits = [s for s in range(shards) if over[s] <= min(over) + 1e-12]
        place[i] = max(fits, key=lambda s: (sum(a * b for a, b in zip(load[i], left[s], strict=True)), -s))
        left[place[i]] = [a - b for a, b in zip(left[place[i]], load[i], strict=True)]
    return [place[i] for i in range(len(items))]


def test_packing_by_brute_force():
    for seed in range(5):
        items = np.random.default_rng(seed).integers(1, 1000, (60, 3)).astype(float)
        assert sharding.pack(items, 7).tolist() == packed_plainly(items.tolist(), 7)


def test_mixing_meets_its_targets(spark):
    rows = [(i, "w " * 50, "en" if i % 10 else "fr", "a" if i % 3 else "b", "clash") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens string")
    mix = mixing.Mix(source={"a": 0.5, "b": 0.5}, lang={"en": 0.8, "fr": 0.2}, topic={"short": 1.0}, budget=0.3, rounds=30)
    cells = mixing.rake(df, mix).toPandas()
    kept = cells["tokens"] * cells["p"]
    assert kept.sum() / cells["tokens"].sum() == pytest.approx(0.3, abs=1e-9)
    assert kept[cells["_source"] == "b"].sum() / kept.sum() == pytest.approx(0.5, abs=1e-6)
    assert kept[cells["_lang"] == "fr"].sum() / kept.sum() == pytest.approx(0.2, abs=1e-6)
    out = mixing.mix_sources(df, mix)
    assert out.count() == pytest.approx(1800, rel=0.1)
    ids = {r[0] for r in out.select("doc_id").collect()}
    more = {r[0] for r in mixing.mix_sources(df, mixing.Mix(source=mix.source, lang=mix.lang, topic=mix.topic, budget=0.4, rounds=30)).select("doc_id").collect()}
    assert ids <= more


def test_default_targets_are_met_by_the_largest_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cells = mixing.rake(docs)
    for r in mixing.shares(cells).collect():
        assert r["got"] == pytest.approx(r["target"] / 1.0, abs=2e-3), r
    p = cells.toPandas()["p"]
    assert p.max() == pytest.approx(1.0) and p.min() >= 0
    kept = mixing.mix_sources(docs)
    n = kept.groupBy("_source").agg(F.sum("_tokens").alias("t")).toPandas().set_index("_source")["t"]
    assert (n / n.sum()).max() < 0.09  # expected: 0.05; documents are few and of all lengths


def test_rare_and_unknown_values_do_not_shrink_the_sample(spark):
    rows = [(i, "w " * 20, "en" if i else "es", "src0" if i % 2 else "src1") for i in range(2000)] + [(3000, "w " * 20, None, "new")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mix = mixing.Mix(source={"src0": 0.5, "src1": 0.5}, lang={"en": 0.5, "es": 0.5}, topic={"short": 1.0})
    cells = mixing.rake(df, mix).toPandas()
    assert (cells["tokens"] * cells["p"]).sum() > 0.4 * cells["tokens"].sum()
    assert (cells["p"] > 0.4).all()  # the one Spanish text doubles its share, the unknown ones keep theirs
    none = df.selectExpr("doc_id", "text", "cast(null as string) as lang", "cast(null as string) as source")
    assert mixing.mix_sources(none).count() > 0


def test_own_topics_and_clashing_columns(spark):
    df = spark.createDataFrame([(i, "w " * 9, "en", "a", "sport" if i % 2 else "news", i) for i in range(400)], "doc_id long, text string, lang string, source string, _topic string, _p int")
    mix = mixing.Mix(source={"a": 1.0}, lang={"en": 1.0}, topic={"sport": 0.2, "news": 0.8})
    got = {r["value"]: r["got"] for r in mixing.shares(mixing.rake(df, mix, F.col("_topic")), mix).where("dimension = 'topic'").collect()}
    assert got == pytest.approx({"sport": 0.2, "news": 0.8})
    out = mixing.mix_sources(df, mix, by=F.col("_topic"))
    assert out.columns.count("_p") == 1 and out.where("_topic = 'news' AND _p < 1").count() == 0


def test_mixing_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, None), (None, "", "xx", "new"), (2, "a b", "en", "src0"), (2, "a b", "en", "src0")], "doc_id long, text string, lang string, source string")
    out = mixing.mix_sources(df, mixing.Mix(source={}, lang={}, topic={}, budget=1.0))
    assert out.count() == 4 and out.where(F.col("_source") != "other").count() == 0
    assert mixing.mix_sources(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="source"):
        mixing.Mix(source={"a": 2.0}, lang={}, topic={}).shares("source")
