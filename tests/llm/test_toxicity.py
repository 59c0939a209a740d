import itertools
import random

import numpy as np
import pyarrow as pa
from ashlar.llm import toxicity as t

SMALL = t.Config(epochs=40)


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    chain, counts = rng.standard_normal((2, 2)), np.array([4, 0, 1, 5])
    e = rng.standard_normal(counts.sum())
    got = t.marginals(e, counts, chain)
    at = 0
    for n in counts:
        part = e[at : at + n]
        total, mass = 0.0, np.zeros(n)
        for tags in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(part[i] * x for i, x in enumerate(tags)) + sum(chain[a, b] for a, b in itertools.pairwise(tags)))
            total += w
            mass += w * np.array(tags)
        assert np.allclose(got[at : at + n], mass / total)
        at += n


def made(n, seed):
    rng = random.Random(seed)
    words = ["the", "river", "runs", "to", "a", "sea", "and", "hill", "over", "stone"]
    bad = ["idiot", "moron", "scum", "loser"]
    texts, labels = [], []
    for i in range(n):
        w = rng.choices(words, k=rng.randint(5, 60))
        k = 0 if i % 3 else rng.randint(3, 6)
        for _ in range(k if i % 3 == 0 else (i % 5 == 0)):  # one such word alone is no offence
            w[rng.randrange(len(w))] = rng.choice(bad) + rng.choice([",", ".", ""])
        texts.append(" ".join(w))
        labels.append(int(i % 3 == 0 and sum(x.strip(",.") in bad for x in w) > 1))
    return texts, labels


def test_learns_documents_and_spans(spark):
    texts, labels = made(900, 3)
    rows = [(i, x, y) for i, (x, y) in enumerate(zip(texts, labels, strict=True))]
    docs = spark.createDataFrame([(i, x, "s") for i, x, _ in rows] + [(900, None, "s"), (901, "", "s")], "doc_id long, text string, score string")
    given = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5000, 1), (None, None)], "doc_id long, toxic int")
    model = t.train(docs, given, SMALL)
    got = {r["doc_id"]: r for r in t.tag(docs, model).collect()}
    hits = [(got[i]["score"] >= 0.5) == bool(y) for i, _, y in rows]
    assert np.mean(hits) > 0.97
    assert 0 <= got[900]["score"] < 0.5 and got[900]["score"] == got[901]["score"] and got[901]["n_toxic"] == 0
    one = next(i for i, _, y in rows if y)
    assert all(texts[one][s["start"] : s["stop"]].split() for s in got[one]["spans"]) and got[one]["spans"]


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = t.train(docs, spark.createDataFrame([], "doc_id long, toxic int"), SMALL)
    assert 0 <= t.tag(docs, model).first()["score"] <= 1
    assert t.tag(docs.limit(0), model).count() == 0


def test_tokens():
    counts, ids, words = t.tokenized(pa.array(["a  b\n a", None, "", " x"]))
    assert counts.tolist() == [3, 0, 0, 1] and [words[i] for i in ids] == ["a", "b", "a", "x"]


def test_long_sequences_in_stretches_equal_one_pass(monkeypatch):
    rng = np.random.default_rng(3)
    counts = np.array([5000, 0, 1, 700, 1025, 2048, 3])
    e, chain = rng.standard_normal(counts.sum()) * 3, np.array([[0.3, -2.0], [-1.0, 0.5]])
    e[100:140] = 80.0
    whole = t._messages(e, counts, chain)
    for leap in (16, 512):
        monkeypatch.setattr(t, "LEAP", leap)
        parts = t.forward_backward(e, counts, chain)
        m = [1 / (1 + np.exp(-np.clip(f + b, -60, 60))) for f, b in (whole, parts)]
        assert np.allclose(*m, atol=1e-9)


def test_a_very_long_text_repeated_rows_and_null_ids(spark):
    texts, labels = made(200, 5)
    long = "river " * 400_000 + "scum, scum idiot moron loser"
    rows = [*enumerate(texts), (300, long), (300, long), (None, "a river")]
    docs = spark.createDataFrame([(i, x, 0.5, 1) for i, x in rows], "doc_id long, text string, score double, n_toxic int")
    given = spark.createDataFrame([*enumerate(labels), *enumerate(labels), (300, 0)], "doc_id long, toxic int")
    model = t.train(docs, given, t.Config(epochs=10, bytes=2_000_000))  # the long text does not fit
    got = t.tag(docs, model).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] is None for r in got) == 1
    two = [r for r in got if r["doc_id"] == 300]
    assert two[0]["score"] == two[1]["score"] and two[0]["spans"] and two[0]["spans"][-1]["stop"] == len(long)

