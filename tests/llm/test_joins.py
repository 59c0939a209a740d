"""The near-duplicate joins and the byte dedup against brute force on small, hostile inputs."""

import hashlib
import random

import numpy as np
from ashlar.llm import chosen_path, suffix_dedup, vector_join
from pyspark.sql import functions as F


def classes(ids, pairs):
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_jaccard_join(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(160):
        k = rng.random()
        if k < 0.1 or not texts:
            texts.append(" ".join(rng.choices(words, k=rng.randint(0, 8))))
        elif k < 0.5:
            t = rng.choice(texts).split()
            for _ in range(rng.randint(0, 2)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
        elif k < 0.6:
            texts.append(rng.choice(texts))
        else:
            texts.append(" ".join(rng.choices(words, k=rng.randint(40, 120))))
    base = rng.choices(words, k=80)
    for i in range(60):  # mutual near copies: a bucket that no split parts
        t = list(base)
        t[i] = "edit"
        texts.append(" ".join(t))
    texts += [None, "", "  \n"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "x", 1)], "doc_id long, text string, n_links int")
    got = {r["doc_id"]: r for r in chosen_path.join(df, chosen_path.Config(limit=8, tile=16, recall=0.9999)).collect()}
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 - 1e-12]
    top = classes(range(len(texts)), pairs)
    n = np.bincount(np.array(pairs).ravel(), minlength=len(texts))
    assert {i: (got[i]["class_id"], got[i]["n_links"]) for i in top} == {i: (top[i], n[i]) for i in top}
    assert got[None]["class_id"] is None
    assert chosen_path.join(df.limit(0)).count() == 0


def test_jaccard_of_repeated_rows_and_shared_ids(spark):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(40)]
    near = lambda k: " ".join([*base[k][:-1], "edit"])
    text = lambda k: " ".join(base[k])
    rows = [(1, text(0)), (1, text(0)), (1, text(0)), (2, near(0))]  # a repeated row and its partner
    rows += [(10 + k // 4, text(k)) for k in range(4, 36)] + [(100 + k, near(k)) for k in range(4, 36)]  # four texts an id
    rows += [(50, text(36)), (51, text(36)), (51, text(37)), (52, near(37)), (53, text(38)), (53, near(38))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = chosen_path.join(df).collect()
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 - 1e-12]
    n = np.bincount(np.array(pairs).ravel(), minlength=len(rows))
    top = classes({d for d, _ in rows}, [(rows[a][0], rows[b][0]) for a, b in pairs])
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == sorted((d, top[d], n[i]) for i, (d, _) in enumerate(rows))


def test_recall_at_defaults_on_whole_documents(spark):
    """All pairs of the table by an inverted index against the join as it is shipped."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in chosen_path.join(docs).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    sets, held = {}, {}
    for i, x in texts.items():
        w = x.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        for g in sets[i]:
            held.setdefault(g, []).append(i)
    shared = {}
    for own in held.values():
        for a, b in ((a, b) for k, a in enumerate(own) for b in own[:k]):
            shared[a, b] = shared.get((a, b), 0) + 1
    pairs = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9]
    n = np.bincount(np.array(pairs).ravel(), minlength=max(texts) + 1)
    found = sum(min(got[i]["n_links"], n[i]) for i in texts)
    print("links", int(n.sum()) // 2, "recall", found / n.sum())
    assert n.sum() > 100 and found >= 0.99 * n.sum() and all(got[i]["n_links"] <= n[i] for i in texts)
    top = classes(texts, pairs)
    assert np.mean([got[i]["class_id"] == top[i] for i in texts]) > 0.99


def test_vectors_that_share_an_id(spark):
    a, b = [1.0, 0.0, 0.0, 0.1], [0.0, 1.0, 0.0, 0.1]
    rows = [(1, a, 0), (1, b, 0), (2, a, 0), (2, a, 0), (3, b, 0), (4, b, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vector_join.near_duplicates(df).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 1, 1), (4, 0, 4)]


def test_more_axes_find_the_same(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((40, 24))
    rows = [(i, (base[i % 40] + rng.standard_normal(24) * 0.15 * (i >= 40)).tolist(), i % 2) for i in range(160)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = [sorted(map(tuple, vector_join.near_duplicates(df, vector_join.Config(grid=g)).collect())) for g in (1, 2, 3)]
    assert found[0] == found[1] == found[2] and any(r[1] for r in found[0])


def test_vector_join(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 16))
    rows = [(base[i % 60] + rng.standard_normal(16) * 0.12 * (i >= 60)).tolist() for i in range(200)]
    rows += [rows[0]] * 5 + [[0.0] * 16, None, [], [float("nan")] * 16, [1.0] * 15 + [None]]
    labels = [i % 3 for i in range(200)] + [0] * 5 + [0] * 5
    labels[7] = None
    df = spark.createDataFrame([(i, v, x, "y") for i, (v, x) in enumerate(zip(rows, labels, strict=True))] + [(None, rows[0], 0, "y")], "vec_id long, embedding array<float>, label int, kept string")
    got = {r["vec_id"]: r for r in vector_join.near_duplicates(df, vector_join.Config(tile=16)).collect()}
    good = [i for i, v in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v) and labels[i] is not None]
    x = {i: np.asarray(rows[i], dtype=np.float32).astype(float) for i in good}
    pairs = [(a, b) for a in good for b in good if b < a and labels[a] == labels[b] and x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) >= 0.93]
    assert len(pairs) > 50
    top, n = classes(range(len(rows)), pairs), np.bincount(np.array(pairs).ravel(), minlength=len(rows))
    assert {i: (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) for i in top} == {i: (n[i], top[i], top[i] == i) for i in top}
    assert vector_join.near_duplicates(df.limit(0)).count() == 0


def covered(texts):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        m = np.zeros(len(b) + 1, dtype=int)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                m[s] += 1
                m[s + 100] -= 1
            seen.add(w)
        gone = np.cumsum(m)[:-1] > 0
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def hostile(n, seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdef ") for _ in range(2000))
    texts = []
    for i in range(n):
        k = rng.random()
        if k < 0.1:
            texts.append("a" * rng.randint(0, 400))
        elif k < 0.2:
            texts.append(rng.choice(["", None]))
        elif k < 0.5:
            j = rng.randint(0, 1800)
            texts.append("".join(rng.choice("xyzé") for _ in range(rng.randint(0, 80))) + base[j : j + rng.randint(90, 400)] + "z" * rng.randint(0, 30))
        elif k < 0.65:
            texts.append("ONE HEADER THAT MANY OF THESE TEXTS SHARE, LONGER THAN A HUNDRED BYTES, WITH A DIFFERENT TAIL BEHIND IT EACH " + str(i) * rng.randint(0, 60))
        elif k < 0.75:
            texts.append("ab" * rng.randint(40, 200))
        else:
            texts.append(rng.choice(texts) if texts else "x")
    return texts


def test_suffix_dedup(spark, monkeypatch):
    texts = hostile(200, 4)
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(None, "b" * 300, "en")], "doc_id long, text string, lang string")
    want = covered(texts)
    for config in (suffix_dedup.Config(), suffix_dedup.Config(sample=20)):
        got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.with_sha(suffix_dedup.dedup(df, config)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
        assert [got[i] for i in range(len(texts))] == want
        assert got[None][:2] == (300, 0)
    text = {r["doc_id"]: r for r in suffix_dedup.dedup(df, keep=("lang",), as_text=True).collect()}
    assert all(isinstance(r["kept"], str) and r["lang"] == "en" for r in text.values())
    assert suffix_dedup.dedup(df.limit(0)).count() == 0


def test_rows_that_share_an_id_keep_what_is_theirs(spark):
    rng = random.Random(2)
    a, b, c = ("".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (4, b[:200] + "!"), (None, a), (None, a)]
    df = spark.createDataFrame([(*r, r[1][:3]) for r in rows], "doc_id long, text string, n_bytes string")
    got = sorted((r["doc_id"] or 0, r["n_removed"], bytes(r["kept"])) for r in suffix_dedup.dedup(df).collect())
    assert got == sorted([(1, 0, a.encode()), (2, 400, b""), (2, 0, b.encode()), (3, 0, c.encode()), (3, 400, b""), (4, 200, b"!"), (0, 0, a.encode()), (0, 0, a.encode())])
    kept = suffix_dedup.dedup(df.drop("n_bytes").withColumn("doc", F.lit(5)), keep=("doc",)).where("doc_id = 2").collect()
    assert [r["doc"] for r in kept] == [5, 5]


def test_a_text_above_16_mib_and_a_copy_of_its_end(spark):
    import base64

    raw = base64.b64encode(np.random.default_rng(1).bytes(13_500_000)).decode()
    end = raw[17_000_000:17_500_000]
    df = spark.createDataFrame([(1, raw), (2, end), (3, "!" + end[1000:300_000])], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.dedup(df).drop("kept").collect()}
    assert got == {1: (18_000_000, 0, 0), 2: (500_000, 500_000, 1), 3: (299_001, 299_000, 1)}


def test_ranges_order_leads_and_parts_keep_them_together():
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list("ab "), 30_000)).encode()
    a = suffix_dedup.anchors(np.array([1]), [text], suffix_dedup.Config())
    s = suffix_dedup.splitters([a.w0, a.w1, a.w2, a.around], 40)
    bucket = suffix_dedup.Ranges(s).of(a)
    keys = list(zip(a.w0.tolist(), a.w1.tolist(), a.w2.tolist(), a.around.tolist(), strict=True))
    edges = [tuple(x) for x in s.tolist()]
    assert bucket.tolist() == [sum(e <= k for e in edges) for k in keys]
    fine = suffix_dedup.Ranges(s, 5).of(a)
    assert (fine // 5 == bucket).all() and len({(k[:3], int(b)) for k, b in zip(keys, fine, strict=True)}) == len({(k[:3], int(b)) for k, b in zip(keys, bucket, strict=True)})


def test_anchors_of_long_texts_do_not_depend_on_stretches(monkeypatch):
    rng = random.Random(5)
    t = "".join(rng.choice("abcd ") for _ in range(5000)).encode()
    c = suffix_dedup.Config()
    whole = suffix_dedup.anchors(np.array([1]), [t], c)
    monkeypatch.setattr(suffix_dedup, "STRETCH", 700)
    parts = suffix_dedup.anchors(np.array([1]), [t], c)
    assert (whole.at == parts.at).all() and (whole.around == parts.around).all()


def test_anchors_beyond_16_mib_are_those_of_the_same_bytes_elsewhere():
    c = suffix_dedup.Config()
    tail = np.random.default_rng(6).integers(97, 123, 3_000_000, dtype=np.uint8).tobytes()
    head = np.random.default_rng(7).integers(97, 123, (1 << 24) + 1000, dtype=np.uint8).tobytes()
    alone = suffix_dedup.anchors(np.array([1]), [tail], c)
    behind = suffix_dedup.anchors(np.array([2]), [head + tail], c)
    assert (np.diff(behind.at) > 0).all() and (np.diff(behind.at) <= c.span).all()
    inner = alone.at >= c.span
    beyond = behind.at >= len(head) + c.span
    assert (behind.at[beyond] - len(head) == alone.at[inner]).all() and (behind.around[beyond] == alone.around[inner]).all()


def test_multikey():
    rng = np.random.default_rng(3)
    keys = [rng.integers(0, 4, 500) for _ in range(5)]
    order = suffix_dedup.multikey(keys)
    rows = [tuple(k[i] for k in keys) for i in order]
    assert rows == sorted(rows)
