"""Each stage of the pipeline against brute force on its own input."""

import os

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(name, input, output) of each stage on the smallest tables, with repeated rows, a null text and an extra column."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(900_001, None, "en", "src1", 0), (900_002, "one text twice " * 20, "en", "src2", 300), (900_002, "one text twice " * 20, "en", "src2", 300), (900_003, "", "fr", "src3", 0)], docs.schema)
    base, out = tmp_path_factory.mktemp("stages"), []
    docs.unionByName(odd).write.parquet(f"{base}/in")
    docs = spark.read.parquet(f"{base}/in")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{base}/{name}")
        after = spark.read.parquet(f"{base}/{name}")
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def rows(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


def test_columns(stages):
    from corpus_pipeline import COLUMNS

    for name, (before, after) in stages.items():
        assert before.columns == list(COLUMNS)
        assert after.columns == list(COLUMNS) or name == "pieces"


def test_toxicity_drops_what_scores_and_nothing_else(spark, stages):
    from ashlar.llm import toxicity

    before, after = stages["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(before, labels)
    texts = [t for _, t in rows(before)]
    gone = set()
    for t in set(texts):  # one text at a time
        counts, ids, words = toxicity.tokenized(toxicity.pa.array([t]))
        e = toxicity.emissions(words, model.weights, model.bits)[ids] if words else np.zeros(0)
        x = toxicity.summary(toxicity.marginals(e, counts, model.chain), counts)
        if 1 / (1 + np.exp(-(x @ model.head)[0])) >= 0.5:
            gone.add(t)
    assert sorted(rows(after)) == sorted(r for r in rows(before) if r[1] not in gone)
    assert gone


def test_one_document_of_each_group_stays(stages):
    before, after = stages["near_duplicates"]
    texts = dict(rows(before))
    sets = {}
    for i, t in texts.items():
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    top = {i: i for i in texts}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    assert sorted(i for i, _ in rows(after)) == [i for i in ids if find(i) == i]


def test_repeated_bytes_go(stages):
    before, after = stages["suffix_dedup"]
    seen, want = set(), {}
    for i, t in sorted(rows(before)):
        b = t.encode()
        gone = np.zeros(len(b) + 1, dtype=int)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s] += 1
                gone[s + 100] -= 1
            seen.add(w)
        keep = np.cumsum(gone)[:-1] == 0
        want[i] = bytes(np.frombuffer(b, dtype=np.uint8)[keep]).decode("utf-8", "ignore")
    assert dict(rows(after)) == want
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_mixing_draws_by_its_probabilities(stages):
    import hashlib

    from ashlar.llm import mixing

    before, after = stages["mixing"]
    p = {r["doc_id"]: r["p"] for r in mixing.celled(before, mixing.DEFAULT).join(mixing.rake(before), ["_source", "_lang", "_topic"], "left").select("doc_id", "p").collect()}
    draw = lambda i: int(hashlib.md5(f"{mixing.DEFAULT.seed}:{i}".encode()).hexdigest()[:13], 16) / 2**52
    want = [i for i, _ in rows(before) if draw(i) < (1.0 if p[i] is None else p[i])]
    assert sorted(i for i, _ in rows(after)) == sorted(want) and 0 < len(want) < len(p)


def test_pieces_give_the_texts_back(stages):
    from ashlar.llm import pieces

    before, after = stages["pieces"]
    back = {r["doc_id"]: r["text"] for r in pieces.decode(after, pieces.Vocabulary.load(pieces.MODEL)).collect()}
    assert back == dict(rows(before))


def test_empty_tables(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_null_ids_texts_and_columns_pass(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(None, None, None, None, None), (None, "a b", None, None, None), (1, "", None, "s", 0), (2, None, "en", None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() <= docs.count()
