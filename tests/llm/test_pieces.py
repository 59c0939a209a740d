import os

import numpy as np
import pyarrow as pa
import pytest
from ashlar.llm import pieces

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary")
TEXTS = ["", " ", "  two  blanks ", "x▁y", "a" * 300, "日本語 text 😀", "tab\there\n\nnew", "\0nul \0", "def f(x):\n        return x", "The same words, the same words."]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


def cut(n, ids):
    ends = np.cumsum(n)
    return [ids[e - k : e].tolist() for e, k in zip(ends, n, strict=True)]


def test_without_dropout_as_the_library(vocabulary):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = cut(*pieces.Coder(vocabulary, 0.0).encode(pa.array(TEXTS), np.zeros(len(TEXTS), dtype=np.int64)))
    for t, ids in zip(TEXTS, got, strict=True):
        if pieces.MARK not in t:
            assert ids == sp.encode(t), t


def test_dropout_is_lossless_seeded_and_varied(vocabulary):
    many = pa.array(TEXTS * 4)
    variant = np.repeat(np.arange(4), len(TEXTS))
    c = pieces.Coder(vocabulary, 0.3, 5)
    n, ids = c.encode(many, variant)
    size, data = c.decode(n, ids)
    raw, ends = data.tobytes(), np.cumsum(size)
    assert [raw[e - k : e].decode() for e, k in zip(ends, size, strict=True)] == TEXTS * 4
    again = pieces.Coder(vocabulary, 0.3, 5, most=0).encode(many, variant)
    assert (again[1] == ids).all()
    parts = cut(n, ids)
    assert len({tuple(parts[9 + 10 * v]) for v in range(4)}) > 1


def test_wide_merge_equals_agenda(vocabulary):
    c = pieces.Coder(vocabulary, 0.2, 3)
    units = ["hello", "internationalization", "x", "", "ééé", "supercalifragilistic"]
    variant = np.arange(len(units)) % 3
    key = c.unit_key([" " + u for u in units], variant)
    for u, k, ids in zip(units, key, cut(*c.encode_units(units, variant)), strict=True):
        assert ids == c.agenda(" " + u, k)


def test_columns(spark, vocabulary):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string")
    coded = pieces.encode(df, vocabulary, verify=True)
    assert all(r["lossless"] for r in coded.collect())
    back = {r["doc_id"]: r["text"] for r in pieces.decode(coded, vocabulary).collect()}
    assert [back[i] for i in range(len(TEXTS) + 1)] == [*TEXTS, ""]
    assert pieces.encode(df.limit(0), vocabulary).count() == 0


def test_workers_tell_vocabularies_apart(vocabulary):
    import dataclasses

    words = list(vocabulary.pieces)
    at = words.index(" the")
    words[at], words[at - 1] = words[at - 1], words[at]
    other = dataclasses.replace(vocabulary, pieces=tuple(words))
    assert other.digest() != vocabulary.digest()
    first = pieces._worker_coder((vocabulary.digest(), 0.0, 1), vocabulary, 0.0, 1)
    second = pieces._worker_coder((other.digest(), 0.0, 1), other, 0.0, 1)
    assert first is not second and pieces._worker_coder((other.digest(), 0.0, 1), other, 0.0, 1) is second
    assert len(pieces._CODER) == 1


def test_long_texts_repeated_rows_null_ids_and_clashing_columns(spark, vocabulary):
    rng = np.random.default_rng(0)
    long = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in rng.integers(1, 12, 300_000))
    rows = [(1, long, "x"), (1, long, "x"), (None, "a b", "y"), (2, "word" * 20_000, "z")]
    df = spark.createDataFrame([(*r, b"q") for r in rows], "doc_id long, text string, n_bytes string, ids binary")
    got = pieces.encode(df, vocabulary, verify=True).collect()
    assert len(got) == 4 and all(r["lossless"] for r in got)
    assert sorted((r["doc_id"] or 0, r["n_bytes"]) for r in got) == [(0, 3), (1, len(long)), (1, len(long)), (2, 80_000)]
    assert len({bytes(r["ids"]) for r in got if r["doc_id"] == 1}) == 1



def test_units_that_recur_are_merged_once_though_the_store_is_full(vocabulary, monkeypatch):
    merged = []
    inner = pieces.Coder.encode_units
    monkeypatch.setattr(pieces.Coder, "encode_units", lambda self, units, variant: merged.append(len(units)) or inner(self, units, variant))
    c = pieces.Coder(vocabulary, 0.1, 1, most=70)
    for batch in range(6):
        words = [f"common{k}" for k in range(30)] + [f"rare{batch}x{k}" for k in range(30)]
        n, ids = c.encode(pa.array([" ".join(words)]), np.zeros(1, dtype=np.int64))
        assert c.unpacked([ids.astype("<u4").tobytes()]) == [" ".join(words).encode()]
    assert merged == [60] + [30] * 5


def test_units_of_all_lengths_equal_agenda(vocabulary):
    rng = np.random.default_rng(2)
    letters = np.array(list("aeinrst\0.éß日😀"))
    units = ["".join(rng.choice(letters, n)) for n in [*range(80)] * 4] + [w * k for w in ("er", "é", "日", "😀", "the") for k in (5, 15, 16, 17, 31, 63, 64, 90)]
    variant = np.arange(len(units)) % 4
    for dropout in (0.0, 0.1, 0.6, 1.0):
        c = pieces.Coder(vocabulary, dropout, 9)
        key = c.unit_key([" " + u for u in units], variant)
        for u, k, ids in zip(units, key, cut(*c.encode_units(units, variant)), strict=True):
            assert ids == c.agenda(" " + u, k), u
