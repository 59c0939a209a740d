import hashlib
import zlib

import numpy as np
import pytest
from ashlar.llm import media


@pytest.mark.parametrize("filters", [(0,), (1,), (2,), (3,), (4,), (0, 1, 2, 3, 4)])
@pytest.mark.parametrize("height", [1, 2, 9])
def test_round_trip(filters, height):
    x = np.random.default_rng(height).integers(0, 256, (height, 192), dtype=np.uint8)
    x[height // 2 :, ::3] = 7
    assert (media.read_png(media.write_png(x, filters, piece=500)) == x).all()


def plain_png(data):
    """The samples again, a byte at a time after the format's own rules."""
    at, body, width, height = 8, b"", 0, 0
    while at < len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        chunk = data[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + chunk) == int.from_bytes(data[at + 8 + n : at + 12 + n], "big")
        if kind == b"IHDR":
            width, height = int.from_bytes(chunk[:4], "big"), int.from_bytes(chunk[4:8], "big")
        body += chunk if kind == b"IDAT" else b""
        at += 12 + n
    raw, above, out = zlib.decompress(body), bytes(width), []
    for y in range(height):
        kind, line, row = raw[y * (width + 1)], raw[y * (width + 1) + 1 : (y + 1) * (width + 1)], bytearray()
        for x, v in enumerate(line):
            a, b, c = (row[x - 1] if x else 0), above[x], (above[x - 1] if x else 0)
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            row.append((v + (0, a, b, (a + b) // 2, near)[kind]) % 256)
        above = bytes(row)
        out.append(above)
    return b"".join(out)


@pytest.mark.parametrize("filters", [(1,), (3,), (4,), (0, 1, 2, 3, 4)])
def test_reads_as_a_plain_decoder_does(filters):
    x = np.random.default_rng(5).integers(0, 256, (7, 192), dtype=np.uint8)
    x[2:5] = x[2] + np.arange(192, dtype=np.uint8)
    data = media.write_png(x, filters)
    assert plain_png(data) == x.tobytes() == media.read_png(data).tobytes()


def test_hash_by_plain_sums():
    x = np.random.default_rng(2).integers(0, 256, (64, 192), dtype=np.uint8)
    grid = x.reshape(32, 2, 32, 6).mean(axis=(1, 3))
    low = [sum(grid[i, j] * np.cos(np.pi / 32 * (i + 0.5) * u) * np.cos(np.pi / 32 * (j + 0.5) * v) for i in range(32) for j in range(32)) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    bits = "".join("1" if k and v > middle else "0" for k, v in enumerate(low))
    assert media.cosine_hash(x) == f"{int(bits, 2):016x}"


def test_long_texts_repeated_rows_and_clashing_columns(spark):
    long = "é" * 1_500_000
    df = spark.createDataFrame([(1, long, b"x"), (1, long, b"x"), (None, "a", b"x")], "doc_id long, text string, media binary")
    got = media.read_media(media.to_media(df)).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"]) for r in got) == [(0, 1), (1, 3_000_000), (1, 3_000_000)]
    assert len({r["feature"] for r in got if r["doc_id"]}) == 1


def test_damage_is_found():
    data = bytearray(media.write_png(np.zeros((3, 192), dtype=np.uint8)))
    for at in (0, 20, 45, len(data) - 2):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            media.read_png(bytes(bad))
    with pytest.raises(ValueError):
        media.read_png(bytes(data[:-6]))


def test_column(spark):
    texts = ["", None, "é" * 96, "x" * 193, "same", "same"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = media.to_media(df)
    got = {r["doc_id"]: r for r in media.read_media(made).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(want))
        assert r["payload_sha256"] == hashlib.sha256(want).hexdigest() and r["tail_crc32"] == zlib.crc32(want[-16:])
    assert got[4]["feature"] == got[5]["feature"] and got[4]["media_sha256"] == got[5]["media_sha256"]
    broken = spark.createDataFrame([(1, 0, bytearray(b"junk")), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    got = {r["doc_id"]: r for r in media.read_media(broken, on_error="null").collect()}
    assert got[1]["error"] and got[1]["feature"] is None and got[2]["error"] is None
    assert media.read_media(media.to_media(df.limit(0))).count() == 0
