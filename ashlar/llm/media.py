"""Media columns: PNG images in binary columns.

``to_media`` stores each text's bytes as the samples of an 8-bit greyscale PNG; ``read_media`` reads the binary column
back, testing every chunk's checksum and undoing the row filters in numpy, and computes a hash of the image's
low-frequency cosine transform. Both run over Arrow batches; a row's image is the largest thing held besides a batch.

Null text counts as empty (one row of blanks). A null binary gives nulls; one that is damaged raises, or gives nulls
and the reason in ``error`` under ``on_error="null"``. Every row is taken by itself: repeated rows and ids, null ids
and equal texts give as many rows, equal texts with equal values. Extra columns stay out unless ``keep`` names them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, by_size, releasing

#: Samples in a row of the image; payloads are filled up with blanks to whole rows.
WIDTH = 192
#: Fixed values of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)


def payload(text: str | None) -> bytes:
    """UTF-8 bytes, filled up with blanks to a positive multiple of WIDTH."""
    return filled((text or "").encode("utf-8", "surrogatepass"))


def filled(raw: bytes) -> bytes:
    return raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b" ")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    a, b, c = (x.astype(np.int16) for x in (a, b, c))
    p = a + b - c
    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c)).astype(np.uint8)


def filtered(rows: np.ndarray, kind: int) -> np.ndarray:
    """rows (height x width, one byte a sample) under one filter."""
    left = np.pad(rows, ((0, 0), (1, 0)))[:, :-1]
    above = np.pad(rows, ((1, 0), (0, 0)))[:-1]
    if kind == NONE:
        return rows
    if kind == SUB:
        return rows - left
    if kind == UP:
        return rows - above
    if kind == AVERAGE:
        return rows - ((left.astype(np.uint16) + above) // 2).astype(np.uint8)
    return rows - _paeth(left, above, np.pad(above, ((0, 0), (1, 0)))[:, :-1])


def write_png(samples: np.ndarray, filters: Sequence[int] = (NONE, UP), level: int = 6, piece: int = 1 << 16) -> bytes:
    """An 8-bit greyscale PNG; each row takes that filter of the given ones whose result varies least."""
    height, width = samples.shape
    made = np.stack([filtered(samples, k) for k in filters])
    # steps between neighbouring bytes tell how well a row will pack
    cost = np.abs(np.diff(made.astype(np.int16), axis=2)).sum(axis=2)
    best = cost.argmin(axis=0)
    body = np.empty((height, width + 1), dtype=np.uint8)
    body[:, 0] = np.asarray(filters, dtype=np.uint8)[best]
    body[:, 1:] = made[best, np.arange(height)]
    data = zlib.compress(body.tobytes(), level)
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    pieces = b"".join(_chunk(b"IDAT", data[i : i + piece]) for i in range(0, len(data), piece))
    return SIGNATURE + _chunk(b"IHDR", head) + pieces + _chunk(b"IEND", b"")


def unfiltered(body: np.ndarray) -> np.ndarray:
    """Undoes the filters: runs of rows at once where rows do not depend on each other within the row."""
    kinds, rows = body[:, 0], body[:, 1:]
    if kinds.max(initial=0) > PAETH:
        raise ValueError(f"unknown filter {kinds.max()}")
    out = np.zeros_like(rows)
    flat = kinds == NONE
    out[flat] = rows[flat]
    flat = kinds == SUB
    out[flat] = np.cumsum(rows[flat], axis=1, dtype=np.uint8)
    cuts = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(kinds)], strict=True):
        kind = kinds[a] if a < len(kinds) else NONE
        above = out[a - 1] if a else np.zeros(rows.shape[1], dtype=np.uint8)
        if kind == UP:
            out[a:b] = np.cumsum(np.vstack([above[None], rows[a:b]]), axis=0, dtype=np.uint8)[1:]
        elif kind in (AVERAGE, PAETH):
            _diagonals(rows, out, a, b, kind)
    return out


def _diagonals(rows: np.ndarray, out: np.ndarray, a: int, b: int, kind: int) -> None:
    """Rows a to b of a filter that needs left, above and their corner: samples of one diagonal are independent."""
    height, width = b - a, rows.shape[1]
    full = np.zeros((height + 1, width + 1), dtype=np.uint8)
    full[0, 1:] = out[a - 1] if a else 0
    for d in range(height + width - 1):
        i = np.arange(max(0, d - width + 1), min(height, d + 1))
        j = d - i
        left, above, corner = full[i + 1, j], full[i, j + 1], full[i, j]
        guess = _paeth(left, above, corner) if kind == PAETH else ((left.astype(np.uint16) + above) // 2).astype(np.uint8)
        full[i + 1, j + 1] = rows[a + i, j] + guess
    out[a:b] = full[1:, 1:]


def read_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG; raises ValueError where a checksum, length or order is wrong."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, parts, ended = 8, None, [], False
    while at < len(data):
        if ended or at + 12 > len(data):
            raise ValueError("bytes beyond the last chunk")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        chunk = data[at + 8 : at + 8 + n]
        if at + 12 + n > len(data) or zlib.crc32(chunk, zlib.crc32(kind)) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError(f"wrong checksum in {kind!r}")
        if (kind == b"IHDR") != (head is None):
            raise ValueError("IHDR is not first")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            parts.append(chunk)
        elif kind == b"IEND":
            ended = True
        elif kind[0] < 97:
            raise ValueError(f"unknown critical chunk {kind!r}")
        at += 12 + n
    if not ended or head is None:
        raise ValueError("no IEND")
    width, height, *rest = head
    if rest != [8, 0, 0, 0, 0]:
        raise ValueError(f"not 8-bit greyscale without interlace: {rest}")
    body = np.frombuffer(zlib.decompress(b"".join(parts)), dtype=np.uint8)
    if body.size != height * (width + 1):
        raise ValueError("wrong number of samples")
    return unfiltered(body.reshape(height, width + 1))


def _edges(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.arange(m + 1) * n / m
    i = np.minimum(x.astype(int), n - 1)
    return i, x - i


#: Size to which an image is averaged, and the side of the block of low frequencies.
SIDE, LOW = 32, 8
BASIS = np.cos(np.pi / SIDE * (np.arange(SIDE) + 0.5)[None, :] * np.arange(LOW)[:, None])


def cosine_hash(samples: np.ndarray) -> str:
    """16 hex digits: which of the 64 lowest frequencies, the mean apart, are above their median."""
    grid = samples.astype(np.float64)
    for _ in range(2):  # area average over each axis, with split samples
        n = grid.shape[0]
        i, f = _edges(n, SIDE)
        sums = np.vstack([np.zeros(grid.shape[1]), np.cumsum(grid, axis=0)])
        grid = (np.diff(sums[i] + grid[i] * f[:, None], axis=0) * (SIDE / n)).T
    low = (BASIS @ grid @ BASIS.T).ravel()
    bits = np.round(low, 6) > np.median(np.round(low[1:], 6))
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def to_media(documents: DataFrame, key: str = "doc_id", text: str = "text", filters: Sequence[int] = (NONE, UP), level: int = 6) -> DataFrame:
    """(key, n_bytes, media): the PNG of each text, and its length in bytes before filling up."""

    bounded(documents.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, 1, 1_000_000):
            sizes, made = [], []
            for t in b.column(1):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                sizes.append(len(raw))
                made.append(write_png(np.frombuffer(filled(raw), dtype=np.uint8).reshape(-1, WIDTH), filters, level))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(made, pa.binary())], [key, "n_bytes", "media"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, F.col(text).alias("_text")).mapInArrow(releasing(run), f"`{key}` {kind}, n_bytes long, media binary")


READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def read_media(media: DataFrame, keep: Sequence[str] = ("doc_id", "n_bytes"), column: str = "media", on_error: str = "raise") -> DataFrame:
    """(keep..., digests of the payload read back and of the stored form, feature, error)."""

    def look(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 7
        try:
            samples = read_png(data)
        except (ValueError, zlib.error) as e:
            if on_error == "raise":
                raise
            return (None, None, None, len(data), hashlib.sha256(data).hexdigest(), None, str(e))
        raw = samples.tobytes()
        return (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(samples), None)

    fields = [pa.field(x.split()[0], {"long": pa.int64(), "string": pa.string()}[x.split()[1]]) for x in READ.split(", ")]

    bounded(media.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, len(keep), 1_000_000):
            found = list(zip(*(look(x.as_py()) for x in b.column(len(keep))), strict=True)) or [()] * len(fields)
            arrays = [*b.columns[: len(keep)], *(pa.array(v, f.type) for v, f in zip(found, fields, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, *(f.name for f in fields)])

    kept = ", ".join(f"`{k}` {media.schema[k].dataType.simpleString()}" for k in keep)
    return media.select(*keep, F.col(column).alias("_media")).mapInArrow(releasing(run), f"{kept}, {READ}")
