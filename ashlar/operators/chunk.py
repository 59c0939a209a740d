"""Chunkers: one text to many chunks.

``fixed`` without sentence boundaries has a closed form in expressions. The others carry state from chunk to chunk and
run over Arrow batches; each text is cut by itself. Chunks are numbered from 0 within their document and keep true
offsets.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import clean_chunk, content_features
from ..shared import bounded

SCHEMA = "doc_id long, chunk_index int, start_char int, end_char int, section string, text string"
FIELDS = pa.schema([("doc_id", pa.int64()), ("chunk_index", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("section", pa.string()), ("text", pa.string())])
#: Characters of chunks that a batch holds.
HELD = 1 << 20
Piece = tuple[int, int, str, str]  # start, end, section, text


@dataclass(frozen=True)
class ChunkConfig:
    strategy: str = "fixed_size"
    size: int = 500
    overlap: int = 50
    least: int = 100
    most: int = 1000
    sentences: bool = True


def boundary(text: str, at: int, reach: int = 100) -> int:
    """After the next end of a sentence within reach, else after the last one before, else where it was."""
    ahead = re.search(r"[.!?]\s", text[at : at + reach])
    if ahead:
        return at + ahead.start() + 1
    back = list(re.finditer(r"[.!?]\s", text[max(0, at - reach) : at]))
    return max(0, at - reach) + back[-1].start() + 1 if back else at


def fixed(text: str, c: ChunkConfig) -> list[Piece]:
    """Windows of c.size that advance by size - overlap. A last piece below c.least joins the chunk before it."""
    out: list[Piece] = []
    start, n = 0, len(text)
    while start < n:
        end = min(start + c.size, n)
        if end < n and c.sentences:
            moved = boundary(text, end)
            end = moved if moved > start + c.least else end
        piece = text[start:end].strip()
        if len(piece) < c.least and out:
            a, _, s, t = out[-1]
            out[-1] = (a, end, s, f"{t} {piece}")
            break
        if piece:
            out.append((start, end, "content", piece))
        start = max(start + 1, end - c.overlap)
    return out


def sections(text: str) -> list[Piece]:
    """Stretches that start at a line which names a section; what stands before the first is left out."""
    found: list[tuple[int, str]] = []
    at = 0
    for line in text.split("\n"):
        head = line.strip().lower()
        name = next((s for s, p in K.SECTION_STARTS if re.match(p, head)), None)
        if name:
            found.append((at, name))
        at += len(line) + 1
    ends = [a for a, _ in found[1:]] + [len(text)] * bool(found)
    return [(a, e, s, text[a:e].strip()) for (a, s), e in zip(found, ends, strict=True)]


def paragraphs(text: str, c: ChunkConfig) -> list[Piece]:
    """Whole paragraphs packed up to c.size characters; with overlap the last of a full chunk starts the next."""
    spots: list[tuple[int, str]] = []
    at = 0
    for p in re.split(r"\n\s*\n", text):
        body = p.strip()
        if body:
            at = text.find(body, at)
            spots.append((at, body))
    out: list[Piece] = []
    held: list[tuple[int, str]] = []

    def close() -> None:
        if held:
            out.append((held[0][0], held[-1][0] + len(held[-1][1]), "content", "\n\n".join(b for _, b in held)))

    size = 0
    for spot in spots:
        if held and size + len(spot[1]) > c.size:
            close()
            held = [held[-1]] if c.overlap > 0 and len(held) > 1 else []
            size = sum(len(b) for _, b in held)
        held.append(spot)
        size += len(spot[1])
    close()
    return out


def _recut(piece: Piece, c: ChunkConfig) -> list[Piece]:
    start, end, section, text = piece
    if len(text) <= c.most:
        return [piece]
    return [(start + a, start + b, section, t) for a, b, _, t in fixed(text, c)]


def semantic(text: str, c: ChunkConfig) -> list[Piece]:
    """Sections, the long ones cut by size; paragraphs where there are no two sections."""
    found = sections(text)
    if len(found) < 2:
        return paragraphs(text, c)
    return [p for s in found if s[3] for p in _recut(s, c)]


def hybrid(text: str, c: ChunkConfig) -> list[Piece]:
    return [p for s in semantic(text, c) for p in _recut(s, c)]


STRATEGIES: dict[str, Callable[[str, ChunkConfig], list[Piece]]] = {"fixed_size": fixed, "semantic": semantic, "paragraph": paragraphs, "hybrid": hybrid}


def chunk(documents: DataFrame, c: ChunkConfig = ChunkConfig(), doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, chunk_index, start_char, end_char, section, text) before cleaning."""
    if c.strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {c.strategy!r}")
    cut = STRATEGIES[c.strategy]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            # a text at a time becomes a Python string; chunks leave as soon as they are HELD characters
            for d, t in zip(batch.column(0), batch.column(1), strict=True):
                for i, p in enumerate(cut(t.as_py() or "", c)):
                    rows.append((d.as_py(), i, *p))
                    held += len(p[3]) + 100
                    if held >= HELD:
                        yield _batch(rows)
                        rows, held = [], 0
            if rows:
                yield _batch(rows)
                rows, held = [], 0

    narrow = documents.select(F.col(doc).cast("long").alias("d"), F.col(text).alias("t"))
    bounded(documents.sparkSession)
    return narrow.mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), FIELDS, strict=True)], schema=FIELDS)


def spans(documents: DataFrame, size: int, overlap: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Fixed windows without sentence boundaries and without joining the tail, as expressions: (doc_id, chunk_index,
    start_char, end_char, text)."""
    n = F.length(F.col(text))
    count = F.greatest(F.ceil((n - overlap) / (size - overlap)), F.lit(1)).cast("int")
    rows = documents.where(n > 0).select(F.col(doc).alias("doc_id"), F.col(text).alias("t"), F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_index"))
    start = F.col("chunk_index") * (size - overlap)
    return rows.select("doc_id", "chunk_index", start.alias("start_char"), F.least(start + size, F.length("t")).alias("end_char"), F.substring(F.col("t"), start + 1, F.lit(size)).alias("text"))


def finish(chunks: DataFrame, least: int = 100) -> DataFrame:
    """Cleaned chunks of at least ``least`` characters, numbered anew, with counts and features."""
    from pyspark.sql import Window

    c = chunks.withColumn("text", clean_chunk("text")).where(F.length("text") >= least)
    c = c.withColumn("chunk_index", (F.row_number().over(Window.partitionBy("doc_id").orderBy("start_char", "chunk_index")) - 1).cast("int"))
    c = c.withColumns({"chunk_id": F.concat_ws("_", F.col("doc_id"), F.col("chunk_index")), "char_count": F.length("text"), "word_count": F.size(F.split("text", " +"))})
    return c.withColumns(content_features("text"))


def stats(chunks: DataFrame) -> DataFrame:
    n, w = F.length("text"), F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    return chunks.agg(
        F.count("*").alias("chunks"), F.avg(n).alias("avg_chars"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.avg(w).alias("avg_words"), F.sum(n).alias("chars"), F.sum(w).alias("words"), F.count_distinct("section").alias("sections")
    )


def lines_of(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    return documents.select(F.col(doc).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
