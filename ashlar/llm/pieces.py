"""SentencePiece encoding and decoding with seeded merge-dropout.

Text is cut before each run of blanks; no piece of the vocabulary has a blank inside, so units are independent. Within
a unit, characters are merged best score first, leftmost among equals, until no pair makes a piece. Each candidate
merge, known by where its two halves start and where it ends, is skipped for good if a hash keyed by seed, variant and
unit falls under the dropout rate: the segmentation varies between variants and is the same on every run and machine.
Characters outside the vocabulary become their UTF-8 bytes, so decoding gives back every text exactly, a literal
U+2581 included.

All distinct units of an Arrow batch are merged at once in numpy, a merge in every unit at each step, which touches only
the symbols beside it; units too long for that run over an agenda (a heap). Units that come again are looked up. Null counts as empty, which has no pieces. Documents choose their variant by a
hash of their id, so copies under different ids may be cut differently, and decode alike.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, by_size, releasing

#: Where the vocabulary file lies unless a path is given; ``ASHLAR_PIECES`` names another.
MODEL = os.environ.get("ASHLAR_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
#: Units of up to so many characters are merged together; longer ones one by one.
WIDE = 64
CLASSES = (6, 8, 10, 12, 16, 24, 40, WIDE)
#: Units merged at once: few enough for their tables to stay in a core's cache.
TOGETHER = 8_192
NEVER = np.int32(2**31 - 1)
EMPTY = np.uint64(2**64 - 1)
MARK = "▁"


@dataclass(frozen=True)
class Vocabulary:
    """pieces: the text of each id, '' where it has none; order: merge priority of each id; byte0: id of byte 0."""

    pieces: tuple[str, ...]
    order: np.ndarray
    byte0: int

    @staticmethod
    def load(path: str = MODEL) -> Vocabulary:
        """Reads the model on the driver; what tasks need is shipped with the function."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        pieces = tuple(sp.id_to_piece(i).replace(MARK, " ") if plain[i] else "" for i in range(n))
        if any(" " in p.lstrip(" ") for p in pieces):
            raise ValueError("a piece goes on after a blank: units are not independent")
        scores = np.array([sp.get_score(i) for i in range(n)])
        order = np.empty(n, dtype=np.int32)
        order[np.argsort(-scores, kind="stable")] = np.arange(n, dtype=np.int32)
        byte0 = next(i for i in range(n) if sp.is_byte(i))
        if not all(sp.is_byte(byte0 + i) for i in range(256)):
            raise ValueError("bytes are not consecutive")
        return Vocabulary(pieces, order, byte0)

    def digest(self) -> str:
        """Names everything that coding depends on."""
        h = hashlib.blake2b(np.ascontiguousarray(self.order, dtype="<i4").tobytes() + self.byte0.to_bytes(4, "little"), digest_size=16)
        for p in self.pieces:
            raw = p.encode("utf-8", "surrogatepass")
            h.update(len(raw).to_bytes(4, "little") + raw)
        return h.hexdigest()


def _crc_table() -> np.ndarray:
    out = np.empty(256, dtype=np.uint32)
    for i in range(256):
        out[255 ^ i] = (zlib.crc32(bytes([i])) ^ 0xFFFFFFFF) ^ 0x00FFFFFF
    return out


CRC = _crc_table()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of x moves every bit of the result."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Coder:
    """Encodes and decodes batches. What depends on the vocabulary alone is kept by a Python worker, units are not."""

    def __init__(self, vocabulary: Vocabulary, dropout: float = 0.1, seed: int = 1, most: int = 100_000) -> None:
        """most: units that are remembered from batch to batch; beyond it those stay that the last batch met again, and new ones up to half."""
        self.v, self.dropout, self.seed, self.most = vocabulary, dropout, seed, most
        self.clear()
        ids = {p: i for i, p in enumerate(vocabulary.pieces) if p}
        singles = sorted({c for p in ids for c in p})
        n = len(vocabulary.pieces)
        # characters that only occur inside pieces are symbols, too
        self.symbol = dict(ids) | {c: n + k for k, c in enumerate(c for c in singles if c not in ids)}
        self.unknown = n + len(singles)
        self.of_char = np.full(0x110000, self.unknown, dtype=np.int32)
        for c in singles:
            self.of_char[ord(c)] = self.symbol[c]
        pairs = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = i
        self.pairs = pairs
        self.of_order = np.argsort(vocabulary.order).astype(np.int32)
        if (vocabulary.order[self.of_order] != np.arange(n)).any():
            raise ValueError("two pieces share a priority")
        keys = np.fromiter(pairs, dtype=np.uint64, count=len(pairs))
        order = vocabulary.order[np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs))].astype(np.uint64)
        # two hash tables of key and order without chains; the few keys that neither holds are looked up by bisection
        self.tables, left = [], np.arange(len(keys))
        wide = max(8, (4 * len(keys)).bit_length())
        for factor, bits in ((0x9E3779B97F4A7C15, wide), (0xC2B2AE3D27D4EB4F, wide - 3)):
            at = slot(keys[left], factor, bits)
            first = np.full(1 << bits, -1, dtype=np.int32)
            first[at[::-1]] = left[::-1]
            table = np.full(1 << bits, EMPTY)
            held = first >= 0
            table[held] = (keys[first[held]] << np.uint64(24)) | order[first[held]]
            self.tables.append((factor, bits, table))
            left = left[first[at] != left]
        rest = left[np.argsort(keys[left])]
        self.rest = keys[rest], order[rest]
        parts = [p.encode() for p in vocabulary.pieces]
        for i in range(256):
            parts[vocabulary.byte0 + i] = bytes([i])
        self.parts = pa.array(parts, pa.large_binary())

    def order_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The priority of the piece that two symbols make, -1 if none."""
        keys = (a.astype(np.uint64) << np.uint64(20)) | b.astype(np.uint64)
        out = np.full(len(keys), -1, dtype=np.int32)
        at: np.ndarray | slice = slice(None)
        for factor, bits, table in self.tables:
            entry = table[slot(keys, factor, bits)]
            hit = (entry >> np.uint64(24)) == keys
            out[at] = np.where(hit, (entry & np.uint64(0xFFFFFF)).astype(np.int32), -1)
            other = np.flatnonzero(~hit & (entry != EMPTY))
            at, keys = other if isinstance(at, slice) else at[other], keys[other]
        if len(self.rest[0]) and len(keys):
            j = np.minimum(np.searchsorted(self.rest[0], keys), len(self.rest[0]) - 1)
            hit = self.rest[0][j] == keys
            out[at[hit]] = self.rest[1][j[hit]]
        return out

    def skipped(self, unit: np.ndarray, start: np.ndarray, middle: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Whether a candidate merge is left out; unit: hash of the unit with seed and variant."""
        key = (start.astype(np.uint64) << np.uint64(42)) | (middle.astype(np.uint64) << np.uint64(21)) | stop.astype(np.uint64)
        return (mixed(mixed(key) ^ unit) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < self.dropout

    def unit_key(self, units: Sequence[str], variant: np.ndarray) -> np.ndarray:
        raw = [u.encode("utf-8", "surrogatepass") for u in units]
        low = np.fromiter(map(zlib.crc32, raw), dtype=np.uint64, count=len(raw))
        high = np.fromiter(map(zlib.adler32, raw), dtype=np.uint64, count=len(raw))
        return self._keyed(low, high, variant)

    def _keyed(self, crc: np.ndarray, adler: np.ndarray, variant: np.ndarray) -> np.ndarray:
        return mixed(mixed((adler << np.uint64(32)) | crc) ^ mixed(variant.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(self.seed)))

    def encode_units(self, units: Sequence[str] | pa.Array, variant: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each unit, the ids end to end); a blank before each unit is implied."""
        if not isinstance(units, pa.Array):
            units = pa.array(units, pa.large_string())
        units = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), units, pa.scalar("", pa.large_string()))
        ends, data = flat(units)
        key = self._keyed(*checksums(ends, data), variant)
        code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[ends]
        first, size = chars[:-1], np.diff(chars)
        symbol = self.of_char[code]
        found: list[tuple[np.ndarray, np.ndarray]] = []  # (unit of each id, id), ids of a unit in order
        low = 0
        for high in CLASSES:
            own = np.flatnonzero((size > low) & (size <= high))
            low = high
            for i in range(0, len(own), TOGETHER):
                part = own[i : i + TOGETHER]
                found.append(self._merge(high, code, symbol, first[part], size[part], key[part], part))
        for j in np.flatnonzero(size > WIDE):
            ids = np.array(self.agenda(units[int(j)].as_py(), key[j]), dtype=np.int64)
            found.append((np.full(len(ids), j), ids))
        if not found:
            return np.zeros(len(units), dtype=np.int64), np.zeros(0, dtype=np.int64)
        owner, ids = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        order = np.argsort(owner, kind="stable")
        return np.bincount(owner, minlength=len(units)), ids[order]

    def _merge(self, width: int, code: np.ndarray, symbol: np.ndarray, first: np.ndarray, size: np.ndarray, key: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All merges of units of up to width characters: in each step every unit makes its best one.

        A symbol is known by the place of its first character, and has links to those beside it; a unit is a column.
        Ranks are priority and place in one number, the lowest of a column being its next merge.
        """
        m = len(size)
        place = np.arange(width + 1)[:, None]
        alive = place < size
        sym = np.where(alive, symbol[np.minimum(first + place, len(symbol) - 1)], self.unknown)
        stop = np.broadcast_to(place + 1, alive.shape).copy()
        before = stop - 2
        rank = np.full((width, m), NEVER, dtype=np.int32)
        i, j = np.nonzero(alive[1:])
        rank[i, j] = self._ranks(sym[i, j], sym[i + 1, j], key[j], i, i + 1, i + 2)
        for x in (alive, sym, stop, before):
            x.shape = -1
        live = np.arange(m)
        while True:
            best = rank.min(axis=0)
            col = np.flatnonzero(best < NEVER)
            if not len(col):
                break
            best = best[col]
            if len(col) < 0.8 * len(live):
                rank, live, col = rank[:, col], live[col], np.arange(len(col))
            row = live[col]
            at, piece = (best & 63).astype(np.int64), self.of_order[best >> 6]
            here = at * m + row
            middle = stop[here]
            gone = middle * m + row
            end = stop[gone]
            after = end * m + row
            sym[here], stop[here], alive[gone], before[after] = piece, end, False, at
            rank[middle, col] = NEVER
            left = before[here]
            ok = np.flatnonzero(left >= 0)
            left = left[ok]
            a, b = np.concatenate([piece, sym[left * m + row[ok]]]), np.concatenate([sym[after], piece[ok]])
            start, owner = np.concatenate([at, left]), np.concatenate([col, col[ok]])
            k, half = key[live[owner]], np.concatenate([end, at[ok]])
            rank[start, owner] = self._ranks(a, b, k, start, half, np.concatenate([stop[after], end[ok]]))
        row, at = np.nonzero(np.ascontiguousarray(alive.reshape(width + 1, m).T))
        ids, owner = sym[at * m + row].astype(np.int64), unit[row]
        bare = ids >= len(self.v.pieces)
        if bare.any():
            char = code[first[row[bare]] + at[bare]]
            times = np.ones(len(ids), dtype=np.int64)
            times[bare] = 1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF)
            raw = np.frombuffer("".join(map(chr, char)).encode(), dtype=np.uint8)
            owner, wide = np.repeat(owner, times), np.repeat(bare, times)
            ids = np.repeat(ids, times)
            ids[wide] = raw.astype(np.int64) + self.v.byte0
        return owner, ids

    def _ranks(self, a: np.ndarray, b: np.ndarray, key: np.ndarray, start: np.ndarray, middle: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Priority and place of candidate merges, NEVER where there is none or it is skipped."""
        order = self.order_of(a, b)
        out = np.full(len(order), NEVER, dtype=np.int32)
        real = np.flatnonzero(order >= 0)
        if self.dropout > 0:
            real = real[~self.skipped(key[real], start[real], middle[real], stop[real])]
        out[real] = (order[real] << 6) | start[real]
        return out

    def agenda(self, unit: str, key: np.uint64) -> list[int]:
        """The same merges for one unit of any length, over a heap of candidates."""
        n = len(unit)
        sym = [int(self.of_char[ord(c)]) for c in unit]
        stop, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap: list[tuple[int, int, int, int, int]] = []

        def push(a: int, b: int) -> None:
            piece = self.pairs.get(sym[a] << 20 | sym[b])
            if piece is not None and not (self.dropout > 0 and self.skipped(np.array([key]), *(np.array([x]) for x in (a, b, stop[b])))[0]):
                heapq.heappush(heap, (int(self.v.order[piece]), a, b, stop[b], piece))

        for i in range(n - 1):
            push(i, i + 1)
        while heap:
            _, a, b, end, piece = heapq.heappop(heap)
            if not (alive[a] and b < n and alive[b] and stop[a] == b and stop[b] == end):
                continue
            sym[a], stop[a], alive[b] = piece, end, False
            if end < n:
                before[end] = a
                push(a, end)
            if before[a] >= 0:
                push(before[a], a)
        out: list[int] = []
        for i in range(n):
            if alive[i]:
                out += [sym[i]] if sym[i] < len(self.v.pieces) else [self.v.byte0 + x for x in unit[i].encode("utf-8", "surrogatepass")]
        return out

    def encode(self, texts: pa.Array, variant: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, ids end to end)."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        runs = pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")).to_numpy(zero_copy_only=False)
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(texts, " ")
        if runs.any():  # of a run of blanks, all belong to the unit that follows
            rows = parts.to_pylist()
            for i in np.flatnonzero(runs):
                rows[i] = [u[1:] for u in re.findall(" +[^ ]*", " " + texts[int(i)].as_py())]
            parts = pa.array(rows, pa.large_list(pa.large_string()))
        counts = np.diff(parts.offsets.to_numpy())
        coded = parts.flatten().dictionary_encode()
        unit = coded.indices.to_numpy().astype(np.int64)
        words = coded.dictionary
        doc = np.repeat(np.arange(len(counts)), counts)
        keep = ~empty[doc]
        doc, unit = doc[keep], unit[keep]
        most = int(variant.max(initial=0)) + 1
        code = unit * most + variant[doc]
        held = np.zeros(len(words) * most, dtype=bool)
        held[code] = True
        pair = np.flatnonzero(held)
        back = (np.cumsum(held) - 1)[code]
        ends, raw = flat(self._stored(words.take(pa.array(pair // most)), pair % most).take(pa.array(back)))
        total = np.bincount(doc, np.diff(ends) // 4, minlength=len(counts)).astype(np.int64)
        return total, raw.view("<u4")

    def _stored(self, words: pa.Array, variant: np.ndarray) -> pa.Array:
        """Packed ids of units under their variants; the store keeps what earlier batches had, to a bound."""
        tags = pa.array([f" {v}" for v in range(int(variant.max(initial=0)) + 1)], pa.large_string())
        keys = pc.binary_join_element_wise(words, tags.take(pa.array(variant)), pa.scalar("", pa.large_string()))
        found = pc.index_in(keys, value_set=self.known)
        new = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
        at = pc.fill_null(found, 0).to_numpy().astype(np.int64)
        known, packed = self.known, self.packed
        if len(new):
            at[new] = len(known) + np.arange(len(new))
            take = pa.array(new)
            known = pa.concat_arrays([known, keys.take(take)])
            packed = pa.concat_arrays([packed, self._packed(*self.encode_units(words.take(take), variant[new]))])
        if len(known) > self.most:
            again = np.unique(at[at < len(self.known)])
            stay = pa.array(np.concatenate([again, at[new][: max(0, self.most // 2 - len(again))]]))
            self.known, self.packed = known.take(stay), packed.take(stay)
        else:
            self.known, self.packed = known, packed
        return packed.take(pa.array(at))

    @staticmethod
    def _packed(n: np.ndarray, ids: np.ndarray) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(n) * 4]).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u4"))])

    def clear(self) -> None:
        self.known, self.packed = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def decode(self, counts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of each text, bytes end to end), without the implied first blank."""
        sums, data = flat(self.parts.take(pa.array(ids)))
        ends = np.cumsum(counts)
        length = sums[ends] - sums[ends - counts]
        drop = (np.cumsum(length) - length)[length > 0]
        return np.maximum(length - 1, 0), np.delete(data, drop)

    def unpacked(self, packed: Sequence[bytes | None]) -> list[bytes]:
        """The texts' bytes of packed ids."""
        rows = [np.frombuffer(x or b"", dtype="<u4") for x in packed]
        n, data = self.decode(np.array([len(r) for r in rows], dtype=np.int64), np.concatenate([*rows, np.zeros(0, dtype="<u4")]).astype(np.int64))
        raw = data.tobytes()
        return [raw[e - k : e] for e, k in zip(np.cumsum(n).tolist(), n.tolist(), strict=True)]


def slot(keys: np.ndarray, factor: int, bits: int) -> np.ndarray:
    return ((keys * np.uint64(factor)) >> np.uint64(64 - bits)).astype(np.int64)


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(where the values end, from 0 on, all their bytes) of a large string or binary array without nulls."""
    if not len(array):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    _, ends, data = array.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    return ends - ends[0], data


def checksums(ends: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 and Adler-32 of each value: a byte of all values at a time, one by one where they are long."""
    size = np.diff(ends)
    order = np.argsort(-np.minimum(size, WIDE + 1), kind="stable")
    long, size = order[: np.count_nonzero(size > WIDE)], size[order]
    order, size, start = order[len(long) :], size[len(long) :], ends[order[len(long) :]]
    crc = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    low, high = np.ones(len(order), dtype=np.uint32), np.zeros(len(order), dtype=np.uint32)
    for k in range(int(size.max(initial=0))):
        n = np.searchsorted(-size, -k)
        byte = data[start[:n] + k]
        crc[:n] = CRC[(crc[:n] ^ byte) & 0xFF] ^ (crc[:n] >> 8)
        low[:n] += byte
        high[:n] += low[:n]
    out = np.zeros((2, len(ends) - 1), dtype=np.uint64)
    out[0, order], out[1, order] = ~crc, (high % 65521) << 16 | low % 65521
    for j in long:
        raw = data[ends[j] : ends[j + 1]].tobytes()
        out[:, j] = zlib.crc32(raw), zlib.adler32(raw)
    return out[0], out[1]


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0]+size[0]-1, start[1] .. and so on."""
    out = np.repeat(start - (np.cumsum(size) - size), size)
    out += np.arange(len(out))
    return out


#: The last coder of a Python worker, by vocabulary, dropout and seed.
_CODER: dict[tuple, Coder] = {}


def _worker_coder(name: tuple, vocabulary: Vocabulary, dropout: float, seed: int) -> Coder:
    """One coder for each Python worker, kept between tasks of the same vocabulary and settings."""
    if name not in _CODER:
        _CODER.clear()
        _CODER[name] = Coder(vocabulary, dropout, seed)
    return _CODER[name]


def encode(documents: DataFrame, vocabulary: Vocabulary, dropout: float = 0.1, seed: int = 1, variants: int = 4, keep: Sequence[str] = ("doc_id",), key: str = "doc_id", text: str = "text", verify: bool = False) -> DataFrame:
    """(keep..., n_bytes, n_pieces, ids): ids as little-endian unsigned 32-bit numbers in a binary column.

    verify: adds ``lossless``, whether decoding the packed ids gives back the text's bytes. Other columns of documents
    stay out, whatever their names.
    """
    bounded(documents.sparkSession)
    name = (vocabulary.digest(), dropout, seed)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _worker_coder(name, vocabulary, dropout, seed)
        try:
            for b in by_size(batches, len(keep), 1_000_000):
                texts, variant = b.column(len(keep)), b.column(len(keep) + 1).to_numpy(zero_copy_only=False).astype(np.int64)
                n, ids = coder.encode(texts, variant)
                raw = ids.astype("<u4").tobytes()
                ends = np.cumsum(n) * 4
                packed = [raw[e - 4 * k : e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                made = [*b.columns[: len(keep)], size, pa.array(n), pa.array(packed, pa.binary())]
                if verify:
                    back = coder.unpacked(packed)
                    made.append(pa.array([x == (y or "").encode("utf-8", "surrogatepass") for x, y in zip(back, texts.to_pylist(), strict=True)]))
                yield pa.RecordBatch.from_arrays(made, [*keep, "n_bytes", "n_pieces", "ids", *["lossless"] * verify])
        finally:
            coder.clear()

    kept = ", ".join(f"`{k}` {documents.schema[k].dataType.simpleString()}" for k in keep)
    variant = F.pmod(F.xxhash64(F.col(key)), F.lit(variants)).alias("_variant")
    schema = f"{kept}, n_bytes long, n_pieces long, ids binary{', lossless boolean' if verify else ''}"
    return documents.select(*keep, F.col(text).alias("_text"), variant).mapInArrow(releasing(run), schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary, keep: Sequence[str] = ("doc_id",), column: str = "ids") -> DataFrame:
    """(keep..., text): the texts of a column of packed ids; null counts as no ids."""
    bounded(encoded.sparkSession)
    name = (vocabulary.digest(), 0.0, 0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _worker_coder(name, vocabulary, 0.0, 0)
        for b in by_size(batches, len(keep)):
            texts = [x.decode("utf-8", "surrogatepass") for x in coder.unpacked(b.column(len(keep)).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(texts, pa.string())], [*keep, "text"])

    kept = ", ".join(f"`{k}` {encoded.schema[k].dataType.simpleString()}" for k in keep)
    return encoded.select(*keep, F.col(column).alias("_ids")).mapInArrow(releasing(run), f"{kept}, text string")
