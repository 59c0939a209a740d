"""Toxicity: a linear-chain conditional random field tags toxic spans.

Labels mark whole documents. Tokens are labelled from them: in a toxic document those tokens whose form, or the first
or last letters of it, occurs far more often in toxic documents than in others; in clean documents none. The field
(two tags, hashed features of each token's form, transition weights) is fitted on these sequences by gradient ascent.
Forward-backward marginals over every token of a whole text give the offending offsets, and are aggregated to a
document score by a small logistic model.

Training uses a sample of at most ``Config.toxic`` + ``Config.clean`` labelled documents, those with the lowest keyed
hash of their id, and of those as many as ``Config.bytes`` of text hold; all else runs over all documents. Null and
empty texts have no tokens and score as documents without any offence. Copies score alike. No column but the text
enters a score. Of an id with several texts all train under its label; an id with several labels counts under the
lowest. Rows with a null id are scored like others and never train. Extra columns stay out unless ``keep`` names them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, by_size, releasing, whole
from .pieces import mixed


@dataclass(frozen=True)
class Config:
    """toxic, clean: most documents of either label that training takes; bytes: of text in all; bits: of the feature hash."""

    toxic: int = 1200
    clean: int = 1800
    bytes: int = 64_000_000
    bits: int = 18
    odds: float = 2.3
    least: int = 4
    epochs: int = 40
    rate: float = 0.15
    ridge: float = 2e-3
    stretch: int = 256
    chunk: int = 200_000
    seed: int = 11


@dataclass(frozen=True)
class Model:
    """weights: of the features for tag 1; chain: log potentials [from, to]; head: logistic weights of the score."""

    weights: np.ndarray
    chain: np.ndarray
    head: np.ndarray
    bits: int


#: What stands around a token's form.
EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
#: Lengths of the first and last letters that are features; the form itself is the first column.
FIRST, LAST = (3, 4, 5, 6, 7), (3, 4, 5, 6)


def features(words: Sequence[str], bits: int) -> np.ndarray:
    """tokens x features: hashes of a token's form (without case and outer punctuation) and of the form's first and last
    letters; -1 where there are none: a form has no beginning as long as itself, an empty one has nothing."""
    out = np.full((len(words), 1 + len(FIRST) + len(LAST)), -1, dtype=np.int32)
    forms = pc.utf8_lower(pc.replace_substring_regex(pa.array(words, pa.string()), EDGES, ""))
    size = pc.utf8_length(forms).to_numpy(zero_copy_only=False).astype(np.int64)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    size = size[full]
    letters = np.frombuffer("".join(forms.to_pylist()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    value = mixed(letters.astype(np.uint64) + np.uint64(1))
    start = np.cumsum(size) - size
    power = np.cumprod(np.full(max(int(size.max()), max(FIRST)), 0xD6E8FEB86659FD93, dtype=np.uint64))

    def hashed(sums: np.ndarray, kind: int) -> np.ndarray:
        return (mixed(sums + np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(64 - bits)).astype(np.int32)

    place = np.arange(len(letters)) - np.repeat(start, size)
    out[full, 0] = hashed(np.add.reduceat(value * power[place], start), 0)
    for column, lengths, first, step in ((1, FIRST, start, 1), (1 + len(FIRST), LAST, start + size - 1, -1)):
        sums = np.zeros(len(full), dtype=np.uint64)
        for n in range(1, max(lengths) + 1):
            own = size >= n
            sums[own] += value[first[own] + step * (n - 1)] * power[n - 1]
            if n in lengths:
                own = size > n
                out[full[own], column + lengths.index(n)] = hashed(sums[own], column + n)
    return out


def tokenized(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(tokens per text, the tokens as indices, distinct tokens); tokens are what white space parts."""
    parts = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    counts = np.diff(parts.offsets.to_numpy())
    flat = parts.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(counts)), counts)[full]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return np.bincount(owner, minlength=len(counts)), coded.indices.to_numpy(), coded.dictionary.to_pylist()


def emissions(words: Sequence[str], weights: np.ndarray, bits: int) -> np.ndarray:
    held = features(words, bits)
    return np.where(held >= 0, weights[np.maximum(held, 0)], 0).sum(axis=1, dtype=np.float64)


#: Sequences of more tokens than twice this are taken in stretches of it.
LEAP = 512


def forward_backward(e: np.ndarray, counts: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log odds of the forward messages, of the backward messages) for each token of the sequences laid end to end.

    e: log odds of tag 1 by the token alone. All sequences advance together, the longest first. Long ones are cut into
    stretches: what a stretch makes of any message is a 2 x 2 matrix, so the messages between stretches are found
    first, stretch by stretch, and then all stretches advance together.
    """
    if not len(counts) or counts.max() <= 2 * LEAP:
        return _messages(e, counts, chain)
    pieces = np.maximum(-(-counts // LEAP), 1)
    owner = np.repeat(np.arange(len(counts)), pieces)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lengths = np.minimum(counts[owner] - place * LEAP, LEAP)
    starts = np.cumsum(lengths) - lengths
    ahead, behind = _transfers(e, starts, lengths, place == 0, chain)
    before, after = np.full(len(owner), np.nan), np.zeros(len(owner))
    first = np.cumsum(pieces) - pieces
    a = np.exp(chain)
    for k in range(1, int(pieces.max())):
        at = first[pieces > k] + k
        before[at] = _moved(ahead[at - 1], np.where(np.isnan(before[at - 1]), e[starts[at - 1]], before[at - 1]))
        at = (first + pieces)[pieces > k] - 1 - k
        # the message into the last token of a stretch comes over the first token of the next
        x = np.exp(np.clip(e[starts[at + 1]] + _moved(behind[at + 1], after[at + 1]), -60, 60))
        after[at] = np.log((a[1, 0] + a[1, 1] * x) / (a[0, 0] + a[0, 1] * x))
    return _messages(e, lengths, chain, before, after)


def _moved(m: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Log odds r under the matrices m (n x 2 x 2), which act on (odds, 1)."""
    x = np.exp(np.clip(r, -60, 60))
    return np.log(np.maximum(m[:, 0, 0] * x + m[:, 0, 1], 1e-300) / np.maximum(m[:, 1, 0] * x + m[:, 1, 1], 1e-300))


def _transfers(e: np.ndarray, starts: np.ndarray, lengths: np.ndarray, opens: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(what each stretch makes of the forward message before it, of the backward message of its last token), as matrices.

    A stretch that opens its sequence starts from its first token's own odds, which its matrix leaves out. Backward, a
    matrix leads from the last token's message to the first token's.
    """
    a = np.exp(chain)
    out = []
    for back in (False, True):
        m = np.broadcast_to(np.eye(2), (len(starts), 2, 2)).copy()
        for t in range(int(lengths.max())):
            own = np.flatnonzero((lengths > t) & (~opens | (t > 0)) if not back else lengths > t + 1)
            if not len(own):
                continue
            odds = e[starts[own] + t] if not back else e[starts[own] + lengths[own] - 1 - t]
            up, down = np.exp(np.minimum(odds, 0)), np.exp(-np.maximum(odds, 0))  # odds as a quotient without overflow
            step = np.empty((len(own), 2, 2))
            if back:
                step[:, 0, 0], step[:, 0, 1], step[:, 1, 0], step[:, 1, 1] = a[1, 1] * up, a[1, 0] * down, a[0, 1] * up, a[0, 0] * down
            else:
                step[:, 0, 0], step[:, 0, 1], step[:, 1, 0], step[:, 1, 1] = a[1, 1] * up, a[0, 1] * up, a[1, 0] * down, a[0, 0] * down
            got = step @ m[own]
            m[own] = got / got.max(axis=(1, 2), keepdims=True)
        out.append(m)
    return out[0], out[1]


def _messages(e: np.ndarray, counts: np.ndarray, chain: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The messages of sequences that advance together. before: forward log odds ahead of the first token, nan where there
    are none; after: backward log odds of the last token."""
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    longest = counts[order]
    a = np.exp(chain)
    forward, backward = np.zeros_like(e), np.zeros_like(e)
    if not len(e):
        return forward, backward
    # how many sequences are longer than t
    active = np.searchsorted(-longest, -np.arange(longest[0] + 1), side="left")
    r = None if before is None else before[order]
    for t in range(longest[0]):
        at = starts[: active[t]] + t
        if r is None:
            r = e[at]
        else:
            x = np.exp(np.minimum(r[: len(at)], 60))
            moved = e[at] + np.log((a[0, 1] + a[1, 1] * x) / (a[0, 0] + a[1, 0] * x))
            r = moved if t else np.where(np.isnan(x), e[at], moved)
        forward[at] = r
    if after is not None:
        full = longest > 0
        backward[starts[full] + longest[full] - 1] = after[order][full]
    for t in range(longest[0] - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        x = np.exp(np.minimum(e[at + 1] + backward[at + 1], 60))
        backward[at] = np.log((a[1, 0] + a[1, 1] * x) / (a[0, 0] + a[0, 1] * x))
    return forward, backward


def marginals(e: np.ndarray, counts: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """P(tag 1) of each token."""
    f, b = forward_backward(e, counts, chain)
    return 1 / (1 + np.exp(-np.clip(f + b, -60, 60)))


def summary(m: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each sequence: 1, offences up to one, the next one, the log of the rest, the log of the expected count.

    An offence counts by how far its marginal lies from a quarter to three quarters, so that the faint marginals of
    long texts do not add up to one.
    """
    ends = np.cumsum(counts)

    def total(x: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(x)])
        return np.maximum(sums[ends] - sums[ends - counts], 0)

    n = total(np.clip(2 * m - 0.5, 0, 1))
    steps = [np.minimum(n, 1), np.clip(n - 1, 0, 1), np.log1p(np.maximum(n - 2, 0))]
    return np.column_stack([np.ones(len(counts)), *steps, np.log(total(m) + 0.05) / 10])


def _labelled_tokens(counts: np.ndarray, ids: np.ndarray, held: np.ndarray, toxic: np.ndarray, c: Config) -> np.ndarray:
    """Which distinct tokens count as offences in toxic documents, by document frequencies of their features."""
    ends = np.cumsum(counts)
    seen = np.zeros((2, 1 << c.bits), dtype=np.int64)
    for i in range(len(counts)):
        found = np.unique(held[np.unique(ids[ends[i] - counts[i] : ends[i]])])
        seen[int(toxic[i]), found[found >= 0]] += 1
    n0, n1 = seen
    odds = np.log((n1 + 0.5) / (toxic.sum() + 1)) - np.log((n0 + 0.5) / ((~toxic).sum() + 1))
    strong = (odds >= c.odds) & (n1 >= c.least)
    return (strong[np.maximum(held, 0)] & (held >= 0)).any(axis=1)


def fit(texts: Sequence[str], toxic: Sequence[bool], c: Config = Config(), share: float | None = None) -> Model:
    """Fits the field and the score on labelled texts. share: of toxic documents where the texts come from, if it is another."""
    toxic = np.asarray(toxic, dtype=bool)
    counts, ids, words = tokenized(pa.array(texts, pa.string()))
    if not len(ids) or toxic.all() or not toxic.any():
        rate = (toxic.sum() + 0.5) / (len(toxic) + 1)
        return Model(np.zeros(1 << c.bits, dtype=np.float32), np.zeros((2, 2)), np.array([np.log(rate / (1 - rate)), 0, 0, 0, 0]), c.bits)
    ids = ids.astype(np.int32)
    held = features(words, c.bits)
    bad_word = _labelled_tokens(counts, ids, held, toxic, c)
    owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    y = bad_word[ids] & toxic[owner]
    # toxic documents in which no token is marked tell nothing of their tokens
    known = ~toxic | (np.bincount(owner, y, minlength=len(counts)) > 0)
    y, wid = y[known[owner]], ids[known[owner]]
    del owner
    # long texts train in stretches, all of them
    lengths = np.concatenate([[c.stretch] * (n // c.stretch) + [n % c.stretch] * (n % c.stretch > 0) for n in counts[known].tolist()]).astype(np.int64)
    ends = np.cumsum(lengths)
    cuts = np.searchsorted(ends, np.arange(0, ends[-1], c.chunk), side="right")
    chunks = [(int(a), int(b)) for a, b in zip(cuts, [*cuts[1:], len(lengths)], strict=True) if b > a]
    size = (held >= 0).sum(axis=1)
    flat = held[held >= 0]
    of = np.repeat(np.arange(len(words), dtype=np.int32), size)
    del held
    theta, chain = np.zeros(1 << c.bits), np.array([[0.0, -2.0], [-1.0, -1.0]])
    bias = -4.0
    moments = [np.zeros(x) for x in (1 << c.bits, 1 << c.bits, 4, 4)]
    scale = max(float(y.sum()), 1.0)
    for step in range(1, c.epochs + 1):
        word_e = np.bincount(of, theta[flat], minlength=len(words)) + bias * (size > 0)
        by_word, h = np.zeros(len(words)), np.zeros(4)
        for a, b in chunks:
            at = slice(ends[a] - lengths[a], ends[b - 1])
            surplus, pairs = _gradient(word_e[wid[at]], y[at].astype(np.float64), lengths[a:b], chain)
            by_word += np.bincount(wid[at], surplus, minlength=len(words))
            h += pairs
        g = np.bincount(flat, by_word[of], minlength=1 << c.bits) / scale - c.ridge * theta
        for k, (x, grad) in enumerate(((theta, g), (chain.reshape(-1), h / scale))):
            u, v = moments[2 * k], moments[2 * k + 1]
            u += 0.1 * (grad - u)
            v += 0.01 * (grad * grad - v)
            x += c.rate * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights = theta.astype(np.float32)
    full = np.bincount(of, weights[flat].astype(np.float64), minlength=len(words)) + bias * (size > 0)
    x = summary(marginals(full[ids], counts, chain), counts)
    have = toxic.mean()
    weight = np.where(toxic, (share or have) / have, (1 - (share or have)) / (1 - have))
    head = _logistic(x, toxic, weight)
    # the bias of each token goes to the chain, as it goes with every entry of tag 1
    return Model(weights, chain + np.array([[0.0, bias], [0.0, bias]]), head, c.bits)


def _gradient(e: np.ndarray, y: np.ndarray, lengths: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label minus marginal of each token; counts of tag pairs minus their expectation) over sequences end to end."""
    f, b = forward_backward(e, lengths, chain)
    inner = np.ones(len(y), dtype=bool)
    inner[np.cumsum(lengths) - lengths] = False
    inner = np.flatnonzero(inner)
    was, now = y[inner - 1], y[inner]
    seen = np.array([np.sum((was == i) & (now == j)) for i in (0, 1) for j in (0, 1)], dtype=float)
    # forward of the first, transition, emission and backward of the second, relative to tags 0 and 0
    before, ahead = f[inner - 1], e[inner] + b[inner]
    logs = [np.zeros(len(inner))] + [chain[i, j] - chain[0, 0] + i * before + j * ahead for i, j in ((0, 1), (1, 0), (1, 1))]
    top = np.maximum.reduce(logs)
    p = [np.exp(x - top) for x in logs]
    norm = sum(p)
    return y - 1 / (1 + np.exp(-np.clip(f + b, -60, 60))), seen - np.array([np.sum(x / norm) for x in p])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Newton's method with a small ridge on weighted rows."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.1 * w)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
    return w


def bucket(key: Column) -> Column:
    """crc32 of the id as text, modulo 5: rows with 0 are held out of training."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def train(documents: DataFrame, labels: DataFrame, c: Config = Config(), key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fits on a bounded sample of the labelled rows that are not held out."""
    known = labels.select(F.col(key).alias("_k"), F.col(label).alias("_y")).where(F.col("_y").isin(0, 1) & (bucket(F.col("_k")) != 0))
    known = known.groupBy("_k").agg(F.min("_y").alias("_y"))
    order = F.md5(F.concat(F.lit(f"{c.seed}:"), F.col("_k").cast("string")).cast("binary"))
    chosen = [r for y, n in ((1, c.toxic), (0, c.clean)) for r in known.where(F.col("_y") == y).orderBy(order, "_k").limit(n).collect()]
    if not chosen:
        return fit([], [], c)
    sizes = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    share = sizes.get(1, 0) / sum(sizes.values())
    texts = documents.select(F.col(key).alias("_k"), whole(text).alias("_t"))
    held = texts.join(F.broadcast(_ids(documents, labels, key, chosen)), "_k").groupBy("_k").agg(F.sum(F.octet_length("_t")).alias("n"), F.first("_y").alias("_y"))
    held = {r["_k"]: r["n"] for r in held.collect()}  # at most c.toxic + c.clean ids
    left, taken = {0: c.bytes // 2, 1: c.bytes // 2}, []
    for r in chosen:  # in the order of their hash, each label up to half of the bytes
        n = held.get(r["_k"], 0)
        if n <= left[r["_y"]]:
            left[r["_y"]] -= n
            taken.append(r)
    rows = texts.join(F.broadcast(_ids(documents, labels, key, taken)), "_k").select("_t", "_y").toPandas()
    rows = rows.sort_values(["_t", "_y"], kind="stable")
    return fit(rows["_t"].tolist(), rows["_y"].to_numpy() == 1, c, share)


def _ids(documents: DataFrame, labels: DataFrame, key: str, chosen: Sequence) -> DataFrame:
    kind = labels.schema[key].dataType.simpleString()
    return documents.sparkSession.createDataFrame([(r["_k"], int(r["_y"])) for r in chosen], f"_k {kind}, _y int")


SPANS = "array<struct<start:int,stop:int,p:double>>"


def _offsets(text: str, marked: dict[int, float]) -> list[dict]:
    """Code point offsets of the marked tokens; neighbours are one span."""
    out: list[dict] = []
    last = -2
    for i, t in enumerate(re.finditer(r"\S+", text)):
        if i in marked:
            if i == last + 1:
                out[-1]["stop"], out[-1]["p"] = t.end(), max(out[-1]["p"], marked[i])
            else:
                out.append({"start": t.start(), "stop": t.end(), "p": marked[i]})
            last = i
    return out


def tag(documents: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",), text: str = "text", spans: bool = True, threshold: float = 0.5) -> DataFrame:
    """(keep..., score, n_toxic, spans): the document score, tokens tagged, and their offsets (null without spans)."""
    bounded(documents.sparkSession)
    kinds = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, len(keep), 1_000_000):
            texts = b.column(len(keep))
            counts, ids, words = tokenized(texts)
            e = emissions(words, model.weights, model.bits)[ids] if words else np.zeros(0)
            m = marginals(e, counts, model.chain)
            score = 1 / (1 + np.exp(-np.clip(summary(m, counts) @ model.head, -30, 30)))
            hits = np.flatnonzero(m >= threshold)
            ends = np.cumsum(counts)
            doc = np.searchsorted(ends, hits, side="right")
            n = np.bincount(doc, minlength=len(counts))
            found: list[list] = [[] for _ in range(len(counts))]
            if spans:
                at = np.cumsum(n) - n  # hits are in the order of documents
                for i in np.flatnonzero(n).tolist():
                    own = hits[at[i] : at[i] + n[i]]
                    found[i] = _offsets(texts[i].as_py(), dict(zip((own - (ends[i] - counts[i])).tolist(), m[own].tolist(), strict=True)))
            arrays = [*b.columns[: len(keep)], pa.array(score), pa.array(n, pa.int32()), pa.array(found if spans else [None] * len(counts), kinds)]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "score", "n_toxic", "spans"])

    kept = ", ".join(f"`{k}` {documents.schema[k].dataType.simpleString()}" for k in keep)
    return documents.select(*keep, F.col(text).alias("_text")).mapInArrow(releasing(run), f"{kept}, score double, n_toxic int, spans {SPANS}")
