"""HTML extraction by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score by the log odds that what surrounds them holds content, tags score
negative; both are learned from labelled pages (``html_pages``). One linear scan finds the contiguous run with the
highest sum, which is the content region.

1. Containers. Every element has features: its name, and the words of its class, id or role, whole or in parts; each
   counts apart for elements that hold a third of the page's words or not, whose words are mostly links or not, and that
   stand in content, in boilerplate or in neither. The sum of their weights is the element's score; scores of outer
   containers carry over, wholly where they are negative and by half where they are positive. An element that holds
   the page's article has no score of its own, whatever its class.
2. Words in a container score as it does; loose words by their block, its length, links, and whether the page has a
   container of content at all.
3. Tags cost a little; a tag that opens boilerplate costs the more, the less often content goes on behind its like.
4. In the region, words of boilerplate containers (a negative score) are left out, and on pages with a container of
   content those outside of one. Character references are decoded and blocks are joined by a blank line.

Null html counts as empty; a page without a positive run gives an empty text. Cut off and unclosed markup is read as
browsers do: an unfinished tag is dropped, an end tag closes what was opened inside it. Every page is judged by
itself, so repeated rows and ids give repeated results. Of equal runs the first is taken. Extra columns stay out.
Time is linear in the length of a page, however deep it is nested.
"""

from __future__ import annotations

import bisect
import html
import itertools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, by_size, releasing
from .html_pages import Page, labelled

#: One piece of markup or the text up to the next.
PIECE = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|[^<]+|<""", re.S
)
MARK = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
#: Elements whose inside is no markup and never content.
RAW = {"title", "textarea", "script", "style", "noscript", "template", "iframe", "xmp", "svg", "math", "object", "canvas", "select", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Often left unclosed: they mark blocks and are no containers.
OPEN = {"p", "li", "td", "th", "tr", "dt", "dd", "option"}
#: Never content by what they are for.
CONTROLS = {"button", "dialog", "menu"}
#: Containers that say nothing by their name; and those that say nothing beside marks.
PLAIN = {"html", "body", "div", "section", "ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "caption", "center", "fieldset", "details", "summary"}
PLAIN |= {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "blockquote", "pre", "figure", "figcaption", "address", "picture", "video", "audio"}
MAIN = {"article", "main"}


@dataclass(slots=True, eq=False)
class Element:
    """first, stop: its pieces. holds: whether an article is in it. words, linked, main: how many, those in links, those in
    articles. score: of its context."""

    name: str
    marks: tuple[str, ...]
    outer: Element | None
    first: int
    stop: int = 0
    holds: bool = False
    words: int = 0
    linked: int = 0
    main: int = 0
    score: float = 0.0
    known: bool = False


@dataclass(slots=True)
class Piece:
    """kind: word for the text between tags, tag or block for markup. n: words; block: the block that a text is in; run: words of that block."""

    kind: str
    value: str
    element: Element | None
    link: bool
    at: int
    n: int = 0
    block: str = ""
    run: int = 0
    opens: Element | None = None


def _marks(attributes: str) -> tuple[str, ...]:
    return tuple(w for m in MARK.findall(attributes) for w in m.strip("\"'").lower().replace("_", "-").split())


def walk(page: str) -> tuple[list[Piece], list[Element]]:
    """(pieces, elements, outer ones first)."""
    pieces: list[Piece] = []
    elements: list[Element] = []
    stack: list[Element] = []
    articles: list[Element] = []
    opened: Counter[str] = Counter()  # names in the stack
    at, block, run = 0, "", []

    def ended() -> None:
        n = sum(p.n for p in run)
        for p in run:
            p.run = n
        run.clear()

    while at < len(page):
        m = PIECE.match(page, at)
        begin, at = at, m.end()
        name = m[2]
        if name is None:
            # a bare < is text, but at the very end it is a tag that was cut off
            if page[begin] != "<" or at - begin == 1 and at < len(page):
                p = Piece("word", m[0], stack[-1] if stack else None, opened["a"] > 0, begin, len(m[0].split()), block)
                pieces.append(p)
                run.append(p)
            continue
        name = name.lower()
        kind = "tag" if name in INLINE else "block"
        opens = None
        if kind == "block":
            ended()
            block = "" if m[1] else name
        if m[1]:
            if opened[name]:
                while True:
                    e = stack.pop()
                    opened[e.name] -= 1
                    e.stop = len(pieces)
                    if e.name == name:
                        break
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)" + (r"|(?=<body\b)" if name == "head" else ""), re.I).search(page, at)
            at = end.end() if end else len(page)
        elif name not in VOID and not m[3].rstrip().endswith("/") and name not in OPEN:
            e = opens = Element(name, _marks(m[3]) if m[3] and name not in ("html", "body") else (), stack[-1] if stack else None, len(pieces))
            if name in MAIN and not any("comment" in x for x in e.marks):
                articles.append(e)
                over = e.outer
                while over and not over.holds:
                    over.holds = True
                    over = over.outer
            stack.append(e)
            opened[name] += 1
            elements.append(e)
        pieces.append(Piece(kind, name, stack[-1] if stack else None, opened["a"] > 0, begin, opens=opens))
    ended()
    for e in stack:
        e.stop = len(pieces)
    words = [0, *itertools.accumulate(p.n for p in pieces)]
    linked = [0, *itertools.accumulate(p.n if p.link else 0 for p in pieces)]
    gained = [0] * (len(pieces) + 1)  # words of an article where it ends, of outermost ones only
    reached = 0
    for e in articles:
        if e.first >= reached:
            reached = e.stop
            gained[e.stop] = words[e.stop] - words[e.first]
    main = list(itertools.accumulate(gained))
    for e in elements:
        e.words, e.linked = words[e.stop] - words[e.first], linked[e.stop] - linked[e.first]
        e.main = main[e.stop] - main[e.first] if e.holds else 0
    return pieces, elements


@dataclass(frozen=True)
class Weights:
    """containers: log odds by feature; gaps: cost of a tag that opens boilerplate; loose: of loose words; tags: of other tags."""

    containers: dict[str, float]
    gaps: dict[str, float]
    loose: dict[str, float]
    tags: dict[str, float]


#: Bound of a container's score, and what a positive one hands on.
MOST, CARRY = 4.0, 0.5


def _names(e: Element, known: dict[str, float] | None) -> list[str]:
    """The features of an element without their circumstances: marks that are not known go by their parts."""
    out = []
    for m in e.marks:
        whole = f"m:{m}"
        if known is None or whole in known:
            out.append(whole)
        if "-" in m and (known is None or whole not in known):
            out += [x for x in (f"p:{part}" for part in m.split("-")) if known is None or x in known]
    if e.name not in INLINE and e.name not in PLAIN and not (out and e.name in MAIN):
        out.append(f"e:{e.name}")
    return out


def _circumstances(e: Element, total: int) -> tuple[list[str], list[str]]:
    """(for names, for marks): from the most to the least particular, the last says nothing.

    What a name means depends most on what is around it, what a mark means on how much is in it.
    """
    outer = e.outer.score if e.outer else 0.0
    around = "in content" if outer > 0 else "in boilerplate" if outer < 0 else "free"
    size = "small" if 3 * e.words < total else "large"
    text = size if size == "small" or e.words >= 25 else "short"  # a page that is a form, or one with a form around it
    links = "links" if 2 * e.linked > e.words else "text"
    held = "|holds" if e.holds else "|"
    filled = f"{held}|{size}|{links}"
    return [f"{held}|{text}|{links}|{around}", f"{held}|{around}", held, ""], [f"{filled}|{around}", filled, f"{held}|{size}", held, ""]


def _looked_up(table: dict[str, float], name: str, how: Sequence[str], none: float = 0.0) -> float:
    """The weight under the most particular circumstances known; of a part not known in large elements, what parts are worth there."""
    for k, h in enumerate(how):
        if name + h in table:
            return table[name + h]
        if k == 1 and name[0] == "p" and "large" in h and "p" + h in table:
            return table["p" + h]
    return none


def _wraps(e: Element, total: int, main: int) -> bool:
    """Whether an element holds the page's article: half of the words in articles, and a sixth of all."""
    return e.holds and 2 * e.main >= main and 6 * e.main >= total


def _main(elements: Sequence[Element]) -> int:
    return max((e.main for e in elements if e.outer is None), default=0)


def _score(elements: Sequence[Element], total: int, w: dict[str, float]) -> None:
    """Sets the scores of elements, outer ones first."""
    main = _main(elements)
    for e in elements:
        outer = e.outer.score if e.outer else 0.0
        own = 0.0
        e.known = False
        if not _wraps(e, total, main):
            how = _circumstances(e, total)
            for name in _names(e, w):
                if name in w:
                    e.known = True
                    own += _looked_up(w, name, how[name[0] != "e"])
        if e.name in CONTROLS:
            own, e.known = -MOST, True
        if own == 0.0:
            e.score = outer
        else:
            e.score = max(-MOST, min(MOST, own + outer * (1.0 if outer < 0 else CARRY)))


def _loose_keys(p: Piece, has: bool) -> list[str]:
    base = f"{'with' if has else 'without'}|{'link' if p.link else 'text'}"
    size = "short" if p.run < 6 else "long"
    return [f"{base}|{p.block}|{size}", f"{base}|{p.block}", f"{base}|{size}", base]


def _of(p: Piece) -> float:
    return p.element.score if p.element else 0.0


def _has(pieces: Sequence[Piece], elements: Sequence[Element]) -> bool:
    """Whether the page has a container of content: an article, or one with as many words as are loose."""
    if any(e.name in MAIN and e.words and e.score > 0 for e in elements):
        return True
    held, loose = 0, 0
    for p in pieces:
        if p.n:
            score = _of(p)
            if score > 0:
                held += p.n
            elif score == 0 and not p.link:
                loose += p.n
    return held > 0 and held >= loose


def _steps(pieces: Sequence[Piece], has: bool, total: int, w: Weights) -> list[float]:
    out = []
    for p in pieces:
        score = _of(p)
        if p.kind == "word":
            if score < 0 or not p.n:
                out.append(0.0)
            elif score > 0:
                out.append(p.n * (max(score - 1, 0.2) if p.link else score))
            else:
                keys = _loose_keys(p, has)
                out.append(p.n * _looked_up(w.loose, keys[0], [""], _looked_up(w.loose, keys[1], [""], _looked_up(w.loose, keys[2], [""], w.loose.get(keys[3], 0.0)))))
        elif p.opens is not None and score < 0 and (p.opens.outer is None or p.opens.outer.score >= 0):
            how = _circumstances(p.opens, total)
            out.append(max([_looked_up(w.gaps, x, how[x[0] != "e"]) for x in _names(p.opens, w.containers) if x in w.gaps], default=-1.0))
        else:
            out.append(w.tags.get(p.value, -0.2) if score >= 0 else 0.0)
    return out


def best_run(steps: Sequence[float]) -> tuple[int, int]:
    """The contiguous run with the highest sum, the first of equal ones; (0, 0) if none is above zero."""
    best, run, start, span = 0.0, 0.0, 0, (0, 0)
    for i, step in enumerate(steps):
        if run <= 0:
            run, start = 0.0, i
        run += step
        if run > best:
            best, span = run, (start, i + 1)
    return span


def _odds(inside: float, outside: float) -> float:
    return math.log((inside + 0.5) / (outside + 0.5))


def learned(pages: Iterable[Page] | None = None, rounds: int = 3) -> Weights:
    """Weights from labelled pages; what surrounds a container depends on the scores, so they are counted in rounds."""
    return _default() if pages is None else _learned(list(pages), rounds)


@lru_cache(maxsize=1)
def _default() -> Weights:
    return _learned(list(labelled()), 3)


def _learned(pages: list[Page], rounds: int) -> Weights:
    seen = []
    for fragments in pages:
        pieces, elements = walk("".join(f for f, _ in fragments))
        ends = list(itertools.accumulate(len(f) for f, _ in fragments))
        labels = [fragments[bisect.bisect_right(ends, p.at)][1] for p in pieces]
        seen.append((pieces, elements, labels, sum(p.n for p in pieces)))
    weights: dict[str, float] = {}
    for _ in range(rounds):
        counts: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for pieces, elements, labels, total in seen:
            _score(elements, total, weights)
            own: dict[Element, list[int]] = defaultdict(lambda: [0, 0])
            main = _main(elements)
            for p, y in zip(pieces, labels, strict=True):
                e = p.element
                while e and not _names(e, None):
                    e = e.outer
                if p.n and e:
                    own[e][1 - y] += p.n
            for e, (good, bad) in own.items():
                if _wraps(e, total, main):
                    continue
                share = good / (good + bad)
                for name in _names(e, None):
                    for how in _circumstances(e, total)[name[0] != "e"]:
                        for key in (name + how, name[0] + how):
                            counts[key][0] += share
                            counts[key][1] += 1 - share
        # seen now and then; a whole mark often, as its parts say more of rare ones
        weights = {k: max(-MOST, min(MOST, _odds(*c))) for k, c in counts.items() if sum(c) >= 3 and sum(counts.get(k.partition("|")[0], c)) >= (8 if k.startswith("m:") else 3)}
    gaps: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    loose: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    tags: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for pieces, elements, labels, total in seen:
        _score(elements, total, weights)
        good = [i for i, (p, y) in enumerate(zip(pieces, labels, strict=True)) if y and p.n]
        first, last = (good[0], good[-1]) if good else (len(pieces), -1)
        has = _has(pieces, elements)
        for i, (p, y) in enumerate(zip(pieces, labels, strict=True)):
            between = first < i < last
            if p.kind == "word":
                if p.n and _of(p) == 0:
                    for k in _loose_keys(p, has):
                        loose[k][1 - y] += p.n
            elif p.opens is not None and _of(p) < 0 and (p.opens.outer is None or p.opens.outer.score >= 0):
                for name in _names(p.opens, weights):
                    for how in _circumstances(p.opens, total)[name[0] != "e"]:
                        gaps[name + how][1 - between] += 1
            elif _of(p) >= 0:
                tags[p.value][1 - between] += 1
    return Weights(
        weights,
        {k: max(-6.0, min(-0.1, _odds(*c))) for k, c in gaps.items() if sum(c) >= (3 if "|" in k else 1)},
        {k: max(-3.0, min(3.0, _odds(*c))) for k, c in loose.items() if sum(c) >= 5},
        {k: max(-0.3, min(-0.05, _odds(*c))) for k, c in tags.items()},
    )


def main_text(page: str | None, weights: Weights, scan: bool = True) -> str:
    """scan: False takes the whole page for the region; to see what the region decides."""
    pieces, elements = walk(page or "")
    total = sum(p.n for p in pieces)
    _score(elements, total, weights.containers)
    has = _has(pieces, elements)
    span = best_run(_steps(pieces, has, total, weights)) if scan else (0, len(pieces))
    blocks: list[str] = []
    held: list[str] = []

    def close() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            blocks.append(text)
        held.clear()

    for p in pieces[slice(*span)]:
        if p.kind == "word":
            score = _of(p)
            if score > 0 or score == 0 and not has:
                held.append(p.value)
        elif p.kind == "block":
            close()
        elif p.value in ("br", "img"):
            held.append(" ")
    close()
    return "\n\n".join(blocks)


def extract(pages: DataFrame, keep: Sequence[str] = ("page_id", "url"), column: str = "html", labelled: Iterable[Page] | None = None) -> DataFrame:
    """(keep..., text, n_chars): the main text of each page and its code points."""
    bounded(pages.sparkSession)
    weights = learned(labelled)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, len(keep), 1_000_000):
            texts = [main_text(x.as_py(), weights) for x in b.column(len(keep))]
            arrays = [*b.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "text", "n_chars"])

    kept = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keep)
    return pages.select(*keep, F.col(column).alias("_html")).mapInArrow(releasing(run), f"{kept}, text string, n_chars long")
