"""Text functions: tokenising, cleaning, features, detectors, sections."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(text: Column, words: list[str]) -> Column:
    """Whether any of the words is a substring."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def any_match(text: Column, patterns: list[str], flags: str = "") -> Column:
    return reduce(lambda a, b: a | b, (text.rlike(flags + p) for p in patterns))


def letters_tokens(text: str | Column) -> Column:
    """Words of the letters a-z only, in lower case; words that hold other letters, digits or _ give nothing."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(r"(?<![\p{L}\p{N}_])[a-z]++(?![\p{L}\p{N}_])"), F.lit(0))


def words(text: str | Column) -> Column:
    """What white space parts."""
    return F.regexp_extract_all(col(text), F.lit(r"\S+"), F.lit(0))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it: a one-element array binds it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def word_set(text: str | Column) -> Column:
    return F.array_distinct(words(F.lower(col(text))))


def keywords(text: str | Column) -> Column:
    """Letter tokens longer than two that are no stop words; repeats stay."""
    return F.filter(letters_tokens(text), lambda t: (F.length(t) > 2) & ~t.isin(K.STOP_WORDS))


def squeeze(text: str | Column) -> Column:
    return F.regexp_replace(col(text), r"(?U)\s+", " ")


def clean_chunk(text: str | Column) -> Column:
    """White space to one blank; characters beyond words and plain punctuation to a blank each; trimmed."""
    kept = r"""(?U)[^\w\s.,!?:;\-()\[\]"'/\\$%#@&*+=<>~`]"""
    return F.trim(F.regexp_replace(squeeze(text), kept, " "))


def clean_prompt(text: str | Column, longest: int = 800) -> Column:
    """White space to one blank; other characters deleted; cut with an ellipsis."""
    t = F.regexp_replace(F.trim(squeeze(text)), r"(?U)[^\w\s.,;:!?()\[\]{}\-]", "")
    return F.when(F.length(t) > longest, F.concat(F.substring(t, 1, longest), F.lit("..."))).otherwise(t)


def clean_page(text: str | Column) -> Column:
    """White space to one blank, trimmed; empty if three characters or fewer stay."""
    t = F.trim(squeeze(text))
    return F.when(F.length(t) > 3, t).otherwise("")


def normal_title(text: str | Column) -> Column:
    """Lower case, runs of other than words to one blank, trimmed."""
    return F.trim(squeeze(F.regexp_replace(F.lower(col(text)), r"(?U)[^\w\s]", " ")))


def content_features(text: str | Column) -> dict[str, Column]:
    t = col(text)
    return {
        "has_formulas": t.rlike("(?i)" + K.HAS_FORMULAS),
        "has_code": t.rlike("(?i)" + K.HAS_CODE),
        "has_citations": t.rlike(K.HAS_CITATIONS),
        "has_numbers": t.rlike("(?U)" + K.HAS_NUMBERS),
        "has_urls": t.rlike(K.HAS_URLS),
        "paragraph_count": F.size(F.filter(F.split(t, "\n\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != "")),
        "sentence_count": F.regexp_count(t, F.lit("[.!?]+")),
    }


def has_formulas(text: str | Column) -> Column:
    return any_match(col(text), K.FORMULA_MARKS)


def has_tables(text: str | Column) -> Column:
    """Three repetitions stand for three or more: a search finds the same texts, and Java's matcher does not recurse by word."""
    return any_match(col(text), [p.replace("{3,}", "{3}") for p in K.TABLE_MARKS], "(?i)")


def has_figures(text: str | Column) -> Column:
    return any_match(col(text), K.FIGURE_MARKS, "(?i)")


def language(text: str | Column) -> Column:
    """zh if there are more CJK characters than half as many as words of letters; else en."""
    t = col(text)
    cjk = F.regexp_count(t, F.lit("[\u4e00-\u9fff]"))
    english = F.size(F.filter(F.split(t, r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[A-Za-z]+$")))
    return F.when(cjk > english * 0.5, "zh").otherwise("en")


def section_of(line: str | Column) -> Column:
    """The section that a line starts, null if none: by how it begins."""
    t = F.trim(F.lower(col(line)))
    return F.coalesce(*(F.when(t.rlike(f"^({p})"), F.lit(s)) for s, p in K.SECTION_STARTS))


def heading_of(line: str | Column) -> Column:
    """The section whose heading a whole line of 3 to 100 characters is, null if none."""
    t = F.trim(col(line))
    found = F.coalesce(*(F.when(any_match(t, ps, "(?i)"), F.lit(s)) for s, ps in K.SECTION_LINES.items()))
    return F.when(F.length(t).between(3, 100), found)


def heading_confidence(line: str | Column, section: str | Column) -> Column:
    """0.5, and 0.2 for a number, 0.1 for upper or title case, 0.3 for the section's own word; 1 at most."""
    t, s = F.trim(col(line)), col(section)
    cased = t.rlike(r"\p{L}") & ((F.upper(t) == t) | t.rlike(r"^[^\p{L}]*(\p{Lu}\p{Ll}*[^\p{L}]+)*\p{Lu}\p{Ll}*[^\p{L}]*$"))
    own = ((s == "abstract") & F.contains(F.lower(t), F.lit("abstract"))) | ((s == "reference") & any_of(F.lower(t), ["reference", "bibliography"]))
    return F.least(F.lit(1.0), F.lit(0.5) + F.when(t.rlike(r"^\d+\.?\s*"), 0.2).otherwise(0.0) + F.when(cased, 0.1).otherwise(0.0) + F.when(own, 0.3).otherwise(0.0))


def title_of(text: str | Column) -> Column:
    """The first of the first twenty lines with 11 to 199 characters and none of the words that titles do not hold."""
    lines = F.transform(F.slice(F.split(col(text), "\n"), 1, 20), lambda x: F.trim(x))
    fits = F.filter(lines, lambda x: (F.length(x) > 10) & (F.length(x) < 200) & ~any_of(F.lower(x), K.NOT_TITLES))
    return F.coalesce(F.try_element_at(fits, F.lit(1)), F.lit("Unknown Title"))


def abstract_of(text: str | Column) -> Column:
    """Between the abstract's heading and the introduction, key words or an empty line; 2000 characters at most."""
    pattern = r"(?is)abstract\s*[:\-]?\s*\n(.*?)(?=\n\s*(?:1\.?\s*introduction|keywords|key\s*words|\n\s*\n))"
    return F.substring(F.trim(squeeze(F.regexp_extract(col(text), pattern, 1))), 1, 2000)
