"""URL filters: pattern rules indexed by their rarest literal token.

Each rule is a regular expression over host and path, with the literal tokens that every fitting URL must contain.
The rule is filed under the one of them that the URLs hold most seldom; a URL's own tokens fetch candidate rules,
and only those run their expression. The longest fitting host rule wins, then the longest pattern rule.

Null URLs, and those without ``://``, have an empty host and path and meet no host rule. Repeated rows and repeated
ids each get their own result row. Other columns of the input stay out of the result.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many rules the index is a map literal in the plan; beyond it the rules are a table that tokens join.
INLINE_RULES = 2_000


@dataclass(frozen=True)
class Rule:
    """A regular expression over host+path; tokens: runs of letters and digits that every fit contains whole."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int


def host_rule(verdict: str, host: str, path: str = "/") -> Rule:
    """Fits the host and all its subdomains where the path starts with the rule's."""
    ended = path.rstrip(UPPER + LOWER + "0123456789")  # the last word of a path may go on in the URL
    tokens = re.findall("[A-Za-z0-9]+", host) + re.findall("[A-Za-z0-9]+", ended)
    pattern = rf"^(?:[^/]*\.)?{_quoted(host)}{_quoted(path)}"
    return Rule(host + path, verdict, pattern, tuple(tokens), 1_000_000 + len(host + path))


def pattern_rule(verdict: str, pattern: str, tokens: Sequence[str] = ()) -> Rule:
    """A free expression; it ranks below every host rule."""
    return Rule(f"re:{pattern}", verdict, pattern, tuple(tokens), len(pattern))


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_])", r"\\\1", text)


#: Patterns over the host that mark link farms, pharmacies, betting, adult sites and trackers.
DEFAULT_PATTERNS = (
    pattern_rule("block", r"^[^/]*\bspam-", ("spam",)),
    pattern_rule("block", r"^[^/]*\bcheap-pills\b", ("pills",)),
    pattern_rule("block", r"^[^/]*\bcasino-", ("casino",)),
    pattern_rule("block", r"^[^/]*\bfree-bets\b", ("bets",)),
    pattern_rule("block", r"^[^/]*\badult-", ("adult",)),
    pattern_rule("block", r"^[^/]*\bads-track\b", ("track",)),
)


def url_host(url: Column) -> Column:
    """After the first :// up to /, ? or #; A-Z in lower case; empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ? or #; empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(text: Column) -> Column:
    return F.array_distinct(F.split(text, "[^A-Za-z0-9]+"))


def rarest_tokens(urls: DataFrame, rules: Sequence[Rule]) -> dict[str, str]:
    """For each rule's name the token to file it under, '' if it has none.

    Counts every URL, but only the tokens of the rules: a row for each such token comes back.
    """
    wanted = sorted({t for r in rules for t in r.tokens})
    counts: dict[str, int] = {}
    if wanted:
        held = F.array_intersect(url_tokens(F.col("target")), F.array(*map(F.lit, wanted)))
        counts = {t: n for t, n in urls.select(F.explode(held).alias("t")).groupBy("t").count().collect()}
    return {r.name: min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default="") for r in rules}


def filter_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    patterns: Sequence[Rule] = DEFAULT_PATTERNS,
    url: str = "url",
    keep: Sequence[str] = ("page_id",),
    default: str = "allow",
) -> DataFrame:
    """(keep..., host, path, rule, pattern, verdict): the winning host rule and the winning pattern, null if none."""
    given = [*rules, *patterns]
    base = pages.select(*keep, F.col(url).alias("_url")).withColumns({"host": url_host(F.col("_url")), "path": url_path(F.col("_url"))})
    base = base.withColumn("target", F.concat("host", "path"))
    filed = rarest_tokens(base, given)
    if len(given) <= INLINE_RULES:
        out = base.withColumn("_best", _inline(given, filed))
    else:
        out = _joined(base, given, filed)
    host = F.array_max(F.filter("_best", lambda r: r["rank"] >= 1_000_000))
    other = F.array_max(F.filter("_best", lambda r: r["rank"] < 1_000_000))
    return out.select(
        *keep,
        "host",
        "path",
        host["name"].alias("rule"),
        other["name"].alias("pattern"),
        F.coalesce(host["verdict"], other["verdict"], F.lit(default)).alias("verdict"),
    )


def _entry(r: Rule) -> Column:
    return F.struct(F.lit(r.rank).alias("rank"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"))


def _inline(rules: Sequence[Rule], filed: dict[str, str]) -> Column:
    """Fitting rules: the URL's tokens look candidates up in a map from token to rules."""
    none = F.filter(F.array(_entry(Rule("", "", "", (), 0))), lambda r: F.lit(False))
    if not rules:
        return none
    by: dict[str, list[Rule]] = {}
    for r in rules:
        by.setdefault(filed[r.name], []).append(r)
    always = F.array(*map(_entry, by.pop(""))) if "" in by else none
    fetched = none
    if by:
        index = F.create_map(*[c for t, rs in by.items() for c in (F.lit(t), F.array(*map(_entry, rs)))])
        hits = F.array_intersect(url_tokens(F.col("target")), F.array(*map(F.lit, by)))
        fetched = F.flatten(F.transform(hits, lambda t: F.try_element_at(index, t)))
    return F.filter(F.concat(fetched, always), lambda r: F.regexp_like(F.col("target"), r["pattern"]))


def _joined(base: DataFrame, rules: Sequence[Rule], filed: dict[str, str]) -> DataFrame:
    """For rule sets too large for a literal: distinct targets join the index by token; results join back."""
    spark = base.sparkSession
    index = spark.createDataFrame(
        [(filed[r.name], r.rank, r.name, r.verdict, r.pattern) for r in rules], "t string, rank int, name string, verdict string, pattern string"
    )
    targets = base.select("target").distinct()
    tokens = targets.select("target", F.explode(F.array_union(url_tokens(F.col("target")), F.array(F.lit("")))).alias("t"))
    fits = tokens.join(index, "t").where("target rlike pattern")
    best = fits.groupBy("target").agg(F.collect_set(F.struct("rank", "name", "verdict", "pattern")).alias("_best"))
    none = F.filter(F.array(_entry(Rule("", "", "", (), 0))), lambda r: F.lit(False))
    return base.join(best, "target", "left").withColumn("_best", F.coalesce("_best", none))
