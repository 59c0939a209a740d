import pytest
from ashlar.llm import url_filters as u

RULES = [u.host_rule(*r) for r in (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "x.org", "/ab"))]
URLS = {
    "http://a.example.com/en/1": ("a.example.com", "/en/1", "example.com/en/", "block"),
    "https://WWW.Example.com/en/?q#f": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
    "http://example.com": ("example.com", "", None, "allow"),
    "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
    "http://b.net/es/x?http://c.com/": ("b.net", "/es/x", "net/es/", "block"),
    "http://x.org/abc": ("x.org", "/abc", "x.org/ab", "block"),
    "http://casino-win.example.org/": ("casino-win.example.org", "/", None, "block"),
    "no scheme": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "http://?q": ("", "", None, "allow"),
}


@pytest.mark.parametrize("inline", [True, False])
def test_verdicts(spark, monkeypatch, inline):
    if not inline:
        monkeypatch.setattr(u, "INLINE_RULES", 0)
    df = spark.createDataFrame([(i, x, "z") for i, x in enumerate([*URLS, *URLS])], "page_id long, url string, host string")
    got = sorted(u.filter_urls(df, RULES).select("page_id", "host", "path", "rule", "verdict").collect())
    assert [tuple(r)[1:] for r in got] == [*URLS.values(), *URLS.values()]
    assert u.filter_urls(df.limit(0), RULES).count() == 0


def test_rarest_token(spark):
    df = spark.createDataFrame([(i, "http://a.com/b/") for i in range(3)] + [(9, "http://q.com/")], "page_id long, url string")
    rows = df.select(u.F.concat(u.url_host(u.F.col("url")), u.url_path(u.F.col("url"))).alias("target"))
    rule = u.host_rule("block", "q.com", "/")
    assert u.rarest_tokens(rows, [rule]) == {rule.name: "q"}


def test_two_thousand_rules_as_by_brute_force(spark):
    import random

    rng = random.Random(7)
    hosts = [f"{rng.choice('abc')}{i}.{rng.choice(['com', 'net', 'org'])}" for i in range(400)]
    rules = [(rng.choice(["allow", "block"]), h, p) for h in hosts for p in ("/", "/x/", f"/{h[0]}/y", "/z/z/", "/q")]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(['', 'www.', 'a.b.'])}{rng.choice(hosts)}{rng.choice(['/', '/x/1', '/a/y/2', '/z/z/', '/q?x=1', '', '#f'])}" for _ in range(300)] + ["no url", None, ""]
    df = spark.createDataFrame([(i, x, "c") for i, x in enumerate(urls)], "page_id long, url string, rule string")
    for patterns in (u.DEFAULT_PATTERNS[:0], u.DEFAULT_PATTERNS):  # at the bound of the literal index, and above it
        got = {r["page_id"]: (r["rule"], r["verdict"]) for r in u.filter_urls(df, [u.host_rule(*r) for r in rules], patterns).collect()}
        for i, x in enumerate(urls):
            rest = x.split("://", 1)[1] if x and "://" in x else ""
            host = rest.split("/")[0].split("?")[0].split("#")[0].lower()
            path = rest[len(host) :].split("?")[0].split("#")[0]
            fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
            assert got[i] == (max(fits)[1:] if fits else (None, "allow")), x

