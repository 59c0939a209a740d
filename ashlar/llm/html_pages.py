"""Labelled pages: made by rule from a seed, fragment by fragment, each with 1 where its words are content.

They show in which containers articles and boilerplate stand, not what they say: texts are drawn from a few words.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

Page = list[tuple[str, int]]

#: Classes and ids that containers of each kind have.
BOILERPLATE = {
    "menu": ["nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "tabs", "toc", "skip-link"],
    "advert": ["ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner-ad", "adsense"],
    "notice": ["cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "paywall"],
    "aside": ["sidebar", "side-bar", "aside", "widget", "widgets", "related", "recommended", "more-stories", "share", "sharing", "social", "tags", "complementary"],
    "footer": ["footer", "site-footer", "copyright", "contentinfo", "colophon"],
    "header": ["site-header", "masthead", "topbar", "page-header", "banner", "branding"],
    "form": ["search", "search-form", "login", "signup", "sign-up", "form"],
    "comments": ["comment", "comments", "disqus", "replies", "respond", "discussion", "comment-list", "comment-body"],
}
CONTENT = ["article", "article-body", "entry", "entry-content", "post", "post-body", "post-content", "main", "main-content", "content", "story", "story-body", "text", "body-text"]
#: Words that wrappers have around those above, and suffixes of small boxes.
WRAPPERS, BOXES = ["has", "no", "with", "row", "js", "page"], ["box", "slot", "unit", "banner", "buttons", "bar", "block", "list", "area"]
WORDS = "a the river runs down to sea and boats go with bread in old mill town where people made cloth for many years until roads came over hills".split()


class Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.out: Page = []

    def put(self, markup: str, label: int = 0) -> None:
        self.out.append((markup, label))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.r.choices(WORDS, k=self.r.randint(low, high)))

    def links(self, n: int) -> str:
        return "".join(f"<li><a href='/{i}'>{self.words(1, 3)}</a></li>" for i in range(n))

    def marked(self, tokens: list[str], plain: float = 0.6) -> str:
        """An attribute with one of the tokens, whole or with a suffix."""
        t = self.r.choice(tokens)
        if self.r.random() > plain:
            t = f"{t}-{self.r.choice(BOXES)}"
        return f" {self.r.choice(['class', 'class', 'id'])}='{t}'"

    def boilerplate(self, kind: str) -> None:
        r = self.r
        name = {"menu": "nav", "footer": "footer", "aside": "aside", "header": "header", "form": "form"}.get(kind, "div")
        named = name != "div" and r.random() < 0.5
        tag, mark = (name, "" if r.random() < 0.5 else self.marked(BOILERPLATE[kind])) if named else (r.choice(["div", "div", "section"]), self.marked(BOILERPLATE[kind]))
        inner: dict[str, Callable[[], str]] = {
            "menu": lambda: f"<ul>{self.links(r.randint(2, 8))}</ul>" if r.random() < 0.7 else " ".join(f"<a href='/'>{self.words(1, 2)}</a>" for _ in range(4)),
            "advert": lambda: r.choice([self.words(2, 30), f"<p>{self.words(3, 20)}</p>", f"<a href='/'>{self.words(2, 6)}</a>"]),
            "notice": lambda: f"{self.words(4, 30)} <button>{self.words(1, 2)}</button>",
            "aside": lambda: r.choice([f"<h3>{self.words(1, 3)}</h3><ul>{self.links(4)}</ul>", f"<p>{self.words(3, 30)}</p>", self.words(1, 4), f"<article><h3>{self.words(1, 4)}</h3><p>{self.words(3, 12)}</p></article>"]),
            "footer": lambda: r.choice([self.words(3, 20), f"<p>{self.words(3, 20)}</p>", f"<ul>{self.links(3)}</ul>{self.words(2, 5)}"]),
            "header": lambda: r.choice([f"<a href='/'>{self.words(1, 3)}</a>", f"<h1>{self.words(1, 3)}</h1><p>{self.words(2, 8)}</p>", f"<div>{self.words(1, 5)}</div>"]),
            "form": lambda: f"<label>{self.words(1, 3)}</label><input><button>{self.words(1, 2)}</button>",
            "comments": lambda: "".join(f"<{t}{m}><p>{self.words(2, 40)}</p></{t}>" for t, m in r.choices([("div", ""), ("article", " class='comment'"), ("li", "")], k=r.randint(1, 8))),
        }
        self.put(f"<{tag}{mark}>{inner[kind]()}</{tag}>")

    def inside(self) -> None:
        """A small box between paragraphs."""
        self.boilerplate(self.r.choice(["advert", "advert", "aside", "aside", "notice", "form"]))

    def content(self, boxes: bool) -> None:
        """A title and paragraphs, lists, quotes; each may be followed by a box."""
        r = self.r
        for k in range(r.randint(1, 9)):
            if k == 0 and r.random() < 0.7:
                self.put(f"<h1>{self.words(2, 9)}</h1>", 1)
            elif k and r.random() < 0.15:
                self.put(f"<h2>{self.words(1, 6)}</h2>", 1)
            text = self.words(1, 5) if r.random() < 0.1 else self.words(8, 60)
            form = r.random()
            if form < 0.7:
                self.put(f"<p>{text}" + "</p>" * (r.random() < 0.9), 1)
            elif form < 0.76:
                self.put(f"<ul><li>{text}</li><li>{self.words(2, 12)}</li></ul>", 1)
            elif form < 0.82:
                self.put(f"<blockquote>{text}</blockquote>", 1)
            elif form < 0.9:
                self.put(f"<div>{text}</div>", 1)
            elif form < 0.94:
                self.put(f"<p><a href='/'>{self.words(1, 3)}</a> {text}</p>", 1)
            elif form < 0.97:
                self.put(f"<figure><img src='x'><figcaption>{self.words(2, 9)}</figcaption></figure><p>{text}</p>", 1)
            else:
                self.put(f"<table><tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr></table><p>{text}</p>", 1)
            if boxes and r.random() < 0.2:
                self.inside()

    def page(self) -> Page:
        r = self.r
        self.put(f"<html><head><title>{self.words(2, 6)}</title></head><body{r.choice(['', '', self.marked(['home', 'sidebar', 'post'])])}>")
        for kind in ("notice", "header", "menu", "advert", "aside"):
            if r.random() < 0.45:
                self.boilerplate(kind)
        if r.random() < 0.04:  # nothing but boilerplate
            for kind in r.sample(sorted(BOILERPLATE), 3):
                self.boilerplate(kind)
        else:
            self.body()
        for kind in ("aside", "comments", "advert", "menu", "footer"):
            if r.random() < 0.45:
                self.boilerplate(kind)
        if r.random() < 0.2:
            self.put(f"<hr><a href='/'>{self.words(1, 3)}</a> <a href='/'>{self.words(1, 3)}</a>")
        self.put("</body></html>")
        return self.out

    def body(self) -> None:
        r = self.r
        form, ends = r.random(), []
        if r.random() < 0.25:  # a wrapper whose class is made of any kind of word
            word = r.choice(r.choice(list(BOILERPLATE.values())[:-1]))
            mark = r.choice([f"{r.choice(WRAPPERS)}-{word}", f"{r.choice(CONTENT)} {r.choice(WRAPPERS)}-{word}", r.choice(["wrap", "page", "container"])])
            self.put(f"<div class='{mark}'>")
            ends.append("</div>")
        elif r.random() < 0.08:
            self.put("<form id='form1'>" + "<input>" * r.randint(0, 2))
            ends.append("</form>")
        if form < 0.45:
            tag = r.choice(["article", "article", "main"])
            if r.random() < 0.15:
                self.put(f"<div>{self.words(2, 7)}</div>")  # loose text beside an article
            self.put(f"<{tag}>")
            ends.append(f"</{tag}>")
            if r.random() < 0.3:
                self.put(f"<header><h1>{self.words(2, 8)}</h1></header>", 1)
            if r.random() < 0.2:
                self.put(f"<div{self.marked(CONTENT)}>")
                ends.append("</div>")
        elif form < 0.75:
            self.put(f"<{r.choice(['div', 'div', 'section'])}{self.marked(CONTENT)}>")
            ends.append("</div>")
            if r.random() < 0.1:  # the text lies in tabs or widgets
                self.put(f"<div class='{r.choice(['tabs', 'widget', 'banner', 'page-header'])}'>")
                ends.append("</div>")
        elif r.random() < 0.1:
            self.put(f"<div>{self.words(2, 8)}</div>")
        self.content(True)
        for e in reversed(ends):
            if form < 0.45 and r.random() < 0.25 and e != "</div>":
                self.boilerplate(r.choice(["footer", "aside", "form", "comments"]))
            self.put(e)


def labelled(n: int = 600, seed: int = 13) -> Iterator[Page]:
    for i in range(n):
        yield Maker(seed * 1_000_003 + i).page()
