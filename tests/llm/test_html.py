import bisect
import itertools
import random
import time

from ashlar.llm import html_pages, html_text

W = html_text.learned()


def test_article_without_its_surroundings():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><nav><a href='/'>Home</a></nav><div class='cookie-banner'>We use cookies</div>"
        "<article><header><h1>Big &amp; news</h1></header><p>First  line\n of &lt;text&gt;.<p>Second <b>line</b><br>goes on here.<div class='ad'>Buy now</div><aside>Related</aside>"
        "<script>var x = '<p>no</p>';</script><p>Third caf&eacute; line.</p></article><section id='comments'><p>Nice nice nice</p></section><footer>End of it</footer></body></html>"
    )
    assert html_text.main_text(page, W) == "Big & news\n\nFirst line of <text>.\n\nSecond line goes on here.\n\nThird café line."


def test_marks_on_wrappers_do_not_empty_the_page():
    text = "<p>The river runs wide and slow below the old mill.</p><p>In spring it floods the fields.</p>"
    want = "The river runs wide and slow below the old mill.\n\nIn spring it floods the fields."
    rest = "<nav><a href='/'>Home</a></nav>", "<div class='sidebar'>Read this too</div><footer>End of it</footer>"
    for begin, inner in (
        ("<html><body class='has-sidebar'>", f"<article>{text}</article>"),
        ("<html><body class='no-sidebar'>", text),
        ("<html><body class='sidebar'>", f"<article>{text}</article>"),
        ("<html class='js-nav'><body>", f"<article>{text}</article>"),
        ("<html><body>", f"<div class='content with-sidebar'>{text}</div>"),
        ("<html><body>", f"<div class='content with_sidebar'><article>{text}</article></div>"),
        ("<html><body>", f"<div class='sidebar'><main>{text}</main></div>"),
        ("<html><body>", f"<form id='form'><main>{text}</main></form>"),
        ("<html><head>", f"<body><article>{text}</article>"),
    ):
        assert html_text.main_text(begin + rest[0] + inner + rest[1] + "</body></html>", W) == want, (begin, inner)


def test_loose_marks_are_left_out_beside_the_content():
    text = "<p>The river runs wide and slow below the old mill.</p>"
    more = "<p>In spring it floods all the fields along it.</p>"
    want = "The river runs wide and slow below the old mill.\n\nIn spring it floods all the fields along it."
    for inner in (
        f"<article>{text}<div class='ad-slot'>Buy now</div>{more}</article>",
        f"<div class='with-sidebar'>{text}<div class='ad-slot'>Buy now</div>{more}</div>",
        f"<div class='row-menu'>{text}</div><div class='row-menu'>{more}</div>",
        f"<article>{text}{more}</article><aside><article>Ten cakes</article></aside>",
        f"<article>{text}{more}</article><section id='comments'><article class='comment'>{'nice ' * 99}</article></section>",
    ):
        assert html_text.main_text(f"<html><body>{inner}</body></html>", W) == want, inner


def test_pages_without_containers_keep_all_paragraphs():
    for page, want in (
        ("<h1>Title</h1><div><p>First para is here with words.</p></div><div class='share-buttons'>x</div><p>Second.</p>", "Title|First para is here with words.|Second."),
        ("<div class='post'><h1>One title</h1><div class='tabs'><p>Some words in a paragraph here.</p></div></div>", "One title|Some words in a paragraph here."),
        ("<body><p>One.</p><hr><p>Two words.</p><blockquote>Three more words.</blockquote></body>", "One.|Two words.|Three more words."),
        ("<body><table><tr><td><p>Only cells hold this text of the page.</p></td></tr></table></body>", "Only cells hold this text of the page."),
    ):
        assert html_text.main_text(page, W) == want.replace("|", "\n\n"), page


def test_scan_equals_all_spans():
    rng = random.Random(1)
    for _ in range(300):
        steps = [rng.choice([-2.0, -0.5, 0.0, 0.5, 1.0, 3.0]) for _ in range(rng.randint(0, 25))]
        a, b = html_text.best_run(steps)
        spans = [sum(steps[i:j]) for i, j in itertools.combinations(range(len(steps) + 1), 2)]
        best = max(spans, default=0.0)
        assert sum(steps[a:b]) == max(best, 0.0)


def test_learned_weights_and_scan_decide_on_held_out_pages():
    shared = made = wanted = changed = bare = 0
    none = html_text.Weights({}, {}, {}, {})
    pages = list(html_pages.labelled(200, 999))
    for fragments in pages:
        page = "".join(f for f, _ in fragments)
        ends = list(itertools.accumulate(len(f) for f, _ in fragments))
        want = [w for p in html_text.walk(page)[0] if p.n and fragments[bisect.bisect_right(ends, p.at)][1] for w in p.value.split()]
        got = html_text.main_text(page, W)
        both = sum(min(got.split().count(w), want.count(w)) for w in set(want))
        shared, made, wanted = shared + both, made + len(got.split()), wanted + len(want)
        changed += got != html_text.main_text(page, W, scan=False)
        bare += html_text.main_text(page, none) == ""
    print("precision", shared / made, "recall", shared / wanted, "pages on which the scan matters", changed)
    assert shared / made > 0.97 and shared / wanted > 0.97
    assert changed >= 5 and bare == len(pages)


def test_time_is_linear_in_depth():
    def took(depth):
        page = "<div class='a'>" * depth + "<article><p>words in the middle</p></article>" + "</div>" * depth
        began = time.process_time()
        assert html_text.main_text(page, W) == "words in the middle"
        return time.process_time() - began

    took(500)
    assert took(8000) < 8 * max(took(2000), 0.01)


def test_odd_pages():
    for page in ("", None, "<", "<div", "<!-- open", "<script>never closed", "</p></div>", "<nav>only a menu</nav>"):
        assert html_text.main_text(page, W) == ""
    assert html_text.main_text("<article><p>Cut off in the middle of a wo", W) == "Cut off in the middle of a wo"
    assert html_text.main_text("<article><p>1 < 2 and 3<", W) == "1 < 2 and 3"
    assert html_text.main_text("<article><p>one &am", W) == "one &am"
    assert html_text.main_text("just some plain words without any tags at all", W) == "just some plain words without any tags at all"
    long = "<article>" + "<p>word word word</p>" * 20000
    assert html_text.main_text(long, W).count("\n\n") == 19999


def test_table(spark):
    rows = [(1, "u", "<article><p>a b c d</p></article>"), (1, "u", "<article><p>a b c d</p></article>"), (2, None, None)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    got = sorted(map(tuple, html_text.extract(df).fillna("").collect()))
    assert got == [(1, "u", "a b c d", 7), (1, "u", "a b c d", 7), (2, "", "", 0)]
