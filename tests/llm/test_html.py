"""Parsing of odd pages, decoding against all labellings, and accuracy on layouts that were not trained on."""

import itertools

import numpy as np
import pytest

from brindle.llm import html


@pytest.fixture(scope="module")
def model():
    return html.train()


def test_held_out_layouts(model):
    wrong = pages = 0
    for order, x, parents, label in html.examples(150, 4321):
        kept = html.decode(model.margin(x).tolist(), parents)
        leaves = [(k, bool(y)) for n, k, y in zip(order, kept, label, strict=True) if n.tag == "#text"]
        wrong += sum(k != y for k, y in leaves) > 0.1 * len(leaves)
        pages += 1
    assert wrong <= 0.12 * pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var t="</p>";</script></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies <button>OK</button></div><div class="ad">Buy now cheap things here.</div>
<article><h1>A &amp;amp; title</h1><p>First   para<b>graph</b> with
words, and &eacute;.<br>Next line.<p>Second one<!-- hidden --> goes on, and on, for a while.</p></article>
<aside class="sidebar"><h3>Popular</h3><ul><li><a href=/c>Three things</a></li></ul></aside>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I agree with this writer.</p></div></section>
<form class="newsletter"><label>Your mail</label><input name=q></form><footer>&copy; 2020 Site. All rights.</footer></body></html>"""


def test_page(model):
    assert html.texts([PAGE], model) == ["A &amp; title First paragraph with words, and é. Next line. Second one goes on, and on, for a while."]


def test_decoding_is_the_likeliest():
    r = np.random.default_rng(5)
    for _ in range(60):
        n = int(r.integers(1, 9))
        parents = [-1] + [int(r.integers(0, k)) for k in range(1, n)]
        margin = r.normal(0, 2, n)
        best = max((sum(-np.log1p(np.exp(-m if y else m)) for m, y in zip(margin, ys, strict=True)), ys) for ys in itertools.product((False, True), repeat=n) if all(ys[p] or not ys[k] for k, p in enumerate(parents) if p >= 0))
        assert tuple(html.decode(margin.tolist(), parents)) == best[1]


def test_odd_markup_does_not_fail(model):
    odd = [None, "", "plain text only", "<", "<p", "<p title='a>b'>x", "</div></p>", "<script>never ends", "<!-- never ends", "<a" * 2000, "<div>" * 3000 + "deep" + "</div>" * 10, "&#0;&#x110000;&bogus;", "<p>" * 5000, "<td>a<td>b<tr>c", '<div class="' + "x" * 10_000, "<p>a\x00b</p>", "<br><br>x<br/>y", "w " * 100_000]
    found = html.texts(odd, model)
    assert len(found) == len(odd) and found[0] == found[1] == ""


def test_extract(spark):
    rows = [(1, "u", PAGE, "t", 1), (2, None, None, "t", 1), (2, None, None, "t", 1), (None, "v", "", "t", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = html.extract(pages).collect()
    assert len(got) == 4 and all(len(x["text"]) == x["n_chars"] for x in got)
    assert {x["text"] for x in got if x["page_id"] != 1} == {""}
    assert html.extract(pages.limit(0)).collect() == []


def test_features_of_many_siblings():
    """Places, neighbours and upper case are told alike however many children an element has and however long a text is."""
    at, before, after, n, upper = (html.NAMES.index(k) for k in ("place", "before", "after", "siblings", "upper"))
    for k in (5, 401, 3000):
        page = "<body>" + "".join(f"<p>{'a' * (1 + j % 7)}</p><p></p>" for j in range(k)) + "</body>"
        order = html.nodes_of(html.parse(page))
        x, _ = html.features(order)
        rows = [r for r, node in zip(x, order, strict=True) if node.tag == "p"]
        size = [1 + j % 7 for j in range(k)]
        assert len(rows) == k
        for j in (0, 1, k // 3, k - 1):
            want = [j / k, np.log1p(size[j - 1] if j else 0), np.log1p(size[j + 1] if j + 1 < k else 0), np.log1p(k)]
            assert rows[j][[at, before, after, n]] == pytest.approx(want, rel=1e-6)
    order = html.nodes_of(html.parse("<p>" + "A" * 200 + "b" * 600 + "</p>"))
    x, _ = html.features(order)
    assert x[-1][upper] == pytest.approx(0.25)


#: Pages by hand, in layouts that the made pages don't have, each with its main text.
BY_HAND = [
    # the head's end and the body's start are left out
    ("<html><head><title>T</title><meta charset=utf-8><article><h1>Of rivers</h1><p>A river runs, and the river's bank gives way to it in spring.</p></article>", "Of rivers A river runs, and the river's bank gives way to it in spring."),
    ("<head><title>T</title>Plain words come first here, without any element around them, and they are the page.", "Plain words come first here, without any element around them, and they are the page."),
    # hidden parts, in a line and around blocks
    ("<body><main><p>One <span hidden>secret</span>line of text that is shown, <i style='display: none'>and not this</i> to the end of it.</p><span hidden><div>gone</div></span><p>Then another one, which is shown as well, whole.</p></main></body>", "One line of text that is shown, to the end of it. Then another one, which is shown as well, whole."),
    # advertising inside a sentence; emphasis with an attribute stays
    ("<body><article><h1>Bread</h1><p>Bread is made of flour, <span class='advert'>BUY OUR OVENS</span> of water and of <em class=x>time</em>, as everyone knows.</p><p>Let it rest over the night, then bake it.</p></article></body>", "Bread Bread is made of flour, of water and of time, as everyone knows. Let it rest over the night, then bake it."),
    # a letter: tables for layout, upper-case tags, entities
    ("<HTML><BODY><TABLE><TR><TD><UL CLASS=menu><LI><A HREF=/>Home</A><LI><A HREF=/n>News</A><LI><A HREF=/c>Contact</A></UL><TD><DIV CLASS=content><H2>Caf&eacute; &amp; bar</H2><P>We open at nine, and we close when the last guest has gone home.<P>Sunday is our day of rest, so don't come then.</DIV></TABLE></BODY></HTML>", "Café & bar We open at nine, and we close when the last guest has gone home. Sunday is our day of rest, so don't come then."),
    ("<body><nav><a href=/>Start</a> <a href=/x>More</a></nav><section class=post-body><h1>Notes</h1><ul><li>First, a note of some length about things.</li><li>Second, one more note about other things.</li></ul></section><section class=comments><p>Nice notes, thank you so much!</p></section><footer>&copy; 2020 Me</footer></body>", "Notes First, a note of some length about things. Second, one more note about other things."),
]


@pytest.mark.parametrize("page, text", BY_HAND)
def test_layouts_by_hand(model, page, text):
    assert html.texts([page], model) == [text]


def plain_text(page):
    """All text of a small page of well-formed blocks, by the library's parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.blocks, self.silent = [], [], 0

        def end(self):
            self.out.append(" ".join("".join(self.blocks).split()))
            self.blocks = []

        def handle_starttag(self, tag, attributes):
            if tag in html.SILENT:
                self.silent += 1
            if tag == "br":
                self.blocks.append(" ")
            elif tag not in html.INLINE:
                self.end()

        def handle_endtag(self, tag):
            if tag in html.SILENT:
                self.silent -= 1
            if tag not in html.INLINE and tag != "br":
                self.end()

        def handle_data(self, data):
            if not self.silent:
                self.blocks.append(data)

    reader = Reader()
    reader.feed(page)
    reader.close()
    reader.end()
    return " ".join(t for t in reader.out if t)


def test_all_kept_is_the_whole_text():
    """Parse and join against another parser: with every node kept, a page's text is all its text."""
    r = np.random.default_rng(8)
    words = ["alpha", "b&amp;c", "d é", "  e ", "\n", "&lt;f&gt;", "12"]

    def block(depth):
        if depth == 0 or r.random() < 0.4:
            out = []
            for _ in range(r.integers(1, 5)):
                w = words[r.integers(len(words))]
                out.append(w if r.random() < 0.6 else f"<{(t := ['b', 'span', 'em'][r.integers(3)])} class='{['x', 'ad', 'share'][r.integers(3)]}'>{w}</{t}>")
                if r.random() < 0.1:
                    out.append("<br>")
            return "".join(out)
        return "".join(f"<{(t := ['div', 'section', 'h2', 'blockquote'][r.integers(4)])} class=c>{block(depth - 1)}</{t}>" + ("<script>x</script>" if r.random() < 0.1 else "") for _ in range(r.integers(1, 4)))

    for _ in range(300):
        page = f"<body>{block(3)}</body>"
        order = html.nodes_of(html.parse(page))
        assert html.chosen_text(order, [True] * len(order)) == plain_text(page)


def test_labels_of_parts_are_the_likeliest(model):
    """The whole of parse, score and decode on small pages against all labellings of their trees."""
    for seed in range(40):
        page = html._Writer(seed).inline() + f"<div class=ad>{html._Writer(seed).words(2, 6)}</div><p>{html._Writer(seed + 1).words(3, 20)}</p>"
        page = page.replace("\x02", "").replace("\x03", "")
        order = html.nodes_of(html.parse(page))
        x, parents = html.features(order)
        margin = model.margin(x)
        if len(order) > 12:
            continue
        labels = [ys for ys in itertools.product((False, True), repeat=len(order)) if all(ys[p] or not ys[k] for k, p in enumerate(parents) if p >= 0)]
        best = max(labels, key=lambda ys: (sum(-np.log1p(np.exp(-m if y else m)) for m, y in zip(margin, ys, strict=True)), ys))
        assert html.texts([page], model) == [html.chosen_text(order, list(best))]


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p>Ok.</p></article><footer>c 2020</footer>", "Ok."),
        ("<nav>Home About</nav><article><p>Ok, fine.</p></article>", "Ok, fine."),
        ("<header>Site</header><article><header><h1>Title</h1></header><p>Text.</p></article>", "Title Text."),
        ("<article><p>Sources of it all:</p><ul><li><a>First source</a></li><li><a>Second source</a></li></ul></article>", "Sources of it all: First source Second source"),
        ("<article><p aria-hidden=TRUE>no</p><p style='visibility: hidden'>nor this</p><p>Yes, this stays.</p></article>", "Yes, this stays."),
        (f"<article><p>Yes, this stays in here.</p></article><div class='{'x' * 30}commentlistwrapper'><p>I agree so much</p></div>", "Yes, this stays in here."),
        ("<main><p>Here is what the page is about.</p></main><aside><article><p>Other things to read</p></article></aside>", "Here is what the page is about."),
    ],
)
def test_tags_that_set_apart_outweigh_length(model, page, text):
    assert html.texts([page], model) == [text]


@pytest.mark.parametrize("name", ["cmts", "kommentare", "c-hdr__wrap", "fusszeile", "werbung", "piedepagina"])
def test_short_names_and_those_of_other_languages(model, name):
    page = f"<body><article><p>Main text of it, with quite a few words in here.</p></article><div class='{name}'><p>Ja, genau so ist es</p></div></body>"
    assert html.texts([page], model) == ["Main text of it, with quite a few words in here."]


@pytest.mark.parametrize("opened", ["<span class=a>x", "<b class=x><span class=x>x"])
def test_unclosed_elements_of_a_line_take_linear_time(opened):
    import time

    def seconds(n):
        began = time.perf_counter()
        html.parse(opened * n + "</b>" * n)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(100_000) < 60 * max(seconds(10_000), 0.05)


def test_elements_of_a_line_end_in_any_order(model):
    page = "<article><p>One <b class=x>two <i class=ad>gone</b> gone too</i> three, and so on to the end of it.</p><p>Another of them, as long.</p></article>"
    assert html.texts([page], model) == ["One two three, and so on to the end of it. Another of them, as long."]
    assert html.texts(["<article>Some <b hidden>no <div>no</div></b> more of the text that is told here.</article>"], model) == ["Some more of the text that is told here."]


def test_whole_articles_of_the_pages(model):
    """The main text of the driver's pages is what the library's own reading of their article element gives."""
    import re

    import pyarrow.parquet as pq

    pages = [p for p in pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist() if p and p.count("<article") == 1]
    bodies = [re.search(r"<article\b[^>]*>(.*)</article>", p, re.S)[1] for p in pages]
    clean = [k for k, b in enumerate(bodies) if not re.search(r"<(script|style|nav|aside|form|footer|span|div)\b", b)]
    assert len(clean) > 10
    for k, got in zip(clean, html.texts([pages[k] for k in clean], model), strict=True):
        assert got == plain_text(bodies[k])
