"""Evidence fusion on pages with known languages, and its edge cases."""

import math
import random
import re
from collections import defaultdict

import pytest

from brindle.llm import common, html, langid

WORDS = {"en": "the and of that with this from for which there".split(), "de": "der und nicht eine durch auch nach wird über für".split(), "fr": "les dans une pour avec est sur être très où".split()}


def text(lang, n, shift=0):
    w = WORDS[lang]
    return " ".join(w[(k * 7 + shift) % len(w)] for k in range(n))


def page(lang, declared, n=60, shift=0):
    attribute = f' lang="{declared}"' if declared else ""
    return f"<html{attribute}><body><article><h1>{text(lang, 5, shift)}</h1><p>{text(lang, n, shift)}.</p></article></body></html>"


def frames(spark):
    docs = [(k, text(lang, 40, k), lang) for k, lang in enumerate(list(WORDS) * 12)] + [(900, None, "en"), (901, "x", None), (902, "", "de")]
    pages = []
    for k, lang in enumerate(list(WORDS) * 8):
        pages.append((k, f"https://{lang}.host.example.{lang}/p/{k}", page(lang, f"{lang}-XX", shift=k)))
    pages += [
        (100, "https://de.host.example.de/x", "<html><body></body></html>"),  # no text: the host tells
        (101, None, page("fr", None)),
        (102, "not an address", None),
        (103, "https://en.host.example.en/", page("de", "en", 200)),  # a long German text on an English host
        (104, "https://en.host.example.en/", ""),
        (104, "https://en.host.example.en/", ""),
        (None, "http://user@[::1]:80/", page("en", "EN", 20_000)),
    ]
    return spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(docs, "doc_id long, text string, lang string")


def test_languages(spark):
    pages, docs = frames(spark)
    rows = langid.identify(pages.selectExpr("*", "1 as lang", "2 as declared", "3 as host"), docs).collect()
    got = {r["page_id"]: r for r in rows}
    assert len(rows) == pages.count()
    for k, lang in enumerate(list(WORDS) * 8):
        assert got[k]["lang"] == got[k]["text_lang"] == got[k]["declared"] == lang and got[k]["confidence"] > 0.9
    assert (got[100]["lang"], got[100]["text_lang"]) == ("de", None)
    assert got[101]["lang"] == "fr" and got[101]["host"] is None
    assert got[102]["lang"] in WORDS and got[102]["text_lang"] is None
    assert (got[103]["text_lang"], got[103]["declared"]) == ("de", "en")
    assert got[104]["lang"] == "en" and got[None]["lang"] == "en"


def test_empty(spark):
    pages, docs = frames(spark)
    assert langid.identify(pages.limit(0), docs).collect() == []
    assert {r["lang"] for r in langid.identify(pages, docs.limit(0)).collect()} == {None}


def test_parts():
    assert langid.address("https://u@Www.A-b.co.UK:80/x?y") == ("uk", "co.uk", "www.a-b.co.uk")
    assert langid.address("http://localhost/") == (None, "localhost", "localhost") and langid.address("x/y") == (None, None, None)
    assert langid.declared("<!doctype html><HTML class=x lang = 'pt-BR'>") == "pt"
    assert langid.declared('<meta http-equiv="content-language" content="de">') == "de" and langid.declared("<p lang=x>") is None


def test_declared_after_a_long_head():
    for lead in ("<!--" + "x" * 70_000 + "-->", "<!--" + "x > y " * 40_000 + "-->", "<style>" + "a{b:c} " * 20_000 + "</style>"):
        assert langid.declared(lead + "<html class='a' lang=\"sv-SE\"><body>") == "sv"
        assert langid.declared("<html><head>" + lead + "<meta http-equiv=content-language content='fi'>") == "fi"


#: What is declared, in one pattern whose time grows with a power of the page's length.
PLAIN = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-zA-Z]{2,3})\b|<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?\s*([a-zA-Z]{2,3})\b", re.I)


def test_declared_at_random():
    r, hits = random.Random(4), 0
    parts = ["<html", "<META", " ", " ", ">", "lang", "Lang=", "=", "content-language", " content", "content=", "'", '"', "de", "fra", "abcd", "x", "-", "<"]
    for _ in range(60_000):
        page = r.choice(["", "<html ", "<meta content-language "]) + "".join(r.choice(parts) for _ in range(r.randint(1, 16)))
        m = PLAIN.search(page)
        hits += m is not None
        assert langid.declared(page) == ((m[1] or m[2]).lower() if m else None), page
    assert hits > 500


def test_declared_is_read_once():
    for page in ("<html ", "<meta ", "<meta content-language ", "<meta content-language content", "<html lang", "<html lang=", "<html><meta>"):
        assert langid.declared(page * 100_000) is None
    assert langid.declared("<html lang=" + " " * 1_000_000) is None


def posteriors(pages, docs):
    """page_id -> (posterior by language, text likelihoods), in plain Python: triples, shares and Bayes' rule by their definitions."""
    def cell(a, b, c):
        h = ((ord(a) * 0x9E3779B1 + ord(b)) * 0x85EBCA6B + ord(c)) % 2**64 * 0x9E3779B97F4A7C15 % 2**64
        return h >> 50

    triples = lambda t: [cell(*t.lower()[i : i + 3]) for i in range(len(t.lower()) - 2)]
    counts = defaultdict(lambda: defaultdict(int))
    for lang in sorted({d[2] for d in docs if d[1] is not None and d[2] is not None}):
        for c in triples("\n".join(d[1] for d in docs if d[1] is not None and d[2] == lang)):
            counts[lang][c] += 1
    names = sorted(counts)
    total = {lang: sum(counts[lang].values()) for lang in names}
    every = defaultdict(int)
    for lang in names:
        for c, n in counts[lang].items():
            every[c] += n
    whole = lambda c: (every[c] + 1) / (sum(total.values()) + langid.CELLS)
    texts = html.texts([p[2] for p in pages], html.train())
    like, own = [], []
    for t in texts:
        at = triples(t)
        scale = min(1, langid.INDEPENDENT / len(at)) if at else 0
        like.append([scale * sum(math.log((counts[lang][c] + 1000 * whole(c)) / (total[lang] + 1000)) for c in at) for lang in names])
        e = [math.exp(x - max(like[-1])) for x in like[-1]]
        own.append([x / sum(e) for x in e])
    k, s = len(names), langid.SMOOTHING
    known = [i for i, t in enumerate(texts) if t]
    mass = [sum(own[i][j] for i in known) for j in range(k)]
    told = [langid.address(p[1]) for p in pages]
    declared = [langid.declared(p[2]) for p in pages]
    groups = {"declared": declared, "suffix": [t[0] for t in told], "domain": [t[1] for t in told], "site": [t[2] and ".".join(t[2].split(".")[-3:]) for t in told], "host": [t[2] for t in told]}
    held = lambda kind, value: [sum(own[i][j] for i in known if groups[kind][i] == value) for j in range(k)]
    out = []
    for i in range(len(pages)):
        prior = [(m + s / k) / (sum(mass) + s) for m in mass]
        for kind in ("domain", "site", "host"):
            c = held(kind, groups[kind][i]) if groups[kind][i] is not None else [0.0] * k
            c = [max(x - (own[i][j] if texts[i] else 0), 0) for j, x in enumerate(c)]
            prior = [(x + s * p) / (sum(c) + s) for x, p in zip(c, prior)]
        score = [math.log(p) + x for p, x in zip(prior, like[i])]
        for kind in ("declared", "suffix"):
            value = groups[kind][i]
            if value is not None and any(groups[kind][j] == value for j in known):
                c = held(kind, value)
                n = [sum(own[j][x] for j in known if groups[kind][j] is not None) for x in range(k)]
                share = sum(c) / sum(n)
                score = [v + math.log((a + s * share) / (b + s)) for v, a, b in zip(score, c, n)]
        e = [math.exp(x - max(score)) for x in score]
        out.append((names, [x / sum(e) for x in e]))
    return out


@pytest.mark.parametrize("most", [200_000, 0])
def test_posterior_is_bayes_rule(spark, monkeypatch, most):
    """With most = 0 no table of hosts is broadcast whole, and with HOT_ROWS = 3 some hosts are hot."""
    monkeypatch.setattr(langid, "SENT_KEYS", most)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "HOT_KEYS", 10**9)
    pages, docs = frames(spark)
    plain_pages = [tuple(r) for r in pages.collect()]
    want = posteriors(plain_pages, [tuple(r) for r in docs.collect()])
    got = sorted(((str(r["page_id"]), r["lang"], r["confidence"]) for r in langid.identify(pages, docs).collect()), key=str)
    expected = sorted(((str(p[0]), names[post.index(max(post))], round(max(post), 6)) for p, (names, post) in zip(plain_pages, want)), key=str)
    assert [g[:2] for g in got] == [e[:2] for e in expected]
    assert [g[2] for g in got] == pytest.approx([e[2] for e in expected], abs=2e-6)


def test_sites_of_a_shared_domain(spark):
    """Two sites under co.uk speak for themselves."""
    _, docs = frames(spark)
    rows = [(k, f"https://www.{'ab'[k % 2]}.co.uk/{k}", page("de" if k % 2 else "en", None, shift=k)) for k in range(40)] + [(100, "https://x.a.co.uk/", ""), (101, "https://x.b.co.uk/", "")]
    got = {r["page_id"]: r["lang"] for r in langid.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    assert (got[100], got[101]) == ("en", "de")


def test_ties_and_repeats(spark):
    """Equal languages tie: the first name is told; repeated rows each have a row."""
    docs = spark.createDataFrame([(1, "same words", "bb"), (2, "same words", "aa")], "doc_id long, text string, lang string")
    rows = [(1, "https://h.example.org/", "<p>same words here and there, same words.</p>")] * 3
    got = langid.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()
    assert [(r["lang"], r["confidence"]) for r in got] == [("aa", 0.5)] * 3
