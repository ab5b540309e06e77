"""Language of pages by fusing evidence: text, declared markup language, address suffix, host.

Character triples counted over all labelled documents give a text's likelihood in each language. What a declared
language or an address suffix says is learnt from the pages themselves: grouped sums of the pages' text posteriors
give P(declared | language) and P(suffix | language). A host's prior is the share of each language among its other
pages, smoothed towards that of its site (the last three labels), that towards its domain's (the last two), and that
towards all pages': a domain that many owners share, like co.uk, says little, and their sites speak for themselves.
Bayes' rule joins the four.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import html
from .common import SENT_KEYS, left_beside, mapped, own_columns, small_batches, written

#: Cells that character triples are counted in.
CELLS = 1 << 14
#: A text counts as at most so many independent triples, as neighbouring ones depend on each other.
INDEPENDENT = 60
#: Pages that a smoothed count weighs as much as.
SMOOTHING = 5.0

#: Tags that may declare a language, and where in them it stands; what is read once is not given back.
OPEN = re.compile(r"<(html|meta)\b", re.I)
CONTENT_LANGUAGE = re.compile("content-language", re.I)
LANG, CONTENT = (re.compile(name + r"\s*+=\s*+(?:[\"']\s*+)?([a-zA-Z]{2,3})\b", re.I) for name in (r"\blang", "content"))
HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", re.I)


def cells(text: str) -> np.ndarray:
    """The cell of each character triple of a text without case."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    if len(c) < 3:
        return np.zeros(0, np.int64)
    h = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1]) * np.uint64(0x85EBCA6B) + c[2:]
    h *= np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(50)).astype(np.int64)


def triples(documents: DataFrame, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """lang, cell, n: character triples of all documents with a language."""
    small_batches(documents.sparkSession)

    def rows(batches) -> Iterator[list]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            texts: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text)
            for lang, some in texts.items():
                found = np.bincount(cells("\n".join(some)), minlength=CELLS)
                counts[lang] = counts[lang] + found if lang in counts else found
        for lang, found in counts.items():
            at = np.flatnonzero(found)
            yield [[lang] * len(at), at.tolist(), found[at].tolist()]

    documents = own_columns(documents, text=text_column, lang=lang_column).where("text is not null and lang is not null")
    return mapped(documents, rows, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


class Languages:
    """Log-likelihoods of cells in each language: a number for each language and cell."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.names = sorted(counts)
        n = np.array([counts[k] for k in self.names], np.float64).reshape(len(self.names), CELLS)
        # smoothed towards all languages' shares, so that a cell that one has never shown tells little
        whole = (n.sum(axis=0) + 1) / (n.sum() + CELLS)
        self.table = np.log((n + 1000 * whole) / (n.sum(axis=1, keepdims=True) + 1000))

    def likelihood(self, text: str) -> list[float]:
        """Log-likelihoods in each language, those of a long text scaled down to `INDEPENDENT` triples."""
        at = cells(text)
        if not len(at) or not self.names:
            return [0.0] * len(self.names)
        return (self.table[:, at].sum(axis=1) * min(1.0, INDEPENDENT / len(at))).tolist()


def learn(documents: DataFrame, text_column: str = "text", lang_column: str = "lang") -> Languages:
    """The languages of all documents that name theirs; what is gathered is languages * cells, however many documents."""
    counts: dict[str, np.ndarray] = {}
    for r in triples(documents, text_column, lang_column).toLocalIterator():
        counts.setdefault(r["lang"], np.zeros(CELLS))[r["cell"]] = r["n"]
    return Languages(counts)


def declared(page: str | None) -> str | None:
    """The language that the markup declares: its first subtag in lower case. The whole page is read, in linear time."""
    ends = {"html": 0, "meta": 0}
    for m in OPEN.finditer(page or ""):
        tag = m[1].lower()
        if m.start() < ends[tag]:  # in a tag that an earlier one of the kind has opened and that says nothing
            continue
        at, close = m.end(), page.find(">", m.end())
        end = ends[tag] = close if close >= 0 else len(page)
        if tag == "meta":
            name = CONTENT_LANGUAGE.search(page, at, end)
            found = CONTENT.search(page, name.end(), end) if name else None
        else:
            found = LANG.search(page, at, end)
        if found:
            return found[1].lower()
    return None


def address(url: str | None) -> tuple[str | None, str | None, str | None]:
    """(suffix, domain, host) of an address; null where it names no host."""
    m = HOST.match(url or "")
    if not m:
        return None, None, None
    host = m[1].lower().rstrip(".")
    parts = host.split(".")
    return (parts[-1], ".".join(parts[-2:]), host) if len(parts) > 1 else (None, host, host)


def evidence(pages: DataFrame, languages: Languages, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, declared, suffix, domain, host, site, n_chars and the text's log-likelihoods of every page."""
    spark = pages.sparkSession
    small_batches(spark)
    kind = dict(pages.dtypes)[id_column]
    pages = own_columns(pages, page_id=id_column, url=url_column, html=html_column)
    given, model = spark.sparkContext.broadcast(languages), spark.sparkContext.broadcast(html.train())

    def rows(batches) -> Iterator[list]:
        for batch in batches:
            sources = batch.column(2).to_pylist()
            texts = html.texts(sources, model.value)
            told = [address(u) for u in batch.column(1).to_pylist()]
            yield [batch.column(0), [declared(p) for p in sources], *([t[k] for t in told] for k in range(3)), [h and ".".join(h.split(".")[-3:]) for _, _, h in told], [len(t) for t in texts], [given.value.likelihood(t) for t in texts]]

    return mapped(pages, rows, f"page_id {kind}, declared string, suffix string, domain string, host string, site string, n_chars bigint, likelihood array<double>")


def _softmax(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def _sums(k: int) -> list[Column]:
    """The sums of an array column's elements, as an array."""
    return [F.array(*[F.sum(F.col("p")[i]) for i in range(k)])]


def identify(pages: DataFrame, documents: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """The likeliest language of every page, learnt from the documents that name theirs.

    Returns page_id, lang, confidence (posterior, rounded to 6 places), text_lang (by text alone; null without text),
    declared, suffix, host, n_chars. Ties go to the first name. Missing evidence of a kind says nothing: a page with
    none at all gets the commonest language. A row for each page, repeated rows included; without any labelled
    document lang and confidence are null.
    """
    languages = learn(documents)
    names, k = languages.names, len(languages.names)
    found = evidence(pages, languages, id_column, url_column, html_column)
    plain = ["page_id", "declared", "suffix", "host", "n_chars"]
    if not k:
        return found.select("page_id", *[F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("confidence", "double"), ("text_lang", "string"))], *plain[1:])
    found = written(found.withColumn("p", _softmax(F.col("likelihood"))), "evidence")
    known = found.where("n_chars > 0")
    whole = known.agg(_sums(k)[0].alias("p")).first()["p"] or [None] * k
    mass = [float(v or 0.0) for v in whole]
    root = [(v + SMOOTHING / k) / (sum(mass) + SMOOTHING) for v in mass]
    array = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    out = found
    for kind in ("declared", "suffix"):  # P(value | language), smoothed towards P(value)
        counts = known.where(F.col(kind).isNotNull())
        held = counts.agg(_sums(k)[0].alias("p")).first()["p"] or []
        held = [float(v or 0.0) for v in held] or [0.0] * k
        counts = counts.groupBy(kind).agg(_sums(k)[0].alias("c"))
        share = F.aggregate("c", F.lit(0.0), lambda a, v: a + v) / max(sum(held), 1e-9)
        said = F.zip_with("c", array(held), lambda c, n: F.log((c + SMOOTHING * F.col("_share")) / (n + SMOOTHING)))
        counts = counts.withColumn("_share", F.greatest(share, F.lit(1e-9))).select(kind, said.alias(f"said_{kind}"))
        out = out.join(counts, kind, "left")
    for kind in ("domain", "site", "host"):
        counts = known.where(F.col(kind).isNotNull()).groupBy(kind).agg(_sums(k)[0].alias(f"in_{kind}"), F.count("*").alias("pages"))
        out = left_beside(out, counts, kind, "pages", SENT_KEYS // (1 + k // 8), kind)
    none = array([0.0] * k)
    own = F.when(F.col("n_chars") > 0, F.col("p")).otherwise(none)

    def smoothed(counts: Column, towards: Column) -> Column:
        other = F.zip_with(F.coalesce(counts, none), own, lambda c, p: F.greatest(c - p, F.lit(0.0)))  # without the page itself
        total = F.aggregate(other, F.lit(0.0), lambda a, v: a + v)
        return F.zip_with(other, towards, lambda c, t: (c + SMOOTHING * t) / (total + SMOOTHING))

    out = out.withColumn("prior", smoothed(F.col("in_domain"), array(root)))
    for kind in ("site", "host"):
        out = out.withColumn("prior", smoothed(F.col(f"in_{kind}"), F.col("prior")))
    add = lambda x, y: F.zip_with(x, y, lambda a, b: a + b)
    score = add(F.transform("prior", lambda v: F.log(v)), F.col("likelihood"))
    for kind in ("declared", "suffix"):
        score = add(score, F.coalesce(F.col(f"said_{kind}"), none))
    out = out.withColumn("posterior", _softmax(score))
    best = lambda x: F.element_at(F.array(*map(F.lit, names)), F.array_position(x, F.array_max(x)).cast("int"))
    text_lang = F.when(F.col("n_chars") > 0, best(F.col("likelihood")))
    return out.select("page_id", best(F.col("posterior")).alias("lang"), F.round(F.array_max("posterior"), 6).alias("confidence"), text_lang.alias("text_lang"), *plain[1:])
