"""Personal data and what discloses it: base patterns, then terms by their information about the entities.

The base patterns find the protected entities. Corpus counts tell what a term in an entity's texts says about it:
with N documents, the pointwise mutual information log(N n(e,t) / (n(e) n(t))) as a share of the entity's own
information log(N / n(e)). It is 1 where the term occurs only with the entity, near 0 where the term tells
nothing. Terms from one threshold on are generalised, from a higher one on removed.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, as_bytes, mapped, own_columns, row_key, sent, small_batches, words_of, written

KINDS = ("email", "ip", "card", "phone")
#: Characters of an address before its sign, and the pattern after it.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Digits are taken whole, so a long run of them is read once; the matches are those of the plain pattern.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
DIGITS = re.compile("[0-9]+")

#: Terms that are sent to the executors at most; with more, all terms are counted and joined.
SENT_TERMS = 200_000
#: Pairs of an entity and a term that a task counts before it hands them on.
HELD_PAIRS = 200_000


@dataclass(frozen=True)
class Thresholds:
    generalise: float = 0.75
    remove: float = 0.95
    support: int = 3  # different texts that hold the term and the entity


def luhn(digits: str) -> bool:
    """Whether the digits' check sum holds."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0  # what lies before belongs to a match or to another sign
    at = text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL))
        free = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of addresses, IP addresses, card and phone numbers, by start, then kind."""
    out = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(map(len, DIGITS.findall(m[0]))) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def entity(text: str, span: tuple[int, int, str]) -> str:
    """An entity's name: its kind and value, without case and separators."""
    value = text[span[0] : span[1]]
    return f"{span[2]}:{value.lower() if span[2] in ('email', 'ip') else ''.join(DIGITS.findall(value))}"


def terms_of(text: str, spans: list[tuple[int, int, str]]) -> dict[str, list[int]]:
    """Where each word of the whole text starts, without the words that lie in an entity."""
    out: dict[str, list[int]] = {}
    k, end = 0, 0  # spans before k start before the word; end is the furthest of theirs
    for m in WORD.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            end = max(end, spans[k][1])
            k += 1
        if end <= m.start():
            out.setdefault(m[0].encode("utf-8", "replace").translate(LOWER).decode(), []).append(m.start())
    return out


def detect(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Base spans of every whole text, and the entities and words of texts that have any: doc_id, row, spans, entities, terms.

    `entities` and `terms` are null where there is no span. A null text counts as empty.
    """
    small_batches(documents.sparkSession)
    kind = dict(documents.dtypes)[id_column]
    documents = documents.select(F.col(f"`{id_column}`").alias("doc_id"), row_key(id_column, text_column).alias("row"), F.col(f"`{text_column}`").alias("text"))

    def rows(batches) -> Iterator[list]:
        for batch in batches:
            spans, entities, terms = [], [], []
            for text in batch.column(2).to_pylist():
                found = base_spans(text) if text else []
                spans.append([{"kind": k, "start": a, "end": b} for a, b, k in found])
                entities.append(sorted({entity(text, s) for s in found}) if found else None)
                terms.append([{"term": t, "at": at} for t, at in terms_of(text, found).items()] if found else None)
            yield [batch.column(0), batch.column(1), spans, entities, terms]

    return mapped(documents, rows, f"doc_id {kind}, row string, {SPANS}, entities array<string>, terms array<struct<term: string, at: array<int>>>")


SPANS = "spans array<struct<kind: string, start: int, end: int>>"


def document_counts(documents: DataFrame, terms: set[bytes] | None, text_column: str = "text") -> DataFrame:
    """term, n: documents that hold each of the terms, or each term of all."""
    given = documents.sparkSession.sparkContext.broadcast(terms)

    def rows(batches) -> Iterator[list]:
        held, counts = given.value, Counter()
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                if text:
                    words = set(words_of(text))
                    counts.update(words if held is None else words & held)
            if len(counts) > 200_000:
                yield [[w.decode("utf-8", "replace") for w in counts], list(counts.values())]
                counts.clear()
        yield [[w.decode("utf-8", "replace") for w in counts], list(counts.values())]

    return mapped(own_columns(documents, text=text_column), rows, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def pair_counts(texts: DataFrame, counts: dict[str, int] | None, highest: float, power: float) -> DataFrame:
    """entity, term, n_both, texts: rows and different texts that hold both, added up in each task before the shuffle.

    `texts` has copies, held (entity, n_entity) and terms. With `counts` a pair is left out only if no number of common
    texts could bring it to the threshold: n(e,t) <= n(e), so it takes n(t) <= highest * n(e) ** power.
    """
    given = texts.sparkSession.sparkContext.broadcast(counts)

    def told(pairs: dict[tuple[str, str], list[int]]) -> list[list]:
        return [[e for e, _ in pairs], [t for _, t in pairs], [n for n, _ in pairs.values()], [n for _, n in pairs.values()]]

    def rows(batches) -> Iterator[list]:
        known, pairs = given.value, {}
        for batch in batches:
            for copies, held, terms in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                some = sorted((0 if known is None else known[t], t) for t in terms if known is None or t in known)
                rarest = [n for n, _ in some]
                for e in held:
                    for _, t in some[: bisect.bisect_right(rarest, highest * e["n_entity"] ** power)]:
                        pair = pairs.setdefault((e["entity"], t), [0, 0])
                        pair[0] += copies
                        pair[1] += 1
                    if len(pairs) > HELD_PAIRS:
                        yield told(pairs)
                        pairs = {}
        yield told(pairs)

    found = mapped(texts.select("copies", "held", "terms"), rows, "entity string, term string, n_both bigint, texts bigint")
    return found.groupBy("entity", "term").agg(F.sum("n_both").alias("n_both"), F.sum("texts").alias("texts"))


def disclosing(documents: DataFrame, found: DataFrame, thresholds: Thresholds = Thresholds(), text_column: str = "text", each_entity: bool = True) -> DataFrame:
    """entity, term, disclosure of the pairs from the lower threshold on, by counts over whole documents.

    Entities that stand in just the same rows disclose the same, so one of them is counted for all: a directory of many
    addresses costs its words, not addresses times words. Without `each_entity` only that one is told.
    """
    total = documents.count()
    bearing = found.where("entities is not null")
    rows = bearing.groupBy("row").agg(F.count("*").alias("copies"))  # a text counts once as support
    each = bearing.select("row", F.explode("entities").alias("entity")).distinct().join(rows, "row")
    where = [F.bit_xor(F.xxhash64(F.lit(k), "row")).alias(f"rows{k}") for k in range(2)]  # two hashes of the set of rows
    entities = each.groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.count("*").alias("texts"), *where)
    entities = written(entities.where((F.col("texts") >= thresholds.support) & (F.col("n_entity") < total)), "supported")
    alike = ["n_entity", "texts", "rows0", "rows1"]
    ones = entities.groupBy(*alike).agg(F.min("entity").alias("one"))
    named = entities.join(ones, alike).select("entity", "one")
    entities = sent(ones.select(F.col("one").alias("entity"), "n_entity"), "entities")
    held = each.join(entities, "entity").groupBy("row").agg(F.first("copies").alias("copies"), F.collect_list(F.struct("entity", "n_entity")).alias("held"))
    names = bearing.select("row", F.transform("terms", lambda x: x["term"]).alias("terms")).dropDuplicates(["row"])
    texts = written(names.join(held, "row"), "texts")
    terms = texts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("texts"))
    terms = written(terms.where(F.col("texts") >= thresholds.support).select("term"), "terms")
    few = terms.count() <= SENT_TERMS
    chosen = {r["term"].encode() for r in terms.collect()} if few else None
    counts = written(document_counts(documents, chosen, text_column), "counts")
    highest = float(total) ** (1 - thresholds.generalise) * (1 + 1e-9)
    known = {r["term"]: r["n"] for r in counts.collect()} if few else None
    pairs = pair_counts(texts, known, highest, thresholds.generalise).where(F.col("texts") >= thresholds.support)
    pairs = pairs.join(entities, "entity").join(counts, "term")
    share = F.log(F.lit(float(total)) * F.col("n_both") / (F.col("n_entity") * F.greatest("n", "n_both"))) / F.log(F.lit(float(total)) / F.col("n_entity"))
    pairs = pairs.select("entity", "term", share.alias("disclosure")).where(F.col("disclosure") >= thresholds.generalise)
    return pairs.withColumnRenamed("entity", "one").join(named, "one").select("entity", "term", "disclosure") if each_entity else pairs


def sanitised_spans(documents: DataFrame, thresholds: Thresholds = Thresholds(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All spans of every whole text: doc_id, row, spans (kind, start, end), by start, then kind.

    Kinds are the base ones, and `generalise` or `remove` for terms that disclose an entity: all their places in the
    texts that hold the entity, however far from it. Base spans stay as found. Counts cover all rows; copies of a text
    count as rows but not as support. A row for each document, repeated rows included; a null or empty text has none;
    an empty table gives no rows.
    """
    found = written(detect(documents, id_column, text_column), "entities")
    pairs = written(disclosing(documents, found, thresholds, text_column, each_entity=False), "pairs")
    pairs = F.broadcast(pairs) if pairs.count() <= SENT_TERMS else pairs
    bearing = found.where("entities is not null")
    placed = bearing.select("row", F.explode("terms").alias("x")).select("row", "x.*").join(pairs, "term")
    placed = placed.join(bearing.select("row", F.explode("entities").alias("entity")).distinct(), ["row", "entity"], "left_semi")
    flagged = placed.groupBy("row", "term").agg(F.max("disclosure").alias("disclosure"), F.first("at").alias("at"))
    kind = F.when(F.col("disclosure") >= thresholds.remove, "remove").otherwise("generalise")
    flagged = flagged.select("row", kind.alias("kind"), F.explode("at").alias("start"), F.length("term").alias("n"))
    flagged = flagged.groupBy("row").agg(F.collect_list(F.struct("kind", "start", (F.col("start") + F.col("n")).alias("end"))).alias("more"))
    rank = F.array(*[F.lit(k) for k in (*KINDS, "generalise", "remove")])
    every = F.transform(F.concat("spans", F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,end:int>>"))), lambda s: F.struct(s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    ordered = F.transform(F.array_sort(every), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select("doc_id", "row", "spans").join(flagged, "row", "left").select("doc_id", "row", ordered.alias("spans"))


def digests(spans: DataFrame) -> DataFrame:
    """The spans' numbers, digest and text: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    told = lambda some: F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of(k) for k in KINDS]
    return spans.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def sanitise(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced: an entity by its kind, a general term by its class, a removed one by nothing.

    Where spans overlap, the one that starts first is told and the others go with it.
    """
    out, at = [], 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= at:
            out.append(text[at:start])
            word = text[start:end]
            out.append("" if kind == "remove" else f"[{kind.upper()}]" if kind != "generalise" else "[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[TERM]")
        at = max(at, end)
    return "".join(out) + text[at:]


def sanitised(documents: DataFrame, thresholds: Thresholds = Thresholds(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents with their texts sanitised; all other columns stay. Null texts stay null."""
    small_batches(documents.sparkSession)
    spans = sanitised_spans(documents, thresholds, id_column, text_column).where(F.size("spans") > 0)
    # rows of one key have the same id and text, so one of them tells the spans of all
    spans = spans.groupBy("row").agg(F.max("spans").alias("_spans")).withColumnRenamed("row", "_row")
    marked = documents.withColumn("_row", row_key(id_column, text_column)).join(spans, "_row", "left").drop("_row")
    at, schema = marked.columns.index(text_column), documents.schema

    def rows(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(batch.num_columns - 1).to_pylist()
            columns = batch.columns[:-1]
            if any(spans):
                texts = [t if t is None or not s else sanitise(t, [(x["start"], x["end"], x["kind"]) for x in s]) for t, s in zip(columns[at].to_pylist(), spans, strict=True)]
                columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return marked.mapInArrow(rows, schema)
