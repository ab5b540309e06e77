"""Benchmark decontamination over a distributed positional inverted index.

The index is a stored table of shards. A shard holds the postings of some documents: for each term its
sorted positions, documents lying one after another with a gap between them. Shards are built where the
documents lie, without a shuffle; no term's list, however common, is gathered from all of them.
A search starts from the rarest term of each phrase in the shard and intersects its offset-adjusted list
with those of the phrase's other terms, from rare to common.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cached_property
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, mapped, own_columns, row_key, sent, small_batches, words_of, written

#: Positions between two documents of a shard; a phrase and its slop are shorter.
GAP = 64
#: Tokens after which a shard ends (with the document they are in).
SHARD_TOKENS = 1_000_000
#: Places of a shard that a search works on at once.
EXPANDED = 1 << 19
#: Bytes of test texts that one search carries to the executors; more are searched block after block.
BLOCK_BYTES = 16 << 20

INDEX_COLUMNS = "shard string, starts array<int>, lengths array<int>, terms array<binary>, counts array<int>, positions binary"


def vocabulary(tests: DataFrame, text_column: str = "text") -> DataFrame:
    """Distinct words (binary) of the test texts."""

    def rows(batches) -> Iterator[list]:
        for batch in batches:
            yield [list({w for t in as_bytes(batch.column(0)) if t for w in words_of(t)})]

    return mapped(own_columns(tests, text=text_column), rows, "term binary").distinct()


def build_index(documents: DataFrame, terms: set[bytes] | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Shards: doc_ids, starts and lengths of their documents, and each term's sorted positions.

    `terms` keeps the postings of those words only; words that no test holds are counted but not stored.
    A null text has no words. Repeated rows are documents of their own.
    """
    small_batches(documents.sparkSession)
    kind = dict(documents.dtypes)[id_column]
    given = documents.sparkSession.sparkContext.broadcast(sorted(terms)) if terms is not None else None

    def rows(batches) -> Iterator[list]:
        known = {t: i for i, t in enumerate(given.value)} if given else {}
        docs, starts, lengths, parts, at = [], [], [], [], GAP
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                words = words_of(text) if text else []
                if given is None:
                    for w in words:
                        known.setdefault(w, len(known))
                parts.append(np.fromiter(map(known.get, words, repeat(-1)), np.int32, len(words)))
                docs.append(doc)
                starts.append(at)
                lengths.append(len(words))
                at += len(words) + GAP
                if at >= SHARD_TOKENS:
                    yield _shard(docs, starts, lengths, parts, known)
                    docs, starts, lengths, parts, at = [], [], [], [], GAP
                    if given is None:
                        known.clear()
        if docs:
            yield _shard(docs, starts, lengths, parts, known)

    return mapped(own_columns(documents, doc_id=id_column, text=text_column), rows, f"doc_ids array<{kind}>, {INDEX_COLUMNS}")


def _shard(docs: list, starts: list, lengths: list, parts: list, known: dict) -> list:
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    place = np.arange(len(ids), dtype=np.int32) + np.repeat(np.array(starts, np.int32) - np.cumsum([0, *lengths[:-1]], dtype=np.int32), lengths)
    kept = ids >= 0
    ids, place = ids[kept], place[kept]
    order = np.argsort(ids, kind="stable")
    found, counts = np.unique(ids, return_counts=True)
    by_id = list(known)
    return [[docs], [uuid.uuid4().hex], [starts], [lengths], [[by_id[i] for i in found]], [counts.tolist()], [place[order].astype("<i4").tobytes()]]


class Phrases:
    """Distinct phrases of test items: windows of `window` words, or the whole item where it is shorter."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        found: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            words = words_of(text) if text else []
            size = min(window, len(words))
            for k in range(len(words) - size + 1 if size else 0):
                found.setdefault(tuple(words[k : k + size]), set()).add(item)
        self.words = list(found)
        self.items = [sorted(found[w]) for w in self.words]
        self.terms = sorted({w for ws in self.words for w in ws})
        number = self.number = {t: i for i, t in enumerate(self.terms)}
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.ids = np.full((len(self.words), int(self.sizes.max(initial=1))), -1, np.int64)
        for k, ws in enumerate(self.words):
            self.ids[k, : len(ws)] = [number[w] for w in ws]


class Tests:
    """Test items that are sent to the workers, each of which makes the phrases of them once."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        self.items, self.window = items, window

    @cached_property
    def phrases(self) -> Phrases:
        return Phrases(self.items, self.window)


def _chunks(sizes: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(list, place in it) of all places of lists of these sizes, at most `most` at once."""
    ends = np.cumsum(sizes)
    for at in range(0, int(ends[-1]) if len(ends) else 0, most):
        places = np.arange(at, min(at + most, int(ends[-1])))
        row = np.searchsorted(ends, places, "right")
        yield row, places - (ends[row] - sizes[row])


def matches(phrases: Phrases, terms: list[bytes], counts: list[int], positions: bytes, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, start) of every match in a shard: each word within `slop` places of where the phrase has it.

    A phrase's search starts from its rarest word in the shard. That word's list is first intersected with its rarer
    neighbour's, once for all phrases that hold the two side by side; what is left of it is checked against the other
    words, from rare to common. At most `EXPANDED` places are in work at once, however many phrases or places there are.
    """
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(phrases.words):
        return nothing
    number = phrases.number
    mine = np.fromiter(map(number.get, terms, repeat(-1)), np.int64, len(terms))
    place = np.frombuffer(positions, "<i4").astype(np.int64)
    ends = np.cumsum(counts)
    used = np.flatnonzero(mine >= 0)
    used = used[np.argsort(mine[used], kind="stable")]
    if not len(used):
        return nothing
    span = int(place.max()) + 2 * GAP
    length = np.zeros(len(phrases.terms) + 1, np.int64)  # of each term's list; the last stands for no term
    length[mine[used]] = np.asarray(counts, np.int64)[used]
    lists = [place[ends[k] - counts[k] : ends[k]] for k in used]
    flat = np.concatenate(lists)
    keys = np.repeat(mine[used], [len(x) for x in lists]) * span + flat
    first = np.concatenate([[0], np.cumsum(length[:-1])])

    def near(term: np.ndarray, at: np.ndarray, reach: int) -> np.ndarray:
        """Whether the term stands within `reach` of the place; no term does."""
        target = term * span + at - reach
        found = np.minimum(np.searchsorted(keys, target), len(keys) - 1)
        return (term < 0) | (keys[found] >= target) & (keys[found] <= target + 2 * reach)

    never = np.iinfo(np.int64).max
    frequency = np.where(phrases.ids >= 0, length[phrases.ids], never)
    possible = np.flatnonzero((frequency > 0).all(axis=1))
    if not len(possible):
        return nothing
    frequency = frequency[possible]
    order = np.argsort(frequency, axis=1, kind="stable")
    rows, rare = np.arange(len(possible)), order[:, 0]
    beside = np.stack([np.where(rare > 0, frequency[rows, np.maximum(rare - 1, 0)], never), np.where(rare + 1 < frequency.shape[1], frequency[rows, np.minimum(rare + 1, frequency.shape[1] - 1)], never)])
    way = np.where(beside.min(axis=0) == never, 0, np.where(beside[0] < beside[1], -1, 1))
    ids = phrases.ids[possible]
    anchor, other = ids[rows, rare], np.where(way == 0, -1, ids[rows, np.clip(rare + way, 0, ids.shape[1] - 1)])
    pairs, pair = np.unique(np.stack([anchor, other, way]), axis=1, return_inverse=True)
    pair = pair.ravel()
    kept, by = [], []
    for row, within in _chunks(length[pairs[0]], EXPANDED):
        at = flat[first[pairs[0][row]] + within]
        good = near(pairs[1][row], at + pairs[2][row], 2 * slop)
        kept.append(at[good])
        by.append(row[good])
    kept, by = np.concatenate(kept), np.concatenate(by)
    sizes = np.bincount(by, minlength=pairs.shape[1])
    begin = np.cumsum(sizes) - sizes
    shift, out = np.arange(-slop, slop + 1), [nothing]
    for row, within in _chunks(sizes[pair], max(1, EXPANDED // len(shift))):
        start = kept[begin[pair[row]] + within] - rare[row]
        if slop:
            row, start = np.repeat(row, len(shift)), (start[:, None] + shift).ravel()
        for k in range(0 if slop else 1, order.shape[1]):
            offset = order[row, k]
            good = near(ids[row, offset], start + offset, slop)
            row, start = row[good], start[good]
        out.append((possible[row], start))
    phrase, start = (np.concatenate(x) for x in zip(*out, strict=True))
    return tuple(np.unique(np.stack([phrase, start]), axis=1)) if slop and len(phrase) else (phrase, start)


def search(index: DataFrame, tests: DataFrame, window: int = 10, slop: int = 0, item_column: str = "item_id", text_column: str = "text", folded: bool = True) -> DataFrame:
    """Documents of an index with the words that lie in occurrences of test windows.

    Returns a row for each document of the index: doc_id, n_words, n_hit (words inside any match), items
    (sorted strings: the tests with a match), contaminated. `folded=False` gives the matches themselves instead:
    doc_id, item, start (word position), n_words of the phrase. A test's windows are its runs of `window` words;
    a shorter one, if it has words, is one window. `slop` above 0 gives proximity matches. Tests with null id or
    text have none; rows that repeat an id add their windows. No test, or no document, gives no match, or no row.
    """
    if window + 2 * slop >= GAP:
        raise ValueError(f"window and slop must stay under {GAP} words")
    spark = index.sparkSession
    small_batches(spark)
    kind = dict(index.dtypes)["doc_ids"][6:-1]
    tests = own_columns(tests, item=item_column, text=text_column).where("item is not null and text is not null").select(F.col("item").cast("string"), F.col("text").cast("binary").alias("text"))
    total = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES) or 1
    out = None
    for block in range(blocks):  # each block is of bounded size; usually there is one
        items = [(r.item, bytes(r.text)) for r in tests.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()]
        given = spark.sparkContext.broadcast(Tests(items, window))

        def rows(batches, given=given) -> Iterator[list]:
            phrases = given.value.phrases
            for batch in batches:
                for s in batch.to_pylist():
                    yield _folded(s, phrases, slop) if folded else _listed(s, phrases, slop)

        columns = f"doc_id {kind}, " + ("n_words bigint, hit binary, items array<string>" if folded and blocks > 1 else "n_words bigint, n_hit bigint, items array<string>" if folded else "item string, start bigint, n_words bigint")
        if folded and blocks > 1:
            columns = f"shard string, place int, {columns}"

            def rows(batches, given=given) -> Iterator[list]:  # noqa: F811
                phrases = given.value.phrases
                for batch in batches:
                    for s in batch.to_pylist():
                        yield _masks(s, phrases, slop)

        part = mapped(index, rows, columns)
        out = part if out is None else out.unionByName(part)
    if folded and blocks > 1:
        out = _merged(out, kind)
    return out.withColumn("contaminated", F.col("n_hit") > 0) if folded else out


def _found(s: dict, phrases: Phrases, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrase, document and start of each match, and the mask of hit positions of the shard."""
    phrase, start = matches(phrases, s["terms"], s["counts"], s["positions"], slop)
    starts, lengths = np.array(s["starts"], np.int64), np.array(s["lengths"], np.int64)
    doc = np.searchsorted(starts, start, side="right") - 1
    inside = (doc >= 0) & (start + phrases.sizes[phrase] <= starts[doc] + lengths[doc])
    phrase, start, doc = phrase[inside], start[inside], doc[inside]
    edge = np.zeros(int(starts[-1] + lengths[-1]) + 2, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + phrases.sizes[phrase], -1)
    return phrase, doc, start, np.cumsum(edge) > 0


def _items(phrase: np.ndarray, doc: np.ndarray, phrases: Phrases, n: int) -> list[list[str]]:
    of: dict[int, set[str]] = {}
    for d, p in set(zip(doc.tolist(), phrase.tolist(), strict=True)):
        of.setdefault(d, set()).update(phrases.items[p])
    return [sorted(of.get(d, ())) for d in range(n)]


def _folded(s: dict, phrases: Phrases, slop: int) -> list:
    phrase, doc, _, hit = _found(s, phrases, slop)
    total = np.concatenate([[0], np.cumsum(hit)])
    starts, lengths = np.array(s["starts"], np.int64), np.array(s["lengths"], np.int64)
    return [s["doc_ids"], s["lengths"], (total[starts + lengths] - total[starts]).tolist(), _items(phrase, doc, phrases, len(starts))]


def _listed(s: dict, phrases: Phrases, slop: int) -> list:
    phrase, doc, start, _ = _found(s, phrases, slop)
    rows = [(s["doc_ids"][d], item, int(p - s["starts"][d]), len(phrases.words[w])) for w, d, p in zip(phrase.tolist(), doc.tolist(), start.tolist(), strict=True) for item in phrases.items[w]]
    return [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], [], []]


def _masks(s: dict, phrases: Phrases, slop: int) -> list:
    phrase, doc, _, hit = _found(s, phrases, slop)
    masks = [np.packbits(hit[a : a + n]).tobytes() for a, n in zip(s["starts"], s["lengths"], strict=True)]
    n = len(masks)
    return [[s["shard"]] * n, list(range(n)), s["doc_ids"], s["lengths"], masks, _items(phrase, doc, phrases, n)]


def _merged(out: DataFrame, kind: str) -> DataFrame:
    """One row for each document of several blocks' rows."""

    def rows(batches) -> Iterator[list]:
        for batch in batches:
            hit = []
            for masks in batch.column(2).to_pylist():
                whole = np.zeros(len(masks[0]), np.uint8)
                for m in masks:
                    whole |= np.frombuffer(m, np.uint8)
                hit.append(int(np.unpackbits(whole).sum()))
            yield [batch.column(0), batch.column(1), hit, batch.column(3)]

    grouped = out.groupBy("shard", "place", "doc_id", "n_words").agg(F.collect_list("hit").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return mapped(grouped.select("doc_id", "n_words", "hits", "items"), rows, f"doc_id {kind}, n_words bigint, n_hit bigint, items array<string>")


def decontaminate(documents: DataFrame, tests: DataFrame, window: int = 10, slop: int = 0, whole: bool = True) -> DataFrame:
    """Index the documents, store the index in the shared folder, and search it for the tests' windows.

    The stored index holds every word, so `search` takes other tests to it later; without `whole` it holds the words of
    these tests alone, which is smaller.
    """
    small_batches(documents.sparkSession)
    held = None
    if not whole:
        terms = vocabulary(tests)
        size = terms.agg(F.sum(F.length("term"))).first()[0] or 0
        held = {bytes(r.term) for r in terms.collect()} if size <= BLOCK_BYTES else None
    return search(written(build_index(documents, held), "postings"), tests, window, slop)


def cleaned(documents: DataFrame, tests: DataFrame, window: int = 10, slop: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents without a word in an occurrence of a test's window; all columns stay."""
    marked = documents.withColumn("_row", row_key(id_column, text_column))
    found = decontaminate(marked.select(F.col("_row").alias("doc_id"), F.col(f"`{text_column}`").alias("text")), tests, window, slop, whole=False)
    return marked.join(sent(found.where("contaminated").select(F.col("doc_id").alias("_row")), "contaminated"), "_row", "left_anti").drop("_row")


def digest_items(df: DataFrame) -> DataFrame:
    """Items as their number and the digest of their ids joined by commas."""
    return df.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
