"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

A vector has a component for every word of a text, whether any example holds it or not; its weight is
(1 + log count) * (1 + log((1 + N) / (1 + examples that hold it))). The index has postings of every word of every
example, in blocks of examples, and for each word and block that has it the greatest weight. A document's words give
each block an upper bound of the cosine; blocks are scored from the greatest bound down until no bound exceeds the k-th
best cosine, so the neighbours are those of a full comparison, and a fitted text is its own nearest with 1.

The neighbours vote for their labels. How near a neighbour's vote is follows from the words, and beginnings of words,
that are associated with the labels: the cosine over those alone, as shares of the whole vectors' lengths. The nearest
of the neighbours in this sense vote, weighted by it; neighbours that share nothing of the kind say nothing. The share
of the votes is calibrated by isotonic regression on labelled rows, each scored by a model that was fitted without its
share of the rows; between the regression's steps the score is interpolated.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, give_back, mapped, own_columns, sent, small_batches, words_of, written

#: Examples in a block of the index.
BLOCK = 64
#: Bytes of a word's beginnings that are terms beside the word itself.
STARTS = (4, 5, 6, 7, 8)


@dataclass(frozen=True)
class Bounds:
    """The labelled rows that a model is fitted on at most, and its sizes."""

    toxic: int = 1000  # of label 1
    clean: int = 3000  # of label 0
    folds: int = 4  # shares of the rows, for the calibration
    text_bytes: int = 65536  # longer labelled texts are not fitted on; all texts are scored
    terms: int = 1500  # that weigh votes; the cosine that finds the neighbours is over all words
    association: float = 16.0  # chi-square with the label that a term has at least
    lift: float = 3.0  # times as frequent under one label as under the other, at least
    least: int = 4  # examples that hold a term at least
    neighbours: int = 100  # nearest examples by the cosine over all words
    voters: int = 15  # of them, the nearest by the associated terms
    doubt: float = 0.05  # votes that stand for no evidence, as a share of what examples of label 1 have


def term_counts(text: bytes | None) -> Counter:
    """Words with their numbers of occurrences; a word's beginnings count with it."""
    return Counter(words_of(text)) if text else Counter()


def terms_of(word: bytes) -> list[bytes]:
    return [word, *(word[:n] + b"*" for n in STARTS if len(word) >= n)]


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the spans, one span after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


class Index:
    """Postings of all words of the examples, sorted by word and example; a pair is a word's postings in a block."""

    def __init__(self, number: dict[bytes, int], rows: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray):
        """`rows` has each example's words, as the dictionary numbers them, and their weights as shares of its vector's length."""
        word = np.concatenate([w for w, _ in rows]) if rows else np.zeros(0, np.int64)
        weight = np.concatenate([x for _, x in rows]) if rows else np.zeros(0)
        example = np.repeat(np.arange(len(rows)), [len(w) for w, _ in rows])
        order = np.lexsort((example, word))
        word, self.weight, self.example = word[order], weight[order], example[order]
        self.number, self.idf, self.examples, self.blocks = number, idf, len(rows), -(-len(rows) // BLOCK)
        pair = word * max(1, self.blocks) + self.example // BLOCK
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        self.begin = np.append(first, len(pair))  # of each pair's postings
        self.block = self.example[first] // BLOCK
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.pairs = np.searchsorted(word[first], np.arange(len(idf) + 1))  # of each word

    def nearest(self, words: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int]]:
        """(cosine, example) of the k nearest, nearest first, equal ones by their number; those that share no word are none.

        Words that no example holds (-1) count for the length.
        """
        known = words >= 0
        weights, words = (weights / np.sqrt(weights @ weights))[known], words[known]
        sizes = self.pairs[words + 1] - self.pairs[words]
        pairs, by = _spans(self.pairs[words], sizes), np.repeat(weights, sizes)
        bound = np.bincount(self.block[pairs], by * self.most[pairs], self.blocks)
        order = np.argsort(-bound, kind="stable")
        some = -(-k // BLOCK) + 2  # blocks that hold over k examples; then all that may still hold a nearer one
        cosine = self._scored(pairs, by, order[:some])
        if len(cosine) > k:
            bar = np.partition(cosine, len(cosine) - k)[len(cosine) - k] - 1e-9
            rest = order[some:][bound[order[some:]] > max(bar, 0)]
            cosine = cosine if not len(rest) else cosine + self._scored(pairs, by, rest)
            bar = np.partition(cosine, len(cosine) - k)[len(cosine) - k] - 1e-9
        else:
            cosine, bar = cosine + self._scored(pairs, by, order[some:]), 0.0
        near = np.flatnonzero((cosine >= bar) & (cosine > 1e-12))
        near = near[np.lexsort((near, -np.round(cosine[near], 9)))][:k]
        return list(zip(cosine[near].tolist(), near.tolist(), strict=True))

    def _scored(self, pairs: np.ndarray, by: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        chosen = np.zeros(self.blocks, bool)
        chosen[blocks] = True
        at = chosen[self.block[pairs]]
        pairs = pairs[at]
        sizes = self.begin[pairs + 1] - self.begin[pairs]
        places = _spans(self.begin[pairs], sizes)
        return np.bincount(self.example[places], np.repeat(by[at], sizes) * self.weight[places], self.examples)


@dataclass
class Model:
    """Index, the terms that weigh votes, and the calibration; small enough to be sent to every executor."""

    bounds: Bounds
    index: Index | None = None
    terms: dict[bytes, int] = field(default_factory=dict)
    idf: np.ndarray | None = None  # of each term
    rarity: np.ndarray = field(default_factory=lambda: np.ones(1))  # idf by the number of examples that hold a word
    ids: list = field(default_factory=list)
    labels: np.ndarray | None = None
    tile: np.ndarray | None = None  # (term, block) -> its tile, 0 for none
    tiles: np.ndarray | None = None  # weights of a term in a block's examples
    unit: float = 1.0  # votes that an example of label 1 has
    steps: tuple[list[float], list[float]] = ((), ())
    starts: frozenset = frozenset()  # first bytes of the terms: most words have none of them
    words: int = 0  # terms from here on are beginnings; those before are words, which the length holds already

    def vector(self, counts: Counter, memory: dict) -> tuple[np.ndarray, np.ndarray]:
        """Associated terms of a document and their weights, as shares of the whole vector's length."""
        found: dict[int, int] = {}
        starts = self.starts
        for word, n in counts.items():
            if word[: STARTS[0]] in starts:
                held = memory.get(word)
                if held is None:
                    if len(memory) > 50_000:
                        memory.clear()
                    held = memory[word] = tuple(t for x in terms_of(word) if (t := self.terms.get(x)) is not None)
                for t in held:
                    found[t] = found.get(t, 0) + n
        if not found:
            return np.zeros(0, np.int64), np.zeros(0)
        terms = np.fromiter(found, np.int64, len(found))
        weights = (1 + np.log(np.fromiter(found.values(), np.float64, len(found)))) * self.idf[terms]
        whole = self.weights(counts)[1]
        beginnings = weights[terms >= self.words]
        return terms, weights / np.sqrt(whole @ whole + beginnings @ beginnings)

    def weights(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """The document's words, as the index numbers them (-1 for those of no example), and their weights."""
        words = np.fromiter(map(self.index.number.get, counts, repeat(-1)), np.int64, len(counts))
        idf = np.where(words >= 0, self.index.idf[words], self.rarity[0])
        return words, (1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))) * idf

    def neighbours(self, counts: Counter) -> list[tuple[float, int]]:
        """(cosine, example) of the nearest examples by the cosine over all words."""
        return self.index.nearest(*self.weights(counts), self.bounds.neighbours) if counts and self.index and self.index.examples else []

    def voters(self, counts: Counter, memory: dict) -> list[tuple[float, float, int]]:
        """(vote, cosine, example) of the nearest examples that vote, the heaviest first.

        A document without associated terms shares none with any example: it has no voters, and none are looked for.
        """
        terms, weights = self.vector(counts, memory)
        near = self.neighbours(counts) if len(terms) else []
        if not near:
            return []
        examples = np.array([e for _, e in near])
        votes = weights @ self.tiles[self.tile[terms[:, None], examples[None, :] // BLOCK], examples[None, :] % BLOCK]
        heard = np.flatnonzero(votes > 1e-12)
        heard = heard[np.lexsort((heard, -np.round(votes[heard], 9)))][: self.bounds.voters]
        return [(float(votes[k]), *near[k]) for k in heard.tolist()]

    def raw(self, votes: list[tuple[float, float, int]]) -> float:
        """Share of the votes for label 1, each by its weight; few or light votes say little."""
        return self.share(*self.raw_parts(votes))

    def raw_parts(self, votes: list[tuple[float, float, int]]) -> tuple[float, float]:
        """Votes for label 1, and all votes."""
        return float(sum(v * self.labels[e] for v, _, e in votes)), float(sum(v for v, _, _ in votes))

    def share(self, toxic: float, both: float) -> float:
        return toxic / (both + self.bounds.doubt * self.unit)

    def calibrated(self, raw: float) -> float:
        """Calibrated score; it grows with the raw one."""
        at, value = self.steps
        if not len(at):
            return 0.0
        return min(1.0, max(0.0, 0.99 * float(np.interp(raw, at, value)) + 0.01 * raw))


class _Counted:
    """Fitted rows as numbers: each row's words with their counts, and the terms of each word."""

    def __init__(self, rows: list[tuple[object, bytes, int]]):
        number: dict[bytes, int] = {}
        self.ids, self.labels = [i for i, _, _ in rows], np.array([int(y) for _, _, y in rows], np.int64)
        self.words, self.counts = [], []
        for _, text, _ in rows:
            counts = term_counts(text)
            self.words.append(np.fromiter((number.setdefault(w, len(number)) for w in counts), np.int32, len(counts)))
            self.counts.append(np.fromiter(counts.values(), np.int32, len(counts)))
        # terms: the words, then the beginnings; each word's own are listed in a row, -1 for none
        self.terms = list(number)
        self.word_terms = np.full((len(self.terms), 1 + len(STARTS)), -1, np.int32)
        beginnings: dict[bytes, int] = {}
        for k, word in enumerate(number):
            of = [k, *(beginnings.setdefault(t, len(number) + len(beginnings)) for t in terms_of(word)[1:])]
            self.word_terms[k, : len(of)] = of
        self.n_words = len(number)
        self.terms += list(beginnings)

    def held(self, rows: np.ndarray) -> np.ndarray:
        """(label, term) -> rows that hold the term."""
        out = np.zeros((2, len(self.terms)), np.int64)
        for k in rows.tolist():
            of = np.unique(self.word_terms[self.words[k]])
            out[self.labels[k], of[of >= 0]] += 1
        return out


def fit(rows: list[tuple], bounds: Bounds = Bounds(), weights: tuple[float, float] = (1.0, 1.0)) -> Model:
    """A calibrated model of labelled rows (id, text in UTF-8, label).

    `weights` tells how many rows of label 0 and of label 1 each given one stands for.
    """
    rows = list({t: (i, t, y) for i, t, y in reversed(rows)}.values())[::-1]  # copies of a text say nothing new
    counted, every = _Counted(rows), np.arange(len(rows))
    whole, found = counted.held(every), []
    for fold in range(bounds.folds):
        mine = every[fold :: bounds.folds]
        part = build(counted, np.setdiff1d(every, mine), whole - counted.held(mine), bounds)
        memory: dict = {}
        for k in mine.tolist():
            found.append((part.raw_parts(part.voters(term_counts(rows[k][1]), memory)), int(rows[k][2])))
        del part, memory
        give_back()  # the driver lives on
    model = build(counted, every, whole, bounds)
    votes = [both for (_, both), y in found if y and both > 0]
    model.unit = float(np.median(votes)) if votes else 1.0
    model.steps = curve([(model.share(*parts), y, weights[y]) for parts, y in found])
    del counted
    give_back()
    return model


def build(counted: _Counted, rows: np.ndarray, held: np.ndarray, bounds: Bounds) -> Model:
    """Index, terms and weights of some of the rows, not calibrated; `held` has the rows of each label with each term."""
    model = Model(bounds)
    n = np.bincount(counted.labels[rows], minlength=2).astype(np.float64)
    total = len(rows)
    b, a = held.astype(np.float64)
    rest = (a + b) * (total - a - b) * n[0] * n[1]
    association = np.where(rest > 0, total * (a * n[0] - b * n[1]) ** 2 / np.where(rest > 0, rest, 1), 0.0)  # chi-square
    share_a, share_b = (a + 0.5) / (n[1] + 1), (b + 0.5) / (n[0] + 1)
    lift = np.maximum(share_a / share_b, share_b / share_a)
    good = np.flatnonzero((a + b >= bounds.least) & (association >= bounds.association) & (lift >= bounds.lift)).tolist()
    good.sort(key=lambda t: (-association[t], counted.terms[t]))
    chosen = np.sort(np.array(good[: bounds.terms], np.int64))  # words first, beginnings after them
    number = (a + b).astype(np.int64)
    model.rarity = 1 + np.log((1 + total) / (1 + np.arange(total + 1)))
    model.terms = {counted.terms[t]: j for j, t in enumerate(chosen.tolist())}
    model.words = int((chosen < counted.n_words).sum())
    model.starts = frozenset(t[: STARTS[0]] for t in model.terms)
    model.idf = model.rarity[number[chosen]] if len(chosen) else np.zeros(1)
    place = np.full(len(counted.terms) + 1, -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    vectors = []
    for k in rows.tolist():
        words, counts = counted.words[k], counted.counts[k]
        of = place[counted.word_terms[words]]  # -1 takes the last place, which is -1
        at = of >= 0
        terms, where = np.unique(of[at], return_inverse=True)
        weights = (1 + np.log(np.bincount(where, np.repeat(counts, at.sum(axis=1)), len(terms)))) * model.idf[terms]
        whole = (1 + np.log(counts)) * model.rarity[number[words]]
        length = np.sqrt(whole @ whole + (weights[terms >= model.words] ** 2).sum())
        vectors.append((terms, weights / length if length else weights, k, whole / np.sqrt(whole @ whole) if len(whole) else whole))
    # Examples with the same widespread words, so mostly of one language, lie together: many blocks have low bounds.
    common = {k: words[np.lexsort((words, -number[words]))[:3]].tolist() for _, _, k, _ in vectors for words in (counted.words[k],)}
    vectors.sort(key=lambda v: (common[v[2]], v[2]))
    model.ids, model.labels = [counted.ids[v[2]] for v in vectors], np.array([counted.labels[v[2]] for v in vectors], np.float64)
    blocks = max(1, -(-len(vectors) // BLOCK))
    model.tile = np.zeros((len(chosen) or 1, blocks), np.int32)
    tiles = [np.zeros(BLOCK)]
    for e, (terms, weights, _, _) in enumerate(vectors):
        for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
            if not model.tile[t, e // BLOCK]:
                model.tile[t, e // BLOCK] = len(tiles)
                tiles.append(np.zeros(BLOCK))
            tiles[model.tile[t, e // BLOCK]][e % BLOCK] = w
    model.tiles = np.array(tiles)
    words = {counted.terms[k]: k for k in range(counted.n_words)}
    model.index = Index(words, [(counted.words[k].astype(np.int64), whole) for _, _, k, whole in vectors], model.rarity[np.minimum(number[: counted.n_words], total)])
    return model


def _steps(pairs: list[tuple[float, int, float]]) -> list[list[float]]:
    """Steps of the isotonic regression: least and greatest raw score, sum of labels, number, rows."""
    merged: list[list[float]] = []

    def join() -> None:
        top = merged.pop()
        merged[-1] = [merged[-1][0], top[1], *(x + y for x, y in zip(merged[-1][2:], top[2:], strict=True))]

    for raw, y, weight in sorted(pairs):
        merged.append([raw, raw, y * weight, weight, 1])
        if len(merged) > 1 and merged[-2][1] == raw:
            join()
        while len(merged) > 1 and merged[-2][2] * merged[-1][3] >= merged[-1][2] * merged[-2][3]:
            join()
    return merged


def isotonic(pairs: list[tuple[float, int, float]]) -> tuple[list[float], list[float]]:
    """Least raw score of each step and the step's share of label 1, which never falls."""
    merged = _steps(pairs)
    return [m[0] for m in merged], [m[2] / m[3] for m in merged]


def curve(pairs: list[tuple[float, int, float]]) -> tuple[list[float], list[float]]:
    """Raw scores and shares of label 1 between which the score is interpolated: both ends of each step.

    A step's share counts one more row with the share of all, so that a step of few rows isn't certain.
    """
    merged = _steps(pairs)
    if not merged:
        return [], []
    whole = sum(m[2] for m in merged) / sum(m[3] for m in merged)
    shares = [(m[2] + whole * m[3] / m[4]) / (m[3] + m[3] / m[4]) for m in merged]
    shares = np.maximum.accumulate(shares).tolist()
    return [x for m in merged for x in m[:2]], [v for v in shares for _ in range(2)]


def is_held_out(column: Column) -> Column:
    """Whether labels of a row are never learnt from: crc32 of the id as text, mod 3, is 1."""
    return F.crc32(column.cast("string").cast("binary")) % 3 == 1


def learn(documents: DataFrame, labels: DataFrame, bounds: Bounds = Bounds()) -> Model:
    """Fit a model on labelled documents that are not held out: bounded samples by a hash of their ids.

    Rows of labels with null id or label are ignored, an id with both labels counts as toxic; labels of absent or too
    long documents take no place in the samples. Without labelled documents every score is 0.
    """
    spark = documents.sparkSession
    labels = own_columns(labels, doc_id="doc_id", toxic="toxic").where("doc_id is not null and toxic in (0, 1)").where(~is_held_out(F.col("doc_id")))
    labels = sent(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "labels")
    texts = own_columns(documents, doc_id="doc_id", text="text").where(F.octet_length("text") <= bounds.text_bytes)
    labels = written(texts.select("doc_id").join(labels, "doc_id").distinct(), "labelled")
    there = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    order = F.xxhash64(F.col("doc_id").cast("string"))
    clean, toxic = (labels.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(most) for y, most in ((0, bounds.clean), (1, bounds.toxic)))
    chosen = {r["doc_id"]: r["toxic"] for r in clean.unionByName(toxic).collect()}
    named = spark.createDataFrame([(k,) for k in chosen], f"doc_id {dict(labels.dtypes)['doc_id']}")
    rows: dict = {}
    for r in texts.join(F.broadcast(named), "doc_id").select("doc_id", F.col("text").cast("binary").alias("text")).toLocalIterator():
        text = bytes(r["text"] or b"")
        rows[r["doc_id"]] = min(text, rows.get(r["doc_id"], text))  # of texts that share an id, the first in order
    some = [(k, rows[k], chosen[k]) for k in sorted(rows, key=lambda k: hashlib.sha256(str(k).encode()).digest())]
    weights = [there.get(y, 0) / max(1, sum(v == y for v in chosen.values())) for y in (0, 1)]
    return fit(some, bounds, (weights[0], weights[1]))


def score(documents: DataFrame, model: Model, threshold: float = 0.7, evidence: bool = True) -> DataFrame:
    """Score of every whole text: doc_id, score, predicted and, if asked for, the neighbours as evidence.

    `evidence` is an array of (doc_id, label, cosine, vote): the neighbours that vote. A text without any word, an
    empty or a null one, has no neighbours; it and a text whose neighbours share none of the associated terms with it
    get the calibrated score of no votes. Repeated rows each get a row.
    """
    spark = documents.sparkSession
    small_batches(spark)
    kind = dict(documents.dtypes)["doc_id"]
    given = spark.sparkContext.broadcast(model)
    example = {k: str(v) for k, v in enumerate(model.ids)}

    def rows(batches) -> Iterator[list]:
        model, memory = given.value, {}
        for batch in batches:
            scores, proofs = [], []
            for text in as_bytes(batch.column(1)):
                votes = model.voters(term_counts(text), memory)
                scores.append(model.calibrated(model.raw(votes)))
                if evidence:
                    proofs.append([{"doc_id": example[e], "label": int(model.labels[e]), "cosine": c, "vote": v} for v, c, e in votes])
            yield [batch.column(0), scores, [int(s >= threshold) for s in scores]] + [proofs] * evidence

    schema = f"doc_id {kind}, score double, predicted int" + ", evidence array<struct<doc_id: string, label: int, cosine: double, vote: double>>" * evidence
    return mapped(own_columns(documents, doc_id="doc_id", text="text"), rows, schema)


def accepted(documents: DataFrame, model: Model, threshold: float = 0.7, text_column: str = "text") -> DataFrame:
    """The documents whose score stays below the threshold; all columns stay."""
    small_batches(documents.sparkSession)
    given = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text_column)

    def rows(batches) -> Iterator:
        model, memory = given.value, {}
        for batch in batches:
            raw = (model.raw(model.voters(term_counts(t), memory)) for t in as_bytes(batch.column(at)))
            yield batch.filter(pa.array([model.calibrated(r) < threshold for r in raw], pa.bool_()))

    return documents.mapInArrow(rows, documents.schema)
