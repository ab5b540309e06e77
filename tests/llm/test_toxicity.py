"""Neighbours against a full comparison, calibration, and held-out accuracy."""

import random
import string
import zlib
from collections import Counter
from math import log, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import toxicity

SLURS = "zugnak brofel trindop".split()


def made(n=400, seed=3):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(300)]
    rows = []
    for i in range(n):
        text, y = [r.choice(words) for _ in range(r.randint(5, 60))], int(r.random() < 0.25)
        if y:
            for _ in range(3):
                text.insert(r.randrange(len(text)), r.choice(SLURS) + r.choice(("", "er", "!!", ",")))
        rows.append((i, " ".join(text), y))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in rows], "doc_id long, text string, score string, predicted double")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows], "doc_id long, toxic int, text int")
    return docs, labels


def words_in(text):
    return Counter("".join(c.lower() if c in string.ascii_letters + string.digits or c > "\x7f" else " " for c in text).split())


def starts_in(text):
    out = Counter()
    for w, n in words_in(text).items():
        for k in (4, 5, 6, 7, 8):
            if len(w.encode()) >= k:
                out[w.encode()[:k] + b"*"] += n
    return out


def weighted(counts, held, n):
    return {t: (1 + log(k)) * (1 + log((1 + n) / (1 + held[t]))) for t, k in counts.items()}


def unit(v):
    length = sqrt(sum(x * x for x in v.values()))
    return {t: x / length for t, x in v.items()} if length else {}


def dot(a, b):
    return sum(x * b.get(t, 0) for t, x in a.items())


def independent(rows, model, texts):
    """For each text: cosines over all words, and votes over the associated terms, with every example."""
    fitted = list(dict.fromkeys(t for _, t, _ in rows))
    of_words = Counter(t for x in fitted for t in words_in(x))
    of_starts = Counter(t for x in fitted for t in starts_in(x))
    text_of = {i: t for i, t, _ in reversed(rows)}

    def both(text):
        plain = weighted(words_in(text), of_words, len(fitted))
        starts = weighted({t: k for t, k in starts_in(text).items() if t in model.terms}, of_starts, len(fitted))
        wide = unit({t.encode(): x for t, x in plain.items()} | starts)
        return unit(plain), {t: x for t, x in wide.items() if t in model.terms}

    examples = [both(text_of[i]) for i in model.ids]
    for text in texts:
        p, v = both(text)
        yield [dot(p, e) for e, _ in examples], [dot(v, e) for _, e in examples]


def ranked(values, most):
    return [e for _, e in sorted((-round(x, 9), e) for e, x in enumerate(values) if x > 1e-12)[:most]]


@pytest.mark.parametrize("block, neighbours", [(64, 100), (4, 7), (1, 3)])
def test_neighbours_votes_and_score_are_exact(monkeypatch, block, neighbours):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    rows = made(200)
    model = toxicity.fit([(i, t.encode(), y) for i, t, y in rows], toxicity.Bounds(neighbours=neighbours, voters=5))
    asked = [t for _, t, _ in made(40, 9)] + ["zugnak unseen words only", "zugnaker", "nothing of it", rows[0][1], ""]
    for text, (cosines, votes) in zip(asked, independent(rows, model, asked), strict=True):
        counts = toxicity.term_counts(text.encode())
        near = model.neighbours(counts)
        order = ranked(cosines, neighbours)
        assert [e for _, e in near] == order and [c for c, _ in near] == pytest.approx([cosines[e] for e in order], abs=1e-8)
        heard = [order[k] for k in ranked([votes[e] for e in order], 5)]
        got = model.voters(counts, {})
        assert [e for _, _, e in got] == heard and [v for v, _, _ in got] == pytest.approx([votes[e] for e in heard], abs=1e-8)
        whole = sum(votes[e] for e in heard)
        share = sum(votes[e] * model.labels[e] for e in heard) / (whole + model.bounds.doubt * model.unit)
        at, value = model.steps
        assert model.calibrated(model.raw(got)) == pytest.approx(min(1, max(0, 0.99 * float(np.interp(share, at, value)) + 0.01 * share)), abs=1e-7)


def test_a_fitted_text_is_its_own_nearest():
    rows = made(120)
    model = toxicity.fit([(i, t.encode(), y) for i, t, y in rows])
    for i, text, _ in rows[:30]:
        cosine, e = model.neighbours(toxicity.term_counts(text.encode()))[0]
        assert model.ids[e] == i and cosine == pytest.approx(1.0)


def test_score_has_no_cliff():
    model = toxicity.Model(toxicity.Bounds())
    model.steps = toxicity.curve([(0.0, 0, 1.0)] * 50 + [(0.95, 1, 1.0)] * 20)
    some = [model.calibrated(k / 100) for k in range(101)]
    assert some == sorted(some) and max(b - a for a, b in zip(some, some[1:])) < 0.02
    assert model.calibrated(0.94) > 0.9 and model.calibrated(0.05) < 0.1


def test_labels_of_absent_documents_take_no_place(spark):
    rows = made(300)
    docs, labels = frames(spark, rows)
    absent = spark.range(1000, 6000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic", "1 as text")
    bounds = toxicity.Bounds(toxic=40, clean=60)
    assert len(toxicity.learn(docs, labels.union(absent), bounds).ids) == len(toxicity.learn(docs, labels, bounds).ids) == 100


def test_held_out_accuracy(spark):
    rows = made()
    docs, labels = frames(spark, rows)
    model = toxicity.learn(docs, labels)
    got = {x["doc_id"]: x for x in toxicity.score(docs, model).collect()}
    held = [(got[i]["predicted"], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert all(0 <= x["score"] <= 1 and len(x["evidence"]) <= 15 for x in got.values())
    assert all(zlib.crc32(e["doc_id"].encode()) % 3 != 1 for x in got.values() for e in x["evidence"])
    kept = {x["doc_id"] for x in toxicity.accepted(docs, model).collect()}
    assert kept == {i for i, x in got.items() if not x["predicted"]} and toxicity.accepted(docs, model).schema == docs.schema


def test_held_out_rows(spark):
    df = spark.range(200).withColumn("out", toxicity.is_held_out(F.col("id")))
    assert all(r["out"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in df.collect())


def test_edges(spark):
    docs, labels = frames(spark, made())
    model = toxicity.learn(docs, labels)
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "zugnak " * 50_000)], "doc_id long, text string")
    got = toxicity.score(odd, model, evidence=False).collect()
    assert len(got) == 4 and all(0 <= x["score"] <= 1 for x in got)
    assert max(x["score"] for x in got if x["doc_id"]) < 0.7
    assert toxicity.score(odd.limit(0), model).collect() == []
    nothing = toxicity.learn(docs, labels.limit(0))
    assert {x["score"] for x in toxicity.score(docs.limit(5), nothing).collect()} == {0.0}
    nulls = labels.withColumn("toxic", F.lit(None).cast("int"))
    assert {x["predicted"] for x in toxicity.score(docs.limit(5), toxicity.learn(docs, nulls)).collect()} == {0}


def test_isotonic():
    at, value = toxicity.isotonic([(0.1, 0, 1.0), (0.2, 1, 1.0), (0.3, 0, 1.0), (0.4, 1, 2.0)])
    assert value == sorted(value) and at == sorted(at) and value[-1] == 1.0
