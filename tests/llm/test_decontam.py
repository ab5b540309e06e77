"""The index's matches against a scan of all places, exact and near, in one block and in several."""

import random
import re

import pytest

from brindle.llm import decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(doc, items, size=10, slop=0):
    d, hit, found = words(doc), set(), set()
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            for s in range(len(d) - n + 1):
                if slop:
                    good = all(any(0 <= s + j + e < len(d) and d[s + j + e] == w[k + j] for e in range(-slop, slop + 1)) for j in range(n))
                else:
                    good = d[s : s + n] == w[k : k + n]
                if good:
                    hit |= set(range(s, s + n))
                    found.add(str(item))
    return len(d), len(hit), sorted(found)


def made():
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(30)] + ["É", "naïve", "x1"]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.choice((3, 9, 10, 14, 25))))) for k in range(12)] + [(50, None), (51, "..."), (None, "w1"), (3, "w0 w0 w0")]
    docs = []
    for i in range(60):
        text = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        if i % 3 == 0:
            part = words(items[r.randrange(12)][1])
            at = r.randint(0, len(text))
            text[at:at] = part[r.randrange(3) :]
        docs.append((i, r.choice((" ", ", ", "\n-")).join(text).upper() if i % 2 else " ".join(text)))
    return docs + [(100, None), (101, ""), (102, "w0 " * 40_000), (5, docs[5][1])], items


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, items string, n_hit int").repartition(2), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [1 << 24, 40])
def test_against_a_scan(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontam, "SHARD_TOKENS", 500)
    docs, items = made()
    got = decontam.decontaminate(*frames(spark, docs, items)).collect()
    known = [x for x in items if x[0] is not None]
    texts = dict(docs)
    assert sorted(x["doc_id"] for x in got) == sorted(i for i, _ in docs)
    for x in got:
        want = brute(texts[x["doc_id"]], known) if x["doc_id"] != 102 else (40_000, 40_000, ["3"])
        assert (x["n_words"], x["n_hit"], x["items"]) == want and x["contaminated"] == (want[1] > 0)


def test_near_matches(spark):
    docs, items = made()
    docs, items = docs[:40], [x for x in items if x[0] is not None]
    got = decontam.decontaminate(*frames(spark, docs, items), window=5, slop=1).collect()
    for x in got:
        assert (x["n_words"], x["n_hit"], x["items"]) == brute(dict(docs)[x["doc_id"]], items, 5, 1)


def test_listed_matches(spark):
    docs, items = frames(spark, [(1, "a b c a b c")], [(7, "b c")])
    found = decontam.search(decontam.build_index(docs), items, folded=False).collect()
    assert sorted((x["doc_id"], x["item"], x["start"], x["n_words"]) for x in found) == [(1, "7", 1, 2), (1, "7", 4, 2)]


def test_cleaned(spark):
    docs, items = made()
    df, tests = frames(spark, docs, items)
    kept = sorted((x["doc_id"] for x in decontam.cleaned(df, tests).collect()))
    assert kept == sorted(i for i, t in docs if i != 102 and not brute(t, [x for x in items if x[0] is not None])[1])
    assert decontam.cleaned(df, tests.limit(0)).count() == len(docs) and decontam.cleaned(df, tests).columns == df.columns
    assert decontam.decontaminate(df.limit(0), tests).collect() == []


@pytest.mark.parametrize("slop", [0, 2])
def test_bounded_work_on_common_words(monkeypatch, slop):
    """Many phrases of few, common words: the same matches whatever the number of places in work."""
    r = random.Random(slop)
    vocabulary = [b"a", b"b", b"c", b"d"]
    text = [r.choice(vocabulary) for _ in range(400)]
    items = [(str(k), b" ".join(r.choice(vocabulary) for _ in range(r.choice((1, 2, 4, 6))))) for k in range(60)]
    phrases = decontam.Phrases(items, 5)
    shard = decontam._shard(["x"], [decontam.GAP], [len(text)], [decontam.np.array([vocabulary.index(w) for w in text], "i4")], dict.fromkeys(vocabulary))
    terms, counts, positions = shard[4][0], shard[5][0], shard[6][0]
    want = set()
    for p, ws in enumerate(phrases.words):
        for s in range(-slop, len(text) + slop + 1):
            if all(any(0 <= s + j + e < len(text) and text[s + j + e] == w for e in range(-slop, slop + 1)) for j, w in enumerate(ws)):
                want.add((p, s + decontam.GAP))
    for most in (1 << 19, 17):
        monkeypatch.setattr(decontam, "EXPANDED", most)
        phrase, start = decontam.matches(phrases, terms, counts, positions, slop)
        assert set(zip(phrase.tolist(), start.tolist(), strict=True)) == want and len(phrase) == len(want)


def test_one_stored_index_for_many_tests(spark):
    docs, items = made()
    frame, first = frames(spark, docs, items)
    index = decontam.written(decontam.build_index(frame), "postings")
    second = spark.createDataFrame([("new", "w5 w6 w7"), ("other", docs[7][1])], "item_id string, text string")
    key = lambda x: tuple(map(str, x))
    for tests in (first, second):
        by_index = sorted(map(tuple, decontam.search(index, tests).collect()), key=key)
        assert by_index == sorted(map(tuple, decontam.decontaminate(frame, tests, whole=False).collect()), key=key)
