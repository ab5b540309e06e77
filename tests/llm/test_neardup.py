"""The join against all pairs, on documents with copies, near copies and shared passages."""

import random

from brindle.llm import neardup
from brindle.llm.components import components

SCHEMA = "doc_id long, text string, row string, n int, kept string, component int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in rows], SCHEMA).repartition(3)


def sets_of(text, size):
    words = (text or "").encode()
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in words).split()
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def brute(rows, size):
    sets = {i: sets_of(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def made(seed=4, groups=14):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 5)))
    shared = [word() for _ in range(60)]
    rows, at = [], 0
    for g in range(groups):
        base = [word() for _ in range(r.choice((3, 8, 60, 200)))]
        for _ in range(r.choice((1, 2, 12, 25))):
            copy = list(base)
            for _ in range(r.choice((0, 0, 1, 2, 4, 8))):
                copy[r.randrange(len(copy))] = word()
            if g % 3 == 0:
                copy += shared
            rows.append((at, " ".join(copy) if r.random() < 0.7 else "  ".join(copy).upper()))
            at += 1
    return rows + [(at, None), (at + 1, ""), (at + 2, " \t\n"), (at + 3, "one"), (at + 4, "ONE"), (at + 5, "one two three"), (at + 6, "x " * 30_000)]


def test_against_all_pairs(spark):
    rows = made()
    got = neardup.grouped(frame(spark, rows), neardup.Join(words=4))
    assert {(x["doc_id"], x["n_shingles"], x["component_id"], x["kept"]) for x in got.collect()} == brute(rows, 4)


def test_small_nodes_and_blocks(spark):
    """Limits so low that nodes branch to the last depth and end in blocks: nothing is lost."""
    rows = made(9)
    got = neardup.grouped(frame(spark, rows), neardup.Join(words=4, small=3, depth=1))
    assert {(x["doc_id"], x["n_shingles"], x["component_id"], x["kept"]) for x in got.collect()} == brute(rows, 4)


def test_repeated_rows_and_null_ids(spark):
    text = "a b c d e f g h"
    rows = [(5, text), (5, text), (7, text), (None, text), (None, "q"), (9, "q r")]
    got = sorted(((x["doc_id"], x["component_id"], x["kept"]) for x in neardup.grouped(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 5, True), (5, 5, True), (7, 5, False), (None, 5, False), (None, None, False), (9, 9, True)], key=str)
    kept = sorted((x["doc_id"] or 0, x["text"]) for x in neardup.deduplicated(frame(spark, rows)).collect())
    assert kept == sorted([(5, text), (9, "q r"), (0, text), (0, "q")])
    assert neardup.deduplicated(frame(spark, rows)).columns == frame(spark, rows).columns


def test_empty(spark):
    assert neardup.grouped(frame(spark, [])).collect() == []
    assert neardup.deduplicated(frame(spark, [(1, None), (2, "")])).count() == 2


def test_components(spark):
    r = random.Random(2)
    chain = [(k, k + 1) for k in range(100, 140)]
    links = chain + [(r.randrange(40), r.randrange(40)) for _ in range(25)] + [(3, 3), (None, 4), (900, 800), (800, 900)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for p in links for x in p if x is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
