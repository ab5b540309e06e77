import functools
import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from brindle.llm import merkle
from brindle.llm.merkle import Shape, digest, manifest, merged, settled, verified

FIELDS = ("doc_id", "lang", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def grown(leaves, arity):
    """Root, and for each leaf its steps (place, siblings)."""
    steps, row, at = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(row) > 1:
        for k, a in enumerate(at):
            run = row[a // arity * arity : (a // arity + 1) * arity]
            steps[k].append((a % arity, run[: a % arity] + run[a % arity + 1 :]))
        row, at = [h(*row[k : k + arity]) for k in range(0, len(row), arity)], [a // arity for a in at]
    return row[0], steps


def brute(rows, arity):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    parts = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in names}
    trees = {g: grown([leaf(r) for r in parts[g]], arity) for g in names}
    root, upper = grown([trees[g][0] for g in names], arity) if names else ("", [])
    return [(r[0], g, leaf(r), trees[g][0], root, steps + up) for g, up in zip(names, upper, strict=True) for r, steps in zip(parts[g], trees[g][1], strict=True)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, lang string, text string, leaf string, tree int").repartition(4)


def check(spark, rows, shape):
    found = manifest(frame(spark, rows), FIELDS, "lang", "doc_id", shape)
    assert found.columns == ["doc_id", "lang", "leaf", "subroot", "root", "proof"]
    got = [(*tuple(r)[:5], [(s["place"], s["siblings"]) for s in r["proof"]]) for r in found.collect()]
    assert sorted(got, key=str) == sorted(brute(rows, shape.arity), key=str)
    assert verified(found).where("verified").count() == len(rows)


@pytest.mark.parametrize("shape", [Shape(), Shape(2, 2), Shape(3, 2), Shape(5, 1)])
def test_against_a_tree_in_one_place(spark, shape, monkeypatch):
    monkeypatch.setattr(merkle, "LEAST_LEAVES", 8)  # many tasks
    rng = random.Random(2)
    rows = [(k, rng.choice(["en", "en", "en", "de", "é", None]), f"text {k}") for k in range(150)] + [(500, "one", "alone")]
    check(spark, rows, shape)


def test_odd_rows(spark):
    rows = [(None, "en", "null id"), (None, "en", None), (1, "", ""), (1, None, None), (2, "en", "tie"), (2, "en", "other"), (3, "en", "twice"), (3, "en", "twice"), (4, "en", "long " * 50_000)]
    check(spark, rows, Shape())
    check(spark, rows, Shape(2, 1))
    check(spark, [(1, "en", "alone")], Shape())


def test_empty(spark):
    assert manifest(frame(spark, []), FIELDS, "lang", "doc_id").count() == 0


def test_every_row_its_own_group(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEAST_LEAVES", 8)
    check(spark, [(k, f"g{k:03}", "t") for k in range(70)], Shape(2, 3))


def test_what_is_tampered_with_is_found(spark):
    rows = [(k, "en" if k % 3 else "de", f"text {k}") for k in range(20)]
    other = F.when(F.col("doc_id") == 7, merkle.leaf_digest([F.col("doc_id"), F.col("lang"), F.lit("other")]))
    found = manifest(frame(spark, rows), FIELDS, "lang", "doc_id", more={"other": other})
    got = verified(found.withColumn("held", F.coalesce("other", "leaf")), "held")
    assert [r["doc_id"] for r in got.where("not verified").collect()] == [7]


def test_forests_merge_in_any_order_and_grouping():
    shape, leaves = Shape(3, 2), [h(str(k)).encode() for k in range(23)]
    one = lambda k: {(0, None): 23, (0, 0): {k: leaves[k]}, "high": {}}
    want = grown([x.decode() for x in leaves], 3)[0].encode()
    rng = random.Random(4)
    for _ in range(20):
        parts = [settled(one(k), shape) for k in range(23)]
        rng.shuffle(parts)
        while len(parts) > 1:  # a random tree of merges
            a, b = parts.pop(rng.randrange(len(parts))), parts.pop(rng.randrange(len(parts)))
            parts.append(merged(a, b, shape))
        assert parts[0][0, 3] == {0: want} and [k for k in parts[0] if k != "high" and k[1] is not None] == [(0, 3)]
    a, b, c = (functools.reduce(lambda x, y: merged(x, y, shape), [one(k) for k in r]) for r in ((0, 1, 7), (2, 6, 9), (8, 22, 10)))
    orders = [merged(merged(x, y, shape), z, shape) for x, y, z in itertools.permutations((a, b, c))] + [merged(a, merged(b, c, shape), shape)]
    nodes = [{k: v for k, v in o.items() if k == "high" or v} for o in orders]
    assert all(o == nodes[0] for o in nodes) and merged(a, {}, shape) == a


def test_digest_takes_hex():
    assert digest([b"ab", b"cd"]).decode() == h("abcd")
