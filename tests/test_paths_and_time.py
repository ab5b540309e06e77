"""Landmark distances, sketches and joins in time, against plain Python."""

import datetime
import random
from collections import defaultdict
from heapq import heappop, heappush

import pytest
from pyspark.sql import functions as F

from brindle.operators import paths, sketches, temporal


def shortest(edges, source):
    near, dist, heap = defaultdict(list), {source: 0}, [(0, source)]
    for a, b, w in edges:
        near[a].append((b, w))
    while heap:
        d, a = heappop(heap)
        if d == dist[a]:
            for b, w in near[a]:
                if d + w < dist.get(b, float("inf")):
                    dist[b] = d + w
                    heappush(heap, (d + w, b))
    return dist


@pytest.mark.parametrize("weight", [None, "w"])
def test_distances_and_bounds(spark, weight):
    rng = random.Random(4)
    ways = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}", rng.randint(1, 9)) for _ in range(45)] + [("x", "y", 2)]
    odd = [(None, "n1", 1), ("n1", None, 1), ("n1", "n1", 1)] + ([("n1", "n2", 0), ("n1", "n2", None)] if weight else [])
    both = ways + [(b, a, w) for a, b, w in ways]
    near = spark.createDataFrame(both + odd, "id string, nbr string, w long").repartition(3)
    asked = ["n0", "n7", "nowhere"]
    plain = [(a, b, w if weight else 1) for a, b, w in both]
    found = paths.distances(near, spark.createDataFrame([(a,) for a in [*asked, "n0", None]], "landmark string"), weight)
    want = {(a, i): d for a in asked for i, d in shortest(plain, a).items()}
    assert {(r["landmark"], r["id"]): r["dist"] for r in found.collect()} == want and found.count() == len(want)
    ids = sorted({i for a, b, _ in ways for i in (a, b)})
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(60)] + [("n0", "x"), ("x", "y"), ("n3", "n3"), (None, "n1")]
    got = {(r["a"], r["b"]): r for r in paths.pair_bounds(spark.createDataFrame(pairs, "a string, b string"), found).collect()}
    assert set(got) == {p for p in pairs if p[0]}
    for (a, b), r in got.items():
        true = shortest(plain, a).get(b)
        if r["apart"]:
            assert true is None
        if r["lower"] is not None:
            assert r["lower"] <= true <= r["upper"] and r["exact"] == (r["lower"] == r["upper"])
        if "n0" in (a, b) and true is not None:
            assert r["exact"] and r["lower"] == true
    assert got["x", "y"]["lower"] is None and not got["x", "y"]["apart"] and got["n3", "n3"]["exact"]


def test_rounds_bound_the_edges(spark):
    near = spark.createDataFrame([(k, k + 1) for k in range(9)], "id long, nbr long")
    found = paths.distances(near, spark.createDataFrame([(0,)], "landmark long"), most_rounds=4)
    assert sorted(r["id"] for r in found.collect()) == [0, 1, 2, 3, 4]
    assert paths.distances(near.limit(0), spark.createDataFrame([(5,)], "landmark long")).collect()[0]["dist"] == 0


def test_landmarks(spark):
    near = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "a"), ("c", "a"), ("b", "c")], "id string, nbr string")
    assert [r[0] for r in paths.landmarks(near, 2).collect()] == ["a", "b"]


def test_sketches_merge_and_are_close(spark):
    rng = random.Random(8)
    rows = [(f"n{int(rng.paretovariate(0.7)) % 500}", f"m{rng.randrange(9000)}", rng.choice("abc"), rng.choice(["t", None])) for _ in range(20_000)]
    near = spark.createDataFrame([*rows, (None, "m", "a", "t"), ("n", None, "a", "t")], "id string, nbr string, kind string, type string").repartition(4)
    by, sets = ("kind", "type"), (("kind", "type"), ("kind",), ())
    stored = sketches.neighbourhoods(near, by)
    halves = sketches.neighbourhoods(near.where("nbr < 'm5'"), by, F.lit(100)).unionByName(sketches.neighbourhoods(near.where("nbr >= 'm5'"), by, F.lit(101)))
    for kept, same_nodes in ((stored, True), (halves, False)):  # parts by node, and parts that came one after the other
        told = {(r["level"], r["kind"], r["type"]): r for r in sketches.rolled_up(kept, by, sets).collect()}
        exact = {(r["level"], r["kind"], r["type"]): r for r in sketches.exact(near, by, sets).collect()}
        assert set(told) == set(exact) and len(told) == 6 + 3 + 1
        for key, e in exact.items():
            some = [r for r in rows if key[0] >= 3 or r[2] == key[1] and (key[0] > 0 or r[3] == key[2])]
            assert e["edges"] == len(some) == told[key]["edges"] and e["neighbours"] == len({r[1] for r in some})
            assert abs(told[key]["neighbours"] - e["neighbours"]) <= 4 * 1.04 / 64 * e["neighbours"] + 1
            if same_nodes:
                assert told[key]["nodes"] == e["nodes"]
                degrees = defaultdict(int)
                for r in some:
                    degrees[r[0], r[2], r[3]] += 1
                ranked = sorted(degrees.values())
                for q in (0.5, 0.9):
                    low, high = (ranked[min(len(ranked) - 1, max(0, int(len(ranked) * x)))] for x in (q - 0.05, q + 0.05))
                    assert low <= told[key][f"degree_{round(100 * q)}"] <= high


DAY = datetime.timedelta(days=1)
START = datetime.datetime(2020, 1, 1)


@pytest.mark.parametrize("strict", [False, True])
def test_as_of(spark, strict):
    rng = random.Random(strict)
    when = lambda: START + DAY * rng.randrange(400)
    left = [(k, rng.choice(["hot", "hot", "b", None]), when() if rng.random() < 0.95 else None, "x") for k in range(300)]
    right = [(rng.choice(["hot", "b", "c", None]), when() if rng.random() < 0.95 else None, n) for n in range(120)]
    right += [("b", START + 5 * DAY, 1000), ("b", START + 5 * DAY, 1001)]
    a = spark.createDataFrame([*left, left[0]], "k int, key string, at timestamp, n2 string").repartition(3)
    b = spark.createDataFrame(right, "key string, day timestamp, n int").repartition(2)
    for width in (7, 90, 4000):
        got = temporal.as_of(a, b, ("key",), "at", "day", ("n",), width * temporal.DAY, strict)
        assert got.columns == ["k", "key", "at", "n2", "day", "n"]
        want = []
        for k, key, at, x in [*left, left[0]]:
            some = [(d, n) for q, d, n in right if q is not None and q == key and d and at and (d < at if strict else d <= at)]
            want.append((k, key, at, x, *(max(some) if some else (None, None))))
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    with pytest.raises(ValueError):
        temporal.as_of(a, b.withColumn("n2", F.lit(1)), ("key",), "at", "day")
    assert temporal.as_of(a.limit(0), b, ("key",), "at", "day", ("n",)).count() == 0
    assert temporal.as_of(a, b.limit(0), ("key",), "at", "day", ("n",)).where("n is null").count() == 301


def test_overlapping(spark):
    rng = random.Random(6)

    def some(n, long):
        out = []
        for k in range(n):
            s = START + DAY * rng.randrange(300)
            out.append((k, rng.choice(["hot", "hot", "b", None]), s, s + DAY * rng.choice((0, -3, 1, 5, 40, long))))
        return out + [(n, "hot", START, None), (n + 1, "hot", None, START)]

    left, right = some(80, 900), some(70, 300)
    a = spark.createDataFrame(left, "k int, key string, s timestamp, e timestamp").repartition(3)
    b = spark.createDataFrame(right, "k int, key string, s timestamp, e timestamp").repartition(2)
    good = lambda r: None not in r and r[2] < r[3]
    want = sorted((*x, y[0], y[2], y[3]) for x in left for y in right if good(x) and good(y) and x[1] == y[1] and max(x[2], y[2]) < min(x[3], y[3]))
    for width in (3, 60, 5000):
        got = temporal.overlapping(a, b, ("key",), ("s", "e"), ("s", "e"), width * temporal.DAY)
        assert got.columns == ["k", "key", "s", "e", "r_k", "r_s", "r_e"] and sorted(map(tuple, got.collect())) == want
    assert temporal.overlapping(a.limit(0), b, ("key",), ("s", "e"), ("s", "e")).count() == 0
