"""Sensed and deep addresses, triangles and motifs, against plain Python."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import pytest

from brindle.operators import depth, graph, motifs, sensing, signatures


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, t, k) for k, (a, b, t) in enumerate(pairs)], "source string, target string, type string, edge_seq int").repartition(3)


def number(row, width=256):
    return sum((row[f"l{j}"] & (1 << 64) - 1) << 64 * j for j in range(width // 64))


def some_edges(rng, nodes, n):
    pairs = [(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}", rng.choice("xyz")) for _ in range(n)]
    return pairs + pairs[:5] + [("n0", f"n{k}", "x") for k in range(nodes)] + [("n1", "ghost", "x"), (None, "n2", "x"), ("n3", "", "x")]


def walks(near, at, n, came=None):
    """Ends of all walks of n edges that don't turn back along the edge they came by."""
    if not n:
        return [at]
    return [end for edge, (to, back) in near[at].items() if edge != came for end in walks(near, to, n - 1, back)]


@pytest.mark.parametrize("lanes", [2, 1])
def test_depth_addresses_against_walks(spark, monkeypatch, lanes):
    rng = random.Random(lanes)
    ids = [f"n{k}" for k in range(12)] + ["alone"]
    pairs = some_edges(rng, 12, 10)
    nodes = spark.createDataFrame([(i, f"{i} {rng.choice('pqr')} word") for i in ids], "id string, text string")
    content = signatures.simhash(nodes)
    base = {r["id"]: number(r) for r in content.collect()}
    near = defaultdict(dict)  # each edge both ways: its number and side -> (other end, the same edge the other way)
    for k, (a, b, _) in enumerate(pairs):
        if a in base and b in base:
            near[a][k, 0], near[b][k, 1] = (b, (k, 1)), (a, (k, 0))
    scale = 1 if lanes == 2 else 1 << 40  # heavy weights need a number for each counter
    weights = [(1,), (2, 1), (4, 2, 1), (8, 4, 2, 1)]
    got = depth.depth_addresses(content, graph.undirected(edges_of(spark, pairs)), [[w * scale for w in some] for some in weights])
    for some, found in zip(weights, got, strict=True):
        rows = {r["id"]: number(r) for r in found.collect()}
        assert set(rows) == set(ids)
        for i in ids:
            votes = [(w, base[e]) for d, w in enumerate(some) for e in walks(near, i, d)]
            whole = sum(w for w, _ in votes)
            assert rows[i] == sum(1 << b for b in range(256) if 2 * sum(w * (x >> b & 1) for w, x in votes) >= whole), (i, some)
    one = signatures.topology(content, graph.undirected(edges_of(spark, pairs)))
    assert {tuple(r) for r in got[1].collect()} == {tuple(r) for r in one.collect()}


def test_too_many_walks_are_refused(spark):
    content = signatures.simhash(spark.createDataFrame([("a", "x")], "id string, text string"))
    with pytest.raises(ValueError):
        depth.depth_addresses(content, graph.undirected(edges_of(spark, [])), [[1 << 62]])


def sensed(members, width):
    total = Counter()
    for m in members:
        h = hashlib.sha256(f"row:{m}".encode()).hexdigest()
        for k in range(16):
            w = int(h[4 * k : 4 * k + 4], 16)
            total[w % width] += 1 if w < 1 << 15 else -1
    return sum(1 << p for p, t in total.items() if t > 0)


def test_sensed_addresses(spark):
    rng = random.Random(3)
    pairs = some_edges(rng, 15, 20)
    ids = [f"n{k}" for k in range(15)] + ["alone"]
    nodes = spark.createDataFrame([(i,) for i in [*ids, "n1", None]], "id string")
    found = sensing.sensed(nodes, graph.undirected(edges_of(spark, pairs)), (64, 256, 1024))
    for width, addresses in found.items():
        rows = {r["id"]: number(r, width) for r in addresses.collect()}
        want = {i: sensed({i} | {b for a, b, _ in pairs if a == i and b} | {a for a, b, _ in pairs if b == i and a}, width) for i in ids}
        assert rows == want
    with pytest.raises(ValueError):
        sensing.row_sums(nodes, graph.undirected(edges_of(spark, pairs)), 96)


@pytest.mark.parametrize("hub", [512, 2])
def test_triangles_and_census(spark, monkeypatch, hub):
    monkeypatch.setattr(motifs, "SLICE", hub)
    rng = random.Random(hub)
    pairs = some_edges(rng, 20, 70) + [("n4", "n4", "x"), ("n7", "n2", None)]
    edges = edges_of(spark, pairs)
    near, kinds = defaultdict(set), defaultdict(set)
    for a, b, t in pairs:
        if a and b and a != b:
            near[a].add(b)
            near[b].add(a)
            kinds[frozenset((a, b))].add(t or "")
    want = {frozenset(s) for s in itertools.combinations(near, 3) if all(y in near[x] for x, y in itertools.combinations(s, 2))}
    found = motifs.triangles(edges).collect()
    assert {frozenset(r) for r in found} == want and len(found) == len(want)
    got = {r["id"]: (r["degree"], r["triangles"], r["clustering"]) for r in motifs.clustering(edges).collect()}
    for i, nbrs in near.items():
        t, d = sum(i in w for w in want), len(nbrs)
        assert got[i] == (d, t, pytest.approx(2 * t / (d * (d - 1)) if d > 1 else 0.0))
    assert set(got) == set(near)
    degrees = [len(n) for n in near.values()]
    wedges = sum(d * (d - 1) // 2 for d in degrees)
    census = {"nodes": len(near), "edges": sum(degrees) // 2, "wedges": wedges, "open wedges": wedges - 3 * len(want), "triangles": len(want), "stars": sum(d * (d - 1) * (d - 2) // 6 for d in degrees)}
    for w in want:
        for types in itertools.product(*[kinds[frozenset(e)] for e in itertools.combinations(sorted(w), 2)]):
            key = "+".join(sorted(types))
            census[key] = census.get(key, 0) + 1
    assert {r["motif"]: r["n"] for r in motifs.census(edges).collect()} == census


def test_no_edges(spark):
    edges = edges_of(spark, [])
    assert motifs.triangles(edges).count() == 0 and motifs.clustering(edges).count() == 0
    assert {r["n"] for r in motifs.census(edges).collect()} == {0}
