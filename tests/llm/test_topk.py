"""Exact top-k against plain Python, and its edge cases."""

import math
import random

from brindle.llm import topk

SCHEMA = "vec_id long, embedding array<float>, vector string, score int, dim string, g int"


def brute(rows, queries, k):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(256.0 * x) for x in v]
            good[i] = max(good.get(i, w), w)
    out = set()
    for q in queries:
        if q in good:
            found = sorted(((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q and len(v) == len(good[q])))[:k]
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(found, 1)}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "text", 1, "x", 2) for i, v in rows], SCHEMA)


def test_random_vectors_with_ties_and_bad_ones(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    monkeypatch.setattr(topk, "QUERIES", 4)
    r = random.Random(1)
    rows = [(i, [float(f"{r.gauss(0, 1) * (1 + i % 5):.6g}") for _ in range(8)]) for i in range(300)]
    rows = [(i, [float(__import__("numpy").float32(x)) for x in v]) for i, v in rows]
    rows += [(1000 + i, rows[0][1]) for i in range(20)]  # equal vectors tie
    rows += [rows[3], (None, [1.0] * 8), (400, None), (401, []), (402, [1.0] * 7 + [None]), (403, [float("nan")] * 8), (404, [float("inf")] * 8), (405, [0.5, 0.25]), (406, [0.5, 0.5])]
    asked = [0, 3, 100, 200, 299, 1003, 400, 403, 405]
    df = frame(spark, rows)
    got = {tuple(x) for x in topk.exact_top_k(df, df.where(df.vec_id.isin(asked)), 5).collect()}
    assert got == brute(rows, asked, 5)


def test_negative_scores_and_few_candidates(spark):
    rows = [(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [-0.5, 0.1])]
    df = frame(spark, rows)
    assert {tuple(x) for x in topk.exact_top_k(df, df, 5).collect()} == brute(rows, [1, 2, 3], 5)


def test_large_components(spark):
    rows = [(1, [1e12, 1.0]), (2, [3e11, 2.0]), (3, [1.0, -1e12])]
    rows = [(i, [float(__import__("numpy").float32(x)) for x in v]) for i, v in rows]
    df = frame(spark, rows)
    limit = lambda s: max(-(2**63), min(2**63 - 1, s))
    assert {tuple(x) for x in topk.exact_top_k(df, df, 2).collect()} == {(q, n, i, limit(s)) for q, n, i, s in brute(rows, [1, 2, 3], 2)}


def test_empty(spark):
    df = frame(spark, [])
    assert topk.exact_top_k(df, df, 5).collect() == []
