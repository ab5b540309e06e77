import hashlib

import numpy as np
import pytest

from brindle.llm import centroids
from brindle.llm.centroids import Clustering, Move, assigned, cluster, distances, told
from brindle.storage import scratch


def plain(rows, how):
    """Every distance in every round, without bounds: id -> (cluster, distance), and the centroids."""
    kept = [(i, np.floor(how.scale * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v in rows if v is not None and len(v) == how.dimension and None not in v and np.isfinite(v).all()]
    ids, x = [i for i, _ in kept], np.array([v for _, v in kept]).reshape(len(kept), how.dimension)
    key = lambda k: (hashlib.sha256(f"{how.seed}{ids[k]}".encode()).hexdigest(), x[k].tolist())
    c = x[sorted((k for k in range(len(ids)) if ids[k] is not None), key=key)[: how.centroids]].copy()
    for r in range(how.rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        a = d.argmin(axis=1)
        if r < how.rounds:
            c = np.array([x[a == k].sum(axis=0) // (a == k).sum() if (a == k).any() else c[k] for k in range(len(c))])
    return [(i, int(k), int(d[n, k])) for n, (i, k) in enumerate(zip(ids, a, strict=True))], c


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1.5, 0) for i, v in rows], "vec_id bigint, embedding array<float>, q string, upper double, cluster int").repartition(3)


def check(spark, rows, how):
    want, c = plain(rows, how)
    found = cluster(frame(spark, rows), how)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted([tuple(r) for r in found.rows.collect()], key=key) == sorted(want, key=key)
    assert found.centroids.tolist() == c.tolist()
    return found


def test_bounds_give_what_all_distances_give(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(k, (centres[k % 6] + 0.05 * rng.normal(size=8)).astype(np.float32).tolist()) for k in range(300)]
    found = check(spark, rows, Clustering(6, 6, 8, 256.0))
    assert found.scanned[0] == 300 and found.scanned[-1] < 30  # the bounds do their work


def test_odd_rows_ties_and_few_vectors(spark):
    same = [1.0, 0.0]
    rows = [(1, same), (2, same), (2, same), (3, [0.0, 1.0]), (4, None), (5, [1.0]), (6, [float("nan"), 0.0]), (7, [float("inf"), 0.0]), (8, [None, 1.0]), (None, [0.5, -0.5]), (9, [-0.1, -0.7])]
    for k in (1, 2, 4, 40):  # equal centroids tie: the smaller number gets all; the others stay empty, and stay
        check(spark, rows, Clustering(k, 3, 2, 256.0))
    check(spark, rows, Clustering(3, 0, 2, 10.0))


def test_empty(spark):
    found = cluster(frame(spark, [(4, None)]), Clustering(3, 2, 2))
    assert found.rows.count() == 0 and told(found).count() == 0


def test_sums_and_digests(spark):
    rows = [(k, [k / 10, -k / 7]) for k in range(20)]
    how = Clustering(3, 2, 2)
    want, c = plain(rows, how)
    got = {r["vec_id"]: r for r in told(cluster(frame(spark, rows), how)).collect()}
    for i, k, d in want:
        assert got[i]["cluster_inertia"] == sum(w[2] for w in want if w[1] == k) and got[i]["inertia"] == sum(w[2] for w in want)
        assert got[i]["centroid_sha256"] == hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest() and got[i]["distance"] == d


def test_large_components_are_exact_or_refused(spark):
    rows = [(1, [float(1 << 18), 1.0]), (2, [float(1 << 18), 2.0]), (3, [0.0, 3.0])]
    check(spark, rows, Clustering(2, 2, 2, 256.0))
    with pytest.raises(ValueError):
        cluster(frame(spark, [(1, [1e30, 0.0])]), Clustering(1, 1, 2))


def test_distances_by_either_way(monkeypatch):
    rng = np.random.default_rng(1)
    x, c = rng.integers(-1000, 1000, (50, 7)), rng.integers(-1000, 1000, (5, 7))
    want = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (distances(x, c) == want).all()
    monkeypatch.setattr(centroids, "EXACT", 1)
    assert (distances(x, c) == want).all()


def test_a_bound_that_only_touches_is_not_enough():
    c = np.array([[0, 0], [10, 0]])
    x = np.array([[5, 0]])  # as near to one as to the other
    move = Move(c, np.zeros(2))
    a, _, _, scanned = assigned(x, np.array([1]), np.array([5.0]), np.array([5.0]), move, move.half_gaps(), move.others())
    assert a.tolist() == [0] and scanned == 1


def test_only_the_last_state_is_left(spark):
    with scratch(spark) as made:
        cluster(frame(spark, [(k, [k / 10, 1.0]) for k in range(9)]), Clustering(2, 2, 2)).rows.collect()
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        fs = path(made[0]).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        assert [fs.exists(path(p)) for p in made] == [False] * (len(made) - 1) + [True]
