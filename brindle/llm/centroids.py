"""Exact integer clustering around centroids, with one upper and one lower bound kept for each vector.

Every vector keeps an upper bound of its distance to its centroid and a lower bound of that to its second nearest.
After centroids moved, the upper bound grows by its own centroid's drift and the lower bound shrinks by the largest
drift of the others; while the upper one stays below the lower one, or below half the way to the nearest other
centroid, nothing can have changed. All others are measured against every centroid in integers. Bounds are rounded
outwards, so a tie is never skipped: it goes to the smaller number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import drop_written, mapped, scratch_path

#: Below this, integers and sums of their products are exact in doubles; from `LARGEST` on, distances leave 64 bits.
EXACT, LARGEST = 1 << 22, 1 << 27
#: Bounds are widened by this share, which is far more than rounding takes.
SLACK = 1e-9


@dataclass(frozen=True)
class Clustering:
    """How many centroids and rounds, the vectors' dimension, and what components are multiplied by."""

    centroids: int = 40
    rounds: int = 5
    dimension: int = 64
    scale: float = 256.0
    seed: str = "2:"


def kept(vectors: DataFrame, how: Clustering, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """id, q: integers floor(scale * x) of the vectors that have the dimension and only finite components."""
    v = F.col(f"`{vector_column}`")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(v.isNotNull() & (F.size(v) == how.dimension)).where(F.coalesce(whole, F.lit(False)))
    q = F.transform(v, lambda x: F.floor(F.lit(how.scale) * x.cast("double")).cast("bigint"))
    return rows.select(F.col(f"`{id_column}`").alias("id"), q.alias("q"))


def first_centroids(rows: DataFrame, how: Clustering) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in that order; of equal ids the smaller vector. Null ids are none."""
    key = F.sha2(F.concat(F.lit(how.seed), F.col("id").cast("string")), 256)
    some = rows.where("id is not null").select(key.alias("key"), "q").orderBy("key", "q").limit(how.centroids).collect()
    return _integers(np.array([r["q"] for r in some], np.int64).reshape(len(some), how.dimension))


def _integers(x: np.ndarray) -> np.ndarray:
    if x.size and np.abs(x).max() >= LARGEST:
        raise ValueError(f"a component of {LARGEST} or more: distances would not fit into 64 bits")
    return x


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all x to all c, exactly."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < EXACT:
        dots = (x.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    else:
        dots = x @ c.T
    return (x * x).sum(axis=1)[:, None] - 2 * dots + (c * c).sum(axis=1)[None, :]


def _own(x: np.ndarray, c: np.ndarray, a: np.ndarray) -> np.ndarray:
    return ((x - c[a]) ** 2).sum(axis=1)


@dataclass(frozen=True)
class Move:
    """Centroids, and how far each has moved since the bounds were written."""

    centroids: np.ndarray
    drift: np.ndarray

    def half_gaps(self) -> np.ndarray:
        """Half the distance of each centroid to the nearest other, rounded down."""
        d = np.sqrt(distances(self.centroids, self.centroids).astype(np.float64))
        np.fill_diagonal(d, np.inf)
        return d.min(axis=1) / 2 * (1 - SLACK)

    def others(self) -> np.ndarray:
        """For each centroid the largest drift of any other."""
        if len(self.drift) < 2:
            return np.zeros(len(self.drift))
        order = np.argsort(-self.drift, kind="stable")
        out = np.full(len(self.drift), self.drift[order[0]])
        out[order[0]] = self.drift[order[1]]
        return out


def assigned(x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray, move: Move, gaps: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest centroids and new bounds, and how many vectors were measured against all centroids."""
    known = a >= 0
    mine = np.where(known, a, 0)
    upper = np.where(known, (upper + move.drift[mine]) * (1 + SLACK), np.inf)
    lower = np.where(known, np.maximum(lower - others[mine] * (1 + SLACK), 0), 0)
    bar = np.where(known, np.maximum(lower, gaps[mine]), 0)
    a = mine.copy()
    near = np.flatnonzero(upper >= bar)
    if len(near):  # the upper bound may only be loose
        upper[near] = np.sqrt(_own(x[near], move.centroids, a[near]).astype(np.float64)) * (1 + SLACK)
    open_ = np.flatnonzero(~known | (upper >= bar))
    if len(open_):
        d = distances(x[open_], move.centroids)
        best = d.argmin(axis=1)  # the smaller number of equally near ones
        at = np.arange(len(open_))
        upper[open_] = np.sqrt(d[at, best].astype(np.float64)) * (1 + SLACK)
        d[at, best] = np.iinfo(np.int64).max
        lower[open_] = np.sqrt(d.min(axis=1).astype(np.float64)) * (1 - SLACK) if d.shape[1] > 1 else np.inf
        a[open_] = best
    return a, upper, lower, len(open_)


def _round(state: DataFrame, how: Clustering, move: Move, kind: str) -> DataFrame:
    """State rows with their new cluster, and beside them one row a task and cluster: what it gained and lost."""
    sent, id_type = state.sparkSession.sparkContext.broadcast(move), to_arrow_type(state.schema["id"].dataType)

    def rows(batches) -> Iterator[list]:
        now = sent.value
        gaps, others, k = now.half_gaps(), now.others(), len(now.centroids)
        gained, counts, scanned = np.zeros((k, how.dimension), np.int64), np.zeros(k, np.int64), 0
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _integers(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(m, how.dimension))
            before = batch.column(2).to_numpy(zero_copy_only=False)
            a, upper, lower, some = assigned(x, before, batch.column(3).to_numpy(zero_copy_only=False), batch.column(4).to_numpy(zero_copy_only=False), now, gaps, others)
            scanned += some
            moved = np.flatnonzero(a != before)
            np.add.at(gained, a[moved], x[moved])
            np.add.at(counts, a[moved], 1)
            left = moved[before[moved] >= 0]
            np.subtract.at(gained, before[left], x[left])
            np.subtract.at(counts, before[left], 1)
            none = pa.nulls(m, pa.list_(pa.int64()))
            yield [batch.column(0), batch.column(1), a.astype(np.int32), upper, lower, _own(x, now.centroids, a), none, pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())]
        nothing = [pa.nulls(k, t) for t in (id_type, pa.list_(pa.int64()))]
        yield [*nothing, np.arange(k, dtype=np.int32), *[pa.nulls(k, t) for t in (pa.float64(), pa.float64(), pa.int64())], pa.array(gained.tolist(), pa.list_(pa.int64())), counts, np.array([scanned] + [0] * (k - 1))]

    told = f"id {kind}, q array<bigint>, cluster int, upper double, lower double, distance bigint, gained array<bigint>, members bigint, scanned bigint"
    return mapped(state, lambda batches: ([c if isinstance(c, pa.Array) else pa.array(c) for c in columns] for columns in rows(batches)), told)


@dataclass
class Found:
    """The last state (id, cluster, distance), the centroids, and how many vectors each round measured in full."""

    rows: DataFrame
    centroids: np.ndarray
    scanned: list[int]


def cluster(vectors: DataFrame, how: Clustering, id_column: str = "vec_id", vector_column: str = "embedding") -> Found:
    """Rounds of assignment and componentwise floor of the mean; then vectors are assigned once more.

    Each round reads the state that the one before wrote to the shared folder (vectors, cluster, bounds) and writes its
    own, so a lost executor repeats its tasks only; centroids and their sums (k * dimension numbers) are all that the
    driver holds. Vectors that are null, of another dimension, or hold null or non-finite components take no part. Rows
    with a null id are clustered but are no first centroids; repeated rows each count; with fewer vectors than
    centroids there are as many centroids as vectors; no vector gives no row. A centroid without vectors stays. Other
    columns stay behind. Components of 2^27 and more are refused: their distances don't fit into 64 bits.
    """
    spark = vectors.sparkSession
    rows = kept(vectors, how, id_column, vector_column)
    kind = rows.schema["id"].dataType.simpleString()
    c = first_centroids(rows, how)
    if not len(c):
        return Found(rows.where("false").select("id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), c, [])
    sums, members, scanned = np.zeros(c.shape, object), np.zeros(len(c), object), []
    state = rows.select("id", "q", F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"))
    drift, before = np.zeros(len(c)), None
    for last in [False] * how.rounds + [True]:
        path = scratch_path(spark, "clusters")
        made = _round(state, how, Move(c, drift), kind)
        made.write.parquet(path)
        both = spark.read.schema(made.schema).parquet(path)
        gains = both.where("gained is not null").select("cluster", "members", "scanned", F.posexplode("gained"))
        # of each task's rows only those of clusters that gained or lost something count
        for r in gains.groupBy("cluster", "pos").agg(F.sum("col").alias("s"), F.sum("members").alias("m"), F.sum("scanned").alias("n")).collect():
            sums[r["cluster"], r["pos"]] += r["s"]
            if r["pos"] == 0:
                members[r["cluster"]] += r["m"]
                if r["cluster"] == 0:
                    scanned.append(r["n"])
        state = both.where("gained is null").select("id", "q", "cluster", "upper", "lower")
        if before:
            drop_written(spark, before)
        before = path
        if not last:
            new = np.array([[int(s) // int(m) for s in row] if m else old for row, m, old in zip(sums, members, c.tolist(), strict=True)], np.int64)
            drift = np.sqrt(((new - c) ** 2).sum(axis=1).astype(np.float64)) * (1 + SLACK)
            c = new
    return Found(both.where("gained is null").select("id", "cluster", "distance"), c, scanned)


def told(found: Found, id_column: str = "vec_id") -> DataFrame:
    """Every vector with its cluster and distance, the distances summed over its cluster and over all, and its centroid's digest."""
    spark = found.rows.sparkSession
    sums = {r["cluster"]: int(r["s"]) for r in found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row for each centroid
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in found.centroids.tolist()]
    per = spark.createDataFrame([(k, s, sum(sums.values()), digests[k]) for k, s in sums.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    beside = found.rows.join(F.broadcast(per), "cluster")
    return beside.select(F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
