"""Exact top-k by inner product: vectors by descending length, rotated partial sums, Cauchy-Schwarz bounds.

Vectors are turned into whole numbers, dealt by length into blocks and stored. The rotation comes from the
singular vectors of all vectors, found from their second moments (d x d numbers, gathered by one aggregation).
Each block of queries meets each block of candidates unless the product of their greatest lengths cannot reach
what the queries have already. Inside a pair of blocks the candidates go by descending length; the first
rotated coordinates give a partial sum, the rest is bounded by the residual lengths, and only what may still
enter a query's k is scored, exactly, in whole numbers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, own_columns, small_batches, written

#: Vectors in a block of candidates, and of queries; a pair of blocks fits in a task's memory.
CANDIDATES, QUERIES = 1024, 256
#: Blocks of candidates (the longest vectors) that set the queries' first thresholds.
SEED_BLOCKS = 1
#: Groups that the blocks of candidates are dealt to at least, and blocks of a group; each block of queries is sent to each group.
GROUPS, GROUP_BLOCKS = 64, 16

BLOCK = "dim int, longest double, ids binary, whole binary, big boolean"


def scaled(df: DataFrame, scale: float = 256.0, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, values (floor(scale * x) as double), norm, dim of the vectors that take part.

    Null ids and vectors, empty vectors and those that hold null or non-finite components take no part.
    Of rows that repeat an id, the greatest vector stays.
    """
    df = own_columns(df, vec_id=id_column, vector=vector_column)
    x = F.transform("vector", lambda v: v.cast("double"))
    whole = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    df = df.where("vec_id is not null and vector is not null and size(vector) > 0").withColumn("x", x).where(whole)
    df = df.groupBy("vec_id").agg(F.max("x").alias("x"))
    values = F.transform("x", lambda v: F.call_function("floor", F.lit(scale) * v).cast("double"))
    df = df.select("vec_id", values.alias("values"))
    return df.select("vec_id", "values", F.sqrt(F.aggregate("values", F.lit(0.0), lambda a, v: a + v * v)).alias("norm"), F.size("values").alias("dim"))


def blocks(df: DataFrame, size: int) -> DataFrame:
    """Consecutive rows of a partition packed into blocks of a dimension, longest first."""

    def rows(batches) -> Iterator[list]:
        held: dict[int, list] = {}
        for batch in batches:
            for vec_id, values, norm, dim in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.setdefault(dim, []).append((-norm, vec_id, values))
                if len(held[dim]) >= size:
                    yield _packed(dim, held.pop(dim), size)
        for dim, some in held.items():
            yield _packed(dim, some, size)

    return mapped(df.select("vec_id", "values", "norm", "dim"), rows, BLOCK)


def _packed(dim: int, some: list, size: int) -> list:
    some.sort(key=lambda r: r[:2])
    out: list[list] = [[], [], [], [], []]
    for k in range(0, len(some), size):
        part = some[k : k + size]
        big = max(max(abs(v) for v in r[2]) for r in part) >= 2.0**26 / math.sqrt(dim)
        whole = np.array([r[2] for r in part], np.float64)
        out[0].append(dim)
        out[1].append(-part[0][0])
        out[2].append(np.array([r[1] for r in part], "<i8").tobytes())
        out[3].append((whole if big else whole.astype("<i4")).tobytes())
        out[4].append(big)
    return out


def rotation(df: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all vectors of a dimension, by descending singular value."""

    def rows(batches) -> Iterator[list]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), np.float64).reshape(-1, dim)
            total += x.T @ x
        yield [[0], [total.ravel().tolist()]]

    parts = mapped(df.where(F.col("dim") == dim).select("values"), rows, "one int, m array<double>")
    cells = parts.select(F.posexplode("m").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
    m = np.zeros(dim * dim)
    for r in cells.collect():  # dim * dim numbers, however many vectors there are
        m[r["at"]] = r["v"]
    if not np.isfinite(m).all():
        return np.eye(dim)
    return np.linalg.eigh(m.reshape(dim, dim))[1][:, ::-1].copy()


def _vectors(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["whole"], "<f8" if row["big"] else "<i4").reshape(-1, row["dim"])


def _exact(q: np.ndarray, x: np.ndarray) -> list[int]:
    """Inner products of a vector with rows, in whole numbers of any size."""
    if q.dtype == x.dtype == np.dtype("<i4"):  # every sum stays below 2**53
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64).tolist()
    return [sum(int(a) * int(b) for a, b in zip(q.tolist(), r, strict=True)) for r in x.tolist()]


def _search(row_q: dict, row_c: dict, bars: np.ndarray, turn: np.ndarray, k: int, head: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of what may be among the k best of each query, from a pair of blocks."""
    ids_q, q = _vectors(row_q)
    ids_c, c = _vectors(row_c)
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    rq, rc = qf @ turn, cf @ turn
    norm_q, norm_c = np.linalg.norm(qf, axis=1), np.linalg.norm(cf, axis=1)
    rest_q, rest_c = (np.linalg.norm(r[:, head:], axis=1) for r in (rq, rc))
    slack = 1e-9 * norm_q * float(norm_c.max(initial=0)) + 1e-6  # more than rounding can make of the sums
    if not (row_q["big"] or row_c["big"]):
        return _search_together(ids_q, qf, rq, norm_q, rest_q, ids_c, cf, rc, norm_c, rest_c, bars, slack, k, head)
    out = []
    for i in np.flatnonzero(~(norm_q * norm_c.max(initial=0) + slack < bars)):
        best: list[tuple[int, int]] = []
        bar = bars[i]
        for at in range(0, len(ids_c), 512):  # candidates go by descending length
            if norm_q[i] * norm_c[at] + slack[i] < bar:
                break
            part = slice(at, at + 512)
            bound = rc[part, :head] @ rq[i, :head] + rest_c[part] * rest_q[i] + slack[i]
            kept = at + np.flatnonzero(~(bound < bar) & (ids_c[part] != ids_q[i]))
            for j, score in zip(kept.tolist(), _exact(q[i], c[kept]), strict=True):
                item = (score, -int(ids_c[j]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                bar = max(bar, float(best[0][0]))
        out += [(int(ids_q[i]), -v, s) for s, v in best]
    return out


def _search_together(ids_q, qf, rq, norm_q, rest_q, ids_c, cf, rc, norm_c, rest_c, bars, slack, k: int, head: int) -> list[tuple[int, int, int]]:
    """`_search` where every sum of products stays below 2**53: all queries meet each part of the candidates in matrix products."""
    bars, best = bars.copy(), [[] for _ in ids_q]
    for at in range(0, len(ids_c), 512):  # candidates go by descending length
        live = np.flatnonzero(~(norm_q * norm_c[at] + slack < bars))
        if not len(live):
            break
        part = slice(at, at + 512)
        bound = rq[live, :head] @ rc[part, :head].T + rest_q[live, None] * rest_c[part] + slack[live, None]
        open_ = ~(bound < bars[live, None]) & (ids_c[part] != ids_q[live, None])
        rows, columns = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
        if not len(rows):
            continue
        scores = qf[live[rows]] @ cf[part][columns].T  # whole numbers, exact as doubles
        scores[~open_[np.ix_(rows, columns)]] = -np.inf
        names = ids_c[part][columns]
        for row, i in zip(scores, live[rows].tolist(), strict=True):
            least = max(bars[i], np.partition(row, len(row) - k)[len(row) - k]) if len(row) > k else bars[i]
            near = np.flatnonzero((row >= least) & (row > -np.inf))
            best[i] = heapq.nsmallest(k, best[i] + list(zip((-row[near]).tolist(), names[near].tolist(), strict=True)))
            if len(best[i]) == k:
                bars[i] = max(bars[i], -best[i][-1][0])
    return [(int(ids_q[i]), v, int(-s)) for i, found in enumerate(best) for s, v in found]


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_column: str = "vec_id", vector_column: str = "embedding", head: int | None = None) -> DataFrame:
    """The k candidates of greatest inner product of every query, exactly; ties go to the smaller id.

    Returns query_id, rank (int, from 1), vec_id, score (long; beyond 64 bits it is held at the bound). A query's
    own id is no candidate of it; vectors of another dimension are none either. Fewer than k candidates give all
    of them, no candidate gives no row. See `scaled` for vectors that take no part and for repeated ids.
    `head` is the number of rotated coordinates in the partial sums (a quarter of the dimension if not given).
    """
    spark = vectors.sparkSession
    small_batches(spark)
    base = written(scaled(vectors, scale, id_column, vector_column), "vectors")
    asked = scaled(queries, scale, id_column, vector_column)
    dims = [r["dim"] for r in base.select("dim").distinct().collect()]  # a few: a table of embeddings has one
    turns = spark.sparkContext.broadcast({d: rotation(base, d) for d in dims})
    width = max(dims, default=1)
    parts = max(1, spark.sparkContext.defaultParallelism)
    stored = written(blocks(base.repartitionByRange(parts, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id"), CANDIDATES), "candidates")
    asked = blocks(asked.repartition(parts, "vec_id"), QUERIES)
    longest = spark.sparkContext.broadcast([r.asDict() for d in dims for r in stored.where(F.col("dim") == d).orderBy(F.desc("longest"), "ids").limit(SEED_BLOCKS).collect()])
    keep = head

    def seeded(batches) -> Iterator[list]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for row in batch.to_pylist():
                ids, _ = _vectors(row)
                bars = np.full(len(ids), -np.inf)
                some = [x for c in longest.value if c["dim"] == row["dim"] for x in _search(row, c, bars, turns.value[row["dim"]], k, keep or max(1, row["dim"] // 4))]
                scores: dict[int, list[int]] = {}
                for i, _, s in some:
                    scores.setdefault(i, []).append(s)
                place = {int(v): n for n, v in enumerate(ids)}
                for i, found in scores.items():
                    if len(found) >= k:
                        bars[place[i]] = float(sorted(found)[-k])
                out[0].append(bars.astype("<f8").tobytes())
                out[1].append(float(bars.min()))
                out[2].append(row)
            yield [[r[c] for r in out[2]] for c in ("dim", "longest", "ids", "whole", "big")] + out[:2]

    asked = written(mapped(asked, seeded, f"{BLOCK}, bars binary, least double"), "queries")
    groups = max(GROUPS, -(-stored.count() // GROUP_BLOCKS))  # as many as the candidates need
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns], F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    # copies of the queries are never broadcast
    met = stored.withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int")).join(asked.hint("shuffle_merge"), "g")
    met = met.where((F.col("dim") == F.col("q_dim")) & (F.col("longest") * F.col("q_longest") * (1 + 1e-9) + 1e-6 >= F.col("q_least")))

    def scored(batches) -> Iterator[list]:
        for batch in batches:
            for row in batch.to_pylist():
                asked_row = {c: row[f"q_{c}"] for c in ("dim", "ids", "whole", "big")}
                found = _search(asked_row, row, np.frombuffer(row["q_bars"], "<f8"), turns.value[row["dim"]], k, keep or max(1, row["dim"] // 4))
                yield [[x[0] for x in found], [x[1] for x in found], [max(-(2**63), min(2**63 - 1, x[2])) for x in found]]

    best = mapped(met, scored, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
