"""Nearest nodes by Hamming distance or cosine, for one query and for many."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import address_of, bind, hamming, limb_names, literal, to_hex
from ..functions.vectors import finite, normalised

#: Queries that are sent to the executors at once.
QUERY_BLOCK = 4096
#: Queries that a task compares with a batch at once: what it holds are so many scores for each row of the batch.
AT_ONCE = 256


def _limbs(df: DataFrame, bits: int | None = None) -> list[str]:
    """The limbs' columns: those of the given width, or else l0 and all that follow it without a gap."""
    if bits:
        return limb_names(bits)
    n = 0
    while f"l{n}" in df.columns:
        n += 1
    return [f"l{j}" for j in range(n)]


def query_blocks(queries: DataFrame) -> list[DataFrame]:
    """A stated set of queries in parts that are small enough to be sent to all tasks."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) for b in range(blocks)] if blocks > 1 else [queries]


def ranked(addresses: DataFrame, query: Sequence[Column], order: Sequence[str] = ("id",)) -> DataFrame:
    """All addresses with their distance, nearest first; ties go by the `order` columns (id, or the input's order)."""
    names = limb_names(64 * len(query))  # as wide as the query: other columns, whatever their names, are none
    return addresses.withColumn("dist", hamming([F.col(n) for n in names], query)).orderBy("dist", *order)


def top_k(addresses: DataFrame, query: Sequence[Column], k: int = 10, exclude: DataFrame | Sequence | None = None, order: Sequence[str] = ("id",)) -> DataFrame:
    """The k nearest addresses: id, dist. What is excluded goes before the limit; fewer rows give all of them."""
    if isinstance(exclude, DataFrame):
        addresses = addresses.join(exclude.select("id"), "id", "left_anti")
    elif exclude:
        addresses = addresses.where(~F.col("id").isin(list(exclude)))
    return ranked(addresses, query, order).limit(k).select("id", "dist")


def text_query(addresses: DataFrame, text: str, k: int = 10, order: Sequence[str] = ("id",), bits: int | None = None) -> DataFrame:
    """The k nearest to a text's address. `bits` names the addresses' width where other columns follow the limbs' names."""
    return top_k(addresses, literal(address_of(text, 64 * len(_limbs(addresses, bits)))), k, order=order)


def composed_query(addresses: DataFrame, a: str, b: str, k: int = 10, order: Sequence[str] = ("id",), bits: int | None = None) -> DataFrame:
    """The k nearest to two texts' addresses bound together. This is no conjunction of the texts."""
    width = 64 * len(_limbs(addresses, bits))
    return top_k(addresses, bind(literal(address_of(a, width)), literal(address_of(b, width))), k, order=order)


def node_query(addresses: DataFrame, node, k: int = 10, order: Sequence[str] = ("id",), bits: int | None = None) -> DataFrame:
    """The k nearest to a node's address, without the node; an unknown node gives no rows."""
    names = _limbs(addresses, bits)
    own = addresses.where(F.col("id") == node).limit(1).select(*[F.col(n).alias(f"q_{n}") for n in names])
    beside = addresses.where(F.col("id") != node).join(F.broadcast(own))  # one row
    return beside.withColumn("dist", hamming([F.col(n) for n in names], [F.col(f"q_{n}") for n in names])).orderBy("dist", *order).limit(k).select("id", "dist")


def _kept(best: list[list], bar: np.ndarray, at: np.ndarray, scores: np.ndarray, ids: list, ids_q: list, k: int) -> None:
    """Takes a batch's scores (queries at the places `at`, rows) into the queries' lists of (-score, id), k each.

    `bar` has the least score of each list that is full: rows below it are passed over. -inf is no candidate.
    """
    least, n = bar[at], scores.shape[1]
    fresh = np.flatnonzero(least == -np.inf)
    if n > k + 1 and len(fresh):
        least[fresh] = np.partition(scores[fresh], n - k - 1, axis=1)[:, n - k - 1]  # one more than k, as the query itself may be among them
    which, rows = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    ends = np.searchsorted(which, np.arange(len(at) + 1))
    for j in np.unique(which).tolist():
        i, some = int(at[j]), rows[ends[j] : ends[j + 1]]
        best[i] = heapq.nsmallest(k, best[i] + [(-x, ids[m]) for x, m in zip(scores[j, some].tolist(), some.tolist(), strict=True) if ids[m] != ids_q[i]])
        if len(best[i]) == k:
            bar[i] = -best[i][-1][0]


def top_k_batch(addresses: DataFrame, queries: DataFrame, k: int = 10, bits: int | None = None, own: bool = False) -> DataFrame:
    """The k nearest of every query: query_id, id, dist, rank; a query's own id is left out unless `own`, ties go by id.

    `queries` has query_id and limbs. Queries go to the executors in bounded blocks; each batch of addresses keeps
    its k best for each query, so the shuffle holds queries * batches * k rows, not queries * addresses.
    """
    names, kind, q_kind = _limbs(addresses, bits), addresses.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    spark, out = addresses.sparkSession, None
    for block in query_blocks(queries.select("query_id", *names)):
        some = block.collect()
        given = spark.sparkContext.broadcast(([r["query_id"] for r in some], np.array([r[1:] for r in some], np.int64).reshape(len(some), len(names))))

        def rows(batches, given=given) -> Iterator[pa.RecordBatch]:
            ids_q, q = given.value
            passed = [None] * len(ids_q) if own else ids_q
            bits, signs = 64 * len(names), lambda a: 2 * np.unpackbits(np.ascontiguousarray(a).view(np.uint8), axis=1).astype(np.float32) - 1
            best: list[list] = [[] for _ in ids_q]
            bar = np.full(len(ids_q), -np.inf, np.float32)
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = batch.column(0).to_pylist()
                x = signs(np.stack([batch.column(j + 1).to_numpy() for j in range(len(names))], axis=1))
                for s in range(0, len(ids_q), AT_ONCE):
                    # of signs, the inner product is the width less twice the distance
                    _kept(best, bar, np.arange(s, min(s + AT_ONCE, len(ids_q))), signs(q[s : s + AT_ONCE]) @ x.T, ids, passed, k)
            told = [(mine, i, int(bits + away) // 2) for mine, some in zip(ids_q, best, strict=True) for away, i in some]
            columns = list(zip(*told, strict=True)) if told else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], qt), pa.array(columns[1], it), pa.array(columns[2], pa.int32())], names=["query_id", "id", "dist"])

        from pyspark.sql.pandas.types import to_arrow_type

        it, qt = to_arrow_type(addresses.schema["id"].dataType), to_arrow_type(queries.schema["query_id"].dataType)
        part = addresses.select("id", *names).mapInArrow(rows, f"query_id {q_kind}, id {kind}, dist int")
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("query_id").orderBy("dist", "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "dist", "rank")


def top_k_classes(members: DataFrame, queries: DataFrame, k: int = 10, bits: int | None = None) -> DataFrame:
    """`top_k_batch` where addresses repeat: each different address is asked for and compared one time.

    Ids are unique. The k + 1 nearest rows of an address, the query's own among them, are of the k + 1 nearest different addresses, by their smallest ids.
    """
    names = _limbs(members, bits)
    place = F.row_number().over(Window.partitionBy(*names).orderBy("id"))
    first = members.where("id is not null").select("id", *names).withColumn("place", place).where(F.col("place") <= k + 1)
    first = first.withColumn("rep", F.min("id").over(Window.partitionBy(*names)))
    asked = queries.select("query_id", *names)
    different = asked.select(*names).distinct().withColumn("query_id", to_hex([F.col(n) for n in names]))
    near = top_k_batch(first.where("place = 1").select("id", *names), different, k + 1, bits, own=True)
    rows = near.select("query_id", F.col("id").alias("rep"), "dist").join(first.select("rep", "id"), "rep")
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "id"))).where(F.col("at") <= k + 1)
    lists = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("at", "id", "dist"))).alias("near"))
    found = asked.withColumn("number", to_hex([F.col(n) for n in names])).join(lists.withColumnRenamed("query_id", "number"), "number")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    return found.select("query_id", F.posexplode(others).alias("rank", "x")).select("query_id", "x.id", "x.dist", (F.col("rank") + 1).alias("rank"))


def _units(df: DataFrame, key: str, *more: str) -> DataFrame:
    """key, unit vector v, and more columns, of the rows whose vectors are whole and finite."""
    return df.where(finite(F.col("vector"))).select(key, normalised(F.col("vector")).alias("v"), *more)


def _by_dimension(ids: list, vectors: Sequence) -> dict[int, tuple[list[int], np.ndarray]]:
    """Dimension -> (places of its vectors, matrix of them)."""
    places: dict[int, list[int]] = {}
    for k, v in enumerate(vectors):
        places.setdefault(len(v), []).append(k)
    return {d: (at, np.array([vectors[k] for k in at], np.float64)) for d, at in places.items()}


def _matrix(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and matrix of a batch's vectors of a dimension."""
    starts, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    at = np.flatnonzero(np.diff(starts) == d)
    return at, flat[starts[at][:, None] + np.arange(d)]


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, places: int = 9, same: str | None = None) -> DataFrame:
    """The k nearest of every query by cosine: query_id, id, sim (rounded), rank; ties go by id.

    `vectors` has id and vector, `queries` query_id and vector. Vectors that are null, empty, or hold null or non-finite
    components take no part; a query's candidates are those of its dimension; vectors of length 0 have cosine 0.
    Other columns stay behind. Queries go to the executors in bounded blocks; each batch keeps its k best for each. With
    `same`, a column of both, a query's candidates are the rows that hold its value; null is the value of none.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    it, qt = to_arrow_type(vectors.schema["id"].dataType), to_arrow_type(queries.schema["query_id"].dataType)
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, sim double"
    more = [same] if same else []
    x, out = _units(vectors, "id", *more), None
    for block in query_blocks(_units(queries, "query_id", *more)):
        some = block.collect()
        given = vectors.sparkSession.sparkContext.broadcast(([r["query_id"] for r in some], _by_dimension(some, [r["v"] for r in some]), [r[same] for r in some] if same else None))

        def rows(batches, given=given) -> Iterator[pa.RecordBatch]:
            ids_q, asked, values = given.value
            best: list[list] = [[] for _ in ids_q]
            bar = np.full(len(ids_q), -np.inf)
            codes = {v: n for n, v in enumerate(dict.fromkeys(values or ()))}
            code_q = np.array([-2 if v is None else codes[v] for v in values or ()], np.int64)
            for batch in batches:
                names = batch.column(0).to_pylist()
                code = np.array([codes.get(v, -1) if v is not None else -1 for v in batch.column(2).to_pylist()], np.int64) if values is not None else None
                for d, (places_q, q) in asked.items():
                    at, v = _matrix(batch.column(1), d)
                    if not len(at):
                        continue
                    ids, of = [names[n] for n in at.tolist()], np.array(places_q)
                    for s in range(0, len(of), AT_ONCE):
                        some_q = of[s : s + AT_ONCE]
                        sims = np.round(q[s : s + AT_ONCE] @ v.T, places) + 0.0
                        if code is not None:
                            sims[code_q[some_q][:, None] != code[at][None, :]] = -np.inf
                        _kept(best, bar, some_q, sims, ids, ids_q, k)
            told = [(mine, i, -s + 0.0) for mine, found in zip(ids_q, best, strict=True) for s, i in found]
            columns = list(zip(*told, strict=True)) if told else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], qt), pa.array(columns[1], it), pa.array(columns[2], pa.float64())], names=["query_id", "id", "sim"])

        part = x.mapInArrow(rows, kinds)
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cosine_before(vectors: DataFrame, marks: DataFrame, places: int = 9) -> DataFrame:
    """query_id, n_before: vectors that come before a marked one in the ranking by cosine, then id.

    `marks` has query_id, the query's vector, and sim and id of the marked vector. Each task hands on one count a query.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    qt, kinds = to_arrow_type(marks.schema["query_id"].dataType), f"query_id {marks.schema['query_id'].dataType.simpleString()}, n bigint"
    x, out = _units(vectors, "id"), None
    for block in query_blocks(_units(marks, "query_id", "sim", "id")):
        some = block.collect()
        given = vectors.sparkSession.sparkContext.broadcast(([r["query_id"] for r in some], _by_dimension(some, [r["v"] for r in some]), np.array([r["sim"] for r in some], np.float64), [r["id"] for r in some]))

        def rows(batches, given=given) -> Iterator[pa.RecordBatch]:
            ids_q, asked, sim, marked = given.value
            before = np.zeros(len(ids_q), np.int64)
            for batch in batches:
                names = batch.column(0).to_pylist()
                for d, (places_q, q) in asked.items():
                    at, v = _matrix(batch.column(1), d)
                    ids = [names[n] for n in at.tolist()]
                    own = {n: k for k, n in enumerate(ids)}
                    for s in range(0, len(places_q), AT_ONCE):
                        some_q = places_q[s : s + AT_ONCE]
                        sims, bar = np.round(q[s : s + AT_ONCE] @ v.T, places) + 0.0, sim[some_q][:, None]
                        before[some_q] += (sims > bar).sum(axis=1)
                        for j, i in enumerate(some_q):
                            if ids_q[i] in own:
                                before[i] -= sims[j, own[ids_q[i]]] > sim[i]  # a query is not before itself
                        for j, k in zip(*np.nonzero(sims == bar), strict=True):
                            i = some_q[j]
                            before[i] += ids[k] < marked[i] and ids[k] != ids_q[i]
            yield pa.RecordBatch.from_arrays([pa.array(ids_q, qt), pa.array(before)], names=["query_id", "n"])

        part = x.mapInArrow(rows, kinds)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("query_id").agg(F.sum("n").alias("n_before"))


def decorated(results: DataFrame, nodes: DataFrame) -> DataFrame:
    """Results with their nodes' short titles; of nodes that repeat an id, the first in input order, else any."""
    from ..functions.text import short_title

    first = nodes.groupBy("id").agg(F.min_by(short_title(F.col("title"), F.col("label")), F.col("node_seq") if "node_seq" in nodes.columns else F.lit(0)).alias("name"))
    return results.join(first, "id", "left")
