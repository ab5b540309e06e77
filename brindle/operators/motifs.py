"""Triangles and small motifs of a graph, closed by joins over edges that are oriented by degree.

Every edge points from its end of lower degree to the other, so a node has at most about sqrt(2 * edges) ways out, hubs
included. Pairs of ways out of one node are wedges; an edge between their ends closes a triangle, which is found once.
Nodes go by numbers in the order of their degree, and wedges by lists of them. Ids are strings or whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

#: Candidates for a triangle's last corner that a task looks up at once, and ways of a bucket, which it holds.
SLICE, BUCKET_WAYS = 1 << 20, 16_000_000


def _ends(edges: DataFrame) -> DataFrame:
    """a, b, with a < b, and the other columns, of edges that are no loops and have no null or empty end, dealt by both ends."""
    kept = edges.where("source is not null and target is not null and source <> target")
    for end in ("source", "target"):
        kept = kept.where(F.col(end) != "") if edges.schema[end].dataType.simpleString() == "string" else kept
    more = [c for c in edges.columns if c not in ("source", "target")]
    return kept.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), *more).repartition("a", "b")


def simple_edges(edges: DataFrame) -> DataFrame:
    """a, b, with a < b: distinct undirected edges without loops and without null or empty ends."""
    return _ends(edges.select("source", "target")).distinct()


def degrees(simple: DataFrame) -> DataFrame:
    """id, degree over `simple_edges`."""
    return simple.select(F.col("a").alias("id")).union(simple.select("b")).groupBy("id").agg(F.count("*").alias("degree"))


def numbered(known: DataFrame) -> DataFrame:
    """number, id, degree of `degrees`: numbers from 0 without gaps, in the order of degree, then id."""
    at = written(known.orderBy("degree", "id").withColumn("at", F.monotonically_increasing_id()), "ends")
    part = F.shiftright("at", 33).alias("part")
    sizes = {r["part"]: r["n"] for r in at.groupBy(part).agg(F.count("*").alias("n")).collect()}  # a row a task
    starts, so_far = [], 0
    for k in sorted(sizes):
        starts.append((k, so_far))
        so_far += sizes[k]
    begin = at.sparkSession.createDataFrame(starts, "part bigint, start bigint")
    number = (F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).cast("int" if so_far < 1 << 31 else "long")
    return at.select("*", part).join(F.broadcast(begin), "part").select(number.alias("number"), "id", "degree")


def oriented(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """low, high, and other columns: each of `pairs` (a, b) by its ends' numbers, from the lower one, of lower degree."""
    of = lambda end: names.select(F.col("id").alias(end), F.col("number").alias(f"n_{end}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return both.select(F.least("n_a", "n_b").alias("low"), F.greatest("n_a", "n_b").alias("high"), *[c for c in pairs.columns if c not in ("a", "b")])


def _met(batches, kinds: int, of_bucket: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """x, y, z and the kinds of xy, xz, yz of triangles. Of each bucket, the lists of its nodes come first, in order; then those that ask."""
    at, held, asked = None, [], False
    keys = names = marks = None
    for batch in batches:
        if not batch.num_rows:
            continue
        buckets, ask, low = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        lists = batch.column(3)
        starts, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
        cuts = np.flatnonzero(np.r_[True, (buckets[1:] != buckets[:-1]) | (ask[1:] != ask[:-1])])
        for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows], strict=True):
            some, size = flat[starts[s] : starts[e]].astype(np.int64), np.diff(starts[s : e + 1])
            if buckets[s] != at:
                at, held, asked = buckets[s], [], False
            if not ask[s]:
                held.append((low[s:e].astype(np.int64), size, some))
                continue
            if not held:
                continue
            if not asked:  # the bucket's ways as ascending keys: the place of the first end, the second end
                names, sizes = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                whole = np.concatenate([h[2] for h in held])
                held, asked, marks = [None], True, (whole % kinds).astype(np.min_scalar_type(kinds)) if kinds > 1 else None
                whole //= kinds
                bits = int(whole.max()).bit_length()
                keys = whole
                keys |= np.repeat(np.arange(len(names)), sizes) << bits
            number = some // kinds
            end = np.repeat(np.cumsum(size), size)
            place = np.searchsorted(names, number)
            place[place == len(names)] = 0
            first = np.flatnonzero((names[place] == number) & (of_bucket(number) == at) & (np.arange(len(some)) + 1 < end))
            row, rest = np.repeat(np.arange(e - s), size)[first], end[first] - first - 1
            so_far = np.cumsum(rest)
            i = 0
            while i < len(first):
                j = max(i + 1, int(np.searchsorted(so_far, (so_far[i - 1] if i else 0) + SLICE, "right")))
                n = rest[i:j]
                y = np.repeat(first[i:j], n)
                z = y + 1 + np.arange(len(y)) - np.repeat(np.cumsum(n) - n, n)
                wanted, known = number[z], number[z] < 1 << bits
                wanted = wanted | place[y] << bits
                found = np.searchsorted(keys, wanted)
                found[found == len(keys)] = 0
                hit = np.flatnonzero((keys[found] == wanted) & known)
                y, z, found = y[hit], z[hit], found[hit]
                x = low[s:e].astype(np.int64)[np.repeat(row[i:j], n)[hit]]
                zero = np.zeros(len(x), np.int64)
                yield x, number[y], number[z], *((some[y] % kinds, some[z] % kinds, marks[found].astype(np.int64)) if kinds > 1 else (zero, zero, zero))
                i = j


def _corners(x: np.ndarray, y: np.ndarray, z: np.ndarray, *_: np.ndarray) -> list[np.ndarray]:
    return list(np.unique(np.concatenate([x, y, z]), return_counts=True))


def _by_kinds(x: np.ndarray, y: np.ndarray, z: np.ndarray, *kinds: np.ndarray) -> list[np.ndarray]:
    three, n = np.unique(np.stack(kinds, axis=1), axis=0, return_counts=True) if len(x) else (np.zeros((0, 3), np.int64), np.zeros(0, np.int64))
    return [*three.T, n]


def closed(ways: DataFrame, told: Callable[..., list[np.ndarray]] | None = None, columns: str = "", kinds: int = 1) -> DataFrame:
    """x, y, z, ascending numbers, of every triangle of `ways` (low, high, and kind, below `kinds`, if there are several), once.

    A node's ways out are one sorted list, of sqrt(2 * edges) numbers at most. Nodes are dealt to buckets, whose tasks hold their
    lists; each node's list is sent once to a bucket that has a node of it, from that node on, and what it and a list there both hold
    closes a triangle. No wedge travels as a row, nor a list for each of its nodes. With `told`, a task hands on what this makes of
    some triangles' x, y, z and kinds of xy, xz, yz, as `columns`.
    """
    whole, last = ways.agg(F.count("*"), F.max("low")).first()
    most = ways.agg(F.max("high")).first()[0]
    buckets = max(ways.sparkSession.sparkContext.defaultParallelism, -(-whole // BUCKET_WAYS))
    kind = "int" if ((most or 0) + 1) * kinds < 1 << 31 else "bigint"
    way = (F.col("high").cast("long") * kinds + (F.col("kind") if kinds > 1 else 0)).cast(kind)
    lists = ways.groupBy("low").agg(F.sort_array(F.collect_list(way)).alias("out"))
    home = lambda c: F.pmod(c, F.lit(buckets)).cast("int")
    theirs = lists.select(home(F.col("low")).alias("bucket"), F.lit(False).alias("ask"), F.col("low").cast("long").alias("low"), "out")
    # nodes above the last with ways out have no list that could be met
    homes = F.transform("out", lambda v: home(F.floor(v / kinds) if kinds > 1 else v))
    asks = lists.where(F.size("out") > 1).withColumn("homes", homes)
    met = F.array_distinct(F.slice("homes", 1, F.size(F.filter(F.slice("out", 1, F.size("out") - 1), lambda v: v < F.lit((last or 0) + 1) * kinds))))
    asks = asks.select(F.explode(met).alias("bucket"), F.lit(True).alias("ask"), F.col("low").cast("long").alias("low"), "out", "homes")
    asks = asks.withColumn("out", F.expr("slice(out, int(array_position(homes, bucket)), size(out))")).drop("homes")
    dealt = theirs.unionByName(asks).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "ask", "low")

    def rows(batches) -> Iterator[pa.RecordBatch]:
        for found in _met(batches, kinds, lambda number: number % buckets):
            arrays = told(*found) if told else found[:3]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], names=[c.split()[0] for c in (columns or LISTED).split(", ")])

    return dealt.mapInArrow(rows, columns or LISTED)


LISTED = "x bigint, y bigint, z bigint"


def _graph(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`numbered` nodes and `oriented` distinct edges, stored."""
    simple = written(simple_edges(edges), "simple")
    names = written(numbered(degrees(simple)), "names")
    return names, written(oriented(simple, names), "ways")


def triangles(edges: DataFrame) -> DataFrame:
    """x, y, z of every triangle of the undirected graph, once: x has the lowest degree (then id), y < z.

    Parallel edges and loops don't matter; edges with a null or empty end are skipped; no triangle gives no row.
    """
    names, ways = _graph(edges)
    found = closed(ways)
    for c in ("x", "y", "z"):
        found = found.join(names.select(F.col("number").alias(c), F.col("id").alias(f"id_{c}")), c)
    return found.select(F.col("id_x").alias("x"), F.least("id_y", "id_z").alias("y"), F.greatest("id_y", "id_z").alias("z"))


def clustering(edges: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """id, degree, triangles, clustering (the share of its neighbour pairs that are edges, 0 below two) of all edge ends."""
    count = lambda of, name: of.select(F.explode(F.array("x", "y", "z")).alias(name)).groupBy(name).agg(F.count("*").alias("triangles"))
    if found is None:
        names, ways = _graph(edges)
        ends = closed(ways, _corners, "number bigint, n bigint").groupBy("number").agg(F.sum("n").alias("triangles"))
        known, corners = names.select("id", "degree"), ends.join(names, "number").select("id", "triangles")
    else:
        known, corners = degrees(simple_edges(edges)), count(found, "id")
    n = F.coalesce("triangles", F.lit(0)).cast("long")
    pairs = F.col("degree") * (F.col("degree") - 1)
    return known.join(corners, "id", "left").select("id", "degree", n.alias("triangles"), F.when(pairs > 0, 2.0 * n / pairs).otherwise(0.0).alias("clustering"))


def census(edges: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """motif, n: nodes, edges, wedges (paths of two edges), open wedges, triangles, stars of three; then triangles by their edges' types.

    A triangle's types are those of its edges, in order, joined by +; parallel edges of several types give a motif each.
    """
    kept = edges.select("source", "target", F.coalesce("type", F.lit("")).alias("type"))
    simple = written(_ends(kept).groupBy("a", "b").agg(F.array_sort(F.collect_set("type")).alias("types")), "simple")
    names = written(numbered(degrees(simple)), "names")
    sets = written(simple.select("types").distinct().select("types", F.monotonically_increasing_id().alias("at")), "sets")
    sets = written(sets.select("types", (F.row_number().over(Window.orderBy("at")) - 1).alias("kind")), "sets")  # a row for each set of types
    kinds = sets.count()
    typed = written(oriented(simple.join(sets, "types").drop("types"), names), "ways")
    if found is None:
        by_kinds = closed(typed, _by_kinds, "k0 bigint, k1 bigint, k2 bigint, n bigint", kinds).groupBy("k0", "k1", "k2").agg(F.sum("n").alias("n"))
    else:
        for c in ("x", "y", "z"):
            found = found.join(names.select(F.col("id").alias(c), F.col("number").alias(f"n_{c}")), c)
        three = found.select(F.array_sort(F.array("n_x", "n_y", "n_z")).alias("n")).select(*[F.col("n")[k].alias(c) for k, c in enumerate("xyz")])
        for k, (p, q) in enumerate((("x", "y"), ("x", "z"), ("y", "z"))):
            three = three.join(typed.select(F.col("low").alias(p), F.col("high").alias(q), F.col("kind").alias(f"k{k}")), [p, q])
        by_kinds = three.groupBy("k0", "k1", "k2").agg(F.count("*").alias("n"))
    found = written(by_kinds, "triangles")
    d = F.col("degree").cast("decimal(38,0)")
    of_degrees = {"nodes": F.count("*"), "edges": F.sum(d) / 2, "wedges": F.sum(d * (d - 1)) / 2, "open wedges": F.sum(d * (d - 1)) / 2, "stars": F.sum(d * (d - 1) * (d - 2)) / 6}
    of_triangles = {"triangles": F.sum("n"), "open wedges": -3 * F.sum("n")}
    row = lambda counts: F.array(*[F.struct(F.lit(k).alias("motif"), F.coalesce(v, F.lit(0)).cast("bigint").alias("n")) for k, v in counts.items()])
    told = [df.agg(row(counts).alias("m")).select(F.explode("m").alias("m")).select("m.*") for df, counts in ((names, of_degrees), (found, of_triangles))]
    three = found
    for k in range(3):  # several types of one pair are a row each
        three = three.join(sets.select(F.col("kind").alias(f"k{k}"), F.col("types").alias(f"t{k}")), f"k{k}").withColumn(f"t{k}", F.explode(f"t{k}"))
    by_type = three.groupBy(F.array_join(F.array_sort(F.array("t0", "t1", "t2")), "+").alias("motif")).agg(F.sum("n").alias("n"))
    return told[0].unionByName(told[1]).unionByName(by_type).groupBy("motif").agg(F.sum("n").alias("n"))
