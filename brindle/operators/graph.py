"""Typed multigraphs as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def _whole(edges: DataFrame) -> DataFrame:
    """Edges without those that have a null or empty end."""
    return edges.where("source is not null and source <> '' and target is not null and target <> ''")


def undirected(edges: DataFrame) -> DataFrame:
    """id, nbr, edge_seq, side: each edge both ways; parallel edges repeat and a self-loop gives two rows.

    Edges with a null or empty end are skipped.
    """
    edges = _whole(edges)
    seq = F.col("edge_seq") if "edge_seq" in edges.columns else F.struct("target", "type")
    out = edges.select(F.col("source").alias("id"), F.col("target").alias("nbr"), seq.alias("edge_seq"), F.lit(0).alias("side"))
    back = edges.select(F.col("target").alias("id"), F.col("source").alias("nbr"), seq.alias("edge_seq"), F.lit(1).alias("side"))
    return out.union(back)


def _dealt(ends: DataFrame, parts: int | None) -> DataFrame:
    """Rows dealt by both ends before they are counted: a task holds the rows of its part alone, and a hub is spread over all."""
    return ends.repartition(parts, "id", "nbr") if parts else ends.repartition("id", "nbr")


def true_neighbors(edges: DataFrame, of: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """id, nbr: distinct neighbours; they may be unknown nodes, or the node itself.

    With `of` (query_id), those of these nodes alone. `parts` is the number of parts that the edges' ends are dealt to, if
    not the session's.
    """
    ends = undirected(edges).select("id", "nbr")
    if of is not None:
        ends = ends.join(of.select(F.col("query_id").alias("id")), "id", "left_semi")
    return _dealt(ends, parts).distinct()


def degree(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """id, degree (each edge end counts), n_true (distinct neighbours). `parts` as in `true_neighbors`."""
    pairs = _dealt(undirected(edges).select("id", "nbr"), parts).groupBy("id", "nbr").agg(F.count("*").alias("ends"))
    return pairs.groupBy("id").agg(F.sum("ends").alias("degree"), F.count("*").alias("n_true"))


def neighbor_counts(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """id, n_true: how many distinct neighbours a node has. A pair of ends is dealt once, whichever way its edges go. `parts` as in `true_neighbors`."""
    ends = _whole(edges).select(F.least("source", "target").alias("id"), F.greatest("source", "target").alias("nbr"))
    pairs = _dealt(ends, parts).distinct()
    both = F.when(F.col("id") == F.col("nbr"), F.array("id")).otherwise(F.array("id", "nbr"))
    return pairs.select(F.explode(both).alias("id")).groupBy("id").agg(F.count("*").alias("n_true"))


#: Edges of a bucket above which it is dealt in slices.
SLICE_ROWS = 4_000_000


def homed(edges: DataFrame) -> DataFrame:
    """deal, home, hub: edges (bucket, home, hub) dealt by their bucket, which all edges of a home share.

    Choose the end with fewer edges as home: a hub's edges are then added up in each bucket before anything is sent. Buckets
    with very many edges are dealt in slices, by their hubs. The order of a pair's ends is the same in all its edges.
    """
    heavy = edges.groupBy("bucket").agg(F.count("*").alias("rows")).where(F.col("rows") > SLICE_ROWS)
    heavy = heavy.select("bucket", F.ceil(F.col("rows") / SLICE_ROWS).alias("slices"))
    found = edges.join(F.broadcast(heavy), "bucket", "left")  # one row of `heavy` for SLICE_ROWS edges at most
    deal = F.xxhash64("bucket", F.pmod(F.xxhash64("hub"), F.coalesce("slices", F.lit(1))))
    return found.select(deal.alias("deal"), "home", "hub").repartition("deal")


def homed_counts(edges: DataFrame) -> DataFrame:
    """id, n_true: how many distinct neighbours a node has, of edges by `homed`: each bucket hands on one count a node."""
    pairs = edges.distinct()
    ends = pairs.select("deal", F.explode(F.when(F.col("home") == F.col("hub"), F.array("home")).otherwise(F.array("home", "hub"))).alias("id"))
    return ends.groupBy("deal", "id").agg(F.count("*").alias("n")).groupBy("id").agg(F.sum("n").alias("n_true"))


def eligible(nodes: DataFrame, edges: DataFrame, least: int = 2, parts: int | None = None) -> DataFrame:
    """Nodes with at least so many distinct neighbours: query_id, n_true. `parts` as in `true_neighbors`."""
    counts = neighbor_counts(edges, parts).where(F.col("n_true") >= least)
    return counts.join(nodes.select("id"), "id", "left_semi").select(F.col("id").alias("query_id"), "n_true")


def bfs_subgraph(queries: DataFrame, near: DataFrame, most: int | None = 50, hops: int | None = None) -> DataFrame:
    """Breadth-first subgraphs of all queries at once: query_id, node, bfs_order, dist.

    `near` is `undirected`'s table. The order is that of one queue: nodes by their parent's order, then by the
    edges' order. A subgraph ends at `most` nodes (None: no such end) or after `hops` levels. Unknown queries give themselves. One
    pass of joins a level serves all queries; each level is written, so the plan stays short. With an end, a level is of
    the queries that haven't reached it, and a node needs its first 2 * `most` neighbours alone, as at most `most` of them
    can be in a subgraph before. `near` is read once a level, of which the edges of the level's own nodes are kept: store
    it if it is dear.
    """
    start = queries.select("query_id").distinct()
    seen = start.select("query_id", F.col("query_id").alias("node"), F.lit(1).alias("bfs_order"), F.lit(0).alias("dist"))
    if most is not None and most <= 1:
        return seen
    near = near.select(F.col("id").alias("node"), "nbr", "edge_seq", "side")
    level, frontier = 0, seen
    while hops is None or level < hops:
        level += 1
        met = near
        if most is not None:
            full = seen.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= most)
            frontier = frontier.join(full, "query_id", "left_anti")
            if frontier.isEmpty():
                break
            first = near.join(frontier.select("node").distinct(), "node", "left_semi").groupBy("node", "nbr").agg(F.min(F.struct("edge_seq", "side")).alias("edge"))
            place = F.row_number().over(Window.partitionBy("node").orderBy("edge", "nbr"))
            met = first.withColumn("place", place).where(F.col("place") <= 2 * most).select("node", "nbr", "edge.edge_seq", "edge.side")
        found = frontier.join(met, "node").groupBy("query_id", F.col("nbr").alias("node")).agg(F.min(F.struct("bfs_order", "edge_seq", "side")).alias("key"))
        found = found.join(seen.select("query_id", "node"), ["query_id", "node"], "left_anti")
        order = Window.partitionBy("query_id").orderBy("key", "node")
        have = seen.groupBy("query_id").agg(F.max("bfs_order").alias("have"))
        found = found.withColumn("at", F.row_number().over(order))
        found = (found if most is None else found.where(F.col("at") <= most)).join(have, "query_id")
        found = found if most is None else found.where(F.col("have") + F.col("at") <= most)
        frontier = written(found.select("query_id", "node", (F.col("have") + F.col("at")).cast("int").alias("bfs_order"), F.lit(level).alias("dist")), "level")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def induced_edges(subgraph: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, source, target of the edges whose ends both lie in a query's subgraph; parallel edges repeat."""
    edges = _whole(edges).select("source", "target")
    inside = subgraph.select("query_id", "node")
    first = edges.join(inside.withColumnRenamed("node", "source"), "source")
    return first.join(inside.withColumnRenamed("node", "target"), ["query_id", "target"]).select("query_id", "source", "target")


def endpoints_missing(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id: distinct edge ends that are no node."""
    ends = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()
    return ends.join(nodes.select("id"), "id", "left_anti")
