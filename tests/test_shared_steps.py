"""What the steps that many queries share send and store."""

import pytest
from pyspark.sql import functions as F

from brindle.functions import bits
from brindle.operators import evaluate, graph, paths, signatures, temporal, votes
from brindle.storage import scratch


def _star(spark, leaves=40):
    return spark.range(leaves).select(F.lit("hub").alias("source"), F.format_string("leaf%03d", "id").alias("target"), F.lit("t").alias("type"))


def test_capped_subgraphs_keep_no_edges_but_their_own(spark):
    edges = _star(spark).union(spark.createDataFrame([("leaf000", "far", "t")], "source string, target string, type string"))
    queries = spark.createDataFrame([("hub",), ("far",)], "query_id string")
    with scratch(spark) as made:
        found = graph.bfs_subgraph(queries, graph.undirected(edges), 3).collect()
        names = [path.rsplit("/", 1)[1].split("-")[0] for path in made]
    assert sorted((r.query_id, r.node, r.dist) for r in found) == [("far", "far", 0), ("far", "hub", 2), ("far", "leaf000", 1), ("hub", "hub", 0), ("hub", "leaf000", 1), ("hub", "leaf001", 1)]
    assert names == ["level"] * 2  # none of all edges, and none after the last subgraph is full


def test_ends_are_dealt_to_the_parts_asked_for(spark):
    edges = _star(spark, 3).union(_star(spark, 1))
    found = graph.true_neighbors(edges, parts=7)
    assert found.rdd.getNumPartitions() == 7 and found.count() == 6
    assert [tuple(r) for r in graph.true_neighbors(edges, spark.createDataFrame([("leaf000",)], "query_id string")).collect()] == [("leaf000", "hub")]
    assert {tuple(r) for r in graph.degree(edges, 7).where("degree > 1").collect()} == {("hub", 4, 3), ("leaf000", 2, 1)}


def test_neighbours_are_counted_by_pairs_that_are_dealt_once(spark):
    rows = [("a", "b", "t"), ("b", "a", "t"), ("a", "b", "u"), ("a", "a", "t"), ("b", "c", "t"), ("", "c", "t"), (None, "c", "t"), ("c", None, "t")]
    edges = spark.createDataFrame(rows, "source string, target string, type string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    found = graph.eligible(nodes, edges, 1, parts=5)
    assert {tuple(r) for r in found.collect()} == {("a", 2), ("b", 2), ("c", 1)}
    assert "Union" not in found._jdf.queryExecution().executedPlan().toString()  # not the edges both ways


def _homed(spark, leaves=300):
    """Edges of leaves that are homes, to hubs; some are told twice, some have an end without an address."""
    rows = [(k // 100, f"leaf{k}", f"hub{h}") for k in range(leaves) for h in {k % 7, k % 3}] + [(0, "leaf0", "hub0"), (0, "leaf1", "hub1"), (0, "leaf1", "none"), (3, "none", "hub0"), (3, "hub5", "hub5"), (3, "hub6", "hub0")]
    ids = sorted({end for _, *ends in rows for end in ends} - {"none"}) + ["lone"]
    nodes = spark.createDataFrame([(i, f"text of {i} {i[::-1]}") for i in ids], "id string, text string")
    return rows, nodes, spark.createDataFrame(rows, "bucket long, home string, hub string")


@pytest.mark.parametrize("rows_a_slice", [graph.SLICE_ROWS, 40])
@pytest.mark.parametrize("once", [False, True])
def test_homed_edges_give_the_same_addresses_and_counts(spark, monkeypatch, once, rows_a_slice):
    monkeypatch.setattr(graph, "SLICE_ROWS", rows_a_slice)
    rows, nodes, edges = _homed(spark)
    plain = signatures.simhash_arrow(nodes)
    told = [(a, b, "t") for _, a, b in (set(rows) if once else rows)]
    near = graph.undirected(spark.createDataFrame(told, "source string, target string, type string"))
    dealt = graph.homed(edges)
    got, want = signatures.topology_homed(plain, dealt, F.lit(once)), signatures.topology(plain, near)
    assert got.count() == nodes.count() and got.exceptAll(want).isEmpty()
    assert dealt.select("deal").distinct().count() == 4 if rows_a_slice > 40 else dealt.select("deal").distinct().count() > 12
    counts = {tuple(r) for r in graph.homed_counts(dealt).collect()}
    assert counts == {tuple(r) for r in near.select("id", "nbr").distinct().groupBy("id").count().collect()}


def test_a_bucket_sends_one_row_of_votes_a_node(spark):
    rows, nodes, edges = _homed(spark)
    named = signatures.simhash_arrow(nodes).select("id", votes.plane(bits.limbs_of()).alias("_plane"))
    sent = votes.homed_votes(graph.homed(edges), named)
    assert sent.count() < len(rows) and sent.agg(F.sum("n")).first()[0] == 2 * (len(rows) - 2)  # where there was a row an edge's end
    assert sent.where("id like 'hub%'").groupBy("id").count().where("count > 5").isEmpty()


def test_rankings_count_the_neighbours_of_their_queries_alone(spark):
    edges, queries = _star(spark), spark.createDataFrame([("leaf000",)], "query_id string")
    ranking = spark.createDataFrame([("leaf000", "leaf001", 1), ("leaf000", "hub", 2)], "query_id string, node string, rank int")
    scores = evaluate.ranking_scores(ranking, queries, graph.true_neighbors(edges))
    assert [tuple(r) for r in scores.collect()] == [("leaf000", 0.5, 1.0)]


def test_a_nodes_distances_from_four_sources_are_one_row(spark):
    near = graph.undirected(_star(spark)).select("id", "nbr")
    sources = spark.createDataFrame([(f"leaf{k:03}",) for k in range(6)], "landmark string")
    with scratch(spark) as made:
        found = paths.distances(near, sources)
        told = {(r.landmark, r.id): r.dist for r in found.collect()}
        fronts = [spark.read.parquet(path).count() for path in made if "/front-" in path]
    assert told == {(f"leaf{k:03}", n): 1 if n == "hub" else 0 if n == f"leaf{k:03}" else 2 for k in range(6) for n in ["hub", *(f"leaf{m:03}" for m in range(40))]}
    assert fronts == [2, 80, 0]  # two rows a node for six sources, where there were six


def test_a_join_of_intervals_with_themselves_is_shuffled_once(spark):
    rows = spark.createDataFrame([(1, 7, 0, 10), (1, 8, 5, 20), (2, 9, 0, 10)], "k int, v int, s long, e long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        pairs = temporal.overlapping(rows, rows, ("k",), ("s", "e"), ("s", "e"), width=8).where("v < r_v")
        assert [r.asDict() for r in pairs.collect()] == [{"k": 1, "v": 7, "s": 0, "e": 10, "r_v": 8, "r_s": 5, "r_e": 20}]
        assert "ReusedExchange" in pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
