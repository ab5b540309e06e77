"""Triangles are closed by lists of numbers, so wedges don't travel as rows."""

from itertools import combinations

from brindle.operators import motifs


def test_lists_close_every_triangle(spark, monkeypatch):
    monkeypatch.setattr(motifs, "SLICE", 3)
    ways = spark.createDataFrame(list(combinations(range(12), 2)), "low int, high int")
    found = motifs.closed(ways)
    assert sorted(map(tuple, found.collect())) == list(combinations(range(12), 3))


def test_numbers_follow_degree_and_id(spark):
    known = spark.createDataFrame([("b", 2), ("a", 2), ("z", 1), ("c", 9)], "id string, degree long").repartition(3)
    assert [(r["number"], r["id"]) for r in motifs.numbered(known).orderBy("number").collect()] == [(0, "z"), (1, "a"), (2, "b"), (3, "c")]


def test_no_list_is_sent_for_each_of_its_nodes(spark):
    ways = spark.createDataFrame(list(combinations(range(40), 2)), "low int, high int")
    assert "array_intersect" not in motifs.closed(ways)._jdf.queryExecution().toString()
    assert motifs.closed(ways, lambda x, y, z, *_: [[len(x)]], "n bigint").agg({"n": "sum"}).first()[0] == 40 * 39 * 38 // 6


def test_hubs_and_long_numbers(spark, monkeypatch):
    monkeypatch.setattr(motifs, "BUCKET_WAYS", 20)
    far = 1 << 33
    pairs = [(0, k) for k in range(1, 30)] + [(k, far + k % 3) for k in range(1, 30)] + [(0, far + k) for k in range(3)]
    found = motifs.closed(spark.createDataFrame(pairs, "low long, high long"))
    assert sorted(map(tuple, found.collect())) == sorted((0, k, far + k % 3) for k in range(1, 30))
