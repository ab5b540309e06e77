"""Readers and sinks on odd files."""

import json

import pytest
from pyspark.errors import AnalysisException

from brindle.sources import jsonl


def test_graph_files(spark, tmp_path):
    nodes = [
        '{"id": "a", "title": "old", "bisociation": {"domain_a": "x", "domain_b": "y"}}',
        "not json",
        "",
        '{"id": "b", "bisociation": "text", "falsifiable_test": {"k": [1, 2]}, "label": "é"}',
        "[1, 2]",
        '{"id": "a", "title": "new"}',
        '{"title": "nobody"}',
    ]
    (tmp_path / "n.jsonl").write_text("\n".join(nodes), encoding="utf-8")
    got = {r["id"]: r for r in jsonl.read_nodes(spark, str(tmp_path / "n.jsonl")).collect()}
    assert set(got) == {"a", "b"} and got["a"]["title"] == "new" and got["a"]["node_seq"] < got["b"]["node_seq"]
    assert got["b"]["domain_a"] is None and json.loads(got["b"]["falsifiable_test"]) == {"k": [1, 2]} and got["b"]["label"] == "é"
    assert {r["line"] for r in jsonl.quarantined(spark, str(tmp_path / "n.jsonl")).collect()} == {"[1, 2]", '{"title": "nobody"}'}
    assert [r["line"] for r in jsonl.malformed(spark, str(tmp_path / "n.jsonl")).collect()] == ["not json"]


def test_edge_aliases(spark, tmp_path):
    edges = ['{"source": "a", "target": "b", "type": "t"}', '{"src": "c", "tgt": "d"}', '{"source": "", "src": "x", "target": "y"}']
    (tmp_path / "e.jsonl").write_text("\n".join(edges))
    got = [tuple(r)[:3] for r in jsonl.read_edges(spark, str(tmp_path / "e.jsonl")).orderBy("edge_seq").collect()]
    assert got == [("a", "b", "t"), ("c", "d", None), ("", "y", None)]


def test_missing_path(spark, tmp_path):
    with pytest.raises(AnalysisException):
        jsonl.read_lines(spark, str(tmp_path / "none.jsonl")).count()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, 0.91236, "é")], "seed int, mrr double, name string")
    jsonl.write_lines(df, str(tmp_path / "out"))
    with pytest.raises(AnalysisException):
        jsonl.write_lines(df, str(tmp_path / "out"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("part-*"))
    assert json.loads(text) == {"seed": 0, "mrr": 0.91236, "name": "é"} and "é" in text
    jsonl.write_results(df, str(tmp_path / "csv"))
    assert [tuple(r) for r in jsonl.read_results(spark, str(tmp_path / "csv"), "seed int, mrr double, name string").collect()] == [(0, 0.9124, "é")]


def test_backup(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "x int")
    for _ in range(3):
        jsonl.write_lines(df, str(tmp_path / "out"), backup=True)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out", "out.bak", "out.bak1"]
    assert jsonl.backed_up(spark, str(tmp_path / "none")) is None


def test_scopes_of_threads_are_apart(spark):
    """A table that one thread writes stays while another thread's scope ends."""
    import threading

    from brindle.storage import scratch, written

    inside, done = threading.Event(), threading.Event()

    def other():
        with scratch(spark) as made:
            inside.set()
            done.wait(60)
            assert made == []

    thread = threading.Thread(target=other)
    thread.start()
    inside.wait(60)
    table = written(spark.range(5), "mine")
    done.set()
    thread.join()
    assert table.count() == 5
    with scratch(spark) as made:
        gone = written(spark.range(3), "gone")
        assert gone.count() == 3 and len(made) == 1
    assert table.count() == 5
