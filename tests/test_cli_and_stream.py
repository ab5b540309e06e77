"""The command line over files, and an index that follows a stream."""

import json

from brindle import cli
from brindle.functions import bits
from brindle.streaming import index


def graph_files(folder):
    nodes = [{"id": f"n{k}", "title": f"word{k % 3} text {k}"} for k in range(12)]
    edges = [{"source": "n0", "target": f"n{k}", "type": "t"} for k in range(1, 8)] + [{"src": "n1", "tgt": "n2"}]
    (folder / "n.jsonl").write_text("\n".join(map(json.dumps, nodes)))
    (folder / "e.jsonl").write_text("\n".join(map(json.dumps, edges)))
    return ["--nodes", str(folder / "n.jsonl"), "--edges", str(folder / "e.jsonl")]


def test_search(spark, tmp_path):
    base = graph_files(tmp_path)
    got = cli.run(spark, [*base, "search", "--query", "word1 text 10", "--k", "3"]).collect()
    assert got[0]["id"] == "n10" and got[0]["dist"] == 0 and got[0]["name"] == "word1 text 10" and len(got) == 3
    assert cli.run(spark, [*base, "search", "--node", "n1", "--k", "20"]).count() == 11
    wide = cli.run(spark, [*base, "search", "--bits", "512", "--query-and", "word1", "text", "--k", "4"]).collect()
    assert len(wide) == 4 and all(r["dist"] % 2 == 0 for r in wide)


def test_walk_and_evaluate(spark, tmp_path):
    base = graph_files(tmp_path)
    got = cli.run(spark, [*base, "walk", "--query-id", "n1", "--k", "2"]).collect()
    assert [r["id"] for r in got][0] in ("n0", "n2") and len(got) == 2
    rows = {r["method"]: r for r in cli.run(spark, [*base, "evaluate", "--queries", "3"]).collect()}
    assert set(rows) == {"content", "topology"} and all(0 <= r["mrr"] <= 1 for r in rows.values())


def test_stream(spark, tmp_path):
    where = [str(tmp_path / x) for x in ("in", "out", "mark")]
    for text in ("first text", "second text"):
        spark.createDataFrame([("a", text), (text, "fixed")], "id string, text string").write.mode("append").parquet(where[0])
        stream = spark.readStream.schema("id string, text string").parquet(where[0])
        index.follow(stream, where[1], where[2]).awaitTermination()
    got = {r[0]: list(r[1:]) for r in index.latest(spark, where[1]).collect()}
    assert got["a"] == bits.address_of("second text") and got["first text"] == bits.address_of("fixed") and len(got) == 3
