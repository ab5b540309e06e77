"""The table function of SQL, and topology addresses that follow a stream of edges."""

import datetime
import random

import pytest

from brindle.functions import tables
from brindle.operators import graph, retrieval, signatures
from brindle.streaming import topology


def test_nearest_in_sql(spark):
    texts = [(k, f"word{k % 7} text {k % 11}") for k in range(120)] + [(500, ""), (501, None)]
    index = signatures.simhash(spark.createDataFrame(texts, "id long, text string"))
    tables.register(spark, index)
    told = spark.sql("SELECT * FROM nearest(TABLE(addresses), 'word3 text 4', 5) ORDER BY dist, id LIMIT 5")
    want = retrieval.text_query(index, "word3 text 4", 5)
    assert [tuple(r) for r in told.collect()] == [tuple(r) for r in want.collect()] and told.schema["id"].dataType.simpleString() == "bigint"
    named = spark.sql("SELECT count(*) AS n FROM nearest(TABLE(SELECT * FROM addresses WHERE id < 0), text => 'x', k => 3)")
    assert named.first()["n"] == 0
    joined = spark.sql("SELECT a.id FROM nearest(TABLE(addresses), 'word3 text 4', 2) n JOIN addresses a ON a.id = n.id WHERE n.dist = 0")
    assert joined.count() >= 1
    for bad in ("nearest(TABLE(addresses), NULL, 5)", "nearest(TABLE(addresses), 'x', 0)", "nearest(TABLE(SELECT 1 AS id), 'x', 1)"):
        with pytest.raises(Exception, match="argument|null|least"):
            spark.sql(f"SELECT * FROM {bad}").collect()
    wide = signatures.simhash(spark.createDataFrame(texts, "id long, text string"), bits=512)
    tables.register(spark, wide, "wide")
    got = spark.sql("SELECT * FROM nearest(TABLE(wide), 'word3 text 4', 5) ORDER BY dist, id LIMIT 5").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in retrieval.text_query(wide, "word3 text 4", 5).collect()]


CHANGE = "source string, target string, delta int, at timestamp"
START = datetime.datetime(2024, 1, 1)


def run(spark, tmp_path, name, content, batches, late="1 hour"):
    where, out, mark = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "mark"))
    for batch in batches:  # one batch after the other, as they come
        spark.createDataFrame(batch, CHANGE).coalesce(1).write.mode("append").parquet(where)
        stream = spark.readStream.schema(CHANGE).parquet(where)
        topology.follow_edges(stream, content, out, mark, late).awaitTermination()
    return out


def rows_of(df):
    return {r["id"]: tuple(r)[1:] for r in df.collect()}


def test_any_order_of_batches_gives_the_batch_index(spark, tmp_path):
    rng = random.Random(2)
    ids = [f"n{k}" for k in range(9)]
    content = signatures.simhash(spark.createDataFrame([(i, f"{i} {rng.choice('pqr')} text") for i in ids], "id string, text string"))
    edges = [(rng.choice(ids), rng.choice([*ids, "ghost"])) for _ in range(25)]
    gone = edges[::4]
    changes = [(a, b, 1, START) for a, b in edges] + [(a, b, -1, START) for a, b in gone] + [(None, "n1", 1, START), ("n1", "n2", 5, START), ("n1", "n2", 1, None)]
    left = list(edges)
    for e in gone:
        left.remove(e)
    batch = spark.createDataFrame([(a, b, "t", k) for k, (a, b) in enumerate(left)], "source string, target string, type string, edge_seq int")
    want = rows_of(signatures.topology(content, graph.undirected(batch)))
    for k in range(2):
        rng.shuffle(changes)  # withdrawals may come before what they withdraw
        cut = rng.randrange(len(changes))
        out = run(spark, tmp_path, str(k), content, [changes[:cut] or changes[:1], changes[cut:] if cut else changes[1:]])
        assert rows_of(topology.current(spark, out, content)) == want


def test_late_changes_are_dropped_and_counted(spark, tmp_path):
    content = signatures.simhash(spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "three")], "id string, text string"))
    hour = datetime.timedelta(hours=1)
    first = [("a", "b", 1, START + 10 * hour)]
    second = [("a", "c", 1, START), ("a", "c", 1, START + 9.5 * hour)]  # one is older than the mark allows, one isn't
    out = run(spark, tmp_path, "late", content, [first, second])
    batch = spark.createDataFrame([("a", "b", "t", 1), ("a", "c", "t", 2)], "source string, target string, type string, edge_seq int")
    assert rows_of(topology.current(spark, out, content)) == rows_of(signatures.topology(content, graph.undirected(batch)))
    newest = {r["id"]: r for r in spark.read.parquet(out).orderBy("version").collect()}
    assert newest["a"]["n"] == 2 and newest["c"]["n"] == 1
