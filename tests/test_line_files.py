"""The data source of JSON lines: byte ranges, pushed filters, commits."""

import json
import os

import pytest

from brindle.sources.line_files import LineReader, LineWriter, register

SCHEMA = "id string, n bigint, x double, ok boolean, extra string"


@pytest.fixture()
def source(spark):
    register(spark)
    yield spark
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


LINES = [
    '{"id": "a", "n": 1, "x": 2, "ok": true, "extra": {"k": [1, "é"]}}',
    "",
    "no json",
    '{"id": "ü", "n": 2.5, "x": "text", "ok": 1}',
    "[1, 2]",
    '{"id": 7, "n": 99999999999999999999}',
    '{"id": null, "n": true, "more": 1}',
    '{"id": "' + "long " * 50 + '", "n": -3}',
    "   ",
    '{"id": "last", "n": 4, "x": 0.5}',
]
WANT = [("a", 1, 2.0, True, '{"k": [1, "é"]}'), ("ü", None, None, None, None), ("7", None, None, None, None), (None, None, None, None, None), ("long " * 50, -3, None, None, None), ("last", 4, 0.5, None, None)]


@pytest.mark.parametrize("end", ["\n", ""])
@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_ranges_read_as_one_file(spark, tmp_path, split, end):
    from pyspark.sql.types import StructType

    path = tmp_path / "lines.json"
    path.write_bytes("\n".join(LINES).encode() + end.encode())
    reader = LineReader(StructType.fromDDL(SCHEMA), {"path": str(path), "splitbytes": str(split)})
    parts = reader.partitions()
    assert len(parts) == -(-path.stat().st_size // split)
    got = [tuple(r.values()) for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert got == WANT
    assert [line.decode() for p in parts for line in reader.lines(p)][: len(LINES)] == LINES


def test_read_by_spark(source, tmp_path):
    for name in ("a.json", "b.json", "_hidden", ".hidden"):
        (tmp_path / name).write_text("\n".join(LINES))
    df = source.read.format("line_files").schema(SCHEMA).option("splitBytes", 100).load(str(tmp_path))
    assert sorted(map(tuple, df.collect()), key=str) == sorted(WANT * 2, key=str) and df.rdd.getNumPartitions() > 4
    (tmp_path / "empty").mkdir()
    assert source.read.format("line_files").schema(SCHEMA).load(str(tmp_path / "empty")).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        source.read.format("line_files").schema(SCHEMA).load(str(tmp_path / "nowhere")).count()
    with pytest.raises(Exception, match="map<string,string>"):
        source.read.format("line_files").schema("m map<string,string>").load(str(tmp_path)).count()


def test_filters_are_pushed_and_told_in_the_plan(source, tmp_path):
    rows = [(f"n{k}", k if k % 5 else None, k / 2, k % 2 == 0, None) for k in range(200)]
    source.createDataFrame(rows, SCHEMA).write.format("line_files").mode("append").save(str(tmp_path / "t"))
    df = source.read.format("line_files").schema(SCHEMA).load(str(tmp_path / "t"))
    for condition in ("n > 150", "n = 7", "id in ('n3', 'n8')", "id like 'n19%'", "n <= 3 and x >= 1", "ok = true and id like '%7'", "n is not null", "n is null", "n > 10 or id = 'n1'", "not (n > 10)", "length(id) = 2 and n < 9"):
        want = sorted(r["id"] for r in source.createDataFrame(rows, SCHEMA).where(condition).collect())
        assert sorted(r["id"] for r in df.where(condition).collect()) == want, condition
    plan = df.where("n > 150")._jdf.queryExecution().toString()
    assert "GreaterThan" in plan or "n > 150" in plan or "n#" in plan
    reader = LineReader(df.schema, {"path": str(tmp_path / "t")})
    from pyspark.sql.datasource import GreaterThan, IsNull

    some = [GreaterThan(("n",), 150), IsNull(("n",)), GreaterThan(("a", "b"), 1)]
    assert list(reader.pushFilters(some)) == some[1:] and reader.filters == [("n", "GreaterThan", 150)]
    kept = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert kept == sum(n is not None and n > 150 for _, n, *_ in rows)  # the others never leave the source


def test_write_modes(source, tmp_path):
    where = str(tmp_path / "out")
    df = source.createDataFrame([("é", 1), (None, 2)], "id string, n int").repartition(3)
    df.write.format("line_files").mode("append").save(where)
    df.write.format("line_files").mode("append").save(where)
    back = source.read.format("line_files").schema("id string, n int").load(where)
    assert sorted(map(tuple, back.collect()), key=str) == sorted([("é", 1), (None, 2)] * 2, key=str)
    df.write.format("line_files").mode("overwrite").save(where)
    assert source.read.format("line_files").schema("id string, n int").load(where).count() == 2
    text = "".join(open(f"{where}/{f}", encoding="utf-8").read() for f in os.listdir(where))
    assert sorted(map(json.dumps, map(json.loads, text.split("\n")[:-1]))) == sorted(map(json.dumps, [{"id": "é", "n": 1}, {"n": 2}])) and "é" in text
    assert all(not f.startswith("_") for f in os.listdir(where))


def test_only_tasks_that_count_are_seen(tmp_path):
    import pyarrow as pa

    writer = LineWriter({"path": str(tmp_path / "t")}, False)
    batch = pa.RecordBatch.from_pydict({"n": [1]})
    first, again = writer.write(iter([batch])), writer.write(iter([batch]))
    assert os.listdir(tmp_path / "t") == [f"_{writer.job}"]
    writer.commit([again, None])
    assert os.listdir(tmp_path / "t") == [again.name] and first.name != again.name
    lost = LineWriter({"path": str(tmp_path / "t")}, True)
    lost.write(iter([batch]))
    lost.abort([])
    assert os.listdir(tmp_path / "t") == [again.name]
