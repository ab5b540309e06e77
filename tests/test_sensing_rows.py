"""Sensed rows are summed without a row for each place."""

import hashlib

from brindle.operators import sensing


def test_sums_of_a_hub(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    nodes = spark.createDataFrame([("n0",), ("n1",)], "id string")
    near = spark.createDataFrame([("n0", f"n{k}") for k in range(300)] + [("n0", "n7"), ("n9", "n0"), ("n1", None)], "id string, nbr string")
    found = sensing.row_sums(nodes, near, 128)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "Generate" not in found._jdf.queryExecution().toString()
    want = {"n0": [0] * 128, "n1": [0] * 128}
    for one, members in (("n0", range(300)), ("n1", [1])):
        for k in members:
            digest = hashlib.sha256(f"row:n{k}".encode()).digest()
            for at in range(16):
                word = int.from_bytes(digest[2 * at : 2 * at + 2], "big")
                want[one][word & 127] += 1 if word < 1 << 15 else -1
    assert {r["id"]: r["totals"] for r in found.collect()} == want
