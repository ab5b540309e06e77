"""An index whose probes would meet nearly everything scans, with the same rows."""

import uuid

from brindle.operators import hamming_index, retrieval
from brindle.storage import shared_dir


def test_probes_that_meet_too_much_are_not_sent(spark, monkeypatch):
    rows = [(f"n{k:03}", k, 5, 5, 5) for k in range(200)]
    addresses = spark.createDataFrame(rows, "id string, l0 long, l1 long, l2 long, l3 long")
    index = hamming_index.build(addresses, f"{shared_dir(spark)}/bands-{uuid.uuid4().hex}")
    asked = addresses.where("l0 % 20 = 0").withColumnRenamed("id", "query_id")
    probed = hamming_index.search(index, asked, 4)
    monkeypatch.setattr(hamming_index, "MOST_MET", 100)
    scanned = hamming_index.search(index, asked, 4)
    assert scanned.scanned == 10 and not scanned.work and probed.work
    assert sorted(map(tuple, scanned.rows.collect())) == sorted(map(tuple, probed.rows.collect()))


def test_pairs_of_a_value_are_compared_where_they_lie(spark, monkeypatch):
    rows = [(k, 1 << k % 60, k // 60, 0, -1) for k in range(180)]
    addresses = spark.createDataFrame(rows, "id long, l0 long, l1 long, l2 long, l3 long")
    monkeypatch.setattr(hamming_index, "SLICE", 50)
    index = hamming_index.build(addresses, f"{shared_dir(spark)}/bands-{uuid.uuid4().hex}")
    pairs = hamming_index.pairs_within(index, 2)
    bits = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a[1:4], b[1:4], strict=True))
    want = [(a[0], b[0], bits(a, b)) for i, a in enumerate(rows) for b in rows[i + 1 :] if bits(a, b) <= 2]
    assert sorted(map(tuple, pairs.collect())) == want
    assert "Join Inner" not in pairs._jdf.queryExecution().optimizedPlan().toString()  # no row for a pair that meets


def test_equal_addresses_are_compared_once(spark, monkeypatch):
    rows = [(f"n{k:03}", k % 7, 5, 5, k % 3) for k in range(120)]
    addresses = spark.createDataFrame(rows, "id string, l0 long, l1 long, l2 long, l3 long")
    asked = addresses.where("substring(id, 2) % 5 = 0").withColumnRenamed("id", "query_id")
    want = sorted(map(tuple, retrieval.top_k_batch(addresses, asked, 4).collect()))
    scan, met = retrieval.top_k_batch, []
    monkeypatch.setattr(retrieval, "top_k_batch", lambda a, q, *more, **named: met.append((a.count(), q.count())) or scan(a, q, *more, **named))
    assert sorted(map(tuple, retrieval.top_k_classes(addresses, asked, 4).collect())) == want and met == [(21, 21)]
