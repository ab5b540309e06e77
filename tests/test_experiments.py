"""Whole experiments: the tables that they return and write."""

import pytest

from brindle import experiments


@pytest.mark.parametrize("name, parts", [("sanitiser", {"nodes", "edges", "missing", "scan"}), ("ablation", {"rankers", "verdict", "best_baseline"})])
def test_run(spark, tmp_path, name, parts):
    found = experiments.run(spark, name, "/root/testdata/sf0.001", str(tmp_path))
    assert set(found) == parts
    for part, df in found.items():
        path = next(tmp_path.glob(f"{part}.*"))
        assert (spark.read.json if path.suffix == ".jsonl" else spark.read.option("header", True).csv)(str(path)).count() == df.count()
