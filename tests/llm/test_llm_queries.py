"""Queries against their SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import FOLDER, same  # noqa: E402

from brindle.llm.oracle import ORACLES  # noqa: E402
from brindle.llm.queries import QUERIES  # noqa: E402


def test_names():
    assert set(ORACLES) <= set(QUERIES) and sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert same(QUERIES[name](spark, FOLDER), ORACLES[name])


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    table = {"op6_langid": "pages", "op8_html": "pages", "op7_chat": "conversations"}.get(name, "documents")
    assert QUERIES[name](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
