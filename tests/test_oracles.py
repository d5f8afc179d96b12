"""Every registered query with an oracle agrees with it on the whole test tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("key", sorted(oracle_sql()))
def test_query_agrees_with_oracle(spark, key):
    rows, problems = compare(spark, FOLDER, key)
    assert problems == []
    assert rows > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    rows = entry(spark)
    assert rows.columns == ["carrier", "carrier_name", "mean_rate", "n", "above_average", "overall_mean"]
    assert rows.count() > 0
