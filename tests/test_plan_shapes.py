"""Plans contain no join of all pairs, and scans read and keep no more than they need."""

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from opsrisk.sources import testdata

FOLDER = "/root/testdata/sf0.001"
# these train a model or run a stream while they are built
EAGER = {"delay_eval", "delay_score"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(set(queries()) - EAGER))
def test_no_all_pairs_join(spark, key):
    plan = plan_of(queries()[key](spark, FOLDER))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(queries()["risk_scan_24h"](spark, FOLDER))
    assert "GreaterThanOrEqual(ts" in plan and "LessThanOrEqual(ts" in plan
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz,value:double>", plan)


def test_monthly_scan_reads_only_used_columns(spark):
    plan = plan_of(queries()["top_carriers"](spark, FOLDER))
    read = next(line for line in plan.splitlines() if "lineitem.parquet" in line)
    assert "l_extendedprice" not in read and "l_linenumber" not in read


def test_recent_rows_are_a_top_k(spark):
    plan = plan_of(queries()["history_recent"](spark, FOLDER))
    assert "TakeOrderedAndProject" in plan
    assert "Exchange rangepartitioning" not in plan


def test_newest_rows_are_limited_before_the_shuffle(spark):
    plan = plan_of(queries()["traffic_trend"](spark, FOLDER))
    assert plan.count("WindowGroupLimit") == 2


def test_feature_averages_do_not_shuffle_the_rows(spark):
    plan = plan_of(queries()["features_monthly"](spark, FOLDER))
    assert plan.count("BroadcastHashJoin") == 2
    assert "Sort" not in plan


def test_hot_keys_are_split_in_shuffle_joins(spark, folder):
    """With broadcasting off, a part and a supplier with a third of the rows are split over tasks."""
    source = "/root/testdata/sf0.01"
    hot = F.col("l_orderkey") % 3 == 0
    testdata.table(spark, source, "lineitem").withColumns(
        {
            "l_partkey": F.when(hot, 77).otherwise(F.col("l_partkey")).cast("bigint"),
            "l_suppkey": F.when(hot, 5).otherwise(F.col("l_suppkey")).cast("bigint"),
        }
    ).repartition(8).write.parquet(f"{folder}/lineitem.parquet")
    for name in ("part", "supplier", "nation", "region"):
        testdata.table(spark, source, name).write.parquet(f"{folder}/{name}.parquet")
    expected = sorted(testdata.monthly_raw(spark, folder).collect(), key=str)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        rows = testdata.monthly_raw(spark, folder)
        assert sorted(rows.collect(), key=str) == expected
        assert plan_of(rows).split("Initial Plan")[0].count("skew=true") >= 2
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
