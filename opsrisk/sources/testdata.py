"""Adapters that give the driver's tables the shapes the operators work on.

Joins carry no hints: Spark broadcasts a side only after measuring its files
(or, at run time, its shuffle output) and otherwise shuffles both sides, with
adaptive execution splitting partitions of keys that hold many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsrisk.constants import (
    DEFAULT_AIRPORT_RATE,
    DEFAULT_CARRIER_RATE,
    DEFAULT_FLIGHTS,
    MODEL_VERSION,
)
from opsrisk.functions.calendar import is_summer, is_winter_holiday, years_since_base
from opsrisk.functions.display import status_of

# ship years 1995..2001 become 2014..2020, inside the range requests may have
YEAR_SHIFT = 19

# stated, so that no file has to be opened to plan a query
TABLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def monthly_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Carrier x airport x month, from line items by brand and supplier region.

    Open line items count as not reported and untaxed ones as not flown, so
    cells without activity, cells with zero flights, missing measures and more
    delays than flights all occur. A sum over no reported row is null.
    """
    lines = table(spark, folder, "lineitem").selectExpr(
        "l_partkey",
        "l_suppkey",
        f"year(l_shipdate) + {YEAR_SHIFT} AS year",
        "month(l_shipdate) AS month",
        "l_linestatus = 'F' AS reported",
        "l_linestatus = 'F' AND l_quantity > 40 AS delayed",
        "l_linenumber AS cause",
        "l_returnflag",
        "double(l_tax > 0) AS flown",
        "double(l_quantity > 40) AS late",
        "double(l_discount >= 0.09D) AS cancelled",
        "double(l_tax >= 0.08D) AS diverted",
    )
    return (
        lines.join(table(spark, folder, "part"), F.expr("l_partkey = p_partkey"))
        .join(table(spark, folder, "supplier"), F.expr("l_suppkey = s_suppkey"))
        .join(table(spark, folder, "nation"), F.expr("s_nationkey = n_nationkey"))
        .join(table(spark, folder, "region"), F.expr("n_regionkey = r_regionkey"))
        .groupBy("year", "month", "p_brand", "r_name")
        .agg(
            F.expr("sum(flown) FILTER (WHERE reported) AS arr_flights"),
            F.expr("sum(late) FILTER (WHERE reported) AS arr_del15"),
            F.expr("sum(1D) FILTER (WHERE delayed AND cause IN (1, 2)) AS carrier_ct"),
            F.expr("sum(1D) FILTER (WHERE delayed AND cause = 3) AS weather_ct"),
            F.expr("sum(1D) FILTER (WHERE delayed AND cause IN (4, 5)) AS nas_ct"),
            F.expr("sum(1D) FILTER (WHERE delayed AND cause = 6) AS security_ct"),
            F.expr("sum(1D) FILTER (WHERE delayed AND cause = 7) AS late_aircraft_ct"),
            F.expr("sum(cancelled) FILTER (WHERE reported AND l_returnflag = 'R') AS arr_cancelled"),
            F.expr("sum(diverted) FILTER (WHERE reported AND l_returnflag = 'A') AS arr_diverted"),
        )
        .selectExpr(
            "year",
            "month",
            "p_brand AS carrier",
            "concat('Carrier ', p_brand) AS carrier_name",
            "r_name AS airport",
            "concat(r_name, ' Hub') AS airport_name",
            "arr_flights",
            "arr_del15",
            "carrier_ct",
            "weather_ct",
            "nas_ct",
            "security_ct",
            "late_aircraft_ct",
            "arr_cancelled",
            "arr_diverted",
        )
    )


def _daily_footfall(orders: DataFrame, key: Column) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return (
        orders.groupBy(key.alias("series_key"), F.to_date("o_orderdate").alias("date"))
        .agg(F.sum(cents).alias("cents"), F.count("*").alias("n"))
        .select("series_key", "date", F.expr("cents div (800 * n)").alias("passenger_footfall"))
    )


def traffic_raw(spark: SparkSession, folder: str) -> DataFrame:
    """One daily series over all orders, in the column names of the raw file."""
    orders = table(spark, folder, "orders").select("o_orderdate", "o_totalprice")
    return _daily_footfall(orders, F.lit("ALL"))


def traffic_panel_raw(spark: SparkSession, folder: str) -> DataFrame:
    """One daily series per market segment."""
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return _daily_footfall(joined, F.col("c_mktsegment"))


def history_from(events: DataFrame) -> DataFrame:
    """Prediction history from events; also applies to a stream of events."""
    month = F.month("ts")
    year = F.year("ts")
    probability = F.round(F.least(F.col("value") / 100, F.lit(1.0)), 4)
    prediction = (probability >= 0.5).cast("int")
    return events.select(
        F.col("event_id").alias("id"),
        month.alias("flight_month"),
        year.alias("flight_year"),
        F.lit(DEFAULT_FLIGHTS).alias("arr_flights"),
        is_summer(month).cast("double").alias("is_summer"),
        is_winter_holiday(month).cast("double").alias("is_winter_holiday"),
        years_since_base(year).cast("double").alias("years_since_2013"),
        F.lit(DEFAULT_AIRPORT_RATE).alias("airport_avg_delay_rate"),
        F.lit(DEFAULT_CARRIER_RATE).alias("carrier_avg_delay_rate"),
        prediction.alias("high_delay_prediction"),
        probability.alias("high_delay_probability"),
        status_of(prediction).alias("status"),
        F.lit(MODEL_VERSION).alias("model_version"),
        F.col("ts").alias("created_at"),
    )


def prediction_history(spark: SparkSession, folder: str) -> DataFrame:
    return history_from(table(spark, folder, "events"))


def requests_from(events: DataFrame) -> DataFrame:
    """Scoring requests from events, many of them out of range or incomplete."""
    month = (F.col("event_id") % 14).cast("double")
    year = (F.lit(2010) + F.col("user_id") % 25).cast("double")
    return events.select(
        F.col("event_id").alias("request_id"),
        year.alias("year"),
        month.alias("month"),
        F.floor("value").cast("double").alias("arr_flights"),
        is_summer(month).cast("double").alias("is_summer"),
        is_winter_holiday(month).cast("double").alias("is_winter_holiday"),
        years_since_base(year).cast("double").alias("years_since_2013"),
        (F.col("value") / 100).alias("airport_avg_delay_rate"),
        F.when(F.col("event_type") != "error", DEFAULT_CARRIER_RATE).alias("carrier_avg_delay_rate"),
    )


def score_requests(spark: SparkSession, folder: str) -> DataFrame:
    return requests_from(table(spark, folder, "events"))


def scored_labels(spark: SparkSession, folder: str) -> DataFrame:
    """A label, a score and a class per event, for the quality measures."""
    score = F.round(F.least(F.col("value") / 500, F.lit(1.0)), 4)
    return table(spark, folder, "events").select(
        F.col("event_id").alias("row_id"),
        (F.col("event_type") == "error").cast("int").alias("label"),
        score.alias("score"),
        (score >= 0.1).cast("int").alias("prediction"),
    )
