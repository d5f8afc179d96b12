import pytest
from pyspark.sql import functions as F

from opsrisk.operators import cleaning, features
from opsrisk.operators.joins import attach_group_values
from opsrisk.schemas import CLEAN_COLUMNS, RAW_SCHEMA


def raw_row(**given):
    row = {f.name: None for f in RAW_SCHEMA} | {
        "year": 2020, "month": 7, "carrier": "AA", "carrier_name": "Alpha", "airport": "XXX",
        "airport_name": "X Hub", "arr_flights": 10.0, "arr_del15": 2.0, "carrier_ct": 1.0, "weather_ct": 0.0,
        "nas_ct": 1.0, "security_ct": 0.0, "late_aircraft_ct": 0.0, "arr_cancelled": 1.0, "arr_diverted": 0.0,
    }
    return tuple({**row, **given}[f.name] for f in RAW_SCHEMA)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), RAW_SCHEMA)


def test_rows_without_activity_are_dropped(spark):
    raw = frame(
        spark, raw_row(arr_del15=None), raw_row(arr_flights=None), raw_row(arr_flights=0.0), raw_row()
    )
    assert cleaning.clean(raw).count() == 1
    audit = cleaning.clean_audit(raw).first()
    assert (audit["raw_rows"], audit["dropped_missing"], audit["dropped_zero_flights"], audit["clean_rows"]) == (
        4, 2, 1, 1,
    )
    assert audit["dropped_missing_pct"] == 50.0


def test_audit_of_nothing(spark):
    audit = cleaning.clean_audit(frame(spark)).first()
    assert audit["raw_rows"] == 0 and audit["dropped_missing_pct"] == 0.0


def test_rates_are_clipped_and_missing_measures_stay_missing(spark):
    cleaned = cleaning.clean(frame(spark, raw_row(arr_flights=10.0, arr_del15=12.0, arr_cancelled=None, arr_diverted=30.0)))
    row = features.add_row_features(cleaned).first()
    assert row["delay_rate"] == 1.0
    assert row["cancellation_rate"] is None
    assert row["diversion_rate"] == 1.0


@pytest.mark.parametrize(
    ("causes", "shares"),
    [
        ((0.0, 0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0, 0.0)),
        ((None, None, None, None, None), (0.0, 0.0, 0.0, 0.0, 0.0)),
        ((None, 1.0, 1.0, 2.0, 0.0), (0.0, 0.25, 0.25, 0.5, 0.0)),
    ],
)
def test_cause_shares(spark, causes, shares):
    names = ("carrier_ct", "weather_ct", "nas_ct", "security_ct", "late_aircraft_ct")
    cleaned = cleaning.clean(frame(spark, raw_row(**dict(zip(names, causes)))))
    row = features.primary_cause(features.add_row_features(cleaned)).first()
    assert tuple(row[f"{n}_share"] for n in names) == shares
    assert row["primary_cause"] == (None if sum(shares) == 0 else "security_ct")


def test_features_have_the_contract_columns(spark):
    cleaned = cleaning.clean(frame(spark, raw_row(), raw_row(month=1, arr_del15=8.0)))
    out = features.add_features(cleaned)
    assert tuple(out.columns) == CLEAN_COLUMNS
    rows = {r["month"]: r for r in out.collect()}
    assert (rows[7]["is_summer"], rows[7]["is_winter_holiday"], rows[7]["years_since_2013"]) == (1, 0, 7)
    assert (rows[1]["is_summer"], rows[1]["is_winter_holiday"]) == (0, 1)
    assert rows[7]["airport_avg_delay_rate"] == pytest.approx(0.5)


def test_asof_averages_look_only_back(spark):
    cleaned = cleaning.clean(
        frame(spark, raw_row(year=2019, month=12, arr_del15=1.0), raw_row(year=2020, month=1, arr_del15=3.0),
              raw_row(year=2020, month=1, carrier="BB", arr_del15=9.0), raw_row(year=2020, month=2))
    )
    rows = {(r["year"], r["month"], r["carrier"]): r for r in features.add_features(cleaned, "asof").collect()}
    assert rows[2019, 12, "AA"]["airport_avg_delay_rate"] is None
    assert rows[2020, 1, "BB"]["airport_avg_delay_rate"] == pytest.approx(0.1)
    assert rows[2020, 1, "BB"]["carrier_avg_delay_rate"] is None
    assert rows[2020, 2, "AA"]["airport_avg_delay_rate"] == pytest.approx((0.1 + 0.3 + 0.9) / 3)
    with pytest.raises(ValueError):
        features.add_features(cleaned, "later")


def test_group_values_without_broadcasting(spark):
    # a third of the rows has one key, and some have none
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, None)
        .otherwise((F.col("id") % 700).cast("string")).alias("k"),
        F.col("id").cast("double").alias("v"),
    )
    groups = rows.filter("k IS NOT NULL").groupBy("k").agg(F.avg("v").alias("m"))
    small = sorted(attach_group_values(rows, groups, ["k"]).fillna("", ["k"]).collect(), key=str)
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name in names:
            spark.conf.set(name, "-1")
        joined = attach_group_values(rows, groups, ["k"])
        large = sorted(joined.fillna("", ["k"]).collect(), key=str)
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert len(small) == 3000 and small == large


def test_window_and_join_averages_agree(spark):
    cleaned = cleaning.clean(frame(spark, *(raw_row(month=m, arr_del15=float(m)) for m in range(1, 9))))
    keys = ["month", "airport_avg_delay_rate", "carrier_avg_delay_rate"]
    joined = features.add_group_averages(cleaned).select(*keys).orderBy("month").collect()
    windowed = features.add_group_averages_by_window(cleaned).select(*keys).orderBy("month").collect()
    assert [tuple(round(x, 12) for x in r) for r in joined] == [tuple(round(x, 12) for x in r) for r in windowed]
