"""Explicit schemas of every table; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

from opsrisk.constants import CAUSES


RAW_SCHEMA = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in ("year", "month")]
    + [T.StructField(n, T.StringType()) for n in ("carrier", "carrier_name", "airport", "airport_name")]
    + [
        T.StructField(n, T.DoubleType())
        for n in ("arr_flights", "arr_del15", *CAUSES, "arr_cancelled", "arr_diverted")
    ]
)

CLEAN_COLUMNS = (
    "year", "month", "carrier", "carrier_name", "airport", "airport_name",
    "arr_flights", "arr_del15", "delay_rate",
    "carrier_ct_share", "weather_ct_share", "nas_ct_share", "security_ct_share", "late_aircraft_ct_share",
    "is_summer", "is_winter_holiday", "years_since_2013",
    "airport_avg_delay_rate", "carrier_avg_delay_rate",
    "cancellation_rate", "diversion_rate",
)
_CLEAN_INTEGERS = {"year", "month", "is_summer", "is_winter_holiday", "years_since_2013"}
_CLEAN_STRINGS = {"carrier", "carrier_name", "airport", "airport_name"}
CLEAN_SCHEMA = T.StructType(
    [
        T.StructField(
            n,
            T.IntegerType() if n in _CLEAN_INTEGERS
            else T.StringType() if n in _CLEAN_STRINGS
            else T.DoubleType(),
        )
        for n in CLEAN_COLUMNS
    ]
)

TRAFFIC_CSV_SCHEMA = T.StructType(
    [T.StructField("date", T.StringType()), T.StructField("passenger_footfall", T.LongType())]
)

REQUEST_FIELDS = (
    "year", "month", "arr_flights", "is_summer", "is_winter_holiday", "years_since_2013",
    "airport_avg_delay_rate", "carrier_avg_delay_rate",
)
REQUEST_SCHEMA = T.StructType([T.StructField(n, T.DoubleType()) for n in REQUEST_FIELDS])

HISTORY_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("flight_month", T.IntegerType()),
        T.StructField("flight_year", T.IntegerType()),
        T.StructField("arr_flights", T.DoubleType()),
        T.StructField("is_summer", T.DoubleType()),
        T.StructField("is_winter_holiday", T.DoubleType()),
        T.StructField("years_since_2013", T.DoubleType()),
        T.StructField("airport_avg_delay_rate", T.DoubleType()),
        T.StructField("carrier_avg_delay_rate", T.DoubleType()),
        T.StructField("high_delay_prediction", T.IntegerType()),
        T.StructField("high_delay_probability", T.DoubleType()),
        T.StructField("status", T.StringType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

META_SCHEMA = T.StructType(
    [
        T.StructField("series_key", T.StringType()),
        T.StructField("mae", T.DoubleType()),
        T.StructField("mape_pct", T.DoubleType()),
        T.StructField("train_rows", T.LongType()),
        T.StructField("holdout_days", T.IntegerType()),
        T.StructField("date_min", T.DateType()),
        T.StructField("date_max", T.DateType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("trained_on", T.DateType()),
    ]
)

ALERT_SCHEMA = T.StructType(
    [
        T.StructField("alert_type", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("ref_id", T.StringType()),
    ]
)
ALERT_COLUMNS = tuple(ALERT_SCHEMA.names)

# --- fixed values: thirty monthly scenarios that fill an empty history --------
# year, month, flights, summer, winter holiday, years since 2013, airport rate, carrier rate
SEED_ROWS = (
    (2024.0, 1.0, 180.0, 0.0, 1.0, 11.0, 0.210, 0.195),
    (2024.0, 2.0, 165.0, 0.0, 0.0, 11.0, 0.185, 0.172),
    (2024.0, 3.0, 210.0, 0.0, 0.0, 11.0, 0.192, 0.180),
    (2024.0, 4.0, 225.0, 0.0, 0.0, 11.0, 0.188, 0.175),
    (2024.0, 5.0, 240.0, 0.0, 0.0, 11.0, 0.195, 0.182),
    (2024.0, 6.0, 310.0, 1.0, 0.0, 11.0, 0.245, 0.228),
    (2024.0, 7.0, 340.0, 1.0, 0.0, 11.0, 0.268, 0.251),
    (2024.0, 8.0, 325.0, 1.0, 0.0, 11.0, 0.255, 0.239),
    (2024.0, 9.0, 285.0, 0.0, 0.0, 11.0, 0.218, 0.204),
    (2024.0, 10.0, 270.0, 0.0, 0.0, 11.0, 0.205, 0.191),
    (2024.0, 11.0, 295.0, 0.0, 0.0, 11.0, 0.222, 0.208),
    (2024.0, 12.0, 350.0, 0.0, 1.0, 11.0, 0.278, 0.261),
    (2025.0, 1.0, 195.0, 0.0, 1.0, 12.0, 0.215, 0.199),
    (2025.0, 2.0, 178.0, 0.0, 0.0, 12.0, 0.188, 0.175),
    (2025.0, 3.0, 220.0, 0.0, 0.0, 12.0, 0.196, 0.183),
    (2025.0, 4.0, 235.0, 0.0, 0.0, 12.0, 0.191, 0.178),
    (2025.0, 5.0, 255.0, 0.0, 0.0, 12.0, 0.198, 0.185),
    (2025.0, 6.0, 320.0, 1.0, 0.0, 12.0, 0.251, 0.235),
    (2025.0, 7.0, 355.0, 1.0, 0.0, 12.0, 0.272, 0.255),
    (2025.0, 8.0, 338.0, 1.0, 0.0, 12.0, 0.261, 0.244),
    (2025.0, 9.0, 292.0, 0.0, 0.0, 12.0, 0.221, 0.207),
    (2025.0, 10.0, 278.0, 0.0, 0.0, 12.0, 0.208, 0.194),
    (2025.0, 11.0, 305.0, 0.0, 0.0, 12.0, 0.228, 0.213),
    (2025.0, 12.0, 362.0, 0.0, 1.0, 12.0, 0.282, 0.264),
    (2026.0, 1.0, 201.0, 0.0, 1.0, 13.0, 0.218, 0.202),
    (2026.0, 2.0, 182.0, 0.0, 0.0, 13.0, 0.191, 0.178),
    (2026.0, 3.0, 228.0, 0.0, 0.0, 13.0, 0.199, 0.186),
    (2026.0, 4.0, 242.0, 0.0, 0.0, 13.0, 0.194, 0.181),
    (2026.0, 5.0, 261.0, 0.0, 0.0, 13.0, 0.201, 0.188),
    (2026.0, 6.0, 328.0, 1.0, 0.0, 13.0, 0.255, 0.239),
)
