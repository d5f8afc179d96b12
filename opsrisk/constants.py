"""Thresholds, labels and word lists the results depend on."""

# --- fixed values -----------------------------------------------------------

BASE_YEAR = 2013
SUMMER_MONTHS = (6, 7, 8)
WINTER_HOLIDAY_MONTHS = (12, 1)
PEAK_MONTHS = (6, 7, 8, 12)
MONTH_LABELS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
ANNOTATED_YEAR = 2020

CAUSES = ("carrier_ct", "weather_ct", "nas_ct", "security_ct", "late_aircraft_ct")
CAUSE_LABELS = {
    "carrier_ct_share": "Carrier",
    "weather_ct_share": "Weather",
    "nas_ct_share": "NAS / ATC",
    "security_ct_share": "Security",
    "late_aircraft_ct_share": "Late Aircraft",
}

HISTOGRAM_BINS = 60
MIN_CARRIER_ROWS = 100
TOP_CARRIERS = 10

DELAY_LABEL_THRESHOLD = 0.20
HIGH_RISK_PROBABILITY = 0.65
BAR_PROBABILITY = 0.5
CAPACITY_LIMIT = 45_000
RECENT_ROWS = 20
MODEL_VERSION = "v1"

LEAK_COLUMNS = (
    "arr_del15", "delay_rate", "cancellation_rate", "diversion_rate",
    "carrier_ct_share", "weather_ct_share", "nas_ct_share", "security_ct_share", "late_aircraft_ct_share",
)
MODEL_FEATURES = (
    "year", "month", "arr_flights", "is_summer", "is_winter_holiday", "years_since_2013",
    "airport_avg_delay_rate", "carrier_avg_delay_rate",
)

STATUS_RISK = "disruption_risk"
STATUS_NOMINAL = "nominal"
BADGE_RISK = "High Risk"
BADGE_NOMINAL = "Nominal"

DEFAULT_FLIGHTS = 250.0
DEFAULT_AIRPORT_RATE = 0.183
DEFAULT_CARRIER_RATE = 0.165

TREND_LOOKBACK = 90
HOLDOUT_DAYS = 90
FOOTFALL_FLOOR = 5_000
WEEKDAY_EFFECT = (-600, -1400, -900, 300, 2100, 900, 1700)  # Monday first
SUMMER_EFFECT = 3_500
YEAR_END_EFFECT = 4_200
YEAR_END_FIRST_DAY = 15
NOISE_SD = 500.0
FORECAST_DAYS = 30
MAX_FORECAST_DAYS = 365
INTERVAL_WIDTH = 0.95
CHANGEPOINT_PRIOR = 0.05
SEASONALITY_PRIOR = 10.0

# text the CSV reader takes for a missing value
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# camelCase names on the public surface, snake_case inside
REQUEST_NAMES = {
    "year": "year",
    "month": "month",
    "arrFlights": "arr_flights",
    "isSummer": "is_summer",
    "isWinterHoliday": "is_winter_holiday",
    "yearsSince2013": "years_since_2013",
    "airportAvgDelayRate": "airport_avg_delay_rate",
    "carrierAvgDelayRate": "carrier_avg_delay_rate",
}
RESPONSE_NAMES = {
    "high_delay_prediction": "highDelayPrediction",
    "high_delay_probability": "highDelayProbability",
    "status": "status",
    "model_version": "modelVersion",
    "created_at": "predictedAt",
    "id": "historyId",
}

# --- fixed values: texts of the alerts, filled by functions.display ----------------
CAPACITY_TEXT = "HIGH TRAFFIC ALERT: {day} forecast {footfall} passengers (exceeds {limit} capacity threshold)"
RISK_SCAN_TEXT = (
    "{count} high-risk delay predictions detected in the last {hours} hours "
    "(probability >= {percent}%). Immediate review recommended."
)
MONITORING_TEXT = (
    "AUTOMATED ALERT — Continuous monitoring detected HIGH DELAY RISK for {month}/{year}: "
    "probability={percent}%. Consider proactive gate reallocation."
)
