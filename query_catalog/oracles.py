"""SQL oracles, written for DuckDB independently of the Spark code.

Each text starts from the driver's views. Shared inputs are common table
expressions that are put in front of the query that names them; a text that
starts with a comma adds further ones of its own.
"""

from __future__ import annotations

from opsrisk.schemas import SEED_ROWS

SHARED: dict[str, str] = {}
ORACLES: dict[str, str] = {}
# which shared inputs an input itself needs
NEEDS: dict[str, list[str]] = {}


def shared(name: str, text: str, needs: list[str] | None = None) -> None:
    SHARED[name] = text
    NEEDS[name] = needs or []


def _expand_rounding(text: str) -> str:
    """Write out r6(x): six digits, after a finer rounding that absorbs summation order."""
    while (start := text.find("r6(")) >= 0:
        end, depth = start + 3, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        text = f"{text[:start]}round(round({text[start + 3:end - 1]}, 10), 6){text[end:]}"
    return text


def oracle(key: str, text: str, needs: list[str] | None = None) -> None:
    order: list[str] = []

    def visit(name: str) -> None:
        for n in NEEDS[name]:
            visit(n)
        if name not in order:
            order.append(name)

    for n in needs or []:
        visit(n)
    head = ",\n".join(f"{n} AS ({SHARED[n]})" for n in order)
    text = text.strip()
    if head:
        text = f"WITH {head}\n{text}"
    elif text.startswith(","):
        text = f"WITH {text[1:]}"
    ORACLES[key] = _expand_rounding(text)


# --- inputs -------------------------------------------------------------------

shared("monthly_raw", """
  SELECT CAST(year(l_shipdate) + 19 AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
         p_brand AS carrier, 'Carrier ' || p_brand AS carrier_name,
         r_name AS airport, r_name || ' Hub' AS airport_name,
         CAST(CASE WHEN count(*) FILTER (l_linestatus = 'F') > 0
              THEN count(*) FILTER (l_linestatus = 'F' AND l_tax > 0) END AS DOUBLE) AS arr_flights,
         CAST(CASE WHEN count(*) FILTER (l_linestatus = 'F') > 0
              THEN count(*) FILTER (l_linestatus = 'F' AND l_quantity > 40) END AS DOUBLE) AS arr_del15,
         CAST(nullif(count(*) FILTER (l_linestatus = 'F' AND l_quantity > 40 AND l_linenumber IN (1, 2)), 0) AS DOUBLE) AS carrier_ct,
         CAST(nullif(count(*) FILTER (l_linestatus = 'F' AND l_quantity > 40 AND l_linenumber = 3), 0) AS DOUBLE) AS weather_ct,
         CAST(nullif(count(*) FILTER (l_linestatus = 'F' AND l_quantity > 40 AND l_linenumber IN (4, 5)), 0) AS DOUBLE) AS nas_ct,
         CAST(nullif(count(*) FILTER (l_linestatus = 'F' AND l_quantity > 40 AND l_linenumber = 6), 0) AS DOUBLE) AS security_ct,
         CAST(nullif(count(*) FILTER (l_linestatus = 'F' AND l_quantity > 40 AND l_linenumber = 7), 0) AS DOUBLE) AS late_aircraft_ct,
         CAST(CASE WHEN count(*) FILTER (l_linestatus = 'F' AND l_returnflag = 'R') > 0
              THEN count(*) FILTER (l_linestatus = 'F' AND l_returnflag = 'R' AND l_discount >= 0.09::DOUBLE) END AS DOUBLE) AS arr_cancelled,
         CAST(CASE WHEN count(*) FILTER (l_linestatus = 'F' AND l_returnflag = 'A') > 0
              THEN count(*) FILTER (l_linestatus = 'F' AND l_returnflag = 'A' AND l_tax >= 0.08::DOUBLE) END AS DOUBLE) AS arr_diverted
  FROM lineitem, part, supplier, nation, region
  WHERE l_partkey = p_partkey AND l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey
  GROUP BY ALL""")

shared("clean", """
  SELECT *, CASE WHEN arr_del15 > arr_flights THEN 1.0::DOUBLE ELSE arr_del15 / arr_flights END AS delay_rate
  FROM monthly_raw WHERE arr_flights IS NOT NULL AND arr_del15 IS NOT NULL AND arr_flights > 0""",
       ["monthly_raw"])

_CAUSES = ["carrier_ct", "weather_ct", "nas_ct", "security_ct", "late_aircraft_ct"]
_TOTAL = "(" + " + ".join(f"coalesce({c}, 0)" for c in _CAUSES) + ")"
_SHARES = ",\n         ".join(
    f"coalesce({c} / nullif({_TOTAL}, 0), 0)::DOUBLE AS {c}_share" for c in _CAUSES
)

shared("row_features", f"""
  SELECT year, month, carrier, carrier_name, airport, airport_name, arr_flights, arr_del15, delay_rate,
         {_SHARES},
         CASE WHEN month BETWEEN 6 AND 8 THEN 1 ELSE 0 END::INTEGER AS is_summer,
         CASE WHEN month = 12 OR month = 1 THEN 1 ELSE 0 END::INTEGER AS is_winter_holiday,
         (year - 2013)::INTEGER AS years_since_2013,
         CASE WHEN arr_cancelled > arr_flights THEN 1.0::DOUBLE ELSE arr_cancelled / arr_flights END AS cancellation_rate,
         CASE WHEN arr_diverted > arr_flights THEN 1.0::DOUBLE ELSE arr_diverted / arr_flights END AS diversion_rate
  FROM clean""", ["clean"])

shared("features", """
  SELECT *, avg(delay_rate) OVER (PARTITION BY airport) AS airport_avg_delay_rate,
         avg(delay_rate) OVER (PARTITION BY carrier) AS carrier_avg_delay_rate
  FROM row_features""", ["row_features"])

_FEATURE_OUT = """year, month, carrier, carrier_name, airport, airport_name, arr_flights, arr_del15,
  r6(delay_rate) AS delay_rate, r6(carrier_ct_share) AS carrier_ct_share,
  r6(weather_ct_share) AS weather_ct_share, r6(nas_ct_share) AS nas_ct_share,
  r6(security_ct_share) AS security_ct_share, r6(late_aircraft_ct_share) AS late_aircraft_ct_share,
  is_summer, is_winter_holiday, years_since_2013,
  r6(airport_avg_delay_rate) AS airport_avg_delay_rate,
  r6(carrier_avg_delay_rate) AS carrier_avg_delay_rate,
  r6(cancellation_rate) AS cancellation_rate, r6(diversion_rate) AS diversion_rate"""

_MONTHS = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"

# --- cleaning and features -------------------------------------------------------

oracle("clean_monthly", """
SELECT year, month, carrier, carrier_name, airport, airport_name, arr_flights, arr_del15,
       carrier_ct, weather_ct, nas_ct, security_ct, late_aircraft_ct, arr_cancelled, arr_diverted,
       r6(delay_rate) AS delay_rate FROM clean""", ["clean"])

oracle("clean_audit", """
SELECT count(*) AS raw_rows,
       count(*) FILTER (arr_flights IS NULL OR arr_del15 IS NULL) AS dropped_missing,
       count(*) FILTER (arr_flights <= 0 AND arr_del15 IS NOT NULL) AS dropped_zero_flights,
       count(*) FILTER (arr_flights > 0 AND arr_del15 / nullif(arr_flights, 0) > 1) AS clipped_rates,
       count(*) FILTER (arr_flights > 0 AND arr_del15 IS NOT NULL) AS clean_rows,
       round(100.0::DOUBLE * count(*) FILTER (arr_flights IS NULL OR arr_del15 IS NULL) / count(*), 2) AS dropped_missing_pct
FROM monthly_raw""", ["monthly_raw"])

oracle("clean_sample", """
SELECT year, month, carrier, airport, arr_flights, arr_del15, r6(delay_rate) AS delay_rate
FROM clean ORDER BY year, month, carrier, airport LIMIT 3""", ["clean"])

oracle("features_monthly", f"SELECT {_FEATURE_OUT} FROM features", ["features"])
oracle("features_window", f"SELECT {_FEATURE_OUT} FROM features", ["features"])

oracle("features_asof", f"""
, prior_means AS (
  SELECT r.*,
         (SELECT avg(p.delay_rate) FROM row_features p WHERE p.airport = r.airport
            AND p.year * 12 + p.month < r.year * 12 + r.month) AS airport_avg_delay_rate,
         (SELECT avg(p.delay_rate) FROM row_features p WHERE p.carrier = r.carrier
            AND p.year * 12 + p.month < r.year * 12 + r.month) AS carrier_avg_delay_rate
  FROM row_features r)
SELECT {_FEATURE_OUT} FROM prior_means""", ["row_features"])

oracle("primary_cause", """
SELECT year, month, carrier, airport,
       CASE greatest(carrier_ct_share, weather_ct_share, nas_ct_share, security_ct_share, late_aircraft_ct_share)
         WHEN 0 THEN NULL WHEN carrier_ct_share THEN 'carrier_ct' WHEN weather_ct_share THEN 'weather_ct'
         WHEN nas_ct_share THEN 'nas_ct' WHEN security_ct_share THEN 'security_ct' ELSE 'late_aircraft_ct' END AS primary_cause
FROM row_features""", ["row_features"])

# --- exploratory aggregates --------------------------------------------------------

oracle("delay_profile", """
SELECT count(*) AS row_count, count(DISTINCT carrier) AS carriers, count(DISTINCT airport) AS airports,
       min(year) AS first_year, max(year) AS last_year, r6(avg(delay_rate)) AS mean_delay_rate
FROM clean""", ["clean"])

oracle("delay_describe", """
, d AS (SELECT count(delay_rate)::DOUBLE AS c, avg(delay_rate) AS a, stddev_samp(delay_rate) AS s, min(delay_rate) AS lo,
         max(delay_rate) AS hi, quantile_cont(delay_rate, [0.25, 0.5, 0.75]) AS q FROM clean)
SELECT statistic, r6(value) AS value FROM (
  SELECT 'count' AS statistic, c AS value FROM d UNION ALL SELECT 'mean', a FROM d UNION ALL SELECT 'std', s FROM d
  UNION ALL SELECT 'min', lo FROM d UNION ALL SELECT 'max', hi FROM d
  UNION ALL SELECT '25%', q[1] FROM d UNION ALL SELECT '50%', q[2] FROM d UNION ALL SELECT '75%', q[3] FROM d)""", ["clean"])

oracle("delay_histogram", """
, ends AS (SELECT min(delay_rate) AS lo, max(delay_rate) AS hi, (max(delay_rate) - min(delay_rate)) / 60 AS w FROM clean),
edges AS (SELECT i::INTEGER AS bin, lo + i * w AS e0, lo + (i + 1) * w AS e1 FROM ends, range(60) t(i))
SELECT bin, r6(e0) AS bin_start, r6(e1) AS bin_end,
       (SELECT count(*) FROM clean WHERE delay_rate >= e0 AND (delay_rate < e1 OR bin = 59)) AS n
FROM edges""", ["clean"])

oracle("delay_by_month", f"""
SELECT month, {_MONTHS}[month] AS month_label, r6(avg(delay_rate)) AS mean_rate,
       r6(stddev_samp(delay_rate)) AS std_rate, month IN (6, 7, 8, 12) AS is_peak
FROM clean GROUP BY month""", ["clean"])

oracle("delay_by_carrier", """
, s AS (SELECT carrier, carrier_name, avg(delay_rate) AS m, count(delay_rate) AS n FROM clean
        GROUP BY ALL HAVING count(delay_rate) >= 100)
SELECT carrier, carrier_name, r6(m) AS mean_rate, n, m > (SELECT avg(m) FROM s) AS above_average,
       (SELECT r6(avg(delay_rate)) FROM clean) AS overall_mean FROM s""", ["clean"])

oracle("delay_by_year", """
SELECT year, r6(avg(delay_rate)) AS mean_rate, r6(stddev_samp(delay_rate)) AS std_rate, count(delay_rate) AS n,
       r6(avg(delay_rate) - stddev_samp(delay_rate)) AS lower, r6(avg(delay_rate) + stddev_samp(delay_rate)) AS upper,
       year = 2020 AS annotated FROM clean GROUP BY year""", ["clean"])

oracle("delay_causes", """
, m AS (SELECT 'Carrier' AS cause, avg(carrier_ct_share) AS v FROM row_features UNION ALL
        SELECT 'Weather', avg(weather_ct_share) FROM row_features UNION ALL
        SELECT 'NAS / ATC', avg(nas_ct_share) FROM row_features UNION ALL
        SELECT 'Security', avg(security_ct_share) FROM row_features UNION ALL
        SELECT 'Late Aircraft', avg(late_aircraft_ct_share) FROM row_features)
SELECT cause, r6(v) AS mean_share, r6(100 * v / sum(v) OVER ()) AS composition_pct,
       row_number() OVER (ORDER BY v DESC, cause)::INTEGER AS rank FROM m""", ["row_features"])

oracle("top_carriers", """
SELECT carrier_name, count(delay_rate) AS n FROM clean GROUP BY carrier_name ORDER BY n DESC, carrier_name LIMIT 10""",
       ["clean"])

oracle("top_carrier_rows", """
SELECT year, month, carrier_name, airport, r6(delay_rate) AS delay_rate FROM clean
WHERE carrier_name IN (SELECT carrier_name FROM clean GROUP BY carrier_name ORDER BY count(delay_rate) DESC, carrier_name LIMIT 10)""",
       ["clean"])

_HEAT = ",\n       ".join(
    f"r6(avg(CASE WHEN month = {i} THEN delay_rate END)) AS {m}"
    for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1)
)
oracle("delay_heatmap", f"""
SELECT carrier_name,
       {_HEAT}
FROM clean
WHERE carrier_name IN (SELECT carrier_name FROM clean GROUP BY carrier_name ORDER BY count(delay_rate) DESC, carrier_name LIMIT 10)
GROUP BY carrier_name""", ["clean"])

oracle("delay_extremes", f"""
, m AS (SELECT month, round(avg(delay_rate), 12) AS v FROM clean GROUP BY month),
c AS (SELECT carrier_name, round(avg(delay_rate), 12) AS v FROM clean GROUP BY carrier_name)
SELECT 'month' AS dimension, (SELECT {_MONTHS}[month] FROM m ORDER BY v DESC, month LIMIT 1) AS highest,
       (SELECT r6(max(v)) FROM m) AS highest_mean,
       (SELECT {_MONTHS}[month] FROM m ORDER BY v, month LIMIT 1) AS lowest, (SELECT r6(min(v)) FROM m) AS lowest_mean
UNION ALL
SELECT 'carrier', (SELECT carrier_name FROM c ORDER BY v DESC, carrier_name LIMIT 1), (SELECT r6(max(v)) FROM c),
       (SELECT carrier_name FROM c ORDER BY v, carrier_name LIMIT 1), (SELECT r6(min(v)) FROM c)""", ["clean"])

# --- learning sets and quality measures ---------------------------------------------

oracle("delay_labels", """
SELECT year, month, carrier, airport, r6(delay_rate) AS delay_rate, (delay_rate > 0.20::DOUBLE)::INTEGER AS high_delay
FROM clean""", ["clean"])

oracle("model_matrix", """
SELECT year, month, arr_flights, is_summer, is_winter_holiday, years_since_2013,
       r6(airport_avg_delay_rate) AS airport_avg_delay_rate, r6(carrier_avg_delay_rate) AS carrier_avg_delay_rate
FROM features""", ["features"])

oracle("stratified_split", """
SELECT year, month, carrier, airport, (delay_rate > 0.20::DOUBLE)::INTEGER AS high_delay,
       substr(md5(concat_ws('|', carrier, airport, year, month, '42')), 1, 8) < 'cccccccc' AS is_train
FROM clean""", ["clean"])

oracle("exact_split", """
, l AS (SELECT *, (delay_rate > 0.20::DOUBLE)::INTEGER AS high_delay,
        md5(concat_ws('|', carrier, airport, year, month, '42')) AS digest FROM clean),
q AS (SELECT *, row_number() OVER (PARTITION BY high_delay ORDER BY digest) AS place FROM l),
t AS (SELECT count(*) AS n, ceil(count(*) * 0.2::DOUBLE) AS tests, sum(high_delay) AS pos FROM l),
f AS (SELECT *, floor(pos * tests / n) AS p0, floor((n - pos) * tests / n) AS n0, pos * tests / n % 1 >= (n - pos) * tests / n % 1 AS up FROM t),
g AS (SELECT p0 + CASE WHEN up THEN tests - p0 - n0 ELSE 0 END AS pq, n0 + CASE WHEN up THEN 0 ELSE tests - p0 - n0 END AS nq FROM f)
SELECT year, month, carrier, airport, high_delay, place > CASE high_delay WHEN 1 THEN pq ELSE nq END AS is_train FROM q, g""",
       ["clean"])

shared("scored", """
  SELECT (event_type = 'error')::INTEGER AS y, round(least(value / 500, 1), 4) AS s,
         (round(least(value / 500, 1), 4) >= 0.1::DOUBLE)::INTEGER AS p FROM events""")

oracle("classification_report", """
, k AS (SELECT c, count(*) FILTER (y = c AND p = c) AS tp, count(*) FILTER (p = c) AS np, count(*) FILTER (y = c) AS ny,
               count(*) AS n FROM scored, (VALUES (0), (1)) t(c) GROUP BY c),
r AS (SELECT c, n, ny, coalesce(tp / nullif(np, 0)::DOUBLE, 0) AS pr, coalesce(tp / nullif(ny, 0)::DOUBLE, 0) AS re,
             coalesce(2 * tp / nullif(np + ny, 0)::DOUBLE, 0) AS f, tp FROM k)
SELECT c::VARCHAR AS row_label, r6(pr) AS "precision", r6(re) AS recall, r6(f) AS f1_score, ny AS support FROM r
UNION ALL SELECT 'accuracy', r6(sum(tp)::DOUBLE / max(n)), r6(sum(tp)::DOUBLE / max(n)), r6(sum(tp)::DOUBLE / max(n)), max(n) FROM r
UNION ALL SELECT 'macro avg', r6(avg(pr)), r6(avg(re)), r6(avg(f)), max(n) FROM r
UNION ALL SELECT 'weighted avg', r6(sum(pr * ny) / max(n)), r6(sum(re * ny) / max(n)), r6(sum(f * ny) / max(n)), max(n) FROM r""",
       ["scored"])

_AUC = """
, ranked AS (SELECT y, rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2.0::DOUBLE AS r FROM {t})
SELECT r6((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE)
       / (count(*) FILTER (y = 1)::DOUBLE * count(*) FILTER (y = 0))) AS roc_auc FROM ranked"""
oracle("roc_auc", _AUC.format(s="s", t="scored"), ["scored"])
_MARGINS = "(SELECT (event_type = 'error')::INTEGER AS y, (value - 40) * (value - 40) * (value - 40) / 7 AS s FROM events)"
oracle("roc_auc_margins", _AUC.format(s="s", t=_MARGINS), ["scored"])

# --- requests -----------------------------------------------------------------------

shared("requests", """
  SELECT event_id AS request_id, (2010 + user_id % 25)::DOUBLE AS year, (event_id % 14)::DOUBLE AS month,
         floor(value)::DOUBLE AS arr_flights,
         CASE WHEN event_id % 14 IN (6, 7, 8) THEN 1 ELSE 0 END AS is_summer,
         CASE WHEN event_id % 14 IN (1, 12) THEN 1 ELSE 0 END AS is_winter_holiday,
         (user_id % 25 - 3)::DOUBLE AS years_since_2013, value / 100 AS airport_avg_delay_rate,
         CASE WHEN event_type = 'error' THEN NULL ELSE 0.165 END AS carrier_avg_delay_rate
  FROM events""")

shared("broken", """
  SELECT request_id, 1 AS pos, 'year must be >= 2013' AS message FROM requests WHERE year < 2013
  UNION ALL SELECT request_id, 2, 'year must be <= 2030' FROM requests WHERE year > 2030
  UNION ALL SELECT request_id, 3, 'month must be between 1 and 12' FROM requests WHERE month NOT BETWEEN 1 AND 12
  UNION ALL SELECT request_id, 4, 'arr_flights must be >= 1' FROM requests WHERE arr_flights < 1
  UNION ALL SELECT request_id, 5, 'must be greater than or equal to 0' FROM requests WHERE years_since_2013 < 0
  UNION ALL SELECT request_id, 6, 'must be less than or equal to 1.0' FROM requests WHERE airport_avg_delay_rate > 1
  UNION ALL SELECT request_id, 7, 'carrier_avg_delay_rate is required' FROM requests WHERE carrier_avg_delay_rate IS NULL""",
       ["requests"])

oracle("validate_requests", """
, m AS (SELECT request_id, string_agg(message, ', ' ORDER BY pos) AS message FROM broken GROUP BY request_id)
SELECT r.request_id, m.message IS NULL AS is_valid, coalesce(m.message, '') AS message
FROM requests r LEFT JOIN m ON m.request_id = r.request_id""", ["broken"])

oracle("validation_report", "SELECT message, count(*) AS n FROM broken GROUP BY message", ["broken"])

oracle("quarantined_requests", """
, m AS (SELECT request_id, string_agg(message, ', ' ORDER BY pos) AS message FROM broken GROUP BY request_id)
SELECT r.request_id, year, month, arr_flights, m.message FROM requests r JOIN m ON m.request_id = r.request_id""",
       ["broken"])

oracle("scoring_outcome", """
, m AS (SELECT request_id, string_agg(message, ', ' ORDER BY pos) AS message FROM broken GROUP BY request_id)
SELECT r.request_id, m.message IS NULL AS accepted, m.message FROM requests r LEFT JOIN m ON m.request_id = r.request_id""",
       ["broken"])

oracle("derived_requests", """
, g AS (SELECT *, (year(ts) - user_id % 9)::DOUBLE AS y, (1 + event_id % 12)::DOUBLE AS m FROM events)
SELECT event_id AS request_id, y AS year, m AS month,
       CASE WHEN event_type = 'view' THEN 250 ELSE floor(value) + 1 END::DOUBLE AS arr_flights,
       CASE WHEN event_type = 'signup' OR m IN (6, 7, 8) THEN 1 ELSE 0 END::DOUBLE AS is_summer,
       CASE WHEN event_type = 'purchase' OR m IN (12, 1) THEN 1 ELSE 0 END::DOUBLE AS is_winter_holiday,
       CASE WHEN event_type = 'click' THEN 3 ELSE y - 2013 END::DOUBLE AS years_since_2013,
       CASE WHEN event_type = 'click' THEN 0.183 ELSE 0.25 END::DOUBLE AS airport_avg_delay_rate,
       CASE WHEN event_type = 'error' THEN 0.165 ELSE 0.125 END::DOUBLE AS carrier_avg_delay_rate
FROM g""")

oracle("monitor_requests", """
SELECT DISTINCT ts::DATE AS day, year(ts)::DOUBLE AS year, month(ts)::DOUBLE AS month, 250::DOUBLE AS arr_flights,
       CASE WHEN month(ts) IN (6, 7, 8) THEN 1 ELSE 0 END::DOUBLE AS is_summer,
       CASE WHEN month(ts) IN (12, 1) THEN 1 ELSE 0 END::DOUBLE AS is_winter_holiday,
       (year(ts) - 2013)::DOUBLE AS years_since_2013, 0.183::DOUBLE AS airport_avg_delay_rate,
       0.165::DOUBLE AS carrier_avg_delay_rate FROM events""")

# --- history -----------------------------------------------------------------------

shared("past", """
  SELECT event_id AS id, (p >= 0.5::DOUBLE)::INTEGER AS high_delay_prediction, p AS high_delay_probability,
         CASE WHEN p >= 0.5::DOUBLE THEN 'disruption_risk' ELSE 'nominal' END AS status,
         month(ts)::INTEGER AS flight_month, year(ts)::INTEGER AS flight_year, ts AS created_at
  FROM (SELECT *, round(least(value / 100, 1), 4)::DOUBLE AS p FROM events)""")

_SHOWN = """CASE status WHEN 'disruption_risk' THEN 'High Risk' ELSE 'Nominal' END AS badge,
       ((round(high_delay_probability * 10000)::BIGINT + 5) // 10) / 10.0::DOUBLE AS probability_pct,
       flight_year::VARCHAR || '/' || lpad(flight_month::VARCHAR, 2, '0') AS period,
       high_delay_probability > 0.5::DOUBLE AS bar_high"""

oracle("score_status", """
SELECT high_delay_prediction AS "highDelayPrediction", high_delay_probability AS "highDelayProbability", status,
       'v1' AS "modelVersion", created_at AS "predictedAt", id AS "historyId" FROM past""", ["past"])
oracle("history_recent", f"SELECT *, {_SHOWN} FROM past ORDER BY created_at DESC, id DESC LIMIT 20", ["past"])
oracle("history_alerts", f"SELECT *, {_SHOWN} FROM past WHERE high_delay_prediction = 1 ORDER BY created_at DESC, id DESC",
       ["past"])
oracle("history_between", """SELECT * FROM past
WHERE created_at >= TIMESTAMP '2024-01-10 00:00:00' AND created_at <= TIMESTAMP '2024-01-12 12:00:00'""", ["past"])
oracle("status_counts", "SELECT status, count(*) AS n FROM past GROUP BY status", ["past"])
oracle("dashboard_summary", """
SELECT count(*) AS total_predictions, count(*) FILTER (high_delay_prediction = 1) AS high_risk_count,
       count(*) FILTER (high_delay_prediction = 0) AS nominal_count,
       coalesce(round(100.0::DOUBLE * count(*) FILTER (high_delay_prediction = 1) / nullif(count(*), 0), 2), 0) AS high_risk_percentage,
       count(*) FILTER (high_delay_prediction = 1) AS active_alerts FROM past""", ["past"])

_SEED_VALUES = ", ".join(str(row) for row in SEED_ROWS)
oracle("seed_if_empty", f"""
, seed(year, month, arr_flights, is_summer, is_winter_holiday, years_since_2013, airport_avg_delay_rate, carrier_avg_delay_rate)
  AS (VALUES {_SEED_VALUES})
SELECT year::DOUBLE AS year, month::DOUBLE AS month, arr_flights::DOUBLE AS arr_flights, is_summer::DOUBLE AS is_summer,
       is_winter_holiday::DOUBLE AS is_winter_holiday, years_since_2013::DOUBLE AS years_since_2013,
       airport_avg_delay_rate::DOUBLE AS airport_avg_delay_rate, carrier_avg_delay_rate::DOUBLE AS carrier_avg_delay_rate
FROM seed s WHERE NOT EXISTS (SELECT 1 FROM past WHERE flight_year = s.year AND flight_month = s.month)""", ["past"])

# --- scans and alerts ------------------------------------------------------------------

oracle("risk_scan_24h", """
, w AS (SELECT count(*) AS predictions, count(*) FILTER (high_delay_probability >= 0.65::DOUBLE) AS high_risk FROM past
        WHERE created_at BETWEEN TIMESTAMP '2024-01-14 06:05:00' AND TIMESTAMP '2024-01-15 06:05:00')
SELECT 'risk_scan' AS alert_type, 'Daily Risk Scan: High-Risk Detections' AS subject,
       high_risk || ' high-risk delay predictions detected in the last 24 hours (probability >= 65%). Immediate review recommended.' AS message,
       TIMESTAMP '2024-01-15 06:05:00' AS event_time, '2024-01-15 06:05:00' AS ref_id, predictions, high_risk
FROM w WHERE high_risk > 0""", ["past"])

oracle("monitor_alerts", f"""
, h AS (SELECT *, (round(high_delay_probability * 10000)::BIGINT + 5) // 10 AS tenths FROM past
        WHERE high_delay_probability >= 0.65::DOUBLE)
SELECT 'monitoring' AS alert_type, 'Automated Monitoring Alert' AS subject,
       'AUTOMATED ALERT — Continuous monitoring detected HIGH DELAY RISK for ' || {_MONTHS}[flight_month] || '/' || flight_year
       || ': probability=' || tenths // 10 || '.' || tenths % 10 || '%. Consider proactive gate reallocation.' AS message,
       created_at AS event_time, id::VARCHAR AS ref_id FROM h""", ["past"])

# --- daily series ------------------------------------------------------------------------

shared("daily", """
  SELECT 'ALL' AS series_key, o_orderdate::DATE AS ds,
         (sum(round(o_totalprice * 100)::BIGINT) // (800 * count(*)))::BIGINT AS y FROM orders GROUP BY ALL""")
shared("panel", """
  SELECT c_mktsegment AS series_key, o_orderdate::DATE AS ds,
         (sum(round(o_totalprice * 100)::BIGINT) // (800 * count(*)))::BIGINT AS y
  FROM orders, customer WHERE o_custkey = c_custkey GROUP BY ALL""")
shared("numbered", """
  SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY ds DESC) AS back FROM panel""", ["panel"])
shared("train", "SELECT series_key, ds, y FROM numbered WHERE back > 90", ["numbered"])
shared("held", "SELECT series_key, ds, y FROM numbered WHERE back <= 90", ["numbered"])


def _trend_of(rows: str) -> str:
    return f"""
  SELECT series_key, max(ds) AS last_ds, arg_max(y, ds) AS last_y,
         (arg_max(y, ds) - arg_min(y, ds)) / count(*)::DOUBLE AS slope
  FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY ds DESC) AS b FROM {rows}) WHERE b <= 90
  GROUP BY series_key"""


_DRAW = "(('0x' || substr(md5('42|' || series_key || '|' || d::DATE::VARCHAR), {}, 13))::BIGINT / 4503599627370496::DOUBLE)"
_NOISE = f" + sqrt(-2 * ln(1 - {_DRAW.format(1)})) * cos(2 * pi() * {_DRAW.format(14)}) * 500"


def _carried_on(trend: str, until: str, noise: str = "") -> str:
    return f"""
  SELECT series_key, d::DATE AS ds,
         trunc(greatest(5000, last_y + i * slope + [-600, -1400, -900, 300, 2100, 900, 1700][isodow(d)]
           + CASE WHEN month(d) BETWEEN 6 AND 8 THEN 3500 ELSE 0 END
           + CASE WHEN month(d) = 12 AND day(d) >= 15 THEN 4200 ELSE 0 END{noise}))::BIGINT AS y
  FROM (SELECT *, last_ds + i::INTEGER AS d FROM {trend}, LATERAL (SELECT unnest(range(1, {until} - last_ds + 1)) AS i))"""


shared("trend", _trend_of("panel"), ["panel"])
shared("extended", "SELECT series_key, ds, y FROM panel UNION ALL" + _carried_on("trend", "DATE '2001-12-31'"), ["trend"])
shared("train_trend", _trend_of("train"), ["train"])
shared("guessed", _carried_on(
    "(SELECT t.*, e.until FROM train_trend t JOIN (SELECT series_key, max(ds) AS until FROM held GROUP BY ALL) e USING (series_key))",
    "until"), ["train_trend", "held"])
shared("metrics", """
  SELECT h.series_key, count(*) AS n, avg(abs(h.y - g.y)) AS mae, avg(abs(h.y - g.y) / h.y::DOUBLE) * 100 AS mape_pct
  FROM held h JOIN guessed g ON g.series_key = h.series_key AND g.ds = h.ds GROUP BY h.series_key""", ["guessed"])

oracle("traffic_series", "SELECT * FROM daily", ["daily"])
oracle("traffic_panel", "SELECT * FROM panel", ["panel"])
oracle("traffic_profile", "SELECT series_key, min(ds) AS date_min, max(ds) AS date_max, count(*) AS n FROM panel GROUP BY ALL",
       ["panel"])
oracle("traffic_trend", "SELECT series_key, last_ds, last_y, r6(slope) AS slope FROM trend", ["trend"])
oracle("traffic_extended", "SELECT * FROM extended", ["extended"])
oracle("traffic_extended_noise",
       "SELECT series_key, ds, y FROM panel UNION ALL" + _carried_on("trend", "DATE '2001-12-31'", _NOISE), ["trend"])
oracle("traffic_holdout_split", "SELECT series_key, ds, y, back <= 90 AS is_holdout FROM numbered", ["numbered"])
oracle("traffic_future_dates", """
SELECT series_key, (max(ds) + i::INTEGER)::DATE AS ds FROM panel, range(1, 31) t(i) GROUP BY series_key, i""", ["panel"])

# every holiday as a table of dates: n-th weekday of a month by counting, observed days by moving
shared("holiday_dates", """
  SELECT * FROM (
    WITH y AS (SELECT unnest(range(1990, 2031))::INTEGER AS y),
    d AS (SELECT y, (make_date(y, 1, 1) + i::INTEGER)::DATE AS d FROM y, range(366) t(i) WHERE year(make_date(y, 1, 1) + i::INTEGER) = y),
    n AS (SELECT *, row_number() OVER (PARTITION BY y, month(d), isodow(d) ORDER BY d) AS nth,
                 row_number() OVER (PARTITION BY y, month(d), isodow(d) ORDER BY d DESC) AS nth_last FROM d),
    fixed AS (SELECT y, make_date(y, 1, 1) AS d, 'New Year''s Day' AS name FROM y
      UNION ALL SELECT y, make_date(y, 6, 19), 'Juneteenth National Independence Day' FROM y WHERE y >= 2021
      UNION ALL SELECT y, make_date(y, 7, 4), 'Independence Day' FROM y
      UNION ALL SELECT y, make_date(y, 11, 11), 'Veterans Day' FROM y
      UNION ALL SELECT y, make_date(y, 12, 25), 'Christmas Day' FROM y)
    SELECT d, name FROM fixed
    UNION ALL SELECT (d - 1)::DATE, name || ' (observed)' FROM fixed WHERE isodow(d) = 6
    UNION ALL SELECT (d + 1)::DATE, name || ' (observed)' FROM fixed WHERE isodow(d) = 7
    UNION ALL SELECT d, 'Martin Luther King Jr. Day' FROM n WHERE month(d) = 1 AND isodow(d) = 1 AND nth = 3
    UNION ALL SELECT d, 'Washington''s Birthday' FROM n WHERE month(d) = 2 AND isodow(d) = 1 AND nth = 3
    UNION ALL SELECT d, 'Memorial Day' FROM n WHERE month(d) = 5 AND isodow(d) = 1 AND nth_last = 1
    UNION ALL SELECT d, 'Labor Day' FROM n WHERE month(d) = 9 AND isodow(d) = 1 AND nth = 1
    UNION ALL SELECT d, 'Columbus Day' FROM n WHERE month(d) = 10 AND isodow(d) = 1 AND nth = 2
    UNION ALL SELECT d, 'Thanksgiving Day' FROM n WHERE month(d) = 11 AND isodow(d) = 4 AND nth = 4)""")

oracle("traffic_holidays", """
SELECT series_key, ds, name AS holiday FROM daily LEFT JOIN holiday_dates ON d = ds""", ["daily", "holiday_dates"])

_HOLIDAYS = [
    "New Year's Day", "Juneteenth National Independence Day", "Independence Day", "Veterans Day", "Christmas Day",
    "Martin Luther King Jr. Day", "Washington's Birthday", "Memorial Day", "Labor Day", "Columbus Day", "Thanksgiving Day",
]
_HOLIDAYS += [f"{name} (observed)" for name in _HOLIDAYS[:5]]
_WAVES = [(n, p, k) for n, p, top in (("yearly", 365.25, 10), ("weekly", 7.0, 3)) for k in range(1, top + 1)]
_COLUMNS = ["r6(t) AS t"]
_COLUMNS += [f"r6(greatest(0, t - 0.8::DOUBLE * {i} / 25)) AS bend_{i}" for i in range(1, 26)]
_COLUMNS += [
    f"r6({f}(2 * pi() * {k} * e / {p}::DOUBLE)) + 0.0::DOUBLE AS {n}_{f}_{k}" for n, p, k in _WAVES for f in ("sin", "cos")
]
_COLUMNS += [
    "(coalesce(name, '') = '{}')::INTEGER::DOUBLE AS holiday_{}".format(h.replace("'", "''"), i)
    for i, h in enumerate(_HOLIDAYS, 1)
]
oracle("traffic_features", """
, placed AS (SELECT p.*, h.name, (ds - DATE '1970-01-01')::DOUBLE AS e,
    (ds - min(ds) OVER (PARTITION BY series_key))::DOUBLE
      / greatest(1, max(ds) OVER (PARTITION BY series_key) - min(ds) OVER (PARTITION BY series_key)) AS t
  FROM panel p LEFT JOIN holiday_dates h ON h.d = p.ds)
SELECT series_key, ds, y,
       """ + ",\n       ".join(_COLUMNS) + "\nFROM placed", ["panel", "holiday_dates"])

# forecasts of stated coefficients: the features as above, the 50 sums written out
_TERMS = ["t"]
_TERMS += [f"greatest(0, t - 0.8::DOUBLE * {i} / 25)" for i in range(1, 26)]
_TERMS += [f"{f}(2 * pi() * {k} * e / {p}::DOUBLE)" for n, p, k in _WAVES for f in ("sin", "cos")]
_TERMS += ["(coalesce(name, '') = '{}')::INTEGER::DOUBLE".format(h.replace("'", "''")) for h in _HOLIDAYS]
_CENTRE = "(10::DOUBLE + (0::DOUBLE" + "".join(f" + {term} * ({(k * 37 % 11 - 5) / 400})::DOUBLE" for k, term in enumerate(_TERMS)) + "))"
shared("predicted", f"""
  SELECT series_key, ds, step, exp(c) AS yhat, exp(c - w) AS yhat_lower, exp(c + w) AS yhat_upper FROM (
    SELECT *, {_CENTRE} AS c,
      1.959963984540054::DOUBLE * sqrt(0.05::DOUBLE ** 2 + 25 * 2 * 0.04::DOUBLE ** 2 * greatest(0, t - 1) ** 3 / 3) AS w
    FROM (SELECT m.series_key, m.last + i::INTEGER AS ds, i AS step, h.name, (m.last + i::INTEGER - DATE '1970-01-01')::DOUBLE AS e,
                 (m.last + i::INTEGER - m.first)::DOUBLE / greatest(1, m.last - m.first) AS t
          FROM (SELECT series_key, min(ds) AS first, max(ds) AS last FROM panel GROUP BY ALL) m CROSS JOIN range(-10, 366) r(i)
          LEFT JOIN holiday_dates h ON h.d = m.last + i::INTEGER))""", ["panel", "holiday_dates"])
shared("points", """
  SELECT series_key, ds::DATE AS ds, step, greatest(0, round_even(yhat, 0))::BIGINT AS predicted_footfall,
         greatest(0, round_even(yhat_lower, 0))::BIGINT AS lower_bound, greatest(0, round_even(yhat_upper, 0))::BIGINT AS upper_bound
  FROM predicted WHERE step > 0""", ["predicted"])
oracle("traffic_predict", """
SELECT series_key, ds::DATE AS ds, r6(yhat) AS yhat, r6(yhat_lower) AS yhat_lower, r6(yhat_upper) AS yhat_upper
FROM predicted WHERE step <= 90""", ["predicted"])
oracle("daily_forecast_totals", """
SELECT series_key, sum(predicted_footfall)::BIGINT AS total_footfall, max(predicted_footfall) AS peak_footfall
FROM points WHERE step <= 30 GROUP BY series_key""", ["points"])
oracle("daily_forecast_alerts", """
SELECT 'capacity' AS alert_type, 'High Traffic Day Forecast' AS subject,
       'HIGH TRAFFIC ALERT: ' || ds || ' forecast ' || format('{:,}', predicted_footfall) || ' passengers (exceeds 22,000 capacity threshold)' AS message,
       ds::TIMESTAMP AS event_time, series_key || '|' || ds AS ref_id FROM points WHERE predicted_footfall > 22000""", ["points"])
oracle("daily_forecast_document", """
SELECT series_key, count(*)::INTEGER AS forecast_days, min(ds)::VARCHAR AS forecast_from, max(ds)::VARCHAR AS forecast_to,
       812.5::DOUBLE AS model_mae, 4.25::DOUBLE AS model_mape_pct,
       '[' || string_agg('{"date":"' || ds || '","predicted_footfall":' || predicted_footfall || ',"lower_bound":' || lower_bound
         || ',"upper_bound":' || upper_bound || '}', ',' ORDER BY ds) || ']' AS forecast
FROM points WHERE step <= 14 GROUP BY series_key""", ["points"])
oracle("traffic_forecast_shape", """
SELECT series_key, days::INTEGER AS days, days::BIGINT AS points, days::BIGINT AS distinct_days, (last + 1)::DATE AS first_ds,
       (last + days)::DATE AS last_ds, true AS ordered
FROM (SELECT series_key, max(ds) AS last FROM panel GROUP BY ALL), (VALUES (1), (7), (14), (30), (90)) h(days)""", ["panel"])

oracle("capacity_alerts", """
SELECT 'capacity' AS alert_type, 'High Traffic Day Forecast' AS subject,
       'HIGH TRAFFIC ALERT: ' || ds || ' forecast ' || format('{:,}', y) || ' passengers (exceeds 45,000 capacity threshold)' AS message,
       ds::TIMESTAMP AS event_time, series_key || '|' || ds AS ref_id FROM panel WHERE y > 45000""", ["panel"])

oracle("forecast_totals", """
SELECT series_key, sum(y)::BIGINT AS total_footfall, max(y) AS peak_footfall FROM extended GROUP BY series_key""", ["extended"])

oracle("forecast_clamp", """
, e AS (SELECT o_orderkey::VARCHAR AS series_key, o_orderdate::DATE AS ds, floor(o_totalprice) / 2 AS v FROM orders)
SELECT series_key, ds, greatest(0, round_even(v - 60000, 0))::BIGINT AS predicted_footfall,
       greatest(0, round_even(v - 90000, 0))::BIGINT AS lower_bound, greatest(0, round_even(v - 30000, 0))::BIGINT AS upper_bound
FROM e""")

oracle("forecast_metrics", "SELECT series_key, n, r6(mae) AS mae, r6(mape_pct) AS mape_pct FROM metrics", ["metrics"])

oracle("forecast_display", """
SELECT series_key, ds, y AS predicted_footfall, y - 1000 AS lower_bound, y + 1000 AS upper_bound,
       month(ds) || '/' || day(ds) AS chart_date FROM panel""", ["panel"])

oracle("forecast_document", """
SELECT series_key, count(*)::INTEGER AS forecast_days, min(ds)::VARCHAR AS forecast_from, max(ds)::VARCHAR AS forecast_to,
       0.0::DOUBLE AS model_mae, 0.0::DOUBLE AS model_mape_pct,
       '[' || string_agg('{"date":"' || ds || '","predicted_footfall":' || y || ',"lower_bound":' || (y - 1000)
         || ',"upper_bound":' || (y + 1000) || '}', ',' ORDER BY ds) || ']' AS forecast
FROM held GROUP BY series_key""", ["held"])

oracle("traffic_meta", """
SELECT series_key, round(mae, 2) AS mae, round(mape_pct, 4) AS mape_pct, p.n AS train_rows, 90::INTEGER AS holdout_days,
       date_min, date_max, 'v1' AS model_version, DATE '2001-12-31' AS trained_on
FROM metrics JOIN (SELECT series_key, count(*) AS n, min(ds) AS date_min, max(ds) AS date_max FROM panel GROUP BY ALL) p USING (series_key)""",
       ["metrics"])

# --- streams: the tables that standing queries leave, windows still open included -------------

_DAILY_WINDOWS = """SELECT b AS window_start, b + INTERVAL 24 HOUR AS window_end, count(*) AS predictions,
       count(*) FILTER (high_delay_probability >= 0.65::DOUBLE) AS high_risk
FROM (SELECT *, time_bucket(INTERVAL 24 HOUR, created_at, INTERVAL '6 hours 5 minutes') AS b FROM past) GROUP BY b"""
_SLIDING_WINDOWS = """SELECT b AS window_start, b + INTERVAL 24 HOUR AS window_end, count(*) AS predictions,
       count(*) FILTER (high_delay_probability >= 0.65::DOUBLE) AS high_risk
FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, created_at) - to_hours(6 * k) AS b FROM past, range(4) t(k)) GROUP BY b"""
oracle("risk_windows_daily", _DAILY_WINDOWS, ["past"])
oracle("risk_windows_sliding", _SLIDING_WINDOWS, ["past"])
ORACLES["stream_risk_windows"] = ORACLES["risk_windows_daily"]
ORACLES["stream_risk_windows_sliding"] = ORACLES["risk_windows_sliding"]
oracle("seed_outcome", """
, m AS (SELECT request_id FROM broken GROUP BY request_id)
, a AS (SELECT count(*) AS n, count(m.request_id) AS bad FROM requests r LEFT JOIN m ON m.request_id = r.request_id)
SELECT n - bad AS seeded, bad AS failed, 0::BIGINT AS seeded_again, n - bad AS held FROM a""", ["broken"])
oracle("stream_scoring", """
, m AS (SELECT request_id FROM broken GROUP BY request_id)
, a AS (SELECT count(*) AS n, count(m.request_id) AS bad FROM requests r LEFT JOIN m ON m.request_id = r.request_id)
SELECT n - bad AS accepted, n - bad AS ids, 1::BIGINT AS first_id, n - bad AS last_id, bad AS refused, bad AS refused_requests FROM a""",
       ["broken"])
ORACLES["stream_alerts"] = ORACLES["monitor_alerts"]
ORACLES["stream_status_counts"] = ORACLES["status_counts"]

# --- sources and sinks ------------------------------------------------------------------------

ORACLES["raw_csv_scan"] = ORACLES["clean_monthly"]
ORACLES["clean_table_scan"] = ORACLES["features_monthly"]
ORACLES["meta_json_scan"] = ORACLES["traffic_meta"]

oracle("model_health", """
SELECT series_key, 'v1' AS model_version, round(mae, 2) AS traffic_model_mae, round(mape_pct, 4) AS traffic_model_mape_pct,
       0.2::DOUBLE AS delay_threshold FROM metrics""", ["metrics"])

oracle("requests_from_json", """
, r AS (SELECT event_id AS request_id, event_type AS e,
    CASE WHEN event_type <> 'error' THEN (2013 + user_id % 18)::DOUBLE END AS year,
    CASE WHEN event_type <> 'error' THEN (1 + event_id % 12)::DOUBLE END AS month,
    CASE WHEN event_type NOT IN ('error', 'signup') THEN 1 + floor(value) END AS arr_flights,
    CASE WHEN event_type NOT IN ('error', 'click') THEN 0::DOUBLE END AS is_summer,
    CASE WHEN event_type <> 'error' THEN (user_id % 18)::DOUBLE END AS years_since_2013 FROM events)
SELECT request_id, year, month, arr_flights, is_summer, years_since_2013,
  CASE e WHEN 'error' THEN 'year is required, month is required, arr_flights is required, is_summer is required, is_winter_holiday is required, years_since_2013 is required, airport_avg_delay_rate is required, carrier_avg_delay_rate is required'
    WHEN 'signup' THEN 'arr_flights is required' WHEN 'click' THEN 'is_summer is required' ELSE '' END AS message
FROM r""")

oracle("history_append", """
, c AS (SELECT status, count(*) AS n FROM past GROUP BY status)
SELECT status, n, n AS ids, CASE status WHEN 'disruption_risk' THEN 1 ELSE 1 + (SELECT n FROM c WHERE status = 'disruption_risk') END::BIGINT AS first_id,
       CASE status WHEN 'disruption_risk' THEN n ELSE (SELECT sum(n) FROM c) END::BIGINT AS last_id FROM c""", ["past"])
ORACLES["history_replay"] = ORACLES["history_append"]
