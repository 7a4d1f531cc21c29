"""DuckDB text of the external-signal stand-ins (see ``shiftcast.sources.standins``)."""

from shiftcast.sources.standins import NEARBY_SENSORS, SENSORS

WEATHER_DAILY = """
SELECT CAST(l_shipdate AS DATE) AS date, (sum(l_quantity) % 30) / 2.0 AS temp_c,
       CAST(sum(round(l_discount * 100)) % 13 AS DOUBLE) AS rain_mm,
       CAST(sum(round(l_tax * 100)) % 40 AS DOUBLE) AS wind_speed_kmh,
       max(CAST(round(l_discount * 1000) AS INTEGER)) AS weathercode,
       CAST(max(CAST(round(l_discount * 1000) AS INTEGER)) >= 61 AS INTEGER) AS weather_severity_flag
FROM lineitem GROUP BY 1"""

QUARTERLY = """
SELECT 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) AS quarter,
       round(sum(o_totalprice) / 1e6, 3) AS total_000
FROM orders GROUP BY 1"""

AIRPORT_DAILY = f"""
SELECT date, airport_arrivals,
       coalesce(lag(airport_arrivals) OVER (ORDER BY date), airport_arrivals) AS airport_arrivals_lag1
FROM (SELECT CAST(unnest(generate_series(qs, qe, INTERVAL 1 DAY)) AS DATE) AS date,
             CAST(floor(pax / (date_diff('day', qs, qe) + 1)) AS BIGINT) AS airport_arrivals
      FROM (SELECT make_date(CAST(regexp_extract(quarter, '^Q(\\d)\\s*(\\d{{2,4}})', 2) AS INTEGER),
                             (CAST(regexp_extract(quarter, '^Q(\\d)\\s*(\\d{{2,4}})', 1) AS INTEGER) - 1) * 3 + 1, 1) AS qs,
                   CAST(make_date(CAST(regexp_extract(quarter, '^Q(\\d)\\s*(\\d{{2,4}})', 2) AS INTEGER),
                             (CAST(regexp_extract(quarter, '^Q(\\d)\\s*(\\d{{2,4}})', 1) AS INTEGER) - 1) * 3 + 1, 1)
                        + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS qe,
                   CAST(trunc(total_000 * 1000) AS BIGINT) AS pax
            FROM ({QUARTERLY}) q))"""

CRUISE_DAILY = """
SELECT CAST(l_shipdate AS DATE) AS date, 1 AS cruise_ship_flag, count(*) AS ships_in_port_count,
       count(*) * 2500 AS cruise_passenger_estimate
FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE lower(p_type) LIKE '%small%' OR upper(p_name) LIKE '%RED %' OR upper(p_name) LIKE '%HOT %'
GROUP BY 1"""

EVENTS_DAILY = """
SELECT date,
  max(CAST(venue = 'F' AS INTEGER)) AS aviva_event_flag,
  max(CAST(venue = 'O' AS INTEGER)) AS croke_park_event_flag,
  max(CAST(venue = 'P' AS INTEGER)) AS nearby_venue_event_flag,
  1 AS city_event_flag,
  max(CASE lower(impact) WHEN 'very_high' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 1 END)
    AS event_impact_score,
  string_agg(event_name, ' | ' ORDER BY seq) AS event_names
FROM (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS event_name, o_orderstatus AS venue,
             CASE o_orderpriority WHEN '1-URGENT' THEN 'very_high' WHEN '2-HIGH' THEN 'high'
                  WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE o_orderpriority END AS impact,
             min(o_orderkey) AS seq
      FROM orders GROUP BY 1, 2, 3, 4) ev
GROUP BY date"""

INTERVALS = """
SELECT CAST(o_orderdate AS DATE) AS s,
       least(coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL
                           WHEN o_orderpriority = '5-LOW' THEN CAST(o_orderdate AS DATE) - 1
                           ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 14 AS INTEGER) END,
                      CAST(o_orderdate AS DATE)), DATE '2030-12-31') AS e,
       CAST(o_orderstatus = 'F' AS INTEGER) AS is_free, CAST(o_orderpriority LIKE '1-%' AS INTEGER) AS is_festival
FROM orders"""

FAILTE_DAILY = f"""
SELECT date, count(*) AS failte_event_count, CAST(sum(is_free) AS BIGINT) AS failte_free_event_count,
       CAST(sum(is_festival) AS BIGINT) AS failte_festival_count
FROM (SELECT CAST(unnest(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) AS date, is_free, is_festival
      FROM ({INTERVALS}) iv WHERE e >= s) d
GROUP BY 1"""

SENSOR_PANEL = "SELECT l_shipdate AS timestamp_hour, " + ", ".join(
    f"CAST(sum(CASE WHEN l_returnflag = '{rf}' AND l_linestatus = '{ls}' THEN 1 END) AS BIGINT) AS {name}"
    for name, (rf, ls) in SENSORS.items()) + " FROM lineitem GROUP BY 1"

_NEARBY_LIST = "[" + ", ".join(f"CAST({c} AS DOUBLE)" for c in NEARBY_SENSORS) + "]"

SENSOR_E1 = f"""
SELECT *, round_even(list_avg(list_filter({_NEARBY_LIST}, lambda x: x IS NOT NULL)), 1) AS nearby_footfall_avg,
       CAST(coalesce(list_sum(list_filter({_NEARBY_LIST}, lambda x: x IS NOT NULL)), 0) AS BIGINT)
         AS nearby_footfall_sum
FROM ({SENSOR_PANEL}) sp"""

EVENTS_HOURLY = """
SELECT date_trunc('hour', ts) AS timestamp_hour,
       count(*) FILTER (WHERE event_type = 'view') AS footfall_views,
       count(*) FILTER (WHERE event_type = 'click') AS footfall_clicks,
       count(*) FILTER (WHERE event_type = 'error') AS n_errors,
       (sum(round(value * 100)) % 3000) / 100.0 AS temp_c, round(sum(value) / 2, 4) AS sales_total
FROM events GROUP BY 1"""

FOOTFALL = f"""
WITH e1 AS ({SENSOR_E1}),
st AS (SELECT count(s_rf) AS n_live,
              median(CASE WHEN s_rf IS NOT NULL AND nearby_footfall_avg > 0 THEN s_rf / nearby_footfall_avg END) AS scale
       FROM e1),
f AS (SELECT *, coalesce(nearby_footfall_avg, 0) AS s,
             (isodow(timestamp_hour) - 1) * 24 + hour(timestamp_hour) AS how FROM e1),
zs AS (SELECT avg(s) AS mu, stddev_samp(s) AS sd FROM f),
pq AS (SELECT how, quantile_cont(nearby_footfall_avg, 0.7) AS p FROM f GROUP BY 1)
SELECT f.timestamp_hour,
  CAST(trunc(coalesce(CASE WHEN n_live > 100
                           THEN coalesce(CAST(s_rf AS DOUBLE), round_even(nearby_footfall_avg * scale, 0))
                           ELSE nearby_footfall_avg END, 0)) AS BIGINT) AS suffolk_nassau_footfall,
  CAST(s_rf IS NOT NULL AS INTEGER) AS suffolk_counter_is_live,
  nearby_footfall_avg, nearby_footfall_sum,
  CASE WHEN sd > 0 THEN round_even((s - mu) / sd, 3) END AS city_footfall_zscore,
  CAST(round_even(coalesce(lag(s, 1) OVER w, 0), 0) AS BIGINT) AS suffolk_footfall_lag_1h,
  CAST(round_even(coalesce(lag(s, 24) OVER w, 0), 0) AS BIGINT) AS suffolk_footfall_lag_24h,
  CAST(round_even(coalesce(lag(s, 168) OVER w, 0), 0) AS BIGINT) AS suffolk_footfall_lag_168h,
  CASE WHEN count(s) OVER w24 >= 4
       THEN round_even(sum(CAST(round(s * 10) AS BIGINT)) OVER w24 / (count(s) OVER w24 * 10.0), 1) END
    AS suffolk_footfall_roll_24h,
  CAST(coalesce(nearby_footfall_avg > p, false) AS INTEGER) AS suffolk_is_busy_flag
FROM f CROSS JOIN st CROSS JOIN zs LEFT JOIN pq USING (how)
WINDOW w AS (ORDER BY f.timestamp_hour),
       w24 AS (ORDER BY f.timestamp_hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)"""
