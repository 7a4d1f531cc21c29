"""Registered queries for survey 2.A (sources, sinks, contracts) and 2.B (panel)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftcast.operators import panel as P
from shiftcast.operators.calendars import add_time_parts, date_spine
from shiftcast.plans.sqlpanels import P1, P1K, with_panels
from shiftcast.registry import register
from shiftcast.sources import ingest
from shiftcast.sources.tables import TABLES, panel_p1, read_table

# --- B4–B9: the flagship roll-up -------------------------------------------------------

register("hourly_rollup", sql=P1)(lambda spark, sf: panel_p1(spark, sf))


@register("panel_summary", sql=with_panels("""
SELECT event_type, CAST(count(*) AS BIGINT) AS n_rows, min(timestamp_hour) AS ts_min,
       max(timestamp_hour) AS ts_max, round(avg(CAST(orders_count AS DOUBLE)), 6) AS mean_orders,
       round(avg(CASE WHEN food_tickets_count > 0 THEN CAST(food_tickets_count AS DOUBLE) END), 6)
         AS mean_food_positive
FROM p GROUP BY event_type""", p=P1K))
def q_panel_summary(spark, sf):
    return P.panel_summary(panel_p1(spark, sf, keyed=True), keys=["event_type"])


@register("truthy_flag", sql="""
SELECT event_type, CAST(count(*) AS BIGINT) AS n,
  CAST(sum(CASE WHEN lower(CAST(user_id % 3 AS VARCHAR)) IN ('true','yes','1','food') THEN 1 ELSE 0 END) AS BIGINT)
    AS n_flag_mod,
  CAST(sum(CASE WHEN lower(CASE event_type WHEN 'purchase' THEN 'Yes' WHEN 'view' THEN 'FOOD' ELSE event_type END)
                  IN ('true','yes','1','food') THEN 1 ELSE 0 END) AS BIGINT) AS n_flag_text,
  CAST(sum(CASE WHEN lower(CAST(CAST(value > 25 AS INTEGER) AS DOUBLE)::VARCHAR) IN ('true','yes','1','food')
                THEN 1 ELSE 0 END) AS BIGINT) AS n_flag_double_text,
  CAST(sum(CASE WHEN lower(CAST(value > 25 AS VARCHAR)) IN ('true','yes','1','food') THEN 1 ELSE 0 END) AS BIGINT)
    AS n_flag_bool
FROM events GROUP BY event_type""")
def q_truthy_flag(spark, sf):
    ev = read_table(spark, sf, "events")
    text = (F.when(F.col("event_type") == "purchase", "Yes").when(F.col("event_type") == "view", "FOOD")
            .otherwise(F.col("event_type")))
    return ev.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(P.truthy((F.col("user_id") % 3).cast("string"))).cast("long").alias("n_flag_mod"),
        F.sum(P.truthy(text)).cast("long").alias("n_flag_text"),
        # "1.0" is not truthy: the reference maps text, it does not parse numbers.
        F.sum(P.truthy((F.col("value") > 25).cast("int").cast("double"))).cast("long").alias("n_flag_double_text"),
        F.sum(P.truthy(F.col("value") > 25)).cast("long").alias("n_flag_bool"),
    )


@register("coerce_parse", sql="""
WITH raw AS (
  SELECT o_orderkey,
         CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE strftime(o_orderdate, '%d/%m/%Y') END AS ts_text,
         substr(o_orderpriority, 1, 1) AS prio_text, o_orderpriority AS prio_full
  FROM orders)
SELECT o_orderkey, CAST(try_strptime(ts_text, '%d/%m/%Y') AS TIMESTAMP) AS ts,
       TRY_CAST(prio_text AS INTEGER) AS prio_num, TRY_CAST(prio_full AS INTEGER) AS prio_bad
FROM raw WHERE try_strptime(ts_text, '%d/%m/%Y') IS NOT NULL""")
def q_coerce_parse(spark, sf):
    o = read_table(spark, sf, "orders")
    raw = o.select("o_orderkey",
                   F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))
                   .otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("ts_text"),
                   F.substring("o_orderpriority", 1, 1).alias("prio_text"),
                   F.col("o_orderpriority").alias("prio_full"))
    parsed = raw.select("o_orderkey", P.coerce_timestamp("ts_text", ["dd/MM/yyyy"]).alias("ts"),
                        P.coerce_number("prio_text", "int").alias("prio_num"),
                        P.coerce_number("prio_full", "int").alias("prio_bad"))
    return parsed.filter(F.col("ts").isNotNull())


@register("range_filter", sql="""
SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate <= TIMESTAMP '1996-03-31' + INTERVAL 23 HOURS""")
def q_range_filter(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return P.range_filter(li, "l_shipdate", "1996-01-01", "1996-03-31").select(
        "l_orderkey", "l_linenumber", "l_shipdate")


# Columns of the given tables that a pattern flags, for the oracle.
_FLAGGED = [("nation", "n_name", "name"), ("region", "r_name", "name"), ("customer", "c_name", "name"),
            ("supplier", "s_name", "name"), ("part", "p_name", "name")]


@register("pii_column_audit", sql=" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{p}' AS pattern, count({c}) AS n_values FROM {t}"
    for t, c, p in _FLAGGED))
def q_pii_column_audit(spark, sf):
    return P.pii_audit({t: read_table(spark, sf, t) for t in TABLES})


# Two sources with different date ranges that overlap: ship dates, then order dates.
_F1 = """SELECT l_shipdate AS ts, CAST(count(*) FILTER (WHERE l_linestatus = 'O') AS BIGINT) AS open_lines,
                CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem GROUP BY 1"""
_F2 = """SELECT o_orderdate AS ts, CAST(count(*) AS BIGINT) AS n_orders, CAST(count(DISTINCT o_custkey) AS BIGINT) AS qty
         FROM orders GROUP BY 1"""


@register("union_dedupe_first", sql=f"""
WITH f1 AS ({_F1}), f2 AS ({_F2}),
u AS (SELECT ts, open_lines, qty, NULL::BIGINT AS n_orders, 0 AS src FROM f1
      UNION ALL SELECT ts, NULL::BIGINT, qty, n_orders, 1 FROM f2)
SELECT ts, open_lines, qty, n_orders, src AS source_rank FROM u
QUALIFY row_number() OVER (PARTITION BY ts ORDER BY src) = 1""")
def q_union_dedupe_first(spark, sf):
    f1 = (read_table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").alias("ts"))
          .agg(F.count_if(F.col("l_linestatus") == "O").alias("open_lines"), F.sum("l_quantity").cast("long").alias("qty")))
    f2 = (read_table(spark, sf, "orders").groupBy(F.col("o_orderdate").alias("ts"))
          .agg(F.count(F.lit(1)).alias("n_orders"), F.countDistinct("o_custkey").alias("qty")))
    return ingest.union_first_wins([f1, f2], "ts", rank_col="source_rank")


@register("union_history_first", sql="""
WITH hist AS (SELECT l_shipdate AS ts, max(l_discount) + 0.0 AS value FROM lineitem GROUP BY 1),
fc AS (SELECT o_orderdate AS ts, max(o_totalprice) / 1000000 AS value FROM orders GROUP BY 1),
u AS (SELECT ts, value, 0 AS src FROM hist UNION ALL SELECT ts, value, 1 FROM fc)
SELECT ts, value, CAST(src = 0 AS INTEGER) AS is_history FROM u
QUALIFY row_number() OVER (PARTITION BY ts ORDER BY src) = 1""")
def q_union_history_first(spark, sf):
    hist = (read_table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").alias("ts"))
            .agg((F.max("l_discount") + F.lit(0.0)).alias("value")))
    fc = (read_table(spark, sf, "orders").groupBy(F.col("o_orderdate").alias("ts"))
          .agg((F.max("o_totalprice") / 1000000).alias("value")))
    out = ingest.union_first_wins([hist, fc], "ts", rank_col="src")
    return out.select("ts", "value", (F.col("src") == 0).cast("int").alias("is_history"))


@register("json_event_list", sql="""
SELECT event_id, CAST(ts AS DATE) AS event_date, event_type || ' ' || user_id AS event_name FROM events""")
def q_json_event_list(spark, sf):
    # every row as one nested event payload, the shape of an event search answer
    ev = read_table(spark, sf, "events")
    event = F.struct(F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("name"),
                     F.struct(F.struct(F.date_format("ts", "yyyy-MM-dd").alias("localDate")).alias("start")).alias("dates"))
    raw = ev.select("event_id", F.to_json(F.struct(F.struct(F.array(event).alias("events")).alias("_embedded"))).alias("json"))
    return ingest.json_event_list(raw, "json", keep=["event_id"])


@register("json_props_flatten", sql="""
SELECT event_id, event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def q_json_props_flatten(spark, sf):
    ev = read_table(spark, sf, "events")
    return ingest.json_props(ev, "props", {"k": "bigint"}).select("event_id", "event_type", "k")


@register("json_column_arrays", sql=with_panels("""
SELECT timestamp_hour, orders_count, sales_total FROM p""", p=P1))
def q_json_column_arrays(spark, sf):
    # Encode the hourly panel as one column-array payload per day (the shape of
    # an hourly weather API answer), then flatten it back.
    p1 = panel_p1(spark, sf)
    day = (p1.groupBy(F.to_date("timestamp_hour").alias("d"))
           .agg(F.collect_list(F.struct(F.date_format("timestamp_hour", "yyyy-MM-dd'T'HH:mm").alias("time"),
                                        "orders_count", "sales_total")).alias("rows")))
    payload = day.select(F.to_json(F.struct(F.struct(
        F.transform("rows", lambda r: r["time"]).alias("time"),
        F.transform("rows", lambda r: r["orders_count"]).alias("orders_count"),
        F.transform("rows", lambda r: r["sales_total"]).alias("sales_total")).alias("hourly"))).alias("json"))
    flat = ingest.json_column_arrays(payload, "json", "hourly",
                                     {"time": "string", "orders_count": "bigint", "sales_total": "double"})
    return flat.select(F.to_timestamp_ntz("time", F.lit("yyyy-MM-dd'T'HH:mm")).alias("timestamp_hour"),
                       "orders_count", "sales_total")


CONTRACT = [
    ingest.Rule("timestamp_hour", required=True, dtype="timestamp_ntz", on_the_hour=True),
    ingest.Rule("hour", range=(9, 23)),          # declared range; 0 and 1 do occur
    ingest.Rule("weekday", range=(0, 6)),
    ingest.Rule("month", range=(1, 12)),
    ingest.Rule("orders_count", required=True, range=(0, 10**9)),
    ingest.Rule("food_tickets_count", required=True, range=(0, 10**9)),
    ingest.Rule("busy_label", values=["quiet", "normal", "busy", "slammed"]),
    ingest.Rule("covers_count", required=True),  # absent → schema violation
]


@register("contract_violations", sql=with_panels("""
SELECT * FROM (VALUES
  ('timestamp_hour', 'null', (SELECT count(*) FILTER (WHERE timestamp_hour IS NULL) FROM x)),
  ('timestamp_hour', 'on_the_hour', (SELECT count(*) FILTER (WHERE minute(timestamp_hour) <> 0
                                       OR second(timestamp_hour) <> 0) FROM x)),
  ('hour', 'range', (SELECT count(*) FILTER (WHERE hour < 9 OR hour > 23) FROM x)),
  ('weekday', 'range', (SELECT count(*) FILTER (WHERE weekday < 0 OR weekday > 6) FROM x)),
  ('month', 'range', (SELECT count(*) FILTER (WHERE month < 1 OR month > 12) FROM x)),
  ('orders_count', 'null', (SELECT count(*) FILTER (WHERE orders_count IS NULL) FROM x)),
  ('orders_count', 'range', (SELECT count(*) FILTER (WHERE orders_count < 0 OR orders_count > 1000000000) FROM x)),
  ('food_tickets_count', 'null', (SELECT count(*) FILTER (WHERE food_tickets_count IS NULL) FROM x)),
  ('food_tickets_count', 'range', (SELECT count(*) FILTER (WHERE food_tickets_count < 0
                                     OR food_tickets_count > 1000000000) FROM x)),
  ('covers_count', 'missing', -1)
) t(column_name, check_name, n_violations)""",
    p=P1, x="SELECT *, hour(timestamp_hour) AS hour, isodow(timestamp_hour) - 1 AS weekday, "
            "month(timestamp_hour) AS month FROM p"))
def q_contract_violations(spark, sf):
    return ingest.contract_violations(add_time_parts(panel_p1(spark, sf)), CONTRACT)


@register("date_spine", sql="""
SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate) + INTERVAL 7 DAY, INTERVAL 1 DAY)) AS DATE)
  AS date FROM orders""")
def q_date_spine(spark, sf):
    o = read_table(spark, sf, "orders")
    return date_spine(o.agg(F.min("o_orderdate").alias("start"), F.max("o_orderdate").alias("end")),
                      extra_days=7)
