"""DuckDB text of the test panels (see ``shiftcast.sources.tables``).

Used only to build oracle queries; the Spark side never parses SQL.
"""

P1 = """
SELECT date_trunc('hour', ts) AS timestamp_hour,
       CAST(count(*) AS BIGINT) AS orders_count,
       CAST(sum(CASE WHEN event_type = 'purchase' AND hour(ts) BETWEEN 9 AND 20 THEN 1 ELSE 0 END) AS BIGINT)
         AS food_tickets_count,
       round(sum(value), 4) AS sales_total
FROM events
WHERE hour(ts) >= 9 OR hour(ts) <= 1
GROUP BY 1
"""

P1K = """
SELECT event_type, date_trunc('hour', ts) AS timestamp_hour,
       CAST(count(*) AS BIGINT) AS orders_count,
       CAST(sum(CASE WHEN event_type = 'purchase' AND hour(ts) BETWEEN 9 AND 20 THEN 1 ELSE 0 END) AS BIGINT)
         AS food_tickets_count,
       round(sum(value), 4) AS sales_total
FROM events
WHERE hour(ts) >= 9 OR hour(ts) <= 1
GROUP BY 1, 2
"""

P2 = """
SELECT c_mktsegment, o_orderdate AS timestamp_hour,
       CAST(count(*) AS BIGINT) AS orders_count,
       CAST(count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS BIGINT) AS food_tickets_count,
       round(sum(o_totalprice), 2) AS sales_total
FROM orders JOIN customer ON o_custkey = c_custkey
GROUP BY 1, 2
"""

P3 = """
SELECT l_suppkey, l_shipdate AS timestamp_hour,
       CAST(count(*) AS BIGINT) AS orders_count,
       CAST(sum(l_quantity) AS BIGINT) AS food_tickets_count,
       round(sum(l_extendedprice), 2) AS sales_total
FROM lineitem
GROUP BY 1, 2
"""


def with_panels(body: str, ctes: str = "", **panels: str) -> str:
    """``WITH name AS (panel), …, <ctes> body``."""
    parts = [f"{k} AS ({v.strip()})" for k, v in panels.items()]
    if ctes.strip():
        parts.append(ctes.strip())
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()
