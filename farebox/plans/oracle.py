"""DuckDB SQL for every query that SQL can express, written from the definitions:
row-level windows, plain ranks and direct percentiles, not the operators' own plans."""

from farebox.functions.fixed_values import (
    STRATEGY_ABOVE_040,
    STRATEGY_ABOVE_070,
    STRATEGY_OTHERWISE,
)

# Purchases from the star schema. The line order breaks ties of the line number.
PURCHASES = """
WITH ranked AS (
  SELECT l_orderkey, l_suppkey, l_returnflag,
         row_number() OVER (PARTITION BY l_orderkey
                            ORDER BY l_linenumber, l_suppkey, l_partkey, l_returnflag) AS rn,
         count(*) OVER (PARTITION BY l_orderkey) AS n
  FROM lineitem),
legs AS (
  SELECT l_orderkey, max(n) AS tickets,
         max(CASE WHEN rn = 1 THEN l_suppkey END) AS dep_supp,
         max(CASE WHEN rn = n THEN l_suppkey END) AS ret_supp,
         max(CASE WHEN rn = n THEN l_returnflag END) AS last_flag
  FROM ranked GROUP BY l_orderkey),
base AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_orderdate, o.o_totalprice,
         (o.o_orderkey * 7919) % 86400 AS sec, coalesce(g.tickets, 0) AS tickets,
         g.dep_supp, g.ret_supp, coalesce(g.last_flag, 'N') AS last_flag,
         cn.n_name AS origin, sn.n_name AS dest
  FROM orders o
  LEFT JOIN legs g ON g.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON c.c_custkey = o.o_custkey
  LEFT JOIN nation cn ON cn.n_nationkey = c.c_nationkey
  LEFT JOIN supplier s ON s.s_suppkey = g.dep_supp
  LEFT JOIN nation sn ON sn.n_nationkey = s.s_nationkey),
raw AS (
  SELECT CAST(o_orderkey AS STRING) AS id, CAST(o_custkey AS STRING) AS fk_contact,
         CAST(o_orderdate AS DATE) AS d,
         concat(lpad(CAST(CAST(floor(sec / 3600) AS INT) AS STRING), 2, '0'), ':',
                lpad(CAST(CAST(floor((sec % 3600) / 60) AS INT) AS STRING), 2, '0'), ':',
                lpad(CAST(CAST(sec % 60 AS INT) AS STRING), 2, '0')) AS t,
         origin, dest,
         CASE WHEN last_flag = 'R' THEN dest ELSE '0' END AS back_origin,
         CASE WHEN last_flag = 'R' THEN origin ELSE '0' END AS back_dest,
         CAST(dep_supp AS STRING) AS company,
         CASE WHEN last_flag = 'R' THEN CAST(ret_supp AS STRING) ELSE '1' END AS back_company,
         o_totalprice AS gmv, CAST(tickets AS INT) AS qty
  FROM base)
"""

# Purchases from the event log.
EVENT_PURCHASES = """
WITH raw AS (
  SELECT CAST(event_id AS STRING) AS id, CAST(user_id AS STRING) AS fk_contact,
         CAST(ts AS DATE) AS d, strftime(ts, '%H:%M:%S') AS t,
         CAST(NULL AS STRING) AS origin, CAST(NULL AS STRING) AS dest,
         '0' AS back_origin, '0' AS back_dest,
         CAST(NULL AS STRING) AS company, '1' AS back_company, value AS gmv, 1 AS qty
  FROM events WHERE event_type = 'purchase')
"""

# Derived columns.
CLEAN = """,
p AS (
  SELECT *, CAST(substr(t, 1, 2) AS INT) AS hour, date_diff('second', TIME '00:00:00', CAST(t AS TIME)) AS second, CAST(date_trunc('month', d) AS DATE) AS month,
         CAST(isodow(d) - 1 AS INT) AS dow, origin || ' -> ' || dest AS route,
         back_origin IS NOT NULL AND back_origin <> '0' AS has_return,
         CASE WHEN qty > 0 THEN gmv / qty ELSE 0 END AS avg_price,
         CAST(gmv AS DECIMAL(28, 8)) AS money
  FROM raw)
"""

RFM = """,
rfm AS (
  SELECT fk_contact, CAST(date_diff('day', max(d), DATE '{as_of}') AS INT) AS recency,
         count(id) AS frequency, coalesce(CAST(CAST(sum(money) AS VARCHAR) AS DOUBLE), 0) AS monetary
  FROM p WHERE fk_contact IS NOT NULL AND d IS NOT NULL GROUP BY fk_contact)
"""

QUARTILES = """,
ranks AS (
  SELECT *, row_number() OVER (ORDER BY frequency, fk_contact) AS fr,
         row_number() OVER (ORDER BY monetary, fk_contact) AS mr, count(*) OVER () AS n
  FROM rfm),
edges AS (
  SELECT quantile_cont(recency, 0.25) AS q1, quantile_cont(recency, 0.5) AS q2,
         quantile_cont(recency, 0.75) AS q3 FROM rfm),
quartiles AS (
  SELECT fk_contact, recency, frequency, monetary,
         CAST(CASE WHEN recency <= q1 THEN 4 WHEN recency <= q2 THEN 3
                   WHEN recency <= q3 THEN 2 ELSE 1 END AS INT) AS R_quartile,
         CAST(greatest(1, ceil(4.0 * (fr - 1) / (n - 1))) AS INT) AS F_quartile,
         CAST(greatest(1, ceil(4.0 * (mr - 1) / (n - 1))) AS INT) AS M_quartile
  FROM ranks CROSS JOIN edges),
scored AS (
  SELECT *, R_quartile + F_quartile + M_quartile AS RFM_score,
         R_quartile AS r, F_quartile AS f, M_quartile AS m FROM quartiles),
segments AS (
  SELECT fk_contact, recency, frequency, monetary, R_quartile, F_quartile, M_quartile, RFM_score,
         CASE WHEN r <= 2 AND f <= 1 AND m <= 1 THEN 'Perdidos'
              WHEN r = 4 AND f = 1 THEN 'Novos'
              WHEN r >= 3 AND f <= 2 AND m <= 2 THEN 'Precisam Atenção'
              WHEN r <= 2 AND f <= 2 AND m >= 2 THEN 'Hibernando'
              WHEN r <= 2 AND f >= 3 AND m >= 3 THEN 'Em Risco'
              WHEN r >= 3 AND f < 3 AND m >= 3 THEN 'Potenciais'
              WHEN RFM_score >= 8 AND RFM_score < 10 THEN 'Leais'
              WHEN RFM_score >= 10 THEN 'Campeões' ELSE 'Outros' END AS Segment
  FROM scored)
"""

GAPS = """,
gaps AS (
  SELECT fk_contact, d,
         lag(d) OVER w AS prev, CAST(date_diff('day', lag(d) OVER w, d) AS INT) AS since,
         lead(d) OVER w AS nxt, CAST(date_diff('day', d, lead(d) OVER w) AS INT) AS until
  FROM p WHERE fk_contact IS NOT NULL AND d IS NOT NULL
  WINDOW w AS (PARTITION BY fk_contact ORDER BY d, t, id)),
last_labelled AS (
  SELECT fk_contact, max(d) AS last_day FROM gaps WHERE until IS NOT NULL GROUP BY fk_contact),
labels AS (
  SELECT g.fk_contact, g.d AS date_purchase, g.nxt AS next_purchase,
         g.until AS days_until_next_purchase,
         CAST(g.until <= 7 AS INT) AS will_buy_next_7_days,
         CAST(g.until <= 15 AS INT) AS will_buy_next_15_days,
         CAST(g.until <= 30 AS INT) AS will_buy_next_30_days, count(*) AS purchases
  FROM gaps g JOIN last_labelled l ON l.fk_contact = g.fk_contact AND l.last_day = g.d
  WHERE g.until IS NOT NULL GROUP BY ALL)
"""

COHORTS = """,
firsts AS (
  SELECT fk_contact, min(month) AS primeira_compra FROM p
  WHERE fk_contact IS NOT NULL AND d IS NOT NULL GROUP BY fk_contact),
dated AS (
  SELECT primeira_compra, CAST(date_diff('month', primeira_compra, month) AS INT) AS periods,
         id, p.fk_contact
  FROM p JOIN firsts ON firsts.fk_contact = p.fk_contact WHERE d IS NOT NULL),
cells AS (
  SELECT primeira_compra, periods, count(DISTINCT id) AS purchases,
         count(DISTINCT fk_contact) AS customers
  FROM dated GROUP BY primeira_compra, periods),
retention AS (
  SELECT c.primeira_compra, c.periods,
         c.purchases / CAST(z.purchases AS DOUBLE) * 100 AS retention
  FROM cells c JOIN cells z ON z.primeira_compra = c.primeira_compra AND z.periods = 0)
"""

ROUTES = """,
top_routes AS (
  SELECT route, count(*) AS n FROM p WHERE route IS NOT NULL
  GROUP BY route ORDER BY n DESC, route LIMIT 10),
on_routes AS (SELECT * FROM p WHERE route IN (SELECT route FROM top_routes)),
codes AS (
  SELECT route, CAST(row_number() OVER (ORDER BY route) - 1 AS INT) AS route_encoded
  FROM top_routes),
latest AS (
  SELECT fk_contact, route FROM on_routes WHERE fk_contact IS NOT NULL AND d IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY fk_contact ORDER BY d DESC, second DESC NULLS LAST, id DESC) = 1),
route_rfm AS (
  SELECT fk_contact, CAST(date_diff('day', max(d), DATE '{as_of}') AS INT) AS recency,
         count(id) AS frequency, coalesce(CAST(CAST(sum(money) AS VARCHAR) AS DOUBLE), 0) AS monetary
  FROM on_routes WHERE fk_contact IS NOT NULL AND d IS NOT NULL GROUP BY fk_contact),
route_features AS (
  SELECT r.fk_contact, recency, frequency, monetary, l.route, route_encoded
  FROM route_rfm r JOIN latest l ON l.fk_contact = r.fk_contact
  JOIN codes c ON c.route = l.route)
"""

WEEKDAYS = """,
weekdays AS (
  SELECT * FROM (VALUES (0, 'Monday', 'Segunda'), (1, 'Tuesday', 'Terça'),
    (2, 'Wednesday', 'Quarta'), (3, 'Thursday', 'Quinta'), (4, 'Friday', 'Sexta'),
    (5, 'Saturday', 'Sábado'), (6, 'Sunday', 'Domingo')) AS v(dow, day_en, day_pt))
"""

CHAIN = """,
chain AS (
  SELECT fk_contact, d, route, lag(route) OVER w AS prev1, lag(route, 2) OVER w AS prev2,
         lead(route) OVER w IS NULL AS is_last
  FROM p WHERE fk_contact IS NOT NULL AND d IS NOT NULL AND route IS NOT NULL
  WINDOW w AS (PARTITION BY fk_contact ORDER BY d, coalesce(second, -1), id, route))
"""

# Best next route after two routes, after one, and of all.
CONTEXTS = """,
best2 AS (
  SELECT prev2, prev1, route AS r2, CAST(n AS DOUBLE) / CAST(sum(n) OVER w AS DOUBLE) AS s2, sum(n) OVER w AS total
  FROM (SELECT prev2, prev1, route, count(*) AS n FROM {chain} WHERE prev2 IS NOT NULL GROUP BY ALL)
  WINDOW w AS (PARTITION BY prev2, prev1)
  QUALIFY row_number() OVER (PARTITION BY prev2, prev1 ORDER BY n DESC, route) = 1),
best1 AS (
  SELECT prev1, route AS r1, CAST(n AS DOUBLE) / CAST(sum(n) OVER w AS DOUBLE) AS s1, sum(n) OVER w AS total
  FROM (SELECT prev1, route, count(*) AS n FROM {chain} WHERE prev1 IS NOT NULL GROUP BY ALL)
  WINDOW w AS (PARTITION BY prev1)
  QUALIFY row_number() OVER (PARTITION BY prev1 ORDER BY n DESC, route) = 1),
best0 AS (
  SELECT route AS r0, CAST(n AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) AS s0
  FROM (SELECT route, count(*) AS n FROM {chain} GROUP BY route)
  QUALIFY row_number() OVER (ORDER BY n DESC, route) = 1)
"""

# Last route of test customers who bought before, and what is left of all purchases.
HELD_OUT = """,
held AS (
  SELECT fk_contact, route FROM chain
  WHERE is_last AND prev1 IS NOT NULL AND CAST('0x' || substr(md5(fk_contact), 1, 8) AS BIGINT) % 100 >= 80),
kept AS (
  SELECT fk_contact, route FROM chain c
  WHERE NOT (is_last AND EXISTS (SELECT 1 FROM held h WHERE h.fk_contact = c.fk_contact)))
"""


# Labelled rows with their fold and digest scores, and the metrics of every fold.
FOLD_CASES = """,
folded AS (
  SELECT l.*, CAST(CAST('0x' || substr(md5(l.fk_contact || ':fold'), 1, 8) AS BIGINT) % 3 AS INT) AS fold
  FROM labels l JOIN rfm ON rfm.fk_contact = l.fk_contact)
"""
FOLD_METRICS = FOLD_CASES + """,
cases AS (
  SELECT fold, CAST(h AS INT) AS horizon_days, purchases AS n,
         CAST(CAST('0x' || substr(md5(fk_contact || ':' || h), 1, 8) AS BIGINT) % 100 AS DOUBLE) / 100 AS score,
         CASE h WHEN 7 THEN will_buy_next_7_days WHEN 15 THEN will_buy_next_15_days
                ELSE will_buy_next_30_days END AS y
  FROM folded CROSS JOIN (VALUES (7), (15), (30)) v(h)),
pairs AS (
  SELECT a.fold, a.horizon_days, CAST(sum(a.n * b.n * CASE WHEN a.score > b.score THEN 2
           WHEN a.score = b.score THEN 1 ELSE 0 END) AS DOUBLE) AS won
  FROM cases a JOIN cases b ON a.fold = b.fold AND a.horizon_days = b.horizon_days AND a.y = 1 AND b.y = 0
  GROUP BY a.fold, a.horizon_days),
cells AS (
  SELECT fold, horizon_days, CAST(coalesce(sum(n) FILTER (y = 1), 0) AS DOUBLE) AS pos,
         CAST(coalesce(sum(n) FILTER (y = 0), 0) AS DOUBLE) AS neg,
         CAST(coalesce(sum(n) FILTER (y = 1 AND score > 0.5), 0) AS DOUBLE) AS tp,
         CAST(coalesce(sum(n) FILTER (y = 0 AND score > 0.5), 0) AS DOUBLE) AS fp,
         sqrt(sum(n * (score - y) * (score - y)) / sum(n)) AS rmse
  FROM cases GROUP BY fold, horizon_days),
metrics AS (
  SELECT c.fold, c.horizon_days, CASE WHEN pos > 0 AND neg > 0 THEN won / (2 * pos * neg) END AS auc,
         CASE WHEN pos + fp > 0 THEN 2 * tp / (tp + fp + pos) ELSE 0 END AS f1, round(rmse, 9) AS rmse
  FROM cells c LEFT JOIN pairs p ON p.fold = c.fold AND p.horizon_days = c.horizon_days)
"""


def _ranking_metrics(found: str) -> str:
    return f"""
SELECT count(*) AS customers, round(CAST(count(position) AS DOUBLE) / count(*), 9) AS hit_rate,
       round(coalesce(sum(1 / log2(position + 1)), 0) / count(*), 9) AS ndcg,
       round(coalesce(sum(CAST(1 AS DOUBLE) / position), 0) / count(*), 9) AS reciprocal_rank
FROM held h LEFT JOIN {found}
"""


WAITS = """,
waits AS (
  SELECT Segment, days, CAST(sum(bought) AS BIGINT) AS bought, CAST(sum(waiting) AS BIGINT) AS waiting
  FROM (SELECT fk_contact, since AS days, 1 AS bought, 0 AS waiting FROM gaps WHERE since IS NOT NULL
        UNION ALL SELECT fk_contact, greatest(recency, 0), 0, 1 FROM rfm) w
  JOIN segments s ON s.fk_contact = w.fk_contact GROUP BY Segment, days),
risk AS (
  SELECT *, sum(bought + waiting) OVER (PARTITION BY Segment ORDER BY days DESC) AS at_risk FROM waits),
curve AS (
  SELECT *, CASE WHEN bought = at_risk THEN 0 ELSE exp(sum(CASE WHEN bought = at_risk THEN 0
           ELSE ln(1 - CAST(bought AS DOUBLE) / at_risk) END) OVER (PARTITION BY Segment ORDER BY days)) END AS survival
  FROM risk)
"""

MONTHS = """,
months AS (
  SELECT * FROM (VALUES (1, 'January', 'Janeiro'), (2, 'February', 'Fevereiro'),
    (3, 'March', 'Março'), (4, 'April', 'Abril'), (5, 'May', 'Maio'), (6, 'June', 'Junho'),
    (7, 'July', 'Julho'), (8, 'August', 'Agosto'), (9, 'September', 'Setembro'),
    (10, 'October', 'Outubro'), (11, 'November', 'Novembro'), (12, 'December', 'Dezembro'))
    AS v(month_no, month_en, month_pt))
"""

# Largest month offset of the orders at scale factors 0.001 and 0.01; SQL names its columns.
LAST_OFFSET = 78
AS_OF = "2001-09-01"
EVENTS_AS_OF = "2024-02-01"

_P = PURCHASES + CLEAN
_RFM = _P + RFM.format(as_of=AS_OF)
_SEGMENTS = _RFM + QUARTILES
_GAPS = _P + GAPS
_COHORTS = _P + COHORTS
_ROUTES = _P + ROUTES.format(as_of=AS_OF)
_EVENTS = EVENT_PURCHASES + CLEAN

_KPI = """
SELECT gmv AS total_gmv, tickets AS total_tickets, transactions, customers,
       CASE WHEN transactions > 0 THEN gmv / transactions ELSE 0 END AS gmv_per_transaction,
       CASE WHEN transactions > 0 THEN CAST(tickets AS DOUBLE) / transactions ELSE 0 END
         AS tickets_per_transaction,
       CASE WHEN tickets > 0 THEN gmv / tickets ELSE 0 END AS gmv_per_ticket,
       CASE WHEN customers > 0 THEN gmv / customers ELSE 0 END AS gmv_per_customer
FROM (SELECT coalesce(CAST(CAST(sum(money) AS VARCHAR) AS DOUBLE), 0) AS gmv,
             CAST(coalesce(sum(qty), 0) AS BIGINT) AS tickets,
             count(DISTINCT id) AS transactions, count(DISTINCT fk_contact) AS customers FROM p)
"""

_DOW_HOUR = """
SELECT dow, hour, count(*) AS purchases FROM p
WHERE d IS NOT NULL AND hour IS NOT NULL GROUP BY dow, hour
"""


def _interval_stats(condition: str) -> str:
    return f"""
SELECT count(*) AS intervals, round(avg(since), 6) AS mean_days,
       round(median(since), 6) AS median_days, min(since) AS min_days, max(since) AS max_days,
       round(stddev_samp(since), 6) AS std_days,
       round(quantile_cont(since, 0.99), 6) AS p99_days
FROM gaps WHERE {condition}
"""


def _top(column: str, measure: str, name: str, where: str = "true", k: int = 10) -> str:
    return f"""
SELECT *, CAST(row_number() OVER (ORDER BY {name} DESC, {column}) AS INT) AS position
FROM (SELECT {column}, {measure} AS {name} FROM (SELECT *, origin AS place_origin_departure,
             dest AS place_destination_departure, company AS fk_departure_ota_bus_company FROM p)
      WHERE {column} IS NOT NULL AND {where} GROUP BY {column})
ORDER BY {name} DESC, {column} LIMIT {k}
"""


def _bins(values: str, bins: int, extra: str = "") -> str:
    """Histogram of the ``value`` column of a relation."""
    return f"""
SELECT {extra} CAST(bin AS INT) AS bin, round(low + bin * ((high - low) / {bins}), 6) AS bin_start,
       round(low + (bin + 1) * ((high - low) / {bins}), 6) AS bin_end, n
FROM (SELECT low, high,
             least(coalesce(floor((value - low) / nullif(high - low, 0) * {bins}), 0), {bins} - 1)
               AS bin, count(*) AS n
      FROM (SELECT CAST(value AS DOUBLE) AS value FROM ({values})) AS x
      CROSS JOIN (SELECT CAST(min(value) AS DOUBLE) AS low, CAST(max(value) AS DOUBLE) AS high
                  FROM ({values})) AS ends
      GROUP BY ALL)
"""


_MONEY = "coalesce(CAST(CAST(sum(money) AS VARCHAR) AS DOUBLE), 0)"
_GMV_BY_MONTH = f"""
, monthly AS (SELECT month, {_MONEY} AS gmv FROM p WHERE d IS NOT NULL GROUP BY month)
SELECT strftime(month, '%Y-%m') AS year_month, gmv,
       CASE WHEN count(*) OVER w = 3 THEN avg(gmv) OVER w END AS moving_avg
FROM monthly WINDOW w AS (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
"""
_MONTHLY_KPIS = f"""
SELECT month AS purchase_year_month, count(*) AS purchases, count(DISTINCT fk_contact) AS customers,
       CAST(count(DISTINCT d) AS INT) AS days, {_MONEY} AS gmv
FROM p WHERE d IS NOT NULL GROUP BY month
"""
_MONTHLY_ROUTES = f"""
SELECT month AS purchase_year_month, route, count(*) AS purchases, {_MONEY} AS gmv
FROM p WHERE d IS NOT NULL AND route IS NOT NULL GROUP BY month, route
"""
_NULLS = [
    ("nk_ota_localizer_id", "id"),
    ("fk_contact", "fk_contact"),
    ("date_purchase", "d"),
    ("time_purchase", "t"),
    ("place_origin_departure", "origin"),
    ("place_destination_departure", "dest"),
    ("place_origin_return", "back_origin"),
    ("place_destination_return", "back_dest"),
    ("fk_departure_ota_bus_company", "company"),
    ("fk_return_ota_bus_company", "back_company"),
    ("gmv_success", "gmv"),
    ("total_tickets_quantity_success", "qty"),
]

_BUSIEST = """,
by_day AS (SELECT dow, count(*) AS n FROM p WHERE dow IS NOT NULL GROUP BY dow),
by_hour AS (SELECT hour, count(*) AS n FROM p WHERE hour IS NOT NULL GROUP BY hour),
by_both AS (SELECT dow, hour, count(*) AS n FROM p
            WHERE dow IS NOT NULL AND hour IS NOT NULL GROUP BY dow, hour)
"""

_PROFILE_TEXTS = """,
texts AS (SELECT * FROM (VALUES {rows}) AS v(Segment, description, priority, strategies))
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _profile_texts() -> str:
    from farebox.functions.fixed_values import BLUE_SEGMENTS, SEGMENT_STRATEGIES

    rows = [
        "(" + ", ".join(
            map(
                _quoted,
                (name, text, "blue" if name in BLUE_SEGMENTS else "orange", "; ".join(strategies)),
            )
        ) + ")"
        for name, (text, strategies) in SEGMENT_STRATEGIES.items()
    ]
    return _PROFILE_TEXTS.format(rows=", ".join(rows))


ORACLE_SQL: dict[str, str] = {
    "purchases_clean": _P + """
SELECT id AS nk_ota_localizer_id, fk_contact, d AS date_purchase, t AS time_purchase,
       hour AS time_purchase_hour, gmv AS gmv_success, qty AS total_tickets_quantity_success,
       month AS purchase_year_month, dayname(d) AS purchase_day_of_week,
       monthname(d) AS purchase_month, CAST(year(d) AS INT) AS purchase_year,
       CAST(day(d) AS INT) AS purchase_day, avg_price AS avg_ticket_price, has_return, route,
       origin AS place_origin_departure, dest AS place_destination_departure,
       back_origin AS place_origin_return, back_dest AS place_destination_return,
       company AS fk_departure_ota_bus_company, back_company AS fk_return_ota_bus_company
FROM p
""",
    "ingest_profile": _P + ", one AS (SELECT " + ", ".join(
        [
            "CAST(count(*) AS STRING) AS \"rows\"",
            "'12' AS \"columns\"",
            "CAST(count(*) FILTER (d IS NULL) AS STRING) AS invalid_dates",
            "CAST(count(*) FILTER (hour IS NULL) AS STRING) AS invalid_hours",
            "CAST(min(d) AS STRING) AS first_date",
            "CAST(max(d) AS STRING) AS last_date",
            "CAST(count(DISTINCT company) AS STRING) AS outbound_companies",
        ]
        + [
            f'CAST(count(*) FILTER ({short} IS NULL) AS STRING) AS "nulls:{name}"'
            for name, short in _NULLS
        ]
        # The orders hold no value that is not a number; unit tests have such values.
        + [
            f"""CAST(count(*) FILTER ({short} IS NOT NULL AND NOT isfinite(CAST({short} AS DOUBLE)))
               AS STRING) AS "rejected:{name}\""""
            for name, short in _NULLS[-2:]
        ]
    ) + " FROM p) SELECT metric, value FROM (UNPIVOT one ON * INTO NAME metric VALUE value)",
    "kpi_overview": _P + _KPI,
    "gmv_by_month": _P + _GMV_BY_MONTH,
    "monthly_kpis": _P + _MONTHLY_KPIS,
    "stored_monthly_kpis": _P + _MONTHLY_KPIS,
    "monthly_weekday_hours": _P + f"""
SELECT month AS purchase_year_month, dow, hour, count(*) AS purchases, {_MONEY} AS gmv
FROM p WHERE d IS NOT NULL AND hour IS NOT NULL GROUP BY month, dow, hour
""",
    "monthly_routes": _P + _MONTHLY_ROUTES,
    "stored_monthly_routes": _P + _MONTHLY_ROUTES,
    "stored_gmv_by_month": _P + _GMV_BY_MONTH,
    "gmv_by_weekday": _P + WEEKDAYS + f"""
SELECT w.dow, day_en, day_pt, gmv FROM weekdays w
LEFT JOIN (SELECT dow, {_MONEY} AS gmv FROM p GROUP BY dow) s ON s.dow = w.dow
""",
    "gmv_by_hour": _P + f"SELECT hour, {_MONEY} AS gmv FROM p WHERE hour IS NOT NULL GROUP BY hour",
    "gmv_by_calendar_month": _P + MONTHS + f"""
SELECT month_no, month_en, month_pt, {_MONEY} AS gmv
FROM p JOIN months ON month_no = month(d) GROUP BY month_no, month_en, month_pt
""",
    "purchases_by_weekday": _P + WEEKDAYS + """
SELECT w.dow, day_en, day_pt, purchases FROM weekdays w
LEFT JOIN (SELECT dow, count(*) AS purchases FROM p GROUP BY dow) s ON s.dow = w.dow
""",
    "purchases_by_hour": _P + """
SELECT hour, count(*) AS purchases FROM p WHERE hour IS NOT NULL GROUP BY hour
""",
    "weekday_hour_counts": _P + _DOW_HOUR,
    "weekday_hour_grid": _P + WEEKDAYS + "SELECT w.dow, day_en, day_pt, " + ", ".join(
        f"nullif(count(*) FILTER (hour = {h}), 0) AS h{h}" for h in range(24)
    ) + " FROM weekdays w LEFT JOIN p ON p.dow = w.dow GROUP BY w.dow, day_en, day_pt",
    "best_contact_slot": _P + WEEKDAYS + _BUSIEST + """
SELECT (SELECT day_pt FROM by_day b JOIN weekdays w ON w.dow = b.dow
        ORDER BY n DESC, b.dow LIMIT 1) AS best_day,
       (SELECT hour FROM by_hour ORDER BY n DESC, hour LIMIT 1) AS best_hour,
       day_pt AS slot_day, hour AS slot_hour, n AS slot_purchases
FROM by_both b JOIN weekdays w ON w.dow = b.dow ORDER BY n DESC, b.dow, hour LIMIT 1
""",
    "rfm": _RFM + "SELECT * FROM rfm",
    "rfm_excluded_rows": _P + """
SELECT count(*) FILTER (fk_contact IS NULL) AS without_customer,
       count(*) FILTER (d IS NULL) AS without_date FROM p
""",
    "rfm_quartiles": _SEGMENTS + "SELECT * EXCLUDE (Segment) FROM segments",
    "rfm_segments": _SEGMENTS + "SELECT * FROM segments",
    "segment_report": _SEGMENTS + """
, sums AS (SELECT Segment, count(*) AS customers,
                  CAST(CAST(sum(CAST(monetary AS DECIMAL(28, 8))) AS VARCHAR) AS DOUBLE) AS total_value
           FROM segments GROUP BY Segment)
SELECT Segment, customers, total_value, total_value / customers AS mean_value,
       CAST(customers AS DOUBLE) / (SELECT count(*) FROM segments) * 100 AS pct_customers,
       total_value / (SELECT CAST(CAST(sum(CAST(monetary AS DECIMAL(28, 8))) AS VARCHAR) AS DOUBLE) FROM segments)
         * 100 AS pct_value
FROM sums
""",
    "segment_profiles": _SEGMENTS + _profile_texts() + """
, sums AS (SELECT Segment, count(*) AS customers,
                  CAST(CAST(sum(CAST(monetary AS DECIMAL(28, 8))) AS VARCHAR) AS DOUBLE) AS total_value,
                  round_even(CAST(sum(recency) AS DOUBLE) / count(*) * 100, 0) / 100
                    AS mean_recency,
                  round_even(CAST(sum(frequency) AS DOUBLE) / count(*) * 100, 0) / 100
                    AS mean_frequency,
                  round_even(CAST(CAST(sum(CAST(monetary AS DECIMAL(28, 8))) AS VARCHAR) AS DOUBLE) / count(*)
                             * 100, 0) / 100 AS mean_monetary,
                  round_even(CAST(sum(RFM_score) AS DOUBLE) / count(*) * 100, 0) / 100
                    AS mean_score
           FROM segments GROUP BY Segment)
SELECT coalesce(x.Segment, s.Segment) AS Segment, description, priority, strategies, coalesce(customers, 0) AS customers,
       coalesce(total_value, 0) AS total_value, mean_recency, mean_frequency, mean_monetary,
       mean_score, coalesce(total_value / customers, 0) AS mean_value
FROM texts x FULL JOIN sums s ON s.Segment = x.Segment
""",
    "rfm_sample": _SEGMENTS + """
SELECT fk_contact, recency, frequency, monetary, Segment FROM segments
ORDER BY md5(fk_contact), fk_contact LIMIT 1000
""",
    "rfm_histograms": _RFM + " UNION ALL ".join(
        _bins(f"SELECT {c} AS value FROM rfm", n, f"'{c}' AS measure,")
        for c, n in (("recency", 30), ("frequency", 20), ("monetary", 20))
    ),
    "purchase_intervals": _GAPS + """
SELECT fk_contact, d AS date_purchase, prev AS prev_purchase, since AS days_since_prev_purchase,
       count(*) AS purchases
FROM gaps WHERE since IS NOT NULL GROUP BY fk_contact, d, prev, since
""",
    "interval_stats": _GAPS + _interval_stats("since > 0"),
    "interval_stats_180": _GAPS + _interval_stats("since <= 180"),
    "interval_histogram": _GAPS + """
, p99 AS (SELECT quantile_cont(since, 0.99) AS top FROM gaps WHERE since > 0)
""" + _bins(
        "SELECT since AS value FROM gaps, p99 WHERE since > 0 AND since <= top", 50,
        "'up_to_p99' AS measure,",
    ) + " UNION ALL " + _bins(
        "SELECT since AS value FROM gaps WHERE since <= 180", 30, "'up_to_180' AS measure,"
    ),
    "interval_by_segment": _SEGMENTS + GAPS + """
SELECT Segment, round(avg(since), 6) AS mean_days, round(median(since), 6) AS median_days,
       count(*) AS intervals
FROM gaps JOIN segments s ON s.fk_contact = gaps.fk_contact WHERE since > 0 GROUP BY Segment
""",
    "next_purchase_labels": _GAPS + "SELECT * FROM labels",
    "next_purchase_one_per_customer": _GAPS + """
SELECT * REPLACE (1::BIGINT AS purchases) FROM labels
QUALIFY row_number() OVER (PARTITION BY fk_contact ORDER BY days_until_next_purchase DESC) = 1
""",
    "conversion_by_segment": _SEGMENTS + GAPS + "SELECT Segment, " + ", ".join(
        f"CAST(sum(will_buy_next_{h}_days * purchases) AS DOUBLE) / CAST(sum(purchases) AS DOUBLE)"
        f" * 100 AS conversion_{h}_days"
        for h in (7, 15, 30)
    ) + """, CAST(sum(purchases) AS BIGINT) AS labelled
FROM labels l JOIN segments s ON s.fk_contact = l.fk_contact GROUP BY Segment
""",
    "cohort_counts": _COHORTS + "SELECT primeira_compra, periods, purchases FROM cells",
    "cohort_customers": _COHORTS + "SELECT primeira_compra, periods, customers FROM cells",
    "cohort_retention": _COHORTS + "SELECT * FROM retention",
    "retention_curve": _COHORTS + """
SELECT periods, round(avg(retention), 6) AS mean_retention, count(*) AS cohorts
FROM retention GROUP BY periods
""",
    "cohort_grid": _COHORTS + "SELECT primeira_compra, " + ", ".join(
        f"max(retention) FILTER (periods = {k}) AS p{k}" for k in range(LAST_OFFSET + 1)
    ) + " FROM retention GROUP BY primeira_compra",
    "cohort_grid_rows": _COHORTS + """
SELECT f.primeira_compra, CAST(k.periods AS INT) AS periods, r.retention
FROM (SELECT DISTINCT primeira_compra FROM cells) f
CROSS JOIN (SELECT unnest(range((SELECT max(periods) + 1 FROM cells))) AS periods) k
LEFT JOIN retention r ON r.primeira_compra = f.primeira_compra AND r.periods = k.periods
""",
    "route_ranking": _P + _top("route", "count(*)", "purchases"),
    "origin_ranking": _P + _top("place_origin_departure", "count(*)", "purchases"),
    "destination_ranking": _P + _top("place_destination_departure", "count(*)", "purchases"),
    "company_ranking": _P + _top("fk_departure_ota_bus_company", _MONEY, "gmv"),
    "customer_ranking": _P + f"""
, totals AS (SELECT fk_contact, count(DISTINCT id) AS purchases, {_MONEY} AS gmv
             FROM p WHERE fk_contact IS NOT NULL GROUP BY fk_contact),
places AS (SELECT *, row_number() OVER (ORDER BY purchases DESC, fk_contact) AS by_purchases,
                  row_number() OVER (ORDER BY gmv DESC, fk_contact) AS by_gmv FROM totals),
mean AS (SELECT CAST(sum(purchases) AS DOUBLE) / count(*) AS mean_purchases FROM totals)
SELECT 'purchases' AS ranking, CAST(by_purchases AS INT) AS position, fk_contact, purchases, gmv,
       mean_purchases FROM places, mean WHERE by_purchases <= 10
UNION ALL
SELECT 'gmv', CAST(by_gmv AS INT), fk_contact, purchases, gmv, mean_purchases
FROM places, mean WHERE by_gmv <= 10
""",
    "business_highlights": _P + WEEKDAYS + _BUSIEST + """
SELECT * FROM (
  SELECT 'route' AS highlight, CAST(row_number() OVER (ORDER BY n DESC, pair) AS INT) AS position,
         pair AS value
  FROM (SELECT origin || ' → ' || dest AS pair, count(*) AS n FROM p
        WHERE origin IS NOT NULL AND dest IS NOT NULL GROUP BY pair)
  QUALIFY position <= 3)
UNION ALL
SELECT * FROM (SELECT 'weekday', 1, day_pt FROM by_day b JOIN weekdays w ON w.dow = b.dow
               ORDER BY n DESC, b.dow LIMIT 1)
UNION ALL
SELECT * FROM (SELECT 'hour', 1, CAST(hour AS STRING) FROM by_hour ORDER BY n DESC, hour LIMIT 1)
""",
    "same_company_share": _P + """
SELECT count(*) AS purchases, count(*) FILTER (back_company <> '1') AS round_trips,
       CAST(count(*) FILTER (company = back_company) AS DOUBLE) / count(*) * 100
         AS pct_same_company,
       CAST(count(*) FILTER (back_company <> '1' AND company = back_company) AS DOUBLE)
         / count(*) FILTER (back_company <> '1') * 100 AS pct_same_company_round_trips
FROM p WHERE company IS NOT NULL AND back_company IS NOT NULL
""",
    "tickets_distribution": _P + """
SELECT qty AS tickets, count(*) AS purchases FROM p WHERE qty IS NOT NULL GROUP BY qty
""",
    "avg_ticket_price": _P + """
SELECT round(avg(gmv / qty), 4) AS avg_ticket_price, count(*) AS purchases
FROM p WHERE qty > 0 AND gmv IS NOT NULL
""",
    "round_trip_comparison": _P + """
, s AS (SELECT CAST(count(*) FILTER (has_return) AS DOUBLE) / count(*) * 100 AS pct,
               CAST(CAST(sum(money) FILTER (has_return) AS VARCHAR) AS DOUBLE) / count(money) FILTER (has_return)
                 AS w,
               CAST(CAST(sum(money) FILTER (NOT has_return) AS VARCHAR) AS DOUBLE)
                 / count(money) FILTER (NOT has_return) AS o
        FROM p)
SELECT 'Somente Ida' AS kind, o AS mean_gmv, 100 - pct AS pct_purchases,
       CASE WHEN o > 0 THEN (w / o - 1) * 100 ELSE 0 END AS pct_round_trip_above FROM s
UNION ALL
SELECT 'Ida e Volta', w, pct, CASE WHEN o > 0 THEN (w / o - 1) * 100 ELSE 0 END FROM s
""",
    "ticket_price_histogram": _P + _bins("SELECT gmv / qty AS value FROM p WHERE qty > 0", 30),
    "ticket_price_density": _P + """
, prices AS (SELECT gmv / qty AS price FROM p WHERE qty > 0 AND gmv IS NOT NULL),
known AS (SELECT min(price) AS low, max(price) AS high,
                 CAST(format('{:.5e}', stddev_samp(price) * pow(count(*), -0.2)) AS DOUBLE) AS h
          FROM prices),
fine AS (SELECT low + (floor((price - low) / (h / 16)) + 0.5) * (h / 16) AS centre, count(*) AS n
         FROM prices CROSS JOIN known GROUP BY centre),
grid AS (SELECT CAST(unnest(range(200)) AS INT) AS point)
SELECT point, round(low + point * ((high - low) / 199), 6) AS price,
       round(sum(n * exp(-pow((low + point * ((high - low) / 199) - centre) / h, 2) / 2))
             * ((high - low) / 30 / (h * sqrt(2 * pi()))), 6) AS density
FROM fine CROSS JOIN known CROSS JOIN grid GROUP BY point, low, high, h
""",
    "purchase_count_histogram": _P + _bins(
        "SELECT count(*) AS value FROM p WHERE fk_contact IS NOT NULL GROUP BY fk_contact", 20
    ),
    "repurchase_features": _RFM + GAPS + """
SELECT l.fk_contact, recency, frequency, monetary, days_until_next_purchase,
       will_buy_next_7_days, will_buy_next_15_days, will_buy_next_30_days, purchases
FROM labels l JOIN rfm ON rfm.fk_contact = l.fk_contact
""",
    "repurchase_features_point_in_time": _GAPS + """
, history AS (
  SELECT l.fk_contact, l.date_purchase, l.days_until_next_purchase,
         max(p.d) FILTER (p.d < l.date_purchase) AS previous_day,
         count(p.id) FILTER (p.d < l.date_purchase OR l.next_purchase > l.date_purchase)
           AS frequency,
         coalesce(CAST(CAST(sum(p.money) FILTER (p.d < l.date_purchase OR
                                                 l.next_purchase > l.date_purchase)
                            AS VARCHAR) AS DOUBLE), 0) AS monetary
  FROM labels l JOIN p ON p.fk_contact = l.fk_contact AND p.d <= l.date_purchase
  GROUP BY l.fk_contact, l.date_purchase, l.days_until_next_purchase, l.next_purchase)
SELECT l.fk_contact, coalesce(CAST(date_diff('day', previous_day, l.date_purchase) AS INT), 0)
         AS recency, frequency, monetary, l.days_until_next_purchase,
       will_buy_next_7_days, will_buy_next_15_days, will_buy_next_30_days, purchases
FROM labels l JOIN history h ON h.fk_contact = l.fk_contact
  AND h.days_until_next_purchase = l.days_until_next_purchase
""",
    "train_test_split": _GAPS + """
SELECT fk_contact, CAST(bucket AS INT) AS bucket, bucket < 80 AS in_training
FROM (SELECT DISTINCT fk_contact,
             CAST('0x' || substr(md5(fk_contact), 1, 8) AS BIGINT) % 100 AS bucket FROM labels)
""",
    "top_route_purchases": _ROUTES + """
SELECT id AS nk_ota_localizer_id, fk_contact, d AS date_purchase, route, gmv AS gmv_success
FROM on_routes
""",
    "route_features": _ROUTES + "SELECT * FROM route_features",
    "route_baseline": _ROUTES + """
SELECT count(DISTINCT route_encoded) AS classes,
       CAST(1 AS DOUBLE) / count(DISTINCT route_encoded) AS baseline, count(*) AS customers
FROM route_features
""",
    "scored_metrics": _RFM + GAPS + """
, cases AS (
  SELECT CAST(h AS INT) AS horizon_days, CAST(digest AS DOUBLE) / 100 AS score, purchases AS n,
         CASE h WHEN 7 THEN will_buy_next_7_days WHEN 15 THEN will_buy_next_15_days
                ELSE will_buy_next_30_days END AS y
  FROM (SELECT l.*, h, CAST('0x' || substr(md5(l.fk_contact || ':' || h), 1, 8) AS BIGINT) % 100 AS digest
        FROM labels l JOIN rfm ON rfm.fk_contact = l.fk_contact CROSS JOIN (VALUES (7), (15), (30)) v(h))
  WHERE CAST('0x' || substr(md5(fk_contact), 1, 8) AS BIGINT) % 100 >= 80),
pairs AS (
  SELECT a.horizon_days, CAST(sum(a.n * b.n * CASE WHEN a.score > b.score THEN 2
                                                   WHEN a.score = b.score THEN 1 ELSE 0 END) AS DOUBLE) AS won
  FROM cases a JOIN cases b ON a.horizon_days = b.horizon_days AND a.y = 1 AND b.y = 0
  GROUP BY a.horizon_days),
cells AS (
  SELECT horizon_days, CAST(coalesce(sum(n) FILTER (y = 1), 0) AS DOUBLE) AS pos,
         CAST(coalesce(sum(n) FILTER (y = 0), 0) AS DOUBLE) AS neg,
         CAST(coalesce(sum(n) FILTER (y = 1 AND score > 0.5), 0) AS DOUBLE) AS tp,
         CAST(coalesce(sum(n) FILTER (y = 0 AND score > 0.5), 0) AS DOUBLE) AS fp
  FROM cases GROUP BY horizon_days)
SELECT c.horizon_days, CASE WHEN pos > 0 AND neg > 0 THEN won / (2 * pos * neg) END AS auc,
       CASE WHEN pos + fp > 0 THEN 2 * tp / (tp + fp + pos) ELSE 0 END AS f1,
       CASE WHEN pos > 0 AND neg > 0 THEN (tp / pos + (neg - fp) / neg) / 2 END AS auc_of_answers
FROM cells c LEFT JOIN pairs p ON p.horizon_days = c.horizon_days
""",
    "fold_sizes": _RFM + GAPS + FOLD_CASES + """
SELECT fold, count(DISTINCT fk_contact) AS customers, count(*) AS lines, CAST(sum(purchases) AS BIGINT) AS purchases
FROM folded GROUP BY fold
""",
    "scored_fold_metrics": _RFM + GAPS + FOLD_METRICS + "SELECT fold, horizon_days, auc, f1, rmse FROM metrics",
    "scored_fold_summary": _RFM + GAPS + FOLD_METRICS + "SELECT horizon_days, count(*) AS folds, " + ", ".join(
        [f"round(avg({m}), 9) AS mean_{m}" for m in ("auc", "f1", "rmse")]
        + [f"round(stddev_samp({m}), 9) AS deviation_{m}" for m in ("auc", "f1", "rmse")]
    ) + " FROM metrics GROUP BY horizon_days",
    "scored_permutation_importance": _RFM + GAPS + """
, tested AS (
  SELECT l.*, recency, frequency, monetary, l.fk_contact || ':' || days_until_next_purchase || ':' AS name
  FROM labels l JOIN rfm ON rfm.fk_contact = l.fk_contact
  WHERE CAST('0x' || substr(md5(l.fk_contact), 1, 8) AS BIGINT) % 100 >= 80),
takers AS (SELECT *, row_number() OVER (ORDER BY md5(name || 'rows')) AS i FROM tested),
r AS (SELECT recency AS v, row_number() OVER (ORDER BY md5(name || 'recency')) AS i FROM tested),
f AS (SELECT frequency AS v, row_number() OVER (ORDER BY md5(name || 'frequency')) AS i FROM tested),
m AS (SELECT monetary AS v, row_number() OVER (ORDER BY md5(name || 'monetary')) AS i FROM tested),
cases AS (
  SELECT feature, CAST(h AS INT) AS horizon_days, purchases AS n,
         floor((0.5 * (CAST(h AS DOUBLE) / (seen + h)) + 0.3 * (CAST(often AS DOUBLE) / (often + 10))
                + 0.2 * (value / (value + 1000000))) * 1000) / 1000 AS score,
         CASE h WHEN 7 THEN will_buy_next_7_days WHEN 15 THEN will_buy_next_15_days
                ELSE will_buy_next_30_days END AS y
  FROM (SELECT t.*, feature, greatest(CASE WHEN feature = 'recency' THEN r.v ELSE recency END, 0) AS seen,
               CASE WHEN feature = 'frequency' THEN f.v ELSE frequency END AS often,
               greatest(CASE WHEN feature = 'monetary' THEN m.v ELSE monetary END, 0) AS value
        FROM takers t JOIN r ON r.i = t.i JOIN f ON f.i = t.i JOIN m ON m.i = t.i
        CROSS JOIN (VALUES ('none'), ('recency'), ('frequency'), ('monetary')) w(feature))
  CROSS JOIN (VALUES (7), (15), (30)) u(h)),
pairs AS (
  SELECT a.feature, a.horizon_days, CAST(sum(a.n * b.n * CASE WHEN a.score > b.score THEN 2
           WHEN a.score = b.score THEN 1 ELSE 0 END) AS DOUBLE) AS won
  FROM cases a JOIN cases b ON a.feature = b.feature AND a.horizon_days = b.horizon_days AND a.y = 1 AND b.y = 0
  GROUP BY a.feature, a.horizon_days),
cells AS (
  SELECT feature, horizon_days, CAST(coalesce(sum(n) FILTER (y = 1), 0) AS DOUBLE) AS pos,
         CAST(coalesce(sum(n) FILTER (y = 0), 0) AS DOUBLE) AS neg,
         CAST(coalesce(sum(n) FILTER (y = 1 AND score > 0.5), 0) AS DOUBLE) AS tp,
         CAST(coalesce(sum(n) FILTER (y = 0 AND score > 0.5), 0) AS DOUBLE) AS fp,
         round(sqrt(sum(n * (score - y) * (score - y)) / sum(n)), 9) AS rmse
  FROM cases GROUP BY feature, horizon_days),
metrics AS (
  SELECT c.feature, c.horizon_days, CASE WHEN pos > 0 AND neg > 0 THEN won / (2 * pos * neg) END AS auc,
         CASE WHEN pos + fp > 0 THEN 2 * tp / (tp + fp + pos) ELSE 0 END AS f1, rmse
  FROM cells c LEFT JOIN pairs p ON p.feature = c.feature AND p.horizon_days = c.horizon_days)
SELECT x.horizon_days, x.feature, x.auc, w.auc - x.auc AS auc_drop, w.f1 - x.f1 AS f1_drop,
       round(x.rmse - w.rmse, 9) AS rmse_rise
FROM metrics x JOIN metrics w ON w.horizon_days = x.horizon_days AND w.feature = 'none'
WHERE x.feature <> 'none'
""",
    "scored_top_customers": _SEGMENTS + GAPS + """
, best AS (
  SELECT l.fk_contact, CAST(CAST('0x' || substr(md5(l.fk_contact || ':15'), 1, 8) AS BIGINT) % 100
                            AS DOUBLE) / 100 AS prob_15, days_until_next_purchase
  FROM labels l JOIN rfm ON rfm.fk_contact = l.fk_contact
  ORDER BY prob_15 DESC, l.fk_contact, days_until_next_purchase LIMIT 10)
SELECT b.fk_contact, prob_15, Segment, recency, frequency, monetary
FROM best b JOIN segments s ON s.fk_contact = b.fk_contact
""",
    "scored_contact_plan": _SEGMENTS + WEEKDAYS + _BUSIEST + f"""
, scores AS (
  SELECT fk_contact, Segment, recency, frequency, monetary,
         {", ".join(f"CAST(CAST('0x' || substr(md5(fk_contact || ':{h}'), 1, 8) AS BIGINT) % 100 AS DOUBLE) / 100 AS prob_{h}" for h in (7, 15, 30))}
  FROM segments),
best AS (SELECT *, greatest(prob_7, prob_15, prob_30) AS best_probability FROM scores),
slot AS (SELECT day_pt AS contact_day, hour AS contact_hour
         FROM by_both b JOIN weekdays w ON w.dow = b.dow ORDER BY n DESC, b.dow, hour LIMIT 1)
SELECT b.*, {", ".join(f"CASE WHEN prob_{h} > 0.6 THEN 'green' WHEN prob_{h} > 0.3 THEN 'orange' ELSE 'red' END AS band_{h}" for h in (7, 15, 30))},
       CAST(CASE best_probability WHEN prob_7 THEN 7 WHEN prob_15 THEN 15 ELSE 30 END AS INT)
         AS best_window_days, contact_day, contact_hour,
       CASE WHEN best_probability > 0.7 THEN {_quoted(STRATEGY_ABOVE_070)}
            WHEN best_probability > 0.4 THEN {_quoted(STRATEGY_ABOVE_040)}
            ELSE {_quoted(STRATEGY_OTHERWISE)} END AS strategy
FROM best b CROSS JOIN slot
""",
    "scored_routes": _ROUTES + RFM.format(as_of=AS_OF) + """
SELECT * FROM (
  SELECT fk_contact, CAST(row_number() OVER (PARTITION BY fk_contact ORDER BY probability DESC, route) AS INT)
           AS position, route, probability
  FROM (SELECT rfm.fk_contact, route,
               CAST(CAST('0x' || substr(md5(rfm.fk_contact || ':' || route), 1, 8) AS BIGINT) % 100
                    AS DOUBLE) / 100 AS probability
        FROM rfm CROSS JOIN top_routes))
WHERE position <= 3
""",
    "guessed_route_metrics": _ROUTES + """
, guesses AS (
  SELECT route, route_encoded = CAST(floor(CAST(CAST('0x' || substr(md5(fk_contact || ':route'), 1, 8)
           AS BIGINT) % 100 AS DOUBLE) / 100 * 10) AS BIGINT) AS hit,
         CAST('0x' || substr(md5(fk_contact), 1, 8) AS BIGINT) % 100 >= 80 AS test
  FROM route_features),
one AS (
  SELECT count(*) FILTER (test AND hit) / CAST(nullif(count(*) FILTER (test), 0) AS DOUBLE) AS accuracy,
         count(DISTINCT route) AS classes, count(*) AS customers,
         count(*) FILTER (test) AS test_rows FROM guesses)
SELECT *, CAST(1 AS DOUBLE) / classes AS baseline, accuracy / (CAST(1 AS DOUBLE) / classes) AS lift,
       (accuracy - CAST(1 AS DOUBLE) / classes) * 100 AS points_above, customers >= 50 AS enough_data
FROM one
""",
    "route_transitions": _P + CHAIN + """
SELECT prev1 AS previous_route, route, count(*) AS transitions,
       CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER (PARTITION BY prev1) AS DOUBLE) AS share
FROM chain WHERE prev1 IS NOT NULL GROUP BY prev1, route
""",
    "next_route_markov": _P + CHAIN + CONTEXTS.format(chain="chain") + """
SELECT fk_contact, c.route AS last_route, c.prev1 AS route_before_last,
       CAST(CASE WHEN r2 IS NOT NULL THEN 2 WHEN r1 IS NOT NULL THEN 1 ELSE 0 END AS INT) AS context_length,
       coalesce(r2, r1, r0) AS next_route, coalesce(s2, s1, s0) AS probability
FROM chain c
LEFT JOIN best2 b ON b.prev2 = c.prev1 AND b.prev1 = c.route AND b.total >= 5
LEFT JOIN best1 a ON a.prev1 = c.route AND a.total >= 5 CROSS JOIN best0
WHERE is_last
""",
    "next_route_markov_metrics": _P + CHAIN + """,
sides AS (SELECT *, CAST('0x' || substr(md5(fk_contact), 1, 8) AS BIGINT) % 100 < 80 AS training FROM chain),
known AS (SELECT * FROM sides WHERE training)
""" + CONTEXTS.format(chain="known") + """
SELECT count(*) AS customers,
       CAST(count(*) FILTER (c.route = coalesce(r2, r1, r0)) AS DOUBLE) / count(*) AS accuracy,
       CAST(count(*) FILTER (c.route = r0) AS DOUBLE) / count(*) AS popular_accuracy,
       count(*) FILTER (r2 IS NOT NULL) AS by_two_routes,
       count(*) FILTER (r2 IS NULL AND r1 IS NOT NULL) AS by_one_route
FROM sides c
LEFT JOIN best2 b ON b.prev2 = c.prev2 AND b.prev1 = c.prev1 AND b.total >= 5
LEFT JOIN best1 a ON a.prev1 = c.prev1 AND a.total >= 5 CROSS JOIN best0
WHERE is_last AND NOT training
""",
    "asked_customers_plan": _RFM + CHAIN + CONTEXTS.format(chain="chain") + f""",
scores AS (
  SELECT fk_contact,
         {", ".join(f"CAST(CAST('0x' || substr(md5(fk_contact || ':{h}'), 1, 8) AS BIGINT) % 100 AS DOUBLE) / 100 AS prob_{h}" for h in (7, 15, 30))}
  FROM rfm),
best AS (SELECT *, greatest(prob_7, prob_15, prob_30) AS chance FROM scores),
places AS (
  SELECT fk_contact, coalesce(r2, r1, r0) AS next_route, coalesce(s2, s1, s0) AS probability
  FROM chain c
  LEFT JOIN best2 b ON b.prev2 = c.prev1 AND b.prev1 = c.route AND b.total >= 5
  LEFT JOIN best1 a ON a.prev1 = c.route AND a.total >= 5 CROSS JOIN best0
  WHERE is_last)
SELECT CAST(c_custkey AS STRING) AS fk_contact, b.fk_contact IS NOT NULL AS known,
       CAST(CASE chance WHEN prob_7 THEN 7 WHEN prob_15 THEN 15 WHEN prob_30 THEN 30 END AS INT) AS best_window_days,
       chance AS window_probability, next_route, probability AS route_probability,
       chance * probability AS joint_probability
FROM customer LEFT JOIN best b ON b.fk_contact = CAST(c_custkey AS STRING)
LEFT JOIN places p ON p.fk_contact = CAST(c_custkey AS STRING)
""",
    "scored_days_metrics": _RFM + GAPS + """,
guesses AS (
  SELECT days_until_next_purchase AS days, purchases AS n,
         CAST(CAST('0x' || substr(md5(l.fk_contact || ':days'), 1, 8) AS BIGINT) % 100 AS DOUBLE) / 100 * 100 AS guess,
         CAST('0x' || substr(md5(l.fk_contact), 1, 8) AS BIGINT) % 100 < 80 AS training
  FROM labels l JOIN rfm ON rfm.fk_contact = l.fk_contact),
mean AS (
  SELECT CAST(sum(days * n) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS mean_days FROM guesses WHERE training)
SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS test_rows,
       round(sqrt(sum(n * (guess - days) * (guess - days)) / CAST(sum(n) AS DOUBLE)), 6) AS rmse,
       round(sum(n * abs(guess - days)) / CAST(sum(n) AS DOUBLE), 6) AS mae,
       round(sqrt(sum(n * (mean_days - days) * (mean_days - days)) / CAST(sum(n) AS DOUBLE)), 6) AS rmse_of_mean,
       round(sum(n * abs(mean_days - days)) / CAST(sum(n) AS DOUBLE), 6) AS mae_of_mean
FROM guesses CROSS JOIN mean WHERE NOT training
""",
    "scored_cluster_profile": _RFM + """,
logs AS (
  SELECT fk_contact, recency, frequency, monetary, ln(1 + greatest(recency, 0)) AS a,
         ln(1 + greatest(frequency, 0)) AS b, ln(1 + greatest(monetary, 0)) AS c,
         CAST(floor(CAST(CAST('0x' || substr(md5(fk_contact || ':cluster'), 1, 8) AS BIGINT) % 100 AS DOUBLE)
              / 100 * 4) AS INT) AS cluster
  FROM rfm),
points AS (
  SELECT *, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS x, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS y,
         (c - avg(c) OVER ()) / stddev_pop(c) OVER () AS z FROM logs),
pairs AS (
  SELECT p.fk_contact, p.cluster, q.cluster AS other,
         avg((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2) FILTER (p.fk_contact <> q.fk_contact) AS far
  FROM points p CROSS JOIN points q GROUP BY ALL),
each AS (
  SELECT fk_contact, cluster, max(far) FILTER (other = cluster) AS inside, min(far) FILTER (other <> cluster) AS near
  FROM pairs GROUP BY ALL)
SELECT e.cluster, count(*) AS customers, round(avg(recency), 6) AS mean_recency,
       round(avg(frequency), 6) AS mean_frequency, round(avg(monetary), 6) AS mean_monetary,
       round(avg((near - inside) / greatest(near, inside)), 6) AS silhouette
FROM each e JOIN points p ON p.fk_contact = e.fk_contact GROUP BY e.cluster
""",
    "held_out_routes": _P + CHAIN + HELD_OUT + "SELECT * FROM held",
    "route_history": _P + CHAIN + HELD_OUT + """
SELECT fk_contact, route, count(*) AS purchases FROM kept GROUP BY ALL
""",
    "popular_route_metrics": _P + CHAIN + HELD_OUT + """,
best AS (
  SELECT route, row_number() OVER (ORDER BY count(DISTINCT fk_contact) DESC, route) AS position
  FROM kept GROUP BY route QUALIFY position <= 3)
""" + _ranking_metrics("best b ON b.route = h.route"),
    "scored_route_ranking_metrics": _ROUTES + RFM.format(as_of=AS_OF) + CHAIN + HELD_OUT + """,
places AS (
  SELECT fk_contact, route, row_number() OVER (PARTITION BY fk_contact ORDER BY probability DESC, route) AS position
  FROM (SELECT rfm.fk_contact, route,
               CAST('0x' || substr(md5(rfm.fk_contact || ':' || route), 1, 8) AS BIGINT) % 100 AS probability
        FROM rfm CROSS JOIN top_routes)
  QUALIFY position <= 3)
""" + _ranking_metrics("places r ON r.fk_contact = h.fk_contact AND r.route = h.route"),
    "waits_by_segment": _SEGMENTS + GAPS + WAITS + """
SELECT Segment, CAST(days AS INT) AS days, bought, waiting, CAST(at_risk AS BIGINT) AS at_risk,
       round(survival, 6) AS survival FROM curve
""",
    "days_to_next_baseline": _SEGMENTS + GAPS + WAITS + """
SELECT Segment, CAST(sum(bought) AS BIGINT) AS bought, CAST(sum(waiting) AS BIGINT) AS waiting,
       CAST(min(days) FILTER (survival <= 0.5 + 1e-9) AS INT) AS median_days, """ + ", ".join(
        f"round(1 - coalesce(min(survival) FILTER (days <= {h}), 1), 6) AS chance_{h}_days" for h in (7, 15, 30)
    ) + """
FROM curve GROUP BY Segment
""",
    "events_kpi_overview": _EVENTS + _KPI,
    "events_weekday_hour_counts": _EVENTS + _DOW_HOUR,
    "events_rfm_segments": _EVENTS + RFM.format(as_of=EVENTS_AS_OF) + QUARTILES
    + "SELECT * FROM segments",
    "events_interval_stats": _EVENTS + GAPS + _interval_stats("since > 0"),
    "events_next_purchase_labels": _EVENTS + GAPS + "SELECT * FROM labels",
}
