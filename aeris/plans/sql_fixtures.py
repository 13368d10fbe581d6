"""DuckDB SQL fragments equal to the Spark fixture plans (oracle side).

Each constant is one CTE; queries chain them with ``with_(...)``.
"""

R = """r AS (SELECT CAST(l_suppkey % 10 AS BIGINT) AS station,
  CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'NO' WHEN 'AO' THEN 'NO2'
       WHEN 'NF' THEN 'O3' WHEN 'RO' THEN 'NOX as NO2' ELSE 'other' END AS pollutant,
  CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE 2 * l_quantity END AS concentration,
  l_shipdate AS ts FROM lineitem)"""
K = "k AS (SELECT * FROM r WHERE station IN (1, 2, 3))"
IMP = """imp AS (SELECT station, pollutant,
  coalesce(concentration, (SELECT avg(concentration) FROM k)) AS concentration, ts FROM k)"""
D = """d AS (SELECT CAST(ts AS DATE) AS date,
  avg(CASE WHEN pollutant = 'NO' THEN concentration END) AS avg_no,
  avg(CASE WHEN pollutant = 'NO2' THEN concentration END) AS avg_no2,
  avg(CASE WHEN pollutant = 'O3' THEN concentration END) AS avg_o3,
  coalesce(avg(CASE WHEN pollutant = 'NOX as NO2' THEN concentration END), 0.0) AS avg_nox
  FROM imp WHERE ts IS NOT NULL GROUP BY CAST(ts AS DATE))"""
W = """w AS (SELECT CAST(o_orderdate AS DATE) AS date,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 1000000.0 AS temp,
  max(o_totalprice) / 10000 AS humidity, min(o_totalprice) / 10000 AS windspeed,
  count(*) AS n FROM orders GROUP BY CAST(o_orderdate AS DATE))"""
M = """m AS (SELECT coalesce(d.date, w.date) AS date, d.avg_no, d.avg_no2, d.avg_o3, d.avg_nox,
  w.temp, w.humidity, w.windspeed, w.n FROM d FULL OUTER JOIN w ON d.date = w.date)"""
_FF = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
F = ("f AS (SELECT date, " + ", ".join(
    f"last_value({c} IGNORE NULLS) OVER (ORDER BY date {_FF}) AS {c}"
    for c in ["avg_no", "avg_no2", "avg_o3", "avg_nox", "temp", "humidity", "windspeed", "n"])
    + " FROM m)")
YRS = "yrs AS (SELECT DISTINCT CAST(year(date) AS INTEGER) AS y FROM f)"
EAS = """eas AS (SELECT y, make_date(y, (h + l - 7 * mm + 114) // 31, (h + l - 7 * mm + 114) % 31 + 1) AS easter
  FROM (SELECT y, h, l, (a + 11 * h + 22 * l) // 451 AS mm
  FROM (SELECT y, a, h, (32 + 2 * e + 2 * i - h - kk) % 7 AS l
  FROM (SELECT y, a, e, i, kk, (19 * a + b - dd - g + 15) % 30 AS h
  FROM (SELECT y, y % 19 AS a, y // 100 AS b, (y // 100) // 4 AS dd, (y // 100) % 4 AS e,
        ((y // 100) - ((y // 100) + 8) // 25 + 1) // 3 AS g, (y % 100) // 4 AS i, (y % 100) % 4 AS kk
        FROM yrs)))))"""
HOL = """hol AS (SELECT DISTINCT hd FROM (
  SELECT make_date(y, 1, 1) AS hd FROM yrs
  UNION ALL SELECT make_date(y, 12, 25) FROM yrs
  UNION ALL SELECT make_date(y, 12, 26) FROM yrs
  UNION ALL SELECT easter FROM eas
  UNION ALL SELECT easter + 1 FROM eas
  UNION ALL SELECT easter + 39 FROM eas
  UNION ALL SELECT easter + 49 FROM eas
  UNION ALL SELECT easter + 50 FROM eas
  UNION ALL SELECT CASE WHEN dayofweek(rb) = 0 THEN rb - 1 ELSE rb END FROM
     (SELECT CASE WHEN y >= 2014 THEN make_date(y, 4, 27) ELSE make_date(y, 4, 30) END AS rb FROM yrs)
  UNION ALL SELECT make_date(y, 5, 5) FROM yrs WHERE y % 5 = 0))"""
L = """l AS (SELECT f.*, strftime(f.date, '%B') AS month, (hol.hd IS NOT NULL) AS holiday,
  strftime(f.date, '%A') AS weekday,
  coalesce(f.avg_o3 > 80 AND strftime(f.date, '%B') IN ('May', 'June', 'July', 'August', 'September'), false)
    AS high_o3_warm_months,
  CASE WHEN (f.avg_no2 > 20 AND f.avg_o3 < 39.98) OR (f.avg_no2 < 10.23 AND f.avg_o3 > 63.39)
       THEN 1 ELSE 0 END AS inverse_no2_o3,
  abs(f.avg_no2 - f.avg_o3) AS relative_difference,
  CAST(dayofyear(f.date) AS INTEGER) AS day_of_year,
  sin(2 * pi() * 1 * dayofyear(f.date) / 365.0) AS sin_1,
  cos(2 * pi() * 1 * dayofyear(f.date) / 365.0) AS cos_1,
  sin(2 * pi() * 2 * dayofyear(f.date) / 365.0) AS sin_2,
  cos(2 * pi() * 2 * dayofyear(f.date) / 365.0) AS cos_2
  FROM f LEFT JOIN hol ON f.date = hol.hd)"""
# row position and 70/15/15 split of the filled daily table
S = """s AS (SELECT *, CAST(row_number() OVER (ORDER BY date) - 1 AS BIGINT) AS row_id,
  count(*) OVER () AS n_rows FROM f)"""
SP = """sp AS (SELECT * EXCLUDE (n_rows), CASE
  WHEN row_id < CAST(floor(n_rows * 0.7) AS BIGINT) THEN 'train'
  WHEN row_id < CAST(floor(n_rows * 0.7) AS BIGINT) + CAST(floor(n_rows * 0.15) AS BIGINT) THEN 'val'
  ELSE 'test' END AS split FROM s)"""
EV = """ev AS (SELECT event_id, user_id AS station, event_type AS pollutant,
  value AS concentration, ts FROM events)"""

BASE = [R, K, IMP, D, W, M, F]
LABELLED = BASE + [YRS, EAS, HOL, L]


def with_(ctes, select: str) -> str:
    recursive = "RECURSIVE " if any(c.startswith("walk_") for c in ctes) else ""
    return f"WITH {recursive}" + ",\n".join(ctes) + "\n" + select


def rd(expr: str) -> str:
    """Half-up rounding to 6 decimals, written identically in both engines."""
    return f"floor(({expr}) * 1000000.0 + 0.5) / 1000000.0"


def rnd(cols) -> str:
    return ", ".join(f"{rd(c)} AS {c}" for c in cols)

# encoded labels: names -> numbers, booleans -> 0/1
E = """e AS (SELECT date, avg_no, avg_no2, avg_o3, avg_nox, temp, humidity, windspeed, n,
  CAST(month(date) AS INTEGER) AS month, CAST(holiday AS INTEGER) AS holiday,
  CAST(isodow(date) AS INTEGER) AS weekday, CAST(high_o3_warm_months AS INTEGER) AS high_o3_warm_months,
  inverse_no2_o3, relative_difference, day_of_year, sin_1, cos_1, sin_2, cos_2 FROM l)"""
ENCODED = LABELLED + [E]
# 60/20/20 re-split with a 2 % gap and the unseen tail
RS = """rs AS (SELECT * EXCLUDE (t, v, g, u, n_rows), CASE WHEN row_id < t THEN 'train'
  WHEN row_id >= t + g AND row_id < v THEN 'val' WHEN row_id >= v + g THEN 'test' ELSE 'gap' END AS split,
  row_id >= u AS unseen FROM (SELECT *, CAST(floor(n_rows * 0.6) AS BIGINT) AS t,
  CAST(floor(n_rows * 0.8) AS BIGINT) AS v, CAST(floor(n_rows * 0.02) AS BIGINT) AS g,
  CAST(floor(n_rows * 0.95) AS BIGINT) AS u FROM s))"""


def union_all(selects) -> str:
    return "\nUNION ALL ".join(selects)
