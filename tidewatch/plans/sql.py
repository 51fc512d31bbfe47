"""CTE texts shared by the comparison queries."""

from __future__ import annotations

EV = """ev AS (
  SELECT event_type AS series_id,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx,
         count(*) OVER (PARTITION BY event_type) AS n, ts, value AS f0
  FROM events),
evc AS (
  SELECT *, least(greatest(50, CAST(floor(n * 0.15) AS BIGINT)), n - 1) AS cal_end FROM ev),
evs AS (
  SELECT series_id, avg(f0) AS mu, stddev_pop(f0) AS sd FROM evc WHERE idx < cal_end GROUP BY 1),
evz AS (
  SELECT e.*, (f0 - mu) / (sd + 1e-10) AS z FROM evc e JOIN evs USING (series_id))"""

DAILY = """daily0 AS (
  SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS f0,
         round(sum(l_extendedprice) * 100) AS f1, round(sum(l_discount) * 100) AS f2,
         round(sum(l_tax) * 100) AS f3
  FROM lineitem GROUP BY 1, 2),
daily AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS series_id,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY day) - 1 AS idx,
         count(*) OVER (PARTITION BY l_suppkey) AS n, day, f0, f1, f2, f3
  FROM daily0),
dlong AS (
  SELECT series_id, idx, n, feature, value FROM daily
  UNPIVOT (value FOR feature IN (f0, f1, f2, f3)))"""

EMB = """emb AS (
  SELECT 'embeddings' AS series_id, row_number() OVER (ORDER BY vec_id) - 1 AS idx,
         count(*) OVER () AS n, vec_id, embedding, label
  FROM embeddings)"""

FIVE = """lagged AS (
  SELECT *, lag(f0, 1) OVER w AS l1, lag(f0, 2) OVER w AS l2 FROM ev
  WINDOW w AS (PARTITION BY series_id ORDER BY idx)),
five AS (
  SELECT series_id, idx, n, f0,
         avg(f0) OVER w AS f1,
         coalesce(stddev_samp(f0) OVER w, 0) AS f2,
         coalesce(f0 - 2 * l1 + l2, 0) AS f3,
         greatest(-1, least(1, coalesce(CASE WHEN isfinite(corr(f0, l1) OVER w) THEN corr(f0, l1) OVER w END, 0))) AS f4
  FROM lagged
  WINDOW w AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"""


def r(expr: str, name: str, places: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {places}) + 0.0 AS {name}"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
