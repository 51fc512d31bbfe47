"""Queries over label windows, masks and margins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.numeric import rounded
from tidewatch.operators import masks as G
from tidewatch.operators.layout import IDX, KEYS, LEN, SERIES, home, runs, with_halo
from tidewatch.plans.catalog_basic import out
from tidewatch.plans.registry import query
from tidewatch.plans.sql import EV, r, with_
from tidewatch.sources import files as A
from tidewatch.sources.tables import event_series, table

# label windows follow from the data: two hours after every high value, and for odd events
# an interval that holds no row
HIGH = 250
WINDOWS_SQL = f"""win AS (
  SELECT event_type AS series_id, event_id AS window_id,
    CASE WHEN event_id % 2 = 0 THEN ts ELSE ts + INTERVAL 1 MILLISECOND END AS start_ts,
    CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL 2 HOUR ELSE ts + INTERVAL 2 MILLISECOND END AS end_ts
  FROM events WHERE value > {HIGH})"""
POS_SQL = """pos AS (
  SELECT w.series_id, window_id, any_value(n) AS n,
    least(count(*) FILTER (WHERE ts < start_ts), any_value(n) - 1) AS s,
    least(count(*) FILTER (WHERE ts <= end_ts) - 1, any_value(n) - 1) AS e
  FROM win w JOIN ev USING (series_id) GROUP BY 1, 2),
rng AS (SELECT series_id, window_id, n, s AS start_, greatest(s, e) AS end_ FROM pos)"""


def label_windows(spark, sf):
    odd = F.col("event_id") % 2 == 1
    return table(spark, sf, "events").filter(F.col("value") > HIGH).select(
        F.col("event_type").alias(SERIES), F.col("event_id").alias("window_id"),
        F.when(odd, F.col("ts") + F.expr("INTERVAL 1 MILLISECOND")).otherwise(F.col("ts")).alias("start_ts"),
        F.when(odd, F.col("ts") + F.expr("INTERVAL 2 MILLISECOND")).otherwise(F.col("ts") + F.expr("INTERVAL 2 HOUR")).alias("end_ts"),
    )


@query("category_scan", with_(EV, WINDOWS_SQL) + "SELECT 'web/' || series_id AS series_id, idx, f0 FROM ev "
       "WHERE series_id IN ('click', 'view') AND EXISTS (SELECT 1 FROM win WHERE win.series_id = ev.series_id)")
def category_scan(spark, sf):
    def named(df):
        group = F.when(F.col(SERIES).isin("click", "view"), "web/").otherwise("app/")
        return df.withColumn(SERIES, F.concat(group, F.col(SERIES)))

    return A.in_category(named(event_series(spark, sf)), named(label_windows(spark, sf)), "web").select(SERIES, IDX, "f0")


@query("window_json_scan", "SELECT user_id::VARCHAR AS series_id, count(*) AS windows, "
       "CAST(epoch_us(min(date_trunc('second', ts))) AS BIGINT) AS first_start, CAST(epoch_us(max(date_trunc('second', ts))) AS BIGINT) AS last_end FROM events WHERE value > 150 GROUP BY 1")
def window_json_scan(spark, sf):
    """Windows written as JSON maps, one per user, and read back by the parser."""
    high = table(spark, sf, "events").filter("value > 150").withColumn("t", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    texts = high.groupBy(F.col("user_id").cast("string").alias("u")).agg(
        F.collect_list(F.array("t", "t")).alias("w")
    ).select(F.to_json(F.create_map("u", "w")).alias("value"))
    secs = F.to_timestamp_ntz(F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss"))
    micros = (F.unix_date(F.to_date("start_ts")).cast("long") * 86400 + F.hour("start_ts") * 3600 + F.minute("start_ts") * 60 + F.second("start_ts")) * F.lit(1000000).cast("long")
    return A.parse_windows(texts).groupBy(SERIES).agg(
        F.count("start_ts").alias("windows"), F.min(micros).alias("first_start"), F.max(micros).alias("last_end"))


@query("window_positions", with_(EV, WINDOWS_SQL, POS_SQL) + 'SELECT series_id, window_id, start_ AS "start", end_ AS "end" FROM rng')
def window_positions(spark, sf):
    return G.window_positions(event_series(spark, sf), label_windows(spark, sf)).select(SERIES, "window_id", "start", "end")


@query("anomaly_mask", with_(EV, WINDOWS_SQL, POS_SQL) + "SELECT ev.series_id, idx, CAST(EXISTS (SELECT 1 FROM rng WHERE rng.series_id = ev.series_id AND idx BETWEEN start_ AND end_) AS INTEGER) AS label FROM ev")
def anomaly_mask(spark, sf):
    df = G.anomaly_mask(event_series(spark, sf), label_windows(spark, sf))
    return df.select(SERIES, IDX, F.col("is_anomaly").cast("int").alias("label"))


MASK = "mk AS (SELECT *, f0 > 200 AS m FROM ev)"


def masked(spark, sf, high=200):
    return event_series(spark, sf).withColumn("m", F.col("f0") > high)


@query("mask_dilate", with_(EV, MASK) + "SELECT series_id, idx, CAST(bool_or(m) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS INTEGER) AS masked FROM mk")
def mask_dilate(spark, sf):
    return G.dilate(masked(spark, sf), "m", 5).select(SERIES, IDX, F.col("masked").cast("int").alias("masked"))


RUNS_SQL = """mruns AS (
  SELECT series_id, min(idx) AS s, max(idx) AS e, any_value(n) AS n FROM (
    SELECT series_id, idx, n, idx - row_number() OVER (PARTITION BY series_id ORDER BY idx) AS g FROM mk WHERE m)
  GROUP BY series_id, g)"""


@query("mask_runs", with_(EV, "mk AS (SELECT *, f0 > 60 AS m FROM ev)", RUNS_SQL) + 'SELECT series_id, s AS "start", e AS "end" FROM mruns')
def mask_runs(spark, sf):
    return runs(masked(spark, sf, 60), "m")


@query("local_std", with_(EV) + "SELECT series_id, idx, " + r("CASE WHEN count(*) OVER w >= 5 THEN stddev_pop(f0) OVER w END", "local_std")
       + " FROM ev WINDOW w AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)")
def local_std(spark, sf):
    df = with_halo(event_series(spark, sf), back=15, ahead=15)
    return out(home(df.withColumn("local_std", G.local_std("f0"))), "local_std")


ADAPT = """mk AS (SELECT *, f0 > 330 AS m FROM ev)""", RUNS_SQL, """
loc AS (SELECT series_id, idx, CASE WHEN count(*) OVER w >= 5 THEN stddev_pop(f0) OVER w ELSE 'inf'::DOUBLE END AS loc FROM ev
  WINDOW w AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)),
near AS (SELECT ev.series_id, ev.idx, ev.n, f0, EXISTS (SELECT 1 FROM mruns k WHERE k.series_id = ev.series_id AND ev.idx BETWEEN s - 60 AND e + 60) AS near FROM ev),
bs AS (SELECT series_id, any_value(n) AS n, stddev_pop(f0) FILTER (WHERE NOT near) AS sd, count(*) FILTER (WHERE NOT near) AS calm, count(*) FILTER (WHERE near) AS safe FROM near GROUP BY 1),
side AS (SELECT series_id, n, 'post' AS side, e AS edge FROM mruns UNION ALL SELECT series_id, n, 'pre', s FROM mruns),
offs AS (SELECT side.series_id, side, edge, abs(loc.idx - edge) AS off, loc <= 0.95 * sd AND abs(loc.idx - edge) >= 10 AS ok
  FROM side JOIN loc ON loc.series_id = side.series_id AND CASE WHEN side = 'post' THEN loc.idx BETWEEN edge + 1 AND edge + 60 ELSE loc.idx BETWEEN edge - 60 AND edge - 1 END
  JOIN bs ON bs.series_id = side.series_id),
mar AS (SELECT side.series_id, side.side, side.edge, coalesce(min(off) FILTER (WHERE ok), max(off), 0) AS margin,
  coalesce(min(off) FILTER (WHERE ok) - 1, max(off), 0) AS marked
  FROM side LEFT JOIN offs USING (series_id, side, edge) GROUP BY 1, 2, 3),
grown AS (SELECT series_id, edge AS s, edge + marked AS e FROM mar WHERE side = 'post' UNION ALL SELECT series_id, edge - marked, edge FROM mar WHERE side = 'pre'
  UNION ALL SELECT series_id, s - 10, e + 10 FROM mruns),
pre AS (SELECT ev.series_id, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM grown g WHERE g.series_id = ev.series_id AND idx BETWEEN g.s AND g.e)) AS c FROM ev GROUP BY 1),
tries AS (SELECT ev.series_id, m, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM mruns k WHERE k.series_id = ev.series_id AND idx BETWEEN s - m AND e + m)) / any_value(ev.n) AS share
  FROM ev, (SELECT unnest([10, 5, 0]) AS m) GROUP BY 1, 2),
mode AS (SELECT bs.*, c, calm < 100 AS fb, CASE WHEN calm < 100 THEN 10 WHEN c / n <= 0.06 THEN -1
  ELSE coalesce((SELECT max(m) FROM tries t WHERE t.series_id = bs.series_id AND share <= 0.06), 0) END AS mode FROM bs JOIN pre USING (series_id)),
fin AS (SELECT g.series_id, s, e FROM grown g JOIN mode USING (series_id) WHERE mode = -1
  UNION ALL SELECT k.series_id, s - mode, e + mode FROM mruns k JOIN mode USING (series_id) WHERE mode >= 0),
res AS (SELECT ev.series_id, idx, EXISTS (SELECT 1 FROM fin WHERE fin.series_id = ev.series_id AND idx BETWEEN s AND e) AS masked FROM ev)"""


def _adaptive(spark, sf):
    return G.adaptive_mask(masked(spark, sf, 330), "m", "f0", base_margin=10, max_margin=60, cap=0.06, ratio=0.95)


@query("mask_adaptive", with_(EV, *ADAPT) + "SELECT series_id, idx, CAST(masked AS INTEGER) AS masked FROM res")
def mask_adaptive(spark, sf):
    return _adaptive(spark, sf)[0].select(SERIES, IDX, F.col("masked").cast("int").alias("masked"))


@query("mask_exclusion_cap", with_(EV, *ADAPT, "av AS (SELECT series_id, avg(margin) FILTER (WHERE side = 'pre') AS a, avg(margin) FILTER (WHERE side = 'post') AS b FROM mar GROUP BY 1)",
       "fs AS (SELECT series_id, count(*) FILTER (WHERE masked) AS f FROM res GROUP BY 1)")
       + f"SELECT series_id, {r('CASE WHEN NOT fb THEN sd END', 'baseline_std')}, {r('CASE WHEN fb THEN 10 ELSE coalesce(a, 10) END', 'avg_margin_pre')}, "
         f"{r('CASE WHEN fb THEN 10 ELSE coalesce(b, 10) END', 'avg_margin_post')}, {r('CASE WHEN fb THEN safe / n ELSE c / n END', 'exclusion_before_cap')}, "
         f"{r('f / n', 'exclusion_final')}, CAST(CASE WHEN mode = -1 THEN 60 ELSE mode END AS INTEGER) AS margin_after_cap, fb AS fallback "
         "FROM mode JOIN fs USING (series_id) LEFT JOIN av USING (series_id)")
def mask_exclusion_cap(spark, sf):
    info = _adaptive(spark, sf)[1]
    return out(info, "baseline_std", "avg_margin_pre", "avg_margin_post", "exclusion_before_cap", "exclusion_final",
               keys=(SERIES, "margin_after_cap", "fallback"))


@query("clean_guard", "WITH u AS (SELECT user_id::VARCHAR AS series_id, count(*) AS n, count(*) FILTER (WHERE value <= 100) AS clean_rows FROM events GROUP BY 1) "
       "SELECT series_id, n, clean_rows, clean_rows >= 100 AS accepted FROM u")
def clean_guard(spark, sf):
    df = event_series(spark, sf, key="user_id").withColumn("masked", F.col("f0") > 100)
    return G.clean_counts(df)
