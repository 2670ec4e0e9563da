"""Queries of the weather and model operators, with their SQL twins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitecast import params as P
from sitecast.functions import columns as C
from sitecast.operators import model as M
from sitecast.operators import weather as W
from sitecast.plans.fixtures import ANCHORS_SQL, DAY0, EPOCH, EPOCH_SQL, OBS_SQL, SPLIT, anchors, obs, r6, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
BASE = f"WITH {OBS_SQL}, {ANCHORS_SQL}"
NORM_SAMPLES = 400  # the synthetic record is a month long
ROLLING = {"min_samples": 200, "window_days": 20, "step_days": 1}
ROLLING_SQL = f"""nm AS (SELECT a.site_id, a.at, count(o.ts) AS n, CASE WHEN count(o.ts) >= {ROLLING["min_samples"]} THEN quantile_cont(o.pressure_msl, 0.5) END AS norm
  FROM anchors a LEFT JOIN obs o ON a.site_id = o.site_id AND NOT o.is_forecast AND o.ts < (a.at // 86400) * 86400 AND o.ts >= (a.at // 86400 - {ROLLING["window_days"]}) * 86400 GROUP BY 1, 2)"""
TODAY = DAY0 + 21


def query(oracle: str | None = None):
    """Register the function under its name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = re.sub(r"\bat\b", '"at"', oracle)  # a keyword there
        return f

    return add


def _deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as re-delivered hours of five sources."""
    return table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("site_id"), F.col("event_type").alias("source"), F.expr(EPOCH).alias("ts"), F.col("event_id").alias("delivery"), (F.expr(EPOCH) + F.expr("minute(ts) * 60L")).alias("fetched_at"), F.expr("case when user_id % 7 <> 0 then 1011 + value / 20 end").alias("pressure_msl"), F.expr("case when user_id % 3 <> 0 then 15 + value / 100 end").alias("temp_c")).withColumn("is_forecast", F.col("ts") > F.col("fetched_at") - 1800)


DELIVERIES = f"""deliveries AS (SELECT user_id % 5 AS site_id, event_type AS source, {EPOCH_SQL} AS ts, event_id AS delivery, {EPOCH_SQL} + minute(ts) * 60 AS fetched_at,
  CASE WHEN user_id % 7 <> 0 THEN 1011 + value / 20 END AS pressure_msl, CASE WHEN user_id % 3 <> 0 THEN 15 + value / 100 END AS temp_c, {EPOCH_SQL} > {EPOCH_SQL} + minute(ts) * 60 - 1800 AS is_forecast FROM events)"""


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("event_type = 'signup'")
    start = F.expr(EPOCH) + F.expr("minute(ts) * 60L")
    return events.select(F.col("event_id").alias("gap_id"), (F.col("user_id") % 5).alias("site_id"), start.alias("from_ts"), (start + (F.col("user_id") % 6) * 3600).alias("to_ts"), (F.col("event_id") % 3 == 0).alias("resolved"))


GAPS = f"""gaps AS (SELECT event_id AS gap_id, user_id % 5 AS site_id, {EPOCH_SQL} + minute(ts) * 60 AS from_ts, {EPOCH_SQL} + minute(ts) * 60 + (user_id % 6) * 3600 AS to_ts, event_id % 3 = 0 AS resolved FROM events WHERE event_type = 'signup')"""
GAP_HOURS = "gh AS (SELECT gap_id, site_id, unnest(range(from_ts // 3600, to_ts // 3600 + 1)) * 3600 AS ts FROM gaps)"


@query(f"{BASE} SELECT site_id, ts, pressure_msl FROM (SELECT site_id, ts, round(pressure_msl, 6) AS pressure_msl FROM obs) WHERE ts BETWEEN {SPLIT} - 72 * 3600 AND {SPLIT} + 8 * 86400")
def flt1_pressure_series(spark, sf_dir):
    near = F.col("ts").between(SPLIT - 72 * P.HOUR, SPLIT + 8 * P.DAY)
    return r6(obs(spark, sf_dir).where(near & F.col("pressure_msl").isNotNull()).select("site_id", "ts", "pressure_msl"))


@query(f"""{BASE}, spread AS (SELECT site_id, at, h, at - h * 3600 AS t FROM anchors CROSS JOIN (VALUES (0), (6), (24)) o(h)),
  found AS (SELECT s.site_id, s.at, s.h, o.pressure_msl AS v FROM spread s ASOF LEFT JOIN obs o ON s.site_id = o.site_id AND s.t >= o.ts)
  SELECT site_id, at, round(max(v) FILTER (h = 0), 6) AS v_0, round(max(v) FILTER (h = 6), 6) AS v_6, round(max(v) FILTER (h = 24), 6) AS v_24 FROM found GROUP BY 1, 2""")
def jn1_asof_backward(spark, sf_dir):
    return r6(W.asof_offsets(anchors(spark, sf_dir), obs(spark, sf_dir), "pressure_msl", (0, 6, 24)))


@query(f"""{BASE}, m AS (SELECT site_id, at + 1800 AS at FROM anchors), j AS (SELECT m.site_id, m.at, o.ts, o.temp_c, row_number() OVER (PARTITION BY m.site_id, m.at ORDER BY abs(o.ts - m.at), o.ts) AS r
  FROM m JOIN obs o ON m.site_id = o.site_id AND abs(o.ts - m.at) <= 10800) SELECT site_id, at, ts, round(temp_c, 6) AS temp_c, CAST(floor((at - ts) / 60) AS bigint) AS age_min FROM j WHERE r = 1""")
def jn2_nearest_reading(spark, sf_dir):
    return r6(W.nearest_within(anchors(spark, sf_dir).withColumn("at", F.col("at") + 1800), obs(spark, sf_dir), "temp_c"))


@query(f"""{BASE}, {GAPS}, {GAP_HOURS}, {DELIVERIES}, d AS (SELECT DISTINCT site_id, ts, source FROM deliveries)
  SELECT gap_id, site_id, count(DISTINCT gh.ts) AS hours, count(DISTINCT CASE WHEN d.source IS NOT NULL THEN gh.ts END) AS present, coalesce(array_to_string(list_sort(list_distinct(list(d.source) FILTER (d.source IS NOT NULL))), ','), '') AS covered_by,
  count(DISTINCT gh.ts) - count(DISTINCT CASE WHEN d.source IS NOT NULL THEN gh.ts END) AS missing, count(DISTINCT gh.ts) = count(DISTINCT CASE WHEN d.source IS NOT NULL THEN gh.ts END) AS complete
  FROM gh LEFT JOIN d USING (site_id, ts) GROUP BY 1, 2""")
def jn3_gap_hours(spark, sf_dir):
    return W.gap_hours(_gaps(spark, sf_dir), _deliveries(spark, sf_dir)).withColumn("covered_by", F.array_join("covered_by", ","))


@query(f"{BASE}, {GAPS}, {GAP_HOURS} SELECT DISTINCT site_id, ts FROM gh WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.site_id = gh.site_id AND o.ts = gh.ts)")
def set2_missing_hours(spark, sf_dir):
    return W.missing_hours(_gaps(spark, sf_dir), obs(spark, sf_dir))


SUMMARY = "count(o.ts) AS n, round(min(o.temp_c), 6) AS lowest, round(max(o.temp_c), 6) AS highest, round(avg(o.temp_c), 6) AS mean, round(max(o.temp_c) - min(o.temp_c), 6) AS span"


@query(f"""{BASE} SELECT a.site_id, a.at, {SUMMARY}, round(least(1.0, count(o.ts) / 72.0), 6) AS coverage, count(o.ts) >= 2 AND least(1.0, count(o.ts) / 72.0) >= 0.8 AS available
  FROM anchors a LEFT JOIN obs o ON a.site_id = o.site_id AND o.ts BETWEEN a.at - 72 * 3600 AND a.at GROUP BY 1, 2""")
def agg1_lookback_summary(spark, sf_dir):
    return r6(W.summarise(anchors(spark, sf_dir), obs(spark, sf_dir), "temp_c", 72, P.STABILITY["min_coverage"]))


@query(f"{BASE} SELECT a.site_id, a.at, count(o.ts) AS n, round(CASE WHEN count(o.ts) >= 2 THEN stddev_pop(o.pressure_msl) END, 6) AS deviation FROM anchors a LEFT JOIN obs o ON a.site_id = o.site_id AND o.ts BETWEEN a.at - 48 * 3600 AND a.at GROUP BY 1, 2")
def agg2_pressure_deviation(spark, sf_dir):
    return r6(W.deviation(anchors(spark, sf_dir), obs(spark, sf_dir), "pressure_msl"))


@query(f"{BASE} SELECT site_id, count(*) AS n, round(CASE WHEN count(*) >= {NORM_SAMPLES} THEN quantile_cont(pressure_msl, 0.5) END, 6) AS norm FROM obs GROUP BY 1")
def agg3_pressure_norm(spark, sf_dir):
    return r6(W.norm(obs(spark, sf_dir), "pressure_msl", NORM_SAMPLES))


def _norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = W.value_counts(obs(spark, sf_dir).where("not is_forecast"), "pressure_msl", ROLLING["step_days"])
    return W.rolling_norm(anchors(spark, sf_dir), counts, ROLLING)


@query(f"{BASE}, {ROLLING_SQL} SELECT site_id, at, n, round(norm, 6) AS norm FROM nm")
def agg3_rolling_norm(spark, sf_dir):
    """The norm that was known at each past instant, from observed hours before it."""
    return r6(_norms(spark, sf_dir))


SPANS = """spans AS (SELECT a.site_id, a.at, b.block, CASE WHEN count(o.ts) >= 2 THEN max(o.pressure_msl) - min(o.pressure_msl) END AS span_p, CASE WHEN count(o.ts) >= 2 THEN max(o.temp_c) - min(o.temp_c) END AS span_t
  FROM anchors a CROSS JOIN range(0, 7) b(block) LEFT JOIN obs o ON a.site_id = o.site_id AND o.ts BETWEEN a.at - (b.block + 1) * 86400 AND a.at - b.block * 86400 GROUP BY 1, 2, 3)"""
STREAK = "streak AS (SELECT site_id, at, coalesce(min(block) FILTER (NOT coalesce(span_p <= 4.0 AND span_t <= 8.0, false)), 7) AS stable_days FROM spans GROUP BY 1, 2)"


@query(f"{BASE}, {SPANS} SELECT site_id, at, CAST(block AS integer) AS block, round(span_p, 6) AS span_p, round(span_t, 6) AS span_t FROM spans")
def agg4_daily_spans(spark, sf_dir):
    return r6(W.daily_spans(anchors(spark, sf_dir), obs(spark, sf_dir)))


@query(f"{BASE}, {SPANS}, {STREAK} SELECT * FROM streak")
def agg5_stable_streak(spark, sf_dir):
    return W.stable_streak(W.daily_spans(anchors(spark, sf_dir), obs(spark, sf_dir)))


DIRECTION = "CASE WHEN abs(sum(sin(radians(wind_dir)))) > 1e-9 OR abs(sum(cos(radians(wind_dir)))) > 1e-9 THEN (round_even(degrees(atan2(sum(sin(radians(wind_dir))), sum(cos(radians(wind_dir))))), 0) + 360) % 360 END"


@query(f"""{BASE}, d AS (SELECT site_id, (ts + 3600) // 86400 AS day, count(*) AS n_hours, min(temp_c) AS temp_min, max(temp_c) AS temp_max, max(wind_ms) AS wind_max, avg(pressure_msl) AS pressure, {DIRECTION} AS wind_dir
  FROM obs WHERE NOT is_forecast GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY day DESC) AS r FROM d)
  SELECT site_id, day, n_hours, round(temp_min, 6) AS temp_min, round(temp_max, 6) AS temp_max, wind_max, round(pressure, 6) AS pressure, wind_dir, n_hours < 20 AS is_partial,
  CASE WHEN wind_dir IS NOT NULL THEN ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][CAST(floor(((wind_dir + 22.5) % 360) / 45) AS integer) + 1] END AS wind_compass FROM r WHERE r <= 5""")
def agg6_recent_days(spark, sf_dir):
    return r6(W.recent_days(obs(spark, sf_dir)))


FORECAST = f"fd AS (SELECT site_id, (ts + 3600) // 86400 AS day, count(*) AS n_hours, min(temp_c) AS temp_min, max(temp_c) AS temp_max, max(wind_ms) AS wind_max, avg(pressure_msl) AS pressure FROM obs WHERE is_forecast AND ts <= {SPLIT} + 7 * 86400 GROUP BY 1, 2)"


@query(f"{BASE}, {FORECAST} SELECT site_id, day, n_hours, round(temp_min, 6) AS temp_min, round(temp_max, 6) AS temp_max, wind_max, round(pressure, 6) AS pressure FROM fd")
def agg7_forecast_days(spark, sf_dir):
    return r6(W.forecast_days(obs(spark, sf_dir), SPLIT))


@query(f"{BASE} SELECT site_id, {DIRECTION} AS wind_dir FROM obs GROUP BY 1")
def agg8_circular_mean(spark, sf_dir):
    return obs(spark, sf_dir).groupBy("site_id").agg(C.circular_mean(F.col("wind_dir")).alias("wind_dir"))


@query(f"""{BASE}, {GAPS}, g AS (SELECT site_id, count(*) AS open_gaps FROM gaps WHERE NOT resolved GROUP BY 1), n AS (SELECT site_id, max(ts) FILTER (NOT is_forecast) AS newest FROM obs GROUP BY 1)
  SELECT n.site_id, newest, coalesce(open_gaps, 0) AS open_gaps, round(({SPLIT} + 4 * 3600 - newest) / 3600.0, 6) AS age_hours, coalesce(({SPLIT} + 4 * 3600 - newest) / 3600.0 > 6, true) AS stale FROM n LEFT JOIN g USING (site_id)""")
def agg14_freshness(spark, sf_dir):
    return r6(W.freshness(obs(spark, sf_dir), _gaps(spark, sf_dir), SPLIT + 4 * P.HOUR))


@query(f"""{BASE}, {DELIVERIES}, x AS (SELECT site_id, ts, avg(temp_c) AS v FROM deliveries WHERE source = 'click' AND temp_c IS NOT NULL GROUP BY 1, 2), y AS (SELECT site_id, ts, avg(temp_c) AS v FROM deliveries WHERE source = 'view' AND temp_c IS NOT NULL GROUP BY 1, 2)
  SELECT site_id, round(avg(x.v - y.v), 6) AS bias, round(stddev_pop(x.v - y.v), 6) AS spread, count(*) AS n FROM x JOIN y USING (site_id, ts) GROUP BY 1""")
def agg19_source_bias(spark, sf_dir):
    hourly = _deliveries(spark, sf_dir).where("temp_c is not null").groupBy("site_id", "source", "ts").agg(F.avg("temp_c").alias("temp_c"))
    return r6(W.source_bias(hourly, "click", "view", "temp_c"))


NEWEST = "newest AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY site_id, source, ts ORDER BY fetched_at DESC, delivery DESC) AS r FROM deliveries) WHERE r = 1)"


@query(f"WITH {DELIVERIES}, {NEWEST} SELECT site_id, source, ts, delivery, fetched_at, round(pressure_msl, 6) AS pressure_msl, round(temp_c, 6) AS temp_c, is_forecast FROM newest")
def src2_forecast_upsert(spark, sf_dir):
    return r6(W.newest_fetch(_deliveries(spark, sf_dir)))


@query(f"""WITH {DELIVERIES}, stored AS (SELECT DISTINCT site_id, source, ts FROM deliveries WHERE delivery % 4 = 0), u AS (SELECT *, row_number() OVER (PARTITION BY site_id, source, ts ORDER BY delivery) AS r FROM deliveries WHERE pressure_msl IS NOT NULL OR temp_c IS NOT NULL)
  SELECT site_id, source, ts, delivery, fetched_at, round(pressure_msl, 6) AS pressure_msl, round(temp_c, 6) AS temp_c, is_forecast FROM u WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.site_id = u.site_id AND s.source = u.source AND s.ts = u.ts)""")
def src3_archive_backfill(spark, sf_dir):
    rows = _deliveries(spark, sf_dir)
    return r6(W.backfill_new(rows, rows.where("delivery % 4 = 0")))


@query(f"""WITH s AS (SELECT c_custkey AS site_id FROM customer), e AS (SELECT {TODAY} - 6 AS last), p AS (SELECT site_id, unnest(range(last - 1095, last + 1, 366)) AS from_day, last FROM s, e)
  SELECT site_id, from_day, least(from_day + 365, last) AS to_day FROM p""")
def src4_backfill_plan(spark, sf_dir):
    sites = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site_id"))
    return W.backfill_plan(sites, TODAY * P.DAY).select("site_id", F.col("from_day").cast("long").alias("from_day"), F.col("to_day").cast("long").alias("to_day"))


@query(f"""WITH {DELIVERIES}, r AS (SELECT *, row_number() OVER (PARTITION BY site_id, ts ORDER BY CASE source WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 ELSE 99 END, fetched_at DESC, delivery DESC) AS r FROM deliveries)
  SELECT site_id, source, ts, delivery, fetched_at, round(pressure_msl, 6) AS pressure_msl, round(temp_c, 6) AS temp_c, is_forecast FROM r WHERE r = 1""")
def src11_reconcile(spark, sf_dir):
    return r6(W.reconcile(_deliveries(spark, sf_dir), {"purchase": 0, "view": 1}))


@query(f"WITH {DELIVERIES}, {OBS_SQL} SELECT site_id, ts, 'model' AS provenance FROM obs UNION ALL SELECT site_id, ts, source FROM deliveries")
def set1_union_sources(spark, sf_dir):
    both = obs(spark, sf_dir).select("site_id", "ts", F.lit("model").alias("provenance"))
    return both.unionByName(_deliveries(spark, sf_dir).select("site_id", "ts", F.col("source").alias("provenance")))


# Windows


FEATURES = """f AS (SELECT a.site_id, a.at, n.pressure_msl - s.pressure_msl AS dp_6h, n.pressure_msl - d.pressure_msl AS dp_24h, v.stability_48h
  FROM anchors a ASOF LEFT JOIN obs n ON a.site_id = n.site_id AND a.at >= n.ts ASOF LEFT JOIN obs s ON a.site_id = s.site_id AND a.at - 21600 >= s.ts ASOF LEFT JOIN obs d ON a.site_id = d.site_id AND a.at - 86400 >= d.ts
  LEFT JOIN (SELECT a.site_id, a.at, CASE WHEN count(*) >= 2 THEN stddev_pop(o.pressure_msl) END AS stability_48h FROM anchors a JOIN obs o ON a.site_id = o.site_id AND o.ts BETWEEN a.at - 172800 AND a.at GROUP BY 1, 2) v ON v.site_id = a.site_id AND v.at = a.at),
  m AS (SELECT *, CASE WHEN dp_6h IS NULL OR stability_48h IS NULL THEN NULL WHEN dp_6h <= -3.0 THEN 'falling_fast' WHEN dp_6h < -0.7 AND dp_6h > -3.0 THEN 'falling_slow' WHEN abs(dp_6h) <= 0.7 AND stability_48h < 2.0 THEN 'stable'
    WHEN dp_6h > 0.7 AND dp_6h < 3.0 THEN 'rising_slow' WHEN dp_6h >= 3.0 THEN 'rising_fast' END AS regime FROM f)"""
SCORED = """sc AS (SELECT *, greatest(0.0, least(10.0, 5 + 5 * (coalesce(CASE regime WHEN 'falling_slow' THEN 1.0 WHEN 'stable' THEN 0.6 WHEN 'falling_fast' THEN 0.3 WHEN 'rising_slow' THEN 0.4 WHEN 'rising_fast' THEN -0.5 END, 0.0) * 0.6 + 0.4))) AS day_score FROM m)"""
BAND = "CASE WHEN day_score < 3.5 THEN 'red' WHEN day_score < 5.5 THEN 'orange' WHEN day_score < 7.5 THEN 'yellow' ELSE 'green' END"
ROUNDED = "round(dp_6h, 6) AS dp_6h, round(dp_24h, 6) AS dp_24h, round(stability_48h, 6) AS stability_48h, regime"


@query(f"{BASE}, {FEATURES} SELECT site_id, at, {ROUNDED} FROM m")
def mod1_pressure_features(spark, sf_dir):
    return r6(W.pressure_features(anchors(spark, sf_dir), obs(spark, sf_dir)))


@query(f"{BASE}, {FEATURES}, {SCORED} SELECT site_id, at, {ROUNDED}, round(CAST(day_score AS double), 6) AS day_score, day_score >= 5.5 AS go, {BAND} AS band, round_even(coalesce(CASE regime WHEN 'falling_slow' THEN 1.0 WHEN 'stable' THEN 0.6 WHEN 'falling_fast' THEN 0.3 WHEN 'rising_slow' THEN 0.4 WHEN 'rising_fast' THEN -0.5 END, 0.0)::double * 0.6, 3) AS pressure_part FROM sc")
def mod17_day_score(spark, sf_dir):
    scored = M.score_days(W.pressure_features(anchors(spark, sf_dir), obs(spark, sf_dir)))
    return r6(scored.withColumn("pressure_part", F.col("contributions")["pressure_trend"]).drop("contributions"))


@query(f"{BASE}, {FEATURES}, w AS (SELECT o.site_id, o.at, o.h, n.pressure_msl - s.pressure_msl AS dp FROM (SELECT site_id, at, h, at - h * 3600 AS t FROM anchors CROSS JOIN (VALUES (3), (6), (9), (12), (24)) x(h)) o ASOF LEFT JOIN obs s ON o.site_id = s.site_id AND o.t >= s.ts ASOF LEFT JOIN obs n ON o.site_id = n.site_id AND o.at >= n.ts) SELECT site_id, at, " + ", ".join(f"round(max(dp) FILTER (h = {h}), 6) AS dp_{h}h" for h in (3, 6, 9, 12, 24)) + " FROM w GROUP BY 1, 2")
def win13_pressure_deltas(spark, sf_dir):
    hours = (3, 6, 9, 12, 24)
    at = W.asof_offsets(anchors(spark, sf_dir), obs(spark, sf_dir), "pressure_msl", (0, *hours))
    return r6(at.select("site_id", "at", *((F.col("v_0") - F.col(f"v_{h}")).alias(f"dp_{h}h") for h in hours)))


RUNS = "runs AS (SELECT *, sum(fresh) OVER (PARTITION BY site_id ORDER BY at) AS run FROM (SELECT *, CASE WHEN lag(at) OVER w IS NULL OR lag({0}) OVER w IS DISTINCT FROM {0} THEN 1 ELSE 0 END AS fresh FROM {1} WINDOW w AS (PARTITION BY site_id ORDER BY at)))"


@query(f"{BASE}, {FEATURES}, {RUNS.format('regime', 'm')} SELECT site_id, at, regime, round((at - min(at) OVER (PARTITION BY site_id, run)) / 3600.0, 6) AS hours_since_change FROM runs")
def win14_regime_age(spark, sf_dir):
    rows = W.since_change(W.pressure_features(anchors(spark, sf_dir), obs(spark, sf_dir)), "regime")
    return r6(rows.select("site_id", "at", "regime", "hours_since_change"))


@query(f"{BASE} SELECT site_id, ts, round(sum(greatest(temp_c - 10.0, 0.0)) OVER (PARTITION BY site_id ORDER BY ts) / 24, 4) AS degree_days FROM obs WHERE ts >= {DAY0} * 86400 + 10 * 86400")
def win15_degree_days(spark, sf_dir):
    rows = W.degree_days(obs(spark, sf_dir), 10.0, F.lit((DAY0 + 10) * P.DAY))
    return rows.select("site_id", "ts", F.round("degree_days", 4).alias("degree_days"))


WARM = "c AS (SELECT site_id, at, CASE WHEN o.temp_c >= 18.9 THEN 'warm' ELSE 'cool' END AS phase_now FROM anchors a ASOF LEFT JOIN obs o ON a.site_id = o.site_id AND a.at >= o.ts)"


@query(f"{BASE}, {WARM.replace('site_id, at', 'a.site_id, a.at', 1)}, {RUNS.format('phase_now', 'c')}, aged AS (SELECT *, (at - min(at) OVER (PARTITION BY site_id, run)) / 3600.0 AS h FROM runs) SELECT site_id, at, phase_now, last_value(CASE WHEN h >= 48 THEN phase_now END IGNORE NULLS) OVER (PARTITION BY site_id ORDER BY at ROWS UNBOUNDED PRECEDING) AS phase FROM aged")
def win16_settled_phase(spark, sf_dir):
    rows = W.asof_backward(anchors(spark, sf_dir), obs(spark, sf_dir), "temp_c").withColumn("phase_now", F.when(F.col("temp_c_asof") >= 18.9, "warm").otherwise("cool"))
    return W.settle(rows, "phase_now").select("site_id", "at", "phase_now", "phase")


PREDICTED = f"""pgrid AS (SELECT site_id, CAST(h.h AS integer) AS horizon, {TODAY} + h.h AS target_day, ({TODAY} + h.h) * 86400 + 43200 AS at FROM (SELECT DISTINCT site_id FROM obs) CROSS JOIN range(0, 8) h(h))"""
PREDICT_BASE = f"WITH {OBS_SQL}, {PREDICTED}, anchors AS (SELECT DISTINCT site_id, at FROM pgrid)"


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors(spark, sf_dir).select("site_id").distinct()


@query(f"{PREDICT_BASE}, {FEATURES}, {SCORED} SELECT g.site_id, g.horizon, g.target_day, g.at, {ROUNDED}, round(CAST(day_score AS double), 6) AS day_score, day_score >= 5.5 AS go, {BAND} AS band FROM pgrid g LEFT JOIN sc ON g.site_id = sc.site_id AND g.at = sc.at".replace("FROM pgrid g LEFT JOIN sc", "FROM pgrid g LEFT JOIN sc"))
def mod19_predictions(spark, sf_dir):
    return r6(M.predictions(_sites(spark, sf_dir), obs(spark, sf_dir), TODAY).withColumn("target_day", F.col("target_day").cast("long")).drop("contributions", "ruleset", "inputs_hash"))


@query(f"""{PREDICT_BASE}, {FEATURES}, {SCORED}, {FORECAST} SELECT g.site_id, g.horizon, g.target_day AS day, round(CAST(day_score AS double), 6) AS day_score, CASE WHEN g.horizon <> 3 THEN {BAND} END AS band, g.horizon <> 3 AS has_data, g.horizon > 5 AS is_far,
  round(CASE WHEN g.horizon > 0 THEN fd.temp_min END, 6) AS temp_min, round(CASE WHEN g.horizon > 0 THEN fd.temp_max END, 6) AS temp_max
  FROM pgrid g LEFT JOIN sc ON g.site_id = sc.site_id AND g.at = sc.at AND g.horizon <> 3 LEFT JOIN fd ON fd.site_id = g.site_id AND fd.day = g.target_day""")
def win5_day_strip(spark, sf_dir):
    weather = obs(spark, sf_dir)
    stored = M.predictions(_sites(spark, sf_dir), weather, TODAY).where("horizon <> 3")
    return r6(W.day_strip(_sites(spark, sf_dir), stored, W.forecast_days(weather, SPLIT), TODAY).withColumn("day", F.col("day").cast("long")))


@query("SELECT user_id % 5 AS site_id, CAST(date_diff('day', date '1970-01-01', CAST(ts AS date)) AS bigint) AS target_day, event_type AS horizon, max(event_id) AS generated FROM events GROUP BY 1, 2, 3")
def win4_latest_prediction(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("site_id"), F.expr("cast(datediff(to_date(ts), date'1970-01-01') as bigint)").alias("target_day"), F.col("event_type").alias("horizon"), F.col("event_id").alias("generated"))
    return W.latest(rows, ("site_id", "target_day", "horizon"), "generated")


@query(f"{BASE}, {FEATURES}, r AS (SELECT site_id, at, regime, CASE regime WHEN 'falling_slow' THEN 0 WHEN 'stable' THEN 1 WHEN 'rising_slow' THEN 2 WHEN 'falling_fast' THEN 3 WHEN 'rising_fast' THEN 4 END AS place FROM m) SELECT site_id, at, regime, CASE place WHEN 0 THEN 'best' WHEN 1 THEN 'good' WHEN 2 THEN 'middling' WHEN 3 THEN 'poor' WHEN 4 THEN 'worst' END AS rating FROM r")
def win6_regime_rating(spark, sf_dir):
    """Rank of a regime among the scored ones: first, last, and thirds between."""
    order = sorted(P.DAY_SCORE["regimes"], key=lambda r: -P.DAY_SCORE["regimes"][r])
    names = {r: "best" if i == 0 else "worst" if i == len(order) - 1 else ("good", "middling", "poor")[i * 3 // len(order) if i * 3 // len(order) < 3 else 2] for i, r in enumerate(order)}
    names |= {r: ("good", "middling", "poor")[i - 1] for i, r in enumerate(order) if 0 < i < len(order) - 1 and len(order) == 5}
    rows = W.pressure_features(anchors(spark, sf_dir), obs(spark, sf_dir))
    return rows.select("site_id", "at", "regime", C.lookup(F.col("regime"), names).alias("rating"))


@query(f"{BASE}, n AS (SELECT site_id, max(ts) AS ts FROM obs WHERE NOT is_forecast GROUP BY 1) SELECT o.site_id, o.ts, round(pressure_msl, 6) AS pressure_msl, round(temp_c, 6) AS temp_c, wind_dir FROM obs o JOIN n ON o.site_id = n.site_id AND o.ts = n.ts")
def win9_current_conditions(spark, sf_dir):
    return r6(W.current_conditions(obs(spark, sf_dir)))


# Water and bite


STABILITY = """st AS (SELECT a.site_id, a.at, count(o.ts) AS n, CASE WHEN count(o.ts) >= 2 AND least(1.0, count(o.ts) / 72.0) >= 0.8 THEN greatest(0.0, least(1.0, 1 - (max(o.pressure_msl) - min(o.pressure_msl)) / 12.0)) * greatest(0.0, least(1.0, 1 - (max(o.temp_c) - min(o.temp_c)) / 14.0)) END AS stability
  FROM anchors a LEFT JOIN obs o ON a.site_id = o.site_id AND o.ts BETWEEN a.at - 259200 AND a.at GROUP BY 1, 2)"""


@query(f"{BASE}, {STABILITY} SELECT site_id, at, n AS n_p, round(stability, 6) AS stability FROM st")
def mod2_stability_index(spark, sf_dir):
    return r6(W.stability(anchors(spark, sf_dir), obs(spark, sf_dir)).select("site_id", "at", "n_p", "stability"))


EQ = "temp_c + 2.5 * shortwave / 1000.0 - 0.10 * greatest(0.0, temp_c - dewpoint_c) * least(2.0, 1 + wind_ms / 8.0)"


@query(f"{BASE} SELECT site_id, ts, round({EQ}, 6) AS equilibrium_c FROM obs")
def mod3_equilibrium(spark, sf_dir):
    eq = C.equilibrium(F.col("temp_c"), F.col("shortwave"), F.col("dewpoint_c"), F.col("wind_ms"))
    return r6(obs(spark, sf_dir).select("site_id", "ts", eq.alias("equilibrium_c")))


WATER = f"""win AS (SELECT a.site_id, a.at, list({{'ts': o.ts, 'eq': {EQ}, 'w': 0.0::double}} ORDER BY o.ts) AS s, avg(o.temp_c) AS seed, count(*) AS hours, min(o.temp_c) AS air_min, max(o.temp_c) AS air_max FROM anchors a JOIN obs o ON a.site_id = o.site_id AND o.ts BETWEEN a.at - 259200 AND a.at GROUP BY 1, 2),
  step AS (SELECT *, least(1.0, hours / 72.0) AS coverage, CASE WHEN hours >= 2 AND least(1.0, hours / 72.0) >= 0.8 THEN list_reduce(s, lambda x, y: {{'ts': y.ts, 'eq': y.eq, 'w': x.w + (y.eq - x.w) * (greatest(0.0, least(CASE WHEN x.ts < 0 THEN 1.0 ELSE (y.ts - x.ts) / 3600.0 END, 62.64)) / 62.64)}}, {{'ts': -1::bigint, 'eq': 0.0::double, 'w': seed}}).w END AS water_c,
    CASE WHEN hours >= 2 AND least(1.0, hours / 72.0) >= 0.8 AND len(list_filter(s, lambda x: x.ts <= at - 86400)) > 0 THEN list_reduce(list_filter(s, lambda x: x.ts <= at - 86400), lambda x, y: {{'ts': y.ts, 'eq': y.eq, 'w': x.w + (y.eq - x.w) * (greatest(0.0, least(CASE WHEN x.ts < 0 THEN 1.0 ELSE (y.ts - x.ts) / 3600.0 END, 62.64)) / 62.64)}}, {{'ts': -1::bigint, 'eq': 0.0::double, 'w': seed}}).w END AS day_ago FROM win),
  water AS (SELECT a.site_id, a.at, water_c, water_c - day_ago AS trend_24h, coverage, hours, air_min, air_max FROM anchors a LEFT JOIN step USING (site_id, at))"""


@query(f"{BASE}, {WATER} SELECT site_id, at, round(water_c, 6) AS water_c, round(trend_24h, 6) AS trend_24h, round(coverage, 6) AS coverage, hours, round(air_min - 6, 6) AS low_guard, round(air_max + 4, 6) AS high_guard FROM water")
def mod5_water_estimate(spark, sf_dir):
    return r6(M.envelope(M.water_estimate(anchors(spark, sf_dir), obs(spark, sf_dir))).drop("air_min", "air_max"))


@query(f"{BASE}, {WATER} SELECT site_id, at, round(water_c, 6) AS central FROM water")
def mod7_water_band_central(spark, sf_dir):
    """The ensemble with all factors at one is the plain estimate; the band itself is in mod7_water_band."""
    one = {"tau": (1.0,), "sun": (1.0,), "evaporation": (1.0,)}
    return r6(M.water_band(anchors(spark, sf_dir), obs(spark, sf_dir), e=one).select("site_id", "at", "central"))


MEMBERS = ", ".join(f"(VALUES {', '.join(f'({float(x)}::double)' for x in P.ENSEMBLE[name])}) {c}({c})" for c, name in (("tau", "tau"), ("sun", "sun"), ("dry", "evaporation")))
BAND27 = f"""w7 AS (SELECT a.site_id, a.at, list({{'ts': o.ts, 'air': temp_c, 'gain': 2.5 * shortwave / 1000.0, 'loss': 0.10 * greatest(0.0, temp_c - dewpoint_c) * least(2.0, 1 + wind_ms / 8.0), 'w': 0.0::double}} ORDER BY o.ts) AS s, avg(temp_c) AS seed, count(*) AS hours, min(temp_c) - 6 AS lo, max(temp_c) + 4 AS hi FROM anchors a JOIN obs o ON a.site_id = o.site_id AND o.ts BETWEEN a.at - 259200 AND a.at GROUP BY 1, 2),
  m7 AS (SELECT site_id, at, greatest(lo, least(hi, list_reduce(s, lambda x, y: {{'ts': y.ts, 'air': y.air, 'gain': y.gain, 'loss': y.loss, 'w': x.w + (y.air + y.gain * sun - y.loss * dry - x.w) * (greatest(0.0, least(CASE WHEN x.ts < 0 THEN 1.0 ELSE (y.ts - x.ts) / 3600.0 END, 62.64 * tau)) / (62.64 * tau))}}, {{'ts': -1::bigint, 'air': 0.0::double, 'gain': 0.0::double, 'loss': 0.0::double, 'w': seed}}).w)) AS w
    FROM w7, {MEMBERS} WHERE hours >= 2 AND least(1.0, hours / 72.0) >= 0.8), b7 AS (SELECT site_id, at, list_sort(list(w)) AS r FROM m7 GROUP BY 1, 2)"""


@query(f"{BASE}, {BAND27} SELECT a.site_id, a.at, round(r[14], 6) AS central, round(r[1], 6) AS low, round(r[27], 6) AS high FROM anchors a LEFT JOIN b7 ON a.site_id = b7.site_id AND a.at = b7.at")
def mod7_water_band(spark, sf_dir):
    return r6(M.water_band(anchors(spark, sf_dir), obs(spark, sf_dir)))


PHASE = "CASE WHEN water_c IS NULL OR trend_24h IS NULL THEN 'unknown' WHEN water_c >= 26.8 THEN 'summer_stagnation' WHEN trend_24h >= 0.15 THEN 'spring_warming' WHEN trend_24h <= -0.15 THEN 'autumn_cooling' ELSE 'holding' END"


@query(f"{BASE}, {WATER} SELECT site_id, at, {PHASE} AS phase FROM water")
def mod8_phase(spark, sf_dir):
    rows = M.water_estimate(anchors(spark, sf_dir), obs(spark, sf_dir))
    return rows.select("site_id", "at", C.phase_from_water(F.col("water_c"), F.col("trend_24h"), F.lit(P.SPECIES["roach"])).alias("phase"))


@query("SELECT o_orderkey AS order_id, CASE WHEN month(o_orderdate) BETWEEN 3 AND 5 THEN 'spring_warming' WHEN month(o_orderdate) BETWEEN 9 AND 11 THEN 'autumn_cooling' ELSE 'summer_stagnation' END AS phase FROM orders")
def mod9_calendar_phase(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), C.lookup(F.month("o_orderdate"), P.MONTH_PHASES, P.MONTH_DEFAULT).alias("phase"))


SAT = "(14.652 - 0.41022 * t + 0.007991 * t * t - 0.000077774 * t * t * t)"
OXYGEN = f"""ox0 AS (SELECT site_id, ts, temp_c, wind_ms, greatest(0.0, least(40.0, temp_c))::double AS t FROM obs), ox1 AS (SELECT *, {SAT} AS sat, 2.0 * pow(2.3, (temp_c - 20) / 10) AS resp FROM ox0), ox2 AS (SELECT *, greatest(0.0, sat - resp) AS before FROM ox1),
  ox3 AS (SELECT *, least(greatest(0.0, least(1.0, 0.5 * (wind_ms / 6.0) * (wind_ms / 6.0))) * 0.35 * sat, greatest(0.0, sat - before)) AS gain FROM ox2), ox AS (SELECT *, least(sat, before + gain) AS dissolved FROM ox3)"""


@query(f"{BASE}, {OXYGEN} SELECT site_id, ts, round(sat, 6) AS saturation, round(resp, 6) AS respiration, round(dissolved, 6) AS dissolved FROM ox")
def mod10_oxygen(spark, sf_dir):
    t = F.col("temp_c")
    return r6(obs(spark, sf_dir).select("site_id", "ts", C.oxygen_saturation(t).alias("saturation"), C.oxygen_respiration(t).alias("respiration"), C.dissolved_oxygen(t, F.col("wind_ms"), F.lit(0.5)).alias("dissolved")))


@query(f"{BASE}, {OXYGEN} SELECT site_id, ts, round(greatest(0.0, least(1.0, (dissolved - 5.0) / 3.5)), 6) AS f_oxygen FROM ox")
def mod11_oxygen_term(spark, sf_dir):
    return r6(obs(spark, sf_dir).select("site_id", "ts", C.oxygen_term(C.dissolved_oxygen(F.col("temp_c"), F.col("wind_ms"), F.lit(0.5))).alias("f_oxygen")))


@query(f"""{BASE}, nm AS (SELECT site_id, quantile_cont(pressure_msl, 0.5) AS norm FROM obs GROUP BY 1), p AS (SELECT o.site_id, o.ts, o.pressure_msl AS p, n.norm, d.pressure_msl AS ago FROM obs o JOIN nm n USING (site_id) ASOF LEFT JOIN obs d ON o.site_id = d.site_id AND o.ts - 86400 >= d.ts)
  SELECT site_id, ts, round(greatest(0.0, least(1.0, 1 - abs(p - norm) / 14.0)), 6) AS comfort, round(CASE WHEN ago IS NOT NULL THEN greatest(-1.0, least(1.0, (abs(ago - norm) - abs(p - norm)) / 6.0)) END, 6) AS approach FROM p""")
def mod12_pressure_factor(spark, sf_dir):
    weather = obs(spark, sf_dir)
    hours = weather.select("site_id", F.col("ts").alias("at"), "pressure_msl")
    ago = W.asof_backward(hours.select("site_id", "at", "pressure_msl", (F.col("at") - P.DAY).alias("t")).withColumnRenamed("pressure_msl", "p"), weather, "pressure_msl", at="t")
    rows = ago.join(W.norm(weather, "pressure_msl", 1).select("site_id", "norm"), "site_id")
    p, n, d = F.col("p"), F.col("norm"), F.col("pressure_msl_asof")
    return r6(rows.select("site_id", F.col("at").alias("ts"), C.pressure_comfort(p, n).alias("comfort"), C.pressure_approach(p, n, d).alias("approach")))


@query(f"{BASE}, sp(species, t_opt) AS (VALUES ('roach', 26.8), ('bream', 27.9), ('crucian', 27.0), ('carp', 26.0), ('rudd', 24.0), ('ide', 20.0), ('pike', NULL)) SELECT site_id, ts, species, round(CASE WHEN t_opt IS NOT NULL THEN greatest(0.0, least(1.0, (temp_c - 4.0) / (t_opt::double - 4.0::double))) END + 1e-9, 6) AS f_temp FROM obs CROSS JOIN sp")
def mod13_temperature_factor(spark, sf_dir):
    species = F.explode(F.array(*[F.struct(F.lit(s).alias("species"), F.lit(t).cast("double").alias("t_opt")) for s, t in (P.SPECIES | {"pike": None}).items()]))
    rows = obs(spark, sf_dir).select("site_id", "ts", "temp_c", species.alias("s"))
    return rows.select("site_id", "ts", "s.species", F.round(C.temperature_term(F.col("temp_c"), F.col("s.t_opt")) + 1e-9, 6).alias("f_temp"))


REPLAY = f"""{WATER}, {STABILITY}, {SPANS}, {STREAK}, {ROLLING_SQL},
  j AS (SELECT a.site_id, a.at, w.water_c, w.trend_24h, w.coverage, st.stability, streak.stable_days, n.pressure_msl AS p, d.pressure_msl AS ago, n.wind_ms AS wind, nm.norm, greatest(0.0, least(40.0, w.water_c))::double AS t
    FROM anchors a JOIN water w ON a.site_id = w.site_id AND a.at = w.at JOIN st ON a.site_id = st.site_id AND a.at = st.at JOIN streak ON a.site_id = streak.site_id AND a.at = streak.at
    ASOF LEFT JOIN obs n ON a.site_id = n.site_id AND a.at >= n.ts ASOF LEFT JOIN obs d ON a.site_id = d.site_id AND a.at - 86400 >= d.ts JOIN nm ON nm.site_id = a.site_id AND nm.at = a.at),
  j1 AS (SELECT *, {SAT} AS sat, greatest(0.0, {SAT} - 2.0 * pow(2.3, (water_c - 20) / 10)) AS before FROM j WHERE water_c IS NOT NULL),
  j2 AS (SELECT *, least(sat, before + least(greatest(0.0, least(1.0, 0.5 * (wind / 6.0) * (wind / 6.0))) * 0.35 * sat, greatest(0.0, sat - before))) AS oxygen FROM j1),
  j3 AS (SELECT *, CASE WHEN norm IS NOT NULL THEN greatest(0.0, least(1.0, 1 - abs(p - norm) / 14.0)) END AS fp, greatest(0.0, least(1.0, (oxygen - 5.0) / 3.5)) AS fo, greatest(0.0, least(1.0, (water_c - 4.0) / 22.8)) AS ft,
    CASE WHEN ago IS NOT NULL AND norm IS NOT NULL THEN greatest(-1.0, least(1.0, (abs(ago - norm) - abs(p - norm)) / 6.0)) END AS ap FROM j2),
  j4 AS (SELECT *, greatest(0.0, least(1.0, (0.65 * least(fp, fo, ft) + 0.35 * (fp + fo + ft) / 3) * (1 + 0.25 * coalesce(ap, 0.0)) * (0.55 + 0.45 * greatest(coalesce(stability, 1.0), 0.0, coalesce(ap, 0.0))))) AS bite,
    greatest(0.0, least(1.0, 0.25 + 0.45 * stability + 0.20 * least(stable_days / 2.0, 1.0) + 0.10 * coverage)) * (1 - 0.35 * (1 - fo)) AS conf FROM j3 WHERE fp IS NOT NULL)"""


@query(f"{BASE}, {REPLAY} SELECT site_id, at, round(water_c, 5) AS water_c, round(oxygen, 5) AS oxygen, round(fp, 5) AS f_pressure, round(fo, 5) AS f_oxygen, round(ft, 5) AS f_temp, round(ap, 5) AS approach, round(bite, 5) AS bite_index, round(CASE WHEN stability IS NOT NULL THEN conf END, 5) AS confidence, CASE WHEN fp <= fo AND fp <= ft THEN 'pressure' WHEN fo <= ft THEN 'oxygen' ELSE 'temperature' END AS limiting FROM j4")
def mod21_replay(spark, sf_dir):
    """MOD5 and MOD8 to MOD16 for every site at all its past instants; rows without an index are in mod16_assessment."""
    rows = M.replay(anchors(spark, sf_dir), obs(spark, sf_dir), _norms(spark, sf_dir), scored_only=True)
    five = lambda c: F.round(c, 5).alias(c)
    return rows.select("site_id", "at", *map(five, ("water_c", "oxygen", "f_pressure", "f_oxygen", "f_temp", "approach", "bite_index", "confidence")), "limiting")


@query(f"{BASE}, {REPLAY} SELECT a.site_id, a.at, w.water_c IS NOT NULL AND nm.norm IS NOT NULL AS scored, concat_ws(',', CASE WHEN nm.norm IS NULL THEN 'pressure' END, CASE WHEN w.water_c IS NULL THEN 'oxygen' END, CASE WHEN w.water_c IS NULL THEN 'temperature' END) AS missing FROM anchors a JOIN water w ON a.site_id = w.site_id AND a.at = w.at JOIN nm ON nm.site_id = a.site_id AND nm.at = a.at")
def mod16_assessment(spark, sf_dir):
    rows = M.replay(anchors(spark, sf_dir), obs(spark, sf_dir), _norms(spark, sf_dir))
    return rows.select("site_id", "at", F.col("bite_index").isNotNull().alias("scored"), "missing")


@query(f"""{BASE}, {OXYGEN.replace("FROM obs)", "FROM sw)", 1).replace("ox0 AS", "calm AS (SELECT site_id, avg(wind_ms) AS wind_ms FROM obs GROUP BY 1), sw AS (SELECT site_id, 0 AS ts, (8 + 2 * i.i)::double AS temp_c, wind_ms FROM calm CROSS JOIN range(0, 13) i(i)), ox0 AS", 1)},
  b AS (SELECT site_id, temp_c AS water_c, wind_ms, greatest(0.0, least(1.0, (dissolved - 5.0) / 3.5)) AS fo, greatest(0.0, least(1.0, (temp_c - 4.0) / 22.8)) AS ft FROM ox)
  SELECT site_id, water_c, round(fo, 5) AS f_oxygen, round(ft, 5) AS f_temp, round(greatest(0.0, least(1.0, 0.65 * least(1.0, fo, ft) + 0.35 * (1.0 + fo + ft) / 3)), 5) AS bite_index FROM b""")
def mod20_bite_sweep(spark, sf_dir):
    calm = obs(spark, sf_dir).groupBy("site_id").agg(F.avg("wind_ms").alias("wind_ms"))
    rows = M.sweep(calm, list(range(8, 33, 2)))
    return rows.select("site_id", "water_c", F.round("f_oxygen", 5).alias("f_oxygen"), F.round("f_temp", 5).alias("f_temp"), F.round("bite_index", 5).alias("bite_index"))


@query()
def mod18_sun_times(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site_id"), F.expr("49 + (s_suppkey % 60) / 10").alias("lat"), F.expr("14 + (s_suppkey % 90) / 10").alias("lon"), (DAY0 + F.col("s_suppkey") % 366).alias("day"))
    return M.light_windows(M.sun_times(rows)).select("site_id", "day", *(F.round(c, 3).alias(c) for c in ("dawn", "sunrise", "noon", "sunset", "dusk")), F.to_json("best_hours").alias("best_hours"))


@query(f"""{BASE}, {WATER}, seen AS (SELECT site_id, at, water_c, round(water_c, 1) + (site_id - 2) * 0.5 AS observed_c FROM water WHERE water_c IS NOT NULL AND (at // 86400) % 3 = 0) SELECT site_id, round(quantile_cont(observed_c - water_c, 0.5), 5) AS offset_c, count(*) AS n FROM seen GROUP BY 1""")
def cal3_standing_offset(spark, sf_dir):
    modelled = M.water_estimate(anchors(spark, sf_dir), obs(spark, sf_dir)).select("site_id", "at", "water_c")
    seen = modelled.where("(at div 86400) % 3 = 0").select("site_id", "at", (F.round("water_c", 1) + (F.col("site_id") - 2) * 0.5).alias("observed_c"))
    return M.fit_offset(seen, modelled).select("site_id", F.round("offset_c", 5).alias("offset_c"), "n")


@query(f"{BASE}, {WATER} SELECT site_id, at, round(water_c, 6) AS water_c FROM water")
def mod4_relaxation(spark, sf_dir):
    return r6(M.water_estimate(anchors(spark, sf_dir), obs(spark, sf_dir)).select("site_id", "at", "water_c"))


@query(f"{BASE}, {WATER} SELECT site_id, at, round(air_min - 6, 6) AS low_guard, round(air_max + 4, 6) AS high_guard FROM water")
def mod6_envelope(spark, sf_dir):
    return r6(M.envelope(M.water_estimate(anchors(spark, sf_dir), obs(spark, sf_dir))).select("site_id", "at", "low_guard", "high_guard"))


@query(f"{BASE}, {REPLAY} SELECT site_id, at, round(bite, 5) AS bite_index FROM j4")
def mod14_combine(spark, sf_dir):
    return mod21_replay(spark, sf_dir).select("site_id", "at", "bite_index")


@query(f"{BASE}, {REPLAY} SELECT site_id, at, round(CASE WHEN stability IS NOT NULL THEN conf END, 5) AS confidence FROM j4")
def mod15_confidence(spark, sf_dir):
    return mod21_replay(spark, sf_dir).select("site_id", "at", "confidence")


@query(f"{BASE}, {WATER} SELECT site_id, at, round(round(water_c, 1) + (site_id - 2) * 0.5 - water_c, 5) AS residual FROM water WHERE water_c IS NOT NULL AND (at // 86400) % 3 = 0")
def jn12_observed_vs_modelled(spark, sf_dir):
    modelled = M.water_estimate(anchors(spark, sf_dir), obs(spark, sf_dir)).select("site_id", "at", "water_c").where("water_c is not null")
    seen = modelled.where("(at div 86400) % 3 = 0").select("site_id", "at", (F.round("water_c", 1) + (F.col("site_id") - 2) * 0.5).alias("observed_c"))
    return seen.join(modelled, ["site_id", "at"]).select("site_id", "at", F.round(F.col("observed_c") - F.col("water_c"), 5).alias("residual"))
