"""Time-series operators: as-of joins, lookback windows, daily summaries, forecasts and their upkeep.

``ts`` and ``at`` are epoch seconds.  Lookbacks include both ends, so 72 hours hold 73 hourly rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitecast import params as P
from sitecast.functions import columns as C
from sitecast.operators import scans as S


def asof_backward(anchors: DataFrame, readings: DataFrame, value: str, key: str = "site_id", at: str = "at", stretch: int = S.STRETCH) -> DataFrame:
    """``anchors`` with the last non-null ``value`` at or before each, however old: no range join, one sort for each stretch of a site's time."""
    left = anchors.select("*", F.lit(None).cast(readings.schema[value].dataType).alias("_r"), F.col(at).alias("_ts"), F.lit(1).alias("_side"))
    right = readings.where(F.col(value).isNotNull()).select(key, F.col(value).alias("_r"), F.col("ts").alias("_ts"), F.lit(0).alias("_side"))
    both = S.cut(left.unionByName(right, allowMissingColumns=True), "_ts", stretch)
    found = S.last_before(both, [key], ["_ts", "_side"], F.col("_r"), f"{value}_asof")
    return found.where("_side = 1").drop("_r", "_ts", "_side", S.PART).select(*anchors.columns, f"{value}_asof")


def asof_offsets(anchors: DataFrame, readings: DataFrame, value: str, hours: Sequence[int], key: str = "site_id") -> DataFrame:
    """One column ``v_{h}`` for each offset: the last value at or before ``at - h``."""
    spread = anchors.select(key, "at", F.explode(F.array(*[F.lit(h) for h in hours])).alias("h")).withColumn("t", F.col("at") - F.col("h") * P.HOUR)
    found = asof_backward(spread, readings, value, key, "t")
    return found.groupBy(key, "at").agg(*(F.max(F.when(F.col("h") == h, F.col(f"{value}_asof"))).alias(f"v_{h}") for h in hours))


def asof_values(anchors: DataFrame, readings: DataFrame, wanted: Sequence[tuple[str, int]], key: str = "site_id", stretch: int = S.STRETCH) -> DataFrame:
    """(key, at) with a column ``{value}_{h}`` for each (value, h) wanted: its last non-null reading at or before ``at - h`` hours, in one pass."""
    values, hours = sorted({v for v, _ in wanted}), sorted({h for _, h in wanted})
    left = anchors.select(key, "at", F.explode(F.array(*map(F.lit, hours))).alias("h"), *(F.lit(None).cast(readings.schema[v].dataType).alias(v) for v in values))
    left = left.withColumn("ts", F.col("at") - F.col("h") * P.HOUR).withColumn("side", F.lit(1))
    both = S.cut(left.unionByName(readings.select(key, "ts", *values).withColumn("side", F.lit(0)), allowMissingColumns=True), "ts", stretch)
    for v in values:
        both = S.last_before(both, [key], ["ts", "side"], F.col(v), v)
    return both.where("side = 1").groupBy(key, "at").agg(*(F.max(F.when(F.col("h") == h, F.col(v))).alias(f"{v}_{h}") for v, h in wanted))


def lookback(anchors: DataFrame, readings: DataFrame, hours: int, key: str = "site_id") -> DataFrame:
    """Readings within [at - hours, at] of each anchor; an equi-join on time buckets as wide as the window."""
    width = hours * P.HOUR
    wide = anchors.withColumn("_b", F.explode(F.array(F.floor(F.col("at") / width), F.floor(F.col("at") / width) - 1)))
    near = readings.withColumn("_b", F.floor(F.col("ts") / width))
    return wide.join(near, [key, "_b"]).where(F.col("ts").between(F.col("at") - width, F.col("at"))).drop("_b")


def nearest_within(anchors: DataFrame, readings: DataFrame, value: str, hours: int = 3, key: str = "site_id") -> DataFrame:
    """The reading nearest to each anchor, either side, ties to the earlier; no row where none is near."""
    width = hours * P.HOUR
    wide = anchors.withColumn("_b", F.explode(F.sequence(F.floor(F.col("at") / width) - 1, F.floor(F.col("at") / width) + 1)))
    near = readings.where(F.col(value).isNotNull()).withColumn("_b", F.floor(F.col("ts") / width))
    met = wide.join(near, [key, "_b"]).where(F.abs(F.col("ts") - F.col("at")) <= width)
    best = F.min_by(F.struct("ts", value), F.struct(F.abs(F.col("ts") - F.col("at")), F.col("ts")))
    return met.groupBy(key, "at").agg(best.alias("r")).select(key, "at", F.col("r.ts").alias("ts"), F.col(f"r.{value}").alias(value), F.floor((F.col("at") - F.col("r.ts")) / 60).alias("age_min"))


def summarise(anchors: DataFrame, readings: DataFrame, value: str, hours: int, min_coverage: float, key: str = "site_id") -> DataFrame:
    """n, lowest, highest, mean, span, coverage and availability of each anchor's window; anchors without readings stay."""
    held = lookback(anchors, readings.where(F.col(value).isNotNull()), hours, key).groupBy(key, "at").agg(F.count("*").alias("n"), F.min(value).alias("lowest"), F.max(value).alias("highest"), F.avg(value).alias("mean"))
    out = anchors.join(held, [key, "at"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = out.withColumn("span", F.col("highest") - F.col("lowest")).withColumn("coverage", F.least(F.lit(1.0), F.col("n") / hours))
    return out.withColumn("available", (F.col("n") >= 2) & (F.col("coverage") >= min_coverage))


def deviation(anchors: DataFrame, readings: DataFrame, value: str, hours: int = 48, key: str = "site_id") -> DataFrame:
    """Population standard deviation over the window, null under two readings."""
    held = lookback(anchors, readings.where(F.col(value).isNotNull()), hours, key).groupBy(key, "at").agg(F.count("*").alias("n"), F.when(F.count("*") >= 2, F.stddev_pop(value)).alias("deviation"))
    return anchors.join(held, [key, "at"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def norm(readings: DataFrame, value: str, min_samples: int = P.NORM["min_samples"], key: str = "site_id") -> DataFrame:
    """Each site's own norm: the exact median of its record, null for a short one."""
    return readings.groupBy(key).agg(F.count(value).alias("n"), F.median(value).alias("m")).select(key, "n", F.when(F.col("n") >= min_samples, F.col("m")).alias("norm"))


def value_counts(readings: DataFrame, value: str, step_days: int = P.NORM["step_days"], key: str = "site_id") -> DataFrame:
    """(key, chunk, value, n): how often each value stands in each stretch of ``step_days``, counted from 1970.

    Exact and mergeable: counts of new hours are added, so a stored table of them replaces the hours.
    """
    chunk = F.floor(F.col("ts") / (step_days * P.DAY)).alias("chunk")
    return readings.where(F.col(value).isNotNull()).groupBy(key, chunk, F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n"))


def rolling_norm(anchors: DataFrame, counts: DataFrame, p: dict = P.NORM, key: str = "site_id") -> DataFrame:
    """Each anchor with ``n`` and ``norm``: the exact median as it was known at the last recomputation, null for a short record.

    A norm is computed every ``step_days``, over the ``window_days`` before, from ``value_counts`` of that step: a
    stretch that an instant lies in doesn't count, so nothing after ``at`` does.  One norm serves all anchors
    of a site between two recomputations, and is merged from counts map-side, so a long record is many tasks.
    """
    spans = p["window_days"] // p["step_days"]
    known = F.floor(F.col("at") / (p["step_days"] * P.DAY))
    due = anchors.select(key, known.alias("known")).distinct()
    held = due.withColumn("chunk", F.explode(F.sequence(F.col("known") - spans, F.col("known") - 1))).join(counts, [key, "chunk"])
    found = held.groupBy(key, "known").agg(F.sum("n").alias("n"), F.percentile("value", F.lit(0.5), F.col("n")).alias("m"))
    found = found.select(key, "known", "n", F.when(F.col("n") >= p["min_samples"], F.col("m")).alias("norm"))
    return anchors.withColumn("known", known).join(found, [key, "known"], "left").withColumn("n", F.coalesce("n", F.lit(0))).drop("known")


def daily_spans(anchors: DataFrame, readings: DataFrame, days: int = 7, key: str = "site_id") -> DataFrame:
    """Ranges of pressure and temperature in each of the last 24-hour blocks, an edge reading in both; null under two readings."""
    blocks = anchors.select("*", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("block")).withColumn("_end", F.col("at") - F.col("block") * P.DAY)
    ends = blocks.select(key, "block", F.col("at").alias("_at"), F.col("_end").alias("at"))
    span = lambda c: F.when(F.count(c) >= 2, F.max(c) - F.min(c))
    held = lookback(ends, readings, 24, key).groupBy(key, "_at", "block").agg(span("pressure_msl").alias("span_p"), span("temp_c").alias("span_t"))
    return blocks.drop("_end").join(held.withColumnRenamed("_at", "at"), [key, "at", "block"], "left")


def stable_streak(spans: DataFrame, p: dict = P.STABILITY, key: str = "site_id") -> DataFrame:
    """Leading blocks whose spans are both within limits; an unknown block ends the streak."""
    calm = F.coalesce((F.col("span_p") <= p["day_pressure_max"]) & (F.col("span_t") <= p["day_temp_max"]), F.lit(False))
    return spans.groupBy(key, "at").agg(F.coalesce(F.min(F.when(~calm, F.col("block"))), F.lit(p["days"])).cast("long").alias("stable_days"))


def pressure_features(anchors: DataFrame, readings: DataFrame, regimes: dict[str, str] = P.REGIMES, key: str = "site_id") -> DataFrame:
    """dp_6h, dp_24h, stability_48h and regime of each anchor; no regime where an input is missing or no rule holds."""
    at = asof_offsets(anchors, readings, "pressure_msl", (0, 6, 24), key)
    dev = deviation(anchors, readings, "pressure_msl", 48, key).select(key, "at", F.col("deviation").alias("stability_48h"))
    rows = at.join(dev, [key, "at"], "left").select(key, "at", (F.col("v_0") - F.col("v_6")).alias("dp_6h"), (F.col("v_0") - F.col("v_24")).alias("dp_24h"), "stability_48h")
    return rows.withColumn("regime", F.when(F.col("dp_6h").isNotNull() & F.col("stability_48h").isNotNull(), C.first_match(regimes)))


def stability(anchors: DataFrame, readings: DataFrame, p: dict = P.STABILITY, key: str = "site_id") -> DataFrame:
    both = [summarise(anchors, readings, v, p["hours"], p["min_coverage"], key).select(key, "at", F.col("n").alias(f"n_{s}"), F.col("span").alias(f"span_{s}"), F.col("coverage").alias(f"coverage_{s}")) for v, s in (("pressure_msl", "p"), ("temp_c", "t"))]
    return both[0].join(both[1], [key, "at"]).withColumn("stability", C.stability_index(p))


def local_day(hours_east: Column | int = 1, zone: str | None = "Europe/Warsaw") -> Column:
    """Date of ``ts`` in the zone, from epoch seconds."""
    wall = F.from_utc_timestamp(F.timestamp_seconds("ts"), zone) if zone else F.timestamp_seconds(F.col("ts") + hours_east * P.HOUR)
    return F.to_date(F.date_trunc("day", wall))


def local_day_number(zone: str = "Europe/Warsaw") -> Column:
    """Days since 1970 of the local date, whatever the session's time zone."""
    shift = F.unix_timestamp(F.from_utc_timestamp(F.timestamp_seconds("ts"), zone)) - F.col("ts")
    return F.floor((F.col("ts") + shift) / P.DAY)


def recent_days(readings: DataFrame, days: int = 5, key: str = "site_id", zone: str = "Europe/Warsaw") -> DataFrame:
    """Highs and lows of observed hours by local day, the newest ``days`` of each site."""
    daily = readings.where("not is_forecast").withColumn("day", local_day_number(zone)).groupBy(key, "day").agg(F.count("*").alias("n_hours"), F.min("temp_c").alias("temp_min"), F.max("temp_c").alias("temp_max"), F.max("wind_ms").alias("wind_max"), F.avg("pressure_msl").alias("pressure"), C.circular_mean(F.col("wind_dir")).alias("wind_dir"))
    ranked = daily.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("day"))))
    return ranked.where(F.col("_r") <= days).drop("_r").withColumn("is_partial", F.col("n_hours") < 20).withColumn("wind_compass", C.compass(F.col("wind_dir")))


def forecast_days(readings: DataFrame, now: int, days: int = 7, key: str = "site_id", zone: str = "Europe/Warsaw") -> DataFrame:
    """Daily summaries of forecast hours up to ``days`` ahead of ``now``."""
    ahead = readings.where(F.col("is_forecast") & (F.col("ts") <= now + days * P.DAY)).withColumn("day", local_day_number(zone))
    return ahead.groupBy(key, "day").agg(F.count("*").alias("n_hours"), F.min("temp_c").alias("temp_min"), F.max("temp_c").alias("temp_max"), F.max("wind_ms").alias("wind_max"), F.avg("pressure_msl").alias("pressure"))


def freshness(readings: DataFrame, gaps: DataFrame, now: int, stale_hours: int = 6, key: str = "site_id") -> DataFrame:
    """Newest observed hour, its age, whether the site is stale, and its open gaps."""
    newest = readings.groupBy(key).agg(F.max(F.when(~F.col("is_forecast"), F.col("ts"))).alias("newest"))
    open_gaps = gaps.where("not resolved").groupBy(key).agg(F.count("*").alias("open_gaps"))
    out = newest.join(open_gaps, key, "left").withColumn("open_gaps", F.coalesce("open_gaps", F.lit(0)))
    return out.withColumn("age_hours", (now - F.col("newest")) / P.HOUR).withColumn("stale", F.coalesce(F.col("age_hours") > stale_hours, F.lit(True)))


def newest_fetch(rows: DataFrame, keys: Sequence[str] = ("site_id", "source", "ts")) -> DataFrame:
    """Upsert of re-delivered hours: the row fetched last of each key, even where its forecast flag flips."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("fetched_at"), F.desc("delivery")))).where("_r = 1").drop("_r")


def backfill_new(archive: DataFrame, stored: DataFrame, keys: Sequence[str] = ("site_id", "source", "ts")) -> DataFrame:
    """Archive hours to append: not stored yet, with a pressure or a temperature, each key once (the first delivery)."""
    usable = archive.where("pressure_msl is not null or temp_c is not null").withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("delivery"))).where("_r = 1").drop("_r")
    return usable.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def backfill_plan(sites: DataFrame, now: int, years: int = 3, lag_days: int = 6, chunk_days: int = 365, key: str = "site_id") -> DataFrame:
    """Windows to fetch: from ``now - lag - years`` to ``now - lag``, a chunk's length each, the next a day after the one before."""
    end = now // P.DAY - lag_days
    start = end - 365 * years
    starts = F.explode(F.sequence(F.lit(start), F.lit(end), F.lit(chunk_days + 1)))
    return sites.select(key, starts.alias("from_day")).withColumn("to_day", F.least(F.col("from_day") + chunk_days, F.lit(end)))


def reconcile(rows: DataFrame, priority: dict[str, int], key: str = "site_id") -> DataFrame:
    """One row per site and hour: archive actuals replace forecasts (the lowest priority number wins)."""
    order = C.lookup(F.col("source"), priority, 99)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key, "ts").orderBy(order, F.desc("fetched_at"), F.desc("delivery")))).where("_r = 1").drop("_r")


def gap_hours(gaps: DataFrame, readings: DataFrame, key: str = "site_id") -> DataFrame:
    """Hours of each gap that are on record from any source: hours, present, missing, covered_by, complete."""
    hours = gaps.select("gap_id", key, F.explode(F.sequence(F.floor(F.col("from_ts") / P.HOUR) * P.HOUR, F.floor(F.col("to_ts") / P.HOUR) * P.HOUR, F.lit(P.HOUR))).alias("ts"))
    held = readings.groupBy(key, "ts").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    met = hours.join(held, [key, "ts"], "left").groupBy("gap_id", key).agg(F.count("*").alias("hours"), F.count("sources").alias("present"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("covered_by"))
    return met.withColumn("missing", F.col("hours") - F.col("present")).withColumn("complete", F.col("hours") == F.col("present"))


def missing_hours(gaps: DataFrame, readings: DataFrame, key: str = "site_id") -> DataFrame:
    hours = gaps.select(key, F.explode(F.sequence(F.floor(F.col("from_ts") / P.HOUR) * P.HOUR, F.floor(F.col("to_ts") / P.HOUR) * P.HOUR, F.lit(P.HOUR))).alias("ts")).distinct()
    return hours.join(readings.select(key, "ts").distinct(), [key, "ts"], "left_anti")


def source_bias(rows: DataFrame, a: str, b: str, value: str, key: str = "site_id") -> DataFrame:
    """Mean, spread and count of a - b at hours that both sources have."""
    x, y = (rows.where(F.col("source") == s).select(key, "ts", F.col(value).alias(c)) for s, c in ((a, "x"), (b, "y")))
    return x.join(y, [key, "ts"]).groupBy(key).agg(F.avg(F.col("x") - F.col("y")).alias("bias"), F.stddev_pop(F.col("x") - F.col("y")).alias("spread"), F.count("*").alias("n"))


def since_change(rows: DataFrame, column: str, key: str = "site_id", stretch: int = S.STRETCH) -> DataFrame:
    """Hours since ``column`` last changed, by runs of equal values (nulls are a value of their own)."""
    known = S.last_before(S.cut(rows, "at", stretch), [key], ["at"], F.struct(F.col(column).alias("v")), "_before", inclusive=False)
    new = F.col("_before").isNull() | ~F.col("_before.v").eqNullSafe(F.col(column))
    begun = S.last_before(known, [key], ["at"], F.when(new, F.col("at")), "_since")
    return begun.withColumn("hours_since_change", (F.col("at") - F.col("_since")) / P.HOUR).select(*rows.columns, "hours_since_change")


def degree_days(readings: DataFrame, base: float, season_start: Column, key: str = "site_id", stretch: int = S.STRETCH) -> DataFrame:
    """Running degree-days above ``base`` from the season's start, for every hour."""
    rows = S.cut(readings.where((F.col("ts") >= season_start) & F.col("temp_c").isNotNull()), "ts", stretch)
    summed = S.running_sum(rows, [key], ["ts"], F.greatest(F.col("temp_c") - base, F.lit(0.0)), "degree_days")
    return summed.withColumn("degree_days", F.col("degree_days") / 24).select(*readings.columns, "degree_days")


def settle(rows: DataFrame, candidate: str, hours: int = 48, key: str = "site_id", stretch: int = S.STRETCH) -> DataFrame:
    """Phase with hysteresis: a candidate holds once it has lasted ``hours``; until then the phase before it stays."""
    aged = S.cut(since_change(rows, candidate, key, stretch), "at", stretch)
    held = F.when(F.col("hours_since_change") >= hours, F.col(candidate))
    return S.last_before(aged, [key], ["at"], held, "phase").drop(S.PART)


def latest(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The newest row of each key; the table itself is never updated."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


def day_strip(sites: DataFrame, predictions: DataFrame, summaries: DataFrame, today: int, horizons: int = 7, far: int = 5, key: str = "site_id") -> DataFrame:
    """Horizons 0..7 of every site, with the stored band where there is one and the day's weather except for today; nothing is filled in."""
    grid = sites.select(key, F.explode(F.sequence(F.lit(0), F.lit(horizons))).alias("horizon")).withColumn("day", F.lit(today) + F.col("horizon"))
    stored = predictions.select(key, F.col("target_day").alias("day"), "horizon", "day_score", "band")
    out = grid.join(stored, [key, "day", "horizon"], "left").join(summaries.select(key, "day", "temp_min", "temp_max"), [key, "day"], "left")
    hidden = lambda c: F.when(F.col("horizon") > 0, F.col(c)).alias(c)
    return out.select(key, "horizon", "day", "day_score", "band", F.col("band").isNotNull().alias("has_data"), (F.col("horizon") > far).alias("is_far"), hidden("temp_min"), hidden("temp_max"))


def current_conditions(readings: DataFrame, key: str = "site_id") -> DataFrame:
    """The newest observed row of each site; its values are null where its pressure is (no older row steps in)."""
    newest = readings.where("not is_forecast").groupBy(key).agg(F.max_by(F.struct("ts", "pressure_msl", "temp_c", "wind_dir"), "ts").alias("r"))
    return newest.select(key, F.col("r.ts").alias("ts"), *(F.when(F.col("r.pressure_msl").isNotNull(), F.col(f"r.{c}")).alias(c) for c in ("pressure_msl", "temp_c", "wind_dir")))
