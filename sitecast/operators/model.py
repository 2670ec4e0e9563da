"""Physical-model operators over sites and as-of instants: water temperature, bite assessment, predictions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitecast import params as P
from sitecast.functions import columns as C
from sitecast.operators import weather as W


def water_estimate(anchors: DataFrame, readings: DataFrame, depth_m: float = P.WATER["depth_m"], p: dict = P.WATER, key: str = "site_id") -> DataFrame:
    """Modelled water temperature at each anchor, its 24-hour trend, coverage and hours: null below the coverage."""
    eq = C.equilibrium(F.col("temp_c"), F.col("shortwave"), F.col("dewpoint_c"), F.col("wind_ms"), p)
    near = W.lookback(anchors, readings.where("temp_c is not null").select(key, "ts", "temp_c", eq.alias("eq")), p["hours"], key)
    held = near.groupBy(key, "at").agg(F.array_sort(F.collect_list(F.struct("ts", "eq"))).alias("s"), F.avg("temp_c").alias("seed"), F.count("*").alias("hours"), F.min("temp_c").alias("air_min"), F.max("temp_c").alias("air_max"))
    held = held.withColumn("coverage", F.least(F.lit(1.0), F.col("hours") / p["hours"]))
    ok = (F.col("hours") >= 2) & (F.col("coverage") >= p["min_coverage"])
    held = held.withColumn("path", F.when(ok, C.relax(F.col("s"), F.col("seed"), F.lit(float(depth_m)), p)))
    before = F.filter("path", lambda x: x["ts"] <= F.col("at") - P.DAY)
    held = held.withColumn("water_c", F.try_element_at("path", F.lit(-1))["water"])
    held = held.withColumn("trend_24h", F.col("water_c") - F.try_element_at(before, F.lit(-1))["water"])
    return anchors.join(held.select(key, "at", "water_c", "trend_24h", "coverage", "hours", "air_min", "air_max"), [key, "at"], "left")


def envelope(rows: DataFrame, p: dict = P.WATER) -> DataFrame:
    """The defensible range of a shallow water, from the air of the window."""
    return rows.withColumn("low_guard", F.col("air_min") - p["below_min"]).withColumn("high_guard", F.col("air_max") + p["above_max"])


def water_band(anchors: DataFrame, readings: DataFrame, depth_m: float = P.WATER["depth_m"], offset_c: float = 0.0, p: dict = P.WATER, e: dict = P.ENSEMBLE, key: str = "site_id") -> DataFrame:
    """Median, lowest and highest of 27 models, cut to the envelope.

    The members differ in coefficients alone: each window is gathered once and all members step through
    all windows of a batch as one array.  A window holds ``hours`` + 1 rows at most, whatever the length of the history.
    """
    near = W.lookback(anchors, readings.where("temp_c is not null").select(key, "ts", "temp_c", "shortwave", "dewpoint_c", "wind_ms"), p["hours"], key)
    windows = near.groupBy(key, "at").agg(F.array_sort(F.collect_list(F.struct("ts", "temp_c", "shortwave", "dewpoint_c", "wind_ms"))).alias("s"))
    tau_f, sun_f, loss_f = (np.array(x) for x in zip(*[(a, b, c) for a in e["tau"] for b in e["sun"] for c in e["evaporation"]], strict=True))
    tau = p["tau_days_per_m"] * max(0.3, depth_m) * 24 * tau_f

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(2)
            begins, fields = held.offsets.to_numpy(), held.values.flatten()
            size = np.diff(begins)
            grid = np.full((5, len(size), max(1, int(size.max(initial=1)))), np.nan)
            at = np.repeat(np.arange(len(size)), size), np.arange(int(size.sum())) - np.repeat(begins[:-1] - begins[0], size)
            for k, column in enumerate(fields):
                grid[k][at] = column.slice(begins[0], int(size.sum())).cast(pa.float64()).to_numpy(zero_copy_only=False)
            ts, air, sun, dew, wind = grid
            gain = p["sun_gain"] * np.nan_to_num(sun) / 1000
            loss = np.where(np.isnan(dew), 0.0, p["evaporation"] * np.maximum(0.0, air - dew) * np.minimum(p["wind_cap"], 1 + np.nan_to_num(wind) / p["wind_ref"]))
            hours = np.concatenate((np.ones((len(size), 1)), np.diff(ts, axis=1) / P.HOUR), axis=1)
            whole = (size >= 2) & (np.minimum(1.0, size / p["hours"]) >= p["min_coverage"])
            water = np.repeat(np.nansum(air, axis=1)[:, None] / np.maximum(size, 1)[:, None], len(tau), axis=1)
            for j in range(grid.shape[2]):  # an hour of all windows and members at once
                on = np.flatnonzero(size > j)
                eq = air[on, j, None] * p["air_weight"] + gain[on, j, None] * sun_f - loss[on, j, None] * loss_f
                water[on] += (eq - water[on]) * (np.clip(hours[on, j, None], 0, tau) / tau)
            low, high = np.nanmin(air, axis=1, initial=np.inf) - p["below_min"], np.nanmax(air, axis=1, initial=-np.inf) + p["above_max"]
            runs = np.sort(np.clip(water + offset_c, low[:, None], high[:, None]), axis=1)[whole]
            keys = [batch.column(i).filter(pa.array(whole)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(runs[:, i]) for i in (runs.shape[1] // 2, 0, -1))], names=[key, "at", "central", "low", "high"])

    rows = windows.select(F.col(key).cast("long").alias(key), F.col("at").cast("long").alias("at"), "s")
    found = rows.mapInArrow(run, f"{key} long, at long, central double, low double, high double")
    return anchors.join(found, [key, "at"], "left")


def fit_offset(observed: DataFrame, modelled: DataFrame, key: str = "site_id") -> DataFrame:
    """Median of observed - modelled at equal instants: a site's standing bias."""
    met = observed.select(key, "at", "observed_c").join(modelled.select(key, "at", "water_c"), [key, "at"]).where("observed_c is not null and water_c is not null")
    return met.groupBy(key).agg(F.median(F.col("observed_c") - F.col("water_c")).alias("offset_c"), F.count("*").alias("n"))


def assess(rows: DataFrame) -> DataFrame:
    """Index, confidence, limiting factor and missing factors, from f_pressure, f_oxygen, f_temp, approach, stability, stable_days and coverage.

    Any missing factor leaves no index.  Ties limit in the order pressure, oxygen, temperature.
    """
    factors = ["f_pressure", "f_oxygen", "f_temp"]
    names = ["pressure", "oxygen", "temperature"]
    whole = F.col("f_pressure").isNotNull() & F.col("f_oxygen").isNotNull() & F.col("f_temp").isNotNull()
    worst = F.array_min(F.array(*[F.struct(F.col(c).alias("v"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (c, n) in enumerate(zip(factors, names, strict=True))]))["name"]
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), n) for c, n in zip(factors, names, strict=True)]), lambda x: x.isNotNull())
    return rows.withColumns({
        "bite_index": F.when(whole, C.combine(F.col("f_pressure"), F.col("f_oxygen"), F.col("f_temp"), F.col("approach"), F.col("stability"))),
        "confidence": F.when(whole, C.confidence(F.col("stability"), F.col("stable_days"), F.col("coverage"), F.col("f_oxygen"))),
        "limiting": F.when(whole, worst),
        "missing": F.array_join(missing, ","),
    })


def _windows(anchors: DataFrame, readings: DataFrame, p: dict, w: dict, key: str) -> DataFrame:
    """What ``replay`` needs of the hours before each anchor, gathered in one pass over the longest window.

    n_p, n_t, span_p and span_t of the stability window, stable_days of the daily blocks, and the sorted samples, seed and hours
    of the water model; as ``weather.stability``, ``weather.stable_streak`` and ``water_estimate`` have them.
    """
    eq = C.equilibrium(F.col("temp_c"), F.col("shortwave"), F.col("dewpoint_c"), F.col("wind_ms"), w)
    near = W.lookback(anchors, readings.select(key, "ts", "temp_c", "pressure_msl", eq.alias("eq")), max(24 * p["days"], p["hours"], w["hours"]), key)
    age = F.col("at") - F.col("ts")
    recent = lambda c, hours: F.when(age <= hours * P.HOUR, F.col(c))
    parts = [F.array_sort(F.collect_list(F.when((age <= w["hours"] * P.HOUR) & F.col("temp_c").isNotNull(), F.struct("ts", "eq")))).alias("s"), F.avg(recent("temp_c", w["hours"])).alias("seed")]
    for c, s in (("pressure_msl", "p"), ("temp_c", "t")):
        parts += [F.count(recent(c, p["hours"])).alias(f"n_{s}"), (F.max(recent(c, p["hours"])) - F.min(recent(c, p["hours"]))).alias(f"span_{s}")]
        for k in range(p["days"]):
            block = F.when(age.between(k * P.DAY, (k + 1) * P.DAY), F.col(c))
            parts.append(F.when(F.count(block) >= 2, F.max(block) - F.min(block)).alias(f"day_{s}_{k}"))
    held = near.groupBy(key, "at").agg(*parts)
    restless = F
    for k in range(p["days"]):
        calm = (F.col(f"day_p_{k}") <= p["day_pressure_max"]) & (F.col(f"day_t_{k}") <= p["day_temp_max"])
        restless = restless.when(~F.coalesce(calm, F.lit(False)), k)
    return held.select(key, "at", "s", "seed", F.size("s").alias("hours"), *(f"{c}_{s}" for c in ("n", "span") for s in "pt"), restless.otherwise(p["days"]).cast("long").alias("stable_days"))


def replay(anchors: DataFrame, readings: DataFrame, norms: DataFrame, t_opt: float = P.SPECIES["roach"], key: str = "site_id", scored_only: bool = False, p: dict = P.STABILITY, w: dict = P.WATER) -> DataFrame:
    """Everything about a site at past instants: water, oxygen, stability, factors and the assessment, from one ruleset.

    ``norms`` has a norm by site, or, for a replay of what was known then, by site and ``at`` (see ``weather.rolling_norm``).
    ``scored_only`` leaves out instants that lack an input of the index.  The readings are brought to the anchors
    twice, for the windows and for the last values; everything after is columns of one row.
    """
    rows = anchors.select(key, "at").distinct().join(_windows(anchors, readings, p, w, key), [key, "at"], "left").fillna(0, ["hours", "n_p", "n_t", "stable_days"])
    rows = rows.withColumn("coverage", F.least(F.lit(1.0), F.col("hours") / w["hours"]))
    path = C.relax(F.col("s"), F.col("seed"), F.lit(float(w["depth_m"])), w)
    rows = rows.withColumn("path", F.when((F.col("hours") >= 2) & (F.col("coverage") >= w["min_coverage"]), path))
    before = F.filter("path", lambda x: x["ts"] <= F.col("at") - P.DAY)
    rows = rows.withColumns({"water_c": F.try_element_at("path", F.lit(-1))["water"], "_ago": F.try_element_at(before, F.lit(-1))["water"], "stability": C.stability_index(p)})
    rows = rows.select(key, "at", "water_c", (F.col("water_c") - F.col("_ago")).alias("trend_24h"), F.when(F.col("hours") > 0, F.col("coverage")).alias("coverage"), "stability", "stable_days")
    last = W.asof_values(anchors, readings, [("pressure_msl", 0), ("pressure_msl", 24), ("wind_ms", 0)], key)
    rows = rows.join(last, [key, "at"]).join(norms.select(key, *(["at"] if "at" in norms.columns else []), "norm"), [key, *(["at"] if "at" in norms.columns else [])], "left")
    if scored_only:
        # Of the inputs, not of the index: a condition on that would carry its whole formula down to the joins.
        rows = rows.dropna(subset=["water_c", "wind_ms_0", "pressure_msl_0", "norm"])
    now, ago, norm = F.col("pressure_msl_0"), F.col("pressure_msl_24"), F.col("norm")
    rows = C.with_oxygen(rows, F.col("water_c"), F.col("wind_ms_0"), F.lit(P.OXYGEN["fetch"])).withColumns({
        "f_pressure": C.pressure_comfort(now, norm), "approach": C.pressure_approach(now, norm, ago),
        "f_oxygen": C.oxygen_term(F.col("oxygen")), "f_temp": C.temperature_term(F.col("water_c"), F.lit(t_opt)),
        "phase": C.phase_from_water(F.col("water_c"), F.col("trend_24h"), F.lit(t_opt)),
    })
    return assess(rows)


def sun_times(rows: DataFrame, day: str = "day") -> DataFrame:
    """Civil dawn, sunrise, noon, sunset and civil dusk in hours UTC from lat, lon and the day number since 1970; null where the sun doesn't cross.

    The equations are NOAA's for the equation of time and the declination, with the fractional year at noon.
    """
    doy = F.dayofyear(F.date_add(F.lit("1970-01-01").cast("date"), F.col(day).cast("int")))
    g = 2 * F.pi() / 365 * (doy - 1 + 0.5)
    rows = rows.withColumn("_g", g)
    g = F.col("_g")
    eqtime = 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))
    decl = 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
    rows = rows.withColumn("_d", decl).withColumn("noon", (720 - 4 * F.col("lon") - eqtime) / 60)
    phi = F.radians("lat")

    def half_day(zenith: float):
        x = (F.cos(F.radians(F.lit(zenith))) - F.sin(phi) * F.sin(F.col("_d"))) / (F.cos(phi) * F.cos(F.col("_d")))
        return F.when(F.abs(x) <= 1, F.degrees(F.acos(x)) / 15)

    rows = rows.withColumn("_s", half_day(90.833)).withColumn("_c", half_day(96.0))
    noon, s, c = F.col("noon"), F.col("_s"), F.col("_c")
    return rows.withColumns({"dawn": noon - c, "sunrise": noon - s, "sunset": noon + s, "dusk": noon + c}).drop("_g", "_d", "_s", "_c")


def light_windows(rows: DataFrame, hours: float = P.DAY_SCORE["window_hours"]) -> DataFrame:
    window = lambda label, a, b: F.struct(F.lit(label).alias("label"), a.alias("start"), b.alias("end"))
    return rows.withColumn("best_hours", F.array(window("morning", F.col("dawn"), F.col("sunrise") + hours), window("evening", F.col("sunset") - hours, F.col("dusk"))))


def score_days(features: DataFrame, p: dict = P.DAY_SCORE) -> DataFrame:
    """Day score, go flag (on the unrounded score), band and contributions by rule, from the regime."""
    pressure = F.coalesce(C.lookup(F.col("regime"), p["regimes"]), F.lit(0.0)) * p["w_pressure"]
    return features.withColumn("day_score", C.day_score(F.col("regime"), p)).withColumns({
        "go": F.col("day_score") >= p["go"], "band": C.band(F.col("day_score"), p),
        "contributions": F.map_from_arrays(F.array(F.lit("pressure_trend"), F.lit("light_window")), F.array(F.bround(pressure, 3), F.lit(round(p["light"] * p["w_light"], 3)))),
    })


def predictions(sites: DataFrame, readings: DataFrame, today: int, horizons: int = 7, ruleset: str = "v0.4", key: str = "site_id") -> DataFrame:
    """Append-only rows for ``horizons`` + 1 days, each anchored at 12:00 UTC; ``inputs_hash`` is of what they were made from."""
    grid = sites.select(key, F.explode(F.sequence(F.lit(0), F.lit(horizons))).alias("horizon")).withColumn("target_day", F.lit(today) + F.col("horizon"))
    grid = grid.withColumn("at", F.col("target_day").cast("long") * P.DAY + 12 * P.HOUR)
    scored = score_days(W.pressure_features(grid.select(key, "at").distinct(), readings, key=key))
    out = grid.join(scored, [key, "at"], "left")
    return out.withColumn("ruleset", F.lit(ruleset)).withColumn("inputs_hash", F.sha2(F.to_json(F.struct(key, "target_day", "horizon", F.round("dp_6h", 6), F.round("dp_24h", 6), F.round("stability_48h", 6), "ruleset")), 256))


def sweep(conditions: DataFrame, temperatures: list[float], t_opt: float = P.SPECIES["roach"]) -> DataFrame:
    """The bite terms over water temperatures for every row of wind conditions (wind_ms)."""
    rows = conditions.withColumn("water_c", F.explode(F.array(*[F.lit(float(t)) for t in temperatures])))
    rows = C.with_oxygen(rows, F.col("water_c"), F.col("wind_ms"), F.lit(P.OXYGEN["fetch"]))
    rows = rows.withColumns({"f_oxygen": C.oxygen_term(F.col("oxygen")), "f_temp": C.temperature_term(F.col("water_c"), F.lit(t_opt))})
    return rows.withColumn("bite_index", C.combine(F.lit(1.0), F.col("f_oxygen"), F.col("f_temp"), F.lit(0.0), F.lit(1.0)))
