"""Column functions: null-safe arithmetic, pressure, water, oxygen, bite, wind and flat-earth geometry.

A missing input gives null, never a filled-in value, unless a docstring says that the input is optional.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitecast import params as P

M_PER_DEG = 111_320.0


def clamp(x: Column, lo: float, hi: float) -> Column:
    """x cut to [lo, hi]; null stays null (``greatest`` and ``least`` alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x)))


def first_match(rules: dict[str, str]) -> Column:
    """Name of the first predicate that holds, in order; null if none does."""
    out = F
    for name, predicate in rules.items():
        out = out.when(F.expr(predicate), name)
    return out


def lookup(x: Column, table: dict, default=None) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(x == k, v)
    return out.otherwise(default)


# Weather stability


def range_term(span: Column, full: float) -> Column:
    return clamp(1 - span / full, 0, 1)


def stability_index(p: dict = P.STABILITY) -> Column:
    """From n_p, n_t, span_p, span_t: product of two range terms, null when either window is sparse."""
    enough = lambda n: (F.col(n) >= 2) & (F.least(F.lit(1.0), F.col(n) / p["hours"]) >= p["min_coverage"])
    return F.when(enough("n_p") & enough("n_t"), range_term(F.col("span_p"), p["pressure_full"]) * range_term(F.col("span_t"), p["temp_full"]))


# Water temperature


def equilibrium(air: Column, sun: Column, dew: Column, wind: Column, p: dict = P.WATER) -> Column:
    """Where the water would settle; sun, dew point and wind are optional and neutral when missing."""
    gust = F.least(F.lit(p["wind_cap"]), 1 + F.coalesce(wind, F.lit(0.0)) / p["wind_ref"])
    loss = p["evaporation"] * F.greatest(F.lit(0.0), air - dew) * gust
    return air * p["air_weight"] + F.coalesce(p["sun_gain"] * sun / 1000.0, F.lit(0.0)) - F.when(dew.isNotNull(), loss).otherwise(0.0)


def relax(samples: Column, seed: Column, depth: Column, p: dict = P.WATER) -> Column:
    """Water temperature after each sample: array of structs (ts, water), from sorted structs (ts, eq).

    T moves toward eq by step/tau, the first step one hour, none longer than tau.
    """
    tau = p["tau_days_per_m"] * F.greatest(F.lit(0.3), depth) * 24.0
    state = F.struct(seed.cast("double").alias("water"), F.lit(None).cast("long").alias("ts"), F.array().cast("array<struct<ts:bigint,water:double>>").alias("path"))

    def step(s: Column, x: Column) -> Column:
        hours = F.coalesce((x["ts"] - s["ts"]) / 3600.0, F.lit(1.0))
        water = s["water"] + (x["eq"] - s["water"]) * (F.greatest(F.lit(0.0), F.least(hours, tau)) / tau)
        return F.struct(water.alias("water"), x["ts"].alias("ts"), F.concat(s["path"], F.array(F.struct(x["ts"].alias("ts"), water.alias("water")))).alias("path"))

    return F.aggregate(samples, state, step, lambda s: s["path"])


def phase_from_water(water: Column, trend: Column, t_opt: Column, p: dict = P.PHASE) -> Column:
    return F.when(water.isNull() | trend.isNull() | t_opt.isNull(), "unknown").when(water >= t_opt, "summer_stagnation").when(trend >= p["warming"], "spring_warming").when(trend <= p["cooling"], "autumn_cooling").otherwise("holding")


# Oxygen


def oxygen_saturation(water: Column, p: dict = P.OXYGEN) -> Column:
    return _saturation_at(clamp(water, 0, 40), p)


def _saturation_at(t: Column, p: dict = P.OXYGEN) -> Column:
    c = p["saturation"]
    return c[0] + c[1] * t + c[2] * t * t + c[3] * t * t * t


def oxygen_respiration(water: Column, p: dict = P.OXYGEN) -> Column:
    return p["r20"] * F.pow(F.lit(p["q10"]), (water - 20) / 10)


def oxygen_reaeration(wind: Column, fetch: Column, saturation: Column, before: Column, p: dict = P.OXYGEN) -> Column:
    """Capped by max_boost and by the room below saturation."""
    blow = F.when(wind.isNotNull(), F.greatest(F.lit(0.0), wind)) / p["wind_ref"]
    energy = clamp(F.when(fetch.isNotNull(), F.greatest(F.lit(0.0), fetch)) * blow * blow, 0, 1)
    return F.when(energy.isNotNull() & before.isNotNull(), F.least(energy * p["max_boost"] * saturation, F.greatest(F.lit(0.0), saturation - before)))


def dissolved_oxygen(water: Column, wind: Column, fetch: Column, p: dict = P.OXYGEN) -> Column:
    sat = oxygen_saturation(water, p)
    before = F.when(water.isNotNull(), F.greatest(F.lit(0.0), sat - oxygen_respiration(water, p)))
    gain = oxygen_reaeration(wind, fetch, sat, before, p)
    return F.when(gain.isNotNull(), F.least(sat, before + gain))


def with_oxygen(rows: DataFrame, water: Column, wind: Column, fetch: Column, name: str = "oxygen", p: dict = P.OXYGEN) -> DataFrame:
    """``rows`` with dissolved oxygen, step by step: each step is a column, so that the steps after it don't repeat it."""
    rows = rows.withColumn("_t", clamp(water, 0, 40)).withColumn("_sat", _saturation_at(F.col("_t"), p))
    rows = rows.withColumn("_before", F.when(water.isNotNull(), F.greatest(F.lit(0.0), F.col("_sat") - oxygen_respiration(water, p))))
    rows = rows.withColumn("_gain", oxygen_reaeration(wind, fetch, F.col("_sat"), F.col("_before"), p))
    return rows.withColumn(name, F.when(F.col("_gain").isNotNull(), F.least(F.col("_sat"), F.col("_before") + F.col("_gain")))).drop("_t", "_sat", "_before", "_gain")


def oxygen_term(dissolved: Column, p: dict = P.OXYGEN) -> Column:
    """The owner's thresholds, or the provisional pair; null if neither or if they are the wrong way round."""
    lo, hi = (p["stops"], p["good"]) if p["stops"] is not None and p["good"] is not None else (p["provisional_stops"], p["provisional_good"])
    if lo is None or hi is None or hi <= lo:
        return F.lit(None).cast("double")
    return clamp((dissolved - lo) / (hi - lo), 0, 1)


# Bite


def pressure_comfort(now: Column, norm: Column, p: dict = P.BITE) -> Column:
    return clamp(1 - F.abs(now - norm) / p["comfort_width"], 0, 1)


def pressure_approach(now: Column, norm: Column, day_ago: Column, p: dict = P.BITE) -> Column:
    return clamp((F.abs(day_ago - norm) - F.abs(now - norm)) / p["approach_full"], -1, 1)


def temperature_term(water: Column, t_opt: Column, t_zero: float = P.T_ZERO) -> Column:
    """Rising limb only; null for a species without an optimum above the floor."""
    return F.when(t_opt > t_zero, clamp((water - t_zero) / (t_opt - t_zero), 0, 1))


def combine(pressure: Column, oxygen: Column, temp: Column, approach: Column, stability: Column, p: dict = P.BITE) -> Column:
    """Softened limiter; a missing approach counts 0, a missing stability 1."""
    near, calm = F.coalesce(approach, F.lit(0.0)), F.coalesce(stability, F.lit(1.0))
    worst = F.when(pressure.isNotNull() & oxygen.isNotNull() & temp.isNotNull(), F.least(pressure, oxygen, temp))
    core = (1 - p["blend"]) * worst + p["blend"] * (pressure + oxygen + temp) / 3
    return clamp(core * (1 + p["w_approach"] * near) * (p["stability_floor"] + (1 - p["stability_floor"]) * F.greatest(calm, F.lit(0.0), near)), 0, 1)


def confidence(stability: Column, days: Column, coverage: Column, f_oxygen: Column, p: dict = P.CONFIDENCE, ideal: float = P.STABILITY["ideal_days"]) -> Column:
    base = clamp(p["base"] + p["stability"] * stability + p["days"] * F.least(days / max(1.0, ideal), F.lit(1.0)) + p["coverage"] * clamp(coverage, 0, 1), 0, 1)
    return clamp(base * (1 - p["heat_penalty"] * (1 - clamp(f_oxygen, 0, 1))), 0, 1)


# Day score


def day_score(regime: Column, p: dict = P.DAY_SCORE) -> Column:
    pressure = F.coalesce(lookup(regime, p["regimes"]), F.lit(0.0))
    return clamp(5 + 5 * (pressure * p["w_pressure"] + p["light"] * p["w_light"]), 0, 10)


def band(score: Column, p: dict = P.DAY_SCORE) -> Column:
    out = F
    for most, name in p["bands"]:
        out = out.when(F.lit(True) if most is None else score < most, name)
    return out


# Wind and geometry


def circular_mean(direction: Column) -> Column:
    """Aggregate: mean direction in whole degrees, null when empty or cancelling."""
    s, c = F.sum(F.sin(F.radians(direction))), F.sum(F.cos(F.radians(direction)))
    return F.when((F.abs(s) > 1e-9) | (F.abs(c) > 1e-9), F.pmod(F.bround(F.degrees(F.atan2(s, c))), F.lit(360.0)))


def compass(deg: Column) -> Column:
    points = F.array(*[F.lit(x) for x in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    return F.get(points, F.floor(F.pmod(deg + 22.5, F.lit(360.0)) / 45).cast("int"))


def wind_bucket(deg: Column) -> Column:
    """Nearest ten degrees, halves to even: 25 is 20."""
    return F.pmod((F.bround(deg / 10) * 10).cast("long"), F.lit(360))


def wind_exposure(wind_from: Column, aspect: Column) -> Column:
    return F.bround(F.cos(F.radians(wind_from - aspect)), 3)


def flat_distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    mid = F.radians((lat1 + lat2) / 2)
    return F.hypot((lat2 - lat1) * M_PER_DEG, (lon2 - lon1) * M_PER_DEG * F.cos(mid))


def cell_size(area_ha: Column, target: int = 5000, lo: float = 5.0, hi: float = 150.0, default: float = 5.0) -> Column:
    size = F.greatest(F.lit(lo), F.least(F.lit(hi), F.bround(F.sqrt(area_ha * 10_000.0 / target))))
    return F.when(area_ha > 0, size).otherwise(default)


def fine_cell_size(area_ha: Column, least_ha: float = 50.0, target: int = 20_000, lo: float = 5.0, hi: float = 60.0) -> Column:
    return F.when(area_ha >= least_ha, F.greatest(F.lit(lo), F.least(F.lit(hi), F.bround(F.sqrt(area_ha * 10_000.0 / target)))))


def ring_area_ha(ring: Column) -> Column:
    """Shoelace on a local projection; null for fewer than four points or no area.  ring: structs (lon, lat), closed."""
    n = F.size(ring)
    mid = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["lat"]) / n
    kx = M_PER_DEG * F.cos(F.radians(mid))
    pairs = F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda a, b: a["lon"] * kx * b["lat"] * M_PER_DEG - b["lon"] * kx * a["lat"] * M_PER_DEG)
    area = F.abs(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)) / 2 / 10_000.0
    return F.when((n >= 4) & (area > 0), area)


def point_in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Parity of the edges that a ray to the east crosses."""
    n = F.size(ring)
    cross = F.zip_with(ring, F.concat(F.slice(ring, 2, n - 1), F.slice(ring, 1, 1)), lambda a, b: ((a["lat"] > lat) != (b["lat"] > lat)) & (lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.when(b["lat"] != a["lat"], b["lat"] - a["lat"]) + a["lon"]))
    return F.size(F.filter(cross, lambda x: x)) % 2 == 1


def circle_ring(lat: Column, lon: Column, area_ha: Column) -> Column:
    """25 vertices, one every 15 degrees, at the radius of a circle of that area."""
    r = F.sqrt(area_ha * 10_000.0 / F.pi())
    return F.transform(F.sequence(F.lit(0), F.lit(360), F.lit(15)), lambda b: F.struct((lon + r * F.sin(F.radians(b)) / (M_PER_DEG * F.cos(F.radians(lat)))).alias("lon"), (lat + r * F.cos(F.radians(b)) / M_PER_DEG).alias("lat")))


def mean_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns) / len(columns)
