"""Literal cases of the time-series and model operators."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from sitecast import params as P
from sitecast.functions import columns as C
from sitecast.operators import model as M
from sitecast.operators import weather as W

NOW = 20_000 * 86_400
SCHEMA = "site_id long, ts long, pressure_msl double, temp_c double, dewpoint_c double, wind_ms double, shortwave double, wind_dir double, is_forecast boolean"


def series(spark, pressures, temps=None, now=NOW):
    n = len(pressures)
    return spark.createDataFrame([(1, now - (n - 1 - i) * 3600, p, (temps[i] if temps else 15.0), 10.0, 4.0, 0.0, 90.0, False) for i, p in enumerate(pressures)], SCHEMA)


def at(spark, *times):
    return spark.createDataFrame([(1, t) for t in times], "site_id long, at long")


def test_falling_pressure(spark):
    hours = series(spark, [1015.0] * 44 + [1014.5, 1013.5, 1012.5, 1011.5, 1010.5, 1009.5])
    r = W.pressure_features(at(spark, NOW), hours).first()
    assert r.dp_6h == -5.5 and r.regime == "falling_fast"


def test_flat_and_missing_pressure(spark):
    flat = W.pressure_features(at(spark, NOW), series(spark, [1013.0] * 49)).first()
    assert (flat.dp_6h, flat.stability_48h, flat.regime) == (0.0, 0.0, "stable")
    none = W.pressure_features(at(spark, NOW), series(spark, [None] * 5)).first()
    assert none.dp_6h is None and none.stability_48h is None and none.regime is None


def test_lookback_holds_both_ends(spark):
    r = W.summarise(at(spark, NOW), series(spark, [1000.0 + i for i in range(100)]), "pressure_msl", 72, 0.8).first()
    assert (r.n, r.span, r.coverage, r.available) == (73, 72.0, 1.0, True)
    none = W.summarise(at(spark, NOW + 10**7), series(spark, [1000.0]), "pressure_msl", 72, 0.8).first()
    assert (none.n, none.span, none.available) == (0, None, False)


def test_nearest_prefers_the_earlier_on_a_tie(spark):
    hours = series(spark, [1.0, 2.0, 3.0], [5.0, 6.0, 7.0])
    r = W.nearest_within(at(spark, NOW - 1800), hours, "temp_c").first()
    assert (r.temp_c, r.age_min) == (6.0, 30)
    assert W.nearest_within(at(spark, NOW + 4 * 3600), hours, "temp_c").count() == 0


def test_streak_ends_at_an_unknown_day(spark):
    spans = spark.createDataFrame([(1, 5, 0, 1.0, 1.0), (1, 5, 1, 1.0, 2.0), (1, 5, 2, None, 1.0), (1, 5, 3, 1.0, 1.0)], "site_id long, at long, block int, span_p double, span_t double")
    assert W.stable_streak(spans).first().stable_days == 2


def test_upserts_are_idempotent(spark):
    rows = spark.createDataFrame([(1, "a", 10, 1, 100, 5.0, True), (1, "a", 10, 2, 200, 6.0, False)], "site_id long, source string, ts long, delivery long, fetched_at long, temp_c double, is_forecast boolean")
    once = W.newest_fetch(rows)
    assert [r.temp_c for r in once.collect()] == [6.0] and not once.first().is_forecast
    assert W.newest_fetch(once).collect() == once.collect()


def test_backfill_skips_stored_and_void_hours(spark):
    schema = "site_id long, source string, ts long, delivery long, pressure_msl double, temp_c double"
    archive = spark.createDataFrame([(1, "a", 1, 1, 1.0, None), (1, "a", 2, 2, None, None), (1, "a", 3, 3, None, 4.0)], schema)
    new = W.backfill_new(archive, archive.where("ts = 3"))
    assert [r.ts for r in new.collect()] == [1]
    assert W.backfill_new(archive, archive).count() == 0


@pytest.mark.parametrize(("end", "hours"), [(5, 1), (3 * 3600 + 2400, 4)])
def test_gap_closes_only_when_whole(spark, end, hours):
    gaps = spark.createDataFrame([(7, 1, 300, end if hours > 1 else 305)], "gap_id long, site_id long, from_ts long, to_ts long")
    held = spark.createDataFrame([(1, h * 3600, "other") for h in range(hours - 1)] or [(2, 0, "other")], "site_id long, ts long, source string")
    r = W.gap_hours(gaps, held).first()
    assert (r.hours, r.present, r.complete) == (hours, hours - 1, False)
    full = W.gap_hours(gaps, spark.createDataFrame([(1, h * 3600, "other") for h in range(hours)], "site_id long, ts long, source string")).first()
    assert full.complete and full.covered_by == ["other"]


def test_clamp_keeps_null_and_regimes_are_ordered(spark):
    r = spark.range(1).select(C.clamp(F.lit(None).cast("double"), 0, 1).alias("a"), C.clamp(F.lit(5.0), 0, 1).alias("b"), C.wind_bucket(F.lit(25.0)).alias("c"), C.compass(F.lit(350.0)).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == (None, 1.0, 20, "N")


def test_equilibrium_with_missing_inputs(spark):
    none = F.lit(None).cast("double")
    r = spark.range(1).select(C.equilibrium(F.lit(20.0), none, none, none).alias("a"), C.equilibrium(none, none, none, none).alias("b")).first()
    assert r.a == 20.0 and r.b is None


def test_a_fatal_factor_is_not_rescued(spark):
    one, none = F.lit(1.0), F.lit(None).cast("double")
    rows = spark.range(1).select(F.lit(1.0).alias("f_pressure"), F.lit(0.0).alias("f_oxygen"), F.lit(1.0).alias("f_temp"), F.lit(0.0).alias("approach"), F.lit(1.0).alias("stability"), F.lit(2).alias("stable_days"), F.lit(1.0).alias("coverage"))
    r = M.assess(rows).first()
    assert r.bite_index < 0.25 and r.limiting == "oxygen"
    gone = M.assess(rows.withColumn("f_pressure", none)).first()
    assert gone.bite_index is None and gone.missing == "pressure" and gone.limiting is None
    tie = M.assess(rows.withColumn("f_oxygen", one)).first()
    assert tie.limiting == "pressure"


def test_heat_wave_replay(spark):
    """Eight days of a heat wave that breaks, mornings at 06:00: water, oxygen, bite and what limits it."""
    days = [(33, 20, 1004), (34, 21, 1004), (34, 21, 1005), (33, 21, 1006), (31, 20, 1008), (26, 17, 1011), (22, 13, 1013), (21, 12, 1013)]
    rows = []
    for d, (high, low, p) in enumerate(days):
        for h in range(24):
            temp = (high + low) / 2 + (high - low) / 2 * math.cos(2 * math.pi * (h - 15) / 24)
            rows.append((1, NOW + (d * 24 + h) * 3600, float(p), temp, temp - 6, 4.0, max(0.0, 800 * math.sin(math.pi * (h - 5) / 15)) if 5 <= h <= 20 else 0.0, 90.0, False))
    hours = spark.createDataFrame(rows, SCHEMA)
    norms = spark.createDataFrame([(1, 1013.0)], "site_id long, norm double")
    got = M.replay(at(spark, *(NOW + (d * 24 + 6) * 3600 for d in range(3, 8))), hours, norms).orderBy("at").collect()
    water = [r.water_c for r in got]
    assert water == sorted(water, reverse=True) or water[0] < 30
    assert all(r.bite_index is None or 0 <= r.bite_index <= 1 for r in got) and got[0].oxygen < got[-1].oxygen
    assert got[-1].bite_index > got[0].bite_index


def test_band_holds_its_centre(spark):
    hours = series(spark, [1013.0] * 80, [15 + 5 * math.sin(i / 4) for i in range(80)])
    band = M.water_band(at(spark, NOW), hours).first()
    plain = M.water_estimate(at(spark, NOW), hours).first()
    assert band.low <= band.central <= band.high and band.low <= plain.water_c <= band.high
    assert M.water_band(at(spark, NOW), series(spark, [1.0] * 5)).first().central is None


def test_sun_times_of_a_known_day(spark):
    rows = spark.createDataFrame([(52.23, 21.01, 19894), (80.0, 20.0, 19894)], "lat double, lon double, day int")
    r = M.sun_times(rows).collect()
    assert abs(r[0].sunrise - 2.25) < 0.15 and abs(r[0].sunset - 19.0) < 0.15 and r[0].dawn < r[0].sunrise < r[0].noon < r[0].sunset < r[0].dusk
    assert r[1].sunrise is None


def test_phase_needs_two_days(spark):
    rows = spark.createDataFrame([(1, i * 86400, "a" if i < 4 else "b") for i in range(7)], "site_id long, at long, c string")
    assert [r.phase for r in W.settle(rows, "c").orderBy("at").collect()] == [None, None, "a", "a", "a", "a", "b"]


def test_day_score_bands(spark):
    rows = spark.createDataFrame([("falling_slow",), ("stable",), ("rising_fast",), (None,)], "regime string")
    got = [(round(r.day_score, 6), r.go, r.band) for r in M.score_days(rows).collect()]
    assert got == [(10.0, True, "green"), (8.8, True, "green"), (5.5, True, "yellow"), (7.0, True, "yellow")]
    assert P.DAY_SCORE["go"] == 5.5
