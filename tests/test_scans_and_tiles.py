"""Scans by stretches, ranks by counts, covers and descents: each equal to its plain form, and cut into many tasks."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sitecast.functions import columns as C
from sitecast.operators import geo as G
from sitecast.operators import notebook as N
from sitecast.operators import scans as S
from sitecast.operators import weather as W

HOURS = 3600


def readings(spark, seed=1):
    rng = random.Random(seed)
    rows = [(s, t * HOURS, rng.choice((None, round(rng.uniform(990, 1030), 1))), rng.uniform(5, 25)) for s in (1, 2) for t in range(600) if rng.random() < 0.4 or s == 2]
    return spark.createDataFrame(rows, "site_id long, ts long, pressure_msl double, temp_c double")


@pytest.mark.parametrize("stretch", [5 * HOURS, 40 * HOURS, S.STRETCH])
def test_scans_equal_one_window_a_site(spark, stretch):
    rng = random.Random(2)
    hours = readings(spark)
    instants = spark.createDataFrame([(s, t) for s in (1, 2, 3) for t in sorted(rng.sample(range(-9000, 700 * HOURS), 200))], "site_id long, at long")
    found = {(r.site_id, r["at"]): r.pressure_msl_asof for r in W.asof_backward(instants, hours, "pressure_msl", stretch=stretch).collect()}
    held = [(r.site_id, r.ts, r.pressure_msl) for r in hours.collect() if r.pressure_msl is not None]
    for s, at in ((r.site_id, r["at"]) for r in instants.collect()):
        assert found[s, at] == max(((t, p) for k, t, p in held if k == s and t <= at), default=(0, None))[1]

    w = Window.partitionBy("site_id").orderBy("at")
    rows = hours.select("site_id", F.col("ts").alias("at"), F.when(F.col("temp_c") > 20, "warm").when(F.col("temp_c") > 8, "mild").alias("c"))
    new = (F.lag("at").over(w).isNull() | ~F.lag("c").over(w).eqNullSafe(F.col("c"))).cast("int")
    plain = rows.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    plain = plain.withColumn("h", (F.col("at") - F.min("at").over(Window.partitionBy("site_id", "run"))) / HOURS)
    plain = plain.withColumn("phase", F.last(F.when(F.col("h") >= 3, F.col("c")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    want = {(r.site_id, r["at"]): (r.h, r.phase) for r in plain.collect()}
    assert {(r.site_id, r["at"]): (r.hours_since_change, r.phase) for r in W.settle(rows, "c", 3, stretch=stretch).collect()} == want

    total = F.sum(F.greatest(F.col("temp_c") - 10, F.lit(0.0))).over(Window.partitionBy("site_id").orderBy("ts")) / 24
    want = {(r.site_id, r.ts): r.d for r in hours.where("ts >= 36000").withColumn("d", total).collect()}
    got = {(r.site_id, r.ts): r.degree_days for r in W.degree_days(hours, 10.0, F.lit(36000), stretch=stretch).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_a_long_history_is_many_tasks(spark):
    """No window of an as-of join holds more than a stretch of a site."""
    hours = spark.range(200_000).select(F.lit(1).cast("long").alias("site_id"), (F.col("id") * 60).alias("ts"), F.rand(1).alias("p"))
    cut = S.cut(hours, "ts").groupBy(S.PART).count()
    assert cut.agg(F.max("count")).first()[0] <= S.STRETCH / 60
    plan = W.asof_backward(hours.select("site_id", F.col("ts").alias("at")), hours, "p")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "windowspecdefinition" in line and "_side" in line]
    assert windows and all(S.PART in line for line in windows)


def test_rolling_norms_know_nothing_later(spark):
    hours = readings(spark, 3)
    p = {"min_samples": 20, "window_days": 6, "step_days": 2}
    instants = spark.createDataFrame([(s, t * 7 * HOURS) for s in (1, 2, 9) for t in range(-3, 100)], "site_id long, at long")
    held = [(r.site_id, r.ts, r.pressure_msl) for r in hours.collect() if r.pressure_msl is not None]
    for r in W.rolling_norm(instants, W.value_counts(hours, "pressure_msl", 2), p).collect():
        last = math.floor(r["at"] / (2 * 86400)) * 2 * 86400
        own = sorted(v for s, t, v in held if s == r.site_id and last - 6 * 86400 <= t < last)
        assert r.n == len(own)
        median = (own[len(own) // 2] + own[(len(own) - 1) // 2]) / 2 if own else None
        assert (r.norm is None) == (len(own) < 20) and (r.norm is None or abs(r.norm - median) < 1e-9)


def test_ranks_equal_windows(spark):
    rng = random.Random(4)
    rows = [(rng.choice((1, 2)), i, float(rng.choice((rng.randrange(5), rng.randrange(300)))), rng.random()) for i in range(3000)] + [(3, 0, 1.0, 1.0), (4, 0, 2.0, 0.1), (4, 1, 2.0, 0.2)]
    cells = spark.createDataFrame(rows, "site_id long, place long, raw double, other double").repartition(5)
    w = Window.partitionBy("site_id")
    n, same = F.count("*").over(w), F.count("*").over(Window.partitionBy("site_id", "raw"))
    plain = cells.withColumn("t", F.when(n == 1, 0.5).otherwise((F.rank().over(w.orderBy("raw")) - 1 + (same - 1) / 2) / (n - 1)))
    flat = (F.max("raw").over(w) - F.min("raw").over(w)) < 1e-9
    plain = plain.withColumn("o", F.when((n == 1) | flat, 0.5).otherwise((F.row_number().over(w.orderBy("raw", "place")) - 1) / (n - 1)))
    want = {(r.site_id, r.place): (r.t, r.o) for r in plain.collect()}
    found = G.ordinal(G.percentile_ties(cells, "raw", ["site_id"], "t"), "raw", "place", ["site_id"], "o")
    assert {(r.site_id, r.place): (r.t, r.o) for r in found.collect()} == want
    few = S.ordinal_ranks(cells, ["site_id"], {"r": "raw"}, "place", pieces=8)
    assert {(r.site_id, r.place): r.r for r in few.collect()} == {(r.site_id, r.place): r.r for r in cells.withColumn("r", F.row_number().over(w.orderBy("raw", "place"))).collect()}
    x, y = (F.row_number().over(w.orderBy(c, "place")) for c in ("raw", "other"))
    d = cells.withColumn("d", x - y).groupBy("site_id").agg(F.sum(F.col("d") * F.col("d")).alias("d2"), F.count("*").alias("n")).collect()
    rho = {r.site_id: r.rho for r in N.spearman(cells, ["site_id"], "raw", "other", "place").collect()}
    assert rho == {r.site_id: 1 - 6 * r.d2 / (r.n * (r.n * r.n - 1)) if r.n > 1 else None for r in d}


def test_pieces_of_a_large_group_are_small(spark):
    cells = spark.range(300_000).select(F.lit(1).alias("g"), (F.col("id") * 7919 % 300_007).alias("raw"))
    found = S.value_ranks(cells, ["g"], "raw")
    pieces = found.groupBy(F.floor(F.col("below") / 6000)).count()
    assert found.where("same <> 1 or n <> 300000").limit(1).count() == 0 and pieces.count() == 50
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all("_piece" in line for line in plan.splitlines() if "windowspecdefinition" in line and "same" in line)


def star(n, seed, cx, cy, radius):
    rng = random.Random(seed)
    points = [(cx + radius * rng.uniform(0.5, 1) * math.cos(a * 2 * math.pi / n), cy + radius * rng.uniform(0.5, 1) * math.sin(a * 2 * math.pi / n)) for a in range(n)]
    return [*points, points[0]]


def test_covers_equal_rays(spark):
    rng = random.Random(5)
    rings = [(i, star(rng.choice((5, 40, 400)), i, rng.uniform(14, 24), rng.uniform(49, 55), rng.choice((0.01, 0.3, 4.0)))) for i in range(30)] + [(50, [(20.0, 50.0), (20.5, 50.0), (20.5, 50.5), (20.0, 50.5), (20.0, 50.0)]), (51, [])]
    listed = spark.createDataFrame(rings, f"entry_id long, ring {G.RING}")
    points = [(i, rng.uniform(46, 58), rng.uniform(10, 28)) for i in range(1500)] + [(i + 2000, 50 + i * 0.125, 20 + i * 0.125) for i in range(6)]
    points += [(3000 + 10 * k + j, y + rng.uniform(-0.02, 0.02), x + rng.uniform(-0.02, 0.02)) for k, (_, ring) in enumerate(rings[:30]) for j, (x, y) in enumerate(rng.sample(ring, 5))]
    asked = spark.createDataFrame(points, "query_id long, lat double, lon double")
    dense = asked.crossJoin(listed.where("size(ring) > 0")).where(C.point_in_ring(F.col("lat"), F.col("lon"), F.col("ring"))).groupBy("query_id").agg(F.count("*").alias("hits"), F.min("entry_id").alias("entry_id")).collect()
    want = {r.query_id: (r.hits, r.entry_id if r.hits == 1 else None) for r in dense}
    found = {r.query_id: (r.hits, r.entry_id) for r in G.points_in_rings(asked, listed).collect()}
    assert found == {q: want.get(q, (0, None)) for q, _, _ in points}
    cover = G.ring_cover(listed)
    assert cover.where("inner and size(edges) > 0").count() == 0 and cover.where("inner").count() > 100
    # A ring of 400 points isn't copied to its tiles: a tile along the edge carries a fraction of it.
    assert cover.where("not inner").agg(F.avg(F.size("edges"))).first()[0] < 40


def test_the_nearest_however_far(spark):
    rng = random.Random(6)
    others = [(i, 50 + rng.gauss(0, 0.2), 20 + rng.gauss(0, 0.3)) for i in range(300)] + [(400, -33.9, 151.2), (401, 64.1, -21.9), (402, 50.0, 20.0), (403, 50.0, 20.0), (404, None, 1.0)]
    points = [(i, rng.uniform(-80, 80), rng.uniform(-179, 179)) for i in range(150)] + [(200 + i, 50 + rng.gauss(0, 0.3), 20 + rng.gauss(0, 0.3)) for i in range(150)] + [(500, 50.0, 20.0), (501, None, 3.0)]
    found = {r.query_id: (r.entry_id, r.km) for r in G.nearest_any(spark.createDataFrame(points, "query_id long, lat double, lon double"), spark.createDataFrame(others, "entry_id long, lat double, lon double")).collect()}
    assert 501 not in found
    for q, lat, lon in points[:-1]:
        km, entry = min((math.hypot((y - lat) * G.M, (x - lon) * G.M * math.cos(math.radians((lat + y) / 2))) / 1000, e) for e, y, x in others if y is not None)
        assert found[q][0] == entry and abs(found[q][1] - km) < 1e-9
    assert G.nearest_any(spark.createDataFrame(points, "query_id long, lat double, lon double"), spark.createDataFrame([], "entry_id long, lat double, lon double")).collect() == []
