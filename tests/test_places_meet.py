"""Rows of equal places meet as one place, rows of a small file are many tasks, and both give what all pairs give."""

import math
import random

from sitecast.operators import geo as G
from sitecast.operators import registry as R
from sitecast.plans import geo_queries as Q

SF = "/root/testdata/sf0.001"


def metres(a, b, c, d):
    return math.hypot((c - a) * G.M, (d - b) * G.M * math.cos(math.radians((a + c) / 2)))


def aggregates(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate")


def spots(rng, n, first=0):
    return [(first + i, 50 + rng.randrange(6) * 0.01, 20 + rng.randrange(6) * 0.01) for i in range(n)]


def test_nearest_vertex_of_places(spark):
    rng = random.Random(1)
    points, ends = spots(rng, 300), spots(rng, 300, 1000)
    lines = spark.createDataFrame([(i, [{"lat": y, "lon": x}, {"lat": y + 0.003, "lon": x}]) for i, y, x in ends], "entry_id long, line array<struct<lat:double,lon:double>>")
    found = G.nearest_vertex(spark.createDataFrame(points, "query_id long, lat double, lon double"), lines, 0.9)
    want = {}
    for q, y, x in points:
        near = [(metres(y, x, b + more, c) / 1000, i) for i, b, c in ends for more in (0, 0.003)]
        if min(near)[0] <= 0.9:
            want[q] = min(near)[1]
    assert {r.query_id: r.entry_id for r in found.collect()} == want and want
    assert aggregates(found) >= 3


def test_cells_of_a_small_file_are_many_tasks(spark):
    assert Q.geo9_grid_cells(spark, SF).rdd.getNumPartitions() == 4


def test_cells_of_a_ring_that_turns_back(spark):
    """Rows that a ring crosses four times have cells in two spans."""
    from pyspark.sql import functions as F

    from sitecast.functions import columns as C

    ring = [(20.0, 50.0), (20.03, 50.0), (20.03, 50.02), (20.02, 50.02), (20.02, 50.005), (20.01, 50.005), (20.01, 50.02), (20.0, 50.02), (20.0, 50.0)]
    base = spark.createDataFrame([(1, [{"lon": x, "lat": y} for x, y in ring], 150.0)], f"site_id long, ring {G.RING}, cell_m double")
    box = G._boxes(base).withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    box = box.withColumn("clat", F.col("y0") + (F.col("row") + 0.5) * F.col("dy")).withColumn("clon", F.col("x0") + (F.col("col") + 0.5) * F.col("dx"))
    want = {tuple(r) for r in box.where(C.point_in_ring(F.col("clat"), F.col("clon"), F.col("ring"))).select("row", "col", "clat", "clon").collect()}
    assert {(r.row, r.col, r.lat, r.lon) for r in G.grid(base).collect()} == want and len(want) > 100


def test_existing_sites_of_places(spark):
    rng = random.Random(2)
    named = lambda rows: [(i, f"Name {rng.randrange(3)}", rng.choice((None, "NAME 1")), "way", i, y, x) for i, y, x in rows]
    candidates, stored = named(spots(rng, 200)), named(spots(rng, 200, 150))
    found = R.find_existing(*(spark.createDataFrame(rows, f"{key} long, name string, name_alt string, osm_type string, osm_id long, lat double, lon double") for rows, key in ((candidates, "cand_id"), (stored, "site_id"))), 900.0)
    for r in found.collect():
        _, name, _, _, osm, y, x = candidates[r.cand_id]
        near = [(metres(y, x, b, c), i) for i, n, alt, _, _, b, c in stored if name.lower() in (n.lower(), (alt or "").lower())]
        close = min((p for p in near if p[0] <= 900), default=(0, None))[1]
        assert (r.site_id, r.how) == ((osm, "id") if osm >= 150 else (close, close and "name"))
    assert aggregates(found) >= 5


def test_sections_of_a_small_file_are_many_tasks(spark):
    found = Q.sections(spark, SF)
    assert found.rdd.getNumPartitions() == 4
    rows = spark.createDataFrame([(g, i, float((i * 7 + g) % 5)) for g in range(3) for i in range(20)] + [(7, 0, 1.0), (8, 0, 2.0), (8, 1, 2.0)], "site_id long, index long, raw double")
    small, large = ({tuple(r) for r in G.ordinal(rows, "raw", "index", ["site_id"], small=x).collect()} for x in (True, False))
    assert small == large and len(small) == 63
