"""Map objects of one name, led patch by patch, against the greedy pass over all of them."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from sitecast.operators import registry as R

SCHEMA = "cand_id long, pos long, name string, kind string, osm_type string, area_ha double, lat double, lon double"


def greedy(rows, metres=1500.0):
    groups: list[list[tuple]] = []
    for r in sorted(rows, key=lambda r: r[1]):
        linear = r[3] in ("river", "canal")
        for g in groups:
            h = g[0]
            if h[2].lower() != r[2].lower() or (h[3] in ("river", "canal")) != linear:
                continue
            if linear or None not in (r[6], r[7], h[6], h[7]) and math.hypot((r[6] - h[6]) * R.M, (r[7] - h[7]) * R.M * math.cos(math.radians((r[6] + h[6]) / 2))) <= metres:
                g.append(r)
                break
        else:
            groups.append([r])
    rank = {"relation": 2, "way": 1}
    return collections.Counter((max(g, key=lambda r: (rank.get(r[4], 0), r[5] or 0.0, -r[1]))[0], len(g)) for g in groups)


@pytest.mark.parametrize("lat", [0.0, 52.0, -74.0])
def test_patches_equal_the_greedy_pass(spark, lat):
    rng = random.Random(6)
    rows = [(i, i, rng.choice(("Biale", "Czarne", "biale")), rng.choice(("lake", "lake", "pond", "river")), rng.choice(("way", "node", "relation")), rng.choice((None, 1.0, 2.0, 5.0)), lat + rng.gauss(0, 0.05), 179.9 * (rng.random() < 0.01) + 21 + rng.gauss(0, 0.1)) for i in range(800)]
    rows += [(900, 900, "Biale", "lake", "way", 1.0, None, 21.0), (901, 901, "Biale", "lake", "way", 1.0, lat, None)]
    rng.shuffle(rows)
    found = R.collapse(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert collections.Counter((r.cand_id, r.members) for r in found) == greedy(rows)
    assert R.collapse(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_name_is_many_tasks(spark):
    """A hundred thousand objects of one name: patches of a few, none of which holds a hundredth."""
    n = 100_000
    rows = spark.range(n).select(F.col("id").alias("cand_id"), F.col("id").alias("pos"), F.lit("Staw").alias("name"), F.lit("pond").alias("kind"), F.lit("way").alias("osm_type"), F.lit(1.0).alias("area_ha"), (F.lit(49.0) + F.col("id") % 300 * 0.04 + F.rand(1) * 0.002).alias("lat"), (F.lit(14.0) + F.floor(F.col("id") / 300) % 120 * 0.09 + F.rand(2) * 0.002).alias("lon"))
    found = R.collapse(rows)
    total, most, waters = found.agg(F.sum("members"), F.max("members"), F.count("*")).first()
    assert total == n and most < 20 and 30_000 <= waters <= 40_000


def test_roots_are_the_smallest_reached(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(i + 1000, i + 1001) for i in range(90)]
    edges = [(max(e), min(e)) for e in edges if e[0] != e[1]]
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    assert {r.node: r.root for r in R.roots(spark.createDataFrame(edges, "u long, v long")).collect()} == root
