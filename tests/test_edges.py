"""Cells against few edges of a large ring: equal to all edges, and fast."""

import math
import random
import time

import numpy as np
import pytest

from sitecast.operators import geo as G


def bay(n: int, seed: int, radius: float = 0.03) -> np.ndarray:
    """A closed ring with bays and, here and there, edges without extent."""
    rng = random.Random(seed)
    waves = [(rng.randint(2, 40), rng.random() * 0.15, rng.random() * 6) for _ in range(6)]
    angles = sorted(rng.random() * 2 * math.pi for _ in range(n))
    points = [(21 + radius * r * math.cos(t), 52 + radius * r * math.sin(t) * 0.7) for t in angles for r in [1 + sum(a * math.sin(k * t + p) for k, a, p in waves)]]
    points[5] = points[6]
    return np.array([*points, points[0]])


@pytest.mark.parametrize("n", [120, 700])
@pytest.mark.parametrize("seed", [1, 2])
def test_few_edges_equal_all_edges(n, seed):
    ring = bay(n, seed)
    ys, xs = np.linspace(51.97, 52.03, 43), np.linspace(20.95, 21.05, 57)
    r, c = np.nonzero(G._inside(ys, xs, ring[:, 0], ring[:, 1]))
    lat, lon = ys[r], xs[c]
    kx = G.M * np.cos(np.radians(lat))
    winds = [0.0, 45.0, 90.0, 133.3, 180.0, 270.0, 359.9]
    assert np.array_equal(G._rays(lon, lat, kx, ring, winds, 500.0), G._rays_by_row(lon, lat, kx, ring, winds, 500.0))
    assert np.array_equal(G._shore(lon, lat, ring), G._shore_by_tile(lon, lat, ring, r // 8 * 8 + c // 8))


def test_rings_of_2700_points_keep_their_rate(spark):
    ring = [(float(a), float(b)) for a, b in bay(2700, 3)]
    sites = spark.createDataFrame([(i, ring, 15.0) for i in range(2)], f"site_id long, ring {G.RING}, cell_m double")
    G.geometry(sites.limit(1), [225.0]).count()
    begin = time.time()
    cells = G.geometry(sites, [225.0]).count()
    rate = cells / (time.time() - begin)
    print(f"{cells} cells, {rate:.0f}/s")
    assert cells > 30_000 and rate > 21_000
