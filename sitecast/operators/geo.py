"""Polygons, grids, rays, sections and spatial scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitecast import params as P
from sitecast.functions import columns as C
from sitecast.operators.scans import ordinal_ranks, with_ranks

M = C.M_PER_DEG
RING = "array<struct<lon:double,lat:double>>"


def bbox_area_ha(rows: DataFrame) -> DataFrame:
    """Hectares of the bounding box, null for lines and boxes without extent."""
    h = (F.col("lat_max") - F.col("lat_min")) * M
    w = (F.col("lon_max") - F.col("lon_min")) * M * F.cos(F.radians((F.col("lat_max") + F.col("lat_min")) / 2))
    return rows.withColumn("area_ha", F.when(~F.col("linear") & (h > 0) & (w > 0), h * w / 10_000))


def choose_ring(rings: DataFrame, lat: str = "lat", lon: str = "lon", key: str = "site_id") -> DataFrame:
    """Of several rings: with the right id the largest, else the largest around the point, else the one with the nearest vertex."""
    near = F.array_min(F.transform("ring", lambda p: F.hypot((p["lat"] - F.col(lat)) * M, (p["lon"] - F.col(lon)) * M * F.cos(F.radians(F.col(lat))))))
    inside = C.point_in_ring(F.col(lat), F.col(lon), F.col("ring"))
    scored = rings.withColumn("area", F.coalesce(C.ring_area_ha(F.col("ring")), F.lit(0.0))).withColumn("how", F.when(F.col("id_match"), 2).when(inside, 1).otherwise(0))
    order = F.struct("how", F.when(F.col("how") > 0, F.col("area")).otherwise(-near), -F.col("ring_id"))
    return scored.groupBy(key).agg(F.max_by("ring_id", order).alias("ring_id"), F.max("how").alias("how"))


def wedges(sites: DataFrame) -> DataFrame:
    """Four wedge zones around each centre, with the aspect of their bank: zone, aspect, ring (centre, 11 points, centre)."""
    zone = F.explode(F.array(*[F.struct(F.lit(n).alias("zone"), F.lit(a).alias("aspect")) for n, a in (("N", 0), ("E", 90), ("S", 180), ("W", 270))]))
    rows = sites.select("*", zone.alias("z")).select("*", "z.zone", "z.aspect").drop("z")
    r = F.sqrt(F.col("area_ha") * 10_000 / F.pi())
    centre = F.array(F.struct(F.col("lon").alias("lon"), F.col("lat").alias("lat")))
    arc = F.transform(F.sequence(F.lit(-45), F.lit(45), F.lit(9)), lambda o: F.struct((F.col("lon") + r * F.sin(F.radians(F.col("aspect") + o)) / (M * F.cos(F.radians("lat")))).alias("lon"), (F.col("lat") + r * F.cos(F.radians(F.col("aspect") + o)) / M).alias("lat")))
    return rows.withColumn("ring", F.concat(centre, arc, centre))


def _boxes(sites: DataFrame) -> DataFrame:
    """``sites`` (ring, cell_m) with the south-west corner, cell extent and numbers of rows and columns of their grids."""
    lats, lons = F.transform("ring", lambda p: p["lat"]), F.transform("ring", lambda p: p["lon"])
    box = sites.withColumns({"y0": F.array_min(lats), "y1": F.array_max(lats), "x0": F.array_min(lons), "x1": F.array_max(lons)})
    box = box.withColumn("dy", F.col("cell_m") / M).withColumn("dx", F.col("cell_m") / (M * F.cos(F.radians((F.col("y0") + F.col("y1")) / 2))))
    return box.withColumn("rows", F.greatest(F.lit(1), F.ceil((F.col("y1") - F.col("y0")) / F.col("dy")))).withColumn("cols", F.greatest(F.lit(1), F.ceil((F.col("x1") - F.col("x0")) / F.col("dx"))))


def grid(sites: DataFrame, key: str = "site_id") -> DataFrame:
    """Cells of ``cell_m`` whose centre lies in the ring: (key, row, col, lat, lon).

    A row of candidate cells is one row first, with the longitudes at which the ring crosses its latitude; a cell lies in the ring
    if an odd number of them is east of it, so the ring isn't carried to the cells.
    """
    rows = _boxes(sites).withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("lat", F.col("y0") + (F.col("row") + 0.5) * F.col("dy"))
    ends = F.zip_with("ring", F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1)), lambda a, b: F.when((a["lat"] > F.col("lat")) != (b["lat"] > F.col("lat")), (b["lon"] - a["lon"]) * (F.col("lat") - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"]))
    crossed = rows.select(key, "row", "lat", "x0", "dx", "cols", F.array_sort(F.filter(ends, lambda x: x.isNotNull())).alias("at"))
    # Between the first and the second crossing a row is inside, between the second and the third it isn't, and so on.
    spans = crossed.select("*", F.explode(F.when(F.size("at") >= 2, F.sequence(F.lit(0), F.size("at") - 2, F.lit(2)))).alias("i")).select(key, "row", "lat", "x0", "dx", "cols", F.get("at", F.col("i")).alias("west"), F.get("at", F.col("i") + 1).alias("east"))
    # One column more on each side, so that no rounding leaves out a cell; the cell's own centre decides.
    edge = lambda c, more: F.least(F.col("cols") - 1, F.greatest(F.lit(0), F.floor((F.col(c) - F.col("x0")) / F.col("dx") - 0.5) + more))
    cells = spans.withColumn("col", F.explode(F.sequence(edge("west", -1), edge("east", 2)))).withColumn("lon", F.col("x0") + (F.col("col") + 0.5) * F.col("dx"))
    return cells.where("lon >= west and lon < east").select(key, "row", "col", "lat", "lon")


def _inside(lat: np.ndarray, lon: np.ndarray, ax: np.ndarray, ay: np.ndarray) -> np.ndarray:
    """Parity of the edges that a ray to the east crosses, row of cells by row: the edges that span a row's latitude are few."""
    bx, by = np.append(ax[1:], ax[0]), np.append(ay[1:], ay[0])
    out = np.zeros((len(lat), len(lon)), bool)
    for r, y in enumerate(lat):
        e = np.flatnonzero((ay > y) != (by > y))
        at = (bx[e] - ax[e]) * (y - ay[e]) / (by[e] - ay[e]) + ax[e]
        out[r] = (lon[:, None] < at[None, :]).sum(axis=1) % 2 == 1
    return out


def _rays(x: np.ndarray, y: np.ndarray, kx: np.ndarray, ring: np.ndarray, winds: list[float], reach: float) -> np.ndarray:
    """Metres of water upwind of points inside the ring, by wind: to the first edge that each ray meets, ``reach`` at most.

    An edge meets a ray where its ends lie on different sides of it; only edges with an end within reach
    along the ray's axis can.  Points go through in chunks that fit the cache.
    """
    out = np.full((len(winds), len(x)), reach)
    ex, ey = np.diff(ring[:, 0]), np.diff(ring[:, 1]) * M
    step = max(1, 60_000 // max(1, len(ring)))
    for begin in range(0, len(x), step):
        at = slice(begin, begin + step)
        px, py = (ring[None, :, 0] - x[at, None]) * kx[at, None], (ring[None, :, 1] - y[at, None]) * M
        edge_x = ex[None, :] * kx[at, None]
        for k, wind in enumerate(winds):
            dx, dy = np.sin(np.radians(wind)), np.cos(np.radians(wind))
            side = px * dy - py * dx
            den = dx * ey[None, :] - dy * edge_x
            cell, e = np.nonzero((side[:, :-1] * side[:, 1:] <= 0) & (den != 0))
            t = (px[cell, e] * ey[e] - py[cell, e] * edge_x[cell, e]) / den[cell, e]
            ahead = t >= 0
            np.minimum.at(out[k, at], cell[ahead], t[ahead])
    return out


def _shore(x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Degrees, counted alike both ways, to the nearest point of the ring."""
    a, e = ring[:-1], np.diff(ring, axis=0)
    length = np.maximum((e**2).sum(axis=1), 1e-30)
    out = np.empty(len(x))
    step = max(1, 60_000 // max(1, len(a)))
    for begin in range(0, len(x), step):
        wx, wy = x[begin : begin + step, None] - a[None, :, 0], y[begin : begin + step, None] - a[None, :, 1]
        t = np.clip((wx * e[:, 0] + wy * e[:, 1]) / length, 0, 1)
        wx -= t * e[:, 0]
        wy -= t * e[:, 1]
        out[begin : begin + step] = np.sqrt((wx * wx + wy * wy).min(axis=1))
    return out


def _rays_by_row(x: np.ndarray, y: np.ndarray, kx: np.ndarray, ring: np.ndarray, winds: list[float], reach: float) -> np.ndarray:
    """``_rays`` for cells in the order of their rows: each edge meets only the cells of a row that lie in its shadow.

    Seen along the wind, the cells of a row stand in order and an edge covers a stretch of them, found by two
    searches; only these pairs are measured, by the same formulas.
    """
    out = np.full((len(winds), len(x)), reach)
    ex, ey = np.diff(ring[:, 0]), np.diff(ring[:, 1]) * M
    begins = np.flatnonzero(np.concatenate(([True], y[1:] != y[:-1])))
    for begin, end in zip(begins, np.append(begins[1:], len(y)), strict=True):
        own, k0, y0 = x[begin:end], kx[begin], y[begin]
        for k, wind in enumerate(winds):
            dx, dy = np.sin(np.radians(wind)), np.cos(np.radians(wind))
            seen, across = own * k0 * dy, ring[:, 0] * k0 * dy - (ring[:, 1] - y0) * M * dx
            order = np.argsort(seen, kind="stable")
            slack = 1e-6 + 1e-12 * np.abs(seen).max()
            low, high = np.minimum(across[:-1], across[1:]) - slack, np.maximum(across[:-1], across[1:]) + slack
            first = np.searchsorted(seen[order], low, side="left")
            many = np.searchsorted(seen[order], high, side="right") - first
            e = np.repeat(np.arange(len(many)), many)
            cell = order[np.repeat(first - np.cumsum(many) + many, many) + np.arange(len(e))]
            ax, ay = (ring[e, 0] - own[cell]) * k0, (ring[e, 1] - y0) * M
            bx, by = (ring[e + 1, 0] - own[cell]) * k0, (ring[e + 1, 1] - y0) * M
            edge_x = ex[e] * k0
            den = dx * ey[e] - dy * edge_x
            met = ((ax * dy - ay * dx) * (bx * dy - by * dx) <= 0) & (den != 0)
            t = (ax[met] * ey[e[met]] - ay[met] * edge_x[met]) / den[met]
            ahead = t >= 0
            np.minimum.at(out[k, begin:end], cell[met][ahead], t[ahead])
    return out


def _shore_by_tile(x: np.ndarray, y: np.ndarray, ring: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """``_shore`` for points dealt to small tiles: a tile's points meet only the edges that can be nearest to one of them.

    If the bank is d away from a tile's middle and its points lie within r of that, each has an edge within d + r, and an
    edge further than d + 2 r from the middle is further than that from all of them.
    """
    out = np.empty(len(x))
    a, e = ring[:-1], np.diff(ring, axis=0)
    length = np.maximum((e**2).sum(axis=1), 1e-30)
    order = np.argsort(tile, kind="stable")
    begins = np.flatnonzero(np.concatenate(([True], np.diff(tile[order]) != 0)))
    for own in np.split(order, begins[1:]):
        cx, cy = (x[own].min() + x[own].max()) / 2, (y[own].min() + y[own].max()) / 2
        wx, wy = cx - a[:, 0], cy - a[:, 1]
        t = np.clip((wx * e[:, 0] + wy * e[:, 1]) / length, 0, 1)
        away = np.hypot(wx - t * e[:, 0], wy - t * e[:, 1])
        spread = np.hypot(x[own] - cx, y[own] - cy).max()
        near = np.flatnonzero(away <= (away.min() + 2 * spread) * (1 + 1e-9) + 1e-12)
        wx, wy = x[own, None] - a[None, near, 0], y[own, None] - a[None, near, 1]
        t = np.clip((wx * e[near, 0] + wy * e[near, 1]) / length[near], 0, 1)
        wx -= t * e[near, 0]
        wy -= t * e[near, 1]
        out[own] = np.sqrt((wx * wx + wy * wy).min(axis=1))
    return out


#: Rings of fewer points are measured edge by edge for all cells, which is then no more work.
SMALL_RING = 100


def geometry(sites: DataFrame, winds: list[float], reach: float = 500.0, key: str = "site_id", block: int = 16) -> DataFrame:
    """The cells of ``grid`` with effective fetch for each wind and distance to the bank: (key, row, col, lat, lon, wind, fetch_m, shore_m).

    sites: key, ring, cell_m.  One input row stands for a site and ``block`` rows of cells and carries the
    ring once, as flat coordinates; its cells are made and measured in numpy.  So a site of many cells is
    spread over tasks and none holds it whole.  A centre on the ring counts as inside.
    """
    names = [key, "row", "col", "lat", "lon", "wind", "fetch_m", "shore_m"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (site, first, last, cols, y0, x0, dy, dx) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True)):
                ring = np.stack([batch.column(c)[i].values.to_numpy() for c in (8, 9)], axis=1)
                rows, ys, xs = np.arange(first, last), y0 + (np.arange(first, last) + 0.5) * dy, x0 + (np.arange(cols) + 0.5) * dx
                r, c = np.nonzero(_inside(ys, xs, ring[:, 0], ring[:, 1]))
                if not len(r):
                    continue
                lat, lon = ys[r], xs[c]
                kx = M * np.cos(np.radians(lat))
                if len(ring) < SMALL_RING:
                    shore, fetch = _shore(lon, lat, ring) * M, _rays(lon, lat, kx, ring, winds, reach)
                else:
                    shore, fetch = _shore_by_tile(lon, lat, ring, r // 8 * (cols // 8 + 1) + c // 8) * M, _rays_by_row(lon, lat, kx, ring, winds, reach)
                for wind, own in zip(winds, fetch, strict=True):
                    columns = (np.full(len(r), site, np.int64), rows[r], c, lat, lon, np.full(len(r), float(wind)), own, shore)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)

    flat = lambda c: F.transform("ring", lambda p: p[c])
    blocks = _boxes(sites).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(block).cast("long"))))
    rows = blocks.select(F.col(key).cast("long").alias(key), "first", F.least(F.col("first") + block, F.col("rows")).alias("last"), "cols", "y0", "x0", "dy", "dx", flat("lon").alias("lons"), flat("lat").alias("lats"))
    # Sites differ in their blocks by orders of magnitude; dealt anew, the blocks are the units of work.
    return rows.repartition(key, "first").mapInArrow(run, f"{key} long, row long, col long, lat double, lon double, wind double, fetch_m double, shore_m double")


def fetch_edges(points: DataFrame, wind: Column, reach: float = 500.0, key: str = "point_id") -> DataFrame:
    """The same fetch as a join of rays with edges, for small rings: points (key, lat, lon, ring)."""
    edges = points.withColumn("w", wind).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("ring") - 2)))
    kx = M * F.cos(F.radians("lat"))
    at = lambda i, d, c: (F.get("ring", i)[c] - F.col(c)) * (kx if d == "x" else F.lit(M))
    e = edges.withColumns({"ax": at(F.col("i"), "x", "lon"), "ay": at(F.col("i"), "y", "lat"), "bx": at(F.col("i") + 1, "x", "lon"), "by": at(F.col("i") + 1, "y", "lat"), "dx": F.sin(F.radians("w")), "dy": F.cos(F.radians("w"))})
    e = e.withColumns({"ex": F.col("bx") - F.col("ax"), "ey": F.col("by") - F.col("ay")}).withColumn("den", F.col("dx") * F.col("ey") - F.col("dy") * F.col("ex"))
    t = F.try_divide(F.col("ax") * F.col("ey") - F.col("ay") * F.col("ex"), F.col("den"))
    # An edge is met if its ends lie on different sides of the ray, or on it: a ray through a vertex meets an edge for certain.
    side = lambda p: F.col(f"{p}x") * F.col("dy") - F.col(f"{p}y") * F.col("dx")
    hit = (t >= 0) & (side("a") * side("b") <= 0)
    return e.groupBy(key).agg(F.least(F.lit(reach), F.coalesce(F.min(F.when(hit, t)), F.lit(reach))).alias("fetch_m"))


#: Sides of a cover's tiles in degrees, each sixteen to the one before; a tile stays whole while few edges touch it.
LEVELS = (8.0, 2.0, 0.5, 0.125, 0.03125)
FEW_EDGES = 12
COVER = "entry_id long, level int, ty long, tx long, inner boolean, edges array<struct<ax:double,ay:double,bx:double,by:double>>"


def _cover(ring: np.ndarray) -> Iterator[tuple[int, int, int, bool, np.ndarray]]:
    """Tiles (level, ty, tx, inner, edges) of a ring (lon, lat): inside as a whole, or with the edges that a ray to the east from it can cross."""
    ax, ay = ring[:, 0], ring[:, 1]
    bx, by = np.append(ax[1:], ax[0]), np.append(ay[1:], ay[0])
    x0, x1, y0, y1 = np.minimum(ax, bx), np.maximum(ax, bx), np.minimum(ay, by), np.maximum(ay, by)
    size = LEVELS[0]
    todo = [(0, ty, tx, np.arange(len(ax))) for ty in range(math.floor(ay.min() / size), math.floor(ay.max() / size) + 1) for tx in range(math.floor(ax.min() / size), math.floor(ax.max() / size) + 1)]
    while todo:
        level, ty, tx, e = todo.pop()
        size = LEVELS[level]
        south, west = ty * size, tx * size
        # A hair beyond the tile on all sides, so that no rounding of its corners leaves out an edge.
        hair = 1e-9 * (1 + abs(south) + abs(west))
        e = e[(x1[e] >= west - hair) & (x0[e] <= west + size + hair) & (y1[e] >= south - hair) & (y0[e] <= south + size + hair)]
        if len(e) == 0:
            around = south <= ay.max() and ay.min() <= south + size and west <= ax.max() and ax.min() <= west + size
            if around and _inside(np.array([south + size / 2]), np.array([west + size / 2]), ax, ay)[0, 0]:
                yield level, ty, tx, True, e
        elif level == len(LEVELS) - 1 or len(e) <= FEW_EDGES:
            yield level, ty, tx, False, np.flatnonzero((y1 >= south - hair) & (y0 <= south + size + hair) & (x1 >= west - hair))
        else:
            n = round(size / LEVELS[level + 1])
            todo += [(level + 1, ty * n + i, tx * n + j, e) for i in range(n) for j in range(n)]


def ring_cover(rings: DataFrame) -> DataFrame:
    """Rings (entry_id, ring) as tiles of several sizes (``COVER``): large ones where a ring is whole, small ones along its edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("entry_id", pa.int64()), ("level", pa.int32()), ("ty", pa.int64()), ("tx", pa.int64()), ("inner", pa.bool_()), ("edges", pa.list_(pa.struct([(c, pa.float64()) for c in ("ax", "ay", "bx", "by")])))])
        for batch in batches:
            for i, entry in enumerate(batch.column(0).to_pylist()):
                ring = np.stack([batch.column(c)[i].values.to_numpy() for c in (1, 2)], axis=1)
                ends = np.concatenate((ring, np.roll(ring, -1, axis=0)), axis=1)
                tiles = list(_cover(ring))
                for begin in range(0, len(tiles), 500):
                    some = tiles[begin : begin + 500]
                    flat = ends[np.concatenate([e for *_, e in some])]
                    edges = pa.ListArray.from_arrays(np.cumsum([0, *(len(e) for *_, e in some)]).astype(np.int32), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(4)], ["ax", "ay", "bx", "by"]))
                    level, ty, tx, inner, _ = zip(*some, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([entry] * len(some), pa.int64()), pa.array(level, pa.int32()), pa.array(ty, pa.int64()), pa.array(tx, pa.int64()), pa.array(inner), edges], schema=kinds)

    flat = lambda c: F.transform("ring", lambda p: p[c])
    rows = rings.where(F.size("ring") > 0).select(F.col("entry_id").cast("long").alias("entry_id"), flat("lon").alias("lons"), flat("lat").alias("lats"))
    return rows.repartition("entry_id").mapInArrow(run, COVER)


def points_in_rings(points: DataFrame, rings: DataFrame) -> DataFrame:
    """Points (query_id, lat, lon) with the only ring (entry_id, ring) around them; refused where there are several.

    Rings become covers (``ring_cover``), points go to their tile of each size: an equi-join.  In an inner tile that is
    all; in one along the edge a ray meets the edges that the tile carries, by the formula of ``point_in_ring``.
    """
    tiles = F.array(*[F.struct(F.lit(i).alias("level"), F.floor(F.col("lat") / size).alias("ty"), F.floor(F.col("lon") / size).alias("tx")) for i, size in enumerate(LEVELS)])
    at = points.select("query_id", "lat", "lon", F.explode(tiles).alias("t")).select("query_id", "lat", "lon", "t.*")
    lat, lon = F.col("lat"), F.col("lon")
    crossed = F.filter("edges", lambda e: ((e["ay"] > lat) != (e["by"] > lat)) & (lon < (e["bx"] - e["ax"]) * (lat - e["ay"]) / F.when(e["by"] != e["ay"], e["by"] - e["ay"]) + e["ax"]))
    met = at.join(ring_cover(rings), ["level", "ty", "tx"]).where(F.col("inner") | (F.size(crossed) % 2 == 1))
    hits = met.groupBy("query_id").agg(F.count_distinct("entry_id").alias("hits"), F.min("entry_id").alias("entry_id"))
    return points.select("query_id").join(hits, "query_id", "left").select("query_id", F.coalesce("hits", F.lit(0)).alias("hits"), F.when(F.col("hits") == 1, F.col("entry_id")).alias("entry_id"))


def near_pairs(points: DataFrame, others: DataFrame, km: float, lat: str, lon: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of ``points`` (lat, lon) and ``others`` (columns ``lat`` and ``lon``) alike in ``by`` that may be within ``km``, met in tiles and their neighbours.

    Tiles are bands of that height, as wide as it takes at the band's edge nearest to a pole.
    """
    size = km / (M / 1000)
    band = lambda y: F.floor(y / size)
    # Of a band and the next toward the pole the cosine is least at the far edge; none is taken below a hundredth.
    width = lambda b: size / F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.lit(90.0), F.greatest(F.abs(b), F.abs(b + 1)) * size + size))))
    held = others.withColumn("ty", band(F.col(lat))).withColumn("tx", F.floor(F.col(lon) / width(F.col("ty"))))
    around = points.withColumn("ty", F.explode(F.sequence(band(F.col("lat")) - 1, band(F.col("lat")) + 1)))
    tile = F.floor(F.col("lon") / width(F.col("ty")))
    return around.withColumn("tx", F.explode(F.sequence(tile - 1, tile + 1))).join(held, [*by, "ty", "tx"]).drop("ty", "tx")


def nearest_vertex(points: DataFrame, lines: DataFrame, km: float = 8.0) -> DataFrame:
    """Points with the line (entry_id, line) that has the nearest vertex, none beyond ``km``; of equally near ones the smallest id.

    Places meet, not rows: points of one place have one answer, and of lines with a vertex at one place only the smallest id can be it.
    """
    v = lines.select("entry_id", F.explode("line").alias("p")).groupBy(F.col("p.lat").alias("vlat"), F.col("p.lon").alias("vlon")).agg(F.min("entry_id").alias("entry_id"))
    met = near_pairs(points.select("lat", "lon").distinct(), v, km, "vlat", "vlon").withColumn("km", C.flat_distance_m(F.col("lat"), F.col("lon"), F.col("vlat"), F.col("vlon")) / 1000).where(F.col("km") <= km)
    found = met.groupBy("lat", "lon").agg(F.min(F.struct("km", "entry_id")).alias("best"))
    return points.select("query_id", "lat", "lon").join(found, ["lat", "lon"]).groupBy("query_id").agg(F.min("best").alias("best")).select("query_id", "best.entry_id", "best.km")


#: Sides in degrees of the tiles through which ``nearest_any`` descends; of the coarsest there are 44 from -120 to 120 and -240 to 420 degrees.
STEPS = (60.0, 15.0, 3.75, 0.9375, 0.234375, 0.05859375)


def nearest_any(points: DataFrame, others: DataFrame) -> DataFrame:
    """(query_id, entry_id, km): of ``others`` (entry_id, lat, lon) the nearest to each of ``points`` (query_id, lat, lon), however far; ties to the smaller id.

    A descent through tiles that hold any: of the tiles in question the furthest corner of the best bounds the distance, tiles that
    begin beyond it go, and the rest are opened.  A point keeps a few tiles at each size, wherever the others lie, and
    only the last tiles' contents are measured.
    """
    held = others.select("entry_id", F.col("lat").alias("elat"), F.col("lon").alias("elon")).where("elat is not null and elon is not null")
    name = lambda k: [F.floor(F.col("elat") / STEPS[k]).alias(f"y{k}"), F.floor(F.col("elon") / STEPS[k]).alias(f"x{k}")]
    own = points.select("query_id", "lat", "lon").where("lat is not null and lon is not null")
    globe = [F.explode(F.sequence(F.lit(-2), F.lit(1))).alias("y0"), F.explode(F.sequence(F.lit(-4), F.lit(6))).alias("x0")]
    asked = own.select("*", globe[0]).select("*", globe[1])
    for k in range(len(STEPS)):
        above = ["y0", "x0"] if k == 0 else [f"y{k - 1}", f"x{k - 1}"]
        # The box of what a tile holds is tighter than the tile.
        box = [F.min("elat").alias("s"), F.max("elat").alias("n"), F.min("elon").alias("w"), F.max("elon").alias("e")]
        tiles = held.select("elat", "elon", *(name(k - 1) if k else []), *name(k)).groupBy(*dict.fromkeys([*above, f"y{k}", f"x{k}"])).agg(*box)
        met = asked.join(tiles, above)
        lat, lon = F.col("lat"), F.col("lon")
        apart = lambda lo, hi, x: F.greatest(F.col(lo) - x, x - F.col(hi), F.lit(0.0)) * M
        reach = lambda lo, hi, x: F.greatest(F.abs(F.col(lo) - x), F.abs(F.col(hi) - x)) * M
        shrink = [F.cos(F.radians((lat + F.col(c)) / 2)) for c in ("s", "n")]
        widest = F.when((lat + F.col("s")) * (lat + F.col("n")) <= 0, F.lit(1.0)).otherwise(F.greatest(*shrink))
        met = met.withColumn("least", F.hypot(apart("s", "n", lat), apart("w", "e", lon) * F.least(*shrink))).withColumn("most", F.hypot(reach("s", "n", lat), reach("w", "e", lon) * widest))
        bound = F.min("most").over(Window.partitionBy("query_id"))
        asked = met.withColumn("bound", bound).where(F.col("least") <= F.col("bound") * (1 + 1e-9) + 1e-6).select("query_id", "lat", "lon", f"y{k}", f"x{k}")
    last = len(STEPS) - 1
    measured = asked.join(held.select("entry_id", "elat", "elon", *name(last)), [f"y{last}", f"x{last}"])
    km = C.flat_distance_m(F.col("lat"), F.col("lon"), F.col("elat"), F.col("elon")) / 1000
    return measured.withColumn("km", km).groupBy("query_id").agg(F.min_by("entry_id", F.struct("km", "entry_id")).alias("entry_id"), F.min("km").alias("km"))


def points_near(points: DataFrame, others: DataFrame, metres: float = 20.0) -> DataFrame:
    """Pairs (query_id, entry_id, metres) of ``points`` (query_id, lat, lon) and ``others`` (entry_id, lat, lon) no further apart than that."""
    held = others.select("entry_id", F.col("lat").alias("elat"), F.col("lon").alias("elon"))
    met = near_pairs(points.select("query_id", "lat", "lon"), held, metres / 1000, "elat", "elon")
    return met.select("query_id", "entry_id", C.flat_distance_m(F.col("lat"), F.col("lon"), F.col("elat"), F.col("elon")).alias("metres")).where(F.col("metres") <= metres)


def _walked(line: str) -> Column:
    """Metres from the line's first point to each of its points."""
    step = lambda i: C.flat_distance_m(F.get(line, i - 1)["lat"], F.get(line, i - 1)["lon"], F.get(line, i)["lat"], F.get(line, i)["lon"])
    return F.when(F.size(line) >= 2, F.aggregate(F.sequence(F.lit(1), F.size(line) - 1), F.array(F.lit(0.0)), lambda acc, i: F.concat(acc, F.array(F.element_at(acc, -1) + step(i))))).otherwise(F.array(F.lit(0.0)))


def _point_at(line: str, walked: str, metres: Column) -> Column:
    """The point so far along a line."""
    i = F.greatest(F.lit(1), F.least(F.size(line) - 1, F.size(F.filter(walked, lambda c: c < metres))))

    def between(i: Column) -> Column:
        a, b, c0, c1 = F.get(line, i - 1), F.get(line, i), F.get(walked, i - 1), F.get(walked, i)
        f = F.when(c1 > c0, (metres - c0) / (c1 - c0)).otherwise(0.0)
        return F.struct((a["lat"] + (b["lat"] - a["lat"]) * f).alias("lat"), (a["lon"] + (b["lon"] - a["lon"]) * f).alias("lon"))

    # As the argument of a function the place is looked for once, not wherever it is used.
    return F.get(F.transform(F.array(i), between), F.lit(0))


def shore_segments(rings: DataFrame, piece_m: float = 25.0, key: str = "site_id") -> DataFrame:
    """The bank cut into equal pieces of about ``piece_m``: key, index, length_m, lat, lon (the middle between its ends), normal_deg.

    ``normal_deg`` is the bearing that points out of the water: to the right of a ring that runs against the clock.
    """
    rows = rings.withColumn("walked", _walked("ring")).withColumn("total", F.element_at("walked", -1)).where("total > 0")
    turn = F.aggregate(F.sequence(F.lit(1), F.size("ring") - 1), F.lit(0.0), lambda s, i: s + F.get("ring", i - 1)["lon"] * F.get("ring", i)["lat"] - F.get("ring", i)["lon"] * F.get("ring", i - 1)["lat"])
    rows = rows.withColumn("side", F.when(turn > 0, 90.0).otherwise(-90.0)).withColumn("n", F.greatest(F.lit(1), F.bround(F.col("total") / piece_m).cast("int")))
    rows = rows.withColumn("index", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("length_m", F.col("total") / F.col("n"))
    rows = rows.withColumn("a", _point_at("ring", "walked", F.col("index") * F.col("length_m"))).withColumn("b", _point_at("ring", "walked", (F.col("index") + 1) * F.col("length_m")))
    return rows.select(key, "index", "length_m", ((F.col("a.lat") + F.col("b.lat")) / 2).alias("lat"), ((F.col("a.lon") + F.col("b.lon")) / 2).alias("lon"), F.pmod(_bearing(F.col("a"), F.col("b")) + F.col("side"), F.lit(360.0)).alias("normal_deg"))


def _bearing(a: Column, b: Column) -> Column:
    mid = F.radians((a["lat"] + b["lat"]) / 2)
    return F.pmod(F.degrees(F.atan2((b["lon"] - a["lon"]) * M * F.cos(mid), (b["lat"] - a["lat"]) * M)), F.lit(360.0))


def cut_sections(lines: DataFrame, target: int = 40, lo: float = 250.0, hi: float = 2500.0, step: float = 50.0, cap: int = 120, tail: float = 0.35, key: str = "site_id") -> DataFrame:
    """Lines (key, line: lat/lon structs) cut at exact distances into about ``target`` stretches of ``lo`` to ``hi`` metres.

    A rest under ``tail`` of a stretch joins the one before it on the same line.  Lines stay apart.  One row
    a stretch: index, start_m, length_m, points (the cut points interpolated).
    """
    seg = lines.where(F.size("line") >= 2).withColumn("cum", _walked("line")).withColumn("total", F.element_at("cum", -1)).where("total > 0")
    size = F.greatest(F.lit(lo), F.least(F.lit(hi), F.bround(F.col("total") / target / step) * step), F.ceil(F.col("total") / cap))
    seg = seg.withColumn("size", size).withColumn("whole", F.floor(F.col("total") / F.col("size")))
    rest = F.col("total") - F.col("whole") * F.col("size")
    seg = seg.withColumn("n", F.greatest(F.lit(1), F.col("whole") + F.when(rest >= tail * F.col("size"), 1).otherwise(0)))
    out = seg.withColumn("index", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("start_m", F.col("index") * F.col("size")).withColumn("end_m", F.when(F.col("index") == F.col("n") - 1, F.col("total")).otherwise((F.col("index") + 1) * F.col("size")))

    at = lambda d: _point_at("line", "cum", d)
    inner = F.transform(F.filter(F.arrays_zip(F.col("line").alias("p"), F.col("cum").alias("c")), lambda x: (x["c"] > F.col("start_m")) & (x["c"] < F.col("end_m"))), lambda x: F.struct(x["p"]["lat"].alias("lat"), x["p"]["lon"].alias("lon")))
    return out.select(key, "index", "start_m", (F.col("end_m") - F.col("start_m")).alias("length_m"), F.concat(F.array(at(F.col("start_m"))), inner, F.array(at(F.col("end_m")))).alias("points"))


def section_shape(sections: DataFrame) -> DataFrame:
    """Bearing end to end, bend index (sinuosity less one, 0..1) and the point halfway along, of a section without length its middle vertex."""
    a, b = F.element_at("points", 1), F.element_at("points", -1)
    straight = C.flat_distance_m(a["lat"], a["lon"], b["lat"], b["lon"])
    bend = F.when((straight > 0) & (F.col("length_m") > 0), C.clamp(F.col("length_m") / straight - 1, 0, 1)).otherwise(0.0)
    rows = sections.withColumn("bearing_deg", _bearing(a, b)).withColumn("bend_index", bend).withColumn("walked", _walked("points"))
    half = F.element_at("walked", -1) / 2
    middle = F.get("points", (F.size("points") / 2).cast("int"))
    return rows.withColumn("mid", F.when(half > 0, _point_at("points", "walked", half)).otherwise(F.struct(middle["lat"].alias("lat"), middle["lon"].alias("lon")))).drop("walked")


def stitch(fragments: DataFrame, key: str = "relation_id") -> DataFrame:
    """Way fragments (key, way_id, points) joined at either end into closed rings, turned round where needed; the unjoinable are dropped.

    The order of joining decides, so one relation's fragments are taken together: as many as a map relation has ways.
    """

    def join(group: pd.DataFrame) -> pd.DataFrame:
        left = [x for x in ([(p["lat"], p["lon"]) for p in x] for x in group.sort_values("way_id")["points"]) if len(x) >= 2]
        rings = []
        while left:
            cur = left.pop(0)
            while cur[0] != cur[-1]:
                at = next((i for i, x in enumerate(left) if {x[0], x[-1]} & {cur[0], cur[-1]}), None)
                if at is None:
                    break
                nxt = left.pop(at)
                if cur[-1] in (nxt[0], nxt[-1]):
                    cur = cur + (nxt if nxt[0] == cur[-1] else nxt[::-1])[1:]
                else:
                    cur = (nxt if nxt[-1] == cur[0] else nxt[::-1])[:-1] + cur
            if len(cur) >= 4 and cur[0] == cur[-1]:
                rings.append(cur)
        rows = [(group[key].iloc[0], i, len(r), [b for _, b in r], [a for a, _ in r]) for i, r in enumerate(rings)]
        return pd.DataFrame(rows, columns=[key, "ring_no", "n_points", "lon", "lat"])

    found = fragments.groupBy(key).applyInPandas(join, f"{key} long, ring_no long, n_points long, lon array<double>, lat array<double>")
    return found.withColumn("ring", F.arrays_zip("lon", "lat").cast(RING)).drop("lon", "lat")


def thin(line: Column, most: int = 160) -> Column:
    """At most ``most`` points at even steps, the last always kept."""
    n = F.size(line)
    return F.when(n <= most, line).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(line, F.when(i == most - 1, n - 1).otherwise(F.floor(i * n / most).cast("int")))))


# Scores


def percentile_ties(rows: DataFrame, raw: str, keys: list[str], name: str = "score") -> DataFrame:
    """``rows`` with the mean rank of equal values over n - 1; one row is 0.5."""
    ranked = with_ranks(rows, keys, raw)
    mean = (F.col("below") + (F.col("same") - 1) / 2) / (F.col("n") - 1)
    return ranked.withColumn("_p", F.when(F.col("n") == 1, 0.5).otherwise(mean)).select(*rows.columns, F.col("_p").alias(name))


def min_max(raw: str, keys: list[str]) -> Column:
    w = Window.partitionBy(*keys)
    span = F.max(raw).over(w) - F.min(raw).over(w)
    return F.when(span == 0, 0.5).otherwise((F.col(raw) - F.min(raw).over(w)) / span)


def ordinal(rows: DataFrame, raw: str, order: str, keys: list[str], name: str = "score", small: bool = False) -> DataFrame:
    """``rows`` with their place over n - 1, ties by ``order``; all 0.5 where the values don't spread.

    ``small`` says that no group can be large, as the sections of a line: then a group is a window.
    """
    if small:
        w = Window.partitionBy(*keys)
        n, spread = F.count("*").over(w), F.max(raw).over(w) - F.min(raw).over(w)
        ranked = rows.withColumns({"_place": F.row_number().over(w.orderBy(raw, order)), "_n": n, "_spread": spread})
        return ranked.withColumn("_p", F.when((F.col("_n") == 1) | (F.col("_spread") < 1e-9), 0.5).otherwise((F.col("_place") - 1) / (F.col("_n") - 1))).select(*rows.columns, F.col("_p").alias(name))
    ranked = ordinal_ranks(rows, keys, {"_place": raw}, order)
    spread = rows.groupBy(*keys).agg(F.count("*").alias("_n"), (F.max(raw) - F.min(raw)).alias("_spread"))
    place = F.when((F.col("_n") == 1) | (F.col("_spread") < 1e-9), 0.5).otherwise((F.col("_place") - 1) / (F.col("_n") - 1))
    return ranked.join(spread, keys).withColumn("_p", place).select(*rows.columns, F.col("_p").alias(name))


def zone_inputs(cells: DataFrame, p: dict = P.FALLBACK) -> DataFrame:
    fetch = C.clamp(F.col("fetch_m") / p["max_fetch_m"], 0, 1)
    shore = C.clamp(1 - F.col("shore_m") / p["margin_m"], 0, 1)
    return cells.withColumn("fetch_norm", fetch).withColumn("shore_prox", shore).withColumn("lee_shore", F.col("fetch_norm") * F.col("shore_prox"))


def geometry_score(cells: DataFrame, phase: str = "phase", p: dict = P.FALLBACK) -> DataFrame:
    """Raw score by the phase's weights, an unknown phase by the default's."""
    rows = zone_inputs(cells, p)
    known = F.when(F.col(phase).isin(*p["phases"]), F.col(phase)).otherwise(p["default"])
    w = lambda k: C.lookup(F.col("phase_used"), {name: v[k] for name, v in p["phases"].items()})
    rows = rows.withColumn("phase_used", known)
    return rows.withColumn("raw", w("w_fetch") * F.col("fetch_norm") + w("w_margin") * F.col("shore_prox") + w("w_shelter") * (1 - F.col("fetch_norm")) + w("w_lee") * F.col("lee_shore"))


def type_weights(rows: DataFrame, p: dict = P.ZONE) -> DataFrame:
    """Columns of weights: the base ones, or what the water type overrides."""
    return rows.withColumns({k: C.lookup(F.col("water_type"), {t: float(o.get(k, v)) for t, o in p["overrides"].items()}, float(v)) for k, v in p["weights"].items()})


TERMS = {"w_o2": "t_o2", "w_temp": "t_temp", "w_food": "lee_shore", "w_margin": "shore_prox", "w_exposure": "fetch_norm"}


def live_weights(rows: DataFrame, keys: list[str], p: dict = P.ZONE) -> DataFrame:
    """Weights of the terms that vary over a site's cells, scaled to sum to one; sites where none does have no rows.

    The spreads are one aggregate a site, a row that meets its cells again; no site is sorted or held by one task.
    """
    spreads = rows.groupBy(*keys).agg(*((F.max(t) - F.min(t)).alias(f"_s_{k}") for k, t in TERMS.items()))
    live = {f"l_{k}": F.when(F.col(f"_s_{k}") >= p["dead_spread"], F.col(k)).otherwise(0.0) for k in TERMS}
    rows = rows.join(spreads, keys).withColumns(live).drop(*(f"_s_{k}" for k in TERMS))
    total = sum((F.col(f"l_{k}") for k in TERMS), F.lit(0.0))
    return rows.withColumn("_total", total).where("_total > 0").withColumns({f"l_{k}": F.col(f"l_{k}") / F.col("_total") for k in TERMS}).drop("_total")


def factor_score(cells: DataFrame, keys: list[str], p: dict = P.ZONE) -> DataFrame:
    """Three-factor raw score of cells with water_c, water_24h, t_opt, wind_ms and water_type; cells without an oxygen term are left out.

    Warm water counts for a cell only while the water moves toward the optimum.  The score is damped by
    the cell's oxygen adequacy, not by its oxygen advantage.
    """
    rows = type_weights(zone_inputs(cells), p)
    rows = C.with_oxygen(rows, F.col("water_c"), F.col("wind_ms"), F.col("fetch_norm"), "_o2")
    rows = rows.withColumn("adequacy", C.oxygen_term(F.col("_o2"))).drop("_o2").where("adequacy is not null")
    toward = C.clamp((F.abs(F.col("water_24h") - F.col("t_opt")) - F.abs(F.col("water_c") - F.col("t_opt"))) / p["t_dir_full"], -1, 1)
    rows = rows.withColumn("t_temp", C.clamp(F.col("fetch_norm") * F.col("shore_prox"), 0, 1) * toward).withColumn("t_o2", C.clamp(F.col("fetch_norm") * (1 - F.col("adequacy")), 0, 1))
    rows = live_weights(rows, keys, p)
    core = sum((F.col(f"l_{k}") * F.col(t) for k, t in TERMS.items()), F.lit(0.0))
    return rows.withColumn("raw", core * C.clamp(F.col("adequacy") / p["gate_floor"], 0, 1))


def river_score(sections: DataFrame, wind: str = "wind_dir", p: dict = P.RIVER) -> DataFrame:
    """Bend and cross-wind; without a wind the cross-wind term is nothing."""
    blow = F.coalesce(F.col(wind), F.col("bearing_deg"))
    return sections.withColumn("raw", p["w_bend"] * F.col("bend_index") + p["w_wind_cross"] * F.abs(F.sin(F.radians(blow - F.col("bearing_deg")))))


def top_overlap(a: DataFrame, b: DataFrame, keys: list[str], item: str, score: str, k: int = 3) -> DataFrame:
    """How many of the k best items by one score are among the k best by another."""
    best = lambda df, name: df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), item))).where(F.col("_r") <= k).groupBy(*keys).agg(F.collect_list(item).alias(name))
    return best(a, "x").join(best(b, "y"), keys).select(*keys, F.size(F.array_intersect("x", "y")).alias("kept"))


def to_features(sections: DataFrame) -> DataFrame:
    """A GeoJSON feature line for each section, its score only where it has one."""
    shape = F.struct(F.lit("LineString").alias("type"), F.transform("points", lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"))
    props = F.struct("index", F.round("length_m", 1).alias("length_m"), F.round("bearing_deg", 1).alias("bearing_deg"), F.round("bend_index", 3).alias("bend_index"), "score")
    return sections.withColumn("feature", F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), props.alias("properties"))))
