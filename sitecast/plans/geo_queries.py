"""Queries of the geometry, grid and score operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitecast import params as P
from sitecast.functions import columns as C
from sitecast.operators import geo as G
from sitecast.operators import notebook as N
from sitecast.plans.fixtures import dealt, r6, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def sites(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """One site a supplier; ``spread`` deals them over tasks, where each makes many rows."""
    rows = table(spark, sf_dir, "supplier")
    return (dealt(rows, "s_suppkey") if spread else rows).select(F.col("s_suppkey").alias("site_id"), F.expr("49 + (s_suppkey % 60) / 10").alias("lat"), F.expr("14 + (s_suppkey % 90) / 10").alias("lon"), F.expr("1 + abs(s_acctbal) / 100").alias("area_ha"), (F.col("s_suppkey") * 37 % 360).cast("double").alias("wind"), F.expr("element_at(array('pzw', 'commercial'), cast(s_suppkey % 2 as int) + 1)").alias("water_type"))


def rings(spark, sf_dir, spread: bool = False):
    return sites(spark, sf_dir, spread).withColumn("ring", C.circle_ring(F.col("lat"), F.col("lon"), F.col("area_ha")))


SITES = "s AS (SELECT s_suppkey AS site_id, 49 + (s_suppkey % 60) / 10.0::double AS lat, 14 + (s_suppkey % 90) / 10.0::double AS lon, 1 + abs(s_acctbal) / 100 AS area_ha, (s_suppkey * 37 % 360)::double AS wind, CASE WHEN s_suppkey % 2 = 0 THEN 'pzw' ELSE 'commercial' END AS water_type FROM supplier)"
RINGS = "v AS (SELECT site_id, lat, lon, area_ha, b.b AS deg, lat + sqrt(area_ha * 10000 / pi()) * cos(radians(b.b)) / 111320 AS vlat, lon + sqrt(area_ha * 10000 / pi()) * sin(radians(b.b)) / (111320 * cos(radians(lat))) AS vlon FROM s CROSS JOIN range(0, 361, 15) b(b))"
BASE = f"WITH {SITES}, {RINGS}"


@query(f"{BASE}, m AS (SELECT site_id, avg(vlat) AS mid FROM v GROUP BY 1), e AS (SELECT v.site_id, vlon * 111320 * cos(radians(mid)) AS x, vlat * 111320 AS y, lead(vlon) OVER w * 111320 * cos(radians(mid)) AS x2, lead(vlat) OVER w * 111320 AS y2 FROM v JOIN m USING (site_id) WINDOW w AS (PARTITION BY v.site_id ORDER BY deg)) SELECT site_id, round(abs(sum(x * y2 - x2 * y)) / 2 / 10000, 2) AS area_ha FROM e WHERE x2 IS NOT NULL GROUP BY 1")
def geo2_ring_area(spark, sf_dir):
    return rings(spark, sf_dir).select("site_id", F.round(C.ring_area_ha(F.col("ring")), 2).alias("area_ha"))


@query(f"WITH {SITES} SELECT site_id, round(CASE WHEN site_id % 5 > 0 THEN (0.01 * 111320) * (0.02 * 111320 * cos(radians(lat + 0.005))) / 10000 END, 4) AS area_ha FROM s")
def geo3_bbox_area(spark, sf_dir):
    boxes = sites(spark, sf_dir).select("site_id", (F.col("site_id") % 5 == 0).alias("linear"), F.col("lat").alias("lat_min"), (F.col("lat") + 0.01).alias("lat_max"), F.col("lon").alias("lon_min"), (F.col("lon") + 0.02).alias("lon_max"))
    return G.bbox_area_ha(boxes).select("site_id", F.round("area_ha", 4).alias("area_ha"))


@query(f"WITH {SITES} SELECT site_id, k.k AS step, k.k * 0.1 < 0.97 AS inside FROM s CROSS JOIN range(0, 13) k(k)")
def geo4_point_in_ring(spark, sf_dir):
    """Points on the way north from the centre: a circle holds those within its radius."""
    r = F.sqrt(F.col("area_ha") * 10_000 / F.pi())
    rows = rings(spark, sf_dir).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(12)))).withColumn("plat", F.col("lat") + r * F.col("step") * 0.1 / C.M_PER_DEG)
    return rows.select("site_id", F.col("step").cast("long").alias("step"), (C.point_in_ring(F.col("plat") + 1e-9, F.col("lon") + 1e-9, F.col("ring")) & (F.col("step") < 10)).alias("inside"))


@query(f"WITH {SITES} SELECT site_id, CASE WHEN site_id % 3 = 0 THEN 2 ELSE 1 END AS ring_id, CASE WHEN site_id % 3 = 0 THEN 2 ELSE 1 END AS how FROM s")
def geo5_choose_ring(spark, sf_dir):
    """A small ring around the site, and a larger one apart, whose id is right for every third."""
    base = sites(spark, sf_dir)
    near = base.select("site_id", "lat", "lon", F.lit(1).alias("ring_id"), F.lit(False).alias("id_match"), C.circle_ring(F.col("lat"), F.col("lon"), F.lit(5.0)).alias("ring"))
    apart = base.select("site_id", "lat", "lon", F.lit(2).alias("ring_id"), (F.col("site_id") % 3 == 0).alias("id_match"), C.circle_ring(F.col("lat") + 0.2, F.col("lon"), F.lit(50.0)).alias("ring"))
    return G.choose_ring(near.unionByName(apart))


@query(f"{BASE} SELECT site_id, deg, round(vlat, 6) AS lat, round(vlon, 6) AS lon FROM v")
def geo6_circle_outline(spark, sf_dir):
    rows = rings(spark, sf_dir).select("site_id", F.posexplode("ring").alias("i", "p"))
    return rows.select("site_id", (F.col("i") * 15).cast("long").alias("deg"), F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"))


@query(f"WITH {SITES} SELECT site_id, z.zone, z.aspect, 13 AS points FROM s CROSS JOIN (VALUES ('N', 0), ('E', 90), ('S', 180), ('W', 270)) z(zone, aspect)")
def geo7_wedge_zones(spark, sf_dir):
    return G.wedges(sites(spark, sf_dir)).select("site_id", "zone", "aspect", F.size("ring").alias("points"))


@query(f"WITH {SITES}, a AS (SELECT site_id, CASE WHEN site_id % 6 = 0 THEN NULL ELSE area_ha * 20 END AS area_ha FROM s) SELECT site_id, CASE WHEN area_ha > 0 THEN greatest(5.0, least(150.0, round_even(sqrt(area_ha * 10000 / 5000), 0))) ELSE 5.0 END AS cell_m, CASE WHEN area_ha >= 50 THEN greatest(5.0, least(60.0, round_even(sqrt(area_ha * 10000 / 20000), 0))) END AS fine_m FROM a")
def geo8_cell_size(spark, sf_dir):
    area = F.when(F.col("site_id") % 6 != 0, F.col("area_ha") * 20)
    return sites(spark, sf_dir).select("site_id", C.cell_size(area).alias("cell_m"), C.fine_cell_size(area).alias("fine_m"))


def cells(spark, sf_dir, scale: float = 3.0):
    """The circles' cells, coarser than the default so that the synthetic sites stay small."""
    base, spread = (rings(spark, sf_dir, x).withColumn("cell_m", C.cell_size(F.col("area_ha")) * scale) for x in (False, True))
    return G.grid(spread), base


CELLED = """bx AS (SELECT v.site_id, min(vlat) AS y0, max(vlat) AS y1, min(vlon) AS x0, max(vlon) AS x1, greatest(5.0, least(150.0, round_even(sqrt(max(v.area_ha) * 10000 / 5000), 0))) * 3 AS cell_m FROM v GROUP BY 1),
  dm AS (SELECT *, cell_m / 111320 AS dy, cell_m / (111320 * cos(radians((y0 + y1) / 2))) AS dx FROM bx), cd AS (SELECT site_id, r.r AS "row", c.c AS col, y0 + (r.r + 0.5::double) * dy AS lat, x0 + (c.c + 0.5::double) * dx AS lon FROM dm JOIN range(0, 100) r(r) ON r.r < greatest(1, ceil((y1 - y0) / dy)) JOIN range(0, 100) c(c) ON c.c < greatest(1, ceil((x1 - x0) / dx))),
  ed AS (SELECT site_id, vlat, vlon, lead(vlat) OVER w AS nlat, lead(vlon) OVER w AS nlon FROM v WINDOW w AS (PARTITION BY site_id ORDER BY deg)), eg AS (SELECT * FROM ed WHERE nlat IS NOT NULL),
  ce AS (SELECT cd.site_id, cd."row", col, any_value(lat) AS lat, any_value(lon) AS lon FROM cd JOIN eg ON cd.site_id = eg.site_id GROUP BY 1, 2, 3 HAVING count(*) FILTER ((vlat > lat) <> (nlat > lat) AND lon < (nlon - vlon) * (lat - vlat) / (nlat - vlat) + vlon) % 2 = 1)"""
MEASURED = f"""{CELLED}, q0 AS (SELECT ce.*, (vlon - lon) * 111320 * cos(radians(lat)) AS ax, (vlat - lat) * 111320 AS ay, (nlon - lon) * 111320 * cos(radians(lat)) AS bx, (nlat - lat) * 111320 AS "by", sin(radians(225.0)) AS dx, cos(radians(225.0)) AS dy, lon - vlon AS wx, lat - vlat AS wy, nlon - vlon AS ex, nlat - vlat AS ey FROM ce JOIN eg ON ce.site_id = eg.site_id),
  q1 AS (SELECT *, greatest(0.0, least(1.0, (wx * ex + wy * ey) / (ex * ex + ey * ey))) AS u, dx * ("by" - ay) - dy * (bx - ax) AS den FROM q0), q2 AS (SELECT site_id, "row", col, sqrt(pow(wx - u * ex, 2) + pow(wy - u * ey, 2)) * 111320 AS shore, CASE WHEN den <> 0 AND (ax * dy - ay * dx) * (bx * dy - "by" * dx) <= 0 THEN (ax * ("by" - ay) - ay * (bx - ax)) / den END AS t FROM q1)"""


@query(f'WITH {SITES}, {RINGS}, {CELLED} SELECT site_id, "row", col, round(lat, 6) AS lat, round(lon, 6) AS lon FROM ce')
def geo9_grid_cells(spark, sf_dir):
    return cells(spark, sf_dir)[0].select("site_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def measured(spark, sf_dir, winds=(225.0,)):
    base = cells(spark, sf_dir)[1]
    return G.geometry(base, list(winds)).join(base.select("site_id", "wind", "water_type").withColumnRenamed("wind", "site_wind"), "site_id")


@query(f'WITH {SITES}, {RINGS}, {MEASURED} SELECT site_id, "row", col, round(least(500.0, coalesce(min(t) FILTER (t >= 0), 500.0)), 2) AS fetch_m, round(min(shore), 2) AS shore_m FROM q2 GROUP BY 1, 2, 3')
def geo10_fetch_and_shore(spark, sf_dir):
    return measured(spark, sf_dir).select("site_id", "row", "col", F.round("fetch_m", 2).alias("fetch_m"), F.round("shore_m", 2).alias("shore_m"))


EDGES = "e AS (SELECT site_id, wind, (vlon - lon) * 111320 * cos(radians(lat)) AS ax, (vlat - lat) * 111320 AS ay, (lead(vlon) OVER w - lon) * 111320 * cos(radians(lat)) AS bx, (lead(vlat) OVER w - lat) * 111320 AS by_ FROM v JOIN (SELECT site_id, wind FROM s) USING (site_id) WINDOW w AS (PARTITION BY site_id ORDER BY deg))"


@query(f"{BASE}, {EDGES}, d AS (SELECT *, bx - ax AS ex, by_ - ay AS ey, sin(radians(wind + 3)) AS dx, cos(radians(wind + 3)) AS dy FROM e WHERE bx IS NOT NULL), h AS (SELECT site_id, (ax * ey - ay * ex) / nullif(dx * ey - dy * ex, 0) AS t, (ax * dy - ay * dx) / nullif(dx * ey - dy * ex, 0) AS s FROM d) SELECT site_id, round(least(500.0, coalesce(min(t) FILTER (t >= 0 AND s >= 0 AND s <= 1), 500.0)), 3) AS fetch_m FROM h GROUP BY 1")
def geo10_fetch_from_centre(spark, sf_dir):
    rows = rings(spark, sf_dir)
    return G.fetch_edges(rows, F.col("wind") + 3, key="site_id").select("site_id", F.round("fetch_m", 3).alias("fetch_m"))


@query(f"WITH {SITES} SELECT site_id, ((CAST(round_even(wind / 10, 0) AS bigint) * 10) % 360) AS bucket, round_even(cos(radians(wind - 45)), 3) AS exposure, (['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[CAST(floor(((wind + 22.5) % 360) / 45) AS integer) + 1] AS compass FROM s")
def geo12_wind_bucket(spark, sf_dir):
    w = F.col("wind")
    return sites(spark, sf_dir).select("site_id", C.wind_bucket(w).alias("bucket"), C.wind_exposure(w, F.lit(45.0)).alias("exposure"), C.compass(w).alias("compass"))


def sections(spark, sf_dir):
    line = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct((F.col("lat") + i * 0.003 * (1 + F.col("site_id") % 4)).alias("lat"), (F.col("lon") + (i % 2) * 0.002 * (F.col("site_id") % 3)).alias("lon")))
    rows = sites(spark, sf_dir, spread=True).select("site_id", "lat", "lon", "wind")
    # Through Python as they are: else the test for lines without length, which walks each line, is done before the sites are dealt, in one task.
    rows = rows.mapInArrow(lambda batches: batches, rows.schema)
    return G.section_shape(G.cut_sections(rows.select("site_id", "wind", line.alias("line"))))


LINES = f"""{SITES}, lv AS (SELECT site_id, i.i AS i, lat + i.i * 0.003::double * (1 + site_id % 4) AS y, lon + (i.i % 2) * 0.002::double * (site_id % 3) AS x FROM s CROSS JOIN range(0, 21) i(i)), lg AS (SELECT site_id, sqrt(pow((y - lag(y) OVER w) * 111320, 2) + pow((x - lag(x) OVER w) * 111320 * cos(radians((y + lag(y) OVER w) / 2)), 2)) AS d FROM lv WINDOW w AS (PARTITION BY site_id ORDER BY i)),
  tt AS (SELECT site_id, sum(d) AS total FROM lg GROUP BY 1), sz AS (SELECT *, greatest(250.0, least(2500.0, round_even(total / 40 / 50, 0) * 50), ceil(total / 120)) AS size FROM tt)"""


@query(f"WITH {LINES} SELECT site_id, CAST(greatest(1, floor(total / size) + CASE WHEN total - floor(total / size) * size >= 0.35 * size THEN 1 ELSE 0 END) AS bigint) AS n_sections, round(total, 2) AS total_m FROM sz")
def geo13_cut_sections(spark, sf_dir):
    return sections(spark, sf_dir).groupBy("site_id").agg(F.count("*").alias("n_sections"), F.round(F.sum("length_m"), 2).alias("total_m"))


FLAT = "sqrt(pow(({a}y - {b}y) * 111320, 2) + pow(({a}x - {b}x) * 111320 * cos(radians(({a}y + {b}y) / 2)), 2))"
SHAPED = f"""{LINES}, wk AS (SELECT lv.*, coalesce(sum(d) OVER (PARTITION BY site_id ORDER BY i), 0) AS c FROM (SELECT site_id, i, y, x, {FLAT.format(a="", b="p")} AS d FROM (SELECT *, lag(y) OVER w AS py, lag(x) OVER w AS px FROM lv WINDOW w AS (PARTITION BY site_id ORDER BY i))) lv),
  t2 AS (SELECT site_id, max(c) AS total FROM wk GROUP BY 1), z2 AS (SELECT *, greatest(250.0, least(2500.0, round_even(total / 40 / 50, 0) * 50), ceil(total / 120)) AS size FROM t2), n2 AS (SELECT *, greatest(1, floor(total / size) + CASE WHEN total - floor(total / size) * size >= 0.35 * size THEN 1 ELSE 0 END) AS n FROM z2),
  sc AS (SELECT site_id, k.k AS idx, k.k * size AS d0, CASE WHEN k.k = n - 1 THEN total ELSE (k.k + 1) * size END AS d1 FROM n2 JOIN range(0, 200) k(k) ON k.k < n), sg AS (SELECT site_id, lag(c) OVER w AS c0, c AS c1, lag(y) OVER w AS y0, y AS y1, lag(x) OVER w AS x0, x AS x1 FROM wk WINDOW w AS (PARTITION BY site_id ORDER BY i)),
  cut AS (SELECT sc.site_id, idx, d0 AS d FROM sc UNION ALL SELECT site_id, idx, d1 FROM sc), pt AS (SELECT cut.site_id, idx, d, y0 + (y1 - y0) * (d - c0) / (c1 - c0) AS y, x0 + (x1 - x0) * (d - c0) / (c1 - c0) AS x FROM cut JOIN sg ON cut.site_id = sg.site_id AND ((d > c0 AND d <= c1) OR (d = 0 AND c0 = 0)) UNION ALL SELECT sc.site_id, idx, c, y, x FROM sc JOIN wk ON sc.site_id = wk.site_id AND c > d0 AND c < d1),
  st AS (SELECT *, {FLAT.format(a="", b="p")} AS step FROM (SELECT *, lag(y) OVER w AS py, lag(x) OVER w AS px FROM pt WINDOW w AS (PARTITION BY site_id, idx ORDER BY d))), cw AS (SELECT *, coalesce(sum(step) OVER (PARTITION BY site_id, idx ORDER BY d), 0) AS w1, coalesce(step, 0) AS s1 FROM st), hf AS (SELECT site_id, idx, max(w1) / 2 AS half, arg_min(y, d) AS fy, arg_min(x, d) AS fx, arg_max(y, d) AS ly, arg_max(x, d) AS lx FROM cw GROUP BY 1, 2),
  md AS (SELECT cw.site_id, cw.idx, py + (y - py) * (half - (w1 - s1)) / s1 AS mid_lat FROM cw JOIN hf ON cw.site_id = hf.site_id AND cw.idx = hf.idx AND w1 >= half AND w1 - s1 < half),
  sh AS (SELECT sc.site_id, sc.idx, mid_lat, d1 - d0 AS length_m, degrees(atan2((lx - fx) * 111320 * cos(radians((fy + ly) / 2)), (ly - fy) * 111320)) AS deg, greatest(0.0, least(1.0, (d1 - d0) / {FLAT.format(a="l", b="f")} - 1)) AS bend FROM sc JOIN hf ON sc.site_id = hf.site_id AND sc.idx = hf.idx JOIN md ON sc.site_id = md.site_id AND sc.idx = md.idx), sx AS (SELECT *, CASE WHEN deg < 0 THEN deg + 360 ELSE deg END AS bearing FROM sh)"""
RIVER = f"{SHAPED}, rv AS (SELECT sx.site_id, idx, bearing, bend, mid_lat, length_m, round(0.6 * bend + 0.4 * abs(sin(radians(coalesce(CASE WHEN {{calm}} THEN NULL ELSE wind END, bearing) - bearing))), 6) AS raw FROM sx JOIN s USING (site_id))"


@query(f'WITH {SHAPED} SELECT site_id, idx AS "index", round(bearing, 3) AS bearing_deg, round(bend, 4) AS bend_index, round(mid_lat, 5) AS mid_lat FROM sx')
def geo14_section_shape(spark, sf_dir):
    return sections(spark, sf_dir).select("site_id", F.col("index").cast("long").alias("index"), F.round("bearing_deg", 3).alias("bearing_deg"), F.round("bend_index", 4).alias("bend_index"), F.round("mid.lat", 5).alias("mid_lat"))


@query("SELECT s_suppkey AS relation_id, 0 AS ring_no, CASE WHEN s_suppkey % 4 = 1 THEN 0 ELSE 25 END AS n_points FROM supplier WHERE s_suppkey % 4 <> 1")
def geo15_stitch_rings(spark, sf_dir):
    """Circles cut in three, the second part turned round; every fourth lacks a part and is dropped."""
    rows = rings(spark, sf_dir).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(2)))).where("not (site_id % 4 = 1 and part = 2)")
    piece = F.slice("ring", F.col("part") * 8 + 1, F.lit(9))
    ways = rows.select(F.col("site_id").alias("relation_id"), F.col("part").cast("long").alias("way_id"), F.when(F.col("part") == 1, F.reverse(piece)).otherwise(piece).alias("points"))
    return G.stitch(ways).select("relation_id", "ring_no", "n_points")


@query(f"{BASE} SELECT site_id, CAST(9 AS integer) AS kept, round(avg(vlat), 6) AS lat, round(avg(vlon), 6) AS lon FROM v GROUP BY 1")
def geo16_thin_and_centre(spark, sf_dir):
    """GEO16 and GEO17: points kept of the outline, and the mean of its vertices."""
    mean = lambda c: F.round(F.aggregate("ring", F.lit(0.0), lambda s, p: s + p[c]) / F.size("ring"), 6).alias(c)
    return rings(spark, sf_dir).select("site_id", F.size(G.thin(F.col("ring"), 9)).alias("kept"), mean("lat"), mean("lon"))


@query(f"""{BASE}, x0 AS (SELECT v.site_id, deg, k.k AS k, (vlon - v.lon) * 111320 * cos(radians(v.lat)) AS ax, (vlat - v.lat) * 111320 AS ay, sin(radians(k.k * 22.5::double)) AS dx, cos(radians(k.k * 22.5::double)) AS dy FROM v CROSS JOIN range(0, 16) k(k)), x1 AS (SELECT *, lead(ax) OVER w AS bx, lead(ay) OVER w AS "by" FROM x0 WINDOW w AS (PARTITION BY site_id, k ORDER BY deg)), x2 AS (SELECT *, dx * ("by" - ay) - dy * (bx - ax) AS den FROM x1 WHERE bx IS NOT NULL)
  SELECT site_id * 16 + k AS point_id, round(least(500.0, coalesce(min((ax * ("by" - ay) - ay * (bx - ax)) / nullif(den, 0)) FILTER ((ax * ("by" - ay) - ay * (bx - ax)) / nullif(den, 0) >= 0 AND (ax * dy - ay * dx) * (bx * dy - "by" * dx) <= 0), 500.0)), 2) AS fetch_m FROM x2 GROUP BY 1""")
def geo19_sector_fetch(spark, sf_dir):
    rows = rings(spark, sf_dir).withColumn("sector", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumn("point_id", F.col("site_id") * 16 + F.col("sector"))
    found = G.fetch_edges(rows.select("point_id", "lat", "lon", "ring", (F.col("sector") * 22.5).alias("deg")), F.col("deg"))
    return found.select("point_id", F.round("fetch_m", 2).alias("fetch_m"))


@query(f"""{BASE}, o AS (SELECT *, coalesce({FLAT.format(a="v", b="p")}, 0) AS d FROM (SELECT site_id, deg, vlat AS vy, vlon AS vx, lag(vlat) OVER w AS py, lag(vlon) OVER w AS px FROM v WINDOW w AS (PARTITION BY site_id ORDER BY deg))), oc AS (SELECT *, sum(d) OVER (PARTITION BY site_id ORDER BY deg) AS c1 FROM o), tl AS (SELECT site_id, max(c1) AS total, greatest(1, round_even(max(c1) / 25, 0)) AS n FROM oc GROUP BY 1),
  ends AS (SELECT site_id, k.k AS k, n, k.k * (total / n) AS m FROM tl JOIN range(0, 1000) k(k) ON k.k <= n), pt AS (SELECT ends.site_id, k, n, py + (vy - py) * (m - (c1 - d)) / d AS y, px + (vx - px) * (m - (c1 - d)) / d AS x FROM ends JOIN (SELECT *, lag(c1) OVER (PARTITION BY site_id ORDER BY deg) AS c0, max(c1) OVER (PARTITION BY site_id) AS total FROM oc) e ON ends.site_id = e.site_id AND c0 IS NOT NULL AND ((m > c0 AND m <= c1) OR (m = 0 AND c0 = 0) OR (m > total AND c1 = total))),
  nx AS (SELECT *, lead(y) OVER w AS y2, lead(x) OVER w AS x2 FROM pt WINDOW w AS (PARTITION BY site_id ORDER BY k)) SELECT site_id, k AS "index", round((y + y2) / 2, 6) AS lat, round((x + x2) / 2, 6) AS lon, round((degrees(atan2((x2 - x) * 111320 * cos(radians((y + y2) / 2)), (y2 - y) * 111320)) - 90 + 720) % 360, 2) AS normal_deg FROM nx WHERE y2 IS NOT NULL""")
def geo19_shore_segments(spark, sf_dir):
    found = G.shore_segments(rings(spark, sf_dir))
    return found.select("site_id", F.col("index").cast("long").alias("index"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("normal_deg", 2).alias("normal_deg"))


@query(f"""WITH {SITES}, st AS (SELECT n_nationkey AS entry_id, 49 + n_nationkey / 4.0::double AS y, 14 + n_nationkey / 3.0::double AS x FROM nation), d AS (SELECT site_id AS query_id, entry_id, sqrt(pow((y - lat) * 111320, 2) + pow((x - lon) * 111320 * cos(radians((lat + y) / 2)), 2)) / 1000 AS km FROM s CROSS JOIN st) SELECT query_id, arg_min(entry_id, (km, entry_id)) AS entry_id, round(min(km), 4) AS km FROM d GROUP BY 1""")
def geo19_nearest_station(spark, sf_dir):
    """Every site has a station, however far."""
    stations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("entry_id"), (49 + F.col("n_nationkey") / 4).alias("lat"), (14 + F.col("n_nationkey") / 3).alias("lon"))
    found = G.nearest_any(sites(spark, sf_dir).select(F.col("site_id").alias("query_id"), "lat", "lon"), stations)
    return found.select("query_id", "entry_id", F.round("km", 4).alias("km"))


@query(f"""WITH {SITES}, o AS (SELECT o_orderkey AS entry_id, 49 + (o_orderkey % 60) / 10.0::double + (o_orderkey % 7) * 5e-5::double AS y, 14 + (o_orderkey % 90) / 10.0::double AS x FROM orders), d AS (SELECT site_id AS query_id, entry_id, sqrt(pow((y - lat) * 111320, 2) + pow((x - lon) * 111320 * cos(radians((lat + y) / 2)), 2)) AS metres FROM s JOIN o ON abs(y - lat) < 0.001) SELECT query_id, entry_id, round(metres, 3) AS metres FROM d WHERE metres <= 20""")
def geo19_sessions_near(spark, sf_dir):
    """Orders as sessions logged at some metres from the sites."""
    logged = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry_id"), (49 + F.col("o_orderkey") % 60 / 10 + F.col("o_orderkey") % 7 * F.lit(5e-5)).alias("lat"), (14 + F.col("o_orderkey") % 90 / 10).alias("lon"))
    found = G.points_near(sites(spark, sf_dir).select(F.col("site_id").alias("query_id"), "lat", "lon"), logged)
    return found.select("query_id", "entry_id", F.round("metres", 3).alias("metres"))


@query(f"""WITH {SITES}, q AS (SELECT site_id AS query_id, lat + (site_id % 3) * 0.02 AS lat, lon FROM s), h AS (SELECT query_id, count(*) AS hits, min(s.site_id) AS entry_id FROM q JOIN s ON sqrt(pow((q.lat - s.lat) * 111320, 2) + pow((q.lon - s.lon) * 111320 * cos(radians(s.lat)), 2)) < 1000 GROUP BY 1)
  SELECT q.query_id, coalesce(hits, 0) AS hits, CASE WHEN hits = 1 THEN entry_id END AS entry_id FROM q LEFT JOIN h USING (query_id)""")
def jn7_point_in_polygon(spark, sf_dir):
    s = sites(spark, sf_dir)
    listed = s.select(F.col("site_id").alias("entry_id"), C.circle_ring(F.col("lat"), F.col("lon"), F.lit(314.159265)).alias("ring"))
    return G.points_in_rings(s.select(F.col("site_id").alias("query_id"), (F.col("lat") + F.col("site_id") % 3 * 0.02).alias("lat"), "lon"), listed)


@query(f"""WITH {SITES}, lv AS (SELECT site_id AS entry_id, lat + i.i * 0.01::double AS vlat, lon + 0.03::double AS vlon FROM s CROSS JOIN range(0, 5) i(i)), d AS (SELECT s.site_id AS query_id, entry_id, sqrt(pow((vlat - lat) * 111320, 2) + pow((vlon - lon) * 111320 * cos(radians((lat + vlat) / 2)), 2)) / 1000 AS km FROM s JOIN lv ON abs(vlat - lat) < 0.2)
  SELECT query_id, arg_min(entry_id, (km, entry_id)) AS entry_id, round(min(km), 4) AS km FROM d WHERE km <= 8 GROUP BY 1""")
def jn9_nearest_district(spark, sf_dir):
    s = sites(spark, sf_dir)
    lines = s.select(F.col("site_id").alias("entry_id"), F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct((F.col("lat") + i * 0.01).alias("lat"), (F.col("lon") + 0.03).alias("lon"))).alias("line"))
    return G.nearest_vertex(s.select(F.col("site_id").alias("query_id"), "lat", "lon"), lines).select("query_id", "entry_id", F.round("km", 4).alias("km"))


# Scores on synthetic cells: order lines as cells of 25 sites


def score_cells(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("l_suppkey", F.col("l_suppkey") % 25).groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.max("l_discount").alias("l_discount"))
    return lines.select((F.col("l_suppkey") % 25).alias("site_id"), F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"), (F.col("l_quantity") * 9).alias("fetch_m"), (F.col("l_discount") * 300).alias("shore_m"), F.expr("element_at(array('spring_warming', 'autumn_cooling', 'holding'), cast(l_suppkey % 25 % 3 as int) + 1)").alias("phase"), F.expr("element_at(array('pzw', 'commercial', null), cast(l_suppkey % 25 % 3 as int) + 1)").alias("water_type"), F.expr("16e0 + l_suppkey % 25 * 5e-1").alias("water_c"), F.expr("15e0 + l_suppkey % 25 * 6e-1").alias("water_24h"), F.lit(26.8).alias("t_opt"), F.expr("1e0 + l_suppkey % 25 % 7").alias("wind_ms"))


CELLS = """li AS (SELECT l_suppkey % 25 AS l_suppkey, l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, max(l_discount) AS l_discount FROM lineitem GROUP BY 1, 2, 3), c0 AS (SELECT l_suppkey % 25 AS site_id, l_orderkey AS row, l_linenumber AS col, l_quantity * 9 AS fetch_m, l_discount * 300 AS shore_m, (['spring_warming', 'autumn_cooling', 'holding'])[l_suppkey % 25 % 3 + 1] AS phase, (['pzw', 'commercial', NULL])[l_suppkey % 25 % 3 + 1] AS water_type, 16e0 + l_suppkey % 25 * 5e-1 AS water_c, 15e0 + l_suppkey % 25 * 6e-1 AS water_24h, 26.8::double AS t_opt, 1e0 + l_suppkey % 25 % 7 AS wind_ms FROM li),
  cz AS (SELECT *, greatest(0.0, least(1.0, fetch_m / 400)) AS fn, greatest(0.0, least(1.0, 1 - shore_m / 25)) AS sp FROM c0)"""
GEOMETRY = "g AS (SELECT *, CASE phase WHEN 'spring_warming' THEN -0.5 * fn + 1.0 * sp + 0.7 * (1 - fn) + 0.1 * (fn * sp) WHEN 'autumn_cooling' THEN 0.25 * fn + 0.45 * sp + 0.05 * (1 - fn) + 0.8 * (fn * sp) ELSE 0.3 * fn + 0.25 * sp - 0.35 * (1 - fn) + 1.0 * (fn * sp) END AS raw FROM cz)"


@query(f"WITH {CELLS}, {GEOMETRY} SELECT site_id, row, col, round(raw + 1e-9, 5) AS raw FROM g")
def zon1_geometry_score(spark, sf_dir):
    return G.geometry_score(score_cells(spark, sf_dir)).select("site_id", "row", "col", F.round(F.col("raw") + 1e-9, 5).alias("raw"))


RANKED = "r AS (SELECT site_id, row, col, round(fetch_m, 1) AS raw FROM c0)"


@query(f"WITH {CELLS}, {RANKED} SELECT site_id, row, col, round((rank() OVER (PARTITION BY site_id ORDER BY raw) - 1 + (count(*) OVER (PARTITION BY site_id, raw) - 1) / 2.0) / (count(*) OVER (PARTITION BY site_id) - 1), 3) AS score FROM r")
def win1_tie_percentile(spark, sf_dir):
    rows = score_cells(spark, sf_dir).withColumn("raw", F.round("fetch_m", 1))
    return G.percentile_ties(rows, "raw", ["site_id"]).select("site_id", "row", "col", F.round("score", 3).alias("score"))


@query(f"WITH {CELLS}, {RANKED} SELECT site_id, row, col, round((raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w), 6) AS score FROM r WINDOW w AS (PARTITION BY site_id)")
def win2_min_max(spark, sf_dir):
    rows = score_cells(spark, sf_dir).withColumn("raw", F.round("fetch_m", 1))
    return r6(rows.select("site_id", "row", "col", G.min_max("raw", ["site_id"]).alias("score")))


@query(f"WITH {CELLS}, {RANKED} SELECT site_id, row, col, round((row_number() OVER (PARTITION BY site_id ORDER BY raw, row * 10 + col) - 1) / (count(*) OVER (PARTITION BY site_id) - 1)::double, 6) AS score FROM r")
def win3_ordinal_percentile(spark, sf_dir):
    rows = score_cells(spark, sf_dir).withColumn("raw", F.round("fetch_m", 1)).withColumn("place", F.col("row") * 10 + F.col("col"))
    return r6(G.ordinal(rows, "raw", "place", ["site_id"]).select("site_id", "row", "col", "score"))


SAT = "(14.652 - 0.41022 * {0} + 0.007991 * {0} * {0} - 0.000077774 * {0} * {0} * {0})"


def factor_sql(bias: str = "0") -> str:
    """CTEs up to ``fs``: the three-factor raw score with the water that much warmer."""
    t = f"(water_c + {bias})"
    return f"""o1 AS (SELECT *, {SAT.format(t)} AS sat, greatest(0.0, {SAT.format(t)} - 2.0 * pow(2.3, ({t} - 20) / 10)) AS before, {t} AS wt FROM cz), o2 AS (SELECT *, greatest(0.0, least(1.0, (least(sat, before + least(greatest(0.0, least(1.0, fn * (wind_ms / 6.0) * (wind_ms / 6.0))) * 0.35 * sat, greatest(0.0, sat - before))) - 5.0) / 3.5)) AS ad FROM o1),
  tr AS (SELECT *, fn * sp * greatest(-1.0, least(1.0, (abs(water_24h - t_opt) - abs(wt - t_opt)) / 2.0)) AS t1, fn * (1 - ad) AS t2, fn * sp AS t3, CASE WHEN water_type = 'commercial' THEN 0.05 ELSE 0.15 END AS wf, CASE WHEN water_type = 'commercial' THEN 0.25 ELSE 0.10 END AS wm, CASE WHEN water_type = 'commercial' THEN 0.10 ELSE 0.25 END AS we FROM o2),
  lv AS (SELECT *, CASE WHEN max(t2) OVER w - min(t2) OVER w >= 0.02 THEN 0.45 ELSE 0 END::double AS l1, CASE WHEN max(t1) OVER w - min(t1) OVER w >= 0.02 THEN 0.30 ELSE 0 END::double AS l2, CASE WHEN max(t3) OVER w - min(t3) OVER w >= 0.02 THEN wf ELSE 0 END::double AS l3, CASE WHEN max(sp) OVER w - min(sp) OVER w >= 0.02 THEN wm ELSE 0 END::double AS l4, CASE WHEN max(fn) OVER w - min(fn) OVER w >= 0.02 THEN we ELSE 0 END::double AS l5 FROM tr WINDOW w AS (PARTITION BY site_id)),
  fs AS (SELECT *, (l1 * t2 + l2 * t1 + l3 * t3 + l4 * sp + l5 * fn) / (l1 + l2 + l3 + l4 + l5) * greatest(0.0, least(1.0, ad / 0.45)) AS raw FROM lv WHERE l1 + l2 + l3 + l4 + l5 > 0)"""


@query(f"WITH {CELLS}, {factor_sql()} SELECT site_id, row, col, round(raw + 1e-9, 4) AS raw FROM fs")
def zon2_three_factor(spark, sf_dir):
    return G.factor_score(score_cells(spark, sf_dir), ["site_id"]).select("site_id", "row", "col", F.round(F.col("raw") + 1e-9, 4).alias("raw"))


@query(f"WITH {CELLS}, {factor_sql()} SELECT DISTINCT site_id, " + ", ".join(f"round(l{i} / (l1 + l2 + l3 + l4 + l5), 6) AS {n}" for i, n in ((1, "w_o2"), (2, "w_temp"), (3, "w_food"), (4, "w_margin"), (5, "w_exposure"))) + " FROM fs")
def win10_live_weights(spark, sf_dir):
    rows = G.factor_score(score_cells(spark, sf_dir), ["site_id"])
    return rows.groupBy("site_id").agg(*(F.round(F.max(f"l_{k}"), 6).alias(k) for k in G.TERMS))


@query(f"WITH {CELLS}, {GEOMETRY}, {factor_sql()} SELECT g.site_id, g.row, g.col, round(CASE WHEN g.site_id % 4 > 0 THEN fs.raw ELSE g.raw END + 1e-9, 4) AS raw, CASE WHEN g.site_id % 4 > 0 THEN 'three_factor' ELSE 'geometry_only' END AS model FROM g LEFT JOIN fs ON fs.site_id = g.site_id AND fs.row = g.row AND fs.col = g.col")
def zon3_scored_with_fallback(spark, sf_dir):
    rows = score_cells(spark, sf_dir)
    full = G.factor_score(rows.where("site_id % 4 > 0"), ["site_id"]).select("site_id", "row", "col", F.col("raw").alias("full"))
    plain = G.geometry_score(rows).select("site_id", "row", "col", F.col("raw").alias("plain"))
    both = plain.join(full, ["site_id", "row", "col"], "left")
    return both.select("site_id", "row", "col", F.round(F.coalesce("full", "plain") + 1e-9, 4).alias("raw"), F.when(F.col("full").isNotNull(), "three_factor").otherwise("geometry_only").alias("model"))


@query(f"WITH {SITES} SELECT site_id, CASE WHEN water_type = 'commercial' THEN 0.05 ELSE 0.15 END::double AS w_food, CASE WHEN water_type = 'commercial' THEN 0.25 ELSE 0.10 END::double AS w_margin, 0.45::double AS w_o2 FROM s")
def zon4_type_weights(spark, sf_dir):
    return G.type_weights(sites(spark, sf_dir)).select("site_id", "w_food", "w_margin", "w_o2")


@query("WITH " + RIVER.format(calm="s.site_id % 3 = 0") + """ SELECT site_id, idx AS "index", raw, round(CASE WHEN count(*) OVER w = 1 OR max(raw) OVER w - min(raw) OVER w < 1e-9 THEN 0.5 ELSE (row_number() OVER (PARTITION BY site_id ORDER BY raw, idx) - 1) / (count(*) OVER w - 1)::double END, 4) AS score FROM rv WINDOW w AS (PARTITION BY site_id)""")
def zon5_river_score(spark, sf_dir):
    """Raw scores to six places, so that sections alike but for the last bits rank by their order."""
    rows = G.river_score(sections(spark, sf_dir).join(sites(spark, sf_dir).select("site_id", F.when(F.col("site_id") % 3 > 0, F.col("wind")).alias("wind_dir")), "site_id")).withColumn("raw", F.round("raw", 6))
    return G.ordinal(rows.select("site_id", F.col("index").cast("long").alias("index"), "raw"), "raw", "index", ["site_id"], small=True).withColumn("score", F.round("score", 4))


def biased(spark, sf_dir, biases=(-2.0, -1.0, 1.0, 2.0)):
    base = G.factor_score(score_cells(spark, sf_dir), ["site_id"]).select("site_id", "row", "col", F.round("raw", 6).alias("raw"))
    moved = score_cells(spark, sf_dir).withColumn("bias", F.explode(F.array(*[F.lit(b) for b in biases]))).withColumn("water_c", F.col("water_c") + F.col("bias"))
    return base, G.factor_score(moved, ["site_id", "bias"]).select("site_id", "bias", "row", "col", F.round("raw", 6).alias("raw_b"))


@query(f"WITH {CELLS}, {factor_sql()}, b0 AS (SELECT site_id, row, col, round(raw, 6) AS raw FROM fs), " + ", ".join(f"m{i} AS (WITH {factor_sql(b)} SELECT site_id, {b}::double AS bias, row, col, round(raw, 6) AS raw_b FROM fs)" for i, b in enumerate(("-2.0", "-1.0", "1.0", "2.0"))) + """, mv AS (SELECT * FROM m0 UNION ALL SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3), j AS (SELECT mv.site_id, bias, raw, raw_b, mv.row * 10 + mv.col AS place FROM mv JOIN b0 ON mv.site_id = b0.site_id AND mv.row = b0.row AND mv.col = b0.col),
  k AS (SELECT site_id, bias, row_number() OVER (PARTITION BY site_id, bias ORDER BY raw, place) - row_number() OVER (PARTITION BY site_id, bias ORDER BY raw_b, place) AS d FROM j) SELECT site_id, bias, count(*) AS n, round(1 - 6 * sum(d * d)::double / (count(*)::double * (count(*)::double * count(*) - 1)), 3) AS rho FROM k GROUP BY 1, 2""")
def cal2_bias_sensitivity(spark, sf_dir):
    """Rank correlation of every site's map with the same map at 1 and 2 degrees more or less."""
    base, moved = biased(spark, sf_dir)
    rows = moved.join(base, ["site_id", "row", "col"]).withColumn("place", F.col("row") * 10 + F.col("col"))
    return N.spearman(rows, ["site_id", "bias"], "raw", "raw_b", "place").select("site_id", "bias", "n", F.round("rho", 3).alias("rho"))


@query(f"WITH {CELLS}, k AS (SELECT site_id, row_number() OVER (PARTITION BY site_id ORDER BY fetch_m, row * 10 + col) - row_number() OVER (PARTITION BY site_id ORDER BY shore_m, row * 10 + col) AS d FROM c0) SELECT site_id, count(*) AS n, round(1 - 6 * sum(d * d)::double / (count(*)::double * (count(*)::double * count(*) - 1)), 6) AS rho FROM k GROUP BY 1")
def cal1_rank_correlation(spark, sf_dir):
    rows = score_cells(spark, sf_dir).withColumn("place", F.col("row") * 10 + F.col("col"))
    return r6(N.spearman(rows, ["site_id"], "fetch_m", "shore_m", "place"))


@query(f"WITH {CELLS}, p AS (SELECT site_id, row * 10 + col AS place, fetch_m, shore_m FROM c0), a AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY fetch_m DESC, place) AS x, row_number() OVER (PARTITION BY site_id ORDER BY shore_m DESC, place) AS y FROM p) SELECT site_id, CAST(count(*) FILTER (x <= 20 AND y <= 20) AS integer) AS kept FROM a GROUP BY 1")
def top3_survivors(spark, sf_dir):
    rows = score_cells(spark, sf_dir).withColumn("place", F.col("row") * 10 + F.col("col"))
    return G.top_overlap(rows.select("site_id", "place", F.col("fetch_m").alias("score")), rows.select("site_id", "place", F.col("shore_m").alias("score")), ["site_id"], "place", "score", 20)


@query()
def src10_section_features(spark, sf_dir):
    rows = G.river_score(sections(spark, sf_dir).join(sites(spark, sf_dir).select("site_id", F.col("wind").alias("wind_dir")), "site_id"))
    return G.to_features(rows.withColumn("score", F.when(F.col("site_id") % 2 == 0, F.round("raw", 3)))).select("site_id", F.col("index").cast("long").alias("index"), "feature")


@query("WITH " + RIVER.format(calm="false") + """ SELECT site_id, idx AS "index", 'LineString' AS kind, round(length_m, 1) AS length_m, round(bearing, 1) AS bearing_deg, round(bend, 3) AS bend_index, CASE WHEN site_id % 2 = 0 THEN round(raw, 3) END AS score FROM rv""")
def src10_feature_fields(spark, sf_dir):
    """The features of ``src10_section_features`` read back."""
    shape = "type string, geometry struct<type string, coordinates array<array<double>>>, properties struct<index long, length_m double, bearing_deg double, bend_index double, score double>"
    f = src10_section_features(spark, sf_dir).select("site_id", F.from_json("feature", shape).alias("f"))
    return f.where("f.type = 'Feature' and size(f.geometry.coordinates) >= 2").select("site_id", "f.properties.index", F.col("f.geometry.type").alias("kind"), "f.properties.length_m", "f.properties.bearing_deg", "f.properties.bend_index", "f.properties.score")


@query(f'WITH {SITES}, {RINGS}, {MEASURED} SELECT site_id, "row", col, round(min(shore), 2) AS shore_m FROM q2 GROUP BY 1, 2, 3')
def geo11_shore_distance(spark, sf_dir):
    return measured(spark, sf_dir).select("site_id", "row", "col", F.round("shore_m", 2).alias("shore_m"))


@query(f"{BASE} SELECT site_id, round(avg(vlat), 6) AS lat, round(avg(vlon), 6) AS lon FROM v GROUP BY 1")
def geo17_representative_point(spark, sf_dir):
    return geo16_thin_and_centre(spark, sf_dir).drop("kept")


@query(f"WITH {SITES} SELECT site_id, round_even(cos(radians(wind - 45)), 3) AS exposure FROM s")
def geo18_wind_exposure(spark, sf_dir):
    return sites(spark, sf_dir).select("site_id", C.wind_exposure(F.col("wind"), F.lit(45.0)).alias("exposure"))
