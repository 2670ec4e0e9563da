"""Literal cases of the registry, fact, session and geometry operators, and of the rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sitecast.functions import columns as C
from sitecast.functions import rules as R
from sitecast.functions import text as T
from sitecast.operators import geo as G
from sitecast.operators import notebook as N
from sitecast.operators import registry as X


def test_name_keys(spark):
    names = ["j. Pomocnia", "Jezioro Pomocnia", "0.101 Stobrawa - staw", "Kanał Żerański", "STAW", None]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(T.name_key(F.col("n"))).collect()]
    assert got == ["pomocnia", "pomocnia", "stobrawa staw", "zeranski", "", None]


def test_ambiguity_is_refused(spark):
    listed = spark.createDataFrame([("czarne", 1), ("czarne", 2), ("biale", 3), ("szczesliwice warszawa", 4)], "key string, entry_id long")
    asked = spark.createDataFrame([(1, "czarne"), (2, "biale"), (3, "nowe"), (4, "szczesliwickie")], "query_id long, key string")
    exact = {r.query_id: r.entry_id for r in X.match_exact(asked, listed).collect()}
    fuzzy = {r.query_id: r.entry_id for r in X.match_fuzzy(asked, listed).collect()}
    assert exact == {1: None, 2: 3, 3: None, 4: None} and fuzzy == {1: None, 2: 3, 3: None, 4: 4}
    inside = spark.createDataFrame([(3, 9)], "query_id long, entry_id long")
    how = {r.query_id: (r.how, r.entry_id) for r in X.cascade(asked, inside, X.match_exact(asked, listed), X.match_fuzzy(asked, listed)).collect()}
    assert how == {1: (None, None), 2: ("exact", 3), 3: ("inside", 9), 4: ("fuzzy", 4)}


def test_merge_takes_fields_from_the_first_source(spark):
    rows = spark.createDataFrame([("k", "Name", "", None, 0), ("k", "Long name", "Here", 5.0, 1), ("m", "A", "x", None, 0), ("m", "B", "y", None, 1), ("m", "C", "", 3.0, 2)], "key string, name string, place string, area_ha double, src_ord int")
    got = sorted((r.key, r.name, r.place, r.area_ha) for r in X.merge(rows, ["place", "area_ha"]).collect())
    assert got == [("k", "Long name", "Here", 5.0), ("m", "A", "x", None), ("m", "B", "y", None)]


def test_facts_are_rejected_with_reasons(spark):
    items = [(1, 0, "species", "Pike", "yes", "https://a.example/x", None, "HIGH"), (1, 1, "species", "pike", "again", "https://a.example/x", None, None), (1, 2, "gossip", "k", "v", "https://a.example", None, None), (1, 3, "depth", " ", "v", "https://a.example", None, None), (1, 4, "depth", "max", "3 m", "ftp://a.example", None, "sure"), (1, 5, "depth", "max", "3 m", "https://host.", None, None)]
    rows = X.parse_facts(spark.createDataFrame(items, "answer_id long, pos long, topic string, key string, value string, source_url string, source_title string, confidence string")).orderBy("pos").collect()
    assert [r.reason for r in rows] == [None, "duplicate", "unknown topic", "empty key or value", "no usable source", "no usable source"]
    assert rows[0].confidence == "high" and rows[1].confidence == "low" and rows[0].source_title == "a.example"


def test_collapse_keeps_the_fullest(spark):
    rows = [(1, 0, "Kanał X", "canal", "way", 1.0, 52.0, 21.0), (2, 1, "Kanał X", "canal", "relation", 0.5, 53.0, 21.0), (3, 2, "Jezioro Y", "lake", "way", 1.0, 52.0, 21.0), (4, 3, "j. Y", "lake", "way", 2.0, 52.001, 21.0), (5, 4, "Jezioro Y", "lake", "way", 9.0, 53.0, 21.0)]
    got = X.collapse(spark.createDataFrame(rows, "cand_id long, pos long, name string, kind string, osm_type string, area_ha double, lat double, lon double"))
    assert sorted(r.cand_id for r in got.collect()) == [2, 4, 5]


def test_suggestions(spark):
    listed = spark.createDataFrame([("pomocnia", "Pomocnia"), ("zegrzynskie", "Zegrzyńskie"), ("x", "X")], "key string, name string")
    got = X.suggest(spark.createDataFrame([(1, "pomocna"), (2, "qq")], "query_id long, key string"), listed).collect()
    assert [(r.query_id, r.key) for r in got] == [(1, "pomocnia")]


def test_blank_sessions_count(spark):
    sessions = spark.createDataFrame([(i, 1, 5, i * 10, i * 10 + 7200, 120, "pzw") for i in range(12)], "session_id long, user_id long, site_id long, started_at long, ended_at long, effort_minutes long, water_type string")
    catches = spark.createDataFrame([(i, 3) for i in range(0, 12, 2)], "session_id long, count long")
    rated = N.with_catch(sessions, catches).withColumn("rate", N.catch_rate())
    assert rated.count() == 12 and rated.where("rate = 0").count() == 6
    assert N.mean_rate(rated, ["user_id"]).first().mean_rate == 0.75
    mixed = rated.withColumn("water_type", F.when(F.col("session_id") > 5, "commercial").otherwise("pzw"))
    assert N.mean_rate(mixed, ["user_id"]).first().refusal == "types mixed"
    assert N.mean_rate(rated.withColumn("water_type", F.lit(None).cast("string")), ["user_id"]).first().mean_rate is None


def test_limits_and_clearing(spark):
    rows = [(i, "a", "x", 100 + i * 10, False) for i in range(6)] + [(10, "a", "x", 200, True), (11, "a", "x", 210, False), (12, None, "x", 220, False)]
    got = N.limiter(spark.createDataFrame(rows, "attempt_id long, email string, ip string, ts long, ok boolean")).collect()
    assert [(r.attempt_id, r.rule, r.retry_after) for r in got] == [(5, "pair", 850)]


def test_rank_correlation(spark):
    rows = spark.createDataFrame([(1, i, float(i), float(-i)) for i in range(10)] + [(2, 0, 1.0, 1.0)], "g int, i int, x double, y double")
    got = {r.g: r.rho for r in N.spearman(rows, ["g"], "x", "y", "i").collect()}
    assert got == {1: -1.0, 2: None}


def test_sections_of_a_kilometre(spark):
    line = spark.createDataFrame([(1, [(52.0, 21.0), (52.008983, 21.0)])], "site_id long, line array<struct<lat:double,lon:double>>")
    assert G.cut_sections(line, lo=250).count() == 4
    assert G.cut_sections(line, lo=450).count() == 2
    shape = G.section_shape(G.cut_sections(line)).first()
    assert shape.bearing_deg == 0 and shape.bend_index < 1e-6


def test_rings_are_stitched(spark):
    ways = [(1, 1, [(0.0, 0.0), (0.0, 1.0)]), (1, 2, [(1.0, 1.0), (0.0, 1.0)]), (1, 3, [(1.0, 1.0), (0.0, 0.0)]), (1, 4, [(5.0, 5.0), (6.0, 6.0)]), (2, 1, [(0.0, 0.0), (0.0, 1.0)])]
    got = G.stitch(spark.createDataFrame(ways, "relation_id long, way_id long, points array<struct<lat:double,lon:double>>")).collect()
    assert [(r.relation_id, r.n_points) for r in got] == [(1, 4)]


def test_both_fetches_agree(spark):
    base = spark.createDataFrame([(1, 52.0, 21.0, 30.0)], "site_id long, lat double, lon double, area_ha double").withColumn("ring", C.circle_ring(F.col("lat"), F.col("lon"), F.col("area_ha"))).withColumn("cell_m", F.lit(60.0))
    grid = G.grid(base)
    fast = {(r.row, r.col): r for r in G.geometry(base, [225.0]).collect()}
    points = grid.select((F.col("row") * 1000 + F.col("col")).alias("point_id"), "lat", "lon").crossJoin(base.select("ring"))
    slow = {r.point_id: r.fetch_m for r in G.fetch_edges(points, F.lit(225.0)).collect()}
    assert len(fast) > 60 and all(abs(r.fetch_m - slow[r.row * 1000 + r.col]) < 0.01 for r in fast.values())
    assert all(0 <= r.shore_m for r in fast.values())


def test_percentiles_and_live_terms(spark):
    cells = spark.createDataFrame([(1, i, 100 + i * 0.001) for i in range(40)] + [(2, 0, 1.0)], "site_id long, row long, raw double")
    got = G.percentile_ties(cells, "raw", ["site_id"], "p").collect()
    assert {r.p for r in got if r.site_id == 2} == {0.5}
    own = [r.p for r in got if r.site_id == 1]
    assert min(own) == 0 and max(own) == 1 and sum(p <= 0.25 for p in own) >= 8
    flat = spark.createDataFrame([(1, 0, i, 100.0, 60.0, 20.0, 19.0, 26.8, 4.0, "pzw") for i in range(3)], "site_id long, row long, col long, fetch_m double, shore_m double, water_c double, water_24h double, t_opt double, wind_ms double, water_type string")
    assert G.factor_score(flat, ["site_id"]).count() == 0


def test_rules_are_checked_first(spark):
    df = spark.createDataFrame([(1.0, None), (9.0, 2.0)], "a double, b double")
    got = R.apply_rules(df, {"c": "clamp(a / 3, 0, 1)", "d": "c + coalesce_free".replace("coalesce_free", "clamp(b, 0, clamp(a, 0, 1))")}).collect()
    assert [round(r.c, 4) for r in got] == [0.3333, 1.0] and [r.d for r in got] == [None, 2.0]
    for bad in ("a + unknown", "system(a)", "a; drop", "reflect('x', 'y')"):
        with pytest.raises(R.RuleError):
            R.apply_rules(df, {"x": bad})
    assert [r.k for r in R.first_match(df, "k", {"low": "a < 2", "any": "a > 0"}).collect()] == ["low", "any"]
