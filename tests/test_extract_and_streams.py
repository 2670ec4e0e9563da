"""Extraction from literal sources, name suggestions against brute force, high latitudes, and streams against their batch twins."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from sitecast.operators import extract as X
from sitecast.operators import geo as G
from sitecast.operators import notebook as N
from sitecast.operators import registry as R
from sitecast.plans import job_queries, notebook_queries
from sitecast.streaming import jobs as S

SF = "/root/testdata/sf0.001"


def figures(spark, body: str):
    text = f"1. Spis (Tabela nr 3) 7 wędkarzy\nII. Łowiska\n1.1. Zalew Duży (Tabela nr 12)\n{body}"
    return X.report_figures(spark.createDataFrame([(1, text)], "report_id long, text string")).collect()


def test_shares_follow_their_species(spark):
    cases = {
        "karp 2,8%": {"carp": 2.8}, "karpia (1%)": {"carp": 1.0}, "ryby karpiowate 57%": {}, "karp o średniej wadze 3,90 kg stanowił 5,4%": {"carp": 5.4},
        "leszcz, płoć, wzdręga i ukleja stanowiące odpowiednio 57%, 6% i 0,4%": {}, "udziałem (85%) zaznaczył się karp": {"carp": 85.0}, "suma 3%": {"catfish": 3.0}, "konsument 3%": {},
    }
    for body, want in cases.items():
        (row,) = figures(spark, body)
        assert (row.table_no, row.name, row.species_pct) == (12, "Zalew Duży", want), body


def test_report_figures_take_the_first_phrasing(spark):
    (row,) = figures(spark, "1 234 wędkarzy. Całkowity odłowy 12 345,5 kg. Łowili 0, 29 kg rocznie; dzienny odłów to 0,62 kg. 12,5 dni.")
    assert (row.anglers, row.total_kg, row.kg_per_angler_year, row.kg_per_angler_day, row.days_per_angler) == (1234, 12345.5, 0.29, 0.62, 12.5)
    assert X.report_figures(spark.createDataFrame([(1, "no body"), (2, None)], "report_id long, text string")).count() == 0


def test_table_rows_and_names(spark):
    lines = ["  wrapped before any row", "Nazwa akwenu    Miejsce", "j. Pomocnia14   Pomiechówek   12,50", "   i okolice", "7", "2. Jeziora", "Glinianki Szczęśliwice3    2   Warszawa Ochota", "", "Staw bez miejsca"]
    got = X.table_rows(spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, line_no long, line string")).orderBy("line_no").collect()
    assert [(r.line_no, r.name, r.place, r.area_ha) for r in got] == [(2, "Jezioro Pomocnia", "Pomiechówek i okolice", 12.5), (6, "Glinianki Szczęśliwice", "Warszawa Ochota Staw bez miejsca", None)]
    names = {"j. Przytom- ne": "Jezioro Przytomne", "rz. Narew    1": "Rzeka Narew", "rz. Bug Nr 5 obwodu rybackiego": "Rzeka Bug", "j. Pomocnia w zlewni rzeki Wkra Nr 4": "Jezioro Pomocnia", "rz. Narew 1, Nr 8": "Rzeka Narew"}
    rows = spark.createDataFrame([(k,) for k in names], "cell string").select("cell", X.tidy_name(F.col("cell")).alias("name")).collect()
    assert {r["cell"]: r["name"] for r in rows} == names


def test_suggestions_equal_all_pairs(spark):
    keys = ["narew nr 7", "narew nr 8", "bug", "bugaj", "wisla", "wisła", "pilica", "pilca", "zegrze", "zegrzynskie", "ab", "abc", "abcd", "narew", "wkra nr 4", "czarna woda", "czarna", "zzz"]
    asked = ["narew", "narwe", "zegrz", "bug", "pilcia", "abc", "czarna wod", "xx", "zegrzyn", "nr 8", "woda"]
    entries = [(i, f"Rzeka {k} Nr {i}", k, None if i % 4 == 3 else 52.0) for i, k in enumerate(keys * 2)]
    registry = spark.createDataFrame(entries, "entry_id long, name string, key string, lat double").withColumn("line", F.array().cast("array<double>"))
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, key string")

    def ratio(q, k):
        return SequenceMatcher(None, q, k).ratio()

    want = {}
    for i, q in enumerate(asked):
        best = {}
        for _, name, k, _lat in entries:
            r = ratio(q, k) + (0.15 if k.startswith(q[:4]) or q.startswith(k[:4]) else 0)
            if len(q) >= 3 and r >= 0.62:
                best[k] = min(best.get(k, (-r, name)), (-r, name))
        want[i] = [k for k, _ in sorted(best.items(), key=lambda x: (x[1], x[0]))[:5]]
    got = {i: [] for i in want}
    for r in R.suggest(queries, registry).orderBy("query_id", "place").collect():
        got[r.query_id].append(r.key)
    assert got == want
    fit = {}
    for i, q in enumerate(asked):
        scored = [(-(ratio(q, k) + (0.35 if k.startswith(q) else 0.2 if q in k else 0)), name, e) for e, name, k, lat in entries if lat is not None and len(q) >= 3]
        fit[i] = [e for s, _, e in sorted(scored) if -s >= 0.62][:8]
    got = {i: [] for i in fit}
    for r in R.districts(queries, registry).orderBy("query_id", "place").collect():
        got[r.query_id].append(r.entry_id)
    assert got == fit


def test_neighbours_near_the_pole(spark):
    points = spark.createDataFrame([(1, 70.0, 20.0), (2, 85.0, 179.0), (3, -64.99, 10.0)], "query_id long, lat double, lon double")
    lines = spark.createDataFrame([(7, [(70.0, 20.199)]), (8, [(85.0, 179.7)]), (9, [(-65.01, 10.1)])], "entry_id long, line array<struct<lat:double,lon:double>>")
    got = {r.query_id: r.entry_id for r in G.nearest_vertex(points, lines).collect()}
    assert got == {1: 7, 2: 8, 3: 9}
    near = G.points_near(points, spark.createDataFrame([(5, 70.0001, 20.0), (6, 70.001, 20.0)], "entry_id long, lat double, lon double")).collect()
    assert [(r.query_id, r.entry_id) for r in near] == [(1, 5)]


def test_midpoint_lies_halfway_along(spark):
    line = [(52.0, 0.0), (52.0, 0.0001), (52.0, 0.002)]
    rows = spark.createDataFrame([(1, 0, 137.0, line)], "site_id long, index int, length_m double, points array<struct<lat:double,lon:double>>")
    assert abs(G.section_shape(rows).first().mid.lon - 0.001) < 1e-9


def test_rings_are_stitched_at_either_end(spark):
    ways = [(1, 1, [(0.0, 0.0), (0.0, 1.0)]), (1, 2, [(1.0, 1.0), (0.0, 0.0)]), (1, 3, [(0.0, 1.0), (1.0, 1.0)])]
    got = G.stitch(spark.createDataFrame(ways, "relation_id long, way_id long, points array<struct<lat:double,lon:double>>")).collect()
    assert [(r.relation_id, r.n_points) for r in got] == [(1, 4)]


def test_streams_equal_their_batch_twins(spark):
    rows = notebook_queries.attempts(spark, SF)
    want = {(r.attempt_id, r.rule, r.retry_after) for r in N.limiter(rows, notebook_queries.SMALL_LIMITS).collect()}
    assert want == {(r.attempt_id, r.rule, r.retry_after) for r in job_queries.stm3_all_rules(spark, SF).collect()}
    assert S.standing(spark.createDataFrame([(1, "ip", 5, 0), (1, None, None, 1), (2, "pair", 3, 0)], "attempt_id long, rule string, retry_after long, batch int")).count() == 1
    late = {(r.site_id, r.ts): r.temp_c for r in job_queries.stm1_late_hours(spark, SF).collect()}
    once = {(r.site_id, r.ts): r.temp_c for r in job_queries.stm1_upsert_stream(spark, SF).collect()}
    edge = int((19723 + 22.5) * 86400)
    assert late.keys() == once.keys() and all(abs(late[k] - v - (edge - 3 * 86400 <= k[1] < edge - 2 * 86400)) < 1e-5 for k, v in once.items())
