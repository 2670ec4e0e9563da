"""Matching queries reach every entry: against all pairs, and against their SQL, which has no id filters."""

from __future__ import annotations

import pytest

from sitecast.operators import registry as X
from sitecast.plans import geo_queries, registry_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["jn5_exact_match", "jn6_fuzzy_match", "jn8_match_cascade", "jn7_point_in_polygon", "jn9_nearest_district"])
def test_all_entries_are_matched(spark, name):
    duckdb = pytest.importorskip("duckdb")
    plan = registry_queries if name in registry_queries.QUERIES else geo_queries
    sql = plan.ORACLES[name]
    db = duckdb.connect()
    for t in ("part", "supplier"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = db.sql(sql)
    got = plan.QUERIES[name](spark, SF).select(*want.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_fuzzy_tokens_that_many_entries_share(spark):
    keys = ["zolw duzy", "zolw duza", "zolwie duzy", "maly zolw", "zolw", "duzy", "", "ab", None]
    entries = [(i, keys[i % len(keys)]) for i in range(900)] + [(900, "jedyny zolw")]
    asked = [(i, k) for i, k in enumerate(["zolw", "zolw duzy", "jedyny", "jedyny zolw", "nic", "ab", None, "zolw", "zolw"])]
    alike = lambda a, b: a == b or (k := max(4, (7 * max(len(a), len(b)) + 9) // 10)) <= min(len(a), len(b)) and a[:k] == b[:k]
    words = lambda key: [t for t in (key or "").split(" ") if len(t) >= 3]
    of = lambda q: [e for e, k in entries if words(q) and all(any(alike(t, o) for o in words(k)) for t in words(q))]
    want = {i: (len(m := of(q)), m[0] if len(m) == 1 else None) for i, q in asked}
    queries, listed = spark.createDataFrame(asked, "query_id long, key string"), spark.createDataFrame(entries, "entry_id long, key string")
    assert {r.query_id: (r.hits, r.entry_id) for r in X.match_fuzzy(queries, listed).collect()} == want
    equal = {i: (sum(k is not None and k == q for _, k in entries), 900 if q == "jedyny zolw" else None) for i, q in asked}
    assert {r.query_id: (r.hits, r.entry_id) for r in X.match_exact(queries, listed).collect()} == equal


def test_each_entry_finds_its_own_key(spark, monkeypatch):
    part = registry_queries.listed(spark, SF)
    monkeypatch.setattr(registry_queries, "asked", lambda *_: part.select(part["entry_id"].alias("query_id"), "key"))
    rows = registry_queries.jn5_exact_match(spark, SF).collect()
    assert len(rows) == part.count() and all(r.hits >= 1 and r.entry_id in (None, r.query_id) for r in rows)
