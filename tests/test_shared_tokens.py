"""Queries that share tokens with many entries meet few of them, and what many typed is ranked once."""

from sitecast.operators import registry as R


def test_queries_meet_on_their_rarest_token(spark):
    names = [f"jezioro wspolne {chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}xwlasne" for i in range(1500)]
    asked = spark.createDataFrame([(n[:-1],) for n in names] + [("wspolne jezioro",), ("nic",)], "asked string")
    listed = spark.createDataFrame([(n,) for n in names], "key string")
    met = R.fuzzy_candidates(asked, listed).collect()
    assert len(met) <= 3 * 1500 + 1500 and {(n[:-1], n) for n in names} <= {(r.asked, r.key) for r in met}
    queries = asked.selectExpr("row_number() over (order by asked) as query_id", "asked as key")
    found = {r.key: (r.hits, r.entry_id) for r in queries.join(R.match_fuzzy(queries, listed.selectExpr("cast(substring_index(key, ' ', -1) = 'aaaxwlasne' as long) as entry_id", "key").union(spark.createDataFrame([(7, "inne")], "entry_id long, key string"))), "query_id").collect()}
    assert found["nic"] == (0, None) and found["wspolne jezioro"] == (2, None) and found[names[0][:-1]] == (1, 1) and found[names[5][:-1]] == (1, 0)


def test_a_word_is_ranked_once(spark):
    registry = spark.createDataFrame([(i, f"Zolw {i % 3} nr {i % 40}", f"zolw {i % 3}", 1.0) for i in range(400)], "entry_id long, name string, key string, lat double").selectExpr("*", "array(1.0) as line")
    queries = spark.createDataFrame([(i, "zolw") for i in range(300)], "query_id long, key string")
    found = R.districts(queries, registry)
    want = sorted((f"Zolw {i % 3} nr {i % 40}", i) for i in range(400))[:8]
    rows = found.collect()
    assert len(rows) == 2400 and all((r.name, r.entry_id) == want[r.place - 1] for r in rows)
    windows = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "windowspecdefinition" in line]
    assert windows and not any("query_id" in line for line in windows)
