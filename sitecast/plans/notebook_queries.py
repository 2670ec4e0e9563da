"""Queries of the session, rate and limit operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitecast.operators import notebook as N
from sitecast.plans.fixtures import EPOCH, EPOCH_SQL, r6, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _day(c: str) -> str:
    return f"datediff(to_date({c}), date'1970-01-01')"


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.expr(f"cast({_day('o_orderdate')} as bigint) * 86400")
    minutes = F.expr("cast((o_orderkey % 9) * 30 as bigint)")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user_id"), (F.col("o_custkey") % 25).alias("site_id"), start.alias("started_at"), F.when(F.col("o_orderstatus") != "O", start + minutes * 60).alias("ended_at"), minutes.alias("effort_minutes"), F.col("o_orderpriority").alias("method"))


def catches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber") % 3).alias("leg_id"), F.col("l_returnflag").alias("species"), F.col("l_quantity").cast("long").alias("count"), F.when(F.col("l_tax") != 0, F.col("l_extendedprice") / 100).alias("weight_g"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("element_at(array(' PZW ', 'Commercial', ''), cast(n_regionkey % 3 as int) + 1)")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("site_id"), F.col("n_name").alias("name"), kind.alias("raw_type"), N.water_type(kind).alias("water_type"))


SESSIONS = """s AS (SELECT o_orderkey AS session_id, o_custkey AS user_id, o_custkey % 25 AS site_id, date_diff('day', date '1970-01-01', CAST(o_orderdate AS date)) * 86400 AS started_at,
  CASE WHEN o_orderstatus <> 'O' THEN date_diff('day', date '1970-01-01', CAST(o_orderdate AS date)) * 86400 + (o_orderkey % 9) * 1800 END AS ended_at, (o_orderkey % 9) * 30 AS effort_minutes, o_orderpriority AS method FROM orders)"""
CATCHES = "c AS (SELECT l_orderkey AS session_id, l_orderkey * 8 + l_linenumber % 3 AS leg_id, l_returnflag AS species, CAST(trunc(l_quantity) AS bigint) AS count, CASE WHEN l_tax <> 0 THEN l_extendedprice / 100 END AS weight_g FROM lineitem)"
FISH = "f AS (SELECT s.*, coalesce(x.fish, 0) AS fish FROM s LEFT JOIN (SELECT session_id, CAST(sum(count) AS bigint) AS fish FROM c GROUP BY 1) x USING (session_id))"
BASE = f"WITH {SESSIONS}, {CATCHES}, {FISH}"
RATE = "CASE WHEN effort_minutes > 0 THEN round_even(fish / (effort_minutes / 60.0), 2) ELSE 0.0 END"
SITES = "t AS (SELECT n_nationkey AS site_id, n_name AS name, CASE n_regionkey % 3 WHEN 0 THEN 'pzw' WHEN 1 THEN 'commercial' END AS water_type FROM nation)"


def _rated(spark, sf_dir):
    return N.with_catch(sessions(spark, sf_dir), catches(spark, sf_dir)).withColumn("rate", N.catch_rate())


@query(f"{BASE} SELECT session_id, fish, fish = 0 AS is_blank FROM f")
def jn4_sessions_with_catch(spark, sf_dir):
    return N.with_catch(sessions(spark, sf_dir), catches(spark, sf_dir)).select("session_id", "fish", "is_blank")


@query(f"{BASE} SELECT session_id, CAST({RATE} AS double) AS rate FROM f")
def agg9_catch_rate(spark, sf_dir):
    return _rated(spark, sf_dir).select("session_id", "rate")


@query(f"{BASE}, {SITES}, r AS (SELECT f.user_id, {RATE} AS rate, t.water_type FROM f LEFT JOIN t USING (site_id)), g AS (SELECT user_id % 40 AS angler, count(*) AS n, avg(rate) AS mean, count(DISTINCT water_type) AS types, count(*) FILTER (water_type IS NULL) AS unset FROM r GROUP BY 1) SELECT angler, n, round(CASE WHEN unset = 0 AND types <= 1 THEN mean END, 6) AS mean_rate, CASE WHEN unset > 0 THEN 'type unset' WHEN types > 1 THEN 'types mixed' END AS refusal FROM g")
def agg10_comparable_mean(spark, sf_dir):
    rated = _rated(spark, sf_dir).join(sites(spark, sf_dir).select("site_id", "water_type"), "site_id", "left").withColumn("angler", F.col("user_id") % 40)
    return r6(N.mean_rate(rated, ["angler"]))


@query(f"{BASE} SELECT site_id, count(*) AS sessions, count(*) FILTER (fish = 0) AS blanks, max(started_at) AS last_visit FROM f WHERE ended_at IS NOT NULL GROUP BY 1")
def agg11_visit_stats(spark, sf_dir):
    return N.visit_stats(_rated(spark, sf_dir), ["site_id"])


REGISTER = "reg AS (SELECT p_partkey % 30 AS site_id, 2015 + p_size % 10 AS year, avg(p_retailprice) / 500 AS kg FROM part GROUP BY 1, 2)"


@query(f"""{BASE}, {REGISTER}, k AS (SELECT session_id, sum(count * weight_g / 1000.0) AS kg FROM c GROUP BY 1), own AS (SELECT site_id, sum(coalesce(kg, 0)) / sum(greatest(effort_minutes, 1) / 1440.0) AS own_rate FROM s LEFT JOIN k USING (session_id) WHERE ended_at IS NOT NULL GROUP BY 1),
  n AS (SELECT site_id, arg_max(kg, year) AS register_rate FROM reg GROUP BY 1)
  SELECT coalesce(own.site_id, n.site_id) AS site_id, round(own_rate, 4) AS own_rate, round(register_rate, 4) AS register_rate, round(own_rate / register_rate, 4) AS ratio, CASE WHEN own_rate / register_rate IS NULL THEN 'one side only' WHEN own_rate / register_rate >= 1 THEN 'at or above' ELSE 'below' END AS verdict FROM own FULL JOIN n ON own.site_id = n.site_id""")
def agg12_weight_per_day(spark, sf_dir):
    register = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 30).alias("site_id"), (F.lit(2015) + F.col("p_size") % 10).alias("year")).agg((F.avg("p_retailprice") / 500).alias("kg_per_angler_day"))
    rows = N.weight_per_day(sessions(spark, sf_dir), catches(spark, sf_dir), register)
    return rows.select("site_id", *(F.round(c, 4).alias(c) for c in ("own_rate", "register_rate", "ratio")), "verdict")


LEGS = "legs AS (SELECT session_id * 8 + i.i AS leg_id, session_id, session_id % 12 AS zone_id, started_at + i.i * 3600 AS from_ts, CASE WHEN ended_at IS NOT NULL THEN started_at + i.i * 3600 + effort_minutes * 20 END AS to_ts, method FROM s CROSS JOIN range(0, 3) i(i))"


def legs(spark, sf_dir):
    rows = sessions(spark, sf_dir).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return rows.select((F.col("session_id") * 8 + F.col("i")).alias("leg_id"), "session_id", (F.col("session_id") % 12).alias("zone_id"), (F.col("started_at") + F.col("i") * 3600).alias("from_ts"), F.when(F.col("ended_at").isNotNull(), F.col("started_at") + F.col("i") * 3600 + F.col("effort_minutes") * 20).alias("to_ts"), "method")


LEG_FISH = "lf AS (SELECT legs.*, (to_ts - from_ts) / 3600.0 AS hours, coalesce(x.fish, 0) AS fish FROM legs LEFT JOIN (SELECT leg_id, CAST(sum(count) AS bigint) AS fish FROM c GROUP BY 1) x USING (leg_id))"


@query(f"{BASE}, {LEGS}, {LEG_FISH} SELECT leg_id, fish, round(CASE WHEN hours > 0 THEN fish / hours END, 6) AS rate FROM lf")
def agg17_leg_rates(spark, sf_dir):
    return r6(N.leg_rates(legs(spark, sf_dir), catches(spark, sf_dir)).select("leg_id", "fish", "rate"))


@query(f"{BASE}, {LEGS} SELECT zone_id * 100 + session_id % 97 AS zone, count(*) AS legs, round(sum(coalesce((to_ts - from_ts) / 3600.0, 0)), 6) AS hours, CASE WHEN count(*) <= 4 THEN 'low' WHEN count(*) <= 15 THEN 'medium' ELSE 'high' END AS confidence, CASE WHEN sum(coalesce((to_ts - from_ts) / 3600.0, 0)) < 10 THEN 0.8::double ELSE 0.0 END AS bonus FROM legs GROUP BY 1")
def agg18_zone_coverage(spark, sf_dir):
    return r6(N.zone_coverage(legs(spark, sf_dir).withColumn("zone", F.col("zone_id") * 100 + F.col("session_id") % 97), "zone"))


@query(f"{BASE}, {LEGS}, {LEG_FISH} SELECT zone_id, method, CAST(sum(fish) AS bigint) AS fish, round(sum(hours), 6) AS hours, count(*) AS n, round(CASE WHEN sum(hours) > 0 THEN sum(fish) / sum(hours) END, 6) AS rate FROM lf GROUP BY 1, 2")
def agg20_rate_by_condition(spark, sf_dir):
    return r6(N.grouped_rate(N.leg_rates(legs(spark, sf_dir), catches(spark, sf_dir)), ["zone_id", "method"]))


@query(f"{BASE}, w AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY started_at DESC, session_id DESC) AS place FROM f WHERE ended_at IS NOT NULL) SELECT site_id, session_id, place FROM w WHERE place <= 50")
def win7_newest_sessions(spark, sf_dir):
    return N.newest_sessions(sessions(spark, sf_dir), ["site_id"]).select("site_id", "session_id", "place")


@query(f"{BASE} SELECT user_id, session_id, row_number() OVER w AS place, row_number() OVER w = 1 AS is_active, count(*) OVER (PARTITION BY user_id) > 1 AS overlaps FROM s WHERE ended_at IS NULL WINDOW w AS (PARTITION BY user_id ORDER BY started_at DESC, session_id DESC)")
def win8_open_sessions(spark, sf_dir):
    return N.open_sessions(sessions(spark, sf_dir)).select("user_id", "session_id", "place", "is_active", "overlaps")


@query(f"{BASE} SELECT session_id, CASE WHEN ended_at IS NOT NULL THEN greatest(1, (ended_at - started_at + session_id % 60) // 60) END AS minutes, fish = 0 AS is_blank FROM f")
def dt1_session_effort(spark, sf_dir):
    rows = N.with_catch(sessions(spark, sf_dir), catches(spark, sf_dir))
    return rows.select("session_id", N.effort_minutes(F.col("started_at"), F.col("ended_at") + F.col("session_id") % 60).alias("minutes"), "is_blank")


@query(f"WITH {SITES} SELECT site_id, water_type FROM t")
def flt3_water_type(spark, sf_dir):
    return sites(spark, sf_dir).select("site_id", "water_type")


@query("SELECT p_partkey AS species_id, p_name AS name, p_size % 2 = 0 AS favourite FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_brand) LIKE '%ring%' OR lower(p_type) LIKE '%ring%'")
def flt5_species_search(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return N.search_names(part, "RING", ["p_name", "p_brand", "p_type"]).select(F.col("p_partkey").alias("species_id"), F.col("p_name").alias("name"), (F.col("p_size") % 2 == 0).alias("favourite"))


PREFS = "pref AS (SELECT c_custkey AS user_id, c_nationkey AS site_id, c_acctbal > 5000 AS is_favourite, CASE WHEN c_acctbal < 0 THEN c_custkey END AS removed_at FROM customer)"


def _prefs(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("long").alias("site_id"), (F.col("c_acctbal") > 5000).alias("is_favourite"), F.when(F.col("c_acctbal") < 0, F.col("c_custkey")).alias("removed_at"))


@query(f"WITH {SITES}, {PREFS} SELECT t.site_id, coalesce(is_favourite, false) AS is_favourite, coalesce(removed_at IS NOT NULL, false) AS is_removed FROM t LEFT JOIN pref ON t.site_id = pref.site_id AND pref.user_id = 7")
def jn13_preferences(spark, sf_dir):
    return N.preferences(sites(spark, sf_dir).select("site_id"), _prefs(spark, sf_dir), F.lit(7))


@query(f"""{BASE}, {SITES}, {PREFS}, st AS (SELECT site_id, count(*) AS sessions FROM s WHERE ended_at IS NOT NULL GROUP BY 1), sc AS (SELECT site_id, arg_max(effort_minutes, session_id) AS score FROM s GROUP BY 1)
  SELECT pref.user_id, t.site_id, score, coalesce(sessions, 0) AS sessions, row_number() OVER (PARTITION BY pref.user_id ORDER BY is_favourite DESC, lower(t.name), t.site_id) AS place
  FROM pref JOIN t ON t.site_id = pref.site_id LEFT JOIN sc ON sc.site_id = t.site_id LEFT JOIN st ON st.site_id = t.site_id WHERE t.water_type = 'pzw' AND removed_at IS NULL""")
def flt6_site_cards(spark, sf_dir):
    own = sites(spark, sf_dir).where("water_type = 'pzw'").join(_prefs(spark, sf_dir), "site_id").withColumn("is_removed", F.col("removed_at").isNotNull())
    runs = sessions(spark, sf_dir)
    latest = runs.groupBy("site_id").agg(F.max_by("effort_minutes", "session_id").alias("score"))
    stats = runs.where("ended_at is not null").groupBy("site_id").agg(F.count("*").alias("sessions"))
    return N.site_cards(own, latest, stats).select("user_id", "site_id", "score", "sessions", "place")


ADDS = f"SELECT event_id, user_id, {EPOCH_SQL} + minute(ts) * 60 AS ts FROM events WHERE event_type = 'signup'"


@query(f"SELECT event_id, user_id, count(*) OVER w AS used, greatest(0, 5 - count(*) OVER w) AS remaining, min(ts) OVER w + 86400 AS resets_at FROM ({ADDS}) WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)")
def win11_trailing_quota(spark, sf_dir):
    adds = table(spark, sf_dir, "events").where("event_type = 'signup'").select("event_id", "user_id", (F.expr(EPOCH) + F.expr("minute(ts) * 60L")).alias("ts"))
    return N.trailing_quota(adds).select("event_id", "user_id", "used", "remaining", "resets_at")


ATTEMPTS = f"a AS (SELECT event_id AS attempt_id, user_id AS email, CASE WHEN user_id % 17 <> 0 THEN user_id % 20 END AS ip, {EPOCH_SQL} + minute(ts) * 60 AS ts, event_type = 'purchase' AS ok FROM events WHERE event_type IN ('error', 'purchase'))"
SMALL_LIMITS = (("pair", ("email", "ip"), 2, 36000), ("email", ("email",), 3, 86400), ("ip", ("ip",), 4, 36000))


def attempts(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type in ('error', 'purchase')").select(F.col("event_id").alias("attempt_id"), F.col("user_id").alias("email"), F.when(F.col("user_id") % 17 != 0, F.col("user_id") % 20).alias("ip"), (F.expr(EPOCH) + F.expr("minute(ts) * 60L")).alias("ts"), (F.col("event_type") == "purchase").alias("ok"))


def limit_sql(limits: tuple) -> str:
    parts, waits = [], []
    for name, keys, most, width in limits:
        on = " AND ".join(f"p.{k} = n.{k}" for k in keys)
        parts.append(f"w_{name} AS (SELECT n.attempt_id, min(p.ts) + {width} - n.ts AS wait FROM x n JOIN x p ON {on} AND NOT p.ok AND p.ts >= n.ts - {width} AND p.ts < n.ts AND (p.cleared IS NULL OR p.cleared > n.ts) WHERE NOT n.ok GROUP BY n.attempt_id, n.ts HAVING count(*) >= {most})")
        waits.append(name)
    case = " ".join(f"WHEN w_{n}.wait IS NOT NULL THEN '{n}'" for n in waits)
    joins = " ".join(f"LEFT JOIN w_{n} ON w_{n}.attempt_id = x.attempt_id" for n in waits)
    return f"WITH {ATTEMPTS}, x AS (SELECT *, min(CASE WHEN ok THEN ts END) OVER (PARTITION BY email ORDER BY ts, attempt_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS cleared FROM a), {', '.join(parts)} SELECT * FROM (SELECT x.attempt_id, CASE {case} END AS rule, coalesce({', '.join(f'w_{n}.wait' for n in waits)}) AS retry_after FROM x {joins} WHERE NOT x.ok) WHERE rule IS NOT NULL"


@query(limit_sql(SMALL_LIMITS))
def win12_attempt_limits(spark, sf_dir):
    """The synthetic attempts are far apart, so the windows are wider and the limits lower than the defaults."""
    return N.limiter(attempts(spark, sf_dir), SMALL_LIMITS)


PREDICTIONS = "p AS (SELECT o_orderkey AS prediction_id, 'v' || o_orderkey % 3 AS ruleset, (o_totalprice / 50000.0) AS day_score, (o_orderkey % 5 - 2) / 10.0 AS trend, 0.4 AS light FROM orders)"


def _outcomes(spark, sf_dir):
    predictions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("prediction_id"), F.concat(F.lit("v"), F.col("o_orderkey") % 3).alias("ruleset"), (F.col("o_totalprice") / 50000.0).alias("day_score"), F.map_from_arrays(F.array(F.lit("pressure_trend"), F.lit("light_window")), F.array((F.col("o_orderkey") % 5 - 2) / 10.0, F.lit(0.4))).alias("contributions"))
    return N.outcome(predictions, _rated(spark, sf_dir).where("ended_at is not null").withColumn("prediction_id", F.col("session_id")))


@query(f"""{BASE}, {PREDICTIONS}, j AS (SELECT ruleset, session_id, {RATE} AS rate, day_score FROM f JOIN p ON p.prediction_id = f.session_id WHERE ended_at IS NOT NULL),
  r AS (SELECT ruleset, row_number() OVER (PARTITION BY ruleset ORDER BY day_score, session_id) - row_number() OVER (PARTITION BY ruleset ORDER BY rate, session_id) AS d FROM j) SELECT ruleset, count(*) AS n, round(1 - 6 * sum(d * d)::double / (count(*)::double * (count(*)::double * count(*) - 1)), 6) AS rho FROM r GROUP BY 1""")
def cal4_outcome_correlation(spark, sf_dir):
    return r6(N.spearman(_outcomes(spark, sf_dir), ["ruleset"], "day_score", "rate", "session_id"))


@query(f"""{BASE}, {PREDICTIONS}, j AS (SELECT ruleset, {RATE} AS rate, trend, light FROM f JOIN p ON p.prediction_id = f.session_id WHERE ended_at IS NOT NULL), e AS (SELECT ruleset, rate, 'pressure_trend' AS rule, trend AS part FROM j UNION ALL SELECT ruleset, rate, 'light_window', light FROM j)
  SELECT rule, ruleset, count(*) AS n, round(avg(CASE WHEN rate >= 20.0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM e WHERE part > 0 GROUP BY 1, 2""")
def cal4_rule_hits(spark, sf_dir):
    return r6(N.rule_hits(_outcomes(spark, sf_dir), 20.0))
