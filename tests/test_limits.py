"""The attempt limits against their definition, in linear time on one hot address."""

import random
import time

from pyspark.sql import functions as F

from sitecast.operators import notebook as N

LIMITS = (("pair", ("email", "ip"), 3, 60), ("email", ("email",), 5, 200), ("ip", ("ip",), 8, 60))
SCHEMA = "attempt_id long, email string, ip string, ts long, ok boolean"


def by_definition(rows, limits):
    out = {}
    for now in (r for r in rows if not r[4]):
        for name, keys, most, width in limits:
            at = [{"email": 1, "ip": 2}[k] for k in keys]
            if any(now[i] is None for i in at):
                continue
            live = []
            for p in rows:
                if p[4] or any(p[i] != now[i] for i in at) or not now[3] - width <= p[3] < now[3]:
                    continue
                if not any(s[4] and s[1] is not None and s[1] == p[1] and (s[3], s[0]) > (p[3], p[0]) and s[3] <= now[3] for s in rows):
                    live.append(p[3])
            if len(live) >= most:
                out[now[0]] = (name, min(live) + width - now[3])
                break
    return out


def attempts(n, seed):
    rng = random.Random(seed)
    return [(i, rng.choice(("a", "b", "c", None)), rng.choice(("x", "y", None)), rng.randint(0, 1500) - 300, rng.random() < 0.08) for i in range(n)]


def test_limits_equal_their_definition(spark):
    for seed in (1, 2):
        rows = attempts(700, seed)
        found = N.limiter(spark.createDataFrame(rows, SCHEMA).repartition(3), LIMITS).collect()
        assert len(found) == len({r.attempt_id for r in found})
        assert {r.attempt_id: (r.rule, r.retry_after) for r in found} == by_definition(rows, LIMITS)
    assert N.limiter(spark.createDataFrame([], SCHEMA), LIMITS).collect() == []


def test_a_million_attempts_of_one_address_in_one_window(spark):
    n = 1_000_000
    rows = spark.range(n).select(F.col("id").alias("attempt_id"), F.concat(F.lit("u"), F.col("id") % 200_000).alias("email"), F.lit("x").alias("ip"), (F.col("id") % 900).alias("ts"), (F.col("id") % 11 == 0).alias("ok"))
    begin = time.time()
    found = N.limiter(rows).groupBy("rule").count().collect()
    assert time.time() - begin < 120
    assert {r["rule"] for r in found} == {"ip"} and 800_000 < found[0]["count"] < n


def test_the_stateful_pass_equals_the_batch_and_is_linear():
    """The pass over one email's attempts, cut into batches in the order of time."""
    import pandas as pd

    from sitecast.streaming import jobs as S

    own = LIMITS[:2]
    rows = sorted(((i, "a", ip, ts, ok) for i, _, ip, ts, ok in attempts(900, 5)), key=lambda r: (r[3], r[0]))
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    processor, held, decided = S._EmailLimits(own), {}, []
    edges = [0, *(i for i in range(1, len(rows)) if i % 13 == 0 and rows[i][3] != rows[i - 1][3]), len(rows)]
    for begin, stop in zip(edges, edges[1:], strict=False):
        batch = pd.DataFrame(rows[begin:stop], columns=["attempt_id", "email", "ip", "epoch", "ok"])
        more, held = processor._decide(batch, held)
        decided += more
    assert {a: (rule, wait) for a, rule, wait in decided} == by_definition(rows, own)
    n = 300_000
    hot = pd.DataFrame({"attempt_id": range(n), "email": "a", "ip": "x", "epoch": [i % 900 for i in range(n)], "ok": False})
    begin = time.time()
    decided, held = processor._decide(hot, {})
    assert time.time() - begin < 30 and len(decided) > 0.9 * n and len(held) == 900


def test_the_limiter_stream_equals_the_batch(spark):
    from sitecast.plans import job_queries, notebook_queries

    sf = "/root/testdata/sf0.001"
    want = N.limiter(notebook_queries.attempts(spark, sf), notebook_queries.SMALL_LIMITS[:2]).collect()
    found = job_queries.stm3_attempt_limits(spark, sf).collect()
    assert {(r.attempt_id, r.rule, r.retry_after) for r in found} == {(r.attempt_id, r.rule, r.retry_after) for r in want}
