"""Queries of rules, sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitecast import params as P
from sitecast.functions import rules as R
from sitecast.operators import weather as W
from sitecast.plans import notebook_queries as NQ
from sitecast.plans.fixtures import DAY0, OBS_SQL, anchors, obs, r6, table
from sitecast.plans.weather_queries import BASE, FEATURES, ORACLES as WEATHER_SQL, QUERIES as WEATHER
from sitecast.sources import weather_json as J
from sitecast.sources.scratch import scratch
from sitecast.streaming import jobs as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle.replace(" at,", ' "at",')
        return f

    return add


@query(f"WITH {OBS_SQL} SELECT site_id, ts, round(greatest(0.0, least(1.0, 1 - abs(pressure_msl - 1013) / 14)), 6) AS comfort, round(greatest(0.0, least(1.0, 1 - abs(pressure_msl - 1013) / 14)) * greatest(0.0, least(1.0, temp_c / 30)), 6) AS index_value FROM obs")
def udf1_rule_columns(spark, sf_dir):
    rules = {"comfort": "clamp(1 - abs(pressure_msl - 1013) / 14, 0, 1)", "index_value": "comfort * clamp(temp_c / 30, 0, 1)"}
    return r6(R.apply_rules(obs(spark, sf_dir), rules).select("site_id", "ts", "comfort", "index_value"))


@query(f"{BASE}, {FEATURES} SELECT site_id, at, regime FROM m".replace(" at, ", ' "at", '))
def udf2_first_match(spark, sf_dir):
    rows = W.pressure_features(anchors(spark, sf_dir), obs(spark, sf_dir)).drop("regime")
    known = F.col("dp_6h").isNotNull() & F.col("stability_48h").isNotNull()
    out = R.first_match(rows, "regime", P.REGIMES)
    return out.select("site_id", "at", F.when(known, F.col("regime")).alias("regime"))


@query(f"WITH {OBS_SQL} SELECT site_id, ts AS epoch, round(temp_c, 6) AS temperature_2m, round(dewpoint_c, 6) AS dewpoint_2m, CAST(NULL AS double) AS precipitation FROM obs")
def src1_hourly_json(spark, sf_dir):
    """The hourly fixture folded into one columnar reply a site and day, and unfolded again."""
    rows = obs(spark, sf_dir).withColumn("day", F.floor(F.col("ts") / P.DAY)).withColumn("t", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm"))
    held = rows.groupBy("site_id", "day").agg(F.array_sort(F.collect_list(F.struct("ts", F.round("temp_c", 6).alias("temp"), F.round("dewpoint_c", 6).alias("dew")))).alias("h"))
    text = F.transform("h", lambda x: F.concat(F.date_format(F.to_timestamp(F.timestamp_seconds(x["ts"])), "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(F.timestamp_seconds(x["ts"]), "XXX")))
    body = F.to_json(F.struct(F.struct(F.transform(text, lambda t: F.replace(t, F.lit("Z"), F.lit("+00:00"))).alias("time"), F.transform("h", lambda x: x["temp"]).alias("temperature_2m"), F.transform("h", lambda x: x["dew"]).alias("dew_point_2m")).alias("hourly")))
    found = J.hourly_rows(held.select("site_id", body.alias("body")))
    return found.select("site_id", F.unix_timestamp("ts").alias("epoch"), "temperature_2m", "dewpoint_2m", "precipitation")


@query(f"SELECT site_id, target_day, horizon, run, day_score FROM ({WEATHER_SQL['mod19_predictions']}) m CROSS JOIN (VALUES (1), (2)) r(run)")
def src7_append_predictions(spark, sf_dir):
    """Two runs of predictions appended; both stay."""
    path = scratch(spark, "predictions")
    rows = WEATHER["mod19_predictions"](spark, sf_dir)
    for run in (1, 2):
        J.append_predictions(rows.withColumn("run", F.lit(run)), path)
    return spark.read.parquet(path).select("site_id", F.col("target_day").cast("long").alias("target_day"), "horizon", "run", "day_score")


@query("SELECT user_id % 5 AS site_id, CAST(date_diff('day', date '1970-01-01', CAST(ts AS date)) AS bigint) AS for_day, count(*) * CASE WHEN date_diff('day', date '1970-01-01', CAST(ts AS date)) % 2 = 0 THEN 2 ELSE 1 END AS cells FROM events GROUP BY 1, 2, date_diff('day', date '1970-01-01', CAST(ts AS date)) % 2")
def src8_replace_grids(spark, sf_dir):
    """Grids of all days, then those of even days again: only these change."""
    path = scratch(spark, "grids")
    days = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("site_id"), F.expr("cast(datediff(to_date(ts), date'1970-01-01') as bigint)").alias("for_day")).agg(F.count("*").alias("cells"))
    J.replace_grids(days, path)
    J.replace_grids(days.where("for_day % 2 = 0").withColumn("cells", F.col("cells") * 2), path)
    return spark.read.parquet(path).select(F.col("site_id").cast("long").alias("site_id"), F.col("for_day").cast("long").alias("for_day"), "cells")


def _stream(spark: SparkSession, rows: DataFrame, name: str, chunk: str | None = None) -> DataFrame:
    """Rows as a file stream; by ``chunk`` (0 to 3) they come in this order, each part in batches of its own."""
    path = scratch(spark, name)
    for part in [rows] if chunk is None else [rows.where(f"{chunk} = {i}").repartition(2) for i in range(4)]:
        part.write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4 if chunk is None else 2).parquet(path)


def _week(ts: str = "ts") -> Column:
    """Quarters of a month of 30 days."""
    return F.greatest(F.lit(0), F.least(F.lit(3), F.floor((F.col(ts) - DAY0 * P.DAY) / (7.5 * P.DAY)))).cast("int")


def _collected(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    spark = df.sparkSession
    out, check = scratch(spark, name), scratch(spark, f"{name}-state")
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
    else:
        q = df.writeStream.foreachBatch(lambda b, i: b.withColumn("_batch", F.lit(i)).write.mode("append").parquet(out)).option("checkpointLocation", check).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


@query(f"WITH {OBS_SQL} SELECT site_id, ts, round(temp_c, 6) AS temp_c FROM obs")
def stm1_upsert_stream(spark, sf_dir):
    """Every hour delivered twice, the second time right; the upserted table has the second."""
    path = scratch(spark, "hours")
    first = obs(spark, sf_dir).select("site_id", "ts", (F.col("temp_c") - 5).alias("temp_c"), F.lit(1).alias("delivery"))
    both = first.unionByName(first.select("site_id", "ts", (F.col("temp_c") + 5).alias("temp_c"), F.lit(2).alias("delivery"))).withColumn("month", F.floor(F.col("ts") / (7 * P.DAY)))
    merge = lambda df: df.groupBy("site_id", "ts", "month").agg(F.max_by("temp_c", "delivery").alias("temp_c"), F.max("delivery").alias("delivery"))

    def write(batch: DataFrame) -> None:
        J.upsert_months(batch, path, merge)

    S.upsert_stream(_stream(spark, both, "deliveries"), write, scratch(spark, "hours-state")).awaitTermination()
    return r6(spark.read.parquet(path).select("site_id", "ts", "temp_c"))


LAST_WEEK = f"({DAY0} * 86400 + 22.5 * 86400)"


@query(f"WITH {OBS_SQL} SELECT site_id, ts, round(temp_c + CASE WHEN ts >= {LAST_WEEK} - 3 * 86400 AND ts < {LAST_WEEK} - 2 * 86400 THEN 1 ELSE 0 END, 6) AS temp_c FROM obs")
def stm1_late_hours(spark, sf_dir):
    """Hours in the order of their weeks; with the last come a day of hours two days behind, which count, and days of hours that are too late."""
    path = scratch(spark, "late-hours")
    hours = obs(spark, sf_dir).select("site_id", F.col("ts").alias("epoch"), "temp_c", F.lit(1).alias("delivery")).withColumn("week", _week("epoch"))
    back = (DAY0 + 22.5) * P.DAY - F.col("epoch")
    again = lambda first, last, more: hours.where((back > last * P.DAY) & (back <= first * P.DAY)).select("site_id", "epoch", (F.col("temp_c") + more).alias("temp_c"), F.lit(2).alias("delivery"), F.lit(3).alias("week"))
    rows = hours.unionByName(again(3, 2, 1.0)).unionByName(again(18, 16, 2.0)).withColumn("ts", F.timestamp_seconds("epoch")).withColumn("month", F.floor(F.col("epoch") / (7 * P.DAY)))
    merge = lambda df: df.groupBy("site_id", "epoch", "month").agg(F.max_by("temp_c", "delivery").alias("temp_c"), F.max("delivery").alias("delivery"))

    def write(batch: DataFrame) -> None:
        J.upsert_months(batch.select("site_id", "epoch", "month", "temp_c", "delivery"), path, merge)

    S.upsert_stream(_stream(spark, rows, "late", "week"), write, scratch(spark, "late-state"), "6 days", ("site_id", "ts", "delivery")).awaitTermination()
    return r6(spark.read.parquet(path).select("site_id", F.col("epoch").alias("ts"), "temp_c"))


@query(f"WITH {OBS_SQL} SELECT site_id, (ts + 3600) // 86400 AS day, round(min(temp_c), 6) AS temp_min, round(max(temp_c), 6) AS temp_max, count(*) AS n_hours FROM obs WHERE NOT is_forecast GROUP BY 1, 2")
def stm2_daily_summary(spark, sf_dir):
    rows = obs(spark, sf_dir).withColumn("epoch", F.col("ts")).withColumn("ts", F.timestamp_seconds("ts"))
    found = _collected(S.daily_summary(_stream(spark, rows, "hours")), "days", "complete")
    last = found.groupBy("site_id", "day").agg(F.max_by(F.struct("temp_min", "temp_max", "n_hours"), "_batch").alias("r"))
    return r6(last.select("site_id", F.floor((F.unix_timestamp("day.start") + P.HOUR) / P.DAY).alias("day"), "r.*"))


@query(NQ.limit_sql(NQ.SMALL_LIMITS[:2]))
def stm3_attempt_limits(spark, sf_dir):
    """The limits by email over the attempt stream, decided at once, in the order of time."""
    rows = NQ.attempts(spark, sf_dir).withColumn("week", _week()).withColumnRenamed("ts", "epoch").withColumn("ts", F.timestamp_seconds("epoch"))
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, S.STATE_STORE)
    try:
        return _collected(S.limiter_stream(_stream(spark, rows, "attempts", "week"), NQ.SMALL_LIMITS), "limits")
    finally:
        spark.conf.set(store, before)


@query(NQ.ORACLES["win12_attempt_limits"])
def stm3_all_rules(spark, sf_dir):
    """The three rules over the attempts in several batches, which aren't in the order of time."""
    rows = NQ.attempts(spark, sf_dir).withColumn("chunk", (F.col("attempt_id") % 4).cast("int"))
    store, decisions = scratch(spark, "attempts"), scratch(spark, "decisions")
    S.limiter_upserts(_stream(spark, rows, "attempt-stream", "chunk"), store, decisions, scratch(spark, "attempt-state"), NQ.SMALL_LIMITS).awaitTermination()
    return S.standing(spark.read.parquet(decisions))


@query(f"WITH {OBS_SQL}, o AS (SELECT site_id, ts, lead(ts) OVER (PARTITION BY site_id ORDER BY ts) AS nxt FROM obs WHERE NOT is_forecast AND hod NOT BETWEEN 8 AND 16) SELECT site_id, ts AS last_epoch FROM o WHERE nxt - ts > 6 * 3600")
def stm4_silence_alarm(spark, sf_dir):
    """Hours from 8 to 16 are taken out; the weeks come one after another."""
    rows = obs(spark, sf_dir).where("hod not between 8 and 16").withColumn("week", _week()).withColumn("epoch", F.col("ts")).withColumn("ts", F.timestamp_seconds("ts"))
    return _collected(S.silence_stream(_stream(spark, rows, "observed", "week")), "alarms")
