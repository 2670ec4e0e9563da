"""Bindings of the operators' inputs to the synthetic tables, and the same as SQL text for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds since 1970 of a timestamp without zone; the same in every session time zone.
EPOCH = "datediff(to_date(ts), date'1970-01-01') * 86400L + hour(ts) * 3600L"
EPOCH_SQL = "date_diff('day', date '1970-01-01', CAST(ts AS date)) * 86400 + hour(ts) * 3600"
DAY0 = 19723  # 2024-01-01
SPLIT = 19744 * 86400  # 2024-01-22: later hours are forecasts

OBS_SQL = f"""obs AS (
  SELECT site_id, ts, hod, 15 + abs(hod - 4) * 4e-1 + avg_value / 100 AS temp_c, 1011 + avg_value / 20 AS pressure_msl,
    15 + abs(hod - 4) * 4e-1 + avg_value / 100 - 7 AS dewpoint_c, CAST(2 + n % 7 AS double) AS wind_ms,
    CAST((users * 37) % 360 AS double) AS wind_dir, CAST(greatest(0, 800 - abs(hod - 12) * 120) AS double) AS shortwave,
    ts > {SPLIT} AS is_forecast
  FROM (SELECT user_id % 5 AS site_id, {EPOCH_SQL} AS ts, hour(ts) AS hod, avg(value) AS avg_value, count(*) AS n, CAST(sum(user_id) AS bigint) AS users
        FROM events GROUP BY 1, 2, 3))"""
ANCHORS_SQL = f"anchors AS (SELECT s.site_id, ({DAY0} + d.d) * 86400 + 43200 AS at FROM (SELECT DISTINCT user_id % 5 AS site_id FROM events) s CROSS JOIN range(4, 28) d(d))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` over as many tasks as a shuffle has: a small file is one task, however much its rows make work."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly weather of five sites: site_id, ts (epoch seconds), hod, temp_c, pressure_msl, dewpoint_c, wind_ms, wind_dir, shortwave, is_forecast."""
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("site_id"), F.expr(EPOCH).alias("epoch"), F.hour("ts").alias("hod"), "value", "user_id")
    hourly = events.groupBy("site_id", F.col("epoch").alias("ts"), "hod").agg(F.avg("value").alias("avg_value"), F.count("*").alias("n"), F.sum("user_id").alias("users"))
    warm = F.expr("15 + abs(hod - 4) * 4e-1 + avg_value / 100")
    return hourly.select(
        "site_id", "ts", "hod", warm.alias("temp_c"), F.expr("1011 + avg_value / 20").alias("pressure_msl"), (warm - 7).alias("dewpoint_c"),
        F.expr("cast(2 + n % 7 as double)").alias("wind_ms"), F.expr("cast((users * 37) % 360 as double)").alias("wind_dir"),
        F.expr("cast(greatest(0, 800 - abs(hod - 12) * 120) as double)").alias("shortwave"), (F.col("ts") > SPLIT).alias("is_forecast"),
    )


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noon of 24 days for every site: site_id, at."""
    sites = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("site_id")).distinct()
    days = F.explode(F.sequence(F.lit(4), F.lit(27)))
    return sites.select("site_id", days.alias("d")).select("site_id", ((F.col("d") + DAY0) * F.lit(86400).cast("long") + 43200).alias("at"))


def r6(df: DataFrame) -> DataFrame:
    """Doubles to six places, as the oracles have them."""
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
