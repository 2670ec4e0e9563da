"""Sources and sinks: hourly JSON replies, prediction and grid tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names in a reply, and ours.
CHANNELS = {"temperature_2m": "temperature_2m", "dew_point_2m": "dewpoint_2m", "relative_humidity_2m": "relative_humidity_2m", "pressure_msl": "pressure_msl", "wind_speed_10m": "wind_speed_10m", "wind_direction_10m": "wind_direction_10m", "wind_gusts_10m": "wind_gusts_10m", "cloud_cover": "cloud_cover", "shortwave_radiation": "shortwave_radiation", "precipitation": "precipitation"}


def hourly_rows(replies: DataFrame, body: str = "body") -> DataFrame:
    """One row an hour from columnar replies; a short or missing channel gives nulls, a time of 16 characters is UTC."""
    schema = f"hourly struct<time:array<string>,{','.join(f'{c}:array<double>' for c in CHANNELS)}>"
    parsed = replies.withColumn("_h", F.from_json(body, schema)["hourly"])
    rows = parsed.select(*(c for c in replies.columns if c != body), F.posexplode("_h.time").alias("_i", "_t"), "_h")
    ts = F.try_to_timestamp(F.when(F.length("_t") == 16, F.concat("_t", F.lit(":00+00:00"))).otherwise(F.col("_t")), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    return rows.select(*(c for c in replies.columns if c != body), ts.alias("ts"), *(F.get(F.col("_h")[c], F.col("_i")).alias(n) for c, n in CHANNELS.items()))


def append_predictions(rows: DataFrame, path: str) -> None:
    """Predictions are only ever added, by target day."""
    rows.write.mode("append").partitionBy("target_day").parquet(path)


def replace_grids(rows: DataFrame, path: str) -> None:
    """Replace the grids of the days and sites in ``rows``, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("for_day", "site_id").parquet(path)


def upsert_months(rows: DataFrame, path: str, merge) -> None:
    """Rewrite only the months that re-delivered hours touch; ``merge`` reduces old and new rows to one a key."""
    spark = rows.sparkSession
    touched = rows.select("month").distinct()
    try:
        stored = spark.read.parquet(path).join(F.broadcast(touched) if touched.limit(1000).count() < 1000 else touched, "month", "left_semi")
        rows = merge(stored.unionByName(rows, allowMissingColumns=True))
    except Exception as missing:  # noqa: BLE001  the first write has nothing to merge with
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        rows = merge(rows)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
