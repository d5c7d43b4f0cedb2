"""Driver tables as facts. A duplicate key is kept; the as-of tie-break decides."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(date: int) -> dt.datetime | None:
    try:
        return dt.datetime.strptime(f"{date:08d}", "%Y%m%d")
    except ValueError:
        return None


def events_as_facts(spark: SparkSession, sf_dir: str, start_date: int | None = None, end_date: int | None = None) -> DataFrame:
    """``start_date`` and ``end_date``, if they are days, bound the time of the event, so that they reach the scan."""
    rows = table(spark, sf_dir, "events")
    if start_date is not None and (day := _day(start_date)):
        rows = rows.where(F.col("ts") >= F.lit(day).cast("timestamp_ntz").cast(rows.schema["ts"].dataType))
    if end_date is not None and (day := _day(end_date)):
        rows = rows.where(F.col("ts") < F.lit(day + dt.timedelta(1)).cast("timestamp_ntz").cast(rows.schema["ts"].dataType))
    return rows.select(
        F.col("user_id").cast("long").alias("asset_id"),
        F.date_format("ts", "yyyyMMdd").cast("long").alias("date"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.col("value").cast("float").alias("value"),
    )


def lineitem_as_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("long").alias("asset_id"),
        (F.date_format("l_shipdate", "yyyyMM").cast("long") * 100 + 1).alias("date"),
        F.col("l_orderkey").cast("long").alias("timestamp"),
        F.col("l_extendedprice").cast("float").alias("value"),
    )


def orders_as_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("long").alias("asset_id"),
        F.date_format("o_orderdate", "yyyyMMdd").cast("long").alias("date"),
        F.col("o_orderkey").cast("long").alias("timestamp"),
        F.col("o_totalprice").cast("float").alias("value"),
    )
