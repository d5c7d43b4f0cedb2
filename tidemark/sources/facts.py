"""Strict reader of fact CSV: asset_id,date,timestamp,value; further fields are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.convert import f32_or_null, u32_or_null


class FactError(ValueError):
    """A line is no fact."""


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    part = F.split("line", ",", -1)
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    fields = {n: u32_or_null(F.try_element_at(part, F.lit(i + 1))) for i, n in enumerate(("asset_id", "date", "timestamp"))}
    return lines.withColumns(fields | {"value": f32_or_null(F.try_element_at(part, F.lit(4)))})


def _bad():
    return F.col("asset_id").isNull() | F.col("date").isNull() | F.col("timestamp").isNull() | F.col("value").isNull()


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines that are no fact."""
    return _parsed(spark, path).where(_bad()).select("line")


def read_facts_csv(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Facts of a headerless file without quoting. Bad lines raise FactError if ``strict``, else they are left out."""
    rows = _parsed(spark, path)
    if strict and (bad := rows.where(_bad()).select("line").limit(5).collect()):
        raise FactError(f"not facts: {[r.line for r in bad]}")
    return rows.where(~_bad()).select("asset_id", "date", "timestamp", "value")
