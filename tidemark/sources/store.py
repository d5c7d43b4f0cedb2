"""A store is a Parquet dataset of facts, range-partitioned and sorted by key.

Sorted files give tight row-group statistics, so that a query for one asset and a date range
skips most row groups through pushed filters. The bucketed form also spares the shuffle of the
as-of window, which is keyed by asset.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.schema import FACT, KEY, U32_MAX, require_columns


class DuplicateKey(ValueError):
    """Two facts have the same asset, date and timestamp."""


def _wrong() -> Column:
    wrong = F.col("value").isNull()
    for c in KEY:
        wrong = wrong | F.col(c).isNull() | ~F.col(c).between(0, U32_MAX)
    return wrong


def checked(df: DataFrame, on_duplicate: str = "error") -> DataFrame:
    """Facts of ``df``; raises on keys out of range or missing, and on equal keys if ``on_duplicate`` is 'error'."""
    _known_choice(on_duplicate)
    facts = require_columns(df, FACT)
    if bad := facts.where(_wrong()).limit(3).collect():
        raise ValueError(f"not facts: {bad}")
    if on_duplicate == "error" and (twice := facts.groupBy(*KEY).count().where("count > 1").limit(3).collect()):
        raise DuplicateKey(f"equal keys: {twice}")
    return facts


def _known_choice(on_duplicate: str) -> None:
    if on_duplicate not in ("error", "keep"):
        raise ValueError("on_duplicate is 'error' or 'keep'")


_NO_FACT, _TWICE = "not facts: ", "equal keys: "


def _checking(facts: DataFrame, on_duplicate: str) -> DataFrame:
    """``facts``, range-partitioned by asset and date, sorted; rows that ``checked`` would refuse fail the job that reads them.

    Equal keys are neighbours here, so finding them takes neither a pass nor a shuffle of its own.
    """
    row = F.to_json(F.struct(*FACT.names))
    fail = F.when(_wrong(), F.raise_error(F.concat(F.lit(_NO_FACT), row)))
    if on_duplicate == "error":
        before = F.lag("timestamp").over(Window.partitionBy("asset_id", "date").orderBy("timestamp"))
        fail = fail.when(before == F.col("timestamp"), F.raise_error(F.concat(F.lit(_TWICE), row)))
    return facts.withColumn("_fine", fail.otherwise(True)).where("_fine").drop("_fine")


def write_store(df: DataFrame, path: str, files: int | None = None, on_duplicate: str = "error", rows_per_file: int = 0) -> None:
    """Write facts in any order to ``path``, sorted, checked as they are written. ``files``: range partitions; else as the session has it.

    Where something is at ``path``, the facts are written beside it and take its place when all are well, so
    that a load that fails leaves it as it was.
    """
    _known_choice(on_duplicate)
    facts = require_columns(df, FACT)
    ranged = facts.repartitionByRange(files, "asset_id", "date") if files else facts.repartitionByRange("asset_id", "date")
    out = _checking(ranged.sortWithinPartitions(*KEY), on_duplicate).write
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf())
    target = f"{path.rstrip('/')}-{uuid.uuid4().hex}" if fs.exists(at) else path
    new = at if target == path else df.sparkSession._jvm.org.apache.hadoop.fs.Path(target)
    try:
        (out.option("maxRecordsPerFile", rows_per_file) if rows_per_file else out).parquet(target)
    except Exception as e:
        fs.delete(new, True)
        said = str(e)
        if _TWICE in said:
            raise DuplicateKey(_TWICE + said.split(_TWICE, 1)[1].split("}", 1)[0] + "}") from e
        if _NO_FACT in said:
            raise ValueError(_NO_FACT + said.split(_NO_FACT, 1)[1].split("}", 1)[0] + "}") from e
        raise
    if new is not at:
        fs.delete(at, True)
        if not fs.rename(new, at):
            raise OSError(f"the store is at {target} and can't be moved to {path}")


def write_bucketed(df: DataFrame, table: str, buckets: int, path: str | None = None, on_duplicate: str = "error") -> None:
    """Write facts to a table bucketed by asset and sorted by key."""
    out = checked(df, on_duplicate).repartition(buckets, "asset_id").write.mode("overwrite").bucketBy(buckets, "asset_id").sortBy(*KEY)
    (out.option("path", path) if path else out).saveAsTable(table)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """The facts at ``path``; the schema is fixed, so no file is opened for it."""
    return spark.read.schema(FACT).parquet(path)


def dump(facts: DataFrame) -> DataFrame:
    """All facts in key order."""
    return require_columns(facts, FACT).orderBy(*KEY, F.asc("value"))
