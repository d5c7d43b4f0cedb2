"""As-of queries: for each date the latest version known at a time.

Bounds are inclusive. Of equal keys the greater value wins. ``row_number() = 1`` compiles to a group
limit that runs before the exchange, so only one candidate for each date and task is shuffled.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.schema import FACT, QUERY, require_columns


def _newest(rows: DataFrame, *by: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("timestamp"), F.desc("value"))
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def _known(timestamp: int | None) -> Column:
    return F.col("timestamp") <= F.lit(int(time.time()) if timestamp is None else timestamp)


def as_of_range(
    facts: DataFrame, asset_id: int, start_date: int, end_date: int, timestamp: int | None = None, id: int = 0, limit: int | None = None
) -> DataFrame:
    """One asset's dates from ``start_date`` to ``end_date`` as known at ``timestamp`` (None: now), newest first.

    ``limit``: only so many of the newest dates.
    """
    rows = require_columns(facts, FACT).where((F.col("asset_id") == asset_id) & F.col("date").between(start_date, end_date) & _known(timestamp))
    out = _newest(rows, "asset_id", "date").select(F.lit(id).cast("long").alias("id"), "asset_id", "date", "timestamp", "value").orderBy(F.desc("date"))
    return out.limit(limit) if limit is not None else out


def as_of_batch(facts: DataFrame, queries: DataFrame, ordered: bool = True) -> DataFrame:
    """All of ``queries`` (id, asset_id, start_date, end_date, timestamp) against ``facts``. Repeated ids are an error.

    The join is on the asset with the bounds as residual; whether to broadcast is left to the
    optimizer, which knows the sizes. The queries' overall bounds go to the scan as scalar
    subqueries, since the join alone pushes none of them.
    """
    q = require_columns(queries, QUERY)
    if (twice := q.groupBy("id").count().where("count > 1").limit(3).collect()):
        raise ValueError(f"query ids must be unique: {twice}")

    def bound(f, c: str) -> Column:
        return q.agg(f(c)).scalar()

    f = require_columns(facts, FACT).where(
        F.col("asset_id").between(bound(F.min, "asset_id"), bound(F.max, "asset_id"))
        & (F.col("date") >= bound(F.min, "start_date")) & (F.col("date") <= bound(F.max, "end_date")) & (F.col("timestamp") <= bound(F.max, "timestamp"))
    )
    q = q.withColumnRenamed("timestamp", "_known").withColumnRenamed("asset_id", "_asset")
    seen = f.join(q, (F.col("asset_id") == F.col("_asset")) & F.col("date").between(F.col("start_date"), F.col("end_date")) & (F.col("timestamp") <= F.col("_known")))
    out = _newest(seen.select("id", "asset_id", "date", "timestamp", "value"), "id", "date")
    return out.orderBy("id", F.desc("date")) if ordered else out


def latest(facts: DataFrame, timestamp: int | None = None) -> DataFrame:
    """Every asset and date as known at ``timestamp`` (None: now)."""
    return _newest(require_columns(facts, FACT).where(_known(timestamp)), "asset_id", "date")


def cross_section(facts: DataFrame, date: int, timestamp: int | None = None) -> DataFrame:
    """Extension: all assets' values for one date as known at ``timestamp``."""
    return _newest(require_columns(facts, FACT).where((F.col("date") == date) & _known(timestamp)), "asset_id")


def revisions(facts: DataFrame, timestamp: int | None = None) -> DataFrame:
    """Extension: first published against latest value of each asset and date, with the count of versions."""
    rows = require_columns(facts, FACT).where(_known(timestamp))
    order = F.struct("timestamp", "value")
    return rows.groupBy("asset_id", "date").agg(
        F.min_by("value", order).alias("first_value"), F.max_by("value", order).alias("last_value"), F.count("*").alias("versions")
    )
