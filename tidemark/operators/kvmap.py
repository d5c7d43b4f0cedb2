"""A keyed map (k, v with k unique) as DataFrames: each change makes a new version.

Batches carry ``seq``, the order in which their rows apply.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.schema import KV, U32_MAX, require_columns


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], KV)


def in_range(df: DataFrame) -> DataFrame:
    """``df``, failing when a key or value is no unsigned 32-bit number."""
    ok = F.col("k").between(0, U32_MAX) & F.col("v").between(0, U32_MAX)
    return df.where(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.lit("key or value out of range")).cast("boolean")))


def lookup(base: DataFrame, keys: DataFrame) -> DataFrame:
    """(k, v) for each row of ``keys``; v is NULL where the key is absent."""
    return keys.select("k").join(require_columns(base, KV), "k", "left")


def lookup_one(base: DataFrame, key: int) -> DataFrame:
    return require_columns(base, KV).where(F.col("k") == key).select("v")


def lookup_range(base: DataFrame, start: int, end: int) -> DataFrame:
    """Values of keys from ``start`` to ``end``, both included, by key."""
    return require_columns(base, KV).where(F.col("k").between(start, end)).orderBy("k").select("v")


def _first(new: DataFrame, last: bool = False) -> DataFrame:
    w = Window.partitionBy("k").orderBy(F.desc("seq") if last else F.asc("seq"))
    return new.select("seq", "k", "v").withColumn("_n", F.row_number().over(w)).where("_n = 1").select("k", "v")


def insert(base: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Insert absent keys. Returns the new map, and (seq, k, inserted) for each row of ``new``."""
    base = require_columns(base, KV)
    state = base.unionByName(_first(new).join(base, "k", "left_anti"))
    w = Window.partitionBy("k").orderBy("seq")
    had = base.select("k", F.lit(True).alias("_had"))
    ops = new.select("seq", "k").withColumn("_n", F.row_number().over(w)).join(had, "k", "left")
    return state, ops.select("seq", "k", (F.col("_had").isNull() & (F.col("_n") == 1)).alias("inserted"))


def update(base: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Change present keys, the last row of a key wins. Returns the new map, and (seq, k, old); old is NULL if absent."""
    base = require_columns(base, KV)
    change = _first(new, last=True).withColumnRenamed("v", "_new")
    state = base.join(change, "k", "left").select("k", F.coalesce("_new", "v").alias("v"))
    w = Window.partitionBy("k").orderBy("seq")
    ops = new.select("seq", "k", F.lag("v").over(w).alias("_before")).join(base, "k", "left")
    return state, ops.select("seq", "k", F.when(F.col("v").isNotNull(), F.coalesce("_before", "v")).alias("old"))


def delete(base: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove keys. Returns the new map, and (seq, k, old); of a repeated key only the first finds a value."""
    base = require_columns(base, KV)
    w = Window.partitionBy("k").orderBy("seq")
    ops = keys.select("seq", "k").withColumn("_n", F.row_number().over(w)).join(base, "k", "left")
    return base.join(keys.select("k").distinct(), "k", "left_anti"), ops.select("seq", "k", F.when(F.col("_n") == 1, F.col("v")).alias("old"))


def apply_log(base: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replay a mixed log (seq, op, k, v) of insert, update, delete and lookup.

    Returns the new map, and (seq, old): the value that the operation found, NULL if none. Windows over one
    shuffle by key: the map's rows are inserts before all others; deletes part a key's operations into
    stretches; in a stretch the first insert puts a value, and from then on the last update holds.
    """
    seq = F.col("seq").cast("long").alias("seq")
    first = F.lit(-(1 << 63)).alias("seq")
    held = require_columns(base, KV).select(first, F.lit("insert").alias("op"), "k", F.col("v").cast("long").alias("v"), F.lit(True).alias("_base"))
    rows = held.unionByName(log.select(seq, "op", F.col("k").cast("long").alias("k"), F.col("v").cast("long").alias("v"), F.lit(False).alias("_base")))
    by_key = Window.partitionBy("k").orderBy("seq")
    before = by_key.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_part", F.coalesce(F.sum(F.when(F.col("op") == "delete", 1)).over(before), F.lit(0)))
    in_part = Window.partitionBy("k", "_part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_put", F.first(F.when(F.col("op") == "insert", F.col("v")), ignorenulls=True).over(in_part))
    changed = F.when((F.col("op") == "update") & F.col("_put").isNotNull(), F.col("v"))
    rows = rows.withColumn("_changed", F.last(changed, ignorenulls=True).over(in_part)).withColumn("old", F.coalesce("_changed", "_put"))
    after = (
        F.when(F.col("op") == "insert", F.coalesce("old", "v"))
        .when(F.col("op") == "update", F.when(F.col("old").isNotNull(), F.col("v")))
        .when(F.col("op") == "delete", F.lit(None).cast("long"))
        .otherwise(F.col("old"))
    )
    ends = rows.withColumn("_next", F.lead("seq").over(by_key)).where("_next is null").select("k", after.alias("v"))
    return ends.where("v is not null"), rows.where("not _base").select("seq", "old")
