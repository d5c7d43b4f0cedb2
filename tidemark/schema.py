"""Row types shared by all modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

U32_MAX = 4_294_967_295


def _longs(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType(), False) for n in names]


FACT = T.StructType([*_longs("asset_id", "date", "timestamp"), T.StructField("value", T.FloatType(), False)])
QUERY = T.StructType(_longs("id", "asset_id", "start_date", "end_date", "timestamp"))
RESULT = T.StructType([*_longs("id", "asset_id", "date", "timestamp"), T.StructField("value", T.FloatType(), False)])
KV = T.StructType(_longs("k", "v"))

KEY = ["asset_id", "date", "timestamp"]


def require_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` narrowed to the columns of ``schema``, each cast to its type; ValueError if one is missing."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df.select(*(df[f.name].cast(f.dataType).alias(f.name) for f in schema))
