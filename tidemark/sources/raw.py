"""Raw delimited files: ISO dates and timestamps become integers, then rows are sorted by type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.convert import date_or_null, epoch_or_null


class ConversionError(ValueError):
    """Some raw values don't convert."""


def read_raw_csv(spark: SparkSession, path: str, width: int) -> DataFrame:
    """A headerless CSV file as text columns c0 .. c{width-1}."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    return spark.read.schema(schema).option("header", False).option("escape", '"').csv(path)


def write_raw_csv(df: DataFrame, path: str) -> None:
    """Headerless CSV."""
    df.write.mode("overwrite").option("header", False).option("escape", '"').csv(path)


def _converted(df: DataFrame, date_cols: list[int], ts_cols: list[int]) -> dict[str, Column]:
    if not date_cols and not ts_cols:
        raise ValueError("name at least one date or timestamp column")
    if bad := [i for i in [*date_cols, *ts_cols] if not 0 <= i < len(df.columns)]:
        raise ValueError(f"no columns {bad} in {df.columns}")
    by = {df.columns[i]: date_or_null for i in date_cols} | {df.columns[i]: epoch_or_null for i in ts_cols}
    return {c: f(F.col(c)) for c, f in by.items()}


def rejected(df: DataFrame, date_cols: list[int] = (), ts_cols: list[int] = ()) -> DataFrame:
    """The rows of ``df`` with a value that doesn't convert, and ``bad_columns``: their 1-based positions."""
    to = _converted(df, list(date_cols), list(ts_cols))
    bad = F.array_compact(F.array(*(F.when(x.isNull(), df.columns.index(c) + 1) for c, x in to.items())))
    return df.withColumn("bad_columns", F.array_sort(bad)).where(F.size("bad_columns") > 0)


def normalize_raw(
    df: DataFrame, date_cols: list[int] = (), ts_cols: list[int] = (), mapping: dict[str, str] | None = None, strict: bool = True
) -> DataFrame:
    """``df`` with the columns at these 0-based positions converted to integers.

    ``mapping`` renames and selects: {new name: old name}. With ``strict`` a bad value raises
    ConversionError that counts the rows and shows the first few; otherwise it is NULL.
    """
    to = _converted(df, list(date_cols), list(ts_cols))
    if strict:
        bad = rejected(df, date_cols, ts_cols)
        if first := bad.limit(5).collect():
            raise ConversionError(f"{bad.count()} rows don't convert, such as {[r.asDict() for r in first]}")
    out = df.withColumns(to)
    return out.select(*(F.col(old).alias(new) for new, old in mapping.items())) if mapping else out


def normalize_and_sort(df: DataFrame, date_cols: list[int], ts_cols: list[int], sort_cols: int = 4) -> DataFrame:
    """``normalize_raw``, sorted by the first ``sort_cols`` columns, each by its own type."""
    out = normalize_raw(df, date_cols, ts_cols)
    return out.orderBy(*out.columns[:sort_cols])
