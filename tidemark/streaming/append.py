"""Extension: new versions arrive as a stream and are appended to a store.

A late correction is only a later timestamp, so appending needs no state and no watermark:
as-of queries see a version once its file is committed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.schema import FACT, KEY, require_columns


def stream_facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts in the Parquet files that appear under ``path``."""
    return spark.readStream.schema(FACT).parquet(path)


def append_stream(facts: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Append ``facts`` to ``store``, all that is there now; each batch's files are sorted by key."""

    def put(batch: DataFrame, n: int) -> None:
        require_columns(batch, FACT).sortWithinPartitions(*KEY).write.mode("overwrite").parquet(f"{store}/batch={n}")

    return facts.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
