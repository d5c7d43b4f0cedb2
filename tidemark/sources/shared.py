"""Tables written between steps, in the folder that all executors share.

The cluster names the folder in ``spark.checkpoint.dir``. Where that is unset a local master gets a
folder of this process, removed at exit, and any other an error. Parquet written there cuts lineage, so a lost
executor costs a reread and not the steps before.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, without a slash at its end."""
    if named := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tidemark-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df``, written to the shared folder and read back."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of steps whose results are written.

    It follows the JVM's collector, which needs Python to have released its handles, and that happens in a thread of its own.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(1)
        spark._jvm.System.gc()
