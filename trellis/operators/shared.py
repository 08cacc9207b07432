"""Tables written to the cluster's shared folder: they cut long plans and survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset (tests, one machine)."""
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="trellis-tables-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        base = f"file://{_own[app]}"
    return f"{base}/trellis-{app}"


def written(df: DataFrame, name: str, held: list | None = None) -> DataFrame:
    """df written once and read back; noted in held for whoever lets go of it."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._trellis_path = path
    if held is not None:
        held.append(out)
    return out


def release(held: list[DataFrame]) -> None:
    """Let go of kept tables: memory of persisted ones, files of written ones."""
    for df in held:
        df.unpersist()
        if path := getattr(df, "_trellis_path", None):
            p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    held.clear()
