"""Shared helpers: table access, scratch tables in the cluster's shared folder, connected components."""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()
_own_dir: dict[str, str] = {}


class _Open(threading.local):
    def __init__(self):
        self.scopes: list[Scratch] = []


class Scratch:
    """The tables written while one scope is open; those it doesn't keep are deleted when it ends."""

    def __init__(self):
        self.tables: list[DataFrame] = []
        self.kept: list[DataFrame] = []

    def keep(self, *tables: DataFrame) -> None:
        """These tables are still read when the scope has ended; the scope around it, if any, has them then."""
        self.kept += tables


_open = _Open()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named parquet table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers when it is not on their path already."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    known = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if any(Path(p).resolve() == ROOT for p in known) or (sc.master.startswith("local[") and Path.cwd().resolve() == ROOT):
        return
    out = Path(tempfile.mkdtemp(prefix="trellis-")) / "trellis.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted((ROOT / "trellis").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(out))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only where that is unset (tests, one machine)."""
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if app not in _own_dir:
            _own_dir[app] = tempfile.mkdtemp(prefix="trellis-scratch-")
            atexit.register(_remove_local, _own_dir[app])
        base = f"file://{_own_dir[app]}"
    return f"{base}/trellis-{app}"


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._trellis_path = path
    if _open.scopes:
        _open.scopes[-1].tables.append(out)
    return out


#: Rows of a materialized table of a few numbers a row up to which it is broadcast (some 20 MB).
FEW = 500_000


def few(df: DataFrame, rows: int = FEW) -> DataFrame:
    """A materialized table of narrow rows, marked for broadcast if it has no more than so many rows; else it is joined through a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


@contextmanager
def scratch() -> Iterator[Scratch]:
    """A scope that owns the tables materialized inside it. Tables of other calls are never touched."""
    own = Scratch()
    _open.scopes.append(own)
    try:
        yield own
    finally:
        _open.scopes.pop()
        for t in own.tables:
            if not any(t is k for k in own.kept):
                discard(t)
            elif _open.scopes:
                _open.scopes[-1].tables.append(t)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make returns, materialized; the tables that make itself has left behind are deleted."""
    with scratch() as own:
        out = materialize(make(), name)
        own.keep(out)
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a materialized table that nothing reads any more."""
    path = getattr(df, "_trellis_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b) over longs: (node, root), root the smallest node reachable.

    Alternates the large-star and small-star steps until every edge leads to a root; each step is a
    minimum per node and a join on the node, so a hub is a skewed join key (which AQE splits), never one
    collected group. Nodes without an edge to another node do not appear. Empty edges give no rows.
    """

    def directed(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def stars(df: DataFrame) -> bool:
        """Whether every node has one edge at most as the larger one, and no root has any."""
        ends = df.select("a", F.lit(1).alias("up")).unionByName(df.select(F.col("b").alias("a"), F.lit(0).alias("up")))
        return not ends.groupBy("a").agg(F.sum("up").alias("n"), F.min("up").alias("root")).where("n > 1 OR (n > 0 AND root = 0)").limit(1).count()

    current = materialize(directed(edges), "edges")
    while not stars(current):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        after = materialize(directed(small), "edges")
        discard(current)
        current = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
