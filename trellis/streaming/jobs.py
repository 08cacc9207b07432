"""Jobs: their table, the transitions allowed, and a runner over a drop folder.

The reference system polls jobs and has no streams; the drop-folder runner is an extension on Structured Streaming that
gives each new file the same treatment as a submitted job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.operators.selection import page
from trellis.plans import solve
from trellis.sources import geojson

STATES = ("UPLOADED", "RUNNING", "DONE", "FAILED", "CANCELLED")
NEXT = {"UPLOADED": ("RUNNING", "CANCELLED", "FAILED"), "RUNNING": ("DONE", "FAILED", "CANCELLED")}
JOB = "id string, status string, mode string, path string, size bigint, error string, created timestamp, started timestamp, finished timestamp"


def apply(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """jobs after events(id, status, at, error): each job takes its events in order, as far as they are allowed.

    A finished job keeps its state (a late failure doesn't undo a cancellation).
    """
    own = events.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "status", "error"))).alias("_e"))  # a job has a handful of events
    state = F.struct(F.col("status").alias("status"), F.col("error").alias("error"), F.col("started").alias("started"), F.col("finished").alias("finished"))

    def step(s, e):
        allowed = F.lit(False)
        for a, b in NEXT.items():
            allowed = allowed | ((s["status"] == a) & e["status"].isin(*b))
        final = ~e["status"].isin("RUNNING", "UPLOADED")
        moved = F.struct(e["status"].alias("status"), e["error"].alias("error"), F.when(e["status"] == "RUNNING", e["at"]).otherwise(s["started"]).alias("started"), F.when(final, e["at"]).otherwise(s["finished"]).alias("finished"))
        return F.when(allowed, moved).otherwise(s)

    joined = jobs.join(own, "id", "left").withColumn("_s", F.aggregate(F.coalesce("_e", F.array().cast("array<struct<at:timestamp,status:string,error:string>>")), state, step))
    return joined.select(*[F.col(f"_s.{c}").alias(c) if c in ("status", "error", "started", "finished") else F.col(c) for c in jobs.columns])


def recovered(jobs: DataFrame) -> DataFrame:
    """After a restart: what was running has failed, what waits still waits."""
    running = F.col("status") == "RUNNING"
    return jobs.withColumns({"error": F.when(running, "interrupted").otherwise(F.col("error")), "status": F.when(running, "FAILED").otherwise(F.col("status"))})


def listed(jobs: DataFrame, statuses: list[str] | None = None, number: int = 0, size: int = 20) -> DataFrame:
    """A page of jobs, newest first."""
    return page(jobs.where(F.col("status").isin(*statuses)) if statuses else jobs, [F.desc("created"), F.desc("id")], number, size)


def estimate(points: int, base: float = 5.0, each: float = 1.0) -> int:
    """Seconds that a job of so many points may take."""
    return max(1, round(base + each * points))


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, mode: str = "PLAN_2D", strategies: tuple[str, ...] = solve.STRATEGIES):
    """Start a stream that solves each GeoJSON file put into the folder; networks and summaries are appended under ``out`` as parquet.

    Each micro-batch is written under its own number, so one that runs again after a failure replaces itself.
    """
    files = spark.readStream.format("text").option("wholetext", "true").schema("value string").load(folder).select(F.col("_metadata.file_path").alias("district"), F.col("value").alias("text"))

    def run(batch: DataFrame, number: int) -> None:
        features = geojson.scan_text(batch)
        net = solve.network(features, mode, strategies)
        target = f"{out}/network/batch={number}"
        net.write.mode("overwrite").parquet(target)
        done = batch.sparkSession.read.schema(net.schema).parquet(target)
        solve.select(solve.summaries(done)).write.mode("overwrite").parquet(f"{out}/variants/batch={number}")

    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
