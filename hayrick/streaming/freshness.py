"""Change events as a stream: sessions that one refresh covers."""

from __future__ import annotations

import uuid
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hayrick.sources.scratch import shared_folder

CHANGES = "repo bigint, path string, ts timestamp, deleted boolean, outcome string"


def session_submissions(changes: DataFrame, gap_seconds: int = 6 * 3600, late: str = "0 seconds") -> DataFrame:
    """One row for each run of changes of a repository without a gap: works on batches and on streams.

    A refresh of a run that deletes anything covers the whole repository, others their
    paths. As in maintenance.sessions, a change exactly a gap after the last one begins a
    new run; session windows would join those, so theirs is a microsecond shorter.
    """
    events = changes.withWatermark("ts", late) if changes.isStreaming else changes
    runs = events.groupBy("repo", F.session_window("ts", f"{gap_seconds * 1_000_000 - 1} microseconds").alias("w"))
    found = runs.agg(F.count(F.lit(1)).alias("n"), F.bool_or("deleted").alias("full"), F.max("ts").alias("last"))
    return found.select("repo", F.col("w.start").alias("start"), F.col("last").alias("end"), "n", "full")


def stream_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Sessions of an events table read as a stream, all that is there, then closed by a sink in the shared folder."""
    schema = spark.read.parquet(path).schema
    base = f"{shared_folder(spark)}/hayrick/stream-{uuid.uuid4().hex}"
    # A stream reads folders: one that is a single file is found in the folder above by its name.
    parent, _, name = path.rpartition("/")
    single = spark.read.format("binaryFile").load(path).select("path").first()
    single = single is not None and single["path"].rstrip("/").endswith(f"/{name}")
    reader = spark.readStream.schema(schema)
    events = reader.option("pathGlobFilter", name).parquet(parent) if single else reader.parquet(path)
    changes = events.select(F.col("user_id").alias("repo"), F.col("event_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("ts"), F.lit(False).alias("deleted"), F.lit(None).cast("string").alias("outcome"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = session_submissions(changes).writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    done = spark.read.parquet(f"{base}/out")
    last = done.agg(F.max("batch")).first()[0]
    return done.where(F.col("batch") == last).drop("batch")


def unpublished(changes: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Changes but those of paths that a successful refresh left out and that haven't changed since."""
    return changes.join(suppressed, ["repo", "path", "mtime_ns", "size"], "left_anti")
