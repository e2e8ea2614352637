"""Streaming forms of the line filters (ST1-ST3) on Structured Streaming.

Sources are file streams over a table folder (one file per micro-batch set,
``pathGlobFilter`` picks the table). Stateful operators carry a watermark so
their state is bounded (the reference's whole-stream ``seen`` set is not).
Runs use ``trigger(availableNow=True)``. With a ``location`` on shared storage,
output and checkpoint stay there, and a run with the same location resumes after
the last committed batch; without one, each run starts anew in the session's
shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def read_table_stream(spark: SparkSession, sf_dir: str, table: str, max_files: int | None = None) -> DataFrame:
    """Stream the rows of ``{sf_dir}/{table}.parquet`` (schema from the file)."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    r = spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", f"{table}.parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(sf_dir)


def stateless_transform(events: DataFrame, event_type: str = "click") -> DataFrame:
    """ST1: filter + convert, row at a time (no state)."""
    return events.where(F.col("event_type") == event_type).select(
        "event_id", "user_id", F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        F.concat_ws(" ", F.col("user_id").cast("string"), F.lit("Q0"), F.col("event_id").cast("string")).alias("line"))


def _event_time(events: DataFrame, col: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP (with zone); NTZ columns are read as UTC."""
    if events.schema[col].dataType.typeName() == "timestamp_ntz":
        return events.withColumn(col, F.col(col).cast("timestamp"))
    return events


def dedup_within_watermark(events: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """ST2: drop repeated keys seen within the watermark delay."""
    return _event_time(events).withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def dedup_earliest(events: DataFrame, keys: list[str], gap: str = "1 hour", delay: str = "1 hour", tie: str = "event_id") -> DataFrame:
    """ST2: of every run of a key's events that follow each other within ``gap``, the
    earliest (then the least ``tie``), whatever the order of arrival. It is emitted once
    the watermark passes the end of the run, when no event can join it any more; runs
    still open stay in the state for the next call. Events later than ``delay`` are
    dropped by the watermark."""
    ev = _event_time(events)
    row = F.struct("ts", tie, *[c for c in events.columns if c not in ("ts", tie)])
    runs = ev.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), *keys).agg(F.min(row).alias("_row"))
    return runs.select("_row.*").select(*events.columns)


def windowed_counts(events: DataFrame, key: str, size: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """ST3: tumbling-window counts per key with a watermark."""
    return (_event_time(events).withWatermark("ts", delay)
            .groupBy(F.window("ts", size).alias("w"), key).agg(F.count("*").alias("count"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), key, "count"))


def _folders(spark: SparkSession, name: str, location: str | None) -> tuple[str, str]:
    base = location.rstrip("/") if location else scratch_path(spark, name)
    return f"{base}/out", f"{base}/checkpoint"


def run_append(df: DataFrame, name: str, location: str | None = None) -> DataFrame:
    """Run a stateless or append-mode stream over what is available into a
    parquet folder; return the folder as a batch frame."""
    spark = df.sparkSession
    out, ck = _folders(spark, name, location)
    q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


def run_update(df: DataFrame, keys: list[str], name: str, location: str | None = None) -> DataFrame:
    """Run an aggregating stream in update mode (state evicted behind the
    watermark); every micro-batch's updated rows are appended with their
    batch id and the final value per key is the latest update."""
    spark = df.sparkSession
    out, ck = _folders(spark, name, location)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(out)

    q = (df.writeStream.foreachBatch(sink).option("checkpointLocation", ck)
         .outputMode("update").trigger(availableNow=True).start())
    q.awaitTermination()
    from ..operators.rank import top_k
    rows = spark.read.parquet(out)
    return top_k(rows, keys, [F.col("_batch").desc()], 1, "_n").drop("_n", "_batch")
