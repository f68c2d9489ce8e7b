"""Operation logs as streams: event-time windows, duplicates within a watermark."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log(spark: SparkSession, path: str, files_per_batch: int = 80) -> DataFrame:
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events and values by hour and type; the same on a stream (with a watermark) and on a table."""
    t = events.withColumn("at", F.col("ts").cast("timestamp"))
    t = t.withWatermark("at", late) if events.isStreaming else t
    g = t.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return g.select(F.col("w.start").alias("hour"), "event_type", "events", "value")


def once(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    t = events.withColumn("at", F.col("ts").cast("timestamp"))
    return t.withWatermark("at", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else t.dropDuplicates([key])


def drained(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """What a stream gives once all present input is read, as a memory table (for results of bounded size)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def append_log(operations: DataFrame, path: str, checkpoint: str, key: str = "operation_id", late: str = "1 day") -> None:
    """Append all present input of a stream of operations ``(operation_id, ts, ...)`` to the log at ``path``, each pending. An operation that
    comes again within ``late`` isn't appended again; what is in the log is never rewritten. A later call with the same checkpoint
    goes on after the last appended operation."""
    fresh = once(operations, key, late).withColumn("state", F.lit("pending")).drop("at")
    q = fresh.writeStream.format("parquet").option("path", path).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """``user_id, began, ended, events``: a user's events without a longer gap; the same on a stream and on a table."""
    t = events.withColumn("at", F.col("ts").cast("timestamp"))
    t = t.withWatermark("at", late) if events.isStreaming else t
    g = t.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
    return g.select("user_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "events")


def job_states(events: DataFrame) -> DataFrame:
    """``job_id, state, done, total, at``: the latest of each job's lifecycle and progress events ``(job_id, seq, state, done, total, at)``;
    numbers that an event lacks stay what they were. State is one row per job, on a stream as well (complete or update mode)."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return events.groupBy("job_id").agg(*[last(c) for c in ("state", "done", "total", "at")])


def pushed(stream: DataFrame, push, cancelled, checkpoint: str) -> int:
    """Hands the rows of each batch of a report's stream to ``push`` (a function of a DataFrame) until all present input is read or
    ``cancelled()`` is true; returns the number of batches pushed.

    A batch that meets the cancellation ends the query before it is committed, so a later call with the same checkpoint goes on with
    just that batch."""
    done, stopped = [], []

    def batch(df: DataFrame, number: int) -> None:
        if cancelled():
            stopped.append(number)
            raise RuntimeError("cancelled")
        push(df)
        done.append(number)

    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    except StreamingQueryException:
        if not stopped:
            raise
    return len(done)
