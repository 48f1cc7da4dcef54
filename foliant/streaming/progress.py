"""Live progress on Structured Streaming: newest state, warnings said once, running tallies."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder


def latest_progress(events: DataFrame) -> DataFrame:
    """job, event_id, stage, overall: the newest event of each job; overall = (index + done) / count, at most 1.

    ``events``: job, ts, event_id, stage, index, count, done. The state is one row for each job.
    """
    newest = events.groupBy("job").agg(F.max_by(F.struct("event_id", "stage", "index", "count", "done"), F.struct("ts", "event_id")).alias("e"))
    return newest.select("job", "e.event_id", "e.stage", F.round(F.least((F.col("e.index") + F.col("e.done")) / F.col("e.count"), F.lit(1.0)), 6).alias("overall"))


def distinct_warnings(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Each (item, detail) once; the watermark bounds how long a repeat is remembered."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["item", "detail"])


def running_tally(events: DataFrame) -> DataFrame:
    """batch, succeeded, failed, first_error: counts so far and the first error by input order."""
    ok = F.col("error").isNull()
    return events.groupBy("batch").agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.min_by("error", F.when(~ok, F.col("ord"))).alias("first_error"))


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The events table as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def run_to_end(stream: DataFrame, mode: str, key: list[str] | None = None) -> DataFrame:
    """Run a streaming query over all that is there, and return its result as a table.

    The result is written by each batch to the session's shared folder; for update and complete mode
    the last batch that holds a key counts.
    """
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/foliant/stream-{uuid4().hex}"

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/_b={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    rows = spark.read.option("basePath", f"{path}/out").parquet(f"{path}/out").drop("_b")
    if key is None:
        return rows.drop("_batch")
    newest = rows.groupBy(*key).agg(F.max("_batch").alias("_batch"))
    return rows.join(newest, [*key, "_batch"], "left_semi").drop("_batch")
