"""Ingestion in micro-batches: an extension over the polled work queue, as Structured Streaming.

New files of queue rows are taken once each; every batch keeps the latest row of a key and writes a new version of the
state table, so a batch that runs again after a failure writes the same version.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.ingest import latest, upserted


def current(spark: SparkSession, state: str, schema: StructType, before: int | None = None) -> DataFrame:
    """The newest version of the state table, or the newest before a batch; empty where there is none."""
    try:
        every = spark.read.schema(StructType([*schema.fields, StructField("version", LongType())])).parquet(state)
        newest = every.filter(F.col("version") < before) if before is not None else every
        found = newest.agg(F.max("version")).first()[0]
    except AnalysisException as e:  # the folder isn't there before the first batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = None
    return every.filter(F.col("version") == found).drop("version") if found is not None else spark.createDataFrame([], schema)


def run_available(spark: SparkSession, source: str, schema: StructType, state: str, checkpoint: str, key: list[str], order: list[str]) -> None:
    """Take all files of `source` (Parquet) not taken yet, in batches, and stop.

    Of rows with equal keys the one last in `order` stays.
    """
    by = [F.desc(c) for c in order]

    def batch(rows: DataFrame, number: int) -> None:
        fresh = latest(rows, key, by)
        upserted(current(rows.sparkSession, state, schema, number), fresh, key, by).write.mode("overwrite").parquet(f"{state}/version={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "8").parquet(source)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_outcomes(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Outcomes by window of time and type of a stream (or table) of events, closed once `late` has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
