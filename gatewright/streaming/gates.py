"""Gates over streams: the stateless pipeline as it is, windowed indicators, resumable sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .exactly_once import run_folder

EVENTS = T.StructType(
    [T.StructField(n, t) for n, t in (("event_id", T.LongType()), ("ts", T.TimestampType()), ("user_id", T.LongType()), ("event_type", T.StringType()), ("value", T.DoubleType()), ("props", T.StringType()))]
)


def event_decision() -> Column:
    """The decision that an event stands for: purchases block, clicks are reviewed, others pass."""
    return F.when(F.col("event_type") == "purchase", "BLOCK").when(F.col("event_type") == "click", "REVIEW").otherwise("PASS")


def windowed_kpis(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Decisions by tumbling window; on a stream, windows close when the watermark passes them."""
    marked = events.withColumn("decision", event_decision())
    if events.isStreaming:
        marked = marked.withWatermark("ts", late)
    counted = marked.groupBy(F.window("ts", size).alias("w")).agg(
        F.count("*").alias("n"),
        *(F.count_if(F.col("decision") == d).alias(f"n_{d.lower()}") for d in ("BLOCK", "REVIEW", "PASS")),
    )
    return counted.select(F.col("w.start").alias("window_start"), "n", "n_block", "n_review", "n_pass")


def session_kpis(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Events by user session."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).parquet(folder)


def resumable(df: DataFrame, folder: str, resume: str = "auto") -> StreamingQuery:
    """Everything available, appended as Parquet to the run that ``resume`` names, ``auto`` or ``fresh``; a rerun goes on behind its last commit."""
    run = run_folder(df.sparkSession, folder, resume)
    return df.writeStream.format("parquet").option("path", f"{run}/rows").option("checkpointLocation", f"{run}/checkpoint").trigger(availableNow=True).start()
