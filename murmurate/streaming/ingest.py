"""Counters of a post stream, by event time. Checkpoints hold offsets and state; late posts beyond the watermark are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators import counters

DELAY = "10 minutes"


def _windowed(posts: DataFrame, unit: str) -> DataFrame:
    timed = posts.withColumn("time", F.timestamp_seconds("ts")).withWatermark("time", DELAY)
    return timed.withColumn("w", F.window("time", unit))


def totals(posts: DataFrame, unit: str = "1 minute") -> DataFrame:
    return _windowed(posts, unit).groupBy("w").agg(F.count("*").alias("posts")).select(F.unix_timestamp("w.start").alias("unit"), "posts")


def topic_hits(posts: DataFrame, topics: list[dict], unit: str = "1 minute") -> DataFrame:
    rows = _windowed(posts, unit).select("w", F.explode(T.matched_topics(F.col("text"), F.col("lang"), topics)).alias("subject"))
    return rows.groupBy("w", "subject").agg(F.count("*").alias("hits")).select(F.unix_timestamp("w.start").alias("unit"), "subject", "hits")


def term_hits(posts: DataFrame, unit: str = "1 minute") -> DataFrame:
    """Distinct authors of each term: duplicates go within the window, then rows are counted."""
    rows = _windowed(posts, unit).select("w", "time", "did", F.explode(T.extract_terms(F.col("text"), F.col("tags"))).alias("subject"))
    once = rows.dropDuplicates(["w", "subject", "did"])
    return once.groupBy("w", "subject").agg(F.count("*").alias("hits")).select(F.unix_timestamp("w.start").alias("unit"), "subject", "hits")


def write(df: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends closed windows as Parquet; every 5 seconds, or all there is and stop."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="5 seconds")).start()


def write_top_terms(df: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Ranks the terms of closed windows in each micro-batch; a batch that is run again overwrites its own folder."""

    def store(batch: DataFrame, number: int) -> None:
        counters.top_terms(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    w = df.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="5 seconds")).start()
