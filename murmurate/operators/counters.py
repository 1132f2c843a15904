"""Counters of a post stream and the series made of them. Times are BIGINT seconds."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T

EPOCH = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {0})"


def with_unit(rows: DataFrame, unit: int, ts: str = "ts") -> DataFrame:
    return rows.withColumn("unit", F.col(ts) - F.col(ts) % unit)


def totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("unit").agg(F.count("*").alias("posts"))


def topic_hits(rows: DataFrame, subject: str = "subject") -> DataFrame:
    return rows.groupBy("unit", F.col(subject).alias("subject")).agg(F.count("*").alias("hits"))


def term_hits(rows: DataFrame, subject: str = "subject", author: str = "did") -> DataFrame:
    """Distinct authors; posts without an author count each."""
    named = F.when(F.col(author) != "", F.col(author))
    return rows.groupBy("unit", F.col(subject).alias("subject")).agg((F.countDistinct(named) + F.count_if(named.isNull())).alias("hits"))


def top_terms(hits: DataFrame, limit: int = config.TOP_PER_MINUTE, least: int = config.MIN_HITS_PER_MINUTE) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("unit").orderBy(F.desc("hits"), "subject"))
    return hits.withColumn("rank", rank).where((F.col("rank") <= limit) & (F.col("hits") >= least)).drop("rank")


#: Terms of a unit that a task keeps before it hands on what it has counted.
_KEPT = 2_000_000


def top_terms_of(posts: DataFrame, limit: int = config.TOP_PER_MINUTE, least: int = config.MIN_HITS_PER_MINUTE, kept: int = _KEPT) -> DataFrame:
    """top_terms of the term_hits of posts (unit, did, text): a unit's posts meet in a task and are counted there, so terms that
    few authors have leave no row. A unit of more than kept terms is handed on in parts, each of whole authors, and summed."""
    rows = posts.select("unit", F.when(F.col("did") != "", F.col("did")).alias("did"), "text").repartition("unit").sortWithinPartitions("unit", "did")
    rows = rows.select("unit", "did", F.array_join(T.words(F.col("text")), " ").alias("words"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, own, now, whole = Counter(), set(), None, True

        def part(done: bool) -> pa.RecordBatch:
            rows = found.items()
            if done and whole:
                rows = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[1], r[0]))[:limit]
            subjects, hits = zip(*rows) if rows else ((), ())
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(hits), pa.int64()), pa.array(subjects, pa.string()), pa.array(hits, pa.int64())], ["unit", "subject", "hits"])

        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                for unit, did, words in zip(*(c.to_pylist() for c in batch.slice(i, 500).columns)):
                    if now != (unit, did):
                        found.update(own)
                        own.clear()
                        if now is not None and now[0] != unit:
                            yield part(True)
                            whole = True
                        now = unit, did
                    if did is None:
                        found.update(T.terms_of((words or "").split()).keys())
                    else:
                        own.update(T.terms_of((words or "").split()))
                    if len(found) > kept:
                        yield part(False)
                        whole = False
        if now is not None:
            found.update(own)
            yield part(True)

    return top_terms(rows.mapInArrow(count, "unit bigint, subject string, hits bigint").groupBy("unit", "subject").agg(F.sum("hits").alias("hits")), limit, least)


def frame(totals_: DataFrame, units: int, unit: int) -> DataFrame:
    bucket = units * unit
    out = totals_.groupBy((F.col("unit") - F.col("unit") % bucket).alias("start")).agg(F.sum("posts").alias("total"), (F.count("*") / F.lit(units)).alias("coverage"))
    return out.where("total > 0")


def bucket_hits(hits: DataFrame, units: int, unit: int) -> DataFrame:
    bucket = units * unit
    return hits.groupBy("subject", (F.col("unit") - F.col("unit") % bucket).alias("start")).agg(F.sum("hits").alias("hits"))


def candidates(hits: DataFrame, min_hits: int, limit: int = config.CANDIDATE_LIMIT) -> DataFrame:
    sums = hits.groupBy("subject").agg(F.sum("hits").alias("hits")).where(F.col("hits") >= min_hits * config.CANDIDATE_MULTIPLE)
    return sums.orderBy(F.desc("hits"), "subject").limit(limit)


def dense(hits: DataFrame, frame_: DataFrame, units: int, unit: int, subjects: DataFrame | None = None) -> DataFrame:
    """Every subject in every observed bucket. Subjects are a bounded candidate list and the frame has one row a bucket."""
    own = (hits.select("subject").distinct() if subjects is None else subjects.select("subject"))
    full = own.crossJoin(frame_)
    out = full.join(bucket_hits(hits, units, unit), ["subject", "start"], "left")
    h = F.coalesce("hits", F.lit(0))
    return out.select("subject", "start", h.alias("hits"), "total", "coverage", F.when(F.col("total") > 0, h / F.col("total")).otherwise(0.0).alias("share"))


def tail(series: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("start")))
    return series.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")


def systematic_sample(rows: DataFrame, key: list[str], every: int = config.SAMPLE_EVERY) -> DataFrame:
    """Every so-manieth row by a hash of its key: batch and stream agree, and no global order is needed."""
    return rows.where(F.pmod(F.xxhash64(*key), F.lit(every)) == 0)


def readiness(totals_: DataFrame) -> DataFrame:
    """Of each horizon: units seen, whether that is enough, and how many are missing."""
    seen = totals_.agg(F.count("*").alias("minutes"))
    known = totals_.sparkSession.createDataFrame([(h.name, h.warmup) for h in config.HORIZONS.values()], "mode string, warmup bigint")
    return known.crossJoin(seen).select("mode", "warmup", "minutes", (F.col("minutes") >= F.col("warmup")).alias("ready"), F.greatest(F.lit(0), F.col("warmup") - F.col("minutes")).cast("bigint").alias("minutes_remaining"))


def summary(totals_: DataFrame) -> DataFrame:
    return totals_.agg(F.min("unit").alias("first_unit"), F.max("unit").alias("last_unit"), F.sum("posts").alias("posts"), F.count("*").alias("units"))
