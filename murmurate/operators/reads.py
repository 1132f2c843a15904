"""What a reader asks for: the state of the corpus, horizons, topics, series, posts. Each is a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from . import counters


def post_url(did: Column, rkey: Column, pattern: str = "https://bsky.app/profile/%s/post/%s") -> Column:
    return F.format_string(pattern, did, rkey)


def stats(totals: DataFrame, now: int, heartbeat: int | None = None, **counted: DataFrame) -> DataFrame:
    """One row: what was collected, whether collection goes on, readiness, and the rows of each table given by name."""
    out = counters.summary(totals).select(F.col("units").alias("minutes_collected"), F.bround(F.col("units") / 60, 2).alias("hours_collected"), F.coalesce("posts", F.lit(0)).alias("posts_scanned"), F.col("first_unit").alias("first_minute"), F.col("last_unit").alias("last_minute"))
    needed = min(h.warmup for h in config.HORIZONS.values())
    out = out.withColumns({
        "collecting": F.lit(heartbeat is not None and now - heartbeat < config.LIVE_SECONDS), "lag_seconds": F.lit(now) - F.col("last_minute"),
        "ready_for_detection": F.col("minutes_collected") >= needed, "minutes_needed": F.greatest(F.lit(0), F.lit(needed) - F.col("minutes_collected")),
    })
    for name, rows in counted.items():  # one row each
        out = out.crossJoin(rows.agg((F.countDistinct("term") if name == "terms" else F.count("*")).alias(name)))
    return out


def horizons(totals: DataFrame, alerts: DataFrame) -> DataFrame:
    """Readiness of each horizon, with its alerts."""
    by_mode = alerts.groupBy("mode").agg(F.count("*").alias("alerts"))
    return counters.readiness(totals).join(by_mode, "mode", "left").fillna(0, ["alerts"])


def topics(listed: DataFrame, hits: DataFrame) -> DataFrame:
    """Listed topics with all their hits; 0 for those that never occurred."""
    sums = hits.groupBy("subject").agg(F.sum("hits").alias("total_hits"))
    return listed.join(sums, F.col("name") == F.col("subject"), "left").drop("subject").fillna(0, ["total_hits"])


def series(dense: DataFrame, subject: str, limit: int) -> DataFrame:
    return counters.tail(dense.where(F.col("subject") == subject), limit).select(F.col("start").alias("t"), "hits", "total", "share", F.bround("coverage", 3).alias("coverage"))


def _shown(posts: DataFrame) -> DataFrame:
    return posts.select("ts", "did", "rkey", "lang", F.substring("text", 1, config.POST_CHARS).alias("text"), post_url(F.col("did"), F.col("rkey")).alias("url"))


def topic_posts(matches: DataFrame, topic: str, limit: int, start: int | None = None, end: int | None = None) -> DataFrame:
    """Oldest first within a window, if both its ends are given; else the newest."""
    rows = matches.where(F.col("subject") == topic)
    if start is None or end is None:
        return _shown(rows.orderBy(F.desc("ts"), "rkey").limit(limit))
    return _shown(rows.where((F.col("ts") >= start) & (F.col("ts") < end)).orderBy("ts", "rkey").limit(limit))


def term_posts(samples: DataFrame, term: str, limit: int, now: int, start: int | None = None, end: int | None = None) -> DataFrame:
    """Posts that contain the term, oldest first; of the time that samples are kept, if no window is given."""
    if start is None or end is None:
        start, end = now - config.SAMPLE_HOURS * 3600, now
    hit = F.lower("text").contains(term.lstrip("#").lower())
    return _shown(samples.where((F.col("ts") >= start) & (F.col("ts") < end) & hit).orderBy("ts", "rkey").limit(limit))
