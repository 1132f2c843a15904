"""Stored tables: merges by key, retention, reads in order, older shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALERT_KEY = ["bucket", "subject", "mode", "kind"]


def new_alerts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Alerts that are not stored yet: the first write wins."""
    rank = F.row_number().over(Window.partitionBy(*ALERT_KEY).orderBy(F.desc("zscore")))
    return new.withColumn("rank", rank).where("rank = 1").drop("rank").join(old.select(*ALERT_KEY), ALERT_KEY, "left_anti")


def add_counts(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    return old.select(*keys, value).unionByName(new.select(*keys, value)).groupBy(*keys).agg(F.sum(value).alias(value))


def merge_events(old: DataFrame, new: DataFrame) -> DataFrame:
    """By (key, mode): new terms and recurrence, the wider span, the larger hits, score and confidence, the older first post."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, (F.col("o.key") == F.col("n.key")) & (F.col("o.mode") == F.col("n.mode")), "full_outer")
    pick = {"key": F.coalesce, "mode": F.coalesce, "first_bucket": F.least, "last_bucket": F.greatest, "hits": F.greatest, "zscore": F.greatest, "confidence": F.greatest}
    out = []
    for c in new.columns:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        out.append((pick[c](a, b) if c in pick else F.coalesce(a, b) if c.startswith("story_") else F.when(F.col("n.key").isNotNull(), b).otherwise(a)).alias(c))
    return both.select(*out)


def merge_trends(old: DataFrame, new: DataFrame) -> DataFrame:
    """By topic: the new row, but first_seen and started_at stay."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.topic") == F.col("n.topic"), "full_outer")
    first = {"first_seen", "started_at", "topic"}
    return both.select(*[(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in first else F.when(F.col("n.topic").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))).alias(c) for c in new.columns])


def retain(rows: DataFrame, column: str, now: int, seconds: int) -> DataFrame:
    return rows.where(F.col(column) >= now - seconds)


def list_alerts(alerts: DataFrame, limit: int, sort: str = "recent", subject: str = "", mode: str = "", kind: str = "") -> DataFrame:
    orders = {"recent": [F.desc("bucket"), F.desc("zscore"), "subject", "mode", "kind"], "confidence": [F.desc_nulls_last("confidence"), F.desc("bucket"), "subject", "mode", "kind"]}
    if sort not in orders:
        raise ValueError(f"unknown sort {sort!r}")
    if kind not in ("", "topic", "term"):
        raise ValueError(f"unknown kind {kind!r}")
    for c, v in (("subject", subject), ("mode", mode), ("kind", kind)):
        if v:
            alerts = alerts.where(F.col(c) == v)
    return alerts.orderBy(*orders[sort]).limit(limit)


def normalize_alerts(df: DataFrame) -> DataFrame:
    """Alerts of any older shape in today's columns."""
    for old, new in (("topic", "subject"), ("novelty", "terms")):
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    for c, v in (("mode", F.lit("deep")), ("kind", F.lit("topic")), ("links", F.lit("")), ("confidence", F.lit(None).cast("double"))):
        if c not in df.columns:
            df = df.withColumn(c, v)
    return df


def _plain(text: Column) -> Column:
    return F.ltrim(F.lower(text), F.lit("#"))


def trend_report(trends: DataFrame, alerts: DataFrame) -> DataFrame:
    """trends: topic, wanted, first_seen. alerts: bucket, subject, terms, zscore. The earliest alert of each trend in time, and its lead in whole minutes.

    A subject that the trend has counts if it is specific (two words, a hashtag) or one of the alert's terms is there too; else two
    terms must be. Alerts are joined by a word that they share with the trend, so only those are compared. Case and leading '#' don't matter.
    """
    from .. import config

    t = trends.select("topic", "first_seen", "wanted", F.explode("wanted").alias("token"))
    a = alerts.select("bucket", "subject", "zscore", _plain(F.col("subject")).alias("plain"), F.array_distinct(F.transform("terms", _plain)).alias("alert_terms"))
    a = a.withColumn("token", F.explode(F.array_distinct(F.concat(F.array("plain"), F.col("alert_terms")))))
    lead = F.col("first_seen") - F.col("bucket")
    rows = t.join(a, "token").where((lead >= config.LEAD_FROM) & (lead <= config.LEAD_TO))
    overlap = F.size(F.array_intersect("alert_terms", "wanted"))
    specific = F.col("plain").contains(" ") | F.col("subject").startswith("#") | (overlap >= 1)
    by_subject = F.array_contains("wanted", F.col("plain")) & specific
    rows = rows.where(by_subject | (overlap >= 2)).withColumn("basis", F.when(by_subject, "subject").otherwise("terms"))
    best = rows.groupBy("topic").agg(F.min_by(F.struct("bucket", "subject", "basis"), F.struct(F.col("bucket"), -F.col("zscore"), F.col("subject"))).alias("m"))
    minutes = F.bround((F.col("first_seen") - F.col("m.bucket")) / 60).cast("bigint")
    return trends.join(best, "topic", "left").select("topic", "first_seen", F.col("m.subject").alias("subject"), F.col("m.basis").alias("basis"), minutes.alias("lead_minutes"))


def trend_summary(report: DataFrame) -> DataFrame:
    """Trends tracked and matched, the share of them, the median and the best lead."""
    n, matched = F.count("*"), F.count("subject")
    share = F.when(n > 0, F.bround(matched / n, 3)).otherwise(0.0)
    return report.agg(n.alias("trends_tracked"), matched.alias("matched"), share.alias("coverage"), F.bround(F.median("lead_minutes"), 1).alias("median_lead_minutes"), F.max("lead_minutes").alias("best_lead_minutes"))


def newest(alerts: DataFrame, limit: int) -> DataFrame:
    """The newest alerts, to be read oldest first."""
    return alerts.orderBy(F.desc("bucket"), F.desc("zscore"), "subject", "mode", "kind").limit(limit)


def list_events(events: DataFrame, limit: int, mode: str = "") -> DataFrame:
    if mode:
        events = events.where(F.col("mode") == mode)
    return events.orderBy(F.desc("last_bucket"), F.desc("zscore"), "key").limit(limit)


def event(events: DataFrame, mode: str, key: str) -> DataFrame:
    return events.where((F.col("mode") == mode) & (F.col("key") == key))


def list_trends(trends: DataFrame, limit: int) -> DataFrame:
    return trends.orderBy(F.desc("first_seen"), "topic").limit(limit)


def put_meta(old: DataFrame, new: DataFrame) -> DataFrame:
    """key, value: new values replace old ones."""
    return old.join(new.select("key"), "key", "left_anti").unionByName(new)


def fresh_cursor(cursor_us: int | None, now: float, most: int = 3600) -> int | None:
    """The cursor (microseconds) to go on from; None, to begin live, if there is none or it is too old."""
    return cursor_us if cursor_us and now - cursor_us / 1e6 <= most else None


def retained(corpora: dict[str, DataFrame], now: int) -> dict[str, DataFrame]:
    """Each corpus without what is past its retention; corpora without one (counters) stay whole."""
    from .. import config

    kept = {"matches": ("ts", config.MATCH_DAYS * 86400), "samples": ("ts", config.SAMPLE_HOURS * 3600), "term_minutes": ("minute", config.TERM_HOURS * 3600)}
    return {name: retain(rows, kept[name][0], now, kept[name][1]) if name in kept else rows for name, rows in corpora.items()}
