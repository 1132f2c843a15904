"""Readers of posts, trends and watchlists."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the wire format.
COLLECTION = "app.bsky.feed.post"
EXTERNAL = "app.bsky.embed.external"
_FEATURE = "features array<struct<`$type`:string, uri:string, tag:string>>"
WIRE = f"kind string, did string, time_us bigint, commit struct<operation:string, collection:string, rkey:string, record:struct<text:string, langs:array<string>, tags:array<string>, facets:array<struct<{_FEATURE.replace(' ', ':', 1)}>>, embed:struct<`$type`:string, external:struct<uri:string>>>>"


def parse(lines: DataFrame, column: str = "value", collection: str = COLLECTION) -> DataFrame:
    """Posts of JSON lines (batch or stream): created, of the collection, with text."""
    j = lines.select(F.from_json(column, WIRE).alias("j")).select("j.*")
    record = F.col("commit.record")
    kept = j.where((F.col("kind") == "commit") & (F.col("commit.operation") == "create") & (F.col("commit.collection") == collection) & (F.trim(record["text"]) != ""))
    empty = F.array().cast("array<string>")
    parts = F.flatten(F.transform(record["facets"], lambda f: F.coalesce(f["features"], F.array().cast("array<struct<`$type`:string,uri:string,tag:string>>"))))
    links = F.transform(F.filter(parts, lambda p: p["$type"].endswith("#link") & p["uri"].isNotNull()), lambda p: p["uri"])
    tags = F.transform(F.filter(parts, lambda p: p["$type"].endswith("#tag") & p["tag"].isNotNull()), lambda p: p["tag"])
    embed = F.when(record["embed"]["$type"].startswith(EXTERNAL) & record["embed"]["external"]["uri"].isNotNull(), F.array(record["embed"]["external"]["uri"])).otherwise(empty)
    time_us = F.coalesce("time_us", F.unix_micros(F.current_timestamp()))
    return kept.select(
        "did", F.col("commit.rkey").alias("rkey"), record["text"].alias("text"), F.get(record["langs"], 0).alias("lang"), time_us.alias("time_us"), F.floor(time_us / 1000000).alias("ts"),
        F.array_distinct(F.concat(F.coalesce(links, empty), embed)).alias("links"), F.array_distinct(F.concat(F.coalesce(tags, empty), F.coalesce(record["tags"], empty))).alias("tags"),
    )


def epoch(value):
    """Seconds of an ISO-8601 time, null if it is none."""
    return F.unix_timestamp(F.try_to_timestamp(value))


def trends(lines: DataFrame, now: int, column: str = "value") -> DataFrame:
    j = lines.select(F.from_json(column, "topic string, displayName string, description string, category string, status string, postCount bigint, startedAt string").alias("j")).select("j.*")
    name = F.coalesce(F.nullif("topic", F.lit("")), F.col("displayName"))
    return j.where(name.isNotNull()).select(name.alias("topic"), F.col("displayName").alias("display_name"), "description", "category", "status", F.col("postCount").alias("post_count"), epoch(F.col("startedAt")).alias("started_at"), F.lit(now).cast("bigint").alias("first_seen"), F.lit(now).cast("bigint").alias("last_seen"))


def topics(text: str) -> list[dict]:
    """A watchlist: name -> phrases, or {phrases, langs}; names that begin with _ and malformed values are left out."""
    out = []
    for name, value in json.loads(text).items():
        value = {"phrases": value} if isinstance(value, list) else value
        if not name.startswith("_") and isinstance(value, dict) and isinstance(value.get("phrases"), list):
            phrases = [p for p in value["phrases"] if isinstance(p, str) and p.strip()]
            if phrases:
                out.append({"name": name, "phrases": phrases, "langs": value.get("langs") or []})
    return out


def replay(spark: SparkSession, path: str) -> DataFrame:
    """A stream of recorded wire lines."""
    return parse(spark.readStream.text(path))
