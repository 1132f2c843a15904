"""Stories: co-occurring terms as a graph, communities, chains over time, first posts and recurrence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T


def edges(term_posts: DataFrame, least: float = config.MIN_EDGE) -> DataFrame:
    """term_posts: window, term, post. Pairs of terms by the share of posts that they have in common, of the smaller one's."""
    rows = term_posts.select("window", "term", "post").distinct()
    sizes = rows.groupBy("window", "term").agg(F.count("*").alias("n"))
    a, b = (rows.select("window", "post", F.col("term").alias(c)) for c in "ab")
    both = a.join(b, ["window", "post"]).where("a < b").groupBy("window", "a", "b").agg(F.count("*").alias("shared"))
    for c in "ab":
        both = both.join(sizes.select("window", F.col("term").alias(c), F.col("n").alias(f"n{c}")), ["window", c])
    return both.select("window", "a", "b", "shared", (F.col("shared") / F.least("na", "nb")).alias("weight")).where(F.col("weight") >= least)


def louvain(nodes: list[str], weights: dict[tuple[str, str], float]) -> list[list[str]]:
    """One level of local moving in a fixed order; larger communities first."""
    near: dict[str, dict[str, float]] = {n: {} for n in sorted(nodes)}
    for (a, b), w in sorted(weights.items()):
        near[a][b] = near[b][a] = w
    degree = {n: sum(x.values()) for n, x in near.items()}
    total, of = sum(degree.values()), {n: n for n in near}
    load, moved, rounds = dict(degree), total > 0, 0
    while moved and rounds < 100:
        moved, rounds = False, rounds + 1
        for n in near:
            load[of[n]] -= degree[n]
            into: dict[str, float] = {of[n]: 0.0}
            for m, w in near[n].items():
                into[of[m]] = into.get(of[m], 0.0) + w
            gain = {c: w - load[c] * degree[n] / total for c, w in into.items()}
            best = of[n]
            for c, g in gain.items():
                if g > gain[best] and g > 0:
                    best = c
            moved |= best != of[n]
            of[n] = best
            load[best] += degree[n]
    groups: dict[str, list[str]] = {}
    for n, c in of.items():
        groups.setdefault(c, []).append(n)
    return sorted(groups.values(), key=lambda g: (-len(g), min(g)))


def communities(term_posts: DataFrame) -> DataFrame:
    """window, cluster, terms. A window's graph has the terms that spiked in it, dozens."""
    terms = term_posts.groupBy("window").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    links = edges(term_posts).groupBy("window").agg(F.collect_list(F.struct("a", "b", "weight")).alias("links"))

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.itertuples():
            links = row.links if row.links is not None else []
            found = louvain(list(row.terms), {(x["a"], x["b"]): x["weight"] for x in links})
            out += [(row.window, i, sorted(g)) for i, g in enumerate(found)]
        return pd.DataFrame(out, columns=["window", "cluster", "terms"])

    return terms.join(links, "window", "left").mapInPandas(lambda it: (cluster(p) for p in it), "window bigint, cluster bigint, terms array<string>")


def cluster_alerts(members: DataFrame) -> DataFrame:
    """members: mode, start, cluster, subject, hits, zscore, confidence, links (separated by spaces). Each cluster's terms, summed hits, the
    score and subject of its peak, the largest known confidence, and the first three links, the peak's first."""
    order = F.struct(-F.col("zscore"), F.col("subject"))
    by_peak = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.coalesce("links", F.lit("")).alias("links")))), lambda x: F.split(x["links"], " "))
    links = F.slice(F.array_distinct(F.filter(F.flatten(by_peak), lambda u: u != "")), 1, 3)
    return members.groupBy("mode", "start", "cluster").agg(F.sort_array(F.collect_set("subject")).alias("terms"), F.sum("hits").alias("hits"), F.max("zscore").alias("zscore"), F.min_by("subject", order).alias("peak"), F.max("confidence").alias("confidence"), links.alias("links"))


def chain(clusters: DataFrame, bucket: int) -> DataFrame:
    """clusters: mode, start, terms, hits, zscore. Stories: (mode, key) with span and recurrence; the order of time makes this one pass a mode."""

    def overlap(a: set, b: set) -> float:
        return len(a & b) / len(a | b) if a and b else 0.0

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        stories: dict[str, dict] = {}
        for row in pdf.assign(first=pdf.terms.map(min)).sort_values(["start", "first"]).itertuples():
            terms = set(row.terms)
            live = [s for s in stories.values() if row.start - config.CHAIN_GAP * bucket <= s["last_bucket"] <= row.start]
            best = max(live, key=lambda s: (overlap(terms, s["set"]), -s["last_bucket"]), default=None)
            if best is None or overlap(terms, best["set"]) < config.CHAIN_SIMILARITY:
                key = "+".join(sorted(terms)[:3]) + f"@{row.start}"
                past = [s for s in stories.values() if s["last_bucket"] < row.start - config.RECURRENCE_AGE]
                old = max(past, key=lambda s: overlap(terms, s["set"]), default=None)
                score = overlap(terms, old["set"]) if old else None
                best = stories.setdefault(key, {"mode": row.mode, "key": key, "set": terms, "first_bucket": row.start, "last_bucket": row.start, "seen": set(), "hits": 0, "zscore": row.zscore, "recurrence": None if score is None else round(score, 3), "recurs_from": old["key"] if old and score >= config.RECURRENCE_SIMILARITY else None})
            best["set"] = terms
            best["last_bucket"] = row.start
            best["seen"].add(row.start)
            best["hits"] = max(best["hits"], row.hits)
            best["zscore"] = max(best["zscore"], row.zscore)
        out = [{**s, "terms": sorted(s["set"]), "buckets": len(s["seen"])} for s in stories.values()]
        return pd.DataFrame(out, columns=["mode", "key", "terms", "first_bucket", "last_bucket", "buckets", "hits", "zscore", "recurrence", "recurs_from"])

    return clusters.groupBy("mode").applyInPandas(run, "mode string, key string, terms array<string>, first_bucket bigint, last_bucket bigint, buckets bigint, hits bigint, zscore double, recurrence double, recurs_from string")


def banded(posts: DataFrame, keys: list[str]) -> DataFrame:
    """posts: keys, id, rank, sig. A row for each band, with the signature's name."""
    rows = config.SIGNATURE // config.BANDS
    parts = F.array(*[F.xxhash64(F.lit(b), *[F.col("sig")[b * rows + k] for k in range(rows)]) for b in range(config.BANDS)])
    return posts.select(*keys, "id", "rank", F.xxhash64("sig").alias("name"), F.explode(parts).alias("band"))


def nearest(posts: DataFrame, background: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, id, rank, sim: the most similar post that shares a band, of the earlier ones with these keys and of the background, else 0.

    background: sig, and those of the keys that it goes by."""
    keys = list(keys)
    b = banded(posts, keys)
    old = b.select(*keys, "band", F.col("id").alias("i0"), F.col("rank").alias("r0"), F.col("name").alias("n0"))
    pairs = b.join(old, [*keys, "band"]).where("r0 < rank or r0 = rank and i0 < id").select(*keys, "id", "rank", "name", "n0")
    sigs = posts.select("sig")
    if background is not None:
        shared = [k for k in keys if k in background.columns]
        before = banded(background.withColumns({"id": F.lit(0), "rank": F.lit(0)}), shared).select(*shared, "band", F.col("name").alias("n0"))
        pairs = pairs.unionByName(b.join(before, [*shared, "band"]).select(*keys, "id", "rank", "name", "n0"))
        sigs = sigs.unionByName(background.select("sig"))
    sigs = sigs.distinct().withColumn("name", F.xxhash64("sig"))
    both = pairs.distinct().join(sigs, "name").join(sigs.select(F.col("name").alias("n0"), F.col("sig").alias("s0")), "n0")
    best = both.groupBy(*keys, "id", "rank").agg(F.max(T.similarity(F.col("sig"), F.col("s0"))).alias("sim"))
    return posts.select(*keys, "id", "rank").join(best, [*keys, "id", "rank"], "left").select(*keys, "id", "rank", F.coalesce("sim", F.lit(0.0)).alias("sim"))


def first_story(posts: DataFrame, background: DataFrame | None = None, keys: tuple[str, ...] = (), below: float = config.NOVELTY_BELOW) -> DataFrame:
    """Of each story (keys): the earliest post that resembles neither the background nor a post before it, and how new it is; of a
    continuation, where all do, the earliest, with 0."""
    order = F.struct("rank", "id")
    near = nearest(posts, background, keys)
    new = F.min_by(F.struct("id", F.bround(1 - F.col("sim"), 3).alias("novelty")), F.when(F.col("sim") < below, order))
    found = near.groupBy(*keys).agg(F.coalesce(new, F.min_by(F.struct("id", F.lit(0.0).alias("novelty")), order)).alias("f"))
    return found.where("f is not null").select(*keys, "f.id", "f.novelty")
