"""What a spike is about: words and links that are unusually common inside it. All spikes at once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T


def _ranked(counts: DataFrame, limit: int) -> DataFrame:
    """counts: spike, word, cin, cout, nin, nout."""
    lift = (F.col("cin") / F.greatest("nin", F.lit(1))) / (F.col("cout") / F.greatest("nout", F.lit(1)) + F.lit(1e-9))
    rows = counts.where(F.col("cin") >= config.MIN_TERM_OCCURRENCES).select("spike", "word", "cin", lift.alias("lift")).where(F.col("lift") >= config.MIN_LIFT)
    rank = F.row_number().over(Window.partitionBy("spike").orderBy(F.desc("lift"), F.desc("word")))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit)


def distinctive(texts: DataFrame, limit: int = config.TERM_LIMIT) -> DataFrame:
    """texts: spike, inside (boolean), text. Words of each spike by lift, highest first, ties by the later word."""
    counts = texts.select("spike", "inside", F.explode(T.novelty_words(F.col("text"))).alias("word")).groupBy("spike", "word").agg(F.count_if("inside").alias("cin"), F.count_if(~F.col("inside")).alias("cout"))
    return _ranked(counts.join(counts.groupBy("spike").agg(F.sum("cin").alias("nin"), F.sum("cout").alias("nout")), "spike"), limit)


def top_links(posts: DataFrame, limit: int = config.LINK_LIMIT) -> DataFrame:
    """posts: spike, links (separated by spaces). The most shared links that enough of the posts with links have."""
    held = posts.select("spike", F.array_distinct(F.filter(F.split("links", " "), lambda x: x != "")).alias("urls")).where(F.size("urls") > 0)
    floor = held.groupBy("spike").agg(F.greatest(F.lit(2), F.floor(F.count("*") * config.MIN_LINK_SHARE)).alias("floor"))
    counts = held.select("spike", F.explode("urls").alias("url")).groupBy("spike", "url").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("spike").orderBy(F.desc("n"), "url"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= limit).join(floor, "spike").where("n >= floor").drop("floor")


def inside(spikes: DataFrame, posts: DataFrame, bucket: int, limit: int, term: bool) -> DataFrame:
    """Posts of each spike's own bucket, oldest first: an equi-join on the bucket, then containment for terms."""
    dated = posts.withColumn("start", F.col("ts") - F.col("ts") % bucket)
    rows = spikes.select("start", F.col("subject").alias("spike_subject")).join(dated, "start")
    hit = F.lower("text").like(F.concat(F.lit("%"), F.lower(F.ltrim(F.col("spike_subject"), F.lit("#"))), F.lit("%"))) if term else F.col("subject") == F.col("spike_subject")
    rank = F.row_number().over(Window.partitionBy("start", "spike_subject").orderBy("ts", "rkey"))
    return rows.where(hit).withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")


def _block(ts: Column, guard: int) -> Column:
    return F.floor(ts / max(guard, 60))


def _placed(spikes: DataFrame, posts: DataFrame, guard: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """posts with their place among those of their subject by time, and of each spike n_before and ranges (before, lo, hi) of the places of its contrast.

    Places are counted within blocks of time, to which the posts of earlier blocks are added: no subject meets in one task."""
    own = posts.where("ts is not null and subject is not null").withColumn("post", F.lit(True))
    edges = F.explode(F.array(F.struct(F.lit(True).alias("before"), (F.col("start") - guard).alias("ts")), F.struct(F.lit(False).alias("before"), (F.col("end") + guard).alias("ts")))).alias("edge")
    edges = spikes.where("subject is not null").select("spike", "subject", edges).select("spike", "subject", "edge.*", F.lit(False).alias("post"))
    rows = own.unionByName(edges, allowMissingColumns=True).withColumn("block", _block(F.col("ts"), guard))
    seen = F.coalesce(F.sum("n").over(Window.partitionBy("subject").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = rows.groupBy("subject", "block").agg(F.count_if("post").alias("n")).select("subject", "block", seen.alias("seen"))
    order = Window.partitionBy("subject", "block").orderBy("ts", "post", "rkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("here", F.count_if("post").over(order)).join(blocks, ["subject", "block"]).withColumn("place", F.col("seen") + F.col("here"))
    of = rows.where("not post").groupBy("spike", "subject").agg(F.max(F.when(F.col("before"), F.col("place"))).alias("n_before"), F.max("place").alias("n_till"))
    held, n = F.least("n_before", F.lit(limit)), F.col("n_before")
    ahead = F.when(held < limit // 2, limit - held).otherwise(0)
    part = lambda before, lo, size: F.struct(F.lit(before).alias("before"), lo.alias("lo"), (lo + size).alias("hi"))
    ranges = F.filter(F.array(part(True, n - held, held), part(False, F.greatest("n_till", n), ahead)), lambda r: r["lo"] < r["hi"])
    return rows.where("post").select(*posts.columns, (F.col("place") - 1).alias("place")), of.select("spike", "subject", "n_before", ranges.alias("ranges"))


def outside(spikes: DataFrame, posts: DataFrame, guard: int, limit: int) -> DataFrame:
    """The contrast of every spike at once: spikes (spike, subject, start, end) meet posts (subject, ts, rkey) of their subject.

    The newest posts before it; if those are under half of limit, filled up with the oldest after it. A spike meets the few
    chunks of places that its contrast lies in, not all posts of its subject."""
    placed, of = _placed(spikes, posts, guard, limit)
    size = max(limit, 1)
    ranges = of.select("spike", "subject", F.explode("ranges").alias("r")).select("spike", "subject", "r.*")
    ranges = ranges.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor((F.col("hi") - 1) / size))))
    rows = ranges.join(placed.withColumn("chunk", F.floor(F.col("place") / size)), ["subject", "chunk"])
    return rows.where("place >= lo and place < hi").drop("chunk", "place", "lo", "hi")


def _contrasted(wanted: DataFrame, spikes: DataFrame, posts: DataFrame, guard: int, limit: int) -> DataFrame:
    """wanted: spike, word, cin, nin. Adds cout and nout, the counts of the word and of all words in the spike's contrast.

    Contrasts of neighbouring spikes overlap, so each post is read once for all spikes whose places before them lie in the same
    stretch of 2 * limit: a group holds those posts and limit more, however many posts a subject has."""
    told = posts.select("subject", "ts", "rkey", F.array_join(T.novelty_words(F.col("text")), " ").alias("words"))
    placed, of = _placed(spikes, told, guard, limit)
    stretch, size = 2 * max(limit, 1), max(limit // 4, 1)
    of = of.withColumn("stretch", F.floor(F.col("n_before") / stretch))
    of = of.join(wanted.groupBy("spike").agg(F.collect_list(F.struct("word", "cin")).alias("own"), F.first("nin").alias("nin")), "spike")
    chunks = F.flatten(F.transform("ranges", lambda r: F.sequence(F.floor(r["lo"] / size), F.floor((r["hi"] - 1) / size))))
    needed = of.select("subject", "stretch", F.explode(chunks).alias("chunk")).distinct()
    texts = placed.withColumn("chunk", F.floor(F.col("place") / size)).join(needed, ["subject", "chunk"]).select(F.col("subject").alias("of_subject"), F.col("stretch").alias("of_stretch"), "place", F.coalesce("words", F.lit("")).alias("words"))
    of = of.select("spike", "subject", "stretch", "nin", "ranges.lo", "ranges.hi", "own.word", "own.cin")

    def count(texts: pd.DataFrame, spikes: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        ids: dict[str, int] = {}
        for words in spikes["word"]:
            for w in words:
                ids.setdefault(w, len(ids))
        texts = texts.sort_values("place")
        places, sizes, known = texts["place"].to_numpy(), [0], [np.zeros(0, np.int32)]
        ends = [0]
        for words in texts["words"]:
            split = words.split()
            sizes.append(len(split))
            known.append(np.array([ids[w] for w in split if w in ids], np.int32))
            ends.append(len(known[-1]))
        sizes, ends, known = np.cumsum(sizes), np.cumsum(ends), np.concatenate(known)
        out = []
        for row in spikes.itertuples():
            n, total = np.zeros(len(ids), np.int64), 0
            for lo, hi in zip(row.lo, row.hi):
                i, j = np.searchsorted(places, [lo, hi])
                n += np.bincount(known[ends[i] : ends[j]], minlength=len(ids))
                total += int(sizes[j] - sizes[i])
            out.append(pd.DataFrame({"spike": row.spike, "word": row.word, "cin": row.cin, "cout": n[[ids[w] for w in row.word]], "nin": row.nin, "nout": total}))
        return pd.concat(out) if out else pd.DataFrame(columns=["spike", "word", "cin", "cout", "nin", "nout"])

    kind = spikes.schema["spike"].dataType.simpleString()
    return texts.groupBy("of_subject", "of_stretch").cogroup(of.groupBy("subject", "stretch")).applyInPandas(count, f"spike {kind}, word string, cin bigint, cout bigint, nin bigint, nout bigint")


def explained(spikes: DataFrame, posts: DataFrame, guard: int, limit: int = config.CONTRAST_LIMIT) -> DataFrame:
    """spike, terms, links: what each spike's posts have that its subject's other posts have not, and what they link to."""
    covered = F.explode(F.sequence(_block(F.col("start"), guard), _block(F.greatest("start", F.col("end") - 1), guard))).alias("block")
    here = spikes.select("spike", "subject", "start", "end", covered).join(posts.withColumn("block", _block(F.col("ts"), guard)), ["subject", "block"]).where("ts >= start and ts < end").select("spike", "text", "links")
    counts = here.select("spike", F.explode(T.novelty_words(F.col("text"))).alias("word")).groupBy("spike", "word").agg(F.count("*").alias("cin"))
    wanted = counts.withColumn("nin", F.sum("cin").over(Window.partitionBy("spike"))).where(F.col("cin") >= config.MIN_TERM_OCCURRENCES)
    words = _ranked(_contrasted(wanted, spikes, posts, guard, limit), config.TERM_LIMIT).join(spikes.select("spike", "subject"), "spike").where("word != subject")
    terms = words.groupBy("spike").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("terms"))
    links = top_links(here).groupBy("spike").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "url"))), lambda x: x["url"]).alias("links"))
    none = F.array().cast("array<string>")
    out = spikes.select("spike").join(terms, "spike", "left").join(links, "spike", "left")
    return out.select("spike", F.coalesce("terms", none).alias("terms"), F.coalesce("links", none).alias("links"))
