"""Queries over the driver's tables, each with the SQL that gives the same rows.

events are posts: an event type is a subject, a user an author, an hour (UNIT) the least unit of time.
documents are posts with ts = 1704067200 + 6 * doc_id and their source as author.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T
from ..functions.lists import EMPTY_WORDS, STOPWORDS
from ..operators import counters, detector, explain, model, passes, reads, stories, tables

UNIT, DOC_TIME = 3600, 1704067200
TOPICS = [{"name": "license", "phrases": ["license", "rights reserved"], "langs": []}, {"name": "the", "phrases": ["the"], "langs": ["en"]}, {"name": "und", "phrases": ["und", "der die"], "langs": ["de"]}, {"name": "tion", "phrases": ["tion"], "langs": []}]


def _read(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet").select(*columns)


def events(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "events", "ts", "user_id", "event_type")
    rows = rows.select(F.expr(counters.EPOCH.format("ts")).alias("ts"), F.col("user_id").cast("string").alias("did"), F.col("event_type").alias("subject"))
    return counters.with_unit(rows, UNIT)


def posts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "documents", "doc_id", "text", "lang", "source")
    rows = rows.select((DOC_TIME + F.col("doc_id") * 6).alias("ts"), F.col("source").alias("did"), "doc_id", "lang", "text")
    return counters.with_unit(rows, 60)


_EV = f"WITH e AS (SELECT cast(floor(epoch(ts)) AS BIGINT) AS ts, user_id, event_type AS subject FROM events), u AS (SELECT ts, ts - ts % {UNIT} AS unit, user_id, subject FROM e)"
_PO = f"WITH d AS (SELECT {DOC_TIME} + doc_id * 6 AS ts, doc_id, source AS did, lang, text FROM documents)"


def _frame_sql(h: config.Horizon) -> str:
    b = h.units * UNIT
    return f"""{_EV}, t AS (SELECT unit, count(*) AS posts FROM u GROUP BY unit),
f AS (SELECT unit - unit % {b} AS start, sum(posts)::BIGINT AS total, count(*)::DOUBLE / {h.units} AS coverage FROM t GROUP BY 1),
h AS (SELECT subject, unit - unit % {b} AS start, count(*) AS hits FROM u GROUP BY 1, 2),
s AS (SELECT x.subject, f.start, coalesce(h.hits, 0)::BIGINT AS hits, f.total, f.coverage, coalesce(h.hits, 0)::DOUBLE / f.total AS share
  FROM (SELECT DISTINCT subject FROM u) x CROSS JOIN f LEFT JOIN h ON h.subject = x.subject AND h.start = f.start)"""


def _scored_sql(h: config.Horizon) -> str:
    near = f"OVER (PARTITION BY subject ORDER BY start ROWS BETWEEN {h.gap + h.window} PRECEDING AND {h.gap + 1} PRECEDING)"
    days = "OVER (PARTITION BY subject, start % 86400 ORDER BY start RANGE BETWEEN 604800 PRECEDING AND 86400 PRECEDING)"
    return f"""{_frame_sql(h)}, w AS (
  SELECT *, count(*) {near} AS nt, median(share) {near} AS mt, mad(share) {near} AS dt, count(*) {days} AS ns, median(share) {days} AS ms, mad(share) {days} AS ds FROM s WHERE coverage >= 0.8),
b AS (SELECT *, coalesce(ns >= 3 AND ms > mt, false) AS is_seasonal FROM w WHERE nt = {h.window}),
c AS (SELECT *, CASE WHEN is_seasonal THEN ms ELSE mt END AS baseline, CASE WHEN is_seasonal THEN ds ELSE dt END AS spread FROM b),
z AS (SELECT *, (share - baseline) / greatest(1.4826 * spread, sqrt(greatest(baseline, 1.0::DOUBLE / total) / total)) AS zscore FROM c)"""


def _series(spark: SparkSession, sf: str, h: config.Horizon) -> DataFrame:
    e = events(spark, sf)
    return counters.dense(counters.topic_hits(e), counters.frame(counters.totals(e), h.units, UNIT), h.units, UNIT)


def _scored(name: str):
    h = config.horizon(name)

    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = detector.score(_series(spark, sf, h), h)
        return rows.select("subject", "start", "hits", "total", "is_seasonal", F.round("baseline", 6).alias("baseline"), F.round("zscore", 6).alias("zscore"), detector.is_spike(h).alias("is_spike"))

    sql = f"{_scored_sql(h)} SELECT subject, start, hits, total, is_seasonal, round(baseline, 6) AS baseline, round(zscore, 6) AS zscore, zscore >= {h.z} AND hits >= {h.min_hits} AND share > baseline AS is_spike FROM z"
    return run, sql


FAST = config.horizon("fast")
_Q: dict[str, tuple] = {f"scored_{n}": _scored(n) for n in config.HORIZONS}


def _query(sql: str | None):
    def add(f):
        _Q[f.__name__] = (f, sql)
        return f

    return add


@_query(f"{_EV} SELECT unit, count(*) AS posts FROM u GROUP BY unit")
def unit_totals(spark, sf):
    return counters.totals(events(spark, sf))


@_query(f"{_EV} SELECT unit, subject, count(*) AS hits FROM u GROUP BY 1, 2")
def topic_minutes(spark, sf):
    return counters.topic_hits(events(spark, sf))


@_query(f"{_EV} SELECT unit, subject, count(DISTINCT user_id) AS hits FROM u GROUP BY 1, 2")
def term_minutes_distinct(spark, sf):
    return counters.term_hits(events(spark, sf))


@_query(f"{_frame_sql(FAST)} SELECT start, total, round(coverage, 3) AS coverage FROM f")
def bucket_frame(spark, sf):
    return counters.frame(counters.totals(events(spark, sf)), FAST.units, UNIT).select("start", "total", F.round("coverage", 3).alias("coverage"))


@_query(f"{_frame_sql(FAST)} SELECT subject, start, hits, total, round(share, 9) AS share FROM s")
def dense_series(spark, sf):
    return _series(spark, sf, FAST).select("subject", "start", "hits", "total", F.round("share", 9).alias("share"))


@_query(f"{_frame_sql(FAST)} SELECT subject, start, hits FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY start DESC) AS r FROM s) WHERE r <= 10")
def series_tail(spark, sf):
    return counters.tail(_series(spark, sf, FAST), 10).select("subject", "start", "hits")


@_query(f"{_scored_sql(FAST)} SELECT subject, start, hits, round(zscore, 6) AS zscore, round(CASE WHEN baseline > 0 THEN share / baseline ELSE 0 END, 6) AS multiple FROM z WHERE zscore >= 2 AND hits >= 5 AND share > baseline")
def spikes_low_threshold(spark, sf):
    rows = detector.score(_series(spark, sf, FAST), FAST).where(detector.is_spike(FAST, 2.0))
    return rows.select("subject", "start", "hits", F.round("zscore", 6).alias("zscore"), F.round("multiple", 6).alias("multiple"))


@_query(f"{_EV} SELECT subject, hits FROM (SELECT subject, sum(n)::BIGINT AS hits FROM (SELECT unit, subject, count(DISTINCT user_id) AS n FROM u GROUP BY 1, 2) GROUP BY 1) WHERE hits >= 20 ORDER BY hits DESC, subject LIMIT 1500")
def candidates(spark, sf):
    return counters.candidates(counters.term_hits(events(spark, sf)), FAST.min_hits)


@_query(f"{_EV}, t AS (SELECT unit, count(*) AS posts FROM u GROUP BY unit) SELECT min(unit) AS first_unit, max(unit) AS last_unit, sum(posts)::BIGINT AS posts, count(*) AS units FROM t")
def corpus_summary(spark, sf):
    return counters.summary(counters.totals(events(spark, sf)))


@_query(f"{_EV}, t AS (SELECT count(DISTINCT unit) AS minutes FROM u), h(mode, warmup) AS (VALUES ('fast', 60::BIGINT), ('mid', 240::BIGINT), ('deep', 540::BIGINT)) SELECT mode, warmup, minutes, minutes >= warmup AS ready, greatest(0, warmup - minutes)::BIGINT AS minutes_remaining FROM h CROSS JOIN t")
def horizon_status(spark, sf):
    return counters.readiness(counters.totals(events(spark, sf)))


def _topic_sql() -> str:
    parts = []
    for t in TOPICS:
        phrases = "|".join(t["phrases"])
        langs = f" AND (lang IS NULL OR lang IN ({', '.join(repr(x) for x in t['langs'])}))" if t["langs"] else ""
        parts.append(f"SELECT unit, '{t['name']}' AS subject FROM p WHERE regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_''’])({phrases})($|[^\\p{{L}}\\p{{N}}_''’])'){langs}")
    return f"{_PO}, p AS (SELECT ts - ts % 60 AS unit, lang, text FROM d) SELECT unit, subject, count(*) AS hits FROM ({' UNION ALL '.join(parts)}) GROUP BY 1, 2"


@_query(_topic_sql())
def topic_match(spark, sf):
    rows = posts(spark, sf).select("unit", F.explode(T.matched_topics(F.col("text"), F.col("lang"), TOPICS)).alias("subject"))
    return counters.topic_hits(rows)


def _list(items: list[str]) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


_CONTENT = f"(CASE WHEN starts_with({{0}}, '#') THEN length({{0}}) > 2 ELSE length({{0}}) >= 3 AND translate({{0}}, '’', '''') NOT IN ({_list(EMPTY_WORDS)}) END)"
_WORDS = rf"""{_PO}, l AS (SELECT ts, doc_id, did, regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://\S+', ' ', 'g'), '[\p{{L}}\p{{N}}_-]+(?:\.[\p{{L}}\p{{N}}_-]+)+(?:/\S*)?', ' ', 'g'), '@[\p{{L}}\p{{N}}_.-]+', ' ', 'g') AS t FROM d),
w AS (SELECT ts, doc_id, did, regexp_extract_all(t, '#?[a-z][a-z0-9''’_-]{{1,29}}') AS ws FROM l)"""
_TERMS = f"""{_WORDS}, i AS (SELECT ts, doc_id, did, ws[k] AS a, ws[k + 1] AS b FROM (SELECT ts, doc_id, did, ws, unnest(range(1, len(ws) + 1)) AS k FROM w)),
x AS (SELECT ts, doc_id, did, a AS term FROM i WHERE {_CONTENT.format('a')}
  UNION SELECT ts, doc_id, did, a || ' ' || b FROM i WHERE b IS NOT NULL AND NOT starts_with(a, '#') AND NOT starts_with(b, '#') AND ({_CONTENT.format('a')} OR {_CONTENT.format('b')}))"""


def _all_of(texts: str, items) -> Column:
    """Distinct items of all texts of a row."""
    return F.array_distinct(F.flatten(F.transform(texts, lambda x: items(x))))


def _extent(items: Column) -> Column:
    """How many, least and greatest. Rows of one text each would have to be sorted and spilled to find the least string."""
    return T.let(items, lambda x: F.struct(F.size(x).cast("bigint").alias("n"), F.array_min(x).alias("first"), F.array_max(x).alias("last")))


@_query(f"{_TERMS} SELECT doc_id, count(*) AS n_terms, min(term) AS first_term, max(term) AS last_term FROM x GROUP BY doc_id")
def extract_terms(spark, sf):
    rows = posts(spark, sf).groupBy("doc_id", "did").agg(F.collect_list("text").alias("texts"))
    found = _extent(_all_of("texts", T.extract_terms)).alias("t")
    rows = rows.select("doc_id", found).groupBy("doc_id").agg(F.sum("t.n").alias("n_terms"), F.min("t.first").alias("first_term"), F.max("t.last").alias("last_term"))
    return rows.where("n_terms > 0")


@_query(f"{_TERMS}, h AS (SELECT ts - ts % 60 AS unit, term AS subject, count(DISTINCT did) AS hits FROM x GROUP BY 1, 2) SELECT unit, subject, hits FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY hits DESC, subject) AS r FROM h) WHERE r <= 400 AND hits >= 3")
def top_terms_per_minute(spark, sf):
    return counters.top_terms_of(posts(spark, sf))


_NOVEL = f"regexp_extract_all(lower(text), '[a-z][a-z'']{{2,}}')"


@_query(f"""{_PO}, n AS (SELECT ts % 86400 < 3000 AS inside, unnest({_NOVEL}) AS word FROM d), c AS (SELECT word, count(*) FILTER (inside) AS cin, count(*) FILTER (NOT inside) AS cout FROM n WHERE word NOT IN ({_list(STOPWORDS)}) GROUP BY word),
t AS (SELECT greatest(sum(cin), 1) AS nin, greatest(sum(cout), 1) AS nout FROM c), l AS (SELECT word, cin, (cin::DOUBLE / nin) / (cout::DOUBLE / nout + 1e-9) AS lift FROM c CROSS JOIN t WHERE cin >= 2)
SELECT word, cin, round(log10(lift), 6) AS log_lift FROM l WHERE lift >= 3 ORDER BY lift DESC, word DESC LIMIT 6""")
def distinctive_terms(spark, sf):
    rows = posts(spark, sf).select(F.lit(1).alias("spike"), (F.col("ts") % 86400 < 3000).alias("inside"), "text")
    return explain.distinctive(rows).select("word", "cin", F.round(F.log10("lift"), 6).alias("log_lift"))


@_query(r"""WITH p AS (SELECT page_id % 7 AS spike, list_distinct(list_append(regexp_extract_all(html, 'https?://[^/\s"''<>]+'), regexp_extract(url, 'https?://[^/\s]+'))) AS urls FROM pages), c AS (SELECT spike, url, count(*) AS n FROM (SELECT spike, unnest(urls) AS url FROM p) GROUP BY 1, 2),
f AS (SELECT spike, greatest(2, floor(count(*) * 0.02))::BIGINT AS floor FROM p GROUP BY spike)
SELECT spike, url, n FROM (SELECT *, row_number() OVER (PARTITION BY spike ORDER BY n DESC, url) AS r FROM c) JOIN f USING (spike) WHERE r <= 3 AND n >= floor""")
def top_links(spark, sf):
    found = F.regexp_extract_all("html", F.lit(r"""https?://[^/\s"'<>]+"""), 0)
    rows = _read(spark, sf, "pages", "page_id", "url", "html").select((F.col("page_id") % 7).alias("spike"), F.array_join(F.concat(found, F.array(F.regexp_extract("url", r"https?://[^/\s]+", 0))), " ").alias("links"))
    return explain.top_links(rows).select("spike", "url", "n")


def _hashtag_posts(spark, sf) -> DataFrame:
    """Users who sent an event type in a day: terms that share posts."""
    return events(spark, sf).select((F.col("ts") - F.col("ts") % 86400).alias("window"), F.col("subject").alias("term"), F.col("did").alias("post")).distinct()


@_query(f"""{_EV}, p AS (SELECT DISTINCT ts - ts % 86400 AS win, subject, user_id FROM u), n AS (SELECT win, subject, count(*) AS n FROM p GROUP BY 1, 2),
b AS (SELECT x.win, x.subject AS a, y.subject AS b, count(*) AS shared FROM p x JOIN p y ON x.win = y.win AND x.user_id = y.user_id AND x.subject < y.subject GROUP BY 1, 2, 3)
SELECT b.win AS "window", a, b, shared, round(shared::DOUBLE / least(i.n, j.n), 6) AS weight FROM b JOIN n i ON i.win = b.win AND i.subject = a JOIN n j ON j.win = b.win AND j.subject = b WHERE shared::DOUBLE / least(i.n, j.n) >= 0.35""")
def cooccurrence_edges(spark, sf):
    return stories.edges(_hashtag_posts(spark, sf)).withColumn("weight", F.round("weight", 6))


@_query(None)
def communities(spark, sf):
    return stories.communities(_hashtag_posts(spark, sf)).withColumn("terms", F.array_join("terms", ","))


@_query(None)
def story_chains(spark, sf):
    found = stories.communities(_hashtag_posts(spark, sf))
    rows = found.select(F.lit("fast").alias("mode"), F.col("window").alias("start"), "terms", F.size("terms").cast("bigint").alias("hits"), F.lit(1.0).alias("zscore"))
    return stories.chain(rows, 86400).withColumn("terms", F.array_join("terms", ","))


@_query(None)
def minhash_signature(spark, sf):
    return posts(spark, sf).select("doc_id", T.signature(F.col("text")).alias("sig"))


@_query(None)
def first_story(spark, sf):
    """A language's posts in a bucket stand for a story; all posts of the six buckets before it are the background."""
    width = FAST.units * 60
    rows = posts(spark, sf).where("ts is not null").select((F.col("ts") - F.col("ts") % width).alias("bucket"), "lang", "ts", "doc_id", T.signature(F.col("text")).alias("sig")).persist()  # signatures are made once
    mode, lang = F.lit(FAST.name).alias("mode"), F.coalesce("lang", F.lit(""))
    candidates = rows.select(mode, "bucket", F.concat_ws("@", lang, "bucket").alias("story"), F.col("doc_id").alias("id"), F.col("ts").alias("rank"), "sig")
    background = rows.select(mode, F.explode(F.sequence(F.col("bucket") + width, F.col("bucket") + 6 * width, F.lit(width))).alias("bucket"), "sig")
    return stories.first_story(candidates, background, ("mode", "bucket", "story")).drop("bucket")


@_query(f"""{_WORDS}, g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1]) END) AS s FROM w)
SELECT doc_id, count(*) AS n_shingles, min(s) AS first_shingle FROM g GROUP BY doc_id""")
def shingle_sets(spark, sf):
    rows = posts(spark, sf).groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    rows = rows.select("doc_id", _extent(_all_of("texts", T.shingles)).alias("t"))
    return rows.groupBy("doc_id").agg(F.sum("t.n").alias("n_shingles"), F.min("t.first").alias("first_shingle")).where("n_shingles > 0")


def _labelled(spark, sf) -> DataFrame:
    series = _series(spark, sf, FAST)
    return model.persistence(series, detector.score(series, FAST))


@_query(f"""{_scored_sql(FAST)}, a AS (SELECT subject, start, list(share) OVER (PARTITION BY subject ORDER BY start ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS ahead FROM s WHERE coverage >= 0.8)
SELECT z.subject, z.start, CASE WHEN len(a.ahead) = 3 AND share - baseline > 0 THEN (len(list_filter(a.ahead, lambda x: x - baseline >= 0.5 * (share - baseline))) >= 2)::INT END AS label FROM z JOIN a ON a.subject = z.subject AND a.start = z.start""")
def persistence_label(spark, sf):
    return _labelled(spark, sf).select("subject", "start", "label")


@_query(f"""{_scored_sql(FAST)}, d AS (SELECT subject, start, coalesce(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY subject ORDER BY start ROWS BETWEEN 32 PRECEDING AND 1 PRECEDING), 0.0) AS density FROM s WHERE coverage >= 0.8)
SELECT z.subject, z.start, round(ln(1 + hits), 6) AS log_hits, round(share * 1000, 6) AS share_per_mille, round(ln(1 + total), 6) AS log_window_posts, round(density, 6) AS history_density, round(sin(floor(z.start / 3600) % 24 * 2 * pi() / 24), 6) AS hour_sin, contains(z.subject, ' ')::INT AS is_multiword
FROM z JOIN d ON d.subject = z.subject AND d.start = z.start""")
def spike_features(spark, sf):
    from pyspark.sql import Window

    series = _series(spark, sf, FAST)
    dens = series.where("coverage >= 0.8").withColumn("history_density", model.density(Window.partitionBy("subject").orderBy("start"))).select("subject", "start", "history_density")
    rows = model.features(detector.score(series, FAST).join(dens, ["subject", "start"]), 4, "topic")
    return rows.select("subject", "start", *[F.round(c, 6).alias(c) for c in ("log_hits", "share_per_mille", "log_window_posts", "history_density", "hour_sin")], F.col("is_multiword").cast("int").alias("is_multiword"))


@_query(f"{_scored_sql(FAST)} SELECT feature, round(mean, 6) AS mean, round(std, 6) AS std FROM (SELECT 'hits' AS feature, avg(hits) AS mean, stddev_pop(hits) AS std FROM z UNION ALL SELECT 'zscore', avg(zscore), stddev_pop(zscore) FROM z)")
def standardizer(spark, sf):
    rows = detector.score(_series(spark, sf, FAST), FAST)
    return model.standardizer(rows, ["hits", "zscore"]).select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@_query("""WITH r AS (SELECT n_chars AS s, quality AS y FROM documents JOIN labels USING (doc_id)), p AS (SELECT s FROM r WHERE y = 1), n AS (SELECT s FROM r WHERE y = 0)
SELECT round(CASE WHEN (SELECT count(*) FROM p) * (SELECT count(*) FROM n) = 0 THEN 0.5 ELSE (SELECT sum(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0 END) FROM p CROSS JOIN n) / ((SELECT count(*) FROM p) * (SELECT count(*) FROM n)) END, 9) AS auc""")
def auc(spark, sf):
    rows = _read(spark, sf, "documents", "doc_id", "n_chars").join(_read(spark, sf, "labels", "doc_id", "quality"), "doc_id")
    return model.auc(rows.select(F.col("n_chars").alias("score"), F.col("quality").alias("label"))).select(F.round("auc", 9).alias("auc"))


@_query(None)
def model_weights(spark, sf):
    rows = _labelled(spark, sf).where("label is not null")
    m = model.train(rows, ["hits", "zscore", "multiple"])
    return spark.createDataFrame(list(zip(m["columns"], m["weights"])), "feature string, weight double")


_ALERTS = f"{_scored_sql(FAST)}, al AS (SELECT start AS bucket, subject, 'fast' AS mode, 'topic' AS kind, round(zscore, 6) AS zscore, CASE WHEN hits % 3 <> 0 THEN hits % 7 END AS confidence FROM z WHERE zscore >= 1 AND share > baseline)"


def _alerts(spark, sf) -> DataFrame:
    rows = detector.score(_series(spark, sf, FAST), FAST).where(detector.is_spike(FAST, 1.0))
    return rows.select(F.col("start").alias("bucket"), "subject", F.lit("fast").alias("mode"), F.lit("topic").alias("kind"), F.round("zscore", 6).alias("zscore"), F.when(F.col("hits") % 3 != 0, F.col("hits") % 7).alias("confidence"))


@_query(f"{_ALERTS.replace('zscore >= 1 AND', 'zscore >= 1 AND hits >= 5 AND')} SELECT * FROM al ORDER BY confidence DESC NULLS LAST, bucket DESC, subject LIMIT 50")
def alerts_by_confidence(spark, sf):
    return tables.list_alerts(_alerts(spark, sf), 50, "confidence")


@_query(f"{_ALERTS.replace('zscore >= 1 AND', 'zscore >= 1 AND hits >= 5 AND')} SELECT mode, kind, count(*) AS n FROM al GROUP BY 1, 2")
def counts_by_mode(spark, sf):
    return _alerts(spark, sf).groupBy("mode", "kind").agg(F.count("*").alias("n"))


@_query(f"{_ALERTS.replace('zscore >= 1 AND', 'zscore >= 1 AND hits >= 5 AND')} SELECT * FROM al WHERE confidence IS NULL OR confidence >= 3")
def anti_insert(spark, sf):
    rows = _alerts(spark, sf)
    return tables.new_alerts(rows.where("confidence < 3"), rows)


@_query("""WITH o AS (SELECT o_custkey AS key, min(o_orderkey) AS first_bucket, max(o_orderkey) AS last_bucket, count(*) AS hits FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), n AS (SELECT o_custkey AS key, min(o_orderkey) AS first_bucket, max(o_orderkey) AS last_bucket, count(*) AS hits FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT coalesce(o.key, n.key)::VARCHAR AS key, least(o.first_bucket, n.first_bucket) AS first_bucket, greatest(o.last_bucket, n.last_bucket) AS last_bucket, greatest(o.hits, n.hits) AS hits FROM o FULL JOIN n ON o.key = n.key""")
def merge_events(spark, sf):
    rows = _read(spark, sf, "orders", "o_orderkey", "o_custkey")

    def part(odd: int) -> DataFrame:
        return rows.where(F.col("o_orderkey") % 2 == odd).groupBy(F.col("o_custkey").cast("string").alias("key")).agg(F.lit("fast").alias("mode"), F.min("o_orderkey").alias("first_bucket"), F.max("o_orderkey").alias("last_bucket"), F.count("*").alias("hits"))

    return tables.merge_events(part(0), part(1)).drop("mode")


_TREND = rf"""{_scored_sql(FAST)}, al AS (SELECT start AS bucket, subject, lower(subject) AS plain, zscore, ['the', lower(subject)] AS terms FROM z WHERE zscore >= 1 AND hits >= 5 AND share > baseline),
tw AS (SELECT item_id AS topic, (SELECT min(start) FROM z) + item_id * 7200 AS first_seen, regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(lower(text || ' ' || ['#click view', 'purchase error', 'none'][1 + item_id % 3]), 'https?://\S+', ' ', 'g'), '[\p{{L}}\p{{N}}_-]+(?:\.[\p{{L}}\p{{N}}_-]+)+(?:/\S*)?', ' ', 'g'), '@[\p{{L}}\p{{N}}_.-]+', ' ', 'g'), '#?[a-z][a-z0-9''’_-]{{1,29}}') AS ws FROM benchmark),
tr AS (SELECT topic, first_seen, list_distinct(list_filter(ws, lambda w: length(w) >= 3 AND w NOT IN ({_list(STOPWORDS)})) || list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1])) AS wanted FROM tw),
hh AS (SELECT tr.*, al.*, len(list_intersect(list_distinct(al.terms), wanted)) AS o FROM tr JOIN al ON first_seen - bucket BETWEEN -21600 AND 86400),
g AS (SELECT *, list_contains(wanted, plain) AND (contains(plain, ' ') OR o >= 1) AS s FROM hh),
m AS (SELECT topic, arg_min(bucket, (bucket, -zscore, subject)) AS bucket, arg_min(subject, (bucket, -zscore, subject)) AS subject, arg_min(CASE WHEN s THEN 'subject' ELSE 'terms' END, (bucket, -zscore, subject)) AS basis FROM g WHERE s OR o >= 2 GROUP BY 1),
r AS (SELECT tr.topic, first_seen, m.subject, m.basis, round_even((first_seen - m.bucket) / 60.0, 0)::DOUBLE AS lead_minutes FROM tr LEFT JOIN m USING (topic))"""


def _trend_report(spark, sf) -> DataFrame:
    """Benchmark items stand for trends: their texts and a few event types are what they are about."""
    scored = detector.score(_series(spark, sf, FAST), FAST)
    start = scored.agg(F.min("start").alias("s"))
    more = F.element_at(F.array(*map(F.lit, ["#click view", "purchase error", "none"])), (F.col("item_id") % 3 + 1).cast("int"))
    text = F.concat_ws(" ", "text", more)
    trends = _read(spark, sf, "benchmark", "item_id", "text").crossJoin(F.broadcast(start)).select(F.col("item_id").alias("topic"), (F.col("s") + F.col("item_id") * 7200).alias("first_seen"), T.trend_tokens(text).alias("wanted"))
    alerts = scored.where(detector.is_spike(FAST, 1.0)).select(F.col("start").alias("bucket"), "subject", F.array(F.lit("The"), F.concat(F.lit("#"), "subject")).alias("terms"), "zscore")
    return tables.trend_report(trends, alerts)


@_query(f"{_TREND} SELECT * FROM r")
def trend_benchmark(spark, sf):
    return _trend_report(spark, sf).withColumn("lead_minutes", F.col("lead_minutes").cast("double"))


@_query(f"{_TREND} SELECT count(*) AS trends_tracked, count(subject) AS matched, round_even(count(subject)::DOUBLE / count(*), 3) AS coverage, round_even(median(lead_minutes), 1) AS median_lead_minutes, max(lead_minutes)::BIGINT AS best_lead_minutes FROM r")
def benchmark_report(spark, sf):
    return tables.trend_summary(_trend_report(spark, sf))


def _hits_of(spark, sf) -> tuple[DataFrame, dict[str, DataFrame]]:
    e = events(spark, sf)
    return counters.totals(e), {"topic": counters.topic_hits(e), "term": counters.term_hits(e)}


def _runs_sql(columns: str, where: str) -> str:
    parts = []
    for h in config.HORIZONS.values():
        for kind, count in (("topic", "count(*)"), ("term", "count(DISTINCT user_id)")):
            sql = _scored_sql(h)
            if kind == "term":  # distinct authors in each unit; subjects with few hits are no candidates
                sql = sql.replace("h AS (SELECT subject, unit - unit", f"hu AS (SELECT unit, subject, {count} AS n FROM u GROUP BY 1, 2), h AS (SELECT subject, unit - unit").replace("count(*) AS hits FROM u GROUP BY 1, 2)", "sum(n)::BIGINT AS hits FROM hu GROUP BY 1, 2)")
                sql = sql.replace("(SELECT DISTINCT subject FROM u)", f"(SELECT subject FROM hu GROUP BY 1 HAVING sum(n) >= {h.min_hits * config.CANDIDATE_MULTIPLE})")
            parts.append(f"SELECT * FROM ({sql.format(mode=h.name)} SELECT '{h.name}' AS mode, '{kind}' AS kind, {columns} FROM z WHERE {where.format(h=h)} AND (SELECT count(DISTINCT unit) FROM u) >= {h.warmup})")
    return " UNION ALL ".join(parts)


@_query(_runs_sql("subject, start, hits, total, round(zscore, 6) AS zscore", "zscore >= 2 AND hits >= {h.min_hits} AND share > baseline"))
def detection_runs(spark, sf):
    """All horizons and kinds, at a threshold that these quiet tables reach."""
    rows = passes.run(*_hits_of(spark, sf), UNIT, z=2.0)
    return rows.select("mode", "kind", "subject", "start", "hits", "total", F.round("zscore", 6).alias("zscore"))


@_query(None)
def training_set(spark, sf):
    """Spikes of all horizons and kinds with label and all features."""
    rows = passes.dataset(*_hits_of(spark, sf), UNIT, z=1.0)
    return rows.select("mode", "kind", "subject", "start", "label", *[F.round(c, 6).alias(c) for c in model.FEATURES])


@_query(f"{_ALERTS.replace('zscore >= 1 AND', 'zscore >= 1 AND hits >= 5 AND')}, tt AS (SELECT count(DISTINCT unit) AS minutes FROM u), k(mode, warmup) AS (VALUES ('fast', 60::BIGINT), ('mid', 240::BIGINT), ('deep', 540::BIGINT)) SELECT mode, warmup, minutes, minutes >= warmup AS ready, greatest(0, warmup - minutes)::BIGINT AS minutes_remaining, (SELECT count(*) FROM al WHERE al.mode = k.mode) AS alerts FROM k CROSS JOIN tt")
def horizons_and_alerts(spark, sf):
    return reads.horizons(counters.totals(events(spark, sf)), _alerts(spark, sf))


@_query(f"{_EV} SELECT count(DISTINCT unit) AS minutes_collected, round_even(count(DISTINCT unit) / 60, 2) AS hours_collected, count(*) AS posts_scanned, min(unit) AS first_minute, max(unit) AS last_minute, true AS collecting, 4000000000 - max(unit) AS lag_seconds, count(DISTINCT unit) >= 60 AS ready_for_detection, greatest(0, 60 - count(DISTINCT unit)) AS minutes_needed, count(DISTINCT subject) AS terms, (SELECT count(*) FROM documents) AS samples FROM u")
def corpus_stats(spark, sf):
    e = events(spark, sf)
    return reads.stats(counters.totals(e), 4000000000, 4000000000 - 10, terms=e.select(F.col("subject").alias("term")), samples=_read(spark, sf, "documents", "doc_id"))


@_query(f"{_EV}, k(name) AS (VALUES ('click'), ('view'), ('never')) SELECT name, (SELECT count(*) FROM u WHERE subject = name) AS total_hits FROM k")
def topic_totals(spark, sf):
    return reads.topics(spark.createDataFrame([("click",), ("view",), ("never",)], "name string"), counters.topic_hits(events(spark, sf)))


@_query(f"{_frame_sql(FAST)} SELECT start AS t, hits, total, round(share, 9) AS share, round_even(coverage, 3) AS coverage FROM (SELECT *, row_number() OVER (ORDER BY start DESC) AS r FROM s WHERE subject = 'click') WHERE r <= 20")
def topic_series(spark, sf):
    return reads.series(_series(spark, sf, FAST), "click", 20).withColumn("share", F.round("share", 9))


_SHOWN = "ts, did, doc_id::VARCHAR AS rkey, lang, substr(text, 1, 500) AS text, 'https://bsky.app/profile/' || did || '/post/' || doc_id AS url"


def _samples(spark, sf) -> DataFrame:
    return posts(spark, sf).select("ts", "did", F.col("doc_id").cast("string").alias("rkey"), "lang", "text", F.col("lang").alias("subject"), F.lit("").alias("links"))


@_query(f"{_PO} SELECT {_SHOWN} FROM d WHERE ts >= {DOC_TIME + 60} AND ts < {DOC_TIME + 1200} AND contains(lower(text), 'tion') ORDER BY ts, doc_id::VARCHAR LIMIT 40")
def term_posts(spark, sf):
    return reads.term_posts(_samples(spark, sf), "#Tion", 40, 0, DOC_TIME + 60, DOC_TIME + 1200)


@_query(f"{_PO} SELECT {_SHOWN} FROM d WHERE lang = 'de' ORDER BY ts DESC, doc_id::VARCHAR LIMIT 30")
def topic_posts(spark, sf):
    return reads.topic_posts(_samples(spark, sf), "de", 30)


def _language_spikes(spark, sf) -> DataFrame:
    """A language's posts in every fourth bucket stand for a spike."""
    width = FAST.units * 60
    rows = _samples(spark, sf).where("ts is not null and subject is not null").select("subject", (F.col("ts") - F.col("ts") % width).alias("start")).distinct().where(F.col("start") / width % 4 == 0)
    return rows.select(F.concat_ws("@", "subject", "start").alias("spike"), "subject", "start", (F.col("start") + width).alias("end"))


@_query(f"""{_PO}, p AS (SELECT ts, lang, doc_id::VARCHAR AS rkey FROM d WHERE lang IS NOT NULL), k AS (SELECT DISTINCT lang, ts - ts % 240 AS start FROM p WHERE (ts - ts % 240) / 240 % 4 = 0),
j AS (SELECT k.lang || '@' || start AS spike, rkey, ts, ts < start - 720 AS b FROM k JOIN p ON p.lang = k.lang AND (ts < start - 720 OR ts >= start + 240 + 720)),
n AS (SELECT *, row_number() OVER (PARTITION BY spike, b ORDER BY CASE WHEN b THEN -ts ELSE ts END, rkey) AS r, least(count(*) FILTER (b) OVER (PARTITION BY spike), 40) AS nb FROM j)
SELECT spike, count(*) FILTER (b) AS before, count(*) FILTER (NOT b) AS after, min(ts) AS first_ts, max(ts) AS last_ts FROM n WHERE CASE WHEN b THEN r <= 40 ELSE nb < 20 AND r <= 40 - nb END GROUP BY spike""")
def spike_contrast(spark, sf):
    rows = explain.outside(_language_spikes(spark, sf), _samples(spark, sf), config.CONTRAST_GUARD * FAST.units * 60, 40)
    return rows.groupBy("spike").agg(F.count_if("before").alias("before"), F.count_if(~F.col("before")).alias("after"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@_query(None)
def explained_spikes(spark, sf):
    found = explain.explained(_language_spikes(spark, sf), _samples(spark, sf), config.CONTRAST_GUARD * FAST.units * 60)
    return found.select("spike", F.array_join("terms", ",").alias("terms"), F.array_join("links", " ").alias("links"))


@_query("""WITH m AS (SELECT o_custkey % 50 AS cluster, o_orderkey::VARCHAR AS subject, o_orderkey % 7 + 1 AS hits, o_totalprice AS zscore, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 2 END AS confidence FROM orders)
SELECT cluster, sum(hits)::BIGINT AS hits, max(zscore) AS zscore, arg_min(subject, (-zscore, subject)) AS peak, max(confidence) AS confidence, count(DISTINCT subject) AS n_terms FROM m GROUP BY cluster""")
def story_members(spark, sf):
    rows = _read(spark, sf, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    rows = rows.select(F.lit("fast").alias("mode"), F.lit(0).alias("start"), (F.col("o_custkey") % 50).alias("cluster"), F.col("o_orderkey").cast("string").alias("subject"), (F.col("o_orderkey") % 7 + 1).cast("bigint").alias("hits"), F.col("o_totalprice").alias("zscore"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") / 2).alias("confidence"), F.lit("").alias("links"))
    return stories.cluster_alerts(rows).select("cluster", "hits", "zscore", "peak", "confidence", F.size("terms").cast("bigint").alias("n_terms"))


_ORDERS = "WITH e AS (SELECT o_custkey::VARCHAR AS key, 'fast' AS mode, max(o_orderkey) AS last_bucket, max(o_totalprice) AS zscore FROM orders GROUP BY 1)"


@_query(f"{_ORDERS} SELECT * FROM e ORDER BY last_bucket DESC, zscore DESC, key LIMIT 60")
def events_list(spark, sf):
    rows = _read(spark, sf, "orders", "o_custkey", "o_orderkey", "o_totalprice").groupBy(F.col("o_custkey").cast("string").alias("key")).agg(F.lit("fast").alias("mode"), F.max("o_orderkey").alias("last_bucket"), F.max("o_totalprice").alias("zscore"))
    return tables.list_events(rows, 60, "fast")


@_query("SELECT item_id AS topic, 7 * (item_id % 5) AS first_seen FROM benchmark ORDER BY 2 DESC, 1 LIMIT 20")
def trends_list(spark, sf):
    return tables.list_trends(_read(spark, sf, "benchmark", "item_id").select(F.col("item_id").alias("topic"), (F.col("item_id") % 5 * 7).alias("first_seen")), 20)


@_query(f"{_ALERTS.replace('zscore >= 1 AND', 'zscore >= 1 AND hits >= 5 AND')} SELECT * FROM al ORDER BY bucket DESC, zscore DESC, subject LIMIT 50")
def alerts_recent(spark, sf):
    return tables.list_alerts(_alerts(spark, sf), 50, subject="", kind="topic")


@_query(f"{_EV} SELECT subject, unit, count(*) FILTER (user_id % 2 = 0) + count(*) FILTER (user_id % 2 = 1) AS hits FROM u GROUP BY 1, 2")
def added_counts(spark, sf):
    e = events(spark, sf).withColumn("odd", F.col("did").cast("bigint") % 2)
    return tables.add_counts(counters.topic_hits(e.where("odd = 0")), counters.topic_hits(e.where("odd = 1")), ["subject", "unit"], "hits")


@_query("SELECT item_id AS topic, CASE WHEN item_id % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS first_seen, CASE WHEN item_id % 3 = 0 THEN 20 ELSE 10 END::BIGINT AS last_seen FROM benchmark WHERE item_id % 2 = 0 OR item_id % 3 = 0")
def merged_trends(spark, sf):
    rows = _read(spark, sf, "benchmark", "item_id").select(F.col("item_id").alias("topic"))
    old = rows.where("topic % 2 = 0").select("topic", F.lit(1).cast("bigint").alias("first_seen"), F.lit(10).cast("bigint").alias("last_seen"))
    new = rows.where("topic % 3 = 0").select("topic", F.lit(2).cast("bigint").alias("first_seen"), F.lit(20).cast("bigint").alias("last_seen"))
    return tables.merge_trends(old, new)


@_query(f"{_PO} SELECT count(*) AS kept, min(ts) AS first_ts FROM d WHERE ts >= {DOC_TIME + 3000}")
def retained_samples(spark, sf):
    rows = tables.retained({"samples": posts(spark, sf)}, DOC_TIME + 43200 + 3000)["samples"]
    return rows.agg(F.count("*").alias("kept"), F.min("ts").alias("first_ts"))


@_query("SELECT avg(((n_chars > 500) = (quality = 1))::INT)::DOUBLE AS accuracy FROM documents JOIN labels USING (doc_id)")
def accuracy(spark, sf):
    rows = _read(spark, sf, "documents", "doc_id", "n_chars").join(_read(spark, sf, "labels", "doc_id", "quality"), "doc_id")
    return model.accuracy(rows.select((F.col("n_chars") > 500).cast("double").alias("score"), F.col("quality").alias("label")))


def queries() -> dict:
    return {k: f for k, (f, _) in _Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _Q.items() if s}
