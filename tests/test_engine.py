import json
import statistics
import zlib

import pytest
from pyspark.sql import functions as F

from murmurate import config
from murmurate.functions import text as T
from murmurate.operators import counters, detector, explain, model, stories, tables
from murmurate.sources import posts as P
from murmurate.streaming import ingest

H = config.Horizon("test", 15, 10, 1, 4.0, 5)


def series(spark, hits, totals=None, coverage=None):
    totals, coverage = totals or {}, coverage or {}
    rows = [("s", i * 900, h, totals.get(i, 10000), coverage.get(i, 1.0)) for i, h in enumerate(hits)]
    return spark.createDataFrame(rows, "subject string, start bigint, hits bigint, total bigint, coverage double").withColumn("share", F.col("hits") / F.col("total"))


def spikes(spark, base, at, h=H, **more):
    hits = [base] * 30
    hits[25] = at
    return detector.score(series(spark, hits, **more), h).where(detector.is_spike(h)).collect()


def test_planted_spikes(spark):
    assert spikes(spark, 20, 20) == []
    (hit,) = spikes(spark, 20, 400)
    assert hit.start == 25 * 900 and hit.multiple > 15
    assert spikes(spark, 2, 9, config.Horizon("x", 15, 10, 1, 4.0, 25)) == []
    assert spikes(spark, 20, 400, coverage={25: 0.2}) == []
    assert spikes(spark, 20, 200, totals={25: 100000}) == []
    (low,), (high,) = spikes(spark, 0, 8), spikes(spark, 0, 80)
    assert low.zscore < 100 and high.zscore > low.zscore


def test_score_is_the_formula(spark):
    import random

    rng = random.Random(3)
    hits = [rng.randrange(0, 60) for _ in range(80)]
    got = {r.start: r for r in detector.score(series(spark, hits), H).collect()}
    share = [h / 10000 for h in hits]
    for i in range(11, 80):
        base = share[i - 11 : i - 1]
        c = statistics.median(base)
        sigma = max(1.4826 * statistics.median(abs(x - c) for x in base), (max(c, 1 / 10000) / 10000) ** 0.5)
        assert got[i * 900].zscore == pytest.approx((share[i] - c) / sigma, abs=1e-9)
    assert len(got) == 69


def test_warmup_and_unknown_horizon():
    assert [config.HORIZONS[n].warmup for n in ("fast", "mid", "deep")] == [60, 240, 540]
    with pytest.raises(ValueError):
        config.horizon("other")


def test_topics(spark):
    topics = [{"name": "ai", "phrases": [" AI "], "langs": ["en"]}, {"name": "cup", "phrases": ["world cup"], "langs": []}]
    rows = [("AI.", "en"), ("J'ai", "fr"), ("J’ai", None), ("(AI) at the World Cup", None), ("said", "en"), ("AI", "fr"), ("éai", "en")]
    df = spark.createDataFrame(rows, "text string, lang string")
    assert [r[0] for r in df.select(T.matched_topics(F.col("text"), F.col("lang"), topics)).collect()] == [["ai"], [], [], ["ai", "cup"], [], [], []]


def test_terms(spark):
    rows = [("See https://x.org/a www.site.com @someone the bridge closed today #Traffic", ["Quake"])]
    df = spark.createDataFrame(rows, "text string, tags array<string>")
    got = set(df.select(T.extract_terms(F.col("text"), F.col("tags"))).first()[0])
    assert {"bridge", "closed", "bridge closed", "#traffic", "#quake", "see"} <= got
    assert not got & {"the", "today", "com", "someone", "x", "site"}


def test_distinct_authors(spark):
    rows = [(0, "a", "t")] * 50 + [(0, str(i), "u") for i in range(5)] + [(0, "", "v"), (0, None, "v")]
    df = spark.createDataFrame(rows, "unit bigint, did string, subject string")
    assert {r.subject: r.hits for r in counters.term_hits(df).collect()} == {"t": 1, "u": 5, "v": 2}


def test_links(spark):
    rows = [(1, "http://a")] * 20 + [(1, "http://b")] + [(2, "")]
    got = explain.top_links(spark.createDataFrame(rows, "spike int, links string")).collect()
    assert [(r.spike, r.url, r.n) for r in got] == [(1, "http://a", 20)]


def test_distinctive(spark):
    rows = [(1, True, t) for t in ["bridge collapsed downtown", "the bridge collapsed"] * 3] + [(1, False, t) for t in ["nice weather", "good game", "bridge traffic"] * 20]
    got = explain.distinctive(spark.createDataFrame(rows, "spike int, inside boolean, text string")).collect()
    assert "collapsed" in [r.word for r in got]


def test_minhash(spark):
    df = spark.createDataFrame([(["ab", "é c", "x"],), ([],)], "items array<string>")
    got = [r[0] for r in df.select(T.minhash(F.col("items"))).collect()]
    assert got[0] == [min(zlib.crc32(x.encode(), s) for x in ["ab", "é c", "x"]) for s in range(64)]
    assert got[1] == [0xFFFFFFFF] * 64


def test_first_story(spark):
    texts = ["quake hits the coast tonight everyone", "quake hits the coast tonight everyone", "a wholly different matter entirely here"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").select("id", F.col("id").alias("rank"), T.minhash(T.shingles(F.col("text"))).alias("sig"))
    assert stories.first_story(df).first().id == 0
    assert {r.id: r.sim for r in stories.nearest(df).collect()}[1] == 1.0


def test_first_story_against_background(spark):
    quake, other, third = "quake hits the coast tonight everyone", "a wholly different matter entirely here", "some third thing nobody has told before"
    sig = T.minhash(T.shingles(F.col("text"))).alias("sig")
    rows = [("a", 0, quake), ("a", 1, other), ("b", 2, quake), ("b", 3, quake), ("c", 4, third), ("c", 5, other)]
    posts = spark.createDataFrame(rows, "story string, id bigint, text string").select(F.lit("fast").alias("mode"), "story", "id", F.col("id").alias("rank"), sig)
    background = spark.createDataFrame([("a", quake), ("b", quake)], "story string, text string").select("story", sig)
    got = stories.first_story(posts, background, ("mode", "story")).collect()
    assert {(r.mode, r.story): (r.id, r.novelty) for r in got} == {("fast", "a"): (1, 1.0), ("fast", "b"): (2, 0.0), ("fast", "c"): (4, 1.0)}
    assert len(got) == 3 and stories.first_story(posts.where("false"), background, ("mode", "story")).count() == stories.first_story(posts.where("false")).count() == 0


def test_communities_and_chains(spark):
    rows = [(w, t, f"{w}-{i}") for w in (0, 240) for i in range(6) for t in ("harbour", "bridge")] + [(0, t, f"q{i}") for i in range(4) for t in ("quake", "jma")]
    got = stories.communities(spark.createDataFrame(rows, "window bigint, term string, post string"))
    assert sorted((r.window, r.terms) for r in got.collect()) == [(0, ["bridge", "harbour"]), (0, ["jma", "quake"]), (240, ["bridge", "harbour"])]
    rows = [("fast", 0, ["a", "b"]), ("fast", 240, ["a", "b", "c"]), ("fast", 90000, ["a", "b"])]
    df = spark.createDataFrame(rows, "mode string, start bigint, terms array<string>").withColumns({"hits": F.lit(5).cast("bigint"), "zscore": F.lit(6.0)})
    out = {r.key: r for r in stories.chain(df, 240).collect()}
    assert out["a+b@0"].buckets == 2 and out["a+b@0"].last_bucket == 240
    assert out["a+b@90000"].recurrence == pytest.approx(0.667) and out["a+b@90000"].recurs_from == "a+b@0"


def test_labels_and_no_look_ahead(spark):
    hits = [2] * 40
    hits[20] = 400
    held = hits[:21] + [380] * 3 + hits[24:]
    for h, want in ((hits, 0), (held, 1)):
        s = series(spark, h, totals={i: 50000 for i in range(40)})
        rows = {r.start: r for r in model.persistence(s, detector.score(s, H)).collect()}
        assert rows[20 * 900].label == want and rows[39 * 900].label is None
    a, b = ({r.start: r.zscore for r in detector.score(series(spark, x, totals={i: 50000 for i in range(40)}), H).collect()}[20 * 900] for x in (hits, held))
    assert a == b


def test_model(spark, tmp_path):
    import random

    rng = random.Random(5)
    rows = [(i, *(x := [rng.gauss(0, 1) for _ in range(3)]), int(x[0] + x[1] + rng.gauss(0, 0.5) > 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "start bigint, a double, b double, c double, label int")
    m, why = model.fit(df, ["a", "b", "c"])
    assert not why and m["holdout_auc"] > 0.85
    assert model.auc(model.predict(df, m)).first().auc > 0.85
    assert {n for n, _ in model.top_factors(m, 2)} == {"a", "b"}
    path = str(tmp_path / "m.json")
    model.save(m, path)
    assert model.load(path)["weights"] == m["weights"] and model.load(path + "x") is None
    assert model.fit(df.limit(100), ["a"])[0] is None


@pytest.mark.parametrize("scores,want", [([(0.9, 1), (0.1, 0)], 1.0), ([(0.1, 1), (0.9, 0)], 0.0), ([(0.5, 1), (0.5, 0)], 0.5), ([(0.5, 1)], 0.5)])
def test_auc(spark, scores, want):
    assert model.auc(spark.createDataFrame(scores, "score double, label int")).first().auc == want


def test_tables(spark):
    old = spark.createDataFrame([("a", "fast", 5, 9, 3, 2.0, None, "first")], "key string, mode string, first_bucket int, last_bucket int, hits int, zscore double, confidence double, story_text string")
    new = spark.createDataFrame([("a", "fast", 7, 12, 2, 4.0, 0.5, "later"), ("b", "fast", 1, 1, 1, 1.0, None, None)], old.schema)
    got = {r.key: r for r in tables.merge_events(old, new).collect()}
    assert tuple(got["a"]) == ("a", "fast", 5, 12, 3, 4.0, 0.5, "first") and got["b"].hits == 1
    legacy = tables.normalize_alerts(spark.createDataFrame([(1, "x", "w")], "bucket int, topic string, novelty string")).first()
    assert (legacy.subject, legacy.terms, legacy.mode, legacy.kind) == ("x", "w", "deep", "topic")
    t = spark.createDataFrame([("q", ["quake"], 100000)], "topic string, wanted array<string>, first_seen bigint")
    a = spark.createDataFrame([(100000 - 1380, "#quake", ["quake"], 5.0), (100000 - 40 * 3600, "#quake", ["quake"], 9.0)], "bucket bigint, subject string, terms array<string>, zscore double")
    assert tables.trend_report(t.withColumn("wanted", F.array(F.lit("quake"), F.lit("#quake"))), a).first().lead_minutes == 23.0


def wire(i, text, **record):
    return json.dumps({"kind": "commit", "did": f"d{i % 3}", "time_us": (1700000000 + 20 * i) * 1_000_000, "commit": {"operation": "create", "collection": P.COLLECTION, "rkey": str(i), "record": {"text": text, **record}}})


def test_wire(spark):
    feats = [{"features": [{"$type": "x#link", "uri": "http://a"}, {"$type": "x#tag", "tag": "T"}]}]
    lines = [wire(0, "hi", langs=["en", "fr"], facets=feats, tags=["T", "U"], embed={"$type": P.EXTERNAL, "external": {"uri": "http://b"}}), wire(1, "  "), wire(2, "yo", langs=[]), "{bad"]
    got = P.parse(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.rkey, r.lang, r.links, r.tags) for r in got] == [("0", "en", ["http://a", "http://b"], ["T", "U"]), ("2", None, [], [])]
    assert P.topics('{"_x": ["a"], "t": ["p"], "u": {"phrases": ["q"], "langs": ["en"]}, "v": 3}') == [{"name": "t", "phrases": ["p"], "langs": []}, {"name": "u", "phrases": ["q"], "langs": ["en"]}]
    row = P.trends(spark.createDataFrame([('{"topic": "", "displayName": "D", "startedAt": "2024-01-01T00:00:00Z"}',)], "value string"), 7).first()
    assert (row.topic, row.started_at, row.first_seen) == ("D", 1704067200, 7)


def test_stream_equals_batch(spark, tmp_path):
    lines = [wire(i, "bridge closed" if i % 2 else "quiet evening") for i in range(60)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines))
    out = str(tmp_path / "out")
    q = ingest.write(ingest.term_hits(P.replay(spark, str(tmp_path / "in"))), out, str(tmp_path / "cp"), once=True)
    q.awaitTermination(120)
    got = {(r.unit, r.subject): r.hits for r in spark.read.parquet(out).collect()}
    rows = counters.with_unit(P.parse(spark.createDataFrame([(x,) for x in lines], "value string")), 60)
    want = {(r.unit, r.subject): r.hits for r in counters.term_hits(rows.withColumn("subject", F.explode(T.extract_terms(F.col("text"), F.col("tags"))))).collect()}
    assert got and all(want[k] == v for k, v in got.items())
