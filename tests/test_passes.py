"""Whole passes against brute force in plain Python."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from murmurate import config
from murmurate.operators import explain, model, passes

MINUTES = 400


@pytest.fixture(scope="module")
def counts():
    rng = random.Random(5)
    totals = [rng.randrange(900, 1100) for _ in range(MINUTES)]
    hits = {}
    for kind, subject in (("topic", "weather"), ("term", "#storm"), ("term", "power cut")):
        row = [rng.choice([0, 0, 1, 2, 3]) for _ in range(MINUTES)]
        for at, long_ in ((130, 4), (200, 40), (300, 8), (MINUTES - 4, 4)):
            for i in range(at, min(MINUTES, at + long_)):
                row[i] += rng.randrange(60, 90)
        hits[kind, subject] = row
    return totals, hits


def known_spikes(counts):
    """(mode, kind, subject, start): label and features, one bucket after the other."""
    totals, hits = counts
    out = {}
    for mode in ("fast", "mid"):  # 400 minutes are too few for the third horizon
        h = config.HORIZONS[mode]
        for (kind, subject), row in hits.items():
            n = [sum(row[i : i + h.units]) for i in range(0, MINUTES, h.units)]
            total = [sum(totals[i : i + h.units]) for i in range(0, MINUTES, h.units)]
            share = [a / b for a, b in zip(n, total)]
            for i in range(h.window + h.gap, len(n)):
                past = share[i - h.gap - h.window : i - h.gap]
                base = statistics.median(past)
                spread = config.MAD_TO_SIGMA * statistics.median(abs(x - base) for x in past)
                z = (share[i] - base) / max(spread, math.sqrt(max(base, 1 / total[i]) / total[i]))
                ahead = share[i + 1 : i + 1 + config.LOOKAHEAD]
                if z < h.z or n[i] < h.min_hits or share[i] <= base or len(ahead) < config.LOOKAHEAD:
                    continue
                label = int(sum(x - base >= config.SUSTAIN * (share[i] - base) for x in ahead) >= config.MIN_SUSTAINED)
                start = i * h.units * 60
                before = n[max(0, i - config.PRIOR) : i]
                angle = 2 * math.pi * (start // 3600 % 24) / 24
                out[mode, kind, subject, start] = label, {
                    "log_hits": math.log1p(n[i]), "zscore": min(z, config.Z_CAP), "log_multiple": math.log1p(share[i] / base if base > 0 else 0), "baseline_silent": float(base <= 0),
                    "share_per_mille": share[i] * 1000, "coverage": 1.0, "is_term": float(kind == "term"), "is_multiword": float(" " in subject), "is_hashtag": float(subject[0] == "#"),
                    "n_terms": 0.0, "n_links": 0.0, "log_bucket_minutes": math.log1p(h.units), "history_density": sum(x > 0 for x in before) / len(before), "log_window_posts": math.log1p(total[i]),
                    "hour_sin": math.sin(angle), "hour_cos": math.cos(angle),
                }
    return out


def frames(spark, counts):
    totals, hits = counts
    t = spark.createDataFrame([(i * 60, n) for i, n in enumerate(totals)], "unit bigint, posts bigint")
    of = {}
    for kind in ("topic", "term"):
        rows = [(i * 60, subject, n) for (k, subject), row in hits.items() if k == kind for i, n in enumerate(row) if n]
        of[kind] = spark.createDataFrame(rows, "unit bigint, subject string, hits bigint")
    return t, of


def test_training_set_is_every_spike_with_a_future(spark, counts):
    want = known_spikes(counts)
    got = {(r.mode, r.kind, r.subject, r.start): r for r in passes.dataset(*frames(spark, counts)).collect()}
    assert {v for v, _ in want.values()} == {0, 1} and {k[0] for k in want} == {"fast", "mid"}
    assert set(got) == set(want)
    for key, (label, features) in want.items():
        assert got[key].label == label and list(features) == model.FEATURES
        for name, value in features.items():
            assert got[key][name] == pytest.approx(value, abs=1e-9), (key, name)


def test_training_set_counts_terms_and_links(spark, counts):
    mode, kind, subject, start = min(known_spikes(counts))
    told = spark.createDataFrame([(mode, kind, subject, start, ["a", "b"], ["http://x"])], "mode string, kind string, subject string, start bigint, terms array<string>, links array<string>")
    rows = passes.dataset(*frames(spark, counts), explained=told).collect()
    assert len(rows) == len(known_spikes(counts))
    (own,) = [r for r in rows if (r.mode, r.kind, r.subject, r.start) == (mode, kind, subject, start)]
    assert (own.n_terms, own.n_links) == (2.0, 1.0)
    assert all(r.n_terms == 0 and r.n_links == 0 for r in rows if r is not own)


def test_explained_spikes_against_brute_force(spark):
    guard, limit = 30, 6
    rng = random.Random(8)
    vocabulary = ["bridge", "collapse", "river", "garden", "music", "coffee", "train", "window", "summer"]
    posts = []
    for subject in ("north", "south", "east"):
        for i in range(60):
            ts = rng.randrange(0, 1000)
            words = rng.sample(vocabulary[2:], 3) + (vocabulary[:2] if 400 <= ts < 500 else [])
            links = " ".join(rng.choice(["http://a", "http://b", "http://c", "http://d"]) for _ in range(rng.randrange(3)))
            posts.append((subject, ts, f"{subject}{i:02}", " ".join(words), links))
    spikes = [(1, "north", 400, 500), (2, "south", 400, 500), (3, "north", 0, 100), (4, "nowhere", 400, 500)]
    want = {}
    for spike, subject, start, end in spikes:
        own = [p for p in posts if p[0] == subject]
        here = [p for p in own if start <= p[1] < end]
        there = sorted((p for p in own if p[1] < start - guard), key=lambda p: (p[1], p[2]), reverse=True)[:limit]
        if len(there) < limit // 2:
            there += sorted((p for p in own if p[1] >= end + guard), key=lambda p: (p[1], p[2]))[: limit - len(there)]
        inside, outside = ([w for p in rows for w in p[3].split()] for rows in (here, there))
        lift = {w: (inside.count(w) / max(1, len(inside))) / (outside.count(w) / max(1, len(outside)) + 1e-9) for w in set(inside)}
        terms = sorted((w for w in lift if inside.count(w) >= config.MIN_TERM_OCCURRENCES and lift[w] >= config.MIN_LIFT), key=lambda w: (lift[w], w), reverse=True)[: config.TERM_LIMIT]
        linked = [set(p[4].split()) for p in here if p[4]]
        n = {u: sum(u in x for x in linked) for x in linked for u in x}
        floor = max(2, int(len(linked) * config.MIN_LINK_SHARE))
        want[spike] = terms, [u for u in sorted(n, key=lambda u: (-n[u], u))[: config.LINK_LIMIT] if n[u] >= floor]
    got = explain.explained(
        spark.createDataFrame(spikes, "spike int, subject string, start bigint, end bigint"), spark.createDataFrame(posts, "subject string, ts bigint, rkey string, text string, links string"), guard, limit
    ).collect()
    assert {r.spike: (r.terms, r.links) for r in got} == want
    assert "bridge" in want[1][0] and want[1][1] and want[4] == ([], [])


def test_passes_of_nothing(spark):
    t = spark.createDataFrame([], "unit bigint, posts bigint")
    hits = spark.createDataFrame([], "unit bigint, subject string, hits bigint")
    assert passes.run(t, {"topic": hits}).count() == 0 and passes.dataset(t, {"term": hits}).select(F.count("*")).first()[0] == 0
