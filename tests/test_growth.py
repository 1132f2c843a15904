"""What has to grow no faster than its input, against brute force."""

import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from murmurate.functions import text as T
from murmurate.operators import counters, explain
from murmurate.plans import queries

GUARD = 30


def stream(spark, n=240):
    rng = random.Random(4)
    words = ["bridge", "collapse", "river", "garden", "music", "coffee", "train"]
    posts = [(rng.choice(["north", "south", None]), rng.choice([None, *range(0, 1000, 3)]), f"p{i:03}", " ".join(rng.choices(words, k=4)), "") for i in range(n)]
    spikes = [(f"{s}@{t}", s, t, t + 60) for s in ("north", "south", "nowhere") for t in range(0, 960, 60)]
    return spikes, posts, spark.createDataFrame(spikes, "spike string, subject string, start bigint, end bigint"), spark.createDataFrame(posts, "subject string, ts bigint, rkey string, text string, links string")


def joins(df):
    return [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]


def test_contrast_is_the_nearest_posts(spark):
    limit = 12
    spikes, posts, s, p = stream(spark)
    want = set()
    for spike, subject, start, end in spikes:
        own = sorted((x for x in posts if x[0] == subject and x[1] is not None), key=lambda x: (x[1], x[2]))
        before = [x for x in own if x[1] < start - GUARD][-limit:]
        after = [x for x in own if x[1] >= end + GUARD][: limit - len(before)] if len(before) < limit // 2 else []
        want |= {(spike, x[2], b) for b, rows in ((True, before), (False, after)) for x in rows}
    got = [(r.spike, r.rkey, r.before) for r in explain.outside(s, p, GUARD, limit).collect()]
    assert len(got) == len(want) and set(got) == want


def test_spikes_do_not_meet_all_posts_of_their_subject(spark):
    """Joined by subject alone, spikes times posts rows would be made."""
    _, _, s, p = stream(spark)
    for df in (explain.outside(s, p, GUARD, 12), explain.explained(s, p, GUARD, 12)):
        found = joins(df)
        assert found and all("chunk#" in x or "block#" in x or "spike#" in x for x in found), found


def test_minhash_of_long_and_missing_items(spark):
    rows = [["ab", None, "é" * 700], [None], None, ["x" * n for n in range(190, 260)], []]
    df = spark.createDataFrame([(x,) for x in rows], "items array<string>")
    got = [r[0] for r in df.select(T.minhash(F.col("items"))).collect()]
    assert got == [[min((zlib.crc32(x.encode(), s) for x in row or [] if x is not None), default=0xFFFFFFFF) for s in range(64)] for row in rows]


def test_minhash_reads_items_once_for_all_seeds(spark):
    """Once for each of the 64 seeds, an expression of each item was evaluated."""
    df = spark.createDataFrame([(["ab"],)], "items array<string>").select(T.minhash(F.col("items")))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("crc32(") <= 2


TEXTS = ["", None, "word", "The bridge closed, the bridge closed", "#a #tag don’t y’all monday https://x.org/a b.c.d é-x it's it’s", "straße großer café naïve words-with_parts aa bb"]


def test_signature_is_minhash_of_shingles(spark):
    df = spark.createDataFrame([(x,) for x in TEXTS], "text string")
    assert all(a == b for a, b in df.select(T.signature(F.col("text")), T.minhash(T.shingles(F.col("text")))).collect())


def test_terms_of_words_are_extract_terms(spark):
    df = spark.createDataFrame([(x,) for x in TEXTS], "text string")
    for words, terms in df.select(T.words(F.col("text")), T.extract_terms(F.col("text"))).collect():
        assert list(T.terms_of(words or [])) == terms


def many(spark, n=400):
    rng = random.Random(9)
    words = ["bridge", "collapse", "river", "the", "coffee", "#tag", "train", "monday", "ice"]
    rows = [(rng.choice([0, 60, 120, None]), rng.choice(["a", "b", "c", "d", "e", "", None]), rng.choice([None, " ".join(rng.choices(words, k=rng.randrange(8)))])) for _ in range(n)]
    return spark.createDataFrame(rows, "unit bigint, did string, text string")


@pytest.mark.parametrize("kept", [5, 2_000_000])
def test_top_terms_of_posts(spark, kept):
    posts = many(spark)
    terms = posts.select("unit", "did", F.explode(T.extract_terms(F.col("text"))).alias("subject"))
    want = counters.top_terms(counters.term_hits(terms), 7)
    got = counters.top_terms_of(posts, 7, kept=kept)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 28


def test_top_terms_shuffle_posts_not_terms(spark):
    plan = queries.queries()["top_terms_per_minute"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan


@pytest.mark.parametrize("name", ["extract_terms", "shingle_sets"])
def test_sets_of_documents_with_repeated_ids(spark, name, tmp_path):
    """As the SQL has them; no row a term is made, whose least string would be found by sorting."""
    rows = [(1, "Bridge closed the bridge", "s"), (1, "bridge closed today, river", "s"), (1, "bridge closed", "t"), (1, "bridge closed", None), (None, "coffee bridge", "s"), (None, "coffee train", "s"), (2, "", "s"), (3, None, "s"), (4, "one", None), (5, "coffee", "s")]
    path = str(tmp_path / "documents.parquet")
    duckdb.execute("CREATE OR REPLACE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR, lang VARCHAR)")
    duckdb.executemany("INSERT INTO documents VALUES (?, ?, ?, NULL)", rows)
    duckdb.execute(f"COPY documents TO '{path}' (FORMAT parquet)")
    df = queries.queries()[name](spark, str(tmp_path))
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, duckdb.execute(queries.oracle_sql()[name]).fetchall()))
    assert "Generate explode" not in df._jdf.queryExecution().optimizedPlan().toString()
