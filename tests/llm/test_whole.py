"""Operators against brute force, the libraries, and the whole pipeline on planted documents."""

import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from murmurate.llm import decontaminate, flat, labelled, neardup, packing, queries, repeats, store, tokencount, tokens, toxicity


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary(name))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})


def test_names_of_constructed_words():
    t = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    u = t.translate(str.maketrans("ab", "ba"))
    texts = [t, u, t + " " + u, " ".join(t), " ".join(u)]
    data, offs = flat.flatten(pa.array(texts))
    w = flat.Words(data, offs)
    names = w.names()
    assert names[0] != names[1] and names[2] == names[0] and names[3] == names[1]
    first = w.first
    long_ = flat.Prefix(names).ranges(first[3:5], first[4:6])
    assert long_[0] != long_[1]
    for name, by_word in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        lib = tokenizer(name)
        ids, at = tokens.coder(name, by_word).encode(data, offs, 9)
        assert [ids[at[i] : at[i + 1] - 1].tolist() for i in range(5)] == [lib.encode(x, add_special_tokens=False).ids for x in texts]
    assert tokencount.counter("byte_bpe_50k.json").count(data, offs).tolist() == [len(tokenizer("byte_bpe_50k.json").encode(x, add_special_tokens=False).ids) for x in texts]


def test_overlaps_are_the_same_on_both_paths(spark):
    rng = random.Random(8)
    pool = [f"v{i}" for i in range(40)]
    items = [" ".join(rng.choice(pool) for _ in range(n)) for n in (3, 5, 6, 9, 12, 15, 18, 25, 40)]
    rows = []
    for i in range(70):
        x = [rng.choice(pool) for _ in range(rng.randrange(0, 40))]
        if rng.random() < 0.6:
            piece = rng.choice(items).split()
            for _ in range(rng.randrange(0, 3)):
                piece[rng.randrange(len(piece))] = "zz"
            x[5:5] = piece
        rows.append((rng.choice([i, i, None, 7]), " ".join(x)))
    rows += [rows[0], (None, None), (3, "")]
    bench = spark.createDataFrame([(i if i % 3 else None, t) for i, t in enumerate(items)] + [(1, items[1]), (5, None)], "item_id long, text string")
    d = docs(spark, rows).withColumns({"t": F.lit(1), "found": F.lit(2), "__found": F.lit(3)})
    one, two = ([tuple(r) for r in decontaminate.overlaps(d, bench, n).collect()] for n in (10**6, 0))
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    drop = lambda rows: sorted([(r[0], r[1], r[4], r[5]) for r in rows], key=key)  # noqa: E731  ties of place may fall either way
    assert drop(one) == drop(two) and one
    short, want = {t for t in items if len(t.split()) <= decontaminate.SHORT}, []
    for doc_id, text in rows:
        names = decontaminate._Text(pa.array([text or ""], pa.large_string())).names
        for i, t in enumerate(items):
            item = decontaminate._Text(pa.array([t], pa.large_string())).names
            got = [g for g in (decontaminate._verify(names, item, k) for k in range(-len(item), len(names) + 1)) if g]
            if got and t in short:
                want.append((doc_id, i if i % 3 else None, max(g[2] for g in got), len(item)))
    assert drop([(a, b, 0, 0, c, n) for a, b, c, n in want]) == [r for r in drop(one) if r[3] <= decontaminate.SHORT]
    kept = [sorted(((r.doc_id, r.text) for r in decontaminate.clean(d, bench, n).collect()), key=str) for n in (10**6, 0)]
    assert kept[0] == kept[1] and len(kept[0]) < len(rows) and (None, None) in kept[0]
    none = bench.where("false")
    assert decontaminate.overlaps(d, none).count() == 0 and decontaminate.clean(d, none).count() == len(rows) and decontaminate.overlaps(d.where("false"), bench, 0).count() == 0


def test_pieces_are_the_library(spark):
    texts = ["", None, "a b c " * 300, "word " * 90_000, "É " * 50, "x" * 5000]
    got = {}
    for r in packing.pack_documents(docs(spark, list(enumerate(texts))), "byte_bpe_50k.json", 1).collect():
        got.setdefault(r.doc_id, []).append(r)
    lib = tokenizer("byte_bpe_50k.json")
    for i, t in enumerate(texts):
        ids, at = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(got[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)


def test_repeated_ids_and_clashing_names(spark):
    rows = [(1, "a b c d e f"), (1, "x a b c d y"), (1, "x a b c d y"), (2, "q a b c d r"), (None, "a b c d")]
    d = docs(spark, rows).withColumns({c: F.lit("z") for c in ("key", "h", "k1", "packed", "shared", "blocks1", "windows1", "cut_id")})
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in repeats.digests(d, 4).collect())
    assert got == [(0, 4, 0), (1, 6, 0), (1, 6, 0), (1, 6, 0), (2, 6, 4)]
    assert sorted((r.doc_id or 0, r.text) for r in repeats.remove(d, 4).collect()) == [(0, "a b c d"), (1, "a b c d e f"), (1, "x a b c d y"), (1, "x a b c d y"), (2, "q r")]


def test_toxicity_held_out(spark):
    """Recall and precision on the labels of sf0.1 that are not learned from."""
    sf = "/root/testdata/sf0.1"
    labels = queries.table(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = queries.op8_toxicity(spark, sf).join(labels, "doc_id").where("held_out").select("predicted", "toxic").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit >= 0.6 * sum(r.toxic for r in rows) and hit >= 0.85 * sum(r.predicted for r in rows)


def test_toxicity_edges(spark):
    assert labelled.sample(docs(spark, [(1, "a")]), spark.createDataFrame([], "doc_id long, toxic int"), "toxic", F.lit(True), 5) == ([], {})
    model = toxicity.fit([("a b", 0)])
    d = docs(spark, [(1, "x"), (1, "x"), (None, None), (2, "")]).withColumn("predicted", F.lit("z"))
    assert [r.predicted for r in toxicity.score(d, model).collect()] == [0] * 4
    assert toxicity.reject(d, model).count() == 4 and toxicity.reject(d.where("false"), model).count() == 0


def test_pipeline(spark, tmp_path):
    rng = random.Random(4)
    pool = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randrange(3, 9))) for _ in range(4000)]
    say = lambda n: [rng.choice(pool) for _ in range(n)]
    insults = ["worthless", "pathetic", "disgusting", "moron"]
    texts, toxic, want = {}, {}, {}

    def put(words, keep):
        i = len(texts)
        texts[i] = " ".join(words)
        if keep:
            want[i] = " ".join(words)
        return i

    for k in range(320):
        if k % 4 == 0:
            x = say(60)
            for _ in range(14):
                x.insert(rng.randrange(len(x)), rng.choice(insults))
            toxic[put(x, False)] = 1
        else:
            toxic[put(say(rng.randrange(30, 120)), True)] = 0
    base = say(200)
    put(base, True)
    for _ in range(6):  # near copies: J of about 0.9
        copy = list(base)
        copy[rng.randrange(20, 180)] = "changed"
        put(copy, False)
    put(base, False)
    passage = say(70)
    put(say(90) + passage + say(90), True)
    a, b = say(90), say(90)
    want[put(a + passage + b, False)] = " ".join(a + b)
    item = say(40)
    put(say(50) + item[:30] + say(50), False)
    texts[len(texts)] = None
    want[len(texts) - 1] = ""
    sf = str(tmp_path)
    docs(spark, list(texts.items())).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        got.setdefault(r.doc_id, []).append(r)
    rejected = {i for i, y in toxic.items() if y} - set(got)
    assert len(rejected) >= 0.9 * sum(toxic.values()) and set(got) - {i for i, y in toxic.items() if y} == set(want)
    lib = tokenizer("byte_bpe_50k.json")
    for i, t in want.items():
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert [(r.start, r.length, r.ids_crc32) for r in got[i]] == [(0, len(ids), zlib.crc32(ids.tobytes()))]


def test_worst_windows_against_brute_force():
    rng = np.random.default_rng(3)
    sizes = [0, 1, 5, toxicity.WINDOW, toxicity.WINDOW + 1, 90, 0, 40]
    first = np.append(0, np.cumsum(sizes))
    logits = rng.integers(-3, 4, first[-1]).astype(float)  # integers, so that windows tie
    top, begin = toxicity.worst_windows(logits, first)
    for k, n in enumerate(sizes):
        starts = range(max(n - toxicity.WINDOW + 1, 1))
        means = [logits[first[k] + s : min(first[k] + s + toxicity.WINDOW, first[k + 1])] for s in starts]
        means = [m.mean() if len(m) else 0.0 for m in means]
        assert np.isclose(top[k], max(means))
        assert begin[k] == first[k] + int(np.argmax(np.round(means, 9)))
    assert [len(x) for x in toxicity.worst_windows(np.zeros(0), np.zeros(1, int))] == [0, 0]


def test_trainer_finds_the_windows_of_the_model():
    rng = random.Random(5)
    rows = [(" ".join(rng.choice("ab abc bad good word other bad".split()) for _ in range(rng.randrange(1, 60))), k % 2) for k in range(40)]
    trainer = toxicity._Trainer([t for t, _ in rows], np.array([y for _, y in rows]))
    model = trainer.model()
    data, offs = flat.flatten(pa.array([t for t, _ in rows], pa.large_string()))
    assert np.array_equal(trainer.worst(model), model.worst(flat.Words(data, offs))[1])


def whole_collections(spark):
    """How often the JVM has collected its whole heap, as it does when asked to."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_the_driver_collects_its_garbage_before_it_trains(spark, monkeypatch):
    d = docs(spark, [(i, f"word {i}") for i in range(8)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    before, seen, fit = whole_collections(spark), [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda rows, totals: seen.append((len(rows), whole_collections(spark))) or fit([], None))
    toxicity.train(d, labels, F.lit(True))
    assert seen[0][0] == 8 and seen[0][1] > before


def test_the_driver_collects_its_garbage_between_rounds_of_near_duplicates(spark):
    d = docs(spark, [(i, f"a b c d e f g h {i // 2}") for i in range(8)])
    before = whole_collections(spark)
    out = neardup.groups(d)
    assert whole_collections(spark) > before
    assert {r.doc_id: r.component_id for r in out.collect()} == {i: i // 2 * 2 for i in range(8)}


def test_the_jvm_trims_its_native_memory(spark):
    jvm = spark.sparkContext._jvm
    beans = jvm.java.lang.management.ManagementFactory
    version = [int(x) for x in beans.getRuntimeMXBean().getSpecVersion().split(".")]
    if version[0] < 17:
        pytest.skip("older JVMs have no such command")
    assert "rim" in store._trim_jvm(spark)
