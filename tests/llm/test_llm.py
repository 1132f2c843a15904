import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from murmurate.llm import backoff, components, decontaminate, flat, labelled, neardup, packing, quality, repeats, rules, simple8b, tokencount, tokenfile, tokens, toxicity

ODD = ["a  b", "x  　y \n z", "  lead", "trail  ", "it's 'sanity \n\n\t x'll we're'rex", "a<|endoftext|> b  <|endoftext|>", "é́ ́x", "", None, " ", "12'd3 ¼²", "日本語 テキスト", "😀 x", "ÀÉ Σς İx ß", "THE!! Àb</w> x"]
WORDS = [f"w{i}" for i in range(60)]


def docs(spark, texts, ids=None):
    rows = list(zip(ids or range(len(texts)), texts))
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "node": F.lit(1), "k1": F.lit(2), "h": F.lit("x"), "key": F.lit(None).cast("string")})


def empty(spark):
    return docs(spark, ["x"]).where("false")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary(name))


@pytest.mark.parametrize("name,by_word", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_coder_is_the_library(name, by_word):
    data, offs = flat.flatten(pa.array(ODD))
    ids, at = tokens.coder(tokens.vocabulary(name), by_word).encode(data, offs, 9)
    lib = tokenizer(name)
    for i, t in enumerate(ODD):
        assert ids[at[i] : at[i + 1]].tolist() == [*lib.encode(t or "", add_special_tokens=False).ids, 9]


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 3000):
        x = rng.integers(0, 2**63, n, dtype=np.uint64) >> rng.integers(0, 64, n, dtype=np.uint64)
        x[::3] *= np.uint64(2)
        got, lengths = simple8b.unpack(simple8b.pack(x, np.array([n])))
        assert (got == x).all() and len(got) == n and lengths.tolist() == [n]


def test_token_file(spark, tmp_path):
    ids = [*range(len(ODD) - 2), None, 3]
    tokenfile.write(docs(spark, ODD, ids).repartition(3), str(tmp_path / "f"), tokens.vocabulary("word_bpe_49k.json"), True, 2)
    got = tokenfile.read(spark, str(tmp_path / "f")).collect()
    lib, start = tokenizer("word_bpe_49k.json"), 0
    want = sorted(zip(ids, ODD), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for r, (doc_id, t) in zip(sorted(got, key=lambda r: r.start), want, strict=True):
        w = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, list(r.ids), r.ids_crc32) == (doc_id, start, len(w), w, zlib.crc32(np.array(w, "<u4").tobytes()))
        start += len(w)
    tokenfile.write(empty(spark), str(tmp_path / "e"), tokens.vocabulary("word_bpe_49k.json"), True, 2)
    assert tokenfile.read(spark, str(tmp_path / "e")).count() == 0


def test_token_counts(spark):
    got = tokencount.count_tokens(docs(spark, ODD), tokens.vocabulary("byte_bpe_50k.json")).orderBy("doc_id").collect()
    lib = tokenizer("byte_bpe_50k.json")
    assert [(r.n_bytes, r.n_tokens) for r in got] == [(len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for t in ODD]
    assert tokencount.count_tokens(empty(spark), tokens.vocabulary("byte_bpe_50k.json")).count() == 0


def test_packing(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 3, 50, 900]))) for _ in range(60)] + [None, ""]
    got = packing.pack_documents(docs(spark, texts, [*range(60), None, 5]), tokens.vocabulary("byte_bpe_50k.json"), 1, 256).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for rows in by.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    total = sum(r.length for r in got)
    assert total == sum(len(e.ids) + 1 for e in tokenizer("byte_bpe_50k.json").encode_batch([t or "" for t in texts], add_special_tokens=False))
    assert len(by) <= total / 256 * 1.1 + 2
    assert packing.pack_documents(empty(spark), tokens.vocabulary("byte_bpe_50k.json"), 1).count() == 0


def test_rules(spark):
    texts = ["a\na\n a\na", "x y z w v x y z w v q", None, "", "A# B$ | é é\n\né é"]
    got = {r.doc_id: r for r in rules.decide(rules.ledger(rules.measure(docs(spark, texts))), "base").collect()}
    assert (got[0].n_dup_lines, got[1].n_repeat_words, got[2].n_words, got[4].n_symbols, got[4].word_chars) == (2, 10, 0, 3, 9)
    rows = rules.ledger(rules.measure(docs(spark, texts)))
    table = {r.rule: r for r in rules.ablation(rows, "base").collect()}
    assert table["few_words"].n_failed == 4 and table["repeated_words"].n_failed_alone == 1
    assert rules.measure(empty(spark)).count() == 0


def test_repeats(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(3, 60))) for _ in range(12)] + ["a " * 50, "a b " * 30]
    texts = ["\n".join(rng.choice(pool) if rng.random() < 0.6 else " ".join(rng.choice(WORDS) for _ in range(20)) for _ in range(rng.randrange(0, 5))) for _ in range(80)] + [None]
    first, w = {}, [words(t) for t in texts]
    for i, x in enumerate(w):
        for k in range(len(x) - 11):
            first.setdefault(tuple(x[k : k + 12]), i)
    got = {r.doc_id: r for r in repeats.digests(docs(spark, texts), 12).collect()}
    for i, x in enumerate(w):
        gone = {j for k in range(len(x) - 11) if first[tuple(x[k : k + 12])] < i for j in range(k, k + 12)}
        kept = " ".join(v for k, v in enumerate(x) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(x), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    out = repeats.remove(docs(spark, ["p q r s", "p q r s t", None], [1, 2, None]), 4)
    assert sorted((r.doc_id or 0, r.text) for r in out.collect() if r.text) == [(1, "p q r s"), (2, "t")] and out.count() == 3
    assert repeats.digests(empty(spark)).count() == 0


def test_neardup(spark):
    rng = random.Random(3)
    texts = []
    for size in (3, 40, 200):
        base = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(size)]
        for k in range(8):
            w = list(base)
            for _ in range(k % 3):
                w[rng.randrange(size)] = "other"
            texts.append(" ".join(w))
    texts += ["", None, "A b", "a B"]

    def shingles(t):
        w = words((t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    got = {r.doc_id: r for r in neardup.groups(docs(spark, texts), 85).collect()}
    assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in range(len(texts))] == [(len(s), root[i], root[i] == i) for i, s in enumerate(sets)]


def test_neardup_large_open_bucket(spark):
    core, texts = " ".join(f"c21y{i}" for i in range(201)), []  # of these names, 5 pairs share none of 128 keys of 12 registers
    for k in range(300):  # 150 pairs of J = 200 / 250; all others 197 / 253
        texts.append(" ".join([core, *(f"p{k // 2}x{i}" for i in range(3)), *(f"o{k}x{i}" for i in range(25))]))
    got = {r.doc_id: r.component_id for r in neardup.groups(docs(spark, texts), 80).collect()}
    assert [got[k] for k in range(300)] == [k // 2 * 2 for k in range(300)]


def test_intersections():
    rng = np.random.default_rng(7)
    for dense in (1, 5):
        sets = [[np.unique(rng.integers(0, 4000 // dense**4, 40).astype(np.uint64)) for _ in range(n)] for n in (50, 70)]
        (r, k), (r2, k2) = ((np.repeat(np.arange(len(x)), [len(y) for y in x]), np.concatenate(x)) for x in sets)
        got = neardup._intersections(r, k, r2, k2, (50, 70))
        assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[1]] for a in sets[0]]


def test_estimate():
    rng = np.random.default_rng(4)
    for j in (0.3, 0.85):
        both = rng.integers(0, 2**64, int(2000 * j), dtype=np.uint64)
        only = rng.integers(0, 2**64, 2000 - len(both), dtype=np.uint64)
        a, b = np.append(both, only[: len(only) // 2]), np.append(both, only[len(only) // 2 :])
        r = neardup.registers(np.concatenate([a, b]), np.array([0, len(a)]))
        assert abs(neardup.estimate(r[:1], r[1:], np.array([len(a)]), np.array([len(b)]))[0] - j) < 0.15


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 50), (100, 70)]
    got = {r.a: r.b for r in components.stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 21)}, 100: 50, 70: 50}


@pytest.mark.parametrize("held", [decontaminate.MAX_HELD, 0])
def test_decontaminate(spark, held):
    rng = random.Random(8)
    items = [" ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(30)) for _ in range(6)] + [None]
    hit = items[2].split(" ")
    hit[9] = hit[20] = "changed"
    texts = ["before " + items[0].upper() + ", after", " ".join(hit), "nothing " * 40, None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.overlaps(docs(spark, texts), bench, held).collect()}
    assert set(got) == {(0, 0), (1, 2)} and got[0, 0].n_equal == 30 and got[0, 0].start_word == 1 and got[1, 2].n_equal == 28
    assert sorted(r.doc_id for r in decontaminate.clean(docs(spark, texts), bench, held).collect()) == [2, 3, 4]


@pytest.mark.parametrize("held", [decontaminate.MAX_HELD, 0])
def test_decontaminate_short_items(spark, held):
    rng = random.Random(12)
    items = [[f"i{n}w{k}" for k in range(n)] for n in range(1, 19)]
    texts, want = [], set()
    for n, item in enumerate(items, 1):
        for gone in range(4):
            for _ in range(4):
                hit = list(item)
                for k in rng.sample(range(n), min(gone, n)):
                    hit[k] = "changed"
                if n - gone >= (n if n < 6 else 0.7 * n):
                    want.add((len(texts), n))
                texts.append(" ".join(["before", *hit, "after"]))
    bench = spark.createDataFrame([(n, " ".join(x)) for n, x in enumerate(items, 1)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.overlaps(docs(spark, texts), bench, held).collect()}
    assert set(got) == want
    assert all(got[d, n].n_equal == sum(w.startswith("i") for w in texts[d].split(" ")) for d, n in want if n < 12)


def test_backoff(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(WORDS[:20]) for _ in range(rng.randrange(0, 30))) for _ in range(40)] + [None]
    w = [words(t) for t in texts]
    u, b = Counter(x for t in w for x in t), Counter(p for t in w for p in zip(t, t[1:]))
    n = sum(u.values())
    got = {r.doc_id: r for r in backoff.scores(docs(spark, texts)).collect()}
    for i, t in enumerate(w):
        s = sum(np.log(b[t[k - 1], x] / u[t[k - 1]]) if k and b[t[k - 1], x] >= 2 else np.log(u[x] / n) + (np.log(0.4) if k else 0) for k, x in enumerate(t))
        assert got[i].n_words == len(t) and got[i].score == pytest.approx(s, abs=1e-6)
    assert backoff.scores(empty(spark)).count() == 0


def test_classifiers_on_held_out_rows(spark):
    base = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    model = quality.train(d, labels, labelled.remainder("doc_id", 4) != 2)
    rows = quality.score(d, model).join(labels, "doc_id").where(labelled.remainder("doc_id", 4) == 2)
    assert rows.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.9
    model = toxicity.train(d, labels, labelled.remainder("doc_id", 5) != 0)
    rows = toxicity.score(d, model).join(labels, "doc_id").where(labelled.remainder("doc_id", 5) == 0)
    assert rows.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0] > 0.92
    odd = docs(spark, ["", None, " "])
    assert quality.score(odd, quality.fit([])).count() == toxicity.score(odd, model).count() == 3
    assert toxicity.reject(odd, toxicity.fit([])).columns == odd.columns
