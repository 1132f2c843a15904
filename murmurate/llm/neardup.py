"""Near-duplicate documents by SetSketch registers, banding and exact verification.

A document's set is that of its distinct shingles of 5 words (small ASCII letters); with fewer words the whole text is
one shingle. Register i of a set is floor(1 - log_b h) of its least exponential h_i, truncated at 0: the registers of
a union are the larger ones of its parts, and two sets share a register with a probability of their Jaccard similarity J
or more. BANDS bands of ROWS registers make buckets; a link with J >= 0.8 misses all of them with a probability
below 1e-7. Of a candidate pair, J is estimated by maximum likelihood from how many registers are larger, smaller and equal; pairs far
below the threshold are left there, all others are verified on their full sets.

Documents with equal sets become one node first. Within a bucket nodes are linked to pivots, so no pairs are made of a
large group; what stays in several components is tried against new pivots, and in the end all pairs of a bucket
that are still in different components are tried (of buckets with many nodes block by block, on their full sets without
an estimate), so no link that decides a component is lost but for those chances.

Null, empty and blank texts have an empty set and link with nothing. Rows with a null doc_id link with nothing and are
kept. Rows that repeat a doc_id are one document. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components, flat, store

SHINGLE = 5
BANDS, ROWS = 32, 4
M = BANDS * ROWS
#: Base and rate of the registers.
B, RATE = 1.02, 20.0
#: How far below the threshold an estimate may be (5 standard deviations and more) for a pair to be verified.
MARGIN = 0.16
#: Rounds of pivots; the nodes up to which the pairs of an open bucket are joined; beyond, they are compared by blocks.
ROUNDS, LARGE = 3, 16
#: Nodes and shingles of a block, about; sets of a shingle (one side times the other) up to which it is counted pair by
#: pair; columns of a matrix of other shingles.
BLOCK, BLOCK_SHINGLES, DENSE, COLUMNS = 640, 400_000, 1000, 1024
_MULT = flat.mix(np.arange(1000, 1000 + M, dtype=np.uint64)) | np.uint64(1)
_FLIP = flat.mix(np.arange(5000, 5000 + M, dtype=np.uint64))


def shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, name) of the distinct shingles, by text."""
    w = flat.Words(data, offs)
    names, size = w.names(lower=True), np.diff(w.first)
    own = np.flatnonzero(flat.gram_mask(w.first, SHINGLE))
    doc, key = w.doc()[own], flat.grams(names, SHINGLE)[own] if len(own) else np.zeros(0, np.uint64)
    short = np.flatnonzero((size > 0) & (size < SHINGLE))
    if len(short):
        doc = np.append(doc, short)
        key = np.append(key, flat.Prefix(names).ranges(w.first[short], w.first[short + 1]))
    _, one = np.unique(flat.mix(key + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    one.sort()
    order = np.argsort(doc[one], kind="stable")
    return doc[one][order], key[one][order]


def registers(key: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A row of M registers for each set; begin: where each (none empty) begins in key."""
    out = np.empty((len(begin), M), np.uint16)
    for i in range(M):
        least = np.minimum.reduceat((key ^ _FLIP[i]) * _MULT[i], begin).astype(np.float64)
        h = -np.log1p(-(least + 0.5) / 2.0**64) / RATE
        out[:, i] = np.clip(np.floor(1 - np.log(h) / np.log(B)), 0, 65535)
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest (of the set; null if empty), registers."""

    def run(batches):
        for batch in batches:
            data, offs = flat.flatten(batch.column(1))
            for a, b in flat.chunks(offs):
                doc, key = shingles(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                n = np.bincount(doc, minlength=b - a)
                full = np.flatnonzero(n)
                regs, digest = [None] * (b - a), [None] * (b - a)
                if len(full):
                    begin = (np.cumsum(n) - n)[full]
                    sums = np.stack([np.add.reduceat(flat.mix(key ^ np.uint64(s)), begin) for s in (1, 2)], 1)
                    for i, row, d in zip(full.tolist(), registers(key, begin), sums):
                        regs[i], digest[i] = row.tobytes(), d.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "digest", "registers"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(flat.tidy(run), "doc_id bigint, n_shingles bigint, digest binary, registers binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in column), np.uint16).reshape(-1, M)


def bands(nodes: DataFrame) -> DataFrame:
    """node, n, band, bucket (of its own) for each band."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column(2)).astype(np.uint64).reshape(-1, BANDS, ROWS)
            h = np.zeros(m.shape[:2], np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for j in range(ROWS):
                h = flat.mix(h ^ m[:, :, j])
            row = np.repeat(np.arange(batch.num_rows), BANDS)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(h.reshape(-1).view(np.int64))], ["node", "n", "bucket"])

    return nodes.select("node", "n", "registers").mapInArrow(flat.tidy(run), "node bigint, n bigint, bucket bigint")


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """J of pairs of register rows, by maximum likelihood given the sizes of the sets."""
    up, down = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = M - up - down
    u = (na / (na + nb))[:, None]
    v = 1 - u
    grid = np.minimum(u / v, v / u) * np.linspace(0, 1, 101)[None, :]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)
    pu, pd = p(u - v * grid), p(v - u * grid)
    ll = up * np.log(pu + 1e-12) + down * np.log(pd + 1e-12) + same * np.log(np.clip(1 - pu - pd, 1e-12, 1))
    return grid[np.arange(len(grid)), ll.argmax(1)]


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose estimate is not far below the threshold."""
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"))
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                na, nb = (batch.column(c).to_numpy().astype(np.float64) for c in ("na", "nb"))
                j = estimate(_matrix(batch.column("ra")), _matrix(batch.column("rb")), na, nb)
                keep = pa.array(np.flatnonzero(j >= percent / 100 - MARGIN))
                yield pa.RecordBatch.from_arrays([batch.column(c).take(keep) for c in ("a", "b")], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(flat.tidy(run), "a bigint, b bigint")


def _packed(docs: DataFrame) -> DataFrame:
    def run(batches):
        codec = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = [codec.compress(t.as_buffer().to_pybytes()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["node", "packed"])

    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return plain.mapInArrow(flat.tidy(run), "node bigint, packed binary")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union on their full sets."""
    left, right = (texts.select(F.col("node").alias(c), F.col("packed").alias(f"t{c}")) for c in "ab")

    def run(batches):
        codec = zstandard.ZstdDecompressor()
        for batch in batches:
            at, raw, size = 0, [], 0
            for i in range(batch.num_rows):
                raw += [codec.decompress(batch.column(c)[i].as_py()) for c in ("ta", "tb")]
                size += len(raw[-1]) + len(raw[-2])
                if size >= flat.CHUNK or i == batch.num_rows - 1:
                    offs = np.append(0, np.cumsum([len(x) for x in raw]))
                    doc, key = shingles(np.frombuffer(b"".join(raw), np.uint8), offs)
                    sizes = np.bincount(doc, minlength=len(raw)).reshape(-1, 2).sum(1)
                    pair = doc // 2
                    combined = flat.mix(key + pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    order = np.argsort(combined, kind="stable")
                    twice = combined[order][1:] == combined[order][:-1]
                    both = np.bincount(pair[order][1:][twice], minlength=len(sizes))
                    keep = pa.array(at + np.flatnonzero((both > 0) & (100 * both >= percent * (sizes - both))))
                    yield pa.RecordBatch.from_arrays([batch.column(c).take(keep) for c in ("a", "b")], ["a", "b"])
                    at, raw, size = i + 1, [], 0

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(flat.tidy(run), "a bigint, b bigint")


def groups(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reached by links, itself included), kept, for each row of docs."""
    sk = store.keep(sketches(docs), "sketches")
    with_set = sk.where("digest is not null and doc_id is not null")
    nodes = store.keep(with_set.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers")), "nodes")
    of_doc = with_set.select("doc_id", "digest").join(nodes.select("digest", "node"), "digest").select("doc_id", "node")
    again = of_doc.groupBy("doc_id").agg(F.min("node").alias("b"), F.collect_set("node").alias("all")).where(F.size("all") > 1).select(F.explode("all").alias("a"), "b")
    rows = bands(nodes)
    shared = rows.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("members")).where("lo < hi")
    members = store.keep(rows.join(shared.select("bucket", "members"), "bucket"), "bands")
    weights = members.groupBy("node").agg(F.sum("members").alias("weight"))
    members = store.keep(members.join(weights, "node"), "buckets")
    needed = members.select("node").distinct()
    texts = store.keep(_packed(docs).join(needed, "node").groupBy("node").agg(F.first("packed").alias("packed")), "candidate-texts")

    def links(pairs: DataFrame) -> DataFrame:
        fits = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (F.col("a") != F.col("b"))
        ordered = pairs.where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        likely = store.keep(_likely(ordered, nodes, percent), "likely-pairs")
        return _verified(likely, texts, percent)

    found = store.keep(again, "links")
    star = components.stars(found)
    for round_ in range(ROUNDS + 1):
        store.rest(docs.sparkSession)
        labelled = members.join(star.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_ = labelled.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), *_pivots(round_)).where("lo < hi").drop("lo", "hi")
        open_ = store.keep(open_, "open-buckets")
        if open_.isEmpty():  # each bucket lies within one component
            break
        if round_ < ROUNDS:
            tried = labelled.join(open_, "bucket").select(F.col("node").alias("a"), F.col("n").alias("na"), "root", F.explode("pivots").alias("p"))
            pairs = tried.where("root != p.root").select("a", "na", F.col("p.node").alias("b"), F.col("p.n").alias("nb"))
        else:
            rest = store.keep(labelled.join(open_.select("bucket"), "bucket"), "rest")
            pairs = _rest(rest)
        found = links(pairs)
        if round_ == ROUNDS:
            found = found.unionByName(_blocks(rest.where(F.col("members") > LARGE), texts, percent))
        new = store.keep(found, "links")
        store.rest(docs.sparkSession)
        star = components.stars(star.unionByName(new))
    root = of_doc.groupBy("doc_id").agg(F.min("node").alias("node")).join(star.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"))
    out = sk.select("doc_id", "n_shingles").join(root, "doc_id", "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _pivots(round_: int) -> list:
    """Nodes of a bucket: the one whose buckets hold the most nodes (what others are copies of), and after the first round one that a hash picks."""
    one = F.struct("node", "n", "root")
    central = F.max_by(one, F.struct(F.when(F.lit(round_ == 0), F.col("weight")).otherwise(F.pmod(F.xxhash64("node", F.lit(round_)), F.col("weight"))), "node"))
    return [F.array(central, *([F.min_by(one, F.xxhash64("node", F.lit(-round_)))] if round_ else [])).alias("pivots")]


def _rest(members: DataFrame) -> DataFrame:
    """All pairs of different components in the buckets with few nodes."""
    small = members.where(F.col("members") <= LARGE)
    a = small.select("bucket", F.col("node").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"))
    b = small.select("bucket", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))
    return a.join(b, "bucket").where("a < b and ra != rb").select("a", "na", "b", "nb")


def _intersections(row: np.ndarray, key: np.ndarray, other: np.ndarray, key2: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """How many keys each of the sets (row, key) has in common with each of (other, key2)."""
    out = np.zeros(shape[0] * shape[1], np.int64)
    both = np.intersect1d(key, key2)
    sides = []
    for r, k in ((row, key), (other, key2)):
        at = np.minimum(np.searchsorted(both, k), max(len(both) - 1, 0))
        own = np.flatnonzero(both[at] == k) if len(both) else np.zeros(0, np.int64)
        own = own[np.argsort(at[own], kind="stable")]
        sides.append((r[own], at[own]))
    (r, k), (r2, k2) = sides
    n, n2 = np.bincount(k, minlength=len(both)), np.bincount(k2, minlength=len(both))
    first, first2 = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(n2))
    rare = n * n2 <= DENSE
    own = np.flatnonzero(rare[k])  # keys of few sets: pair by pair
    ends = np.append(0, np.cumsum(n2[k[own]]))
    for a, b in flat.chunks(ends, 1_000_000):
        i, j = flat.spread(n2[k[own[a:b]]])
        i = own[a:b][i]
        out += np.bincount(r[i] * shape[1] + r2[first2[k[i]] + j], minlength=len(out))
    out = out.reshape(shape)
    common = np.flatnonzero(~rare)
    for a in range(0, len(common), COLUMNS):  # of many: products of 0/1 matrices
        now = common[a : a + COLUMNS]
        left, right = np.zeros((shape[0], len(now)), np.float32), np.zeros((shape[1], len(now)), np.float32)
        for m, rows, start, size in ((left, r, first, n), (right, r2, first2, n2)):
            i, j = flat.spread(size[now])
            m[rows[start[now[i]] + j], i] = 1
        out += (left @ right.T).astype(np.int64)
    return out


def _blocks(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components within buckets: all pairs are compared on their full sets, and of the
    links within a pair of blocks those that join components are returned. The largest component of a bucket isn't compared with itself."""
    parts = members.groupBy("bucket", "root").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    most = parts.groupBy("bucket").agg(F.max_by(F.struct("root", "m", "s"), F.struct("m", "root")).alias("main"), F.sum("m").alias("m"), F.sum("s").alias("s"))
    count = lambda m, s: F.greatest(F.ceil(m / BLOCK), F.ceil(s / BLOCK_SHINGLES), F.lit(1)).cast("int")
    cut = most.select("bucket", F.col("main.root").alias("main"), count(F.col("m") - F.col("main.m"), F.col("s") - F.col("main.s")).alias("open"), count(F.col("main.m"), F.col("main.s")).alias("closed"))
    rows = members.select("bucket", "node", "root").join(cut, "bucket")
    h, is_open = F.xxhash64("node", F.lit(7)), F.col("root") != F.col("main")
    rows = rows.withColumn("block", F.when(is_open, F.pmod(h, F.col("open"))).otherwise(F.col("open") + F.pmod(h, F.col("closed"))).cast("int"))
    with_ = F.explode(F.when(is_open, F.sequence(F.lit(0), F.col("open") + F.col("closed") - 1)).otherwise(F.sequence(F.lit(0), F.col("open") - 1)))
    tasks = rows.select("bucket", "node", "root", "block", with_.alias("with")).select("bucket", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "node", "root", "block")

    def run(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        codec = zstandard.ZstdDecompressor()
        block, node, root = (table.column(c).to_numpy() for c in ("block", "node", "root"))
        packed = table.column("packed").combine_chunks()
        sides = []
        for side in (i, j) if i != j else (i,):
            own = np.flatnonzero(block == side)
            doc, key_, n, at = [], [], [], 0
            raw, size = [], 0
            for k, x in enumerate(own.tolist()):
                raw.append(codec.decompress(packed[x].as_buffer().to_pybytes()))
                size += len(raw[-1])
                if size >= flat.CHUNK or k == len(own) - 1:
                    d, v = shingles(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(t) for t in raw])))
                    n.append(np.bincount(d, minlength=len(raw)))
                    doc.append(d + at)
                    key_.append(v)
                    at, raw, size = k + 1, [], 0
            if not len(own):
                return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
            sides.append((own, np.concatenate(doc), np.concatenate(key_), np.concatenate(n)))
        (own, doc, k, n), (own2, doc2, k2, n2) = sides[0], sides[-1]
        both = _intersections(doc, k, doc2, k2, (len(own), len(own2)))
        linked = (both > 0) & (100 * both >= percent * (n[:, None] + n2[None, :] - both)) & (root[own][:, None] != root[own2][None, :])
        x, y = np.nonzero(linked)
        names, back = np.unique(root, return_inverse=True)
        _, one = np.unique(back[own[x]] * len(names) + back[own2[y]], return_index=True)
        of, out = list(range(len(names))), []

        def top(v: int) -> int:
            while of[v] != v:
                of[v] = of[of[v]]
                v = of[v]
            return v

        for p, q in zip(own[x[one]].tolist(), own2[y[one]].tolist()):
            u, v = top(back[p]), top(back[q])
            if u != v:
                of[u] = v
                out.append((node[p], node[q]))
        return pa.table({c: pa.array([int(o[m]) for o in out], pa.int64()) for m, c in enumerate("ab")})

    return tasks.join(texts, "node").groupBy("bucket", "i", "j").applyInArrow(run, "a bigint, b bigint")


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group, with their own columns; rows that repeat that doc_id and rows without one stay."""
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    gone = groups(docs, percent).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    left = plain.join(gone, F.col(f"c{names.index('doc_id')}").cast("bigint") == F.col("gone"), "left_anti")
    return left.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
