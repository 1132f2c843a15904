"""Repeated passages, found by recompression.

Words are the first symbols. Each round names, for the whole corpus alike, runs of one symbol and then pairs of a
left and a right symbol (a bit of a symbol's name and the round says which it is). A name is a 64-bit hash of what it
stands for, so that a name means the same in every task without a dictionary to be joined, and equal passages get equal
symbols in their interior: each symbol carries the stretch of words (its context) that it depends on, whatever lies around.

Spark rounds then say which named sequences of symbols are shared, each on what the one before left:
1. anchors: every window of WINDOW words takes the least name among the sequences of ANCHORS symbols (some 13 words)
   whose context it holds; equal windows have equal anchors. Sequences of lower symbols, and words in the end, stand
   in where a window holds no higher one. An anchor in two documents makes both texts go on.
2. blocks: of these texts, sequences of the highest symbols that reach BLOCK words, named by 128 bits. A block
   that an earlier document has too is a repeat as a whole.
3. windows outside such blocks whose anchor is shared are verified by a 128-bit hash of all their words.
So no repeat is missed whatever lies around it. Every round pre-aggregates to the first and last document of a name.

A window is repeated if its words also start in a document with a smaller doc_id; covered words go. Null texts have no
words. Rows with a null doc_id are neither earlier nor later than others: nothing of them goes, and they make nothing
go. Rows that repeat a doc_id are judged each, against smaller ids only. An empty table gives no rows.
A text is parsed by one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat, store

WINDOW = 50
BLOCK, BLOCK_LEVEL = 80, 9
#: Level of symbols, and how many of them one after the other are an anchor.
ANCHORS = ((4, 4), (2, 6), (0, 16))
_A, _B, _C = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


class Parse:
    """Symbols of texts in a row: name, first and last (exclusive) word, context, text."""

    def __init__(self, names: np.ndarray, first: np.ndarray):
        n = len(names)
        self.sym = names
        self.start = np.arange(n)
        self.end = self.start + 1
        self.left, self.right = self.start, self.end
        self.doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.first = first
        self.level = 0

    def round(self) -> None:
        self.level += 1
        salt = flat.mix(np.array([self.level], np.uint64))[0]
        self._runs(salt)
        self._pairs(salt)

    def _runs(self, salt: np.uint64) -> None:
        n = len(self.sym)
        if not n:
            return
        joined = np.zeros(n, bool)
        joined[1:] = (self.sym[1:] == self.sym[:-1]) & (self.doc[1:] == self.doc[:-1])
        head = np.flatnonzero(~joined)
        tail = np.append(head[1:], n) - 1
        times = (tail - head + 1).astype(np.uint64)
        name = self.sym[head]
        many = times > 1
        name[many] = flat.mix(name[many] * _A + times[many] * _B + salt)
        # where a run ends is known once its neighbours are
        doc = self.doc[head]
        left, right = self.left[np.maximum(head - 1, 0)], self.right[np.minimum(tail + 1, n - 1)]
        self._borders(left, np.append(True, doc[1:] != doc[:-1]), right, np.append(doc[1:] != doc[:-1], True), doc)
        self.sym, self.start, self.end, self.left, self.right, self.doc = name, self.start[head], self.end[tail], left, right, doc

    def _borders(self, left: np.ndarray, head: np.ndarray, right: np.ndarray, tail: np.ndarray, doc: np.ndarray) -> None:
        """What depends on where a text begins or ends has a context that no window holds: a word beyond it."""
        left[head] = self.first[doc[head]] - 1
        right[tail] = self.first[doc[tail] + 1] + 1

    def _pairs(self, salt: np.uint64) -> None:
        n = len(self.sym)
        if not n:
            return
        lefty = ((self.sym * _C + salt) >> np.uint64(60)) < 8
        inner = self.doc[1:] == self.doc[:-1]
        pair = np.zeros(n, bool)
        pair[:-1] = lefty[:-1] & ~lefty[1:] & inner
        second = np.append(False, pair[:-1])
        left, right = self.left.copy(), self.right.copy()
        alone = np.flatnonzero(lefty & ~pair)  # the next symbol is no right one
        right[alone] = self.right[np.minimum(alone + 1, n - 1)]
        last = alone[np.append(~inner, True)[alone]]
        alone = np.flatnonzero(~lefty & ~second)
        left[alone] = self.left[np.maximum(alone - 1, 0)]
        self._borders(left, alone[np.append(True, ~inner)[alone]], right, last, self.doc)
        at = np.flatnonzero(pair)
        name, end = self.sym.copy(), self.end.copy()
        name[at] = flat.mix(self.sym[at] * _B + (self.sym[at + 1] ^ _A) * _C + salt)
        end[at], right[at] = self.end[at + 1], self.right[at + 1]
        keep = ~second
        self.sym, self.start, self.end, self.left, self.right, self.doc = name[keep], self.start[keep], end[keep], left[keep], right[keep], self.doc[keep]


class _Sequences:
    """Sequences of n adjacent symbols of one text: name and context."""

    def __init__(self, p: Parse, n: int):
        m = max(0, len(p.sym) - n + 1)
        name = np.zeros(m, np.uint64)
        for j in range(n):
            name = flat.mix(name * _A + p.sym[j : j + m])
        own = np.flatnonzero(p.doc[:m] == p.doc[n - 1 : n - 1 + m])
        self.name, self.left, self.right = flat.mix(name[own] ^ np.uint64(p.level + 1)), p.left[:m][own], p.right[n - 1 : n - 1 + m][own]

    def least(self, window: int, own: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Sets out to the least name that a window (first words in own) holds; returns the windows that hold none."""
        lo, hi = np.searchsorted(self.left, own, "left"), np.searchsorted(self.right, own + window, "right")
        n = hi - lo
        got = n > 0
        if got.any():
            tables, width = [self.name], 1
            while 2 * width <= int(n.max()):
                values = tables[-1].copy()
                np.minimum(values[:-width], tables[-1][width:], out=values[:-width])
                tables.append(values)
                width *= 2
            k = np.frexp(n[got].astype(np.float64))[1] - 1
            a, b = lo[got], hi[got]
            least = np.empty(len(a), np.uint64)
            for power in np.unique(k):
                sel = k == power
                t = tables[power]
                least[sel] = np.minimum(t[a[sel]], t[b[sel] - (1 << int(power))])
            out[own[got]] = least
        return own[~got]


class Passages:
    """Anchors, blocks and windows of texts in a row. The highest symbols are made only where blocks are asked for."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, window: int, blocks: bool = True):
        self.w = w = flat.Words(data, offs)
        self.names, self.window = w.names(), window
        self.doc = w.doc()
        self.windows = np.flatnonzero(flat.gram_mask(w.first, window))
        self.anchors = np.zeros(len(w), np.uint64)
        p, held = Parse(self.names, w.first), {}
        for level in range(BLOCK_LEVEL + 1 if blocks else max(k for k, _ in ANCHORS) + 1):
            if level:
                p.round()
            held |= {k: _Sequences(p, max(1, n * window // WINDOW)) for k, n in ANCHORS if k == level}
        rest = self.windows
        for level, _ in ANCHORS:
            rest = held[level].least(window, rest, self.anchors)
        if blocks:
            self.sums, self.sums2 = flat.Prefix(self.names), flat.Prefix(self.names, True)
            end = np.searchsorted(p.end, p.start + BLOCK * window // WINDOW, "left")
            ok = np.flatnonzero(end < len(p.sym))
            ok = ok[p.doc[end[ok]] == p.doc[ok]] if len(ok) else ok
            self.block_start, self.block_end, self.block_doc = p.start[ok], p.end[end[ok]], p.doc[ok]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.sums.ranges(start, end), self.sums2.ranges(start, end)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, anchor), each once."""
        doc, key = self.doc[self.windows], self.anchors[self.windows]
        step = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))) if len(key) else np.zeros(0, np.int64)
        doc, key = doc[step], key[step]
        order = np.lexsort((key, doc))
        doc, key = doc[order], key[order]
        keep = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])) if len(key) else np.zeros(0, bool)
        return doc[keep], key[keep]

    def covered(self, known: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The words that known blocks cover, and the windows that no known block holds."""
        cover, done = np.zeros(len(self.w) + 1, np.int64), np.zeros(len(self.w) + 1, np.int64)
        hit = _both(self.block_doc, self.hashes(self.block_start, self.block_end), known)
        np.add.at(cover, self.block_start[hit], 1)
        np.add.at(cover, self.block_end[hit], -1)
        np.add.at(done, self.block_start[hit], 1)
        np.add.at(done, self.block_end[hit] - self.window + 1, -1)
        return np.cumsum(cover)[:-1] > 0, self.windows[np.cumsum(done)[self.windows] == 0]


def _of(doc: np.ndarray, key: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which (text, key) are known."""
    return np.isin(flat.mix(key + doc.astype(np.uint64) * _A), flat.mix(known[1] + known[0].astype(np.uint64) * _A))


def _both(doc: np.ndarray, keys: tuple[np.ndarray, np.ndarray], known: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Which (text, 128-bit key) are known: both halves are."""
    return _of(doc, keys[0], known[0]) & _of(doc, keys[1], known[1])


_ROW = ["doc_id", "h"]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("h"), "text").where("doc_id is not null and text is not null")


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """key, doc_id, h (xxhash64 of the text): the distinct anchors of each text."""

    def run(batches):
        for batch in batches:
            data, offs = flat.flatten(batch.column(2))
            for a, b in flat.chunks(offs):
                doc, key = Passages(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], window, False).keys()
                at = pa.array(a + doc)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0).take(at), batch.column(1).take(at)], ["key", *_ROW])

    return _texts(docs).mapInArrow(flat.tidy(run), "key bigint, doc_id bigint, h bigint")


def _packed(docs: DataFrame, window: int) -> DataFrame:
    """Texts with a window at least, compressed: they are shuffled."""

    def run(batches):
        codec = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data, offs = flat.flatten(batch.column(2))
            rows, packed = [], []
            for a, b in flat.chunks(offs):
                first = flat.Words(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]).first
                for i in np.flatnonzero(np.diff(first) >= window).tolist():
                    rows.append(a + i)
                    packed.append(codec.compress(data[offs[a + i] : offs[a + i + 1]].tobytes()))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(packed, pa.binary())], [*_ROW, "packed"])

    return _texts(docs).mapInArrow(flat.tidy(run), "doc_id bigint, h bigint, packed binary")


def _groups(batch: pa.RecordBatch, window: int, codec):
    """Rows of a batch, some text at a time: row numbers, their passages, and what a list column knows of them."""
    rows, raw, size = [], [], 0
    for i in range(batch.num_rows):
        rows.append(i)
        raw.append(codec.decompress(batch.column("packed")[i].as_py()))
        size += len(raw[-1])
        if size >= flat.CHUNK or i == batch.num_rows - 1:
            offs = np.append(0, np.cumsum([len(x) for x in raw]))

            def known(name: str, rows: list[int] = rows) -> tuple[np.ndarray, np.ndarray]:
                column = batch.column(name)
                parts = [column[k].values.to_numpy().view(np.uint64) if column[k].is_valid else np.zeros(0, np.uint64) for k in rows]
                return np.repeat(np.arange(len(rows)), [len(x) for x in parts]), np.concatenate(parts)

            yield rows, Passages(np.frombuffer(b"".join(raw), np.uint8), offs, window), known
            rows, raw, size = [], [], 0


def _named(rows: DataFrame, window: int, which) -> DataFrame:
    """k1, k2, doc_id, h: the 128-bit names of what which(passages, known) gives as first and last (exclusive) words, each once a text."""

    def run(batches):
        codec = zstandard.ZstdDecompressor()
        for batch in batches:
            for numbers, p, known in _groups(batch, window, codec):
                doc, start, end = which(p, known)
                k1, k2 = p.hashes(start, end)
                keep = np.unique(flat.mix(k1 + doc.astype(np.uint64) * _A), return_index=True)[1]
                at = pa.array(np.array(numbers, np.int64)[doc[keep]])
                yield pa.RecordBatch.from_arrays([pa.array(k1[keep].view(np.int64)), pa.array(k2[keep].view(np.int64)), batch.column("doc_id").take(at), batch.column("h").take(at)], ["k1", "k2", *_ROW])

    return rows.mapInArrow(flat.tidy(run), "k1 bigint, k2 bigint, doc_id bigint, h bigint")


def _earlier(named: DataFrame, name: str) -> DataFrame:
    """doc_id, h, <name>1, <name>2: the names that a document with a smaller doc_id has too. named is computed twice."""
    first = named.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    later = named.join(first, ["k1", "k2"]).where("first < doc_id")
    return later.groupBy(*_ROW).agg(F.collect_list("k1").alias(f"{name}1"), F.collect_list("k2").alias(f"{name}2"))


def repeated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, h (xxhash64 of the text), n_words, n_removed, spans (of removed words), text (kept words, one space between): texts with a repeat only."""
    anchors = store.keep(_anchors(docs, window), "anchors")
    shared = anchors.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("key")
    lists = store.keep(anchors.join(shared, "key").groupBy(*_ROW).agg(F.collect_set("key").alias("shared")), "shared-anchors")
    store.drop(anchors)
    touched = store.keep(_packed(docs, window).join(lists, _ROW).dropDuplicates(_ROW), "touched-texts")
    store.drop(lists)

    def blocks(p: Passages, known):
        return p.block_doc, p.block_start, p.block_end

    def windows(p: Passages, known):
        own = p.covered([known("blocks1"), known("blocks2")])[1]
        own = own[_of(p.doc[own], p.anchors[own], known("shared"))]
        return p.doc[own], own, own + window

    rest = store.keep(touched.join(_earlier(_named(touched, window, blocks), "blocks"), _ROW, "left"), "texts-and-blocks")
    store.drop(touched)

    def cut(batches):
        codec = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for rows, p, known in _groups(batch, window, codec):
                gone, own = p.covered([known("blocks1"), known("blocks2")])
                own = own[_both(p.doc[own], p.hashes(own, own + window), [known("windows1"), known("windows2")])]
                cover = np.zeros(len(p.w) + 1, np.int64)
                np.add.at(cover, own, 1)
                np.add.at(cover, own + window, -1)
                gone = gone | (np.cumsum(cover)[:-1] > 0)
                sums = np.append(0, np.cumsum(gone))[p.w.first]
                for k in np.flatnonzero(np.diff(sums)).tolist():
                    a, b = p.w.first[k], p.w.first[k + 1]
                    lost = gone[a:b]
                    edge = np.diff(np.concatenate([[0], lost.astype(np.int8), [0]]))
                    spans = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1)
                    kept = joined(p.w.data, p.w.start[a:b][~lost], p.w.end[a:b][~lost])
                    out.append((batch.column("doc_id")[rows[k]].as_py(), batch.column("h")[rows[k]].as_py(), int(b - a), int(lost.sum()), spans.tolist(), kept.decode()))
            if out:
                kinds = [pa.int64()] * 4 + [pa.list_(pa.list_(pa.int64())), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["doc_id", "h", "n_words", "n_removed", "spans", "text"])

    found = rest.join(_earlier(_named(rest, window, windows), "windows"), _ROW, "left").where("windows1 is not null or blocks1 is not null")
    return found.mapInArrow(flat.tidy(cut), "doc_id bigint, h bigint, n_words bigint, n_removed bigint, spans array<array<bigint>>, text string")


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """Words with one space between."""
    row, place = flat.spread(end - start + 1)
    out = np.full(len(row), 32, np.uint8)
    inside = place < (end - start)[row]
    out[inside] = data[(start[row] + place)[inside]]
    return out[:-1].tobytes()


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of docs."""

    def run(batches):
        for batch in batches:
            data, offs = flat.flatten(batch.column(2))
            words, sha = [], []
            for a, b in flat.chunks(offs):
                w = flat.Words(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                n = np.diff(w.first)
                text = joined(w.data, w.start, w.end)
                ends = np.append(0, np.cumsum(w.end - w.start + 1))[w.first]
                sha += [hashlib.sha256(text[x : max(x, y - 1)]).hexdigest() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
                words.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate([np.zeros(0, np.int64), *words])), pa.array(sha, pa.string())], ["doc_id", "h", "n_words", "sha"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    whole = rows.mapInArrow(flat.tidy(run), "doc_id bigint, h bigint, n_words bigint, sha string")
    cut = repeated(docs, window).select("doc_id", "h", "n_removed", F.sha2("text", 256).alias("cut_sha"))
    return whole.join(cut, ["doc_id", "h"], "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("cut_sha", "sha").alias("kept_sha256"))


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without repeated passages: a text that loses words has its other words, one space between; one that loses all goes.

    Other columns stay as they are.
    """
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    id_, text = (F.col(f"c{names.index(c)}") for c in ("doc_id", "text"))
    cut = repeated(docs, window).select(F.col("doc_id").alias("cut_id"), F.col("h").alias("cut_h"), F.col("text").alias("cut_text"))
    rows = plain.join(cut, (id_.cast("bigint") == F.col("cut_id")) & (F.xxhash64(text) == F.col("cut_h")), "left").where("cut_text is null or cut_text != ''")
    return rows.select(*[(F.coalesce("cut_text", text) if c == "text" else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)])
