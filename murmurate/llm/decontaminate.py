"""Benchmark decontamination by spaced seeds: hashes of word windows in which fixed masks ignore some positions.

Words are runs of letters and digits, in small letters; everything of ASCII else separates them. A window of SPAN
words has one hash for each mask, over the positions that the mask keeps, so a replaced word spoils only the hashes
that look at it. Hits between a text and an item say on which diagonal (place in the text less place in the item)
to look; there the two are compared word by word. They overlap if the best stretch (1 for each equal word, -PENALTY
else) has LEAST equal words, or if SHARE percent of all the item's words are equal on the diagonal (of an item of fewer
than SHORTEST words: all). Items of up to SHORT words are cut into one piece more than words may differ, and the pieces
are looked for too: one of them is always whole, so of these items no such overlap is missed.

While the items' hashes are few (MAX_HELD, counted first) each task holds them, and training text is not shuffled.
Beyond that the hashes of both sides are joined by value: only hits, not texts, meet hashes; a second join verifies. Texts
are known by their MD5 there, each distinct one once, so that ids decide nothing on either way: both give the same rows.
Hashes that many items share stay exact: all their items are tried.

Null and empty texts overlap with nothing; documents and items with null ids are looked at and reported as all others;
repeated documents are reported each, repeated items (id and text) once; an empty table or benchmark gives no rows; columns
other than the ids and texts are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat, store

SPAN = 9
#: Positions that each mask keeps; two replaced words leave a mask of some window untouched where they are not at its places.
MASKS = [(0, 1, 2, 3, 4, 5), (0, 1, 3, 4, 6, 7), (0, 2, 3, 5, 6, 8), (0, 1, 4, 5, 7, 8)]
LEAST, SHORTEST, PENALTY, SHARE, SHORT = 12, 6, 2, 70, 18
#: Hashes of benchmark items that each task holds at most.
MAX_HELD = 4_000_000

_SPLIT = flat.SPACE | (np.arange(256) < 128) & ~np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123)])
_FOUND = "doc_id bigint, item_id bigint, start_word bigint, end_word bigint, n_equal bigint, n_item_words bigint"


def _need(n: int) -> int:
    """Equal words on a diagonal that make an overlap with an item of n words."""
    return n if n < SHORTEST else -(-n * SHARE // 100)


def _pieces(n: int) -> list[tuple[int, int]]:
    """Place and length of the pieces of an item of n words; none of a long one."""
    if not 0 < n <= SHORT:
        return []
    cuts = np.linspace(0, n, n - _need(n) + 2).astype(int).tolist()
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


class _Text:
    """Names of the words of texts in a row, and first word of each."""

    def __init__(self, column: pa.Array):
        column = pc.utf8_lower(pc.fill_null(column, ""))
        data, self.offs = flat.flatten(column)
        data = np.where(_SPLIT[data], np.uint8(32), data)
        w = flat.Words(data, self.offs)
        self.names, self.first = w.names(), w.first

    def hashes(self, lengths=()) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each mask, and each length of pieces: first word of windows, and hash."""
        out = []
        for k, mask in [*enumerate(MASKS), *((100 + m, range(m)) for m in lengths)]:
            span = mask[-1] + 1
            own = np.flatnonzero(flat.gram_mask(self.first, span))
            h = np.full(len(own), np.uint64(k * 0x9E3779B9 + 1), np.uint64)
            for j in mask:
                h += self.names[own + j] * flat._COEFS[j]
            out.append((own, flat.mix(h)))
        return out

    def pieces(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Of these items: length of pieces, their first words, and hash."""
        at: dict[int, list[int]] = {}
        for first, n in zip(self.first[:-1].tolist(), np.diff(self.first).tolist()):
            for place, m in _pieces(n):
                at.setdefault(m, []).append(first + place)
        out = []
        for m, starts in sorted(at.items()):
            own, h = self.hashes([m])[-1]
            mine = np.isin(own, starts)
            out.append((m, own[mine], h[mine]))
        return out


def _best(equal: np.ndarray) -> tuple[int, int, int]:
    """The stretch with the largest sum of 1 for equal and -PENALTY for other words: begin, end, equal words."""
    gain = np.where(equal, 1, -PENALTY)
    sums = np.append(0, np.cumsum(gain))
    low = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - low))
    begin = int(np.argmax(sums[: end + 1] == low[end]))
    return begin, end, int(equal[begin:end].sum())


def _verify(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """First and last (exclusive) word in the text of an overlap on this diagonal, and its equal words."""
    a, b = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if b <= a:
        return None
    equal = doc[a + diagonal : b + diagonal] == item[a:b]
    begin, end, n = _best(equal)
    if n >= LEAST:
        return a + diagonal + begin, a + diagonal + end, n
    same = np.flatnonzero(equal)
    if len(same) >= _need(len(item)):
        return a + diagonal + int(same[0]), a + diagonal + int(same[-1]) + 1, len(same)
    return None


class _Items:
    """The benchmark's words and hashes, sorted."""

    def __init__(self, ids: list, texts: list[str]):
        t = _Text(pa.array(texts, pa.large_string()))
        self.ids, self.words = ids, np.split(t.names, t.first[1:-1]) if texts else []
        item, place, value = [], [], []
        pieces = t.pieces()
        self.lengths = [m for m, _, _ in pieces]
        for own, h in [*t.hashes(), *(x[1:] for x in pieces)]:
            item.append(np.searchsorted(t.first, own, "right") - 1)
            place.append(own - t.first[item[-1]])
            value.append(h)
        value = np.concatenate(value)
        order = np.argsort(value, kind="stable")
        self.value, self.item, self.place = value[order], np.concatenate(item)[order], np.concatenate(place)[order]
        sizes = np.diff(t.first)
        self.size = np.minimum(sizes, SHORT + 1)
        self.need = np.array([min(LEAST, _need(n)) if n <= SHORT else 0 for n in sizes.tolist()], np.int64)
        row, k = flat.spread(np.where(sizes <= SHORT, sizes, 0))
        self.short = np.zeros((len(sizes), SHORT), np.uint64)
        self.short[row, k] = t.names[t.first[row] + k]
        self.bits = 22
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[self._slot(self.value)] = True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _enough(self, t: _Text, doc: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        """Which hits can be overlaps: those with short items by their equal words, all others."""
        out = self.size[item] > SHORT
        own = np.flatnonzero(~out)
        for a in range(0, len(own), 100_000):
            x = own[a : a + 100_000]
            k = np.arange(SHORT)[None, :]
            at = (t.first[doc[x]] + diagonal[x])[:, None] + k
            inside = (at >= t.first[doc[x]][:, None]) & (at < t.first[doc[x] + 1][:, None]) & (k < self.size[item[x]][:, None])
            same = inside & (t.names[np.clip(at, 0, len(t.names) - 1)] == self.short[item[x]])
            out[x] = same.sum(1) >= self.need[item[x]]
        return out

    def find(self, column: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(row, item, first word, end word, equal words) of all overlaps, the longest for each row and item."""
        t = _Text(column)
        tried = set()
        for own, h in t.hashes(self.lengths):
            may = self.maybe[self._slot(h)]
            own, h = own[may], h[may]
            lo, hi = np.searchsorted(self.value, h, "left"), np.searchsorted(self.value, h, "right")
            if not (hi > lo).any():
                continue
            row, k = flat.spread(hi - lo)
            entry = lo[row] + k
            doc = np.searchsorted(t.first, own[row], "right") - 1
            diagonal = own[row] - t.first[doc] - self.place[entry]
            item = self.item[entry]
            may = self._enough(t, doc, item, diagonal)
            tried.update(zip(doc[may].tolist(), item[may].tolist(), diagonal[may].tolist()))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for doc, item, diagonal in sorted(tried):
            got = _verify(t.names[t.first[doc] : t.first[doc + 1]], self.words[item], diagonal)
            if got and ((doc, item) not in best or got[2] > best[doc, item][2]):
                best[doc, item] = got
        return [(d, i, *v) for (d, i), v in best.items()]


def _ids(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(f"`{key}`").cast("bigint").alias("id"), "text")


def _hash_rows(texts: DataFrame, lengths: list[int] | None = None) -> DataFrame:
    """t, place and value of every hash: with lengths those of texts, with None those of items."""

    def run(batches):
        for batch in batches:
            _, offs = flat.flatten(batch.column(1))
            for a, b in flat.chunks(offs):
                t = _Text(batch.column(1).slice(a, b - a))
                names = batch.column(0).slice(a, b - a)
                hashes = t.hashes(lengths) if lengths is not None else [*t.hashes(), *(x[1:] for x in t.pieces())]
                for own, h in hashes:
                    row = np.searchsorted(t.first, own, "right") - 1
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(row)), pa.array(own - t.first[row]), pa.array(h.view(np.int64))], ["t", "place", "value"])

    return texts.select("t", "text").mapInArrow(flat.tidy(run), "t string, place bigint, value bigint")


def _lengths(items: DataFrame) -> list[int]:
    """Lengths of the pieces of all items, SHORT different ones at most."""

    def run(batches):
        for batch in batches:
            found = {m for n in set(np.diff(_Text(batch.column(0)).first).tolist()) for _, m in _pieces(n)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int32())], ["m"])

    return sorted(r.m for r in items.select("text").mapInArrow(flat.tidy(run), "m int").distinct().collect())


def _held(items: DataFrame, max_held: int):
    """The items as every task holds them, or None if they are too many."""
    words = F.size(F.split("text", r"[^\p{L}\p{N}]+"))
    size = items.select(F.sum(words.cast("bigint")).alias("n")).first().n or 0
    if size * (len(MASKS) + 1) > max_held:  # pieces are one hash for each word at most
        return None
    rows = items.orderBy("id", "text").collect()  # max_held hashes at most
    return items.sparkSession.sparkContext.broadcast(_Items([r.id for r in rows], [r.text for r in rows]))


def _items(benchmark: DataFrame) -> DataFrame:
    return _ids(benchmark, "item_id").where(F.col("text").isNotNull()).dropDuplicates()


def overlaps(docs: DataFrame, benchmark: DataFrame, max_held: int = MAX_HELD) -> DataFrame:
    """doc_id, item_id, start_word, end_word, n_equal, n_item_words: the longest overlap of each row and item."""
    docs, items = _ids(docs, "doc_id"), _items(benchmark)
    held = _held(items, max_held)
    if held is None:
        found = _joined(docs, items)
        named = items.select(F.col("id").alias("item_id"), F.md5("text").alias("item_t"))
        rows = docs.where("text is not null").select(F.col("id").alias("doc_id"), F.md5("text").alias("t")).join(found, "t").join(named, "item_t")
        return rows.select(*[x.split()[0] for x in _FOUND.split(", ")])

    def run(batches):
        own = held.value
        for batch in batches:
            _, offs = flat.flatten(batch.column(1))
            for a, b in flat.chunks(offs):
                found = own.find(batch.column(1).slice(a, b - a))
                if found:
                    doc, item, start, end, n = (np.array(x, np.int64) for x in zip(*found))
                    sizes = np.array([len(own.words[i]) for i in item], np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a + doc)), pa.array([own.ids[i] for i in item], pa.int64()), pa.array(start), pa.array(end), pa.array(n), pa.array(sizes)], _FOUND.replace(" bigint", "").split(", "))

    return docs.mapInArrow(flat.tidy(run), _FOUND)


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """t, item_t (MD5 of the texts) and the rest of an overlap, for a benchmark of any size: hashes are joined by value, then hits with texts."""
    texts = store.keep(docs.where("text is not null").select(F.md5("text").alias("t"), "text").dropDuplicates(["t"]), "distinct-texts")
    wanted = items.select(F.md5("text").alias("t"), "text").dropDuplicates(["t"])
    left, right = _hash_rows(texts, _lengths(items)), _hash_rows(wanted).select(F.col("t").alias("item_t"), F.col("place").alias("at"), "value")
    hits = left.join(right, "value").groupBy("t", "item_t", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.count("*").alias("n"))
    by_pair = store.keep(hits.groupBy("t", "item_t").agg(F.sort_array(F.collect_set("diagonal")).alias("diagonals")), "hits")
    pairs = by_pair.join(wanted.select(F.col("t").alias("item_t"), F.col("text").alias("item")), "item_t").join(texts, "t")

    def run(batches):
        for batch in batches:
            t, i = _Text(batch.column("text")), _Text(batch.column("item"))
            out = []
            for row, diagonals in enumerate(batch.column("diagonals").to_pylist()):
                doc, item = t.names[t.first[row] : t.first[row + 1]], i.names[i.first[row] : i.first[row + 1]]
                best = None
                for got in (_verify(doc, item, d) for d in diagonals):
                    if got and (best is None or got[2] > best[2]):
                        best = got
                if best:
                    out.append((row, *best, len(item)))
            if out:
                row, *rest = (np.array(x, np.int64) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(row)) for c in ("t", "item_t")] + [pa.array(x) for x in rest], ["t", "item_t", "start_word", "end_word", "n_equal", "n_item_words"])

    return pairs.select("t", "item_t", "diagonals", "item", "text").mapInArrow(flat.tidy(run), "t string, item_t string, start_word bigint, end_word bigint, n_equal bigint, n_item_words bigint")


def clean(docs: DataFrame, benchmark: DataFrame, max_held: int = MAX_HELD) -> DataFrame:
    """The rows of docs whose text overlaps with no item, with their own columns; each row is judged by its own text, whatever its id."""
    items, names = _items(benchmark), docs.columns
    at = names.index("text")
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    held = _held(items, max_held)
    if held is None:
        found = _joined(plain.select(F.col(f"c{at}").alias("text")), items).select("t").distinct()
        left = plain.join(found, F.md5(f"c{at}") == F.col("t"), "left_anti")
    else:

        def run(batches):
            own = held.value
            for batch in batches:
                _, offs = flat.flatten(batch.column(at))
                keep = np.ones(batch.num_rows, bool)
                for a, b in flat.chunks(offs):
                    keep[[a + f[0] for f in own.find(batch.column(at).slice(a, b - a))]] = False
                yield batch.filter(pa.array(keep))

        left = plain.mapInArrow(flat.tidy(run), plain.schema)
    return left.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
