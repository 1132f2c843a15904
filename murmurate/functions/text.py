"""Text functions as column expressions."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config
from .lists import EMPTY_WORDS, STOPWORDS

_EDGE = r"[\w'’]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body mentions it."""
    return F.transform(F.array(value), body)[0]


# The tokenizer's patterns.
_DROPPED = (r"https?://\S+", r"(?U)\b[\w-]+(?:\.[\w-]+)+(?:/\S*)?", r"(?U)@[\w.-]+")
_WORD = r"#?[a-z][a-z0-9'’_-]{1,29}"
_NOVELTY_WORD = r"[a-z][a-z']{2,}"


def words(text: Column) -> Column:
    """Small-letter words and hashtags, without URLs, hosts and mentions."""
    t = F.lower(text)
    for pattern in _DROPPED:
        t = F.regexp_replace(t, pattern, " ")
    return F.regexp_extract_all(t, F.lit(_WORD), 0)


def is_content(word: Column) -> Column:
    return F.when(word.startswith("#"), F.length(word) > 2).otherwise((F.length(word) >= 3) & ~F.translate(word, "’", "'").isin(*EMPTY_WORDS))


def _neighbours(items: Column) -> Column:
    n = F.greatest(F.size(items) - 1, F.lit(0))
    return F.arrays_zip(F.slice(items, 1, n).alias("a"), F.slice(items, 2, n).alias("b"))


def extract_terms(text: Column, tags: Column | None = None) -> Column:
    """Content words, pairs of neighbours of which one has content, and hashtags; each once."""

    def of(marked: Column) -> Column:
        single = F.transform(F.filter(marked, lambda m: m["c"]), lambda m: m["w"])
        plain = lambda m: (F.length(m["w"]) >= 2) & ~m["w"].startswith("#")
        pairs = F.filter(_neighbours(marked), lambda p: (p["a"]["c"] | p["b"]["c"]) & plain(p["a"]) & plain(p["b"]))
        return F.concat(single, F.transform(pairs, lambda p: F.concat_ws(" ", p["a"]["w"], p["b"]["w"])))

    marked = F.transform(words(text), lambda w: F.struct(w.alias("w"), is_content(w).alias("c")))
    out = let(marked, of)
    if tags is not None:
        out = F.concat(out, F.transform(F.filter(tags, lambda t: F.trim(t) != ""), lambda t: F.concat(F.lit("#"), F.lower(F.trim(t)))))
    return F.array_distinct(F.coalesce(out, F.array().cast("array<string>")))


_EMPTY = frozenset(EMPTY_WORDS)


def terms_of(words: list[str]) -> dict[str, None]:
    """extract_terms of a text's words (without tags), in plain Python: keys in the same order."""
    content = [len(w) > 2 if w[0] == "#" else len(w) >= 3 and w.replace("’", "'") not in _EMPTY for w in words]
    out = dict.fromkeys(w for w, c in zip(words, content) if c)
    out.update(dict.fromkeys(f"{a} {b}" for a, b, c, d in zip(words, words[1:], content, content[1:]) if (c or d) and a[0] != "#" and b[0] != "#"))
    return out


def novelty_words(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(_NOVELTY_WORD), 0), lambda w: ~w.isin(*STOPWORDS))


def shingles(text: Column) -> Column:
    """Neighbouring words; of a text with one word that word."""
    pairs = lambda w: F.transform(_neighbours(w), lambda p: F.concat_ws(" ", p["a"], p["b"]))
    return F.array_distinct(let(words(text), lambda w: F.when(F.size(w) < 2, w).otherwise(pairs(w))))


def trend_tokens(text: Column) -> Column:
    """Words of three letters and more that aren't stop words, and all pairs of neighbours; each once."""
    of = lambda w: F.concat(F.filter(w, lambda x: (F.length(x) >= 3) & ~x.isin(*STOPWORDS)), F.transform(_neighbours(w), lambda p: F.concat_ws(" ", p["a"], p["b"])))
    return F.array_distinct(let(words(text), of))


def phrase_pattern(phrases: list[str]) -> str:
    """Whole phrases, in any case; an edge that is a letter or digit has none of those, nor an apostrophe, beside it."""
    parts = []
    for p in sorted({p.strip() for p in phrases if p.strip()}, key=lambda p: (-len(p), p)):
        parts.append((f"(?<!{_EDGE})" if p[0].isalnum() else "") + "\\Q" + p + "\\E" + (f"(?!{_EDGE})" if p[-1].isalnum() else ""))
    return "(?iuU)(?:" + "|".join(parts) + ")"


def matched_topics(text: Column, lang: Column, topics: list[dict]) -> Column:
    """Names of the topics whose phrases occur; a topic with langs takes texts in those or in none."""
    found = []
    for t in topics:
        hit = text.rlike(phrase_pattern(t["phrases"]))
        if t.get("langs"):
            hit = hit & (lang.isNull() | lang.isin(*t["langs"]))
        found.append(F.when(hit, F.lit(t["name"])))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def event_key(terms: Column, bucket: Column) -> Column:
    return F.concat(F.array_join(F.slice(F.array_sort(terms), 1, 3), "+"), F.lit("@"), bucket.cast("string"))


def _least(sums: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, size: int) -> pa.Array:
    """Signatures of sets of sizes items each. sums, lengths: every item's crc32 (-1: no item) and bytes. A checksum is linear: that of
    another seed differs from the first by what its length alone decides, the checksums of as many zero bytes."""
    top = 0xFFFFFFFF
    out = np.full((len(sizes), size), top, np.int64)
    known, which = np.unique(lengths, return_inverse=True)
    zeros = [bytes(int(n)) for n in known]
    shifts = [np.array([zlib.crc32(z, seed) ^ zlib.crc32(z) for z in zeros], np.uint32) for seed in range(size)]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    i = 0
    while i < len(sizes):  # some rows at a time, whose items stay in the processor's cache
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + 30000)))
        lo, hi = ends[i], ends[min(j, len(sizes))]
        held = i + np.flatnonzero(sizes[i:j])
        if len(held):
            first, at, missing = sums[lo:hi].astype(np.uint32), which[lo:hi], np.flatnonzero(sums[lo:hi] < 0)
            for seed, shift in enumerate(shifts):
                now = first ^ shift[at]
                now[missing] = top
                out[held, seed] = np.minimum.reduceat(now, ends[held] - lo)
        i = j
    return pa.ListArray.from_arrays(np.arange(0, out.size + 1, size, dtype=np.int32), pa.array(out.ravel()))


def minhash(items: Column, size: int = config.SIGNATURE) -> Column:
    """Least crc32 of the items for each of size seeds; of nothing, all bits set."""

    @F.arrow_udf("array<bigint>")
    def least(rows: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        flat = rows.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        return _least(np.where(flat < 0, -1, flat & 0xFFFFFFFF), np.maximum(flat >> 32, 0), sizes, size)

    raw = F.transform(items, lambda x: F.encode(x, "utf-8"))
    return least(F.transform(raw, lambda x: F.crc32(x) + F.shiftleft(F.length(x).cast("bigint"), 32)))


def signature(text: Column, size: int = config.SIGNATURE) -> Column:
    """minhash of the text's shingles; repeated ones change no minimum and are left in."""

    @F.arrow_udf("array<bigint>")
    def least(rows: pa.Array) -> pa.Array:
        sums, lengths, sizes = [], [], []
        for row in rows:
            w = (row.as_py() or "").encode().split()
            items = [a + b" " + b for a, b in zip(w, w[1:])] if len(w) > 1 else w
            sums += map(zlib.crc32, items)
            lengths += map(len, items)
            sizes.append(len(items))
        return _least(np.array(sums, np.int64), np.array(lengths, np.int64), np.array(sizes, np.int64), size)

    return least(F.array_join(words(text), " "))


def similarity(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)
