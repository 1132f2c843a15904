"""A ledger of quality rules: each rule is evaluated once and leaves a bit; policies and ablations only combine bits.

measure() reads whole texts and gives counts; ledger() adds failures, a long whose bit k is set where rule k fails;
decide() applies a policy (a named, versioned mask of rules); ablation() counts, from the histogram of failures, what a
policy rejects, and for each of its rules what would pass if only that rule were dropped.

Null and empty texts measure 0 everywhere. Rules compare products of counts, so they need no division. Repeated rows
are measured each; an empty table gives no rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import flat

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_letters", "n_long_words"]
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
#: Code points of a word that counts as long.
LONG = 40

_c = F.col


def rules() -> list[tuple[int, str, Column]]:
    """Bit, name, and when a text fails. A rule keeps its bit for good."""
    return [
        (0, "few_words", _c("n_words") < 10),
        (1, "repeated_words", 100 * _c("n_repeat_words") > 20 * _c("n_words")),
        (2, "symbols", 10 * _c("n_symbols") > 3 * _c("n_words")),
        (3, "duplicate_lines", 10 * _c("n_dup_lines") > 3 * _c("n_lines")),
        (4, "shouting", 10 * _c("n_upper") > 6 * _c("n_letters")),
        (5, "digits", 10 * _c("n_digits") > 3 * _c("word_chars")),
        (6, "short_words", _c("word_chars") < 2 * _c("n_words")),
        (7, "long_words", _c("word_chars") > 20 * _c("n_words")),
        (8, "very_long_words", 10 * _c("n_long_words") > _c("n_words")),
    ]


#: Names of rules by policy. A policy is never changed; a new version gets a new name.
POLICIES = {
    "base": ["few_words", "repeated_words"],
    "web-1": ["few_words", "repeated_words", "symbols", "duplicate_lines", "shouting"],
    "web-2": ["few_words", "repeated_words", "symbols", "duplicate_lines", "shouting", "digits", "short_words", "long_words", "very_long_words"],
}


def mask(policy: str) -> int:
    bits = {name: bit for bit, name, _ in rules()}
    return sum(1 << bits[name] for name in POLICIES[policy])


def counts(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The columns of _COUNTS for texts that lie in a row."""
    n = len(offs) - 1
    w = flat.Words(data, offs)

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums

    lead = (data & 0xC0) != 0x80
    chars = per_text(lead & w.inside)
    upper, digits = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    letters = upper | (data >= 97) & (data <= 122) | (data >= 0xC3) & lead
    by_text = [np.diff(per_text(x)[offs]) for x in (_SYMBOL[data], upper, digits, letters)]
    # lines: between line feeds and the borders of texts
    cut = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offs[:-1], cut + 1]))
    begin = begin[begin < len(data)]
    end = np.append(begin[1:], len(data))
    end = end - ((end > begin) & (data[np.maximum(end, 1) - 1] == 10)) if len(begin) else end
    doc = np.searchsorted(offs, begin, "right") - 1
    worded = chars[end] > chars[begin]
    begin, end, doc = begin[worded], end[worded], doc[worded]
    names = flat.hashes(data, begin, end)
    order = np.lexsort((names, doc))
    same = (names[order][1:] == names[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    dup_lines = np.bincount(doc[order][1:][same], minlength=n) if n else np.zeros(0, np.int64)
    # words within 5-word windows that the text holds twice
    word_doc = w.doc()
    own = np.flatnonzero(flat.gram_mask(w.first, 5))
    grams = flat.mix(flat.grams(w.names(), 5)[own] + word_doc[own].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) if len(own) else np.zeros(0, np.uint64)
    _, back, times = np.unique(grams, return_inverse=True, return_counts=True)
    twice = own[times[back] > 1]
    cover = np.zeros(len(w) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + 5, -1)
    repeated = np.diff(per_text(np.cumsum(cover)[: len(w)] > 0)[w.first])
    long_words = np.diff(per_text(chars[w.end] - chars[w.start] >= LONG)[w.first])
    symbols, n_upper, n_digits, n_letters = by_text
    return [np.diff(w.first), np.diff(chars[offs]), symbols, dup_lines, repeated, np.bincount(doc, minlength=n), n_upper, n_digits, n_letters, long_words]


def measure(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            data, offs = flat.flatten(batch.column(1))
            parts = [counts(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in flat.chunks(offs)]
            columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * len(_COUNTS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c.astype(np.int64)) for c in columns)], ["doc_id", *_COUNTS])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(flat.tidy(run), "doc_id bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS))


def ledger(measured: DataFrame) -> DataFrame:
    bits = [F.when(fails, F.lit(1 << bit)).otherwise(F.lit(0)).cast("bigint") for bit, _, fails in rules()]
    return measured.withColumn("failures", reduce(lambda a, b: a.bitwiseOR(b), bits))


def decide(rows: DataFrame, policy: str, column: str = "kept") -> DataFrame:
    return rows.withColumn(column, F.col("failures").bitwiseAND(F.lit(mask(policy)).cast("bigint")) == 0)


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """A row for each rule of the policy: documents that fail it, and that fail nothing else of the policy."""
    held = rows.groupBy(F.col("failures").bitwiseAND(F.lit(mask(policy)).cast("bigint")).alias("bits")).agg(F.count("*").alias("n"))
    named = [F.struct(F.lit(name).alias("rule"), F.lit(1 << bit).cast("bigint").alias("bit")) for bit, name, _ in rules() if name in POLICIES[policy]]
    each = held.select("bits", "n", F.explode(F.array(*named)).alias("r"))
    fails = F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)
    alone = F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)
    return each.groupBy(F.col("r.rule").alias("rule")).agg(F.sum(fails).alias("n_failed"), F.sum(alone).alias("n_failed_alone"))
