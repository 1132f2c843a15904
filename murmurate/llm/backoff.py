"""Stupid-backoff scores of documents under a bigram model counted over the corpus itself.

score of a word = c(previous, word) / c(previous) where the pair occurs min_pair times or more in the corpus, else
alpha * c(word) / N (a text's first word: c(word) / N); a document's score is the sum of the logarithms.

The tables are partitioned by hash and joined to the documents' own n-grams, summed per document:
1. words are counted (pre-aggregated by task) and kept: the word table;
2. pairs of two hot words are counted in the same way: the table of hot pairs. Hot is what makes up 1 / hot of all words
   or more, so there are hot such words and as many such pairs at most, however large the corpus. Tasks know both tables;
3. all other n-grams are exploded, each pair and document of a part of the text once, and dealt by the hash of their
   word, those of hot words by the hash of the pair; where they meet, pairs are counted and scored (hot pairs are
   scored where they stand);
4. c(previous) of pairs that were found is left where it isn't known: a row for each document and word, joined to the
   word table.
N-grams travel as sorted binary arrays: a row holds those of a part of the text for one group, so there are never more
rows than n-grams; a group's sums travel in the same way, a row for each bucket of documents, where they are added up.
A group holds some GROUP_WORDS n-grams; of a pair that isn't hot, N / hot at most meet in one.

Null, empty and blank texts score 0 with 0 words. Words are as they stand, in 64-bit names. Rows with null ids are
scored and counted; rows that repeat a doc_id are one document (their counts and scores add up). An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat, store

MIN_PAIR, ALPHA = 2, 0.4
#: N-grams of a group, about; bytes of text whose n-grams are sorted together.
GROUP_WORDS, CHUNK = 1_000_000, 6_000_000
#: Least and most hot words; between, so many that what isn't hot fits a quarter of a group.
HOT, MOST_HOT = 1_000, 1_000_000
#: Words that tasks know the count of: those that occur LEAST_KNOWN times, or twice, four times, ... that where it takes it
#: to have KNOWN of them at most.
LEAST_KNOWN, KNOWN = 5, 1_000_000
#: Stands for the word before a text; mix(0) is 0, so not that.
_BEGIN = np.uint64(1)


def _names(batches):
    """Names of words, first word of each text, and the other columns of these rows; CHUNK bytes of text at a time, from several batches."""
    names, sizes, rows, held = [], [], [], 0

    def part():
        whole = pa.Table.from_batches(rows).combine_chunks() if rows[0].num_columns else None
        return np.maximum(np.concatenate(names), np.uint64(2)), np.append(0, np.cumsum(np.concatenate(sizes))), whole

    for batch in batches:
        data, offs = flat.flatten(batch.column(0))
        other = batch.remove_column(0)
        for x, y in flat.chunks(offs):
            w = flat.Words(data[offs[x] : offs[y]], offs[x : y + 1] - offs[x])
            names.append(w.names())
            sizes.append(np.diff(w.first))
            rows.append(other.slice(x, y - x))
            held += int(offs[y] - offs[x])
            if held >= CHUNK:
                yield part()
                names, sizes, rows, held = [], [], [], 0
    if names:
        yield part()


class _Counts:
    """Counts by keys of one or more columns, handed on when many are held."""

    def __init__(self):
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        self.waiting.append(np.unique(keys, return_counts=True))
        self.size += len(self.waiting[-1][0])
        if self.size > 400_000 and len(self.waiting) > 1:
            keys, back = np.unique(np.concatenate([k for k, _ in self.waiting]), return_inverse=True)
            self.waiting = [(keys, np.bincount(back, np.concatenate([n for _, n in self.waiting]), len(keys)).astype(np.int64))]
            self.size = len(keys) // 4  # merge again once as many are new

    def full(self) -> bool:
        return sum(len(k) for k, _ in self.waiting) > 1_500_000

    def rows(self) -> pa.RecordBatch:
        keys = np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in self.waiting)])
        n = np.concatenate([np.zeros(0, np.int64), *(n for _, n in self.waiting)])
        self.waiting, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])


def _counted(docs: DataFrame, which) -> DataFrame:
    """key, n over the whole corpus: how often which(names, first) gives a key."""

    def run(batches):
        counts = _Counts()
        for names, first, _ in _names(batches):
            counts.add(which(names, first))
            if counts.full():
                yield counts.rows()
        yield counts.rows()

    return docs.select("text").mapInArrow(flat.tidy(run), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def word_counts(docs: DataFrame) -> DataFrame:
    """word (its name), n."""
    return _counted(docs, lambda names, first: names).withColumnRenamed("key", "word")


def _previous(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    prev = np.append(_BEGIN, names[:-1])[: len(names)]
    prev[first[:-1][np.diff(first) > 0]] = _BEGIN
    return prev


def _pair(prev: np.ndarray, word: np.ndarray) -> np.ndarray:
    return flat.mix(word ^ flat.mix(prev))


class _Known:
    """Values of sorted keys."""

    def __init__(self, rows: DataFrame):
        got = rows.toArrow()
        keys, n = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy().astype(np.float64)
        order = np.argsort(keys)
        self.keys, self.n = keys[order], n[order]

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key; 0 of those that aren't known."""
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.n[at], 0.0)


#: Words of the documents of a bucket, about.
BUCKET_WORDS = 2_000_000
_PARTS = "bucket int, doc_id bigint, word bigint, due bigint, packed binary"
_DUE = ["bucket", "doc_id", "word", "due", "packed"]


def _bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (flat.mix(ids.view(np.uint64) ^ np.uint64(0x5B)) % np.uint64(buckets)).astype(np.int32)


def _sums(keys: np.ndarray, score: np.ndarray, words: np.ndarray, buckets: int) -> tuple[pa.Array, pa.Array]:
    """Bucket and packed sums of documents (keys: twice the id and 1, or 0 for no id, in ascending order)."""
    codec = zstandard.ZstdCompressor(level=1)
    own = _bucket(keys, buckets)
    order = np.argsort(own, kind="stable")
    begin = np.flatnonzero(np.append(True, own[order][1:] != own[order][:-1])[: len(own)])
    out = []
    for x in np.split(order, begin[1:]) if len(order) else []:
        raw = np.diff(keys[x], prepend=0).astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes() + words[x].astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()
        out.append(np.array([len(x)], np.int64).tobytes() + score[x].astype(np.float64).tobytes() + codec.compress(raw))
    return pa.array(own[order][begin], pa.int32()), pa.array(out, pa.binary())


def _added(rows: DataFrame) -> DataFrame:
    """doc_id, n_words, score of each document: rows of a bucket hold packed sums, or doc_id and score."""

    def planes(raw: bytes, n: int) -> np.ndarray:
        return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(np.int64).reshape(-1)

    def add(key, table):
        codec = zstandard.ZstdDecompressor()
        packed, ids = table.column("packed").combine_chunks(), table.column("doc_id").combine_chunks()
        alone = np.flatnonzero(~np.asarray(packed.is_valid()))
        ids = ids.take(pa.array(alone))
        keys = [np.where(np.asarray(ids.is_valid()), np.asarray(ids.fill_null(0)).astype(np.int64) * 2 + 1, 0)]
        score, words = [table.column("score").to_numpy()[alone]], [np.zeros(len(alone), np.int64)]
        for x in packed.drop_null():
            blob = x.as_buffer().to_pybytes()
            n = int(np.frombuffer(blob, np.int64, 1)[0])
            score.append(np.frombuffer(blob, np.float64, n, 8))
            raw = codec.decompress(blob[8 + 8 * n :])
            keys.append(np.cumsum(planes(raw[: 8 * n], n)))
            words.append(planes(raw[8 * n :], n))
        keys, score, words = (np.concatenate(x) for x in (keys, score, words))
        got, back = np.unique(keys, return_inverse=True)
        n = np.bincount(back, words, len(got)).astype(np.int64)
        return pa.table([pa.array(got >> 1, mask=got == 0), pa.array(n), pa.array(np.bincount(back, score, len(got)))], ["doc_id", "n_words", "score"])

    return rows.groupBy("bucket").applyInArrow(add, "doc_id bigint, n_words bigint, score double")


def _hot_scores(docs: DataFrame, words, pairs, buckets: int) -> DataFrame:
    """bucket, packed: the words of all documents, and the score of their hot pairs."""

    def run(batches):
        for w, first, rows in _names(batches):
            prev = _previous(w, first)
            n = pairs.value.of(_pair(prev, w))
            own = np.flatnonzero(n)
            value = np.zeros(len(w) + 1)
            value[1:][own] = np.log(n[own]) - np.log(words.value.of(prev[own]))
            score, size = np.diff(np.cumsum(value)[first]), np.diff(first)
            ids = rows.column(0).combine_chunks()
            keys, back = np.unique(np.where(np.asarray(ids.is_valid()), np.asarray(ids.fill_null(0)).astype(np.int64) * 2 + 1, 0), return_inverse=True)
            yield pa.RecordBatch.from_arrays([*_sums(keys, np.bincount(back, score, len(keys)), np.bincount(back, size, len(keys)), buckets)], ["bucket", "packed"])

    return docs.select("text", F.col("doc_id").cast("bigint").alias("doc_id")).mapInArrow(flat.tidy(run), "bucket int, packed binary")


def _ngrams(docs: DataFrame, groups: int, frequent: np.ndarray, pairs) -> DataFrame:
    """group, grams: packed n-grams (words, previous words, documents of each pair and how often)."""
    step = np.uint64(-(-(2**64) // groups) if groups > 1 else 2**64 - 1)

    def run(batches):
        codec = zstandard.ZstdCompressor(level=3)
        for w, first, rows in _names(batches):
            ids = rows.column(0).combine_chunks()
            valid, plain = np.asarray(ids.is_valid()), np.asarray(ids.fill_null(0)).astype(np.int64)
            doc, prev = np.repeat(np.arange(len(plain)), np.diff(first)), _previous(w, first)
            pair = _pair(prev, w)
            cold = np.flatnonzero(pairs.value.of(pair) == 0)
            w, prev, doc, pair = w[cold], prev[cold], doc[cold], pair[cold]
            by = np.where(np.isin(w, frequent), pair, flat.mix(w))
            order = np.argsort(pair, kind="stable")  # documents stay in order
            order = order[np.argsort(by[order], kind="stable")]
            del pair
            by, w, prev, doc = by[order], w[order], prev[order], doc[order]
            del order, cold
            n = len(by)
            if not n:
                continue
            new_by = np.append(True, by[1:] != by[:-1])
            new_pair = new_by | np.append(True, prev[1:] != prev[:-1])
            new_doc = new_pair | np.append(True, doc[1:] != doc[:-1])
            at_doc, at_pair, at_by = (np.flatnonzero(x) for x in (new_doc, new_pair, new_by))
            times = np.diff(np.append(at_doc, n))
            group = (by[at_by] // step).astype(np.int64)
            head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            edges = np.append(at_by[head], n)
            d, p, b = (np.searchsorted(x, edges) for x in (at_doc, at_pair, at_by))
            per_pair, per_by = np.diff(np.append(np.searchsorted(at_doc, at_pair), len(at_doc))), np.diff(np.append(np.searchsorted(at_pair, at_by), len(at_pair)))
            out = []
            for k in range(len(head)):  # groups that have n-grams here
                own, back = np.unique(doc[at_doc[d[k] : d[k + 1]]], return_inverse=True)
                light = np.concatenate([per_by[b[k] : b[k + 1]], per_pair[p[k] : p[k + 1]], back, times[d[k] : d[k + 1]]]).astype(np.uint32)
                planes = light.view(np.uint8).reshape(-1, 4).T.tobytes()
                sizes = np.array([b[k + 1] - b[k], p[k + 1] - p[k], d[k + 1] - d[k], len(own)], np.uint32).tobytes()
                out.append(sizes + w[at_by[b[k] : b[k + 1]]].tobytes() + prev[at_pair[p[k] : p[k + 1]]].tobytes() + codec.compress(planes + plain[own].tobytes() + valid[own].astype(np.uint8).tobytes()))
                if len(out) == 500 or k == len(head) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(group[head[k + 1 - len(out) : k + 1]], pa.int32()), pa.array(out, pa.binary())], ["group", "grams"])
                    out = []

    return docs.select("text", F.col("doc_id").cast("bigint").alias("doc_id")).mapInArrow(flat.tidy(run), "group int, grams binary")


def _read(blob: bytes, codec) -> list[np.ndarray]:
    """Word and previous word of each pair, documents per pair, documents, how often, ids, and whether ids are given."""
    n_by, n_pair, n_doc, n_ids = np.frombuffer(blob, np.uint32, 4).tolist()
    w = np.frombuffer(blob, np.uint64, n_by, 16)
    prev = np.frombuffer(blob, np.uint64, n_pair, 16 + 8 * n_by)
    raw = np.frombuffer(codec.decompress(blob[16 + 8 * (n_by + n_pair) :]), np.uint8)
    n = n_by + n_pair + 2 * n_doc
    light = np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view(np.uint32).reshape(-1).astype(np.int64)
    per_by, per_pair, doc, times = np.split(light, np.cumsum([n_by, n_pair, n_doc]))
    ids = np.frombuffer(raw[4 * n : 4 * n + 8 * n_ids].tobytes(), np.int64)
    return [np.repeat(w, per_by), prev, per_pair, doc, times, ids, raw[4 * n + 8 * n_ids :].astype(bool)]


def _scored(grams: DataFrame, words, total: int, buckets: int, min_pair: int, alpha: float) -> DataFrame:
    """bucket, and packed sums or: doc_id, word whose count is still due, how often."""

    def score(key, table):
        codec = zstandard.ZstdDecompressor()
        parts = [_read(b.as_buffer().to_pybytes(), codec) for b in table.column("grams").combine_chunks()]
        w, prev, per_pair, doc, times = (np.concatenate([p[i] for p in parts]) for i in range(5))
        doc += np.repeat(np.cumsum([0] + [len(p[5]) for p in parts[:-1]]), [len(p[3]) for p in parts])
        ids, valid = np.concatenate([p[5] for p in parts]), np.concatenate([p[6] for p in parts])
        del parts
        flat.trim()
        at = np.repeat(np.arange(len(prev)), per_pair)
        here = np.bincount(at, times, len(prev))
        _, back = np.unique(_pair(prev, w), return_inverse=True)
        of_pair = np.bincount(back, here)[back]
        _, back = np.unique(w, return_inverse=True)
        known = words.value.of(w)
        of_word = np.where(known > 0, known, np.bincount(back, here)[back])
        begins = prev == _BEGIN
        found = (of_pair >= min_pair) & ~begins
        known = words.value.of(prev)
        backed_off = np.log(of_word) - np.log(total) + np.where(begins, 0.0, np.log(alpha))
        value = np.where(found, np.log(of_pair) - np.log(np.maximum(known, 1)), backed_off)
        due = found & (known == 0)
        keys, back = np.unique(np.where(valid, ids * 2 + 1, 0), return_inverse=True)
        doc = back[doc]
        buckets_, packed = _sums(keys, np.bincount(doc, value[at] * times, len(keys)), np.zeros(len(keys)), buckets)
        left = np.flatnonzero(due[at])
        _, one, back = np.unique(flat.mix(prev[at[left]] ^ flat.mix(doc[left].astype(np.uint64))), return_index=True, return_inverse=True)
        owed, of = np.bincount(back, times[left], len(one)).astype(np.int64), keys[doc[left[one]]]
        n, m = len(packed), len(one)
        columns = [
            pa.concat_arrays([buckets_, pa.array(_bucket(of, buckets))]), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(of >> 1, mask=of == 0)]),
            pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(prev[at[left[one]]].view(np.int64))]), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(owed)]),
            pa.concat_arrays([packed, pa.nulls(m, pa.binary())]),
        ]
        return pa.table(columns, _DUE)

    return grams.groupBy("group").applyInArrow(score, _PARTS)


def scores(docs: DataFrame, min_pair: int = MIN_PAIR, alpha: float = ALPHA) -> DataFrame:
    """doc_id, n_words, score (sum of natural logarithms), per_word (their mean; null without words)."""
    spark = docs.sparkSession
    table = store.keep(word_counts(docs), "word-counts")
    total = table.agg(F.sum("n").alias("n")).first().n or 1
    hot = min(MOST_HOT, max(HOT, total * 4 // GROUP_WORDS))
    times = F.floor(F.log2(F.col("n") / LEAST_KNOWN)).cast("int")
    sizes = {r.times: r["count"] for r in table.where(F.col("n") >= LEAST_KNOWN).groupBy(times.alias("times")).count().collect()}  # 64 rows at most
    least = next(k for k in range(64) if sum(n for t, n in sizes.items() if t >= k) <= KNOWN)
    counts = _Known(table.where((F.col("n") >= LEAST_KNOWN * 2**least) | (F.col("n") * hot >= total)))  # KNOWN + hot rows at most
    words, frequent = spark.sparkContext.broadcast(counts), counts.keys[counts.n * hot >= total]

    def hot_pairs(names: np.ndarray, first: np.ndarray) -> np.ndarray:
        prev = _previous(names, first)
        own = np.isin(names, frequent) & np.isin(prev, frequent)
        return _pair(prev[own], names[own])

    pairs = spark.sparkContext.broadcast(_Known(_counted(docs, hot_pairs).where((F.col("n") * hot >= total) & (F.col("n") >= min_pair))))  # hot rows at most
    grams = _ngrams(docs, max(1, -(-total // GROUP_WORDS)), frequent, pairs)
    buckets = max(1, -(-total // BUCKET_WORDS))
    parts = _scored(grams, words, total, buckets, min_pair, alpha)
    owed = parts.join(table.select(F.col("word").alias("of"), "n"), (F.col("word") == F.col("of")) & (F.col("due") > 0), "left")
    rows = owed.select("bucket", "doc_id", (-F.col("due") * F.log("n")).alias("score"), "packed")
    whole = _hot_scores(docs, words, pairs, buckets).select("bucket", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("double").alias("score"), "packed")
    sums = _added(rows.unionByName(whole))
    return sums.select("doc_id", "n_words", "score", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")).alias("per_word"))
