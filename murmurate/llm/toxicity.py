"""Toxicity by subword bags: a linear softmax over averaged embeddings of character n-grams.

A word is the average of the vectors of its n-grams (3 to 6 bytes, small ASCII letters, with its borders), a bag
the average of its words (one that recurs within WINDOW words counts once, the others as 0), so a misspelling that was never seen shares most of a known word's vectors. Vectors and
softmax are trained jointly. A text's logit is that of its most toxic WINDOW of words (or of the text, if shorter):
an insult weighs the same in a long text as in a short one. Training begins with whole texts as bags and then takes
each text's worst window by the model so far.

The sample is bounded (ROWS and BYTES of each class); scoring reads whole texts of any length. Texts without words (null, empty,
blank) get the bias alone, and without labels of both classes every score is 0. Repeated rows are scored each;
an empty table gives no rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import gc
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat, labelled, store

#: Labelled documents of each class that a model is fitted to, and their bytes, at most.
ROWS, BYTES = 2000, 4_000_000
BUCKET_BITS, SIZE, WINDOW = 17, 12, 12
#: Mini-batches of the first round and of each other one; rounds; folds for calibration.
FIRST_STEPS, STEPS, ROUNDS, FOLDS = 500, 150, 4, 3
_SLOT_BITS = 20


def ngrams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words, and each one's word, in the order of words."""
    size = end - start + 2
    row, place = flat.spread(size)
    edge = (place == 0) | (place == size[row] - 1)
    letters = flat.SMALL[data[np.minimum(start[row] + place - 1, len(data) - 1)]]
    letters[edge] = np.where(place[edge] == 0, 2, 3)
    last = np.cumsum(size)[row]  # where the word ends
    at = np.arange(len(row))
    words, buckets = [], []
    for n in (3, 4, 5, 6):
        own = at[at + n <= last]
        words.append(row[own])
        buckets.append((flat.hashes(letters, own, own + n) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    words, buckets = np.concatenate(words), np.concatenate(buckets)
    order = np.argsort(words, kind="stable")
    return buckets[order], words[order]


def recurring(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which words occur less than WINDOW words earlier in their text."""
    order = np.argsort(names, kind="stable")
    near = (names[order][1:] == names[order][:-1]) & (np.diff(order) < WINDOW)
    near &= np.searchsorted(first, order[1:], "right") == np.searchsorted(first, order[:-1], "right")
    out = np.zeros(len(names), bool)
    out[order[1:][near]] = True
    return out


def worst_windows(logits: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the mean logit of its worst window and that window's first word; first: where each text's words begin, and the end."""
    sums = np.append(0.0, np.cumsum(logits))
    tries = np.maximum(np.diff(first) - WINDOW + 1, 1)
    row, place = flat.spread(tries)
    begin = first[row] + place
    end = np.minimum(begin + WINDOW, first[row + 1])
    mean = (sums[end] - sums[begin]) / np.maximum(end - begin, 1)
    at = np.cumsum(tries) - tries
    if not len(at):
        return np.zeros(0), at
    top = np.maximum.reduceat(mean, at)
    hits = np.flatnonzero(mean == top[row])
    return top, begin[hits[np.searchsorted(hits, at)]]


@dataclass
class Model:
    #: What each n-gram adds to the logit: its vector along the difference of the softmax's two rows.
    weights: np.ndarray
    bias: float
    _keys: np.ndarray = field(default=None, repr=False)
    _known: np.ndarray = field(default=None, repr=False)

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "_keys": None, "_known": None}

    def words(self, w: flat.Words) -> np.ndarray:
        """The logit of each word; known words are looked up."""
        if self._keys is None:
            self._keys, self._known = np.zeros(1 << _SLOT_BITS, np.uint64), np.zeros(1 << _SLOT_BITS)
        names = w.names(lower=True)
        slot = (names >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        out = self._known[slot]
        miss = np.flatnonzero(self._keys[slot] != names)
        if len(miss):
            new, one, back = np.unique(names[miss], return_index=True, return_inverse=True)
            one = miss[one]
            buckets, word = ngrams(w.data, w.start[one], w.end[one])
            n = np.bincount(word, minlength=len(one))
            got = np.bincount(word, self.weights[buckets], len(one)) / np.maximum(n, 1)
            out[miss] = got[back]
            self._keys[slot[one]], self._known[slot[one]] = new, got
        out[recurring(names, w.first)] = 0
        return out

    def worst(self, w: flat.Words) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, the logit of its worst window (without bias) and that window's first word."""
        return worst_windows(self.words(w), w.first)

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        top, _ = self.worst(flat.Words(data, offs))
        return 1 / (1 + np.exp(-np.clip(top + self.bias, -40, 40)))


class _Trainer:
    """Adam on mini-batches of bags."""

    def __init__(self, texts: list[str], labels: np.ndarray):
        self.y = labels
        self.data, self.offs = flat.flatten(pa.array(texts, pa.large_string()))
        start, end, names, first = [], [], [], [np.zeros(1, np.int64)]
        for a, w in self._parts():
            start.append(w.start + self.offs[a])
            end.append(w.end + self.offs[a])
            names.append(w.names(lower=True))
            first.append(first[-1][-1] + w.first[1:])
        start, end, names, self.first = (np.concatenate(x) for x in (start, end, names, first))
        _, one, self.word = np.unique(names, return_index=True, return_inverse=True)
        self.word = self.word.astype(np.int32)
        grams, counts = [], []
        for own in np.array_split(one, max(1, len(one) // 20_000)):  # a part of the distinct words at a time
            buckets, owner = ngrams(self.data, start[own], end[own])
            grams.append(buckets.astype(np.int32))
            counts.append(np.bincount(owner, minlength=len(own)).astype(np.int32))
        self.gram, self.count = np.concatenate(grams), np.concatenate(counts)
        self.at = np.append(0, np.cumsum(self.count, dtype=np.int64))
        rng = np.random.default_rng(7)
        self.vectors = rng.normal(0, 0.1, (1 << BUCKET_BITS, SIZE)).astype(np.float32)
        self.soft = rng.normal(0, 0.3, (SIZE, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.vectors, self.soft, self.bias)]
        #: Marks of a step's n-grams and their columns in its bags.
        self.used, self.column = np.zeros(1 << BUCKET_BITS, bool), np.zeros(1 << BUCKET_BITS, np.int64)
        self.steps = 0
        self.rng = rng
        self.once = ~recurring(names, self.first)

    def _parts(self):
        """First text and words of a part of the texts at a time."""
        for a, b in flat.chunks(self.offs):
            yield a, flat.Words(self.data[self.offs[a] : self.offs[b]], self.offs[a : b + 1] - self.offs[a])

    def worst(self, model: Model) -> np.ndarray:
        """The first word of each text's worst window; the n-grams of distinct words are known already."""
        owner = np.repeat(np.arange(len(self.count), dtype=np.int32), self.count)
        known = np.bincount(owner, model.weights[self.gram], len(self.count)) / np.maximum(self.count, 1)
        out = []
        for a, b in flat.chunks(self.offs):
            own = slice(self.first[a], self.first[b])
            out.append(worst_windows(np.where(self.once[own], known[self.word[own]], 0.0), self.first[a : b + 1] - self.first[a])[1] + self.first[a])
        return np.concatenate(out)

    def bag(self, docs: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """N-grams in the bags of these texts, and how much each weighs in which."""
        row, place = flat.spread(end - begin)
        word = self.word[begin[row] + place]
        inner, k = flat.spread(self.count[word])
        gram = self.gram[self.at[word][inner] + k]
        weight = (self.once[begin[row] + place] / (end - begin)[row])[inner] / self.count[word][inner]
        self.used[gram] = True
        own = np.flatnonzero(self.used)
        self.used[own], self.column[own] = False, np.arange(len(own))
        dense = np.bincount(row[inner] * len(own) + self.column[gram], weight, len(docs) * len(own)).reshape(len(docs), len(own))
        return own, dense.astype(np.float32)

    def step(self, docs: np.ndarray, begin: np.ndarray, end: np.ndarray, class_weight: np.ndarray, rate: float) -> None:
        own, x = self.bag(docs, begin, end)
        vectors = self.vectors.take(own, 0)
        hidden = x @ vectors
        logits = hidden @ self.soft + self.bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(docs)), self.y[docs]] -= 1
        p *= (class_weight[self.y[docs]] / len(docs))[:, None]
        grads = [x.T @ (p @ self.soft.T) + 1e-6 * vectors, hidden.T @ p, p.sum(0)]
        self.steps += 1
        for i, (param, g) in enumerate(zip((self.vectors, self.soft, self.bias), grads)):
            m, v = ((x.take(own, 0) for x in self.moments[i]) if i == 0 else self.moments[i])
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            spread = 0.01 * g
            spread *= g
            v += spread
            np.sqrt(np.divide(v, 1 - 0.99**self.steps, out=spread), out=spread)
            spread += 1e-8
            move = np.divide(m, 1 - 0.9**self.steps, out=g)
            move *= rate
            move /= spread
            if i == 0:  # only the rows of this step's n-grams
                vectors -= move
                param[own], self.moments[i][0][own], self.moments[i][1][own] = vectors, m, v
            else:
                param -= move

    def model(self) -> Model:
        way = (self.soft[:, 1] - self.soft[:, 0]).astype(np.float64)
        seen = np.zeros(1 << BUCKET_BITS, bool)
        seen[self.gram] = True  # vectors that were never trained say nothing
        return Model(np.where(seen, self.vectors.astype(np.float64) @ way, 0.0), float(self.bias[1] - self.bias[0]))


def _trained(rows: list[tuple[str, int]], first_steps: int = FIRST_STEPS, steps: int = STEPS, rounds: int = ROUNDS) -> Model:
    """A model whose logits are not calibrated yet. Mini-batches of 16 whole texts, then of 48 worst windows, as many for any sample."""
    y = np.array([v for _, v in rows], np.int64)
    trainer = _Trainer([t for t, _ in rows], y)
    first = trainer.first
    begin, end = first[:-1], first[1:]
    weight = len(y) / (2 * np.bincount(y, minlength=2))
    for k in range(rounds):
        left = steps if k else first_steps
        while left > 0:
            order = trainer.rng.permutation(len(y))
            for docs in np.array_split(order, max(1, len(y) // (48 if k else 16)))[:left]:
                trainer.step(docs, begin[docs], end[docs], weight, 0.02 if k < rounds - 1 else 0.005)
                left -= 1
        at = trainer.worst(trainer.model())
        begin, end = at, np.minimum(at + WINDOW, first[1:])
    return trainer.model()


def _top(model: Model, texts: list[str]) -> np.ndarray:
    data, offs = flat.flatten(pa.array(texts, pa.large_string()))
    return np.concatenate([model.worst(flat.Words(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]))[0] for a, b in flat.chunks(offs)])


def fit(rows: list[tuple[str, int]], totals: dict[int, int] | None = None) -> Model:
    """Scale and bias come from all rows, each scored by a model of the other FOLDS - 1 folds; each class weighs what it has in all (totals)."""
    rows = [(t, y) for t, y in rows if t and t.strip()]
    y = np.array([v for _, v in rows], np.int64)
    if len(np.unique(y)) < 2:
        return Model(np.zeros(1 << BUCKET_BITS), -40.0)
    fold = np.empty(len(y), np.int64)
    for v in (0, 1):  # every fold has its share of both classes
        own = np.flatnonzero(y == v)
        fold[own] = np.arange(len(own)) % FOLDS
    top, scored = np.zeros(len(y)), np.zeros(len(y), bool)
    for k in range(FOLDS):
        rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(own) and len(np.unique(y[rest])) == 2:
            gc.collect()
            flat.trim()
            top[own] = _top(_trained([rows[i] for i in rest]), [rows[i][0] for i in own])
            scored[own] = True
    model = _trained(rows)
    if len(np.unique(y[scored])) == 2:
        own = y[scored]
        share = np.array([(totals or {}).get(v, (own == v).sum()) / (own == v).sum() for v in (0, 1)], float)
        scale, model.bias = _logistic(top[scored], own.astype(float), share[own] / share[own].mean())
        model.weights *= scale
        model._keys = None
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (above 0) and bias by Newton's method; a light penalty keeps separable data finite."""
    z, w = np.column_stack([x, np.ones(len(x))]), np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        g = z.T @ (weight * (p - y)) + 0.01 * np.array([w[0], 0.0])
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([0.01, 1e-6])
        w -= np.clip(np.linalg.solve(h, g), -1, 1)
    return max(float(w[0]), 1e-3), float(w[1])


def _scores(own: Model, column: pa.Array) -> np.ndarray:
    data, offs = flat.flatten(column)
    return np.concatenate([np.zeros(0), *(own.scores(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in flat.chunks(offs))])


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, score (higher: toxic likelier), predicted (score >= threshold)."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**BUCKET_BITS numbers

    def run(batches):
        for batch in batches:
            s = _scores(held.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(flat.tidy(run), "doc_id bigint, score double, predicted int")


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below threshold, with their own columns."""
    names = docs.columns
    at = names.index("text")
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(held.value, batch.column(at)) < threshold))

    return plain.mapInArrow(flat.tidy(run), plain.schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def train(docs: DataFrame, labels: DataFrame, learn, rows: int = ROWS) -> Model:
    got = labelled.sample(docs, labels, "toxic", learn, rows, BYTES)
    store.rest(docs.sparkSession)  # training needs the driver's Python most
    model = fit(*got)
    flat.trim()
    return model
