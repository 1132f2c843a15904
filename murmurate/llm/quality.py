"""Quality by compression: text of a class compresses best behind a dictionary of that class.

fit() builds one zstandard dictionary from good and one from bad labelled text, and calibrates on labelled
texts that went into neither: d is the difference of a text's two compressed sizes over its own size, and score(d)
is the rising step function that fits the held labels best, each class weighing what it has in all. The sample is bounded (ROWS of each class); scoring compresses whole texts of any length.

Null and empty texts have d = 0 and get that score; without labels of both classes every score is 0.5.
Repeated rows are scored each; an empty table gives no rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat, labelled

#: Labelled documents of each class that a model is fitted to, at most.
ROWS = 4000
#: Bytes of a dictionary.
DICTIONARY = 32 * 1024
LEVEL = 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    #: Differences and the scores there; between them scores are interpolated.
    at: np.ndarray
    level: np.ndarray

    def differences(self, texts: list[bytes]) -> np.ndarray:
        """Above 0 where a text compresses better behind the good dictionary."""
        if not (self.good and self.bad):
            return np.zeros(len(texts))
        a, b = _compressor(self.good), _compressor(self.bad)
        out = np.zeros(len(texts))
        for i, t in enumerate(texts):
            if t:
                g, x = len(a.compress(t)), len(b.compress(t))
                out[i] = (x - g) / len(t)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return np.interp(self.differences(texts), self.at, self.level)


_compressors: dict[bytes, zstandard.ZstdCompressor] = {}


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if dictionary not in _compressors:
        held = zstandard.ZstdCompressionDict(dictionary)
        held.precompute_compress(level=LEVEL)
        _compressors[dictionary] = zstandard.ZstdCompressor(dict_data=held, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)
    return _compressors[dictionary]


def _dictionary(texts: list[bytes]) -> bytes:
    """Trained where there is enough text, else the text itself."""
    try:
        return zstandard.train_dictionary(DICTIONARY, texts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[:DICTIONARY] or b" "


def _rising(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising step function with the least weighted square error, by pooling adjacent violators."""
    blocks: list[list[float]] = []  # mean, weight, from, to
    for i in np.argsort(x, kind="stable"):
        blocks.append([y[i], weight[i], x[i], x[i]])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            m, w, _, end = blocks.pop()
            last = blocks[-1]
            blocks[-1] = [(last[0] * last[1] + m * w) / (last[1] + w), last[1] + w, last[2], end]
    return np.array([v for b in blocks for v in b[2:]]), np.clip([b[0] for b in blocks for _ in "ab"], 0.001, 0.999)


def fit(rows: list[tuple[str, int]], totals: dict[int, int] | None = None) -> Model:
    """Of each class, even rows make the dictionary and odd rows calibrate. totals: how many each class has in all."""
    sides = {v: [t.encode() for t, y in rows if y == v and t.strip()] for v in (0, 1)}
    if min(map(len, sides.values())) < 2:
        return Model(b"", b"", np.zeros(1), np.full(1, 0.5))
    model = Model(_dictionary(sides[1][::2]), _dictionary(sides[0][::2]), np.zeros(1), np.full(1, 0.5))
    held = [(t, v) for v in (0, 1) for t in sides[v][1::2]]
    y = np.array([v for _, v in held], float)
    share = {v: (totals or {}).get(v, len(sides[v])) / len(sides[v]) for v in (0, 1)}
    model.at, model.level = _rising(model.differences([t for t, _ in held]), y, np.where(y == 1, share[1], share[0]))
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score (higher: label 1 likelier), predicted (score >= threshold)."""

    def run(batches):
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(1)]
            s = model.scores(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(flat.tidy(run), "doc_id bigint, score double, predicted int")


def train(docs: DataFrame, labels: DataFrame, learn, rows: int = ROWS) -> Model:
    return fit(*labelled.sample(docs, labels, "quality", learn, rows))
