"""Token ids of a corpus in Simple-8b segments, in ascending order of doc_id.

write() sorts the documents by range partitions, encodes their whole texts and stores segments:
rows of a Parquet table, so that any store Spark can write to holds them, and a lost task is done
again by Spark's own commit protocol. read() decodes segments; each needs only itself and the sum
of the ids before it.

Null texts have no ids but the end id; null doc_ids come first; rows that repeat a doc_id stay
apart, ordered by text. An empty table gives an empty file. Other columns are not looked at.
A document lies within one segment, so one task holds the ids of the longest document.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import flat, simple8b, tokens

_SEGMENTS = "part int, place long, doc_ids array<bigint>, n_ids bigint, start bigint, segment binary"


def write(docs: DataFrame, path: str, tokenizer: str, words: bool, end_id: int) -> None:
    """tokenizer: name of a public tokenizers file, or a path that every machine has; words: whether it drops white space; end_id ends each document."""

    def encode(batches):
        part, place, start = TaskContext.get().partitionId(), 0, 0
        coder = tokens.coder(tokenizer, words)
        for batch in batches:
            data, offs = flat.flatten(batch.column(1))
            for a, b in flat.chunks(offs):
                ids, at = coder.encode(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], end_id)
                doc_ids = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(0).slice(a, b - a))
                segment = simple8b.pack(ids, np.diff(at))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([place]), doc_ids, pa.array([len(ids)]), pa.array([start]), pa.array([segment], pa.binary())], ["part", "place", "doc_ids", "n_ids", "start", "segment"])
                place, start = place + 1, start + len(ids)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(flat.tidy(encode), _SEGMENTS).write.parquet(path)


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start (ids before it in the whole file), n_tokens, ids_crc32, and with ids the ids themselves."""
    segments = spark.read.parquet(path)
    sums = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each task that wrote
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * ids

    def decode(batches):
        for batch in batches:
            doc_ids, segs, starts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for i, start in enumerate(starts):
                values, lengths = simple8b.unpack(segs[i].as_py())
                ends = np.cumsum(lengths)
                raw = memoryview(values.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                columns = [doc_ids[i].values, pa.array(start + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(values.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    rows = segments.select("part", "doc_ids", "segment", "start").join(F.broadcast(before), "part")  # a row for each task that wrote
    return rows.select("doc_ids", "segment", (F.col("start") + F.col("before")).alias("start")).mapInArrow(flat.tidy(decode), schema)
