"""Documents packed into sequences of a fixed number of tokens, by shortest-pack-first over the histogram of lengths.

A document is cut into pieces of the full length and one of the rest. The histogram has at most as
many entries as a sequence has tokens, so the plan is made on the driver whatever the corpus holds:
lengths are placed longest first, each into the packs that are shortest so far, and what is kept is how
often each packing pattern occurs. The n-th piece of a length then finds its place in the plan.

Null texts are empty documents (their end id alone); null and repeated doc_ids are kept as they are;
an empty table gives no pieces. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import flat, store, tokens

#: Pieces of one length that are ranked together.
RANK_ROWS = 20_000
_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, ids: bool = False) -> DataFrame:
    """The documents' ids cut into pieces of at most size; with ids, the ids too."""

    def cut(batches):
        coder = tokens.coder(tokenizer, False)
        for batch in batches:
            data, offs = flat.flatten(batch.column(1))
            for a, b in flat.chunks(offs):
                values, at = coder.encode(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], end_id)
                total = np.diff(at)
                row, place = flat.spread(-(-total // size))
                start = place * size
                length = np.minimum(size, total[row] - start)
                begin = at[row] + start
                raw = memoryview(values.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * s : 4 * (s + n)]) for s, n in zip(begin.tolist(), length.tolist())]
                columns = [batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total[row])]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, at[-1]), pa.int32()), pa.array(values.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(columns)])

    def forgetting(batches):  # workers are used again by other stages, which need the memory
        yield from cut(batches)
        tokens.coder(tokenizer, False).clear()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(flat.tidy(forgetting), _PIECES + ", ids array<bigint>" * ids)


def plan(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, longest first) and how often each occurs."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by the room left
    rooms: list[int] = []  # that have patterns, in ascending order
    for length in sorted(counts, reverse=True):
        left, made = counts[length], []
        while left:
            room = max((r for r in rooms if open_[r]), default=0)
            if room < length:
                made.append((size - length, (length,), left))
                left = 0
                continue
            pattern, n = open_[room].pop()
            # as many of this length as keep the pack the shortest one, or fill it
            fit = max(1, min(room // length, -(-left // n)))
            take = min(n, left // fit) or 1
            if take * fit > left:
                fit = left
            if n > take:
                open_[room].append((pattern, n - take))
            made.append((room - fit * length, pattern + (length,) * fit, take))
            left -= take * fit
        for room, pattern, n in made:
            open_[room].append((pattern, n))
        rooms = sorted(r for r, x in open_.items() if x and r)
    return [x for room in sorted(open_) for x in open_[room]]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """For each length, ranks from lo on: sequence = base + (rank - lo) // times, offset = at + (rank - lo) % times * length."""
    rows, base, ranked = [], 0, defaultdict(int)
    for pattern, n in patterns:
        at = 0
        for length in dict.fromkeys(pattern):
            times = pattern.count(length)
            rows.append((length, ranked[length], base, times, at))
            ranked[length] += n * times
            at += length * times
        base += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(parts: DataFrame, size: int) -> DataFrame:
    """Adds sequence_id and offset to kept pieces (which are read three times)."""
    spark = parts.sparkSession
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most size rows
    table = places(plan(counts, size))
    groups = spark.createDataFrame([(k, -(-n // RANK_ROWS)) for k, n in counts.items()] or [(0, 1)], "length bigint, groups bigint")
    dealt = parts.join(F.broadcast(groups), "length").withColumn("group", F.pmod(F.xxhash64("doc_id", "start"), "groups")).drop("groups")
    sums = dealt.groupBy("length", "group").agg(F.count("*").alias("n"))
    before = sums.select("length", "group", (F.sum("n").over(Window.partitionBy("length").orderBy("group")) - F.col("n")).alias("before"))
    own = Window.partitionBy("length", "group").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("own", F.row_number().over(own) - 1).join(before, ["length", "group"])
    names = [c for c in parts.columns]
    ranked = ranked.select(*names, (F.col("own") + F.col("before")).alias("rank"))

    def place(batches):
        first = np.searchsorted(table[:, 0], np.arange(size + 2))
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy()
            rank = batch.column(len(names)).to_numpy()
            row = np.empty(len(rank), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                row[own] = first[n] + np.searchsorted(table[first[n] : first[n + 1], 1], rank[own], "right") - 1
            _, lo, base, times, at = table[row].T
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(base + (rank - lo) // times), pa.array(at + (rank - lo) % times * length)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id bigint, offset bigint"
    return ranked.mapInArrow(flat.tidy(place), schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, size: int = 2048, ids: bool = False) -> DataFrame:
    """A row for each piece, with its sequence and offset there; the pieces are kept in the shared folder meanwhile."""
    return pack(store.keep(pieces(docs, tokenizer, end_id, size, ids), "pieces"), size)
