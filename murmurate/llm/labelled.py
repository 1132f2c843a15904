"""Bounded samples of labelled documents, to fit a classifier on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def remainder(column: str, modulus: int):
    """crc32 of an id written as text, modulo modulus; null for null ids."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


#: A text of more bytes is not learned from; the texts of a class have so many bytes together at most.
MOST_TEXT, MOST_BYTES = 64_000, 16_000_000


def sample(docs: DataFrame, labels: DataFrame, label: str, learn, rows: int, most_bytes: int = MOST_BYTES) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """(text, label) of at most rows documents and most_bytes of each class, where learn holds for the labels' rows; and how many each class has in all.

    Which ones is decided by a hash of doc_id. A doc_id with several labels counts as 1 if any is 1;
    null ids, labels and texts are left out, and of documents that repeat a doc_id the least text is taken.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    one = one.withColumn("h", F.xxhash64("doc_id"))
    picked = None
    for value in (0, 1):
        part = one.where(F.col("label") == value).orderBy("h", "doc_id").limit(rows).select("doc_id", "label", "h")
        picked = part if picked is None else picked.unionByName(part)
    ids = picked.collect()  # 2 * rows at most
    if not ids:
        return [], {}
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id bigint, label int, h bigint")
    short = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.octet_length("text") <= MOST_TEXT)
    texts = short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label", "h").agg(F.min("text").alias("text"))
    so_far = F.sum(F.octet_length("text")).over(Window.partitionBy("label").orderBy("h", "doc_id"))  # rows at most
    got = texts.withColumn("so_far", so_far).where(F.col("so_far") <= most_bytes).select("doc_id", "text", "label").collect()
    return [(r.text, r.label) for r in sorted(got, key=lambda r: r.doc_id)], {r.label: r["count"] for r in one.groupBy("label").count().collect()}
