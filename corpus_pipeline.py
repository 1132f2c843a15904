"""documents to packed training sequences: toxicity, near duplicates, repeated passages, benchmark overlaps, packing.

Each stage reads what its predecessor kept, as Parquet, and works on all of it; all but the last return the columns of
documents. Rows with a null doc_id pass (they are no duplicate and repeat nothing), null texts are empty documents,
and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from murmurate.llm import decontaminate, labelled, neardup, packing, repeats, store, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below 0.5."""
    store.bounded_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, labelled.remainder("doc_id", 5) != 0)
    return toxicity.reject(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group that links of similarity 0.8 and more make."""
    return neardup.keep_one(docs, 80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words and more that an earlier document has; n_chars follows the text."""
    from pyspark.sql import functions as F

    cut = repeats.remove(docs)
    return cut.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in cut.columns else cut


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its place in sequences of 2048 tokens."""
    return packing.pack_documents(docs, "byte_bpe_50k.json", 1)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeats", cut_repeats), ("decontamination", drop_contaminated), ("packing", pack)]

#: Trained models, register sketches and packing have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
