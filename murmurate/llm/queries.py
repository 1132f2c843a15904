"""The registered queries of this package, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff, decontaminate, labelled, neardup, packing, quality, repeats, rules, store, tokencount, tokenfile, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    store.bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of documents with benchmark items: a document without any has no row."""
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"), 85)


def op3_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.new_path(spark, "token-file")
    tokenfile.write(table(spark, sf_dir, "documents"), path, "word_bpe_49k.json", True, 2)
    return tokenfile.read(spark, path, ids=False)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), labelled.remainder("doc_id", 4) == 2
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~held)
    return quality.score(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", 1)


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.ledger(rules.measure(table(spark, sf_dir, "documents")))
    rows = rules.decide(rules.decide(rows, "base", "base_passed"), "web-2")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_passed")).alias("base_failed"), "kept", "failures")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), labelled.remainder("doc_id", 5) == 0
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held)
    return toxicity.score(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


def op9_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.scores(table(spark, sf_dir, "documents")).select("doc_id", "n_words", F.round("score", 3).alias("score"))


def op10_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontaminate, op2_neardup, op3_tokenfile, op4_quality, op5_repeats, op6_pack, op7_rules, op8_toxicity, op9_backoff, op10_tokencount)}


_WORD = r"[^\x20\x09-\x0D]+"

_OP2 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 85 * (x.n + y.n - p.c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS o FROM documents UNION SELECT e.b, r.o FROM r JOIN e ON e.a = r.v),
m AS (SELECT v, min(o) AS c FROM r GROUP BY v)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, w.doc_id = m.c AS kept
FROM w JOIN m ON m.v = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id"""

_OP5 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 48, 1))) AS i FROM w)),
f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM g JOIN f USING (h) WHERE f.first < doc_id),
x AS (SELECT doc_id, count(*) AS n, list(k) AS ks FROM c GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(x.n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN x.ks IS NULL THEN ws ELSE list_filter(ws, lambda v, k: NOT list_contains(x.ks, k)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN x ON x.doc_id = w.doc_id"""

_OP7 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORD}') AS ws FROM t),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1))) AS i FROM w)),
d AS (SELECT doc_id, unnest(list(i)) AS i FROM g GROUP BY doc_id, h HAVING count(*) > 1),
c AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM d) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n, count(DISTINCT line) AS u FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n - l.u, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    coalesce(l.n, 0) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits,
    length(regexp_replace(text, '[^A-Za-z\x{{C0}}-\x{{10FFFF}}]', '', 'g')) AS n_letters, len(list_filter(ws, lambda v: length(v) >= 40)) AS n_long_words
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id),
b AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
    + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END + CASE WHEN 10 * n_upper > 6 * n_letters THEN 16 ELSE 0 END + CASE WHEN 10 * n_digits > 3 * word_chars THEN 32 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 64 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 128 ELSE 0 END + CASE WHEN 10 * n_long_words > n_words THEN 256 ELSE 0 END)::BIGINT AS failures
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed, failures = 0 AS kept, failures FROM b"""

_OP9 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
o AS (SELECT doc_id, ws[i] AS word, CASE WHEN i > 1 THEN ws[i - 1] END AS prev FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
u AS (SELECT word, count(*) AS n FROM o GROUP BY word),
p AS (SELECT prev, word, count(*) AS n FROM o WHERE prev IS NOT NULL GROUP BY prev, word HAVING count(*) >= 2),
t AS (SELECT count(*) AS n FROM o),
v AS (
  SELECT o.doc_id, CASE WHEN p.n IS NOT NULL THEN ln(p.n) - ln(b.n) ELSE ln(u.n) - ln(t.n) + CASE WHEN o.prev IS NULL THEN 0 ELSE ln(0.4) END END AS s
  FROM o JOIN u ON u.word = o.word CROSS JOIN t LEFT JOIN p ON p.prev = o.prev AND p.word = o.word LEFT JOIN u b ON b.word = o.prev)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, round(coalesce(s.s, 0), 3) AS score FROM w LEFT JOIN (SELECT doc_id, sum(s) AS s FROM v GROUP BY doc_id) s ON s.doc_id = w.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op2_neardup": _OP2, "op5_repeats": _OP5, "op7_rules": _OP7, "op9_backoff": _OP9}
