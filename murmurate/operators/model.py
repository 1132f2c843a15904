"""Features of spikes, whether they hold, and the logistic model of it."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config

# The order of a model's weights.
FEATURES = ["log_hits", "zscore", "log_multiple", "baseline_silent", "share_per_mille", "coverage", "is_term", "is_multiword", "is_hashtag", "n_terms", "n_links", "log_bucket_minutes", "history_density", "log_window_posts", "hour_sin", "hour_cos"]


def density(order: Window) -> Column:
    return F.coalesce(F.avg(F.when(F.col("hits") > 0, 1.0).otherwise(0.0)).over(order.rowsBetween(-config.PRIOR, -1)), F.lit(0.0))


def features(rows: DataFrame, minutes: int, kind: str) -> DataFrame:
    """rows: scored with history_density, and terms and links where known (null: none). Adds the features."""
    angle = F.floor(F.col("start") / 3600) % 24 * (2 * math.pi / 24)
    size = lambda c: F.coalesce(F.size(c).cast("double"), F.lit(0.0)) if c in rows.columns else F.lit(0.0)
    made = {
        "log_hits": F.log1p("hits"), "zscore": F.least(F.col("zscore"), F.lit(config.Z_CAP)), "log_multiple": F.log1p("multiple"), "baseline_silent": (F.col("baseline") <= 0).cast("double"),
        "share_per_mille": F.col("share") * 1000, "is_term": F.lit(float(kind == "term")), "is_multiword": F.col("subject").contains(" ").cast("double"), "is_hashtag": F.col("subject").startswith("#").cast("double"),
        "n_terms": size("terms"), "n_links": size("links"), "log_bucket_minutes": F.lit(math.log1p(minutes)), "log_window_posts": F.log1p("total"), "hour_sin": F.sin(angle), "hour_cos": F.cos(angle),
    }
    return rows.withColumns(made)


def accuracy(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """The share of rows on the right side of 0.5."""
    return rows.agg(F.avg(((F.col(score) >= 0.5).cast("int") == F.col(label)).cast("double")).alias("accuracy"))


def persistence(series: DataFrame, scored: DataFrame) -> DataFrame:
    """label: 1 if at least 2 of the next 3 usable buckets keep half of the excess; null where the future is not known or there is no excess."""
    usable = series.where(F.col("coverage") >= config.MIN_COVERAGE)
    ahead = usable.select("subject", "start", F.collect_list("share").over(Window.partitionBy("subject").orderBy("start").rowsBetween(1, config.LOOKAHEAD)).alias("ahead"))
    rows = scored.join(ahead, ["subject", "start"])
    excess = F.col("share") - F.col("baseline")
    held = F.size(F.filter("ahead", lambda x: x - F.col("baseline") >= config.SUSTAIN * excess))
    label = F.when((F.size("ahead") == config.LOOKAHEAD) & (excess > 0), (held >= config.MIN_SUSTAINED).cast("int"))
    return rows.withColumn("label", label).drop("ahead")


def standardizer(rows: DataFrame, columns: list[str]) -> DataFrame:
    parts = [rows.agg(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.when(F.var_pop(c) <= 1e-12, 1.0).otherwise(F.stddev_pop(c)).alias("std")) for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def auc(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """P(positive above negative) + half of ties, from counts by score: scores of one value are one row before they are ranked."""
    by = rows.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    below = F.sum("n").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1))
    ranked = by.withColumn("below", F.coalesce(below, F.lit(0)))
    got = ranked.agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return got.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n"))).otherwise(0.5).alias("auc"))


def train(rows: DataFrame, columns: list[str], label: str = "label") -> dict:
    """Weights on standardised columns, both classes weighing the same, with a penalty on all but the bias."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    stats = {r.feature: (r.mean, r["std"]) for r in standardizer(rows, columns).collect()}
    n = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    total = sum(n.values())
    if len(n) < 2:
        raise ValueError("both classes are needed")
    flat = rows.select(*[((F.col(c) - stats[c][0]) / stats[c][1]).alias(c) for c in columns], F.col(label).cast("double").alias("y"))
    flat = flat.withColumn("w", F.when(F.col("y") == 1, total / (2 * n[1])).otherwise(total / (2 * n[0])))
    vector = VectorAssembler(inputCols=columns, outputCol="x").transform(flat)
    m = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=config.L2, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-10).fit(vector)
    return {"columns": columns, "weights": [float(x) for x in m.coefficients], "bias": float(m.intercept), "mean": [stats[c][0] for c in columns], "std": [stats[c][1] for c in columns], "trained_on": total, "positives": n[1]}


def fit(rows: DataFrame, columns: list[str], order: str = "start") -> tuple[dict | None, str]:
    """The model and why not, if there are too few rows; the holdout is the later part of time."""
    n = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    total = sum(n.values())
    if total < config.MIN_SAMPLES or min(n.get(0, 0), n.get(1, 0)) < config.MIN_POSITIVES:
        return None, f"{total} rows, {n.get(1, 0)} of them held: {config.MIN_SAMPLES} rows and {config.MIN_POSITIVES} of each class are needed"
    cut = int(total * config.HOLDOUT)  # ties are cut too, in the order of the other columns; spikes are few
    place = F.row_number().over(Window.orderBy(order, *[c for c in ("mode", "kind", "subject") if c in rows.columns]))
    ranked = rows.withColumn("place", place)
    model, test, early = train(rows, columns), ranked.where(F.col("place") > cut), ranked.where(F.col("place") <= cut)
    held = {r.label: r["count"] for r in test.groupBy("label").count().collect()}
    if sum(held.values()) >= 30 and len(held) == 2 and early.select("label").distinct().count() == 2:
        model["holdout_auc"] = round(auc(predict(test, train(early, columns))).first().auc, 3)
    model["holdout_size"] = sum(held.values())
    return model, ""


def predict(rows: DataFrame, model: dict, name: str = "score") -> DataFrame:
    z = F.lit(model["bias"])
    for c, w, m, s in zip(model["columns"], model["weights"], model["mean"], model["std"]):
        z = z + (F.col(c) - m) / s * w
    return rows.withColumn(name, 1 / (1 + F.exp(-z)))


def save(model: dict, path: str) -> None:
    Path(path).write_text(json.dumps(model))


def load(path: str) -> dict | None:
    """None if there is no model or it cannot be read."""
    try:
        return json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return None


def info(model: dict | None) -> dict:
    """What is told of a model: whether there is one, what it was trained on, and its weights, largest first."""
    if model is None:
        return {"trained": False}
    known = {k: model.get(k) for k in ("trained_on", "positives", "holdout_auc", "holdout_size")}
    return {"trained": True, **known, "weights": top_factors(model, len(model["columns"]))}


def top_factors(model: dict, n: int = 5) -> list[tuple[str, float]]:
    return sorted(zip(model["columns"], model["weights"]), key=lambda x: -abs(x[1]))[:n]
