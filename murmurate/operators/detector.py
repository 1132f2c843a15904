"""Unusual shares of conversation: robust trailing and seasonal baselines, as windows over each subject's series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from . import counters


def middle(values: Column) -> Column:
    """The median of an array without nulls."""
    s = F.array_sort(values)
    n = F.size(values)
    half = (n / 2).cast("int")
    return F.when(n % 2 == 1, F.get(s, half)).otherwise((F.get(s, half - 1) + F.get(s, half)) / 2)


def noise_floor(center: Column, total: Column) -> Column:
    return F.when(total <= 0, F.lit(1e-9)).otherwise(F.sqrt(F.greatest(center, 1 / total) / total))


def score(series: DataFrame, h: config.Horizon, min_coverage: float = config.MIN_COVERAGE) -> DataFrame:
    """Adds baseline, zscore, multiple and position to usable rows that have a full trailing window."""
    day = 86400
    usable = series.where(F.col("coverage") >= min_coverage)
    order = Window.partitionBy("subject").orderBy("start")
    trailing = order.rowsBetween(-(h.gap + h.window), -(h.gap + 1))
    seasonal = Window.partitionBy("subject", F.col("start") % day).orderBy("start").rangeBetween(-config.SEASONAL_DAYS * day, -day)
    rows = usable.withColumn("trailing", F.collect_list("share").over(trailing)).withColumn("position", F.row_number().over(order))
    rows = rows.withColumn("seasonal", F.collect_list("share").over(seasonal)).where(F.size("trailing") == h.window)
    rows = rows.withColumn("t", middle(F.col("trailing"))).withColumn("s", middle(F.col("seasonal")))
    seasonal_wins = (F.size("seasonal") >= config.SEASONAL_LEAST) & (F.col("s") > F.col("t"))
    rows = rows.withColumn("is_seasonal", F.coalesce(seasonal_wins, F.lit(False)))
    rows = rows.withColumn("baseline", F.when(F.col("is_seasonal"), F.col("s")).otherwise(F.col("t")))
    rows = rows.withColumn("base", F.when(F.col("is_seasonal"), F.col("seasonal")).otherwise(F.col("trailing")))
    spread = middle(F.transform("base", lambda x: F.abs(x - F.col("baseline")))) * config.MAD_TO_SIGMA
    sigma = F.greatest(spread, noise_floor(F.col("baseline"), F.col("total")))
    multiple = F.when(F.col("baseline") > 0, F.col("share") / F.col("baseline")).otherwise(0.0)
    return rows.select("subject", "start", "hits", "total", "coverage", "share", "position", "is_seasonal", "baseline", ((F.col("share") - F.col("baseline")) / sigma).alias("zscore"), multiple.alias("multiple"))


def is_spike(h: config.Horizon, z: float | None = None) -> Column:
    return (F.col("zscore") >= (h.z if z is None else z)) & (F.col("hits") >= h.min_hits) & (F.col("share") > F.col("baseline"))


def scored(rows: DataFrame, hits: DataFrame, h: config.Horizon, unit: int = 60) -> DataFrame:
    """rows: posts with a unit; hits: (unit, subject, hits)."""
    return score(counters.dense(hits, counters.frame(counters.totals(rows), h.units, unit), h.units, unit), h)
