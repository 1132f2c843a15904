"""Whole passes: every horizon and kind scored at once, and the training set that they make."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from . import counters, detector, model


def _series(hits: DataFrame, totals: DataFrame, h: config.Horizon, unit: int, kind: str) -> DataFrame:
    own = counters.candidates(hits, h.min_hits).select("subject") if kind == "term" else None
    return counters.dense(hits, counters.frame(totals, h.units, unit), h.units, unit, own)


def run(totals: DataFrame, hits: dict[str, DataFrame], unit: int = 60, modes: list[str] | None = None, z: float | None = None) -> DataFrame:
    """mode, kind and the spikes of every horizon that is ready, for each kind (topic, term) of hits. z: another threshold than the horizons' own."""
    ready = F.broadcast(counters.readiness(totals).where("ready").select("mode"))  # a row a horizon
    out = None
    for name in modes or config.HORIZONS:
        h = config.horizon(name)
        for kind, rows in hits.items():
            scored = detector.score(_series(rows, totals, h, unit, kind), h)
            found = scored.where(detector.is_spike(h) if z is None else detector.is_spike(h, z))
            found = found.select(F.lit(name).alias("mode"), F.lit(kind).alias("kind"), "subject", "start", "hits", "total", "share", "baseline", "zscore", "multiple", "coverage")
            out = found if out is None else out.unionByName(found)
    return out.join(ready, "mode", "left_semi")


def dataset(totals: DataFrame, hits: dict[str, DataFrame], unit: int = 60, z: float | None = None, explained: DataFrame | None = None) -> DataFrame:
    """mode, kind, subject, start, label and model.FEATURES of every spike whose future is known. explained: mode, kind, subject, start, terms, links."""
    ready = F.broadcast(counters.readiness(totals).where("ready").select("mode"))
    keys, out = ["mode", "kind", "subject", "start"], None
    for name, h in config.HORIZONS.items():
        for kind, rows in hits.items():
            series = _series(rows, totals, h, unit, kind)
            dense = series.where(F.col("coverage") >= config.MIN_COVERAGE)
            dens = dense.select("subject", "start", model.density(Window.partitionBy("subject").orderBy("start")).alias("history_density"))
            labelled = model.persistence(series, detector.score(series, h)).where(detector.is_spike(h) if z is None else detector.is_spike(h, z)).where("label is not null")
            made = labelled.join(dens, ["subject", "start"]).withColumns({"mode": F.lit(name), "kind": F.lit(kind)})
            if explained is not None:
                made = made.join(explained, keys, "left")
            made = model.features(made, h.units * unit // 60, kind).select(*keys, "label", *[F.col(c).cast("double").alias(c) for c in model.FEATURES])
            out = made if out is None else out.unionByName(made)
    return out.join(ready, "mode", "left_semi")
