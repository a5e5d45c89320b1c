"""Filters against overfitting: collinearity, stability over time, validation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.places import blocks, placed
from .scoring import fold_scores, guard_cuts, guard_splits, validation_r2


def inflation_factors(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Variance inflation of each feature by the others, from one aggregate of pairwise
    covariances. A constant feature has 1; a combination of others has infinity."""
    return _factors(list(features), _covariances(df, features))


def _covariances(df: DataFrame, features: Sequence[str]) -> np.ndarray:
    k = len(features)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = df.agg(*(F.covar_pop(features[i], features[j]) for i, j in pairs)).first()
    out = np.zeros((k, k))
    for (i, j), c in zip(pairs, row):
        out[i, j] = out[j, i] = c or 0.0
    return out


def _factors(features: list[str], cov: np.ndarray) -> dict[str, float]:
    out = {}
    for i, f in enumerate(features):
        rest = [j for j in range(len(features)) if j != i]
        if cov[i, i] <= 1e-300 or not rest:
            out[f] = 1.0
            continue
        sd = np.sqrt(np.where(np.diag(cov) > 0, np.diag(cov), 1.0))
        corr = cov / np.outer(sd, sd)
        r2 = float(corr[i, rest] @ np.linalg.pinv(corr[np.ix_(rest, rest)], rcond=1e-10) @ corr[rest, i])
        out[f] = 1 / (1 - r2) if r2 < 1 - 1e-10 else math.inf
    return out


def rolling_r2(df: DataFrame, feature: str, target: str, keys: Sequence[str], order: Sequence[str], window: int, coarse: Column | None = None) -> DataFrame:
    """(keys, r2) of every full window; 0 where the feature is constant. With ``coarse``
    (see ``placed()``) no task holds a whole series."""
    rows = blocks(placed(df, keys, order, coarse), window - 1)
    last = Window.partitionBy(*keys, "_cw_no").orderBy("_cw_place").rowsBetween(-(window - 1), 0)
    r2 = F.coalesce(F.regr_r2(F.col(target), F.col(feature)).over(last), F.lit(0.0))
    full = F.col("_cw_own") & (F.col("_cw_place") >= window - 1)
    return rows.select(*keys, r2.alias("r2"), full.alias("_cw_full")).filter("_cw_full").drop("_cw_full")


@dataclass
class OverfittingGuard:
    vif_threshold: float = 5.0
    stability_factor: float = 2.0
    window: int = 252
    folds: int = 5
    min_r2: float = 0.0
    train_share: float = 0.6
    val_share: float = 0.2
    removed: dict[str, str] = field(default_factory=dict)

    def filter(self, df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str] = (), order: Sequence[str] = (), coarse: Column | None = None) -> list[str]:
        """Features that pass all three stages; ``removed`` tells where others fell.
        Rows with a missing value in any column used are left out first. With ``coarse``
        (see ``placed()``) no task holds a whole series."""
        self.removed = {}
        bucket = [] if coarse is None else [coarse.alias("_cw_coarse")]
        rows = df.select(*keys, *order, target, *features, *bucket).dropna(subset=[target, *features])
        keep = list(features)
        for name, stage in (("vif", self._vif), ("stability", self._stable), ("validation", self._valid)):
            if not keep:
                break
            left = stage(rows, keep, target, list(keys), list(order), F.col("_cw_coarse") if bucket else None)
            self.removed |= {f: name for f in keep if f not in left}
            keep = left
        return keep

    def _vif(self, df, features, target, keys, order, coarse=None) -> list[str]:
        cov, keep = _covariances(df, features), list(features)
        while len(keep) > 1:
            at = [features.index(f) for f in keep]
            factors = _factors(keep, cov[np.ix_(at, at)])
            worst = max(keep, key=factors.get)  # the first of equals
            if factors[worst] <= self.vif_threshold:
                break
            keep.remove(worst)
        return keep

    def _stable(self, df, features, target, keys, order, coarse=None) -> list[str]:
        """The range of rolling R squared within `stability_factor` sample deviations, on
        average over series. A series' window is a third of its rows, `window` at most;
        series whose window is under 10 rows have no vote, and if none has, all pass. Note
        that few series can pass at the default of 2."""
        rows = placed(df, keys, order, coarse).withColumn("_cw_w", F.least(F.lit(self.window), F.floor(F.col("_cw_total") / 3)))
        rows = blocks(rows.filter("_cw_w >= 10"), self.window)
        # Positions in units of the series' window: one frame, just short of a unit, spans
        # each series' own number of rows.
        unit = 4096 * self.window
        rows = rows.withColumn("_cw_at", F.floor((F.col("_cw_place") + 1) * unit / F.col("_cw_w")))
        last = Window.partitionBy(*keys, "_cw_no").orderBy("_cw_at").rangeBetween(-(unit - 2048), 0)
        r2 = rows.select(*keys, (F.col("_cw_own") & (F.col("_cw_place") + 1 >= F.col("_cw_w"))).alias("_cw_full"), *(F.coalesce(F.regr_r2(F.col(target), F.col(f)).over(last), F.lit(0.0)).alias(f) for f in features)).filter("_cw_full")
        per = r2.groupBy(*keys).agg(*(((F.max(f) - F.min(f)) <= self.stability_factor * F.coalesce(F.stddev_samp(f), F.lit(0.0)) + 1e-15).cast("double").alias(f) for f in features))
        row = per.agg(F.count("*").alias("_cw_n"), *(F.avg(f).alias(f) for f in features)).first()
        if not row["_cw_n"] or row[features[0]] is None:
            return features
        return [f for f in features if (row[f] or 0.0) > 0.5]

    def _valid(self, df, features, target, keys, order, coarse=None) -> list[str]:
        splits = lambda n: guard_splits(n, self.folds, self.train_share, self.val_share)
        cuts = lambda n: guard_cuts(n, self.folds, self.train_share, self.val_share)
        n = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        if not splits(n):
            return features
        rows = fold_scores(df, features, target, keys, order, splits, cuts, validation_r2, coarse=coarse).groupBy("feature").agg(F.avg("score").alias("s")).collect()
        found = {r["feature"]: r["s"] for r in rows}
        return [f for f in features if found.get(f) is not None and found[f] >= self.min_r2]
