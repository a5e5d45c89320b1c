"""Forecast errors and the comparison of two forecasts, as aggregates."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.places import blocks, placed


def mae(y: str, p: str) -> Column:
    return F.avg(F.abs(F.col(y) - F.col(p)))


def rmse(y: str, p: str) -> Column:
    return F.sqrt(F.avg(F.pow(F.col(y) - F.col(p), F.lit(2.0))))


def mape(y: str, p: str, epsilon: float = 1e-8) -> Column:
    """A fraction, not per cent."""
    return F.avg(F.abs(F.try_divide(F.col(y) - F.col(p), F.abs(F.col(y)) + epsilon)))


def errors(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(mae(y, p).alias("mae"), rmse(y, p).alias("rmse"), mape(y, p).alias("mape"))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / max(tiny, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + k * d, 1 + k / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


@dataclass(frozen=True)
class DieboldMariano:
    dm_statistic: float
    p_value: float
    significant: bool
    preferred: str | None  # model_a, model_b, or none if the test sees no difference


def loss_covariances(df: DataFrame, y: str, a: str, b: str, order: tuple[str, ...], *, loss: str = "squared", h: int = 1, coarse: Column | None = None) -> DataFrame:
    """One row: n, the mean difference of losses, and its autocovariances g0 to g(h-1), each
    the mean of its own n - k products. Without lags (h = 1) it is a plain aggregate. Lags
    need the forecasts in order: in blocks of places if ``coarse`` is given (see
    ``placed()``), else in one task."""
    if loss not in ("squared", "absolute"):
        raise ValueError("loss is squared or absolute")
    cost = (lambda p: F.pow(F.col(y) - F.col(p), F.lit(2.0))) if loss == "squared" else (lambda p: F.abs(F.col(y) - F.col(p)))
    d = df.select(*order, (cost(a) - cost(b)).alias("_cw_d"), *([] if coarse is None else [coarse.alias("_cw_coarse")]))
    mean = F.broadcast(d.agg(F.count("_cw_d").alias("n"), F.avg("_cw_d").alias("mean")))  # one row
    if coarse is None or h == 1:
        rows, w = d.withColumn("_cw_own", F.lit(True)), Window.partitionBy(F.lit(0)).orderBy(*order)
    else:
        rows, w = blocks(placed(d, (), order, F.col("_cw_coarse")), h - 1), Window.partitionBy("_cw_no").orderBy("_cw_place")
    lags = rows.select("_cw_d", "_cw_own", *(F.lag("_cw_d", k).over(w).alias(f"_cw_{k}") for k in range(1, h))).filter("_cw_own")
    c = F.col("_cw_d") - F.col("mean")
    others = [c, *(F.col(f"_cw_{k}") - F.col("mean") for k in range(1, h))]
    return lags.crossJoin(mean).agg(F.max("n").alias("n"), F.max("mean").alias("mean"), *(F.avg(c * x).alias(f"g{k}") for k, x in enumerate(others)))


def diebold_mariano(df: DataFrame, y: str, a: str, b: str, order: tuple[str, ...], *, loss: str = "squared", h: int = 1, alpha: float = 0.05, coarse: Column | None = None) -> DieboldMariano:
    """Whether forecasts a and b of one series differ, with the correction for short
    samples."""
    row = loss_covariances(df, y, a, b, order, loss=loss, h=h, coarse=coarse).first()
    n = row["n"] or 0
    if n < 3:
        raise ValueError("at least three rows are needed")
    var = (row["g0"] + 2 * sum(row[f"g{k}"] or 0.0 for k in range(1, h))) / n
    if var <= 0:
        return DieboldMariano(0.0, 1.0, False, None)
    stat = row["mean"] / math.sqrt(var) * math.sqrt(max(0.0, (n + 1 - 2 * h + h * (h - 1) / n) / n))
    p = t_two_sided(stat, n - 1)
    return DieboldMariano(stat, p, p < alpha, ("model_b" if stat > 0 else "model_a") if p < alpha else None)
