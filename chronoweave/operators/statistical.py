"""Operators over a whole series: statistics given to every row, scalings, running values."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from .base import EPS, POS, Series, clamp, let, ratio, zero
from .base import finite as _finite


def finite(x: Column) -> Column:
    return let(x, _finite)


def pair_cov(a: Column, b: Column, w: WindowSpec) -> Column:
    """Population covariance where means are taken over each column's own values but the
    products over rows that have both: covar_pop, which skips the other rows, and what the
    means of either kind differ by. Without missing values that is covar_pop."""
    both = a.isNotNull() & b.isNotNull()
    apart = [F.avg(F.when(both, x)).over(w) - F.avg(x).over(w) for x in (a, b)]
    return F.covar_pop(a, b).over(w) + apart[0] * apart[1]


def quantile(a: Column, q: float, w: WindowSpec) -> Column:
    return F.percentile(a, F.lit(q)).over(w)


def mean(s: Series, a: Column) -> Column:
    return finite(F.avg(a).over(s.whole))


def std(s: Series, a: Column) -> Column:
    return finite(F.stddev_pop(a).over(s.whole))


def var(s: Series, a: Column) -> Column:
    return finite(F.var_pop(a).over(s.whole))


def _quantile(q: float):
    return lambda s, a: finite(quantile(a, q, s.whole))


def mad(s: Series, a: Column) -> Column:
    return finite(F.avg(F.abs(a - F.avg(a).over(s.whole))).over(s.whole))


def _iqr(s: Series, a: Column) -> Column:
    return quantile(a, 0.75, s.whole) - quantile(a, 0.25, s.whole)


def iqr(s: Series, a: Column) -> Column:
    return finite(_iqr(s, a))


def skew(s: Series, a: Column) -> Column:
    return F.when(F.stddev_pop(a).over(s.whole) < EPS, zero()).otherwise(finite(F.skewness(a).over(s.whole)))


def kurtosis(s: Series, a: Column) -> Column:
    return F.when(F.stddev_pop(a).over(s.whole) < EPS, zero()).otherwise(finite(F.kurtosis(a).over(s.whole)))


def zscore(s: Series, a: Column) -> Column:
    sd = F.stddev_pop(a).over(s.whole)
    return F.when(sd >= EPS, ratio(a - F.avg(a).over(s.whole), sd)).otherwise(zero())


def min_max_scale(s: Series, a: Column) -> Column:
    low = F.min(a).over(s.whole)
    width = F.max(a).over(s.whole) - low
    return F.when(width >= EPS, ratio(a - low, width)).otherwise(zero())


def robust_scale(s: Series, a: Column) -> Column:
    width = _iqr(s, a)
    return F.when(width >= EPS, ratio(a - quantile(a, 0.5, s.whole), width)).otherwise(zero())


def _mean_over_std(x: Column, of: Column, w: WindowSpec) -> Column:
    sd = F.stddev_pop(of).over(w)
    return F.when(sd > EPS, finite(ratio(F.avg(x).over(w), sd))).otherwise(zero())


def information_ratio(s: Series, a: Column, b: Column) -> Column:
    return _mean_over_std(a - b, a - b, s.whole)


def sharpe(s: Series, a: Column) -> Column:
    return _mean_over_std(a, a, s.whole)


def sortino(s: Series, a: Column) -> Column:
    """The deviation of negative values is about their own mean."""
    return _mean_over_std(a, F.when(a < 0, a), s.whole)


def max_drawdown(s: Series, a: Column) -> Column:
    """Running maximum, missing counted as 0, less the row's value."""
    return F.max(F.coalesce(a, zero())).over(s.upto) - a


def corr(s: Series, a: Column, b: Column) -> Column:
    sa, sb = F.stddev_pop(a).over(s.whole), F.stddev_pop(b).over(s.whole)
    return F.when((sa < EPS) | (sb < EPS), zero()).otherwise(finite(ratio(pair_cov(a, b, s.whole), sa * sb)))


def cov(s: Series, a: Column, b: Column) -> Column:
    return finite(pair_cov(a, b, s.whole))


def _slope(s: Series, a: Column, b: Column) -> Column:
    v = F.var_pop(b).over(s.whole)
    return F.when(v >= EPS, ratio(pair_cov(a, b, s.whole), v))


def beta(s: Series, a: Column, b: Column) -> Column:
    return finite(_slope(s, a, b))


def residual(s: Series, a: Column, b: Column) -> Column:
    slope = _slope(s, a, b)
    rest = a - slope * b - (F.avg(a).over(s.whole) - slope * F.avg(b).over(s.whole))
    return F.when(F.var_pop(b).over(s.whole) < EPS, a).otherwise(rest)


def cumsum(s: Series, a: Column) -> Column:
    return F.coalesce(F.sum(a).over(s.upto), zero())


def cumprod(s: Series, a: Column) -> Column:
    return F.product(F.coalesce(clamp(a, 1e4), F.lit(1.0))).over(s.upto)


def cummax(s: Series, a: Column) -> Column:
    return F.coalesce(F.max(a).over(s.upto), F.lit(float("-inf")))


def cummin(s: Series, a: Column) -> Column:
    return F.coalesce(F.min(a).over(s.upto), F.lit(float("inf")))


def pct_change(s: Series, a: Column) -> Column:
    """The first row is 0; a change from 0 is divided by EPS."""
    before = F.lag(a).over(s.ordered)
    return F.when(F.col(POS) == 1, zero()).otherwise(F.coalesce(ratio(a - before, F.abs(before) + EPS), zero()))


COMPILE = {
    "mean": mean,
    "median": _quantile(0.5),
    "quantile_25": _quantile(0.25),
    "quantile_75": _quantile(0.75),
    "quantile_10": _quantile(0.1),
    "quantile_90": _quantile(0.9),
    "std": std,
    "var": var,
    "mad": mad,
    "iqr": iqr,
    "skew": skew,
    "kurtosis": kurtosis,
    "zscore": zscore,
    "min_max_scale": min_max_scale,
    "robust_scale": robust_scale,
    "information_ratio": information_ratio,
    "sharpe": sharpe,
    "sortino": sortino,
    "max_drawdown": max_drawdown,
    "corr": corr,
    "cov": cov,
    "beta": beta,
    "residual": residual,
    "cumsum": cumsum,
    "cumprod": cumprod,
    "cummax": cummax,
    "cummin": cummin,
    "pct_change": pct_change,
}
