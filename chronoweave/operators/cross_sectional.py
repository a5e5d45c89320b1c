"""Ranks and scalings of a row's value within its series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import EPS, Series, ratio, zero
from .statistical import quantile


def rank(s: Series, a: Column) -> Column:
    """From 0, missing as 0; ties are ranked by the series' order."""
    return (F.row_number().over(s.whole.orderBy(F.coalesce(a, zero()), *s.order)) - 1).cast("double")


def percentile(s: Series, a: Column) -> Column:
    n = F.count(F.lit(1)).over(s.whole)
    return ratio(rank(s, a), F.greatest(n - 1, F.lit(1)).cast("double"))


def demean(s: Series, a: Column) -> Column:
    return a - F.avg(a).over(s.whole)


def normalize(s: Series, a: Column) -> Column:
    total = F.sum(F.abs(a)).over(s.whole)
    return F.when(total > EPS, ratio(a, total)).otherwise(zero())


def winsorize(s: Series, a: Column) -> Column:
    low, high = quantile(a, 0.01, s.whole), quantile(a, 0.99, s.whole)
    return F.when(a.isNotNull(), F.greatest(low, F.least(high, a)))


def cs_max(s: Series, a: Column) -> Column:
    return F.max(a).over(s.whole)


def cs_min(s: Series, a: Column) -> Column:
    return F.min(a).over(s.whole)


def cs_sum(s: Series, a: Column) -> Column:
    return F.coalesce(F.sum(a).over(s.whole), zero())


def cs_count_positive(s: Series, a: Column) -> Column:
    return F.count_if(a > 0).over(s.whole).cast("double")


COMPILE = {"rank": rank, "percentile": percentile, "demean": demean, "normalize": normalize, "winsorize": winsorize, "cs_max": cs_max, "cs_min": cs_min, "cs_sum": cs_sum, "cs_count_positive": cs_count_positive}
