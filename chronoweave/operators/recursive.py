"""Exponential moving average as window expressions.

e_1 = a_1, e_t = alpha a_t + (1 - alpha) e_{t-1} with alpha = 2 / (w + 1). A recurrence
is no framed aggregate, but it is linear: within blocks of rows it is a running sum of
powers, and earlier blocks reach a row through their last values, whose weights fall
below double precision after a few blocks. Both parts are windows, so long series need
no Python and no group in memory.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .base import POS, Series, zero


def ts_ema(s: Series, w: int, a: Column) -> Column:
    """Without warm-up zeros. A missing value makes all later ones missing."""
    alpha = 2.0 / (w + 1)
    keep = 1.0 - alpha
    if keep <= 0:
        return a
    size = max(1, min(1024, int(600 / -math.log(keep))))  # powers stay within a double's range
    back = math.ceil(45 / (-math.log(keep) * size))  # blocks until weights are below 1e-19
    i, block = (F.col(POS) - 1) % size, F.floor((F.col(POS) - 1) / size)
    weight = F.when(F.col(POS) == 1, F.lit(1.0)).otherwise(F.lit(alpha))
    inside = Window.partitionBy(*s.keys, block).orderBy(*s.order).rowsBetween(Window.unboundedPreceding, 0)
    own = F.pow(F.lit(keep), i) * F.sum(weight * a * F.pow(F.lit(keep), -i)).over(inside)
    ends = F.collect_list(F.when(i == size - 1, own)).over(s.whole.orderBy(block).rangeBetween(-back, -1))
    before = F.aggregate(ends, zero(), lambda t, x: t * keep**size + x)
    lost = F.count_if(a.isNull()).over(s.upto) > 0
    return F.when(~lost, own + F.pow(F.lit(keep), i + 1) * before)


COMPILE = {"ts_ema": ts_ema}
