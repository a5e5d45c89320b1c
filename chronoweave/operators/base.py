"""What compile functions share: the windows of a series and guarded arithmetic.

Missing is NULL in every intermediate column; NaN becomes NULL where variables enter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 1e-10
CLAMP = 1e9

#: Name of the row number within the series, from 1, that the compiler adds.
POS = "_cw_pos"


def zero() -> Column:
    return F.lit(0.0)


@dataclass(frozen=True)
class Series:
    """Windows of a keyed, totally ordered series."""

    keys: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    @property
    def ordered(self) -> WindowSpec:
        return self.whole.orderBy(*self.order)

    @property
    def upto(self) -> WindowSpec:
        return self.ordered.rowsBetween(Window.unboundedPreceding, 0)

    def last(self, w: int) -> WindowSpec:
        return self.ordered.rowsBetween(-(w - 1), 0)

    def halves(self, w: int, **parts: Column) -> Column:
        """Aggregates over the last w rows in two halves, for Spark computes every frame of
        a sliding window anew. The series is cut into blocks of w rows. A window ends in one
        block and begins in the one before, so an aggregate over it is that of the block's
        rows up to here merged with that of the rows from the window's first to the end of
        the block before. Both run along their blocks, so a row costs the same for every w,
        and nothing is taken off a sum again, which would cost digits.

        A struct of the parts so far, with `before` the struct of the other half: NULL where
        the window is a whole block."""
        block = F.floor((F.col(POS) - 1) / w)
        along = Window.partitionBy(*self.keys, block)
        up = along.orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0)
        down = along.orderBy(*(F.col(c).desc() for c in self.order)).rowsBetween(Window.unboundedPreceding, 0)
        to_end = F.struct(*(x.over(down).alias(n) for n, x in parts.items()))
        before = F.when(F.col(POS) % w != 0, F.lag(to_end, w - 1).over(self.ordered))
        return F.struct(*(x.over(up).alias(n) for n, x in parts.items()), before.alias("before"))


Compile = Callable[..., Column]


def finite(x: Column) -> Column:
    """x, or 0 where it is missing or not finite."""
    return F.coalesce(F.when(F.abs(x) < float("inf"), x), zero())


def clamp(x: Column, most: float = CLAMP) -> Column:
    """greatest and least skip NULL, so a missing x is kept missing."""
    return F.when(x.isNotNull(), F.greatest(F.lit(-most), F.least(F.lit(most), x)))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, where x is computed once. An expression in a lambda is computed anew for
    every element, and a window expression that occurs twice is two windows to Spark."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def of(f: Callable[[Column], Column], **parts: Column) -> Column:
    """f of a struct of parts, each computed once."""
    return let(F.struct(*(x.alias(n) for n, x in parts.items())), f)


def full(w: int, x: Column) -> Column:
    """0 until the window has w rows, and where x is missing or not finite."""
    return F.when(F.col(POS) >= w, let(x, finite)).otherwise(zero())


def sanitise(x: Column) -> Column:
    """At the root: missing is 0, infinities and large values are clamped."""
    return F.coalesce(clamp(F.nanvl(x, F.lit(None).cast("double"))), zero())
