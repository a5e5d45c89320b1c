"""Element-wise operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import EPS, Series, clamp, finite, ratio, zero


def add(s: Series, a: Column, b: Column) -> Column:
    return a + b


def sub(s: Series, a: Column, b: Column) -> Column:
    return a - b


def mul(s: Series, a: Column, b: Column) -> Column:
    return a * b


def div(s: Series, a: Column, b: Column) -> Column:
    return F.when(F.abs(b) < EPS, zero()).otherwise(finite(ratio(a, b)))


def log(s: Series, a: Column) -> Column:
    return F.when(a > EPS, F.ln(a)).otherwise(zero())


def absolute(s: Series, a: Column) -> Column:
    return F.abs(a)


def sign(s: Series, a: Column) -> Column:
    return F.signum(a)


def power(s: Series, a: Column, b: Column) -> Column:
    return F.coalesce(clamp(F.pow(F.abs(a) + EPS, clamp(b, 5.0))), zero())


def clip(s: Series, a: Column) -> Column:
    return clamp(a)


def neg(s: Series, a: Column) -> Column:
    return -a


def sqrt(s: Series, a: Column) -> Column:
    return F.when(a >= 0, F.sqrt(a)).otherwise(zero())


def exp(s: Series, a: Column) -> Column:
    return F.exp(clamp(a, 20.0))


COMPILE = {"add": add, "sub": sub, "mul": mul, "div": div, "log": log, "abs": absolute, "sign": sign, "power": power, "clip": clip, "neg": neg, "sqrt": sqrt, "exp": exp}
