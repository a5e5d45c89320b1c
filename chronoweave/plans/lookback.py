"""How far back an expression looks, and what that allows: one long series evaluated in
many partitions.

An expression of rolling and element-wise operators needs only a bounded number of earlier
rows. A series can then be cut into consecutive buckets, each given that many rows of the
bucket before, and every bucket is a window partition of its own.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalogue import Family
from . import compiler
from .compiler import SeriesFrame
from .expression import Call, Expr, parse
from .places import blocks, placed

#: The only rolling operator that remembers all earlier rows.
UNBOUNDED = {"ts_ema"}


def lookback(expr: Expr | str) -> int | None:
    """Earlier rows that decide a row's value; None where all rows may."""
    expr = parse(expr, compiler.CATALOGUE) if isinstance(expr, str) else expr
    if not isinstance(expr, Call):
        return 0
    op = compiler.CATALOGUE.get(expr.op)
    below = [lookback(a) for a in expr.args]
    if None in below or op.base_name in UNBOUNDED or op.family not in (Family.ARITHMETIC, Family.ROLLING_WINDOW):
        return None
    return max(below, default=0) + (op.window or 0)


def bounded_lookback(features: Mapping[str, Expr | str]) -> int:
    each = {name: lookback(e) for name, e in features.items()}
    if wrong := [name for name, n in each.items() if n is None]:
        raise ValueError(f"these need the whole series: {wrong}")
    return max(each.values(), default=0)


def with_features_by_bucket(frame: SeriesFrame, features: Mapping[str, Expr | str], bucket: Column, **options) -> DataFrame:
    """As SeriesFrame.with_features(), in one window partition per key and bucket.

    ``bucket`` must not decrease along the order (a date of the timestamp, say), and all
    buckets of a series but its last must hold as many rows as the expressions look back.
    The buckets of a series are numbered from their counts, one small row each.
    """
    far = bounded_lookback(features)
    keys = list(frame.keys)
    rows = frame.df.withColumn("_cw_bucket", bucket)
    counts = rows.groupBy(*keys, "_cw_bucket").agg(F.count(F.lit(1)).alias("_cw_rows"))
    w = Window.partitionBy(*(keys or [F.lit("")])).orderBy("_cw_bucket")
    numbered = counts.withColumn("_cw_no", F.row_number().over(w)).withColumn("_cw_last", F.lead("_cw_no").over(w).isNull())
    if short := numbered.filter(~F.col("_cw_last") & (F.col("_cw_rows") < far)).take(1):
        raise ValueError(f"bucket {short[0]['_cw_bucket']} has fewer than {far} rows")
    named = {k: f"_cw_key_{i}" for i, k in enumerate([*keys, "_cw_bucket"])}
    numbered = numbered.select(*(F.col(k).alias(n) for k, n in named.items()), "_cw_no", "_cw_last")
    same = F.lit(True)
    for k, n in named.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    joined = rows.join(numbered, same).drop("_cw_bucket", *named.values())
    back = Window.partitionBy(*keys, "_cw_no").orderBy(*(F.col(c).desc() for c in frame.order))
    ends = joined.withColumn("_cw_from_end", F.row_number().over(back))
    halo = ends.filter((F.col("_cw_from_end") <= far) & ~F.col("_cw_last")).withColumn("_cw_no", F.col("_cw_no") + 1).withColumn("_cw_own", F.lit(False))
    both = ends.withColumn("_cw_own", F.lit(True)).unionByName(halo).drop("_cw_from_end", "_cw_last")
    out = SeriesFrame(both, (*frame.keys, "_cw_no"), frame.order).with_features(features, **options)
    return out.filter("_cw_own").drop("_cw_own", "_cw_no")


def with_features_in_blocks(frame: SeriesFrame, features: Mapping[str, Expr | str], coarse: Column, rows: int = 4096, **options) -> DataFrame:
    """As SeriesFrame.with_features(), in window partitions of about ``rows`` rows.

    Rows get their places as by ``placed()``; blocks are ranges of places, each given the
    rows before it that the expressions look back to. A series of any length is spread over
    as many tasks as it has blocks, as long as a coarse bucket fits one task.
    """
    far = bounded_lookback(features)
    both = blocks(placed(frame.df, frame.keys, frame.order, coarse), far, rows).drop("_cw_place", "_cw_total")
    out = SeriesFrame(both, (*frame.keys, "_cw_no"), frame.order).with_features(features, **options)
    return out.filter("_cw_own").drop("_cw_own", "_cw_no")
