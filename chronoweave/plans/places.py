"""Places of rows in their series, also of series too long for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def placed(df: DataFrame, keys: Sequence[str], order: Sequence[str], coarse: Column | None = None) -> DataFrame:
    """Add _cw_place (row number in the series, from 0) and _cw_total (its rows).

    ``coarse`` must not decrease along the order (an hour of the timestamp, say). With it,
    places come from counts per coarse bucket, summed along each series, and from row
    numbers inside buckets, so that a task holds a bucket at most. Without, a series is one
    window partition.
    """
    keys = list(keys)
    series = Window.partitionBy(*(keys or [F.lit(0)]))
    if coarse is None:
        return df.withColumns({"_cw_place": (F.row_number().over(series.orderBy(*order)) - 1).cast("long"), "_cw_total": F.count(F.lit(1)).over(series)})
    named = df.withColumn("_cw_bucket", coarse)
    counts = named.groupBy(*keys, "_cw_bucket").agg(F.count(F.lit(1)).alias("_cw_rows"))
    earlier = series.orderBy("_cw_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.withColumns({"_cw_base": F.coalesce(F.sum("_cw_rows").over(earlier), F.lit(0)), "_cw_total": F.sum("_cw_rows").over(series)})
    other = {k: f"_cw_key_{i}" for i, k in enumerate([*keys, "_cw_bucket"])}
    sums = sums.select(*(F.col(k).alias(n) for k, n in other.items()), "_cw_base", "_cw_total")
    same = F.lit(True)
    for k, n in other.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    inside = Window.partitionBy(*keys, "_cw_bucket").orderBy(*order)
    joined = named.join(sums, same).withColumn("_cw_place", F.col("_cw_base") + F.row_number().over(inside) - 1)
    return joined.drop("_cw_bucket", "_cw_base", *other.values())


def blocks(df: DataFrame, far: int, rows: int = 4096) -> DataFrame:
    """Of placed rows: these by blocks of ``rows`` places (``far`` at least), numbered in
    _cw_no. Each block also holds the ``far`` rows before it; _cw_own is false there."""
    size = max(rows, far)
    own, late = F.floor(F.col("_cw_place") / size), F.col("_cw_place") % size >= size - far
    both = df.withColumn("_cw_no", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    return both.withColumn("_cw_own", F.col("_cw_no") == own)
