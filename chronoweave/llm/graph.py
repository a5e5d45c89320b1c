"""Connected components over DataFrames of edges.

Edges may repeat and may be loops; loops say nothing, so a node with none but loops is
not in the result, and rows with a null end are left out. No edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """One pass: every node hands its neighbours (large: the larger ones only) to the
    smallest node of its neighbourhood. Returns the new edges and the table of smallest
    nodes that they are computed from. That table is written out, so that the join with it
    lies between two exchanges and adaptive execution can split a node with very many
    neighbours; an aggregate right under the join would keep it in one task."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        out = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = cut(down.groupBy("u").agg(F.min("v").alias("m")), "low")
        moved = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = moved.union(low.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct(), low


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of ``edges`` (u long, v long): the smallest id
    it can reach. Alternates large-star and small-star passes until the edges stop
    changing; each pass is written to the shared folder."""
    now = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        for large in (True, False):
            out, low = _star(now, large)
            new = cut(out, "edges")
            discard(now, low)
            now = new
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    low = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(low)
