"""Rolling features over a stream.

Each micro-batch is evaluated together with the last rows of its series, which are kept as
a table per batch: the same compiler and the same results as over the whole table, as long
as rows arrive in the series' order from batch to batch. Expressions must look back a
bounded number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.compiler import SeriesFrame
from ..plans.expression import Expr
from ..plans.lookback import bounded_lookback


class RollingStream:
    """``sink(df, batch_id)`` gets the rows of a batch with their features. ``state_dir``
    is a folder that all executors share; a batch that is run again after a failure reads
    the state before it and overwrites its own, so sinks may rely on the batch id."""

    def __init__(self, features: Mapping[str, Expr | str], keys: tuple[str, ...], order: tuple[str, ...], state_dir: str, sink: Callable[[DataFrame, int], None], **options):
        self.features, self.keys, self.order, self.dir, self.sink, self.options = features, keys, order, state_dir.rstrip("/"), sink, options
        self.rows = bounded_lookback(features)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("_cw_own", F.lit(True))
        if batch_id > 0:
            old = spark.read.schema(batch.schema).parquet(f"{self.dir}/{batch_id - 1}")
            new = new.unionByName(old.withColumn("_cw_own", F.lit(False)))
        # The rows feed the sink and the next state.
        new.persist()
        try:
            out = SeriesFrame(new, self.keys, self.order).with_features(self.features, **self.options)
            self.sink(out.filter("_cw_own").drop("_cw_own"), batch_id)
            back = Window.partitionBy(*(self.keys or (F.lit(""),))).orderBy(*(F.col(c).desc() for c in self.order))
            tail = new.withColumn("_cw_i", F.row_number().over(back)).filter(F.col("_cw_i") <= self.rows)
            tail.select(*batch.columns).write.mode("overwrite").parquet(f"{self.dir}/{batch_id}")
        finally:
            new.unpersist()

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
