"""Long series in buckets and streams of batches against the whole table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.plans.compiler import SeriesFrame
from chronoweave.plans.lookback import lookback, with_features_by_bucket, with_features_in_blocks
from chronoweave.streaming.rolling import RollingStream

FEATURES = {"z": "div(sub(a, ts_mean_5(a)), ts_std_5(a))", "d": "ts_delta_5(ts_max_10(a))"}


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    return spark.createDataFrame([("k" + str(i % 2), i, float(v)) for i, v in enumerate(rng.normal(size=240))], "k string, t int, a double")


def rows(df):
    return sorted((r.k, r.t, round(r.z, 9), round(r.d, 9)) for r in df.collect())


def test_lookback():
    assert lookback("ts_delta_5(ts_max_10(a))") == 15 and lookback("add(a, 1)") == 0
    assert lookback("mean(a)") is None and lookback("abs(ts_ema_5(a))") is None


def test_buckets(spark, table):
    frame = SeriesFrame(table, ("k",), ("t",))
    want = rows(frame.with_features(FEATURES))
    assert rows(with_features_by_bucket(frame, FEATURES, F.floor(F.col("t") / 50))) == want
    with pytest.raises(ValueError):
        with_features_by_bucket(frame, FEATURES, F.floor(F.col("t") / 10))
    with pytest.raises(ValueError):
        with_features_by_bucket(frame, {"m": "mean(a)"}, F.floor(F.col("t") / 50))


def test_blocks(spark, table):
    """Blocks of any size, whatever the coarse buckets hold: none, one row, or all."""
    holes = table.withColumn("k", F.when(F.col("k") == "k1", None).otherwise(F.col("k")))
    for df in (table, holes):
        frame = SeriesFrame(df, ("k",), ("t",))
        want = sorted(map(str, rows(frame.with_features(FEATURES))) if df is table else (str((r.t, round(r.z, 9), round(r.d, 9))) for r in frame.with_features(FEATURES).collect()))
        for size, coarse in ((1, F.col("t")), (15, F.floor(F.col("t") / 7)), (40, F.lit(0)), (1000, F.floor(F.col("t") / 100))):
            got = with_features_in_blocks(frame, FEATURES, coarse, size)
            assert got.columns == [*df.columns, "z", "d"]
            assert sorted(map(str, rows(got)) if df is table else (str((r.t, round(r.z, 9), round(r.d, 9))) for r in got.collect())) == want
    alone = SeriesFrame(table.drop("k"), (), ("t",))
    assert sorted(map(tuple, with_features_in_blocks(alone, FEATURES, F.floor(F.col("t") / 9), 20).collect())) == sorted(map(tuple, alone.with_features(FEATURES).collect()))
    assert with_features_in_blocks(SeriesFrame(table.limit(0), ("k",), ("t",)), FEATURES, F.col("t")).count() == 0


def test_stream(spark, table, tmp_path):
    want = rows(SeriesFrame(table, ("k",), ("t",)).with_features(FEATURES))
    for i in range(4):
        table.filter(F.floor(F.col("t") / 60) == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    import glob
    import os

    for n, f in enumerate(sorted(glob.glob(f"{tmp_path}/in/*.parquet"), key=lambda f: spark.read.parquet(f).agg(F.min("t")).first()[0])):
        os.utime(f, (1000 + n, 1000 + n))  # the order in which the source takes them
    sink = lambda df, i: df.write.mode("overwrite").parquet(f"{tmp_path}/out/b={i}")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    RollingStream(FEATURES, ("k",), ("t",), f"file://{tmp_path}/state", sink).start(stream, f"file://{tmp_path}/check").awaitTermination(120)
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == want
