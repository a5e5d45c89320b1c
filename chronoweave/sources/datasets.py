"""The three benchmark data sets: readers of their CSV files and synthetic stand-ins."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Spec:
    rows: int
    columns: int
    freq: str
    target: str
    description: str


#: Shapes and targets of the data sets.
SPECS = {
    "sp500": Spec(5034, 25, "B", "realized_vol_21d", "daily returns, 21-day realised volatility"),
    "uci_appliances": Spec(19735, 28, "10min", "energy_wh", "appliance energy and room sensors"),
    "jena_climate": Spec(420551, 14, "10min", "temperature_6h", "weather station, temperature six hours ahead"),
}
#: Column names of the weather data.
JENA = ("p (mbar)", "T (degC)", "Tpot (K)", "Tdew (degC)", "rh (%)", "VPmax (mbar)", "VPact (mbar)", "VPdef (mbar)", "sh (g/kg)", "H2OC (mmol/mol)", "rho (g/m**3)", "wv (m/s)", "max. wv (m/s)", "wd (deg)")
AHEAD = 36


class DatasetLoader:
    """Frames have a timestamp column ``ts``, the variables and the target."""

    def __init__(self, spark: SparkSession, data_dir: str = "data", seed: int = 42):
        self.spark, self.data_dir, self.seed = spark, data_dir, seed

    @staticmethod
    def available_datasets() -> list[str]:
        return list(SPECS)

    @staticmethod
    def dataset_info(name: str) -> Spec:
        if name not in SPECS:
            raise ValueError(f"no data set {name!r}")
        return SPECS[name]

    def load(self, name: str) -> DataFrame:
        self.dataset_info(name)
        return getattr(self, f"_load_{name}")()

    def load_split(self, name: str) -> tuple[DataFrame, DataFrame]:
        """Features and target apart, both with ``ts``, by which they belong together."""
        df, target = self.load(name), SPECS[name].target
        return df.drop(target), df.select("ts", target)

    def _csv(self, path: str, time: str, pattern: str | None = None) -> DataFrame:
        df = self.spark.read.csv(f"{self.data_dir}/{path}", header=True, inferSchema=False)
        ts = F.to_timestamp(F.col(f"`{time}`"), pattern) if pattern else F.to_timestamp(F.col(f"`{time}`"))
        return df.select(ts.alias("ts"), *(F.col(f"`{c}`").cast("double").alias(c) for c in df.columns if c != time))

    def _load_sp500(self) -> DataFrame:
        return self._csv("sp500/sp500.csv", "date")

    def _load_uci_appliances(self) -> DataFrame:
        return self._csv("uci_appliances/energydata_complete.csv", "date").withColumnRenamed("Appliances", "energy_wh")

    def _load_jena_climate(self) -> DataFrame:
        return self._ahead(self._csv("jena_climate/jena_climate_2009_2016.csv", "Date Time", "dd.MM.yyyy HH:mm:ss"))

    @staticmethod
    def _ahead(df: DataFrame) -> DataFrame:
        later = F.lead("`T (degC)`", AHEAD).over(Window.partitionBy(F.lit(0)).orderBy("ts"))
        return df.withColumn("temperature_6h", later).filter("temperature_6h is not null")

    def generate_synthetic(self, name: str, scale: float = 1.0) -> DataFrame:
        """Seeded rows of the same shape; alike in distribution, not in value."""
        spec = self.dataset_info(name)
        n = max(10, int(spec.rows * scale))
        # One partition: a partition seeds its own random numbers, and n is small.
        return getattr(self, f"_make_{name}")(self.spark.range(0, n, 1, 1).withColumnRenamed("id", "t"), n, spec)

    def _noise(self, k: int):
        return F.randn(self.seed * 1000 + k)

    def _make_sp500(self, base: DataFrame, n: int, spec: Spec) -> DataFrame:
        factors = base.select("t", *(self._noise(k).alias(f"f{k}") for k in range(5)), *(self._noise(100 + i).alias(f"e{i}") for i in range(spec.columns)))
        load = lambda i, k: 0.002 * math.sin(1 + 7 * i + 3 * k)
        cols = [(sum((F.col(f"f{k}") * load(i, k) for k in range(5)), F.lit(0.0003)) + F.col(f"e{i}") * 0.008).alias(f"return_{i}") for i in range(spec.columns)]
        back = F.lit(n - 1) - F.col("t")
        # Business days that end on 2024-12-31, a Tuesday.
        shift = (back / 5).cast("int") * 7 + (back % 5) + F.when(back % 5 > 1, 2).otherwise(0)
        out = factors.select("t", F.date_sub(F.lit("2024-12-31").cast("date"), shift.cast("int")).cast("timestamp").alias("ts"), *cols)
        w = Window.partitionBy(F.lit(0)).orderBy("t")
        mean = sum((F.col(f"return_{i}") for i in range(spec.columns)), F.lit(0.0)) / spec.columns
        vol = F.when(F.row_number().over(w) >= 21, F.stddev_samp(mean).over(w.rowsBetween(-20, 0)))
        out = out.withColumn("v", vol)
        return out.withColumn(spec.target, F.first("v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))).drop("v", "t")

    def _make_uci_appliances(self, base: DataFrame, n: int, spec: Spec) -> DataFrame:
        wave = [(F.sin(F.col("t") * (2 * math.pi / (144 * (1 + i % 7)))) + self._noise(i) * 0.3).alias(f"sensor_{i}") for i in range(spec.columns)]
        ts = F.timestamp_seconds(F.unix_timestamp(F.lit("2016-01-11 17:00:00")) + F.col("t") * 600)
        out = base.select("t", ts.alias("ts"), *wave)
        y = 50 + 10 * F.sin(F.col("t") * (2 * math.pi / 144)) + 5 * sum((F.col(f"sensor_{i}") for i in range(3)), F.lit(0.0)) + self._noise(500) * 5
        return out.withColumn(spec.target, F.abs(y)).drop("t")

    def _make_jena_climate(self, base: DataFrame, n: int, spec: Spec) -> DataFrame:
        """A daily and a yearly cycle and an AR(1) process with 0.95, which is the same
        recurrence as an exponential average and is computed as one (see recursive.py)."""
        from ..plans.compiler import SeriesFrame

        ts = F.timestamp_seconds(F.unix_timestamp(F.lit("2009-01-01 00:00:00")) + F.col("t") * 600)
        raw = base.select("t", ts.alias("ts"), *(self._noise(i).alias(f"n{i}") for i in range(spec.columns)))
        # 2 / (w + 1) = 0.05: ema keeps 0.95 of what was and adds 0.05 of the noise.
        frame = SeriesFrame(raw, (), ("t",))
        from ..operators.base import POS
        from ..operators.recursive import ts_ema

        s = frame.series
        out = raw.withColumn(POS, F.row_number().over(s.ordered))
        day, year = 2 * math.pi / 144, 2 * math.pi / 52560
        cols = [(10 * F.sin(F.col("t") * year + i) + 5 * F.sin(F.col("t") * day + i) + 20 * ts_ema(s, 39, F.col(f"n{i}"))).alias(c) for i, c in enumerate(JENA)]
        return self._ahead(out.select("ts", *cols))
