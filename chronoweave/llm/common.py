"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The six ASCII white-space bytes; ``bytes.split()`` splits at exactly these.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from ``spark.checkpoint.dir``.

    Where the setting is missing, a local session (tests) gets a temporary
    folder; any other cluster is refused, since its executors have no common
    disk to fall back on.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = f"file://{tempfile.gettempdir()}/chronoweave-{uuid.uuid4().hex}"
    spark.conf.set("spark.checkpoint.dir", base)
    return base


#: The tables made inside each open scratch().
_open: list[list[DataFrame]] = []


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, so that what
    follows starts from files that survive lost executors. The table stays until
    discard() or the end of a scratch() around it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    # Snappy's direct buffers, a set for each small file, stay until a full collection.
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if _open:
        _open[-1].append(out)
    return out


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Collects the tables that cut() writes inside, and deletes those still listed at
    the end; what is to stay is taken off the list."""
    made: list[DataFrame] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open.pop()
        discard(*made)


def discard(*cuts: DataFrame) -> None:
    """Delete tables that cut() wrote and that no later result reads."""
    for df in cuts:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
