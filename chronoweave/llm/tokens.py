"""Token ids of whole texts with a public byte-level BPE, and the exact histogram of
encoded lengths.

The ids are those of the ``tokenizers`` file. The same vocabulary also comes as
ranks, which ``tiktoken`` encodes several times faster; a test shows both to agree
around every code point below U+10000, so texts of these go the fast way and all others,
and texts holding the special token's string, through ``tokenizers``.

A null text counts as empty, and an empty one has length 0, a row of the histogram like any
other. Texts are encoded whole, one at a time. Rows that repeat an id or a text count each
for itself. Columns other than the two named are never read. An empty table gives an empty
histogram.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Texts that must be encoded by the reference implementation.
_SLOW = re.compile(r"[\U00010000-\U0010ffff]|<\|endoftext\|>")


class Encoder:
    """ids of the tokenizer files ``<name>.json`` and ``<name>.tiktoken``."""

    def __init__(self, name: str = "byte_bpe_50k", folder: str | None = None):
        import public_tokenizers
        import tiktoken

        self.place = (lambda f: f"{folder}/{f}") if folder else public_tokenizers.path
        self.name, self._slow = name, None
        with open(self.place(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def exact(self, text: str) -> list[int]:
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.place(f"{self.name}.json"))
        return self._slow.encode(text, add_special_tokens=False).ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return self.exact(text) if _SLOW.search(text) else self._fast.encode_ordinary(text)


@lru_cache(maxsize=2)
def encoder(name: str, folder: str | None) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(name, folder)


def lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(enc.encode(t)) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def histogram(counted: DataFrame, block: int = 256) -> DataFrame:
    """Exact length histogram with suffix sums, of rows (…, n_tokens).

    One row per length that occurs: n_docs of that length, docs_at_least and
    tokens_at_least (over all documents that long or longer), and truncated_tokens
    (what remains of the corpus if every document is cut at this length). The sums
    run within blocks of lengths and then over blocks, so no window spans all rows.
    """
    hist = cut(counted.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "histogram").withColumn("block", F.floor(F.col("n_tokens") / block))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    after = Window.partitionBy("one").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    # As many blocks as the longest document has times `block` tokens.
    blocks = blocks.withColumn("one", F.lit(1)).select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t"), F.sum("t").over(Window.partitionBy("one")).alias("total"))
    out = hist.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        (F.sum("n_docs").over(inside) + F.col("d")).alias("docs_at_least"),
        (F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside) + F.col("t")).alias("tokens_at_least"),
        "total",
    )
    cut_here = F.col("total") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")
    return out.select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", cut_here.alias("truncated_tokens"))


def truncated_total(hist: DataFrame, limit: int) -> DataFrame:
    """One row: tokens that remain if every document is cut at ``limit``."""
    return hist.agg(F.coalesce(F.sum(F.col("n_docs") * F.least(F.col("n_tokens"), F.lit(limit))), F.lit(0)).alias("tokens"))


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least this share of the
    documents does not exceed; exact."""
    n = hist.agg(F.sum("n_docs").alias("n"))
    wanted = hist.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")
    upto = F.col("n") - F.col("docs_at_least") + F.col("n_docs")
    # One row, and as many as the caller names: loops over two short lists.
    at = hist.join(F.broadcast(n)).join(F.broadcast(wanted), upto >= F.ceil(F.col("share") * F.col("n")))
    return at.groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(lengths(table(spark, sf_dir, "documents")))
