"""The corpus pipeline: language ID, exact and near deduplication, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read back as the next stage's documents. Once it is written, the table of the
stage before and all that the stage itself wrote on the way are deleted.

A null text, or one without a letter, goes in the first stage. A null id takes part in
every stage; the near-duplicate stage links it with nothing. Rows that repeat id and text
are one document to the second stage. Columns beyond those of documents pass through all
stages but the last. Empty documents give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoweave.llm import common, exact_dedup, language_id, minhash, mixing, packing

STAGES = [
    ("language_id", language_id.language_stage),
    ("exact_dedup", exact_dedup.exact_dedup_stage),
    ("near_dedup", minhash.near_dedup_stage),
    ("mixing", mixing.mixing_stage),
    ("best_fit_packing", packing.packing_stage),
]

#: Compression, MinHash, permutations and bin packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with common.scratch() as made:
            done = common.cut(stage(spark, docs, sf_dir), name)
            made.pop()  # done itself
        if hasattr(docs, "_cut_path"):
            common.discard(docs)
        docs = done
    return docs
