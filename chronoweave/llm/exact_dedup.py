"""Exact deduplication against a persistent digest index.

The index is a Spark table of one row per distinct text, bucketed and sorted by
digest. A batch is reduced to one row per digest, anti-joined with the index by
sort-merge (the index side is already bucketed, so only the batch moves), and
what remains is appended.

Texts are equal when identical after lower-casing A-Z only. Nulls: a null text
counts as empty; a null id takes part, and loses against any other id. Rows that
repeat both id and text are all returned, one of them kept. An empty table gives
an empty result. Columns other than the two named are never read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, table


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        # bytes.lower() changes A-Z only
        d = [hashlib.sha256((t or "").encode().lower()).digest() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d, pa.binary())], ["doc_id", "digest"])


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of each normalised text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_digests, "doc_id long, digest binary")


class DigestIndex:
    """A persistent set of the digests seen so far, each with the batch that brought it.

    A batch has a name. If a batch fails after its digests were appended, run it again
    under the same name: the digests are there, and its rows own them. Names must not be
    used for other rows. ``buckets`` counts for a new index only; later on the table's
    own number holds, whatever the session's settings are.
    """

    SCHEMA = "digest binary, keep_id long, group_size long, batch string"

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.name = spark, name
        self._buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    @property
    def buckets(self) -> int:
        if not self.exists():
            return self._buckets
        rows = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}").filter("col_name = 'Num Buckets'").collect()
        return int(rows[0]["data_type"])

    def read(self) -> DataFrame:
        if self.exists():
            return self.spark.table(self.name)
        return self.spark.createDataFrame([], self.SCHEMA)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The rows of ``groups`` whose digest the index lacks."""
        if not self.exists():
            return groups
        return groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add the rows (digest, keep_id, group_size) that the index lacks. Run again
        after a failure, the anti-join skips what was already committed."""
        n = self.buckets
        rows = self.unseen(groups.select("digest", "keep_id", "group_size")).withColumn("batch", F.lit(batch))
        rows.repartition(n, "digest").write.mode("append").format("parquet").option("compression", "zstd").bucketBy(n, "digest").sortBy("digest").saveAsTable(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def dedup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Deduplicate a batch and record it.

        Returns per row of the batch: doc_id, keep_id (the row that stays: an
        earlier batch's if the index has the text, else the batch's largest id),
        group_size (equal rows in the batch that first brought the text), kept,
        text_sha256. Without a name the batch gets one of its own and can't be resumed.
        """
        batch = batch or uuid.uuid4().hex
        rows = cut(text_digests(docs, id_col, text_col).groupBy("doc_id", "digest").agg(F.count("*").alias("n")), "digests")
        groups = cut(rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")), "groups")
        self.append(groups, batch)
        # A digest may have very many rows. What the index says about this batch is
        # written out: between two exchanges adaptive execution can split the hot ones.
        state = cut(self.read().join(groups.select("digest").hint("merge"), "digest", "left_semi"), "seen")
        out = rows.join(state, "digest").select(
            "doc_id",
            "keep_id",
            "group_size",
            F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("nth"),
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("batch") == batch)).alias("first"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
        out = cut(out.select("doc_id", "keep_id", "group_size", (F.col("first") & (F.col("nth") == 1)).alias("kept"), "text_sha256"), "dedup")
        discard(rows, groups, state)
        return out


def dedup_halves(index: DigestIndex, docs: DataFrame) -> DataFrame:
    """What an empty index's dedup() of ``docs`` gives, by two batches: the rows of
    larger ids first, so that the batch that brings a text has the row that stays, then
    the others, whose equal rows are added to the sizes of the groups they join."""
    edge = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), 0.5)).first()[0]
    larger = F.coalesce(F.col("doc_id").cast("long") > F.lit(edge).cast("long"), F.lit(False))
    first, second = index.dedup(docs.filter(larger), batch="larger"), index.dedup(docs.filter(~larger), batch="smaller")
    # Of a text that the index had, no row of the batch is kept.
    joined = second.groupBy("text_sha256").agg(F.count("*").alias("more"), F.max("kept").alias("brought")).filter("not brought").select("text_sha256", "more")
    joined = cut(joined, "joined")
    rows = first.union(second).join(joined.hint("merge"), "text_sha256", "left")
    out = cut(rows.select("doc_id", "keep_id", (F.col("group_size") + F.coalesce("more", F.lit(0))).alias("group_size"), "kept", "text_sha256"), "dedup-halves")
    discard(first, second, joined)
    return out


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    try:
        return dedup_halves(index, table(spark, sf_dir, "documents"))
    finally:
        index.drop()


OP4_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents),
w AS (
  SELECT doc_id, h, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
         row_number() OVER (PARTITION BY h ORDER BY doc_id DESC NULLS LAST) AS nth
  FROM d)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, h AS text_sha256 FROM w
"""


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each group of equal texts stays."""
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    try:
        found = dedup_halves(index, docs)
    finally:
        index.drop()
    return keep_rows(docs, found)


def keep_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``docs`` that ``found`` (doc_id, kept, text_sha256) keeps.

    Only the ids of dropped rows are joined. A repeated row has the same id as its
    kept twin; such ids are settled by id and digest, one row each.
    """
    per_id = cut(found.groupBy("doc_id").agg(F.count_if("kept").alias("n_kept"), F.count("*").alias("n")), "per-id")
    # The merge hint: the same plan at every size, for the ids grow with the corpus.
    gone = per_id.filter("n_kept = 0").select("doc_id").hint("merge")
    mixed = per_id.filter("n_kept > 0 and n > n_kept")
    same = docs["doc_id"].eqNullSafe(gone["doc_id"])
    kept = docs.join(gone, same, "left_anti")
    if mixed.take(1):
        few = mixed.select(F.col("doc_id").alias("_cw_id"))
        twins = kept.join(few, F.col("doc_id").eqNullSafe(F.col("_cw_id")), "left_semi")
        stay = found.filter("kept").select(F.col("doc_id").alias("_cw_id"), "text_sha256")
        hashed = twins.withColumn("_cw_sha", _sql_digest(F.col("text")))
        stay = hashed.join(stay, F.col("doc_id").eqNullSafe(F.col("_cw_id")) & (F.col("_cw_sha") == F.col("text_sha256")), "left_semi").dropDuplicates(["doc_id", "_cw_sha"])
        kept = kept.join(few, F.col("doc_id").eqNullSafe(F.col("_cw_id")), "left_anti").unionByName(stay.drop("_cw_sha"))
    return kept


def _sql_digest(text):
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), 256)
