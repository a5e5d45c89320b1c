"""Best-fit packing into sequences by minimum bin slack.

A document's tokens are its ids and a closing id; only documents longer than a
sequence are cut, into full pieces after a first, shorter one. What matters for the
packing is how many pieces have each length, a table of at most as many rows as a
sequence has tokens. Over this histogram, for the longest length left, a bitset
subset-sum over the available lengths finds the fullest combination that fits beside
it; the combination is used as often as its lengths allow and then removed, until
nothing is left. The plan is the same however the rows are partitioned, and its size
depends on the sequence length only. Each piece then looks up its place by its rank
among the pieces of its length.

A null text counts as empty and packs as its closing id alone. Rows that repeat a
doc_id or text are packed each for itself. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, discard, table
from .tokens import encoder

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """The pieces of every document, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.array([*enc.encode(text), end_id], "<u4")
                n, start, k = len(ids), 0, 0
                take = n % size or min(n, size)
                while start < n:
                    out.append((doc, k, start, take, zlib.crc32(ids[start : start + take].tobytes())))
                    start, take, k = start + take, size, k + 1
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECE)


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """Lengths and how often each, of at most ``counts``, with the largest sum that
    fits into ``room``. Bit s of a state is set when sum s can be reached. Longer
    lengths come first, so that of equal sums the one with fewer, longer pieces wins
    and the short pieces, which fill any gap, are kept for later."""
    states, parts, reach, mask = [], [], 1, (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, step = min(counts[length], room // length), 1
        while left:  # a multiplicity as binary parts
            k = min(step, left)
            states.append(reach)
            parts.append((length, k))
            reach |= (reach << (length * k)) & mask
            left, step = left - k, step * 2
            if reach >> room:
                break
        if reach >> room:
            break
    total, used = reach.bit_length() - 1, {}
    for before, (length, k) in zip(reversed(states), reversed(parts)):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + k
            total -= length * k
    return sorted(used.items(), reverse=True)


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first_rank, n, first_bin, offset): of the pieces of a length,
    those with ranks from first_rank on, n of them, go to bins from first_bin on, one
    in each, at the offset."""
    counts = {k: v for k, v in counts.items() if v}
    rank, rows, bin_ = dict.fromkeys(counts, 0), [], 0
    while counts:
        top = max(counts)
        left = {k: v - (k == top) for k, v in counts.items() if v > (k == top)}
        use = dict(fullest(left, size - top))
        use[top] = use.get(top, 0) + 1
        times = min(counts[k] // n for k, n in use.items())
        offset = 0
        for length in sorted(use, reverse=True):
            for _ in range(use[length]):
                rows.append((length, rank[length], times, bin_, offset))
                rank[length] += times
                offset += length
            counts[length] -= times * use[length]
            if not counts[length]:
                del counts[length]
        bin_ += times
    return rows


def pack(parts: DataFrame, size: int = 2048) -> DataFrame:
    """Add sequence_id and offset to pieces (…, length)."""
    parts = cut(parts, "pieces")
    n = parts.count()
    # Ranks within a length, in two levels: a hot length is spread over salts.
    salts = max(16, math.isqrt(n) // 4)
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    per = cut(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "salts")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    per_before = per.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    at: dict[int, list[tuple[int, int, int, int, int]]] = {}
    for row in plan(counts, size):
        at.setdefault(row[0], []).append(row)
    places = {k: tuple(np.array(c, np.int64) for c in zip(*((r[1], r[3], r[4]) for r in v))) for k, v in at.items()}
    shared = parts.sparkSession.sparkContext.broadcast(places)
    rows = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(rows) - 1).join(per_before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                first, bins, offset = shared.value[int(k)]
                m = np.flatnonzero(length == k)
                i = np.searchsorted(first, rank[m], "right") - 1
                seq[m], off[m] = bins[i] + rank[m] - first[i], offset[i]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], [*b.schema.names[:5], "sequence_id", "offset"])

    out = cut(ranked.mapInArrow(place, f"{PIECE}, sequence_id long, offset long"), "packed")
    discard(parts, per)
    return out


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every piece of every document, and its place."""
    return pack(pieces(docs))
