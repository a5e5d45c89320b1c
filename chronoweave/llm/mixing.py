"""Mixing sources to target weights.

The words of a source, document after document, are packed into blocks of a fixed
length (the last block of a source may be shorter). Output is a sequence of slots in
shards; a slot holds a block. Each shard
draws how many slots each source gets from a multinomial conditioned on the sources'
totals (so these come out exactly), by splitting the range of shards in halves again
and again with seeded hypergeometric draws: any task finds the counts of its own
shards in logarithmically many draws and nothing is drawn in sequence. The slots of a
source are numbered through, and a pseudorandom permutation per source and epoch (a
Feistel network) maps slot numbers to block indices, so a source is used up before
it repeats. Documents and slots meet in a join on source and block index: assemble()
gives the slots with their words and the places these come from, mix() only counts how
many words of each document the slots hold.

Only per-source sums reach the driver; more than `max_sources` sources are refused.
A document's place is found by two-level sums over hashed buckets of a source, so a
source with a third of all rows is many buckets.

Nulls: a null text has size 0, a null source is a source of its own, last in order.
Documents of size 0 are never taken. Rows that repeat an id are documents of their
own. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, discard, table


class Share(NamedTuple):
    sid: int
    source: str | None
    words: int
    docs: int
    target: float
    blocks: int
    slots: int


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Shares of the total by weight, none above `most` times its size; what is cut
    off is shared among the rest by weight until none is above."""
    total, out, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
        per = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if per * weights[i] > most * sizes[i]}
        for i in over or open_:
            out[i] = most * sizes[i] if over else per * weights[i]
        open_ = open_ - over if over else set()
    return out


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 by a Feistel network that walks cycles
    until a value falls inside the range."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    rng = np.random.default_rng(key)
    keys = rng.integers(0, 1 << 63, 4, np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> np.uint64(half), x & mask
        with np.errstate(over="ignore"):
            for k in keys:
                h = (b + k) * np.uint64(0x9E3779B97F4A7C15)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                a, b = b, a ^ ((h >> np.uint64(32)) & mask)
        return (a << np.uint64(half)) | b

    x = once(index.astype(np.uint64))
    while (out := x >= n).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def draw(rng: np.random.Generator, count: np.ndarray, n: int, most: int) -> np.ndarray:
    """How many of n slots, drawn from `count` slots by source, each source gets.

    numpy draws from totals below 10^9. The slots are dealt to strata of at most `most`
    slots and the same make-up, and each gives its share of n; mean and variance are those
    of one draw, but for the rounding of the strata."""
    total, left = int(count.sum()), np.zeros_like(count)
    strata, held, given = -(-total // most), 0, 0
    for j in range(strata):
        part = count * (j + 1) // strata - count * j // strata
        held += int(part.sum())
        upto = n * held // total
        left += rng.multivariate_hypergeometric(part, upto - given, method="marginals")
        given = upto
    return left


def shard_counts(slots: np.ndarray, shards: int, first: int, last: int, seed: int, most: int = 5 * 10**8) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, first slot of each source, slots of each source) of shards first..last-1."""
    total = int(slots.sum())
    upto = lambda s: total * s // shards

    def walk(lo: int, hi: int, start: np.ndarray, count: np.ndarray):
        if hi <= first or lo >= last:
            return
        if hi - lo == 1:
            yield lo, start, count
            return
        mid = (lo + hi) // 2
        left = draw(np.random.default_rng([seed, lo, hi]), count, upto(mid) - upto(lo), most)
        yield from walk(lo, mid, start, left)
        yield from walk(mid, hi, start + left, count - left)

    yield from walk(0, shards, np.zeros_like(slots), slots)


def _measured(with_text: bool):
    """(doc_id, source, size, tie) and the text if asked for. `tie` orders rows of equal id
    and size by their texts, so that reruns agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(t or "").encode() for t in b.column(2).to_pylist()]
            tie = np.array([xxhash.xxh3_64_intdigest(x) for x in raw], np.uint64).view(np.int64)
            cols = [b.column(0), b.column(1), pa.array([len(x.split()) for x in raw], pa.int64()), pa.array(tie)]
            names = ["doc_id", "source", "size", "tie"]
            yield pa.RecordBatch.from_arrays([*cols, b.column(2)] if with_text else cols, [*names, "text"] if with_text else names)

    return run


def _block_words(block: int):
    """From (doc_id, sid, start, text): the words that each document gives to each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                doc, sid, start, text = (c[i].as_py() for c in b.columns)
                words = [w.decode() for w in text.encode().split()]
                cuts = [0, *range(block - start % block, len(words), block), len(words)]
                spans = list(zip(cuts, cuts[1:]))
                cols = ([sid] * len(spans), [(start + x) // block for x, _ in spans], [(start + x) % block for x, _ in spans], [doc] * len(spans), [x for x, _ in spans], [words[x:y] for x, y in spans])
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["sid", "block", "at", "doc_id", "begin", "words"])

    return run


class Mixture:
    """block_words: words in a block; shard_slots: slots in an output shard; draw_limit:
    the largest total of one draw, see draw()."""

    def __init__(self, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, block_words: int = 64, shard_slots: int = 4096, seed: int = 7, max_sources: int = 100_000, draw_limit: int = 5 * 10**8):
        self.weights, self.most, self.block, self.shard_slots, self.seed, self.max_sources, self.draw_limit = weights, most, block_words, shard_slots, seed, max_sources, draw_limit

    def shares(self, sized: DataFrame) -> list[Share]:
        rows = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).limit(self.max_sources + 1).collect()
        if len(rows) > self.max_sources:
            raise ValueError(f"more than {self.max_sources} sources")
        rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        goal = targets([r["words"] for r in rows], [self.weights[i % len(self.weights)] for i in range(len(rows))], self.most) if rows else []
        out = []
        for i, (r, t) in enumerate(zip(rows, goal)):
            n = -(-r["words"] // self.block)
            epochs = min(self.most, int(t // r["words"])) if r["words"] else 0
            more = 0 if epochs == self.most or not n else min(n, round((t - epochs * r["words"]) / self.block))
            out.append(Share(i, r["source"], r["words"], r["docs"], float(t), n, epochs * n + more))
        return out

    def slots(self, spark: SparkSession, shares: list[Share]) -> DataFrame:
        """(shard, place, sid, epoch, block): the mix, slot by slot."""
        counts = np.array([s.slots for s in shares], np.int64)
        blocks = np.array([s.blocks for s in shares], np.int64)
        shards = max(1, math.ceil(int(counts.sum()) / self.shard_slots))
        seed, limit = self.seed, self.draw_limit

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for shard, start, n in shard_counts(counts, shards, int(pdf.id.min()), int(pdf.id.max()) + 1, seed, limit):
                    parts = []
                    for i in np.flatnonzero(n):
                        k = start[i] + np.arange(n[i])
                        epoch, block = k // blocks[i], np.empty(n[i], np.int64)
                        for e in np.unique(epoch):
                            block[epoch == e] = permute(k[epoch == e] % blocks[i], int(blocks[i]), [seed, int(i), int(e)])
                        parts.append(pd.DataFrame({"sid": i, "epoch": epoch, "block": block}))
                    if parts:
                        out = pd.concat(parts).sample(frac=1, random_state=shard % 2**32)
                        yield pd.DataFrame({"shard": shard, "place": np.arange(len(out)), "sid": out.sid.to_numpy(), "epoch": out.epoch.to_numpy(), "block": out.block.to_numpy()})

        wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return spark.range(0, shards, 1, max(1, min(shards, wide))).mapInPandas(run, "shard long, place long, sid int, epoch long, block long")

    def _sized(self, docs: DataFrame, id_col: str, text_col: str, source_col: str, with_text: bool) -> DataFrame:
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
        return cut(rows.mapInArrow(_measured(with_text), "doc_id long, source string, size long, tie long" + ", text string" * with_text), "sizes")

    @staticmethod
    def _known(sized: DataFrame, shares: list[Share]) -> DataFrame:
        """Rows with their source's number, size and target."""
        schema = "sid int, source string, source_size long, docs long, target double, blocks long, slots long"
        dim = F.broadcast(sized.sparkSession.createDataFrame(shares, schema))  # at most max_sources rows
        return sized.join(dim, sized["source"].eqNullSafe(dim["source"])).drop(dim["source"]).drop("blocks", "slots")

    @staticmethod
    def _placed(known: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Add `start`, the words of the source before the document's; and the table of
        bucket sums that it rests on. Documents without words have no place."""
        # Buckets of about sqrt(documents) rows, 512 at least.
        rows = F.greatest(F.lit(512), F.sqrt("docs"))
        some = known.filter("size > 0").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.ceil(F.col("docs") / rows)))
        sums = cut(some.groupBy("sid", "bucket").agg(F.sum("size").alias("n")), "bucket-sums")
        earlier = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        base = sums.select("sid", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
        inside = Window.partitionBy("sid", "bucket").orderBy("doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
        placed = some.withColumn("upto", F.sum("size").over(inside)).join(base, ["sid", "bucket"])
        return placed.withColumn("start", F.col("base") + F.col("upto") - F.col("size")).drop("bucket", "upto", "base", "tie", "docs"), sums

    def mix(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
        """(doc_id, size, source_size, target, taken) of every row."""
        sized = self._sized(docs, id_col, text_col, source_col, False)
        shares = self.shares(sized)
        known = self._known(sized, shares)
        none = known.filter("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
        placed, sums = self._placed(known)
        b = F.lit(self.block)
        first, last = F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b)
        segments = placed.select("doc_id", "size", "sid", "source_size", "target", "start", F.explode(F.sequence(first, last)).alias("block"))
        overlap = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b) - F.greatest(F.col("start"), F.col("block") * b)
        uses = self.slots(docs.sparkSession, shares).groupBy("sid", "block").agg(F.count("*").alias("uses"))
        # Spark takes what Python makes from a short range for a short table and would
        # broadcast it; it grows with the corpus.
        joined = segments.join(uses.hint("merge"), ["sid", "block"], "left")
        taken = joined.groupBy("sid", "start", "doc_id", "size", "source_size", "target").agg(F.sum(overlap * F.coalesce("uses", F.lit(0))).alias("taken"))
        out = cut(taken.select("doc_id", "size", "source_size", "target", "taken").union(none), "mixed")
        discard(sized, sums)
        return out

    def assemble(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
        """The mix itself, one row per slot: shard, place, source, epoch, block, words, and
        pieces (doc_id, begin, length), the documents' words that make up the block. Blocks
        of a shard follow each other by `place`; write it by
        ``.repartition(n, "shard").sortWithinPartitions("shard", "place")``."""
        sized = self._sized(docs, id_col, text_col, source_col, True)
        shares = self.shares(sized)
        placed, sums = self._placed(self._known(sized, shares))
        parts = placed.select("doc_id", "sid", "start", "text").mapInArrow(_block_words(self.block), "sid int, block long, at long, doc_id long, begin long, words array<string>")
        # A block holds at most block_words pieces.
        blocks = parts.groupBy("sid", "block").agg(F.sort_array(F.collect_list(F.struct("at", "doc_id", "begin", "words"))).alias("parts"))
        names = F.broadcast(docs.sparkSession.createDataFrame([(s.sid, s.source) for s in shares], "sid int, source string"))  # at most max_sources rows
        rows = self.slots(docs.sparkSession, shares).join(blocks.hint("merge"), ["sid", "block"]).join(names, "sid")
        pieces = F.transform("parts", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["begin"].alias("begin"), F.size(x["words"]).cast("long").alias("length")))
        out = cut(rows.select("shard", "place", "source", "epoch", "block", F.flatten(F.transform("parts", lambda x: x["words"])).alias("words"), pieces.alias("pieces")), "assembled")
        discard(sized, sums)
        return out


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mixture().mix(table(spark, sf_dir, "documents"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document appears as often as the mix takes it.

    The share taken/size (0 to 3) is rounded down or up by a hash of the id, with the
    chance that keeps each source near its target."""
    mixed = Mixture().mix(docs)
    per = mixed.groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    chance = F.pmod(F.xxhash64(F.lit("copies"), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    copies = per.filter("size > 0").select(F.col("doc_id").alias("_cw_id"), F.floor(F.col("taken") / F.col("size") + chance).cast("int").alias("_cw_copies")).filter("_cw_copies > 0")
    out = docs.join(copies.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_cw_id")))
    return out.withColumn("_cw_nth", F.explode(F.sequence(F.lit(1), F.col("_cw_copies")))).select(*docs.columns)
