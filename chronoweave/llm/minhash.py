"""Near-duplicate classes by b-bit MinHash.

Every text becomes the set of its distinct five-word shingles (64-bit hashes),
and the set a row of minima. Bands of full minima give candidates; only the low
bits of the minima are kept, packed, and their equal share, corrected for the
collisions that few bits bring, drops candidates that are far from the threshold
before the full sets of the rest are compared exactly.

Copies are folded first: documents with equal sets are one class, whose smallest
id stands for it. Within a bucket of a band, each member is first compared with
the bucket's smallest and largest ids, and linked ones are joined into components.
Buckets that then still hold several components have the pairs between different
components compared, so no pair of a bucket stays untested unless it is connected
already, and large groups of copies never become all their pairs. In a bucket of at most
`block` members those are all pairs, at most `block` for each member. In a larger one, of
texts off one template that mostly are not near each other, they are the pairs that their
shingles leave possible (`possible`): a bound on the intersection of full sets, which
drops no pair that reaches the threshold.

Defaults: 32 bands of 4 minima; a pair at similarity 0.75 shares a bucket with
probability 1 - 5e-6. The signatures are 1024 minima at two bits each, computed only for
documents that share a bucket; a pair is dropped below an estimate of 0.675, over four
standard errors under 0.75. A pair is tested in the first bucket that it shares.

Nulls and texts without words have no set: such documents are linked with nothing
and stand alone. Fewer words than five make one shingle of the whole sequence. A
null id is never linked; its component and kept are null. Rows that repeat an id
are one vertex. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, discard, is_empty, table
from .graph import components

_MUL = np.uint64(0x9E3779B97F4A7C15)
_LOW2 = 0x5555555555555555


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of one text."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if n < width:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=n)], np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n - width + 1, np.uint64)
        for i in range(width):
            out = _mix(out * _MUL + h[i : n - width + 1 + i])
    return np.unique(out)


class Sketcher:
    """Minima of shingle sets: bands * rows of them make keys, `packed` of them, those
    included, give two bits each to the signature."""

    def __init__(self, bands: int = 32, rows: int = 4, packed: int = 1024, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        if packed % 32 or packed < bands * rows:
            raise ValueError("packed must be a multiple of 32 (the minima in a word) and hold the bands' minima")
        self.a = rng.integers(0, 1 << 63, packed, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, packed, np.uint64)

    def minima(self, s: np.ndarray, k: int) -> np.ndarray:
        """The upper 32 bits of the smallest value of the first k hash functions."""
        low = np.full(k, np.iinfo(np.uint64).max, np.uint64)
        step = 65536 // k  # bounds the memory of very long texts
        with np.errstate(over="ignore"):
            for i in range(0, len(s), step):
                np.minimum(low, (s[i : i + step, None] * self.a[:k] + self.b[:k]).min(axis=0), out=low)
        return low >> np.uint64(32)

    def keys(self, m: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            k = np.arange(1, self.bands + 1, dtype=np.uint64) * _MUL
            for j in range(self.rows):
                k = _mix(k * _MUL + m[: self.bands * self.rows][j :: self.rows])
        return k.view(np.int64)

    @staticmethod
    def packed(m: np.ndarray) -> np.ndarray:
        """The two low bits of each minimum, 32 minima in a word."""
        low = (_mix(m) & np.uint64(3)).reshape(-1, 32)
        return np.bitwise_or.reduce(low << (np.arange(32, dtype=np.uint64) * np.uint64(2)), axis=1).view(np.int64)


def _sketches(width: int, sk: Sketcher):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, node, keys = [], [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(t, width)
                n.append(len(s))
                node.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(sk.keys(sk.minima(s, sk.bands * sk.rows)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "node", "keys"])

    return run


def _sets(width: int, sk: Sketcher):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                c = b.slice(i, 256)
                sets = [shingle_set(t, width) for t in c.column(1).to_pylist()]
                minima = [sk.minima(s, len(sk.a)) for s in sets]
                lists = ([s.view(np.int64) for s in sets], [sk.packed(m) for m in minima], [sk.keys(m) for m in minima])
                yield pa.RecordBatch.from_arrays([c.column(0), *(pa.array(x, pa.list_(pa.int64())) for x in lists)], ["id", "shingles", "sig", "keys"])

    return run


def estimate(a: str, b: str, words: int) -> str:
    """SQL for the similarity of two packed signatures: the share of equal two-bit
    values, less the quarter that is equal by chance."""
    differ = " + ".join(f"bit_count((({a}[{i}] ^ {b}[{i}]) | shiftrightunsigned({a}[{i}] ^ {b}[{i}], 1)) & {_LOW2}L)" for i in range(words))
    return f"(1 - ({differ}) / {words * 32}D - 0.25D) / 0.75D"


class NearDuplicates:
    def __init__(self, width: int = 5, percent: int = 75, bands: int = 32, rows: int = 4, packed: int = 1024, floor: float = 0.675, seed: int = 1, block: int = 128):
        self.width, self.percent, self.block = width, percent, block
        self.sketcher = Sketcher(bands, rows, packed, seed)
        self.near = f"{estimate('su', 'sv', packed // 32)} >= {floor}"

    def links(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Of candidate pairs (u, v), those whose full sets reach the threshold."""
        left = pairs.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u")
        both = left.join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v")
        shared = F.size(F.array_intersect("a", "b"))
        return cut(both.filter(100 * shared >= self.percent * (F.size("a") + F.size("b") - shared)).select("u", "v"), "links")

    def possible(self, crowd: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs (u > v) of different components of ``crowd`` (id, c) whose sets may reach the
        threshold, and the table that they are joined from.

        Only shingles that two components share can be in an intersection. With those of a
        set in one order for all sets, rarest first, an intersection that begins at a
        shingle has at most the `rest` from there on in either set, which lets the other
        set have up to `reach` shingles. A pair near enough keeps within both reaches at
        its first common shingle, and the smaller of its sets within its own there: what no
        set of the shingle can meet is left out before the join."""
        p, by_t = self.percent, Window.partitionBy("t")
        nodes = sets.select("id", "shingles", F.xxhash64("shingles").alias("s")).join(crowd, "id").dropDuplicates(["id", "s"])  # rows may repeat an id
        tokens = nodes.select("id", "s", "c", F.size("shingles").alias("n"), F.explode("shingles").alias("t"))
        shared = tokens.select("*", F.min("c").over(by_t).alias("c0"), F.max("c").over(by_t).alias("c1"), F.count("*").over(by_t).alias("df")).filter("c0 < c1")
        rest = F.row_number().over(Window.partitionBy("id", "s").orderBy(F.col("df").desc(), F.col("t").desc()))
        places = shared.select("id", "c", "n", "t", rest.alias("rest")).withColumn("reach", F.expr(f"(100 + {p}) * rest div {p} - n")).filter(f"100 * reach >= {p} * n")
        bounds = places.select("*", F.min(F.expr("if(reach >= n, n, null)")).over(by_t).alias("low"), F.max("reach").over(by_t).alias("far")).filter("reach >= low and n <= far")
        several = bounds.select("id", "c", "n", "t", "reach", F.min("c").over(by_t).alias("c0"), F.max("c").over(by_t).alias("c1")).filter("c0 < c1")
        made = cut(several.select("id", "c", "n", "t", "reach"), "places")
        x, y = (made.select("t", *(F.col(k).alias(k + side) for k in ("id", "c", "n", "reach"))) for side in "xy")
        order = "cx <> cy and (nx < ny or nx = ny and idx < idy) and ny <= reachx and nx <= reachy"
        pairs = x.filter("reachx >= nx").join(y, "t").filter(order)
        return cut(pairs.select(F.greatest("idx", "idy").alias("u"), F.least("idx", "idy").alias("v")).distinct(), "possible"), made

    def classes(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
        docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        rows = cut(docs.mapInArrow(_sketches(self.width, self.sketcher), "doc_id long, n_shingles long, node binary, keys array<long>"), "sketches")
        named = rows.filter("node is not null and doc_id is not null")
        folded = cut(named.groupBy("node").agg(F.min("doc_id").alias("id")), "folded")
        reps = named.join(folded, (named["node"] == folded["node"]) & (F.col("doc_id") == F.col("id"))).select("id", "keys")
        buckets = reps.select("id", F.posexplode("keys").alias("band", "key"))
        shared = cut(buckets.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi"), "buckets")
        members = cut(buckets.join(shared, "key"), "members")
        # The merge hint: texts are shuffled once, at every size of the input.
        some = members.select(F.col("id").alias("doc_id")).distinct().hint("merge")
        sets = cut(docs.join(some, "doc_id", "left_semi").mapInArrow(_sets(self.width, self.sketcher), "id long, shingles array<long>, sig array<long>, keys array<long>"), "sets")

        # u is the member and v the hub: a hub's rows meet it with the members' signatures
        # (and later their sets) already in them, large enough to be seen as skewed and split.
        stars = members.filter("id <> lo").select(F.col("id").alias("u"), F.col("lo").alias("v")).union(members.filter("id <> hi").select(F.col("id").alias("u"), F.col("hi").alias("v"))).distinct()
        stars = stars.join(sets.select(F.col("id").alias("u"), F.col("sig").alias("su")), "u").join(sets.select(F.col("id").alias("v"), F.col("sig").alias("sv")), "v")
        stars = cut(stars.filter(self.near).select("u", "v"), "stars")
        links = self.links(stars, sets)
        comp = cut(components(links), "components")

        # Buckets that still hold more than one component: every pair across, once.
        labelled = members.select("key", "band", "id").join(comp, "id", "left").select("key", "band", "id", F.coalesce("component", "id").alias("c"))
        mixed = labelled.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("n")).filter("c0 < c1")
        mixed = cut(mixed.select("key", "n"), "mixed")
        small, large = F.col("n") <= self.block, F.col("n") > self.block
        open_ = cut(labelled.join(mixed.filter(small), "key").join(sets.select("id", "sig", "keys"), "id"), "open")
        a = open_.select("key", "band", F.col("id").alias("u"), F.col("c").alias("cu"), F.col("sig").alias("su"), F.col("keys").alias("ku"))
        b = open_.select("key", F.col("id").alias("v"), F.col("c").alias("cv"), F.col("sig").alias("sv"), F.col("keys").alias("kv"))
        first = F.expr("band = 0 or not exists(sequence(0, band - 1), j -> ku[j] = kv[j])")
        cross = a.join(b, (a["key"] == b["key"]) & (F.col("cu") < F.col("cv")) & F.expr(self.near) & first).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        crowd = cut(labelled.join(mixed.filter(large), "key").select("id", "c").distinct(), "crowd")
        old = [crowd]
        if not is_empty(crowd):
            pairs, made = self.possible(crowd, sets)
            old += [pairs, made]
            pairs = pairs.join(sets.select(F.col("id").alias("u"), F.col("sig").alias("su")), "u").join(sets.select(F.col("id").alias("v"), F.col("sig").alias("sv")), "v")
            cross = cross.union(pairs.filter(self.near).select("u", "v"))
        tried = stars.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        cross = cut(cross.distinct().join(tried, ["u", "v"], "left_anti"), "cross")
        old += [stars, members, shared, mixed, open_, cross, links, comp, rows, folded, sets]
        if not is_empty(cross):
            more = self.links(cross, sets)
            old.append(more)
            if not is_empty(more):
                comp = cut(components(links.union(more)), "components")
                old.append(comp)

        label = folded.join(comp, "id", "left").select("node", F.coalesce("component", "id").alias("component"))
        out = rows.select("doc_id", "n_shingles", "node").join(label, "node", "left")
        alone = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), F.col("doc_id"))
        out = cut(out.select("doc_id", "n_shingles", alone.alias("component_id"), (F.col("doc_id") == alone).alias("kept")), "classes")
        discard(*old)
        return out


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearDuplicates().classes(table(spark, sf_dir, "documents"))


#: All pairs by common shingles, and all that can be reached; for small tables.
OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(ws) < 5 THEN ws ELSE ws[i : i + 4] END, ' ') AS s
  FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
l AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r AS (SELECT doc_id AS id, doc_id AS at FROM documents UNION SELECT r.id, l.v FROM r JOIN l ON l.u = r.at)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.at) AS component_id, d.doc_id = min(r.at) AS kept
FROM documents d JOIN r ON r.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates the smallest id stays."""
    gone = NearDuplicates().classes(docs).filter("not kept").select("doc_id").hint("merge")
    return docs.join(gone, "doc_id", "left_anti")
