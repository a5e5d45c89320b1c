"""Language identification by compression.

For every language a raw-content zstandard dictionary is cut from a bounded sample of
labelled texts. A text is encoded, chunk by chunk and whole, with each dictionary; the
language with the smallest sum is the prediction, and the share by which the runner-up
is larger is the score. Bytes are too coarse for short texts: languages that tie in bytes
are told apart, and scored, by bits, the ideal code length of the text by a character
model of the same dictionaries (contexts of up to `context` bytes, each order blended with
the one below). Where the margin is narrow the prediction is rejected, but only if the
text is long enough for `min_margin` to be a byte or more: no text goes for being short.

The sample: per language, of each of `sample_docs` hash classes of texts the one with
the smallest hash, `sample_chars` characters of each, at most 64 * 2048 by default, lower-cased like the texts. All
else covers whole texts.

Texts that are null or hold no letter give ``und`` with score 0 and are rejected, as
is every text when nothing could be learned. Labels that are null teach nothing. A row
with a null id is not held out and teaches nothing. Ties in bytes and bits go to the
language first in code point order. More than `max_langs` languages are refused: all their
dictionaries must fit in a worker. Rows that repeat are predicted each for itself. Columns
other than those named are never read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_LETTER = regex.compile(r"\p{L}")


@lru_cache(maxsize=2)
def _compressors(dicts: tuple[tuple[str, bytes], ...], level: int, chunk: int) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, data in dicts:
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        # Sized for chunk and dictionary together: else the window leaves most of the dictionary out.
        p = zstandard.ZstdCompressionParameters.from_level(level, source_size=chunk, dict_size=len(data), write_content_size=0, write_checksum=0, write_dict_id=0)
        d.precompute_compress(compression_params=p)
        out.append((lang, zstandard.ZstdCompressor(dict_data=d, compression_params=p)))
    return out


@lru_cache(maxsize=1024)
def _grams(data: bytes, context: int) -> list[Counter[bytes]]:
    """How often each string of 0, 1, ... context + 1 bytes occurs in a dictionary."""
    return [Counter({b"": len(data)}), *(Counter(data[i : i + k] for i in range(len(data) - k + 1)) for k in range(1, context + 2))]


def _bits(data: bytes, grams: list[Counter[bytes]], prior: float = 4.0) -> float:
    out = 0.0
    for i in range(len(data)):
        p = 1 / 256
        for k in range(min(i, len(grams) - 2) + 1):
            p = (grams[k + 1].get(data[i - k : i + 1], 0) + prior * p) / (grams[k].get(data[i - k : i], 0) + prior)
        out -= math.log2(p)
    return out


class CompressionLanguageId:
    """min_margin: below this score a prediction is rejected, if the text is long enough."""

    context = 3

    def __init__(self, sample_docs: int = 64, sample_chars: int = 2048, chunk: int = 8192, level: int = 6, min_margin: float = 0.003, max_langs: int = 1000):
        self.sample_docs, self.sample_chars, self.chunk, self.level, self.min_margin, self.max_langs = sample_docs, sample_chars, chunk, level, min_margin, max_langs
        self.dicts: tuple[tuple[str, bytes], ...] = ()

    def fit(self, labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> CompressionLanguageId:
        rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
        least = rows.groupBy("lang", F.pmod("h", F.lit(self.sample_docs)).alias("k")).agg(F.min("h").alias("h"))
        chosen = least.limit(self.max_langs * self.sample_docs + 1).collect()
        if len({r["lang"] for r in chosen}) > self.max_langs or len(chosen) > self.max_langs * self.sample_docs:
            raise ValueError(f"more than {self.max_langs} languages")
        if not chosen:
            self.dicts = ()
            return self
        keys = {(r["lang"], r["h"]) for r in chosen}
        texts = rows.filter(F.col("h").isin(sorted({h for _, h in keys}))).groupBy("lang", "h").agg(F.min(F.substring("text", 1, self.sample_chars)).alias("text")).collect()
        by: dict[str, list[tuple[int, str]]] = {}
        for r in texts:
            if (r["lang"], r["h"]) in keys:
                by.setdefault(r["lang"], []).append((r["h"], r["text"]))
        self.dicts = tuple((lang, "\n".join(t for _, t in sorted(by[lang])).lower().encode()) for lang in sorted(by))
        return self

    def costs(self, data: bytes) -> list[tuple[int, str]]:
        """(bytes, language), the smallest first."""
        parts = [data[i : i + self.chunk] for i in range(0, len(data), self.chunk)]
        return sorted((sum(len(c.compress(p)) for p in parts), lang) for lang, c in _compressors(self.dicts, self.level, self.chunk))

    def guess(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)"""
        if not self.dicts or not text or not _LETTER.search(text):
            return "und", 0.0, True
        data = text.lower().encode()
        found = self.costs(data)
        if len(found) == 1:
            return found[0][1], 1.0, False
        (least, lang), (second, _) = found[:2]
        score = 1 - least / second
        if least == second:
            by = dict(self.dicts)
            (fewest, lang), (more, _) = sorted((_bits(data, _grams(by[name], self.context)), name) for cost, name in found if cost == least)[:2]
            score = 1 - fewest / more
        return lang, score, score < self.min_margin and second * self.min_margin >= 1

    def predict(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, lang_pred, score, rejected) of every row, from the text alone."""
        shared = docs.sparkSession.sparkContext.broadcast((self.dicts, dict(self.__dict__)))  # bounded by the sample

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = CompressionLanguageId()
            own.__dict__.update(shared.value[1])
            for b in batches:
                found = [own.guess(t) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, *_ in found], pa.string()), pa.array([s for _, s, _ in found], pa.float64()), pa.array([r for *_, r in found], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

        return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _learned(docs: DataFrame) -> CompressionLanguageId:
    return CompressionLanguageId().fit(docs.filter(F.col("doc_id").isNotNull() & ~held_out()))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = _learned(docs).predict(docs)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language is rejected go."""
    model = _learned(docs)
    names = docs.columns
    shared = spark.sparkContext.broadcast(dict(model.__dict__))
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = CompressionLanguageId()
        own.__dict__.update(shared.value)
        for b in batches:
            found = [own.guess(t) for t in b.column(at).to_pylist()]
            yield b.filter(pa.array([not r for *_, r in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
