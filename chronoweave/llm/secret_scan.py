"""Secret scans by DataFrame functions only.

Three fixed patterns give the base spans. Beyond them, every run of key characters of
at least `min_length` is scored by two character Markov models, one of random strings
and one of ordinary identifiers, both trained from labelled samples; the run is a span
of kind ``markov`` when its log-likelihood ratio reaches `min_ratio` nats a character
and no base span overlaps it.

Training samples come from the documents: the values that base patterns caught are
labelled random, words of texts without a base span ordinary. Per label at most
`sample` hash classes give one value (random) or `sample_chars` characters of one text
(ordinary), the one with the smallest hash. That bounds the training and nothing else. Counts are smoothed with one for every
pair of symbols, so that without samples both models are uniform and add nothing.

Offsets are code points, end exclusive. A null text counts as empty, and an empty text
has no spans. Time grows with the length of a text and, by a logarithm, with its spans.
Rows that repeat are scanned each for itself. Columns other than the two named are never
read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, table

#: The base patterns. Runs of the classes are maximal, so a minimum
#: length may stand in the pattern of the two kinds that are one class to the end.
ASSIGN = r"(?i)(?:password|passwd|secret|token|api_?key)[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

#: Matches whose positions are summed up in one array.
CHUNK = 512

_SPAN = "array<struct<s:int,r:int,e:int,v:string>>"


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to a value that is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _hits(text: str, pattern: str, rank: int) -> str:
    """SQL: every match of ``pattern`` as (start, rank, end, value). What lies between
    matches comes from split(), so that running sums of lengths are positions. The sums run
    within chunks of matches and over chunks: appending to one array copies it each time,
    which would make a text of very many matches quadratic."""
    zipped = f"arrays_zip(split({text}, r'{pattern}', -1), regexp_extract_all({text}, r'{pattern}', 0))"
    steps = "transform(z, x -> length(x.`0`) + coalesce(length(x.`1`), 0))"
    chunks = f"transform(sequence(0, (size(z) - 1) div {CHUNK}), k -> slice(steps, k * {CHUNK} + 1, {CHUNK}))"
    running = "aggregate(slice({0}, 1, size({0}) - 1), array({1}), (sums, n) -> concat(sums, array(element_at(sums, -1) + {2})))"
    bases = running.format("chunks", "0", "aggregate(n, 0, (t, y) -> t + y)")
    starts = "flatten(zip_with(chunks, bases, (c, base) -> " + running.format("c", "base", "n") + "))"
    found = f"filter(transform(z, (x, i) -> if(x.`1` is null, null, named_struct('s', starts[i] + length(x.`0`), 'r', {rank}, 'e', starts[i] + length(x.`0`) + length(x.`1`), 'v', x.`1`))), x -> x is not null)"
    return f"cast({_let(zipped, 'z', _let(steps, 'steps', _let(chunks, 'chunks', _let(bases, 'bases', _let(starts, 'starts', found)))))} as {_SPAN})"


def _guarded(text: str, pattern: str, rank: int) -> str:
    return f"if({text} rlike r'{pattern}', {_hits(text, pattern, rank)}, cast(array() as {_SPAN}))"


def base_spans(text: str = "text") -> Column:
    """array of (s, r, e, v), by start and then kind, of a text column without nulls."""
    assign = f"filter({_guarded(text, ASSIGN, 0)}, x -> length(regexp_extract(x.v, r'{ASSIGN}', 1)) >= 6)"
    return F.expr(f"array_sort(concat({assign}, {_guarded(text, ACCESS, 1)}, {_guarded(text, HEX, 2)}))")


def _joined(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat_ws(':', element_at(array({names}), x.r + 1), cast(x.s as string), cast(x.e as string))), ',')"


def _neighbours(value: str, body: str) -> str:
    """SQL: ``body`` of every two neighbouring characters x and y. The string is split
    once; taking characters by number walks UTF-8 from the start each time."""
    return _let(f"split({value}, '')", "chars", f"zip_with(slice(chars, 1, size(chars) - 1), slice(chars, 2, size(chars) - 1), (x, y) -> {body})")


def _meets(spans: str) -> str:
    """SQL: whether run x overlaps one of ``spans``, which are in order and apart: the last
    that starts before x's end, found by halving steps, must not end after x's start."""
    steps = f"transform(sequence(length(bin(size({spans}))), 0, -1), k -> shiftleft(1, k))"
    last = f"aggregate({steps}, 0, (at, step) -> if(at + step <= size({spans}) and get({spans}, at + step - 1).s < x.e, at + step, at))"
    return f"coalesce(get({spans}, {last} - 1).e > x.s, false)"


class SecretScanner:
    def __init__(self, min_length: int = 20, min_ratio: float = 0.7, sample: int = 512, sample_chars: int = 4096):
        self.min_length, self.min_ratio, self.sample, self.sample_chars = min_length, min_ratio, sample, sample_chars
        self.pattern = rf"[A-Za-z0-9+/=_-]{{{min_length},}}"
        self.ratios: list[float] | None = None

    @staticmethod
    def _pairs(strings: DataFrame) -> dict[tuple[int, int], int]:
        """Counts of neighbouring characters, by code less 32; at most 95 * 95 rows."""
        one = strings.select(F.explode(F.expr(_neighbours("v", "struct(ascii(x) as a, ascii(y) as b)"))).alias("p")).select("p.a", "p.b")
        ok = one.filter("a between 32 and 126 and b between 32 and 126")
        return {(r["a"] - 32, r["b"] - 32): r["n"] for r in ok.groupBy("a", "b").agg(F.count("*").alias("n")).collect()}

    def train(self, random: DataFrame, ordinary: DataFrame) -> SecretScanner:
        """From labelled strings, column v each."""
        symbols = [ord(c) - 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"]
        logs = []
        for counts in (self._pairs(random), self._pairs(ordinary)):
            rows: dict[int, int] = defaultdict(int)
            for (a, b), n in counts.items():
                if a in symbols and b in symbols:
                    rows[a] += n
            logs.append({(a, b): math.log((counts.get((a, b), 0) + 1) / (rows[a] + len(symbols))) for a in symbols for b in symbols})
        self.ratios = [round(logs[0].get((a, b), 0.0) - logs[1].get((a, b), 0.0), 6) for a in range(95) for b in range(95)]
        return self

    def fit(self, docs: DataFrame, scanned: DataFrame, text_col: str = "text") -> SecretScanner:
        """Train from documents and what base_spans() found in them (column base)."""
        found = scanned.filter("size(base) > 0").select(F.explode("base").alias("x")).select(F.expr(f"if(x.r = 0, regexp_extract(x.v, r'{ASSIGN}', 1), x.v)").alias("v"))
        hashed = found.filter("length(v) >= 12").withColumn("h", F.xxhash64("v"))
        random = hashed.groupBy(F.pmod("h", F.lit(self.sample))).agg(F.min_by("v", "h").alias("v"))
        text = docs.select(F.col(text_col).alias("text")).filter("text is not null").withColumn("h", F.xxhash64("text"))
        least = text.groupBy(F.pmod("h", F.lit(self.sample))).agg(F.min("h").alias("h"))
        chosen = [r["h"] for r in least.collect()]  # at most `sample` rows
        clean = text.filter(F.col("h").isin(chosen)).groupBy("h").agg(F.min(F.substring("text", 1, self.sample_chars)).alias("text")).filter(F.size(base_spans("text")) == 0)
        ordinary = clean.select(F.explode(F.expr("regexp_extract_all(text, r'[A-Za-z0-9_-]{4,}', 0)")).alias("v"))
        return self.train(random, ordinary)

    def ratio(self, value: str) -> str:
        """SQL: the log-likelihood ratio of a string of key characters, a character."""
        table_ = "cast(split('" + ",".join(map(str, self.ratios)) + "', ',') as array<double>)"
        gains = _neighbours(value, f"element_at({table_}, (ascii(x) - 32) * 95 + ascii(y) - 31)")
        return f"aggregate({gains}, 0D, (p, g) -> p + g) / (length({value}) - 1)"

    def scan(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, base, added): base spans and those of the Markov models."""
        text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        # One pass over the texts: from here on only what was found moves.
        found = cut(text.select("doc_id", base_spans("text").alias("base"), F.expr(_guarded("text", self.pattern, 3)).alias("runs")), "secret-candidates")
        if self.ratios is None:
            self.fit(docs, found, text_col)
        # Spans of one kind lie apart, those of different kinds may overlap.
        kinds = [f"filter(base, y -> y.r = {r})" for r in range(3)]
        meets = " or ".join(_meets(f"k{r}") for r in range(3))
        apart = f"filter(runs, x -> not ({meets}))"
        for r in range(3):
            apart = _let(kinds[r], f"k{r}", apart)
        runs = found.select("doc_id", "base", F.expr(f"if(size(runs) = 0 or size(base) = 0, runs, {apart})").alias("runs"))
        out = runs.select("doc_id", "base", F.expr(f"filter(runs, x -> {self.ratio('x.v')} >= {self.min_ratio})").alias("added"))
        out = cut(out, "secrets")
        discard(found)
        return out


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = SecretScanner().scan(table(spark, sf_dir, "documents"))
    count = lambda r: F.expr(f"cast(size(filter(base, x -> x.r = {r})) as long)")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(F.expr(_joined("base")), 256).alias("base_sha256"),
        F.expr(_joined("array_sort(concat(base, added))")).alias("spans"),
        F.expr("cast(size(added) as long)").alias("n_markov"),
    )
