"""WARC archives as a Spark data source.

``spark.read.format("warc").load(folder)`` plans groups of files as partitions, takes
over filters on the record type and on header columns, parses a record's headers
first, and leaves the blocks of records it doesn't want undecoded: each record is a
gzip member that tells its own length in an extra field, so a reader seeks past it (a
member without that field is inflated, and may hold several records). Files are ``.warc`` or
``.warc.gz``, on any file system that pyarrow reaches (file, hdfs, s3, ...); archives in a
store that only Hadoop knows are read by ``through_spark()``.

Options: ``columns`` (comma list of COLUMNS; payload, payload_bytes and payload_sha1
are decoded only if named); ``partition_bytes``, the most bytes of a partition, and
``min_partitions``, for which partitions get smaller, but not below 4 MB; ``mode``,
``failfast`` (a broken record fails the read) or ``permissive`` (what can't be read up to the
next record gives one row in which only ``corrupt`` is set, with file, offset and reason).

``df.write.format("warc").save(folder)`` writes the columns record_id, record_type,
target_uri, warc_date, payload_sha1, refers_to and payload (others are ignored). Files
count once the job's manifest names them, so attempts that were lost leave nothing to
read. The manifest also marks record starts inside files, where a reader may split them.

Null headers are left out and read back as null; a null payload is an empty one. Headers
are written as they are, but for those with control characters: these are percent-encoded,
and a header of our own names them, so that others' headers are never decoded. A folder
without archives is an empty table. Records that repeat are all kept.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any, BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

from .common import cut, discard, scratch, shared_dir, table

#: Column, type, and the header it comes from.
COLUMNS = {
    "record_id": ("string", "WARC-Record-ID"),
    "record_type": ("string", "WARC-Type"),
    "target_uri": ("string", "WARC-Target-URI"),
    "warc_date": ("string", "WARC-Date"),
    "header_digest": ("string", "WARC-Payload-Digest"),
    "refers_to": ("string", "WARC-Refers-To"),
    "payload_bytes": ("long", None),
    "payload_sha1": ("string", None),
    "payload": ("binary", None),
    "corrupt": ("string", None),
}
_CODED = ("payload_bytes", "payload_sha1", "payload")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


#: Names the headers of a record whose values are percent-encoded.
_ENCODED = "X-Percent-Encoded"
_CONTROL = re.compile(r"[\x00-\x1f\x7f]|^\s|\s$")


def _value(s: str) -> str:
    """Percent-encoded if it can't stand in a header as it is."""
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", s) if _CONTROL.search(s) else s


def _member(data: bytes, level: int = 6) -> bytes:
    """A gzip member with its whole and its inflated length in the extra field ``sl``."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<H", 8)
    return head + struct.pack("<II", len(head) + 8 + len(body) + 8, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(row: dict[str, Any]) -> bytes:
    """One WARC 1.1 record around an HTTP response; a revisit keeps the response's
    headers, whose Content-Length tells the payload's, and leaves the payload out."""
    kind, payload = row.get("record_type") or "response", row.get("payload") or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    sha = row.get("payload_sha1") or base32_sha1(payload)
    heads = [("WARC-Type", kind), ("WARC-Record-ID", row.get("record_id")), ("WARC-Date", row.get("warc_date")), ("WARC-Target-URI", row.get("target_uri")), ("WARC-Payload-Digest", f"sha1:{sha}"), ("WARC-Refers-To", row.get("refers_to")), ("WARC-Profile", _PROFILE if kind == "revisit" else None), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    coded = [k for k, v in heads if v is not None and v != _value(v)]
    heads.append((_ENCODED, ", ".join(coded) or None))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {_value(v)}\r\n" for k, v in heads if v is not None) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


@dataclass
class _Files(InputPartition):
    """Parts of files, from a record's start to the next part's or to the end (None)."""

    parts: list[tuple[str, int, int | None]]


@dataclass
class _Wrote(WriterCommitMessage):
    """Starts of parts by file."""

    marks: dict[str, list[int]]


class _Member:
    """The content of a gzip member, or of a plain file, as a stream that can be left."""

    def __init__(self, f: BinaryIO, plain: bool):
        self.f, self.plain, self.ready = f, plain, b""
        if plain:
            return
        self.start, self.length, self.extra = f.tell(), 0, b""
        head = f.read(10)
        if len(head) < 10 or head[:3] != b"\x1f\x8b\x08":
            raise ValueError("not a gzip member")
        extra = f.read(struct.unpack("<H", f.read(2))[0]) if head[3] & 4 else b""
        while extra:
            n = struct.unpack_from("<H", extra, 2)[0]
            if extra[:2] == b"sl":
                self.length = struct.unpack_from("<I", extra, 4)[0]
            extra = extra[4 + n :]
        for flag in (8, 16):
            while head[3] & flag and f.read(1) not in (b"\0", b""):
                pass
        f.read(2 if head[3] & 2 else 0)
        self.z = zlib.decompressobj(-15)

    def more(self) -> bool:
        data = self.f.read(1 << 16)
        if self.plain:
            self.ready += data
            return bool(data)
        if self.z.eof:
            self.f.seek(-len(data), 1)
            return False
        if not data:
            raise ValueError("truncated gzip member")
        self.ready += self.z.decompress(data)
        if self.z.eof:
            self.f.seek(-len(self.z.unused_data), 1)
        return True

    def until(self, mark: bytes) -> bytes:
        seen = 0
        while (at := self.ready.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.ready)
            if not self.more():
                raise ValueError("record without an end of headers")
        out, self.ready = self.ready[:at], self.ready[at + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts, got = [self.ready], len(self.ready)
        while got < n:
            self.ready = b""
            if not self.more():
                raise ValueError("truncated record")
            parts.append(self.ready)
            got += len(self.ready)
        data = b"".join(parts)
        self.ready = data[n:]
        return data[:n]

    def leave(self, n: int) -> None:
        """Past n more bytes, or past the member if it tells its length."""
        if self.plain:
            self.f.seek(n - len(self.ready), 1)
        elif self.length:
            self.f.seek(self.start + self.length)
        else:
            while n > len(self.ready):
                n -= len(self.ready)
                self.ready = b""
                if not self.more():
                    if n > 4:
                        raise ValueError("truncated record")
                    break
            self.ready = self.ready[n:]

    def rest(self) -> bool:
        """Whether another record follows in the member; if not, the member is left."""
        if self.length:
            return False
        self.ready = self.ready.lstrip(b"\r\n")
        while not self.ready:
            if not self.more():
                self.f.read(8)
                return False
            self.ready = self.ready.lstrip(b"\r\n")
        return True


def _next_record(f: BinaryIO, start: int, end: int, mark: bytes) -> int:
    """Where `mark` next occurs in a part of a file, or the part's end."""
    f.seek(start)
    held, at = b"", start
    while at < end and (data := f.read(1 << 20)):
        held += data
        if (i := held.find(mark)) >= 0:
            return min(at + i, end)
        at += len(held) - len(mark) + 1
        held = held[-len(mark) + 1 :]
    return end


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str], names: list[str]):
        self.path, self.names = options["path"], names
        self.partition_bytes, self.min_partitions = int(options.get("partition_bytes", 128 << 20)), int(options.get("min_partitions", 1))
        self.permissive = options.get("mode", "failfast").lower() == "permissive"
        self.wanted: list[tuple[str, str, Any]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in COLUMNS or name in _CODED:
                yield f
            elif isinstance(f, (EqualTo, EqualNullSafe)):
                self.wanted.append((name, "in", (f.value,)))
            elif isinstance(f, In):
                self.wanted.append((name, "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.wanted.append((name, "starts", f.value))
            elif isinstance(f, (IsNotNull, IsNull)):
                self.wanted.append((name, "null", isinstance(f, IsNull)))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.path)
        found = {f.path: f.size for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)) if f.is_file} if store.get_file_info(root).type != fs.FileType.File else {root: 0}
        lists = [p for p in found if re.search(r"/_manifest-[^/]*\.json$", p)]
        if lists:
            marks = {f"{root}/{n}": at for p in lists for n, at in json.loads(store.open_input_stream(p).read()).items()}
        else:
            marks = {p: [0] for p in found if re.search(r"\.warc(\.gz)?$", p)}
        most = min(self.partition_bytes, max(4 << 20, sum(found[n] for n in marks) // self.min_partitions))
        out, size = [[]], 0
        for n in sorted(marks):
            for start, end in zip(marks[n], [*marks[n][1:], None]):
                length = (found[n] if end is None else end) - start
                if out[-1] and size + length > most:
                    out.append([])
                    size = 0
                out[-1].append((n, start, end))
                size += length
        return [_Files(x) for x in out]

    def _keeps(self, head: dict[str, str]) -> bool:
        for name, how, value in self.wanted:
            v = head.get(COLUMNS[name][1].lower())
            if how == "null":
                if (v is None) != value:
                    return False
            elif v is None and not (how == "in" and None in value) or v is not None and not (v in value if how == "in" else v.startswith(value)):
                return False
        return True

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)

        def rows() -> Iterator[tuple[dict[str, Any], int]]:
            for path, start, end in partition.parts:
                with store.open_input_file(path) as f:
                    yield from self.records(f, path, start, end)

        yield from self.batches(rows())

    def batches(self, records: Iterator[tuple[dict[str, Any], int]]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row, n in records:
            rows.append(row)
            held += n
            if len(rows) >= 4096 or held > 16 << 20:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict[str, Any]]) -> pa.RecordBatch:
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[COLUMNS[n][0]]) for n in self.names], self.names)

    def records(self, f: BinaryIO, path: str, start: int = 0, end: int | None = None) -> Iterator[tuple[dict[str, Any], int]]:
        """Rows of the wanted records that start in a part of an open file, with the bytes
        that each holds."""
        plain, size = not path.endswith(".gz"), f.seek(0, 2) or f.tell()
        end = size if end is None else end
        while start < end:
            f.seek(start)
            try:
                yield from self._records(f, plain, end)
                return
            except (ValueError, zlib.error, struct.error, EOFError) as broken:
                if not self.permissive:
                    raise
                last, reason = self.at, f"{path}@{self.at}: {broken}"
            if self._keeps({}):
                yield {"corrupt": reason}, 0
            start = _next_record(f, last + 1, end, b"WARC/1." if plain else b"\x1f\x8b\x08")

    def _records(self, f: BinaryIO, plain: bool, end: int) -> Iterator[tuple[dict[str, Any], int]]:
        code = any(n in _CODED for n in self.names)
        self.at = f.tell()
        part = _Member(f, True) if plain else None
        more = False
        while more or f.tell() < end or plain and part.ready.strip():
            if not more:
                self.at = f.tell()
            part = part if plain or more else _Member(f, False)
            lines = part.until(b"\r\n\r\n").decode("utf-8", "replace").strip().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            for k in head.get(_ENCODED.lower(), "").lower().split(","):
                if k.strip() in head:
                    head[k.strip()] = urllib.parse.unquote(head[k.strip()])
            n = int(head.get("content-length", 0))
            row, size = None, 0
            if self._keeps(head):
                row = {c: head.get(h.lower()) for c, (_, h) in COLUMNS.items() if h and c in self.names}
                if code:
                    row |= self._payload(head, part.take(n))
                    size, n = len(row.get("payload") or b""), 0
            part.leave(n + 4)
            if plain:
                part.ready = b""
            else:
                more = part.rest()
            if row is not None:
                yield row, size

    def _payload(self, head: dict[str, str], block: bytes) -> dict[str, Any]:
        http, _, payload = block.partition(b"\r\n\r\n") if head.get("content-type", "").startswith("application/http") else (b"", b"", block)
        if head.get("warc-type") == "revisit":
            said = re.search(rb"(?im)^content-length:\s*(\d+)", http)
            return {"payload": None, "payload_bytes": int(said[1]) if said else None, "payload_sha1": (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None}
        return {"payload": payload, "payload_bytes": len(payload), "payload_sha1": base32_sha1(payload) if "payload_sha1" in self.names else None}


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.most = options["path"], int(options.get("file_bytes", 1 << 30))
        self.step = int(options.get("mark_bytes", 64 << 20))
        if overwrite:
            store, root = fs.FileSystem.from_uri(self.path)
            if store.get_file_info(root).type == fs.FileType.Directory:
                store.delete_dir_contents(root)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        marks: dict[str, list[int]] = {}
        out, size = None, 0
        for b in iterator:
            for i in range(0, b.num_rows, 256):
                for row in b.slice(i, 256).to_pylist():
                    if out is None or size > self.most:
                        if out:
                            out.close()
                        name = f"part-{uuid.uuid4().hex}.warc.gz"
                        marks[name] = at = [0]
                        out, size = store.open_output_stream(f"{root}/{name}", compression=None), 0
                    if size - at[-1] >= self.step:
                        at.append(size)
                    data = _member(record(row))
                    out.write(data)
                    size += len(data)
        if out:
            out.close()
        return _Wrote(marks)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps({n: at for m in messages if m for n, at in m.marks.items()}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        for n in (n for m in messages if m for n in m.marks):
            store.delete_file(f"{root}/{n}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def _names(self) -> list[str]:
        names = [n.strip() for n in self.options.get("columns", ",".join(COLUMNS)).split(",")]
        if wrong := set(names) - set(COLUMNS):
            raise ValueError(f"no such columns: {sorted(wrong)}")
        return names

    def schema(self) -> str:
        return ", ".join(f"{n} {COLUMNS[n][0]}" for n in self._names())

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options), [f.name for f in schema.fields])

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def through_spark(spark: SparkSession, path: str, columns: str = ",".join(COLUMNS), **options) -> DataFrame:
    """The records of archives that only Spark can open, by its binaryFile source: a file
    is one row there, read whole, and must stay under 2 GB. Filters are not pushed."""
    reader = WarcDataSource({"path": path, "columns": columns, **options})
    names, source = reader._names(), WarcReader({"path": path, **options}, reader._names())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                yield from source.batches(source.records(io.BytesIO(data.as_buffer()), name))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("path").rlike(r"\.warc(\.gz)?$"))
    return files.select("path", "content").mapInArrow(run, ", ".join(f"{n} {COLUMNS[n][0]}" for n in names))


def revisits(pages: DataFrame, id_col: str, least: int = 0) -> DataFrame:
    """Add record_type and refers_to, in place of any columns of these names: of rows with
    equal payloads (column payload) of at least ``least`` bytes, the one with the smallest
    id is a response and the others revisit it. A row with a null id can't be named but
    revisits like any other; rows that repeat the smallest id are all responses.

    Which rows revisit which is found from ids and digests alone. The payloads move once,
    by id and digest, so that a payload with very many copies is spread over its ids."""
    rows = pages.withColumn("_cw_sha", F.unhex(F.sha1("payload")))
    keys = cut(rows.select(F.col(id_col).alias("_cw_id"), "_cw_sha", F.length("payload").alias("_cw_n")), "digests")
    groups = keys.filter(F.col("_cw_n") >= least).groupBy("_cw_sha").agg(F.min("_cw_id").alias("_cw_first"), F.count("*").alias("_cw_n"))
    many = cut(groups.filter("_cw_n > 1 and _cw_first is not null").select("_cw_sha", "_cw_first"), "copies")
    found = keys.select("_cw_id", "_cw_sha").join(many, "_cw_sha").filter(~F.col("_cw_id").eqNullSafe(F.col("_cw_first"))).distinct()
    found = cut(found.select("_cw_id", F.col("_cw_sha").alias("_cw_same"), "_cw_first"), "revisits")
    again = F.col("_cw_first").isNotNull()
    out = rows.join(found.hint("merge"), F.col(id_col).eqNullSafe(F.col("_cw_id")) & (F.col("_cw_sha") == F.col("_cw_same")), "left")
    out = out.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("_cw_first")))
    return out.drop("_cw_sha", "_cw_first", "_cw_same", "_cw_id")


def write_pages(pages: DataFrame, path: str, least: int = 0, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html") -> None:
    register(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(uri_col).alias("target_uri"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    with scratch():
        _write(revisits(rows, "page_id", least), path)


def _write(named: DataFrame, path: str) -> None:
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    named.select(urn("page_id").alias("record_id"), "record_type", "target_uri", urn("refers_to").alias("refers_to"), "payload").write.format("warc").mode("append").save(path)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_pages(table(spark, sf_dir, "pages"), path)
    back = spark.read.format("warc").option("columns", "record_id,record_type,refers_to,payload_bytes,payload_sha1").option("min_partitions", spark.sparkContext.defaultParallelism).load(path)
    number = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, r'urn:page:(-?\\d+)', 1), '') as long)")
    out = cut(back.select(number("record_id").alias("page_id"), "payload_bytes", F.col("payload_sha1").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to")), "warc-read")
    back._cut_path = path
    discard(back)
    return out


#: base32 from the hexadecimal digest: five digits, 20 bits, are four characters.
OP1_SQL = """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS f FROM d)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(x, CAST((i // 4) * 5 + 1 AS INT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> f THEN f END AS refers_to
FROM g
"""
