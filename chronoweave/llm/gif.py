"""GIF media columns.

read_gif() decodes LZW code streams of any minimum code size, with early, late or
deferred clear codes, applies global and local palettes, interlacing, transparency and
the disposal rules, and gives the composed canvas of every timed frame. frames() turns
a binary column into one row per frame with delay, size, pixels and a colour histogram.
write_gif() stores frames of palette indices losslessly.

Both directions handle one image at a time, in memory proportional to it. The codes
after a clear code have widths that depend on their number only, so whole runs of codes
are packed and unpacked as arrays; the dictionary walk is one step per code.

A null media column gives no frames; so does data that holds no image. read_gif() raises
ValueError on truncated or foreign data, and on a canvas of more than `max_pixels`, which
a header can claim at no cost. frames() turns that into a row with the error and without
pixels, after the frames that could be read, so that one bad image neither fails the job
nor goes unseen; mode "failfast" raises.

As text, null counts as empty; an empty text is one row of spaces. Rows that repeat are
coded each for itself, columns other than the two named are never read, and an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

GRAY = bytes(c for c in range(256) for _ in range(3))


class Frame(NamedTuple):
    left: int
    top: int
    indices: np.ndarray
    delay: int  # hundredths of a second
    disposal: int
    canvas: np.ndarray  # height, width, RGB and opacity


@lru_cache(maxsize=16)
def _widths(min_size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the first n codes after a clear code, and the bit where each begins."""
    size = (1 << min_size) + 2 + np.maximum(np.arange(n) - 1, 0)
    w = np.clip(np.floor(np.log2(size)).astype(np.int64) + 1, min_size + 1, 12)
    return w, np.concatenate(([0], np.cumsum(w)))


def lzw_encode(data: bytes, min_size: int = 8) -> bytes:
    clear, end = 1 << min_size, (1 << min_size) + 1
    most = 4096 - end - 2  # codes after a clear code until the table is full
    runs: list[list[int]] = []
    at, n = 0, len(data)
    it = iter(data)
    p = next(it, None)
    while p is not None:
        table: dict[int, int] = {}
        get, codes, new = table.get, [clear], end + 1
        add, stop = codes.append, end + 1 + most
        for b in it:
            k = p << 8 | b
            c = get(k)
            if c is None:
                add(p)
                table[k] = new
                new += 1
                p = b
                if new == stop:
                    break
            else:
                p = c
        else:
            add(p)
            p = None
        runs.append(codes)
    # The first clear code is as wide as a first code; each later one ends the run before.
    codes = np.array([c for r in runs for c in r] or [clear], np.int64)
    codes = np.append(codes, end)
    w = [np.array([min_size + 1])]
    for i, r in enumerate(runs):
        w.append(_widths(min_size, len(r))[0])  # its codes, and the clear or end code after them
    width = np.concatenate(w) if runs else np.array([min_size + 1] * 2)
    start = np.cumsum(width) - width
    k, v, n = start >> 3, codes << (start & 7), (int(start[-1] + width[-1]) + 7) // 8
    # No two codes share a bit, so adding is the same as setting.
    parts = (np.bincount(k + i, v >> 8 * i & 255, n + 3) for i in range(3))
    return sum(parts)[:n].astype(np.uint8).tobytes()


def _expand(codes: np.ndarray, clear: int) -> bytes:
    """The samples of codes that follow one clear code. The entry that code j adds is
    what it wrote and one sample more, so every code repeats earlier output; lengths and
    then samples are found by jumping along these references, halving what is left."""
    n = len(codes)
    of = np.where(codes < clear, -1, codes - clear - 2)
    if (of >= np.arange(n)).any():
        raise ValueError("LZW code beyond the table")
    length, at = np.ones(n, np.int64) + (of >= 0), of.copy()
    length[of < 0] = 1
    while (m := np.flatnonzero(at >= 0)).size:
        length[m] += length[at[m]] - 1
        at[m] = at[at[m]]
    start = np.cumsum(length) - length
    owner = np.repeat(np.arange(n), length)
    ref = np.arange(len(owner))
    m = of[owner] >= 0
    ref[m] += start[of[owner[m]]] - start[owner[m]]
    while True:
        far = ref[ref]
        if (far == ref).all():
            return codes[owner[ref]].astype(np.uint8).tobytes()
        ref = far


def lzw_decode(data: bytes, min_size: int) -> bytes:
    clear, end = 1 << min_size, (1 << min_size) + 1
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    bits, at, out, j, run = len(data) * 8, 0, [], 0, []
    while True:
        # Codes up to the widest, then windows of constant width.
        if j:
            w, start = np.full(4096, 12), np.arange(4097) * 12
        else:
            w, start = _widths(min_size, 4200)
        n = int(np.searchsorted(at + start[1:], bits, "right"))
        pos = at + start[:n]
        k = pos >> 3
        codes = (raw[k] | raw[k + 1] << 8 | raw[k + 2] << 16) >> (pos & 7) & ((1 << w[:n]) - 1)
        marks = np.flatnonzero((codes == clear) | (codes == end))
        used = int(marks[0]) if len(marks) else n
        run.append(codes[:used])
        if len(marks) or not n:
            out.append(_expand(np.concatenate(run), clear))
            if not n or codes[used] == end:
                return b"".join(out)
            at, j, run = at + int(start[used + 1]), 0, []
        else:
            at, j = at + int(start[n]), j + n


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(b)]) + b for b in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def write_gif(frames: list[np.ndarray], palette: bytes = GRAY, delays: list[int] | None = None, disposal: int = 1, transparent: int | None = None) -> bytes:
    """Frames of palette indices (uint8, two dimensions), all at the upper left."""
    height, width = max(f.shape[0] for f in frames), max(f.shape[1] for f in frames)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette]
    for i, f in enumerate(frames):
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (transparent is not None), delays[i] if delays else 10, transparent or 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, f.shape[1], f.shape[0], 0) + b"\x08" + _blocks(lzw_encode(f.tobytes())))
    return b"".join([*out, b"\x3b"])


def read_gif(data: bytes, max_pixels: int = 1 << 27) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    try:
        yield from _read(data, max_pixels)
    except (IndexError, struct.error):
        raise ValueError("truncated GIF") from None


def _read(data: bytes, max_pixels: int) -> Iterator[Frame]:
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13
    if width * height > max_pixels:
        raise ValueError(f"a canvas of {width} x {height}")

    def colours(flag: int) -> np.ndarray:
        nonlocal at
        n = 3 * (2 << (flag & 7))
        t = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3)
        at += n
        return t

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1
        at += 1
        return b"".join(parts)

    common = colours(flags) if flags & 128 else np.zeros((0, 3), np.uint8)
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, clear = 0, 0, None
    while (kind := data[at]) != 0x3B:
        at += 1
        if kind == 0x21:
            label = data[at]
            at += 1
            body = blocks()
            if label == 0xF9:
                f, delay, t = struct.unpack_from("<BHB", body)
                disposal, clear = f >> 2 & 7, t if f & 1 else None
        elif kind == 0x2C:
            x, y, w, h, f = struct.unpack_from("<HHHHB", data, at)
            at += 9
            palette = colours(f) if f & 128 else common
            min_size = data[at]
            at += 1
            idx = lzw_decode(blocks(), min_size)[: w * h]
            if len(idx) < w * h:
                raise ValueError("image data end early")
            idx = np.frombuffer(idx, np.uint8).reshape(h, w)
            if f & 64:  # interlaced: rows come in four passes
                order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
                rows = np.empty_like(idx)
                rows[order] = idx
                idx = rows
            before = canvas.copy() if disposal == 3 else None
            full = np.zeros((256, 4), np.uint8)
            full[: len(palette), :3] = palette
            full[:, 3] = 255
            spot = canvas[y : y + h, x : x + w]
            seen = idx[: spot.shape[0], : spot.shape[1]]
            if clear is None:
                spot[:] = full[seen]
            else:
                m = seen != clear
                spot[m] = full[seen[m]]
            yield Frame(x, y, idx, delay, disposal, canvas.copy())
            if disposal == 2:
                spot[:] = 0
            elif disposal == 3:
                canvas = before
            delay, disposal, clear = 0, 0, None
        else:
            raise ValueError("unknown block")


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Opaque pixels by two bits of red, green and blue: 64 counts."""
    p = canvas[canvas[..., 3] > 0] >> 6
    return np.bincount(p[:, 0].astype(np.int64) << 4 | p[:, 1] << 2 | p[:, 2], minlength=64)


def frames(media: DataFrame, id_col: str, media_col: str, mode: str = "permissive", max_pixels: int = 1 << 27) -> DataFrame:
    """(id, frame, delay_ms, width, height, pixels as RGBA, histogram, error) of every frame."""
    kinds = {"id": pa.int64(), "frame": pa.int32(), "delay_ms": pa.int32(), "width": pa.int32(), "height": pa.int32(), "pixels": pa.binary(), "histogram": pa.list_(pa.int64()), "error": pa.string()}

    def row(*values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds.values())], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, data in zip(b.column(0).to_pylist(), b.column(1)):
                i = -1
                try:
                    for i, f in enumerate(read_gif(data.as_py(), max_pixels) if data.is_valid else ()):
                        h, w, _ = f.canvas.shape
                        yield row(key, i, f.delay * 10, w, h, f.canvas.tobytes(), histogram(f.canvas), None)
                except ValueError as bad:
                    if mode == "failfast":
                        raise
                    yield row(key, i + 1, None, None, None, None, None, str(bad))

    return media.select(F.col(id_col).cast("long"), F.col(media_col)).mapInArrow(run, "id long, frame int, delay_ms int, width int, height int, pixels binary, histogram array<long>, error string")


WIDTH, ROWS = 192, 1024


def text_to_gif(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and a GIF of it: UTF-8 padded with spaces to rows of 192
    samples, in frames of up to 1024 rows."""
    raw = (text or "").encode()
    full = raw + b" " * (-len(raw) % WIDTH or (0 if raw else WIDTH))
    rows = np.frombuffer(full, np.uint8).reshape(-1, WIDTH)
    return len(raw), write_gif([rows[i : i + ROWS] for i in range(0, len(rows), ROWS)])


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                c = b.slice(i, 64)
                made = [text_to_gif(t) for t in c.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([m for _, m in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _features(media: bytes) -> tuple[bytes, str]:
    parts, total, length, n = [], np.zeros(64, np.int64), 0, 0
    for f in read_gif(media):
        h, w = f.indices.shape
        spot = f.canvas[f.top : f.top + h, f.left : f.left + w]
        parts.append(spot[..., 0].tobytes())  # the palette is grey: any colour is the sample
        total += histogram(spot)
        length, n = length + f.delay * 10, n + 1
    bins = np.flatnonzero(total)
    return b"".join(parts), f"frames={n};ms={length};colours=" + ",".join(f"{k}:{total[k]}" for k in bins)


def op6_media_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in b.column(2).to_pylist():
                back, feature = _features(m)
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature))
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return encode_texts(table(spark, sf_dir, "documents")).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
