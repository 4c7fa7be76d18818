"""ISO base media files: write payloads as 8-bit sample tracks, walk boxes, read sample tables.

The reader never decodes a payload: it walks nested boxes, expands the sample tables (stsz, stsc,
stco/co64, stts, stss) and reports codec, duration and the byte ranges of key frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, read

#: Fixed values of the format: boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}

#: Bytes of one sample, samples of one chunk, and samples from one key frame to the next.
SAMPLE_BYTES, CHUNK_SAMPLES, KEY_EVERY = 64, 256, 64
TIMESCALE, TICKS = 8000, 64

FIELDS = "codec string, handler string, timescale long, duration long, seconds double, n_samples long, n_keyframes long, payload_bytes long, keyframes array<struct<start:long,length:long>>, error string"


class MediaError(ValueError):
    """The bytes break the box structure or a sample table."""


# ---- writing ---------------------------------------------------------------------------------


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad_payload(raw: bytes) -> bytes:
    """raw, then zero bytes up to a positive multiple of the sample size."""
    return raw + bytes(max(SAMPLE_BYTES, -(-len(raw) // SAMPLE_BYTES) * SAMPLE_BYTES) - len(raw))


def write_media(payload: bytes) -> bytes:
    """An ISO media file with one track of unsigned 8-bit samples that holds payload unchanged.

    payload is a positive multiple of SAMPLE_BYTES. Its sample tables use 64-bit offsets.
    """
    if not payload or len(payload) % SAMPLE_BYTES:
        raise MediaError("a payload is a positive multiple of the sample size")
    n = len(payload) // SAMPLE_BYTES
    chunks = -(-n // CHUNK_SAMPLES)
    duration = n * TICKS
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    mdat_head = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16)
    first = len(ftyp) + len(mdat_head)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
    last = n - (chunks - 1) * CHUNK_SAMPLES
    runs = [(1, CHUNK_SAMPLES, 1)] if last == CHUNK_SAMPLES else [(1, CHUNK_SAMPLES, 1), (chunks, last, 1)] if chunks > 1 else [(1, last, 1)]
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    offsets = (first + np.arange(chunks, dtype=np.int64) * CHUNK_SAMPLES * SAMPLE_BYTES).astype(">u8")
    stbl = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, n, TICKS)),
        full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        full(b"stsz", struct.pack(">II", SAMPLE_BYTES, n)),
        full(b"co64", struct.pack(">I", chunks), offsets.tobytes()),
    )
    minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, duration, 0x55C4, 0), version=1), full(b"hdlr", bytes(4), b"soun", bytes(12), b"bytes\0"), minf)
    tkhd = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, duration), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8), version=1, flags=7)
    mvhd = full(b"mvhd", struct.pack(">QQIQ", 0, 0, TIMESCALE, duration), struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2), version=1)
    return b"".join((ftyp, mdat_head, payload, box(b"moov", mvhd, box(b"trak", tkhd, mdia))))


# ---- reading ---------------------------------------------------------------------------------


def walk(data: memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, body start, body end) of every box, depth first; 64-bit and open-ended sizes too."""
    end = len(data) if end is None else end
    stack = [(start, end, path)]
    while stack:
        at, stop, above = stack.pop()
        if at >= stop:
            continue
        if stop - at < 8:
            raise MediaError(f"{stop - at} bytes left over at {at}")
        length, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if length == 1:
            if stop - at < 16:
                raise MediaError(f"box cut short at {at}")
            length, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif length == 0:
            length = stop - at
        if length < head or at + length > stop:
            raise MediaError(f"box {kind!r} at {at} has a bad size")
        here = (*above, kind)
        yield here, at + head, at + length
        stack.append((at + length, stop, above))
        if kind in CONTAINERS:
            stack.append((at + head, at + length, here))


def _table(data: memoryview, body: tuple[int, int], dtype: str, columns: int, skip: int = 4) -> np.ndarray:
    count = struct.unpack_from(">I", data, body[0] + skip)[0]
    size = np.dtype(dtype).itemsize * columns * count
    if body[0] + skip + 4 + size > body[1]:
        raise MediaError("a sample table is cut short")
    return np.frombuffer(data, dtype, count * columns, body[0] + skip + 4).astype(np.int64).reshape(count, columns)


def read_track(data: memoryview) -> dict:
    """Sample tables of the first track: codec, timescale, duration, sample offsets, sizes, key frames."""
    found: dict[bytes, tuple[int, int]] = {}
    tracks = 0
    for path, start, end in walk(data):
        if path[-1] == b"trak":
            tracks += 1
        if tracks <= 1 and (path[:2] == (b"moov", b"trak") or path[-1] in (b"ftyp", b"mdat")):
            found.setdefault(path[-1], (start, end))
    missing = [k.decode() for k in (b"mdhd", b"hdlr", b"stsd", b"stts", b"stsc") if k not in found]
    if missing:
        raise MediaError("no " + ", ".join(missing))
    at = found[b"mdhd"][0]
    timescale, duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
    codec = bytes(data[found[b"stsd"][0] + 12 : found[b"stsd"][0] + 16]).decode("latin-1")
    handler = bytes(data[found[b"hdlr"][0] + 8 : found[b"hdlr"][0] + 12]).decode("latin-1")
    if b"stsz" not in found:
        raise MediaError("no stsz")
    fixed, count = struct.unpack_from(">II", data, found[b"stsz"][0] + 4)
    if fixed * count > len(data):
        raise MediaError("more samples than the file can hold")
    sizes = np.full(count, fixed, np.int64) if fixed else _table(data, found[b"stsz"], ">u4", 1, 8)[:, 0]
    chunks = (_table(data, found[b"co64"], ">u8", 1) if b"co64" in found else _table(data, found[b"stco"], ">u4", 1) if b"stco" in found else np.zeros((0, 1), np.int64))[:, 0]
    runs = _table(data, found[b"stsc"], ">u4", 3)
    upto = np.append(runs[1:, 0], len(chunks) + 1) if len(runs) else runs[:, 0]
    per_chunk = np.repeat(runs[:, 1], np.maximum(upto - runs[:, 0], 0)) if len(runs) else np.zeros(0, np.int64)
    if len(per_chunk) != len(chunks) or per_chunk.sum() != count:
        raise MediaError("stsc, stsz and the chunk offsets disagree")
    chunk_of = np.repeat(np.arange(len(chunks)), per_chunk)
    before = np.cumsum(sizes) - sizes
    starts = np.cumsum(per_chunk) - per_chunk
    offsets = chunks[chunk_of] + before - before[starts[chunk_of]] if count else np.zeros(0, np.int64)
    if count and ((offsets < 0) | (offsets + sizes > len(data))).any():
        raise MediaError("a sample lies outside the file")
    ticks = int((lambda t: (t[:, 0] * t[:, 1]).sum())(_table(data, found[b"stts"], ">u4", 2)))
    keys = _table(data, found[b"stss"], ">u4", 1)[:, 0] - 1 if b"stss" in found else np.arange(count)
    if len(keys) and (keys.min() < 0 or keys.max() >= count):
        raise MediaError("a key frame is no sample")
    return {"codec": codec, "handler": handler, "timescale": int(timescale), "duration": int(duration) or ticks, "offsets": offsets, "sizes": sizes, "keys": keys}


def stored_payload(data: memoryview, track: dict) -> bytes:
    """The samples' bytes in order; contiguous runs are sliced at once."""
    offsets, sizes = track["offsets"], track["sizes"]
    if not len(offsets):
        return b""
    cuts = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
    firsts, lasts = np.append(0, cuts), np.append(cuts, len(offsets)) - 1
    return b"".join(data[offsets[a] : offsets[b] + sizes[b]] for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True))


def describe(data: bytes) -> dict:
    """The columns of FIELDS; error is set, and the rest null, where the bytes cannot be read."""
    try:
        track = read_track(memoryview(data))
    except (MediaError, struct.error, IndexError) as e:  # IndexError: a box without a body at the end
        return dict.fromkeys(x.split()[0] for x in FIELDS.split(", ")) | {"error": str(e)}
    keys = track["keys"]
    ranges = [{"start": a, "length": b} for a, b in zip(track["offsets"][keys].tolist(), track["sizes"][keys].tolist(), strict=True)]
    rate = track["timescale"]
    return {k: track[k] for k in ("codec", "handler", "timescale", "duration")} | {"seconds": track["duration"] / rate if rate else None, "n_samples": len(track["sizes"]), "n_keyframes": len(keys), "payload_bytes": int(track["sizes"].sum()), "keyframes": ranges, "error": None}


def media_columns(df: DataFrame, content: str = "content") -> DataFrame:
    """df plus a struct column ``media`` (see FIELDS) for the container bytes in ``content``.

    Null and empty bytes, and bytes that are no ISO media, give a row with an error. A column of
    df already called media is replaced.
    """

    @F.pandas_udf(FIELDS)
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([describe(x or b"") for x in s], columns=[x.split()[0] for x in FIELDS.split(", ")])

    return df.withColumn("media", udf(F.col(content)))


def as_media(df: DataFrame, text: str = "text") -> DataFrame:
    """df plus ``content``: the text's UTF-8 bytes stored as an ISO media file (null: empty text)."""

    @F.pandas_udf("binary")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([write_media(pad_payload((x or "").encode())) for x in s], dtype=object)

    return df.withColumn("content", udf(F.col(text)))


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration long, n_samples long, n_keyframes long, first_keyframe long, last_keyframe long"


def stored_features(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text as media, read it back from the stored bytes, and describe what was read.

    One row per input row, in one pass without a shuffle; a file lives only while its row is worked
    on. The feature is a function of the text alone.
    """

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, x in zip(pdf["id"], pdf["text"], strict=True):
                raw = (x or "").encode()
                media = write_media(pad_payload(raw))
                view = memoryview(media)
                track = read_track(view)
                back = stored_payload(view, track)
                keys = track["offsets"][track["keys"]]
                ranges = zlib.crc32(np.stack([keys, track["sizes"][track["keys"]]]).astype("<i8").tobytes())
                hist = np.bincount(np.frombuffer(back, np.uint8) >> 5, minlength=8)
                feature = f"{track['codec'].strip()};{track['duration']}/{track['timescale']};{len(track['sizes'])};{len(keys)};{ranges:08x};" + ",".join(map(str, hist.tolist()))
                rows.append((doc, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, track["codec"], track["duration"], len(track["sizes"]), len(keys), int(keys[0]), int(keys[-1])))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in STORED.split(", ")]).astype({"doc_id": "Int64"})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInPandas(run, STORED)


def op2_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_features(read(spark, sf_dir, "documents"))


QUERIES = {"op2_iso_media": op2_iso_media}
SQL: dict[str, str] = {}
