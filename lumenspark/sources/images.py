"""Image files as rows: discovery, sniffing, headers, digests, provenance of names."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions, what they promise, signatures, container brands and name patterns.
EXTENSIONS = {"jpg": "JPEG", "jpeg": "JPEG", "jpe": "JPEG", "jfif": "JPEG", "png": "PNG", "gif": "GIF", "bmp": "BMP", "dib": "BMP", "tif": "TIFF", "tiff": "TIFF", "webp": "WEBP", "ico": "ICO", "psd": "PSD", "heic": "HEIC", "heif": "HEIF", "avif": "AVIF", "jxl": "JPEG XL", "qoi": "QOI"}
SIGNATURES = (("FFD8FF", "JPEG"), ("89504E470D0A1A0A", "PNG"), ("474946383761", "GIF"), ("474946383961", "GIF"), ("424D", "BMP"), ("49492A00", "TIFF"), ("4D4D002A", "TIFF"), ("00000100", "ICO"), ("38425053", "PSD"), ("FF0A", "JPEG XL"), ("0000000C4A584C200D0A870A", "JPEG XL"), ("716F6966", "QOI"))
BRANDS = {"heic": "HEIC", "heix": "HEIC", "heim": "HEIC", "hevc": "HEIC", "mif1": "HEIF", "msf1": "HEIF", "avif": "AVIF", "avis": "AVIF"}
NAMES = (
    (r"^IMG[-_]\d{8}[-_]WA\d{4}", "WhatsApp"), (r"^signal-\d{4}-\d{2}-\d{2}", "Signal"), (r"^(Screenshot|Screen Shot|screenshot)[ _-]", "Screenshot"), (r"^IMG_\d{4}\.(jpe?g|heic)$", "Apple/generic camera"), (r"^DSC[_N]?\d{4}", "Sony/Nikon camera"), (r"^(DJI|dji)_\d+", "DJI drone"),
    (r"^PXL_\d{8}_\d+", "Google Pixel"), (r"^(GOPR|GP\d\d)\d+", "GoPro"), (r"^(FB_IMG|received_)\d+", "Facebook/Messenger"), (r"^(image|unnamed|download)\s*\(?\d*\)?$", "Browser download"), (r"[0-9a-f]{32,}", "Content-addressed"),
)


def find_images(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path, length, modificationTime and content of image files under root, by extension, as a binary scan.

    Extensions count in any case; the scan prunes the content column where nothing reads it.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root)
    return df.where(extension(F.col("path")).isin(*EXTENSIONS))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def sniff(content: Column) -> Column:
    """The format that the first bytes say, null for unknown ones."""
    head = F.hex(F.substring(content, 1, 16))
    out = F.when(head.startswith(SIGNATURES[0][0]), SIGNATURES[0][1])
    for sig, name in SIGNATURES[1:]:
        out = out.when(head.startswith(sig), name)
    brand = F.decode(F.substring(content, 9, 4), "ISO-8859-1")
    known = F.create_map(*(F.lit(x) for kv in BRANDS.items() for x in kv))
    is_ftyp = F.substring(head, 9, 8) == "66747970"
    return out.when(is_ftyp, F.coalesce(F.try_element_at(known, brand), F.lit("ISOBMFF"))).when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "WEBP")


def mismatch(path: Column, content: Column) -> Column:
    """True where extension and first bytes tell different formats; unknown ones do not count."""
    promised = F.try_element_at(F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv)), extension(path))
    return F.coalesce(promised != sniff(content), F.lit(False))


def name_sources(filename: Column) -> Column:
    """Every provenance that a file's name suggests, in fixed order."""
    return F.array_compact(F.array(*(F.when(filename.rlike("(?i)" + rx), F.lit(n)) for rx, n in NAMES)))


def human_size(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1 << 20, F.format_string("%.1f KB", n / 1024)).when(n < 1 << 30, F.format_string("%.1f MB", n / (1 << 20))).otherwise(F.format_string("%.1f GB", n / (1 << 30)))


def slug(text: Column) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", ""), F.lit(48))


def digests(content: Column) -> Column:
    """struct(md5, sha1, sha256, blake2b): three built in, the last from an Arrow batch function."""

    @F.pandas_udf("string")
    def blake(s: pd.Series) -> pd.Series:
        return s.map(lambda b: hashlib.blake2b(b).hexdigest()[:64], na_action="ignore")

    return F.struct(F.md5(content).alias("md5"), F.sha1(content).alias("sha1"), F.sha2(content, 256).alias("sha256"), blake(content).alias("blake2b"))


# ---- headers, without decoding pixels ---------------------------------------------------------------

HEADER = "format string, width int, height int, bits int, channels int, quant array<array<int>>, exif array<struct<tag:int,value:string>>, error string"


def _jpeg(b: bytes) -> dict:
    at, out = 2, {"format": "JPEG", "quant": []}
    while at + 4 <= len(b):
        if b[at] != 0xFF:
            raise ValueError("marker expected")
        kind = b[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", b, at + 2)[0]
        body = b[at + 4 : at + 2 + size]
        if kind == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                n = 128 if wide else 64
                out["quant"].append(list(struct.unpack(">64H", body[i + 1 : i + 1 + n])) if wide else list(body[i + 1 : i + 1 + n]))
                i += 1 + n
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            out["bits"], out["height"], out["width"], out["channels"] = struct.unpack_from(">BHHB", body)
        elif kind == 0xE1 and body[:6] == b"Exif\0\0":
            out["exif"] = read_ifd(body[6:])
        if kind == 0xDA:
            break
        at += 2 + size
    if "width" not in out:
        raise ValueError("no frame header")
    return out


def read_ifd(tiff: bytes) -> list[dict]:
    """ASCII, short, long and rational entries of a TIFF block's first directory and its Exif and GPS ones."""
    end = {b"II": "<", b"MM": ">"}[tiff[:2]]
    sizes = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
    out, todo, seen = [], [struct.unpack_from(end + "I", tiff, 4)[0]], set()
    while todo:
        at = todo.pop()
        if at in seen or at + 2 > len(tiff):
            continue
        seen.add(at)
        for k in range(struct.unpack_from(end + "H", tiff, at)[0]):
            tag, kind, n = struct.unpack_from(end + "HHI", tiff, at + 2 + 12 * k)
            size = sizes.get(kind, 1) * n
            place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(end + "I", tiff, at + 10 + 12 * k)[0]
            raw = tiff[place : place + size]
            if tag in (0x8769, 0x8825):
                todo.append(struct.unpack_from(end + "I", tiff, at + 10 + 12 * k)[0])
            elif kind == 2:
                out.append({"tag": tag, "value": raw.split(b"\0")[0].decode("utf-8", "replace").strip()})
            elif kind in (3, 4) and n and len(raw) == size:
                out.append({"tag": tag, "value": " ".join(map(str, struct.unpack(f"{end}{n}{'H' if kind == 3 else 'I'}", raw)))})
            elif kind == 5 and n and len(raw) == size:
                v = struct.unpack(f"{end}{2 * n}I", raw)
                out.append({"tag": tag, "value": " ".join(f"{a}/{b}" for a, b in zip(v[::2], v[1::2], strict=True))})
    return out


def read_header(b: bytes) -> dict:
    """The fields of HEADER; error is set where the bytes are no readable header."""
    try:
        if b[:3] == b"\xff\xd8\xff":
            return _jpeg(b)
        if b[:8] == b"\x89PNG\r\n\x1a\n":
            w, h, bits, colour = struct.unpack_from(">IIBB", b, 16)
            return {"format": "PNG", "width": w, "height": h, "bits": bits, "channels": {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]}
        if b[:4] == b"GIF8":
            w, h = struct.unpack_from("<HH", b, 6)
            return {"format": "GIF", "width": w, "height": h, "bits": 8, "channels": 1}
        if b[:2] == b"BM":
            w, h, _, depth = struct.unpack_from("<iiHH", b, 18)
            return {"format": "BMP", "width": w, "height": abs(h), "bits": 8, "channels": depth // 8}
        return {"error": "empty file" if not b else "unknown format"}
    except (ValueError, KeyError, IndexError, struct.error) as e:
        return {"error": f"cannot read header: {e}"}


def headers(content: Column) -> Column:
    """A struct of HEADER per row of bytes; failures become its error, never an exception."""
    names = [f.split()[0] for f in ("format", "width", "height", "bits", "channels", "quant", "exif", "error")]

    @F.pandas_udf(HEADER)
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([[read_header(x or b"").get(n) for n in names] for x in s], columns=names).astype({n: "Int32" for n in ("width", "height", "bits", "channels")})

    return udf(content)


# ---- coordinates -------------------------------------------------------------------------------------


def rational(text: Column) -> Column:
    """A number from '3/2' or '1.5'; null for a zero denominator or anything else."""
    a, b = F.substring_index(text, "/", 1).try_cast("double"), F.substring_index(text, "/", -1).try_cast("double")
    return F.when(F.contains(text, F.lit("/")), a / F.nullif(b, F.lit(0.0))).otherwise(text.try_cast("double"))


def dms_to_decimal(dms: Column, ref: Column) -> Column:
    """Degrees from 'd/1 m/1 s/100' and a hemisphere; south and west are negative, a bare sign counts without one."""
    parts = F.transform(F.split(F.trim(dms), r"\s+"), rational)
    v = F.abs(F.get(parts, 0)) + F.coalesce(F.get(parts, 1), F.lit(0.0)) / 60 + F.coalesce(F.get(parts, 2), F.lit(0.0)) / 3600
    r = F.upper(F.coalesce(ref, F.lit("")))
    return F.when(r.isin("S", "W"), -v).when((r == "") & (F.get(parts, 0) < 0), -v).otherwise(v)


def dms_text(value: Column, positive: str, negative: str) -> Column:
    a = F.abs(value)
    d, m = F.floor(a), F.floor((a - F.floor(a)) * 60)
    return F.format_string("%d°%02d'%05.2f\"%s", d, m, (a - d) * 3600 - m * 60, F.when(value >= 0, positive).otherwise(negative))


def bearing(degrees: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in ("N", "NE", "E", "SE", "S", "SW", "W", "NW"))), (F.pmod(degrees + 22.5, F.lit(360)) / 45).cast("int") + 1)


def exif_time(text: Column) -> Column:
    """A camera's local time in any of its three formats, null otherwise."""
    return F.coalesce(*(F.try_to_timestamp(F.left(text, F.lit(19)), F.lit(f)) for f in ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")))


def implied_offset(local: Column, utc: Column) -> Column:
    """struct(hours, verdict): local time less GPS time; over 14.5 hours is no time zone."""
    hours = (F.unix_timestamp(local) - F.unix_timestamp(utc)) / 3600.0
    return F.struct(hours.alias("hours"), F.when(F.abs(hours) > 14.5, "inconsistent").when(hours.isNotNull(), "plausible").alias("verdict"))


# ---- queries -----------------------------------------------------------------------------------------

_FILES = (("a/IMG-20230415-WA0007.jpg", b"\x89PNG\r\n\x1a\n" + bytes(20)), ("b/Screenshot 1.png", b"\x89PNG\r\n\x1a\n" + bytes(20)), ("c/x.heic", b"\0\0\0\x18ftypheic"), ("d/x.webp", b"RIFF\0\0\0\0WEBP"), ("e/note.png", b"plain text"), ("f/empty.gif", b""), ("g/y.JPG", b"\xff\xd8\xff\xe0"))


def sniff_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame([(p, bytearray(b)) for p, b in _FILES], "path string, content binary")
    return d.select("path", sniff(F.col("content")).alias("format"), mismatch(F.col("path"), F.col("content")).alias("mismatch"), F.array_join(name_sources(F.substring_index("path", "/", -1)), ",").alias("sources"))


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", (F.col("c_acctbal") / 100).alias("v"))
    return c.select("c_custkey", dms_text(F.col("v"), "N", "S").alias("dms"), bearing(F.pmod(F.col("v") * 7, F.lit(360))).alias("bearing"))


_B = "CASE CAST(floor((((v * 7) % 360 + 360) % 360 + 22.5) % 360 / 45) AS INT) " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(("N", "NE", "E", "SE", "S", "SW", "W", "NW"))) + " END"

QUERIES = {"sniff_formats": sniff_formats, "coordinates": coordinates}
SQL = {
    "sniff_formats": "SELECT * FROM (VALUES ('a/IMG-20230415-WA0007.jpg', 'PNG', true, 'WhatsApp'), ('b/Screenshot 1.png', 'PNG', false, 'Screenshot'), ('c/x.heic', 'HEIC', false, ''), ('d/x.webp', 'WEBP', false, ''), ('e/note.png', NULL, false, ''), ('f/empty.gif', NULL, false, ''), ('g/y.JPG', 'JPEG', false, '')) t(path, format, mismatch, sources)",
    "coordinates": f"WITH c AS (SELECT c_custkey, c_acctbal / 100 AS v FROM customer) SELECT c_custkey, format('{{}}°{{:02d}}''{{:05.2f}}\"{{}}', CAST(floor(abs(v)) AS INT), CAST(floor((abs(v) - floor(abs(v))) * 60) AS INT), (abs(v) - floor(abs(v))) * 3600 - floor((abs(v) - floor(abs(v))) * 60) * 60, CASE WHEN v >= 0 THEN 'N' ELSE 'S' END) AS dms, {_B} AS bearing FROM c",
}
