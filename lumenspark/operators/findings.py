"""Findings of analyzers as arrays of structs: one projection per analyzer, nothing leaves the row.

A finding is (category, label, value, severity, confidence, detail). Every function takes the columns
it needs and returns array<struct>, empty where nothing is to be said.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .detection import VEHICLES

# Label groups.
SCREENS = ("tv", "laptop", "cell phone")
PETS = ("cat", "dog", "bird")
OTHER_ANIMALS = ("horse", "sheep", "cow", "elephant", "bear", "zebra", "giraffe")


def finding(category: str, label, value=None, severity="info", confidence=1.0, detail=None) -> Column:
    c = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    return F.struct(F.lit(category).alias("category"), c(label, "string").alias("label"), c(value, "string").alias("value"), c(severity, "string").alias("severity"), c(confidence, "double").alias("confidence"), c(detail, "string").alias("detail"))


def some(*tested: tuple[Column, Column]) -> Column:
    """The findings whose tests hold."""
    return F.array_compact(F.array(*(F.when(test, f) for test, f in tested)))


def _percent(x: Column) -> Column:
    return F.concat(F.format_number(x * 100, 1), F.lit("%"))


def object_findings(detections: DataFrame) -> DataFrame:
    """(image_id, findings) from detections (image_id, det_no, label, confidence, area_fraction)."""
    d = F.struct("det_no", "label", "confidence", "area_fraction")
    g = detections.groupBy("image_id").agg(F.array_sort(F.collect_list(d)).alias("d"))
    in_ = lambda names: F.filter("d", lambda x: x["label"].isin(*names))
    names = lambda group: F.array_join(F.array_sort(F.array_distinct(F.transform(in_(group), lambda x: x["label"]))), ", ")
    any_ = lambda group: F.size(in_(group)) > 0
    people = F.size(in_(("person",)))
    closest = F.array_max(F.transform(in_(("person",)), lambda x: F.struct(x["area_fraction"], x["confidence"])))["confidence"]
    mean = F.aggregate("d", F.lit(0.0), lambda a, x: a + x["confidence"]) / F.size("d")
    labels = F.array_distinct(F.transform("d", lambda x: x["label"]))
    count = lambda name: F.size(F.filter("d", lambda x: x["label"] == name))
    parts = F.array_sort(F.transform(labels, lambda n: F.struct((-count(n)).alias("c"), n.alias("n"))))
    summary = F.array_join(F.transform(parts, lambda p: F.when(p["c"] < -1, F.concat(p["n"], F.lit(" x"), -p["c"])).otherwise(p["n"])), ", ")
    return g.select(
        "image_id",
        some(
            (F.lit(True), finding("objects", F.concat(F.size("d"), F.lit(" object(s) detected")), F.left(summary, F.lit(200)), "info", F.round(mean, 3))),
            (people > 0, finding("people", F.concat(people, F.when(people == 1, " person detected").otherwise(" people detected")), people, "medium", closest, "Identifiable individuals may be present; consider redaction before sharing this image")),
            (any_(SCREENS), finding("objects", "Screen visible in frame", names(SCREENS), "medium", 0.6, "Displays may show readable content — run OCR on the region")),
            (any_(PETS), finding("objects", "Pet present", names(PETS), "low", F.get(in_(PETS), 0)["confidence"], "Distinctive animals are surprisingly identifying in linked imagery")),
            (any_(OTHER_ANIMALS), finding("objects", "Animals present", names(OTHER_ANIMALS))),
            (any_(VEHICLES), finding("objects", "Vehicles present", names(VEHICLES))),
        ).alias("findings"),
    )


def face_findings(count: Column, mean_confidence: Column, width: Column, height: Column, area: Column, confidence: Column) -> Column:
    """width, height, area and confidence are the largest face's."""
    n = F.coalesce(count, F.lit(0))
    return some(
        (n == 0, finding("people", "No faces detected", 0)),
        (n > 0, finding("people", F.concat(n, F.lit(" face(s) detected")), n, "medium", F.round(mean_confidence, 3), "Faces located but not identified. Redact before sharing if the individuals are not the subject of the investigation")),
        ((n > 0) & (area > 0.08), finding("people", "Prominent face in frame", F.concat(width, F.lit("x"), height, F.lit(" px ("), _percent(area), F.lit(" of frame)")), "medium", confidence, "Large enough to support identification; treat as personal data")),
        (n >= 5, finding("people", "Group of people", n, "medium", 0.7, "Multiple identifiable individuals — a gathering, event or public space")),
    )


def plate_findings(plates: DataFrame, ocr_ran: bool = True) -> DataFrame:
    """(image_id, findings) from plate candidates (image_id, det_no, region, plate_text): read ones are high, the rest one medium."""
    g = plates.where(F.col("region").isNotNull()).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("det_no", "plate_text"))).alias("p"))
    read = F.filter("p", lambda x: x["plate_text"].isNotNull())
    unread = F.size(F.filter("p", lambda x: x["plate_text"].isNull()))
    hits = F.transform(read, lambda x: finding("vehicles", "Text in plate region", F.left(x["plate_text"], F.lit(40)), "high", 0.55, "Text found where a number plate would sit; confirm visually before treating it as a registration"))
    more = "Plate may be readable at full resolution — re-run with OCR on a crop" if ocr_ran else "Run the deep profile to attempt reading these regions"
    return g.select("image_id", F.concat(hits, some((unread > 0, finding("vehicles", F.concat(unread, F.lit(" candidate plate region(s), no text read")), unread, "medium", 0.4, more)))).alias("findings"))


def quality_findings(content: Column, clip_high: Column, clip_low: Column, p1: Column, p99: Column, noise: Column, entropy: Column, megapixels: Column, sharpness: Column) -> Column:
    """Exposure and noise count for photographs only; a clean floor needs detail to be odd."""
    photo = content == "photograph"
    return some(
        (megapixels < 0.15, finding("quality", "Thumbnail-sized image", F.round(megapixels, 3), "low", 1.0, "Too small for reliable detection or OCR downstream")),
        (photo & (clip_high > 0.05), finding("quality", "Blown highlights", F.concat(_percent(clip_high), F.lit(" of pixels")), "low", 1.0, "Detail unrecoverable in those regions")),
        (photo & (clip_low > 0.10), finding("quality", "Crushed shadows", F.concat(_percent(clip_low), F.lit(" of pixels")), "low")),
        (photo & (p99 - p1 < 40), finding("quality", "Very low dynamic range", F.round(p99 - p1, 1), "low", 1.0, "Flat, hazy or heavily faded — may be a photo of a screen")),
        (photo & (noise > 8), finding("quality", "High sensor noise", F.round(noise, 1), "low", 1.0, "Low light, high ISO, or heavy upscaling")),
        (content == "blank", finding("quality", "Very low information content", F.round(entropy, 2), "medium", 1.0, "Nearly uniform and detail-free — blank, solid colour, or a failed capture")),
        ((noise < 0.4) & (megapixels > 1.0) & (sharpness > 40), finding("manipulation", "Implausibly clean noise floor", F.round(noise, 3), "low", 0.5, "Real sensor output carries noise; this suggests rendering, heavy denoising, or synthetic generation")),
    )


def location_findings(lat: Column, lon: Column, altitude: Column, direction: Column, dop: Column) -> Column:
    from ..sources.images import bearing, dms_text

    known = lat.isNotNull() & lon.isNotNull()
    valid = known & lat.between(-90, 90) & lon.between(-180, 180)
    null_island = (F.abs(lat) < 0.001) & (F.abs(lon) < 0.001)
    pair = F.format_string("%.6f, %.6f", lat, lon)
    return some(
        (known & ~valid, finding("location", "Coordinates out of valid range", pair, "high")),
        (valid & null_island, finding("location", "Null Island coordinates (0, 0)", pair, "high", 1.0, "Almost always a default, placeholder or corrupted value")),
        (valid & ~null_island, finding("location", "GPS coordinates", pair, "high", 1.0, F.concat_ws(" ", dms_text(lat, "N", "S"), dms_text(lon, "E", "W")))),
        (valid & altitude.isNotNull(), finding("location", "Altitude", F.format_string("%.1f m", altitude))),
        (valid & direction.isNotNull(), finding("location", "Camera bearing", F.concat(F.bround(direction).cast("int"), F.lit("° ("), bearing(direction), F.lit(")")), "info", 1.0, "Direction the lens was pointing — narrows down the exact vantage point")),
        (valid & (dop > 5), finding("location", "Poor GPS fix quality", F.format_string("DOP %.1f", dop), "low", 1.0, "Dilution of precision above 5 — coordinates may be tens of metres off")),
    )


def time_findings(offset_hours: Column, zone: Column, zone_offset: Column) -> Column:
    """Local time less GPS time against the place's zone; no zone, no verdict short of impossible."""
    wild = F.abs(offset_hours) > 14.5
    told = ~wild & zone_offset.isNotNull()
    drift = F.abs(offset_hours - zone_offset) > 1.0
    return some(
        (wild, finding("timeline", "Implied UTC offset is impossible", F.format_string("%+.1f h", offset_hours), "high", 0.9, "EXIF local time and GPS UTC time disagree by more than any real timezone — one of the two has been altered")),
        (told & drift, finding("timeline", "Timestamp inconsistent with GPS timezone", F.format_string("implied %+.1f h, %s is %+.1f h", offset_hours, zone, zone_offset), "medium", 0.75, "Camera clock set to a different timezone, or the location or timestamp was edited")),
        (told & ~drift, finding("timeline", "Timestamp consistent with GPS timezone", zone, "info", 0.8)),
    )


def identity_findings(verdict: Column, entity: Column, similarity: Column, runner_up: Column, margin: Column) -> Column:
    return some(
        (verdict == "match", finding("identity", F.concat(F.lit("Identity match: "), entity), F.format_string("similarity %.3f, margin %.3f", similarity, margin), "high", F.round(F.least(F.lit(0.95), similarity), 3), "A biometric match is investigative lead material, not proof of identity — corroborate before relying on it")),
        (verdict == "inconclusive", finding("identity", "Inconclusive identity match", F.format_string("%s (%.3f) vs %s (%.3f)", entity, similarity, runner_up, similarity - margin), "medium", 0.4, "Above the similarity threshold but too close to the next candidate to distinguish them")),
    )


def tamper_rollup(raised: Column) -> Column:
    """Three indicators that agree make one high finding; there is no score of forgery."""
    names = F.array_sort(F.array_distinct(raised))
    return some((F.size(names) >= 3, finding("manipulation", "Multiple independent indicators raised", F.array_join(names, ", "), "high", 0.6, "Several indicators that measure different things agree; worth investigating, still not proof")))


# ---- queries ------------------------------------------------------------------------------------

_DETS = ((1, 0, "person", 0.9, 0.2), (1, 1, "person", 0.5, 0.3), (1, 2, "dog", 0.75, 0.1), (2, 0, "laptop", 0.5, 0.1), (2, 1, "tv", 0.25, 0.1), (3, 0, "car", 0.5, 0.1), (3, 1, "horse", 0.5, 0.1), (3, 2, "car", 0.5, 0.1))


def object_findings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame(_DETS, "image_id int, det_no int, label string, confidence double, area_fraction double")
    return object_findings(d).select("image_id", F.explode("findings").alias("f")).select("image_id", "f.category", "f.label", "f.value", "f.severity", "f.confidence")


def quality_findings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_size") / 50).alias("x"))
    c = F.when(F.col("p_partkey") % 5 == 0, "blank").otherwise("photograph")
    x = F.col("x")
    out = p.select(F.explode(quality_findings(c, x / 10, x / 5, x * 0, x * 255, x * 10, x * 8, x * 3, x * 100)).alias("f"))
    return out.groupBy(F.col("f.label").alias("label"), F.col("f.severity").alias("severity")).agg(F.count("*").alias("n"))


def location_findings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", (F.col("c_acctbal") / 60).alias("v"))
    k = F.col("c_custkey")
    lat = F.when(k % 50 == 0, 0.0).otherwise(F.col("v"))
    lon = F.when(k % 50 == 0, 0.0).otherwise(F.col("v") * 1.5)
    out = c.select(F.explode(location_findings(lat, lon, F.when(k % 3 == 0, F.col("v")), F.when(k % 4 == 0, F.pmod(F.col("v"), F.lit(360))), (k % 9).cast("double"))).alias("f"))
    return out.groupBy(F.col("f.label").alias("label"), F.col("f.severity").alias("severity")).agg(F.count("*").alias("n"))


_D = "d(image_id, det_no, label, confidence, area) AS (VALUES " + ", ".join(f"({i}, {n}, '{x}', {c}, {a})" for i, n, x, c, a in _DETS) + ")"
_L = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_G = lambda label, group, sev, conf: f"SELECT image_id, 'objects' AS category, '{label}' AS label, string_agg(DISTINCT label, ', ' ORDER BY label) AS value, '{sev}' AS severity, {conf} AS confidence FROM d WHERE label IN {_L(group)} GROUP BY image_id"

QUERIES = {"object_findings": object_findings_query, "quality_findings": quality_findings_query, "location_findings": location_findings_query}
SQL = {
    "object_findings": f"WITH {_D}, c AS (SELECT image_id, label, count(*) AS n FROM d GROUP BY ALL) "
    "SELECT image_id, 'objects' AS category, (SELECT count(*) FROM d WHERE d.image_id = c.image_id) || ' object(s) detected' AS label, string_agg(label || CASE WHEN n > 1 THEN ' x' || n ELSE '' END, ', ' ORDER BY n DESC, label) AS value, 'info' AS severity, (SELECT round(avg(CAST(confidence AS DOUBLE)), 3) FROM d WHERE d.image_id = c.image_id) AS confidence FROM c GROUP BY image_id UNION ALL "
    "SELECT image_id, 'people', count(*) || CASE WHEN count(*) = 1 THEN ' person detected' ELSE ' people detected' END, CAST(count(*) AS VARCHAR), 'medium', arg_max(CAST(confidence AS DOUBLE), area) FROM d WHERE label = 'person' GROUP BY image_id UNION ALL "
    + " UNION ALL ".join((_G("Screen visible in frame", SCREENS, "medium", "CAST(0.6 AS DOUBLE)"), _G("Pet present", PETS, "low", "arg_min(CAST(confidence AS DOUBLE), det_no)"), _G("Animals present", OTHER_ANIMALS, "info", "CAST(1 AS DOUBLE)"), _G("Vehicles present", VEHICLES, "info", "CAST(1 AS DOUBLE)"))),
    "quality_findings": "WITH p AS (SELECT p_size / 50.0 AS x, CASE WHEN p_partkey % 5 = 0 THEN 'blank' ELSE 'photograph' END AS c FROM part), t AS (SELECT 'Thumbnail-sized image' AS label, 'low' AS severity FROM p WHERE x * 3 < 0.15 UNION ALL SELECT 'Blown highlights', 'low' FROM p WHERE c = 'photograph' AND x / 10 > 0.05 UNION ALL SELECT 'Crushed shadows', 'low' FROM p WHERE c = 'photograph' AND x / 5 > 0.1 UNION ALL SELECT 'Very low dynamic range', 'low' FROM p WHERE c = 'photograph' AND x * 255 < 40 UNION ALL SELECT 'High sensor noise', 'low' FROM p WHERE c = 'photograph' AND x * 10 > 8 UNION ALL SELECT 'Very low information content', 'medium' FROM p WHERE c = 'blank' UNION ALL SELECT 'Implausibly clean noise floor', 'low' FROM p WHERE x * 10 < 0.4 AND x * 3 > 1 AND x * 100 > 40) SELECT label, severity, count(*) AS n FROM t GROUP BY ALL",
    "location_findings": "WITH c AS (SELECT c_custkey AS k, c_acctbal / 60 AS v FROM customer), g AS (SELECT k, v, CASE WHEN k % 50 = 0 THEN 0 ELSE v END AS lat, CASE WHEN k % 50 = 0 THEN 0 ELSE v * 1.5 END AS lon FROM c), s AS (SELECT *, lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AS ok, abs(lat) < 0.001 AND abs(lon) < 0.001 AS nul FROM g), t AS (SELECT 'Coordinates out of valid range' AS label, 'high' AS severity FROM s WHERE NOT ok UNION ALL SELECT 'Null Island coordinates (0, 0)', 'high' FROM s WHERE ok AND nul UNION ALL SELECT 'GPS coordinates', 'high' FROM s WHERE ok AND NOT nul UNION ALL SELECT 'Altitude', 'info' FROM s WHERE ok AND k % 3 = 0 UNION ALL SELECT 'Camera bearing', 'info' FROM s WHERE ok AND k % 4 = 0 UNION ALL SELECT 'Poor GPS fix quality', 'low' FROM s WHERE ok AND k % 9 > 5) SELECT label, severity, count(*) AS n FROM t GROUP BY ALL",
}
