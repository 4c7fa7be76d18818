"""Detections as tables: head decoding, non-maximum suppression, scenes, plates, overlaps, counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Scene rules (strong and weak labels), label groups, plate geometry.
SCENES = {
    "street / traffic": ("traffic light,stop sign,fire hydrant,bus,parking meter", "car,truck,motorcycle,bicycle,person"),
    "indoor / domestic": ("bed,couch,toilet,refrigerator,microwave,oven,sink", "chair,dining table,tv,potted plant,vase,book,clock"),
    "workplace / desk": ("laptop,keyboard,mouse", "chair,cup,book,cell phone,tv"),
    "food / hospitality": ("pizza,cake,sandwich,hot dog,donut,wine glass", "cup,bowl,fork,knife,spoon,bottle,dining table"),
    "outdoor / nature": ("bird,horse,sheep,cow,elephant,bear,zebra,giraffe", "potted plant,bench,kite,frisbee"),
    "sport / recreation": ("sports ball,skis,snowboard,surfboard,tennis racket,baseball bat,baseball glove,skateboard", "person,bench"),
    "transit / travel": ("airplane,train,boat,suitcase", "person,backpack,handbag,bench"),
}
VEHICLES = ("car", "motorcycle", "bus", "truck", "bicycle")
MOTOR_VEHICLES = ("car", "motorcycle", "bus", "truck")
STRIDES = (8, 16, 32)


def letterbox(width: Column, height: Column, target_w: int, target_h: int) -> Column:
    """struct(scale, new_w, new_h): the picture keeps its shape; padding goes to the bottom right."""
    scale = F.least(F.lit(target_w) / width, F.lit(target_h) / height)
    return F.struct(scale.alias("scale"), F.round(width * scale).cast("int").alias("new_w"), F.round(height * scale).cast("int").alias("new_h"))


def to_source(box: Column, scale: Column, width: Column, height: Column) -> Column:
    """Boxes of network space in source pixels, clipped to the picture."""
    return F.transform(box, lambda v, i: F.greatest(F.lit(0.0), F.least(v / scale, F.when(i % 2 == 0, width).otherwise(height).cast("double"))))


def decode_head(anchors: DataFrame, input_w: int, input_h: int) -> DataFrame:
    """Boxes, score and class of raw head rows (image_id, anchor, v), v = cx, cy, log w, log h, objectness, classes.

    The anchor's number gives its grid cell and stride; the score is objectness times class score. A
    number outside the grid is an error.
    """
    counts = [(input_w // s) * (input_h // s) for s in STRIDES]
    before = [sum(counts[:i]) for i in range(len(STRIDES))]
    a = F.col("anchor")
    stride, base = F.raise_error(F.lit("anchor outside the grid")).cast("int"), F.lit(0)
    for s, b, n in zip(STRIDES, before, counts, strict=True):
        stride, base = F.when(a.between(b, b + n - 1), s).otherwise(stride), F.when(a.between(b, b + n - 1), b).otherwise(base)
    out = anchors.withColumn("stride", stride).withColumn("cell", a - base).withColumn("cols", (F.lit(input_w) / F.col("stride")).cast("int"))
    v = lambda i: F.get("v", F.lit(i)).cast("double")
    cx, cy = (v(0) + F.col("cell") % F.col("cols")) * F.col("stride"), (v(1) + F.floor(F.col("cell") / F.col("cols"))) * F.col("stride")
    w, h = F.exp(v(2)) * F.col("stride"), F.exp(v(3)) * F.col("stride")
    classes = F.slice("v", F.lit(6), F.size("v") - 5)
    top = F.array_max(classes)
    return out.select("image_id", "anchor", F.array(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2).alias("box"), (v(4) * top).alias("score"), (F.array_position(classes, top) - 1).cast("int").alias("class_id"))


def suppressed(boxes: np.ndarray, scores: np.ndarray, limit: float) -> list[int]:
    """Greedy suppression: indices kept, best first; of equal scores the later row leads."""
    rest = np.argsort(scores, kind="stable")[::-1]
    area = np.prod(np.maximum(boxes[:, 2:] - boxes[:, :2], 0), axis=1)
    kept = []
    while len(rest):
        b, rest = rest[0], rest[1:]
        kept.append(int(b))
        low, high = np.maximum(boxes[b, :2], boxes[rest, :2]), np.minimum(boxes[b, 2:], boxes[rest, 2:])
        both = np.prod(np.maximum(high - low, 0), axis=1)
        union = area[b] + area[rest] - both
        rest = rest[np.where(union > 0, both / np.maximum(union, 1e-9), 0) <= limit]
    return kept


def nms(detections: DataFrame, iou: float = 0.45, score: float = 0.35, per_class: bool = True, most: int = 100) -> DataFrame:
    """Detections (image_id, box, score, class_id) that survive per image and class, ranked; at most ``most`` per image."""
    keys = ["image_id", "class_id"] if per_class else ["image_id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "class_id"], kind="stable").reset_index(drop=True)
        return pdf.iloc[suppressed(np.stack(pdf["box"].tolist()).astype(float), pdf["score"].to_numpy(), iou)]

    src = detections.where(F.col("score") >= score).select("image_id", "box", "score", "class_id")
    kept = src.groupBy(*keys).applyInPandas(run, src.schema)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "class_id", "box", "score")))
    top = kept.groupBy("image_id").agg(F.slice(ordered, 1, most).alias("d"))
    return top.select("image_id", F.posexplode("d").alias("rank", "d")).select("image_id", "rank", "d.class_id", "d.box", "d.score")


def scenes(labels: DataFrame) -> DataFrame:
    """Ranked scenes per image from detections (image_id, label): a strong cue, or two weak ones, are needed."""
    present = labels.groupBy("image_id").agg(F.collect_set("label").alias("l"))
    each = []
    for name, (strong, weak) in SCENES.items():
        s, w = (F.array_intersect("l", F.array(*(F.lit(x) for x in g.split(",")))) for g in (strong, weak))
        points = F.size(s) + F.size(w) * 0.25
        hit = F.struct(F.lit(name).alias("scene"), F.round(points, 3).alias("score"), F.round(F.least(F.lit(0.9), 0.35 + points * 0.12), 3).alias("confidence"), F.array_join(F.array_sort(F.array_union(s, w)), ", ").alias("evidence"))
        each.append(F.when((F.size(s) > 0) | (F.size(w) >= 2), hit))
    rows = present.select("image_id", F.posexplode(F.array_compact(F.array(*each))).alias("i", "x"))
    order = F.struct(-F.col("x.score"), "i")
    ranked = rows.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "x"))).alias("r"))
    return ranked.select("image_id", F.posexplode("r").alias("rank", "r")).select("image_id", (F.col("rank") + 1).alias("rank"), "r.x.*")


def plate_region(box: Column, area_fraction: Column) -> Column:
    """Where a plate would be on a vehicle: a low central band of likely shape; null where there is none."""
    x0, y0, x1, y1 = (F.get(box, F.lit(i)) for i in range(4))
    w, h = x1 - x0, y1 - y0
    inset = (w * 0.22).cast("int")
    region = F.array(x0 + inset, y0 + (h * 0.60).cast("int"), x1 - inset, y0 + (h * 0.95).cast("int"))
    rw, rh = region[2] - region[0], region[3] - region[1]
    ok = (F.coalesce(area_fraction, F.lit(0.0)) >= 0.01) & (w >= 40) & (h >= 30) & (rw > 0) & (rh > 0)
    return F.when(ok & ((rw / F.nullif(rh, F.lit(0))).between(2.0, 6.5)), region)


def plate_text(vehicles: DataFrame, blocks: DataFrame) -> DataFrame:
    """vehicles (image_id, det_no, bbox, area_fraction) plus region and the text whose centre lies inside.

    blocks: image_id, block_no, text, bbox; texts join in block order. The join is by image, so both
    sides shuffle on it and no picture meets another's text.
    """
    v = vehicles.withColumn("region", plate_region(F.col("bbox"), F.col("area_fraction")))
    b = blocks.where(F.col("bbox").isNotNull()).select("image_id", "block_no", F.trim("text").alias("t"), ((F.get("bbox", F.lit(0)) + F.get("bbox", F.lit(2))) / 2).alias("cx"), ((F.get("bbox", F.lit(1)) + F.get("bbox", F.lit(3))) / 2).alias("cy"))
    r = lambda i: F.get("region", F.lit(i))
    hit = v.join(b, "image_id").where(F.col("region").isNotNull() & F.col("cx").between(r(0), r(2)) & F.col("cy").between(r(1), r(3)) & (F.col("t") != ""))
    text = hit.groupBy("image_id", "det_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "t"))), lambda x: x["t"]), " ").alias("plate_text"))
    return v.join(text, ["image_id", "det_no"], "left")


def overlapping_labels(matches: DataFrame, detections: DataFrame, share: float = 0.3) -> DataFrame:
    """matches (image_id, match_no, bbox) with the sorted labels of detections covering over ``share`` of them."""
    m, d = matches.withColumnRenamed("bbox", "mb"), detections.select("image_id", "label", F.col("bbox").alias("db"))
    g = lambda c, i: F.get(c, F.lit(i))
    w = F.greatest(F.lit(0), F.least(g("mb", 2), g("db", 2)) - F.greatest(g("mb", 0), g("db", 0)))
    h = F.greatest(F.lit(0), F.least(g("mb", 3), g("db", 3)) - F.greatest(g("mb", 1), g("db", 1)))
    area = (g("mb", 2) - g("mb", 0)) * (g("mb", 3) - g("mb", 1))
    return m.join(d, "image_id").where(w * h / F.nullif(area, F.lit(0)) > share).groupBy("image_id", "match_no").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def label_counts(detections: DataFrame) -> DataFrame:
    """Counts by label with vehicles and motor vehicles marked."""
    return detections.groupBy("image_id", "label").agg(F.count("*").alias("n")).withColumn("vehicle", F.col("label").isin(*VEHICLES)).withColumn("motor_vehicle", F.col("label").isin(*MOTOR_VEHICLES))


def ocr_rollup(blocks: DataFrame) -> DataFrame:
    """Text in reading order (12-pixel lines), counts and mean confidence per image."""
    line = F.struct(F.floor(F.get("bbox", F.lit(1)) / 12).alias("line"), F.get("bbox", F.lit(0)).alias("x"), "block_no", "text")
    return blocks.groupBy("image_id").agg(F.count("*").alias("block_count"), F.count_if(F.col("confidence") >= 0.45).alias("confident"), F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda b: b["text"]), "\n").alias("text"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))


def language_totals(blocks: DataFrame) -> DataFrame:
    """Languages of an image by text length times confidence; blocks under 14 characters or .55 do not count."""
    ok = blocks.where((F.length("text") >= 14) & (F.col("confidence") >= 0.55))
    return ok.groupBy("image_id", "language").agg(F.sum(F.length("text") * F.col("confidence")).alias("weight"))


# ---- queries on literal detections ----------------------------------------------------------------

_LABELS = ((1, "car"), (1, "person"), (1, "traffic light"), (2, "laptop"), (2, "cup"), (2, "chair"), (2, "chair"), (3, "person"), (4, "bird"), (4, "bench"), (4, "kite"), (5, "person"), (5, "bench"), (6, "chair"))
_VEHICLES = ((1, 0, [100, 100, 300, 200], 0.05), (1, 1, [0, 0, 30, 20], 0.02), (2, 0, [0, 0, 400, 100], 0.2), (2, 1, [50, 50, 250, 170], 0.001), (3, 0, [10, 10, 310, 210], 0.3))
_BLOCKS = ((1, 0, " AB12 ", [150, 165, 200, 180]), (1, 1, "CDE", [205, 165, 250, 180]), (1, 2, "far", [0, 0, 10, 10]), (3, 0, "XY 99", [120, 140, 200, 170]), (3, 1, "", [120, 140, 200, 170]))


def scene_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes(spark.createDataFrame(_LABELS, "image_id int, label string"))


def plate_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.createDataFrame(_VEHICLES, "image_id int, det_no int, bbox array<int>, area_fraction double")
    out = plate_text(v, spark.createDataFrame(_BLOCKS, "image_id int, block_no int, text string, bbox array<int>"))
    return out.select("image_id", "det_no", F.array_join("region", ",").alias("region"), "plate_text")


def nms_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppression over synthetic boxes from the embeddings table; rows only."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    x = lambda i: (F.get("embedding", F.lit(i)).cast("double") + 0.5) * 100
    d = e.select((F.col("vec_id") % 20).alias("image_id"), F.array(x(0), x(1), x(0) + 40, x(1) + 40).alias("box"), (F.abs(F.get("embedding", F.lit(2)).cast("double")) * 2 + 0.3).alias("score"), F.col("label").alias("class_id"))
    return nms(d)


def overlap_labels_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.createDataFrame([(i, n, b) for i, n, b, _ in _VEHICLES], "image_id int, match_no int, bbox array<int>")
    d = spark.createDataFrame([(i, t.strip() or "blank", b) for i, _, t, b in _BLOCKS] + [(1, "all", [0, 0, 300, 200]), (2, "left", [0, 0, 200, 100])], "image_id int, label string, bbox array<int>")
    return overlapping_labels(v, d).select("image_id", "match_no", F.array_join("labels", ",").alias("labels"))


_V = "v(image_id, det_no, b, af) AS (VALUES " + ", ".join(f"({i}, {n}, {b}, {a})" for i, n, b, a in _VEHICLES) + ")"
_B = "t(image_id, block_no, text, b) AS (VALUES " + ", ".join(f"({i}, {n}, '{t}', {b})" for i, n, t, b in _BLOCKS) + ")"
_SC = "rules(i, scene, s, w) AS (VALUES " + ", ".join(f"({i}, '{n}', string_split('{s}', ','), string_split('{w}', ','))" for i, (n, (s, w)) in enumerate(SCENES.items())) + ")"

QUERIES = {"scene_rank": scene_rank, "plate_text": plate_text_query, "overlap_labels": overlap_labels_query, "nms": nms_query}
SQL = {
    "scene_rank": f"WITH {_SC}, l(image_id, label) AS (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in _LABELS) + "), p AS (SELECT image_id, list(DISTINCT label) AS l FROM l GROUP BY 1), h AS (SELECT image_id, i, scene, list_intersect(l, s) AS a, list_intersect(l, w) AS b FROM p, rules), k AS (SELECT *, len(a) + 0.25 * len(b) AS score FROM h WHERE len(a) > 0 OR len(b) >= 2) SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY score DESC, i) AS INT) AS rank, scene, CAST(round(score, 3) AS DOUBLE) AS score, round(least(0.9, CAST(0.35 + score * 0.12 AS DOUBLE)), 3) AS confidence, array_to_string(list_sort(list_distinct(list_concat(a, b))), ', ') AS evidence FROM k",
    "plate_text": f"WITH {_V}, {_B}, r AS (SELECT *, [b[1] + CAST(floor((b[3] - b[1]) * 0.22) AS INT), b[2] + CAST(floor((b[4] - b[2]) * 0.60) AS INT), b[3] - CAST(floor((b[3] - b[1]) * 0.22) AS INT), b[2] + CAST(floor((b[4] - b[2]) * 0.95) AS INT)] AS g FROM v), k AS (SELECT image_id, det_no, CASE WHEN af >= 0.01 AND b[3] - b[1] >= 40 AND b[4] - b[2] >= 30 AND (g[3] - g[1]) / (g[4] - g[2]) BETWEEN 2.0 AND 6.5 THEN g END AS g FROM r) SELECT k.image_id, k.det_no, array_to_string(any_value(g), ',') AS region, string_agg(trim(text), ' ' ORDER BY block_no) FILTER (trim(text) <> '') AS plate_text FROM k LEFT JOIN t ON t.image_id = k.image_id AND (t.b[1] + t.b[3]) / 2 BETWEEN g[1] AND g[3] AND (t.b[2] + t.b[4]) / 2 BETWEEN g[2] AND g[4] GROUP BY ALL",
    "overlap_labels": f"WITH {_V}, {_B}, d AS (SELECT image_id, CASE WHEN trim(text) = '' THEN 'blank' ELSE trim(text) END AS label, b FROM t UNION ALL VALUES (1, 'all', [0, 0, 300, 200]), (2, 'left', [0, 0, 200, 100])) SELECT v.image_id, v.det_no AS match_no, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM v JOIN d ON v.image_id = d.image_id WHERE greatest(0, least(v.b[3], d.b[3]) - greatest(v.b[1], d.b[1])) * greatest(0, least(v.b[4], d.b[4]) - greatest(v.b[2], d.b[2])) / ((v.b[3] - v.b[1]) * (v.b[4] - v.b[2])) > 0.3 GROUP BY ALL",
}
