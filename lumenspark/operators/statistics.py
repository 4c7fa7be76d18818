"""Numeric evidence: robust outliers, entropy, exposure, first digits, quality and geometry classes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def mad_outliers(df: DataFrame, keys: list[str], value: str, z: float = 3.5) -> DataFrame:
    """Rows whose value lies z robust deviations from their group's median: adds ``median`` and ``score``.

    A spread below 1e-6 falls back to the mean absolute deviation with twice the limit; groups of
    fewer than 16 rows have no outliers. Groups are reduced before they meet their rows again.
    """
    m = df.groupBy(*keys).agg(F.median(value).alias("median"), F.count(value).alias("n"))
    dev = F.abs(F.col(value) - F.col("median"))
    with_m = df.join(m, keys) if keys else df.crossJoin(F.broadcast(m))
    s = with_m.groupBy(*keys).agg(F.median(dev).alias("mad"), F.avg(dev).alias("mean_dev"))
    out = with_m.join(s, keys) if keys else with_m.crossJoin(F.broadcast(s))
    robust = F.col("mad") >= 1e-6
    score = F.when(robust, dev / (1.4826 * F.col("mad"))).when(F.col("mean_dev") >= 1e-6, dev / F.col("mean_dev")).otherwise(0.0)
    return out.withColumn("score", score).where((F.col("n") >= 16) & (F.col("score") >= F.when(robust, z).otherwise(2 * z))).drop("mad", "mean_dev", "n")


def histogram_entropy(df: DataFrame, keys: list[str], symbol: str) -> DataFrame:
    """Shannon entropy in bits of a symbol column per group."""
    c = df.groupBy(*keys, symbol).agg(F.count("*").alias("c"))
    # -sum(p log p) = log n - sum(c log c) / n: one pass over the counts
    return c.groupBy(*keys).agg((F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("bits"))


def exposure(df: DataFrame, keys: list[str], value: str, low: float, high: float) -> DataFrame:
    """mean, median, population deviation, clipped shares and outer percentiles per group."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_pop(v).alias("std"), F.avg((v <= low).cast("int")).alias("clip_low"), F.avg((v >= high).cast("int")).alias("clip_high"), F.percentile(v, 0.01).alias("p1"), F.percentile(v, 0.99).alias("p99"))


def first_digit(value: Column) -> Column:
    """The leading decimal digit of a number's magnitude; null for zero."""
    a = F.abs(value)
    return F.when(a > 0, F.floor(a / F.pow(F.lit(10.0), F.floor(F.log10(a)))).cast("int"))


def benford_divergence(df: DataFrame, keys: list[str], value: str, least: int = 100) -> DataFrame:
    """Chi-square-like distance of first digits from Benford's law per group; 0 under ``least`` values."""
    d = df.select(*keys, first_digit(F.col(value)).alias("d")).where(F.col("d").between(1, 9))
    counts = d.groupBy(*keys).agg(F.count("*").alias("n"), *(F.count_if(F.col("d") == i).alias(f"c{i}") for i in range(1, 10)))
    total = F.lit(0.0)
    for i in range(1, 10):
        want = math.log10(1 + 1 / i)
        total = total + F.pow(F.col(f"c{i}") / F.col("n") - want, 2) / want
    return counts.select(*keys, "n", F.when(F.col("n") >= least, total).otherwise(0.0).alias("divergence"))


def content_class(entropy: Column, sharpness: Column) -> Column:
    return F.when((entropy < 1.5) & (sharpness < 50), "blank").when((entropy < 4) & (sharpness > 200), "graphic").otherwise("photograph")


def resolution_class(megapixels: Column) -> Column:
    """Fixed limits: .15, 1, 3, 12 and 40 megapixels."""
    return F.when(megapixels < 0.15, "thumbnail").when(megapixels < 1, "low").when(megapixels < 3, "web").when(megapixels < 12, "standard").when(megapixels < 40, "high").otherwise("very high")


def blur_verdict(sharpness: Column, contrast: Column, anisotropy: Column) -> Column:
    """struct(verdict, kind): flat images have no detail; under 12 blurred, under 60 soft; directional blur is motion."""
    verdict = F.when(contrast < 2, "no detail").when(sharpness < 12, "blurred").when(sharpness < 60, "soft").otherwise("sharp")
    return F.struct(verdict.alias("verdict"), F.when(verdict.isin("blurred", "soft"), F.when(anisotropy > 0.25, "motion").otherwise("defocus")).alias("kind"))


def localized_blur(tiles: DataFrame) -> DataFrame:
    """Blurred regions of tiled images: tiles (image_id, row, col, variance, contrast, x0, y0, x1, y1).

    A tile counts when its variance is under 12 and 15 % of the median while it has contrast; images
    with a median up to 1, or more than 40 % such tiles, have no localized blur. Two tiles make one.
    """
    med = tiles.groupBy("image_id").agg(F.median("variance").alias("m"), F.count("*").alias("n"))
    t = tiles.join(med, "image_id").where((F.col("m") > 1) & (F.col("variance") < 12) & (F.col("variance") < 0.15 * F.col("m")) & (F.col("contrast") > 2))
    g = t.groupBy("image_id").agg(F.count("*").alias("tiles"), F.max("n").alias("n"), F.avg(F.col("m") / F.greatest("variance", F.lit(1e-6))).alias("ratio"), F.array(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).alias("bbox"))
    g = g.where((F.col("tiles") <= 0.4 * F.col("n")) & (F.col("tiles") >= 2))
    return g.select("image_id", "tiles", "bbox", F.least(F.lit(0.75), 0.4 + F.col("ratio") / 100).alias("confidence"))


#: The public luminance table of JPEG's Annex K, in natural order.
LUMINANCE = (16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99)


def scaled_table(quality: int) -> list[int]:
    """The table a standard encoder writes at a quality of 1 to 100."""
    s = 5000 / quality if quality < 50 else 200 - 2 * quality
    return [min(255, max(1, math.floor((x * s + 50) / 100))) for x in LUMINANCE]


def jpeg_quality(table: Column) -> Column:
    """struct(quality, error, standard) of a 64-entry quantisation table, compared sorted to all hundred."""
    mine = F.array_sort(table)
    tries = [F.struct((F.aggregate(F.zip_with(mine, F.array(*(F.lit(x) for x in sorted(scaled_table(q)))), lambda a, b: F.abs(a - b)), F.lit(0), lambda a, x: a + x) / 64).alias("error"), F.lit(q).alias("quality")) for q in range(1, 101)]
    best = F.array_min(F.array(*tries))
    return F.struct(best["quality"].alias("quality"), best["error"].alias("error"), (best["error"] < 2).alias("standard"))


def copy_move_offsets(pairs: DataFrame) -> DataFrame:
    """Clone offsets from matched keypoints (image_id, x0, y0, x1, y1): groups of 12 and more.

    Shifts under 40 pixels are the texture's own; of an offset and its opposite the larger group stays.
    """
    p = pairs.select("image_id", (F.col("x1") - F.col("x0")).alias("dx"), (F.col("y1") - F.col("y0")).alias("dy"), "x0", "y0", "x1", "y1").where(F.hypot("dx", "dy") >= 40)
    forward = (F.col("dx") > 0) | ((F.col("dx") == 0) & (F.col("dy") > 0))
    p = p.withColumn("kx", F.round(F.when(forward, F.col("dx")).otherwise(-F.col("dx")) / 6)).withColumn("ky", F.round(F.when(forward, F.col("dy")).otherwise(-F.col("dy")) / 6))
    return p.groupBy("image_id", "kx", "ky").agg(F.count("*").alias("pairs"), F.avg(F.abs("dx")).alias("dx"), F.avg(F.when(forward, F.col("dy")).otherwise(-F.col("dy"))).alias("dy")).where("pairs >= 12")


# ---- queries ------------------------------------------------------------------------------------


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mad_outliers_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("event_type", "event_id", "value")
    return mad_outliers(e, ["event_type"], "value", 2.0).select("event_type", "event_id", F.round("score", 4).alias("score"))


def character_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("lang", F.explode(F.split(F.lower("text"), "")).alias("ch")).where("ch <> ''")
    return histogram_entropy(d, ["lang"], "ch").select("lang", F.round("bits", 6).alias("bits"))


def exposure_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = exposure(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", 2.0, 49.0)
    return x.select("l_returnflag", *(F.round(c, 6).alias(c) for c in ("mean", "median", "std", "clip_low", "clip_high", "p1", "p99")))


def benford(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benford_divergence(_t(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_extendedprice").select("l_linestatus", "n", F.round("divergence", 6).alias("divergence"))


def quality_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").select(resolution_class(F.col("p_size") * 1.0).alias("resolution"), content_class(F.col("p_size") / 8.0, F.col("p_retailprice") / 5).alias("content"))
    return p.groupBy("resolution", "content").agg(F.count("*").alias("n"))


def jpeg_quality_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimate for tables written at known qualities: exact wherever the tables differ."""
    rows = [(q, scaled_table(q)) for q in range(5, 100, 5)]
    return spark.createDataFrame(rows, "written int, t array<int>").select("written", jpeg_quality(F.col("t")).alias("j")).select("written", F.col("j.quality").alias("quality"), F.col("j.standard").alias("standard"))


QUERIES = {"mad_outliers": mad_outliers_query, "entropy": character_entropy, "exposure_stats": exposure_stats, "benford_divergence": benford, "quality_classes": quality_classes, "jpeg_quality": jpeg_quality_scan}
SQL = {
    "mad_outliers": "WITH m AS (SELECT event_type, median(value) AS med, count(value) AS n FROM events GROUP BY 1), d AS (SELECT e.*, n, abs(value - med) AS dev FROM events e JOIN m USING (event_type)), s AS (SELECT event_type, median(dev) AS mad, avg(dev) AS md FROM d GROUP BY 1), r AS (SELECT event_type, event_id, mad, n, CASE WHEN mad >= 1e-6 THEN dev / (1.4826 * mad) WHEN md >= 1e-6 THEN dev / md ELSE 0 END AS score FROM d JOIN s USING (event_type)) SELECT event_type, event_id, round(score, 4) AS score FROM r WHERE n >= 16 AND score >= CASE WHEN mad >= 1e-6 THEN 2.0 ELSE 4.0 END",
    "entropy": "WITH c AS (SELECT lang, ch, count(*) AS c FROM (SELECT lang, unnest(string_split(lower(text), '')) AS ch FROM documents) GROUP BY ALL) SELECT lang, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS bits FROM c GROUP BY lang",
    "exposure_stats": "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(median(l_quantity), 6) AS median, round(stddev_pop(l_quantity), 6) AS std, round(avg(CASE WHEN l_quantity <= 2 THEN 1 ELSE 0 END), 6) AS clip_low, round(avg(CASE WHEN l_quantity >= 49 THEN 1 ELSE 0 END), 6) AS clip_high, round(quantile_cont(l_quantity, 0.01), 6) AS p1, round(quantile_cont(l_quantity, 0.99), 6) AS p99 FROM lineitem GROUP BY 1",
    "benford_divergence": "WITH d AS (SELECT l_linestatus, CAST(floor(l_extendedprice / pow(10.0, floor(log10(l_extendedprice)))) AS INT) AS d FROM lineitem WHERE l_extendedprice > 0), n AS (SELECT l_linestatus, count(*) AS n FROM d GROUP BY 1), c AS (SELECT l_linestatus, g.i, count(d.d) AS c FROM (SELECT DISTINCT l_linestatus FROM d) k CROSS JOIN range(1, 10) g(i) LEFT JOIN d USING (l_linestatus) WHERE d.d = g.i GROUP BY ALL) SELECT l_linestatus, max(n) AS n, round(sum(pow(CAST(c AS DOUBLE) / n - log10(1 + 1.0 / i), 2) / log10(1 + 1.0 / i)), 6) AS divergence FROM c JOIN n USING (l_linestatus) GROUP BY 1",
    "quality_classes": "SELECT CASE WHEN p_size < 0.15 THEN 'thumbnail' WHEN p_size < 1 THEN 'low' WHEN p_size < 3 THEN 'web' WHEN p_size < 12 THEN 'standard' WHEN p_size < 40 THEN 'high' ELSE 'very high' END AS resolution, CASE WHEN p_size / 8.0 < 1.5 AND p_retailprice / 5 < 50 THEN 'blank' WHEN p_size / 8.0 < 4 AND p_retailprice / 5 > 200 THEN 'graphic' ELSE 'photograph' END AS content, count(*) AS n FROM part GROUP BY ALL",
    "jpeg_quality": "SELECT CAST(i AS INT) AS written, CAST(i AS INT) AS quality, true AS standard FROM range(5, 100, 5) r(i)",
}
