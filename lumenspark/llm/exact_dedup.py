"""Exact deduplication by progressive refinement: length, prefix hash, full hash. Native only.

Level 1 groups rows by byte length, level 2 groups the survivors by the hash of a normalised prefix,
and level 3 hashes the whole text of rows that still share a group. Between levels the surviving
groups travel as a broadcast bitmap of fixed size, so no level shuffles a text and none depends on
how many groups survive; a bitmap collision only costs an extra hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, key_bitmap, lower_az, read, remove_keys, settled, with_membership

#: Characters of the normalised text that level 2 hashes.
PREFIX_CHARS = 64


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (binary).

    Texts are equal when identical after lower-casing A-Z only; null counts as empty, and empty texts
    are equal to each other. Of equal texts the largest id stays (null ids sort lowest); of rows that
    repeat both id and text exactly one is marked kept. text_sha256 is null for rows that left the
    refinement early, unless digest_all asks for every row's. Other columns of docs are ignored.
    """
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    length, prefix = F.octet_length("text"), F.xxhash64(lower_az(F.substring("text", 1, PREFIX_CHARS)))
    shape = cut(src.select(F.octet_length("text").alias("n"), prefix.alias("p")).groupBy("n", "p").agg(F.count("*").alias("c")), "exact-shape")

    by_length = shape.groupBy("n").agg(F.sum("c").alias("c")).where("c > 1").select("n")
    lengths = key_bitmap(by_length, "n")
    refined = with_membership(shape, lengths, F.col("n"), "l1").where("l1 and c > 1")
    prefixes = key_bitmap(refined.select(F.xxhash64("n", "p").alias("k")), "k")

    scan = with_membership(src.withColumn("k", F.xxhash64(length, prefix)), prefixes, F.col("k"), "survives")
    digest = F.unhex(F.sha2(lower_az(F.col("text")).cast("binary"), 256))
    if digest_all:
        scan = scan.select("id", "k", "survives", digest.alias("sha"))
    else:
        scan = scan.select("id", "k", "survives", F.when(F.col("survives"), digest).alias("sha"))
    # Rows that left early are alone in length and prefix; with the id, which may repeat or be null, these keep them apart.
    key = F.when(F.col("survives"), F.col("sha")).otherwise(F.concat_ws("~", F.lit(""), F.col("k"), F.col("id").cast("string")).cast("binary"))
    rows = cut(scan.withColumn("key", key).groupBy("id", "key", "sha").agg(F.count("*").alias("n"), F.max("survives").alias("survives")), "exact-rows")
    groups = rows.where("survives").groupBy("key").agg(F.max("id").alias("g_id"), F.sum("n").alias("g_n")).where("g_n > 1").withColumnRenamed("key", "g_key")
    out = rows.join(groups, F.col("key") == F.col("g_key"), "left")
    keep = F.when(F.col("g_key").isNull(), F.col("id")).otherwise(F.col("g_id"))
    out = out.select("id", keep.alias("keep_id"), F.when(F.col("g_key").isNull(), F.col("n")).otherwise(F.col("g_n")).alias("group_size"), "sha", F.explode(F.expr("sequence(1L, n)")).alias("copy"))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text an equal row with a larger id holds; all columns stay.

    Rows that repeat both id and text lose all but one. Null ids are kept unless a text repeats under
    a null id only, where rows cannot be told apart and all stay.
    """
    decided = settled(lambda: exact_dedup(docs, id_col, text_col).select(id_col, "kept"), "exact-decided")
    counts = decided.groupBy(id_col).agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("k"))
    gone = counts.where("k = 0").select(id_col)
    clean = remove_keys(docs, gone, id_col)
    mixed = counts.where(f"n > 1 and k > 0 and {id_col} is not null").select(id_col)
    if mixed.isEmpty():
        return clean
    # Ids that stand on several rows: settle them by text as well as id.
    rest = clean.join(mixed.select(F.col(id_col).alias("__m")), F.col(id_col) == F.col("__m"), "left_semi")
    norm = F.sha2(lower_az(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256)
    text_of = exact_dedup(docs, id_col, text_col, True).where("kept").select(F.col(id_col).alias("__id"), F.lower(F.hex("text_sha256")).alias("__sha")).distinct()
    rest = rest.withColumn("__norm", norm).join(text_of, (F.col(id_col) == F.col("__id")) & (F.col("__norm") == F.col("__sha")), "left_semi")
    rest = rest.dropDuplicates([id_col, "__norm"]).drop("__norm")
    return remove_keys(clean, mixed, id_col).unionByName(rest)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(read(spark, sf_dir, "documents"), digest_all=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("text_sha256")).alias("text_sha256"))


OP3_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (
  SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, t FROM n
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""

QUERIES = {"op3_exact_dedup": op3_exact_dedup}
SQL = {"op3_exact_dedup": OP3_SQL}
