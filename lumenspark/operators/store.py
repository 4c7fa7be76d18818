"""Index and job tables: keyed upserts, resume, statistics, manifests, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(current: DataFrame, changes: DataFrame, key: str, seq: str) -> DataFrame:
    """Rows by key, the change with the largest ``seq`` winning over earlier ones and over current rows.

    Changes are reduced to one per key before they meet the table, so the table shuffles once.
    """
    latest = changes.groupBy(key).agg(F.max_by(F.struct(*changes.columns), seq).alias("r")).select("r.*")
    kept = current.join(latest.select(key), key, "left_anti")
    return kept.unionByName(latest.select(*current.columns))


def resume(inputs: DataFrame, jobs: DataFrame, key: str = "path") -> DataFrame:
    """Inputs whose job is not done yet; failed ones come again."""
    return inputs.join(jobs.where("status = 'done'").select(key), key, "left_anti")


def mark(jobs: DataFrame, results: DataFrame, at: Column) -> DataFrame:
    """Jobs after a run: results (path, error) become done or failed, newest first."""
    new = results.select("path", F.when(F.col("error").isNull(), "done").otherwise("failed").alias("status"), "error", at.alias("updated_utc"))
    return upsert(jobs, new, "path", "updated_utc")


def index_stats(images: DataFrame, jobs: DataFrame) -> DataFrame:
    """images, findings, located and distinct devices in one row."""
    a = images.agg(F.count("*").alias("images"), F.coalesce(F.sum("findings_high"), F.lit(0)).alias("findings_high"), F.coalesce(F.sum("findings_medium"), F.lit(0)).alias("findings_medium"), F.count("latitude").alias("located"), F.countDistinct("camera").alias("cameras"), F.countDistinct("serial").alias("serials"))
    failed = jobs.where("status = 'failed'").agg(F.count("*").alias("failed")).scalar()
    return a.select("*", failed.alias("failed"))


def manifest_diff(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(relpath, problem): files that changed, are missing, or are not listed; empty when all is well."""
    m, f = manifest.select("relpath", F.col("sha256").alias("want")), files.select("relpath", F.col("sha256").alias("have"))
    both = m.join(f, "relpath", "full_outer")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(F.col("have") != F.col("want"), "modified")
    return both.select("relpath", problem.alias("problem")).where(F.col("problem").isNotNull())


def manifest(files: DataFrame) -> DataFrame:
    """Manifest lines of binary files (path relative, content): digest, two spaces, path; the manifest itself is left out."""
    rows = files.where("relpath <> 'MANIFEST.sha256'").select("relpath", F.sha2("content", 256).alias("sha256"))
    return rows.withColumn("line", F.concat_ws("  ", "sha256", "relpath"))


def audit_tail(audit: DataFrame, n: int = 100) -> DataFrame:
    return audit.orderBy(F.desc("id")).limit(n)


def forget(entities: DataFrame, refs: DataFrame, name: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without an entity and its references."""
    gone = entities.where((F.col("name") == name) & (F.col("kind") == kind)).select(F.col("id").alias("entity_id"))
    return entities.join(gone, entities["id"] == gone["entity_id"], "left_anti"), refs.join(gone, "entity_id", "left_anti")


# ---- queries ------------------------------------------------------------------------------------


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("failed").alias("status"))
    left = resume(_t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), "l_linenumber"), o)
    return left.groupBy("l_linenumber").agg(F.count("*").alias("n"))


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return upsert(e.where("event_id % 3 = 0 and false"), e, "user_id", "event_id")


def index_stats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 3).alias("findings_high"), (F.col("o_custkey") % 5).alias("findings_medium"), F.when(F.col("o_orderkey") % 4 == 0, 1.0).alias("latitude"), F.col("o_orderpriority").alias("camera"), F.col("o_custkey").alias("serial"))
    jobs = _t(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "O", "failed").otherwise("done").alias("status"))
    return index_stats(o, jobs)


def manifest_diff_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), F.col("doc_id")).alias("relpath"), F.sha2("text", 256).alias("sha256"), "doc_id")
    files = d.where("doc_id % 17 <> 3").withColumn("sha256", F.when(F.col("doc_id") % 23 == 5, F.lit("x")).otherwise(F.col("sha256"))).select("relpath", "sha256")
    return manifest_diff(d.where("doc_id % 19 <> 7").select("relpath", "sha256"), files)


QUERIES = {"resume_anti": resume_anti, "upsert_latest": upsert_latest, "index_stats": index_stats_query, "manifest_diff": manifest_diff_query}
SQL = {
    "resume_anti": "SELECT l_linenumber, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F') GROUP BY 1",
    "upsert_latest": "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1",
    "index_stats": "SELECT count(*) AS images, CAST(sum(o_custkey % 3) AS BIGINT) AS findings_high, CAST(sum(o_custkey % 5) AS BIGINT) AS findings_medium, count(*) FILTER (o_orderkey % 4 = 0) AS located, count(DISTINCT o_orderpriority) AS cameras, count(DISTINCT o_custkey) AS serials, count(*) FILTER (o_orderstatus = 'O') AS failed FROM orders",
    "manifest_diff": "WITH d AS (SELECT 'd/' || doc_id AS relpath, sha256(text) AS h, doc_id FROM documents), m AS (SELECT * FROM d WHERE doc_id % 19 <> 7), f AS (SELECT relpath, CASE WHEN doc_id % 23 = 5 THEN 'x' ELSE h END AS h FROM d WHERE doc_id % 17 <> 3) SELECT coalesce(m.relpath, f.relpath) AS relpath, CASE WHEN f.h IS NULL THEN 'missing' WHEN m.h IS NULL THEN 'unlisted' ELSE 'modified' END AS problem FROM m FULL JOIN f ON m.relpath = f.relpath WHERE f.h IS NULL OR m.h IS NULL OR f.h <> m.h",
}
