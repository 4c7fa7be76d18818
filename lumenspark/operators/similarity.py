"""Similarity of hashes and vectors: Hamming pairs, clusters, pair verdicts, entity search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.durable import cut
from .blocks import best_scores, near_forest, near_pairs


def hex_halves(h: Column) -> tuple[Column, Column]:
    """A 64-bit hex hash as two longs of 32 bits; a whole one overflows a cast."""
    return F.conv(F.substr(h, F.lit(1), F.lit(8)), 16, 10).cast("long"), F.conv(F.substr(h, F.lit(9), F.lit(8)), 16, 10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hex hashes; other widths are an error."""
    (a1, a2), (b1, b2) = hex_halves(a), hex_halves(b)
    ok = (F.length(a) == 16) & (F.length(b) == 16)
    return F.when(ok, F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))).otherwise(F.when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("hashes must have 16 hex digits")).cast("int")))


#: Rows of a block of hashes, at most; fewer where that gives all cores work.
BLOCK = 1 << 16


def hash_keys(h: Column) -> Column:
    """A 64-bit hex hash as one long; null and empty hashes are null, other widths an error."""
    high, low = hex_halves(h)
    wrong = F.raise_error(F.lit("hashes must have 16 hex digits")).cast("long")
    return F.when(F.length(h) == 16, F.shiftleft(high, 32).bitwiseOR(low)).when(h != "", wrong)


def _dealt(rows: DataFrame) -> int:
    """Into how many blocks the rows are dealt."""
    n = rows.count()
    return max(1, -(-n // BLOCK), min(10, -(-n // 2048)))


def hamming_pairs(df: DataFrame, id_col: str, hash_col: str, radius: int) -> DataFrame:
    """Pairs (a, b, distance), a < b, within ``radius`` bits; null and empty hashes have none.

    Blocks of hashes meet in cells, which are compared bit by bit. Radii of a quarter of the bits
    leave every index more candidates than a join of rows can take.
    """
    keys = df.select(F.col(id_col).alias("id"), hash_keys(F.col(hash_col)).alias("k")).where("k is not null")
    near = near_pairs(keys, _dealt(keys), radius)
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance").where("x <> y")


def cluster_multi(df: DataFrame, id_col: str, hash_cols: list[str], radius: int) -> DataFrame:
    """Single-linkage clusters over any of several hashes: (cluster, id, distance, is_direct).

    Two rows link when any of their hashes lies within the radius. The cluster's anchor is its
    smallest id; a member's distance is its best direct one to the anchor, else the radius. Clusters
    of one row are left out. Every hash that is there must have 16 hex digits, linked or not.

    Each cell's links are merged where they are found, so that at most one a row and cell leaves it.
    """
    names = [f"k{i}" for i in range(len(hash_cols))]
    rows = cut(df.select(F.col(id_col).alias("id"), *(hash_keys(F.col(h)).alias(k) for h, k in zip(hash_cols, names, strict=True))).where(F.col(id_col).isNotNull()))
    edges = None
    for k in names:
        keys = rows.where(F.col(k).isNotNull()).select("id", F.col(k).alias("k"))
        e = near_forest(keys, _dealt(keys), radius)
        edges = e if edges is None else edges.unionByName(e)
    labels = connected(cut(edges.where("a <> b")))
    members = cut(labels.select(F.col("label").alias("cluster"), F.col("node").alias("id")).join(rows, "id"))
    anchors = members.where("id = cluster").select("cluster", *(F.col(k).alias(f"a{k}") for k in names))
    bits = [F.bit_count(F.col(k).bitwiseXOR(F.col(f"a{k}"))) for k in names]
    best = F.least(*bits) if len(bits) > 1 else bits[0]
    out = members.join(anchors, "cluster").groupBy("cluster", "id").agg(F.min(F.when(best <= radius, best)).alias("distance"))
    anchor = F.col("id") == F.col("cluster")
    return out.select("cluster", "id", F.when(anchor, 0).otherwise(F.coalesce("distance", F.lit(radius))).alias("distance"), (anchor | F.col("distance").isNotNull()).alias("is_direct"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) with the smallest node of each component: min labels with pointer jumping, durable rounds."""
    both = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("label")))
    while True:
        heard = both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("near")), "v").groupBy(F.col("u").alias("node")).agg(F.min("near").alias("near"))
        step = cut(labels.join(heard, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was")))
        jump = step.join(step.select(F.col("node").alias("label"), F.col("label").alias("top")), "label").select("node", F.least("label", "top").alias("label"), "was")
        labels = cut(jump)
        if labels.where("label <> was").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def pair_verdict(same_file: Column, same_pixels: Column, distance: Column) -> Column:
    return F.when(same_file, "identical file").when(same_pixels, "identical pixels").when(distance <= 4, "near-identical").when(distance <= 10, "similar").otherwise("different")


# ---- vectors ------------------------------------------------------------------------------------


def normalised(v: Column) -> Column:
    """A vector of doubles of length 1; the zero vector stays."""
    d = F.transform(v, lambda x: x.cast("double"))
    n = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(n > 0, F.transform(d, lambda x: x / n)).otherwise(d)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


#: Vectors that meet in one task may take this many bytes; a block of either side takes an eighth of them.
BROADCAST_BYTES = 64 << 20


def entity_scores(queries: DataFrame, refs: DataFrame, blocks: int = 12) -> DataFrame:
    """Best similarity of every (query, entity): queries (query_id, vector), refs (ref_id, entity, vector).

    Ties keep the larger ref_id. Rows of different dimension are an error. Vectors must have length 1.
    Both sides are cut into blocks that meet in at least ``blocks`` cells, or a reference block for
    each thousand; every cell keeps its best similarity of each query and entity.
    """
    vector = F.transform("vector", lambda x: x.cast("double"))
    q = queries.select("query_id", vector.alias("qv"))
    r = refs.select("ref_id", "entity", vector.alias("rv"))
    limit = max(1, BROADCAST_BYTES // 8)

    def sizes(df: DataFrame, v: str) -> tuple[int, int]:
        n, size = df.agg(F.count("*"), F.coalesce(F.sum(F.size(v) * 8 + 64), F.lit(0))).first()
        return max(1, n), min(max(1, n), max(1, -(-size // limit)))

    (_, n), (rows, m) = sizes(q, "qv"), sizes(r, "rv")
    m = max(m, min(-(-blocks // n), -(-rows // 1024)))
    best = F.max(F.struct("similarity", "ref_id"))
    return best_scores(q, n, r, m).groupBy("query_id", "entity").agg(best.alias("b")).select("query_id", "entity", F.col("b.similarity").alias("similarity"), F.col("b.ref_id").alias("ref_id"))


def entity_verdicts(scores: DataFrame, threshold: float = 0.363, margin: float = 0.05) -> DataFrame:
    """Per query: verdict, best entity, similarity, runner-up and margin.

    Below the threshold there is no match; a runner-up closer than the margin makes it inconclusive.
    Without a runner-up the margin is unbounded and reported as 0.
    """
    w = W.partitionBy("query_id").orderBy(F.desc("similarity"), F.desc("ref_id"))
    top = scores.withColumn("k", F.row_number().over(w)).where("k <= 2").groupBy("query_id").agg(F.max(F.when(F.col("k") == 1, F.struct("entity", "similarity"))).alias("t"), F.max(F.when(F.col("k") == 2, F.struct("entity", "similarity"))).alias("s"))
    gap = F.col("t.similarity") - F.col("s.similarity")
    verdict = F.when(F.col("t.similarity") < threshold, "no match").when(gap < margin, "inconclusive").otherwise("match")
    return top.select("query_id", verdict.alias("verdict"), F.col("t.entity").alias("entity"), F.col("t.similarity").alias("similarity"), F.col("s.entity").alias("runner_up"), F.coalesce(gap, F.lit(0.0)).alias("margin"))


def shortlist(scores: DataFrame, k: int = 5) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.desc("similarity"), F.desc("ref_id"))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# ---- queries ------------------------------------------------------------------------------------


def sign_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and the signs of its vector as a 64-bit hex hash."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    bits = F.array_join(F.transform("embedding", lambda x: F.when(x >= 0, "1").otherwise("0")), "")
    return e.select("vec_id", F.concat(*(F.lpad(F.lower(F.conv(F.substring(bits, 1 + 32 * i, 32), 2, 16)), 8, "0") for i in range(2))).alias("h"))


RADIUS = 16


def hamming_pairs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_pairs(sign_hashes(spark, sf_dir), "vec_id", "h", RADIUS)


def near_dup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_multi(sign_hashes(spark, sf_dir), "vec_id", ["h"], RADIUS + 2)


def pair_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = hamming_pairs(sign_hashes(spark, sf_dir), "vec_id", "h", RADIUS + 2)
    return p.select("a", "b", pair_verdict(F.lit(False), F.col("distance") == 0, F.col("distance") - 8).alias("verdict"))


def _entity_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("vector", F.transform("embedding", lambda x: x.cast("double")))
    return e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "vector"), e.where("vec_id % 10 <> 0").select(F.col("vec_id").alias("ref_id"), F.col("label").alias("entity"), "vector")


def entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = entity_verdicts(entity_scores(*_entity_inputs(spark, sf_dir)))
    return v.select("query_id", "verdict", "entity", F.round("similarity", 4).alias("similarity"))


def entity_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shortlist(entity_scores(*_entity_inputs(spark, sf_dir)))
    return s.select("query_id", "rank", "entity", F.round("similarity", 4).alias("similarity"))


def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with their number of references, entities without any included."""
    names = spark.range(12).select(F.col("id").cast("int").alias("entity"))
    refs = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").alias("entity"), "vec_id")
    return names.join(refs, "entity", "left").groupBy("entity").agg(F.count("vec_id").alias("refs"))


def text_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.sha2("text", 256).alias("digest"), "doc_id"), "digest", "doc_id").select("digest", "n", F.array_join("members", ",").alias("members"))


def exact_duplicates(df: DataFrame, digest: str, id_col: str) -> DataFrame:
    """Groups of more than one row with an equal, non-empty digest; members sorted."""
    g = df.where(F.col(digest).isNotNull() & (F.col(digest) != "")).groupBy(F.col(digest).alias("digest"))
    return g.agg(F.array_sort(F.collect_list(id_col)).alias("members"), F.count("*").alias("n")).where("n > 1")


def without(groups: DataFrame, other: DataFrame, members: str = "members") -> DataFrame:
    """Groups whose sorted member list is not also a group of ``other``."""
    return groups.join(other.select(members), members, "left_anti")


def not_within(clusters: DataFrame, exact: DataFrame, cluster: str = "cluster", id_col: str = "id") -> DataFrame:
    """Clusters with a member outside every exact group (exact: column id)."""
    marked = clusters.join(exact.select(id_col).distinct().withColumn("__in", F.lit(1)), id_col, "left")
    fresh = marked.groupBy(cluster).agg(F.max(F.col("__in").isNull()).alias("__new")).where("__new").select(cluster)
    return clusters.join(fresh, cluster, "left_semi")


_H = "h AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1 ELSE 0 END) AS b FROM embeddings)"
_P = _H + f", p AS (SELECT x.vec_id AS a, y.vec_id AS b, CAST(list_sum(list_transform(list_zip(x.b, y.b), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS INT) AS distance FROM h x JOIN h y ON x.vec_id < y.vec_id)"
_S = "q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 10 = 0), r AS (SELECT vec_id AS ref_id, label AS entity, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 10 <> 0), s AS (SELECT query_id, entity, list_dot_product(q.v, r.v) AS similarity, ref_id FROM q, r), b AS (SELECT query_id, entity, max(similarity) AS similarity, arg_max(ref_id, similarity) AS ref_id FROM s GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, ref_id DESC) AS rank FROM b)"

QUERIES = {"hamming_pairs": hamming_pairs_query, "near_dup_clusters": near_dup_clusters, "pair_verdict": pair_verdicts, "entity_search": entity_search, "entity_top5": entity_top5, "entity_counts": entity_counts, "exact_duplicates": text_duplicates}
SQL = {
    "hamming_pairs": f"WITH {_P} SELECT a, b, distance FROM p WHERE distance <= {RADIUS}",
    "near_dup_clusters": f"WITH RECURSIVE {_P}, e AS (SELECT a AS u, b AS v FROM p WHERE distance <= {RADIUS + 2} UNION SELECT b, a FROM p WHERE distance <= {RADIUS + 2}), c AS (SELECT DISTINCT u AS node, u AS r FROM e UNION SELECT e.v, c.r FROM c JOIN e ON e.u = c.node), l AS (SELECT node AS id, min(r) AS cluster FROM c GROUP BY node) SELECT cluster, id, CASE WHEN id = cluster THEN 0 ELSE coalesce(distance, {RADIUS + 2}) END AS distance, id = cluster OR distance IS NOT NULL AS is_direct FROM l LEFT JOIN (SELECT * FROM p WHERE distance <= {RADIUS + 2}) p ON p.a = cluster AND p.b = id",
    "pair_verdict": f"WITH {_P} SELECT a, b, CASE WHEN distance = 0 THEN 'identical pixels' WHEN distance - 8 <= 4 THEN 'near-identical' WHEN distance - 8 <= 10 THEN 'similar' ELSE 'different' END AS verdict FROM p WHERE distance <= {RADIUS + 2}",
    "entity_search": f"WITH {_S} SELECT a.query_id, CASE WHEN a.similarity < 0.363 THEN 'no match' WHEN a.similarity - b.similarity < 0.05 THEN 'inconclusive' ELSE 'match' END AS verdict, a.entity, round(a.similarity, 4) AS similarity FROM k a LEFT JOIN k b ON a.query_id = b.query_id AND b.rank = 2 WHERE a.rank = 1",
    "entity_top5": f"WITH {_S} SELECT query_id, CAST(rank AS INT) AS rank, entity, round(similarity, 4) AS similarity FROM k WHERE rank <= 5",
    "entity_counts": "SELECT CAST(n.e AS INT) AS entity, count(vec_id) AS refs FROM range(12) n(e) LEFT JOIN embeddings ON label = n.e GROUP BY n.e",
    "exact_duplicates": "SELECT sha256(text) AS digest, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS members FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
}
