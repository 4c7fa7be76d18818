"""Sensitive-data scan: patterns, validators, one hit per (document, type, value), masked findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks
from ..functions.regex import context, find_spans

# Type, label, pattern, severity, confidence, detail, in scan order.
PATTERNS = (
    ("email", "Email address", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "medium", 0.9, "Directly identifying and contactable"),
    ("credit_card", "Payment card number", r"\b(?:\d[ \-]?){13,19}\b", "high", 0.85, "Passes the Luhn checksum — treat as a live card number"),
    ("iban", "Bank account (IBAN)", r"\b[A-Z]{2}\d{2}[ ]?(?:[A-Z0-9]{4}[ ]?){2,7}[A-Z0-9]{1,4}\b", "high", 0.9, "Passes the mod-97 checksum"),
    ("jwt", "JSON Web Token", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{0,}", "high", 0.95, "A bearer token — may still grant access"),
    ("aws_key", "AWS access key ID", r"\b(?:AKIA|ASIA|AIDA|AROA)[0-9A-Z]{16}\b", "high", 0.95, "Cloud credential"),
    ("github_token", "GitHub token", r"\bgh[pousr]_[A-Za-z0-9]{20,}\b", "high", 0.95, "Source-control credential"),
    ("generic_secret", "API key or secret", r"(?i)\b(?:sk|pk|api|key|token|secret)[-_][A-Za-z0-9]{16,}\b", "high", 0.6, "Key-shaped, high-entropy string"),
    ("us_ssn", "US Social Security number", r"\b(?!000|666|9\d\d)\d{3}[- ](?!00)\d{2}[- ](?!0000)\d{4}\b", "high", 0.75, "US national identifier"),
    ("uk_nino", "UK National Insurance number", r"\b[A-CEGHJ-PR-TW-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D]\b", "high", 0.7, "UK national identifier"),
    ("ipv4", "IP address", r"\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b", "low", 0.7, "Network address — may reveal infrastructure"),
    ("btc_address", "Bitcoin address", r"\b(?:bc1[a-z0-9]{25,62}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})\b", "medium", 0.7, "Traceable on-chain"),
    ("eth_address", "Ethereum address", r"\b0x[a-fA-F0-9]{40}\b", "medium", 0.85, "Traceable on-chain"),
    ("uk_postcode", "UK postcode", r"\b[A-Z]{1,2}\d[A-Z\d]?[ ]?\d[A-Z]{2}\b", "medium", 0.75, "Narrows an address to a handful of properties"),
)
#: Fixed value: phones are found behind a keyword and need seven digits.
PHONE = r"(?i)(?:tel|phone|mobile|cell|fax|whatsapp)[\s.:]*([+\d][\d\s().\-]{7,20})"
_RANK = "map('high', 0, 'medium', 1, 'low', 2, 'info', 3)"


def _passes(key: str, value: Column) -> Column:
    return {"credit_card": checks.luhn_valid, "iban": checks.iban_valid, "generic_secret": checks.high_entropy}.get(key, lambda v: F.lit(True))(value)


def _hit(order: int, pattern: tuple):
    key, label, rx, severity, confidence, detail = pattern

    def one(m: Column) -> Column:
        value = F.trim(F.regexp_extract(m["value"], "(?U)" + rx, 1) if key == "phone" else m["value"])
        fixed = (F.lit(order).alias("order"), F.lit(key).alias("type"), F.lit(label).alias("label"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), F.lit(detail).alias("detail"))
        return F.struct(*fixed, value.alias("value"), m["start"].alias("start"), m["end"].alias("end"))

    return one


def _keeps(key: str):
    return lambda h: _passes(key, h["value"])


def _maybe(key: str, text: Column) -> Column:
    """Cheap necessary conditions keep the slower patterns off texts that cannot match."""
    if key == "email":
        return text.contains("@")
    if key in ("jwt", "eth_address"):
        return text.contains("eyJ" if key == "jwt" else "0x")
    return F.lit(True) if key == "generic_secret" else text.rlike("[0-9]")


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per hit: id, type, label, value, masked, severity, confidence, detail, brand, context, position.

    Hits repeat a (type, value) of their document only once, at its first place. One pass over the
    texts without a shuffle: the de-duplication works inside each document's array.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    empty = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    found = base.select("id", "text", *(F.when(_maybe(key, F.col("text")), find_spans(F.col("text"), "(?U)" + rx)).otherwise(empty).alias(key) for key, _, rx, *_ in PATTERNS), F.when(F.col("text").rlike("[0-9]"), find_spans(F.col("text"), "(?U)" + PHONE)).otherwise(empty).alias("phone"))
    arrays = [F.filter(F.transform(p[0], _hit(order, p)), _keeps(p[0])) for order, p in enumerate(PATTERNS)]
    phone = F.transform("phone", _hit(len(PATTERNS), ("phone", "Phone number", PHONE, "medium", 0.6, "Matched by keyword")))
    arrays.append(F.filter(phone, lambda h: F.length(checks.digits(h["value"])) >= 7))
    hits = found.select("id", "text", F.concat(*arrays).alias("hits"))
    seen = lambda x: F.filter(x["hits"], lambda h, i: F.array_position(x["keys"], F.struct(h["type"], h["value"])) == i + 1)
    keyed = F.struct(F.col("hits").alias("hits"), F.transform("hits", lambda x: F.struct(x["type"], x["value"])).alias("keys"))
    first = F.get(F.transform(F.array(keyed), seen), 0)
    # The outer form keeps Catalyst from pushing a second evaluation of the arrays below it.
    out = hits.select("id", "text", F.posexplode_outer(first).alias("position", "h")).where("h is not null")
    h = lambda n: F.col(f"h.{n}")
    return out.select("id", h("type"), h("label"), h("value"), checks.mask(h("value"), h("type")).alias("masked"), h("severity"), h("confidence"), h("detail"), F.when(h("type") == "credit_card", checks.card_brand(h("value"))).alias("brand"), context(F.col("text"), h("start"), h("end")).alias("context"), "position")


def findings(hits: DataFrame) -> DataFrame:
    """Findings of scanned documents: a rollup first, then a masked finding per hit.

    Columns: id, category, label, value, severity, confidence, detail, position.
    """
    counts = hits.groupBy("id", "type").agg(F.count("*").alias("n"), F.max((F.col("severity") == "high").cast("int")).alias("high"))
    rollup = counts.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "n"))), lambda x: F.concat(x["type"], F.lit(" x"), x["n"])), ", ").alias("value"), F.max("high").alias("high"))
    rollup = rollup.select("id", F.lit("sensitive").alias("category"), F.lit("Sensitive information visible").alias("label"), "value", F.when(F.col("high") == 1, "high").otherwise("medium").alias("severity"), F.lit(0.85).alias("confidence"), F.lit("Values are masked here; the matches hold them in full").alias("detail"), F.lit(-1).alias("position"))
    return rollup.unionByName(hits.select("id", F.lit("sensitive").alias("category"), "label", F.col("masked").alias("value"), "severity", "confidence", "detail", "position"))


def summarise(found: DataFrame) -> DataFrame:
    """One row per document: counts by severity, categories, and its four most severe findings in order."""
    rank = F.element_at(F.expr(_RANK), F.col("severity"))
    entry = F.struct(rank.alias("r"), "category", "label", "position", "severity", "value")
    g = found.groupBy("id").agg(F.count("*").alias("findings_total"), *(F.count_if(F.col("severity") == s).alias(f"findings_{s}") for s in ("high", "medium", "low", "info")), F.array_sort(F.collect_list(entry)).alias("f"))
    notable = F.slice(F.filter("f", lambda x: x["r"] <= 1), 1, 4)
    return g.withColumn("top_findings", F.array_join(F.transform(notable, lambda x: F.concat(x["label"], F.coalesce(F.concat(F.lit("="), x["value"]), F.lit("")))), "; ")).drop("f")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def pii_scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_docs(spark, sf_dir), "doc_id", "text").groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("id").alias("docs"))


def pii_masked_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_docs(spark, sf_dir), "doc_id", "text").select(F.col("id").alias("doc_id"), "type", "masked", "severity", "confidence")


def card_brand_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_docs(spark, sf_dir), "doc_id", "text").where("type = 'credit_card'").groupBy("brand").agg(F.count("*").alias("n"))


def doc_findings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise(findings(scan(_docs(spark, sf_dir), "doc_id", "text"))).withColumnRenamed("id", "doc_id")


def page_pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    return scan(pages, "page_id", "html").groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("id").alias("docs"))


_LUHN = "list_sum(list_transform(range(1, length({d}) + 1), lambda i: (CASE WHEN i % 2 = 1 THEN CAST(reverse({d})[i] AS INT) ELSE (CASE WHEN CAST(reverse({d})[i] AS INT) > 4 THEN CAST(reverse({d})[i] AS INT) * 2 - 9 ELSE CAST(reverse({d})[i] AS INT) * 2 END) END))) % 10 = 0"
_ENTROPY = "list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: -(len(list_filter(string_split(v, ''), lambda y: y = c)) / length(v)) * log2(len(list_filter(string_split(v, ''), lambda y: y = c)) / length(v)))) >= 3.4"


def _scan_sql(table: str, key: str, text: str) -> str:
    """The scan in DuckDB: its regex engine has no lookahead, so SSNs are filtered afterwards."""
    parts = []
    for order, (kind, label, rx, sev, conf, _) in enumerate(PATTERNS):
        flags = "'i'" if rx.startswith("(?i)") else "''"
        plain = r"\b\d{3}[- ]\d{2}[- ]\d{4}\b" if kind == "us_ssn" else rx.removeprefix("(?i)")
        parts.append(f"SELECT {key} AS id, {order} AS ord, '{kind}' AS type, '{label}' AS label, '{sev}' AS severity, CAST({conf} AS DOUBLE) AS confidence, unnest(regexp_extract_all({text}, '{plain}', 0, {flags})) AS raw FROM {table}")
    parts.append(f"SELECT {key}, {len(PATTERNS)}, 'phone', 'Phone number', 'medium', CAST(0.6 AS DOUBLE), unnest(regexp_extract_all({text}, '{PHONE.removeprefix('(?i)')}', 1, 'i')) FROM {table}")
    luhn = _LUHN.format(d="d")
    return (
        "WITH raw AS (" + " UNION ALL ".join(parts) + "), cut AS (SELECT *, trim(raw) AS v, regexp_replace(raw, '[^0-9]', '', 'g') AS d FROM raw), "
        f"ok AS (SELECT * FROM cut WHERE CASE WHEN type = 'credit_card' THEN length(d) BETWEEN 13 AND 19 AND {luhn} WHEN type = 'phone' THEN length(d) >= 7 WHEN type = 'generic_secret' THEN {_ENTROPY} "
        "WHEN type = 'us_ssn' THEN NOT regexp_matches(v, '^(000|666|9)') AND NOT regexp_matches(v, '^...[- ]00') AND NOT regexp_matches(v, '0000$') ELSE true END), "
        "hits AS (SELECT DISTINCT id, ord, type, label, severity, confidence, v, d FROM ok), "
        "m AS (SELECT *, CASE WHEN type = 'email' THEN left(v, CASE WHEN instr(v, '@') > 4 THEN 2 ELSE 1 END) || repeat('*', greatest(3, instr(v, '@') - 1 - CASE WHEN instr(v, '@') > 4 THEN 2 ELSE 1 END)) || substr(v, instr(v, '@')) "
        "WHEN type IN ('credit_card', 'iban') THEN left(regexp_replace(v, '[\\s-]', '', 'g'), 4) || repeat('*', greatest(4, length(regexp_replace(v, '[\\s-]', '', 'g')) - 8)) || right(regexp_replace(v, '[\\s-]', '', 'g'), 4) "
        "WHEN length(v) <= 8 THEN left(v, 1) || repeat('*', length(v) - 1) "
        "ELSE left(v, greatest(3, length(v) // 5)) || repeat('*', length(v) - 2 * greatest(3, length(v) // 5)) || right(v, greatest(3, length(v) // 5)) END AS masked FROM hits) "
    )


_BRAND = "CASE WHEN d LIKE '4%' THEN 'Visa' WHEN left(d, 2) IN ('34', '37') THEN 'American Express' WHEN CAST(left(d, 2) AS INT) BETWEEN 51 AND 55 OR CAST(left(d, 4) AS INT) BETWEEN 2221 AND 2720 THEN 'Mastercard' WHEN left(d, 4) = '6011' OR left(d, 2) = '65' THEN 'Discover' ELSE 'unknown issuer' END"
_SCAN = _scan_sql("documents", "doc_id", "text")
# Findings of equal severity and label order by the hit's place; its first place is that of the value in the text.
_SUMMARY = (
    _SCAN
    + ", placed AS (SELECT m.*, row_number() OVER (PARTITION BY id ORDER BY ord, instr(text, v)) AS pos FROM m JOIN documents ON doc_id = id), "
    "f AS (SELECT id, label, masked AS value, severity, pos FROM placed UNION ALL "
    "SELECT id, 'Sensitive information visible', string_agg(type || ' x' || n, ', ' ORDER BY type), CASE WHEN bool_or(h) THEN 'high' ELSE 'medium' END, 0 FROM (SELECT id, type, count(*) AS n, bool_or(severity = 'high') AS h FROM m GROUP BY id, type) GROUP BY id), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, label, pos) AS k FROM f) "
    "SELECT id AS doc_id, count(*) AS findings_total, count(*) FILTER (severity = 'high') AS findings_high, count(*) FILTER (severity = 'medium') AS findings_medium, count(*) FILTER (severity = 'low') AS findings_low, count(*) FILTER (severity = 'info') AS findings_info, "
    "coalesce(string_agg(label || '=' || value, '; ' ORDER BY k) FILTER (severity IN ('high', 'medium') AND k <= 4), '') AS top_findings FROM r GROUP BY id"
)

QUERIES = {"pii_scan_counts": pii_scan_counts, "pii_masked_findings": pii_masked_findings, "card_brand_counts": card_brand_counts, "doc_findings_summary": doc_findings_summary, "page_pii_counts": page_pii_counts}
SQL = {
    "pii_scan_counts": _SCAN + "SELECT type, count(*) AS n, count(DISTINCT id) AS docs FROM m GROUP BY type",
    "pii_masked_findings": _SCAN + "SELECT id AS doc_id, type, masked, severity, confidence FROM m",
    "card_brand_counts": _SCAN + f"SELECT {_BRAND} AS brand, count(*) AS n FROM m WHERE type = 'credit_card' GROUP BY 1",
    "doc_findings_summary": _SUMMARY,
    "page_pii_counts": _scan_sql("pages", "page_id", "html") + "SELECT type, count(*) AS n, count(DISTINCT id) AS docs FROM m GROUP BY type",
}
