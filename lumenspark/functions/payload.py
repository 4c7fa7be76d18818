"""What a decoded barcode or link says: one struct of typed fields per payload, by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Hosts that hide a destination, schemes of coins, and what flags mean.
SHORTENERS = ("bit.ly", "t.co", "goo.gl", "tinyurl.com", "ow.ly", "is.gd", "buff.ly", "adf.ly", "cutt.ly", "rebrand.ly", "shorturl.at", "rb.gy", "tiny.cc", "s.id")
CHAINS = ("bitcoin", "ethereum", "litecoin", "monero", "bitcoincash", "ton")
FLAG_TEXT = {
    "insecure_scheme": "plain HTTP",
    "url_shortener": "shortened link hides the real destination",
    "ip_literal_host": "bare IP address instead of a domain",
    "punycode_host": "punycode host — check for lookalike characters",
    "credentials_in_url": "credentials embedded in the URL",
    "nonstandard_port": "non-standard port",
}


def payload_kind(text: Column) -> Column:
    raw = F.trim(text)
    low = F.lower(raw)
    starts = lambda *p: F.coalesce(low.rlike("^(" + "|".join(p) + ")"), F.lit(False))
    return (
        F.when(starts("wifi:"), "wifi")
        .when(starts("otpauth://"), "otpauth")
        .when(starts("begin:vcard", "mecard:"), "contact")
        .when(starts("geo:"), "geo")
        .when(starts("mailto:"), "email")
        .when(starts("tel:", "sms:", "smsto:"), "phone")
        .when(F.substring_index(low, ":", 1).isin(*CHAINS), "crypto")
        .when(starts("http://", "https://"), "url")
        .when(raw.rlike(r"^\d{8,14}$"), "product_code")
        .otherwise("text")
    )


def url_parts(url: Column) -> Column:
    """scheme, user_info, host, port, path, query and top-level domain; a port that is no number is null."""
    raw = F.trim(url)
    authority = F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    at = F.when(authority.contains("@"), F.substring_index(authority, "@", -1)).otherwise(authority)
    host = F.lower(F.when(at.startswith("["), F.regexp_extract(at, r"^\[([^\]]*)\]", 1)).otherwise(F.substring_index(at, ":", 1)))
    port = F.regexp_extract(at, r":(\d+)$", 1).try_cast("int")
    rest = F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.struct(
        F.lower(F.substring_index(raw, "://", 1)).alias("scheme"),
        F.when(authority.contains("@"), F.regexp_extract(authority, r"^(.*)@", 1)).alias("user_info"),
        host.alias("host"),
        F.when(port.between(0, 65535), port).alias("port"),
        rest.alias("path"),
        F.regexp_extract(raw, r"\?([^#]*)", 1).alias("query"),
        F.when(host.contains("."), F.substring_index(host, ".", -1)).alias("tld"),
    )


def url_flags(parts: Column) -> Column:
    """The warning flags of url_parts, in fixed order."""
    host, port = parts["host"], parts["port"]
    tests = {
        "insecure_scheme": parts["scheme"] == "http",
        "url_shortener": host.isin(*SHORTENERS),
        "ip_literal_host": host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"),
        "punycode_host": host.startswith("xn--") | host.contains(".xn--"),
        "credentials_in_url": F.coalesce(F.length(parts["user_info"]) > 0, F.lit(False)),
        "nonstandard_port": F.coalesce((port != 0) & ~port.isin(80, 443), F.lit(False)),
    }
    return F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items())))


def flag_text(flags: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in FLAG_TEXT.items() for x in kv))
    return F.array_join(F.transform(flags, lambda f: F.coalesce(F.try_element_at(known, f), f)), "; ")


def wifi_fields(text: Column) -> Column:
    """ssid, password, auth and hidden of a WIFI: payload; separators may be escaped."""
    parts = F.split(F.substr(F.trim(text), F.lit(6)), r"(?<!\\);")

    def field(key: str) -> Column:
        hits = F.filter(parts, lambda p: F.upper(F.substring_index(p, ":", 1)) == key)
        value = F.regexp_replace(F.try_element_at(hits, F.lit(-1)), "^[^:]*:?", "")
        return F.replace(F.replace(value, F.lit("\\;"), F.lit(";")), F.lit("\\:"), F.lit(":"))

    auth = field("T")
    return F.struct(field("S").alias("ssid"), field("P").alias("password"), F.when(F.length(auth) > 0, auth).otherwise("nopass").alias("auth"), F.coalesce(F.lower(field("H")) == "true", F.lit(False)).alias("hidden"))


def otpauth_fields(text: Column) -> Column:
    u = url_parts(text)
    arg = lambda k: F.nullif(F.regexp_extract(u["query"], f"(?:^|&){k}=([^&]*)", 1), F.lit(""))
    return F.struct(u["host"].alias("type"), F.try_url_decode(F.regexp_replace(u["path"], "^/+", "")).alias("label"), arg("issuer").alias("issuer"), arg("secret").isNotNull().alias("secret_present"), F.coalesce(arg("algorithm"), F.lit("SHA1")).alias("algorithm"))


def contact_fields(text: Column) -> Column:
    get = lambda rx: F.nullif(F.trim(F.regexp_extract(text, "(?i)" + rx, 1)), F.lit(""))
    return F.struct(get(r"(?:^|\n)(?:FN|N):([^\n;]+)").alias("name"), get(r"(?:^|\n|;)EMAIL[^:]*:([^\n;]+)").alias("email"), get(r"(?:^|\n|;)TEL[^:]*:([^\n;]+)").alias("phone"), get(r"(?:^|\n)ORG:([^\n;]+)").alias("org"))


def geo_fields(text: Column) -> Column:
    body = F.split(F.substring_index(F.substr(F.trim(text), F.lit(5)), "?", 1), ",")
    lat, lon = F.trim(F.get(body, 0)).try_cast("double"), F.trim(F.get(body, 1)).try_cast("double")
    both = lat.isNotNull() & lon.isNotNull()
    return F.struct(F.when(both, lat).alias("latitude"), F.when(both, lon).alias("longitude"))


def interpret(df: DataFrame, text_col: str) -> DataFrame:
    """df plus ``payload``: kind and the fields of its kind, others null. Null texts are of kind text."""
    raw, text = F.trim(F.coalesce(F.col(text_col), F.lit(""))), F.coalesce(F.col(text_col), F.lit(""))
    kind = payload_kind(text)
    only = lambda k, c: F.when(kind == k, c)
    after = F.substring_index(F.regexp_replace(raw, "^[^:]*:", ""), "?", 1)
    u = url_parts(text)
    return df.withColumn(
        "payload",
        F.struct(
            kind.alias("kind"),
            only("wifi", wifi_fields(text)).alias("wifi"),
            only("otpauth", otpauth_fields(text)).alias("otpauth"),
            only("contact", contact_fields(raw)).alias("contact"),
            only("geo", geo_fields(text)).alias("geo"),
            F.when(kind.isin("email", "phone", "crypto"), after).alias("address"),
            only("crypto", F.lower(F.substring_index(raw, ":", 1))).alias("chain"),
            only("url", u).alias("url"),
            only("url", url_flags(u)).alias("flags"),
            F.when(kind == "product_code", raw).when(kind == "text", F.left(raw, F.lit(500))).alias("value"),
        ),
    )


def payload_finding(payload: Column, text: Column, fmt: Column) -> Column:
    """The finding of a payload: category, label, value, severity, confidence, detail."""
    k = payload["kind"]
    flags = F.size(payload["flags"]) > 0
    one = lambda cat, label, value, sev, conf, detail: F.struct(F.lit(cat).alias("category"), label.alias("label"), value.cast("string").alias("value"), (sev if isinstance(sev, Column) else F.lit(sev)).alias("severity"), F.lit(conf).alias("confidence"), detail.cast("string").alias("detail"))
    who = F.coalesce(payload["contact"]["name"], payload["address"])
    return (
        F.when(k == "wifi", one("credentials", F.lit("WiFi credentials in QR code"), F.concat(F.lit("SSID "), F.coalesce(payload["wifi"]["ssid"], F.lit("None")), F.lit(" ("), payload["wifi"]["auth"], F.lit(")")), "high", 0.95, F.lit("The network password is embedded in the code and recoverable from this image")))
        .when(k == "otpauth", F.when(payload["otpauth"]["secret_present"], one("credentials", F.lit("Two-factor authentication seed in QR code"), F.coalesce(F.nullif(payload["otpauth"]["label"], F.lit("")), payload["otpauth"]["issuer"]), "high", 0.95, F.lit("Anyone with this image can generate valid TOTP codes for that account"))).otherwise(one("codes", F.concat(fmt, F.lit(" payload")), F.left(text, F.lit(120)), "info", 1.0, F.lit(None))))
        .when(k == "url", one("codes", F.lit("URL in code"), F.left(F.trim(text), F.lit(120)), F.when(flags, "medium").otherwise("info"), 1.0, F.when(flags, flag_text(payload["flags"])).otherwise(F.concat(F.lit("Host: "), payload["url"]["host"]))))
        .when(k == "crypto", one("codes", F.lit("Cryptocurrency address in code"), F.concat(payload["chain"], F.lit(": "), payload["address"]), "medium", 1.0, F.lit("Traceable on-chain; commonly seen in payment demands and scams")))
        .when(k.isin("contact", "email", "phone"), one("attribution", F.concat(F.lit("Contact details in code ("), k, F.lit(")")), who, "medium", 1.0, F.lit("Personally identifying information encoded in the image")))
        .when(k == "geo", one("location", F.lit("Coordinates in code"), F.concat_ws(", ", payload["geo"]["latitude"], payload["geo"]["longitude"]), "high", 1.0, F.lit(None)))
        .otherwise(one("codes", F.concat(fmt, F.lit(" payload")), F.left(payload["value"], F.lit(120)), "info", 1.0, F.lit(None)))
    )


# Texts beside the page URLs, so that every kind and flag occurs.
SAMPLES = (
    "WIFI:T:WPA;S:cafe;P:secret;H:true;;", "otpauth://totp/Example:alice?secret=JBSWY3DP&issuer=Example", "MECARD:N:Ada;EMAIL:ada@example.org;;",
    "geo:48.8584,2.2945", "mailto:ada@example.org?subject=x", "tel:+441234567890", "bitcoin:1BoatSLRHtKNngkdXEeobR76b53LETtpyT?amount=1",
    "https://bit.ly/abc", "http://192.168.0.1:8080/admin", "https://xn--pple-43d.com/", "https://user:pw@example.org/x", "https://example.org:443/", "5901234123457", "plain words", "geo:north,pole",
)


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("text"))
    return pages.unionByName(spark.createDataFrame([(s,) for s in SAMPLES], "text string"))


def payload_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inputs(spark, sf_dir).groupBy(payload_kind(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


def url_flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = interpret(_inputs(spark, sf_dir), "text").where("payload.kind = 'url'")
    return out.select(F.explode("payload.flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def url_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = interpret(_inputs(spark, sf_dir), "text").where("payload.kind = 'url'").select("text", "payload.url.*", F.array_join("payload.flags", ",").alias("flags"))
    return u.select("text", "scheme", "host", F.col("port").cast("string").alias("port"), "path", "tld", "flags").distinct()


def payload_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = interpret(_inputs(spark, sf_dir), "text").select(payload_finding(F.col("payload"), F.col("text"), F.lit("QR_CODE")).alias("f"))
    return out.groupBy(F.col("f.category").alias("category"), F.col("f.severity").alias("severity")).agg(F.count("*").alias("n"))


_SQL_IN = "WITH t AS (SELECT url AS text FROM pages UNION ALL SELECT * FROM (VALUES " + ", ".join(f"('{s}')" for s in SAMPLES) + ") v(text)), "
_SQL_KIND = "k AS (SELECT *, CASE WHEN lower(text) LIKE 'wifi:%' THEN 'wifi' WHEN lower(text) LIKE 'otpauth://%' THEN 'otpauth' WHEN lower(text) LIKE 'begin:vcard%' OR lower(text) LIKE 'mecard:%' THEN 'contact' WHEN lower(text) LIKE 'geo:%' THEN 'geo' WHEN lower(text) LIKE 'mailto:%' THEN 'email' WHEN regexp_matches(lower(text), '^(tel|sms|smsto):') THEN 'phone' WHEN split_part(lower(text), ':', 1) IN (" + ", ".join(f"'{c}'" for c in CHAINS) + ") THEN 'crypto' WHEN regexp_matches(lower(text), '^https?://') THEN 'url' WHEN regexp_matches(text, '^\\d{8,14}$') THEN 'product_code' ELSE 'text' END AS kind FROM t), "
_SQL_URL = (
    "a AS (SELECT text, kind, lower(split_part(text, '://', 1)) AS scheme, regexp_extract(text, '://([^/?#]*)', 1) AS auth, regexp_extract(text, '://[^/?#]*([^?#]*)', 1) AS path FROM k WHERE kind = 'url'), "
    "h AS (SELECT *, lower(split_part(regexp_replace(auth, '^.*@', ''), ':', 1)) AS host, TRY_CAST(regexp_extract(auth, ':(\\d+)$', 1) AS INT) AS port FROM a), "
    "u AS (SELECT *, CASE WHEN contains(host, '.') THEN regexp_extract(host, '[^.]*$') END AS tld, list_filter([CASE WHEN scheme = 'http' THEN 'insecure_scheme' END, CASE WHEN host IN (" + ", ".join(f"'{c}'" for c in SHORTENERS) + ") THEN 'url_shortener' END, CASE WHEN regexp_matches(host, '^\\d{1,3}(\\.\\d{1,3}){3}$') THEN 'ip_literal_host' END, CASE WHEN host LIKE 'xn--%' OR contains(host, '.xn--') THEN 'punycode_host' END, CASE WHEN contains(auth, '@') THEN 'credentials_in_url' END, CASE WHEN port NOT IN (80, 443, 0) THEN 'nonstandard_port' END], lambda x: x IS NOT NULL) AS flags FROM h) "
)

QUERIES = {"payload_kind_counts": payload_kind_counts, "url_flags": url_flag_counts, "url_fields": url_fields, "payload_findings": payload_findings}
SQL = {
    "payload_kind_counts": _SQL_IN + _SQL_KIND.rstrip(", ") + " SELECT kind, count(*) AS n FROM k GROUP BY kind",
    "url_flags": _SQL_IN + _SQL_KIND + _SQL_URL + "SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM u) GROUP BY flag",
    "url_fields": _SQL_IN + _SQL_KIND + _SQL_URL + "SELECT DISTINCT text, scheme, host, CAST(port AS VARCHAR) AS port, path, tld, array_to_string(flags, ',') AS flags FROM u",
    "payload_findings": _SQL_IN + _SQL_KIND + _SQL_URL
    + "SELECT CASE WHEN k.kind IN ('wifi', 'otpauth') THEN 'credentials' WHEN k.kind IN ('contact', 'email', 'phone') THEN 'attribution' WHEN k.kind = 'geo' THEN 'location' ELSE 'codes' END AS category, CASE WHEN k.kind IN ('wifi', 'otpauth', 'geo') THEN 'high' WHEN k.kind IN ('contact', 'email', 'phone', 'crypto') OR (k.kind = 'url' AND len((SELECT any_value(flags) FROM u WHERE u.text = k.text)) > 0) THEN 'medium' ELSE 'info' END AS severity, count(*) AS n FROM k GROUP BY ALL",
}
