"""Personal data by weak supervision, with DataFrame functions only.

Patterns propose spans; regex, gazetteer and context labelers vote on each; expectation-maximisation
over the (few) distinct vote patterns estimates how reliable every labeler is, and a logistic span
classifier is trained on the resulting soft labels. Only the table of vote patterns, whose size is
bounded by kinds x 3^labelers, reaches the driver. Spans of the four base kinds that pass their rule
always stay; the classifier decides about the rest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read

#: Kinds in the order that breaks ties between spans; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "secret", "account")
LABELERS = ("form", "gazetteer", "context", "edge", "plausible")
ACCEPT = 0.5

# Possessive throughout: the same matches as with plain quantifiers, without backtracking or deep
# recursion. A start inside a run of label characters is only tried where the last match ended.
_LABEL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LABEL})){_LABEL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])(?=[0-9_]*+[A-Za-z])[A-Za-z0-9_]{16,}+",
    "account": r"(?<![0-9A-Za-z_.])(?<![0-9][ -])(?<!\+)[0-9](?:[ -]?+[0-9]){6,12}+(?![ -]?[0-9])(?![A-Za-z_])",
}
# Words that announce personal data, by kind, and gazetteers.
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|host|server|address|adresse|dirección",
    "card": "card|visa|mastercard|karte|carte|tarjeta|credit",
    "phone": "phone|tel|call|mobile|telefon|téléphone|teléfono|fax",
    "secret": "token|secret|password|passwd|api|key|auth|bearer",
    "account": "account|iban|konto|compte|cuenta|ssn|id|number|nummer|numéro|número",
}
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "it", "eu", "us", "ch", "at")
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91")

_SPAN = "struct<s:int,e:int,t:string,l:string,r:string>"


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True where a string of digits passes the Luhn check."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, t: Column) -> Column:
    if kind == "ip":
        return t.rlike(r"^(0*+(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.|$)){4}$") | t.rlike(r"^((0*+(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]?)|0+)(\.|$)){4}$")
    if kind == "card":
        return luhn(_digits(t))
    if kind == "phone":
        return F.length(_digits(t)).between(10, 15)
    return F.lit(True)


def _maybe(kind: str, text: Column) -> Column:
    """A cheap test that holds wherever the pattern can match."""
    return {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike(r"[0-9]\.[0-9]") if kind == "ip" else text.rlike("[0-9]{2}|[0-9][ -][0-9]") if kind in ("card", "account") else text.rlike("[0-9]"))


def _located(kind: str) -> Column:
    """Spans (start, end, text, left and right context) of the hits in columns hits_ and gaps_ of kind."""
    hits, gaps = F.col(f"hits_{kind}"), F.col(f"gaps_{kind}")
    zipped = F.arrays_zip(hits.alias("t"), F.slice(gaps, 1, F.size(hits)).alias("g"), F.slice(gaps, 2, F.size(hits)).alias("h"))

    def step(a: Column, x: Column) -> Column:
        start = a["p"] + F.length(x["1"])
        end = start + F.length(x["0"])
        one = F.struct(start.alias("s"), end.alias("e"), x["0"].alias("t"), F.lower(F.right(x["1"], F.lit(40))).alias("l"), F.left(x["2"], F.lit(1)).alias("r"))
        return F.struct(end.alias("p"), F.concat(a["o"], F.array(one)).alias("o"))

    named = F.transform(zipped, lambda z: F.struct(z["t"].alias("0"), z["g"].alias("1"), z["h"].alias("2")))
    return F.aggregate(named, F.struct(F.lit(0).alias("p"), F.expr(f"cast(array() as array<{_SPAN}>)").alias("o")), step)["o"]


def _votes(kind: str, x: Column, ok: Column) -> dict[str, Column]:
    t, left = x["t"], x["l"]
    n = F.length(_digits(t))
    sign = lambda c: F.when(c, 1).otherwise(-1)
    some = lambda c: F.when(c, 1).otherwise(0)
    gaz = {
        "email": some(F.lower(F.substring_index(t, ".", -1)).isin(*TOP_DOMAINS)),
        "ip": sign(~F.substring_index(t, ".", 1).isin("0", "127", "255")),
        "card": sign(t.rlike("^[3-6]")),
        "phone": some(F.regexp_extract(t, r"^\+([0-9]{1,2})", 1).isin(*CALLING_CODES) | t.startswith("+1")),
        "secret": some(t.rlike("^(AKIA|ghp_|sk_|xox)")),
        "account": some(n.isin(9, 10, 11)),
    }[kind]
    form = {"secret": sign(t.rlike("^[0-9a-f]{32,}$|^[0-9A-F]{32,}$")), "account": sign(t.rlike("^[0-9]+$"))}.get(kind, sign(ok))
    plausible = {
        "email": sign(F.length(F.substring_index(t, "@", 1)) <= 64),
        "ip": sign(~t.rlike(r"(^|\.)0[0-9]")),
        "card": some(n.isin(15, 16)),
        "phone": some(n.between(10, 13)),
        "secret": sign(F.size(F.array_distinct(F.split(t, ""))) >= 8),
        "account": sign(~t.startswith("0")),
    }[kind]
    context = some(left.rlike(CONTEXT[kind]))
    edge = sign(((left == "") | left.rlike(r"[\s\"'(=:;,|>.]$")) & ((x["r"] == "") | x["r"].rlike(r"[^A-Za-z0-9_@]")))
    return dict(zip(LABELERS, (form, gaz, context, edge, plausible), strict=True))


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs' other columns aside, adds ``cands``: array of (s, k, e, base, votes) for whole texts (null: empty).

    k is the kind's place in KINDS. Spans count code points, end exclusive. A span of an extra kind
    that overlaps a valid base span is no candidate.
    """
    text = F.col("__t")
    out = docs.withColumn("__t", F.coalesce(F.col(text_col), F.lit("")))
    none = F.expr("cast(array() as array<string>)")
    for kind, rx in PATTERNS.items():
        out = out.withColumn(f"hits_{kind}", F.when(_maybe(kind, text), F.regexp_extract_all(text, F.lit(rx), F.lit(0))).otherwise(none))
    out = out.select("*", *(F.when(F.size(f"hits_{k}") > 0, F.split(text, rx, -1)).otherwise(none).alias(f"gaps_{k}") for k, rx in PATTERNS.items()))
    out = out.select("*", *(_located(k).alias(f"spans_{k}") for k in KINDS))

    def judged(kind: str) -> Column:
        base = kind in KINDS[:4]

        def one(x: Column) -> Column:
            ok = _valid(kind, x["t"])
            v = _votes(kind, x, ok)
            return F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"), (ok if base else F.lit(False)).alias("base"), F.struct(*(v[n].alias(n) for n in LABELERS)).alias("v"))

        return F.transform(F.col(f"spans_{kind}"), one)

    out = out.withColumn("__base", F.filter(F.concat(*(judged(k) for k in KINDS[:4])), lambda x: x["base"]))
    out = out.withColumn("__more", F.concat(*(judged(k) for k in KINDS[4:])))
    clash = lambda x: F.exists(F.col("__base"), lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    out = out.withColumn("cands", F.concat("__base", F.filter("__more", lambda x: ~clash(x))))
    return out.drop("__t", "__base", "__more", *(f"{p}_{k}" for p in ("hits", "gaps", "spans") for k in KINDS))


# ---- reliabilities and the span classifier, on the table of vote patterns ----------------------


def estimate(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 60) -> tuple[list[float], list[dict[int, tuple[float, float]]]]:
    """Dawid-Skene for one kind: P(true) per pattern, and per labeler vote -> (P(vote|true), P(vote|false))."""
    post = [1 / (1 + math.exp(-sum(v))) for v, _ in patterns]
    table: list[dict[int, tuple[float, float]]] = []
    for _ in range(rounds):
        yes = sum(c * p for (_, c), p in zip(patterns, post, strict=True))
        no = sum(c * (1 - p) for (_, c), p in zip(patterns, post, strict=True))
        table = []
        for j in range(len(LABELERS)):
            seen: dict[int, tuple[float, float]] = {}
            for vote in (-1, 0, 1):
                a = sum(c * p for (v, c), p in zip(patterns, post, strict=True) if v[j] == vote)
                b = sum(c * (1 - p) for (v, c), p in zip(patterns, post, strict=True) if v[j] == vote)
                seen[vote] = ((a + 1 + max(0, vote)) / (yes + 4), (b + 1 + max(0, -vote)) / (no + 4))
            table.append(seen)
        prior = (yes + 1) / (yes + no + 2)
        new = []
        for v, _ in patterns:
            score = math.log(prior / (1 - prior)) + sum(math.log(t[x][0] / t[x][1]) for t, x in zip(table, v, strict=True))
            new.append(1 / (1 + math.exp(-max(-30.0, min(30.0, score)))))
        if max((abs(a - b) for a, b in zip(new, post, strict=True)), default=0) < 1e-6:
            post = new
            break
        post = new
    return post, table


def train(patterns: list[tuple[tuple[int, ...], float]], soft: list[float], rounds: int = 400) -> list[float]:
    """Logistic weights (bias first) on the votes, fitted to the soft labels; counts are log-damped."""
    w = [0.0] * (len(LABELERS) + 1)
    weights = [math.log1p(c) for _, c in patterns]
    total = sum(weights) or 1.0
    for _ in range(rounds):
        grad = [1e-3 * x for x in w]
        for (v, _), p, c in zip(patterns, soft, weights, strict=True):
            z = w[0] + sum(a * b for a, b in zip(w[1:], v, strict=True))
            g = c / total * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p)
            grad[0] += g
            for j, x in enumerate(v):
                grad[j + 1] += g * x
        w = [a - 1.0 * g for a, g in zip(w, grad, strict=True)]
    return w


def fit(cands: DataFrame) -> dict[str, list[float]]:
    """Weights of each kind's span classifier, from every candidate of the corpus."""
    votes = cands.select(F.explode("cands").alias("c")).groupBy(F.col("c.k").alias("k"), *(F.col(f"c.v.{n}").alias(n) for n in LABELERS)).agg(F.count("*").alias("n"))
    rows: dict[int, list] = {}
    for r in votes.collect():
        rows.setdefault(r["k"], []).append((tuple(r[n] for n in LABELERS), float(r["n"])))
    out = {}
    for k, patterns in rows.items():
        patterns.sort()
        out[KINDS[k]] = train(patterns, estimate(patterns)[0])
    return out


def accepted(weights: dict[str, list[float]]) -> Column:
    """The spans of ``cands`` that stay, sorted by start, kind and end."""

    def keep(x: Column) -> Column:
        z = F.lit(False)
        for kind, w in weights.items():
            logit = F.lit(float(w[0]))
            for name, a in zip(LABELERS, w[1:], strict=True):
                logit = logit + F.lit(float(a)) * x["v"][name]
            z = z | ((x["k"] == KINDS.index(kind)) & (logit >= math.log(ACCEPT / (1 - ACCEPT))))
        return x["base"] | z

    return F.array_sort(F.transform(F.filter(F.col("cands"), keep), lambda x: F.struct(x["s"], x["k"], x["e"], x["base"])))


def find_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs' columns (text kept) plus ``spans``: sorted array of (s, k, e, base) found in whole texts.

    Null texts are empty and have no spans; columns of docs named cands or spans are replaced.
    """
    found = cut(candidates(docs, text_col), "pii")
    return found.withColumn("spans", accepted(fit(found.select("cands")))).drop("cands")


def joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def redact(df: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """Replace every span of the text by its kind in brackets; of overlapping spans the first one's. Null stays null."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    text = F.col(text_col)

    def step(a: Column, x: Column) -> Column:
        fresh = F.concat(a["o"], F.array(F.substring(text, a["p"] + 1, x["s"] - a["p"]), F.element_at(names, x["k"] + 1)))
        return F.struct(F.greatest(a["p"], x["e"]).alias("p"), F.when(x["s"] >= a["p"], fresh).otherwise(a["o"]).alias("o"))

    done = F.aggregate(F.col(spans_col), F.struct(F.lit(0).alias("p"), F.expr("cast(array() as array<string>)").alias("o")), step)
    out = df.withColumn("__r", F.when((F.size(spans_col) > 0) & text.isNotNull(), done))
    return out.withColumn(text_col, F.when(F.col("__r").isNotNull(), F.concat(F.array_join("__r.o", ""), F.substring(text, F.col("__r.p") + 1, F.length(text)))).otherwise(text)).drop("__r")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(candidates(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "cands"), "pii")
    out = found.withColumn("spans", accepted(fit(found)))
    base = F.filter("spans", lambda x: x["base"])
    of = lambda k: F.filter(base, lambda x: x["k"] == k)  # noqa: E731 - a second parameter of the inner one would be the index
    counts = [F.size(of(k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    return out.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op9_pii": op9_pii}
SQL: dict[str, str] = {}
