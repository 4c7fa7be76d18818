"""Which analyzers run, in what order, and what stops them. The registry is metadata of under a hundred rows."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cost classes from cheap to heavy, and the ceiling of each profile.
COSTS = ("cheap", "medium", "heavy")
PROFILES = {"quick": "cheap", "standard": "medium", "deep": "heavy"}


@dataclass(frozen=True)
class Analyzer:
    name: str
    cost: str = "cheap"
    requires: tuple[str, ...] = ()
    after: tuple[str, ...] = ()
    needs_network: bool = False


# The analyzers, their cost class and what they build on.
REGISTRY = tuple(
    Analyzer(n, c, tuple(r.split()), tuple(a.split()))
    for n, c, r, a in (
        ("blur", "medium", "", ""), ("codes", "medium", "", ""), ("color", "medium", "", ""), ("exif", "cheap", "", ""), ("facedb", "heavy", "faces", ""), ("faces", "heavy", "", ""),
        ("fileinfo", "cheap", "", ""), ("geoestimate", "cheap", "gps", "ocr language codes"), ("gps", "cheap", "exif", ""), ("hashes", "cheap", "", ""), ("language", "medium", "ocr", ""), ("logo", "medium", "", ""),
        ("objectdb", "medium", "", "objects"), ("objects", "heavy", "", ""), ("ocr", "heavy", "", ""), ("perceptual", "medium", "", ""), ("quality", "medium", "", ""), ("reversesearch", "cheap", "", "hashes perceptual"),
        ("scene", "cheap", "objects", ""), ("sensitive", "medium", "ocr", "codes"), ("summary", "cheap", "", ""), ("tamper", "heavy", "quality", "exif"), ("vehicles", "cheap", "objects", "ocr"),
    )
)


class CycleError(ValueError):
    """Analyzers require each other in a circle."""


class SelectionError(ValueError):
    """A name that no analyzer has."""


def select(analyzers, profile: str, allow_network: bool = False) -> list[Analyzer]:
    """The profile's analyzers by name, without those whose requirements it leaves out, however deep."""
    if profile not in PROFILES:
        raise SelectionError(f"unknown profile {profile!r}; choose from {', '.join(PROFILES)}")
    ceiling = COSTS.index(PROFILES[profile])
    chosen = {a.name: a for a in analyzers if COSTS.index(a.cost) <= ceiling and (allow_network or not a.needs_network)}
    stranded = True
    while stranded:
        stranded = [n for n, a in chosen.items() if not chosen.keys() >= set(a.requires)]
        for n in stranded:
            chosen.pop(n)
    return [chosen[n] for n in sorted(chosen)]


def closure(analyzers, names) -> tuple[list[Analyzer], list[str]]:
    """The named analyzers with all they require, and the names that are unknown."""
    known = {a.name: a for a in analyzers}
    todo, out = [n for n in names if n in known], {}
    while todo:
        n = todo.pop()
        if n in known and n not in out:
            out[n] = known[n]
            todo.extend(known[n].requires)
    return [out[n] for n in sorted(out)], [n for n in names if n not in known]


def plan(analyzers, profile: str = "standard", only=None, exclude=(), allow_network: bool = False) -> list[Analyzer]:
    """What runs: named analyzers with their requirements, or a profile; excluded ones stay while needed."""
    if only:
        chosen, unknown = closure(analyzers, only)
        if unknown:
            raise SelectionError(f"unknown analyzer(s): {', '.join(unknown)}")
    else:
        chosen = select(analyzers, profile)
    needed = {d for a in chosen if a.name not in exclude for d in a.requires}
    return [a for a in chosen if (a.name not in exclude or a.name in needed) and (allow_network or not a.needs_network)]


def order(analyzers) -> list[Analyzer]:
    """Requirements before dependents, soft ones where both run; cheap ones first, then by name."""
    known = {a.name: a for a in analyzers}
    placed: list[str] = []
    path: list[str] = []

    def place(n: str) -> None:
        if n in placed or n not in known:
            return
        if n in path:
            raise CycleError(" -> ".join([*path, n]))
        path.append(n)
        for d in sorted(set(known[n].requires) | (set(known[n].after) & known.keys())):
            place(d)
        placed.append(path.pop())

    for n in sorted(known, key=lambda n: (COSTS.index(known[n].cost), n)):
        place(n)
    return [known[n] for n in placed]


def compose(images: DataFrame, chosen, transforms: dict) -> DataFrame:
    """One plan from the chosen analyzers' DataFrame transforms, in order; Catalyst then prunes and fuses it."""
    out = images
    for a in order(chosen):
        if a.name in transforms:
            out = transforms[a.name](out)
    return out


def biometric_refusal(basis: Column, expires: Column, allowed: Column, today: Column) -> Column:
    """Why identification must not run: no basis, an expired or unreadable expiry, or no flag; null if it may."""
    until = F.try_to_date(F.left(expires, F.lit(10)), "yyyy-MM-dd")
    late = (F.coalesce(F.length(expires), F.lit(0)) > 0) & F.coalesce(until < today, F.lit(True))
    return F.when(F.coalesce(F.length(basis), F.lit(0)) == 0, "no lawful basis").when(late, "authorisation expired").when(~F.coalesce(allowed, F.lit(False)), "not allowed on this run")


def gate(rows: DataFrame) -> DataFrame:
    """rows plus status and reason; the first gate that applies decides.

    Columns: refusal, missing, failed (arrays of names), needs_network, allow_network, unavailable,
    decode_error, error. Refusals come before requirements, these before the network and availability.
    """
    has = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    names = lambda c: F.array_join(F.array_sort(c), ", ")
    net = F.coalesce(F.col("needs_network"), F.lit(False)) & ~F.coalesce(F.col("allow_network"), F.lit(False))
    steps = (
        (F.col("refusal").isNotNull(), "skipped", F.col("refusal")),
        (has("missing"), "skipped", F.concat(F.lit("dependency not selected: "), names("missing"))),
        (has("failed"), "skipped", F.concat(F.lit("dependency did not succeed: "), names("failed"))),
        (net, "skipped", F.lit("requires network access")),
        (F.col("unavailable").isNotNull(), "unavailable", F.col("unavailable")),
        (F.col("decode_error").isNotNull(), "error", F.concat(F.lit("image could not be decoded: "), F.col("decode_error"))),
        (F.col("error").isNotNull(), "error", F.col("error")),
    )
    status, reason = F.lit("ok"), F.lit(None).cast("string")
    for test, s, r in reversed(steps):
        status, reason = F.when(test, s).otherwise(status), F.when(test, r).otherwise(reason)
    return rows.withColumn("status", status).withColumn("reason", reason)


# ---- queries ------------------------------------------------------------------------------------


def registry_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a.name, a.cost, list(a.requires), list(a.after), a.needs_network) for a in REGISTRY], "name string, cost string, requires array<string>, after array<string>, needs_network boolean")


def profile_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(p, k, a.name) for p in PROFILES for k, a in enumerate(order(select(REGISTRY, p)))]
    return spark.createDataFrame(rows, "profile string, position int, name string").select("profile", "name")


def selection_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything each analyzer needs, itself included, from the registry table."""
    t = registry_table(spark)
    t.createOrReplaceTempView("lumenspark_registry")
    return spark.sql("WITH RECURSIVE c(name, needs) AS (SELECT name, name FROM lumenspark_registry UNION ALL SELECT c.name, d.r FROM c JOIN (SELECT name, explode(requires) AS r FROM lumenspark_registry) d ON d.name = c.needs) SELECT DISTINCT name, needs FROM c")


_GATES = (
    (1, "a basis", "2999-01-01", True, "", "", False, False, None, None), (2, None, None, True, "faces", "", False, False, None, None), (3, "a basis", "2001-01-01", True, "", "", False, False, None, None),
    (4, "a basis", "soon", True, "", "", False, False, None, None), (5, "a basis", None, False, "", "", False, False, None, None), (6, "a basis", None, True, "ocr,faces", "gps", False, False, None, None),
    (7, "a basis", None, True, "", "gps", True, False, None, None), (8, "a basis", None, True, "", "", True, False, None, None), (9, "a basis", None, True, "", "", True, True, "no model", None), (10, "a basis", None, True, "", "", False, False, None, "ValueError: x"),
)


def gate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(_GATES, "id int, basis string, expires string, allowed boolean, m string, f string, needs_network boolean, allow_network boolean, unavailable string, error string")
    arr = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    rows = rows.select("*", biometric_refusal(F.col("basis"), F.col("expires"), F.col("allowed"), F.lit(date(2025, 1, 1))).alias("refusal"), arr("m").alias("missing"), arr("f").alias("failed"), F.lit(None).cast("string").alias("decode_error"))
    return gate(rows).select("id", "status", "reason")


_q = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)
_REG_SQL = "r(name, cost, req) AS (VALUES " + ", ".join(f"('{a.name}', {COSTS.index(a.cost)}, [{', '.join(repr(x) for x in a.requires)}]::VARCHAR[])" for a in REGISTRY) + ")"

QUERIES = {"profile_plan": profile_plan, "selection_closure": selection_closure, "gate_status": gate_status}
SQL = {
    # Requirements are at most two deep here, so two anti-joins reach the fixed point.
    "profile_plan": f"WITH {_REG_SQL}, p(profile, top) AS (VALUES ('quick', 0), ('standard', 1), ('deep', 2)), a AS (SELECT profile, name, req FROM r, p WHERE cost <= top), b AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(a.req) AS d) x WHERE NOT EXISTS (SELECT 1 FROM a z WHERE z.profile = a.profile AND z.name = x.d))), c AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(b.req) AS d) x WHERE NOT EXISTS (SELECT 1 FROM b z WHERE z.profile = b.profile AND z.name = x.d))) SELECT profile, name FROM c",
    "selection_closure": f"WITH RECURSIVE {_REG_SQL}, d AS (SELECT name, unnest(req) AS x FROM r), c(name, needs) AS (SELECT name, name FROM r UNION SELECT c.name, d.x FROM c JOIN d ON d.name = c.needs) SELECT name, needs FROM c",
    "gate_status": "WITH g(id, basis, expires, allowed, m, f, nn, an, unavailable, error) AS (VALUES " + ", ".join("(" + ", ".join(map(_q, r)) + ")" for r in _GATES) + "), x AS (SELECT *, CASE WHEN coalesce(basis, '') = '' THEN 'no lawful basis' WHEN coalesce(expires, '') <> '' AND coalesce(TRY_CAST(left(expires, 10) AS DATE) < DATE '2025-01-01', true) THEN 'authorisation expired' WHEN NOT allowed THEN 'not allowed on this run' END AS refusal, array_to_string(list_sort(string_split(m, ',')), ', ') AS ms, array_to_string(list_sort(string_split(f, ',')), ', ') AS fs FROM g) SELECT id, CASE WHEN refusal IS NOT NULL OR ms <> '' OR fs <> '' OR (nn AND NOT an) THEN 'skipped' WHEN unavailable IS NOT NULL THEN 'unavailable' WHEN error IS NOT NULL THEN 'error' ELSE 'ok' END AS status, CASE WHEN refusal IS NOT NULL THEN refusal WHEN ms <> '' THEN 'dependency not selected: ' || ms WHEN fs <> '' THEN 'dependency did not succeed: ' || fs WHEN nn AND NOT an THEN 'requires network access' WHEN unavailable IS NOT NULL THEN unavailable WHEN error IS NOT NULL THEN error END AS reason FROM x",
}
