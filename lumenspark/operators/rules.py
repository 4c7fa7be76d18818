"""Declarative rules: parsed and checked on the driver, evaluated as predicates of one projection."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONDITIONS = ("text_matches", "text_contains", "exif_contains", "exif_missing", "value_above", "value_below", "value_equals", "finding_present")
SEVERITIES = ("info", "low", "medium", "high")
NAME = re.compile(r"[a-z0-9][a-z0-9_-]*")


class RuleError(ValueError):
    """A rule set that cannot be used; the message names the problem."""


@dataclass(frozen=True)
class Rule:
    id: str
    condition: str
    argument: object
    label: str
    category: str = "custom"
    severity: str = "low"
    confidence: float = 0.8
    detail: str | None = None


def parse(text: str) -> tuple[str, list[Rule]]:
    """(name, rules) of a JSON rule set, or YAML where a YAML reader is installed."""
    try:
        data = json.loads(text)
    except ValueError:
        try:
            import yaml

            data = yaml.safe_load(text)
        except ImportError:
            raise RuleError("not valid JSON, and no YAML reader is installed") from None
        except Exception as e:
            raise RuleError(f"cannot be read: {e}") from None
    if not isinstance(data, dict):
        raise RuleError("a rule set is a mapping")
    name = str(data.get("name", ""))
    if not NAME.fullmatch(name):
        raise RuleError(f"bad name {name!r}")
    if not isinstance(data.get("rules"), list) or not data["rules"]:
        raise RuleError("rules must be a list with at least one rule")
    rules = [_rule(r, i) for i, r in enumerate(data["rules"])]
    ids = [r.id for r in rules]
    if len(set(ids)) < len(ids):
        raise RuleError("rule ids repeat: " + ", ".join(sorted({i for i in ids if ids.count(i) > 1})))
    return name, rules


def _rule(r: object, at: int) -> Rule:
    if not isinstance(r, dict) or not r.get("id"):
        raise RuleError(f"rule {at} has no id")
    when = r.get("when") if isinstance(r.get("when"), dict) else {k: r[k] for k in CONDITIONS if k in r}
    if len(when) != 1:
        raise RuleError(f"rule {r['id']}: exactly one condition is needed, found {len(when)}")
    condition, argument = next(iter(when.items()))
    finding = r.get("finding", r)
    if condition not in CONDITIONS:
        raise RuleError(f"rule {r['id']}: unknown condition {condition!r}")
    if not finding.get("label"):
        raise RuleError(f"rule {r['id']}: a label is needed")
    severity, confidence = finding.get("severity", "low"), finding.get("confidence", 0.8)
    if severity not in SEVERITIES:
        raise RuleError(f"rule {r['id']}: unknown severity {severity!r}")
    if not isinstance(confidence, (int, float)) or not 0 <= confidence <= 1:
        raise RuleError(f"rule {r['id']}: confidence must lie in 0 to 1")
    if condition == "text_matches":
        try:
            re.compile(str(argument))
        except re.error as e:
            raise RuleError(f"rule {r['id']}: invalid regular expression: {e}") from None
    return Rule(str(r["id"]), condition, argument, finding["label"], finding.get("category", "custom"), severity, float(confidence), finding.get("detail"))


def evidence(rule: Rule, text: Column, exif: Column, values: Column, labels: Column) -> Column:
    """What the rule matched, null where it does not fire.

    exif: map of highlight or GROUP:Name to value; values: map of dotted path to string; labels: array
    of finding labels.
    """
    a = rule.argument
    if rule.condition == "text_matches":
        hit = F.regexp_extract(text, "(?U)" + str(a), 0)
        return F.when(text.rlike("(?U)" + str(a)), F.left(hit, F.lit(120)))
    if rule.condition == "text_contains":
        at = F.locate(str(a).lower(), F.lower(text))
        return F.when(at > 0, F.substr(text, at, F.lit(len(str(a)))))
    if rule.condition in ("exif_contains", "exif_missing"):
        field = str(a["field"] if rule.condition == "exif_contains" else a)
        raw = F.filter(F.map_entries(exif), lambda e: F.lower(F.substring_index(e["key"], ":", -1)) == field.lower())
        value = F.coalesce(F.try_element_at(exif, F.lit(field)), F.get(raw, 0)["value"])
        if rule.condition == "exif_missing":
            return F.when(F.coalesce(value, F.lit("")) == "", F.lit(field))
        return F.when(F.contains(F.lower(value), F.lit(str(a["value"]).lower())), F.left(value, F.lit(120)))
    if rule.condition == "finding_present":
        return F.get(F.filter(labels, lambda x: F.contains(F.lower(x), F.lit(str(a).lower()))), 0)
    value = F.try_element_at(values, F.lit(str(a["path"])))
    if rule.condition == "value_equals":
        return F.when(F.lower(value) == str(a["value"]).lower(), value)
    number, limit = value.try_cast("double"), float(a["threshold"])
    return F.when(number > limit if rule.condition == "value_above" else number < limit, value)


def evaluate(df: DataFrame, rules: list[Rule], keys: list[str], text: str = "text", exif: str | None = None, values: str | None = None, labels: str | None = None) -> DataFrame:
    """One row per (keys, rule that fires): rule, category, label, value, severity, confidence, detail."""
    none = F.expr("cast(map() as map<string,string>)")
    cols = F.coalesce(F.col(text), F.lit("")), F.col(exif) if exif else none, F.col(values) if values else none, F.col(labels) if labels else F.expr("cast(array() as array<string>)")
    each = [F.struct(F.lit(r.id).alias("rule"), F.lit(r.category).alias("category"), F.lit(r.label).alias("label"), evidence(r, *cols).alias("value"), F.lit(r.severity).alias("severity"), F.lit(r.confidence).alias("confidence"), F.lit(r.detail).cast("string").alias("detail")) for r in rules]
    return df.select(*keys, F.explode(F.filter(F.array(*each), lambda x: x["value"].isNotNull())).alias("r")).select(*keys, "r.*")


_SET = json.dumps({"name": "demo", "rules": [
    {"id": "licence", "text_matches": r"Licensed under [A-Z]{2} [A-Z-]+ [0-9.]+", "label": "Licence line", "severity": "medium"},
    {"id": "token", "text_contains": "TOKEN =", "label": "Token assignment", "severity": "high", "confidence": 0.9},
    {"id": "long", "value_above": {"path": "document.n_chars", "threshold": 15000}, "label": "Very long"},
    {"id": "short", "value_below": {"path": "document.n_chars", "threshold": 30}, "label": "Very short"},
    {"id": "german", "value_equals": {"path": "document.lang", "value": "DE"}, "label": "German"},
    {"id": "src", "exif_contains": {"field": "source", "value": "RC1"}, "label": "Source"},
    {"id": "nolens", "exif_missing": "lens", "label": "No lens", "severity": "info"},
    {"id": "dup", "finding_present": "spanish", "label": "Spanish seen"},
]})


def rules_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = d.select("doc_id", "text", F.create_map(F.lit("DOC:Source"), F.col("source")).alias("exif"), F.create_map(F.lit("document.n_chars"), F.col("n_chars").cast("string"), F.lit("document.lang"), F.col("lang")).alias("values"), F.when(F.col("lang") == "es", F.array(F.lit("Text in Spanish"))).otherwise(F.expr("cast(array() as array<string>)")).alias("labels"))
    return evaluate(rows, parse(_SET)[1], ["doc_id"], "text", "exif", "values", "labels").select("doc_id", "rule", "label", "value", "severity", "confidence")


_CASES = (
    ("licence", "Licence line", "nullif(left(regexp_extract(text, 'Licensed under [A-Z]{2} [A-Z-]+ [0-9.]+'), 120), '')", "medium", 0.8),
    ("token", "Token assignment", "CASE WHEN instr(lower(text), 'token =') > 0 THEN substr(text, instr(lower(text), 'token ='), 7) END", "high", 0.9),
    ("long", "Very long", "CASE WHEN n_chars > 15000 THEN CAST(n_chars AS VARCHAR) END", "low", 0.8),
    ("short", "Very short", "CASE WHEN n_chars < 30 THEN CAST(n_chars AS VARCHAR) END", "low", 0.8),
    ("german", "German", "CASE WHEN lang = 'de' THEN lang END", "low", 0.8),
    ("src", "Source", "CASE WHEN contains(lower(source), 'rc1') THEN source END", "low", 0.8),
    ("nolens", "No lens", "'lens'", "info", 0.8),
    ("dup", "Spanish seen", "CASE WHEN lang = 'es' THEN 'Text in Spanish' END", "low", 0.8),
)

QUERIES = {"rules_eval": rules_eval}
SQL = {"rules_eval": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{i}' AS rule, '{lab}' AS label, {v} AS value, '{s}' AS severity, CAST({c} AS DOUBLE) AS confidence FROM documents" for i, lab, v, s, c in _CASES) + ") WHERE value IS NOT NULL"}
