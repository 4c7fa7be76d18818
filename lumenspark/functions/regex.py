"""Every match of a pattern with its place, by built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MATCH = "array<struct<start:int,end:int,value:string>>"


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    """All non-overlapping matches, as strings; null texts have none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.expr("cast(array() as array<string>)"))


def find_spans(text: Column, pattern: str) -> Column:
    """All matches as array of (start, end, value), counted in code points, end exclusive.

    The text is split at the matches; the lengths of gaps and matches add up to the places. Patterns
    must not match the empty string.
    """
    hits = find_all(text, pattern)
    gaps = F.split(text, pattern, -1)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        found = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(found)).alias("out"))

    def located(x: Column) -> Column:
        both = F.zip_with(x["hits"], F.slice(x["gaps"], 1, F.size(x["hits"])), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
        return F.aggregate(both, F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {_MATCH})").alias("out")), step)["out"]

    # One element, so that the lambda variable holds what would else be evaluated at every use.
    return F.get(F.transform(F.array(F.struct(hits.alias("hits"), gaps.alias("gaps"))), located), 0)


def context(text: Column, start: Column, end: Column, window: int = 24) -> Column:
    """The characters around a match, which itself gives way to a mark; dots where the text goes on."""
    left = F.greatest(F.lit(0), start - window)
    return F.concat(
        F.when(left > 0, "…").otherwise(""),
        F.substring(text, left + 1, start - left),
        F.lit("[…]"),
        F.substring(text, end + 1, F.lit(window)),
        F.when(end + window < F.length(text), "…").otherwise(""),
    )
