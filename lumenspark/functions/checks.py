"""Checksums, entropy, issuers and masking as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def luhn_valid(text: Column) -> Column:
    """13 to 19 digits, whatever stands between them, that pass the Luhn check."""
    d = digits(text)
    doubled = F.transform(_chars(F.reverse(d)), lambda c, i: c.cast("int") * (1 + i % 2))
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    return F.length(d).between(13, 19) & (total % 10 == 0)


def iban_valid(text: Column) -> Column:
    """15 to 34 characters with a country in front whose base-36 digits leave 1 modulo 97."""
    flat = F.upper(F.regexp_replace(text, r"\s+", ""))
    moved = F.concat(F.substr(flat, F.lit(5)), F.left(flat, F.lit(4)))
    rest = F.aggregate(
        _chars(moved),
        F.lit(0),
        lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )
    return flat.rlike("^[A-Z]{2}[A-Z0-9]{13,32}$") & (rest == 1)


def text_entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for the empty text."""
    c = _chars(text)
    n = F.size(c).cast("double")
    terms = F.transform(F.array_distinct(c), lambda x: F.size(F.filter(c, lambda y: y == x)) / n)
    return F.aggregate(terms, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def high_entropy(text: Column, threshold: float = 3.4) -> Column:
    return text_entropy(text) >= threshold


def card_brand(text: Column) -> Column:
    d = digits(text)
    two, four = F.try_to_number(F.left(d, F.lit(2)), F.lit("99")).cast("int"), F.left(d, F.lit(4)).try_cast("int")
    return (
        F.when(d.startswith("4"), "Visa")
        .when(F.left(d, F.lit(2)).isin("34", "37"), "American Express")
        .when(two.between(51, 55) | four.between(2221, 2720), "Mastercard")
        .when((F.left(d, F.lit(4)) == "6011") | (F.left(d, F.lit(2)) == "65"), "Discover")
        .otherwise("unknown issuer")
    )


def _stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), n)


def mask(value: Column, key: Column) -> Column:
    """Enough of a value to recognise it, not enough to use it."""
    v = F.trim(value)
    n = F.length(v)
    local, domain = F.substring_index(v, "@", 1), F.substr(v, F.instr(v, "@") + 1)
    head = F.when(F.length(local) > 3, F.left(local, F.lit(2))).otherwise(F.left(local, F.lit(1)))
    email = F.concat(head, _stars(F.greatest(F.lit(3), F.length(local) - F.length(head))), F.lit("@"), domain)
    flat = F.regexp_replace(v, r"[\s-]", "")
    number = F.concat(F.left(flat, F.lit(4)), _stars(F.greatest(F.lit(4), F.length(flat) - 8)), F.right(flat, F.lit(4)))
    keep = F.greatest(F.lit(3), F.floor(n / 5).cast("int"))
    short = F.concat(F.left(v, F.lit(1)), _stars(n - 1))
    other = F.concat(F.left(v, keep), _stars(n - keep * 2), F.right(v, keep))
    return F.when(key == "email", email).when(key.isin("credit_card", "iban"), number).when(n <= 8, short).otherwise(other)
