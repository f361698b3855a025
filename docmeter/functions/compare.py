"""Comparison of an expected with an actual value, by kind of field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import parse_date
from .text import address, blank, code, identifier, plain_text, strip_accents

STATUSES = ("EXACT", "NORMALIZED", "PARTIAL", "MISMATCH", "UNINTERPRETABLE", "MISSING", "EXTRA", "EXTRA_SCHEMA", "NOT_APPLICABLE")
CORRECT = ("EXACT", "NORMALIZED")
ERRORS = ("MISMATCH", "MISSING", "UNINTERPRETABLE", "EXTRA")

# Words for a sex and what they mean, by convention.
SEX_WORDS = {"X": "X", "HOMBRE": "HOMBRE", "MUJER": "MUJER", "MASCULINO": "HOMBRE", "FEMENINO": "MUJER"}
SEX_MX = SEX_WORDS | {"H": "HOMBRE", "M": "MUJER", "F": "MUJER"}
SEX_ICAO = SEX_WORDS | {"M": "HOMBRE", "F": "MUJER", "H": "HOMBRE"}


def sex(c: Column, table: dict[str, str]) -> Column:
    words = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return words[F.upper(F.trim(F.regexp_replace(c, r"\s+", " ")))]


def compare_values(kind: Column, expected: Column, actual: Column, others: Column | None = None) -> Column:
    """Status of two values that aren't blank. Kinds: identifier, code, text, address, date, sex_mx, sex_icao."""
    others = F.array().cast("array<string>") if others is None else others

    def same(norm) -> Column:
        return F.when(norm(actual) == norm(expected), "NORMALIZED").otherwise("MISMATCH")

    def text(norm) -> Column:
        a, e = norm(actual), norm(expected)
        near = F.exists(others, lambda o: (norm(o) == a) | (strip_accents(norm(o)) == strip_accents(a)))
        return F.when(a == e, "NORMALIZED").when(near | (strip_accents(a) == strip_accents(e)), "PARTIAL").otherwise("MISMATCH")

    def read(norm) -> Column:
        a, e = norm(actual), norm(expected)
        return F.when(a.isNull() | e.isNull(), "UNINTERPRETABLE").when(a == e, "NORMALIZED").otherwise("MISMATCH")

    by_kind = (
        F.when(kind == "identifier", same(identifier))
        .when(kind == "code", same(code))
        .when(kind == "text", text(plain_text))
        .when(kind == "address", text(address))
        .when(kind == "date", read(parse_date))
        .when(kind == "sex_mx", read(lambda c: sex(c, SEX_MX)))
        .when(kind == "sex_icao", read(lambda c: sex(c, SEX_ICAO)))
    )
    return F.when(actual == expected, "EXACT").otherwise(by_kind)


def field_status(kind: Column, expected: Column, actual: Column, applicable: Column, others: Column | None = None) -> Column:
    """Status of a field that is expected: '' expects nothing; a field that doesn't apply is never scored."""
    return (
        F.when(~applicable, "NOT_APPLICABLE")
        .when((expected == "") & blank(actual), "EXACT")
        .when(expected == "", "EXTRA")
        .when(blank(actual), "MISSING")
        .otherwise(compare_values(kind, expected, actual, others))
    )


def verdict(base: Column, new: Column, higher_is_better: Column, tolerance: float = 0.0) -> Column:
    gain = F.when(higher_is_better, new - base).otherwise(base - new)
    return F.when(gain.isNull(), "no_data").when(gain > tolerance, "better").when(gain < -tolerance, "worse").otherwise("same")
