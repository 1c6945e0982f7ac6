"""Scalar functions of standardisation, as Columns that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrystone import config

_EDGES = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def lookup(pairs: dict[str, str]) -> Column:
    """A map literal; empty maps keep their type."""
    if not pairs:
        return F.expr("cast(map() as map<string,string>)")
    return F.create_map(*[F.lit(x) for kv in sorted(pairs.items()) for x in kv])


def mapped(pairs: dict[str, str], key: Column) -> Column:
    return F.element_at(lookup(pairs), key) if pairs else F.lit(None).cast("string")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, _EDGES, ""), F.lit(""))


def display_name(c: Column) -> Column:
    return F.regexp_replace(blank_to_null(c), r"\s+", " ")


def name_tokens(c: Column) -> Column:
    """Upper-case words without full stops and legal forms."""
    words = F.split(F.regexp_replace(F.replace(F.upper(c), F.lit("."), F.lit("")), "[^A-Z0-9 ]", " "), " +")
    legal = F.array(*map(F.lit, config.LEGAL_TOKENS))
    return F.filter(words, lambda w: (w != "") & ~F.array_contains(legal, w))


def normalised_name(c: Column, tokens: dict[str, str]) -> Column:
    out = F.transform(name_tokens(c), lambda w: F.coalesce(mapped(tokens, w), w))
    return F.nullif(F.array_join(F.filter(out, lambda w: w != config.LEGAL_MARK), " "), F.lit(""))


def tax_id(c: Column) -> Column:
    return F.nullif(F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", "")), F.lit(""))


def phone(c: Column) -> Column:
    digits = F.regexp_replace(F.regexp_replace(c, "[^0-9]", ""), "^00", "")
    return F.when(F.length(digits) >= 8, F.concat(F.lit("+"), digits))


def email(c: Column) -> Column:
    return F.lower(blank_to_null(c))


def bank_account(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, "[^0-9]", ""), F.lit(""))


def email_domain(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("@")), F.lower(F.substring_index(c, "@", -1)))


def title(c: Column) -> Column:
    """Capitals behind every non-letter, small letters elsewhere."""
    letters = F.split(F.lower(c), "(?<=[^\\p{L}])")
    return F.array_join(F.transform(letters, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 10_000))), "")


def city(c: Column, aliases: dict[str, str]) -> Column:
    bare = blank_to_null(c)
    return F.coalesce(mapped(aliases, F.upper(bare)), title(bare))


def country_iso2(c: Column) -> Column:
    names = {n: iso2 for iso2, (name, iso3, _, _) in config.COUNTRIES.items() for n in (iso2, iso3, name.upper())}
    return mapped(names, F.upper(blank_to_null(c)))


def currency(c: Column, known: dict[str, str]) -> Column:
    up = F.upper(blank_to_null(c))
    return F.coalesce(mapped(known, up), up)


def date_of(c: Column, pattern: str) -> Column:
    """Null if it isn't a date of the source's format."""
    return F.try_to_timestamp(blank_to_null(c), F.lit(pattern)).cast("date")


def amount(c: Column) -> Column:
    bare = F.replace(blank_to_null(c), F.lit(","), F.lit(""))
    return F.when(bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), bare.try_cast("double"))


def shape(c: Column) -> Column:
    """Letters as A, digits as 9, at most 24 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(c, r"\p{L}", "A"), "[0-9]", "9"), 1, 24)


def source_of(key: Column) -> Column:
    return F.split_part(key, F.lit(":"), F.lit(1))


def sql_literal(value) -> str:
    if isinstance(value, bool):
        return str(value).upper()
    return str(value) if isinstance(value, int | float) else "'" + str(value).replace("'", "''") + "'"


def constraint_name(rule_id: str, name: str) -> str:
    import re

    return re.sub("[^a-z0-9]+", "_", f"{rule_id} {name}".lower()).strip("_")[:60]
