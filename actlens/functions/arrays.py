"""Lists in strings, attachments, nested JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def list_of(c: Column) -> Column:
    """A list literal, or strings separated by ; or |, or one string, as an array; blank and null give an empty one."""
    s = F.trim(c)
    literal = F.from_json(F.replace(s, F.lit("'"), F.lit('"')), "array<string>")
    parts = F.filter(F.transform(F.split(s, r"[;|]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.coalesce(s, F.lit("")) == "", F.array().cast("array<string>")).when(s.startswith("["), F.coalesce(literal, F.array().cast("array<string>"))).otherwise(parts)


def json_of_answer(c: Column, schema: str) -> Column:
    """JSON in a code fence or bare, as a struct; null where it can't be read."""
    return F.from_json(F.trim(F.regexp_replace(c, r"^\s*```(?:json)?|```\s*$", "")), schema)


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))
