"""Dates in several ways of writing; what can't be read is null, never an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("dd/MM/yyyy", "yyyy-MM-dd", "dd-MM-yyyy", "dd.MM.yyyy")
#: Names of the months (fixed values).
MONTHS = "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre".split()


def parse(c: Column, formats: Sequence[str] = FORMATS) -> Column:
    return F.coalesce(*(F.try_to_timestamp(F.trim(c), F.lit(f)) for f in formats)).cast("date")


def first_date(c: Column) -> Column:
    """The first dd/mm/yyyy or 20yy-mm-dd in a text as it stands, else its first year."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"\b(\d{2}/\d{2}/\d{4}|20\d{2}-\d{2}-\d{2})\b", 1), F.lit("")), F.nullif(F.regexp_extract(c, r"\b(20\d{2})\b", 1), F.lit("")))


def spelled_out(c: Column) -> Column:
    """'7 agosto 2020' anywhere in a text as a date."""
    pattern = r"(?i)\b(\d{1,2}) (" + "|".join(MONTHS) + r") (\d{4})\b"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(c, pattern, 2)))
    iso = F.concat_ws("-", F.regexp_extract(c, pattern, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(c, pattern, 1), 2, "0"))
    return F.when(month > 0, F.try_to_timestamp(iso, F.lit("yyyy-MM-dd"))).cast("date")


def within(day: Column, first: str | None, last: str | None) -> Column:
    """Inclusive bounds; a null date fails as soon as a bound is set."""
    ok = F.lit(True)
    if first:
        ok = ok & (day >= F.lit(first).cast("date"))
    if last:
        ok = ok & (day <= F.lit(last).cast("date"))
    return F.coalesce(ok, F.lit(False)) if first or last else F.lit(True)
