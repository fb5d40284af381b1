"""Numbers: amounts as written in Italian, check digits, bounds, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def amount(c: Column) -> Column:
    """'1.234,56', '1 234,56', '1234,56' and '1234.56' as double; null for what is no number. A dot alone is a decimal point."""
    s = F.regexp_replace(F.trim(c), r"\s", "")
    italian = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(s.contains(","), italian.try_cast("double")).otherwise(s.try_cast("double"))


def bounded_amount(c: Column, low: float = 0.0, high: float = 1e9, large: float = 5e6) -> tuple[Column, Column]:
    """(amount within bounds or null, flag): amounts written with thousands' dots."""
    v = F.replace(F.replace(F.trim(c), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    ok = (v > low) & (v < high)
    return F.when(ok, v), F.when(~F.coalesce(ok, F.lit(False)), "IMPORTO_INVALIDO").when(v > large, "HIGH_IMPORTO").otherwise("")


def capped(c: Column, most: float = 5e6) -> Column:
    """Implausible or missing amounts as 0."""
    return F.when(c.isNull() | (c > most), F.lit(0.0)).otherwise(c)


def valid_vat(c: Column) -> Column:
    """Luhn check of an 11-digit VAT number."""
    digit = lambda i: F.substring(c, i, 1).cast("int")
    total = F.lit(0)
    for i in range(1, 12):
        d = digit(i)
        total = total + (d if i % 2 else F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2))
    return F.when(c.rlike(r"^\d{11}$"), total % 10 == 0).otherwise(F.lit(False))


def valid_iban(c: Column) -> Column:
    s = F.upper(F.regexp_replace(c, r"\s", ""))
    return F.coalesce(s.startswith("IT") & (F.length(s) == 27), F.lit(False))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(100.0 * part / whole, 2))


def priority(pct: Column) -> Column:
    return F.when(pct >= 25, 1).when(pct >= 10, 2).when(pct > 0, 3).otherwise(4)


#: Confidence of a label (fixed values).
CONFIDENCE = {"high": 0.95, "ml_predicted": 0.85, "ambiguous": 0.5, "human_reviewed": 1.0}


def confidence(c: Column) -> Column:
    out = None
    for label, value in CONFIDENCE.items():
        out = F.when(F.lower(c) == label, value) if out is None else out.when(F.lower(c) == label, value)
    return out.otherwise(F.coalesce(c.try_cast("double"), F.lit(0.4)))


#: Italian number words (fixed values).
UNITS = "zero uno due tre quattro cinque sei sette otto nove dieci undici dodici tredici quattordici quindici sedici diciassette diciotto diciannove".split()
TENS = "venti trenta quaranta cinquanta sessanta settanta ottanta novanta".split()


def words_to_number(text: str) -> float | None:
    """'milleduecentotrentaquattro/56' -> 1234.56; None for what is no number word."""
    whole, _, cents = text.lower().replace(" ", "").partition("/")
    total = _words(whole)
    if total is None:
        return None
    return total + (int(cents) / 100 if cents.isdigit() else 0)


def _words(s: str) -> int | None:
    for mark, one, size in (("milioni", "unmilione", 1_000_000), ("mila", "mille", 1000)):
        if mark in s:
            left, _, right = s.partition(mark)
            a, b = _words(left), _words(right) if right else 0
            return None if a is None or b is None else a * size + b
        if s.startswith(one):
            rest = s[len(one) :]
            b = _words(rest) if rest else 0
            return None if b is None else size + b
    if "cento" in s:
        left, _, right = s.partition("cento")
        a, b = (_words(left) if left else 1), (_words(right) if right else 0)
        return None if a is None or b is None else a * 100 + b
    if s in UNITS:
        return UNITS.index(s)
    for k, ten in enumerate(TENS):
        for stem, full in ((ten, True), (ten[:-1], False)):
            if s.startswith(stem):
                rest = s[len(stem) :]
                if not rest and full:
                    return 20 + 10 * k
                if rest.replace("tré", "tre") in UNITS[1:10]:
                    return 20 + 10 * k + UNITS.index(rest.replace("tré", "tre"))
    return None
