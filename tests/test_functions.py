"""Functions on hand-written cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from actlens.functions import arrays, dates, numbers, text
from actlens.operators import joins


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expression(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize(("shown", "value"), [("1.234,56", 1234.56), ("1234,56", 1234.56), ("1234.56", 1234.56), ("1 234,56", 1234.56), ("12,50,", None), ("", None), ("x", None), (None, None)])
def test_amount(spark, shown, value):
    assert one(spark, shown, numbers.amount) == value


@pytest.mark.parametrize(("day", "value"), [("31/02/2024", None), ("05/02/2024", datetime.date(2024, 2, 5)), ("2024-02-05", datetime.date(2024, 2, 5)), ("2024", None), ("", None), (None, None)])
def test_dates_never_fail(spark, day, value):
    assert one(spark, day, dates.parse) == value


def test_spelled_out_date(spark):
    assert one(spark, "Il 7 Agosto 2020 e poi", dates.spelled_out) == datetime.date(2020, 8, 7)
    assert one(spark, "nessuna data", dates.spelled_out) is None


@pytest.mark.parametrize(("number", "ok"), [("12345678903", True), ("12345678904", False), ("1234567890", False), (None, False)])
def test_vat(spark, number, ok):
    assert bool(one(spark, number, numbers.valid_vat)) is ok


def test_iban(spark):
    assert one(spark, "it60 x054 2811 1010 0000 0123 456", numbers.valid_iban)
    assert not one(spark, "IT60X054281110100000012345", numbers.valid_iban)


@pytest.mark.parametrize(("words", "value"), [("milleduecentotrentaquattro/56", 1234.56), ("ventuno", 21), ("ventotto", 28), ("cento", 100), ("duemila", 2000), ("unmilione", 1_000_000), ("trentatré", 33), ("abc", None), ("", None)])
def test_number_words(words, value):
    assert numbers.words_to_number(words) == value


@pytest.mark.parametrize(("name", "value"), [("Rossi S.R.L.", "ROSSI"), ("DITTA Rossi & Figli S.N.C.", "ROSSI FIGLI"), ("Avv. Bianchi", "BIANCHI"), ("  ", "NON IDENTIFICATO"), (None, "NON IDENTIFICATO"), ("diverse ditte", "DIVERSI/NON APPLICABILE")])
def test_payee(spark, name, value):
    assert one(spark, name, text.payee) == value


def test_officer(spark):
    assert one(spark, "Dott. Mario Rossi", text.officer) == "MARIO ROSSI"
    assert one(spark, "VISTO il decreto", text.officer) == "NON IDENTIFICATO"


@pytest.mark.parametrize(("cell", "items"), [("['a', 'b']", ["a", "b"]), ("a;b", ["a", "b"]), ("a | b", ["a", "b"]), ("a", ["a"]), (" ", []), (None, []), ("[broken", [])])
def test_list_cells(spark, cell, items):
    assert one(spark, cell, arrays.list_of) == items


def test_turtle_literal(spark):
    assert one(spark, 'a "b"\nc\\d', text.turtle_literal) == '"a \\"b\\"\\nc\\\\d"'


def test_token_set_ratio():
    assert joins.token_set_ratio("lavori ponte vecchio", "ponte vecchio lavori") == 100.0
    assert joins.token_set_ratio("lavori ponte", "scuola media") < 50
    assert joins.token_set_ratio("", "") == 100.0
