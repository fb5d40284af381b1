import pytest

from actlens.llm import pii, queries
from actlens.llm.persons import COMMON_GIVEN

L = pii.Lexicon(COMMON_GIVEN, frozenset("il la segretario presidente via vista istanza firmato ufficio ditta valuta comune servizio".split()))


def kinds(text):
    return [(k, text[b:e]) for b, e, k in pii.find_spans(text, L)]


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("Il Segretario Mario Zolbrecanti", [("NAME", "Mario Zolbrecanti")]),
        ("Firmato ZOLBRECANTI Mario, Ufficio", [("NAME", "ZOLBRECANTI Mario")]),
        ("dott. M. Zolbrecanti ha", [("NAME", "M. Zolbrecanti")]),
        ("La sig.ra Anna Maria Zolbrecanti, residente in Via dei Mille n. 12/B, ha", [("NAME", "Anna Maria Zolbrecanti"), ("ADDRESS", "Via dei Mille n. 12/B")]),
        ("in corso Mario Zolbrecanti, 155 bis;", [("ADDRESS", "corso Mario Zolbrecanti, 155 bis")]),
        ("sosta in via Zolbrecanti dal 12/03/2024", []),
        ("alla ditta Zolbrecanti Vivai S.r.l. a saldo", []),
        ("scrivere a m_zolb@mail.casa.example;", [("EMAIL", "m_zolb@mail.casa.example")]),
        ("scrivere a zolb3 [at] lettere.test;", [("EMAIL", "zolb3 [at] lettere.test")]),
        ("tel. +39 303 3049849 oppure (0889) 065-126", [("PHONE", "+39 303 3049849"), ("PHONE", "(0889) 065-126")]),
        ("dal 01.02.2024 al 2024-03-05, prot. 1234567, CIG 3486E66073", []),
        ("C.F. PCB RBN 30L45 Z965S, documento AT 4667280", [("ID", "PCB RBN 30L45 Z965S"), ("ID", "AT 4667280")]),
        ("partita IVA 90033296937, fattura QD853483, CUP J60X56020573566", []),
        ("", []),
    ],
)
def test_spans(text, spans):
    assert kinds(text) == spans


def test_sanitised_text_stays_readable():
    text = "Il sig. Mario Zolbrecanti, tel. 303 3049849. Il Zolbrecanti chiede un contributo."
    assert pii.sanitise_text(text, pii.find_spans(text, L)) == "Il sig. [NAME], tel. [PHONE]. Il [NAME] chiede un contributo."


def test_operator_edges(spark):
    rows = [(1, "Firmato Mario Zolbrecanti"), (2, None), (3, ""), (1, "Firmato Mario Zolbrecanti"), (4, "parola " * 50000)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "row_id long, t string, kind int, span string")
    got = pii.find_personal(df, "row_id", "t", lexicon=L).collect()
    assert [tuple(r) for r in got] == [(1, "NAME", "Mario Zolbrecanti")] * 2
    clean = {r["row_id"]: r["t"] for r in pii.sanitise(df, "row_id", "t", lexicon=L).collect()}
    assert clean[1] == "Firmato [NAME]"
    assert clean[2] is None
    assert pii.find_personal(df.limit(0), "row_id", "t").count() == 0


def test_names_of_frequent_people_are_found(spark):
    """One officer signs a third of the acts, and one has a given name as surname."""
    rows = []
    for i in range(300):
        who = ("Mario Zolbrecanti", "Anna Franco", f"Luca Quav{chr(97 + i % 26)}{chr(97 + i // 26)}etti")[i % 3]
        rows.append((i, f"Il Comune di Valmorta rende noto quanto segue. Ufficio Tecnico Comunale, il responsabile {who}."))
    rows += [(300 + i, "Ufficio Tecnico Comunale. Il Segretario M. Zolbrecanti, visto il bilancio.") for i in range(20)]
    df = spark.createDataFrame(rows, "i long, t string")
    got = pii.find_personal(df, "i", "t").where("kind = 'NAME'").collect()
    assert len({r["i"] for r in got}) == 320
    assert {r["span"] for r in got if r["i"] % 3 < 2 and r["i"] < 300} == {"Mario Zolbrecanti", "Anna Franco"}
    assert {r["span"] for r in got if r["i"] >= 300} == {"M. Zolbrecanti"}


def test_both_tables_are_sanitised(spark, tmp_path):
    spark.createDataFrame([(1, "Firmato Mario Zolbrecanti"), (2, None)], "event_id long, raw_text string").write.parquet(f"{tmp_path}/admin_events.parquet")
    spark.createDataFrame([(1, "Contributo al sig. Mario Zolbrecanti, tel. 303 3049849"), (3, None)], "notice_id long, oggetto string").write.parquet(f"{tmp_path}/notices.parquet")
    got = {(r["tbl"], r["row_id"]): r["text"] for r in queries.p6_sanitised(spark, str(tmp_path)).collect()}
    assert got == {("admin_events", 1): "Firmato [NAME]", ("admin_events", 2): None, ("notices", 1): "Contributo al sig. [NAME], tel. [PHONE]", ("notices", 3): None}


def test_lexicons_beyond_the_bound_are_whole(spark, monkeypatch):
    """Neither the less frequent given names nor the less frequent common words are left out, in memory or in files."""
    given = [f"{a}{b}io" for a in ("Quirz", "Zelmur", "Voltr", "Ferdz") for b in ("al", "en", "ot")]
    rows = [(f"Il richiedente {g} {chr(65 + k)}olbrecanti{'aeiou'[i % 5]}tti presenta domanda. La nostra pratica{'bcdfg'[k % 5]} segue.",) for i, g in enumerate(given) for k in range(14 + 2 * i)]
    rows += [("viene citato Ufficio Tecnico Comunale e poi Settore Lavori Pubblici, come si legge.",)] * 400
    df = spark.createDataFrame(rows, "t string")
    held = pii.learn_lexicon(df)
    assert {g.lower() for g in given} <= held.given and {"domanda", "presenta", "nostra"} <= held.common and not held.given & held.common
    monkeypatch.setattr(pii, "COMMON_ROWS", 4)
    monkeypatch.setattr(pii, "GIVEN_ROWS", 4, raising=False)
    filed = pii.learn_lexicon(df)
    for w in held.given | held.common | {"zolbrecanti", "x", ""}:
        assert (w in filed.given, w in filed.common) == (w in held.given, w in held.common), w
    table = df.selectExpr("monotonically_increasing_id() as i", "t")
    found = [sorted(map(tuple, pii.find_personal(table, "i", "t", lexicon=x).collect())) for x in (held, filed)]
    assert found[0] == found[1] and len(found[0]) >= 250
