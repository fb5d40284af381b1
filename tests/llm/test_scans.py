from actlens.llm import scans

WORDS = "il la di e presso parere del comune registrata fattura dicembre lavori manutenzione straordinaria reso favorevole sul fascicolo avvenuta delibera approvare piano con spesa euro".split()
MODEL = scans.Model({**dict.fromkeys(WORDS, 500), "socio-assistenziale": 50, "socio": 50, "assistenziale": 50}, 20000)


def damage(text):
    return scans.repair(text, MODEL, {}).damage


def test_kinds_of_damage():
    text = "Comune di Valle - fascicolo Crirzevrese 043565/G   pag. 1\nil parere del comune reso favorevo1e sul fasci-\ncolo di l a v o r i presso socio-\nassistenziale la fattura\n- 1 -\nComune di Valle - fascicolo Crirzevrese 043565/G   pag. 2\ndelibera di approvare presso ilpiano la spesa\n2"
    assert damage(text) == [(1, "HEADER"), (2, "CHAR"), (2, "HYPHEN"), (3, "CHAR"), (5, "PAGENO"), (6, "HEADER"), (7, "CHAR"), (8, "PAGENO")]


def test_repair_restores_words():
    text = "il parere del cornune reso\nfavorevo1e sul fasci¬\ncolo di lavori;\nDelibera di approvare\nil piano con spesa;"
    assert scans.repair(text, MODEL, {}).paragraphs == ["il parere del comune reso favorevole sul fascicolo di lavori;", "Delibera di approvare il piano con spesa;"]


def test_codes_are_no_damage():
    assert damage("il parere FT523809 del 12/03/2024\nfattura 033703/B con CIG K4537111U8\nimpronta 7027a354125c962f sul\npiano") == []


def test_operator_edges(spark):
    rows = [(1, None), (2, ""), (3, "una riga lunga " * 20), (4, "\n".join(["il parere del comune reso", "favorevole sul fascicolo"] * 4)), (4, "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "event_id long, raw_text string, kind int")
    assert scans.find_damage(df).count() == 0
    parts = scans.repaired_paragraphs(df).collect()
    assert {r["event_id"] for r in parts} == {3, 4}
    assert scans.find_damage(df.limit(0)).count() == 0


def lexicon_of(text, times=4000):
    counts = {w: times for w in text.split()}
    return scans.Model(counts, sum(counts.values()))


def test_the_lattice_joins_and_splits_where_each_token_alone_would_not():
    model = lexicon_of("la determinazione per il servizio della mensa comunale approvata ieri con voto unanime minazione")
    model.counts["minazione"] = 1
    lines = ["la deter minazione per il", "serviziodellamensa comu na le", "approvata ieri con vo-", "to unanime"]
    got = scans.repair("\n".join(lines), model, {})
    assert got.damage == [(1, "CHAR"), (2, "CHAR"), (3, "HYPHEN")]
    assert " ".join(got.paragraphs) == "la determinazione per il servizio della mensa comunale approvata ieri con voto unanime"
    # word by word nothing is wrong with the fragment that is a word, and a split into two leaves the rest unknown
    assert scans.repair_token("minazione", model, {})[2] is False and len(scans._split("serviziodellamensa", model)[1]) == 3


def test_known_words_side_by_side_stay_apart():
    model = lexicon_of("sopra tutto soprattutto per la sopratutto")
    assert scans.repair("per la sopra tutto per la", model, {}).damage == []


def test_very_long_tokens_and_streams_end():
    model = lexicon_of("la casa")
    assert scans.repair("l" * 50_000 + " la casa", model, {}).damage == []
    assert len(scans.repair("la casa\n" * 20_000, model, {}).paragraphs) >= 1


def test_lexicons_beyond_the_bound_are_whole(spark, monkeypatch):
    """Words seen three times count beside frequent ones, and so do all runs of letters in names, in memory or in files."""
    rare = [f"{a}{b}{c}mento" for a in ("bra", "cre", "dro", "fli") for b in ("ma", "ne", "po") for c in ("sti", "tra")]
    rows = [("il parere del comune sui lavori " + "della spesa prevista " * 9 + w + " Ros" + w[:5] + "etti",) for w in rare for _ in range(3)]
    broken = "\n".join(["il parere del comune sui", f"lavori {rare[0][:5]}-", f"{rare[0][5:]} della spesa", f"prevista {rare[5].replace('e', 'c')} della", "spesa del cornune"])
    df = spark.createDataFrame([*rows, (broken,)], "t string")
    held = scans.learn_model(df)
    assert {held.counts[w] for w in rare} == {3} and held.names == len({w[:5] for w in rare})
    monkeypatch.setattr(scans, "LEXICON_WORDS", 5)
    monkeypatch.setattr(scans, "NAME_GRAMS", 5, raising=False)
    filed = scans.learn_model(df)
    for mine, theirs in ((held.counts, filed.counts), (held.grams, filed.grams), (held.heads, filed.heads)):
        assert theirs.size == len(mine) and all(theirs[w] == n for w, n in mine.items())
    assert "x" not in filed.counts and filed.counts.get("", 0) == 0 and filed.names == held.names
    table = df.selectExpr("monotonically_increasing_id() as event_id", "t as raw_text")
    in_files = sorted(map(tuple, scans.find_damage(table).collect()))
    monkeypatch.undo()
    assert sorted(map(tuple, scans.find_damage(table).collect())) == in_files and {r[2] for r in in_files} == {"HYPHEN", "CHAR"}
