import pytest

from actlens.llm import mix, residue, tokenize

ACT = "Determinazione n. {0} del 12/03/2024\nOggetto: lavori di manutenzione del ponte {0}\nVista la fattura {0} di euro 120,50 emessa dalla ditta;\nDETERMINA di liquidare la somma di euro 120,50"
BAD = ["Errore 404 - la pagina richiesta non esiste", "lorem ipsum dolor sit amet " * 8, "Per visualizzare la pagina occorre abilitare JavaScript nel browser", "HTTP 500 Internal Server Error", "prova prova prova prova prova prova prova prova"]
OPEN = ["{{ oggetto }}", "[da completare]", "XX/XX/XXXX", "%%RESPONSABILE%%", "${importo}", "<NOME_UFFICIO>"]
FINE = ["Nominativo [omissis] ai sensi", "Il sottoscritto ______________ nato a ________", "Capo XXX del regolamento", "preso atto dell'errore 404 della piattaforma"]


def test_residue(spark):
    rows = [(i, ACT.format(i)) for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(BAD * 3)] + [(200 + i, ACT.format(i) + f"\nIl responsabile {o} dispone") for i, o in enumerate(OPEN * 2)]
    rows += [(300 + i, ACT.format(i) + f"\n{f}") for i, f in enumerate(FINE)] + [(400, None), (401, ""), (402, "  "), (5, ACT.format(5))]
    df = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, excluded boolean")
    out = residue.find_residue(df)
    assert out.count() == len(rows)
    got = {r["doc_id"] for r in out.where("excluded").collect()}
    assert got == {i for i, _ in rows if 100 <= i < 300}
    assert residue.without_residue(df).count() == len(rows) - len(got)
    assert residue.find_residue(df.limit(0)).count() == 0


def test_mix_reaches_its_shares(spark):
    sized = spark.createDataFrame([(i, 10 + i % 7, "a" if i % 3 else "b") for i in range(3000)] + [(9000, 50, None), (9001, 0, "a")], "doc_id long, n_tokens long, source string")
    targets = spark.createDataFrame([("m", "a", 0.5, 3, 0.5), ("m", "b", 0.5, 2, 0.5), ("n", "b", 1.0, 2, 3.0), ("n", "gone", 0.0, 2, 3.0)], "mix string, source string, target_share double, max_repeats int, size_ratio double")
    plan = mix.mix_plan(sized, targets)
    chosen = mix.select_mix(sized, plan)
    report = {(r["mix"], r["source"]): r for r in mix.mix_report(chosen, plan).collect()}
    for key in (("m", "a"), ("m", "b")):
        assert abs(report[key]["reached_tokens"] - report[key]["target_tokens"]) <= 20
    assert report["n", "b"]["most_copies"] == 2
    assert report["n", "b"]["reached_tokens"] == 2 * report["n", "b"]["available_tokens"]
    assert report["n", "gone"]["documents"] == 0
    assert chosen.groupBy("mix", "doc_id").count().where("count > 1").count() == 0


def test_smaller_mixes_are_nested(spark):
    sized = spark.range(2000).selectExpr("id as doc_id", "cast(10 as long) as n_tokens", "'a' as source")
    plan = mix.mix_plan(sized, spark.createDataFrame([("s", "a", 1.0, 1, 0.1), ("l", "a", 1.0, 1, 0.3)], "mix string, source string, target_share double, max_repeats int, size_ratio double"))
    rows = mix.select_mix(sized, plan).collect()
    assert {r["doc_id"] for r in rows if r["mix"] == "s"} <= {r["doc_id"] for r in rows if r["mix"] == "l"}


@pytest.mark.parametrize("path", ["relative.json"])
def test_tokenizer_path_is_absolute(spark, path):
    with pytest.raises(ValueError, match="absolute"):
        tokenize.encode_corpus(spark.createDataFrame([(1, "a")], "doc_id long, text string"), tokenizer=path)
