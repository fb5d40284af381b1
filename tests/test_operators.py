"""Facts about operators on small fixtures."""

import datetime
from xml.etree import ElementTree

from pyspark.sql import functions as F

from actlens.operators import audit, dedup, extract, graph, procedures, quality, retrieval, rollup
from actlens.sources import sinks, tables

EVENT = "event_id long, ente string, event_type string, title string, document_date timestamp, economic_value double, cig string, cup string, actors array<struct<name:string,actor_type:string,role:string,area:string>>"


def events(spark, rows):
    return spark.createDataFrame([(i, "e", k, "t", datetime.datetime(2024, 1, 1), v, cig, None, a) for i, (k, v, cig, a) in enumerate(rows)], EVENT)


def test_events_of_one_cig_are_one_procedure(spark):
    row = procedures.fold(events(spark, [("AFFIDAMENTO", 60000.0, "CIG AB1234567C", []), ("Impegno di spesa", 40000.0, "ab1234567c", [])])).collect()
    assert len(row) == 1
    assert row[0]["procedure_id"] == "CIG_AB1234567C"
    assert float(row[0]["total"]) == 100000.0


def test_equal_events_are_fragmentation(spark):
    found = procedures.anomalies(events(spark, [("AFFIDAMENTO", 1.0, "X", [])] * 5), least_events=5, modal_share=0.8).collect()
    assert [r["anomaly"] for r in found] == ["FRAMMENTAZIONE"]


def test_unknown_event_types_become_altro(spark):
    kinds = [r["event_type"] for r in procedures.normalized_events(events(spark, [(None, None, None, None), ("boh", 1.0, None, None)])).collect()]
    assert kinds == ["Altro", "Altro"]


def test_roll_up_prefers_the_visa(spark):
    rows = [("1_1.pdf", 1, "Determinazione", 10, 5, "A", True, False, 3), ("1_2.pdf", 2, "VistoContabile", 7, 6, "B", False, True, 4), (None, 3, "Delibera", None, None, None, False, False, 1)]
    df = spark.createDataFrame(rows, "pdf_name string, seq long, doc_type string, importo int, capitolo int, beneficiario string, is_signed boolean, accounting_relevant boolean, veracity int")
    out = {r["atto_group"]: r for r in rollup.roll_up(df).collect()}
    assert out["1"]["importo_max"] == 7
    assert out["1"]["beneficiario"] == "B"
    assert out["1"]["doc_type"] == "Determinazione"
    assert out["1"]["veracity"] == 24
    assert out[None]["importo_max"] is None


def test_risk_is_bounded(spark):
    df = spark.createDataFrame([(1,)], "a int")
    rules = [("x", 70, F.lit(True)), ("y", 70, F.lit(True)), ("z", 1, F.lit(None).cast("boolean"))]
    row = audit.scored(df, rules).first()
    assert row["risk_score"] == 100
    assert row["flags"] == "x | y"


def test_content_dedup_is_idempotent_and_keeps_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "i int, t string")
    once = dedup.first_per_content(df, "t", "i")
    assert sorted(r["i"] for r in once.collect()) == [1, 3, 4, 5]
    assert sorted(r["i"] for r in dedup.first_per_content(once, "t", "i").collect()) == [1, 3, 4, 5]


def test_chunks_reconstruct_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(1050))
    df = spark.createDataFrame([(1, text), (2, "short"), (3, "")], "i int, t string")
    parts = retrieval.fixed_chunks(df, "i", "t", 100, 10).orderBy("i", "chunk_no").collect()
    mine = [r["chunk"] for r in parts if r["i"] == 1]
    assert mine[0] + "".join(c[10:] for c in mine[1:]) == text
    assert [r["chunk"] for r in parts if r["i"] == 2] == ["short"]


def test_layout_of_a_text_without_marks(spark):
    kind, conf = extract.layout(F.col("t"))
    row = spark.createDataFrame([("niente",)], "t string").select(kind.alias("k"), conf.alias("c")).first()
    assert (row["k"], row["c"]) == ("SCONOSCIUTO", 0.4)


def test_routes(spark):
    kind, event = extract.route(F.col("t"))
    rows = [("Determinazione n. 5 - di liquidare la somma di euro 1",), ("Bando di gara n. 3",), ("boh",)]
    got = [(r["k"], r["e"]) for r in spark.createDataFrame(rows, "t string").select(kind.alias("k"), event.alias("e")).collect()]
    assert got == [("DETERMINA", "LIQUIDAZIONE"), ("BANDO", "ALTRO"), ("ALTRO", "ALTRO")]


def test_sentinels_make_no_nodes(spark):
    df = spark.createDataFrame([("a1", "NON IDENTIFICATO", "Rossi", None, 5, "Determinazione", 10)], "atto_group string, responsabile string, beneficiario string, cig string, capitolo int, doc_type string, importo int")
    assert sorted(r["relation"] for r in graph.edges(df).collect()) == ["GRAVA_SU", "LIQUIDA"]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "i int, t string")
    assert retrieval.fixed_chunks(empty, "i", "t").count() == 0
    assert retrieval.postings(empty, "i", "t").count() == 0
    assert dedup.first_per_content(empty, "t", "i").count() == 0
    assert graph.centrality(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_markdown_schema():
    assert tables.markdown_schema("| Col | Type |\n|---|---|\n| `a` | String |\n| b | float |\n") == {"a": "string", "b": "float"}


def test_json_array_with_nan(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"a": 1, "b": NaN}, {"a": 2, "b": 3.5}]')
    assert [tuple(r) for r in tables.read_json_array(spark, str(tmp_path / "x.json"), "a:int,b:double").collect()] == [(1, None), (2, 3.5)]


def test_append_unseen(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert tables.append_unseen(first, path, "k").count() == 2
    assert [r["k"] for r in tables.append_unseen(spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int"), path, "k").collect()] == ["c"]
    assert spark.read.parquet(path).count() == 3


def test_gexf(spark, tmp_path):
    (tmp_path / "g.gexf").write_text('<gexf><graph><nodes><node id="1" label="A"/><node id="2" label="B"/></nodes><edges><edge id="0" source="1" target="2"/></edges></graph></gexf>')
    nodes, edges = tables.read_gexf(spark, str(tmp_path / "g.gexf"))
    assert sorted(tuple(r) for r in nodes.collect()) == [("1", "A"), ("2", "B")]
    assert [tuple(r) for r in edges.collect()] == [("1", "2")]


def test_gexf_of_several_files_is_read_whole(spark, tmp_path):
    names = [f'A & <B{i}> "x"' for i in range(60)]
    edges = spark.createDataFrame([(f"ATTO:{n}", f"BEN:{i:03}", "LIQUIDA") for i, n in enumerate(names)], "src string, dst string, relation string").repartition(5)
    sinks.write_graph(sinks.graph_lines(graph.nodes(edges), edges, "gexf"), str(tmp_path / "g"))
    files = sorted((tmp_path / "g").glob("part=*/part-*"))
    assert len({f.parent for f in files}) == 5 and sum(f.parent.name == "part=3" for f in files) > 1
    (tmp_path / "one.gexf").write_text("".join(f.read_text() for f in files))
    assert len(ElementTree.parse(tmp_path / "one.gexf").findall(".//edge")) == 60
    for path in ("g", "one.gexf"):
        nodes, links = tables.read_gexf(spark, str(tmp_path / path))
        assert {r["label"] for r in nodes.collect()} == {*names, *(f"{i:03}" for i in range(60))}
        assert {tuple(r) for r in links.collect()} == {(f"ATTO:{n}", f"BEN:{i:03}") for i, n in enumerate(names)}


def test_gexf_of_others(spark, tmp_path):
    text = """<gexf><!-- <node id="0" label="hidden"/> --><graph><nodes count="2"><node label='a id="7" > b' id = '007'><attvalues/></node>
    <node
      id="8"/><nodeX id="9"/></nodes><edges><edge id="0" weight="1" target="8" source="caff&#232;"/></edges></graph></gexf>"""
    (tmp_path / "g.gexf").write_text(text)
    nodes, edges = tables.read_gexf(spark, str(tmp_path / "g.gexf"))
    assert sorted(tuple(r) for r in nodes.collect()) == [("007", 'a id="7" > b'), ("8", None)]
    assert [tuple(r) for r in edges.collect()] == [("caffè", "8")]
    (tmp_path / "e.gexf").write_text("<gexf><graph><nodes/><edges/></graph></gexf>")
    assert [x.count() for x in tables.read_gexf(spark, str(tmp_path / "e.gexf"))] == [0, 0]


def test_conform_and_report(spark):
    df = spark.createDataFrame([("1", "x")], "a string, b string")
    assert quality.conform(df, {"a": "int", "c": "double"}).first().asDict() == {"a": 1, "c": None}
    assert {r["column"]: r["status"] for r in quality.schema_report(df, {"a": "int", "b": "string", "c": "int"}).collect()} == {"a": "type", "b": "ok", "c": "missing"}


def test_partitioning_changes_nothing(spark):
    df = spark.range(200).selectExpr("id as i", "concat('w', id % 7, ' common') as t")
    a = sorted(map(tuple, retrieval.postings(df, "i", "t").select("token", "df").collect()))
    assert a == sorted(map(tuple, retrieval.postings(df.repartition(13), "i", "t").select("token", "df").collect()))
