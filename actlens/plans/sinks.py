"""Round trips through the sinks, and the small readers, filters and functions beside them; SQL is written on the source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actlens.functions import arrays
from actlens.operators import graph, learning, procedures, quality
from actlens.operators.audit import audit
from actlens.operators.views import ACTS_SQL, ATTACHMENTS_SQL, acts, attachments
from actlens.plans import audit as _audit_queries  # noqa: F401  (registers the SQL of the audit)
from actlens.plans.registry import ORACLE, query
from actlens.plans.relations import _GRAPH_SQL, _edges
from actlens.session import scratch, table
from actlens.sources import sinks, tables


@query(
    f"""with {ACTS_SQL}, {ATTACHMENTS_SQL} select * from (select 'pdf_analisi' as sheet, count(*) as rows from attachments union all select 'kpi_source', count(distinct source) from attachments union all select 'kpi_visto_contabile', count(*) from (select distinct source from attachments where doc_type = 'VistoContabile')
    union all select 'kpi_doctype', count(distinct doc_type) from attachments union all select 'features_ml', count(*) from documents union all select 'fornitori_top50', least(50, count(distinct beneficiario)) from attachments union all select 'atti_estratti', count(*) from acts
    union all select 'metadati', count(*) from notices union all select 'revisione_ml', count(*) from documents where doc_type is null union all select 'anomalie_da_addestrare', count(*) from documents where n_chars < 120)"""
)
def workbook_sheets(spark: SparkSession, sf: str) -> DataFrame:
    """The ten sheets of the workbook written as CSV folders and counted when read back."""
    x, docs, path = attachments(spark, sf), table(spark, sf, "documents"), scratch(spark)
    sheets = {
        "pdf_analisi": x,
        "kpi_source": x.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("importo").alias("total")),
        "kpi_visto_contabile": x.where("doc_type = 'VistoContabile'").groupBy("source").agg(F.count(F.lit(1)).alias("n")),
        "kpi_doctype": x.groupBy("doc_type").agg(F.count(F.lit(1)).alias("n")),
        "features_ml": docs.select("doc_id", "n_chars", "lang"),
        "fornitori_top50": x.groupBy("beneficiario").agg(F.sum("importo").alias("total")).orderBy(F.desc("total"), "beneficiario").limit(50),
        "atti_estratti": acts(spark, sf),
        "metadati": table(spark, sf, "notices").select("notice_id", "ente", "batch_no"),
        "revisione_ml": docs.where("doc_type is null").select("doc_id"),
        "anomalie_da_addestrare": docs.where("n_chars < 120").select("doc_id"),
    }
    tables.write_sheets(sheets, path)
    counted = [sinks.read_sheet(spark, path, name, f"{df.columns[0]} string").agg(F.lit(name).alias("sheet"), F.count(F.lit(1)).alias("rows")) for name, df in sheets.items()]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out


@query("select ente, count(*) as texts, sum(length(text)) as signs from documents where text is not null and ente is not null group by 1")
def corpus_texts(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark)
    sinks.write_documents(table(spark, sf, "documents").where("ente is not null").select("doc_id", "ente", "text"), path, "doc_id", "text", "ente")
    back = spark.read.text(f"{path}/texts").select("ente", F.from_json("value", "doc_id bigint, text string").alias("x"))
    return back.groupBy("ente").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.length("x.text")).alias("signs"))


@query(
    """with e as (select event_id, title, economic_value from admin_events where title is not null) select title, count(*) as events, cast(sum(coalesce(cast(economic_value as decimal(18,2)), 0)) as decimal(28,2)) as total from e group by 1"""
)
def procedures_json(spark: SparkSession, sf: str) -> DataFrame:
    """Totals written as JSON objects and read back."""
    path = scratch(spark)
    e = table(spark, sf, "admin_events").where("title is not null").groupBy("title").agg(F.count(F.lit(1)).alias("events"), F.sum(F.coalesce(F.col("economic_value").cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))).cast("decimal(28,2)").alias("total"))
    sinks.write_json(e, path)
    return sinks.read_json_rows(spark, path, "title string, events bigint, total decimal(28,2)")


@query("select count(*) as procedures from (select distinct upper(regexp_extract(cig, '([A-Za-z0-9]{10})', 1)) as c from admin_events where regexp_matches(cig, '[A-Za-z0-9]{10}'))")
def procedures_written(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark)
    sinks.write_json(procedures.fold(table(spark, sf, "admin_events")), path)
    back = sinks.read_json_rows(spark, path, "procedure_id string, events bigint")
    return back.where(F.col("procedure_id").startswith("CIG_")).agg(F.count(F.lit(1)).alias("procedures"))


@query(_GRAPH_SQL + "select 'node' as kind, count(*) as n from (select src from edges union select dst from edges) union all select 'edge', count(*) from edges")
def gexf_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    edges, path = _edges(spark, sf), scratch(spark)
    sinks.write_graph(sinks.graph_lines(graph.nodes(edges), edges, "gexf"), path)
    counts = tables.gexf_elements(spark, path).agg(*(F.struct(F.lit(kind).alias("kind"), F.count(ident).alias("n")).alias(kind) for kind, ident in (("node", "node_id"), ("edge", "src"))))
    return counts.select(F.inline(F.array("node", "edge")))


@query(_GRAPH_SQL + "select relation, count(*) as n from edges group by 1")
def graphml_document(spark: SparkSession, sf: str) -> DataFrame:
    edges, path = _edges(spark, sf), scratch(spark)
    sinks.write_graph(sinks.graph_lines(graph.nodes(edges), edges, "graphml"), path)
    found = spark.read.text(path).where(F.col("value").startswith("<edge "))
    return found.groupBy(F.regexp_extract("value", '<data key="relation">([^<]*)</data>', 1).alias("relation")).agg(F.count(F.lit(1)).alias("n"))


@query(_GRAPH_SQL + "select p, count(*) as n from (select 'rdf:type' as p from (select src from edges union select dst from edges) union all select 'rdfs:label' from (select src from edges union select dst from edges) union all select 'g:' || lower(relation) from edges) group by 1")
def graph_triples(spark: SparkSession, sf: str) -> DataFrame:
    edges, path = _edges(spark, sf), scratch(spark)
    tables.write_lines(graph.ntriples(sinks.typed_triples(graph.nodes(edges), edges)), path)
    return spark.read.text(path).groupBy(F.regexp_extract("value", r"^<[^>]*> (\S+) ", 1).alias("p")).agg(F.count(F.lit(1)).alias("n"))


@query("select vec_id, label from embeddings")
def vector_index(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors written with their manifest, and read because nothing changed."""
    e, path = table(spark, sf, "embeddings"), scratch(spark)
    sinks.write_vectors(e, path, "vec_id", "embedding")
    return sinks.read_vectors(spark, path, e, "vec_id", "embedding").join(e.select("vec_id", "label"), "vec_id").select("vec_id", "label")


@query("select vec_id from embeddings where false")
def vector_index_refused(spark: SparkSession, sf: str) -> DataFrame:
    e, path = table(spark, sf, "embeddings"), scratch(spark)
    sinks.write_vectors(e, path, "vec_id", "embedding")
    return sinks.read_vectors(spark, path, e.where("vec_id > 0"), "vec_id", "embedding").select("vec_id")


@query(r"select token, count(distinct doc_id) as docs from (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as token from documents where text is not null and text <> '') group by 1")
def index_files(spark: SparkSession, sf: str) -> DataFrame:
    docs, path = table(spark, sf, "documents").where("text is not null and text <> ''"), scratch(spark)
    sinks.write_postings(docs, path, "doc_id", "text")
    return spark.read.parquet(f"{path}/postings").groupBy("token").agg(F.countDistinct("doc_id").alias("docs")).join(spark.read.parquet(f"{path}/vocabulary").select("token"), "token", "left_semi")


@query("select count(*) as n, 0 as changed from documents where text is not null and text <> ''")
def model_file(spark: SparkSession, sf: str) -> DataFrame:
    """A model saved and loaded predicts what it predicted before."""
    docs, path = table(spark, sf, "documents").where("text is not null and text <> ''").select("doc_id", "text", F.coalesce("doc_type", F.lit("none")).alias("category")), scratch(spark)
    model = learning.train(docs, "text", "category", features=200, trees=5)
    sinks.save_model(model, path)
    before, after = (m.transform(docs).select("doc_id", F.col("prediction").alias(f"p{k}")) for k, m in enumerate((model, sinks.load_model(path))))
    return before.join(after, "doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p0") != F.col("p1")).cast("int").alias("changed"))


@query(
    """with d as (select count(*) as t, count(*) filter (text is null) as a, count(*) filter (length(trim(text)) = 0) as b, count(*) filter (n_chars < 120) as c, count(*) filter (lang is null or lang = 'und') as e, count(*) filter (ente is null) as f, count(text) - count(distinct sha256(text)) as g from documents)
    select unnest(['null_text', 'empty_text', 'short_text', 'unknown_language', 'no_ente', 'duplicate_text']) as issue, unnest([a, b, c, e, f, g]) as n from d"""
)
def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    """The Markdown report, by priority and share, read back."""
    path = scratch(spark)
    lines = sinks.markdown(quality.issue_table(table(spark, sf, "documents")), ["priority", "issue", "n", "percent"], [F.asc("priority"), F.desc("percent"), F.asc("issue")])
    lines.orderBy("line_no").coalesce(1).select("value").write.text(path)
    cells = F.split("value", r" \| ")
    return spark.read.text(path).where(F.col("value").startswith("| ") & ~F.col("value").startswith("| priority")).select(F.get(cells, F.lit(1)).alias("issue"), F.get(cells, F.lit(2)).cast("bigint").alias("n"))


@query(
    _GRAPH_SQL
    + ", d as (select n as node_id, count(*) as degree from (select src n from simple union all select dst from simple) group by 1) select row_number() over (order by degree desc, node_id) || '. ' || node_id || ' (' || degree || ')' as line from d order by degree desc, node_id limit 20"
)
def topology_report(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    top = graph.centrality(_edges(spark, sf)).select("node_id", (F.col("in_degree") + F.col("out_degree")).alias("degree")).orderBy(F.desc("degree"), "node_id").limit(20)
    return top.select(F.format_string("%d. %s (%d)", F.row_number().over(Window.orderBy(F.desc("degree"), "node_id")), "node_id", "degree").alias("line"))


@query("select 'notices' as name, count(*)::double as value from notices union all select 'enti', count(distinct ente)::double from notices")
def metrics_json(spark: SparkSession, sf: str) -> DataFrame:
    """A summary from one pass, written as a JSON object and loaded again."""
    path = scratch(spark)
    row = table(spark, sf, "notices").agg(F.count(F.lit(1)).alias("notices"), F.countDistinct("ente").alias("enti")).first()
    sinks.write_text(spark, sinks.summary(row.asDict()), path)
    found = sinks.read_object(spark, path)["summary"] | sinks.read_object(spark, f"{path}-missing")
    return spark.createDataFrame([(k, float(v)) for k, v in found.items()], "name string, value double")


@query("select notice_id, 'ok' as answer from notices where batch_no <= 1")
def feedback_append(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark)
    for n in (0, 1):
        table(spark, sf, "notices").where(F.col("batch_no") == n).select("notice_id", F.lit("ok").alias("answer")).write.mode("append").csv(path, header=True)
    return spark.read.csv(path, header=True, schema="notice_id bigint, answer string")


@query(f"with {ACTS_SQL} select atto_group, importo from acts where importo > 100000 and category = 'Personale'")
def filtered_export(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark)
    acts(spark, sf).where("importo > 100000 and category = 'Personale'").select("atto_group", "importo").write.csv(path, header=True)
    return spark.read.csv(path, header=True, schema="atto_group string, importo decimal(18,2)")


@query("select ente, provincia, popolazione from enti")
def ground_truth_json(spark: SparkSession, sf: str) -> DataFrame:
    """A bounded table as one JSON array, read as an array."""
    path = scratch(spark)
    sinks.write_text(spark, sinks.json_array(table(spark, sf, "enti").select("ente", "provincia", "popolazione")), path)
    return spark.read.json(path, schema="ente string, provincia string, popolazione bigint", multiLine=True)


@query("select ente from notices where ente is not null group by 1")
def tenant_discovery(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark)
    table(spark, sf, "notices").where("ente is not null").select("ente", "notice_id").write.partitionBy("ente").parquet(path)
    return sinks.tenants(spark, sinks.resolve(spark, [f"{path}/missing", path]), "ente")


@query("select ente, list_sort(list(m)) as turns from (select ente, 'q' || batch_no as m from notices where ente is not null group by 1, 2) group by 1")
def chat_history(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of each conversation stored as JSON and loaded."""
    path = scratch(spark)
    turns = table(spark, sf, "notices").where("ente is not null").groupBy("ente").agg(F.array_sort(F.collect_set(F.concat(F.lit("q"), F.col("batch_no").cast("string")))).alias("turns"))
    sinks.write_json(turns, path)
    return sinks.read_json_rows(spark, path, "ente string, turns array<string>")


@query("select least(count(*), 25) as n from documents")
def jsonl_sample(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark)
    table(spark, sf, "documents").select("doc_id", "source").write.json(path)
    return tables.read_jsonl(spark, path, "doc_id bigint, source string").limit(25).agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id, lang from documents where doc_type is null")
def unclassified(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without a class, of the columns asked for those that exist."""
    return sinks.existing(table(spark, sf, "documents").where("doc_type is null"), ["doc_id", "no_such_column", "lang"])


@query(f"with {ATTACHMENTS_SQL} select domain, count(*) as n from (select unnest(['accounting', 'signed']) as domain, unnest([accounting_relevant, is_signed]) as holds from attachments) where holds group by 1")
def domain_filter(spark: SparkSession, sf: str) -> DataFrame:
    x = attachments(spark, sf)
    kinds = F.array(F.when(F.col("accounting_relevant"), "accounting"), F.when(F.col("is_signed"), "signed"))
    return x.select(F.explode(F.array_compact(kinds)).alias("domain")).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@query(f"select atto_group, risk_score from ({ORACLE['audit_risk_score']})")
def risk_order(spark: SparkSession, sf: str) -> DataFrame:
    """Acts by risk, the riskiest first, ties by key."""
    return audit(acts(spark, sf)).select("atto_group", "risk_score").orderBy(F.desc("risk_score"), "atto_group")


@query("select source, lang, count(*) as n from documents where source is not null and lang is not null group by 1, 2 order by 1 asc, 3 desc, 2")
def two_key_order(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("source is not null and lang is not null")
    return d.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.asc("source"), F.desc("n"), "lang")


@query("select e.event_id, x.extract_id from admin_events e left join (select event_id, min(extract_id) as extract_id from extracted_data where event_id is not null group by 1) x using (event_id)")
def keyed_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """What a positional assignment of columns means: the value of the same record, by key."""
    first = table(spark, sf, "extracted_data").where("event_id is not null").groupBy("event_id").agg(F.min("extract_id").alias("extract_id"))
    return table(spark, sf, "admin_events").select("event_id").join(first, "event_id", "left")


@query(r"select notice_id, case when regexp_matches(data_pubblicazione, '^\d{4}-\d{2}-\d{2}$') then data_pubblicazione || 'T00:00:00Z' else data_pubblicazione end as iso from notices")
def normalized_iso(spark: SparkSession, sf: str) -> DataFrame:
    """ISO days and times in UTC; what can't be read passes through."""
    c = F.col("data_pubblicazione")
    read = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.date_format(F.try_to_timestamp(c), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return table(spark, sf, "notices").select("notice_id", F.coalesce(read, c).alias("iso"))


@query("select event_id, coalesce(try_cast(document_number as double), 0) as value from admin_events")
def coerced_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "admin_events").select("event_id", F.coalesce(F.col("document_number").try_cast("double"), F.lit(0.0)).alias("value"))


@query("select event_id, md5(coalesce(title, '') || '|' || coalesce(cig, '')) as key, list_transform(actors, lambda a: a.name) as names from admin_events")
def cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    blank = F.lit("")
    return table(spark, sf, "admin_events").select("event_id", F.md5(F.concat(F.coalesce("title", blank), F.lit("|"), F.coalesce("cig", blank))).alias("key"), F.transform("actors", lambda a: a["name"].cast("string")).alias("names"))


@query(r"select notice_id, len(list_intersect(list_distinct(regexp_extract_all(lower(coalesce(oggetto, '')), '[\p{L}\p{N}_]+')), ['servizio', 'di', 'per', 'gara', 'comunale'])) as shared from notices")
def shared_tokens(spark: SparkSession, sf: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower(F.coalesce("oggetto", F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return table(spark, sf, "notices").select("notice_id", arrays.overlap(words, F.array(*map(F.lit, ("servizio", "di", "per", "gara", "comunale")))).cast("bigint").alias("shared"))


@query("select notice_id, concat_ws(',', case when titolo is null then 'titolo' end, case when dettaglio_url is null then 'dettaglio_url' end, case when allegati is null then 'allegati' end) as missing from notices where titolo is null or dettaglio_url is null or allegati is null")
def adapter_check(spark: SparkSession, sf: str) -> DataFrame:
    """Records that lack what an adapter must give."""
    gone = F.concat_ws(",", *(F.when(F.col(c).isNull(), F.lit(c)) for c in ("titolo", "dettaglio_url", "allegati")))
    return table(spark, sf, "notices").select("notice_id", gone.alias("missing")).where("missing <> ''")


@query("select extract_id, importo is not null and importo > 0 and coalesce(beneficiario_raw, 'NON IDENTIFICATO') <> 'NON IDENTIFICATO' as validated from extracted_data")
def ground_truth_flag(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "extracted_data")
    return x.select("extract_id", (F.coalesce(F.col("importo") > 0, F.lit(False)) & (F.coalesce("beneficiario_raw", F.lit("NON IDENTIFICATO")) != "NON IDENTIFICATO")).alias("validated"))
