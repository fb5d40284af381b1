"""Joins, procedures and graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actlens.functions import text
from actlens.operators import graph, joins, procedures
from actlens.operators.views import ACTS_SQL, ATTACHMENTS_SQL, acts, attachments
from actlens.plans.registry import query
from actlens.session import table


@query(
    """with files as (select notice_id, regexp_extract(unnest(allegati), '([^/?#]*)(?:[?#].*)?$', 1) as pdf_name from notices),
    firsts as (select pdf_name, min(notice_id) as notice_id from files group by 1)
    select f.pdf_name, f.notice_id, coalesce(n.oggetto, n.titolo) as oggetto, coalesce(nullif(trim(n.tipologia), ''), 'unknown') as doc_type from firsts f left join notices n using (notice_id)"""
)
def metadata_merge(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "notices")
    files = n.select("notice_id", F.explode("allegati").alias("link")).select("notice_id", F.regexp_extract("link", r"([^/?#]*)(?:[?#].*)?$", 1).alias("pdf_name"))
    firsts = joins.first_by(files, "pdf_name", "notice_id", ["notice_id"])
    meta = n.select("notice_id", F.coalesce("oggetto", "titolo").alias("oggetto"), F.coalesce(F.nullif(F.trim("tipologia"), F.lit("")), F.lit("unknown")).alias("doc_type"))
    return firsts.join(meta, "notice_id", "left")


@query(
    """select a.event_id, e.document_number, round(x.importo, 2) as importo from (select event_id from admin_events where economic_value > 1000) a join admin_events e using (event_id)
    left join (select event_id, arg_max(importo, extract_id) as importo from extracted_data where importo is not null group by 1) x using (event_id)"""
)
def audit_join(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "admin_events")
    latest = joins.last_by(table(spark, sf, "extracted_data").where("importo is not null"), "event_id", "extract_id", ["importo"])
    return e.where("economic_value > 1000").select("event_id", "document_number").join(latest, "event_id", "left").select("event_id", "document_number", F.round("importo", 2).alias("importo"))


@query(
    """with f as (select event_id, arg_max(beneficiario_clean, extract_id) as corrected from extracted_data where confidence >= 0.8 and beneficiario_clean is not null group by 1)
    select x.extract_id, coalesce(f.corrected, x.beneficiario_clean) as beneficiario_clean from extracted_data x left join f using (event_id)"""
)
def feedback_update(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "extracted_data")
    best = joins.last_by(x.where("confidence >= 0.8 and beneficiario_clean is not null"), "event_id", "extract_id", ["beneficiario_clean"]).withColumnRenamed("beneficiario_clean", "corrected")
    return joins.updated(x.select("extract_id", "event_id", "beneficiario_clean"), best, "event_id", "beneficiario_clean", "corrected").select("extract_id", "beneficiario_clean")


@query("select c_custkey, n.n_name, r.r_name from customer join nation n on c_nationkey = n_nationkey join region r on n_regionkey = r_regionkey where c_mktsegment in ('MACHINERY', 'HOUSEHOLD')")
def lookup_join(spark: SparkSession, sf: str) -> DataFrame:
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    return c.where(F.col("c_mktsegment").isin("MACHINERY", "HOUSEHOLD")).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select("c_custkey", "n_name", "r_name")


@query(
    """select s.s_suppkey, p.p_name as best, round(100.0 * (1 - levenshtein(lower(s.s_name), lower(p.n)) / greatest(length(s.s_name), length(p.n))), 4) as score
    from supplier s join (select s_suppkey + 1 as k, s_name as n, s_name as p_name from supplier) p on p.k = s.s_suppkey"""
)
def name_similarity(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    other = s.select((F.col("s_suppkey") + 1).alias("k"), F.col("s_name").alias("best"))
    return s.join(other, s["s_suppkey"] == other["k"]).select("s_suppkey", "best", joins.similarity(F.lower("s_name"), F.lower("best")).alias("score"))


@query()
def fuzzy_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Subjects of notices matched to the most similar title of an event."""
    n = table(spark, sf, "notices").where("oggetto is not null").select("notice_id", text.semantic_key(F.col("oggetto")).alias("key"))
    e = table(spark, sf, "admin_events").where("title is not null").select("event_id", text.semantic_key(F.col("title")).alias("key"))
    return joins.nearest_match(n, e, "notice_id", "event_id", "key", least=60.0)


_EVENTS_SQL = """
norm as (select event_id, coalesce('CIG_' || nullif(regexp_replace(upper(trim(cig)), '^(CIG|CUP)\\s*:?\\s*', ''), ''), 'CUP_' || nullif(regexp_replace(upper(trim(cup)), '^(CIG|CUP)\\s*:?\\s*', ''), ''),
           'HASH_' || substring(sha1(coalesce(title, '') || '_' || coalesce(strftime(document_date, '%Y-%m-%d'), '') || '_' || coalesce(ente, '')), 1, 16)) as procedure_id,
         case upper(trim(event_type)) when 'IMPEGNO' then 'Impegno di spesa' when 'IMPEGNO DI SPESA' then 'Impegno di spesa' when 'AFFIDAMENTO' then 'Affidamento' when 'LIQUIDAZIONE' then 'Liquidazione'
           when 'PAGAMENTO' then 'Pagamento' when 'NOMINA' then 'Nomina' when 'SELEZIONE' then 'Selezione' else 'Altro' end as event_type,
         cast(economic_value as decimal(18,2)) as value, document_date, title, actors from admin_events)
"""


@query("with " + _EVENTS_SQL + "select event_id, procedure_id, event_type from norm")
def event_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return procedures.normalized_events(table(spark, sf, "admin_events")).select("event_id", "procedure_id", "event_type")


@query(
    "with "
    + _EVENTS_SQL
    + """select procedure_id, count(*) as events, coalesce(sum(value), 0) as total, min(document_date) as starts, max(document_date) as ends, arg_min(title, event_id) as title,
    string_agg(distinct event_type, ',' order by event_type) as kinds from norm group by 1"""
)
def procedure_fold(spark: SparkSession, sf: str) -> DataFrame:
    return procedures.fold(table(spark, sf, "admin_events"))


@query(
    "with "
    + _EVENTS_SQL
    + """, k as (select procedure_id, event_type, count(*) n from norm group by 1, 2),
    s as (select procedure_id, sum(n) e, max(n) m, bool_or(event_type = 'Liquidazione') paid, bool_or(event_type = 'Impegno di spesa') committed from k group by 1),
    payees as (select procedure_id, a.name as payee from (select procedure_id, unnest(actors) as a from norm) where upper(a.actor_type) = 'BENEFICIARIO' and a.name is not null and a.name not in ('NON IDENTIFICATO', 'DIVERSI/NON APPLICABILE'))
    select procedure_id, 'FRAMMENTAZIONE' as anomaly from s where e >= 3 and m >= e * 0.6
    union all select procedure_id, 'INCOMPLETA' from s where paid and not committed
    union all select distinct procedure_id, 'ROTAZIONE' from payees where payee in (select payee from payees group by 1 having count(*) >= 3)"""
)
def procedure_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return procedures.anomalies(table(spark, sf, "admin_events"))


_GRAPH_SQL = f"""
with {ACTS_SQL}, {ATTACHMENTS_SQL},
base as (select pdf_name as atto_group, t.responsabile, x.beneficiario, t.cig, x.capitolo, x.doc_type, x.importo from attachments x join acts t on t.o_orderkey = x.act),
edges as (
  select 'RUP:' || responsabile as src, 'ATTO:' || atto_group as dst, 'FIRMA_O_GESTISCE' as relation, cast(null as decimal(18,2)) as amount from base
  union all select 'ATTO:' || atto_group, 'BEN:' || beneficiario, case when doc_type in ('Determinazione', 'VistoContabile') then 'LIQUIDA' else 'AFFIDA' end, importo from base
  union all select 'ATTO:' || atto_group, 'CIG:' || upper(cig), 'RIFERISCE_A', null from base where cig is not null
  union all select 'ATTO:' || atto_group, 'CAP:' || cast(capitolo as varchar), 'GRAVA_SU', null from base),
simple as (select distinct src, dst from edges)
"""


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    a = acts(spark, sf).select("o_orderkey", "responsabile", "cig")
    x = attachments(spark, sf)
    return graph.edges(x.join(a, x["act"] == a["o_orderkey"]).withColumn("atto_group", F.col("pdf_name")))


@query(_GRAPH_SQL + "select src, dst, relation, amount from edges")
def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf)


@query(_GRAPH_SQL + "select n as node_id, split_part(n, ':', 1) as node_type, regexp_replace(n, '^[A-Z]+:', '') as label from (select src as n from edges union select dst from edges)")
def graph_nodes_built(spark: SparkSession, sf: str) -> DataFrame:
    return graph.nodes(_edges(spark, sf))


@query(
    _GRAPH_SQL
    + """, d as (select n as node_id, sum(i) as in_degree, sum(o) as out_degree from (select src n, 0 i, 1 o from simple union all select dst, 1, 0 from simple) group by 1), c as (select count(*) - 1 as n from d)
    select node_id, in_degree, out_degree, round(in_degree / n, 9) as in_centrality, round(out_degree / n, 9) as out_centrality, round((in_degree + out_degree) / n, 9) as centrality from d, c"""
)
def degree_centrality(spark: SparkSession, sf: str) -> DataFrame:
    return graph.centrality(_edges(spark, sf))


@query(_GRAPH_SQL + "select dst as node_id, count(distinct src) as acts, sum(amount) as volume from edges where relation in ('LIQUIDA', 'AFFIDA') group by 1 order by acts desc, volume desc, node_id limit 20")
def top_beneficiary_volume(spark: SparkSession, sf: str) -> DataFrame:
    e = _edges(spark, sf).where(F.col("relation").isin("LIQUIDA", "AFFIDA"))
    return e.groupBy(F.col("dst").alias("node_id")).agg(F.countDistinct("src").alias("acts"), F.sum("amount").alias("volume")).orderBy(F.desc("acts"), F.desc("volume"), "node_id").limit(20)


@query(
    _GRAPH_SQL
    + """, one as (select dst n from simple where src = 'BEN:Supplier#000000001' union select src from simple where dst = 'BEN:Supplier#000000001'),
    two as (select dst n from simple where src in (select dst from simple where src = 'BEN:Supplier#000000001')),
    around as (select src n from simple where src in (select src from simple where dst = 'BEN:Supplier#000000001') or dst in (select src from simple where dst = 'BEN:Supplier#000000001')
      union select dst from simple where src in (select src from simple where dst = 'BEN:Supplier#000000001') or dst in (select src from simple where dst = 'BEN:Supplier#000000001')),
    m as (select n from one union select n from two union select n from around union select 'BEN:Supplier#000000001')
    select src, dst from simple where src in (select n from m) and dst in (select n from m)"""
)
def ego_two_hop(spark: SparkSession, sf: str) -> DataFrame:
    return graph.ego(_edges(spark, sf), "BEN:Supplier#000000001")


@query(
    r"""with k as (select node_id, label, trim(regexp_replace(regexp_replace(regexp_replace(lower(label), '[^\p{L}\p{N}\s]', ' ', 'g'), '\b(srl|spa|snc|sas|ditta|impresa|dott|ing|arch|geom|avv|di|del|della)\b', ' ', 'g'), '\s+', ' ', 'g')) as key
      from graph_nodes where node_type = 'Beneficiario' and label is not null)
    select 'BEN_' || min(node_id) as entity_id, key, arg_min(label, node_id) as canonical, string_agg(distinct label, '|' order by label) as aliases from k group by key"""
)
def entity_resolution(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "graph_nodes").where("node_type = 'Beneficiario' and label is not null")
    return graph.entities(n, "BEN", "label", "node_id", text.entity_key(F.col("label")))


@query(
    f"""with {ACTS_SQL}, t as (select '<urn:acts:' || regexp_replace('atto/' || atto_group, '[^\\p{{L}}\\p{{N}}:_-]', '_', 'g') || '>' as s, * from acts)
    select s, 'rdf:type' as p, 'foaf:Document' as o from t union all select s, 'dct:identifier', '"' || atto_group || '"^^xsd:string' from t
    union all select s, 'dct:date', '"' || strftime(data_parsed, '%Y-%m-%d') || '"^^xsd:date' from t union all select s, 'pc:price', '"' || cast(importo as varchar) || '"^^xsd:decimal' from t
    union all select s, 'dct:creator', '<urn:acts:' || regexp_replace('rup/' || responsabile, '[^\\p{{L}}\\p{{N}}:_-]', '_', 'g') || '>' from t
    union all select s, 'pc:supplier', '<urn:acts:' || regexp_replace('ben/' || beneficiario, '[^\\p{{L}}\\p{{N}}:_-]', '_', 'g') || '>' from t
    union all select s, 'pc:cig', '"' || cig || '"^^xsd:string' from t where cig is not null"""
)
def rdf_triples(spark: SparkSession, sf: str) -> DataFrame:
    return graph.triples(acts(spark, sf))


@query("select node_id, arg_max(area, node_id) filter (area is not null) as area, max(label) as label from graph_nodes group by 1")
def merged_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.merged_nodes(table(spark, sf, "graph_nodes"), "node_id", "node_id", ["area", "label"])


@query("""select ente, count(*) as notices, count(distinct batch_no) as batches, (select nome from enti e where e.ente = n.ente) as nome from notices n group by ente""")
def tenant_overview(spark: SparkSession, sf: str) -> DataFrame:
    per = table(spark, sf, "notices").groupBy("ente").agg(F.count(F.lit(1)).alias("notices"), F.countDistinct("batch_no").alias("batches"))
    return per.join(table(spark, sf, "enti").select("ente", "nome"), "ente", "left")
