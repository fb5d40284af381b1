"""Composite records, review lists, orders and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actlens.functions import numbers
from actlens.operators import extract, records
from actlens.operators.views import ATTACHMENTS_SQL, attachments
from actlens.plans.extraction import _AMOUNTS
from actlens.plans.registry import query
from actlens.plans.relations import _GRAPH_SQL, _edges
from actlens.session import table


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "admin_events").where("raw_text is not null")


def _re(pattern: str) -> str:
    return pattern.replace("'", "''")


@query(
    f"""select event_id, coalesce(upper(nullif(regexp_extract(raw_text, '{_re(records.ROLE)}', 1), '')), 'NON IDENTIFICATO') as role, coalesce(trim(nullif(regexp_extract(raw_text, '{_re(records.OFFICER)}', 1), '')), 'NON IDENTIFICATO') as area,
    coalesce(upper(trim(nullif(regexp_extract(raw_text, '{_re(records.OFFICER)}', 2), ''))), 'NON IDENTIFICATO') as name from admin_events where raw_text is not null"""
)
def actor_triple(spark: SparkSession, sf: str) -> DataFrame:
    role, area, name = records.parties(F.col("raw_text"))
    return _texts(spark, sf).select("event_id", role.alias("role"), area.alias("area"), name.alias("name"))


@query(
    f"""with x as (select event_id, cast(round(try_cast(replace(replace(regexp_replace(nullif(regexp_extract(raw_text, '{records.LIQUIDATED}', 1), ''), '^([\\d.]+)$', '\\1,00'), '.', ''), ',', '.') as double) * 100) as bigint) as paid, list_max({_AMOUNTS}) as largest
      from admin_events where raw_text is not null)
    select event_id, coalesce(paid, largest) as cents, case when paid is not null then 'liquidated' when largest is not null then 'largest' end as origin from x"""
)
def liquidated_amount(spark: SparkSession, sf: str) -> DataFrame:
    cents, origin = records.chosen_amount(F.col("raw_text"))
    return _texts(spark, sf).select("event_id", cents.alias("cents"), origin.alias("origin"))


@query("select event_id, " + ", ".join(f"regexp_matches(raw_text, '{_re(p)}') as {n}" for n, p in records.RELEVANCE.items()) + " from admin_events where raw_text is not null")
def relevance_vector(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("event_id", *records.relevance(F.col("raw_text")))


@query(" union all ".join(f"select event_id, '{k}' as kind, trim(unnest(regexp_extract_all(raw_text, '({_re(p)})', 1))) as description from admin_events where raw_text is not null" for k, p in records.COMPETENCES.items()))
def personnel_competences(spark: SparkSession, sf: str) -> DataFrame:
    return records.competences(_texts(spark, sf), "event_id", "raw_text")


@query(f"select event_id, len(regexp_extract_all(raw_text, '({records.PROPER})')) as names from admin_events where raw_text is not null")
def proper_names(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("event_id", F.size(F.regexp_extract_all("raw_text", F.lit(f"({records.PROPER})"), F.lit(1))).alias("names"))


@query(
    """select notice_id, round(least(case when contains(lower(coalesce(titolo, '')), k) then 0.4 else 0.0 end + case when contains(lower(coalesce(oggetto, '')), k) then 0.3 else 0.0 end + case when contains(lower(coalesce(dettaglio_url, '')), k) then 0.3 else 0.0 end, 1.0), 4)::double as confidence
    from (select *, lower(substring(coalesce(tipologia, '?'), 1, 3)) as k from notices)"""
)
def kind_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "notices").select("notice_id", records.kind_confidence(F.col("titolo"), F.col("oggetto"), F.col("dettaglio_url"), F.col("tipologia")).alias("confidence"))


@query(
    """with best as (select event_id, arg_max(importo, extract_id) as v from extracted_data where importo is not null group by 1)
    select e.event_id, coalesce(e.economic_value, b.v) as economic_value, coalesce(e.document_number, 'n.d.') as document_number from admin_events e left join best b using (event_id)"""
)
def review_merge(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "admin_events").select("event_id", "economic_value", F.coalesce("document_number", F.lit("n.d.")).alias("document_number"))
    x = table(spark, sf, "extracted_data").where("importo is not null").groupBy("event_id").agg(F.max_by("importo", "extract_id").alias("economic_value"))
    return records.filled(e, x, "event_id", ["economic_value"])


@query()
def metadata_record(spark: SparkSession, sf: str) -> DataFrame:
    return records.metadata_record(_texts(spark, sf), "event_id", "raw_text")


@query(
    """with c as (select node_id, unnest([case when node_type = 'CIG' and not coalesce(regexp_matches(codice, '^[A-Z0-9]{10}$'), false) then 'codice' end, case when coalesce(trim(label), '') = '' then 'label' end,
      case when metadata.confidence_score < 0 or metadata.confidence_score > 1 then 'confidence' end,
      case when partita_iva is not null and not (regexp_matches(partita_iva, '^\\d{11}$') and list_sum(list_transform(range(1, 12), lambda i: case when i % 2 = 1 then try_cast(partita_iva[i] as int) else case when 2 * try_cast(partita_iva[i] as int) > 9 then 2 * try_cast(partita_iva[i] as int) - 9 else 2 * try_cast(partita_iva[i] as int) end end)) % 10 = 0) then 'partita_iva' end]) as problem from graph_nodes)
    select node_id, problem from c where problem is not null"""
)
def graph_validation(spark: SparkSession, sf: str) -> DataFrame:
    return records.invalid_nodes(table(spark, sf, "graph_nodes"))


@query(_GRAPH_SQL + "select src as node_id, count(*) as out_degree from simple where src like 'RUP:%' group by 1 order by out_degree desc, node_id limit 10")
def top_officers_graph(spark: SparkSession, sf: str) -> DataFrame:
    e = _edges(spark, sf).select("src", "dst").distinct().where(F.col("src").startswith("RUP:"))
    return e.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("out_degree")).orderBy(F.desc("out_degree"), "node_id").limit(10)


@query(
    f"""with {ATTACHMENTS_SQL}, c as (select *, case doc_type when 'VistoContabile' then 'high' when 'Determinazione' then 'ml_predicted' else cast(veracity / 100.0 as varchar) end as label from attachments),
    s as (select *, case label when 'high' then 0.95 when 'ml_predicted' then 0.85 else coalesce(try_cast(label as double), 0.4) end as conf from c)
    select doc_type, count(*) as rows, count(*) filter (conf >= 0.85 or label = 'ml_predicted') as certified, sum(case when conf >= 0.85 or label = 'ml_predicted' then importo else 0 end) as certified_spend from s group by 1"""
)
def certified_spend(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("doc_type") == "VistoContabile", "high").when(F.col("doc_type") == "Determinazione", "ml_predicted").otherwise((F.col("veracity") / 100.0).cast("string"))
    c = attachments(spark, sf).withColumn("label", label).withColumn("conf", numbers.confidence(F.col("label")))
    sure = (F.col("conf") >= 0.85) | (F.col("label") == "ml_predicted")
    return c.groupBy("doc_type").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(sure, 1)).alias("certified"), F.sum(F.when(sure, F.col("importo")).otherwise(0)).alias("certified_spend"))


@query(
    """select title, arg_max(kind, p * 1000000 - event_id) as best_type from (select title, event_id, upper(document_type) as kind, case when upper(document_type) in ('DETERMINA', 'DETERMINAZIONE', 'DELIBERA', 'ORDINANZA') then 100 when upper(document_type) in ('BANDO', 'AVVISO') then 50 else 10 end as p
      from admin_events where title is not null and document_type is not null) group by 1"""
)
def best_type_per_subject(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.upper("document_type")
    p = F.when(kind.isin("DETERMINA", "DETERMINAZIONE", "DELIBERA", "ORDINANZA"), 100).when(kind.isin("BANDO", "AVVISO"), 50).otherwise(10)
    return table(spark, sf, "admin_events").where("title is not null and document_type is not null").groupBy("title").agg(F.max_by(kind, F.struct(p, -F.col("event_id"))).alias("best_type"))


@query("select event_id, document_date, economic_value from admin_events order by document_date asc nulls last, economic_value desc nulls last, event_id limit 200")
def ordered_sample(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "admin_events").select("event_id", "document_date", "economic_value")
    return e.orderBy(F.asc_nulls_last("document_date"), F.desc_nulls_last("economic_value"), "event_id").limit(200)


@query("select notice_id from notices order by md5(cast(notice_id as varchar) || '-42'), notice_id limit 50")
def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A sample that any engine draws alike: the least hashes of id and seed."""
    return table(spark, sf, "notices").orderBy(F.md5(F.concat(F.col("notice_id").cast("string"), F.lit("-42"))), "notice_id").select("notice_id").limit(50)


@query(
    """select extract_id, (case when coalesce(trace.ocr_confidence, 1.0) >= 0.6 then 50 else 0 end) + (case when financial_extract_enabled then 50 else 0 end) as compliance,
    case when layout is null or coalesce(trace.ocr_confidence, 0) < 0.3 then 'failed' when confidence < 0.5 then 'ambiguous' else 'ok' end as status, concat_ws(' | ', case when beneficiario_raw is null then 'BENEFICIARIO_ASSENTE' end, case when coalesce(trace.ocr_confidence, 1.0) < 0.6 then 'LOW_OCR' end,
      case when importo is null then 'NO_IMPORTO' end) as flags from extracted_data"""
)
def visto_parse(spark: SparkSession, sf: str) -> DataFrame:
    ocr = F.col("trace.ocr_confidence")
    return table(spark, sf, "extracted_data").select(
        "extract_id",
        (F.when(F.coalesce(ocr, F.lit(1.0)) >= 0.6, 50).otherwise(0) + F.when(F.col("financial_extract_enabled"), 50).otherwise(0)).alias("compliance"),
        F.when(F.col("layout").isNull() | (F.coalesce(ocr, F.lit(0.0)) < 0.3), "failed").when(F.col("confidence") < 0.5, "ambiguous").otherwise("ok").alias("status"),
        F.concat_ws(" | ", F.when(F.col("beneficiario_raw").isNull(), "BENEFICIARIO_ASSENTE"), F.when(F.coalesce(ocr, F.lit(1.0)) < 0.6, "LOW_OCR"), F.when(F.col("importo").isNull(), "NO_IMPORTO")).alias("flags"),
    )


@query("select event_id, strftime(ingested_at, '%Y-%m-%dT%H:%M:%S') as ingested, strftime(date_trunc('month', document_date), '%Y-%m') as month, date_diff('day', document_date, ingested_at) as lag_days from admin_events")
def iso_times(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "admin_events").select(
        "event_id", F.date_format("ingested_at", "yyyy-MM-dd'T'HH:mm:ss").alias("ingested"), F.date_format("document_date", "yyyy-MM").alias("month"), F.date_diff(F.to_date("ingested_at"), F.to_date("document_date")).alias("lag_days")
    )


@query(f"""select event_id, len({_AMOUNTS}) = 0 and regexp_matches(raw_text, '(?i)liquida|impegn') as missing_amount_expected, coalesce(list_max({_AMOUNTS}), 0) > 500000000 as large from admin_events where raw_text is not null""")
def missing_amounts(spark: SparkSession, sf: str) -> DataFrame:
    a = extract.amounts(F.col("raw_text"))
    return _texts(spark, sf).select("event_id", ((F.size(a) == 0) & F.col("raw_text").rlike("(?i)liquida|impegn")).alias("missing_amount_expected"), (F.coalesce(F.array_max(a), F.lit(0)) > 500000000).alias("large"))
