"""Queries over the extraction record, with SQL written for itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actlens.functions import text
from actlens.operators import documents, extract
from actlens.plans.registry import query
from actlens.session import table


def _scanned(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with the best confidence that a scan of theirs was given."""
    e = table(spark, sf, "admin_events").where("raw_text is not null").select("event_id", "raw_text")
    x = table(spark, sf, "extracted_data").where("event_id is not null").groupBy("event_id").agg(F.max("trace.ocr_confidence").alias("ocr"))
    return e.join(x, "event_id", "left")


_LAYOUT = """case when contains(upper(raw_text), 'VISTO DI REGOLARITÀ CONTABILE') or contains(upper(raw_text), 'IMPEGNO DEFINITIVO') then 'VISTO_CONTABILE'
  when contains(upper(raw_text), 'AGGIUDICAZIONE DEFINITIVA') or contains(upper(raw_text), 'PROPOSTA DI AGGIUDICAZIONE') or contains(upper(raw_text), 'ESITO PROCEDURA') then 'ESITO_GARA'
  when contains(upper(raw_text), 'AVVISO PUBBLICO') or contains(upper(raw_text), 'BANDO DI GARA') or contains(upper(raw_text), 'MANIFESTAZIONE DI INTERESSE') then 'BANDO_PURO'
  when contains(upper(raw_text), 'LA GIUNTA COMUNALE') or contains(upper(raw_text), 'IL CONSIGLIO COMUNALE') then 'DELIBERAZIONE' when contains(upper(raw_text), 'DETERMINA') then 'DETERMINAZIONE' else 'SCONOSCIUTO' end"""
_PARSED = (
    """with docs as (select event_id, raw_text, coalesce(ocr, 1.0) as ocr, """
    + _LAYOUT
    + """ as layout from (select event_id, raw_text from admin_events where raw_text is not null) e
      left join (select event_id, max(trace.ocr_confidence) as ocr from extracted_data where event_id is not null group by 1) using (event_id)),
    cut as (select *, regexp_matches(raw_text, '(?i)\\b(?:determina|ordina|decide)\\b') as ordered, case when regexp_matches(raw_text, '(?i)\\b(?:determina|ordina|decide)\\b') then regexp_replace(raw_text, '(?is)\\A.*?\\b(?:determina|ordina|decide)\\b', '') else raw_text end as disp from docs),
    sentences as (select event_id, generate_subscripts(p, 1) - 1 as i, unnest(p) as s from (select event_id, regexp_split_to_array(disp, '\\.\\s|;|\\n') as p from cut where layout = 'DETERMINAZIONE')),
    weighed as (select *, 5 * (contains(lower(s), 'liquidare')::int + contains(lower(s), 'liquidazione')::int + contains(lower(s), 'pagare')::int) + 4 * (contains(lower(s), 'affidare')::int + contains(lower(s), 'affidamento')::int + contains(lower(s), 'impegnare')::int)
        + 3 * (contains(lower(s), 'a favore di')::int + contains(lower(s), 'all''operatore economico')::int + contains(lower(s), 'all''impresa')::int) + 2 * (contains(lower(s), 'alla ditta')::int + contains(lower(s), 'aggiudicatar')::int) as w from sentences),
    top as (select * from (select *, row_number() over (partition by event_id order by w desc, i) as r from weighed where w >= 3) where r <= 3),
    picked as (select event_id, string_agg(s, ' ' order by i) as context, string_agg(w::varchar, ',' order by r) as scores, string_agg(i::varchar, ',' order by r) as places from top group by 1),
    placed as (select c.*, p.scores, p.places, coalesce(p.context, substring(disp, 1, 1000)) as context from cut c left join picked p using (event_id)),
    read as (select *, nullif(trim(case layout when 'VISTO_CONTABILE' then regexp_extract(raw_text, '(?i)Creditore Denominazione:\\s*([^\\n]+?)\\s*-', 1) when 'ESITO_GARA' then regexp_extract(raw_text, '(?i)(?:aggiudicatario|aggiudicazione all''operatore|affidatario)\\s+([^.,;]+)', 1)
        when 'DETERMINAZIONE' then regexp_extract(context, '(?i)\\b(?:liquidare a favore di|a favore di|all[’'']|alla ditta|liquidare a(?:lla)?)\\s+[“"«]?([^\\n,.;]+?)(?:\\s+la somma|\\s+l''importo|\\s+per\\b|\\s+di\\s*€|\\s+di\\s*euro|[,.;\\n]|\\z)', 1) end), '') as payee_raw,
      try_cast(regexp_replace(regexp_extract(case layout when 'VISTO_CONTABILE' then raw_text when 'DETERMINAZIONE' then context end, '\\d{1,3}(?:\\.\\d{3})*,\\d{2}'), '[.,]', '', 'g') as bigint) as found from placed),
    valued as (select *, case when found > 0 and found < 100000000000 then found end as cents from read)"""
)


@query(
    _PARSED
    + """ select event_id, layout, payee_raw, cents, layout in ('VISTO_CONTABILE', 'DETERMINAZIONE', 'ESITO_GARA') as enabled,
      round(ocr * case layout when 'VISTO_CONTABILE' then 0.98 * case when cents is null then 0.5 else 0.95 end when 'ESITO_GARA' then 0.95 * 0.85 when 'BANDO_PURO' then 0.95 * 0.95 when 'DELIBERAZIONE' then 0.95 * 0.95
        when 'DETERMINAZIONE' then 0.96 * (case when scores is null then 0.4 else 0.9 end - case when cents is null then 0.3 else 0 end) else 0.4 * 0.4 end, 4)::double as confidence,
      case when layout = 'DETERMINAZIONE' then coalesce(scores, '') end as scores, case when layout = 'DETERMINAZIONE' then coalesce(places, '') end as places,
      case layout when 'DELIBERAZIONE' then 'financial_disabled' when 'BANDO_PURO' then 'financial_disabled' when 'SCONOSCIUTO' then 'fallback_no_extract' end as action from valued"""
)
def parser_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents.parsed(_scanned(spark, sf), "event_id", "raw_text", "ocr")
    return rows.select("event_id", "layout", "payee_raw", "cents", "enabled", F.round("confidence", 4).alias("confidence"), "scores", "places", "action")


@query(
    _PARSED
    + """ select event_id, concat_ws(' | ', case when layout = 'DETERMINAZIONE' and not ordered then 'NO_DISPOSITIVO' end, case when layout in ('VISTO_CONTABILE', 'DETERMINAZIONE', 'ESITO_GARA') and payee_raw is null then 'BENEFICIARIO_ASSENTE' end,
      case when found is not null and cents is null then 'IMPORTO_INVALIDO' end, case when cents > 500000000 then 'HIGH_IMPORTO' end, case when ocr < 0.6 and layout <> 'SCONOSCIUTO' then 'LOW_OCR' end, case when layout = 'SCONOSCIUTO' then 'FALLBACK_LAYOUT' end) as flags from valued"""
)
def forensic_flags(spark: SparkSession, sf: str) -> DataFrame:
    return documents.parsed(_scanned(spark, sf), "event_id", "raw_text", "ocr").select("event_id", "flags")


@query(
    r"""select extract_id, nullif(upper(trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_split_to_array(beneficiario_raw, '(?i)\b(?:P\.?\s*IVA|C\.?F\.?|CON\s+SEDE)\b')[1]),
      '(?i)\bS\.?R\.?L\.?S?\b|\bS\.?P\.?A\.?\b|\bS\.?N\.?C\.?\b|\bS\.?A\.?S\.?\b|\bS\.?C\.?A\.?R\.?L\.?\b|\bS\.?S\.?D\.?\b|\bO\.?N\.?L\.?U\.?S\b|\bSOCIET(?:A\b|[Àà])|\bDITTA\b|\bIMPRESA\b|\bCOOPERATIVA\b|\bCONSORTILE\b|\bSOCIALE\b|\bAZIENDA\b|\bGRUPPO\b|\bAVV\.?\b|\bING\.?\b|\bARCH\.?\b|\bDOTT\.?(?:SSA)?\b|\bGEOM\.?\b|\bRAG\.?\b|\bPROF\.?\b|\bDR\.?\b', '', 'g'),
      '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))), '') as party from extracted_data where beneficiario_raw is not null"""
)
def party_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "extracted_data").where("beneficiario_raw is not null").select("extract_id", documents.party(F.col("beneficiario_raw")).alias("party"))


@query(
    r"""with found as (select event_id, unnest(list_concat(regexp_extract_all(raw_text, '€\s*(\d[\d.,]*)', 1), regexp_extract_all(raw_text, '(\d[\d.,]*)\s*(?:euro|€|eur)\b', 1), regexp_extract_all(raw_text, '(?i)\beuro\s+(\d[\d.,]*)', 1),
        regexp_extract_all(raw_text, '(?i)importo\s*(?:totale|complessivo|di\s+spesa|a\s+base\s+d''asta)\s*[:=]?\s*(\d[\d.,]*)', 1), regexp_extract_all(raw_text, '(?i)(?:impegno|liquidazione|accredito|pagamento)\s+(?:n\.?\s*\d+\s+)?(\d[\d.]*,\d{2})', 1), regexp_extract_all(raw_text, '(?i)iva\s+(?:inclusa|esclusa)\s*(\d[\d.,]*)', 1))) as n from admin_events where raw_text is not null),
    num as (select event_id, regexp_replace(n, '[.,]+$', '') as n from found),
    val as (select event_id, try_cast(round(try_cast(case when contains(n, ',') then replace(replace(n, '.', ''), ',', '.') when regexp_matches(n, '^\d+\.\d{1,2}$') then n else replace(n, '.', '') end as decimal(24,4)) * 100, 0) as bigint) as v from num)
    select e.event_id, coalesce(string_agg(distinct v::varchar, ',' order by v::varchar), '') as amounts from admin_events e left join (select * from val where v > 0 and v < 10000000000) using (event_id) where raw_text is not null group by 1"""
)
def all_amounts(spark: SparkSession, sf: str) -> DataFrame:
    found = documents.all_amounts(F.col("raw_text"))
    return table(spark, sf, "admin_events").where("raw_text is not null").select("event_id", F.array_join(F.array_sort(F.transform(found, lambda v: v.cast("string"))), ",").alias("amounts"))


@query(
    r"""with t as (select event_id, raw_text as t, '(\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})?)' as n from admin_events where raw_text is not null),
    f as (select event_id, t, coalesce(nullif(regexp_extract(t, '€\s*(\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})?)', 1), ''), nullif(regexp_extract(t, '(?i)(\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})?)\s*euro', 1), ''), nullif(regexp_extract(t, '(?i)totale[\s:]*€?\s*(\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})?)', 1), ''),
      nullif(regexp_extract(t, '(?i)importo[\s:]*€?\s*(\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})?)', 1), ''), nullif(regexp_extract(t, '(?i)per\s+(?:un\s+)?importo\s+(?:complessivo\s+)?di\s+€?\s*(\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})?)', 1), ''), nullif(regexp_extract(t, '(?i)si\s+(?:liquidano|impegnano|pagano)\s+€?\s*(\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})?)', 1), '')) as a,
      nullif(regexp_extract(t, '(?i)totale[\s:]*(?:€|euro)?\s*(\d{1,3}(?:\.\d{3})*,\d{2})', 1), '') as b from t),
    l as (select event_id, sum(v) as s from (select event_id, try_cast(regexp_replace(unnest(regexp_extract_all(t, '\d{1,3}(?:\.\d{3})*,\d{2}')), '[.,]', '', 'g') as bigint) as v from t) where v > 0 and v < 5000000000 group by 1)
    select event_id, try_cast(round(try_cast(replace(replace(a, '.', ''), ',', '.') as decimal(24,4)) * 100, 0) as bigint) as first, coalesce(try_cast(regexp_replace(b, '[.,]', '', 'g') as bigint), s)::bigint as total from f left join l using (event_id)"""
)
def first_and_total(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("raw_text")
    return table(spark, sf, "admin_events").where("raw_text is not null").select("event_id", documents.first_amount(t).alias("first"), documents.total_amount(t).alias("total"))


@query(
    r"""select event_id, case when regexp_matches(raw_text, '(?i)n\.?\s*\d+\s*/\s*\d{4}') then regexp_replace(regexp_extract(raw_text, '(?i)n\.?\s*(\d+\s*/\s*\d{4})', 1), '\s', '', 'g')
      when regexp_matches(raw_text, '(?i)n\.?\s*\d+\s*del\s*\d{1,2}[/_.-]\d{1,2}[/_.-]\d{2,4}') then regexp_extract(raw_text, '(?i)n\.?\s*(\d+)\s*del\s*\d{1,2}[/_.-]\d{1,2}[/_.-]\d{2,4}', 1) || '/' || regexp_extract(raw_text, '(?i)n\.?\s*\d+\s*del\s*\d{1,2}[/_.-]\d{1,2}[/_.-](\d{2,4})', 1)
      else coalesce(nullif(regexp_extract(raw_text, '(?i)(?:determinazione|delibera|ordinanza|avviso|bando)\s*n\.?\s*(\d+)', 1), ''), nullif(regexp_extract(raw_text, '(?i)num\.?\s*(\d+)', 1), '')) end as number,
      len(list_distinct(regexp_extract_all(raw_text, '\b(\d{2}/\d{2}/\d{4})\b', 1))) as dates, nullif(regexp_extract(raw_text, '(?i)(?:accertamento\s+n\.|accertamento|N\.\s+Accertamento)\s*[:\s]*(\d+)', 1), '') as assessment,
      case when not regexp_matches(regexp_extract(raw_text, '(?i)capitolo\s*[:\s]*(\d[\d.]*)', 1), '^\d{5}\.*$') then nullif(regexp_replace(regexp_extract(raw_text, '(?i)capitolo\s*[:\s]*(\d[\d.]*)', 1), '\.+$', ''), '') end as chapter,
      nullif(trim(regexp_extract(raw_text, '(?i)\b((?:PEG|missione|programma)\b[^\n\r]*)', 1)), '') as programme from admin_events where raw_text is not null"""
)
def document_numbers(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents.record(_scanned(spark, sf), "event_id", "raw_text", "ocr")
    return rows.select("event_id", "number", F.size("dates").alias("dates"), "assessment", "chapter", "programme")


@query(
    _PARSED
    + r""", kinds as (select event_id, lower(substring(raw_text, 1, 2500)) as h, length(raw_text) as n from docs),
    typed as (select event_id, n, case when contains(h, 'visto di regolarità contabile') or contains(h, 'visto di regolarita contabile') then 'VistoContabile' when contains(h, 'certificato di pubblicazione') or contains(h, 'attestazione di pubblicazione') then 'AttestazionePubblicazione'
      when contains(h, 'elenco dei cittadini') or contains(h, 'elenco elettori') then 'Elenco' when contains(h, 'ordinanza sindacale') or contains(h, 'ordinanza n.') then 'Ordinanza' when contains(h, 'decreto sindacale') or contains(h, 'decreto n.') then 'Decreto'
      when contains(h, 'determina') then 'Determinazione' when contains(h, 'delibera') then 'Delibera' when contains(h, 'bando') then 'Bando' when contains(h, 'avviso') then 'Avviso' else 'unknown' end as kind from kinds)
    select event_id, t.kind, v.layout, v.cents, nullif(upper(regexp_extract(raw_text, '(?i)\bCIG[ :]+([A-Z0-9]{10})\b', 1)), '') as cig, nullif(upper(regexp_extract(raw_text, '(?i)\bCUP[ :]+([A-Z0-9]{15})\b', 1)), '') as cup, nullif(trim(regexp_extract(raw_text, '(?i)oggetto *[:-]? *([^\n]+)', 1)), '') as subject, t.n as length
    from valued v join typed t using (event_id)"""
)
def extraction_record(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents.record(_scanned(spark, sf), "event_id", "raw_text", "ocr")
    return rows.select("event_id", "kind", "layout", "cents", "cig", "cup", F.nullif("subject", F.lit("")).alias("subject"), "length")


@query(
    """select notice_id, round(0.4 * kind + 0.3 * amounts + 0.3 * score, 6)::double as overall, 0.4 * kind + 0.3 * amounts + 0.3 * score >= 0.7 - 1e-9 as valid from (
      select notice_id, case when tipologia is null then 0.3 else 1.0 end as kind, case when coalesce(len(allegati), 0) = 0 then 0.0 else 1.0 end as amounts, case when numero is null then 0.1 when oggetto is null then 0.3 else 1.0 end as score from notices)"""
)
def overall_confidence(spark: SparkSession, sf: str) -> DataFrame:
    kind, amounts = F.when(F.col("tipologia").isNull(), 0.3).otherwise(1.0), F.when(F.coalesce(F.size("allegati"), F.lit(0)) <= 0, 0.0).otherwise(1.0)
    classified = F.when(F.col("numero").isNull(), "<vuoto>").when(F.col("oggetto").isNull(), "ambiguous").otherwise("high")
    overall = documents.overall_confidence(kind, amounts, classified)
    return table(spark, sf, "notices").select("notice_id", overall.alias("overall"), (overall >= 0.7).alias("valid"))


@query(
    r"""select event_id, array_to_string(list_filter(['liquidazione', 'impegno di spesa', 'gara', 'stato civile', 'POS'], lambda k: regexp_matches(lower(raw_text), '(?:^|[^\p{L}\p{N}_])' || lower(k) || '(?:[^\p{L}\p{N}_]|$)')), ',') as hits from admin_events where raw_text is not null"""
)
def keyword_hits(spark: SparkSession, sf: str) -> DataFrame:
    marked = table(spark, sf, "admin_events").where("raw_text is not null").select("event_id", text.edged(F.col("raw_text")).alias("_t"))
    return marked.select("event_id", F.array_join(text.keyword_hits(F.col("_t"), ("liquidazione", "impegno di spesa", "gara", "stato civile", "POS")), ",").alias("hits"))


@query(
    _PARSED
    + """ select layout, count(*) as events, count(cents) as valued, count(payee_raw) as with_party from valued group by 1"""
)
def extracted_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents.record(_scanned(spark, sf), "event_id", "raw_text", "ocr")
    made = documents.events(rows, "event_id").select("event_id", F.size("actors").alias("_parties"))
    return rows.join(made, "event_id").groupBy("layout").agg(F.count(F.lit(1)).alias("events"), F.count("cents").alias("valued"), F.count("payee_raw").alias("with_party"))


@query(
    r"""with f as (select notice_id, lower(regexp_extract(unnest(allegati), '([^/?#]*)$', 1)) as name, lower(substring(coalesce(oggetto, ''), 1, 2500)) as h from notices)
    select kind, count(*) as files from (select case when contains(name, 'vistocontabile') or contains(name, 'visto_contabile') then 'VistoContabile' when contains(name, 'attestazionepubblicazione') or contains(name, 'certificatopubblicazione') then 'AttestazionePubblicazione'
      when contains(name, 'elencoelettori') or contains(name, 'elenco_') or contains(name, '_elenco') then 'Elenco' when contains(name, 'ordinanza') or contains(name, 'ordinanzesindacali') then 'Ordinanza' when contains(name, 'decreto') then 'Decreto' when contains(name, 'determina') then 'Determinazione'
      when contains(name, 'delibera') then 'Delibera' when contains(name, 'bando') then 'Bando' when contains(name, 'avviso') then 'Avviso' when contains(h, 'visto di regolarità contabile') or contains(h, 'visto di regolarita contabile') then 'VistoContabile'
      when contains(h, 'certificato di pubblicazione') or contains(h, 'attestazione di pubblicazione') then 'AttestazionePubblicazione' when contains(h, 'elenco dei cittadini') or contains(h, 'elenco elettori') then 'Elenco' when contains(h, 'ordinanza sindacale') or contains(h, 'ordinanza n.') then 'Ordinanza'
      when contains(h, 'decreto sindacale') or contains(h, 'decreto n.') then 'Decreto' when contains(h, 'determina') then 'Determinazione' when contains(h, 'delibera') then 'Delibera' when contains(h, 'bando') then 'Bando' when contains(h, 'avviso') then 'Avviso' else 'unknown' end as kind from f) group by 1"""
)
def file_types(spark: SparkSession, sf: str) -> DataFrame:
    """Types of attached files, by their names or else by the notice's subject."""
    files = table(spark, sf, "notices").select("oggetto", F.explode("allegati").alias("link"))
    kind = extract.document_type(F.coalesce("oggetto", F.lit("")), F.regexp_extract("link", r"([^/?#]*)\z", 1))
    return files.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("files"))
