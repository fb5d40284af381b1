"""Text functions, text metrics, URL and date functions over documents and notices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actlens.functions import arrays, dates, text
from actlens.operators import dedup, features
from actlens.plans.registry import query
from actlens.session import table


@query(
    r"""select doc_id, length(text) as text_chars, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) as text_words, len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) as unique_words,
    len(regexp_extract_all(text, '(?i)(€|\beuro\b)')) as euro_mentions, len(regexp_extract_all(text, '\bCIG\b')) as cig_mentions, len(regexp_extract_all(text, '\bCUP\b')) as cup_mentions,
    len(regexp_extract_all(text, '\b\d{2}/\d{2}/\d{4}\b')) as date_mentions, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\b(20\d{2})\b', 1))), ',') as years_mentioned
    from documents where text is not null"""
)
def text_features(spark: SparkSession, sf: str) -> DataFrame:
    return features.text_features(table(spark, sf, "documents").where("text is not null"), "doc_id", "text")


@query(r"select doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\x00-\x1F\x7F]', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) as normalized from documents")
def normalized_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.normalized_for_model(F.col("text")).alias("normalized"))


_CLEAN = "text"
for _p in text.BOILERPLATE:
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '', 'g')"


@query(rf"select doc_id, trim(regexp_replace(regexp_replace({_CLEAN}, '[ \t]+', ' ', 'g'), '\n[ \t\n\r\f\v]*\n+', E'\n', 'g')) as cleaned from documents where text is not null")
def cleaned_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", text.without_boilerplate(F.col("text")).alias("cleaned"))


@query(
    r"""select notice_id, trim(regexp_replace(regexp_replace(lower(coalesce(oggetto, '')), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g')) as subject_key,
    case when substring(regexp_replace(regexp_replace(trim(titolo), '\s+', '_', 'g'), '[^A-Za-z0-9_.-]', '', 'g'), 1, 120) = '' then 'file' else substring(regexp_replace(regexp_replace(trim(titolo), '\s+', '_', 'g'), '[^A-Za-z0-9_.-]', '', 'g'), 1, 120) end as slug,
    regexp_replace(coalesce(numero, ''), '[^\p{L}\p{N}]', '', 'g') as number_id, case when length(oggetto) > 60 then substring(oggetto, 1, 60) || '...' else oggetto end as short_subject from notices"""
)
def slug_keys(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "notices")
    return n.select("notice_id", text.semantic_key(F.col("oggetto")).alias("subject_key"), text.slug(F.col("titolo")).alias("slug"), text.alnum(F.coalesce("numero", F.lit(""))).alias("number_id"), text.shorten(F.col("oggetto"), 60).alias("short_subject"))


@query(
    r"""with links as (select notice_id, unnest(allegati) as link from notices)
    select notice_id, link, coalesce(nullif(regexp_extract(link, '[?&](?:f|file|filename|name)=([^&#]*)', 1), ''), nullif(regexp_extract(link, '([^/?#]*)(?:[?#].*)?$', 1), '')) as doc_name,
    regexp_matches(link, '(?i)\.(pdf|p7m|php|doc|docx|zip)([?#]|$)') or link like '%getdoc.php%' or regexp_matches(link, '(?i)(allegat|scarica|download)') as is_attachment from links"""
)
def attachment_links(spark: SparkSession, sf: str) -> DataFrame:
    return features.attachment_links(table(spark, sf, "notices"))


@query(
    """select notice_id, coalesce(case when lower(oggetto) like '%determina%' then 'Determinazione' when lower(oggetto) like '%delibera%' then 'Delibera' when lower(oggetto) like '%ordinanza%' then 'Ordinanza' when lower(oggetto) like '%bando%' then 'Bando'
      when lower(oggetto) like '%avviso%' then 'Avviso' when lower(oggetto) like '%liquidazione%' or lower(oggetto) like '%impegno%' then 'Determinazione' end,
      case when lower(coalesce(dettaglio_url, '')) like '%tipo=det%' then 'Determinazione' when lower(coalesce(dettaglio_url, '')) like '%tipo=del%' then 'Delibera' when lower(coalesce(dettaglio_url, '')) like '%tipo=ord%' then 'Ordinanza' end,
      nullif(trim(tipologia), ''), 'unknown') as kind from notices"""
)
def tipologia_inferred(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "notices").select("notice_id", features.notice_kind().alias("kind"))


@query(
    r"""select notice_id, coalesce(nullif(dettaglio_url, ''), list_extract(allegati, 1), sha1(concat_ws('|', titolo, numero, data_pubblicazione, oggetto))) as notice_key,
    nullif(regexp_extract(coalesce(titolo, ''), '(?i)\b(?:n\.|numero)[ _-]*(\d{1,6})\b', 1), '') as number_a, nullif(regexp_extract(coalesce(titolo, ''), '\b(\d{1,6})/(?:20\d{2})\b', 1), '') as number_b from notices"""
)
def notice_key(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "notices")
    title = F.coalesce("titolo", F.lit(""))
    return n.select(
        "notice_id",
        dedup.notice_key().alias("notice_key"),
        text.first_group(title, r"(?i)\b(?:n\.|numero)[ _-]*(\d{1,6})\b").alias("number_a"),
        text.first_group(title, r"\b(\d{1,6})/(?:20\d{2})\b").alias("number_b"),
    )


@query(
    """select notice_id, coalesce(try_strptime(trim(data_pubblicazione), '%d/%m/%Y'), try_strptime(trim(data_pubblicazione), '%Y-%m-%d'))::date as published,
    year(coalesce(try_strptime(trim(data_pubblicazione), '%d/%m/%Y'), try_strptime(trim(data_pubblicazione), '%Y-%m-%d'))) as anno,
    strftime(coalesce(try_strptime(trim(data_pubblicazione), '%d/%m/%Y'), try_strptime(trim(data_pubblicazione), '%Y-%m-%d')), '%Y-%m') as mese from notices"""
)
def date_parse(spark: SparkSession, sf: str) -> DataFrame:
    day = dates.parse(F.col("data_pubblicazione"), ("dd/MM/yyyy", "yyyy-MM-dd"))
    return table(spark, sf, "notices").select("notice_id", day.alias("published"), F.year(day).alias("anno"), F.date_format(day, "yyyy-MM").alias("mese"))


@query(
    r"""select doc_id, coalesce(nullif(regexp_extract(text, '\b(\d{2}/\d{2}/\d{4}|20\d{2}-\d{2}-\d{2})\b', 1), ''), nullif(regexp_extract(text, '\b(20\d{2})\b', 1), '')) as first_date,
    regexp_extract_all(text, '\b\d{2}/\d{2}/\d{4}\b') as all_dates,
    try_strptime(regexp_extract(text, '(?i)\b(\d{1,2}) (gennaio|febbraio|marzo|aprile|maggio|giugno|luglio|agosto|settembre|ottobre|novembre|dicembre) (\d{4})\b', 3) || '-' ||
      lpad(cast(list_position(['gennaio','febbraio','marzo','aprile','maggio','giugno','luglio','agosto','settembre','ottobre','novembre','dicembre'], lower(regexp_extract(text, '(?i)\b(\d{1,2}) (gennaio|febbraio|marzo|aprile|maggio|giugno|luglio|agosto|settembre|ottobre|novembre|dicembre) (\d{4})\b', 2))) as varchar), 2, '0') || '-' ||
      lpad(regexp_extract(text, '(?i)\b(\d{1,2}) (gennaio|febbraio|marzo|aprile|maggio|giugno|luglio|agosto|settembre|ottobre|novembre|dicembre) (\d{4})\b', 1), 2, '0'), '%Y-%m-%d')::date as spelled
    from documents where text is not null"""
)
def dates_in_text(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").where("text is not null").select("doc_id", dates.first_date(t).alias("first_date"), F.regexp_extract_all(t, F.lit(r"(\b\d{2}/\d{2}/\d{4}\b)"), F.lit(1)).alias("all_dates"), dates.spelled_out(t).alias("spelled"))


@query(
    """with rows as (select notice_id, trim(tipologia) as tipologia, titolo, oggetto, coalesce(try_strptime(trim(data_pubblicazione), '%d/%m/%Y'), try_strptime(trim(data_pubblicazione), '%Y-%m-%d'))::date as day from notices)
    select notice_id from rows where lower(tipologia) in ('determinazione', 'delibera') and day between date '2023-01-01' and date '2023-12-31' and regexp_matches(coalesce(titolo, '') || ' ' || coalesce(oggetto, ''), '(?i)(lavori|fornitura)') and not lower(tipologia) = 'bando'"""
)
def crawl_filter(spark: SparkSession, sf: str) -> DataFrame:
    return features.crawl_filter(table(spark, sf, "notices"), include=("determinazione", "delibera"), exclude=("bando",), first="2023-01-01", last="2023-12-31", pattern="(lavori|fornitura)").select("notice_id")


@query(
    """with raw as (select notice_id, case notice_id % 4 when 0 then '[' || array_to_string(list_transform(allegati, lambda x: '''' || x || ''''), ', ') || ']' when 1 then array_to_string(allegati, ';') when 2 then array_to_string(allegati, ' | ') else '  ' end as cell from notices where allegati is not null)
    select notice_id, case when trim(cell) in ('', '[]') then [] when cell like '[%' then regexp_extract_all(cell, '''([^'']*)''', 1) else list_filter(list_transform(regexp_split_to_array(cell, '[;|]'), lambda x: trim(x)), lambda x: x <> '') end as links from raw"""
)
def list_cells(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("notice_id") % 4
    quoted = F.concat(F.lit("["), F.array_join(F.transform("allegati", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    cell = F.when(key == 0, quoted).when(key == 1, F.array_join("allegati", ";")).when(key == 2, F.array_join("allegati", " | ")).otherwise("  ")
    return table(spark, sf, "notices").where("allegati is not null").select("notice_id", arrays.list_of(cell).alias("links"))


@query("select notice_id, unnest(allegati) as link from notices")
def attachment_explode(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "notices").select("notice_id", F.explode("allegati").alias("link"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_field(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""select event_id, metadata['fonte'] as fonte, coalesce(metadata['pagine'], metadata['fonte'], '') as fallback, coalesce(len(actors), 0) as actors, list_transform(actors, lambda a: upper(a.name)) as names from admin_events""")
def nested_fields(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("metadata")
    return table(spark, sf, "admin_events").select(
        "event_id",
        F.try_element_at(m, F.lit("fonte")).alias("fonte"),
        F.coalesce(F.try_element_at(m, F.lit("pagine")), F.try_element_at(m, F.lit("fonte")), F.lit("")).alias("fallback"),
        F.coalesce(F.when(F.col("actors").isNotNull(), F.size("actors")), F.lit(0)).alias("actors"),
        F.transform("actors", lambda a: F.upper(a["name"])).alias("names"),
    )


@query("select doc_id, sha256(text) as text_sha256, md5(text) as text_md5, sha1(text) as text_sha1 from documents where text is not null")
def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.sha2(t, 256).alias("text_sha256"), F.md5(t).alias("text_md5"), F.sha1(t).alias("text_sha1"))


@query("select doc_id from (select doc_id, text, row_number() over (partition by sha256(text) order by doc_id) as r from documents) where r = 1 or text is null")
def content_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.first_per_content(table(spark, sf, "documents"), "text", "doc_id").select("doc_id")


@query("select count(*) - count(distinct doc_id) as duplicate_ids, count(text) - count(distinct sha256(text)) as duplicate_texts, count(*) filter (text is null) as null_texts from documents")
def duplicate_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").agg(
        (F.count(F.lit(1)) - F.countDistinct("doc_id")).alias("duplicate_ids"), (F.count("text") - F.countDistinct(F.sha2("text", 256))).alias("duplicate_texts"), F.count(F.when(F.col("text").isNull(), 1)).alias("null_texts")
    )


@query(
    """select distinct on (k) notice_id, k from (select notice_id, coalesce(nullif(dettaglio_url, ''), list_extract(allegati, 1), sha1(concat_ws('|', titolo, numero, data_pubblicazione, oggetto))) as k from notices) order by k, notice_id"""
)
def metadata_dedup(spark: SparkSession, sf: str) -> DataFrame:
    keyed = table(spark, sf, "notices").select("notice_id", dedup.notice_key().alias("k"))
    return keyed.groupBy("k").agg(F.min("notice_id").alias("notice_id"))


@query("select notice_id from notices where batch_no > 0 and not exists (select 1 from notices h where h.batch_no = 0 and h.dettaglio_url = notices.dettaglio_url)")
def incremental_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "notices")
    return dedup.unseen(n.where("batch_no > 0"), n.where("batch_no = 0"), "dettaglio_url").select("notice_id")


@query("select notice_id from notices where ente in (select ente from enti where popolazione > 10000)")
def semi_join(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "notices").join(table(spark, sf, "enti").where("popolazione > 10000"), "ente", "left_semi").select("notice_id")


@query("select tipologia from (select distinct lower(trim(tipologia)) as tipologia from notices where tipologia is not null) union select distinct lower(trim(document_type)) from admin_events where document_type is not null")
def kinds_union(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "notices").where("tipologia is not null").select(F.lower(F.trim("tipologia")).alias("tipologia"))
    return a.union(table(spark, sf, "admin_events").where("document_type is not null").select(F.lower(F.trim("document_type")))).distinct()
