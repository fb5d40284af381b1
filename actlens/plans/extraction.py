"""Extraction, classification, quality and number queries over acts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actlens.functions import numbers, text
from actlens.operators import extract, quality
from actlens.plans.registry import query
from actlens.session import table


def _sql_case(rules, column: str, default: str) -> str:
    whens = " ".join("when " + " or ".join(f"contains({column}, '{n.replace(chr(39), chr(39) * 2)}')" for n in needles) + f" then '{label}'" for label, needles in rules)
    return f"case {whens} else {default} end"


def _g(pattern: str, group: int = 1) -> str:
    quoted = pattern.replace("'", "''")
    return f"nullif(regexp_extract(raw_text, '{quoted}', {group}), '')"


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "admin_events").where("raw_text is not null")


@query(
    f"""select event_id, upper({_g(extract.CIG)}) as cig, upper({_g(extract.CUP)}) as cup, trim({_g(extract.SUBJECT)}) as subject, {_g(extract.ACT_NUMBER)} as act_number, {_g(extract.REGISTER)} as register_number,
    {_g(extract.VAT)} as vat, {_g(extract.COMMITMENT)} as commitment, {_g(extract.COMMITMENT, 2)} as commitment_year, {_g(extract.CHAPTER)} as chapter, trim({_g(extract.SIGNER)}) as signer,
    lower({_g(extract.PROCEDURE)}) as "procedure", upper(replace({_g(extract.IBAN)}, ' ', '')) as iban from admin_events where raw_text is not null"""
)
def extract_ids(spark: SparkSession, sf: str) -> DataFrame:
    return extract.fields(_texts(spark, sf), "event_id", "raw_text")


_AMOUNTS = f"""list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(raw_text, '{extract.AMOUNT}', 1),
  lambda a: cast(round(try_cast(replace(replace(a, '.', ''), ',', '.') as double) * 100) as bigint)), lambda v: v > 0 and v < 10000000000)), 'DESC')"""


@query(f"select event_id, a as amounts_cents, len(a) as importi_count, list_sum(a) as sum_cents, list_max(a) as max_cents from (select event_id, {_AMOUNTS} as a from admin_events where raw_text is not null)")
def extract_amounts(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("amounts_cents")
    return _texts(spark, sf).select("event_id", extract.amounts(F.col("raw_text")).alias("amounts_cents")).select(
        "event_id", "amounts_cents", F.size(a).alias("importi_count"), F.when(F.size(a) > 0, F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)).alias("sum_cents"), F.array_max(a).alias("max_cents")
    )


_UP = "upper(raw_text)"


@query(
    "select event_id, "
    + _sql_case([(n, m) for n, _, m in extract.LAYOUTS], _UP, "'SCONOSCIUTO'")
    + " as layout, cast("
    + _sql_case([(str(c), m) for _, c, m in extract.LAYOUTS], _UP, "'0.40'")
    + " as double) as confidence from admin_events where raw_text is not null"
)
def layout_detect(spark: SparkSession, sf: str) -> DataFrame:
    kind, conf = extract.layout(F.col("raw_text"))
    return _texts(spark, sf).select("event_id", kind.alias("layout"), conf.alias("confidence"))


_W = " + ".join(f"case when contains(lower(s), '{n.replace(chr(39), chr(39) * 2)}') then {w} else 0 end" for w, ns in extract.CLAUSES for n in ns)


@query(
    f"""with parts as (select event_id, raw_text, unnest(range(1, len(regexp_split_to_array(raw_text, '[;\n]')) + 1)) as i, regexp_split_to_array(raw_text, '[;\n]') as p from admin_events where raw_text is not null),
    scored as (select event_id, i, s, {_W} as w from (select event_id, i, trim(p[i]) as s from parts) where s <> ''),
    top as (select * from (select *, row_number() over (partition by event_id order by w desc, i) as r from scored where w >= 3) where r <= 3)
    select e.event_id, coalesce(string_agg(t.s, '; ' order by t.i), substring(any_value(e.raw_text), 1, 1000)) as context from admin_events e left join top t using (event_id) where e.raw_text is not null group by 1"""
)
def determina_parse(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("event_id", extract.operative_clauses(F.col("raw_text")).alias("context"))


@query("select event_id, " + _sql_case(extract.TYPES, "lower(substring(raw_text, 1, 2500))", "'unknown'") + " as doc_type from admin_events where raw_text is not null")
def doc_type_infer(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("event_id", extract.document_type(F.col("raw_text")).alias("doc_type"))


_SCORES = ", ".join(
    "{'n': '" + n + "', 'v': " + " + ".join(f"{k} * regexp_matches({c}, '(?:^|[^\\p{{L}}\\p{{N}}_]){w.lower()}(?:[^\\p{{L}}\\p{{N}}_]|$)')::int" for w in ws for c, k in (("s", 4), ("b", 1))) + "}" for n, ws in extract.CATEGORIES.items()
)


@query(
    f"""with base as (select event_id, lower(coalesce(title, '')) as s, lower(substring(coalesce(raw_text, ''), 1, 3500)) as b from admin_events),
    flat as (select event_id, unnest([{_SCORES}]) as x from base), ranked as (select event_id, x.n as n, x.v as v, row_number() over (partition by event_id order by x.v desc, x.n) as r from flat),
    two as (select event_id, max(n) filter (r = 1) as n, max(v) filter (r = 1) as v, max(v) filter (r = 2) as v2 from ranked group by 1)
    select event_id, case when v > 0 then n end as category, v as score, case when v = 0 then null when v = v2 then 'ambiguous' when v >= 4 then 'high' else 'medium' end as confidence from two"""
)
def category_score(spark: SparkSession, sf: str) -> DataFrame:
    return extract.categories(table(spark, sf, "admin_events"), "event_id", "title", "raw_text")


@query("select event_id, " + _sql_case(extract.SUBCATEGORIES, "lower(coalesce(title, ''))", "null") + " as subcategory from admin_events")
def subcategory(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "admin_events").select("event_id", text.first_label(F.lower(F.coalesce("title", F.lit(""))), extract.SUBCATEGORIES, F.lit(None).cast("string")).alias("subcategory"))


@query(
    """with base as (select event_id, lower(coalesce(raw_text, '')) as low, """
    + _sql_case(extract.TYPES, "lower(substring(coalesce(raw_text, ''), 1, 2500))", "'unknown'")
    + """ as kind, case when contains(lower(coalesce(title, '')), 'regolamento') then 'Regolamenti' when contains(lower(coalesce(title, '')), 'bilancio') then 'Contabilità' end as cat from admin_events),
    marked as (select *, contains(low, 'impegno di spesa') or contains(low, 'liquidazione') or contains(low, 'variazione di bilancio') or contains(low, 'riconoscimento debito') or contains(low, 'debito fuori bilancio') as strong from base)
    select event_id, case when kind in ('Ordinanza', 'Decreto', 'Elenco', 'AttestazionePubblicazione', 'Avviso') or contains(low, 'pubblicazione di matrimonio') or contains(low, 'concessione del patrocinio') or (coalesce(cat, '') in ('Regolamenti', 'Affari Generali', 'Personale') and not strong) then false
      when kind = 'VistoContabile' then true when regexp_matches(low, 'impegno di spesa|liquidazione (?:di|del|della)|capitolo \\d+|cig[ :]+[a-z0-9]{10}') then true
      when kind = 'Determinazione' and (contains(low, 'servizio') or contains(low, 'lavori') or contains(low, 'fornitura')) then true else coalesce(cat = 'Contabilità' and kind = 'Determinazione', false) end as accounting_relevant from marked"""
)
def accounting_relevant(spark: SparkSession, sf: str) -> DataFrame:
    low = F.lower(F.coalesce("title", F.lit("")))
    cat = F.when(low.contains("regolamento"), "Regolamenti").when(low.contains("bilancio"), "Contabilità")
    body = F.coalesce("raw_text", F.lit(""))
    return table(spark, sf, "admin_events").select("event_id", extract.accounting_relevant(body, extract.document_type(body), cat).alias("accounting_relevant"))


_BANK = ", ".join("{'p': '" + n + f"', 'n': len(regexp_extract_all(raw_text, '({p})'))" + "}" for n, p in extract.BANK.items())


@query(f"select event_id, x.p as pattern, x.n as n from (select event_id, unnest([{_BANK}]) as x from admin_events where raw_text is not null) where x.n > 0")
def pattern_bank_counts(spark: SparkSession, sf: str) -> DataFrame:
    return extract.bank_counts(_texts(spark, sf), "event_id", "raw_text")


def _route_case(rules, default: str) -> str:
    return "case " + " ".join(f"when regexp_matches(raw_text, '{p}') then '{n}'" for n, p in rules) + f" else {default} end"


@query(f"select event_id, kind, case when kind in ('DETERMINA', 'DELIBERA') then ev else 'ALTRO' end as event from (select event_id, {_route_case(extract.ROUTES, chr(39) + 'ALTRO' + chr(39))} as kind, {_route_case(extract.EVENT_ROUTES, chr(39) + 'ALTRO' + chr(39))} as ev from admin_events where raw_text is not null)")
def event_route(spark: SparkSession, sf: str) -> DataFrame:
    kind, event = extract.route(F.col("raw_text"))
    return _texts(spark, sf).select("event_id", kind.alias("kind"), event.alias("event"))


@query(
    f"""with a as (select event_id, raw_text, unnest({_AMOUNTS}) as cents from admin_events where raw_text is not null),
    p as (select event_id, cents, raw_text, strpos(raw_text, replace(format('{{:,}}', cents // 100), ',', '.') || ',' || lpad(cast(cents % 100 as varchar), 2, '0')) as place from a),
    w as (select *, lower(substring(raw_text, greatest(place - 80, 1), 160)) as around from p),
    s as (select event_id, cents, place, 50 + case when regexp_matches(around, 'liquidare|impegnare|affidare') then 70 else 0 end + case when contains(around, 'cig') then 40 else 0 end - case when regexp_matches(around, 'vista|premesso|preso atto') then 30 else 0 end as v from w)
    select event_id, cents, case when place > 0 then v end as score, case when place <= 0 then null when v > 100 then 'high' when v > 50 then 'medium' else 'low' end as level from s"""
)
def amount_veracity(spark: SparkSession, sf: str) -> DataFrame:
    rows = _texts(spark, sf).select("event_id", "raw_text", F.explode(extract.amounts(F.col("raw_text"))).alias("cents"))
    score, level = extract.veracity(F.col("raw_text"), F.col("cents"))
    return rows.select("event_id", "cents", score.alias("score"), level.alias("level"))


@query(
    r"""with raw as (select extract_id, beneficiario_raw as r from extracted_data),
    c as (select extract_id, r, upper(trim(r)) as up, trim(regexp_replace(regexp_replace(regexp_replace(upper(trim(r)), '\b(PROFESSIONISTA|DITTA|IMPRESA|SOCIETA|S\.?R\.?L\.?S?|S\.?P\.?A|S\.?N\.?C|S\.?A\.?S|AVV|ING|ARCH|DOTT|GEOM)\b', '', 'g'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) as n from raw)
    select extract_id, case when coalesce(trim(r), '') = '' then 'NON IDENTIFICATO' when regexp_matches(up, 'MAGGIORMENTE QUALIFICAT|CHE HA PRESENTATO|IN REGOLA|DIVERSI BENEFICIARI|DIVERSE DITTE|OPERATORE ECONOMICO|APPALTATRICE|AGGIUDICATARI|DIVERSI') then 'DIVERSI/NON APPLICABILE'
      when n = '' then 'NON IDENTIFICATO' else n end as payee from c"""
)
def supplier_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "extracted_data").select("extract_id", text.payee(F.col("beneficiario_raw")).alias("payee"))


@query(
    r"""with raw as (select node_id, label as r from graph_nodes where node_type = 'RUP'),
    c as (select node_id, r, upper(trim(r)) as up, trim(regexp_replace(regexp_replace(regexp_replace(upper(trim(r)), '\b(DOTT|DR|SSA|IL RESPONSABILE|DEL SERVIZIO|F\.TO|IL SEGRETARIO|IL SINDACO|GEOM|ARCH|ING|AVV)\b', '', 'g'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) as n from raw)
    select node_id, case when coalesce(trim(r), '') = '' or regexp_matches(up, 'VISTO|VISTA|PREMESSO|DECRETO|FUNZIONI|AI SENSI|LA GIUNTA|IL CONSIGLIO|DELIBERAZIONE|DETERMINAZIONE|REGOLAMENTO|DIPENDENTE|PRO TEMPORE') or n = '' then 'NON IDENTIFICATO' else n end as officer from c"""
)
def officer_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "graph_nodes").where("node_type = 'RUP'").select("node_id", text.officer(F.col("label")).alias("officer"))


@query(
    """select notice_id, case when d is not null and numero is not null then 'urn:nir:' || ente || ';giunta:' || lower(trim(tipologia)) || ':' || strftime(d, '%Y-%m-%d') || ';' || numero end as urn
    from (select *, coalesce(try_strptime(data_pubblicazione, '%d/%m/%Y'), try_strptime(data_pubblicazione, '%Y-%m-%d')) as d from notices)"""
)
def legal_urn(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "notices").select("notice_id", text.legal_urn(F.col("ente"), F.lit("giunta"), F.lower(F.trim("tipologia")), F.col("data_pubblicazione"), F.col("numero")).alias("urn"))


@query(
    """with raw as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, replace(replace(replace(format('{:,.2f}', l_extendedprice), ',', 'x'), '.', ','), 'x', '.') as shown from lineitem)
    select shown, count(*) as n, cast(replace(replace(shown, '.', ''), ',', '.') as double) as parsed, cast(replace(replace(shown, '.', ''), ',', '.') as double) > 50000 as large from raw group by 1"""
)
def amount_parse(spark: SparkSession, sf: str) -> DataFrame:
    shown = F.replace(F.replace(F.replace(F.format_number("l_extendedprice", 2), F.lit(","), F.lit("x")), F.lit("."), F.lit(",")), F.lit("x"), F.lit("."))
    grouped = table(spark, sf, "lineitem").groupBy(shown.alias("shown")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("shown", "n", numbers.amount(F.col("shown")).alias("parsed"), (numbers.amount(F.col("shown")) > 50000).alias("large"))


@query(
    """with d as (select o_orderkey as k, lpad(cast(o_orderkey * 7919 % 100000000000 as varchar), 11, '0') as v from orders)
    select k, v, list_sum(list_transform(range(1, 12), lambda i: case when i % 2 = 1 then cast(v[i] as int) else case when 2 * cast(v[i] as int) > 9 then 2 * cast(v[i] as int) - 9 else 2 * cast(v[i] as int) end end)) % 10 = 0 as ok from d"""
)
def vat_check(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.lpad((F.col("o_orderkey") * 7919 % 100000000000).cast("string"), 11, "0").alias("v"))
    return d.select("k", "v", numbers.valid_vat(F.col("v")).alias("ok"))


@query("with d as (select o_orderkey as k, case o_orderkey % 3 when 0 then 'IT60X' || lpad(cast(o_orderkey as varchar), 22, '0') when 1 then 'it 60x ' || lpad(cast(o_orderkey as varchar), 22, '0') else 'DE' || cast(o_orderkey as varchar) end as v from orders) select k, v, starts_with(upper(replace(v, ' ', '')), 'IT') and length(replace(v, ' ', '')) = 27 as ok from d")
def iban_check(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    padded = F.lpad(k.cast("string"), 22, "0")
    v = F.when(k % 3 == 0, F.concat(F.lit("IT60X"), padded)).when(k % 3 == 1, F.concat(F.lit("it 60x "), padded)).otherwise(F.concat(F.lit("DE"), k.cast("string")))
    return table(spark, sf, "orders").select(k.alias("k"), v.alias("v")).withColumn("ok", numbers.valid_iban(F.col("v")))


@query(
    """with t as (select extract_id, confidence, trace.ocr_confidence as o, layout, importo from extracted_data)
    select extract_id, round(coalesce(confidence, 0.4) * coalesce(o, 1.0) * case when layout = 'DETERMINAZIONE' then 0.96 else 0.95 end, 6) as overall, cast(floor(coalesce(confidence, 0.4) * 100) as int) as veracity,
    case when importo is null then 0.0 when importo < 100 or importo > 10000000 then 0.3 else 1.0 end as amount_confidence, case when importo is null or importo > 5000000 then 0.0 else importo end as bounded from t"""
)
def confidence_scores(spark: SparkSession, sf: str) -> DataFrame:
    c, v = F.coalesce("confidence", F.lit(0.4)), F.col("importo")
    return table(spark, sf, "extracted_data").select(
        "extract_id",
        F.round(c * F.coalesce("trace.ocr_confidence", F.lit(1.0)) * F.when(F.col("layout") == "DETERMINAZIONE", 0.96).otherwise(0.95), 6).alias("overall"),
        F.floor(c * 100).cast("int").alias("veracity"),
        F.when(v.isNull(), 0.0).when((v < 100) | (v > 10000000), 0.3).otherwise(1.0).alias("amount_confidence"),
        numbers.capped(v).alias("bounded"),
    )


@query("select coalesce(lang, '<vuoto>') as lang, count(*) as n from documents group by 1 order by n desc, lang limit 30")
def value_counts_lang(spark: SparkSession, sf: str) -> DataFrame:
    return quality.value_counts(table(spark, sf, "documents"), "lang", 30)


@query("select coalesce(doc_type, '<vuoto>') as doc_type, count(*) filter (lang = 'it') as it, count(*) filter (lang = 'de') as de, count(*) filter (lang = 'fr') as fr, count(*) filter (lang = 'en') as en from documents group by 1")
def crosstab_type_lang(spark: SparkSession, sf: str) -> DataFrame:
    return quality.crosstab(table(spark, sf, "documents"), "doc_type", "lang", ["it", "de", "fr", "en"])


@query("select coalesce(lang, '<vuoto>') as lang, count(*) as n, round(avg(n_chars), 4) as mean_chars, median(n_chars) as median_chars, sum((n_chars < 500)::int) as short_texts from documents group by 1")
def numeric_profile_lang(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "documents").groupBy(F.coalesce("lang", F.lit("<vuoto>")).alias("lang"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.median("n_chars").cast("double").alias("median_chars"), F.sum((F.col("n_chars") < 500).cast("int")).alias("short_texts"))


_ISSUES = """with c as (select count(*) as t, count(*) filter (text is null) as null_text, count(*) filter (length(trim(text)) = 0) as empty_text, count(*) filter (n_chars < 120) as short_text, count(*) filter (lang is null or lang = 'und') as unknown_language,
  count(*) filter (ente is null) as no_ente, count(text) - count(distinct sha256(text)) as duplicate_text from documents),
u as (select unnest([{'issue': 'null_text', 'n': null_text}, {'issue': 'empty_text', 'n': empty_text}, {'issue': 'short_text', 'n': short_text}, {'issue': 'unknown_language', 'n': unknown_language}, {'issue': 'no_ente', 'n': no_ente}, {'issue': 'duplicate_text', 'n': duplicate_text}]) as x, t from c)
select x.issue as issue, x.n as n, t as total, case when t = 0 then 0.0 else round(100.0 * x.n / t, 2) end as percent, case when round(100.0 * x.n / t, 2) >= 25 then 1 when round(100.0 * x.n / t, 2) >= 10 then 2 when x.n > 0 and round(100.0 * x.n / t, 2) > 0 then 3 else 4 end as priority from u"""


@query(_ISSUES)
def quality_issues(spark: SparkSession, sf: str) -> DataFrame:
    return quality.issue_table(table(spark, sf, "documents"))


@query(
    """select 'error' as level, 'duplicate doc_id' as name, count(*) - count(distinct doc_id) as n from documents union all select 'warning', 'duplicate text', count(text) - count(distinct sha256(text)) from documents
    union all select 'warning', 'missing source', count(*) filter (source is null) from documents union all select 'warning', 'n_chars differs', count(*) filter (length(text) <> n_chars) from documents"""
)
def validation_report(spark: SparkSession, sf: str) -> DataFrame:
    return quality.validation(table(spark, sf, "documents"))


@query(
    """select * from (values ('doc_id', 'bigint', 'bigint', 'ok'), ('text', 'string', 'string', 'ok'), ('n_chars', 'int', 'bigint', 'type'), ('title', 'string', null, 'missing'), ('lang', 'string', 'string', 'ok')) as t("column", expected, actual, status)"""
)
def schema_report(spark: SparkSession, sf: str) -> DataFrame:
    return quality.schema_report(table(spark, sf, "documents"), {"doc_id": "bigint", "text": "string", "n_chars": "int", "title": "string", "lang": "string"})


@query("select doc_id, text, cast(null as varchar) as title, try_cast(n_chars as int) as n_chars from documents")
def conform(spark: SparkSession, sf: str) -> DataFrame:
    return quality.conform(table(spark, sf, "documents"), {"doc_id": "bigint", "text": "string", "title": "string", "n_chars": "int"})


@query("select event_id from admin_events where document_type is null or regexp_matches(document_type, '^\\d+$') or lower(document_type) = 'altro' union all select event_id from admin_events where coalesce(length(raw_text), 0) < 50")
def review_filters(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "admin_events")
    kind = F.col("document_type")
    untyped = e.where(kind.isNull() | kind.rlike(r"^\d+$") | (F.lower(kind) == "altro")).select("event_id")
    return untyped.unionAll(e.where(F.coalesce(F.length("raw_text"), F.lit(0)) < 50).select("event_id"))


@query("select event_type as op, count(*) as n, round(sum(value), 4) as total, round(avg(value), 6) as mean, round(100.0 * count(*) filter (value > 10) / count(*), 2) as success_rate from events group by 1")
def op_metrics(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "events").groupBy(F.col("event_type").alias("op"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.round(100.0 * F.count(F.when(F.col("value") > 10, 1)) / F.count(F.lit(1)), 2).alias("success_rate"))
