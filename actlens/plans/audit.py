"""Audit, dashboard and roll-up queries over the act views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actlens.operators import audit, rollup
from actlens.operators.views import ACTS_SQL, ATTACHMENTS_SQL, acts, attachments
from actlens.plans.registry import query
from actlens.session import table

AUDIT_SQL = f"""
with {ACTS_SQL},
direct as (select beneficiario, count(*) as n from acts where tipo_procedura like '%affidamento diretto%' group by 1),
bound as (select avg(n) + 2.0 * stddev_samp(n) as b, count(*) as g from direct),
frequent as (select beneficiario from direct, bound where g >= 3 and n > b),
months as (select month(data_parsed) as m, cast(sum(importo) as double) as s from acts group by 1),
december as (select coalesce(stddev_samp(s) > 0 and max(case when m = 12 then s end) > avg(s) + 1.5 * stddev_samp(s), false) as peaks from months),
flagged as (
  select a.*, (f.beneficiario is not null and coalesce(tipo_procedura, '') like '%affidamento%') as r1,
         ((importo >= 39000 and importo < 40000) or (importo >= 135000 and importo < 140000)) as r2,
         (category = 'Contabilità' and importo > 0 and (cig is null or cig like '%0000%')) as r3,
         (peaks and month(data_parsed) = 12 and importo > 0) as r4
  from acts a left join frequent f on a.beneficiario = f.beneficiario cross join december),
audited as (
  select atto_group, beneficiario, responsabile, category, importo, data_parsed, least(35 * r1::int + 50 * r2::int + 40 * r3::int + 25 * r4::int, 100) as risk_score,
         concat_ws(' | ', case when r1 then 'Rotazione Statistica Anomala' end, case when r2 then 'Smurfing (Importo Borderline)' end,
                   case when r3 then 'CIG Fantasma (Spesa non tracciata)' end, case when r4 then 'Febbre di Dicembre (Picco Spesa)' end) as flags
  from flagged)
"""


def _audited(spark: SparkSession, sf: str) -> DataFrame:
    return audit.audit(acts(spark, sf))


@query(AUDIT_SQL + "select atto_group, beneficiario, importo, risk_score, flags from audited order by risk_score desc, atto_group")
def audit_risk_score(spark: SparkSession, sf: str) -> DataFrame:
    return _audited(spark, sf).select("atto_group", "beneficiario", "importo", "risk_score", "flags").orderBy(F.desc("risk_score"), "atto_group")


@query(AUDIT_SQL + "select flag, count(*) as n from (select unnest(string_split(flags, ' | ')) as flag from audited where risk_score > 0) group by 1")
def audit_flag_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _audited(spark, sf).where("risk_score > 0").select(F.explode(F.split("flags", r" \| ")).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query(AUDIT_SQL + "select beneficiario, max(risk_score) as top_score from audited group by 1 order by top_score desc, beneficiario limit 5")
def audit_top_entities(spark: SparkSession, sf: str) -> DataFrame:
    return _audited(spark, sf).groupBy("beneficiario").agg(F.max("risk_score").alias("top_score")).orderBy(F.desc("top_score"), "beneficiario").limit(5)


@query(
    AUDIT_SQL
    + """select sum(importo) as spend, sum(case when importo > 400000 then importo else 0 end) as outlier_spend, count(*) as acts, count(*) filter (risk_score > 0) as suspicious,
    round(avg(risk_score), 6) as mean_risk, sum(case when risk_score > 0 then importo else 0 end) as suspicious_value, round(100.0 * count(*) filter (risk_score > 0) / count(*), 2) as hit_rate from audited"""
)
def audit_kpis(spark: SparkSession, sf: str) -> DataFrame:
    hit = F.col("risk_score") > 0
    return _audited(spark, sf).agg(
        F.sum("importo").alias("spend"),
        F.sum(F.when(F.col("importo") > 400000, F.col("importo")).otherwise(0)).alias("outlier_spend"),
        F.count(F.lit(1)).alias("acts"),
        F.count(F.when(hit, 1)).alias("suspicious"),
        F.round(F.avg("risk_score"), 6).alias("mean_risk"),
        F.sum(F.when(hit, F.col("importo")).otherwise(0)).alias("suspicious_value"),
        F.round(100.0 * F.count(F.when(hit, 1)) / F.count(F.lit(1)), 2).alias("hit_rate"),
    )


@query(AUDIT_SQL + "select atto_group, risk_score from audited where risk_score >= 50")
def risk_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _audited(spark, sf).where("risk_score >= 50").select("atto_group", "risk_score")


@query(f"with {ACTS_SQL}, d as (select beneficiario, count(*) n from acts where tipo_procedura = 'affidamento diretto' group by 1), s as (select avg(n) + 2.0 * stddev_samp(n) b from d) select beneficiario, n from d, s where n > b")
def rotation_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return audit.outlying_groups(acts(spark, sf).where("tipo_procedura = 'affidamento diretto'"), "beneficiario", 2.0)


@query(
    f"""with {ACTS_SQL} select atto_group, beneficiario, importo from acts
    where (regexp_matches(beneficiario, '(?i)#0000000[0-4]') or regexp_matches(coalesce(cig, ''), '(?i)z0000001')) and category in ('Contabilità', 'Personale') and importo between 1000 and 300000"""
)
def explorer_search(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("beneficiario").rlike("(?i)#0000000[0-4]") | F.coalesce("cig", F.lit("")).rlike("(?i)z0000001")
    return acts(spark, sf).where(text & F.col("category").isin("Contabilità", "Personale") & F.col("importo").between(1000, 300000)).select("atto_group", "beneficiario", "importo")


@query(f"with {ACTS_SQL} select strftime(data_parsed, '%Y-%m') as mese, sum(importo) as spesa from acts where category <> 'Personale' group by 1 order by 1")
def monthly_trend(spark: SparkSession, sf: str) -> DataFrame:
    return acts(spark, sf).where("category <> 'Personale'").groupBy(F.date_format("data_parsed", "yyyy-MM").alias("mese")).agg(F.sum("importo").alias("spesa")).orderBy("mese")


@query(f"with {ATTACHMENTS_SQL} select beneficiario, sum(importo) as totale from attachments where beneficiario is not null group by 1 order by totale desc, beneficiario limit 50")
def top_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.top_totals(attachments(spark, sf), "beneficiario", "importo", 50, "totale")


@query(f"with {ACTS_SQL} select responsabile, count(*) as atti from acts where responsabile <> 'NATION_0' group by 1 order by atti desc, responsabile limit 5")
def top_officers(spark: SparkSession, sf: str) -> DataFrame:
    return acts(spark, sf).where("responsabile <> 'NATION_0'").groupBy("responsabile").agg(F.count(F.lit(1)).alias("atti")).orderBy(F.desc("atti"), "responsabile").limit(5)


@query(f"with {ATTACHMENTS_SQL} select capitolo, sum(importo) as totale from attachments group by 1 order by totale desc, capitolo limit 5")
def top_chapters(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.top_totals(attachments(spark, sf), "capitolo", "importo", 5, "totale")


@query(f"with {ATTACHMENTS_SQL} select source, doc_type = 'VistoContabile' as is_visto, doc_type, count(importo) as n, sum(importo) as totale from attachments group by all")
def kpi_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return attachments(spark, sf).groupBy("source", (F.col("doc_type") == "VistoContabile").alias("is_visto"), "doc_type").agg(F.count("importo").alias("n"), F.sum("importo").alias("totale"))


@query("select count(distinct l_suppkey) as suppliers, count(distinct l_partkey) as chapters from lineitem")
def distinct_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("chapters"))


@query(
    f"""with {ATTACHMENTS_SQL}, grouped as (
      select regexp_replace(regexp_replace(pdf_name, '\\.[A-Za-z0-9]+$', ''), '_\\d+$', '') as atto_group, *, doc_type = 'VistoContabile' as visto from attachments)
    select atto_group,
      arg_min(doc_type, (case doc_type when 'Determinazione' then 1 when 'Delibera' then 2 else 5 end) * 1000 + seq) as doc_type,
      coalesce(max(importo) filter (visto), max(importo)) as importo_max,
      coalesce(arg_min(beneficiario, seq) filter (visto), arg_min(beneficiario, seq)) as beneficiario,
      string_agg(distinct cast(capitolo as varchar), ',' order by cast(capitolo as varchar)) as capitoli,
      bool_or(is_signed) as is_signed, bool_or(accounting_relevant) as accounting_relevant, bool_or(visto) as has_visto_contabile,
      round(avg(veracity), 6) as compliance, max(veracity) + case when bool_or(visto) then 20 else 0 end as veracity, count(*) as allegati
    from grouped group by 1"""
)
def act_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.roll_up(attachments(spark, sf))


@query(f"with {ACTS_SQL} select category, count(*) as n, round(avg(importo), 4) as mean_amount, median(cast(importo as double)) as median_amount, sum((cig is null)::int) as without_cig from acts group by 1")
def category_profile(spark: SparkSession, sf: str) -> DataFrame:
    return acts(spark, sf).groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("importo").cast("double")), 4).alias("mean_amount"), F.median(F.col("importo").cast("double")).alias("median_amount"), F.sum(F.col("cig").isNull().cast("int")).alias("without_cig")
    )


@query(
    """select n_name as label, case when count(*) over (partition by c_nationkey) < 55 then 'Altro' else n_name end as folded, c_custkey from customer join nation on c_nationkey = n_nationkey"""
)
def rare_class_folding(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rollup.fold_rare(joined.select(F.col("n_name").alias("label"), "c_custkey"), "label", 55)
