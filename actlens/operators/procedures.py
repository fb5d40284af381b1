"""Events folded into procedures, and the anomalies of procedures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of event and document types and their labels (fixed values).
EVENT_LABELS = {"IMPEGNO": "Impegno di spesa", "AFFIDAMENTO": "Affidamento", "LIQUIDAZIONE": "Liquidazione", "PAGAMENTO": "Pagamento", "NOMINA": "Nomina", "SELEZIONE": "Selezione", "ALTRO": "Altro"}
DOCUMENT_LABELS = {"DETERMINA": "Determinazione", "DELIBERA": "Delibera", "ORDINANZA": "Ordinanza", "BANDO": "Bando", "AVVISO": "Avviso", "ATTO": "Atto", "NUMERARIA": "Atto Numerario", "ESITO": "Esito/Verbale", "ALTRO": "Altro"}


def label(c: Column, labels: dict[str, str]) -> Column:
    """An enum's name or label in any case as its label; null and unknown values are 'Altro'."""
    up, out = F.upper(F.trim(c)), None
    for name, text in labels.items():
        hit = (up == name) | (up == text.upper())
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return out.otherwise("Altro")


def clean_code(c: Column) -> Column:
    """A CIG or CUP without its label, upper case; null where blank."""
    return F.nullif(F.regexp_replace(F.upper(F.trim(c)), r"^(CIG|CUP)\s*:?\s*", ""), F.lit(""))


def procedure_id() -> Column:
    """The CIG, else the CUP, else a hash of title, date and ente."""
    fallback = F.concat(F.lit("HASH_"), F.substring(F.sha1(F.concat_ws("_", F.coalesce("title", F.lit("")), F.coalesce(F.date_format("document_date", "yyyy-MM-dd"), F.lit("")), F.coalesce("ente", F.lit("")))), 1, 16))
    return F.coalesce(F.concat(F.lit("CIG_"), clean_code(F.col("cig"))), F.concat(F.lit("CUP_"), clean_code(F.col("cup"))), fallback)


def normalized_events(events: DataFrame) -> DataFrame:
    return events.select("event_id", procedure_id().alias("procedure_id"), label(F.col("event_type"), EVENT_LABELS).alias("event_type"), F.col("economic_value").cast("decimal(18,2)").alias("value"), "document_date", "title", "actors")


def fold(events: DataFrame) -> DataFrame:
    """One row per procedure: number of events, total, first and last date, title of the first event, kinds."""
    e = normalized_events(events)
    return e.groupBy("procedure_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.coalesce(F.sum("value"), F.lit(0).cast("decimal(28,2)")).alias("total"),
        F.min("document_date").alias("starts"),
        F.max("document_date").alias("ends"),
        F.min_by("title", F.when(F.col("title").isNotNull(), F.col("event_id"))).alias("title"),
        F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"),
    )


def anomalies(events: DataFrame, *, least_events: int = 3, modal_share: float = 0.6, rotation: int = 3) -> DataFrame:
    """(procedure_id, anomaly): fragmentation (one kind prevails in many events), payment without commitment, and payees met too often."""
    e = normalized_events(events)
    per_kind = e.groupBy("procedure_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    sums = per_kind.groupBy("procedure_id").agg(F.sum("n").alias("events"), F.max("n").alias("modal"), F.bool_or(F.col("event_type") == "Liquidazione").alias("paid"), F.bool_or(F.col("event_type") == "Impegno di spesa").alias("committed"))
    split = sums.where((F.col("events") >= least_events) & (F.col("modal") >= F.col("events") * F.lit(modal_share))).select("procedure_id", F.lit("FRAMMENTAZIONE").alias("anomaly"))
    open_ = sums.where(F.col("paid") & ~F.col("committed")).select("procedure_id", F.lit("INCOMPLETA").alias("anomaly"))
    payees = e.select("procedure_id", F.explode("actors").alias("a")).where(F.upper("a.actor_type") == "BENEFICIARIO").select("procedure_id", F.col("a.name").alias("payee")).where(F.col("payee").isNotNull() & ~F.col("payee").isin("NON IDENTIFICATO", "DIVERSI/NON APPLICABILE"))
    often = payees.groupBy("payee").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= rotation).select("payee")
    rotated = payees.join(often, "payee", "left_semi").select("procedure_id", F.lit("ROTAZIONE").alias("anomaly")).distinct()
    return split.unionByName(open_).unionByName(rotated)
