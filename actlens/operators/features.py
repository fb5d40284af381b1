"""Text metrics, links and kinds of notices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actlens.functions import dates, text


def text_features(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = F.col(text_col)
    words = F.regexp_extract_all(t, F.lit(f"({text.WORD})"), F.lit(1))
    years = F.regexp_extract_all(t, F.lit(r"\b(20\d{2})\b"), F.lit(1))
    return df.select(
        id_col,
        F.length(t).alias("text_chars"),
        F.size(words).alias("text_words"),
        F.size(F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(f"({text.WORD})"), F.lit(1)))).alias("unique_words"),
        text.count_matches(t, r"(?i)(?:€|\beuro\b)").alias("euro_mentions"),
        text.count_matches(t, r"\bCIG\b").alias("cig_mentions"),
        text.count_matches(t, r"\bCUP\b").alias("cup_mentions"),
        text.count_matches(t, r"\b\d{2}/\d{2}/\d{4}\b").alias("date_mentions"),
        F.array_join(F.array_sort(F.array_distinct(years)), ",").alias("years_mentioned"),
    )


def doc_name(link: Column) -> Column:
    """The file a link names: a query parameter, else the last part of the path."""
    return F.coalesce(F.nullif(F.regexp_extract(link, r"[?&](?:f|file|filename|name)=([^&#]*)", 1), F.lit("")), F.nullif(F.regexp_extract(link, r"([^/?#]*)(?:[?#].*)?$", 1), F.lit("")))


def is_attachment(link: Column) -> Column:
    return link.rlike(r"(?i)\.(pdf|p7m|php|doc|docx|zip)([?#]|$)") | link.contains("getdoc.php") | link.rlike("(?i)(allegat|scarica|download)")


def attachment_links(notices: DataFrame) -> DataFrame:
    links = notices.select("notice_id", F.explode("allegati").alias("link"))
    return links.select("notice_id", "link", doc_name(F.col("link")).alias("doc_name"), is_attachment(F.col("link")).alias("is_attachment"))


#: Kinds of notices by words of the subject and parameters of the link, in order (fixed values).
KIND_BY_SUBJECT = (("Determinazione", ("determina",)), ("Delibera", ("delibera",)), ("Ordinanza", ("ordinanza",)), ("Bando", ("bando",)), ("Avviso", ("avviso",)), ("Determinazione", ("liquidazione", "impegno")))
KIND_BY_LINK = (("Determinazione", ("tipo=det",)), ("Delibera", ("tipo=del",)), ("Ordinanza", ("tipo=ord",)))


def notice_kind() -> Column:
    none = F.lit(None).cast("string")
    subject = text.first_label(F.lower(F.coalesce("oggetto", F.lit(""))), KIND_BY_SUBJECT, none)
    link = text.first_label(F.lower(F.coalesce("dettaglio_url", F.lit(""))), KIND_BY_LINK, none)
    return F.coalesce(subject, link, F.nullif(F.trim("tipologia"), F.lit("")), F.lit("unknown"))


def crawl_filter(notices: DataFrame, *, include: Sequence[str] = (), exclude: Sequence[str] = (), first: str | None = None, last: str | None = None, pattern: str | None = None) -> DataFrame:
    """Notices of included and not excluded kinds, published within the bounds, whose title or subject matches."""
    kind = F.lower(F.trim("tipologia"))
    keep = dates.within(dates.parse(F.col("data_pubblicazione"), ("dd/MM/yyyy", "yyyy-MM-dd")), first, last)
    if include:
        keep = keep & kind.isin(*include)
    if exclude:
        keep = keep & ~kind.isin(*exclude)
    if pattern:
        keep = keep & F.concat_ws(" ", F.coalesce("titolo", F.lit("")), F.coalesce("oggetto", F.lit(""))).rlike(f"(?i){pattern}")
    return notices.where(keep)
