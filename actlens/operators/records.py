"""Composite records of acts: parties, relevance, competences, confidence, review and merging."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actlens.functions import dates, numbers, text
from actlens.operators import extract

#: Role and area around a signer (own wording).
OFFICER = r"(?i)(?:il responsabile|il dirigente|il segretario) (?:del|della|dell') *([A-Z][^,\n]{2,60}?) (?:dott|ing|arch|geom|avv|rag)\.? ([A-Z][^,\n]{2,60})"
ROLE = r"(?i)\b(responsabile|dirigente|segretario|presidente)\b"
PROPER = r"\b\p{Lu}{3,}(?: \p{Lu}{3,})+\b"
LIQUIDATED = r"(?i)liquidare[^\n]{0,80}?(?:euro|€) *(\d[\d.]*(?:,\d{2})?)"
#: Relevance of a text by field (own wording).
RELEVANCE: Mapping[str, str] = {
    "accounting": r"(?i)impegno|liquida|capitolo|fattura",
    "personnel": r"(?i)dipendente|assunzione|matricola|selezione",
    "tender": r"(?i)\bgara\b|aggiudica|\bbando\b",
    "works": r"(?i)\blavori\b|manutenzione|cantiere",
    "roads": r"(?i)viabilità|\bstrada\b|divieto di sosta",
}
COMPETENCES: Mapping[str, str] = {"delegation": r"(?i)\bdelega\b[^;\n]*", "assignment": r"(?i)\bdi (?:affidare|demandare) (?:al|all'|alla)[^;\n]*", "decree": r"(?i)\bdecreto sindacale\b[^;\n]*"}


def parties(c: Column) -> tuple[Column, Column, Column]:
    """(role, area, name) of the signing officer; sentinels where there is none."""
    sentinel = F.lit(text.UNKNOWN)
    return F.coalesce(F.upper(text.first_group(c, ROLE)), sentinel), F.coalesce(F.trim(text.first_group(c, OFFICER)), sentinel), F.coalesce(F.upper(F.trim(text.first_group(c, OFFICER, 2))), sentinel)


def chosen_amount(c: Column) -> tuple[Column, Column]:
    """(cents, origin): the amount next to a payment verb, else the largest of the text."""
    paid = F.round(numbers.amount(F.regexp_replace(text.first_group(c, LIQUIDATED), r"^([\d.]+)$", "$1,00")) * 100).cast("bigint")
    largest = F.array_max(extract.amounts(c))
    return F.coalesce(paid, largest), F.when(paid.isNotNull(), "liquidated").when(largest.isNotNull(), "largest")


def relevance(c: Column, rules: Mapping[str, str] = RELEVANCE) -> list[Column]:
    return [c.rlike(p).alias(name) for name, p in rules.items()]


def competences(df: DataFrame, id_col: str, text_col: str, rules: Mapping[str, str] = COMPETENCES) -> DataFrame:
    """(id, kind, description): every competence that a text assigns."""
    t = F.col(text_col)

    def named(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), F.trim(x).alias("description")))

    found = F.flatten(F.array(*(named(k, p) for k, p in rules.items())))
    return df.select(id_col, F.explode(found).alias("_c")).select(id_col, F.col("_c.kind").alias("kind"), F.col("_c.description").alias("description"))


def kind_confidence(name: Column, subject: Column, url: Column, kind: Column) -> Column:
    """Weights .4, .3 and .3 where file name, subject and link agree with the kind, at most 1."""
    k = F.lower(F.substring(F.coalesce(kind, F.lit("?")), 1, 3))
    score = F.lit(0.0)
    for c, w in ((name, 0.4), (subject, 0.3), (url, 0.3)):
        score = score + F.when(F.coalesce(F.lower(c).contains(k), F.lit(False)), w).otherwise(0.0)
    return F.round(F.least(score, F.lit(1.0)), 4)


def filled(df: DataFrame, answers: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Null columns filled from ``answers`` by key; known values stay."""
    a = answers.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in columns))
    joined = df.join(a, df[key] == F.col("_k"), "left")
    return joined.select(*(F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in columns else df[c] for c in df.columns))


def metadata_record(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One nested record per act as JSON: kind, identifiers, amounts, dates and relevance."""
    t = F.col(text_col)
    record = F.struct(
        extract.document_type(t).alias("kind"),
        F.upper(text.first_group(t, extract.CIG)).alias("cig"),
        F.size(extract.amounts(t)).alias("amounts"),
        dates.first_date(t).alias("date"),
        F.array_sort(F.filter(F.array(*(F.when(t.rlike(p), F.lit(n)) for n, p in RELEVANCE.items())), lambda x: x.isNotNull())).alias("fields"),
    )
    return df.select(id_col, F.to_json(record).alias("record"))


def invalid_nodes(nodes: DataFrame) -> DataFrame:
    """(node_id, problem): nodes whose code, label or confidence can't be right."""
    checks = F.array(
        F.when((F.col("node_type") == "CIG") & ~F.coalesce(F.col("codice").rlike("^[A-Z0-9]{10}$"), F.lit(False)), F.lit("codice")),
        F.when(F.coalesce(F.trim("label"), F.lit("")) == "", F.lit("label")),
        F.when((F.col("metadata.confidence_score") < 0) | (F.col("metadata.confidence_score") > 1), F.lit("confidence")),
        F.when(F.col("partita_iva").isNotNull() & ~numbers.valid_vat(F.col("partita_iva")), F.lit("partita_iva")),
    )
    return nodes.select("node_id", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("problem"))
