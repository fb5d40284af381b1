"""Rolling attachments up into acts, totals and rare classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def act_group(pdf_name: Column) -> Column:
    """The file's stem without its trailing number."""
    return F.regexp_replace(F.regexp_replace(pdf_name, r"\.[A-Za-z0-9]+$", ""), r"_\d+$", "")


def top_totals(df: DataFrame, key: str, value: str, k: int, name: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(value).alias(name)).orderBy(F.desc(name), key).limit(k)


#: Rank of a type when the attachments of an act differ (fixed values).
TYPE_RANK = {"Determinazione": 1, "Delibera": 2, "Ordinanza": 3, "Decreto": 4}


def roll_up(attachments: DataFrame) -> DataFrame:
    """One act per group of attachments, keeping the null group; values of an accounting visa come first where there is one."""
    visa = F.col("doc_type") == "VistoContabile"
    rank = F.lit(9)
    for kind, r in reversed(TYPE_RANK.items()):
        rank = F.when(F.col("doc_type") == kind, r).otherwise(rank)
    return (
        attachments.groupBy(act_group(F.col("pdf_name")).alias("atto_group"))
        .agg(
            F.min_by("doc_type", F.struct(rank, F.col("seq"))).alias("doc_type"),
            F.coalesce(F.max(F.when(visa, F.col("importo"))), F.max("importo")).alias("importo_max"),
            F.coalesce(F.min_by("beneficiario", F.when(visa, F.col("seq"))), F.min_by("beneficiario", "seq")).alias("beneficiario"),
            F.array_join(F.array_sort(F.collect_set(F.col("capitolo").cast("string"))), ",").alias("capitoli"),
            F.bool_or("is_signed").alias("is_signed"),
            F.bool_or("accounting_relevant").alias("accounting_relevant"),
            F.bool_or(visa).alias("has_visto_contabile"),
            F.round(F.avg("veracity"), 6).alias("compliance"),
            (F.max("veracity") + F.when(F.bool_or(visa), 20).otherwise(0)).alias("veracity"),
            F.count(F.lit(1)).alias("allegati"),
        )
    )


def fold_rare(df: DataFrame, label: str, least: int, other: str = "Altro") -> DataFrame:
    """Adds ``folded``: labels of fewer than ``least`` rows become one class. The counts are joined back, so no label gathers its rows in one task."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(counts, label).withColumn("folded", F.when(F.col("_n") < least, other).otherwise(F.col(label))).drop("_n")
