"""Anomaly scoring: statistics as small sub-plans, one boolean column per rule, one pass over the acts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outlying_groups(df: DataFrame, key: str, sigmas: float, least_groups: int = 3) -> DataFrame:
    """Keys whose number of rows exceeds the mean over keys by ``sigmas`` sample standard deviations, if there are enough keys."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    bound = counts.agg((F.avg("n") + sigmas * F.stddev_samp("n")).alias("bound"), F.count(F.lit(1)).alias("groups"))
    return counts.crossJoin(F.broadcast(bound)).where((F.col("groups") >= least_groups) & (F.col("n") > F.col("bound"))).select(key, "n")  # one row of statistics


def peak_month(df: DataFrame, day: str, value: str, month: int, sigmas: float) -> DataFrame:
    """One row: whether the month's sum, pooled over years, exceeds the mean of months by ``sigmas`` deviations."""
    sums = df.where(F.col(day).isNotNull()).groupBy(F.month(day).alias("m")).agg(F.sum(value).cast("double").alias("s"))
    stats = sums.agg(F.avg("s").alias("mu"), F.stddev_samp("s").alias("sd"), F.max(F.when(F.col("m") == month, F.col("s"))).alias("peak"))
    return stats.select(F.coalesce((F.col("sd") > 0) & (F.col("peak") > F.col("mu") + sigmas * F.col("sd")), F.lit(False)).alias("peaks"))


def scored(df: DataFrame, rules: Sequence[tuple[str, int, Column]], most: int = 100) -> DataFrame:
    """Adds ``risk_score`` (points of the rules that hold, at most ``most``) and ``flags`` (their names, joined)."""
    points = sum((F.when(F.coalesce(c, F.lit(False)), p).otherwise(0) for _, p, c in rules), F.lit(0))
    flags = F.concat_ws(" | ", *(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, _, c in rules))
    return df.withColumn("risk_score", F.least(points, F.lit(most))).withColumn("flags", flags)


def audit(acts: DataFrame, *, rotation_sigmas: float = 2.0, month_sigmas: float = 1.5, bands: Sequence[tuple[int, int]] = ((39000, 40000), (135000, 140000))) -> DataFrame:
    """Acts with their risk: unusual repetition of a payee, amounts just below a threshold, spending without an identifier, a peak in December."""
    direct = acts.where(F.col("tipo_procedura").rlike("affidamento diretto|sotto soglia") & F.col("beneficiario").isNotNull())
    frequent = outlying_groups(direct, "beneficiario", rotation_sigmas).select("beneficiario", F.lit(True).alias("_frequent"))
    december = peak_month(acts, "data_parsed", "importo", 12, month_sigmas)
    rows = acts.join(frequent, "beneficiario", "left").crossJoin(F.broadcast(december))  # one row
    band = F.lit(False)
    for low, high in bands:
        band = band | ((F.col("importo") >= low) & (F.col("importo") < high))
    no_cig = F.col("cig").isNull() | F.col("cig").rlike("0000|DA ASSEGNARE|N/D")
    rules = [
        ("Rotazione Statistica Anomala", 35, F.col("_frequent") & F.col("tipo_procedura").contains("affidamento")),
        ("Smurfing (Importo Borderline)", 50, band),
        ("CIG Fantasma (Spesa non tracciata)", 40, (F.col("category") == "Contabilità") & (F.col("importo") > 0) & no_cig),
        ("Febbre di Dicembre (Picco Spesa)", 25, F.col("peaks") & (F.month("data_parsed") == 12) & (F.col("importo") > 0)),
    ]
    return scored(rows, rules).drop("_frequent", "peaks")
