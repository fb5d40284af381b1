"""Profiles, quality issues, validation and schemas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlens.functions import numbers

EMPTY = "<vuoto>"


def value_counts(df: DataFrame, column: str, k: int) -> DataFrame:
    return df.groupBy(F.coalesce(column, F.lit(EMPTY)).alias(column)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts by row and column value, zeros filled, nulls labelled."""
    return df.groupBy(F.coalesce(row, F.lit(EMPTY)).alias(row)).agg(*(F.count(F.when(F.col(column) == v, 1)).alias(v) for v in values))


def issue_table(df: DataFrame) -> DataFrame:
    """One row per check: count, total, percent and priority, from one aggregate."""
    text = F.col("text")
    checks = {
        "null_text": F.count(F.when(text.isNull(), 1)),
        "empty_text": F.count(F.when(F.length(F.trim(text)) == 0, 1)),
        "short_text": F.count(F.when(F.col("n_chars") < 120, 1)),
        "unknown_language": F.count(F.when(F.col("lang").isNull() | (F.col("lang") == "und"), 1)),
        "no_ente": F.count(F.when(F.col("ente").isNull(), 1)),
        "duplicate_text": F.count("text") - F.countDistinct(F.sha2(text, 256)),
    }
    one = df.agg(F.count(F.lit(1)).alias("total"), *(c.alias(n) for n, c in checks.items()))
    pairs = F.array(*(F.struct(F.lit(n).alias("issue"), F.col(n).alias("n")) for n in checks))
    rows = one.select("total", F.explode(pairs).alias("x")).select(F.col("x.issue").alias("issue"), F.col("x.n").alias("n"), "total")
    return rows.withColumn("percent", numbers.percent(F.col("n"), F.col("total"))).withColumn("priority", numbers.priority(F.col("percent")))


def validation(df: DataFrame) -> DataFrame:
    """(level, name, n): errors make a table unusable, warnings don't."""
    one = df.agg(
        (F.count(F.lit(1)) - F.countDistinct("doc_id")).alias("a"),
        (F.count("text") - F.countDistinct(F.sha2("text", 256))).alias("b"),
        F.count(F.when(F.col("source").isNull(), 1)).alias("c"),
        F.count(F.when(F.length("text") != F.col("n_chars"), 1)).alias("d"),
    )
    names = (("error", "duplicate doc_id", "a"), ("warning", "duplicate text", "b"), ("warning", "missing source", "c"), ("warning", "n_chars differs", "d"))
    rows = F.array(*(F.struct(F.lit(level).alias("level"), F.lit(name).alias("name"), F.col(c).alias("n")) for level, name, c in names))
    return one.select(F.explode(rows).alias("x")).select("x.*")


def schema_report(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """(column, expected, actual, status): missing columns are errors, other types warnings."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = [(c, t, actual.get(c), "missing" if c not in actual else "ok" if actual[c] == t else "type") for c, t in expected.items()]
    return df.sparkSession.createDataFrame(rows, "column string, expected string, actual string, status string")


def conform(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """Exactly the columns of ``schema``, cast; missing ones are typed nulls."""
    return df.select(*((F.col(c).try_cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in schema.items()))
