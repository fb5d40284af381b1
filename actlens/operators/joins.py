"""Joins: metadata, feedback, lookups, nearest match by blocking."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row per key: the columns of the row that comes first. Combined map-side, so a hot key costs one struct a task."""
    picked = df.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("_first"))
    return picked.select(key, *(F.col(f"_first.{c}").alias(c) for c in columns))


def last_by(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    picked = df.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_last"))
    return picked.select(key, *(F.col(f"_last.{c}").alias(c) for c in columns))


def updated(df: DataFrame, changes: DataFrame, key: str, column: str, value: str) -> DataFrame:
    """``column`` replaced where ``changes`` has a non-null ``value`` for the key."""
    c = changes.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    return df.join(c, df[key] == F.col("_k"), "left").withColumn(column, F.coalesce("_v", F.col(column))).drop("_k", "_v")


def similarity(a: Column, b: Column) -> Column:
    """Levenshtein similarity in percent."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(100.0)).otherwise(F.round(100.0 * (1 - F.levenshtein(a, b) / longest), 4))


def token_set_ratio(a: str, b: str) -> float:
    """Similarity in percent of what two strings share and what is their own, whatever the order of words."""
    x, y = set(a.split()), set(b.split())
    common = " ".join(sorted(x & y))
    left, right = f"{common} {' '.join(sorted(x - y))}".strip(), f"{common} {' '.join(sorted(y - x))}".strip()
    return max(_ratio(common, left) if common else 0.0, _ratio(common, right) if common else 0.0, _ratio(left, right))


def _ratio(a: str, b: str) -> float:
    """200 * longest common subsequence / total length."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            keep = row[j]
            row[j] = diagonal + 1 if x == y else max(row[j], row[j - 1])
            diagonal = keep
    return 200.0 * row[-1] / (len(a) + len(b))


def nearest_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text: str, *, least: float = 85.0, rare: float = 0.01) -> DataFrame:
    """(``left_id``, ``right_id``, score): for each left row the most similar right one above ``least``, compared only where they share a word that is not common on the right."""
    words = lambda df, i: df.select(i, F.explode(F.array_distinct(F.split(text, " "))).alias("_w")).where(F.length("_w") > 3)
    counts = words(right, right_id).groupBy("_w").agg(F.count(F.lit(1)).alias("_n"))
    total = right.count()
    usable = counts.where(F.col("_n") <= max(3, rare * total)).select("_w")
    pairs = words(left, left_id).join(words(right, right_id).join(usable, "_w"), "_w").select(left_id, right_id).distinct()
    both = pairs.join(left.select(left_id, F.col(text).alias("_a")), left_id).join(right.select(right_id, F.col(text).alias("_b")), right_id)
    kinds = dict(both.dtypes)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [token_set_ratio(x or "", y or "") for x, y in zip(b.column("_a").to_pylist(), b.column("_b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(left_id), b.column(right_id), pa.array(s, pa.float64())], names=[left_id, right_id, "score"])

    scored = both.select(left_id, right_id, "_a", "_b").mapInArrow(score, f"{left_id} {kinds[left_id]}, {right_id} {kinds[right_id]}, score double").where(F.col("score") > least)
    best = Window.partitionBy(left_id).orderBy(F.desc("score"), F.asc(right_id))
    return scored.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")
