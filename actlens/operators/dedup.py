"""Exact deduplication and incremental reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def notice_key() -> Column:
    """The detail page, else the first file, else a hash of title, number, date and subject."""
    return F.coalesce(F.nullif(F.col("dettaglio_url"), F.lit("")), F.try_element_at("allegati", F.lit(1)), F.sha1(F.concat_ws("|", "titolo", "numero", "data_pubblicazione", "oggetto")))


def first_per_content(df: DataFrame, content: str, order: str) -> DataFrame:
    """The first row of each content; rows of null content all stay. Ids are grouped by a hash and joined back, so copies never meet in one task."""
    known = df.where(F.col(content).isNotNull())
    firsts = known.groupBy(F.sha2(content, 256).alias("_h")).agg(F.min(order).alias(order)).drop("_h")
    return known.join(firsts, order, "left_semi").unionByName(df.where(F.col(content).isNull()))


def unseen(batch: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """Rows of the batch whose key the history doesn't hold; a null key is never seen."""
    return batch.join(history.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")
