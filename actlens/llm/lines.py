"""Lines repeated across the documents of one source.

A line is reduced to its letters, lower-cased, and hashed to 128 bits. Each document names every hash once (deduplicated inside the
row, before any shuffle), so the number of documents of a (source, hash) is a plain count that is combined map-side. The lines above
the share are few: a document has a bounded number of lines, and a line must hold ``min_share`` of a source, so a source has at most
(mean lines) / min_share of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of frequent lines up to which their table (24 bytes a row and the source) is sent to every executor; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: White space of a blank text, as in the Unicode property (fixed value).
_BLANK = r"^[\p{IsWhite_Space}\p{Cf}]*$"


def letters(line: Column) -> Column:
    return F.lower(F.regexp_replace(line, r"[^\p{L}]+", ""))


def numbered_lines(df: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(``_id``, ``_source``, ``_lines`` array of (line_no, line, key)) of the rows with a non-blank text; key is null under no letters."""
    rows = df.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.col(text_col).cast("string").alias("_text"))
    rows = rows.where(F.col("_text").isNotNull() & ~F.col("_text").rlike(_BLANK))
    return rows.withColumn("_split", F.split("_text", "\n", -1))


def _keys(min_letters: int) -> Column:
    """Array of (line_no, h, g): two independent 64-bit hashes of each line that is long enough."""
    reduced = F.transform("_split", lambda x, i: F.struct((i + 1).cast("bigint").alias("line_no"), letters(x).alias("t")))
    long_enough = F.filter(reduced, lambda x: F.length(x["t"]) >= min_letters)
    return F.transform(long_enough, lambda x: F.struct(x["line_no"].alias("line_no"), F.xxhash64(x["t"]).alias("h"), F.xxhash64(F.lit(7), x["t"]).alias("g")))


def frequent_lines(df: DataFrame, id_col: str, source_col: str, text_col: str, *, min_share: float = 0.05, min_docs: int = 4, min_letters: int = 15) -> DataFrame:
    """(``_source``, ``h``, ``g``, ``docs``): the lines found in at least ``min_docs`` and ``min_share`` of a source's documents."""
    rows = numbered_lines(df, id_col, source_col, text_col).select("_source", _keys(min_letters).alias("_keys"))
    per_doc = F.array_distinct(F.transform("_keys", lambda x: F.struct(x["h"].alias("h"), x["g"].alias("g"))))
    # one entry without a key per document carries the number of documents of the source through the same shuffle
    entries = F.concat(F.array(F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(None).cast("bigint").alias("g"))), per_doc)
    counts = rows.select("_source", F.explode(entries).alias("_e")).groupBy("_source", F.col("_e.h").alias("h"), F.col("_e.g").alias("g")).agg(F.count(F.lit(1)).alias("docs"))
    counts = counts.where(F.col("h").isNull() | (F.col("docs") >= min_docs))
    totals = counts.where(F.col("h").isNull()).select(F.col("_source").alias("_s"), F.col("docs").alias("_total"))
    return counts.where(F.col("h").isNotNull()).join(totals, F.col("_source").eqNullSafe(F.col("_s"))).where(F.col("docs") >= F.col("_total") * F.lit(min_share) - F.lit(1e-9)).select("_source", "h", "g", "docs")


def _marked(df: DataFrame, id_col: str, source_col: str, text_col: str, min_share: float, min_docs: int, min_letters: int) -> DataFrame:
    """(``_id``, ``line_no``) of every line that is frequent in its source."""
    from actlens.session import cut_lineage

    frequent = cut_lineage(frequent_lines(df, id_col, source_col, text_col, min_share=min_share, min_docs=min_docs, min_letters=min_letters))
    small = frequent.count() <= BROADCAST_ROWS
    frequent = frequent.select(F.col("_source").alias("_s"), F.col("h").alias("_h"), F.col("g").alias("_g"))
    rows = numbered_lines(df, id_col, source_col, text_col).select("_id", "_source", F.explode(_keys(min_letters)).alias("_k"))
    same = (F.col("_k.h") == F.col("_h")) & (F.col("_k.g") == F.col("_g")) & F.col("_source").eqNullSafe(F.col("_s"))
    return rows.join(F.broadcast(frequent) if small else frequent, same, "left_semi").select("_id", F.col("_k.line_no").alias("line_no"))


def repeated_lines(df: DataFrame, id_col: str = "event_id", source_col: str = "ente", text_col: str = "raw_text", *, min_share: float = 0.05, min_docs: int = 4, min_letters: int = 15) -> DataFrame:
    """(``id_col``, ``line_no`` bigint from 1): the lines of each document that are repeated excessively within its source.

    Lines are split at ``\\n`` and are equal if their letters, lower-cased, are; lines of fewer than ``min_letters`` letters never count.
    A document counts once however often it holds a line. Null and blank texts are no documents: they have no lines and don't enter the
    share. Null is a source of its own. A repeated row is a document of its own but its lines come out once. An empty table gives no rows.
    """
    return _marked(df, id_col, source_col, text_col, min_share, min_docs, min_letters).distinct().withColumnRenamed("_id", id_col)


def without_repeated_lines(df: DataFrame, id_col: str = "event_id", source_col: str = "ente", text_col: str = "raw_text", *, min_share: float = 0.05, min_docs: int = 4, min_letters: int = 15) -> DataFrame:
    """(``id_col``, ``text_col``, ``removed`` bigint): every row's text without the frequent lines of its source.

    The other lines stay as they are, in order. Null and blank texts come out unchanged; a text of frequent lines only becomes empty.
    """
    gone = _marked(df, id_col, source_col, text_col, min_share, min_docs, min_letters).groupBy("_id").agg(F.collect_set("line_no").alias("_gone"))
    base = df.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col))
    kept = F.filter(F.split(F.col(text_col), "\n", -1), lambda _, i: ~F.array_contains(F.col("_gone"), (i + 1).cast("bigint")))
    joined = base.join(gone, base[id_col] == gone["_id"], "left")
    rebuilt = F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return joined.select(base[id_col], rebuilt.alias(text_col), F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias("removed"))
