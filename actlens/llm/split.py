"""Cutting oversized texts at natural boundaries.

Recursive hierarchy: sections, paragraphs, lines, sentences, words, characters. A text is cut into atoms at the coarsest level whose
parts fit, going one level deeper only inside a part that doesn't; atoms are then packed greedily. Every piece but the first begins
with the last ``overlap`` characters of the one before, so neighbours share exactly that many.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlens.session import ship

#: Ends of parts by level, coarsest first: the separator stays with the part before it.
LEVELS = (
    re.compile(r"(?:\r?\n[ \t]*){3,}"),
    re.compile(r"(?:\r?\n[ \t]*){2,}"),
    re.compile(r"\r?\n|\r"),
    re.compile(r"[.;!?:…]+[»\")\]]*\s+"),
    re.compile(r"\s+"),
)


def _atoms(text: str, begin: int, end: int, room: int, level: int) -> Iterator[int]:
    """Ends of the atoms of text[begin:end], none longer than ``room``."""
    if end - begin <= room:
        yield end
        return
    if level == len(LEVELS):
        yield from range(begin + room, end, room)
        yield end
        return
    at = begin
    for m in LEVELS[level].finditer(text, begin, end):
        if m.end() < end and m.end() > at:
            yield from _atoms(text, at, m.end(), room, level + 1)
            at = m.end()
    yield from _atoms(text, at, end, room, level + 1)


def cut_points(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(begin, end) of each piece; the pieces cover the text, none is longer than ``limit``."""
    if len(text) <= limit:
        return [(0, len(text))]
    pieces, begin, last = [], 0, 0
    for end in _atoms(text, 0, len(text), limit - overlap, 0):
        if end - begin > limit:
            pieces.append((begin, last))
            begin = last - overlap if last >= overlap else 0
        last = end
    pieces.append((begin, last))
    return pieces


def split_oversized(df: DataFrame, id_col: str = "event_id", text_col: str = "raw_text", *, limit: int = 3000, overlap: int = 300) -> DataFrame:
    """(``id_col``, ``piece_no`` bigint from 1, ``begin``, ``end`` bigint offsets in code points, ``piece`` string).

    A text up to ``limit`` code points is one piece; longer ones become pieces of at most ``limit``, each sharing its first ``overlap``
    characters with the one before. ``piece`` is exactly text[begin:end]. Null texts have no piece, an empty text one empty piece.
    Repeated rows are cut each for itself. Only oversized rows leave the JVM; columns besides the two named are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where(F.col("_text").isNotNull())
    kind = rows.schema["_id"].dataType.simpleString()
    long = F.length("_text") > limit
    whole = rows.where(~long).select("_id", F.lit(1).cast("bigint").alias("piece_no"), F.lit(0).cast("bigint").alias("begin"), F.length("_text").cast("bigint").alias("end"), F.col("_text").alias("piece"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, text in enumerate(batch.column("_text").to_pylist()):
                out += [(row, n, b, e, text[b:e]) for n, (b, e) in enumerate(cut_points(text, limit, overlap), 1)]
            if out:
                row, number, begin, end, piece = map(list, zip(*out, strict=True))
                columns = [batch.column("_id").take(pa.array(row)), pa.array(number), pa.array(begin), pa.array(end), pa.array(piece)]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "piece_no", "begin", "end", "piece"])

    cut_rows = rows.where(long).mapInArrow(cut, f"_id {kind}, piece_no bigint, begin bigint, end bigint, piece string")
    return whole.unionByName(cut_rows).withColumnRenamed("_id", id_col)
