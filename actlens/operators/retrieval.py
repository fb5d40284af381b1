"""Chunks, inverted index, lexical and vector search, context for answers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actlens.functions import text
from actlens.session import ship, stored


def fixed_chunks(df: DataFrame, id_col: str, text_col: str, size: int = 3000, overlap: int = 300, least: int = 1) -> DataFrame:
    """(id, chunk_no, chunk): windows of ``size`` characters, each beginning ``size - overlap`` after the last; texts below ``least`` have none."""
    step = size - overlap
    t = F.col(text_col)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.length(t) - size) / step).cast("int"), F.lit(0)))
    return df.where(F.length(t) >= least).select(id_col, t.alias("_t"), F.explode(starts).alias("_k")).select(id_col, (F.col("_k") + 1).alias("chunk_no"), F.substring(F.col("_t"), F.col("_k") * step + 1, F.lit(size)).alias("chunk"))


def prefixed(chunk: Column, **fields: Column) -> Column:
    """A chunk after a sentence of its non-null metadata."""
    parts = [F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c)) for name, c in fields.items()]
    return F.concat_ws("\n", F.nullif(F.concat_ws(". ", *parts), F.lit("")), chunk)


def postings(df: DataFrame, id_col: str, text_col: str, block: int = 1_000_000) -> DataFrame:
    """(token, block, df, docs): the documents of every token, ascending, in lists of ``block`` consecutive ids, so that no list outgrows its bound."""
    rows = posting_rows(df, id_col, text_col)
    return rows.groupBy("token", F.floor(F.col(id_col) / block).alias("block")).agg(F.count(F.lit(1)).alias("df"), F.sort_array(F.collect_list(id_col)).alias("docs"))


def posting_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(token, id): one row per token and document; the form in which hot tokens stay spread."""
    return df.select(id_col, F.explode(F.array_distinct(text.tokens(F.col(text_col)))).alias("token"))


def token_ids(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(token, first_doc): every token with the first document that holds it, the order in which ids are given."""
    return posting_rows(df, id_col, text_col).groupBy("token").agg(F.min(id_col).alias("first_doc"))


def lexical_top(df: DataFrame, id_col: str, text_col: str, queries: Sequence[tuple[int, str]], k: int = 6) -> DataFrame:
    """(query_id, id, score): for each query the k documents that share most distinct tokens with it, ties by id. Filters belong on ``df``."""
    spark = df.sparkSession
    q = spark.createDataFrame(list(queries), "query_id int, query string")
    wanted = q.select("query_id", F.explode(F.array_distinct(text.tokens(F.col("query")))).alias("token"))
    hits = posting_rows(df, id_col, text_col).join(F.broadcast(wanted), "token").groupBy("query_id", id_col).agg(F.count(F.lit(1)).alias("score"))  # the queries are given by the caller
    return _best(hits, "query_id", F.desc("score"), id_col, k)


def _best(rows: DataFrame, group: str, order: Column, tie: str, k: int) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(order, F.asc(tie))  # Spark keeps k rows per task before the shuffle
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


#: Probes compared with the vectors at a time, and blocks of them sent to every executor at once; more are met by a join on the block's number.
PROBE_BLOCK, SENT_BLOCKS = 512, 16


def vector_top(base: DataFrame, probes: DataFrame, id_col: str, vector: str, k: int = 6) -> DataFrame:
    """(query_id, id, distance): the k nearest vectors of each probe. ``probes`` (query_id, probe) meet the vectors in blocks: a batch of vectors and a block are
    scored by one matrix product, of which each probe keeps its k best before anything is shuffled. Null vectors are near nothing; vectors have one length."""
    n = probes.count()
    cut = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // PROBE_BLOCK))))
    blocks = probes.where(F.col("probe").isNotNull()).groupBy(cut.alias("_block")).agg(F.collect_list(F.struct("query_id", F.col("probe").cast("array<double>").alias("probe"))).alias("_probes"))
    few = n <= PROBE_BLOCK * SENT_BLOCKS
    ids = base.schema[id_col].dataType.simpleString()
    asked = probes.schema["query_id"].dataType.simpleString()
    rows = base.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("_id"), F.col(vector).cast("array<double>").alias("_v"))
    ship(base.sparkSession)

    def score(batches: Iterator[pd.DataFrame], names: list, q: np.ndarray) -> Iterator[pd.DataFrame]:
        norms = (q * q).sum(axis=1)
        for batch in batches:
            x = np.stack(batch["_v"].to_numpy())
            d = np.maximum(norms[:, None] + (x * x).sum(axis=1)[None, :] - 2 * q @ x.T, 0)
            # the product finds the best; their distances are computed exactly
            m = min(k + 4, d.shape[1])
            best = np.argpartition(d, m - 1, axis=1)[:, :m]
            exact = ((x[best] - q[:, None, :]) ** 2).sum(axis=2)
            order = np.lexsort((batch["_id"].to_numpy()[best], exact), axis=1)[:, :k]
            best, exact = np.take_along_axis(best, order, 1), np.take_along_axis(exact, order, 1)
            yield pd.DataFrame({"query_id": np.repeat(np.array(names), best.shape[1]), id_col: batch["_id"].to_numpy()[best.ravel()], "distance": exact.ravel()})

    schema = f"query_id {asked}, {id_col} {ids}, distance double"
    if few:
        held = [(p["query_id"], p["probe"]) for r in blocks.collect() for p in r["_probes"]]
        if not held:
            return base.sparkSession.createDataFrame([], schema)
        names, q = [h[0] for h in held], np.array([h[1] for h in held], float)
        sent = base.sparkSession.sparkContext.broadcast((names, q))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, q = sent.value
            for batch in batches:
                for a in range(0, len(names), PROBE_BLOCK):
                    yield from score(iter([batch]), names[a : a + PROBE_BLOCK], q[a : a + PROBE_BLOCK])

        found = rows.mapInPandas(search, schema)
    else:
        chunks = rows.withColumn("_chunk", F.pmod(F.xxhash64("_id"), F.lit(max(1, rows.count() // 8192)))).groupBy("_chunk").agg(F.collect_list(F.struct("_id", "_v")).alias("_rows"))

        def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for own, asked_ in zip(batch["_rows"], batch["_probes"], strict=True):
                    frame = pd.DataFrame({"_id": [r["_id"] for r in own], "_v": [np.asarray(r["_v"]) for r in own]})
                    yield from score(iter([frame]), [p["query_id"] for p in asked_], np.array([p["probe"] for p in asked_], float))

        found = chunks.crossJoin(blocks).select("_rows", "_probes").mapInPandas(meet, schema)  # a stated query set against all rows, in blocks
    return _best(found.withColumn("distance", F.round("distance", 6)), "query_id", F.asc("distance"), id_col, k)


def context(rows: DataFrame, group: str, order: str, source: Column, snippet: Column, longest: int = 320) -> DataFrame:
    """(group, context): numbered sources with shortened snippets, for an answer to quote."""
    line = F.concat(F.lit("[Fonte: "), source, F.lit("] "), text.shorten(text.collapse(snippet), longest))
    gathered = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, line.alias("l")))).alias("_x"))
    return gathered.select(group, F.array_join(F.transform("_x", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["l"])), "\n").alias("context"))


#: Tokens up to which their counts are sent to every executor; beyond it a token of most documents is split where the join is skewed.
SENT_TOKENS = 500_000


def tfidf(df: DataFrame, id_col: str, text_col: str, least_df: int = 2, most_share: float = 0.8) -> DataFrame:
    """(id, token, tfidf) with tf * ln(N / df), for tokens of at least ``least_df`` and at most ``most_share`` of the documents."""
    tf = df.select(id_col, F.explode(text.tokens(F.col(text_col))).alias("token")).groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("tf"))
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    tf = stored(tf)  # read twice
    docs = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).where((F.col("df") >= least_df) & (F.col("df") <= F.col("_n") * most_share))  # one row
    return tf.join(F.broadcast(docs) if docs.count() <= SENT_TOKENS else docs, "token").select(id_col, "token", F.round(F.col("tf") * F.log(F.col("_n") / F.col("df")), 6).alias("tfidf"))


def manifest(df: DataFrame, name: str, content: str) -> DataFrame:
    return df.select(F.col(name).cast("string").alias("name"), F.length(content).alias("size"), F.sha2(content, 256).alias("sha256"))


def trusted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows by which two manifests differ; an index is trusted if there are none."""
    return old.exceptAll(new).withColumn("side", F.lit("old")).unionByName(new.exceptAll(old).withColumn("side", F.lit("new")))
