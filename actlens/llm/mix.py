"""Mixing sources to target weights by nested hash thresholds.

Every document has one 24-bit hash. Tokens are summed by source and the upper 12 bits; the bucket in which a source's budget ends is
summed again by the lower 12 bits. A source's plan is then two numbers, whole repeats and a hash threshold, and the selection is a
filter: no sort of documents, and the choice for a smaller budget is contained in that for a larger one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actlens.llm.tokenize import DEFAULT_TOKENIZER, encode_corpus
from actlens.session import cut_lineage

BITS = 12
SIDE = 1 << BITS


#: Rows of a plan up to which it is sent to the documents; a larger one is joined, split where a source is large.
SENT_ROWS = 50_000


def _sent(plan: DataFrame) -> DataFrame:
    return F.broadcast(plan) if plan.count() <= SENT_ROWS else plan


def _hash24(key: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(9), key), F.lit(SIDE * SIDE)).cast("int")


def _boundary(hist: DataFrame, budget: str, bucket: str) -> DataFrame:
    """Per (mix, source): the bucket in which ``budget`` ends, the tokens before it and those up to its end."""
    w = Window.partitionBy("mix", "source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = hist.withColumn("_upto", F.sum("_tokens").over(w))
    over = F.col("_upto") > F.col(budget)
    return summed.groupBy("mix", "source", budget).agg(
        F.coalesce(F.min(F.when(over, F.col(bucket))), F.lit(SIDE)).alias("_at"),
        F.coalesce(F.max(F.when(~over, F.col("_upto"))), F.lit(0)).alias("_before"),
        F.min(F.when(over, F.col("_upto"))).alias("_through"),
    )


def mix_plan(sized: DataFrame, targets: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(mix, source, target_share, max_repeats, target_tokens, available_tokens, whole, threshold): a document is used ``whole`` times, once more if its hash is below."""
    per_source = sized.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    total = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("_all"))
    wanted = targets.groupBy("mix", "source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"), F.max("size_ratio").alias("size_ratio"))
    wanted = wanted.crossJoin(F.broadcast(total)).join(per_source, "source", "left")  # one row of totals
    wanted = wanted.withColumn("target_tokens", F.col("target_share") * F.col("size_ratio") * F.col("_all")).fillna(0, ["available_tokens"])
    fits = F.when(F.col("available_tokens") > 0, F.floor(F.col("target_tokens") / F.col("available_tokens"))).otherwise(F.lit(0))
    wanted = wanted.withColumn("whole", F.least(fits, F.greatest(F.col("max_repeats"), F.lit(0))).cast("int"))
    rest = F.when(F.col("whole") < F.col("max_repeats"), F.col("target_tokens") - F.col("whole") * F.col("available_tokens")).otherwise(F.lit(0.0))
    wanted = cut_lineage(wanted.withColumn("_rest", rest))
    keyed = sized.select("source", "n_tokens", _hash24(F.col(id_col)).alias("_h"))
    upper = keyed.groupBy("source", F.shiftright("_h", BITS).alias("_bucket")).agg(F.sum("n_tokens").alias("_tokens"))
    need = wanted.where(F.col("_rest") > 0).select("mix", "source", "_rest")
    first = cut_lineage(_boundary(upper.join(_sent(need), "source"), "_rest", "_bucket").withColumn("_left", F.col("_rest") - F.col("_before")))
    edge = first.where(F.col("_at") < SIDE).select("mix", F.col("source").alias("_from"), F.col("_at").alias("_edge"), "_left")
    lower = keyed.join(_sent(edge), (F.col("source") == F.col("_from")) & (F.shiftright("_h", BITS) == F.col("_edge"))).select("mix", "source", "_left", F.col("_h").bitwiseAND(SIDE - 1).alias("_bucket"), "n_tokens")
    lower = lower.groupBy("mix", "source", "_left", "_bucket").agg(F.sum("n_tokens").alias("_tokens"))
    second = _boundary(lower, "_left", "_bucket")
    # the last bucket goes in if that comes closer to the budget
    closer = F.col("_through").isNotNull() & ((F.col("_through") - F.col("_left")) < (F.col("_left") - F.col("_before")))
    second = second.select("mix", "source", (F.col("_at") + closer.cast("int")).alias("_fine"))
    cuts = first.join(second, ["mix", "source"], "left").select("mix", "source", (F.col("_at") * SIDE + F.coalesce("_fine", F.lit(0))).cast("int").alias("threshold"))
    return wanted.join(cuts, ["mix", "source"], "left").select("mix", "source", "target_share", "max_repeats", "target_tokens", "available_tokens", "whole", F.coalesce("threshold", F.lit(0)).alias("threshold"))


def sized_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(``id_col``, n_tokens, source), written once to the shared folder; null and empty texts have 0 tokens."""
    named = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("_body"), F.col(source_col).alias("source"))
    return cut_lineage(encode_corpus(named, id_col, "_body", tokenizer=tokenizer, counts_only=True, keep=("source",)))


def select_mix(sized: DataFrame, plan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(mix, source, ``id_col``, n_tokens, copies) of every document that is used at least once.

    ``plan`` has one row per mix and source. A document never gets more than the source's ``max_repeats`` copies. Documents of a null source
    or one without a target are in no mix; a source without documents simply contributes nothing. Repeated rows of one id get equal copies.
    """
    extra = (_hash24(F.col(id_col)) < F.col("threshold")).cast("int")
    joined = sized.join(_sent(plan.select("mix", "source", "whole", "threshold")), "source").withColumn("copies", F.col("whole") + extra)
    return joined.where(F.col("copies") > 0).select("mix", "source", id_col, "n_tokens", "copies")


def mix_report(selected: DataFrame, plan: DataFrame) -> DataFrame:
    """Per mix and source: target and reached tokens and shares, documents used and their largest number of copies."""
    got = selected.groupBy("mix", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("reached_tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    rows = plan.join(got, ["mix", "source"], "left").fillna(0, ["reached_tokens", "documents", "most_copies"])
    whole = F.sum("reached_tokens").over(Window.partitionBy("mix"))
    share = F.when(whole > 0, F.col("reached_tokens") / whole).otherwise(F.lit(0.0))
    return rows.select("mix", "source", "target_share", share.alias("reached_share"), "target_tokens", "reached_tokens", "available_tokens", "documents", "most_copies", "max_repeats")
