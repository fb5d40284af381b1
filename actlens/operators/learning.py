"""The feedback loop: TF-IDF features, a balanced random forest, relabelling of ambiguous rows."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, IndexToString, NGram, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight``: rows of every class weigh the same in sum."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return df.join(counts.crossJoin(F.broadcast(total)), label).withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")  # one row of totals


def train(df: DataFrame, text_col: str, label: str, *, features: int = 2000, trees: int = 40, seed: int = 42) -> PipelineModel:
    vector = lambda source, out: CountVectorizer(inputCol=source, outputCol=out, vocabSize=features, minDF=2.0, maxDF=0.8)
    names = sorted(r[0] for r in df.select(label).distinct().limit(1000).collect())
    stages = [
        RegexTokenizer(inputCol=text_col, outputCol="_w", pattern=r"[^\p{L}\p{N}]+"),
        NGram(n=2, inputCol="_w", outputCol="_b"),
        vector("_w", "_cw"),
        vector("_b", "_cb"),
        VectorAssembler(inputCols=["_cw", "_cb"], outputCol="_c"),
        IDF(inputCol="_c", outputCol="features"),
        RandomForestClassifier(featuresCol="features", labelCol="_y", weightCol="weight", numTrees=trees, maxDepth=8, seed=seed),
        IndexToString(inputCol="prediction", outputCol="predicted", labels=names),
    ]
    indexed = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(df).transform(df)
    return Pipeline(stages=stages).fit(balanced(indexed, label))


def relabel(df: DataFrame, model: PipelineModel, label: str, confidence: str, least: float = 0.5) -> DataFrame:
    """Null and ambiguous labels replaced where the model is sure enough; their confidence becomes ``ml_predicted``."""
    scored = model.transform(df).withColumn("_p", F.array_max(vector_to_array("probability")))
    sure = (F.col(label).isNull() | (F.col(confidence) == "ambiguous")) & (F.col("_p") >= least)
    return scored.withColumn(label, F.when(sure, F.col("predicted")).otherwise(F.col(label))).withColumn(confidence, F.when(sure, "ml_predicted").otherwise(F.col(confidence))).select(*df.columns, F.round("_p", 6).alias("probability"))


def report(scored: DataFrame, label: str, predicted: str) -> DataFrame:
    """(class, support, precision, recall, f1)."""
    hits = scored.groupBy(F.col(label).alias("y"), F.col(predicted).alias("z")).agg(F.count(F.lit(1)).alias("n"))
    tp = hits.where("y = z").select(F.col("y").alias("class"), F.col("n").alias("tp"))
    real, said = hits.groupBy(F.col("y").alias("class")).agg(F.sum("n").alias("support")), hits.groupBy(F.col("z").alias("class")).agg(F.sum("n").alias("said"))
    rows = real.join(said, "class", "left").join(tp, "class", "left").fillna(0)
    p, r = F.try_divide("tp", "said"), F.try_divide("tp", "support")
    return rows.select("class", "support", F.round(F.coalesce(p, F.lit(0.0)), 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 4).alias("f1"))

