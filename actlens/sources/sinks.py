"""Sinks and the readers that take their output back. Every sink writes in parallel; what must be one small document is put together on the driver
from rows whose number its operator bounds."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from actlens.operators import retrieval
from actlens.session import file_system


def exists(spark: SparkSession, path: str) -> bool:
    system, folder = file_system(spark, path)
    return system.exists(folder)


def read_sheet(spark: SparkSession, path: str, sheet: str, schema: str) -> DataFrame:
    """One sheet of ``write_sheets``; an empty table where the workbook or the sheet is missing."""
    if not exists(spark, f"{path}/{sheet}"):
        return spark.createDataFrame([], schema)
    return spark.read.csv(f"{path}/{sheet}", header=True, schema=schema, multiLine=True, escape='"')


def write_documents(df: DataFrame, path: str, id_col: str, text_col: str, group: str) -> None:
    """The corpus as JSON lines, and each text as a line of its own under its group, with line ends escaped."""
    df.write.mode("overwrite").json(f"{path}/corpus")
    df.where(F.col(text_col).isNotNull()).select(group, F.to_json(F.struct(id_col, text_col)).alias("value")).write.mode("overwrite").partitionBy(group).text(f"{path}/texts")


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON objects, one a line; nulls kept."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def read_json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path).select(F.from_json("value", schema).alias("x")).select("x.*")


def json_array(rows: DataFrame, most: int = 10_000) -> str:
    """At most ``most`` rows as one JSON array, for reports and hand-labelled sets."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows: write them as JSON lines")
    return "[" + ",".join(r[0] for r in rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()) + "]"


def write_text(spark: SparkSession, content: str, path: str) -> None:
    spark.createDataFrame([(content,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def read_object(spark: SparkSession, path: str) -> dict:
    """A small JSON object (metrics, chat history); empty where the file is missing."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if exists(spark, path) else {}


# --- graphs ------------------------------------------------------------------------------------------------------------------------------


def escaped(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


#: Parts of a graph document in their order.
HEAD, NODES, BETWEEN, EDGES, FOOT = range(5)


def graph_lines(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """(``part``, ``value``): a whole GEXF or GraphML document by lines; ``part`` orders header, nodes, edges and footer."""
    gexf = kind == "gexf"
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<gexf version="1.2"><graph defaultedgetype="directed">' if gexf else '<graphml><graph edgedefault="directed">']
    node = '<node id="%s" label="%s" type="%s"/>' if gexf else '<node id="%s"><data key="label">%s</data><data key="type">%s</data></node>'
    edge = '<edge source="%s" target="%s" label="%s"/>' if gexf else '<edge source="%s" target="%s"><data key="relation">%s</data></edge>'
    spark = nodes.sparkSession
    fixed = [(HEAD, "\n".join(head + ["<nodes>"] * gexf))] + [(BETWEEN, "</nodes><edges>")] * gexf + [(FOOT, ("</edges>" if gexf else "") + f"</graph></{kind}>")]
    line = lambda form, *columns: F.concat(*(x for k, text in enumerate(form.split("%s")) for x in ([columns[k - 1]] if k else []) + [F.lit(text)]))
    text = lambda c: F.coalesce(escaped(F.col(c)), F.lit("null"))
    return (
        spark.createDataFrame(fixed, "part int, value string")
        .unionByName(nodes.select(F.lit(NODES).alias("part"), line(node, text("node_id"), text("label"), text("node_type")).alias("value")))
        .unionByName(edges.select(F.lit(EDGES).alias("part"), line(edge, text("src"), text("dst"), text("relation")).alias("value")))
    )


def write_graph(lines: DataFrame, path: str) -> None:
    """Folders ``part=0``, ``part=1``... whose part files, read in order, are the document. Each part is written by all tasks that make it: no shuffle, no order within."""
    system, folder = file_system(lines.sparkSession, path)
    system.delete(folder, True)
    for part in range(FOOT + 1):
        lines.where(F.col("part") == part).select("value").write.text(f"{path}/part={part}")


def typed_triples(nodes: DataFrame, edges: DataFrame, base: str = "urn:graph:") -> DataFrame:
    """(s, p, o): type, label and edges of a graph as RDF, literals escaped."""
    from actlens.functions.text import turtle_literal
    from actlens.operators.graph import iri

    po = F.array(F.struct(F.lit("rdf:type").alias("p"), F.concat(F.lit("g:"), F.col("node_type")).alias("o")), F.struct(F.lit("rdfs:label").alias("p"), turtle_literal(F.col("label")).alias("o")))
    own = nodes.select(iri(F.col("node_id"), base).alias("s"), F.inline(po))
    return own.unionByName(edges.select(iri(F.col("src"), base).alias("s"), F.concat(F.lit("g:"), F.lower("relation")).alias("p"), iri(F.col("dst"), base).alias("o")))


# --- indexes and models ------------------------------------------------------------------------------------------------------------------


def write_vectors(df: DataFrame, path: str, id_col: str, vector: str) -> None:
    """Vectors and the manifest by which a later reader trusts them."""
    df.select(id_col, vector).write.mode("overwrite").parquet(f"{path}/vectors")
    retrieval.manifest(df.withColumn("_content", F.to_json(vector)), id_col, "_content").write.mode("overwrite").parquet(f"{path}/manifest")


def read_vectors(spark: SparkSession, path: str, source: DataFrame, id_col: str, vector: str) -> DataFrame:
    """The stored vectors if the manifest agrees with ``source``; none otherwise."""
    now = retrieval.manifest(source.withColumn("_content", F.to_json(vector)), id_col, "_content")
    vectors = spark.read.parquet(f"{path}/vectors")
    return vectors if retrieval.trusted(spark.read.parquet(f"{path}/manifest"), now).isEmpty() else vectors.limit(0)


def write_postings(df: DataFrame, path: str, id_col: str, text_col: str) -> None:
    """Vocabulary with ids and postings sorted by token, so that a lookup reads few row groups."""
    retrieval.token_ids(df, id_col, text_col).write.mode("overwrite").parquet(f"{path}/vocabulary")
    retrieval.posting_rows(df, id_col, text_col).repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}/postings")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# --- reports -----------------------------------------------------------------------------------------------------------------------------


def markdown(rows: DataFrame, columns: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """(``line_no``, ``value``): a Markdown table of a small report."""
    from pyspark.sql import Window

    spark = rows.sparkSession
    head = [(-1, "| " + " | ".join(columns) + " |"), (0, "|" + "-|" * len(columns))]
    body = rows.select(F.row_number().over(Window.orderBy(*order)).alias("line_no"), F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |")).alias("value"))
    return spark.createDataFrame(head, "line_no int, value string").unionByName(body)


def tenants(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key): the tenants whose partitions ``path`` holds, from the folders' names alone."""
    system, folder = file_system(spark, path)
    names = [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []
    return spark.createDataFrame([(n.split("=", 1)[1],) for n in names if n.startswith(f"{key}=")], f"{key} string")


def resolve(spark: SparkSession, candidates: Sequence[str]) -> str | None:
    """The first of several places that exists."""
    return next((p for p in candidates if exists(spark, p)), None)


def existing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Those of ``columns`` that ``df`` has, in the order asked."""
    return df.select(*(c for c in columns if c in df.columns))


def summary(metrics: Mapping[str, float]) -> str:
    return json.dumps({"summary": dict(metrics)}, sort_keys=True)
