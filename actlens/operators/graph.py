"""The knowledge graph of acts as tables of nodes and edges, its metrics and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actlens.session import stored

SENTINELS = ("NON IDENTIFICATO", "DIVERSI/NON APPLICABILE")


def _id(prefix: str, c: Column) -> Column:
    clean = F.nullif(F.trim(c), F.lit(""))
    return F.when(~clean.isin(*SENTINELS), F.concat(F.lit(f"{prefix}:"), clean))


def edges(acts: DataFrame) -> DataFrame:
    """Multi-edges of acts (atto_group, responsabile, beneficiario, cig, capitolo, doc_type, importo): officer-act, act-payee, act-CIG, act-chapter."""
    act = _id("ATTO", F.col("atto_group"))
    pays = F.when(F.col("doc_type").isin("Determinazione", "VistoContabile"), "LIQUIDA").otherwise("AFFIDA")
    none = F.lit(None).cast("decimal(18,2)")
    edge = lambda src, dst, relation, amount=none: F.struct(src.alias("src"), dst.alias("dst"), relation.alias("relation"), amount.cast("decimal(18,2)").alias("amount"))
    made = F.array(
        edge(_id("RUP", F.col("responsabile")), act, F.lit("FIRMA_O_GESTISCE")),
        edge(act, _id("BEN", F.col("beneficiario")), pays, F.col("importo")),
        edge(act, _id("CIG", F.upper("cig")), F.lit("RIFERISCE_A")),
        edge(act, _id("CAP", F.col("capitolo").cast("string")), F.lit("GRAVA_SU")),
    )
    return acts.select(F.inline(made)).where(F.col("src").isNotNull() & F.col("dst").isNotNull())


def nodes(edge_rows: DataFrame) -> DataFrame:
    """(node_id, node_type, label): one row per node of the edges."""
    ids = edge_rows.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return ids.select("node_id", F.split_part("node_id", F.lit(":"), F.lit(1)).alias("node_type"), F.regexp_replace("node_id", "^[A-Z]+:", "").alias("label"))


def merged_nodes(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Nodes of one id collapse; of each attribute the last non-null value wins."""
    return rows.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns))


def simple(edge_rows: DataFrame) -> DataFrame:
    return edge_rows.select("src", "dst").distinct()


def centrality(edge_rows: DataFrame) -> DataFrame:
    """(node_id, in_degree, out_degree, in_centrality, out_centrality, centrality) of the simple graph; degrees over n - 1."""
    e = simple(edge_rows)
    ends = e.select(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(e.select("dst", F.lit(0), F.lit(1)))
    degree = stored(ends.groupBy("node_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree")))  # read twice
    n = degree.agg((F.count(F.lit(1)) - 1).alias("_n"))
    share = lambda c: F.when(F.col("_n") > 0, F.round(c / F.col("_n"), 9)).otherwise(0.0)
    i, o = F.col("in_degree"), F.col("out_degree")
    return degree.crossJoin(F.broadcast(n)).select("node_id", "in_degree", "out_degree", share(i).alias("in_centrality"), share(o).alias("out_centrality"), share(i + o).alias("centrality"))  # one row


def ego(edge_rows: DataFrame, start: str) -> DataFrame:
    """Edges among a node, its successors within two hops, its predecessors and their neighbours."""
    e = stored(simple(edge_rows))  # read for each hop
    one = e.where(F.col("src") == start).select(F.col("dst").alias("n"))
    two = e.join(one, e["src"] == one["n"]).select(F.col("dst").alias("n"))
    back = e.where(F.col("dst") == start).select(F.col("src").alias("n"))
    around = e.join(back, e["src"] == back["n"]).union(e.join(back, e["dst"] == back["n"])).select(F.explode(F.array("src", "dst")).alias("n"))
    members = one.union(two).union(back).union(around).union(e.sparkSession.createDataFrame([(start,)], "n string")).distinct()
    return e.join(members.withColumnRenamed("n", "src"), "src", "left_semi").join(members.withColumnRenamed("n", "dst"), "dst", "left_semi").select("src", "dst")


def entities(names: DataFrame, kind: str, name: str, order: str, key: Column) -> DataFrame:
    """(entity_id, key, canonical, aliases): spellings that share a key; an entity is named by the order of its first appearance."""
    grouped = names.withColumn("_key", key).groupBy("_key").agg(F.min(order).alias("_first"), F.min_by(name, order).alias("canonical"), F.array_join(F.array_sort(F.collect_set(name)), "|").alias("aliases"))
    return grouped.select(F.concat(F.lit(f"{kind}_"), F.col("_first").cast("string")).alias("entity_id"), F.col("_key").alias("key"), "canonical", "aliases")


# --- exports ---------------------------------------------------------------------------------------------------------------------------


def iri(c: Column, base: str) -> Column:
    return F.concat(F.lit(f"<{base}"), F.regexp_replace(c, r"[^\p{L}\p{N}:_-]", "_"), F.lit(">"))


def triples(acts: DataFrame, base: str = "urn:acts:") -> DataFrame:
    """(s, p, o): document, identifier, date, amount, officer and payee of each act as RDF."""
    s = iri(F.concat(F.lit("atto/"), F.col("atto_group")), base)
    lit = lambda c, kind: F.concat(F.lit('"'), c, F.lit(f'"^^xsd:{kind}'))
    po = F.array(
        F.struct(F.lit("rdf:type").alias("p"), F.lit("foaf:Document").alias("o")),
        F.struct(F.lit("dct:identifier").alias("p"), lit(F.col("atto_group"), "string").alias("o")),
        F.struct(F.lit("dct:date").alias("p"), lit(F.date_format("data_parsed", "yyyy-MM-dd"), "date").alias("o")),
        F.struct(F.lit("pc:price").alias("p"), lit(F.col("importo").cast("string"), "decimal").alias("o")),
        F.struct(F.lit("dct:creator").alias("p"), iri(F.concat(F.lit("rup/"), F.col("responsabile")), base).alias("o")),
        F.struct(F.lit("pc:supplier").alias("p"), iri(F.concat(F.lit("ben/"), F.col("beneficiario")), base).alias("o")),
        F.struct(F.lit("pc:cig").alias("p"), lit(F.col("cig"), "string").alias("o")),
    )
    return acts.select(s.alias("s"), F.explode(po).alias("t")).select("s", F.col("t.p").alias("p"), F.col("t.o").alias("o")).where(F.col("o").isNotNull())


def ntriples(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value"))


def graphml_lines(edge_rows: DataFrame) -> DataFrame:
    """Edge elements; a sink writes them between header and footer."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    return edge_rows.select(F.format_string('<edge source="%s" target="%s"><data key="relation">%s</data></edge>', esc(F.col("src")), esc(F.col("dst")), F.col("relation")).alias("value"))
