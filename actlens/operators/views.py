"""Acts and attachments as views over the order tables: one act per order, one attachment per order line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actlens.session import table

ACTS_SQL = """
acts as (
  select o_orderkey, cast(o_orderkey as varchar) as atto_group, cast(o_orderdate as date) as data_parsed,
         cast(round(o_totalprice, 2) as decimal(18,2)) as importo, c_name as beneficiario, n_name as responsabile,
         case o_orderpriority when '1-URGENT' then 'affidamento diretto' when '2-HIGH' then 'procedura negoziata' end as tipo_procedura,
         case o_orderstatus when 'F' then 'Contabilità' when 'O' then 'Lavori Pubblici' else 'Personale' end as category,
         case when o_orderkey % 10 = 0 then null when o_orderkey % 10 = 1 then '0000000000' else 'Z' || lpad(cast(o_orderkey as varchar), 9, '0') end as cig
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)
"""

ATTACHMENTS_SQL = """
attachments as (
  select l_orderkey as act, cast(l_orderkey as varchar) || '_' || cast(row_number() over w as varchar) || '.pdf' as pdf_name, row_number() over w as seq,
         case l_returnflag when 'A' then 'VistoContabile' when 'R' then 'Determinazione' else 'Delibera' end as doc_type,
         cast(round(l_extendedprice, 2) as decimal(18,2)) as importo, l_partkey as capitolo, s_name as beneficiario, l_linestatus as source,
         l_quantity > 25 as is_signed, l_discount > 0.05 as accounting_relevant, cast(l_quantity as int) as veracity
  from lineitem join supplier on l_suppkey = s_suppkey
  window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice))
"""


def acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    key = F.col("o_orderkey")
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(nation, customer["c_nationkey"] == nation["n_nationkey"])
    return joined.select(
        key,
        key.cast("string").alias("atto_group"),
        F.col("o_orderdate").cast("date").alias("data_parsed"),
        F.round("o_totalprice", 2).cast("decimal(18,2)").alias("importo"),
        F.col("c_name").alias("beneficiario"),
        F.col("n_name").alias("responsabile"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "affidamento diretto").when(F.col("o_orderpriority") == "2-HIGH", "procedura negoziata").alias("tipo_procedura"),
        F.when(F.col("o_orderstatus") == "F", "Contabilità").when(F.col("o_orderstatus") == "O", "Lavori Pubblici").otherwise("Personale").alias("category"),
        F.when(key % 10 == 0, None).when(key % 10 == 1, "0000000000").otherwise(F.concat(F.lit("Z"), F.lpad(key.cast("string"), 9, "0"))).alias("cig"),
    )


def line_order() -> list[Column]:
    return [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*line_order()))
    return (
        lines.join(supplier, lines["l_suppkey"] == supplier["s_suppkey"])
        .withColumn("seq", seq)
        .select(
            F.col("l_orderkey").alias("act"),
            F.concat(F.col("l_orderkey").cast("string"), F.lit("_"), F.col("seq").cast("string"), F.lit(".pdf")).alias("pdf_name"),
            F.col("seq").cast("bigint").alias("seq"),
            F.when(F.col("l_returnflag") == "A", "VistoContabile").when(F.col("l_returnflag") == "R", "Determinazione").otherwise("Delibera").alias("doc_type"),
            F.round("l_extendedprice", 2).cast("decimal(18,2)").alias("importo"),
            F.col("l_partkey").alias("capitolo"),
            F.col("s_name").alias("beneficiario"),
            F.col("l_linestatus").alias("source"),
            (F.col("l_quantity") > 25).alias("is_signed"),
            (F.col("l_discount") > 0.05).alias("accounting_relevant"),
            F.col("l_quantity").cast("int").alias("veracity"),
        )
    )
