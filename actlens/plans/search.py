"""Retrieval, learning, sources and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actlens.functions.register import register_functions, register_tables
from actlens.operators import learning, retrieval
from actlens.plans.registry import query
from actlens.session import scratch, shared_dir, ship, table
from actlens.sources import tables
from actlens.streaming import notices as stream

QUERIES = [(1, "affidamento del servizio di manutenzione straordinaria"), (2, "liquidazione fattura al fornitore di arredi"), (3, "chiusura della strada vicinale")]
_Q = ", ".join(f"({i}, '{q}')" for i, q in QUERIES)


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null and text <> ''")


@query("select doc_id, cast(k + 1 as int) as chunk_no, substring(text, k * 900 + 1, 1000) as chunk from (select doc_id, text, unnest(range(0, greatest(cast(ceil((length(text) - 1000) / 900.0) as int), 0) + 1)) as k from documents where length(text) >= 50)")
def chunk_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.fixed_chunks(_documents(spark, sf), "doc_id", "text", 1000, 100, 50)


@query("select doc_id, concat_ws(chr(10), nullif(concat_ws('. ', 'Oggetto: ' || doc_type, 'Fonte: ' || source), ''), text) as page from documents where length(text) >= 50")
def corpus_chunks(spark: SparkSession, sf: str) -> DataFrame:
    page = retrieval.prefixed(F.col("text"), Oggetto=F.col("doc_type"), Fonte=F.col("source"))
    return _documents(spark, sf).where(F.length("text") >= 50).select("doc_id", page.alias("page"))


_TOKENS = r"select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) as token from documents where text is not null and text <> ''"


@query(f"select token, doc_id // 1000000 as block, count(*) as df, list_sort(list(doc_id)) as docs from ({_TOKENS}) group by 1, 2")
def inverted_index(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.postings(_documents(spark, sf), "doc_id", "text")


@query(f"select token, doc_id from ({_TOKENS}) where token in ('fattura', 'capitolo', 'assente')")
def postings_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.posting_rows(_documents(spark, sf), "doc_id", "text").where(F.col("token").isin("fattura", "capitolo", "assente")).select("token", "doc_id")


@query(f"select token, min(doc_id) as first_doc from ({_TOKENS}) group by 1")
def token_interning(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.token_ids(_documents(spark, sf), "doc_id", "text")


_LEX = f"""with q as (select query_id, unnest(list_distinct(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+'))) as token from (values {_Q}) v(query_id, query)),
  h as (select query_id, doc_id, count(*) as score from ({_TOKENS}) t join q using (token) group by 1, 2), r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as r from h)"""


@query(_LEX + " select query_id, doc_id, score from r where r <= 6")
def lexical_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.lexical_top(_documents(spark, sf), "doc_id", "text", QUERIES, 6)


@query(
    _LEX
    + r""", x as (select query_id, r, '[Fonte: ' || source || '] ' || case when length(s) > 320 then substring(s, 1, 320) || '...' else s end as l
      from (select query_id, r, source, trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')) as s from r join documents using (doc_id) where r <= 3))
    select query_id, string_agg(cast(n as varchar) || '. ' || l, chr(10) order by n) as context from (select query_id, l, row_number() over (partition by query_id order by r) as n from x) group by 1"""
)
def extractive_context(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    top = retrieval.lexical_top(docs, "doc_id", "text", QUERIES, 3).join(docs.select("doc_id", "source", "text"), "doc_id")
    return retrieval.context(top.withColumn("_o", F.struct((-F.col("score")).alias("s"), F.col("doc_id").alias("d"))), "query_id", "_o", F.col("source"), F.col("text"))


_VEC = """with d as (select q.vec_id as query_id, b.vec_id as vec_id, b.label as label, q.label as q_label,
  round(list_sum(list_transform(list_zip(b.embedding, q.embedding), lambda p: (cast(p[1] as double) - cast(p[2] as double)) * (cast(p[1] as double) - cast(p[2] as double)))), 6) as distance from embeddings b, embeddings q where q.vec_id % 100 = 0)"""


def _probes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("probe"))


@query(_VEC + " select query_id, vec_id, distance from (select *, row_number() over (partition by query_id order by distance, vec_id) as r from d) where r <= 6")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.vector_top(table(spark, sf, "embeddings"), _probes(spark, sf), "vec_id", "embedding", 6)


@query(_VEC + " select query_id, vec_id, distance from (select *, row_number() over (partition by query_id order by distance, vec_id) as r from d where label in (1, 2, 3)) where r <= 6")
def vector_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.vector_top(table(spark, sf, "embeddings").where("label in (1, 2, 3)"), _probes(spark, sf), "vec_id", "embedding", 6)


@query(
    r"""with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as token from documents where text is not null and text <> ''), tf as (select doc_id, token, count(*) as tf from t group by 1, 2),
    n as (select count(*) as n from documents where text is not null and text <> ''), df as (select token, count(*) as df from tf group by 1)
    select doc_id, token, round(tf * ln(n / df), 6) as tfidf from tf join df using (token), n where df >= 2 and df <= n * 0.8"""
)
def tfidf_terms(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.tfidf(_documents(spark, sf), "doc_id", "text", 2, 0.8)


@query("select cast(doc_id as varchar) as name, length(text) as size, sha256(text) as sha256, 'old' as side from documents where text is not null and text <> '' and lang is null")
def index_trust(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    return retrieval.trusted(retrieval.manifest(docs, "doc_id", "text"), retrieval.manifest(docs.where("lang is not null"), "doc_id", "text"))


@query()
def rf_feedback_loop(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of documents learned from labelled ones and given to the others."""
    docs = _documents(spark, sf).select("doc_id", "text", F.col("doc_type").alias("category"), F.when(F.col("doc_type").isNull(), "ambiguous").otherwise("high").alias("confidence"))
    model = learning.train(docs.where("category is not null"), "text", "category", features=500, trees=20)
    return learning.relabel(docs, model, "category", "confidence", 0.2).select("doc_id", "category", "confidence", "probability")


@query(
    """select notice_id, cast(1 as bigint) as row_no, trim(regexp_replace(oggetto, '\\s+', ' ', 'g')) as subject, case when data_pubblicazione like '__/__/____' then data_pubblicazione end as date, dettaglio_url as detail, allegati as attachments
    from notices where length(trim(oggetto)) > 40 and dettaglio_url is not null and allegati is not null and not regexp_matches(oggetto, '[<>&|]|\\d{2}/\\d{2}/\\d{4}') and len(list_distinct(list_append(allegati, dettaglio_url))) = len(allegati) + 1"""
)
def html_list_page(spark: SparkSession, sf: str) -> DataFrame:
    """Notices rendered as list pages and parsed back."""
    n = table(spark, sf, "notices").where("length(trim(oggetto)) > 40 and dettaglio_url is not null and allegati is not null and size(array_distinct(array_append(allegati, dettaglio_url))) = size(allegati) + 1")
    n = n.where(~F.col("oggetto").rlike(r"[<>&|]|\d{2}/\d{2}/\d{4}"))
    escape = lambda c: F.replace(c, F.lit("&"), F.lit("&amp;"))
    links = F.array_join(F.transform("allegati", lambda a: F.concat(F.lit('<a href="'), escape(a), F.lit('">file</a>'))), " ")
    html = F.concat(F.lit("<table><tr><td>"), F.coalesce("data_pubblicazione", F.lit("")), F.lit('</td><td><a href="'), escape(F.col("dettaglio_url")), F.lit('"><b>'), F.col("oggetto"), F.lit("</b></a></td><td>"), links, F.lit("</td></tr></table>"))
    rows = tables.html_rows(n.select("notice_id", html.alias("html")), "notice_id", "html")
    return tables.list_items(rows, "notice_id").select("notice_id", "row_no", "subject", "date", "detail", "attachments")


@query("select 'portal' as source, cast(k as varchar) as external_id, 'Atto ' || k as title, sha256('https://portal.example/doc/' || k) as content_hash from range(0, 60) t(k)")
def adapter_source(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(tables.Adapter)
    return spark.read.format("portal").option("pages", "3").option("page_size", "20").load().select("source", "external_id", "title", "content_hash")


@query("select notice_id, titolo, numero, oggetto from notices")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark)
    table(spark, sf, "notices").select("notice_id", "titolo", "numero", "oggetto").write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=True, nullValue="\\N", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return spark.read.csv(path, header=True, schema="notice_id bigint, titolo string, numero string, oggetto string", multiLine=True, escape='"', nullValue="\\N", emptyValue="")


@query("select doc_id, source, text from documents")
def jsonl_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark)
    table(spark, sf, "documents").select("doc_id", "source", "text").write.mode("overwrite").json(path)
    return tables.read_jsonl(spark, path, "doc_id bigint, source string, text string")


@query("select date_trunc('hour', ts) as hour, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Event windows by a stream over the events' file, run to its end."""
    from uuid import uuid4

    source = table(spark, sf, "events")
    base = f"{shared_dir(spark)}/stream-{uuid4().hex}"
    source.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{base}/in")
    schema = spark.read.parquet(f"{base}/in").schema
    name = f"hourly_{uuid4().hex}"
    q = stream.hourly(spark.readStream.schema(schema).parquet(f"{base}/in"), "ts").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("select notice_id from (select notice_id, row_number() over (partition by notice_id order by crawled_at) as r from notices) where r = 1")
def stream_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """Batches delivered as files and read once by a stream without repeats."""
    from uuid import uuid4

    base = f"{shared_dir(spark)}/arrivals-{uuid4().hex}"
    n = table(spark, sf, "notices").select("notice_id", F.col("crawled_at").cast("timestamp").alias("crawled_at"))
    n.write.parquet(f"{base}/in")
    n.write.mode("append").parquet(f"{base}/in")
    schema = spark.read.parquet(f"{base}/in").schema
    stream.run_once(stream.arrivals(spark, f"{base}/in", schema, time="crawled_at", key="notice_id", late="3650 days"), f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out").select("notice_id")


@query("select l_quantity as q, count(*) as n from lineitem group by 1")
def number_words(spark: SparkSession, sf: str) -> DataFrame:
    """Quantities spelled out in Italian and read back by the SQL function."""
    ship(spark)
    register_functions(spark)
    units = "uno due tre quattro cinque sei sette otto nove dieci undici dodici tredici quattordici quindici sedici diciassette diciotto diciannove".split()
    tens = ["venti", "trenta", "quaranta", "cinquanta"]
    spelled = [u for u in units] + [t if u == 0 else (t[:-1] if u in (1, 8) else t) + units[u - 1] for t in tens for u in range(10)]
    word = F.element_at(F.array(*map(F.lit, spelled)), F.col("l_quantity").cast("int"))
    counted = table(spark, sf, "lineitem").groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n"), F.first(word).alias("w"))
    return counted.select(F.expr("words_to_number_it(w)").alias("q"), "n")


@query("select doc_id, cast(k + 1 as int) as chunk_no, substring(text, k * 900 + 1, 1000) as chunk from (select doc_id, text, unnest(range(0, greatest(cast(ceil((length(text) - 1000) / 900.0) as int), 0) + 1)) as k from documents where length(text) > 0)")
def table_function(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    register_tables(spark)
    _documents(spark, sf).createOrReplaceTempView("_reviewed")
    return spark.sql("select doc_id, c.chunk_no, c.chunk from _reviewed, lateral windows_of(text, 1000, 100) c")
