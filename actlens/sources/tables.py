"""Readers and writers: CSV, JSON lines, JSON arrays with NaN, whole texts, binary files, GEXF graphs, HTML lists, and the adapter data source."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, broken ones come out as nulls."""
    return spark.read.schema(schema).json(path).dropna("all")


def read_json_array(spark: SparkSession, path: str, item: str) -> DataFrame:
    """A file with one JSON array in which NaN stands for null."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r":\s*NaN\b", ": null").alias("j"))
    return whole.select(F.explode(F.from_json("j", f"array<struct<{item}>>")).alias("x")).select("x.*")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(name, text): whole files with line ends collapsed."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.trim(F.regexp_replace("value", r"\s+", " ")).alias("text"))


def read_binary(spark: SparkSession, path: str, glob: str = "*.{pdf,php,p7m}") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def _quoted(name: str) -> Column:
    """An attribute of the tag that ``value`` begins with, in its quotes; empty where the tag has none. Attributes before it are passed whole."""
    return F.regexp_extract("value", rf"""^\w++(?:\s++[^\s=>"']++\s*+=\s*+(?:"[^"]*+"|'[^']*+'))*?\s++{name}\s*+=\s*+("[^"]*+"|'[^']*+')""", 1)


def _unquoted(quoted: str) -> Column:
    """What an attribute says, its entities replaced; null where there is none."""
    text = plain = F.expr(f"substring({quoted}, 2, length({quoted}) - 2)")
    for old, new in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(old), F.lit(new))
    numbered = F.xpath_string(F.concat(F.lit("<a b="), F.col(quoted), F.lit("/>")), F.lit("/a/@b"))
    return F.when(F.contains(quoted, F.lit("&#")), numbered).when(F.contains(quoted, F.lit("&")), plain).when(F.col(quoted) != "", text)


def gexf_elements(spark: SparkSession, path: str) -> DataFrame:
    """(``kind`` node/edge, ``node_id``, ``label``, ``src``, ``dst``) of a GEXF document, also of one in several files. The text is cut before every ``<``, which in XML
    only begins a tag, so that files are split among tasks; a comment or CDATA that holds tags hides them, then whole files are read."""
    cut = spark.read.option("lineSep", "<").text(path).select("value")
    hides = F.col("value").startswith("!--") & ~F.contains("value", F.lit("-->")) | F.col("value").startswith("![CDATA[") & ~F.contains("value", F.lit("]]>"))
    if not cut.where(hides).isEmpty():
        whole = spark.read.text(path, wholetext=True, lineSep=None)
        cut = whole.select(F.explode(F.split(F.regexp_replace("value", r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>", ""), "<")).alias("value"))
    kind = F.substring("value", 1, 4)
    found = cut.select("value", kind.alias("kind")).where(kind.isin("node", "edge") & F.substring("value", 5, 1).isin(*" \t\r\n/>"))
    node = F.col("kind") == "node"
    found = found.select("kind", *(F.when(node, _quoted(mine)).otherwise(_quoted(theirs)).alias(mine) for mine, theirs in (("id", "source"), ("label", "target"))))
    columns = (("node_id", node, "id"), ("label", node, "label"), ("src", ~node, "id"), ("dst", ~node, "label"))
    return found.select("kind", *(F.when(kind, _unquoted(quoted)).alias(name) for name, kind, quoted in columns))


def read_gexf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a GEXF file."""
    found = gexf_elements(spark, path)
    return found.where("kind = 'node'").select("node_id", "label"), found.where("kind = 'edge'").select("src", "dst")


def markdown_schema(text: str) -> dict[str, str]:
    """{column: type} of the first two columns of a Markdown table."""
    rows = [[c.strip(" `") for c in line.strip().strip("|").split("|")] for line in text.splitlines() if line.strip().startswith("|")]
    return {r[0]: r[1].lower() for r in rows[1:] if len(r) > 1 and not set(r[0]) <= set("-: ")}


class _Rows(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.rows: list[dict] = []
        self.cells: list[str] = []
        self.links: list[str] = []
        self.inside = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "tr":
            self.cells, self.links = [], []
        elif tag == "td":
            self.inside = True
            self.cells.append("")
        elif tag == "a":
            self.links += [v for k, v in attrs if k == "href" and v]

    def handle_data(self, data: str) -> None:
        if self.inside:
            self.cells[-1] += data

    def handle_endtag(self, tag: str) -> None:
        if tag == "td":
            self.inside = False
        elif tag == "tr" and self.cells:
            self.rows.append({"cells": [" ".join(c.split()) for c in self.cells], "links": list(dict.fromkeys(self.links))})


def html_rows(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, row_no, cells, links): table rows of HTML pages. Nested markup has no column expression, so pages go through the standard parser in Arrow batches."""
    kind = dict(df.dtypes)[id_col]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, no, cells, links = [], [], [], []
            for k, html in enumerate(b.column(html_col).to_pylist()):
                p = _Rows()
                p.feed(html or "")
                for n, r in enumerate(p.rows, 1):
                    at.append(k)
                    no.append(n)
                    cells.append(r["cells"])
                    links.append(r["links"])
            yield pa.RecordBatch.from_arrays([b.column(id_col).take(pa.array(at, pa.int64())), pa.array(no, pa.int64()), pa.array(cells, pa.list_(pa.string())), pa.array(links, pa.list_(pa.string()))], names=[id_col, "row_no", "cells", "links"])

    return df.select(id_col, html_col).mapInArrow(parse, f"{id_col} {kind}, row_no bigint, cells array<string>, links array<string>")


def list_items(rows: DataFrame, id_col: str) -> DataFrame:
    """Notices of a list page: the longest cell is the subject; number, date and kind by their forms; the first link is the detail page."""
    joined = F.array_join("cells", " | ")
    longest = F.element_at(F.array_sort(F.transform("cells", lambda c: F.struct((-F.length(c)).alias("n"), c.alias("c")))), 1)["c"]
    return rows.select(
        id_col,
        "row_no",
        longest.alias("subject"),
        F.nullif(F.regexp_extract(joined, r"(\d{2}/\d{2}/\d{4})", 1), F.lit("")).alias("date"),
        F.nullif(F.regexp_extract(joined, r"\b(\d{1,6}/20\d{2})\b", 1), F.lit("")).alias("number"),
        F.try_element_at("links", F.lit(1)).alias("detail"),
        F.slice("links", 2, 1000).alias("attachments"),
    )


class Adapter(DataSource):
    """Python data source of portal records: subclass and override ``records`` to read a portal; ``pages`` become partitions."""

    @classmethod
    def name(cls) -> str:
        return "portal"

    def schema(self) -> str:
        return "source string, external_id string, title string, published_at string, url string, content_hash string"

    def records(self, page: int) -> Iterator[tuple]:
        import hashlib

        size = int(self.options.get("page_size", "10"))
        for k in range(page * size, (page + 1) * size):
            url = f"https://portal.example/doc/{k}"
            yield "portal", str(k), f"Atto {k}", "2024-01-01", url, hashlib.sha256(url.encode()).hexdigest()

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        adapter = self

        class Reader(DataSourceReader):
            def partitions(self) -> list[InputPartition]:
                return [InputPartition(p) for p in range(int(adapter.options.get("pages", "2")))]

            def read(self, partition: InputPartition) -> Iterator[tuple]:
                yield from adapter.records(partition.value)

        return Reader()


def ingest(records: DataFrame) -> DataFrame:
    """Adapter records as notices: time in UTC, first document's name, kind from the metadata's fallbacks."""
    meta = F.col("raw_meta")
    at = lambda k: F.nullif(F.try_element_at(meta, F.lit(k)), F.lit(""))
    return records.select(
        "external_id",
        "source",
        "title",
        F.date_format(F.try_to_timestamp("published_at"), "yyyy-MM-dd'T'HH:mm:ss").alias("published_at"),
        F.coalesce(at("tipologia"), at("tipo"), F.lit("")).alias("tipologia"),
        F.try_element_at("documents", F.lit(1))["filename"].alias("first_file"),
        F.transform("documents", lambda d: F.sha2(d["url"], 256)).alias("hashes"),
    )


# --- sinks -------------------------------------------------------------------------------------------------------------------------------


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """One CSV folder per sheet, instead of a workbook."""
    for name, df in sheets.items():
        df.write.mode("overwrite").csv(f"{path}/{name}", header=True)


def append_unseen(batch: DataFrame, path: str, key: str) -> DataFrame:
    """Appends rows whose key the table at ``path`` doesn't hold, and returns them."""
    from actlens.operators.dedup import unseen
    from actlens.session import stored

    spark = batch.sparkSession
    try:
        history = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        history = batch.limit(0)
    new = stored(unseen(batch, history, key))
    new.write.mode("append").parquet(path)
    return new


def write_lines(df: DataFrame, path: str) -> None:
    """One string column as text files: N-Triples, Turtle, GraphML elements."""
    df.write.mode("overwrite").text(path)
