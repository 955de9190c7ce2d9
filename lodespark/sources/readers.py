"""Readers: delimited text, quoted transactions, JSON lines, points, whole files, HTML, watch-lists."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def csv_table(spark: SparkSession, path: str, schema: str | StructType, header: bool = True) -> DataFrame:
    """CSV with a header and a given schema; unparseable values are null."""
    return spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE").csv(path)


def csv_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV whose header may stand anywhere: every line equal to the first column names is dropped; unparseable values are null."""
    lines = spark.read.text(path)
    names = spark.createDataFrame([], schema).columns
    wanted = [",".join(names), ", ".join(names), ",".join(f'"{n}"' for n in names)]
    return lines.where(~F.col("value").isin(wanted)).select(F.from_csv("value", schema).alias("r")).select("r.*")


def by_keys(df: DataFrame, key: str, values: list) -> DataFrame:
    """The rows of some keys, as a filter that reaches the scan (or the database, for a JDBC table)."""
    return df.where(F.col(key).isin(values))


def jdbc_table(spark: SparkSession, url: str, name: str, split_by: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A database table, read in ``parts`` ranges of ``split_by`` where given; filters and columns are pushed down."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if split_by:
        r = r.option("partitionColumn", split_by).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return r.load()


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(file, bytes, content)`` of the files of a folder and all folders in it whose name fits ``pattern``."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return d.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), "content")


def pages(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, page_no, page)``: the pages of extracted text, form feeds between them; blank pages are counted and left out."""
    p = texts.select(key, F.posexplode(F.split(text, "\f")).alias("at", "page"))
    return p.where(F.trim("page") != "").select(key, (F.col("at") + 1).alias("page_no"), "page")


def transactions(spark: SparkSession, path: str) -> DataFrame:
    """``(basket, item)`` of quoted transactions: basket is date-customer, item the whole product number.

    Fields 0, 1 and 5 of rows of six and more; shorter rows and products that are no number are dropped.
    """
    lines = spark.read.option("header", False).option("quote", '"').option("ignoreLeadingWhiteSpace", True).text(path)
    f = lines.select(F.transform(F.split("value", ","), lambda x: F.trim(F.replace(x, F.lit('"')))).alias("f")).where("size(f) >= 6")
    row = f.select(F.concat_ws("-", F.col("f")[0], F.col("f")[1]).alias("basket"), F.col("f")[5].try_cast("double").cast("bigint").alias("item"))
    return row.where("item is not null").select("basket", F.col("item").cast("string").alias("item"))


def json_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines with a given schema (no inference pass)."""
    return spark.read.schema(schema).json(path)


def optional(spark: SparkSession, path: str, schema: str, fmt: str = "json") -> DataFrame:
    """The source, or an empty table of its schema where the path does not exist."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).format(fmt).load(path) if there else spark.createDataFrame([], schema)


def points(spark: SparkSession, path: str, dimensions: int) -> DataFrame:
    """``(id, x)`` of a headerless numeric CSV: number, an ignored column, then the coordinates."""
    columns = [f"c{i}" for i in range(dimensions)]
    raw = spark.read.schema("id bigint, ignored string, " + ", ".join(f"{c} double" for c in columns)).csv(path)
    return raw.select("id", F.array(*columns).alias("x"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(file, file_no, text)``: each file as one text, with the number in its name."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    return t.select("file", F.regexp_extract("file", r"(\d+)", 1).try_cast("int").alias("file_no"), "text")


def partitioned_names(spark: SparkSession, path: str) -> DataFrame:
    """``(template, gender, year, name, freq)`` of name,_,freq files whose path holds template, gender and year."""
    d = spark.read.schema("name string, other string, freq bigint").csv(path, recursiveFileLookup=True)
    at = F.col("_metadata.file_path")
    part = lambda p: F.regexp_extract(at, p, 1)
    return d.select(part(r"(T\d+)").alias("template"), part(r"(male|female)").alias("gender"), part(r"(\d{4})\.").try_cast("int").alias("year"), "name", "freq")


def watch_list(spark: SparkSession, path: str) -> DataFrame:
    """``(ticker_code, name)`` of a YAML list of two-field entries; a repeated code counts once."""
    t = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"(?m)^\s*-\s+")).alias("e"))
    field = lambda k: F.trim(F.regexp_extract("e", rf"(?m)\b{k}:\s*[\"']?([^\"'\r\n]+)", 1))
    return t.select(field("ticker_code").alias("ticker_code"), field("name").alias("name")).where("ticker_code <> ''").dropDuplicates(["ticker_code"])


class _Tables(HTMLParser):
    """Rows of tables as cells of text and links; paragraphs as text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[dict]] = []
        self.paragraphs: list[str] = []
        self.cell = self.paragraph = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.cell = {"tag": tag, "text": "", "links": []}
            self.rows[-1].append(self.cell)
        elif tag == "p":
            self.paragraph = ""
        elif tag == "a" and self.cell is not None:
            self.cell["links"].append({"name": "", "link": dict(attrs).get("href") or ""})

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.cell = None
        elif tag == "p" and self.paragraph is not None:
            self.paragraphs.append(self.paragraph)
            self.paragraph = None

    def handle_data(self, data):
        if self.paragraph is not None:
            self.paragraph += data
        if self.cell is not None:
            self.cell["text"] += data
            if self.cell["links"] and not self.cell["links"][-1]["name"]:
                self.cell["links"][-1]["name"] = data.strip()


def _parsed(html: str) -> _Tables:
    p = _Tables()
    try:
        p.feed(html or "")
    except (ValueError, AssertionError):
        pass
    return p


def _clean(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def html_rows(pages: DataFrame, key: str, html: str, cells: int = 5) -> DataFrame:
    """``(key, row_no, cells, links)`` of table rows with exactly ``cells`` data cells."""
    kind = dict(pages.dtypes)[key]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, h in zip(b.iloc[:, 0], b.iloc[:, 1]):
                data = [r for r in _parsed(h).rows if len(r) == cells and all(c["tag"] == "td" for c in r)]
                rows += [(k, i, [_clean(c["text"]) for c in r], [x for c in r for x in c["links"]]) for i, r in enumerate(data, 1)]
            yield pd.DataFrame(rows, columns=[key, "row_no", "cells", "links"])

    return pages.select(key, html).mapInPandas(task, f"`{key}` {kind}, row_no int, cells array<string>, links array<struct<name:string,link:string>>")


def html_labels(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``(key, label, value)``: each header cell with the cell next to it."""
    kind = dict(pages.dtypes)[key]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, h in zip(b.iloc[:, 0], b.iloc[:, 1]):
                for r in _parsed(h).rows:
                    rows += [(k, _clean(x["text"]), _clean(y["text"])) for x, y in zip(r, r[1:]) if x["tag"] == "th" and y["tag"] == "td"]
            yield pd.DataFrame(rows, columns=[key, "label", "value"])

    return pages.select(key, html).mapInPandas(task, f"`{key}` {kind}, label string, value string")


def html_stats(pages: DataFrame, key: str, html: str, mark: str = "block_stat") -> DataFrame:
    """``(key, text, value)``: each paragraph of class ``mark`` with the text of the span in it."""
    kind = dict(pages.dtypes)[key]
    block = re.compile(rf"<p[^>]*class=[\"']{mark}[\"'][^>]*>(.*?)</p>", re.S)
    span, tag = re.compile(r"<span[^>]*>(.*?)</span>", re.S), re.compile(r"<[^<>]*>")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, h in zip(b.iloc[:, 0], b.iloc[:, 1]):
                for body in block.findall(h or ""):
                    value = span.search(body)
                    rows.append((k, _clean(unescape(tag.sub(" ", body))), _clean(unescape(tag.sub(" ", value.group(1)))) if value else ""))
            yield pd.DataFrame(rows, columns=[key, "text", "value"])

    return pages.select(key, html).mapInPandas(task, f"`{key}` {kind}, text string, value string")


def page_place(json: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, latitude, longitude)`` of the JSON form of a page; null where it has none."""
    at = lambda k: F.get_json_object(text, f"$.{k}").try_cast("double").alias(k)
    return json.select(key, at("latitude"), at("longitude"))


def html_paragraphs(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``(key, text)``: the paragraphs joined by a blank; '' where there are none."""
    kind = dict(pages.dtypes)[key]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b.iloc[:, 0], "text": [" ".join(map(_clean, _parsed(h).paragraphs)) for h in b.iloc[:, 1]]})

    return pages.select(key, html).mapInPandas(task, f"`{key}` {kind}, text string")


def stacked(frames: dict[str, DataFrame], column: str = "ticker_code") -> DataFrame:
    """Tables of one shape stacked, with the name of each in front."""
    out = None
    for name, df in frames.items():
        part = df.select(F.lit(name).alias(column), "*")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
