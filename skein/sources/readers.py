"""Readers of documents by kind, and writers."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.layout import clean_pages
from ..operators.text import html_to_markdown

Reader = Callable[[SparkSession, str], DataFrame]
READERS: dict[str, Reader] = {}


def reader(*names: str):
    def put(f: Reader) -> Reader:
        for n in names:
            READERS[n] = f
        return f

    return put


def read(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """path, title, markdown of the documents below a path, by kind."""
    if kind not in READERS:
        raise ValueError(f"unknown kind of source: {kind}; known are {', '.join(sorted(READERS))}")
    return READERS[kind](spark, path)


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)


def _text(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("markdown"))


def _titled(df: DataFrame) -> DataFrame:
    heading = F.regexp_extract("markdown", r"(?m)^#\s+(.+)$", 1)
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?\z", 1)
    return df.withColumn("title", F.when(heading != "", heading).otherwise(name)).select("path", "title", "markdown")


@reader("markdown_asis")
def markdown(spark, path):
    return _titled(_text(spark, path, "*.md"))


@reader("markdown_clean")
def markdown_clean(spark, path):
    return _titled(_text(spark, path, "*.md").withColumn("markdown", clean_pages(F.col("markdown"))))


@reader("txt", "paste")
def plain(spark, path):
    return _titled(_text(spark, path, "*.txt"))


@reader("web_url")
def web(spark, path):
    to = F.pandas_udf(lambda s: s.map(html_to_markdown), "string")
    return _titled(_text(spark, path, "*.html").withColumn("markdown", to("markdown")))


@reader("youtube")
def transcript(spark, path):
    """JSON lines {video_id, offset, text} to one document a video, by offset."""
    t = spark.read.schema("video_id string, offset double, text string").json(path)
    rows = F.array_sort(F.collect_list(F.struct("offset", "text")))
    return t.groupBy("video_id").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n\n").alias("markdown")).select(F.col("video_id").alias("path"), F.col("video_id").alias("title"), "markdown")


def parse_epub(content: bytes) -> dict:
    """Title, author, subjects and the chapters in reading order, as markdown."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.attrib["full-path"] for e in root.iter() if e.tag.endswith("rootfile"))
        book = ElementTree.fromstring(z.read(opf))
        base = opf.rpartition("/")[0]
        named = lambda n: [e.text or "" for e in book.iter() if e.tag.endswith("}" + n)]
        items = {e.attrib["id"]: e.attrib["href"] for e in book.iter() if e.tag.endswith("}item")}
        order = [e.attrib["idref"] for e in book.iter() if e.tag.endswith("}itemref")]
        chapters = [html_to_markdown(z.read(f"{base}/{items[i]}".lstrip("/")).decode("utf-8", "replace")) for i in order if i in items]
    return {"title": (named("title") or [""])[0], "author": (named("creator") or [""])[0], "subjects": named("subject"), "chapters": chapters}


def parse_epubs(files: DataFrame) -> DataFrame:
    """files (path, content) to path, title, markdown; a file that is no readable book raises."""

    def run(batches):
        for b in batches:
            rows = [parse_epub(c) for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "title": [r["title"] for r in rows], "markdown": ["\n\n".join(r["chapters"]) for r in rows]})

    return files.select("path", "content").mapInPandas(run, "path string, title string, markdown string")


@reader("epub")
def epub(spark, path):
    return parse_epubs(_files(spark, path, "*.epub"))


@reader("pdf")
def pdf(spark, path):
    """PDF layout needs an external model: set EXTRACTORS["pdf"] to a function from bytes to markdown."""
    f = EXTRACTORS.get("pdf")
    if f is None:
        raise NotImplementedError("no extractor for PDF is installed; set skein.sources.readers.EXTRACTORS['pdf']")
    to = F.pandas_udf(lambda s: s.map(f), "string")
    return _titled(_files(spark, path, "*.pdf").select("path", to("content").alias("markdown")))


EXTRACTORS: dict[str, Callable[[bytes], str]] = {}


def vault(spark: SparkSession, path: str) -> DataFrame:
    """Folders of a vault and which of their parts are there."""
    return vault_status(_files(spark, path, "*").select("path"))


def vault_status(files: DataFrame) -> DataFrame:
    """A listing (path) by folder: which parts are there; complete with content.md, chunks.json and metadata.json."""
    f = files.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
    has = lambda n: F.bool_or(F.col("name") == n)
    g = f.groupBy("folder").agg(has("content.md").alias("content"), has("chunks.json").alias("chunks"), has("metadata.json").alias("metadata"))
    return g.withColumn("complete", F.col("content") & F.col("chunks") & F.col("metadata"))


def highlights(spark: SparkSession, path: str) -> DataFrame:
    """Exported books with highlights (JSON, one book a line) as one row a highlight."""
    schema = "user_book_id long, title string, author string, highlights array<struct<id:long,text:string,note:string,location:long,location_type:string>>"
    return spark.read.schema(schema).json(path).select("user_book_id", "title", "author", F.explode("highlights").alias("h")).select("user_book_id", "title", "author", "h.*")


def write_validated(df: DataFrame, ok, path: str, rejected: str) -> None:
    """Good rows to one folder, the others to another: one bad row fails no batch."""
    df.where(ok).write.mode("append").parquet(path)
    df.where(~ok | ok.isNull()).write.mode("append").json(rejected)


def export_documents(docs: DataFrame, chunks: DataFrame, path: str) -> DataFrame:
    """Documents and their chunks as JSON by document, and a manifest, which is returned."""
    docs.write.mode("overwrite").json(f"{path}/documents")
    chunks.write.mode("overwrite").partitionBy("document_id").json(f"{path}/chunks")
    m = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars"))
    m.write.mode("overwrite").json(f"{path}/manifest")
    return m


def extract_json(text: str):
    """JSON from a model's reply: fences and trailing commas removed; None if it stays unreadable."""
    t = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", text or "")
    for x in (t, re.sub(r",\s*([}\]])", r"\1", t)):
        try:
            return json.loads(x)
        except ValueError:
            continue
    return None
