"""Readers: files of many kinds to rows of (path, page_number, text), and feeds and datasets to typed rows."""

from __future__ import annotations

import csv
import functools
import io
import json
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.extract import source_type
from siltstone.functions.text import collapse, quality_by_spacing, quality_by_word_length
from siltstone.ports import PageParser, PlainPages

#: Bytes or characters of what is parsed and handed on together.
PIECE = 2 << 20
PAGES = "path string, page_number int, text string"
#: Built-in benchmark cases where no dataset is given.
DEFAULT_CASES = (("What is retrieval augmented generation?", "It grounds generation in retrieved text."), ("What does BM25 score?", "Term matches weighted by frequency and length."))


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, content of every file below ``path``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content")


def _pieces(rows: Iterator[tuple], size: int = PIECE) -> Iterator[list[tuple]]:
    """Rows whose last value is a text or bytes, in lists of about ``size`` together."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[-1]) + 64
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def _parsed(sources: DataFrame, reads: dict) -> DataFrame:
    """Pages of (kind, path, content), each content read as its kind says; what a task holds besides the batch that it was given is bounded in bytes."""
    kinds = pa.schema([("kind", pa.string()), ("path", pa.string()), ("page_number", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages = ((k.as_py(), p.as_py(), n, t) for k, p, c in zip(*b.columns, strict=True) for n, t in reads[k.as_py()](c.as_py()))
            for rows in _pieces(pages):
                yield pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    return sources.filter(F.col("kind").isin(*reads)).select("kind", F.col("path").cast("string").alias("path"), "content").mapInArrow(run, f"kind string, {PAGES}")


def _mapped(binary: DataFrame, parse) -> DataFrame:
    return _parsed(binary.withColumn("kind", F.lit("")), {"": parse}).drop("kind")


def documents(binary: DataFrame, parser: PageParser | None = None) -> DataFrame:
    """Pages of binary documents through a page parser (null text becomes empty)."""
    own = parser or PlainPages()
    return _mapped(binary, lambda c: [(n, t or "") for n, t in own.pages(c)])


def docx_text(content: bytes) -> str:
    """Non-blank paragraphs joined by line feeds; empty for what is not such a file."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))
    return "\n".join(p for p in paragraphs if p.strip())


def docx(binary: DataFrame) -> DataFrame:
    return _mapped(binary, lambda c: [(1, docx_text(c))])


def json_text(content: bytes) -> str:
    try:
        return json.dumps(json.loads(content), indent=2)
    except ValueError:
        return ""


def json_documents(binary: DataFrame) -> DataFrame:
    """JSON files as indented ASCII text."""
    return _mapped(binary, lambda c: [(1, json_text(c))])


def csv_text(rows: DataFrame, columns: list[str], order: str, by: str) -> DataFrame:
    """by, text: lines ``Row i: name=value, ...`` of each group in order."""
    line = F.concat_ws(", ", *(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns))
    listed = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))).alias("r"))
    return listed.select(by, F.array_join(F.transform("r", lambda r, i: F.concat(F.lit("Row "), (i + 1).cast("string"), F.lit(": "), r["line"])), "\n").alias("text"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """path, text of CSV files with headers."""
    raw = spark.read.option("header", "true").csv(path)
    named = raw.select("*", F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("_n"))
    return csv_text(named, raw.columns, "_n", "path")


def markdown_pages(texts: DataFrame, pages: Column) -> DataFrame:
    """The whole text on page 1, empty pages after it."""
    return texts.select("*", F.explode(F.sequence(F.lit(1), F.greatest(pages, F.lit(1)))).alias("page_number")).withColumn("text", F.when(F.col("page_number") == 1, F.col("text")).otherwise(""))


def bucketed_pages(texts: DataFrame) -> DataFrame:
    """path, page_number, text: parts with a page of origin joined by page in order (path, page_number, seq, text)."""
    return texts.groupBy("path", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda r: r["text"]), "\n").alias("text"))


def by_type(sources: DataFrame, source: str) -> DataFrame:
    """``sources`` with the kind of reader that each address wants."""
    return sources.withColumn("kind", source_type(F.col(source)))


def quality_cascade(parsed: list[tuple[str, Column, float]], last: tuple[str, Column]) -> Column:
    """Struct of parser and text: the first parser whose pages (an array of texts) have a mean quality above its threshold, else the last one."""

    def mean(pages: Column) -> Column:
        return F.when(F.size(pages) > 0, F.aggregate(F.transform(pages, lambda p: quality_by_word_length(F.coalesce(p, F.lit("")))), F.lit(0.0), lambda a, q: a + q) / F.size(pages)).otherwise(0.0)

    picks = [F.when(mean(pages) > threshold, F.struct(F.lit(name).alias("parser"), F.array_join(pages, "\n").alias("text"))) for name, pages, threshold in parsed]
    return F.coalesce(*picks, F.struct(F.lit(last[0]).alias("parser"), F.array_join(last[1], "\n").alias("text")))


def first_with_text(parsed: list[tuple[str, Column]]) -> Column:
    """Struct of parser and text: the first parser that has a page which is not blank, else the last one."""
    shown = [F.struct(F.lit(name).alias("parser"), F.array_join(pages, "\n").alias("text")) for name, pages in parsed]
    return F.coalesce(*(F.when(F.exists(pages, lambda p: F.trim(p) != ""), out) for (_, pages), out in zip(parsed[:-1], shown, strict=False)), shown[-1])


def process_cascade(first: Column, second: Column, third: Column, least: float = 0.5) -> Column:
    """The first text; where its quality is below ``least`` the second, if it is no worse; where that is blank the third."""
    better = (quality_by_spacing(first) < least) & (quality_by_spacing(second) >= quality_by_spacing(first))
    chosen = F.when(better, second).otherwise(first)
    return F.when(F.trim(chosen) == "", third).otherwise(chosen)


def csv_bytes_text(content: bytes) -> str:
    """Lines ``Row i: name=value, ...`` of a CSV file with a header."""
    rows = list(csv.reader(io.StringIO(content.decode("utf-8", "replace"))))
    return "\n".join(f"Row {i}: " + ", ".join(f"{h}={v}" for h, v in zip(rows[0], r, strict=False)) for i, r in enumerate(rows[1:], 1)) if rows else ""


def dispatch(binary: DataFrame, parser: PageParser | None = None) -> DataFrame:
    """kind, path, page_number, text of sources (path, content), each read as its address asks: pdf, url, csv, json or docx."""
    own = parser or PlainPages()
    reads = {
        "pdf": lambda c: [(n, t or "") for n, t in own.pages(c)], "url": lambda c: [(1, selected_text(c.decode("utf-8", "replace")))],
        "csv": lambda c: [(1, csv_bytes_text(c))], "json": lambda c: [(1, json_text(c))], "docx": lambda c: [(1, docx_text(c))],
    }
    return _parsed(by_type(binary, "path"), reads)  # one pass: a plan for each kind would make the sources again for each


def paper_page(html: Column) -> Column:
    """Struct of title and categories of a paper's page: what follows ``subjects:``, up to a tag or the line's end."""
    found = F.transform(F.regexp_extract_all(html, F.lit(r"(?i)subjects?:\s*([^<\n]+)"), F.lit(1)), lambda c: F.trim(c))
    return F.struct(title(html).alias("title"), found.alias("categories"))


def single_section(texts: DataFrame) -> DataFrame:
    """``texts`` with one section named Document."""
    return texts.withColumn("sections", F.array(F.struct(F.lit("Document").alias("name"), F.col("text").alias("text"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"))))


class _Tree(HTMLParser):
    """Text below the first element that matches each selector, and all text."""

    SELECTORS = ("article", "main", ".content", "#content", "body")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str]]] = []
        self.found: dict[str, list[str]] = {}
        self.every: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
            return
        if tag in ("br", "hr", "img", "input", "meta", "link"):
            return
        a = {k: v or "" for k, v in attrs}
        names = [tag, *(f".{c}" for c in a.get("class", "").split()), f"#{a.get('id', '')}"]
        texts: list[str] = []
        for s in self.SELECTORS:
            if s in names and s not in self.found:
                self.found[s] = texts
        self.open.append((tag, texts))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif any(t == tag for t, _ in self.open):
            while self.open and self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if self.hidden:
            return
        self.every.append(data)
        for _, texts in self.open:
            texts.append(data)


#: An ampersand that begins no character reference ended by a semicolon: it stands for itself.
_BARE = re.compile(r"&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)")


def _tree(page: str | None) -> _Tree:
    tree = _Tree()
    tree.feed(_BARE.sub("&amp;", page or ""))
    tree.close()
    return tree


def selected_text(page: str | None, least: int = 200) -> str:
    """Text of the first of article, main, .content, #content and body with more than ``least`` characters, else all of it."""
    tree = _tree(page)
    for s in tree.SELECTORS:
        text = " ".join(" ".join(tree.found.get(s, ())).split())
        if len(text) > least:
            return text
    return " ".join(" ".join(tree.every).split())


def main_texts(pages: DataFrame, key: str, html: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "text": [selected_text(h) for h in b[html]]})

    return pages.select(key, html).mapInPandas(run, f"{key} {dict(pages.dtypes)[key]}, text string")


def page_backends(pages: DataFrame, key: str, html: str, least: int = 200) -> DataFrame:
    """key, text, backend: the article of a page's markup if it has ``least`` characters, else all of its visible text, else what is between its tags."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for page in b[html]:
                tree = _tree(page)
                article = " ".join(" ".join(tree.found.get("article", ())).split())
                whole = " ".join(" ".join(tree.every).split())
                found.append((article, "article") if len(article) > least else (whole, "page") if whole else (None, None))
            yield pd.DataFrame({key: b[key], "text": [f[0] for f in found], "backend": [f[1] for f in found], html: b[html]})

    kinds = dict(pages.dtypes)
    rows = pages.select(key, html).mapInPandas(run, f"{key} {kinds[key]}, text string, backend string, {html} string")
    return rows.select(key, F.coalesce("text", collapse(F.regexp_replace(html, "<[^>]*>", " ")), F.lit("")).alias("text"), F.coalesce("backend", F.lit("tags")).alias("backend"))


def title(html: Column) -> Column:
    return collapse(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1))


def scrape_cascade(article: Column, plain: Column, rendered: Column, least: int = 500) -> Column:
    """The first text of ``least`` characters, else the longest one left."""
    return F.coalesce(F.when(F.length(article) >= least, article), F.when(F.length(plain) >= least, plain), rendered, plain, article, F.lit(""))


ENTRY = "id string, title string, summary string, updated string, link array<struct<_href:string,_title:string,_type:string>>, category array<struct<_term:string>>"


def _entries(raw: DataFrame, *keep: str) -> DataFrame:
    entry = F.regexp_replace(F.regexp_extract(F.trim("id"), r"([^/]+)$", 1), r"v\d+$", "")
    pdf = F.get(F.filter("link", lambda x: (x["_title"] == "pdf") | (x["_type"] == "application/pdf")), F.lit(0))["_href"]
    rows = raw.select(*keep, entry.alias("entry_id"), collapse(F.col("title")).alias("title"), collapse(F.coalesce("summary", F.lit(""))).alias("summary"), F.to_timestamp("updated").alias("updated"), F.coalesce(pdf, F.concat(F.lit("https://arxiv.org/pdf/"), entry, F.lit(".pdf"))).alias("pdf_url"), F.transform("category", lambda c: c["_term"]).alias("categories"))
    return rows.filter("entry_id <> '' AND title <> '' AND updated IS NOT NULL")


def feed(spark: SparkSession, path: str) -> DataFrame:
    """entry_id, title, summary, updated, pdf_url, categories of Atom feeds; entries that lack an id, a title or a date go."""
    return _entries(spark.read.format("xml").option("rowTag", "entry").schema(ENTRY).load(path))


def entries(rows: DataFrame, xml: str, *keep: str) -> DataFrame:
    """The same from a column of single entries."""
    return _entries(rows.select(*keep, F.from_xml(xml, ENTRY).alias("_e")).select(*keep, "_e.*"), *keep)


def case_rows(rows: DataFrame, line: str, *keep: str) -> DataFrame:
    """keep, question, expected_keywords, paper_ids from a column of JSON objects; rows without a question go."""
    parsed = rows.select(*keep, F.from_json(line, "question string, expected_keywords array<string>, paper_ids array<string>").alias("c")).select(*keep, "c.*")
    none = F.array().cast("array<string>")
    return parsed.select(*keep, F.trim("question").alias("question"), F.coalesce("expected_keywords", none).alias("expected_keywords"), F.coalesce("paper_ids", none).alias("paper_ids")).filter("question <> ''")


def piped_rows(text: Column) -> Column:
    """Lines with cells between bars, as an array of rows of cells."""
    return F.transform(F.filter(F.split(text, "\n"), lambda x: x.contains(" | ")), lambda x: F.split(x, r" \| "))


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """question, expected_keywords, paper_ids from a JSON array or lines; rows without a question go."""
    schema = "question string, expected_keywords array<string>, paper_ids array<string>"
    raw = spark.read.text(path, wholetext=True)
    one = F.from_json("value", f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")
    lines = F.filter(F.transform(F.split("value", "\n"), lambda s: F.from_json(s, schema)), lambda r: r.isNotNull())
    rows = raw.select(F.explode(F.when(F.trim("value").startswith("["), one).otherwise(lines)).alias("c")).select("c.*")
    return rows.select(F.trim("question").alias("question"), F.coalesce("expected_keywords", F.array().cast("array<string>")).alias("expected_keywords"), F.coalesce("paper_ids", F.array().cast("array<string>")).alias("paper_ids")).filter("question <> ''")


def benchmark_cases(spark: SparkSession, path: str | None = None) -> DataFrame:
    """question, ground_truth from lines of JSON, or the two built-in cases."""
    if path is None:
        return spark.createDataFrame(list(DEFAULT_CASES), "question string, ground_truth string")
    return spark.read.schema("question string, ground_truth string").json(path)
