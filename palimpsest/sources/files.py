"""File sources: whole documents, office files, JSON stores and fetched pages.

Spark lists, filters and reads the files (``binaryFile``, ``text``, ``json``); parsers of formats that
Spark lacks run on the bytes inside Arrow-batched functions.
"""

from __future__ import annotations

import io
import re
import time
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from palimpsest.functions.text import newlines

TEXT_KINDS = ("md", "txt")
OFFICE_KINDS = ("docx", "xlsx")
IMAGE_KINDS = ("png", "jpg", "jpeg", "webp")
MAX_UPLOAD = 15 << 20
DOCX_PARAGRAPHS, SHEETS, SHEET_ROWS = 1200, 10, 400
TRUNCATED = "[...]"


def documents(spark: SparkSession, folder: str, glob: str = "*.xml", recursive: bool = True) -> DataFrame:
    """eli (the path below ``folder`` without its suffix), body, size, modified."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(folder)
    inside = F.regexp_replace("path", r"^.*?\Q" + re.sub(r"^\w+:/*", "/", folder.rstrip("/")) + r"/\E", "")
    return files.select(
        F.regexp_replace(inside, r"\.[^./]*\z", "").alias("eli"), F.col("content").alias("body"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")
    )


def listing(spark: SparkSession, folder: str, glob: str = "*.pdf", without: str | None = None, recursive: bool = False) -> DataFrame:
    """path, name, size, sha256 of files, but for names that match ``without``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(folder)
    out = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    return out if without is None else out.where(~F.rlike("name", F.lit(without)))


def extension(name: str | Column) -> Column:
    return F.lower(F.regexp_extract(F.col(name) if isinstance(name, str) else name, r"\.([A-Za-z0-9]+)\z", 1))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def docx_text(data: bytes) -> str:
    """Paragraphs that have text, then tables as rows of cells parted by " | "."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    lines = [t for p in body.findall(f"{_W}p")[:DOCX_PARAGRAPHS] if (t := text(p))]
    for row in body.iter(f"{_W}tr"):
        cells = [text(c) for c in row.findall(f"{_W}tc")]
        if any(cells):
            lines.append(" | ".join(cells))
    return "\n".join(lines)


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of a workbook's sheets in its order, by its relations; without these, by number."""
    sheets = list(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_S}sheet"))
    parts: dict[str | None, str] = {}
    if "xl/_rels/workbook.xml.rels" in book.namelist():
        for relation in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
            target = relation.get("Target") or ""
            parts[relation.get("Id")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return [(s.get("name") or "", parts.get(s.get(_RELATION), f"xl/worksheets/sheet{k}.xml")) for k, s in enumerate(sheets, start=1)]


def xlsx_text(data: bytes) -> str:
    """Sheets by name, rows of non-blank cells parted by " | ", a mark where rows were left out."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
    lines = []
    for name, part in _sheets(z)[:SHEETS]:
        lines.append(f"# {name}")
        rows = list(ElementTree.fromstring(z.read(part)).iter(f"{_S}row"))
        for row in rows[:SHEET_ROWS]:
            cells = []
            for c in row.findall(f"{_S}c"):
                v = c.find(f"{_S}v")
                inline = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                value = inline if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text or ""
                if value.strip():
                    cells.append(value.strip())
            if cells:
                lines.append(" | ".join(cells))
        if len(rows) > SHEET_ROWS:
            lines.append(TRUNCATED)
    return "\n".join(lines)


def pdf_read(data: bytes) -> tuple[list[str], str | None]:
    """(pages' texts, problem): no pages, and why, where no PDF library is installed or the file can't be read."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return [], "no PDF library"
    try:
        return [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages], None
    except Exception as error:  # noqa: BLE001 - the library raises anything on broken files
        return [], f"{type(error).__name__}: {error}"


def pdf_pages(data: bytes) -> list[str]:
    """Pages' texts; none if the file can't be read (``pdf_read`` says why)."""
    return pdf_read(data)[0]


def _parser(parse: Callable[[bytes], str]):
    @F.pandas_udf("string")
    def run(data: pd.Series) -> pd.Series:
        def one(b):
            if b is None:
                return None
            try:
                return parse(bytes(b))
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, IndexError):
                return None

        return data.map(one)

    return run


def uploads(spark: SparkSession, folder: str, max_bytes: int = MAX_UPLOAD) -> DataFrame:
    """name, ext, text, problem for files of any kind: text by extension, a reason where there is none.

    Images need an outside service to be read, so they're named as such.
    """
    files = spark.read.format("binaryFile").load(folder).withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("ext", extension("name"))
    fits = F.col("length") <= max_bytes
    data = lambda *kinds: F.when(fits & F.col("ext").isin(*kinds), F.col("content"))
    utf8 = F.try_validate_utf8(data(*TEXT_KINDS).cast("string"))
    pdf = _parser(lambda b: "\n\n".join(pdf_pages(b)) or None)(data("pdf"))
    text = F.coalesce(utf8, _parser(docx_text)(data("docx")), _parser(xlsx_text)(data("xlsx")), pdf)
    problem = (
        F.when(~fits, "too large")
        .when(F.col("ext").isin(*IMAGE_KINDS), "needs text recognition")
        .when(~F.col("ext").isin(*TEXT_KINDS, *OFFICE_KINDS, "pdf"), "kind not supported")
        .when(F.col("text").isNull() | (F.trim("text") == ""), "no readable text")
    )
    return files.select("name", "ext", "length", newlines(text).alias("text"), F.lit(None).cast("string").alias("problem")).withColumn("problem", problem)


def json_store(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Records of JSON files of lists; a file that can't be read gives none."""
    rows = spark.read.schema(f"{schema}, _broken string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken")
    return rows.option("ignoreCorruptFiles", True).json(folder).where("_broken is null").drop("_broken")


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def write_csv(df: DataFrame, folder: str) -> None:
    """With a header; nested columns as JSON."""
    nested = [c for c, kind in df.dtypes if kind.startswith(("array", "struct", "map"))]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").option("header", True).csv(folder)


# --- pages over HTTP ------------------------------------------------------------------------------


class FetchError(Exception):
    def __init__(self, url: str, status: int | None, reason: str):
        super().__init__(f"{url}: {reason}")
        self.status = status


def worth_retrying(error: FetchError) -> bool:
    """Network faults and server errors are; what the server refuses isn't."""
    return error.status is None or error.status >= 500


def with_retries(get: Callable[[str], bytes], url: str, attempts: int = 3, wait: float = 1.5, sleep=time.sleep) -> bytes:
    for k in range(attempts):
        try:
            return get(url)
        except FetchError as error:
            if k + 1 == attempts or not worth_retrying(error):
                raise
            sleep(wait * 2**k)
    raise AssertionError("unreachable")


def http_get(url: str, limit: int = 128_000_000, timeout: float = 60) -> bytes:
    """A body of at most ``limit`` bytes; one more is asked for, so that a cut body is noticed."""
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(url, timeout=timeout) as response:
            body = response.read(limit + 1)
    except urllib.error.HTTPError as error:
        raise FetchError(url, error.code, str(error)) from error
    except OSError as error:
        raise FetchError(url, None, str(error)) from error
    if len(body) > limit:
        raise FetchError(url, 413, f"more than {limit} bytes")
    return body


class _Pages(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.attempts, self.limit = int(options.get("attempts", 3)), int(options.get("limit", 128_000_000))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        url = partition.value
        try:
            yield url, bytearray(with_retries(lambda u: http_get(u, self.limit), url, self.attempts)), None
        except FetchError as error:
            yield url, None, str(error)


class HttpDocuments(DataSource):
    """``spark.dataSource.register(HttpDocuments)``; then format "http_documents" with option ``urls``, one a
    line. A url that fails gives a row with its problem rather than none."""

    @classmethod
    def name(cls) -> str:
        return "http_documents"

    def schema(self) -> str:
        return "url string, body binary, problem string"

    def reader(self, schema) -> DataSourceReader:
        return _Pages(self.options)
