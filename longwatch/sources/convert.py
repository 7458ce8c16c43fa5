"""Documents from files: readers, format detection, and conversion to text."""

from __future__ import annotations

import io
import ipaddress
import re
import tarfile
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longwatch.functions.urls import extension, media_type

MAX_FILE_BYTES = 100 << 20
MAX_CONVERTED_CHARS = 20_000_000
MAX_RATIO = 200
MAX_MEMBERS = 4096
# Members that are worth converting, the best first; and tags that break lines.
PREFERRED = (".docx", ".pdf", ".txt", ".text")
OPENING_BREAKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "table"}
CLOSING_BREAKS = {"p", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section"}
SILENT = {"script", "style", "noscript"}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class ConversionError(ValueError):
    """Why a file gives no text; its message is the row's error."""


def read_documents(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Documents from Parquet, from text files (one each), or from any files with their bytes.

    Files above the size limit come without their bytes, which are not read,
    and with an error. (S11)
    """
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "text":
        return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    if kind == "binary":
        files = spark.read.format("binaryFile").load(path)
        none = F.lit(None)
        fits = files.where(F.col("length") <= MAX_FILE_BYTES).withColumn("error", none.cast("string"))
        large = files.where(F.col("length") > MAX_FILE_BYTES).select("path", "modificationTime", "length", none.cast("binary").alias("content"), F.lit("file too large").alias("error"))
        return fits.union(large)
    raise ValueError(f"unknown kind {kind!r}")


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
        elif not self.silent and tag in OPENING_BREAKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif not self.silent and tag in CLOSING_BREAKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.silent and (text := data.strip()):
            self.out.append(text + " ")


def html_text(source: str | bytes) -> str:
    """The text of a page: a paragraph for each line that its tags make. (S3)"""
    parser = _Text()
    parser.feed(source.decode("utf-8", "replace") if isinstance(source, bytes) else source)
    parser.close()
    return "\n\n".join(filter(None, (" ".join(line.split()) for line in "".join(parser.out).splitlines())))


def docx_text(data: bytes) -> str:
    """Paragraphs, then the cells of all tables."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            _check_sizes(z.infolist())
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise ConversionError("unreadable docx") from e
    line = lambda node: "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "" for t in node.iter())
    body = root.find(f"{_W}body")
    parts = [line(p) for p in body.findall(f"{_W}p")] if body is not None else []
    for row in root.iter(f"{_W}tr"):
        parts.append(" | ".join("\n".join(line(p) for p in cell.iter(f"{_W}p")).strip() for cell in row.findall(f"{_W}tc")))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(parts)).strip()


def _check_sizes(members: list[zipfile.ZipInfo]) -> None:
    """(S10)"""
    if len(members) > MAX_MEMBERS:
        raise ConversionError("too many members")
    for m in members:
        if m.file_size > MAX_FILE_BYTES or m.file_size / max(m.compress_size, 1) > MAX_RATIO:
            raise ConversionError("member too large")
    if sum(m.file_size for m in members) > MAX_FILE_BYTES:
        raise ConversionError("archive too large")


def ignored_member(name: Column) -> Column:
    """(S8)"""
    base = F.element_at(F.split(name, "/"), -1)
    return base.startswith("~$") | base.startswith(".") | F.contains(name, F.lit("__MACOSX/")) | name.startswith("__MACOSX")


def chosen_members(members: DataFrame, wanted: str | None = None) -> DataFrame:
    """(path, name): the member of each archive to convert, of (path, ord, name).

    The wanted one by its end, else by its base name; or the best kind that is
    there: fewest folders, shortest, first by name.
    """
    rows = members.where(~ignored_member(F.col("name")))
    base = F.lower(F.element_at(F.split("name", "/"), -1))
    if wanted is None:
        rank = F.array_position(F.array(*map(F.lit, PREFERRED)), extension(F.col("name")))
        order = [rank, F.size(F.split("name", "/")), F.length("name"), F.lower("name"), "ord"]
        rows = rows.where(rank > 0)
    else:
        ends, same = F.col("name").endswith(wanted), base == wanted.lower().rsplit("/", 1)[-1]
        order = [F.when(ends, 0).otherwise(1), "ord"]
        rows = rows.where(ends | same)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy(*order))).where("_n = 1").select("path", "name")


def shown_member(name: str) -> bool:
    """(S8)"""
    return not name.rsplit("/", 1)[-1].startswith(("~$", ".")) and "__MACOSX/" not in name and not name.startswith("__MACOSX")


def best_member(names: list[str], wanted: str | None = None) -> str:
    """The member to convert: the wanted one by its end or base name, else the best kind that is there."""

    def kind(name: str) -> str:
        return "." + name.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()

    shown = [n for n in names if shown_member(n)]
    if wanted is not None:
        base = wanted.lower().rsplit("/", 1)[-1]
        found = [n for n in shown if n.endswith(wanted)] or [n for n in shown if n.lower().rsplit("/", 1)[-1] == base]
        if not found:
            raise ConversionError("no such member")
        return found[0]
    ranked = sorted((PREFERRED.index(kind(n)), n.count("/"), len(n), n.lower(), n) for n in shown if kind(n) in PREFERRED)
    if not ranked:
        raise ConversionError("no member to convert")
    return ranked[0][-1]


def archive_member(data: bytes, kind: str, wanted: str | None = None) -> tuple[str, bytes]:
    """Name and bytes of the member of an archive to convert; archives inside are refused."""
    try:
        if kind == "zip":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                _check_sizes([m for m in z.infolist() if not m.is_dir()])
                name = best_member([m.filename for m in z.infolist() if not m.is_dir()], wanted)
                return name, z.read(name)
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            files = []
            for m in t:
                files += [m] if m.isfile() else []
                if len(files) > MAX_MEMBERS or sum(f.size for f in files) > MAX_FILE_BYTES:
                    raise ConversionError("archive too large")
            name = best_member([m.name for m in files], wanted)
            return name, t.extractfile(next(m for m in files if m.name == name)).read()
    except (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError) as e:
        raise ConversionError("unreadable archive") from e


def to_text(data: bytes, kind: str, wanted: str | None = None) -> str:
    """Text of a file of a media type, of an archive the wanted member."""
    if kind in ("zip", "tar"):
        name, data = archive_member(data, kind, wanted)
        suffix = name.rsplit(".", 1)[-1].lower()
        kind = {"docx": "docx", "pdf": "pdf"}.get(suffix, "text")
    if kind == "pdf":
        raise ConversionError("pdf is not supported here")
    if kind == "unknown":
        raise ConversionError("unknown media type")
    text = {"html": html_text, "docx": docx_text}.get(kind, lambda b: b.decode("utf-8", "replace"))(data)
    if not text.strip():
        raise ConversionError("no text")
    if len(text) > MAX_CONVERTED_CHARS:
        raise ConversionError("too many characters")
    return text


def converted(files: DataFrame, member: str | None = None) -> DataFrame:
    """(path, media_type, text, error) of files (path, content) with error or not: one that has an error keeps it.

    member: the member of archives to convert.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for data, kind, error in zip(pdf.content, pdf.media_type, pdf.error, strict=True):
                try:
                    out.append((None, error) if error else (to_text(data or b"", kind, member), None))
                except ConversionError as e:
                    out.append((None, str(e)))
            yield pdf[["path", "media_type"]].assign(text=[o[0] for o in out], error=[o[1] for o in out])

    kind = media_type(F.col("path"), F.lit(None).cast("string"), F.col("content"))
    error = F.col("error") if "error" in files.columns else F.lit(None).cast("string").alias("error")
    return files.select("path", "content", error, kind.alias("media_type")).mapInPandas(run, "path string, media_type string, text string, error string")


def html_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text) of pages. (S3)"""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[id_col]].assign(text=[html_text(h or "") for h in pdf[html_col]])

    return pages.select(id_col, html_col).mapInPandas(run, f"{id_col} {dict(pages.dtypes)[id_col]}, text string")


@F.pandas_udf(T.BooleanType())
def refused_address(host: pd.Series) -> pd.Series:
    """Whether a literal address must not be contacted; null for names."""

    def one(value):
        try:
            ip = ipaddress.ip_address((value or "").strip("[]"))
        except ValueError:
            return None
        ip = getattr(ip, "ipv4_mapped", None) or ip
        return bool(not ip.is_global or ip.is_multicast or ip.is_reserved or ip.is_unspecified)

    return host.map(one).astype("boolean")
