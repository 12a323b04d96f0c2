"""Documents from files: plain text, and the text nodes of docx and xlsx, masked or restored in place."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as K

from ..functions import text as T

# Size limits, XML elements that hold text, parts in reading order.
MOST_BYTES, MOST_INFLATED = 50 << 20, 200 << 20
DOCX_PARTS = re.compile(r"^word/(document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml$")
XLSX_PARTS = re.compile(r"^xl/(sharedStrings|comments\d*|worksheets/sheet\d+)\.xml$")
DOCX_PART, XLSX_PART = re.compile(r"word/(?:document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml"), re.compile(r"xl/(?:sharedStrings|worksheets/sheet\d+)\.xml")
TEXT_NODE = re.compile(r"(<(w:t|w:delText|w:instrText|t)(?:\s[^>]*)?>)([^<]*)(</\2>)")
BLOCK_END = re.compile(r"</(?:w:p|si|c|text)>")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """A row a file: path, text (trimmed); empty ones are left out. CSV is text here."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", f"^[{T.WS}]+|[{T.WS}]+$", "").alias("text"))
    return rows.where(F.length("text") > 0)


def read_binary(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """A row a file: path, content; larger files aren't opened."""
    return spark.read.format("binaryFile").load(path).where(F.col("length") <= most).select("path", "content")


GOLD = "text string, gold array<struct<text:string,type:string>>"


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Labelled sentences from a JSON file that is one array: a row for each gold surface, with its sentence: text, type, surface."""
    rows = spark.read.schema(GOLD).json(path, multiLine=True)
    return rows.select("text", F.explode("gold").alias("g")).select("text", F.col("g.type").alias("type"), F.col("g.text").alias("surface"))


def kind_of(path: Column) -> Column:
    """pdf, xlsx, csv, docx, txt or other."""
    ending = F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))
    return F.when(ending == "pdf", "pdf").when(ending.isin("xlsx", "xls"), "xlsx").when(ending == "csv", "csv").when(ending.isin("docx", "doc"), "docx").when(ending == "txt", "txt").otherwise("other")


def decoded(xml: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        xml = xml.replace(a, b)
    xml = re.sub(r"&#(?:x([0-9a-fA-F]+)|(\d+));", lambda m: chr(int(m[1], 16) if m[1] else int(m[2])), xml)
    return xml.replace("&amp;", "&")


def encoded(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def parts_of(content: bytes) -> Iterator[tuple[str, str]]:
    """Text-bearing parts in order; more than the limit of inflated bytes is refused."""
    spent = 0
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for info in sorted(z.infolist(), key=lambda i: (i.filename not in ("word/document.xml", "xl/sharedStrings.xml"), i.filename)):
            if DOCX_PARTS.match(info.filename) or XLSX_PARTS.match(info.filename):
                spent += info.file_size
                if spent > MOST_INFLATED:
                    raise ValueError("inflated parts exceed the limit")
                yield info.filename, z.read(info).decode("utf-8")


def plain_text(content: bytes) -> str:
    """Text of a docx or xlsx: a line for each paragraph, string or cell."""
    lines = []
    for _, xml in parts_of(content):
        lines += ["".join(decoded(m[3]) for m in TEXT_NODE.finditer(block)) for block in BLOCK_END.split(xml)]
    return "\n".join(x for x in lines if x)


@F.pandas_udf(K.StringType())
def office_text(contents: pd.Series) -> pd.Series:
    return contents.map(lambda c: None if c is None else plain_text(c))


def changed_blocks(xml: str, change: Callable[[str], str], only: str = "") -> str:
    """A part with each block's text changed; a block's new text goes into its first node, so split runs are met whole."""
    parts, at = [], 0
    for end in [*(m.end() for m in BLOCK_END.finditer(xml)), len(xml)]:
        block, at = xml[at:end], end
        if only in block:
            nodes = list(TEXT_NODE.finditer(block))
            old = "".join(decoded(m[3]) for m in nodes)
            new = change(old) if old else old
            if new != old:
                fresh = iter([encoded(new), *[""] * len(nodes)])
                block = TEXT_NODE.sub(lambda m: m[1] + next(fresh) + m[4], block)
        parts.append(block)
    return "".join(parts)


def rewritten(content: bytes, change: Callable[[str], str]) -> bytes:
    """The file with each block's text changed."""
    out = io.BytesIO()
    wanted = dict(parts_of(content))
    with zipfile.ZipFile(io.BytesIO(content)) as src, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as dst:
        for info in src.infolist():
            dst.writestr(info, changed_blocks(wanted[info.filename], change) if info.filename in wanted else src.read(info))
    return out.getvalue()


def token_docx(text: str) -> bytes:
    """A minimal docx: a right-to-left paragraph a line."""
    rows = "".join(f'<w:p><w:pPr><w:bidi/></w:pPr>{f"<w:r><w:t xml:space={chr(34)}preserve{chr(34)}>{encoded(x)}</w:t></w:r>" if x.strip() else ""}</w:p>' for x in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{rows}</w:body></w:document>')
    return out.getvalue()


def chunks(text: str | None, most: int = 400) -> list[dict]:
    """Contiguous pieces of at most ``most`` characters, cut after the last line end or space that lies beyond their middle, if there is one."""
    out, at, text = [], 0, text or ""
    while at < len(text):
        end = min(len(text), at + most)
        if end < len(text):
            cut = max(text.rfind("\n", at, end), text.rfind(" ", at, end))
            end = cut + 1 if cut - at > most * 0.5 else end
        out.append({"text": text[at:end], "offset": at})
        at = end
    return out


@F.pandas_udf(K.ArrayType(K.StructType([K.StructField("text", K.StringType()), K.StructField("offset", K.IntegerType())])))
def chunked(texts: pd.Series) -> pd.Series:
    return texts.map(chunks)
