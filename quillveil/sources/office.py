"""Office files masked and restored in place. A file is one Arrow value: its text parts are detected as one text, healed, written back,
cleaned of metadata, and checked; what can't be made safe is refused with a code.
"""

from __future__ import annotations

import io
import re
import zipfile
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

from ..operators import document, recognizers, verify
from . import files


class Parts(NamedTuple):
    """Parts of a file by name, the order of the first, elements that hold text, the element that groups them, whether cells hold numbers."""

    pattern: str
    first: int
    tags: tuple[str, ...]
    group: str
    numbers: bool = False


# Parts of each kind of file with their elements, and where metadata lies.
HEADERS = ("oddHeader", "evenHeader", "firstHeader", "oddFooter", "evenFooter", "firstFooter")
PARTS = {
    "docx": [
        Parts(r"word/document\.xml", 0, ("w:t", "w:delText", "w:instrText"), "w:p"),
        Parts(r"word/header(\d*)\.xml", 100, ("w:t", "w:delText", "w:instrText"), "w:p"),
        Parts(r"word/footer(\d*)\.xml", 200, ("w:t", "w:delText", "w:instrText"), "w:p"),
        Parts(r"word/(?:footnotes|endnotes|comments)\.xml", 300, ("w:t", "w:delText", "w:instrText"), "w:p"),
        Parts(r"word/charts/chart\d*\.xml", 300, ("c:v",), "c:pt"),
    ],
    "xlsx": [
        Parts(r"xl/sharedStrings\.xml", 0, ("t",), "si"),
        Parts(r"xl/worksheets/sheet(\d+)\.xml", 1, ("t", *HEADERS), "c", True),
        Parts(r"xl/comments(\d*)\.xml", 1000, ("t",), "comment"),
        Parts(r"xl/threadedComments/threadedComment(\d*)\.xml", 2000, ("text",), "threadedComment"),
        Parts(r"xl/drawings/drawing(\d*)\.xml", 3000, ("a:t",), "a:p"),
        Parts(r"xl/charts/chart(\d*)\.xml", 4000, ("c:v",), "c:pt"),
        Parts(r"xl/workbook\.xml", 5000, ("definedName",), "definedName"),
    ],
}
BLANK_TEXT = [
    (r"docProps/core\.xml", ("dc:creator", "cp:lastModifiedBy", "dc:title", "dc:subject", "dc:description", "cp:keywords", "cp:category", "cp:contentStatus")),
    (r"docProps/app\.xml", ("Company", "Manager")),
    (r"docProps/custom\.xml", ("vt:lpwstr", "vt:bstr")),
    (r"xl/comments\d*\.xml", ("author",)),
]
BLANK_ATTRIBUTES = [(r"word/[^/]+\.xml", ("w:author", "w:initials", "w15:author", "w15:userId")), (r"xl/persons/person\d*\.xml", ("displayName",))]
THUMBNAIL, THUMBNAIL_LINK = re.compile(r"docProps/thumbnail\.[^/]+", re.I), re.compile(r'<Relationship\b[^>]*Target="[^"]*docProps/thumbnail[^"]*"[^>]*/>', re.I)
TEXT_PART = re.compile(r".*\.(?:xml|rels)", re.I | re.S)
NESTED, OPAQUE = re.compile(r"(?:.*/)?embeddings/[^/]*\.(?:xlsx|docx|pptx|xlsm|docm|pptm)", re.I), re.compile(r"(?:.*/)?embeddings/[^/]*\.bin|(?:.*/)?oleobject\d*\.bin", re.I)
BOMB, FORMULA, FAILED, LEGACY, BROKEN = "ZIP_BOMB", "XLSX_FORMULA_PII", "OFFICE_SELFVERIFY_FAILED", "LEGACY_XLS_UNSUPPORTED", "UNREADABLE"

Anonymize = Callable[[str], tuple[list[document.Span], list[tuple[str, str, str]], str]]


class Refused(ValueError):
    """A file that can't be made safe; the message begins with a code."""


def deterministic(text: str) -> tuple[list[document.Span], list[tuple[str, str, str]], str]:
    return document.process(text, recognizers.found(text))


class Region(NamedTuple):
    """A stretch of a part that is replaced: a text node's content, or a whole numeric cell."""

    path: str
    start: int
    end: int
    group: tuple
    text: str
    cell: str | None = None
    formula: bool = False


class Budget:
    """Bytes that one file may inflate to."""

    def __init__(self, most: int) -> None:
        self.left = most

    def take(self, n: int) -> None:
        self.left -= n
        if self.left < 0:
            raise Refused(BOMB)


def text_regions(xml: str, path: str, order: int, tags: Sequence[str], group: str) -> Iterator[Region]:
    """Text nodes of the named elements; nodes after the same number of group elements belong together."""
    starts = [m.start() for m in re.finditer(f"<{re.escape(group)}\\b", xml)]
    for tag in tags:
        for m in re.finditer(f"<{re.escape(tag)}\\b[^>]*>([\\s\\S]*?)</{re.escape(tag)}>", xml):
            yield Region(path, m.start(1), m.end(1), (order, "text", bisect_left(starts, m.start())), files.decoded(m[1]))


def whole_value(value: str) -> bool:
    """Whether some rule takes the whole of a value."""
    return any(s[:2] == (0, len(value)) for s in recognizers.found(value))


def number_value(raw: str) -> str | None:
    """The value that a numeric cell stands for if a rule takes it whole: a lost leading zero comes back first."""
    return next((v for v in ((f"0{raw}", raw) if re.fullmatch("[0-9]{8,9}", raw) else (raw,)) if whole_value(v)), None)


def number_regions(xml: str, path: str, order: int) -> Iterator[Region]:
    """Numeric cells that hold a value of a rule, and all cells of formulas with their last result; shared strings stay as they are."""
    n = 0
    for m in re.finditer(r"<c\b[^>]*?(?:/>|>[\s\S]*?</c>)", xml):
        cell = m[0]
        if cell.endswith("/>"):
            continue
        attributes, inner = cell[2 : cell.index(">")], cell[cell.index(">") + 1 : -4]
        value, kind = re.search(r"<v>([\s\S]*?)</v>", inner), re.search(r'\bt="([^"]*)"', attributes)
        if value is None or kind and kind[1] == "s":
            continue
        formula, plain = re.search(r"<f[\s>/]", inner) is not None, files.decoded(value[1])
        known = number_value(plain)
        if known is not None or formula:
            yield Region(path, m.start(), m.end(), (order, "number", n), known if known is not None else plain, re.sub(r'\s+t="[^"]*"', "", attributes), formula)
            n += 1


def overlaid(text: str, segments: Sequence[tuple[int, int]], spans: Sequence[document.Span], key: Sequence[tuple[str, str, str]]) -> list[str]:
    """Each segment's new text; a placeholder stands in the segment where its value begins. Spans are in order and apart."""
    tokens = {(token[1:].rsplit("_", 1)[0], value): token for token, value, _ in key}
    out, first = [], 0
    for start, end in segments:
        parts, at = [], start
        while first < len(spans) and spans[first][1] <= start:
            first += 1
        for a, b, kind, _, label in spans[first:]:
            if a >= end:
                break
            if a >= start:
                parts += [text[at:a], tokens[label or document.LABEL.get(kind, kind), text[a:b]]]
            at = max(at, min(b, end))
        out.append("".join([*parts, text[at:end]]))
    return out


def masked_parts(parts: dict[str, str], classes: dict[str, tuple[int, Parts]], anonymize: Anonymize) -> tuple[dict[str, str], tuple]:
    """The parts with every region masked as one text: groups are apart by a line feed, so that nothing is found across them."""
    regions: list[Region] = []
    for order, (path, xml) in enumerate(parts.items()):
        kind = classes[path][1]
        own = [*text_regions(xml, path, order, kind.tags, kind.group), *(number_regions(xml, path, order) if kind.numbers else ())]
        regions += sorted(own, key=lambda r: r.start)
    pieces, segments, at = [], [], 0
    for k, r in enumerate(regions):
        if k and r.group != regions[k - 1].group:
            pieces.append("\n")
            at += 1
        pieces.append(r.text)
        segments.append((at, at + len(r.text)))
        at += len(r.text)
    text = "".join(pieces)
    result = verify.healed(text, anonymize(text))
    fresh = overlaid(text, segments, result[0], result[1])
    out = dict(parts)
    for r, new in sorted(zip(regions, fresh), key=lambda x: (x[0].path, -x[0].start)):
        if new != r.text:
            if r.formula:
                raise Refused(FORMULA)
            put = files.encoded(new) if r.cell is None else f'<c{r.cell} t="inlineStr"><is><t xml:space="preserve">{files.encoded(new)}</t></is></c>'
            out[r.path] = out[r.path][: r.start] + put + out[r.path][r.end :]
    return out, result


def sanitised(path: str, xml: str) -> str:
    """A part without the metadata that names people or echoes the content; comment bodies are masked, not blanked."""
    for pattern, tags in BLANK_TEXT:
        if re.fullmatch(pattern, path):
            for tag in tags:
                xml = re.sub(f"(<{tag}\\b[^>]*>)[\\s\\S]*?(</{tag}>)", r"\1\2", xml)
    for pattern, names in BLANK_ATTRIBUTES:
        if re.fullmatch(pattern, path):
            for name in names:
                xml = re.sub(f'{name}="[^"]*"', f'{name}=""', xml)
    return THUMBNAIL_LINK.sub("", xml) if path == "_rels/.rels" else xml


def embedded_leaks(name: str, content: bytes, needles: list[str], anonymize: Anonymize, budget: Budget) -> bool:
    """Whether an embedded object holds anything personal: Office files by detection, others by the bytes of known values."""
    budget.take(len(content))
    if NESTED.fullmatch(name):
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                texts = []
                for info in z.infolist():
                    if TEXT_PART.fullmatch(info.filename):
                        budget.take(info.file_size)
                        texts.append(files.decoded(z.read(info).decode("utf-8", "replace")))
            return bool(anonymize("\n".join(texts))[1])
        except zipfile.BadZipFile:
            pass
    return bool(verify.bytes_hold(content, needles))


def redacted(content: bytes, kind: str, anonymize: Anonymize = deterministic, most: int = files.MOST_INFLATED) -> tuple[bytes, str, list[tuple[str, str, str]]]:
    """A docx or xlsx masked: content, masked text, key. Raises Refused where a value would survive."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            budget = Budget(most)
            infos = [i for i in z.infolist() if not i.is_dir()]
            budget.take(sum(i.file_size for i in infos if TEXT_PART.fullmatch(i.filename)))
            raw = {i.filename: z.read(i) for i in infos}
    except zipfile.BadZipFile as e:
        raise Refused(BROKEN) from e
    classes = {}
    for name in raw:
        for c in PARTS[kind]:
            if m := re.fullmatch(c.pattern, name):
                classes[name] = (c.first + int(m[1] or 0) if m.groups() else c.first, c)
    names = sorted(classes, key=lambda n: classes[n][0])
    parts, result = masked_parts({n: raw[n].decode("utf-8") for n in names}, classes, anonymize)
    out = raw | {n: x.encode() for n, x in parts.items()}
    thumbnails = [n for n in out if THUMBNAIL.fullmatch(n)]
    for n in thumbnails:
        del out[n]
    for n in out:
        if TEXT_PART.fullmatch(n) and (n != "_rels/.rels" or thumbnails):
            out[n] = sanitised(n, out[n].decode("utf-8", "replace")).encode() if out[n] else out[n]
    needles = [k[1] for k in result[1]]
    hits = [f"{n}: {v}" for n, x in out.items() if TEXT_PART.fullmatch(n) for v in verify.plain_part_leaks(files.decoded(x.decode("utf-8", "replace")), needles)]
    if hits:
        raise Refused(f"{FAILED}: {', '.join(hits)}")
    for n, x in out.items():
        if (NESTED.fullmatch(n) or OPAQUE.fullmatch(n)) and embedded_leaks(n, x, needles, anonymize, budget):
            raise Refused(f"{FAILED}: embedded {n}")
    file = io.BytesIO()
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
        for n, x in out.items():
            z.writestr(n, x)
    return file.getvalue(), result[2], result[1]


def redacted_file(name: str, content: bytes, anonymize: Anonymize = deterministic) -> tuple[bytes | None, str | None, list[tuple[str, str, str]], str | None]:
    """By kind of file: content, masked text, key, error code. PDF needs a library that isn't here; other kinds can't be read."""
    kind = name.lower().rsplit(".", 1)[-1]
    try:
        if kind in PARTS:
            return *redacted(content, kind, anonymize), None
        if kind in ("txt", "csv"):
            _, key, out = anonymize(content.decode("utf-8", "replace"))
            return out.encode(), out, key, None
        raise Refused(LEGACY if kind == "xls" else "UNSUPPORTED")
    except Refused as e:
        return None, None, [], str(e)


def restored(content: bytes, key: dict[str, str]) -> bytes:
    """An Office file with its placeholders replaced: in each node first, then those that Word has split over nodes of a paragraph, string or cell."""
    def one(text: str) -> str:
        return document.TOKEN.sub(lambda m: key.get(document.plain_token(m[0]), m[0]), text)

    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as src, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as dst:
        for info in src.infolist():
            raw = src.read(info)
            if files.DOCX_PART.fullmatch(info.filename) or files.XLSX_PART.fullmatch(info.filename):
                xml = files.TEXT_NODE.sub(lambda m: m[1] + files.encoded(one(files.decoded(m[3]))) + m[4] if "[" in m[3] else m[0], raw.decode("utf-8"))
                raw = files.changed_blocks(xml, one, only="[").encode()
            dst.writestr(info, raw)
    return out.getvalue()


_RESULT = K.StructType([
    K.StructField("redacted", K.BinaryType()), K.StructField("text", K.StringType()),
    K.StructField("key", K.ArrayType(K.StructType([K.StructField(c, K.StringType()) for c in ("placeholder", "original", "type")]))), K.StructField("error", K.StringType()),
])


def redact_files(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Adds redacted (bytes), text (masked), key and error (why a file is refused) to rows of files."""

    @F.pandas_udf(_RESULT)
    def run(paths: pd.Series, contents: pd.Series) -> pd.DataFrame:
        rows = []
        for p, c in zip(paths, contents):
            data, text, key, error = redacted_file(p or "", c) if c is not None else (None, None, [], BROKEN)
            rows.append((data, text, [dict(zip(("placeholder", "original", "type"), k)) for k in key], error))
        return pd.DataFrame(rows, columns=["redacted", "text", "key", "error"])

    return df.withColumn("_file", run(F.col(path), F.col(content))).select(*df.columns, "_file.*")


def restore_files(df: DataFrame, content: str, key: str) -> DataFrame:
    """Adds restored: Office files with the placeholders of the array column ``key`` replaced; of equal ones the last row holds."""

    @F.pandas_udf(K.BinaryType())
    def run(contents: pd.Series, keys: pd.Series) -> pd.Series:
        one = lambda c, k: None if c is None else restored(c, {document.plain_token(r["placeholder"]): r["original"] for r in (k if k is not None else [])})
        return pd.Series([one(c, k) for c, k in zip(contents, keys)], dtype=object)

    return df.withColumn("restored", run(F.col(content), F.col(key)))
