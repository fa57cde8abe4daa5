"""Converters of single files to Markdown: plain functions of bytes, run by Arrow batch."""

from __future__ import annotations

import csv
import io
import json
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Callable
from html.parser import HTMLParser
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import formats
from .arrow import bound_batches, map_pieces


class ConversionError(ValueError):
    """A file that can't be converted; its message goes into the result."""


_SILENT = {"script", "style", "head", "template", "noscript", "svg"}
_BLOCKS = {"p", "div", "section", "article", "header", "footer", "main", "aside", "nav", "ul", "ol", "table", "blockquote", "pre", "form", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "dl", "dt", "dd"}


class _Markdown(HTMLParser):
    """Headings, paragraphs, lists, links, emphasis, code and tables as Markdown; unclosed tags end with their block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.line: list[str] = []
        self.prefix, self.silent, self.lists, self.links, self.cells, self.pre = "", 0, [], [], None, False
        self.heads = False

    def flush(self) -> None:
        text = "".join(self.line)
        text = text.strip("\n") if self.pre else re.sub(r"[ \t\r\f]*\n[ \t\r\f]*", "\n", re.sub(r"[ \t\r\f]+", " ", text)).strip()
        if text:
            self.blocks.append(f"{self.prefix}{text}" if not self.pre else f"```\n{text}\n```")
        self.line, self.prefix = [], ""

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
            return
        if self.silent:
            return
        if tag in _BLOCKS and self.cells is None or tag in ("table", "tr"):
            self.flush()
        if re.fullmatch("h[1-6]", tag):
            self.prefix = "#" * int(tag[1]) + " "
        elif tag == "blockquote":
            self.prefix = "> "
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li":
            self.flush()
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.prefix = "  " * (len(self.lists) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "* ")
        elif tag == "br":
            self.line.append("\n")
        elif tag in ("b", "strong"):
            self.line.append("**")
        elif tag in ("i", "em"):
            self.line.append("*")
        elif tag == "code" and not self.pre:
            self.line.append("`")
        elif tag == "pre":
            self.pre = True
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.line.append("[")
        elif tag == "img":
            a = dict(attrs)
            self.line.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag == "hr":
            self.flush()
            self.blocks.append("---")
        elif tag == "tr":
            self.cells = []
        elif tag in ("td", "th"):
            self.line = []

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
            return
        if self.silent:
            return
        if tag in ("b", "strong"):
            self.line.append("**")
        elif tag in ("i", "em"):
            self.line.append("*")
        elif tag == "code" and not self.pre:
            self.line.append("`")
        elif tag == "a" and self.links:
            self.line.append(f"]({self.links.pop()})")
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append(" ".join("".join(self.line).split()).replace("|", "\\|"))
            self.line = []
        elif tag == "tr" and self.cells is not None:
            row, self.cells, self.line = self.cells, None, []
            if row:
                self.blocks.append("| " + " | ".join(row) + " |" + ("" if self.heads else "\n|" + " --- |" * len(row)))
                self.heads = True
        elif tag in _BLOCKS or tag == "li":
            self.flush()
            if tag == "pre":
                self.pre = False
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
            if tag == "table":
                self.heads = False

    def handle_data(self, data):
        if not self.silent:
            self.line.append(data if self.pre else data.replace("\n", " "))

    def result(self) -> str:
        self.close()
        self.flush()
        out = ""
        for i, b in enumerate(self.blocks):
            tight = i and ((b.startswith("|") and self.blocks[i - 1].startswith("|")) or (re.match(r"\s*(\*|\d+\.) ", b) and re.match(r"\s*(\*|\d+\.) ", self.blocks[i - 1])))
            out += ("" if not i else "\n" if tight else "\n\n") + b
        return re.sub(r"\*\*\s*\*\*", "", out).strip()


def html_to_markdown(text: str) -> str:
    parser = _Markdown()
    parser.feed(text)
    return parser.result()


def decode(raw: bytes) -> str:
    for name in ("utf-8-sig", "cp1252"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


def table(rows: list[list[str]]) -> str:
    if not rows:
        return ""
    width = max(map(len, rows))
    clean = [[re.sub(r"\s+", " ", c).strip().replace("|", "\\|") for c in r] + [""] * (width - len(r)) for r in rows]
    lines = ["| " + " | ".join(r) + " |" for r in clean]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def csv_to_markdown(raw: bytes) -> str:
    return table(list(csv.reader(io.StringIO(decode(raw)))))


def notebook_to_markdown(raw: bytes) -> str:
    out = []
    for cell in json.loads(decode(raw)).get("cells", []):
        source = cell.get("source", "")
        text = "".join(source) if isinstance(source, list) else source
        out.append(f"```python\n{text}\n```" if cell.get("cell_type") == "code" else text)
    return "\n\n".join(x for x in out if x)


def vtt_to_markdown(raw: bytes) -> str:
    lines = [x.strip() for x in decode(raw).splitlines()]
    return "\n\n".join(x for x in lines if x and x != "WEBVTT" and not x.isdigit() and "-->" not in x)


def _zip(raw: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(raw))
    except (zipfile.BadZipFile, ValueError) as e:
        raise ConversionError(f"File is not a zip file: {e}") from e


def _xml(z: zipfile.ZipFile, name: str):
    try:
        return ElementTree.fromstring(z.read(name))
    except (KeyError, ElementTree.ParseError) as e:
        raise ConversionError(f"broken part {name}: {e}") from e


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(node, tag: str = "t") -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x.tag) == tag)


def docx_to_markdown(raw: bytes) -> str:
    z = _zip(raw)
    body = next(x for x in _xml(z, "word/document.xml").iter() if _local(x.tag) == "body")
    out = []
    for node in body:
        if _local(node.tag) == "p":
            style = next((v for x in node.iter() if _local(x.tag) == "pStyle" for k, v in x.attrib.items() if _local(k) == "val"), "")
            level = re.fullmatch(r"[Hh]eading\s?([1-6])", style)
            text = _texts(node).strip()
            if text:
                out.append(("#" * int(level[1]) + " " if level else "# " if style == "Title" else "") + text)
        elif _local(node.tag) == "tbl":
            out.append(table([[_texts(c) for c in r if _local(c.tag) == "tc"] for r in node if _local(r.tag) == "tr"]))
    return "\n\n".join(out)


def pptx_to_markdown(raw: bytes) -> str:
    z = _zip(raw)
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
    out = []
    for i, name in enumerate(slides, 1):
        lines = [t for p in _xml(z, name).iter() if _local(p.tag) == "p" and (t := _texts(p).strip())]
        out.append("\n".join([f"<!-- Slide number: {i} -->", *lines]))
    return "\n\n".join(out)


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def xlsx_to_markdown(raw: bytes) -> str:
    z = _zip(raw)
    shared = [_texts(x) for x in _xml(z, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
    names = [x.attrib.get("name", "") for x in _xml(z, "xl/workbook.xml").iter() if _local(x.tag) == "sheet"]
    sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
    out = []
    for i, name in enumerate(sheets):
        rows = []
        for r in (x for x in _xml(z, name).iter() if _local(x.tag) == "row"):
            cells: list[str] = []
            for c in r:
                at = _column(c.attrib.get("r", "")) or len(cells) + 1
                value = next((x.text or "" for x in c if _local(x.tag) == "v"), _texts(c))
                if c.attrib.get("t") == "s" and value.isdigit() and int(value) < len(shared):
                    value = shared[int(value)]
                cells += [""] * (at - 1 - len(cells)) + [value]
            rows.append(cells)
        out.append(f"## {names[i] if i < len(names) else f'Sheet{i + 1}'}\n\n{table(rows)}".rstrip())
    return "\n\n".join(out)


def epub_to_markdown(raw: bytes) -> str:
    z = _zip(raw)
    top = next((x.attrib.get("full-path") for x in _xml(z, "META-INF/container.xml").iter() if _local(x.tag) == "rootfile"), None)
    if not top:
        raise ConversionError("no package in this EPUB")
    package, where = _xml(z, top), posixpath.dirname(top)
    items = {x.attrib.get("id"): x.attrib.get("href", "") for x in package.iter() if _local(x.tag) == "item"}
    spine = [items.get(x.attrib.get("idref")) for x in package.iter() if _local(x.tag) == "itemref"]
    pages = [posixpath.normpath(posixpath.join(where, h)) for h in spine if h]
    return "\n\n".join(html_to_markdown(decode(z.read(p))) for p in pages if p in z.namelist())


def pdf_pages(raw: bytes) -> int:
    return len(re.findall(rb"/Type\s*/Page(?![a-zA-Z])", raw))


def pdf_to_markdown(raw: bytes) -> str:
    """Text shown by the content streams of a simple PDF (no encryption, standard encodings)."""
    if not raw.lstrip().startswith(b"%PDF"):
        raise ConversionError("not a PDF file")
    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)endstream", raw, re.S):
        data = m[1]
        try:
            data = zlib.decompressobj().decompress(data)  # leaves the line feed behind the data alone
        except zlib.error:
            pass
        for block in re.findall(rb"\bBT\b((?:\((?:\\.|[^\\)])*\)|[^(])*?)\bET\b", data, re.S):
            line = []
            for piece in re.finditer(rb"\(((?:\\.|[^\\)])*)\)|(T\*|Td|TD|'|\")", block, re.S):
                if piece[2]:
                    line.append("\n")
                else:
                    raw_text = re.sub(rb"\\([nrtbf()\\])", lambda k: {b"n": b"\n", b"r": b"\r", b"t": b"\t"}.get(k[1], k[1]), piece[1])
                    line.append(re.sub(rb"\\([0-7]{1,3})", lambda k: bytes([int(k[1], 8) & 255]), raw_text).decode("cp1252", "replace"))
            text = re.sub(r"\n+", "\n", "".join(line)).strip()
            if text:
                out.append(text)
    return "\n\n".join(out)


def _refuse(kind: str):
    def convert(raw: bytes) -> str:
        raise ConversionError(f"{kind} files need a reader that isn't available here")

    return convert


CONVERTERS = {
    ".html": lambda raw: html_to_markdown(decode(raw)),
    ".htm": lambda raw: html_to_markdown(decode(raw)),
    ".vtt": vtt_to_markdown,
    ".ipynb": notebook_to_markdown,
    ".csv": csv_to_markdown,
    ".txt": decode,
    ".md": decode,
    ".json": decode,
    ".docx": docx_to_markdown,
    ".pptx": pptx_to_markdown,
    ".xlsx": xlsx_to_markdown,
    ".epub": epub_to_markdown,
    ".pdf": pdf_to_markdown,
    ".xls": _refuse("Old Excel"),
    ".msg": _refuse("Outlook"),
}


def suffix(name: str) -> str:
    return posixpath.splitext(posixpath.basename(name))[1].lower()


def member_skip(name: str, size: int) -> str | None:
    """Why a member of an archive is left out, 'silent' if without a word, or None."""
    base, ext = posixpath.basename(name), suffix(name)
    if not base or base.startswith(("~$", ".")):
        return "silent"
    for why, out in (("nested archive", ext == ".zip"), ("audio/video skipped in archives", ext in formats.MEDIA), ("unsupported type", ext not in formats.CONVERTIBLE), ("exceeds size cap", size > formats.ZIP_MAX_ENTRY)):
        if out:
            return why
    return None


def archive_to_markdown(name: str, raw: bytes) -> str:
    """Every member that converts, and the list of those that don't."""
    z = _zip(raw)
    members = [m for m in z.infolist() if not m.is_dir()]
    if len(members) > formats.ZIP_MAX_ENTRIES:
        raise ConversionError(f"Archive has {len(members)} entries; limit is {formats.ZIP_MAX_ENTRIES}")
    total = sum(m.file_size for m in members)
    if total > formats.ZIP_MAX_TOTAL:
        raise ConversionError(f"Archive expands to {total >> 20} MB; limit is {formats.ZIP_MAX_TOTAL >> 20} MB")
    parts, skipped = [f"# Archive: {posixpath.basename(name)}"], []
    for m in members:
        why = member_skip(m.filename, m.file_size)
        if why == "silent":
            continue
        if why is None:
            with z.open(m) as f:
                body = f.read(formats.ZIP_MAX_ENTRY + 1)
            if len(body) > formats.ZIP_MAX_ENTRY:
                raise ConversionError(f"Archive entry {m.filename} exceeds the size cap while decompressing")
            try:
                parts.append(f"\n---\n## {m.filename}\n\n{CONVERTERS[suffix(m.filename)](body)}")
                continue
            except Exception as e:  # noqa: BLE001  one broken member doesn't end the archive
                why = f"conversion failed: {e}"
        skipped.append(f"{m.filename} ({why})")
    if skipped:
        more = f" and {len(skipped) - 20} more" if len(skipped) > 20 else ""
        parts.append(f"\n---\n*Skipped entries:* {', '.join(skipped[:20])}{more}")
    return "\n".join(parts)


def image_size(raw: bytes) -> tuple[int, int]:
    """Width and height of a PNG, GIF, BMP, JPEG, TIFF or WebP; (0, 0) if unknown."""
    try:
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", raw[16:24])
        if raw[:4] == b"GIF8":
            return struct.unpack("<HH", raw[6:10])
        if raw[:2] == b"BM":
            w, h = struct.unpack("<ii", raw[18:26])
            return w, abs(h)
        if raw[:4] == b"RIFF" and raw[8:12] == b"WEBP":
            if raw[12:16] == b"VP8X":
                return 1 + int.from_bytes(raw[24:27], "little"), 1 + int.from_bytes(raw[27:30], "little")
            if raw[12:16] == b"VP8L":
                bits = int.from_bytes(raw[21:25], "little")
                return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
            w, h = struct.unpack("<HH", raw[26:30])
            return w & 0x3FFF, h & 0x3FFF
        if raw[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(raw):
                if raw[at] != 0xFF:
                    at += 1
                    continue
                kind = raw[at + 1]
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", raw[at + 5 : at + 9])
                    return w, h
                at += 2 if kind in (0x01, 0xFF) or 0xD0 <= kind <= 0xD9 else 2 + struct.unpack(">H", raw[at + 2 : at + 4])[0]
    except (struct.error, IndexError):
        pass
    return 0, 0


def unread_images(ext: str, raw: bytes, text: str | None) -> int:
    """Images that recognition would read: embedded ones of 10,000 pixels or more; a PDF's pages when it has hardly any text."""
    try:
        if ext in (".pptx", ".docx", ".xlsx"):
            z = zipfile.ZipFile(io.BytesIO(raw))
            sizes = (image_size(z.read(n)) for n in z.namelist() if "/media/" in n and n.lower().endswith(tuple(formats.EMBEDDED_IMAGES)))
            return sum(w * h >= 10_000 for w, h in sizes)
        if ext == ".pdf":
            n = pdf_pages(raw)
            return n if n and len(text or "") < n * 100 else 0
    except Exception:  # noqa: BLE001  a count must never end a conversion
        pass
    return 0


RESULT = "markdown string, error string, pages int, unread int, members array<struct<name:string,size:long>>"


def convert_files(files: DataFrame, allow_zip: bool = False, ocr: bool = False, pictures: Callable[[], Callable] | None = None) -> DataFrame:
    """(path, n_bytes, content) to path, n_bytes, markdown, error, pages, unread images and zip members, one row for each row.

    Files that the routes refuse get their error as a column and their contents never reach Python.  All is one pass:
    contents may be dear to read or make.  pictures: called once in a task; gives a function from a path and contents to
    what the file's images say, (name, text, error) each, as a further column ``pictures`` of images and documents.
    """
    routed = files.select("path", F.col("n_bytes").cast("long").alias("n_bytes"), "content").withColumn("r_", formats.route(F.col("path"), allow_zip, ocr)).withColumn("route", F.col("r_.route")).withColumn("refused", F.col("r_.error")).drop("r_")
    asked = F.when(F.col("route") == "speech", F.lit("The speech model is missing: words and turns are read from tables")).otherwise(F.lit("No readable text found in this image"))
    todo = F.coalesce(F.col("route").isin("document", "vtt", "zip", *(["ocr"] if pictures else [])), F.lit(False))
    sent = routed.select("path", F.when(todo, F.col("content")).alias("content"), "n_bytes", F.when(~todo, F.coalesce("refused", asked)).alias("refused"))

    def run(batches):
        import pyarrow as pa

        member = pa.struct([("name", pa.string()), ("size", pa.int64())])
        picture = pa.struct([("name", pa.string()), ("text", pa.string()), ("error", pa.string())])
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(member), *([pa.list_(picture)] if pictures else [])]
        said = pictures() if pictures else None
        for b in batches:
            rows = []
            for path, raw, refused in zip(*(b.column(k).to_pylist() for k in (0, 1, 3))):
                if refused is not None:
                    rows.append((None, refused, None, 0, None, None))
                    continue
                ext, text, error, members = suffix(path), None, None, None
                found = [dict(zip(("name", "text", "error"), x)) for x in said(path, raw)] if said else None
                if ext in formats.IMAGES:
                    rows.append((None, None, None, 0, None, found))
                    continue
                try:
                    text = archive_to_markdown(path, raw) if ext == ".zip" else CONVERTERS[ext](raw)
                except Exception as e:  # noqa: BLE001  one broken file is one error row
                    error = str(e) or type(e).__name__
                if ext in (".docx", ".xlsx", ".pptx", ".epub"):
                    try:
                        members = [{"name": i.filename, "size": i.file_size} for i in zipfile.ZipFile(io.BytesIO(raw)).infolist()]
                    except zipfile.BadZipFile:
                        pass
                read = said and error is None and ext in (".docx", ".pptx", ".xlsx")
                rows.append((text, error, pdf_pages(raw) if ext == ".pdf" else None, 0 if read else unread_images(ext, raw, text), members, found))
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *made], ["path", "n_bytes", "markdown", "error", "pages", "unread", "members", "pictures"][: 2 + len(made)])

    return map_pieces(sent, run, f"path string, n_bytes long, {RESULT}" + (", pictures array<struct<name:string,text:string,error:string>>" if pictures else ""))


def html_column(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds markdown made of an HTML column."""
    from pyspark.sql.functions import pandas_udf

    bound_batches(pages.sparkSession)

    @pandas_udf("string")
    def convert(s):
        return s.map(lambda t: html_to_markdown(t) if t is not None else None)

    return pages.withColumn("markdown", convert(F.col(html_col)))


def html_text(text):
    """A native rendering of well-formed pages: scripts and styles go, blocks become paragraphs, headings keep their level, the commonest entities are read."""
    t = F.regexp_replace(text, r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>", "")
    t = F.regexp_replace(t, r"\s+", " ")
    for n in range(1, 7):
        t = F.regexp_replace(t, rf"(?i)<h{n}\b[^>]*>", "\n\n" + "#" * n + " ")
    t = F.regexp_replace(t, r"(?i)<li\b[^>]*>", "\n* ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"(?i)</?(b|strong)\b[^>]*>", "**")
    t = F.regexp_replace(t, r"(?i)</?(p|div|article|section|h[1-6]|ul|ol|nav|footer|header|table|tr)\b[^>]*>", "\n\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(t, r" *\n *", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


