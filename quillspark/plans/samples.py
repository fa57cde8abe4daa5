"""Files and media made of table rows, so that converters and probes meet real bytes in queries whose results SQL can tell."""

from __future__ import annotations

import html
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
#: Of each kind what stands before and after the body (in the one file, or in the archive's member of that name).
TEXT = {
    ".txt": ("", ""),
    ".md": ("# T\n\n", ""),
    ".csv": ("a,b\n1,", "\n"),
    ".html": ("<html><body><h1>T</h1><p>", "</p></body></html>"),
    ".vtt": ("WEBVTT\n\n1\n00:01 --> 00:02\nx ", "\n"),
    ".ipynb": ('{"cells": [{"cell_type": "markdown", "source": ["', '"]}, {"cell_type": "code", "source": ["print(1)"]}]}'),
}
ZIPPED = {
    ".docx": ("word/document.xml", f'<w:document xmlns:w="{W}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>', "</w:t></w:r></w:p></w:body></w:document>"),
    ".xlsx": ("xl/sharedStrings.xml", "<s><si><t>Name</t></si><si><t>", "</t></si></s>"),
    ".epub": ("OPS/a.xhtml", "<html><body><p>", "</p></body></html>"),
    ".pptx": ("ppt/slides/slide1.xml", '<sld xmlns:a="u"><a:p><a:r><a:t>', "</a:t></a:r></a:p></sld>"),
    ".zip": ("a.txt", "", ""),
}
#: Further members of archives.
REST = {
    ".docx": {},
    ".xlsx": {"xl/workbook.xml": '<w><sheets><sheet name="One"/></sheets></w>', "xl/worksheets/sheet1.xml": '<w><row><c r="A1" t="s"><v>0</v></c></row><row><c r="A2" t="s"><v>1</v></c></row></w>'},
    ".epub": {"META-INF/container.xml": '<c><rootfile full-path="OPS/p.opf"/></c>', "OPS/p.opf": '<p><item id="x" href="a.xhtml"/><itemref idref="x"/></p>'},
    ".pptx": {},
    ".zip": {"s.mp3": "x", "t.exe": "x"},
}
KINDS = [*TEXT, *ZIPPED, ".pdf"]
#: A picture of 200 x 100 (only its header), which recognition would have to read.
PICTURE = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 200, 100) + b"\x08\x02\0\0\0"


def made_file(kind: str, body: str) -> bytes:
    if kind in TEXT:
        before, after = TEXT[kind]
        return (before + body + after).encode()
    if kind == ".pdf":
        return b"%PDF-1.4\n1 0 obj <</Type /Page>> endobj\n2 0 obj <</Type /Page>> endobj\nstream\n" + zlib.compress(f"BT ({body}) Tj ET".encode()) + b"\nendstream"
    name, before, after = ZIPPED[kind]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, before + body + after)
        for other, text in REST[kind].items():
            z.writestr(other, text)
        if kind == ".docx":
            z.writestr("word/media/a.png", PICTURE)
    return out.getvalue()


#: How a body is written inside each kind.
WRITTEN = {
    ".csv": lambda b: '"' + b.replace('"', '""') + '"',
    ".ipynb": lambda b: json.dumps(b, ensure_ascii=False)[1:-1],
    **dict.fromkeys([".html", ".epub", ".docx", ".xlsx", ".pptx"], html.escape),
}


def whole_file(kind: str, body: str) -> bytes:
    """A file with the whole body, whatever characters it has."""
    if kind == ".json":
        return json.dumps({"text": body}, ensure_ascii=False).encode()
    if kind == ".pdf":  # every second byte in octal, as writers may
        raw = body.encode("cp1252", "replace")
        shown = b"".join(b"\\%03o" % c if i % 2 or c > 126 else b"\\" + bytes([c]) if c in b"()\\" else bytes([c]) for i, c in enumerate(raw))
        return b"%PDF-1.4\n1 0 obj <</Type /Page>> endobj\nstream\n" + zlib.compress(b"BT (" + shown + b") Tj ET") + b"\nendstream"
    return made_file(kind, WRITTEN.get(kind, str)(body))


def pictured_file(kind: str, body: str, texts: list[str]) -> bytes:
    """A document with pictures, or one picture; ``read_picture`` reads what is written behind a picture's header."""
    pictures = [PICTURE + t.encode() for t in texts]
    if kind == ".png":
        return pictures[0]
    out = io.BytesIO(made_file(kind, body))
    with zipfile.ZipFile(out, "a") as z:
        for i, p in enumerate(pictures):
            z.writestr(f"ppt/media/image{i}.png", p)
    return out.getvalue()


def read_picture(raw: bytes) -> Iterator[tuple[list[list[float]], str, float]]:
    """A box for each word, the last one uppermost; words with a digit are hardly legible."""
    words = raw[len(PICTURE) :].decode().split(" ")
    for y, w in zip(range(len(words), 0, -1), words):
        yield [[0.0, float(y)], [9.0, y + 1.0]], w, 0.4 if not w.isalpha() and any(c.isdigit() for c in w) else 0.9


def _box(name: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), name) + body


def made_media(kind: int, ms: int) -> bytes:
    """A file of ``ms`` milliseconds (0: WAV, 1: FLAC, 2: Ogg Opus, 3: film without sound, 4: sound in MP4, 5: Matroska), or junk."""
    if kind == 0:
        data = b"data" + struct.pack("<I", ms * 16) + bytes(16)  # 8 kHz, 16 bits; the samples are left out
        return b"RIFF" + struct.pack("<I", 36) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16_000, 2, 16) + data
    if kind == 1:
        return b"fLaC" + bytes(14) + ((8000 << 44) | ms * 8).to_bytes(8, "big") + bytes(16)
    if kind == 2:
        return b"OggS" + bytes(2) + struct.pack("<q", 0) + bytes(20) + b"OpusHead\x01\x02" + struct.pack("<H", 312) + bytes(20) + b"OggS" + bytes(2) + struct.pack("<q", ms * 48 + 312) + bytes(10)
    if kind in (3, 4):
        clock = bytes(12) + struct.pack(">II", 1000, ms)
        track = _box(b"trak", _box(b"mdia", _box(b"mdhd", clock), _box(b"hdlr", bytes(8) + (b"vide" if kind == 3 else b"soun"))))
        return _box(b"ftyp", b"isom") + _box(b"moov", _box(b"mvhd", clock), track)
    if kind == 5:
        return b"\x1a\x45\xdf\xa3\x80" + b"\x18\x53\x80\x67\xff" + b"\x15\x49\xa9\x66" + bytes([0x80 | 11]) + b"\x44\x89\x88" + struct.pack(">d", float(ms)) + b"\x16\x54\xae\x6b" + bytes([0x80 | 5]) + b"\xae\x83\x83\x81\x02"
    return json.dumps({"junk": ms}).encode()
