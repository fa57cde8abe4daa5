import io
import json
import math
import struct
import zipfile
import zlib

import numpy as np
from pyspark.sql import functions as F

from quillspark.operators import batch as B
from quillspark.plans.prepare import Options, prepare
from quillspark.sources import convert, media, scan


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


HTML = b"<html><head><style>p{}</style></head><body><h1>Title &amp; more</h1><p>Mail a@b.org <b>now</b></p>" + b"<p style='color:red;margin:0'>Line of text</p>" * 30 + b"</body></html>"
PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 500, 160) + b"\x08\x02\0\0\0"
PDF = b"%PDF-1.4\n" + b"".join(b"%d 0 obj <</Type /Page>> endobj\n" % i for i in range(3)) + b"<</Type /Pages>>\nstream\n" + zlib.compress(b"BT (Hello \\(PDF\\)) Tj ET") + b"\nendstream"
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
DOCX = zipped({"word/document.xml": f'<w:document xmlns:w="{W}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>'})
PPTX = zipped({f"ppt/slides/slide{i}.xml": f'<p xmlns:a="u"><a:p><a:t>Slide {i}</a:t></a:p></p>' for i in range(1, 6)} | {"ppt/media/a.png": PNG, "ppt/media/b.png": PNG[:16] + struct.pack(">II", 24, 24)})
XLSX = zipped({"xl/workbook.xml": '<w><sheets><sheet name="One"/></sheets></w>', "xl/sharedStrings.xml": "<s><si><t>Name</t></si></s>", "xl/worksheets/sheet1.xml": '<w><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row></w>'})
EPUB = zipped({"META-INF/container.xml": '<c><rootfile full-path="OPS/p.opf"/></c>', "OPS/p.opf": '<p><item id="x" href="a.xhtml"/><itemref idref="x"/></p>', "OPS/a.xhtml": "<p>The lighthouse keeper</p>"})
NOTEBOOK = json.dumps({"cells": [{"cell_type": "markdown", "source": ["# Notes\n", "text"]}, {"cell_type": "code", "source": ["print(1)"]}]}).encode()
BUNDLE = zipped({"a.html": "<p>mail a@b.org</p>", "s.mp3": "x", "t.exe": "x", "n.zip": "x", "sub/t.txt": "plain", ".h.txt": "x"})

FILES = {"/in/a.html": HTML, "/in/p.pdf": PDF, "/in/d.docx": DOCX, "/in/d.pptx": PPTX, "/in/x.xlsx": XLSX, "/in/e.epub": EPUB, "/in/n.ipynb": NOTEBOOK, "/in/c.csv": b"a,b\n1,2|3\n", "/in/v.vtt": b"WEBVTT\n\n1\n00:01 --> 00:02\nHi\n", "/in/b.zip": BUNDLE, "/in/o.xls": b"junk", "/in/m.mp3": b"junk", "/in/q.exe": b"x", "/in/i.png": PNG, "/in/broken.docx": b"junk"}


def frame(spark, files):
    return spark.createDataFrame([(p, len(b), bytearray(b)) for p, b in files.items()], "path string, n_bytes long, content binary").repartition(3)


def test_prepare(spark):
    got = {r.path: r for r in prepare(frame(spark, FILES), Options(yaml=True, redact=True, allow_zip=True, stamp="D")).collect()}
    assert len(got) == len(FILES)
    a = got["/in/a.html"]
    assert a.status == "done" and a.markdown.startswith("---\noriginal_filename: a.html\n") and "# Title & more" in a.markdown and "[REDACTED_EMAIL] **now**" in a.markdown and a.source_tokens > a.tokens
    assert "Hello (PDF)" in got["/in/p.pdf"].markdown and got["/in/p.pdf"].source_tokens == 4500 + got["/in/p.pdf"].tokens and got["/in/p.pdf"].unread_images == 3
    assert "# Head\n\nBody" in got["/in/d.docx"].markdown
    assert "Slide 5" in got["/in/d.pptx"].markdown and got["/in/d.pptx"].unread_images == 1 and got["/in/d.pptx"].source_tokens == 7500 + got["/in/d.pptx"].tokens
    assert "| Name |  | 5 |" in got["/in/x.xlsx"].markdown and "lighthouse keeper" in got["/in/e.epub"].markdown
    assert "# Notes\ntext" in got["/in/n.ipynb"].markdown and "print(1)" in got["/in/n.ipynb"].markdown
    assert "| 1 | 2\\|3 |" in got["/in/c.csv"].markdown and got["/in/v.vtt"].markdown.endswith("Hi")
    z = got["/in/b.zip"].markdown
    assert "# Archive: b.zip" in z and "[REDACTED_EMAIL]" in z and "plain" in z and "s.mp3 (audio/video skipped in archives), t.exe (unsupported type), n.zip (nested archive)" in z
    assert "Unsupported file type: .exe" in got["/in/q.exe"].error and "speech model" in got["/in/m.mp3"].error and "OCR" in got["/in/i.png"].error
    assert got["/in/o.xls"].status == got["/in/broken.docx"].status == "error" and "Unsupported" not in got["/in/o.xls"].error
    assert got["/in/d.docx"].output == "/in/d.md" and got["/in/d.pptx"].output == "/in/d (1).md"
    s = B.batch_summary(prepare(frame(spark, FILES), Options(stamp="D"))).first()
    assert (s.converted, s.failed) == (9, 6) and s.src_tokens > s.out_comparable


def test_archive_limits():
    many = zipped({f"{i}.txt": "x" for i in range(201)})
    try:
        convert.archive_to_markdown("m.zip", many)
        raise AssertionError
    except convert.ConversionError as e:
        assert "limit is 200" in str(e)


def test_scan_and_manifest(spark, tmp_path):
    for name in ("a.docx", "B.PDF", "~$t.docx", ".h.pdf", "n.md", "sub/.d/e.docx", "_x.html"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x")
    listed = scan.list_files(spark, [str(tmp_path)])
    names = [r.path[len(str(tmp_path)) + 1 :] for r in scan.scan_listing(listed).collect()]
    assert names == ["B.PDF", "_x.html", "a.docx", "sub/.d/e.docx"]
    outputs = spark.createDataFrame([("/a.html", "/a.md"), ("/b.html", "/b.txt")], "source string, output string")
    at = str(tmp_path / "m.json")
    assert scan.write_manifest(outputs, at) == at and scan.write_manifest(outputs, "/nowhere/m.json") is None
    assert [tuple(r) for r in scan.read_manifest(spark, at).collect()] == [("/a.html", "/a.md")]
    assert scan.read_manifest(spark, str(tmp_path / "none.json")).count() == 0
    out = spark.createDataFrame([(str(tmp_path / "w.md"), "text"), ("/nowhere/w.md", "x")], "output string, markdown string")
    assert {r.written for r in scan.write_markdown(out).collect()} == {True, False} and (tmp_path / "w.md").read_text() == "text"
    assert scan.read_files(spark, str(tmp_path / "w.md")).first().n_bytes == 4


def box(name, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), name) + body


def test_media(spark):
    tone = np.sin(np.arange(32_000) * 2 * math.pi * 440 / 16_000).astype(np.float32)
    wav = media.encode_pcm16(tone)
    flac = b"fLaC" + bytes(14) + ((44_100 << 44) | 88_200).to_bytes(8, "big") + bytes(16)
    opus = b"OggS" + bytes(2) + struct.pack("<q", 0) + bytes(20) + b"OpusHead\x01\x02" + struct.pack("<H", 312) + bytes(20) + b"OggS" + bytes(2) + struct.pack("<q", 96_312) + bytes(10)
    clock = bytes(12) + struct.pack(">II", 1000, 5500)
    movie = box(b"ftyp", b"isom") + box(b"moov", box(b"mvhd", clock), box(b"trak", box(b"mdia", box(b"mdhd", clock), box(b"hdlr", bytes(8) + b"vide"))))
    sound = box(b"ftyp", b"M4A ") + box(b"moov", box(b"trak", box(b"mdia", box(b"mdhd", clock), box(b"hdlr", bytes(8) + b"soun"))))
    ebml = b"\x1a\x45\xdf\xa3\x80" + b"\x18\x53\x80\x67\xff" + b"\x15\x49\xa9\x66" + bytes([0x80 | 11]) + b"\x44\x89\x88" + struct.pack(">d", 2500.0) + b"\x16\x54\xae\x6b" + bytes([0x80 | 5]) + b"\xae\x83\x83\x81\x02"
    mp3 = b"ID3\x03\0\0\0\0\0\x0a" + bytes(10) + b"\xff\xfb\x90\x64" + bytes(15_996)
    aac = b"\xff\xf1\x50\x80" + bytes(100)
    files = {"w": wav, "f": flac, "o": opus, "v": movie, "s": sound, "k": ebml, "m": mp3, "a": aac, "x": b"junk", "e": b""}
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")
    got = {r.path: (r.duration_sec, r.has_audio) for r in media.probe_files(rows).collect()}
    assert got == {"w": (2.0, True), "f": (2.0, True), "o": (2.0, True), "v": (5.5, False), "s": (5.5, True), "k": (2.5, True), "m": (1.0, True), "a": (0.0, False), "x": (0.0, False), "e": (0.0, False)}
    back = {r.path: r for r in media.decode_files(rows).collect()}
    assert np.allclose(back["w"].samples, tone, atol=1e-4) and "decode_error" in back["x"].error
    clip = np.sin(np.arange(12_000) / 10).astype(np.float32)
    assert len(media.pad(media.resample(clip, 48_000))) == 16_000 and len(media.resample(clip, 48_000)) == 4_000
    assert len(media.resample(clip, 8_000)) == 24_000 and abs(len(media.resample(clip, 44_100)) - 4354) <= 1
    assert spark.createDataFrame([([0.0, 0.5],)], "s array<float>").select(media.has_signal(F.col("s"))).first()[0]


def test_image_sizes():
    assert convert.image_size(PNG) == (500, 160)
    assert convert.image_size(b"GIF89a" + struct.pack("<HH", 7, 9)) == (7, 9)
    assert convert.image_size(b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + struct.pack(">HH", 8, 6) + bytes(9)) == (6, 8)
    assert convert.image_size(b"??") == (0, 0)


def test_images_are_read(spark):
    from quillspark.plans import samples
    from quillspark.sources.images import ImageReader

    rows = [("/x/a.png", samples.pictured_file(".png", "", ["one two"])), ("/x/small.png", b"\x89PNG"), ("/x/b.pptx", samples.pictured_file(".pptx", "body", ["seen here", "SEEN HERE", "more words", "no"])), ("/x/c.docx", b"broken"), ("/x/d.txt", b"plain")]
    files = spark.createDataFrame([(p, len(b), bytearray(b)) for p, b in rows], "path string, n_bytes long, content binary")

    def reader(raw):
        words = raw[len(samples.PICTURE) :].decode()
        return [([[0, 5], [9, 6]], words, 0.9), ([[0, 1], [9, 2]], "first", 0.8), ([[0, 0]], "illegible", 0.2)]

    got = {r.path: r for r in prepare(files, Options(images=ImageReader(lambda: reader))).collect()}
    assert got["/x/a.png"].markdown == "first\none two" and got["/x/a.png"].status == "done"
    assert got["/x/b.pptx"].markdown == "<!-- Slide number: 1 -->\nbody\n\n---\n\n## Text found in images\n\n\n### image0.png\n\nfirst\nseen here\n\n### image2.png\n\nfirst\nmore words\n\n### image3.png\n\nfirst\nno"
    assert got["/x/b.pptx"].unread_images == 0 and got["/x/d.txt"].markdown == "plain"
    assert got["/x/c.docx"].status == "error" and got["/x/small.png"].status == "error"

    def broken():
        raise OSError("no model")

    got = {r.path: r for r in prepare(files, Options(images=ImageReader(broken))).collect()}
    assert got["/x/a.png"].error == "OSError: no model" and got["/x/b.pptx"].markdown.endswith("body")


def test_pieces_are_bounded_and_whole(spark):
    import pyarrow as pa

    from quillspark.sources import arrow

    texts = ["x" * 300, None, "", "y" * 5000, *["z" * 90] * 100]
    got = list(arrow.pieces([pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], ["t", "i"])], 1000))
    assert [x for b in got for x in b.column(0).to_pylist()] == texts and [x for b in got for x in b.column(1).to_pylist()] == list(range(len(texts)))
    assert all(b.num_rows == 1 or sum(len(x or "") for x in b.column(0).to_pylist()) <= 1000 for b in got) and len(got) < 20
    seen = arrow.map_pieces(spark.range(5000, numPartitions=1).selectExpr("repeat('a', 4000) AS t"), lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long").collect()
    assert sum(r.n for r in seen) == 5000 and max(r.n for r in seen) <= arrow.PIECE // 4000


def test_boxes_of_one_image_as_in_a_column(spark):
    import random

    from quillspark.operators.batch import read_boxes
    from quillspark.sources.images import in_order

    rng, nan = random.Random(5), float("nan")
    drawn = [[([[0.0, rng.choice([1.0, 2.0, -0.0, 0.0, nan])] for _ in range(rng.randint(0, 3))], rng.choice(["a", " ", "", "bc ", "\t", "é"]), rng.choice([0.4, 0.5, 0.9, nan])) for _ in range(rng.randint(0, 9))] for _ in range(300)]
    rows = spark.createDataFrame([(i, [(b, t, s) for b, t, s in d]) for i, d in enumerate(drawn)], "i int, boxes array<struct<box:array<array<double>>,text:string,score:double>>")
    got = {r.i: r.text for r in rows.select("i", read_boxes(F.col("boxes")).alias("text")).collect()}
    assert [got[i] for i in range(300)] == [in_order(d) for d in drawn] and len(set(got.values())) > 100


def test_naming_does_not_convert_again(spark):
    files = spark.createDataFrame([("/x/a.txt", 1, b"a"), ("/x/a.html", 1, b"<p>b"), ("/y/a.txt", 1, b"c")], "path string, n_bytes long, content binary")
    done = prepare(files)
    assert {r.path: r.output for r in done.collect()} == {"/x/a.html": "/x/a.md", "/x/a.txt": "/x/a (1).md", "/y/a.txt": "/y/a.md"}
    assert done._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_files_and_images_are_read_once(spark, tmp_path):
    """A file's contents are made once for all that is done with them, and an image that stands twice in it is recognised once."""
    import pyarrow as pa

    from quillspark.plans import samples
    from quillspark.sources.images import ImageReader

    texts = {".png": ["alone"], ".pptx": ["seen here", "seen here", "more words", "seen here"]}
    log = str(tmp_path / "log")

    def make(batches):
        for b in batches:
            with open(log, "a") as f:
                f.write("made\n" * b.num_rows)
            paths = b.column(0).to_pylist()
            made = [samples.pictured_file(k, "body", texts[k]) if (k := p[p.rindex(".") :]) in texts else b"?" for p in paths]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in made], pa.int64()), pa.array(made, pa.binary())], ["path", "n_bytes", "content"])

    def reader(raw):
        with open(log, "a") as f:
            f.write("read\n")
        return samples.read_picture(raw)

    paths = spark.createDataFrame([("/x/a.png",), ("/x/b.pptx",), ("/x/c.exe",), ("/x/d.mp3",)], "path string").coalesce(1)
    names = paths.withColumn("output", F.col("path"))
    got = {r.path: r for r in prepare(paths.mapInArrow(make, "path string, n_bytes long, content binary"), Options(images=ImageReader(lambda: reader)), outputs=names).collect()}
    assert got["/x/b.pptx"].markdown.endswith("### image0.png\n\nhere\nseen\n\n### image2.png\n\nwords\nmore") and got["/x/a.png"].markdown == "alone"
    assert got["/x/c.exe"].error == "Unsupported file type: .exe" and got["/x/d.mp3"].error.startswith("The speech model")
    done = open(log).read().split()
    assert done.count("made") == 4 and done.count("read") == 3
