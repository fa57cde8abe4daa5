"""Text of images, by a recogniser of one's own: image files, and images inside of Office documents.

Images are read where their file is converted, so contents are read once and only texts leave the task.
"""

from __future__ import annotations

import io
import math
import zipfile
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import formats
from ..functions.text import rstrip
from ..operators.batch import image_section
from .convert import image_size, suffix

#: Smaller images hold no text.
MIN_PIXELS = 10_000
NO_TEXT = "No readable text found in this image"


@dataclass(frozen=True)
class ImageReader:
    """load: called once in a task; gives a function from an image's bytes to what it reads: (corners of a box, text, score from 0 to 1)."""

    load: Callable[[], Callable[[bytes], list[tuple[list[list[float]], str, float]]]]


def images_of(path: str, raw: bytes | None) -> list[tuple[str, bytes]]:
    """(name, bytes) of the images in a file that are large enough; none in a file that can't be opened."""
    ext = suffix(path)
    size = lambda b: (lambda w, h: w * h)(*image_size(b))
    if raw and ext in formats.IMAGES:
        return [(path.rpartition("/")[2], raw)] if size(raw) >= MIN_PIXELS else []
    if not raw or ext not in (".docx", ".pptx", ".xlsx"):
        return []
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            found = [(n, z.read(n)) for n in sorted(z.namelist()) if "/media/" in n and n.lower().endswith(tuple(formats.EMBEDDED_IMAGES))]
    except (zipfile.BadZipFile, OSError, ValueError, RuntimeError):
        return []
    return [(n, b) for n, b in found if size(b) >= MIN_PIXELS]


def in_order(boxes: Iterable[tuple[list[list[float]], str, float]], min_score: float = 0.5) -> str:
    """What ``read_boxes`` makes of one image's boxes."""
    tops, words, odd = [], [], {}
    for box, text, score in boxes:
        if float(score) < min_score or not text or not text.strip(" "):
            continue
        ys = [c[1] for c in box]
        if not ys or (total := sum(ys)) != total:  # no corner (then it comes first), or some that is no number
            ys = [y for y in ys if y == y]
            if not ys:
                odd[len(tops)] = bool(box)
        tops.append(float(min(ys)) if ys else math.nan)
        words.append(text)
    if odd:
        order = sorted(range(len(tops)), key=lambda i: (odd.get(i, True), i in odd, 0.0 if i in odd else tops[i]))
    else:
        order = sorted(range(len(tops)), key=tops.__getitem__)
    text = "\n".join([words[i] for i in order])
    return text if len(text.strip(" ")) >= 3 else ""


def picture_texts(reader: ImageReader) -> Callable[[str, bytes | None], list[tuple[str, str, str | None]]]:
    """A function from a file to (name, text, error) of its images: an image that the recogniser fails at has no text and says why.

    An image that stands in a document more than once is read and returned once, by its first name.
    """
    model = broken = None

    def read(image: bytes) -> tuple[str, str | None]:
        nonlocal model, broken
        if model is None and broken is None:
            try:
                model = reader.load()
            except Exception as e:  # noqa: BLE001  a recogniser that fails must not end the batch
                broken = f"{type(e).__name__}: {e}"
        if broken is not None:
            return "", broken
        try:
            return in_order(model(image)), None
        except Exception as e:  # noqa: BLE001
            return "", f"{type(e).__name__}: {e}"

    def run(path: str, raw: bytes | None) -> list[tuple[str, str, str | None]]:
        first: dict[bytes, str] = {}
        for name, image in images_of(path, raw):
            first.setdefault(image, name)
        return [(name, *read(image)) for image, name in first.items()]

    return run


def with_image_texts(made: DataFrame) -> DataFrame:
    """Converted files (path, markdown, error, unread, pictures, ...) with what their images say: the whole of an image file, an own section of a document."""
    image = formats.format_class(F.col("path")) == "image"
    section = image_section(F.col("pictures"))
    whole = F.get("pictures", F.lit(0))
    office = formats.extension(F.col("path")).isin(".docx", ".pptx", ".xlsx") & F.col("error").isNull()
    rows = made.withColumn("section_", F.when(office, section)).withColumn("text_", F.when(image, whole["text"])).withColumn("why_", F.when(image, whole["error"]))
    markdown = F.when(image, F.nullif(F.col("text_"), F.lit(""))).when(office & F.col("section_").isNotNull(), F.concat(rstrip(F.coalesce("markdown", F.lit(""))), F.col("section_"))).otherwise(F.col("markdown"))
    error = F.when(image, F.when(F.coalesce("text_", F.lit("")) == "", F.coalesce("why_", F.lit(NO_TEXT)))).otherwise(F.col("error"))
    unread = F.when(office, 0).otherwise(F.col("unread"))
    out = rows.select("*", markdown.alias("m_"), error.alias("e_"), unread.cast("int").alias("u_"))
    return out.select(*[F.col({"markdown": "m_", "error": "e_", "unread": "u_"}.get(c, c)).alias(c) for c in made.columns if c != "pictures"])
