"""File formats: their classes, routes and skip rules, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension lists, limits and messages that must equal the original's.
DOCUMENTS = [".docx", ".pdf", ".pptx", ".xlsx", ".xls", ".msg", ".epub", ".ipynb", ".vtt", ".html", ".htm"]
AUDIO = [".mp3", ".m4a", ".wav", ".flac", ".ogg", ".aac", ".opus"]
VIDEO = [".mp4", ".mov", ".webm", ".mkv"]
IMAGES = [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".tif", ".tiff"]
EMBEDDED_IMAGES = [".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".webp"]
PLAIN = [".txt", ".csv", ".json", ".md"]
RAW_TEXT = [".html", ".htm", ".vtt", ".txt", ".csv", ".json", ".md", ".ipynb"]
ZIP_MAX_ENTRIES, ZIP_MAX_TOTAL, ZIP_MAX_ENTRY = 200, 200 << 20, 50 << 20
NEEDS_OCR = 'Images need OCR — enable "Read text in images and scanned PDFs" in Settings'
ZIP_OFF = "Unsupported file type: .zip (ZIP conversion is off by default; enable it in Settings)"

MEDIA = AUDIO + VIDEO
SCANNED = DOCUMENTS + MEDIA
CONVERTIBLE = SCANNED + PLAIN


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The lower-cased last suffix with its dot; empty where there is none, or only leading dots."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)^\.*[^.].*?(\.[^.]*)$", 1))


def is_hidden(path: Column) -> Column:
    """Lock files of office programs, and dotfiles."""
    return base_name(path).rlike(r"^(~\$|\.)")


def format_class(path: Column) -> Column:
    ext = extension(path)
    return (
        F.when(ext.isin(DOCUMENTS), "document").when(ext.isin(AUDIO), "audio").when(ext.isin(VIDEO), "video").when(ext.isin(IMAGES), "image").when(ext.isin(PLAIN), "text").when(ext == ".zip", "archive").otherwise("other")
    )


def route(path: Column, allow_zip: bool = False, ocr: bool = False) -> Column:
    """struct(route, error): where a file's conversion begins, or why it doesn't."""
    ext = extension(path)

    def to(name: str | None, error: Column | str | None = None) -> Column:
        error = F.lit(error) if error is None or isinstance(error, str) else error
        return F.struct(F.lit(name).cast("string").alias("route"), error.cast("string").alias("error"))

    return (
        F.when(ext == ".zip", to("zip") if allow_zip else to(None, ZIP_OFF))
        .when(ext.isin(IMAGES), to("ocr") if ocr else to(None, NEEDS_OCR))
        .when(ext.isin(MEDIA), to("speech"))
        .when(~ext.isin(CONVERTIBLE), to(None, F.concat(F.lit("Unsupported file type: "), F.when(ext == "", "no extension").otherwise(ext))))
        .when(ext == ".vtt", to("vtt"))
        .otherwise(to("document"))
    )


def archive_skip(name: Column, size: Column) -> Column:
    """Why a member of an archive is left out (for the list of skipped entries), 'silent' if without a word, or null."""
    ext = extension(name)
    return (
        F.when((base_name(name) == "") | is_hidden(name), "silent")
        .when(ext == ".zip", "nested archive")
        .when(ext.isin(MEDIA), "audio/video skipped in archives")
        .when(~ext.isin(CONVERTIBLE), "unsupported type")
        .when(size > ZIP_MAX_ENTRY, "exceeds size cap")
    )
