"""Scalar functions on documents, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..formats import RAW_TEXT, base_name, extension

PAGE_TOKENS = 1500
#: White space as str.strip() sees it, but for the separators U+001C-1F.
SPACE = r"(?U)\s"


def strip(text: Column) -> Column:
    """Only a text that begins or ends in white space meets the pattern, which tries every blank in it."""
    return F.when(F.substring(text, 1, 1).rlike(SPACE) | F.substring(text, -1, 1).rlike(SPACE), F.regexp_replace(text, r"(?U)^\s+|\s+$", "")).otherwise(text)


def rstrip(text: Column) -> Column:
    return F.when(F.substring(text, -1, 1).rlike(SPACE), F.regexp_replace(text, r"(?U)\s+$", "")).otherwise(text)


def estimate_tokens(text: Column) -> Column:
    """Four characters (code points) a token, one token at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def raw_tokens(n_bytes: Column) -> Column:
    """The baseline of a text format: four bytes a token."""
    return F.greatest(F.lit(1), F.floor(n_bytes / 4)).cast("long")


def source_tokens(path: Column, n_bytes: Column, members: Column, pages: Column, output_tokens: Column) -> Column:
    """The baseline of a file's raw form; null where there is no honest one.

    members: array<struct<name, size>> of a zipped format's members, pages: a PDF's pages.
    """
    ext = extension(path)

    def total(test) -> Column:
        sizes = F.aggregate(F.filter(members, test), F.lit(0).cast("long"), lambda a, m: a + m["size"])
        return F.when(sizes > 0, raw_tokens(sizes))

    slides = F.size(F.filter(members, lambda m: m["name"].rlike(r"\Appt/slides/slide\d+\.xml\z")))
    return (
        F.when(ext.isin(RAW_TEXT), raw_tokens(n_bytes))
        .when(ext.isin(".docx", ".xlsx"), total(lambda m: m["name"].endswith(".xml") | m["name"].endswith(".rels")))
        .when(ext == ".epub", total(lambda m: F.lower(m["name"]).rlike(r"\.(xhtml|html|htm)\z")))
        .when(ext == ".pptx", F.when(slides > 0, slides * PAGE_TOKENS + output_tokens))
        .when(ext == ".pdf", F.when(pages > 0, pages * PAGE_TOKENS + output_tokens))
        .cast("long")
    )


def savings_percent(source: Column, output: Column) -> Column:
    """Whole per cent saved, 99 at most; null where nothing is saved."""
    share = F.least(F.lit(99), F.bround(100 * (1 - output / source))).cast("long")
    return F.when((source > output) & (output > 0) & (share > 0), share)


def frontmatter(path: Column, stamp: Column, extras: list[tuple[str, Column]] | None = None) -> Column:
    """The YAML block before a document; extras that are null or empty are left out, no value is escaped."""
    lines = [F.lit("---\noriginal_filename: "), base_name(path), F.lit("\nsource_format: "), extension(path), F.lit("\ndate_converted: "), stamp, F.lit("\n")]
    for name, value in extras or []:
        v = value.cast("string")
        lines.append(F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{name}: "), v, F.lit("\n"))).otherwise(""))
    return F.concat(*lines, F.lit("---\n\n"))


def collection_frontmatter(name: Column, n: Column, stamp: Column) -> Column:
    return F.concat(F.lit("---\ncollection_name: "), name, F.lit("\ntotal_files: "), n.cast("string"), F.lit("\ndate_combined: "), stamp, F.lit("\n---\n\n"))


def slugify(text: Column) -> Column:
    """Lower case; only letters, digits, _, - and white space stay; white space becomes one dash."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{N}_\s-]", ""), r"(?U)\s+", "-")


def format_timestamp(seconds: Column) -> Column:
    """HH:MM:SS, rounded half to even; hours may have more digits."""
    t = F.greatest(F.lit(0), F.bround(seconds)).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(t / 3600), F.floor(t % 3600 / 60), t % 60)


def format_duration(seconds: Column) -> Column:
    """1h 04m 09s, 48m 12s or 9s."""
    t = F.greatest(F.lit(0), F.bround(seconds)).cast("long")
    h, m, s = F.floor(t / 3600), F.floor(t % 3600 / 60), t % 60
    return F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, s)).when(m > 0, F.format_string("%dm %02ds", m, s)).otherwise(F.format_string("%ds", s))


def short_duration(seconds: Column) -> Column:
    """As lists of files show it: empty, 1h 04m, 3m 07s or 9s (1s at least)."""
    t = F.greatest(F.lit(1), F.floor(seconds + 0.5)).cast("long")
    h, m, s = F.floor(t / 3600), F.floor(t % 3600 / 60), t % 60
    return F.when(~(seconds > 0) | seconds.isNull(), "").when(h > 0, F.format_string("%dh %02dm", h, m)).when(m > 0, F.format_string("%dm %02ds", m, s)).otherwise(F.format_string("%ds", s))


def human_size(n_bytes: Column) -> Column:
    b = n_bytes.cast("double")
    in_ = lambda unit: F.format_string("%.1f", F.bround(b / unit, 1))  # noqa: E731  ties to even
    return (
        F.when(b < 1024, F.format_string("%.0f B", b)).when(b < 1 << 20, F.concat(in_(1 << 10), F.lit(" KB"))).when(b < 1 << 30, F.concat(in_(1 << 20), F.lit(" MB"))).otherwise(F.concat(in_(1 << 30), F.lit(" GB")))
    )


def _away(x: Column, unit: int) -> Column:
    return F.signum(x) * F.floor(F.abs(x) * unit + 0.5) / unit


def round_hundredth(x: Column) -> Column:
    """Half away from zero; what isn't finite is 0."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(_away(x, 100))


def round_tenth(x: Column) -> Column:
    """As round_hundredth, by tenths; negative values are 0."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")) | (x < 0), 0.0).otherwise(_away(x, 10))


def format_number(x: Column) -> Column:
    """Two decimals at most and one at least."""
    return F.regexp_replace(F.format_string("%.2f", x), "0$", "")


def join_words(words: Column) -> Column:
    """Trimmed words with single spaces, none before closing punctuation."""
    kept = F.filter(F.transform(words, strip), lambda w: w != "")
    spaced = F.transform(kept, lambda w, i: F.when((i > 0) & ~w.isin(*".,!?;:%)]}"), F.concat(F.lit(" "), w)).otherwise(w))
    return F.array_join(spaced, "")


def parse_vtt(text: Column) -> Column:
    """The spoken lines of a WebVTT file, as paragraphs."""
    lines = F.transform(F.split(text, r"\r\n|\r|\n", -1), strip)
    spoken = F.filter(lines, lambda x: (x != "") & (x != "WEBVTT") & ~x.rlike(r"(?U)^\d+$") & ~x.contains("-->"))
    return F.array_join(spoken, "\n\n")


def text_layer_is_thin(text: Column, pages: Column) -> Column:
    return F.coalesce((pages > 0) & (F.length(F.coalesce(text, F.lit(""))) < pages * 100), F.lit(False))


def unread_note(count: Column, ext: Column) -> Column:
    """What is appended to a document of which images or scanned pages weren't read."""
    plural = F.when(count == 1, "").otherwise("s")
    n = count.cast("string")
    what = F.when(ext == ".pdf", F.concat(n, F.lit(" page"), plural, F.lit(" with no text layer (looks scanned)"))).otherwise(F.concat(n, F.lit(" embedded image"), plural))
    note = F.concat(F.lit("\n\n---\n> **Note:** this file has "), what, F.lit(' that were not read. Enable "Read text in images and scanned PDFs" in Settings to extract the text.\n'))
    return F.when(count > 0, note).otherwise("")


def append(text: Column, note: Column) -> Column:
    return F.when(note != "", F.concat(rstrip(F.coalesce(text, F.lit(""))), note)).otherwise(text)
