"""A batch from files to Markdown: route, convert, annotate, redact, count, name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..formats import extension
from ..functions import text as T
from ..functions.engines import EntityEngine, TextEngine, redact_with
from ..functions.redact import redact
from ..operators import batch as B
from ..sources.convert import convert_files
from ..sources.images import ImageReader, picture_texts, with_image_texts


@dataclass(frozen=True)
class Options:
    yaml: bool = False
    redact: bool = False
    terms: str | None = None
    allow_zip: bool = False
    stamp: str | None = None
    engine: EntityEngine | TextEngine | None = None
    overwrite: bool = True
    images: ImageReader | None = None


def prepare(files: DataFrame, options: Options = Options(), manifest: DataFrame | None = None, existing: DataFrame | None = None, outputs: DataFrame | None = None) -> DataFrame:
    """(path, n_bytes, content) to results: path, status, output, markdown, tokens, source_tokens, unread_images, error.

    manifest: (source, output) of an earlier run, whose names are kept; existing:
    (output) names that are taken when ``overwrite`` is off.  outputs: (path, output)
    where names have been settled before.
    """
    reader = options.images
    made = convert_files(files, options.allow_zip, ocr=reader is not None, pictures=(lambda: picture_texts(reader)) if reader else None)
    if reader:
        made = with_image_texts(made)
    ext = extension(F.col("path"))
    text: Column = T.append(F.col("markdown"), T.unread_note(F.col("unread"), ext))
    stamp = F.lit(options.stamp) if options.stamp else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    if options.yaml:
        text = F.concat(T.frontmatter(F.col("path"), stamp), text)
    if options.redact and not options.engine:
        text = redact(text, options.terms)
    done = made.withColumn("status", F.when(F.col("error").isNull(), "done").otherwise("error")).withColumn("markdown", F.when(F.col("error").isNull(), text))
    if options.redact and options.engine:
        done = redact_with(done, options.engine, "markdown", options.terms)
    tokens = F.when(F.col("status") == "done", T.estimate_tokens(F.col("markdown")))
    done = done.withColumn("tokens", tokens).withColumn("source_tokens", F.when(F.col("status") == "done", T.source_tokens(F.col("path"), F.col("n_bytes"), F.col("members"), F.col("pages"), F.col("tokens"))))
    if outputs is None:  # names need paths alone: the conversion runs once, not for each table that naming looks at
        outputs = B.named_outputs(files.select("path").distinct(), manifest, None if options.overwrite else existing)
    done = done.join(outputs, "path")
    return done.select("path", "status", F.when(F.col("status") == "done", F.col("output")).alias("output"), "markdown", "tokens", "source_tokens", F.col("unread").alias("unread_images"), "error")
