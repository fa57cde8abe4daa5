"""The scalar operators as SQL functions, and two table functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .redact import redact_sql
from .turns import add_segment


class ZipEntries:
    """zip_entries(name, content): the members of an archive with their sizes and why they are skipped (null: they aren't); one row without a name for a file that is no archive."""

    def eval(self, name: str, content: bytes):
        import io
        import zipfile

        from ..sources.convert import member_skip

        try:
            members = zipfile.ZipFile(io.BytesIO(content or b"")).infolist()
        except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError) as e:
            yield None, None, f"not an archive: {e}"
            return
        for m in members:
            if not m.is_dir():
                yield m.filename, m.file_size, member_skip(m.filename, m.file_size)


class MergeTurns:
    """merge_turns(TABLE(SELECT doc_id, seq, start, end, speaker, text ...) PARTITION BY doc_id ORDER BY seq): segments of one speaker without a pause above three seconds as one."""

    def __init__(self):
        self.seq, self.held, self.doc_id = 0, None, None

    def eval(self, row):
        self.doc_id = row["doc_id"]
        self.held, closed = add_segment(self.held, row["start"], row["end"], row["speaker"], row["text"])
        if closed:
            self.seq += 1
            yield self.doc_id, self.seq, *closed

    def terminate(self):
        if self.held:
            yield self.doc_id, self.seq + 1, *self.held


def register(spark: SparkSession) -> None:
    """Defines temporary SQL functions; the scalar ones are expressions, so they are optimised like built-in ones."""
    from pyspark.sql.functions import udtf

    define = lambda name, args, kind, body: spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    define("estimate_tokens", "t STRING", "BIGINT", "greatest(1, length(t) div 4)")
    define("raw_tokens", "n BIGINT", "BIGINT", "greatest(1, n div 4)")
    define("slugify", "t STRING", "STRING", r"regexp_replace(regexp_replace(lower(t), r'(?U)[^\p{L}\p{N}_\s-]', ''), r'(?U)\s+', '-')")
    define("format_timestamp", "s DOUBLE", "STRING", "format_string('%02d:%02d:%02d', cast(greatest(0D, bround(s)) as bigint) div 3600, cast(greatest(0D, bround(s)) as bigint) % 3600 div 60, cast(greatest(0D, bround(s)) as bigint) % 60)")
    define("parse_vtt", "t STRING", "STRING", r"array_join(filter(transform(split(t, r'\r\n|\r|\n', -1), x -> regexp_replace(x, r'(?U)^\s+|\s+$', '')), x -> x <> '' AND x <> 'WEBVTT' AND NOT x rlike r'(?U)^\d+$' AND NOT contains(x, '-->')), '\n\n')")
    define("redact_pii", "content STRING", "STRING", redact_sql("content"))
    spark.udtf.register("zip_entries", udtf(ZipEntries, returnType="name string, size long, skip string"))
    spark.udtf.register("merge_turns", udtf(MergeTurns, returnType="doc_id long, seq long, start double, end double, speaker string, text string"))
