"""Listings of files, manifests, and whole files as rows."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..formats import SCANNED, extension, is_hidden
from . import files
from .files import file_system


def _put(path: str, body: bytes) -> None:
    """Writes a file to a name of its own and then moves it."""
    system, name = file_system(path)
    temp = f"{name}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(temp) as f:
        f.write(body)
    system.move(temp, name)


def scan_listing(paths: DataFrame, extensions: list[str] = SCANNED) -> DataFrame:
    """Of a listing (path), the files a folder scan takes: no lock files or dotfiles, known suffixes, in order of path."""
    return paths.filter(~is_hidden(F.col("path")) & extension(F.col("path")).isin(extensions)).orderBy("path")


def list_files(spark: SparkSession, folders: list[str], tasks: int = 64) -> DataFrame:
    """(path, n_bytes) of all files under folders (paths or URIs), folders with leading dots included, walked in about ``tasks`` tasks.

    Spark's own listing leaves out names that begin with ``_`` or ``.``, so tasks walk the folders.
    """
    files.register(spark)
    return spark.read.format("listed_files").option("folders", json.dumps(folders)).option("tasks", str(tasks)).load()


def collect_files(direct: DataFrame, listed: DataFrame, excluded: DataFrame | None = None, folders: DataFrame | None = None) -> DataFrame:
    """Files named directly (seq, path), whatever their suffix, and listed ones (seq, path) that a scan takes: each once, at its first place.

    folders: (folder) that were named; with it each row has base_dir, the folder that all of them and the direct files lie in.
    """
    rows = direct.select("seq", "path").union(scan_listing(listed).select("seq", "path"))
    rows = rows.groupBy("path").agg(F.min("seq").alias("seq"))
    if excluded is not None:
        from ..operators.batch import exclude

        rows = exclude(rows, excluded)
        direct = exclude(direct, excluded)
    if folders is None:
        return rows.select("seq", "path").orderBy("seq", "path")
    from ..operators.batch import common_folder

    tops = folders.select("folder").union(direct.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")))
    base = tops.agg(common_folder().alias("base_dir"))  # one row
    return rows.select("seq", "path").join(F.broadcast(base), F.lit(True)).orderBy("seq", "path")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, n_bytes, content) of whole files."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("n_bytes"), "content")


def read_listed(paths: DataFrame) -> DataFrame:
    """(path, n_bytes, content) of the files of a listing (path), read in tasks; a file that can't be read has null contents."""

    def read(batches):
        import pyarrow as pa

        for b in batches:
            for path in b.column(0).to_pylist():  # one file at a time: contents may be large
                try:
                    system, name = file_system(path)
                    with system.open_input_file(name) as f:
                        body = f.readall()
                except OSError:
                    body = None
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([body and len(body) or 0], pa.int64()), pa.array([body], pa.binary())], ["path", "n_bytes", "content"])

    return paths.select("path").mapInArrow(read, "path string, n_bytes long, content binary")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(source, output) of a manifest; only outputs that are Markdown files.  A missing file is an empty manifest."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "source string, output string")
    rows = spark.read.schema("version int, outputs map<string,string>, combined string").option("multiLine", True).json(path)
    return rows.select(F.explode("outputs").alias("source", "output")).filter(F.lower("output").endswith(".md"))


def write_manifest(outputs: DataFrame, path: str, combined: str | None = None) -> str | None:
    """Writes (source, output) as a manifest, to a name of its own and then moved; None where that fails.  A manifest is one file for its readers, so it is made on the driver."""
    body = {"version": 1, "outputs": {r[0]: r[1] for r in outputs.select("source", "output").toLocalIterator()}, "combined": combined}
    try:
        _put(path, json.dumps(body, ensure_ascii=False, indent=2).encode())
    except OSError:
        return None
    return path


def write_markdown(results: DataFrame) -> DataFrame:
    """Writes (output, markdown) next to their sources from the tasks, each to a name of its own and then moved; returns (output, written)."""

    def write(batches):
        import pyarrow as pa

        for b in batches:
            ok = []
            for out, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    _put(out, (text or "").encode())
                    ok.append(True)
                except OSError:
                    ok.append(False)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ok, pa.bool_())], ["output", "written"])

    return results.select("output", "markdown").mapInArrow(write, "output string, written boolean")
