"""The command line: ``python -m quillspark PATH...`` prepares files and folders as one batch.

Exit codes: 0 all went well, 1 some file failed, 2 nothing to do or wrong arguments, 130 cancelled.
"""

from __future__ import annotations

import argparse
import json
import os
import signal
import sys
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import batch as B
from .plans.prepare import Options
from .sources import files, scan
from .streaming.live import LiveBatch, convert_listed


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillspark", description="Converts files and folders to Markdown with Spark.")
    p.add_argument("paths", nargs="*", help="files (of any suffix) and folders")
    p.add_argument("--output", choices=("individual", "both", "combined-only"), default="individual", help="which documents are left")
    p.add_argument("--combined-name", help="name of the combined document; default: that of the common folder")
    p.add_argument("--no-yaml", action="store_true", help="no head with the file's name and date")
    p.add_argument("--no-toc", action="store_true", help="no contents in the combined document")
    p.add_argument("--conflict", choices=("keep-both", "overwrite"), default="keep-both", help="where an output exists")
    p.add_argument("--redact", action="store_true", help="redact personal data, credentials and addresses")
    p.add_argument("--term", action="append", help="a term to redact; may be repeated")
    p.add_argument("--terms-file", help="terms to redact, one a line")
    p.add_argument("--allow-zip", action="store_true", help="convert archives")
    p.add_argument("--manifest", help="where to write which output each file has")
    p.add_argument("--replace-from", help="an earlier manifest, whose outputs are overwritten in place")
    p.add_argument("--exclude", action="append", help="a file to leave out; may be repeated")
    p.add_argument("--waves", type=int, default=16, help="parts that the batch is dealt into; between them it can be cancelled")
    p.add_argument("--work-dir", help="a folder that executors share, for the batch's list, results and checkpoint")
    p.add_argument("--json", action="store_true", help="JSON lines on standard output")
    p.add_argument("--watchdog", action="store_true", help="take commands from standard input; its end cancels the batch")
    p.add_argument("--quiet", action="store_true", help="only the summary")
    return p


def kind_of(path: str) -> str:
    """file, folder or none."""
    from pyarrow import fs

    system, name = files.file_system(path)
    found = system.get_file_info(name).type
    return {fs.FileType.File: "file", fs.FileType.Directory: "folder"}.get(found, "none")


def listing(spark: SparkSession, direct: list[str], folders: list[str], excluded: list[str]) -> DataFrame:
    """(path, n_bytes, base_dir) of what the arguments name, each file once."""
    size = {p: next((n for q, is_folder, n in files.entries(p.rpartition("/")[0] or "/", False) if q == p and not is_folder), 0) for p in direct}
    one = spark.createDataFrame([(i, p, size[p]) for i, p in enumerate(direct)], "seq int, path string, n_bytes long")
    many = scan.list_files(spark, folders).select(F.lit(len(direct)).alias("seq"), "path", "n_bytes")
    gone = spark.createDataFrame([(p,) for p in excluded], "path string")
    tops = spark.createDataFrame([(f,) for f in folders], "folder string")
    found = scan.collect_files(one.select("seq", "path"), many.select("seq", "path"), gone, tops)
    sizes = one.select("path", "n_bytes").union(many.select("path", "n_bytes")).groupBy("path").agg(F.max("n_bytes").alias("n_bytes"))
    return found.join(sizes, "path").select("path", "n_bytes", "base_dir")


def existing_outputs(spark: SparkSession, direct: list[str], folders: list[str]) -> DataFrame:
    """(output) the Markdown files that lie where outputs go."""
    near = sorted({q for d in {p.rpartition("/")[0] or "/" for p in direct} for q, is_folder, _ in files.entries(d, False) if not is_folder and q.endswith(".md")})
    there = scan.list_files(spark, folders).select("path").union(spark.createDataFrame([(q,) for q in near], "path string"))
    return there.filter(F.col("path").endswith(".md")).select(F.col("path").alias("output")).distinct()


def write_combined(done: DataFrame, base_dir: str, target: str, stamp: str | None, toc: bool) -> int:
    """The combined document, part by part to a name of its own and then moved; returns its estimated tokens."""
    name = base_dir.rstrip("/").rpartition("/")[2] or "Documents"
    shown = F.expr(f"substring(output, {len(base_dir.rstrip('/')) + 2})")
    docs = done.select(F.lit(name).alias("collection"), shown.alias("name"), F.col("markdown").alias("body"))
    system, path = files.file_system(target)
    n = 0
    with system.open_output_stream(f"{path}.tmp") as f:
        for r in B.combined_parts(docs, stamp, toc).orderBy("part").select("markdown").toLocalIterator():  # a part at a time
            f.write(r.markdown.encode())
            n += len(r.markdown)
    system.move(f"{path}.tmp", path)
    return max(1, n // 4)


def run(spark: SparkSession, argv: list[str], say: Callable[[str], None] = print, lines=None) -> int:
    """One batch by its arguments; ``lines``: where commands come from with --watchdog."""
    args = parser().parse_args(argv)
    warn = lambda text: print(f"quillspark: {text}", file=sys.stderr)
    absolute = lambda p: p if "://" in p else os.path.abspath(p)
    kinds = {absolute(p): kind_of(absolute(p)) for p in args.paths}
    for p, kind in kinds.items():
        if kind == "none":
            warn(f"no such path: {p}")
    direct, folders = ([p for p, k in kinds.items() if k == want] for want in ("file", "folder"))
    found = listing(spark, direct, folders, [absolute(p) for p in args.exclude or []]) if direct or folders else None
    first = found.first() if found is not None else None
    if first is None:
        warn("no files to convert")
        return 2
    terms = list(args.term or [])
    if not terms and args.terms_file:
        with open(args.terms_file, encoding="utf-8") as f:
            terms = f.read().splitlines()
    earlier = None
    if args.replace_from:
        if kind_of(absolute(args.replace_from)) != "file":
            warn(f"no such manifest: {args.replace_from}")
            return 2
        earlier = scan.read_manifest(spark, absolute(args.replace_from))
    began, stamp = time.time(), time.strftime("%Y-%m-%d %H:%M:%S")
    overwrite = args.conflict == "overwrite"
    options = Options(yaml=not args.no_yaml, redact=args.redact, terms="\n".join(terms) or None, allow_zip=args.allow_zip, stamp=stamp, overwrite=overwrite)
    work = absolute(args.work_dir) if args.work_dir else tempfile.mkdtemp(prefix="quill-batch-")
    if not args.work_dir and not spark.sparkContext.master.startswith("local"):
        warn("--work-dir has to name a folder that executors share")
        return 2
    emit = (lambda **event: say(json.dumps(event, ensure_ascii=False))) if args.json else (lambda **_: None)
    commands = None
    if args.watchdog:
        commands = f"{work}/commands"
        system, name = files.file_system(commands)
        system.create_dir(name, recursive=True)

    def report(n: int) -> None:
        for r in batch.results().filter(F.col("wave") == n).select("path", "status", "output", "tokens", "source_tokens", "unread_images", "error").toLocalIterator():
            emit(event="file", **r.asDict())
            if not args.json and not args.quiet:
                say(f"{r.status}: {r.path}" + (f" -> {r.output} (~{r.tokens:,} tokens)" if r.status == "done" else f": {r.error}" if r.error else ""))

    batch = LiveBatch(spark, f"{work}/batch", convert_listed(options), args.waves, commands, first.base_dir, report)
    batch.start(found.select("path", "n_bytes"), earlier, None if overwrite else existing_outputs(spark, direct, folders))
    emit(event="start", total=batch.total, base_dir=first.base_dir)
    before = None
    try:
        before = signal.signal(signal.SIGINT, lambda *_: batch.cancel())
    except ValueError:  # not the main thread
        pass
    if args.watchdog:
        batch.watch(sys.stdin if lines is None else lines)
    try:
        batch.wait()
    finally:
        if before is not None:
            signal.signal(signal.SIGINT, before)
    total = batch.summary()
    combined = None
    done = batch.results().filter("status = 'done'")
    one = args.output != "individual" and not batch.cancelled and total["converted"] >= 2
    if one:
        base = first.base_dir.rstrip("/")
        name = args.combined_name or f"{base.rpartition('/')[2] or 'Documents'}-combined.md"
        combined = f"{base}/{name}"
        taken = spark.createDataFrame([(q,) for q, is_folder, _ in files.entries(base or "/", False) if not is_folder], "output string")
        if not overwrite:
            combined = B.unique_outputs(spark.createDataFrame([(combined,)], "path string"), taken).first().output
        tokens = write_combined(done, base, combined, None if args.no_yaml else stamp, not args.no_toc)
        emit(event="combined", output=combined, tokens=tokens)
    if not (one and args.output == "combined-only"):
        files.write_batch(done, absolute(args.manifest) if args.manifest else f"{work}/manifest.json", combined)
    elif args.manifest:
        files.write_manifest(absolute(args.manifest), iter(()), combined)
    if one and args.output == "combined-only":
        total["tokens"] = tokens
    total |= {"elapsed": round(time.time() - began, 2), "combined": combined, "manifest": args.manifest}
    emit(**total)
    if not args.json:
        say(f"{'Cancelled' if batch.cancelled else 'Done'}: {total['converted']} converted, {total['failed']} failed, {total['skipped']} skipped, ~{total['tokens']:,} tokens in {total['elapsed']} s")
    return batch.exit_code


def main(argv: list[str] | None = None) -> int:
    spark = SparkSession.builder.appName("quillspark").getOrCreate()
    try:
        return run(spark, sys.argv[1:] if argv is None else argv)
    finally:
        spark.stop()
