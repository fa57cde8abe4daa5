"""Files as a Spark data source: listings planned by subfolders, and batches of Markdown files written as a whole or not at all.

``listed_files`` reads (path, n_bytes).  The driver opens folders level by level until there are enough of them to deal
out; tasks walk what lies below.

``prepared_files`` writes (source, output, markdown).  Tasks put texts into a staging folder next to the manifest; the
driver moves them to their places and puts the new manifest last, so the manifest is the commit.  Until then nothing of
the batch is visible and the old manifest holds: a batch that fails leaves neither.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Folders that the driver opens at most to plan a listing.
MOST_OPENED = 10_000
MOVERS = 16


def file_system(path: str):
    """The file system of a path or URI, as tasks can use it, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def entries(path: str, recursive: bool) -> Iterator[tuple[str, bool, int]]:
    """(path, whether it is a folder, size) of what lies in a folder; nothing where there is none."""
    from pyarrow import fs

    system, name = file_system(path)
    scheme = path[: len(path) - len(name)] if "://" in path else ""
    for f in system.get_file_info(fs.FileSelector(name, recursive=recursive, allow_not_found=True)):
        if f.type in (fs.FileType.File, fs.FileType.Directory):
            yield scheme + f.path, f.type == fs.FileType.Directory, f.size or 0


@dataclass
class Folders(InputPartition):
    """Folders to walk, and folders of which only the files that lie directly in them count."""

    whole: list[str]
    direct: list[str]


def plan_folders(roots: list[str], tasks: int) -> list[Folders]:
    """The folders below ``roots`` dealt to about ``tasks`` parts: opened level by level until there are that many."""
    whole, direct, opened = list(dict.fromkeys(roots)), [], 0
    while whole and len(whole) < tasks and opened < MOST_OPENED:
        below = []
        for folder in whole:
            opened += 1
            direct.append(folder)
            below += [p for p, is_folder, _ in entries(folder, False) if is_folder]
        whole = below
    parts = [Folders(whole[i::tasks], direct[i::tasks]) for i in range(tasks)]
    return [p for p in parts if p.whole or p.direct] or [Folders([], [])]


class ListedFiles(DataSource):
    """Options: folders (a JSON list of paths or URIs), tasks (how many parts to aim at; default 64).

    A folder that is listed twice, or lies in another one of the list, gives its files once for each.
    """

    @classmethod
    def name(cls) -> str:
        return "listed_files"

    def schema(self) -> str:
        return "path string, n_bytes long"

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(json.loads(self.options["folders"]), int(self.options.get("tasks", "64")))


class ListingReader(DataSourceReader):
    def __init__(self, roots: list[str], tasks: int):
        self.roots, self.tasks = roots, tasks

    def partitions(self) -> list[Folders]:
        return plan_folders(self.roots, self.tasks)

    def read(self, partition: Folders):
        for folders, recursive in ((partition.whole, True), (partition.direct, False)):
            for folder in folders:
                for path, is_folder, size in entries(folder, recursive):
                    if not is_folder:
                        yield path, size


@dataclass
class Staged(WriterCommitMessage):
    """The list of what a task has staged; the driver never holds the names of all files."""

    part: str
    n: int


class PreparedFiles(DataSource):
    """Options: manifest (where the new manifest goes), combined (the name of the combined document, if there is one)."""

    @classmethod
    def name(cls) -> str:
        return "prepared_files"

    def schema(self) -> str:
        return "source string, output string, markdown string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        missing = {"source", "output", "markdown"} - set(schema.names)
        if missing:
            raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
        return BatchWriter(self.options["manifest"], self.options.get("combined"))


class BatchWriter(DataSourceWriter):
    def __init__(self, manifest: str, combined: str | None):
        self.manifest, self.combined = manifest, combined
        self.staging = f"{manifest}.staging-{uuid.uuid4().hex}"
        system, name = file_system(self.staging)
        system.create_dir(name, recursive=True)

    def write(self, iterator) -> Staged:
        """Stages a task's texts; an attempt that fails leaves only what ``abort`` deletes, and one that goes on after that finds no folder."""
        folder = f"{self.staging}/{uuid.uuid4().hex}"
        system, name = file_system(folder)
        system.create_dir(name, recursive=False)
        n = 0
        with system.open_output_stream(f"{name}/_list") as listed:
            for row in iterator:
                with system.open_output_stream(f"{name}/{n}") as f:
                    f.write((row["markdown"] or "").encode())
                listed.write(json.dumps([row["source"], row["output"], f"{name}/{n}"], ensure_ascii=False).encode() + b"\n")
                n += 1
        return Staged(f"{name}/_list", n)

    def commit(self, messages: list[Staged | None]) -> None:
        """From here on the batch is done: should the driver be lost, ``recover`` moves what is still staged."""
        system, name = file_system(self.staging)
        with system.open_output_stream(f"{name}/_commit.tmp") as f:
            f.write(json.dumps({"parts": [m.part for m in messages if m], "combined": self.combined}).encode())
        system.move(f"{name}/_commit.tmp", f"{name}/_commit")
        finish(self.manifest, self.staging)

    def abort(self, messages: list[Staged | None]) -> None:
        system, name = file_system(self.staging)
        drop(system, name)


def drop(system, name: str) -> None:
    from pyarrow import fs

    for left in (4, 3, 2, 1, 0):  # a task may be adding to it
        if system.get_file_info(name).type != fs.FileType.Directory:
            return
        try:
            system.delete_dir(name)
        except OSError:
            if not left:
                raise


def staged_rows(system, parts: list[str]) -> Iterator[list[str]]:
    for part in parts:
        with system.open_input_stream(part) as f:
            rest = b""
            while block := f.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                yield from map(json.loads, lines)


def finish(manifest: str, staging: str) -> None:
    """Moves all staged files that haven't been moved yet, then puts the manifest; names are read part by part."""
    from pyarrow import fs

    system, name = file_system(staging)
    with system.open_input_stream(f"{name}/_commit") as f:
        said = json.loads(f.read())

    def move(row: list[str]) -> None:
        _, output, staged = row
        if system.get_file_info(staged).type == fs.FileType.File:
            to = file_system(output)[1]
            system.create_dir(to.rpartition("/")[0] or ".", recursive=True)
            system.move(staged, to)

    with ThreadPoolExecutor(MOVERS) as pool:
        held = []
        for row in staged_rows(system, said["parts"]):
            held.append(row)
            if len(held) == 10_000:
                list(pool.map(move, held))
                held = []
        list(pool.map(move, held))
    write_manifest(manifest, ((source, output) for source, output, _ in staged_rows(system, said["parts"])), said["combined"])
    drop(system, name)


def write_manifest(manifest: str, outputs: Iterator[tuple[str, str]], combined: str | None) -> None:
    """One JSON object, written pair by pair to a name of its own and then moved."""
    system, name = file_system(manifest)
    temp = f"{name}.{uuid.uuid4().hex}.tmp"
    say = lambda x: json.dumps(x, ensure_ascii=False).encode()
    if "/" in name:
        system.create_dir(name.rpartition("/")[0], recursive=True)
    with system.open_output_stream(temp) as f:
        f.write(b'{"version": 1, "outputs": {')
        for i, (source, output) in enumerate(outputs):
            f.write((b",\n" if i else b"\n") + say(source) + b": " + say(output))
        f.write(b'},\n"combined": ' + say(combined) + b"}\n")
    system.move(temp, name)


def recover(manifest: str) -> int:
    """Ends batches of a manifest whose driver was lost: those that were committed are finished, others are dropped.  Returns how many were finished."""
    from pyarrow import fs

    system, name = file_system(manifest)
    scheme = manifest[: len(manifest) - len(name)] if "://" in manifest else ""
    folder, _, base = name.rpartition("/")
    done = 0
    for path, is_folder, _ in entries(f"{scheme}{folder or '.'}", False):
        if is_folder and path.rpartition("/")[2].startswith(f"{base}.staging-"):
            at = file_system(path)[1]
            if system.get_file_info(f"{at}/_commit").type == fs.FileType.File:
                finish(manifest, path)
                done += 1
            else:
                drop(system, at)
    return done


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session."""
    spark.dataSource.register(ListedFiles)
    spark.dataSource.register(PreparedFiles)


def write_batch(results: DataFrame, manifest: str, combined: str | None = None) -> None:
    """Writes the Markdown files of results (path, status, output, markdown) and their manifest: all of them or nothing."""
    register(results.sparkSession)
    rows = results.filter("status = 'done'").selectExpr("path AS source", "output", "markdown")
    writer = rows.write.format("prepared_files").option("manifest", manifest)
    (writer if combined is None else writer.option("combined", combined)).mode("append").save()
