"""Listings and written batches through the data sources."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.sources import files, scan


@pytest.fixture
def tree(tmp_path):
    top = tmp_path / "top"
    for i in range(6):
        for j in range(4):
            folder = top / f"a{i}" / f".b{j}" / "c"
            folder.mkdir(parents=True)
            (folder / f"_{i}{j}.txt").write_text("x" * (i + j))
            (folder.parent / ".hidden.md").write_text("h")
        (top / f"a{i}" / "~$lock.docx").write_text("")
    (top / "direct é.txt").write_text("d")
    return top


def walked(top):
    return sorted((str(p), p.stat().st_size) for p in top.rglob("*") if p.is_file())


@pytest.mark.parametrize("tasks", [1, 3, 10, 1000])
def test_listing_equals_a_walk(spark, tree, tasks):
    got = scan.list_files(spark, [str(tree)], tasks)
    assert sorted(map(tuple, got.collect())) == walked(tree)
    parts = files.plan_folders([str(tree)], tasks)
    assert len(parts) <= tasks and (tasks < 3 or len(parts) >= 3)
    assert sum(len(p.whole) for p in parts) >= (tasks if tasks < 24 else 0)


def test_listing_of_nothing_and_of_uris(spark, tree, tmp_path):
    assert scan.list_files(spark, [str(tmp_path / "none")]).count() == 0
    assert scan.list_files(spark, []).count() == 0
    got = scan.list_files(spark, [f"file://{tree}/a0", f"file://{tree}/a1"])
    assert got.count() == 18 and got.filter("path LIKE 'file:///%'").count() == 18


def results(spark, folder, n=40, word="text"):
    rows = [(f"/in/{i}.html", "done" if i % 10 else "error", f"{folder}/out/{i % 3}/f {i} é.md", None if i == 5 else f"{word} {i}") for i in range(n)]
    return spark.createDataFrame(rows, "path string, status string, output string, markdown string").repartition(5)


def test_a_batch_is_written_with_its_manifest(spark, tmp_path):
    at = str(tmp_path / "m" / "manifest.json")
    files.write_batch(results(spark, tmp_path), at, combined="/c.md")
    said = json.loads(open(at).read())
    assert said["version"] == 1 and said["combined"] == "/c.md" and len(said["outputs"]) == 36
    for i in range(40):
        if i % 10:
            assert said["outputs"][f"/in/{i}.html"] == f"{tmp_path}/out/{i % 3}/f {i} é.md"
            assert open(f"{tmp_path}/out/{i % 3}/f {i} é.md").read() == ("" if i == 5 else f"text {i}")
    assert scan.read_manifest(spark, at).count() == 36
    assert sorted(p.name for p in (tmp_path / "m").iterdir()) == ["manifest.json"]
    files.write_batch(results(spark, tmp_path).limit(0), at)
    assert json.loads(open(at).read()) == {"version": 1, "outputs": {}, "combined": None}


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    at = str(tmp_path / "manifest.json")
    files.write_batch(results(spark, tmp_path, 20, "old"), at)
    before = {p: p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()}

    @F.udf("string")
    def fail(path, text):
        if path == "/in/33.html":
            raise RuntimeError("in the middle")
        return text

    rows = results(spark, tmp_path, 60, "new").withColumn("markdown", fail("path", "markdown"))
    with pytest.raises(Exception, match="in the middle"):
        files.write_batch(rows, at)
    assert {p: p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()} == before
    assert not [p for p in tmp_path.iterdir() if "staging" in p.name]


def test_a_lost_driver(spark, tmp_path, monkeypatch):
    """Staged but not committed: dropped.  Committed and moved in part: finished."""
    at = str(tmp_path / "manifest.json")
    rows = [{"source": f"/in/{i}", "output": f"{tmp_path}/o/{i}.md", "markdown": f"t{i}"} for i in range(5)]
    lost = files.BatchWriter(at, None)
    lost.write(iter(rows))
    assert files.recover(at) == 0 and list(tmp_path.iterdir()) == []
    half = files.BatchWriter(at, None)
    message = half.write(iter(rows))
    unused = half.write(iter([{"source": "/in/0", "output": f"{tmp_path}/o/0.md", "markdown": "of another attempt"}]))
    monkeypatch.setattr(files, "finish", lambda *a: None)
    half.commit([message, None])
    monkeypatch.undo()
    (tmp_path / "o").mkdir()
    import os

    os.rename(message.part.replace("_list", "2"), tmp_path / "o" / "2.md")
    assert unused.n == 1 and not os.path.exists(at)
    assert files.recover(at) == 1 and files.recover(at) == 0
    assert {p.name: p.read_text() for p in (tmp_path / "o").iterdir()} == {f"{i}.md": f"t{i}" for i in range(5)}
    assert json.loads(open(at).read())["outputs"] == {f"/in/{i}": f"{tmp_path}/o/{i}.md" for i in range(5)}
