"""The command line on real files, with its exit codes."""

import json
import threading

import pytest

from quillspark import cli


@pytest.fixture
def tree(tmp_path):
    top = tmp_path / "docs"
    (top / "sub").mkdir(parents=True)
    (top / "a.html").write_text("<h1>A</h1><p>mail x@y.org</p>")
    (top / "a.pdf").write_bytes(b"broken")
    (top / "sub" / "b.html").write_text("<p>Project Zeta</p>")
    (top / "sub" / "note.txt").write_text("not scanned")
    (top / "a.md").write_text("old")
    return top


def events(spark, *argv, lines=None):
    out = []
    code = cli.run(spark, [*map(str, argv), "--json"], out.append, lines)
    return code, [json.loads(x) for x in out]


def test_a_folder(spark, tree, tmp_path):
    code, got = events(spark, tree, tree / "sub" / "note.txt", tmp_path / "none", "--redact", "--term", "zeta", "--no-yaml", "--manifest", tmp_path / "m.json", "--output", "both", "--waves", 2)
    assert code == 1 and got[0] == {"event": "start", "total": 4, "base_dir": str(tree)}
    status = {e["path"]: e for e in got if e["event"] == "file"}
    assert {p.rpartition("/")[2]: e["status"] for p, e in status.items()} == {"a.html": "done", "a.pdf": "error", "b.html": "done", "note.txt": "done"}
    assert status[str(tree / "a.html")]["output"] == str(tree / "a (1).md")
    assert (tree / "a (1).md").read_text() == "# A\n\nmail [REDACTED_EMAIL]" and (tree / "a.md").read_text() == "old"
    assert (tree / "sub" / "b.md").read_text() == "Project [REDACTED_TERM]"
    said = json.loads((tmp_path / "m.json").read_text())
    assert len(said["outputs"]) == 3 and said["combined"] == str(tree / "docs-combined.md")
    whole = (tree / "docs-combined.md").read_text()
    assert whole.index("## Table of Contents") < whole.index("## a (1).md") < whole.index("## sub/b.md") and "not scanned" in whole
    assert (got[-1]["event"], got[-1]["converted"], got[-1]["failed"], got[-1]["cancelled"]) == ("summary", 3, 1, False)
    # again, in place, without the broken file
    (tree / "a.html").write_text("<p>new</p>")
    code, got = events(spark, tree, "--exclude", tree / "a.pdf", "--replace-from", tmp_path / "m.json", "--no-yaml")
    assert code == 0 and (tree / "a (1).md").read_text() == "new" and not (tree / "a (2).md").exists() and (tree / "a.md").read_text() == "old"


def test_combined_only_and_plain_lines(spark, tree, tmp_path):
    out = []
    assert cli.run(spark, [str(tree), "--exclude", str(tree / "a.pdf"), "--output", "combined-only", "--combined-name", "all.md", "--no-toc"], out.append) == 0
    assert (tree / "all.md").exists() and not (tree / "sub" / "b.md").exists() and "Table of Contents" not in (tree / "all.md").read_text()
    assert out[-1].startswith("Done: 2 converted, 0 failed, 0 skipped") and len(out) == 3


def test_nothing_to_do(spark, tmp_path, tree, capsys):
    assert cli.run(spark, [str(tmp_path / "none")]) == 2 and cli.run(spark, []) == 2
    assert cli.run(spark, [str(tree), "--replace-from", str(tmp_path / "none.json")]) == 2
    assert "no such path" in capsys.readouterr().err
    with pytest.raises(SystemExit) as e:
        cli.run(spark, ["--output", "what"])
    assert e.value.code == 2


def test_end_of_commands_cancels(spark, tree):
    hold = threading.Event()

    def said():
        yield json.dumps({"cmd": "skip", "file": str(tree / "a.html")})
        hold.wait(1)

    code, got = events(spark, tree, "--watchdog", lines=said())
    assert code == 130 and got[-1]["cancelled"]
