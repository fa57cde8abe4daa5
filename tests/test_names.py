"""Names of outputs against the plain loop."""

import random

import pytest

from quillspark.operators import batch as B
from quillspark.plans.prepare import Options, prepare


def plain(paths, taken):
    """In order of path, each takes the first free name."""
    used, out = set(taken), {}
    for p in sorted(set(paths), key=lambda x: x.encode()):
        folder, _, name = p.rpartition("/")
        dot = name.lstrip(".").rfind(".")
        stem = p if dot <= 0 else f"{folder}/{name[: len(name) - len(name.lstrip('.')) + dot]}"
        n = 0
        while (got := f"{stem} ({n}).md" if n else f"{stem}.md") in used:
            n += 1
        used.add(got)
        out[p] = got
    return out


def made(seed):
    rng = random.Random(seed)
    number = lambda: rng.choice(["", "", " (1)", " (2)", " (3)", " (1) (1)", " (2) (1)", " (01)", " (0)", " (10)"])
    paths = ["/d/" + rng.choice("fg") + number() + rng.choice(["", "", ".a", ".b", ".c", ".d.e", ".", ".F"]) for _ in range(rng.randrange(1, 60))]
    taken = ["/d/" + rng.choice("fg") + number() + rng.choice([".md", ".md", ".MD", ".txt"]) for _ in range(rng.randrange(0, 25))]
    return paths, taken


@pytest.mark.parametrize("bits", [1, 16])
def test_names_equal_the_loop(spark, monkeypatch, bits):
    monkeypatch.setattr(B, "STRETCH_BITS", bits)
    rows, names, want = [], [], {}
    for seed in range(250):  # a folder for each case
        paths, taken = made(seed)
        with_taken = seed % 3 > 0
        put = lambda p, s=seed: f"/{s}{p}"
        rows += [put(p) for p in paths]
        names += [put(t) for t in taken] if with_taken else []
        want |= plain([put(p) for p in paths], [put(t) for t in taken] if with_taken else [])
    files = spark.createDataFrame([(p,) for p in rows], "path string").repartition(4)
    got = B.unique_outputs(files, spark.createDataFrame([(t,) for t in names], "output string")).collect()
    assert len(got) == len(rows) and {r.path: r.output for r in got} == want
    few = {p: o for p, o in want.items() if int(p.split("/")[1]) % 3 == 0}
    got = B.unique_outputs(spark.createDataFrame([(p,) for p in few], "path string")).collect()
    assert {r.path: r.output for r in got} == few


def test_a_large_family(spark):
    n = 200_000
    files = spark.range(n, numPartitions=8).selectExpr("concat('/d/f (', id + 1, ').txt') AS path").union(spark.createDataFrame([("/d/f.a",), ("/d/f.b",), ("/d/f.c",)], "path string"))
    taken = spark.range(3, numPartitions=1).selectExpr("concat('/d/f (', id * 2 + 200002, ').md') AS output")
    got = {r.path: r.output for r in B.unique_outputs(files, taken).filter("path < '/d/f (' OR path >= '/d/f.'").collect()}
    assert got == {"/d/f.a": "/d/f.md", "/d/f.b": f"/d/f ({n + 1}).md", "/d/f.c": f"/d/f ({n + 3}).md"}


def test_manifest_names_are_taken(spark):
    files = spark.createDataFrame([("/x/a.html", 3, bytearray(b"<p>")), ("/x/a.txt", 1, bytearray(b"t")), ("/x/b.txt", 1, bytearray(b"t")), ("/x/b.csv", 1, bytearray(b"t"))], "path string, n_bytes long, content binary")
    earlier = spark.createDataFrame([("/x/./a.html", "/x/a (1).md"), ("/x/b.txt", "/x/b.md"), ("/x/zz.txt", "/x/zz.md"), ("/x/b.csv", "/x/b.exe")], "source string, output string")
    existing = spark.createDataFrame([("/x/a.md",)], "output string")
    got = {r.path: r.output for r in prepare(files, Options(overwrite=True), earlier, existing).collect()}
    assert got == {"/x/a.html": "/x/a (1).md", "/x/a.txt": "/x/a.md", "/x/b.txt": "/x/b.md", "/x/b.csv": "/x/b (1).md"}
    got = {r.path: r.output for r in prepare(files, Options(overwrite=False), earlier, existing).collect()}
    assert got["/x/a.html"] == "/x/a (1).md" and got["/x/a.txt"] == "/x/a (2).md"


def test_parts_are_the_whole(spark):
    rng = random.Random(1)
    rows = [(f"c{rng.randrange(3)}", f"n {rng.randrange(30)} é.md", rng.choice(["body\n", "é" * rng.randrange(300), ""])) for _ in range(120)]
    rows = list({(c, n): (c, n, b) for c, n, b in rows}.values()) + [("same", "n.md", "x")] * 5
    docs = spark.createDataFrame(rows, "collection string, name string, body string").repartition(5)
    for whole, parts in (
        (B.combined(docs, "2024"), B.combined_parts(docs, "2024", part_bytes=150)),
        (B.combined(docs, toc=False), B.combined_parts(docs, toc=False, part_bytes=1000)),
        (B.combined(docs), B.combined_parts(docs)),
        (B.clipboard(docs).withColumnRenamed("text", "markdown"), B.clipboard_parts(docs, part_bytes=150)),
    ):
        want, got = {r.collection: r.markdown for r in whole.collect()}, {}
        for r in sorted(parts.collect(), key=lambda r: (r.collection, r.part)):
            have = got.setdefault(r.collection, "")
            assert r.start == len(have.encode()) and r.n_bytes == len(r.markdown.encode())
            got[r.collection] += r.markdown
        assert got == want and len(want) == 4


def test_common_folders(spark):
    import posixpath

    cases = [["/a/b/c", "/a/b"], ["/a/b", "/a/bc"], ["/x", "/y"], ["/a/b/"], ["/"], ["/a", "/"], ["/a/b/c", "/a/b/d", "/a/b c"], ["/a/é", "/a/é/f"]]
    df = spark.createDataFrame([(i, p) for i, c in enumerate(cases) for p in c], "i int, folder string")
    got = {r.i: r.b for r in df.groupBy("i").agg(B.common_folder().alias("b")).collect()}
    assert got == {i: posixpath.commonpath(c) for i, c in enumerate(cases)}
    assert df.limit(0).agg(B.common_folder().alias("b")).first().b is None


def test_base_dir_of_collected_files(spark):
    from quillspark.sources import scan

    direct = spark.createDataFrame([(0, "/d/x/one.bin"), (1, "/d/gone/two.txt")], "seq int, path string")
    listed = spark.createDataFrame([(2, "/d/y/a.pdf"), (3, "/d/y/b.exe")], "seq int, path string")
    folders = spark.createDataFrame([("/d/y",)], "folder string")
    got = scan.collect_files(direct, listed, spark.createDataFrame([("/d/gone/two.txt",)], "path string"), folders).collect()
    assert [(r.path, r.base_dir) for r in got] == [("/d/x/one.bin", "/d"), ("/d/y/a.pdf", "/d")]


def test_engine_errors_are_told(spark):
    from quillspark.functions.engines import TextEngine, redact_with

    def broken():
        raise OSError("no model")

    df = spark.createDataFrame([("a@b.org",), (None,)], "markdown string").coalesce(1)
    got = redact_with(df, TextEngine(broken), error="why").collect()
    assert [(r.markdown, r.why) for r in got] == [("[REDACTED_EMAIL]", "OSError: no model"), (None, None)]
    fine = redact_with(df, TextEngine(lambda: str.upper), error="why").collect()
    assert [(r.markdown, r.why) for r in fine] == [("[REDACTED_EMAIL]", None), (None, None)]


def test_normal_paths(spark):
    cases = {"/a//./b": "/a/b", "/a/././/b/": "/a/b", "//a": "/a", "/a/b/.": "/a/b", "/": "/", "/a/.b": "/a/.b", "/a./b": "/a./b", "a\\b": "a/b"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.n for r in df.select("p", B.normal_path(df.p).alias("n")).collect()} == cases
