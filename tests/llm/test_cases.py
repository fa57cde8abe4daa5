"""One table of awkward cases through all operators and stages: no row is left out anywhere."""

import hashlib
import random
import re
import sys
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import common, decontam, fingerprint, langid, mixing, neardup, sharding, tokencount, tokenfiles, toxicity, urlfilter

# names of outputs and helper columns of every operator
CLASHES = "target last budget bins epochs copies size source_size score spans items n_words n_hit longest host path rule verdict template purity shard slot law component_id class_id n cid counts node part row id body k0 doc _row _score _match held_out lang_pred accepted predicted edge s_ mix_size mix_row".split()


def rows():
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    long = " ".join(words[i % 300] + str(i // 300) for i in range(900_000))
    assert len(long.encode()) > 5_000_000
    copy = " ".join(rng.choice(words) for _ in range(120))
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", None])) for i in range(40)]
    out += [(100, long, "en", "s1"), (101, long, None, None), (102, long[: len(long) // 2], "en", "s1")]
    out += [(5, copy, "en", "s2"), (5, "another text of the same id", "en", "s2"), (6, copy, "en", "s2"), (None, copy, None, None), (None, "only here and without an id", None, None)]
    out += [(50, copy, "en", "s1")] * 30 + [(-(1 << 63), copy + " and more", "en", "s1"), (-(1 << 63), None, "en", "s1"), ((1 << 63) - 1, "the greatest id", "en", "s1")]
    out += [(200, None, None, None), (201, "", "en", "s1"), (202, " \n\t", "en", "s1"), (203, "one", "en", "s1"), (204, "ONE", "de", "s1"), (205, "12 !?", "en", "s3"), (206, "\U0001f600 \u0000x \ufeff", None, "")]
    return out


@pytest.fixture(scope="module")
def given():
    return rows()


@pytest.fixture(scope="module")
def docs(spark, given):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return common.cut(spark.createDataFrame([(*r, None, *["c"] * len(CLASHES)) for r in given], kinds).repartition(5), "awkward")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def count(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_language(docs, none, given):
    model = langid.fit(docs)
    out = langid.identify(docs, model, keep=docs.columns, prefix="lid_").collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in given)
    assert all(0 <= r.lid_score <= 1 and (r.lid_lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or "")) for r in out)
    of_text = defaultdict(set)
    for r in out:
        of_text[r.text].add((r.lid_lang_pred, r.lid_score, r.lid_accepted))
    assert all(len(v) == 1 for v in of_text.values())  # nothing but the text decides
    assert langid.identify(none, model).count() == 0 and {r.lang_pred for r in langid.identify(docs, langid.fit(none)).collect()} == {"und"}


def test_language_equals_plain_loops():
    """The trained model applied n-gram by n-gram."""
    from quillspark.llm import grams

    rng = random.Random(4)
    texts = ["".join(rng.choice("abcä éñ 1.") for _ in range(rng.randrange(0, 90))) for _ in range(40)] + [None, "", "7"]
    model = langid.LanguageModel(["x", "y"], np.vstack([np.random.default_rng(1).normal(size=(1 << langid.BITS, 2)), np.zeros((1, 2))]).astype(np.float32), 0.7, 0.6)
    got = list(zip(*model.predict(texts)))
    for t, (lang, score, ok) in zip(texts, got):
        total, n = np.zeros(2), 0
        codes = [ord(c) if c.isalpha() else 0 for c in f"\0{(t or '').lower()}\0"]
        for k in langid.ORDERS:
            for i in range(len(codes) - k + 1):
                piece = codes[i : i + k]
                if (any(piece) and (piece[0] > 0 or piece[-1] > 0)) if k <= 2 else all(piece[1:-1]):
                    at, valid = grams.buckets(np.array(piece, np.uint32), k, langid.BITS)
                    assert valid[0]
                    total += model.table[at[0]]
                    n += 1
        if not any(codes):
            assert (lang, score, bool(ok)) == ("und", 0.0, False)
            continue
        z = total / n / 0.7
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert lang == ["x", "y"][int(p.argmax())] and abs(score - p.max()) < 1e-6 and bool(ok) == (p.max() >= 0.6)


def test_toxicity_equals_plain_loops():
    from quillspark.llm import grams

    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdé1 .") for _ in range(rng.randrange(0, 120))) for _ in range(60)] + [None, "", "!!", "a", "ab ab"]
    model = toxicity.ToxicityModel(np.random.default_rng(2).normal(size=1 << toxicity.BITS).astype(np.float32), (np.array([-1.0, 1.0]), np.array([0.1, 0.9])))
    got = model.evidence(texts)
    for t, e in zip(texts, got):
        scores = []
        for w in re.findall(r"[^\W_]+", (t or "").lower()):
            codes, found = [0, *map(ord, w), 0], []
            for k in toxicity.ORDERS:
                for i in range(len(codes) - k + 1):
                    found.append(model.table[grams.buckets(np.array(codes[i : i + k], np.uint32), k, toxicity.BITS)[0][0]])
            if found:
                scores.append(np.mean(found))
        best = sorted(scores)[-toxicity.WORDS :]
        assert abs(e - (np.mean(best) if best else toxicity.NO_EVIDENCE)) < 1e-4
    assert all(0 <= s <= 1 for s in model.scores(texts))


def test_shards(docs, none, given):
    out = sharding.shard_documents(docs, n_shards=4, keep=docs.columns, prefix="s_x", rows_per_run=7).collect()
    assert Counter((r.doc_id, r.s_xsize, r.s_xtext_crc32) for r in out) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in given)
    of = defaultdict(set)
    for r in out:
        of[r.text].add(r.s_xshard)
    assert all(len(v) == 1 for v in of.values())
    for s in range(4):
        assert sorted(r.s_xslot for r in out if r.s_xshard == s) == list(range(sum(r.s_xshard == s for r in out)))
    assert sharding.shard_documents(none).count() == 0


def test_differencing_equals_plain_differencing():
    def plain(sizes, k):
        """Partial partitions as lists of lists, the two of largest spread joined in opposite order."""
        parts = [(s, i, [(s, [i])] + [(0, [])] * (k - 1)) for i, s in enumerate(sizes)]
        n = len(sizes)
        while len(parts) > 1:
            parts.sort(key=lambda p: (-p[0], p[1]))
            (_, _, a), (_, _, b) = parts[:2]
            joined = [(x + y, m + o) for (x, m), (y, o) in zip(a, reversed(b))]
            joined.sort(key=lambda p: -p[0])
            joined = [(x - joined[-1][0], m) for x, m in joined]
            parts = [*parts[2:], (joined[0][0], n, joined)]
            n += 1
        return [sum(sizes[i] for i in m) for _, m in parts[0][2]]

    for seed in range(40):
        rng = random.Random(seed)
        sizes = [rng.randrange(1, 10**6) for _ in range(rng.randrange(8, 80))]
        got = sharding.karmarkar_karp(sizes, 8)
        loads = [sum(s for s, g in zip(sizes, got) if g == n) for n in range(8)]
        want = plain(sizes, 8)
        assert max(loads) - min(loads) == max(want) - min(want)


def test_more_groups_than_pieces(spark):
    made = [(i, f"text {i} " + "x" * (i % 50)) for i in range(3000)] + [(i, "hot " * 5000) for i in range(3000, 3003)]
    out = sharding.shard_documents(spark.createDataFrame(made, "doc_id long, text string"), n_shards=5, n_pieces=64, detail=16).collect()
    load, hot = Counter(), set()
    for r in out:
        load[r.shard] += r.size
        hot |= {r.shard} if r.doc_id >= 3000 else set()
    assert len(out) == 3003 and len(hot) == 1
    rest = [v for s, v in load.items() if s not in hot]
    assert len(load) == 5 and max(rest) - min(rest) < 400


def test_urls(spark):
    urls = ["http://a.org/x", None, "", "://", "http://", "x://h", "x://h/", "x://h//", "http://h/" + "deep/" * 400, "http://h/?" + "q" * 100_000, "http://EX.com/de/1", "http://h\n/x", "http://h/\u00e9/1"] * 3
    kinds = "page_id long, url string, " + ", ".join(f"`{c}` string" for c in CLASHES)
    pages = spark.createDataFrame([(i if i % 7 else None, u, *["c"] * len(CLASHES)) for i, u in enumerate(urls)], kinds)
    out = urlfilter.judge_urls(pages, keep=pages.columns, prefix="u_").collect()
    assert Counter(r.page_id for r in out) == Counter(i if i % 7 else None for i in range(len(urls)))
    of = defaultdict(set)
    for r in out:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r.url or "")
        assert (r.u_host, r.u_path) == ((m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", ""))
        of[r.url].add((r.u_rule, r.u_verdict))
    assert all(len(v) == 1 for v in of.values()) and {v for s in of.values() for _, v in s} <= {"allow", "block"}
    assert urlfilter.judge_urls(pages.limit(0)).count() == 0


def mixed_by_hand(given, quality, seed=mixing.SEED):
    """(doc_id, size, copies) of each row, row by row."""
    sources = sorted({r[3] for r in given if r[3] is not None}) + ([None] if any(r[3] is None for r in given) else [])
    size = [count(r[1]) for r in given]
    total = {s: sum(z for z, r in zip(size, given) if r[3] == s) for s in sources}
    w, left, open_, target = {s: i % 3 + 1 for i, s in enumerate(sources)}, float(sum(total.values())), set(sources), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > 3 * total[s]}
        if not over:
            break
        target |= {s: 3.0 * total[s] for s in over}
        left -= sum(target[s] for s in over)
        open_ -= over
    target |= {s: level * w[s] for s in open_}
    out = Counter()
    for s in sources:
        epochs = int(target[s] // total[s]) if total[s] else 0
        budget, upto, mine = target[s] - epochs * total[s], 0, []
        for r, z in zip(given, size):
            if r[3] == s:
                text = "" if r[0] is None else str(r[0])
                u = (int(hashlib.md5(f"{seed}:{text}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                mine.append((-np.log(u) / quality.get(r[0], 1.0), (r[0] is not None, r[0] or 0), z, r[0]))
        for _, _, z, d in sorted(mine, key=lambda m: m[:3]):
            upto += z
            out[d, z, min(3, epochs + (budget > 0 and upto - z / 2 <= budget))] += 1
    return out, target


@pytest.mark.parametrize("rows_per_bin", [3, 2000])
def test_mix(spark, docs, none, given, rows_per_bin):
    quality = {50: 2.0, 5: 0.5, 100: 0.5}
    q = spark.createDataFrame(list(quality.items()), "doc_id long, weight double")
    want, _ = mixed_by_hand(given, quality)
    got = mixing.mix(docs, q, rows_per_bin=rows_per_bin)
    assert Counter((r.doc_id, r["size"], r.copies) for r in got.collect()) == want
    mixed = mixing.mixed_documents(docs, q, rows_per_bin=rows_per_bin)
    assert mixed.columns == docs.columns
    assert Counter((r.doc_id, count(r.text)) for r in mixed.collect()) == sum((Counter({(d, z): c * n}) for (d, z, c), n in want.items()), Counter())
    assert mixing.mix(none, q).count() == 0 and mixing.mixed_documents(none, q).count() == 0


@pytest.mark.parametrize("other", [1000, 4000, 200])
def test_mix_takes_any_number_of_equal_rows(spark, other):
    given = [(7, "w " * 10, "en", "b")] * 100 + [(1, "v " * other, "en", "a")]
    df = spark.createDataFrame(given, "doc_id long, text string, lang string, source string").repartition(6)
    want, target = mixed_by_hand(given, {})
    got = mixing.mix(df).collect()
    assert Counter((r.doc_id, r["size"], r.copies) for r in got) == want
    assert abs(sum(r.taken for r in got if r.source == "b") - target["b"]) <= 5
    assert mixing.mixed_documents(df).filter("doc_id = 7").count() == sum(c * n for (d, _, c), n in want.items() if d == 7)


def test_fingerprints(docs, none, given):
    out = fingerprint.fingerprint_documents(docs).collect()
    order = sorted(given, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, (r[1] or "").encode()))
    assert len(out) == len(given)
    want = Counter()
    for r, n in zip(order, [*order[1:], order[0]]):
        t, following = r[1] or "", n[1] or ""
        e = fingerprint.edited(t, following)
        want[r[0], len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint.write_tokens(fingerprint.tokens(t)), fingerprint.write_tokens(fingerprint.tokens(e))] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in out) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    assert fingerprint.fingerprint_documents(none).count() == 0


def test_near_duplicates(spark, docs, none, given):
    def words(t):
        return (t or "").translate({c: c + 32 for c in range(65, 91)}).split()

    sets = []
    for _, t, *_ in given:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append(frozenset(zip(*[w[i:] for i in range(4)])) if len(w) >= 4 else frozenset([tuple(w)]) if w else frozenset())
    root = list(range(len(given)))
    for i in range(len(given)):
        for j in range(i):
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * 100 >= 85 * max(len(sets[i]), len(sets[j])):
                shared = len(sets[i] & sets[j])
                if 100 * shared >= 85 * (len(sets[i]) + len(sets[j]) - shared):
                    root = [root[j] if x == root[i] else x for x in root]
    want = Counter()
    for i, (d, *_) in enumerate(given):
        known = [given[j][0] for j in range(len(given)) if root[j] == root[i] and given[j][0] is not None]
        want[d, len(sets[i]), min(known) if known else None] += 1
    got = neardup.near_duplicates(docs)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == want
    assert neardup.near_duplicates(none).count() == 0
    left = neardup.without_near_duplicates(docs, k=4, percent=85)
    assert left.columns == docs.columns
    assert Counter(r.text is not None for r in left.collect()).total() == len(set(root))
    assert {r.text for r in left.collect()} >= {"another text of the same id", "only here and without an id"}


def test_decontamination(spark, docs, none, given):
    passage = " ".join(given[3][1].split()[:20])
    bench = spark.createDataFrame([(1, passage, "x", "x"), (1, passage, "x", "x"), (None, "one", "x", "x"), (2, None, "x", "x"), (3, "", "x", "x"), (4, given[100 - 60][1][:200_000], "x", "x")], "item_id long, text string, spans string, id string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    grams = defaultdict(set)
    for i, t in ((r.item_id, r.text) for r in bench.collect()):
        w = split(t)
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[j : j + n])].add("" if i is None else str(i))
    want = Counter()
    for d, t, *_ in given:
        w, hit, items = split(t), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit |= set(range(i, i + n))
                    items |= grams[g]
        want[d, len(w), len(hit), tuple(sorted(items))] += 1
    for block, shard in ((1_000_000, 1), (1000, 16_000_000), (1000, 50_000)):
        out = decontam.match_benchmark(docs, bench, keep=docs.columns, prefix="m_", block_bytes=block, shard_bytes=shard)
        assert Counter((r.doc_id, r.m_n_words, r.m_n_hit, tuple(r.m_items)) for r in out.collect()) == want
    assert decontam.match_benchmark(none, bench).count() == 0


def test_items_that_share_a_passage_take_little_memory():
    """200 items share a passage and a text of 8 kB repeats it."""
    for unit in ("a b c d e f g h i j k l m n o p q r s t ", "a "):
        windows = decontam.Windows([str(i) for i in range(200)], pa.array([unit * 40 + f"x{i}" for i in range(200)]), 13)
        data, off = decontam.doc_bytes(pa.array([(unit * 4000)[:8000]]))
        tracemalloc.start()
        shard = decontam.Shard([], data, off)
        decontam._search(shard.found, shard.array, windows)
        n, spans, items, longest = shard.found[0]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 20_000_000 and spans == [{"start": 0, "end": n}] and len(items) == 200
        assert longest == [{"item": "0", "item_start": 0, "start": 0, "length": 40 * unit.count(" ")}]


def test_token_counts(spark, docs, none, given, tmp_path):
    vocab = pytest.importorskip("public_tokenizers")
    import sentencepiece
    from tokenizers import Tokenizer

    path, cache = vocab.path("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    t = Tokenizer.from_file(path)
    n = {x: len(t.encode(x or "", add_special_tokens=False).ids) for x in {r[1] for r in given}}
    want = Counter((d, len((x or "").encode()), n[x]) for d, x, *_ in given)
    tokencount.count_tokens(docs.filter("doc_id > 20"), path, cache)
    for _ in range(2):  # half filled, then full
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in tokencount.count_tokens(docs, path, cache).collect()) == want
        assert spark.read.parquet(cache).count() == len({x or "" for x in n})
    files = spark.read.parquet(cache).inputFiles()
    tokencount.count_tokens(docs, path, cache)
    assert spark.read.parquet(cache).inputFiles() == files  # nothing was encoded again
    model = vocab.path("piece_bpe_32k.model")
    piece = sentencepiece.SentencePieceProcessor(model_file=model)
    few = docs.filter("length(text) < 1000 OR text IS NULL")
    want = Counter((d, len(piece.encode(x or ""))) for d, x, *_ in given if len(x or "") < 1000)
    assert Counter((r.doc_id, r.n_tokens) for r in tokencount.count_tokens(few, model, cache).collect()) == want
    assert tokencount.count_tokens(none, path, cache).count() == 0


def test_token_files(docs, none, given, tmp_path):
    vocab = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = vocab.path("word_bpe_49k.json")
    manifest = common.cut(tokenfiles.write_token_files(docs, path, f"file://{tmp_path}/files"), "manifest")
    got = tokenfiles.read_token_files(manifest).collect()
    t, at, want = Tokenizer.from_file(path), 0, Counter()
    for d, x, *_ in sorted(given, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        want[d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        at += len(ids)
    assert Counter(tuple(r) for r in got) == want
    ids = Counter(d for d, *_ in given)
    for r in manifest.collect():
        with tokenfiles.TokenFile(r.path) as f:
            for d in [x for x in ids if x is not None and r.first_id is not None and r.first_id <= x <= r.last_id]:
                assert f.get(d) is not None and f.get(d)[-1] == 1
            assert f.get(999_999_999) is None
            size = f.file.size()
    name = r.path.removeprefix("file://")
    with open(name, "r+b") as out:  # a changed payload is found out
        first = out.read(1)
        out.seek(0)
        out.write(bytes([first[0] ^ 1]))
    with tokenfiles.TokenFile(r.path) as f, pytest.raises(ValueError, match="damaged"):
        assert size and list(f.documents())
    assert tokenfiles.read_token_files(tokenfiles.write_token_files(none, path, f"file://{tmp_path}/none")).count() == 0


def test_token_files_of_one_id(spark, tmp_path):
    """One id has most rows, of which half are equal: they fill several files, and starts are without gaps."""
    vocab = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = vocab.path("word_bpe_49k.json")
    rows = [(7, "the same words in each row") if i % 2 else (7, f"words {i} of a row") for i in range(3000)] + [(3, "first"), (9, "last"), (None, "no id"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    joined = "spark.sql.adaptive.coalescePartitions.enabled"  # would join ranges as small as these
    spark.conf.set(joined, "false")
    try:
        manifest = common.cut(tokenfiles.write_token_files(df, path, f"file://{tmp_path}/files"), "manifest")
    finally:
        spark.conf.unset(joined)
    files = manifest.filter("first_id <= 7 AND last_id >= 7").collect()
    assert len(files) > 2 and max(r.n_docs for r in files) < 1500
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfiles.read_token_files(manifest).collect())
    t = Tokenizer.from_file(path)
    want = Counter()
    for d, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        want[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter(r[1:] for r in got) == want
    assert [r[1] for r in got] == [3] + [7] * 3000 + [9, None, None]
    assert all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:])) and got[0][0] == 0


def test_pipeline_stages(spark, docs, none, given):
    pipeline = pytest.importorskip("corpus_pipeline")
    folder, kept = "/root/testdata/sf0.001", docs
    for name, stage in pipeline.STAGES[:-1]:
        out = common.cut(stage(spark, kept, folder), f"case-{name}")
        assert out.columns == docs.columns, name
        assert stage(spark, none, folder).count() == 0, name
        kept = out
    shards = pipeline.STAGES[-1][1](spark, kept, folder)
    assert shards.count() == kept.count() and pipeline.STAGES[-1][1](spark, none, folder).count() == 0
    texts = [r.text for r in kept.collect()]
    assert {"another text of the same id", "only here and without an id", "the greatest id"} <= set(texts)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://x:7077", "app"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())
    assert "localCheckpoint" not in "".join(open(m.__file__).read() for m in list(sys.modules.values()) if (getattr(m, "__name__", "") or "").startswith("quillspark.llm."))
