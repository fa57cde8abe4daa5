"""Operators 11 to 13 against plain loops, on awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import divergence, negatives, secretscan
from quillspark.llm.common import cut

INF = float("inf")


# --- 11 -----------------------------------------------------------------------------------------


def mined_by_hand(rows, n_pos, n_neg):
    fit = [(k, i, lab, [math.floor(256 * x) if abs(x) < 1e300 else int(x) * 256 for x in v]) for k, (i, v, lab) in enumerate(rows) if lab is not None and v is not None and not any(x is None or not math.isfinite(x) for x in v)]
    key = lambda s, i: (-s, i is None, i or 0)
    most = (1 << 63) - 1
    out = Counter()
    for k, a, lab, v in fit:
        if a is None or a % 100:
            continue
        scored = [(max(-most, min(most, sum(x * y for x, y in zip(v, w)))), i, m, j) for j, i, m, w in fit]
        same = sorted((key(s, i), s, i) for s, i, m, j in scored if m == lab and j != k)[:n_pos]
        for _, p, pid in same:
            other = sorted((key(s, i), s, i) for s, i, m, _ in scored if m != lab and 30 * p <= 100 * s <= 90 * p)[:n_neg]
            for r, (_, s, i) in enumerate(other, 1):
                out[a, pid, r, i, p, s] += 1
    return out


def embedding_rows():
    rng = random.Random(3)
    out = [(i, [rng.uniform(-1, 1.5) for _ in range(rng.choice([4, 4, 4, 3]))], rng.choice("aaab")) for i in range(0, 1200, 5)]
    out += [(100, [0.5] * 4, "a"), (100, [0.5] * 4, "a"), (200, [0.25] * 4, "b"), (None, [0.4] * 4, "b"), (None, [0.4] * 4, "a"), (7, [], "b"), (300, [], "a")]
    out += [(400, None, "a"), (500, [1.0, None, 0.0, 0.0], "a"), (600, [INF, 0.0, 0.0, 0.0], "a"), (700, [float("nan")] * 4, "b"), (800, [1.0] * 4, None)]
    out += [(-100, [0.3] * 4, "b"), (-5, [0.3] * 4, "a"), (11, [0.3] * 4, "a"), (13, [0.3] * 4, "b")] * 2
    return out


@pytest.mark.parametrize("block_bytes,part_rows", [(8 << 20, 20_000), (256, 37)])
def test_hard_negatives(spark, block_bytes, part_rows):
    rows = embedding_rows()
    df = spark.createDataFrame([(*r, "c", "c") for r in rows], "vec_id long, embedding array<double>, label string, score string, `row` string")
    got = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, block_bytes=block_bytes, part_rows=part_rows)
    want = mined_by_hand(rows, 5, 10)
    assert len(want) > 500
    assert Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got.collect()) == want


def test_hard_negatives_of_nothing_and_of_large_numbers(spark):
    kinds = "vec_id long, embedding array<double>, label string"
    for rows in ([], [(1, [1.0], "a")], [(100, [1.0], "a")]):
        assert negatives.hard_negatives(spark.createDataFrame(rows, kinds), F.col("vec_id") % 100 == 0).count() == 0
    rows = [(i, [x, 1.0], lab) for i, (x, lab) in enumerate([(3e7, "a"), (1e7, "a"), (-2e7, "b"), (9e6, "b"), (5e6, "b"), (1e17, "a"), (2e6, "b"), (4e16, "b")] * 3)]
    rows[0] = (100, rows[0][1], "a")
    df = spark.createDataFrame(rows, kinds)
    got = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0)
    want = mined_by_hand(rows, 5, 10)
    assert want and Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got.collect()) == want


def test_scores_are_exact():
    rng = np.random.default_rng(1)
    for scale in (10, 1e6, 1e8, 1e12, 1e200):
        a, b = (np.floor(rng.normal(size=(5, 7)) * scale) for _ in range(2))
        most = (1 << 63) - 1
        want = [[max(-most, min(most, sum(int(x) * int(y) for x, y in zip(r, s)))) for s in b] for r in a]
        assert negatives.exact_scores(a, b).tolist() == want


# --- 12 -----------------------------------------------------------------------------------------


def audited_by_hand(rows, least, k):
    occ, df, groups, lang_n = defaultdict(Counter), defaultdict(Counter), set(), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        groups.add((lang, source))
        occ[lang, source].update(terms)
        lang_n[lang].update(terms)
        df[lang].update(set(terms))
    out = set()
    for lang, source in groups:
        kept = [t for t, n in df[lang].items() if n >= least]
        v = len(kept)
        part = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * v) for t in kept}  # noqa: E731, B023
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = part(occ[lang, source]), part(lang_n[lang])
        pairs = []
        for other in (s for g, s in groups if g == lang and s != source):
            o = part(occ[lang, other])
            pairs.append((-sum(f(p[t], o[t]) for t in kept), other.encode(), other))
        terms = [(-f(p[t], q[t]), t.encode(), t) for t in kept if occ[lang, source][t] > 0 and p[t] > q[t]]
        out |= {(lang, source, "pair", i, -x, r) for r, (x, _, i) in enumerate(sorted(pairs), 1)}
        out |= {(lang, source, "term", i, -x, r) for r, (x, _, i) in enumerate(sorted(terms)[:k], 1)}
    return out


def divergence_rows():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcDé") for _ in range(rng.randrange(1, 6))) for _ in range(150)] + ["\U0001f600", "x" * 300 + "a", "x" * 300 + "b"]
    out = [(" ".join(rng.choice(words[: rng.randrange(5, 153)]) + rng.choice(["", "1", ".", " "]) for _ in range(rng.randrange(0, 60))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "é", None])) for _ in range(150)]
    out += [(out[0][0], "en", "s1")] * 40 + [(None, None, None), ("", "", ""), ("12 34", "zz", "only"), (None, "zz", "other"), ("solo words", "yy", "s1")]
    out += [(" ".join(f"tie{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)), "tt", f"s{j}") for j in range(4)] + [("more words", "tt", "s9")] * 5
    return out


@pytest.mark.parametrize("least,settle", [(3, 2000), (3, 0), (1, 3)])
def test_divergence(spark, least, settle):
    rows = divergence_rows()
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "text string, lang string, source string, term string, n int").repartition(5)
    out = divergence.source_divergence(df, least_docs=least, settle=settle)
    got = [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == audited_by_hand(rows, least, 10)
    assert divergence.source_divergence(df.limit(0)).count() == 0


@pytest.mark.parametrize("settle", [0, 5, 10**6])
def test_top_k(spark, settle):
    rng = random.Random(settle)
    rows = [(g, rng.choice([0, 1, 5, 1023, 1024, (1 << 30) - 1]), "".join(rng.choice("abé") for _ in range(rng.randrange(0, 9)))) for g in ("x", "y", None) for _ in range(400)] + [("few", 3, "a"), ("few", 3, "b")]
    rows = sorted(set(rows), key=repr)
    df = cut(spark.createDataFrame(rows, "g string, v long, item string"), "top")
    got = {(r.g, r["rank"], r.v, r.item) for r in divergence.top_k(df, ["g"], "v", "item", 10, settle=settle).collect()}
    want = set()
    for g in {r[0] for r in rows}:
        want |= {(g, n, v, i) for n, (v, i) in enumerate(sorted(((v, i) for h, v, i in rows if h == g), key=lambda x: (-x[0], x[1].encode()))[:10], 1)}
    assert got == want


# --- 13 -----------------------------------------------------------------------------------------

EITHER = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
ASSIGN = re.compile(rf"""({EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_by_hand(text):
    t = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def secret_texts():
    rng = random.Random(12)
    parts = ['token = "', "PASSWORD:", "api_key=", "ApiKey '", "secret", "passwd =  ", "é\U0001f600 ", "AKIA", "AKIAAKIA", "\n", " ", '"', "===", "KKey", "ſecret=abcdefgh "]
    made = lambda: "".join(rng.choice(parts) if rng.random() < 0.6 else "".join(rng.choice("0123456789abcdefABCXYZ_-") for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(0, 25)))
    out = [made() for _ in range(400)] + [None, "", "token", "token=abcde", "token=abcdef", "f" * 23, "f" * 24, "AKIA" + "A" * 15, "AKIA" + "A" * 16, "token=" + "x" * 3_000_000, "a b " * 400_000 + "secret: 123456", "0" * 24]
    return out


def test_patterns_equal_plain_matches(spark):
    texts = secret_texts()
    for got, t in zip(secretscan.find_spans(pa.array(texts), None), texts):
        assert [(s["kind"], s["start"], s["end"]) for s in got] == base_by_hand(t)
    df = spark.createDataFrame([(i % 50 if i % 7 else None, t, "c", "c") for i, t in enumerate(texts)], "doc_id long, text string, secrets string, k0 string").repartition(3)
    out = secretscan.scan_secrets(df, secretscan.fit(df, sample=50), keep=df.columns, name="found").collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((i % 50 if i % 7 else None, t) for i, t in enumerate(texts))
    for r in out:
        assert [(s["kind"], s["start"], s["end"]) for s in r.found if s["kind"] != "crf"] == base_by_hand(r.text)
        assert all(not (s["start"] < b and a < s["end"]) for s in r.found if s["kind"] == "crf" for _, a, b in base_by_hand(r.text))
    none = df.limit(0)
    assert secretscan.fit(none) is None and secretscan.scan_secrets(none, None).count() == 0
    assert secretscan.fit(df.filter("text = 'token'")) is None


def test_viterbi_equals_the_plain_one():
    def plain(emit, step, start):
        best, back = start + emit[0], []
        for e in emit[1:]:
            way = best[:, None] + step
            back.append(way.argmax(0))
            best = way.max(0) + e
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return best.max(), path[::-1]

    rng = np.random.default_rng(5)
    grain = lambda x: np.round(x * 1024) / 1024
    step, start = grain(rng.normal(size=(3, 3))), grain(rng.normal(size=3))
    step[2, 1] = start[1] = -1e6
    for lengths in ([1], [700], [3, 1, 260, 256, 512, 7], rng.integers(1, 40, 60).tolist()):
        emit = grain(rng.normal(size=(sum(lengths), 3)))
        first = np.zeros(len(emit), bool)
        first[np.cumsum([0, *lengths[:-1]])] = True
        got, at = secretscan.viterbi(emit, first, step, start), 0
        for n in lengths:
            score, path = plain(emit[at : at + n], step, start)
            mine = got[at : at + n].tolist()
            assert mine == path
            assert start[mine[0]] + sum(emit[at + i, t] for i, t in enumerate(mine)) + sum(step[a, b] for a, b in zip(mine, mine[1:])) == score
            at += n


def test_features_do_not_depend_on_the_batch():
    texts = [t for t in secret_texts() if t and len(t) < 5000]
    model = secretscan.Field(np.random.default_rng(0).normal(size=(secretscan.PAD + 1, 3)), np.zeros((3, 3)), np.array([0, -1e6, 0]))
    assert secretscan.find_spans(pa.array(texts), model) == [secretscan.find_spans(pa.array([t]), model)[0] for t in texts]


def test_the_field_finds_new_values_and_leaves_prose(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    half = F.crc32(F.col("text").cast("binary")) % 2
    model = secretscan.fit(docs.filter(half == 0))
    held = [r.text for r in docs.filter(half == 1).select("text").collect() if r.text]
    spans = secretscan.find_spans(pa.array(held), model)
    assert sum(s["kind"] == "crf" for x in spans for s in x) <= len(held) // 100  # prose is left alone
    rng, hit, n = random.Random(99), 0, 0
    for t in held:
        for _, a, b in [s for s in base_by_hand(t) if s[0] == "assign"][:1]:
            lead = len(t[a:b]) - len(ASSIGN.match(t[a:b])[2])
            for _ in range(60):
                new, (span,) = secretscan.varied(t.encode(), [(len(t[:a].encode()), len(t[: a + lead].encode()), len(t[:b].encode()))], rng)
                got = secretscan.find_spans(pa.array([new.decode()]), model)[0]
                start = len(new[: span[0]].decode())
                n, hit = n + 1, hit + any(s["value_start"] <= start < s["value_end"] for s in got)
    assert n >= 100 and hit >= 0.9 * n, (hit, n)


def test_query_columns(spark):
    r = secretscan.op13_secret_spans(spark, "/root/testdata/sf0.001").collect()
    text = {x.doc_id: x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for x in r:
        base = base_by_hand(text[x.doc_id])
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert x.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (x.n_assign, x.n_access, x.n_hex) == tuple(sum(k == w for k, *_ in base) for w in ("assign", "access", "hex"))
        assert [s for s in x.spans.split(",") if s and not s.startswith("crf")] == [s for s in want.split(",") if s]
    assert len(r) == len(text)
