"""The corpus operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillspark.llm import common, decontam, fingerprint, langid, mixing, neardup, sharding, tokencount, tokenfiles, toxicity, urlfilter

DOC = "doc_id long, text string, lang string, source string, n_chars long, size long, k0 string, shard int"


def documents(spark, rows, parts=4):
    """rows of (doc_id, text) or (doc_id, text, lang, source); with columns whose names clash."""
    full = [(*r, *[None] * (4 - len(r)), len(r[1] or ""), 7, "k", 1) for r in rows]
    return spark.createDataFrame(full, DOC).repartition(parts) if full else spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randrange(1, 6))) for _ in range(80)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 80))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(60, 140):  # copies with a few edits, and exact ones
        t = rng.choice(base[:12]).split(" ")
        for _ in range(rng.randrange(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "one"), (204, "ONE"), (205, "a b"), (None, base[0]), (5, base[5]), (206, " ".join(words) * 300)]
    return rows


# --- sharding


def test_karmarkar_karp():
    assert sorted(sharding.karmarkar_karp([8, 7, 6, 5, 4], 2)) in ([0, 0, 1, 1, 1], [0, 0, 0, 1, 1])
    for seed in range(30):
        rng = random.Random(seed)
        sizes = [rng.randrange(1, 1000) for _ in range(rng.randrange(1, 60))]
        got = sharding.karmarkar_karp(sizes, 8)
        assert len(got) == len(sizes) and set(got) <= set(range(8))
        load = [sum(s for s, g in zip(sizes, got) if g == k) for k in range(8)]
        assert max(load) - min(load) <= max(sizes)
    assert sharding.karmarkar_karp([], 8) == []


def test_shards(spark, texts):
    out = sharding.shard_documents(documents(spark, texts), n_shards=3, rows_per_run=20).collect()
    assert len(out) == len(texts)
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    of_text = defaultdict(set)
    by_id = defaultdict(set)
    for d, t in texts:
        by_id[d].add(t)
    for r in out:
        if len(by_id[r.doc_id]) == 1:
            of_text[next(iter(by_id[r.doc_id]))].add(r.shard)
    assert all(len(s) == 1 for s in of_text.values())
    for s in range(3):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    rest = [r for r in out if r.doc_id != 206]  # the long text outweighs all else
    assert {r.law for r in out} == {"bytes"} and len({r.shard for r in rest}) == 2
    load = Counter()
    for r in rest:
        load[r.shard] += r["size"]
    assert max(load.values()) - min(load.values()) <= max(r["size"] for r in rest)
    assert sharding.shard_documents(documents(spark, [])).count() == 0


# --- mixing


def test_mix_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 30)), "en", f"s{rng.choice([0, 0, 0, 1, 2, 3])}" if i % 40 else None) for i in range(600)] + [(9001, None, "en", "null-size"), (9002, "", "en", "null-size")]
    weights = {i: 2.0 for i in range(0, 600, 3)} | {i: 0.5 for i in range(1, 600, 3)}
    quality = spark.createDataFrame(list(weights.items()), "doc_id long, weight double")
    out = {r.doc_id: r for r in mixing.mix(documents(spark, rows), quality, rows_per_bin=25).collect()}
    assert len(out) == len(rows)
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    sources = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    total = {s: sum(size[r[0]] for r in rows if r[3] == s) for s in sources}
    w = {s: i % 3 + 1 for i, s in enumerate(sources)}
    target, open_, left = {}, set(sources), float(sum(total.values()))
    while True:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > 3 * total[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= target[s]
        open_ -= over
    target |= {s: level * w[s] for s in open_}
    for s in sources:
        mine = [r[0] for r in rows if r[3] == s]
        assert all(abs(out[d].target - target[s]) < 1e-6 and out[d].source_size == total[s] for d in mine)
        epochs = int(target[s] // total[s]) if total[s] else 0
        budget = target[s] - epochs * total[s]

        def key(d):
            u = (int(hashlib.md5(f"mix-1:{d}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            return -np.log(u) / weights.get(d, 1.0)

        upto = 0
        for d in sorted(mine, key=key):
            upto += size[d]
            more = budget > 0 and upto - size[d] / 2 <= budget
            assert out[d].copies == min(3, epochs + more), (s, d)
            assert out[d].taken == out[d].copies * size[d]
        assert abs(sum(out[d].taken for d in mine) - target[s]) <= max(size[d] for d in mine)
    mixed = mixing.mixed_documents(documents(spark, rows), quality, rows_per_bin=25)
    assert mixed.columns == documents(spark, rows).columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({d: r.copies for d, r in out.items() if r.copies})
    assert mixing.mix(documents(spark, [])).count() == 0


# --- URL filters


def test_urls(spark):
    urls = ["http://A.Example.ORG/es/1?x", "https://b.example.org/en/12", "http://x.com/fr/1", "http://x.com/de/9#q", "http://x.net", "nourl", None, "", "ftp://h.net/a/b/c/d/e/f/g/h/i", "http://badexample.org/es/1", "http://x.com?/de/", "http://x.net", "http://org/x"]
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate(urls)] + [(100 + i, f"http://s.com/{'de' if i % 2 else 'fr'}/{i}.html", "", "") for i in range(60)] + [(300 + i, f"http://t.net/{'de' if i % 2 else 'fr'}/{i}.html", "", "") for i in range(10)], "page_id long, url string, host string, k0 string")
    got = {r.page_id: r for r in urlfilter.judge_urls(pages).collect()}
    assert len(got) == pages.count()
    want = {0: ("a.example.org", "/es/1", "example.org/es/", "block"), 1: ("b.example.org", "/en/12", "example.org/en/1", "block"), 2: ("x.com", "/fr/1", "com/fr/", "allow"), 3: ("x.com", "/de/9", "com/de/", "block"), 9: ("badexample.org", "/es/1", "org/", "allow"), 12: ("org", "/x", "org/", "allow")}
    for i, w in want.items():
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == w
    assert (got[4].host, got[4].path, got[4].rule, got[4].verdict) == ("x.net", "", None, got[11].verdict) and (got[10].host, got[10].path, got[10].rule) == ("x.com", "", None)
    for i in (5, 6, 7):
        assert (got[i].host, got[i].path, got[i].rule) == ("", "", None)
    # unruled templates follow the same template elsewhere
    assert {got[300 + i].verdict for i in range(1, 10, 2)} == {"block"} and {got[300 + i].verdict for i in range(0, 10, 2)} == {"allow"}
    assert got[101].template == "/de/{n}.html" and got[8].template == "/a/b/c/d/e/f/g/h/i"
    assert urlfilter.judge_urls(pages.limit(0)).count() == 0


def naive_templates(rows, z=2.0):
    """The tree by recursion over (host, path, blocked) of distinct URLs: {(host, path): template}."""
    import math

    def look(seg):
        return "{h}" if re.fullmatch("(?=.*[0-9])[0-9a-fA-F]{8,}", seg) else re.sub("[0-9]+", "{n}", seg)

    out = {}

    def walk(part, level, template):
        ended = [r for r in part if len(r[1]) == level]
        for r in ended:
            out[r[0]] = template
        part = [r for r in part if len(r[1]) > level]
        if not part:
            return
        known = [r[2] for r in part if r[2] is not None]
        if not known or len(part) == 1:
            for r in part:
                out[r[0]] = template + "/" + "/".join(r[1][level:])
            return
        kids = defaultdict(list)
        for r in part:
            kids[r[1][level]].append(r)
        nn, bb = len(known), sum(known)
        share, to = (bb + 1) / (nn + 2), defaultdict(list)
        for seg, mine in kids.items():
            own = [r[2] for r in mine if r[2] is not None]
            n, b = len(own), sum(own)
            gap = (b + share) / (n + 1) - (bb - b + share) / (nn - n + 1)
            spread = math.sqrt(share * (1 - share) * (1 / (n + 1) + 1 / (nn - n + 1)))
            to["*" if len(kids) > 1 and not (n and abs(gap) >= z * spread) else seg] += mine
        for seg, mine in to.items():
            walk(mine, level + 1, f"{template}/{seg}")

    hosts = defaultdict(list)
    for h, p, b in rows:
        hosts[h].append(((h, p), [look(s) for s in re.sub("^/", "", p).split("/")], b))
    for part in hosts.values():
        walk(part, 0, "")
    return out


def test_templates_equal_plain_recursion(spark):
    rng = random.Random(12)
    rows = {}
    for i in range(900):
        depth = rng.randrange(0, 12) if i % 9 == 0 else rng.randrange(1, 4)
        path = "".join("/" + rng.choice(["a", "b", "bad", "good", "x", str(rng.randrange(400)), f"p{rng.randrange(30)}", "deadbeef01", ""]) for _ in range(depth))
        rows[rng.choice(["h", "h", "k.org", "", "solo"]), path] = rng.choice([None, 1 if "bad" in path else 0])
    rows |= {("unlabelled", f"/q/{i}/r"): None for i in range(20)}
    rows = [(h, p, b) for (h, p), b in rows.items()]
    got = urlfilter.template_tree(spark.createDataFrame(rows, "host string, path string, blocked int")).collect()
    assert {(r.host, r.path): r.template for r in got} == naive_templates(rows) and len(got) == len(rows)
    # purity by plain sums
    want, look, own = {}, defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for r in got:
        if r.blocked is not None:
            for x in (look[r.look], own[r.host, r.template]):
                x[0] += r.blocked
                x[1] += 1
    prior = sum(r.blocked or 0 for r in got) / sum(r.blocked is not None for r in got)
    for r in got:
        a, b = look[r.look], own[r.host, r.template]
        want[r.host, r.path] = (b[0] + 4 * (a[0] + 4 * prior) / (a[1] + 4)) / (b[1] + 4)
    tree = spark.createDataFrame(got, "host string, path string, blocked int, look string, template string")
    pure = {(r.host, r.path): r.purity for r in urlfilter.template_purity(tree).collect()}
    assert pure.keys() == want.keys() and all(abs(pure[k] - want[k]) < 1e-9 for k in want)


def test_similar_branches_merge(spark):
    rows = [("h", f"/user/{chr(97 + i)}/x", 0) for i in range(26)] + [("h", f"/good/p{chr(97 + i)}", 0) for i in range(10)] + [("h", f"/bad/p{chr(97 + i)}", 1) for i in range(10)]
    for some in (rows, rows[23:]):  # with many children and with few
        got = {r.path: r.template for r in urlfilter.template_tree(spark.createDataFrame(some, "host string, path string, blocked int")).collect()}
        assert len({t for p, t in got.items() if p.startswith("/user/")}) == 1
        assert got["/bad/pa"].startswith("/bad/") and got["/bad/pa"] == got["/bad/pb"] and not got["/good/pa"].startswith("/bad/")


def test_urls_that_differ_deep_down(spark):
    rows = [(f"http://a.example.net/1/2/3/4/5/6/7/{'bad' if i % 2 else 'good'}/{i}", i % 2) for i in range(40)]
    urls = spark.createDataFrame([("a.example.net", u.split("net", 1)[1], b) for u, b in rows], "host string, path string, blocked int")
    got = urlfilter.template_purity(urlfilter.template_tree(urls)).collect()
    assert {r.template.split("/")[8] for r in got} == {"bad", "good"}
    assert all((r.purity >= 0.5) == bool(r.blocked) for r in got)


# --- fingerprints


def naive_hash(codes):
    """The rolling hash of code points, one by one: the highest power for the first."""
    a, h = 0xD1342543DE82EF95, 0
    for c in codes:
        h = (h * a + int(fingerprint.mix(np.array([c], np.uint64) + np.uint64(1))[0])) % 2**64
    return h


def naive_anchors(text):
    """Position and 12 bits of the hash of each k-mer whose least inner s-mer is its first or last."""
    K, S = fingerprint.K, fingerprint.S
    codes = [ord(c) for c in text]
    final = lambda h: int(fingerprint.mix(np.array([h], np.uint64))[0])
    out = []
    for i in range(len(codes) - K + 1):
        inner = [final(naive_hash(codes[j : j + S])) for j in range(i, i + K - S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            a8, a16 = pow(0xD1342543DE82EF95, 8, 2**64), pow(0xD1342543DE82EF95, 16, 2**64)
            q = [naive_hash(codes[i + 8 * x : i + 8 * x + 8]) for x in range(4)]
            out.append((i, final(((q[0] * a8 + q[1]) * a16 + q[2] * a8 + q[3]) % 2**64) >> 52))
    return out


def naive_fingerprint(text):
    """(fingerprint, tokens) by plain loops."""
    found = naive_anchors(text)
    if not found and text:
        h = len(text)
        for c in text:
            h = int(fingerprint.mix(np.array([(h + int(fingerprint.mix(np.array([ord(c)], np.uint64))[0])) % 2**64], np.uint64))[0])
        found = [(0, h >> 52)]
    digits, out, shown, before = fingerprint._DIGITS.tobytes().decode(), [], "", 0
    for p, h in found:
        gap, before = p - before, p
        out.append((gap, h))
        shown += digits[63] * (gap // 63) + digits[gap % 63] + digits[h >> 6] + digits[h & 63]
    return shown, out


def naive_likeness(a, b):
    """By the whole table of longest common sequences of tokens."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, p in enumerate(a):
        for j, q in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if p == q else max(best[i][j + 1], best[i + 1][j])
    shared = best[-1][-1]
    return shared / (len(a) + len(b) - shared) if len(a) or len(b) else 1.0


@pytest.mark.parametrize("block", [3, 64, 1 << 15])
@pytest.mark.parametrize("few", [0, 20])
def test_likeness_where_tokens_repeat(monkeypatch, few, block):
    monkeypatch.setattr(fingerprint, "FEW_PAIRS", few)
    monkeypatch.setattr(fingerprint, "BLOCK_BITS", block)
    assert fingerprint.likeness(np.array([5, 7, 5]), np.array([7, 5])) == 2 / 3
    rng = random.Random(few)
    for _ in range(150):
        values = rng.choice([2, 5, 40])
        a, b = ([rng.randrange(values) for _ in range(rng.randrange(0, 90))] for _ in range(2))
        if rng.random() < 0.5:
            at = rng.randrange(len(a) + 1)
            b = a[at:] + a[:at] + b[:3]
        assert fingerprint.likeness(np.array(a, np.int64), np.array(b, np.int64)) == naive_likeness(a, b)


def test_likeness_of_texts_with_repeated_lines():
    rng = random.Random(8)
    prose = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    line = "the same line stands here more than once, as in a license.\n"
    for a, b in ((line * 3 + prose, prose), (prose + line * 40, line * 12 + prose + line * 28), (line * 60 + prose, prose[:1500] + line * 30 + prose[1500:])):
        x, y = fingerprint.tokens(a), fingerprint.tokens(b)
        assert fingerprint.likeness(x, y) == naive_likeness(x.tolist(), y.tolist())


def test_fingerprints(spark, texts):
    rows = [(d, t) for d, t in texts if d is not None and len(t or "") < 6000][:70:2] + [(900, "x" * 400), (901, ""), (902, None), (903, "ab" * 20)]
    rows = list(dict(rows).items())
    got = {r.doc_id: r for r in fingerprint.fingerprint_documents(documents(spark, rows, 5)).collect()}
    order = sorted(dict(rows).items(), reverse=True)
    assert len(got) == len(rows)
    made = {t: naive_fingerprint(t) for _, t in [(0, t or "") for _, t in order]}
    for i, (d, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        m = len(t) // 3
        e = t[: len(t) - m] + n[:m]
        own, new, r = made[t], naive_fingerprint(e), got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (own[0], new[0])
        assert r.near_edited == naive_likeness(own[1], new[1]) and r.near_next == naive_likeness(own[1], made[n][1])
    text = texts[3][1] + " far from it"
    assert fingerprint.anchors(text)[0].tolist() == [p for p, _ in naive_anchors(text)]
    assert fingerprint.fingerprint_documents(documents(spark, [])).count() == 0
    one = fingerprint.fingerprint_documents(documents(spark, [(1, "x" * 40)])).first()
    assert one.near_next == 1.0
    assert fingerprint.document_anchors(documents(spark, [(1, text), (2, None)])).count() == len(naive_anchors(text))


def test_fingerprints_are_read_back():
    rng = random.Random(2)
    for n in (0, 1, 31, 32, 60, 500, 5000):
        made = fingerprint.tokens("".join(rng.choice("abc dé") for _ in range(n)))
        assert fingerprint.read_tokens(fingerprint.write_tokens(made)).tolist() == made.tolist()
    far = np.array([0 << 12 | 5, 62 << 12 | 4095, 63 << 12, 640 << 12 | 77])
    assert fingerprint.read_tokens(fingerprint.write_tokens(far)).tolist() == far.tolist()


def test_likeness_follows_edits():
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(6000))
    moved = text[:2000] + "inserted words " + text[2000:]
    swapped = text[3000:] + text[:3000]
    other = "".join(rng.choice("abcdefgh ") for _ in range(6000))
    like = lambda x: fingerprint.likeness(fingerprint.tokens(text), fingerprint.tokens(x))
    assert like(text) == 1.0 and like(moved) > 0.97 and like(other) < 0.01
    assert 0.3 < like(swapped) < 0.36  # half of it is in order


def test_short_texts_have_fingerprints(spark):
    rng = random.Random(6)
    for n in range(1, 60):
        made = ["".join(rng.choice("abcdefghé ") for _ in range(n)) for _ in range(60)]
        found = {t: fingerprint.tokens(t) for t in made}
        assert all(len(s) for s in found.values())
        whole = [t for t in found if not len(fingerprint.anchors(t)[0])]
        assert not whole or n <= 54
        assert all(fingerprint.likeness(found[t], found[t]) == 1.0 for t in whole)
        assert all(fingerprint.likeness(found[t], fingerprint.tokens("")) == 0.0 for t in made)
    rows = [(2, "Ente erkeitung chst."), (1, None)]
    got = {r.doc_id: r for r in fingerprint.fingerprint_documents(documents(spark, rows)).collect()}
    assert got[2].fingerprint and got[2].near_next == 0.0 and not got[1].fingerprint
    assert fingerprint.document_anchors(documents(spark, rows)).count() == 1


# --- decontamination


def test_decontamination(spark, texts):
    rng = random.Random(6)
    rows = list(texts)
    bench = [(i, " ".join(rng.choice(["x", "y", "Z,", "q-r", "é"]) for _ in range(rng.randrange(1, 40)))) for i in range(25)] + [(50, None), (51, "..."), (52, "one"), (7, "seven words"), (7, texts[8][1])]
    for i in range(40):
        t = bench[rng.randrange(25)][1].split(" ")
        a = rng.randrange(len(t))
        rows.append((1000 + i, "pre " + " ".join(t[a:]) + " post " + " ".join(rng.choice("xyz") for _ in range(rng.randrange(30)))))
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    bench_df = spark.createDataFrame([(*b, "z") for b in bench], "item_id long, text string, spans string")
    frames = [decontam.match_benchmark(documents(spark, rows), bench_df, block_bytes=b, shard_bytes=n).collect() for b, n in ((1_000_000, 1), (300, 1_000_000), (300, 500))]

    def judge(text):
        w, hit, items = split(text), set(), set()
        for k, b in bench:
            b = split(b)
            n = min(13, len(b))
            for j in range(max(0, len(b) - n + 1) if n else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == b[j : j + n]:
                        hit |= set(range(i, i + n))
                        items.add(str(k))
        return len(w), tuple(sorted(hit)), tuple(sorted(items))

    want = Counter((d, *judge(t)) for d, t in rows if d != 206)
    for got in frames:
        have = Counter((r.doc_id, r.n_words, tuple(x for s in r.spans for x in range(s.start, s.end)), tuple(r["items"])) for r in got if r.doc_id != 206)
        assert have == want
    assert all({r.doc_id: r.longest for r in frames[0]} == {r.doc_id: r.longest for r in f} for f in frames[1:])
    clean = decontam.match_benchmark(documents(spark, rows), bench_df.limit(0)).filter("size(items) > 0")
    assert clean.count() == 0 and decontam.match_benchmark(documents(spark, []), bench_df).count() == 0


# --- near duplicates


def jaccard_groups(rows, k, percent):
    def sets(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()

    s = [sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(s[i] & s[j])
            if s[i] and s[j] and 100 * shared >= percent * (len(s[i]) + len(s[j]) - shared):
                parent[find(i)] = find(j)
    names = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        names[find(i)].append(d)
    out = Counter()
    for i, (d, _) in enumerate(rows):
        known = [x for x in names[find(i)] if x is not None]
        out[d, len(s[i]), min(known) if known else None] += 1
    return out


@pytest.mark.parametrize(("k", "percent", "block"), [(4, 85, 1024), (5, 80, 8), (2, 40, 16)])
def test_jaccard_groups(spark, texts, k, percent, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "LEAF", 4)
    rows = texts
    got = Counter(tuple(r) for r in neardup.near_duplicates(documents(spark, rows), k, percent).select("doc_id", "n_shingles", "component_id").collect())
    assert got == jaccard_groups(rows, k, percent)


@pytest.mark.parametrize(("k", "percent", "block"), [(4, 85, 1024), (2, 40, 16)])
def test_links_inside_components_are_found(spark, texts, k, percent, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "LEAF", 4)
    words = " ".join(f"w{i}" for i in range(60)).split()
    rows = [*texts, *[(300 + i, " ".join([*words[:-1], f"x{i}"])) for i in range(3)]]  # all three link

    def sets(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()

    of = [sets(t) for _, t in rows]
    ids = defaultdict(list)
    for (d, _), s in zip(rows, of):
        ids[s].append(d)
    least = {s: min((d for d in v if d is not None), default=None) for s, v in ids.items()}
    links = Counter()
    for s in least:
        for o in least:
            shared = len(s & o)
            links[s] += bool(s and o and s != o and 100 * shared >= percent * (len(s) + len(o) - shared))
    got = Counter(tuple(r) for r in neardup.link_counts(documents(spark, rows), k, percent).collect())
    assert got == Counter((d, least[s] if s else d, links[s]) for (d, _), s in zip(rows, of))
    assert all(links[of[-1 - i]] == 2 for i in range(3))
    assert neardup.near_duplicate_links(documents(spark, rows), k, percent)[1].count() * 2 == sum(links.values())


def test_near_duplicates_go(spark, texts):
    rows = [r for r in texts if r[0] is not None]
    left = neardup.without_near_duplicates(documents(spark, rows))
    assert left.columns == documents(spark, rows).columns
    want = {d for d, _, c in jaccard_groups(rows, 5, 80) if d == c}
    assert {r.doc_id for r in left.collect()} == want
    assert neardup.near_duplicates(documents(spark, [])).count() == 0


def test_near_duplicates_go_by_row(spark):
    long, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(None, long), (None, long), (7, other), (7, other), (8, other), (9, "a b c d e f"), (10, "a b c d e f"), (10, "alone in the table with this text")]
    left = neardup.without_near_duplicates(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.text) for r in left) == Counter([(None, long), (7, other), (9, "a b c d e f"), (10, "alone in the table with this text")])


def test_tree_finds_every_pair_in_reach():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**63, rng.integers(1, 60) * (1 + 20 * (i % 3))).astype(np.uint64) * np.uint64(2)) for i in range(30)]
    sets += [np.unique(np.concatenate([s[1:], rng.integers(0, 2**63, 1).astype(np.uint64)])) for s in sets]
    n, vec = np.array([len(s) for s in sets]), neardup.read_vectors([neardup.count_vector(s) for s in sets])
    a, b = neardup.tree_pairs(n, vec, 85)
    raw = [neardup.count_vector(s) for s in sets]
    ok = neardup.within_reach(raw, n, a, b, 85)
    found = {tuple(sorted(p)) for p in zip(a[ok].tolist(), b[ok].tolist())}
    for i in range(len(sets)):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if 100 * shared >= 85 * (len(sets[i]) + len(sets[j]) - shared):
                assert (j, i) in found


def test_finest_counts_are_summed_minima():
    rng = np.random.default_rng(3)
    lists = [np.sort(rng.integers(0, 40, rng.integers(1, 60)).astype("<u4")) for _ in range(20)]
    got = neardup.overlaps(lists)
    for i, a in enumerate(lists):
        for j, b in enumerate(lists):
            assert i == j or got[i, j] == sum((Counter(a.tolist()) & Counter(b.tolist())).values())


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (102, 101), (7, 7)] + [(200, 200 + i) for i in range(1, 40)]
    got = {r.x: r.root for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 103)} | {i: 200 for i in range(200, 240)}


# --- tokens


@pytest.fixture(scope="module")
def vocab():
    return pytest.importorskip("public_tokenizers")


def test_token_counts(spark, texts, vocab, tmp_path):
    from tokenizers import Tokenizer

    path, cache = vocab.path("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    rows = [*texts, (300, "a<|endoftext|>b  don't\n\n x"), (301, "日本  x")]
    t = Tokenizer.from_file(path)
    want = Counter((d, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for d, x in rows)
    got = tokencount.count_tokens(documents(spark, rows), path, cache)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_bytes", "n_tokens").collect()) == want
    assert spark.read.parquet(cache).count() == len({x or "" for _, x in rows})
    again = tokencount.count_tokens(documents(spark, [*rows, (400, "brand new")]), path, cache)
    assert again.count() == len(rows) + 1 and spark.read.parquet(cache).count() == len({x or "" for _, x in rows}) + 1
    other = tokencount.count_tokens(documents(spark, rows[:3]), vocab.path("piece_bpe_32k.model"), cache)
    assert other.count() == 3 and spark.read.parquet(cache).select("tokenizer").distinct().count() == 2
    assert tokencount.count_tokens(documents(spark, []), path, cache).count() == 0


def test_token_files(spark, texts, vocab, tmp_path):
    from tokenizers import Tokenizer

    path = vocab.path("word_bpe_49k.json")
    rows = [r for r in texts if r[0] != 5] + [(-3, "Ünï 12 !!"), (777, "it's")]
    manifest = common.cut(tokenfiles.write_token_files(documents(spark, rows), path, f"file://{tmp_path}/files"), "manifest")
    got = tokenfiles.read_token_files(manifest).collect()
    t, at, want = Tokenizer.from_file(path), 0, Counter()
    for d, x in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        want[d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        at += len(ids)
    assert Counter(tuple(r) for r in got) == want
    files = [tokenfiles.TokenFile(r.path) for r in manifest.collect()]
    found = {d: [f.get(d) for f in files if f.get(d) is not None] for d, _ in rows if d is not None}
    assert all(len(f) == 1 for f in found.values())
    assert found[-3][0].tolist() == [*t.encode("Ünï 12 !!", add_special_tokens=False).ids, 1]
    assert sum(f.get(k) is not None for f in files for k in range(10_000, 10_400)) == 0
    none = tokenfiles.write_token_files(documents(spark, []), path, f"file://{tmp_path}/none")
    assert tokenfiles.read_token_files(none).count() == 0


def test_perfect_hash():
    keys = np.random.default_rng(1).choice(2**62, 5000, replace=False)
    table = tokenfiles.PerfectHash.build(keys)
    assert sorted(table.slot(keys).tolist()) == list(range(5000))
    assert tokenfiles.PerfectHash.build(keys[:0]).slot(np.array([5])).tolist() == [-1]


# --- classifiers


def test_language(spark):
    rng = random.Random(8)
    stems = {"aa": ["the", "and", "ing", "tion"], "bb": ["der", "und", "sch", "ein"], "cc": ["ção", "que", "los", "ñar"]}
    rows = []
    for i in range(400):
        lang = rng.choice(list(stems))
        rows.append((i, " ".join(rng.choice(stems[lang]) + rng.choice(stems[lang]) for _ in range(rng.randrange(2, 40))), lang, "s"))
    rows += [(900, None, "aa", "s"), (901, "", "aa", "s"), (902, "12 !?", None, "s"), (903, "the and", None, "s")]
    df = documents(spark, rows)
    model = langid.fit(df.filter("doc_id % 4 <> 0"))
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    held = [r for r in rows if r[0] % 4 == 0 and r[0] < 400]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.97 * len(held)
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"} and not got[900].accepted and got[903].lang_pred == "aa"
    none = langid.identify(df, langid.fit(df.limit(0)))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert langid.identify(documents(spark, []), model).count() == 0


def test_toxicity(spark):
    rng = random.Random(8)
    plain = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(600)]
    bad = ["zorkish", "zorker", "quaxly", "quaxen", "wibbled"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        w = [rng.choice(plain) for _ in range(rng.randrange(3, 200))]
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, 1, int(toxic)))
    rows += [(5000, None), (5001, ""), (5002, "!!")]
    df = documents(spark, [r if len(r) == 4 else (*r, "en", "s") for r in rows])
    lab = spark.createDataFrame([*labels, (0, 1, 0), (None, 1, 1), (7777, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(toxicity.labelled(df, lab))
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((got[i] >= toxicity.THRESHOLD) == (i % 5 == 0) for i in held)
    assert right >= 0.95 * len(held)
    assert max(got[5000], got[5001], got[5002]) < toxicity.THRESHOLD
    none = toxicity.fit(toxicity.labelled(df, lab.limit(0)))
    assert max(r.score for r in toxicity.score(df, none).collect()) < 0.01
    assert toxicity.score(documents(spark, []), model).count() == 0
