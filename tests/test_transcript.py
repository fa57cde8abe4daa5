import random

from pyspark.sql import functions as F

from quillspark.operators import transcript as S

SEG = "doc_id long, seq long, start double, end double, speaker string, text string"
WORD = "doc_id long, seq long, word string, start double, end double"


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("doc_id", "seq").collect()]


def merge(segs, gap=3.0):
    out = []
    for start, end, spk, text in segs:
        text = (text or "").strip()
        if not text:
            continue
        end = max(start, end)
        if out and spk and out[-1][2] == spk and start - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(out[-1][1], end), spk, f"{out[-1][3]} {text}")
        else:
            out.append((start, end, spk, text))
    return out


def test_merge_turns_equals_a_loop(spark):
    rng = random.Random(1)
    calls = {c: [(round(rng.uniform(0, 40), 1) if c % 3 else i * 2.0, round(rng.uniform(0, 40), 1), rng.choice(["A", "A", "B", None]), rng.choice(["x", " y ", " ", "z"])) for i in range(rng.randrange(1, 15))] for c in range(120)}
    df = spark.createDataFrame([(c, i, *s) for c, segs in calls.items() for i, s in enumerate(segs)], SEG).repartition(5)
    got: dict = {}
    for r in S.merge_turns(df).orderBy("doc_id", "seq").collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.speaker, r.text))
    assert got == {c: m for c, s in calls.items() if (m := merge(s))}


def test_render(spark):
    segs = spark.createDataFrame([(1, 0, 74.0, 75.0, "Speaker 1", "Hi."), (1, 1, 76.3, 77.0, "Speaker 1", "Again."), (1, 2, 82.0, 83.0, None, "Who?")], SEG)
    titles = spark.createDataFrame([(1, "Call"), (2, "Empty")], "doc_id long, title string")
    got = {r.doc_id: r.markdown for r in S.render_transcripts(titles, segs).collect()}
    assert got[1] == "# Call\n\n**[00:01:14] Speaker 1:** Hi. Again.\n\n**[00:01:22]** Who?\n"
    assert got[2] == "# Empty\n\n*(No speech detected in audio track.)*\n"


def test_diarize(spark):
    words = spark.createDataFrame([(1, 0, "Hello", 0.0, 0.5), (1, 1, "there", 0.6, 0.9), (1, 2, ".", 1.0, 1.2), (1, 3, "Bye", 5.0, 5.4)], WORD)
    turns = spark.createDataFrame([(1, 0, "S7", 0.0, 0.55), (1, 1, "S2", 0.58, 0.95), (1, 2, "S7", 0.95, 2.0), (1, 3, "S2", 4.9, 6.0)], "doc_id long, seq long, speaker_id string, start double, end double")
    assert rows(S.diarize(words, turns), "start", "end", "speaker", "text") == [(0.0, 1.2, "Speaker 1", "Hello there."), (5.0, 5.4, "Speaker 2", "Bye")]


def test_assignment_and_flips_equal_loops(spark):
    rng = random.Random(2)
    words, turns = [], []
    for d in range(40):
        t = 0.0
        for i in range(rng.randrange(1, 25)):
            s = t + rng.uniform(0, 1.0)
            e = s + rng.uniform(0, 1.0)
            words.append((d, i, f"w{i}", s, e))
            t = e
        turns += [(d, i, f"S{rng.randrange(3)}", s := rng.uniform(0, 15), s + rng.uniform(0, 3)) for i in range(rng.randrange(0, 6))]
    got = {(r.doc_id, r.seq): r.raw_speaker for r in S.assign_speakers(spark.createDataFrame(words, WORD), spark.createDataFrame(turns, "doc_id long, seq long, speaker_id string, start double, end double")).collect()}
    for d, i, _, s, e in words:
        mine = [t for t in turns if t[0] == d]
        best, spk = 0.0, mine[0][2] if mine else "S1"
        for t in mine:
            if (o := min(e, t[4]) - max(s, t[3])) > best:
                best, spk = o, t[2]
        if mine and best <= 0:
            mid = 0.5 * (s + e)
            spk = min(mine, key=lambda t: (max(t[3] - mid, mid - t[4], 0), t[1]))[2]
        assert got[d, i] == spk
    raw = [(d, i, w, s, e, rng.choice("AB")) for d, i, w, s, e in words]
    smooth = {(r.doc_id, r.seq): r.raw_speaker for r in S.smooth_flips(spark.createDataFrame(raw, WORD + ", raw_speaker string")).collect()}
    for d in range(40):
        w = [list(x) for x in raw if x[0] == d]
        for i in range(1, len(w) - 1):
            if w[i - 1][5] == w[i + 1][5] != w[i][5] and w[i][4] - w[i][3] < 0.55 and w[i][3] - w[i - 1][4] < 0.75 and w[i + 1][3] - w[i][4] < 0.75:
                w[i][5] = w[i - 1][5]
        assert [smooth[d, x[1]] for x in w] == [x[5] for x in w]


def test_subwords_and_empty(spark):
    tokens = spark.createDataFrame([(1, 0, "[_BEG_]", 0.0, 0.0), (1, 1, " Hel", 0.1, 0.2), (1, 2, "lo", 0.2, 0.4), (1, 3, "▁world", 0.5, 0.8), (1, 4, "!", 0.8, 0.9), (1, 5, "<|x|>", 1.0, 1.0)], "doc_id long, seq long, token string, start double, end double")
    assert rows(S.merge_subwords(tokens), "word", "start", "end") == [("Hello", 0.1, 0.4), ("world!", 0.5, 0.9)]
    none = spark.createDataFrame([], WORD)
    assert S.undiarized_segments(none).count() == 0
    docs = spark.createDataFrame([(1, "  hi ", 3.14159), (2, " ", 1.0)], "doc_id long, text string, duration double")
    assert rows(S.fallback_segment(docs, "Speaker 1"), "end", "speaker", "text") == [(3.14, "Speaker 1", "hi")]
    assert S.interpolate_words(spark.createDataFrame([(1, 0, 0.0, 1.0, None, "ab c")], SEG)).orderBy("i").agg(F.collect_list("end")).first()[0][-1] == 1.0


def test_undiarized_segments_by_stretches(spark):
    """Against the fold over the whole transcript, with pauses, overlaps and ends that go back."""
    import random

    rng, rows = random.Random(11), []
    for d in range(12):
        t = -3.0 if d == 3 else 0.0
        for i in range(rng.randrange(1, 250)):
            t += rng.choice([0.1, 0.4, 0.4, 2.4, 2.6, 6.0, -1.0])
            rows.append((d, i * 2, rng.choice(["a", "b.", "c?", " "]), t, t + rng.choice([0.1, 0.5, 9.0, 50.0 if d == 5 else 0.3, -0.5])))
    r2 = lambda x: round(x, 2)
    want = []
    for d in range(12):
        segs, s = [], None
        for _, _, w, a, b in [r for r in rows if r[0] == d]:
            if s is not None and not (a - e > 2.5 or (words[-1][-1:] in (".", "?", "!") and e - s >= 15) or e - s >= 45):
                e = max(e, b)
                words.append(w)
                continue
            if s is not None:
                segs.append((s, e, words))
            s = max(0.0, a)
            e, words = max(b, s), [w]
        segs.append((s, e, words))
        want += [(d, i, r2(s), r2(e)) for i, (s, e, words) in enumerate(segs, 1) if "".join(words).strip()]
    df = spark.createDataFrame(rows, "doc_id long, seq long, word string, start double, end double").repartition(5)
    got = sorted((r.doc_id, r.seq, r.start, r.end) for r in S.undiarized_segments(df).collect())
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)]
    assert all(abs(g[k] - w[k]) < 0.011 for g, w in zip(got, sorted(want)) for k in (2, 3))
