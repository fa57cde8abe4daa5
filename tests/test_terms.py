"""A table of terms against one replacement after another; the strict set against plain checks."""

import random
import re

from pyspark.sql import functions as F

from quillspark.functions import redact as R
from quillspark.operators import terms as T


def made(seed=4):
    rng = random.Random(seed)
    alphabet = ["the", "The", "cat", "Über", "ß", "straße", "x_1", "é", "of", "and", "C", "İst", "k", "K", "12", "redacted_term", "TERM"]
    gaps = [" ", "-", "--", ", ", "\n", ".", "[", "]", "'", "++", " ("]
    text = lambda n: "".join(rng.choice(alphabet) + rng.choice(gaps) for _ in range(rng.randrange(0, n)))
    terms = [text(4).strip() + rng.choice(["", "", "the", "+"]) for _ in range(40)] + ["cat", "CAT", "  of and ", "", "--", "c++", "-the", "the-", "a[", "redacted_term", "$1", "\\d", "(?i)", "kat"]
    return [text(40) for _ in range(300)] + ["", "the cat", None], terms


def test_table_equals_one_after_another(spark):
    texts, terms = made()
    docs = spark.createDataFrame([(i % 9, t, "c") for i, t in enumerate([*texts, *texts[:20]])], "doc_id long, text string, p_ string").drop("p_")
    table = spark.createDataFrame(list(enumerate(terms)), "seq int, term string").repartition(3)
    want = docs.withColumn("redacted", R.redact_terms(F.col("text"), terms)).collect()
    for most in (500_000, 0):
        T.MOST_SENT, before = most, T.MOST_SENT
        got = T.redact_term_table(docs, table).collect()
        T.MOST_SENT = before
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert sum(r.redacted != r.text for r in want) > 200
    plain = [t for t in terms if t.strip() and not re.search("redacted|^[^\\w]|[^\\w]$", t)]
    few = T.redact_term_table(docs, spark.createDataFrame(list(enumerate(plain)), "seq int, term string")).collect()
    assert sorted(map(repr, few)) == sorted(map(repr, docs.withColumn("redacted", R.redact_terms(F.col("text"), plain)).collect()))
    none = T.redact_term_table(docs, table.limit(0)).collect()
    assert all(r.redacted == r.text for r in none) and T.redact_term_table(docs.limit(0), table).count() == 0


def test_many_terms(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7919 + j * 31) % 150_000}" for j in range(200))) for i in range(50)], "doc_id long, text string")
    table = spark.range(100_000).selectExpr("id AS seq", "concat('W', id) AS term")
    got = {r.doc_id: r.redacted for r in T.redact_term_table(docs, table).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == " ".join("[REDACTED_TERM]" if int(w[1:]) < 100_000 else w for w in r.text.split(" "))


def test_strict_set(spark):
    good, bad = "4111 1111 1111 1111", "4111 1111 1111 1112"
    pem = "-----BEGIN PRIVATE KEY-----\nabc\n-----END PRIVATE KEY-----"
    text = f"a {good} b {bad} c 4111111111111111 d 999.1.1.1 e 10.0.255.1 f 1.2.3.4.5 g 256.1.1.1 {pem} -----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----"
    row = spark.createDataFrame([(text,)], "t string").select(R.redact(F.col("t"), strict=True).alias("s"), R.redact(F.col("t")).alias("d")).first()
    assert row.s == f"a [REDACTED_CC] b {bad} c [REDACTED_CC] d 999.1.1.1 e [REDACTED_IP] f 1.2.3.4.5 g 256.1.1.1 [REDACTED_PRIVATE_KEY] [REDACTED_PRIVATE_KEY]"
    assert "999.1.1.1" not in row.d and bad not in row.d and pem in row.d

    def luhn(s):
        d = [int(c) for c in s if c in "0123456789"][::-1]
        return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0

    rng = random.Random(2)
    numbers = ["".join(rng.choice("0123456789-") for _ in range(rng.randrange(1, 20))) for _ in range(200)]
    got = spark.createDataFrame([(n,) for n in numbers], "n string").select("n", R.luhn(F.col("n")).alias("ok")).collect()
    assert all(r.ok == luhn(r.n) for r in got) and {r.ok for r in got} == {True, False}


def test_single_words_are_tried_where_a_word_begins(spark):
    words = [(i, T.BEFORE + w + T.AFTER, single) for i, (w, single) in enumerate([("cat", True), ("Über", True), ("a-b", False), ("dog", True)])]
    kind = "i int, t array<struct<seq:bigint,pattern:string,single:boolean>>"
    rows = spark.createDataFrame([(0, words), (1, words[:2]), (2, [])], kind).select("i", T.passes(F.col("t")).alias("p"))
    assert {r.i: r.p for r in rows.collect()} == {0: [r"(?iuU)\b(?:cat|Über)\b", r"(?iuU)\ba-b\b", r"(?iuU)\b(?:dog)\b"], 1: [r"(?iuU)\b(?:cat|Über)\b"], 2: []}
