"""Operator 12: an audit of how sources differ in their words.

Counts of the terms that a language keeps become smoothed shares in parts of 10**9, for
each (lang, source) group and for the language.  Two reports follow, in whole numbers throughout:

* ``term``: the terms in which a group exceeds its language most.  The kth value of a group is found by
  radix selection: histograms over the values' bits, from the highest down, each made with
  partial sums; terms that tie at the kth value are told apart by further
  histograms over two of their UTF-8 bytes at a time.  Only what reaches that threshold is sorted.
* ``pair``: how far a group is from each other source of its language, summed over all kept terms.  Most
  terms are missing on both sides: these all add the same baseline.  What the terms of one side add
  against the other's baseline follows from how many terms have each count; only terms that both sides have are
  joined, for the correction.

Defined cases: null text, lang and source count as ''; a text without terms only brings its group
into being; repeated rows are separate documents; a language that keeps nothing has pairs with
value 0 and no terms; a language with one source has no pairs; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import vector as V
from .common import cut, docs_table, sized, tune_arrow

#: Bytes of `[^\x00-\x40\x5B-\x60\x7B-\x7F]`, terms' characters.
LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0x80:] = True
#: Bytes of texts counted at once in a task.
CHUNK_BYTES = 8 << 20
#: Shares are parts of so many; each count is smoothed by SMOOTH.
PARTS, SMOOTH = 1_000_000_000, 2
#: Bits of a value (shares are at most PARTS + 1), and of a digit of the radix selection.
VALUE_BITS, DIGIT_BITS = 30, 10
#: Rows that tie at a group's threshold and may be sorted at once.
SETTLE = 2000


def batch_counts(langs: pa.Array, sources: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """The counts of some documents: terms become numbers in a dictionary of their own bytes, pairs of numbers are sorted and counted."""
    data, offsets = V.doc_bytes(texts)
    data = V.LOWER[data]
    starts, ends, doc = V.words(data, offsets, LETTER)
    lengths = ends - starts
    at = np.concatenate([[0], np.cumsum(lengths)])
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(data[LETTER[data]])).dictionary_encode()
    code, size = terms.indices.to_numpy().astype(np.int64), max(1, len(terms.dictionary))
    group = pa.StructArray.from_arrays([langs, sources], ["lang", "source"])
    known: dict[tuple, int] = {}
    of = np.array([known.setdefault((g["lang"], g["source"]), len(known)) for g in group.to_pylist()], np.int64)
    key, n = np.unique(of[doc] * size + code, return_counts=True)
    once = np.unique(doc * size + code)  # a term once for each of its documents
    d = np.bincount(np.searchsorted(key, of[once // size] * size + once % size), minlength=len(key))
    names = list(known)
    pick = lambda i: pa.array([g[i] for g in names], pa.string()).take(pa.array(key // size))
    return pa.RecordBatch.from_arrays([pick(0), pick(1), terms.dictionary.take(pa.array(key % size)).cast(pa.string()), pa.array(n), pa.array(d.astype(np.int64))], ["lang", "source", "term", "n", "d"])


def count_batches(batches):
    """Counts of about CHUNK_BYTES of texts at once."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= CHUNK_BYTES:
            yield batch_counts(*(c.combine_chunks() for c in pa.Table.from_batches(held).columns))
            held, size = [], 0
    if size:
        yield batch_counts(*(c.combine_chunks() for c in pa.Table.from_batches(held).columns))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents, summed up in Arrow batches before anything moves."""
    tune_arrow(docs.sparkSession)
    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    rows = rows.mapInArrow(count_batches, "lang string, source string, term string, n long, d long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(n: str, size: str, vocabulary: str) -> Column:
    """1 + floor(PARTS * (n + SMOOTH) / (size + SMOOTH * vocabulary)); exact for any 64-bit counts."""
    return F.expr(f"1 + (CAST({PARTS} AS DECIMAL(10, 0)) * CAST({n} + {SMOOTH} AS DECIMAL(20, 0))) DIV CAST({size} + {SMOOTH} * {vocabulary} AS DECIMAL(20, 0))")


def distance(p: str, q: str) -> Column:
    """floor((p - q)**2 / (p + q)); shares are below 2**30 and a bit, so squares fit."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) DIV (({p}) + ({q}))")


def top_k(rows: DataFrame, by: list[str], value: str, item: str, k: int, bits: int = VALUE_BITS, digit_bits: int = DIGIT_BITS, settle: int = SETTLE) -> DataFrame:
    """rows of the ``k`` greatest values (0 <= value < 2**bits) of each group with their rank; of equal ones the first items in order of UTF-8 bytes.

    rows should be a working table: it is read once for each digit of the values.
    """
    state, step = None, Window.partitionBy(*by)

    def met(state):  # each row with its group's state
        return rows.join(sized(state, 200_000).select(*[F.col(b).alias(f"s_{b}") for b in by], *[c for c in state.columns if c not in by]), [F.col(b).eqNullSafe(F.col(f"s_{b}")) for b in by])

    def chosen(bins: DataFrame, order: Column) -> DataFrame:
        """Of each group the bin in which the needed rows end; without enough rows, the last."""
        first = step.orderBy(order)
        bins = bins.withColumn("before", F.coalesce(F.sum("c").over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter("before < need")
        return bins.withColumn("last", F.row_number().over(step.orderBy(F.desc("before")))).filter("last = 1")

    for shift in range(bits - digit_bits if bits > digit_bits else 0, -1, -digit_bits):
        digit = F.shiftright(F.col(value), shift)
        here = rows.withColumn("need", F.lit(k).cast("long")) if state is None else met(state).filter(F.shiftright(F.col(value), shift + digit_bits) == F.col("high"))
        bins = here.groupBy(*by, digit.alias("high")).agg(F.count(F.lit(1)).alias("c"), F.first("need").alias("need"))
        state = cut(chosen(bins, F.col("high").desc()).select(*by, "high", (F.col("need") - F.col("before")).alias("need"), "c"), "radix")
    # high is now the kth value; need of its c rows are wanted
    bytes_ = F.encode(item, "UTF-8")
    state = state.withColumn("prefix", F.lit(b"")).withColumn("open", F.col("c") > F.greatest(F.col("need"), F.lit(settle)))
    while state.filter("open").head(1):
        here = met(state.filter("open")).filter((F.col(value) == F.col("high")) & (F.substring(bytes_, F.lit(1), F.length("prefix")) == F.col("prefix")))
        bins = here.groupBy(*by, "high", "prefix", F.substring(bytes_, F.length("prefix") + 1, F.lit(2)).alias("digit")).agg(F.count(F.lit(1)).alias("c"), F.first("need").alias("need"))
        bins = chosen(bins, F.col("digit").asc()).withColumn("need", F.col("need") - F.col("before")).withColumn("prefix", F.concat("prefix", "digit"))
        bins = bins.withColumn("open", (F.col("c") > F.greatest(F.col("need"), F.lit(settle))) & (F.length("digit") == 2))
        state = cut(state.filter("NOT open").unionByName(bins.select(state.columns)), "radix")
    begin = F.substring(bytes_, F.lit(1), F.length("prefix"))
    reach = met(state).filter((F.col(value) > F.col("high")) | ((F.col(value) == F.col("high")) & (begin <= F.col("prefix")))).select(rows.columns)
    return reach.withColumn("rank", F.row_number().over(step.orderBy(F.desc(value), item))).filter(F.col("rank") <= k)


def source_divergence(docs: DataFrame, least_docs: int = 10, k: int = 10, settle: int = SETTLE) -> DataFrame:
    """(lang, source, part, item, value, rank) of (text, lang, source)."""
    counts = cut(term_counts(docs), "terms")
    kept = cut(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("d").alias("d")).filter(F.col("d") >= least_docs).drop("d"), "kept")
    scored = cut(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "scored")
    languages = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_size"))
    sizes = scored.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    groups = groups.join(sizes, ["lang", "source"], "left").join(languages, "lang", "left").fillna(0, ["size", "v", "lang_size"])
    groups = cut(groups.withColumn("p0", F.when(F.col("v") > 0, share("0", "size", "v"))), "groups")
    known = sized(groups, 200_000)
    shares = cut(scored.join(known, ["lang", "source"]).select("lang", "source", "term", "n", share("n", "size", "v").alias("p"), "p0", share("lang_n", "lang_size", "v").alias("q")), "shares")
    excess = cut(shares.filter("p > q").select("lang", "source", "term", distance("p", "q").alias("value")), "excess")
    terms = top_k(excess, ["lang", "source"], "value", "term", k, settle=settle)
    part = lambda df, name, item: df.select("lang", "source", F.lit(name).alias("part"), F.col(item).alias("item"), "value", "rank")
    return part(terms, "term", "term").union(part(source_pairs(shares, groups, known), "pair", "other"))


def source_pairs(shares: DataFrame, groups: DataFrame, known: DataFrame) -> DataFrame:
    """(lang, source, other, value, rank) for every two sources of a language, both ways."""
    # each pair once, the source that is first in order of bytes on the left
    right = lambda df, *cols: df.select("lang", *[F.col(c).alias(f"{c}_") for c in cols])
    pairs = groups.join(right(known, "source", "p0"), "lang").filter("source < source_").withColumn("base", F.coalesce(distance("p0", "p0_"), F.lit(0)))
    # what the terms of one side alone would add to the baseline: by counts, of which there are few
    by_count = cut(shares.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("m")), "counts-of-counts")
    alone = by_count.join(right(known, "source", "p0"), "lang").filter("source <> source_")
    alone = alone.select("lang", F.least("source", "source_").alias("source"), F.greatest("source", "source_").alias("source_"), (F.col("m") * (distance("p", "p0_") - distance("p0", "p0_"))).alias("more"))
    both = shares.join(right(shares.withColumn("t", F.col("term")), "source", "p", "p0", "t").withColumnRenamed("t_", "term"), ["lang", "term"]).filter("source < source_")
    both = both.select("lang", "source", "source_", (distance("p", "p_") - distance("p", "p0_") - distance("p0", "p_") + distance("p0", "p0_")).alias("more"))
    sums = alone.groupBy("lang", "source", "source_").agg(F.sum("more").alias("more")).union(both.groupBy("lang", "source", "source_").agg(F.sum("more").alias("more")))
    sums = sums.groupBy("lang", "source", "source_").agg(F.sum("more").alias("more"))
    out = pairs.join(sums, ["lang", "source", "source_"], "left").withColumn("value", F.col("v") * F.col("base") + F.coalesce("more", F.lit(0)))
    out = cut(out.select("lang", "source", "source_", "value"), "pairs")
    out = out.select("lang", "source", F.col("source_").alias("other"), "value").union(out.select("lang", "source_", "source", "value"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "other")))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return source_divergence(docs_table(spark, sf_dir))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS (SELECT row, lang, source, unnest(w) AS term FROM d
), kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 10
), languages AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_size FROM kept GROUP BY lang
), counts AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY t.lang, t.source, t.term
), sizes AS (SELECT lang, source, sum(n) AS size FROM counts GROUP BY lang, source
), g AS (SELECT DISTINCT lang, source FROM d
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(s.size, 0) + 2 * l.v) AS p, 1 + 1000000000::HUGEINT * (k.lang_n + 2) // (l.lang_size + 2 * l.v) AS q
  FROM g JOIN kept k USING (lang) JOIN languages l USING (lang) LEFT JOIN sizes s USING (lang, source) LEFT JOIN counts c USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), all_pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
), terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM dense WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM all_pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
