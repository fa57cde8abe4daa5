"""Custom terms from a table of any size.

A term can only stand where its words stand, whole and in order.  So each text's word n-grams meet the terms'
first words in a join, and only the few terms that it finds are replaced in a text, one after another in
their order, exactly as if all had been tried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABEL = "[REDACTED_TERM]"
WORD = r"(?U)\w+"
#: Words of a term that the join goes by, at most.
FIRST_WORDS = 3
#: Terms that are sent to all tasks at most, by number and by length of all; beyond that texts' n-grams are shuffled.
MOST_SENT, MOST_CHARS = 500_000, 50_000_000


def fold(text: Column) -> Column:
    """Equal for texts that a pattern takes for equal in any case (and for some more)."""
    return F.lower(F.upper(F.translate(text, "ẞİ", "ßi")))


def words(text: Column, once: bool = False) -> Column:
    found = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.transform(F.array_distinct(found) if once else found, fold)


def grams(w: Column, n: int) -> Column:
    """All runs of ``n`` words, each as one string."""
    at = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
    return w if n == 1 else F.transform(at, lambda i: F.concat_ws("\x1f", F.slice(w, i, n)))


def pattern(term: Column) -> Column:
    """The term itself between word boundaries, in any case."""
    return F.concat(F.lit(BEFORE), F.regexp_replace(term, r"([^\p{L}\p{N}_\x80-\x{10FFFF}])", r"\\$1"), F.lit(AFTER))


def term_table(terms: DataFrame) -> DataFrame:
    """(seq, term) to seq, pattern, whether it is one word, its key and number of words in it; the first of equal terms counts.

    Terms without a word have no key, and are tried on every text; so are those that could match in what takes a term's place.
    """
    term = F.regexp_replace("term", r"(?U)^\s+|\s+$", "")
    rows = terms.select("seq", term.alias("term")).filter("term <> ''").groupBy("term").agg(F.min("seq").alias("seq"))
    rows = rows.withColumn("w", words(F.col("term"))).withColumn("n", F.least(F.size("w"), F.lit(FIRST_WORDS)))
    anywhere = (F.col("n") == 0) | F.lower("term").contains("redacted_term") | F.col("term").endswith("[") | F.col("term").startswith("]")
    single = ~anywhere & F.col("term").rlike(r"(?U)\A\w+\z")
    return rows.select("seq", pattern(F.col("term")).alias("pattern"), single.alias("single"), F.when(anywhere, 0).otherwise(F.col("n")).alias("n"), F.concat_ws("\x1f", F.slice("w", F.lit(1), F.greatest("n", F.lit(1)))).alias("key"))


def redact_term_table(docs: DataFrame, terms: DataFrame, text_col: str = "text", name: str = "redacted") -> DataFrame:
    """docs with ``name``: the text without the terms (seq, term), replaced in order of seq between word boundaries, in any case.

    Null texts stay null.  Equal texts are looked up once.  Terms are counted before they are sent to all tasks.
    """
    known = term_table(terms)
    sizes = known.groupBy("n").agg(F.count(F.lit(1)).alias("c"), F.sum(F.length("pattern")).alias("chars")).collect()  # FIRST_WORDS + 1 rows at most
    few = sum(r.c for r in sizes) <= MOST_SENT and sum(r.chars for r in sizes) <= MOST_CHARS
    lengths = sorted(r.n for r in sizes if r.n)
    text, digest = F.col(f"`{text_col}`"), F.sha2(F.col(f"`{text_col}`").cast("binary"), 256)
    everywhere = known.filter("n = 0")
    if not lengths and not sizes:
        return docs.withColumn(name, text)
    met = None
    if lengths:
        keyed = known.filter("n > 0").select("seq", "pattern", "single", "key")
        found = docs.select(digest.alias("d_"), words(text, lengths == [1]).alias("w")).filter("d_ IS NOT NULL")
        found = found.select("d_", F.explode(F.array_distinct(F.concat(*[grams(F.col("w"), n) for n in lengths]))).alias("key"))
        met = found.join(F.broadcast(keyed) if few else keyed, "key").groupBy("d_").agg(F.collect_set(F.struct("seq", "pattern", "single")).alias("p_"))
    rest = F.lit(None).cast(rest_type())
    if any(r.n == 0 for r in sizes):  # one row
        rows = docs.join(F.broadcast(everywhere.agg(F.collect_list(F.struct(F.col("seq").cast("long").alias("seq"), "pattern", "single")).alias("all_"))), F.lit(True))
    else:
        rows = docs.withColumn("all_", rest)
    rows = rows.withColumn("d_", digest)
    rows = rows.join(met.withColumn("p_", F.col("p_").cast(rest_type())), "d_", "left") if met is not None else rows.withColumn("p_", rest)
    mine = F.sort_array(F.concat(F.coalesce("all_", F.array().cast(rest_type())), F.coalesce("p_", F.array().cast(rest_type()))))
    out = F.aggregate(passes(mine), text, lambda t, x: F.regexp_replace(t, x, F.lit(LABEL)))
    return rows.withColumn(name, F.when(F.size(mine) > 0, out).otherwise(text)).drop("all_", "p_", "d_")


def rest_type() -> str:
    return "array<struct<seq:bigint,pattern:string,single:boolean>>"


BEFORE, AFTER = r"(?iuU)\b", r"\b"


def passes(terms: Column) -> Column:
    """The patterns of ordered terms; single words that follow one another are one pattern, as no two of them can match at one place.

    Their word boundaries stand outside of the choice, so that words are tried where one begins only.
    """
    bare = lambda x: F.substring(x["pattern"], F.lit(len(BEFORE) + 1), F.length(x["pattern"]) - len(BEFORE) - len(AFTER))
    any_of = lambda run: F.concat(F.lit(f"{BEFORE}(?:"), run, F.lit(f"){AFTER}"))
    none = F.lit("")
    start = F.struct(F.array().cast("array<string>").alias("done"), none.alias("run"))
    close = lambda a: F.when(a["run"] == "", a["done"]).otherwise(F.array_append(a["done"], any_of(a["run"])))

    def add(a: Column, x: Column) -> Column:
        run = F.when(a["run"] == "", bare(x)).otherwise(F.concat(a["run"], F.lit("|"), bare(x)))
        return F.struct(F.when(x["single"], a["done"]).otherwise(F.array_append(close(a), x["pattern"])).alias("done"), F.when(x["single"], run).otherwise(none).alias("run"))

    alone = F.forall(terms, lambda x: x["single"]) & (F.size(terms) > 0)
    return F.when(alone, F.array(any_of(F.array_join(F.transform(terms, bare), "|")))).otherwise(F.aggregate(terms, start, add, close))
