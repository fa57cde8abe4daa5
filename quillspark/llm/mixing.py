"""Operator 4: mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame functions only).

Targets share the whole word count by weight; a target stops at ``max_epochs``
times its source's size and the excess is shared again by weight, which is the
water level ``lambda`` with ``target = min(cap, lambda * weight)``.

A source takes ``floor(target / size)`` complete epochs of all its documents
first.  What is left is filled by an Efraimidis-Spirakis order: each document has
the exponential key ``-ln(u) / quality`` (``u`` from a digest of its id), keys are
sorted within the source and the sizes summed up to the budget.  The document at
the budget's edge is taken when that comes nearer to the target than leaving it.

No task sorts a whole source: keys fall into bins, the bins' sizes are summed
(the prefix sum up to each bin), and only the bin at the edge is sorted row by
row.  The number of bins grows with the source.

Defined cases: a null source is a source, ordered last; null or empty texts have
size 0 and take 0; a source of size 0 has target 0; a null quality counts as
weight 1; repeated rows are separate documents, of which any number may be taken;
keys that tie are ordered by id and size; other columns stay as they are, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, docs_table, sized

#: Quality weights of labelled documents, and of those without a label.
QUALITY = {1: 2.0, 0: 0.5}
UNLABELLED = 1.0
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """The number of runs of characters other than space and 0x09-0x0D: the starts of runs, counted by removing all else."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """In (0, 1): 52 bits of md5(seed:id)."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(source, source_size) -> with source_size and target added; one row per source.

    The windows below run over the table of sources, not of documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    w = F.element_at(F.lit(list(weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    caps = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * max_epochs).withColumn("ratio", F.col("cap") / F.col("w"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), F.encode("source", "UTF-8"))
    levels = (
        caps.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("capped", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open_w", F.sum("w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open_w"))
    )
    # the first source that isn't capped gives the level of all that aren't
    lam = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(Window.partitionBy())
    return levels.withColumn("lam", F.coalesce(lam["level"], F.lit(float("inf")))).select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("lam") * F.col("w")).alias("target"))


def keyed(docs: DataFrame, quality: DataFrame | None, seed: str = SEED, text_col: str = "text", whole: bool = False) -> DataFrame:
    """doc_id, source, mix_size and mix_key of each row, with the row itself as a struct (doc) if ``whole``.

    quality: (doc_id, weight) with one row for an id at most.
    """
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if whole else []
    rows = docs.select(*own, "doc_id", "source", n_words(F.col(text_col)).alias("mix_size"))
    if quality is not None:
        rows = rows.join(quality.select("doc_id", F.col("weight").alias("mix_q")), "doc_id", "left")
    else:
        rows = rows.withColumn("mix_q", F.lit(None).cast("double"))
    key = -F.log(uniform(F.col("doc_id"), seed)) / F.coalesce("mix_q", F.lit(UNLABELLED))
    return rows.withColumn("mix_key", key).drop("mix_q")


def mix_plan(rows: DataFrame, weights: tuple[int, ...], max_epochs: int, rows_per_bin: int) -> DataFrame:
    """One row for each source (s_): its size and target, complete epochs, number of bins, the bin at the edge, the last kind of row that it takes, how many of these it takes and how many there are."""
    sizes = cut(rows.groupBy("source").agg(F.sum("mix_size").alias("source_size"), F.count(F.lit(1)).alias("n")), "mix-sources")
    plan = source_targets(sizes.select("source", "source_size"), weights, max_epochs).join(sizes.select(F.col("source").alias("s_"), "n"), F.col("source").eqNullSafe(F.col("s_")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("epochs", F.least(epochs, F.lit(max_epochs)).cast("int")).select(
        F.col("source").alias("s_"), "source_size", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("budget"), F.greatest(F.lit(1), F.ceil(F.col("n") / rows_per_bin)).alias("bins")
    )
    plan = cut(plan, "mix-plan")
    # rows that are equal in all that the order goes by are one kind, counted before anything moves
    rows = rows.groupBy("source", "mix_key", "doc_id", "mix_size").agg(F.count(F.lit(1)).alias("equal"))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("s_"))).drop("s_").withColumn("bin", bin_of(F.col("mix_key"), F.col("bins")))
    rows = cut(rows.select("source", "mix_key", "doc_id", "mix_size", "equal", "budget", "bin", (F.col("mix_size") * F.col("equal")).alias("words")), "mix-kinds")
    by_bin = rows.groupBy("source", "bin").agg(F.sum("words").alias("bin_size"), F.first("budget").alias("bin_budget"))
    before = F.coalesce(F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = by_bin.withColumn("before", before).filter((F.col("before") <= F.col("bin_budget")) & (F.col("before") + F.col("bin_size") > F.col("bin_budget")))
    edge = cut(edge.select(F.col("source").alias("s_"), F.col("bin").alias("edge"), "before"), "mix-edges")
    # kind by kind only within the bin at the edge; the row at the budget goes in if at least half of it fits
    at = rows.join(edge, F.col("source").eqNullSafe(F.col("s_")) & (F.col("bin") == F.col("edge")))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("mix_key", "doc_id", "mix_size").rowsBetween(Window.unboundedPreceding, -1))
    left = F.col("budget") - F.col("before") - F.coalesce(upto, F.lit(0))
    fit = F.when(F.col("mix_size") > 0, F.floor(left / F.col("mix_size") + 0.5)).when(left >= 0, F.col("equal")).otherwise(0)
    last = at.withColumn("takes", F.least(fit, F.col("equal"))).filter("takes > 0")
    kind = F.struct("mix_key", "doc_id", "mix_size")
    last = last.groupBy(F.col("source").alias("e_")).agg(F.max(F.struct(kind.alias("last"), "takes", "equal")).alias("x")).select("e_", "x.*")
    edge = edge.join(last, F.col("s_").eqNullSafe(F.col("e_")), "left").select(F.col("s_").alias("e_"), "edge", "last", "takes", "equal")
    return cut(plan.join(edge, F.col("s_").eqNullSafe(F.col("e_")), "left").drop("e_"), "mix-plan")


def bin_of(key: Column, bins: Column) -> Column:
    """1 - exp(-key * least weight) spreads keys of any weight over (0, 1) with a bounded density."""
    return F.least(F.floor((1 - F.exp(-key * min(UNLABELLED, *QUALITY.values()))) * bins), bins - 1).cast("long")


def copies(rows: DataFrame, plan: DataFrame, max_epochs: int, row: str | None) -> DataFrame:
    """rows with source_size, target and copies.  row: a number of each row, a working table's, if some kind is taken in part."""
    kind = F.struct("mix_key", "doc_id", "mix_size")
    if row is not None:
        # the number of the last row of its kind that is taken: first by the number's upper bits, then within the part where it lies
        mine = rows.join(sized(plan.filter("takes < equal"), 50_000), F.col("source").eqNullSafe(F.col("s_")) & (kind == F.col("last"))).select("s_", F.col(row).alias("row"), F.shiftright(F.col(row), 33).alias("part"), "takes")
        parts = mine.groupBy("s_", "part", "takes").agg(F.count(F.lit(1)).alias("c"))
        before = F.coalesce(F.sum("c").over(Window.partitionBy("s_").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = cut(parts.withColumn("before", before).filter("before < takes AND before + c >= takes").select(F.col("s_").alias("e_"), F.col("part").alias("p_"), (F.col("takes") - F.col("before")).alias("nth")), "mix-parts")
        here = mine.join(sized(parts, 50_000), F.col("s_").eqNullSafe(F.col("e_")) & (F.col("part") == F.col("p_")))
        here = here.withColumn("i", F.row_number().over(Window.partitionBy("s_").orderBy("row"))).filter("i = nth").select("e_", F.col("row").alias("last_row"))
        plan = plan.join(cut(here, "mix-rows"), F.col("s_").eqNullSafe(F.col("e_")), "left").drop("e_")
    plan = cut(plan, "mix-plan") if row is not None else plan
    rows = rows.join(sized(plan, 50_000), F.col("source").eqNullSafe(F.col("s_")))
    whole = (F.coalesce("last_row", F.lit((1 << 63) - 1)) >= F.col(row)) if row is not None else F.lit(True)
    upto = F.coalesce((kind < F.col("last")) | ((kind == F.col("last")) & whole), F.lit(False))
    bin_ = bin_of(F.col("mix_key"), F.col("bins"))
    # no edge: the budget is 0 or the whole source
    more = F.when(F.col("edge").isNull(), F.col("budget") > 0).otherwise((bin_ < F.col("edge")) | ((bin_ == F.col("edge")) & upto))
    return rows.withColumn("copies", F.least(F.col("epochs") + more.cast("int"), F.lit(max_epochs)))


def in_part(plan: DataFrame) -> bool:
    """Whether some source takes only some of several equal rows."""
    return bool(plan.filter("takes < equal").head(1))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, rows_per_bin: int = 2000, seed: str = SEED, text_col: str = "text") -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (words, repeats counted), one row per document."""
    rows = cut(keyed(docs, quality, seed, text_col).withColumn("mix_row", F.monotonically_increasing_id()), "mix-rows")
    plan = mix_plan(rows, weights, max_epochs, rows_per_bin)
    out = copies(rows, plan, max_epochs, "mix_row" if in_part(plan) else None)
    return out.select("doc_id", "source", F.col("mix_size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("mix_size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, rows_per_bin: int = 2000, seed: str = SEED, text_col: str = "text") -> DataFrame:
    """The mix itself: each row as often as it is taken."""
    plan = mix_plan(cut(keyed(docs, quality, seed, text_col), "mix-rows"), weights, max_epochs, rows_per_bin)
    rows, row = keyed(docs, quality, seed, text_col, whole=True), None
    if in_part(plan):  # rows need numbers that stay
        rows, row = cut(rows.withColumn("mix_row", F.monotonically_increasing_id()), "mix-rows"), "mix_row"
    out = copies(rows, plan, max_epochs, row).filter("copies > 0")
    return out.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def label_quality(labels: DataFrame) -> DataFrame:
    """(doc_id, weight) from labels(doc_id, quality); the better label counts where there are several."""
    w = F.when(F.col("quality") == 1, QUALITY[1]).when(F.col("quality") == 0, QUALITY[0])
    return labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(w).alias("weight"))


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    out = mix(docs_table(spark, sf_dir), label_quality(docs_table(spark, sf_dir, "labels")))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


OP4_SQL = r"""
WITH rows AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln(((('0x' || substr(md5('mix-1:' || d.doc_id::VARCHAR), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0) / coalesce(l.weight, 1.0) AS key
  FROM documents d
  LEFT JOIN (SELECT doc_id, max(CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 END)::DOUBLE AS weight FROM labels GROUP BY doc_id) l USING (doc_id)
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM rows GROUP BY source
), levels AS (
  SELECT *, 3 * source_size / w AS ratio,
         ((SELECT sum(source_size) FROM sizes)
           - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / (sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
  FROM sizes
), lam AS (SELECT coalesce(arg_min(level, ratio), 'inf'::DOUBLE) AS lam FROM levels WHERE level <= ratio
), plan AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, lam * w) AS target FROM levels, lam
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::INTEGER AS epochs FROM plan
), sums AS (
  SELECT r.*, b.source_size, b.target, b.epochs, b.target - b.epochs * b.source_size AS budget,
         sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id, r.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM rows r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source
), done AS (
  SELECT *, least(epochs + CASE WHEN budget > 0 AND upto - size / 2 <= budget THEN 1 ELSE 0 END, 3) AS copies FROM sums
)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::INTEGER AS copies FROM done
"""
