"""Operator 11: hard-negative mining by a full score sort for each anchor.

Components become integers, so scores are exact inner products.  An anchor's rows of a
part are put in order of score and id; for each positive the upper limit is found in
that order by binary search, and the first entries with another label that don't fall
below the lower limit are read off.  Parts are merged by the same order.

Rows stand in parts of bounded size in a working table.  Anchors are the stated query set: they go out in blocks
of at most ``BLOCK_BYTES``, one after another, and each block meets all rows.
A part answers with ``n_positives`` rows for an anchor and ``n_negatives`` for a
positive at most, so nothing depends on how many rows share a label.

Defined cases: rows with a null label, a null vector or a component that is null,
infinite or not a number take no part; an empty vector has score 0 with all; of
vectors with different lengths the shorter one counts as filled up with zeros; a null id is
no anchor and comes last among ties; rows that repeat an id are rows of their own (each an
anchor of its own, and a positive of the others); scores beyond 64 bits stand
at the last 64-bit number; other columns are not read; an empty table, and one
without anchors, gives an empty result.  Ids are integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, docs_table

#: Bytes of anchors sent to all tasks at once, and of rows that a task holds at once, as doubles.
BLOCK_BYTES = 8 << 20
CHUNK_BYTES = 16 << 20
#: Scores computed at once.
SCORES = 4_000_000
#: Rows in a part of the working table.
PART_ROWS = 20_000
FOUND = "anchor_row long, anchor_id long, row long, id long, score long"
MINED = "anchor_row long, anchor_id long, positive_row long, positive_id long, positive_score long, row long, id long, score long"
MOST = (1 << 63) - 1


def matrix(vectors: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of each component as doubles; shorter vectors are filled up with zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    with np.errstate(over="ignore"):
        return np.floor(scale * out)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of two matrices of integers, exactly, as 64-bit integers that stop at the ends."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    most = d * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)  # sums of whole numbers below 2**53 are exact in any order
    if most < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = lambda m: np.array([[int(x) if math.isfinite(x) else int(math.copysign(1 << 1024, x)) for x in r] for r in m.tolist()], object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, -MOST, MOST).astype(np.int64)


def chunks(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[dict]:
    """Rows of a part, in order of id (null last) and row, as many at once as CHUNK_BYTES hold."""

    def ready(held):
        t = pa.Table.from_batches(held)
        ids, rows = t["id"], t["row"].to_numpy()
        null = ids.is_null().to_numpy()
        value = ids.fill_null(0).to_numpy()
        order = np.lexsort((rows, value, null))
        labels = np.array(t["label"].to_pylist(), object)
        return {"x": matrix(t["vector"], scale)[order], "id": value[order], "null": null[order], "row": rows[order], "label": labels[order]}

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows * 64 + len(b.column("vector").flatten()) * 8
        if size >= CHUNK_BYTES:
            yield ready(held)
            held, size = [], 0
    if size:
        yield ready(held)


def label_codes(labels: np.ndarray, known: dict) -> np.ndarray:
    return np.fromiter((known.get(x, -1) for x in labels), np.int64, len(labels))


def found(names: list[str], parts: list[tuple]) -> pa.RecordBatch:
    """parts: tuples of arrays in the order of names; ids are numbers with their nulls."""
    cols = [pa.array(np.concatenate([p[i] for p in parts])) if parts and not isinstance(parts[0][i], tuple) else pa.array(np.concatenate([p[i][0] for p in parts]), mask=np.concatenate([p[i][1] for p in parts])) if parts else pa.array([], pa.int64()) for i in range(len(names))]
    return pa.RecordBatch.from_arrays([c.cast(pa.int64()) for c in cols], names)


def same_label_task(block, n: int, scale: int):
    """Of each chunk the first ``n`` rows with an anchor's label, other than itself."""

    def run(batches):
        a = block.value
        for c in chunks(batches, scale):
            codes, out = label_codes(c["label"], a["codes"]), []
            for code in np.unique(codes[codes >= 0]):
                mine, those = np.flatnonzero(codes == code), np.flatnonzero(a["label"] == code)
                for at in range(0, len(those), step := max(1, SCORES // len(mine))):
                    who = those[at : at + step]
                    s = exact_scores(a["x"][who], c["x"][mine])
                    order = np.argsort(-s, axis=1, kind="stable")[:, : n + 1]
                    for i, w in enumerate(who):
                        o = order[i]
                        o = o[c["row"][mine[o]] != a["row"][w]][:n]
                        m = mine[o]
                        out.append((np.full(len(o), a["row"][w]), np.full(len(o), a["id"][w]), c["row"][m], (c["id"][m], c["null"][m]), s[i, o]))
            yield found(["anchor_row", "anchor_id", "row", "id", "score"], out)

    return run


def mine_task(block, n: int, low: int, high: int, scale: int):
    """Of each chunk the first ``n`` rows with another label between each positive's limits."""

    def run(batches):
        a = block.value
        for c in chunks(batches, scale):
            codes, out = label_codes(c["label"], a["codes"]), []
            for at in range(0, len(a["x"]), step := max(1, SCORES // len(codes))):
                s = exact_scores(a["x"][at : at + step], c["x"])
                order = np.argsort(-s, axis=1, kind="stable")  # rows stand in order of id
                for i, o in enumerate(order):
                    w = at + i
                    first, last = a["from"][w], a["from"][w + 1]
                    o = o[codes[o] != a["label"][w]]
                    down = -s[i, o]
                    begin, end = np.searchsorted(down, -a["upper"][first:last], "left"), np.searchsorted(down, -a["lower"][first:last], "right")
                    for p, b, e in zip(range(first, last), begin, end):
                        m = o[b : min(e, b + n)]
                        if len(m):
                            k = lambda v: np.full(len(m), v)  # noqa: E731, B023
                            out.append((k(a["row"][w]), k(a["id"][w]), k(a["p_row"][p]), (k(a["p_id"][p]), k(a["p_null"][p])), k(a["p_score"][p]), c["row"][m], (c["id"][m], c["null"][m]), s[i, m]))
            yield found(["anchor_row", "anchor_id", "positive_row", "positive_id", "positive_score", "row", "id", "score"], out)

    return run


def first_of(rows: DataFrame, by: list[str], n: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    return rows.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= n)


def limits(scores: list[int], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest whole score with low * p <= 100 * s <= high * p."""
    return np.array([max(-MOST, min(MOST, -(-low * p // 100))) for p in scores], np.int64), np.array([max(-MOST, min(MOST, high * p // 100)) for p in scores], np.int64)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label",
    n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, block_bytes: int = BLOCK_BYTES, part_rows: int = PART_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    rows: an id, a vector and a label (any type that casts to a string).  An anchor's positives are its
    ``n_positives`` best rows with its label; a positive's negatives are the ``n_negatives`` best rows with another label
    whose score lies between ``low`` and ``high`` per cent of the positive's.
    """
    spark = rows.sparkSession
    vector = F.col(f"`{vector_col}`")
    if dict(rows.dtypes)[vector_col] != "array<float>":
        vector = vector.cast("array<double>")
    label = F.col(f"`{label}`") if isinstance(label, str) else label
    fit = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("string").alias("label"), vector.alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = fit.filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    parts = max(spark.sparkContext.defaultParallelism, -(-rows.count() // part_rows))
    fit = cut(fit.repartition(parts).withColumn("row", F.monotonically_increasing_id()), "vectors")
    anchors = fit.filter("anchor")
    n, d = anchors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    n_blocks = -(-n * 8 * max(d, 8) // block_bytes)
    mined = None
    for b in range(n_blocks):
        part = anchors.filter(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == b) if n_blocks > 1 else anchors
        part = mine_block(fit, part, n_positives, n_negatives, low, high, scale)
        mined = part if mined is None else mined.union(part)
    if mined is None:
        mined = spark.createDataFrame([], f"{MINED}, rank int")
    return mined.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine_block(fit: DataFrame, anchors: DataFrame, n_positives: int, n_negatives: int, low: int, high: int, scale: int) -> DataFrame:
    """A block of anchors against all rows, as a working table."""
    sc = fit.sparkSession.sparkContext
    t = anchors.select("row", "id", "label", "vector").toArrow()
    labels = t["label"].to_pylist()
    codes = {x: i for i, x in enumerate(dict.fromkeys(labels))}
    block = {"x": matrix(t["vector"], scale), "row": t["row"].to_numpy(), "id": t["id"].to_numpy(), "codes": codes, "label": label_codes(labels, codes)}
    rows = fit.select("row", "id", "label", "vector")
    sent = sc.broadcast(block)
    positives = rows.mapInArrow(same_label_task(sent, n_positives, scale), FOUND)
    # n_positives rows for each anchor of the block
    p = first_of(positives, ["anchor_row"], n_positives, "rank").select("anchor_row", "rank", "row", "id", "score").toArrow()
    at = {r: i for i, r in enumerate(block["row"].tolist())}
    of = np.array([at[r] for r in p["anchor_row"].to_pylist()], np.int64)
    order = np.argsort(of, kind="stable")
    scores = p["score"].to_numpy()[order]
    lower, upper = limits(scores.tolist(), low, high)
    block |= {"from": np.searchsorted(of[order], np.arange(len(at) + 1)), "p_row": p["row"].to_numpy()[order], "p_null": p["id"].is_null().to_numpy()[order], "p_id": p["id"].fill_null(0).to_numpy()[order], "p_score": scores, "lower": lower, "upper": upper}
    sent.unpersist()
    sent = sc.broadcast(block)
    out = cut(first_of(rows.mapInArrow(mine_task(sent, n_negatives, low, high, scale), MINED), ["anchor_row", "positive_row"], n_negatives, "rank"), "negatives")
    sent.unpersist()
    return out


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = docs_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0, label=label)


OP11_SQL = """
WITH r AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.row AS a_row, a.vec_id AS anchor_id, a.label AS a_label, b.row, b.vec_id, b.label, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0
), p AS (
  SELECT * FROM s WHERE label = a_label AND row <> a_row QUALIFY row_number() OVER (PARTITION BY a_row ORDER BY score DESC, vec_id, row) <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.a_row, p.row ORDER BY s.score DESC, s.vec_id, s.row)::INTEGER AS rank,
         s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.a_row = p.a_row AND s.label <> s.a_label AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT * FROM n WHERE rank <= 10
"""
