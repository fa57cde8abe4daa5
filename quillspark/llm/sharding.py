"""Operator 2: byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing.

Rows with equal texts are one group and never part.  Groups are far too many to
difference one by one on one machine, and too unequal to difference in separate
tasks, so the items that are differenced are

* every *large* group: one with more than ``total / (n_shards * detail)`` bytes
  (there are fewer than ``n_shards * detail`` of them, however large the table);
* ``n_pieces`` pieces, each the sum of all smaller groups whose text hash falls
  into it.

Both lists have a fixed bound, so the differencing itself runs on the driver;
per-row work (hashing, placing, numbering) is distributed, and no row is moved
for placement: a shard is found by broadcast of those bounded lists.

Defined cases: a null text counts no bytes and is a group of its own (not equal
to the empty text); an empty table gives an empty result; repeated rows are
separate rows of one group; ties are ordered by hash.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, docs_table


def karmarkar_karp(sizes: list[int], k: int) -> list[int]:
    """A shard of 0..k-1 for each size.

    Starts from one partial partition per item (its size and k-1 zeros),
    repeatedly takes the two with the largest spread and joins them in opposite
    order: the fullest part of one with the emptiest of the other.
    """
    if not sizes:
        return []
    # A partial partition: k sums in descending order less their smallest, each with a root of a forest of items.
    parent: list[int] = list(range(len(sizes)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    heap = []
    for i, s in enumerate(sizes):
        heap.append((-int(s), i, [(int(s), i)] + [(0, -1)] * (k - 1)))
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        joined = []
        for (x, i), (y, j) in zip(a, reversed(b)):
            if i >= 0 and j >= 0:
                parent[find(j)] = find(i)
            joined.append((x + y, i if i >= 0 else j))
        joined.sort(key=lambda p: (-p[0], p[1]))
        low = joined[-1][0]
        joined = [(x - low, i) for x, i in joined]
        heapq.heappush(heap, (-joined[0][0], order, joined))
        order += 1
    shard = {find(i): n for n, (_, i) in enumerate(heap[0][2]) if i >= 0}
    return [shard[find(i)] for i in range(len(sizes))]


def shard_documents(df: DataFrame, n_shards: int = 8, text: str = "text", order: str = "doc_id", n_pieces: int = 4096, detail: int = 512, rows_per_run: int = 1_000_000, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """``keep`` columns (default: ``order``) with size, text_crc32, law, shard, slot and grown_shard.

    prefix: stands before the names of added columns, where ``keep`` has such names.

    Slots number a shard's rows without gaps from 0.  They are dealt in runs: rows
    of a shard are split by a hash of the text and id into runs of about
    ``rows_per_run`` rows, runs are numbered within, and the runs' counts are
    summed up before them; no task holds a whole shard.
    """
    spark = df.sparkSession
    keep = [order] if keep is None else keep
    size, crc, key, run, at = "size", "crc", "key", "run", "order"
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)],
        F.col(f"`{order}`").alias(at),
        (F.octet_length(body).cast("long") + 1).alias(size),
        F.crc32(body.cast("binary")).alias(crc),
        F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.col(text), F.octet_length(F.col(text)))).alias(key),
    )
    rows = cut(rows, "shard-rows")
    total, n = rows.agg(F.sum(size), F.count(F.lit(1))).first()
    total, n = total or 0, n or 0
    groups = rows.groupBy(key).agg(F.sum(size).alias(size))
    large_from = total // (n_shards * detail)
    piece = F.pmod(F.xxhash64(F.col(key)), F.lit(n_pieces)).cast("int")
    groups = cut(groups.withColumn("large", F.col(size) > large_from), "shard-groups")
    large = sorted((r[1], r[0]) for r in groups.filter("large").select(key, size).collect())
    small = sorted((r[1], r[0]) for r in groups.filter("NOT large").groupBy(piece.alias("piece")).agg(F.sum(size)).collect())
    placed = karmarkar_karp([s for s, _ in large] + [s for s, _ in small], n_shards)
    by_key = spark.createDataFrame([(g, int(p)) for (_, g), p in zip(large, placed)], T.StructType([T.StructField("_g", T.LongType()), T.StructField("_gs", T.IntegerType())]))
    of_piece = [0] * n_pieces
    for (_, p), s in zip(small, placed[len(large):]):
        of_piece[p] = int(s)
    # bounded: fewer than n_shards * detail large groups, n_pieces pieces
    out = rows.join(F.broadcast(by_key), F.col(key) == F.col("_g"), "left")
    out = out.withColumn("shard", F.coalesce(F.col("_gs"), F.element_at(F.lit(of_piece), piece + 1)).cast("int")).drop("_g", "_gs")
    runs = max(16, -(-n // rows_per_run))
    out = out.withColumn(run, F.pmod(F.xxhash64(F.col(key), F.col(at)), F.lit(runs)).cast("int"))
    counts = out.groupBy("shard", run).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("shard").orderBy(run).rowsBetween(Window.unboundedPreceding, -1))).select(F.col("shard").alias("_s"), F.col(run).alias("_r"), F.coalesce("_before", F.lit(0)).alias("_before"))
    out = out.withColumn("_at", F.row_number().over(Window.partitionBy("shard", run).orderBy(at, key)))
    out = out.join(before, (F.col("shard") == F.col("_s")) & (F.col(run) == F.col("_r")), "left")
    added = {"size": F.col(size), "text_crc32": F.col(crc), "law": F.lit("bytes"), "shard": F.col("shard"), "slot": (F.col("_before") + F.col("_at") - 1).cast("long"), "grown_shard": F.lit(None).cast("int")}
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[v.alias(prefix + c) for c, v in added.items()])


def op2_kk_shards(spark, sf_dir: str) -> DataFrame:
    return shard_documents(docs_table(spark, sf_dir))
