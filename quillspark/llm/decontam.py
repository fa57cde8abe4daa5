"""Operator 8: benchmark decontamination by suffix arrays over the training texts.

Each batch of documents is a shard: its words (hashed to 64 bits) stand end to end
with a separator after each document, and a suffix array over them is built by
prefix doubling (ranks of 1, 2, 4, 8, 16 words).  Every suffix of every benchmark
item is binary-searched in it, all suffixes at once; the range that shares its
first 13 words (an item of fewer words: all of it) gives the places where the
window occurs.  Windows that follow each other in both texts join to the longest
verbatim matches.  Windows that many items share, or that an item repeats, are
searched once.

The benchmark comes in blocks of at most ``block_bytes`` (or one text).  A single block is
sent to the tasks.  Several are files of the shared folder: a task builds the suffix arrays
of about ``shard_bytes`` of documents once and searches one block after the other in them,
so that neither the driver nor a task ever holds more than one block, and the documents are
passed over once however large the benchmark is.

Defined cases: null or wordless documents have 0 words and no hit; null or wordless
items have no window; items with equal ids count once; repeated documents are
judged row by row, and a repeated id keeps its rows; an empty table gives an empty
result, an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import cut, docs_table, fresh_path, tune_arrow
from .vector import ALNUM, U64, doc_bytes, mix, ragged, slices, word_hashes

WINDOW = 13
DEPTH = 16
BLOCK_BYTES = 2_000_000
#: Bytes of documents whose suffix arrays a task keeps for all blocks of a large benchmark (or one longer text).
SHARD_BYTES = 16_000_000
HITS = "n_words long, spans array<struct<start:long,end:long>>, items array<string>, longest array<struct<item:string,item_start:long,start:long,length:long>>"


class SuffixArray:
    """Over the words of many documents; suffixes are in order of their first ``DEPTH`` words, and end with their document."""

    def __init__(self, hashes: np.ndarray, doc_words: np.ndarray):
        n_docs = len(doc_words) - 1
        counts = np.diff(doc_words)
        #: where each document's words start, each followed by one separator
        self.starts = doc_words[:-1] + np.arange(n_docs)
        self.text = np.zeros(len(hashes) + n_docs + DEPTH, np.int64)
        self.words, rank = np.unique(hashes, return_inverse=True)
        place = ragged(self.starts, counts)
        self.text[place] = rank * 2 + 1
        n = len(hashes) + n_docs
        rank, k = self.text[:n], 1
        while k < DEPTH and n:
            after = np.zeros(n, np.int64)
            after[: max(0, n - k)] = rank[k:]
            # a suffix that has ended stays ended: separators keep the lowest rank
            pair = np.where(rank > 0, rank * (int(rank.max()) + 1) + after, 0)
            distinct, rank = np.unique(pair, return_inverse=True)
            if len(distinct) and distinct[0] != 0:
                rank = rank + 1
            k *= 2
        order = np.argsort(rank, kind="stable") if n else np.zeros(0, np.int64)
        self.order = order[self.text[order] > 0] if n else order

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        """Ranks of words in this shard; words that it lacks get the even numbers between."""
        at = np.searchsorted(self.words, hashes)
        known = at < len(self.words)
        known[known] = self.words[at[known]] == hashes[known]
        return at * 2 + known

    def find(self, queries: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of ``order`` whose suffixes begin with each query (a row of ranks, of which the first ``lengths`` count)."""
        unused = np.arange(queries.shape[1]) >= lengths[:, None]
        out = []
        for upper in (False, True):
            lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), len(self.order), np.int64)
            while len(act := np.flatnonzero(lo < hi)):
                mid = (lo[act] + hi[act]) // 2
                have = self.text[self.order[mid][:, None] + np.arange(queries.shape[1])]
                other = (have != queries[act]) & ~unused[act]
                first = other.argmax(1)
                row = np.arange(len(act))
                same = ~other[row, first]
                less = np.where(same, upper, have[row, first] < queries[act][row, first])
                lo[act[less]] = mid[less] + 1
                hi[act[~less]] = mid[~less]
            out.append(lo)
        return out[0], out[1]


class Windows:
    """The windows of a block of items: every suffix that has one, cut to its window.  Equal windows are one.

    ``places`` are numbers of windows in order of items and words, with a gap after each item, so that of two
    windows the second follows the first in an item where its place is the next number.
    """

    def __init__(self, ids: list[str], texts: pa.Array, width: int):
        hashes, off = word_hashes(*doc_bytes(texts), ALNUM)
        n = np.diff(off)
        some = np.flatnonzero(n)
        m = np.maximum(1, n[some] - width + 1)
        item, length = np.repeat(some, m), np.repeat(np.minimum(n[some], width), m)
        start = ragged(off[some], m)
        key = length.astype(U64)
        for i in range(width):
            inside = np.flatnonzero(length > i)
            key[inside] = mix(key[inside] * U64(0x9E3779B97F4A7C15) + hashes[start[inside] + i])
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        self.ids, self.length = ids, length[first]
        self.valid = np.arange(width) < self.length[:, None]
        self.hashes = hashes[np.where(self.valid, start[first][:, None] + np.arange(width), 0)] if len(hashes) else np.zeros((0, width), U64)
        # of each place its item and where it starts there; of each window its places
        place = np.arange(len(item)) + item
        self.item_of, self.at = np.zeros(int(place[-1]) + 2 if len(place) else 2, np.int64), np.zeros(int(place[-1]) + 2 if len(place) else 2, np.int64)
        self.item_of[place], self.at[place] = item, start - off[item]
        order = np.argsort(which, kind="stable")
        self.places, self.first_place = place[order], np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(first)))])
        # windows with the same items share a list of them
        pair = np.unique(np.stack([which, item], 1), axis=0) if len(item) else np.zeros((0, 2), np.int64)
        count = np.bincount(pair[:, 0], minlength=len(first))
        begin = np.concatenate([[0], np.cumsum(count)])
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(pair[:, 1].astype(U64) + U64(1)))])
        _, alike, self.list_of = np.unique(total[begin[1:]] - total[begin[:-1]], return_index=True, return_inverse=True)
        self.lists = [pair[begin[w] : begin[w + 1], 1] for w in alike.tolist()]


class Shard:
    """Some documents: their suffix array, and [n_words, spans, items, longest matches] of each, to which every block adds."""

    def __init__(self, kept: list[pa.Array], data: np.ndarray, offsets: np.ndarray):
        hashes, doc_words = word_hashes(data, offsets, ALNUM)
        self.kept, self.size = kept, int(offsets[-1] - offsets[0])
        self.found = [[n, [], [], []] for n in np.diff(doc_words).tolist()]
        self.array = SuffixArray(hashes, doc_words) if len(hashes) else None

    def rows(self, names: list[str], types: pa.Schema) -> pa.RecordBatch:
        new = [pa.array([f[k] for f in self.found], types.field(k).type) for k in range(4)]
        return pa.RecordBatch.from_arrays(self.kept + new, names + types.names)


def _search(out: list[list], shard: SuffixArray | None, windows: Windows) -> None:
    """Adds what the windows hit to the documents of a shard.

    What is held grows with the words of the shard and with the pairs of document and item, not with
    how often a window occurs in the benchmark.
    """
    if shard is None or not len(windows.length):
        return
    ranks = shard.encode(windows.hashes.ravel()).reshape(windows.hashes.shape)
    try_ = np.flatnonzero(((ranks % 2 == 1) | ~windows.valid).all(1))  # all words occur in the shard
    lo, hi = shard.find(ranks[try_], windows.length[try_])
    try_, lo, hi = try_[hi > lo], lo[hi > lo], hi[hi > lo]
    if not len(try_):
        return
    # a place has one window of each length at most
    window = np.repeat(try_, hi - lo)
    place = shard.order[ragged(lo, hi - lo)]
    doc = np.searchsorted(shard.starts, place, "right") - 1
    # spans of hit words: joined windows, by document and place
    step = np.zeros(len(shard.text) + 1, np.int64)
    np.add.at(step, place, 1)
    np.add.at(step, place + windows.length[window], -1)
    hit = (np.cumsum(step) > 0).astype(np.int8)
    edge = np.diff(hit, prepend=0)
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    for d, s, e in zip((np.searchsorted(shard.starts, begins, "right") - 1).tolist(), begins.tolist(), ends.tolist()):
        out[d][1].append({"start": s - int(shard.starts[d]), "end": e - int(shard.starts[d])})
    lists = np.unique(np.stack([doc, windows.list_of[window]], 1), axis=0)
    cut_ = np.flatnonzero(np.append(True, lists[1:, 0] != lists[:-1, 0]))
    for a, b in zip(cut_.tolist(), [*cut_[1:].tolist(), len(lists)]):
        found = np.unique(np.concatenate([windows.lists[k] for k in lists[a:b, 1].tolist()]))
        out[int(lists[a, 0])][2] += [windows.ids[k] for k in found.tolist()]
    _longest(out, doc, place - shard.starts[doc], window, windows)


def _longest(out: list[list], doc: np.ndarray, place: np.ndarray, window: np.ndarray, windows: Windows) -> None:
    """Of each document the longest verbatim match, the first in the document of equal ones, then of the least item and place in it.

    Windows that follow each other in the text and in an item join; ``run`` has, for each place of the
    benchmark, how many windows have joined up to there.
    """
    run = np.zeros(len(windows.item_of) + 1, np.int64)
    order = np.lexsort((place, windows.length[window], doc))
    before, last, best, at = np.zeros(0, np.int64), (-1, -1, -1), None, -1
    for d, p, w in zip(doc[order].tolist(), place[order].tolist(), window[order].tolist()):
        length = int(windows.length[w])
        if d != at:
            _keep(out, at, best, windows)
            at, best = d, None
        q = windows.places[windows.first_place[w] : windows.first_place[w + 1]]
        if last != (d, length, p - 1):
            run[before] = 0
            before = q[:0]
        joined = run[q - 1] + 1  # the place before the first is a gap, whose run stays 0
        run[before] = 0
        run[q] = joined
        before, last = q, (d, length, p)
        k = int(joined.argmax())
        size, start = int(joined[k]) + length - 1, p - int(joined[k]) + 1
        if best is None or size > best[0] or size == best[0] and start < best[1]:
            best = size, start, int(q[k]) - int(joined[k]) + 1
    _keep(out, at, best, windows)


def _keep(out: list[list], d: int, best: tuple[int, int, int] | None, windows: Windows) -> None:
    if best:
        size, start, q = best
        out[d][3].append({"item": windows.ids[int(windows.item_of[q])], "item_start": int(windows.at[q]), "start": start, "length": size})


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, list[int], Column]:
    """The items (id, text), the numbers of blocks of at most ``block_bytes`` of text (or one text), and an item's number."""
    items = benchmark.filter(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    total, n, numbers = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0, 1, [0]
    if total > block_bytes:
        items, n = cut(items.distinct(), "benchmark"), 2 * -(-total // block_bytes)
    block = F.pmod(F.xxhash64("id", "text"), F.lit(n))
    while n > 1:  # one row for each block: twice as many as the benchmark fills
        found = items.groupBy(block.alias("block")).agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("texts")).collect()
        if not any(r.bytes > block_bytes and r.texts > 1 for r in found):
            numbers = sorted(r.block for r in found)
            break
        n *= 2
        block = F.pmod(F.xxhash64("id", "text"), F.lit(n))
    return items, numbers, block


def _in_order(items: pa.Table) -> tuple[list[str], pa.Array]:
    items = items.sort_by([("id", "ascending"), ("text", "ascending")])
    return items.column("id").to_pylist(), items.column("text").combine_chunks()


def _stored(items: DataFrame, block: Column) -> str:
    """The folder to which the items are written, one folder in it for each block."""
    path = fresh_path(items.sparkSession, "benchmark-blocks")
    items.withColumn("block", block).repartition("block").write.partitionBy("block").parquet(path)
    return path


def _fetch(path: str, number: int) -> tuple[list[str], pa.Array]:
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(f"{path}/block={number}")
    return _in_order(pq.read_table(name, columns=["id", "text"], filesystem=system, partitioning=None))


def match_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """``keep`` columns of each row (default: doc_id) with n_words, spans of hit words, n_hit, items and the longest verbatim match.

    prefix: stands before the names of added columns, where ``keep`` has such names.
    """
    if not 1 <= width <= DEPTH:
        raise ValueError(f"width must be from 1 to {DEPTH}")
    spark = docs.sparkSession
    tune_arrow(spark)
    keep = ["doc_id"] if keep is None else keep
    types = to_arrow_schema(_parse_datatype_string(HITS))
    items, blocks, block = _blocks(benchmark, id_col, text_col, block_bytes)
    names = [f"k{i}" for i in range(len(keep))]
    source = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, names)], F.col("text").alias("body"))
    kinds = "".join(f"{k} {source.schema[k].dataType.simpleString()}, " for k in names)
    many = len(blocks) > 1
    path = _stored(items, block) if many else None
    only = None if many else spark.sparkContext.broadcast(_in_order(items.distinct().toArrow()))  # at most block_bytes

    def search(batches):
        one = Windows(*only.value, width) if only is not None else None
        held: list[Shard] = []

        def done():
            for n in blocks:
                windows = one if one is not None else Windows(*_fetch(path, n), width)
                for shard in held:
                    _search(shard.found, shard.array, windows)
            for shard in held:
                yield shard.rows(names, types)
            held.clear()

        for b in batches:
            data, offsets = doc_bytes(b.column(len(names)))
            for i, j in slices(offsets):
                held.append(Shard([b.column(k).slice(i, j - i) for k in range(len(names))], data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                if one is not None or sum(s.size for s in held) >= shard_bytes:
                    yield from done()
        if held:
            yield from done()

    out = source.select(*names, "body").mapInArrow(search, f"{kinds}{HITS}")
    if many:
        out = out.withColumn("spans", merged_spans(F.col("spans")))
    longest = F.try_element_at(F.array_sort(F.transform("longest", lambda x: F.struct(-x["length"], x["start"].alias("start"), x["item"].alias("item"), x["item_start"].alias("item_start"), x["length"].alias("length")))), F.lit(1))
    added = {"n_words": F.col("n_words"), "spans": F.col("spans"), "n_hit": n_hit(F.col("spans")), "items": F.array_sort(F.array_distinct("items")), "longest": longest.dropFields("col1")}
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[v.alias(prefix + k) for k, v in added.items()])


def merged_spans(spans: Column) -> Column:
    """Spans in order, with those that touch or overlap joined."""
    kind = "array<struct<start:bigint,end:bigint>>"

    def add(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (x["start"] <= last["end"]), joined).otherwise(F.concat(acc, F.array(x))).cast(kind)

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), add)


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])


def contaminated(n_hit_: Column, n_words: Column) -> Column:
    return (n_hit_ > 0) & (n_hit_ * 20 >= n_words)


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = match_benchmark(docs_table(spark, sf_dir), docs_table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
        F.coalesce(F.col("longest.length"), F.lit(0)).cast("long").alias("longest"),
    )


OP8_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, array_to_string(w[p : p + n - 1], ' ') AS g, n
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS p FROM bw WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM windows
), grams AS (
  SELECT r, p, n, array_to_string(w[p : p + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, lens WHERE len(w) >= n)
), found AS (SELECT r, p, g.n, item_id FROM grams g JOIN windows USING (g, n)
), hit AS (SELECT r, count(DISTINCT q)::BIGINT AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM found) GROUP BY r
), items AS (
  SELECT r, count(*)::BIGINT AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM found) GROUP BY r
), runs AS (
  SELECT r, max(c + n - 1)::BIGINT AS longest FROM (
    SELECT r, item_id, diag, grp, min(n) AS n, count(*) AS c FROM (
      SELECT *, p - row_number() OVER (PARTITION BY r, item_id, diag ORDER BY p) AS grp FROM (
        SELECT DISTINCT f.r, f.p, f.n, f.item_id, f.p - b.p AS diag
        FROM (SELECT g.r, g.p, g.n, g.g, w.item_id FROM grams g JOIN windows w USING (g, n)) f
        JOIN (SELECT item_id, p, array_to_string(w[p : p + least(len(w), 13) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS p FROM bw WHERE len(w) > 0)) b
          ON b.item_id = f.item_id AND b.g = f.g))
    GROUP BY r, item_id, diag, grp)
  GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       coalesce(longest, 0)::BIGINT AS longest
FROM dw LEFT JOIN hit USING (r) LEFT JOIN items USING (r) LEFT JOIN runs USING (r)
"""
