"""Operator 7: n-gram Jaccard join and its groups, by a count-vector R-tree.

A document is its set of ``k``-word shingles; two documents link when
``100 * |A & B| >= percent * |A | B|``.  Documents with equal sets form a class, and
one of each class goes on.

Shingles are hashed into groups and a set is the point of its group counts; the sum
of the coordinates' minima bounds the overlap of two sets from above.  The tree has
three levels, with finer groups from one to the next where points are left to tell apart:

* At the root the groups are as fine as can be (one for each 64-bit hash), and so the
  points sparse.  If two points share no group among a set's first ``n - ceil(percent *
  n) + 1`` groups, in an order common to all, their summed minima stay below the overlap
  that a link needs; so a point stands in the nodes of these groups only.  The order has
  groups that many documents share last, so that boilerplate doesn't bring strangers
  together.  Nodes that hold the same points are one.
* In a node the points are counts over coarse groups (32, for large sets so many more
  that eight shingles fall into one), packed into leaves by size.  A leaf's box
  (greatest counts) and then each point bounds the overlap.  The points that these
  bounds connect are a *spot*, named by its members: the same spot found in many nodes
  is one, so what goes on grows with the documents and not with their pairs.
* In a spot the counts are over 2**32 groups, which bounds the overlap almost exactly.

Copies that have been edited form large spots whose members mostly link.  Pairs are
not listed for them: each spot's points are first compared with its most central one
only, and the verified links give components; only pairs of components that still
differ are bounded by the finest counts, and those that survive are verified on whole
sets.  So every link is either verified or within a component, and no group is
expanded into its pairs.  A node or spot of many points is cut into blocks: a node
of more than ``BLOCK`` is a spot as it is, and in a spot the blocks of points outside
its largest component meet all blocks, those of the largest component only the others.
Their number is what the work of a spot grows with, beyond its size: nothing is listed
for it, but each such point is bounded against each of the spot's.

Components are found by alternating star contractions; links never leave the cluster.

Defined cases: a null or wordless text has no shingles and is alone; repeated rows are
members of one class; a null id takes part and never names a group unless all of the
group's ids are null; rows of one id with different texts are judged each by its own;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, docs_table, sized, temp_name, tune_arrow
from .vector import NOT_SPACE, U64, doc_bytes, shingle_sets, slices, word_hashes

K, PERCENT = 4, 85
#: Leading bits of a shingle's hash that name its group: at least, and at most for large sets.
COARSE_BITS, MOST_BITS = 5, 12
#: Points of a node or spot that one task holds, about, and their shingles.
BLOCK, BLOCK_SHINGLES = 1024, 4_000_000
LEAF = 32
#: Groups that count as shared by many, for the order only: any choice gives the same links.
MOST_HEAVY, HEAVY_FROM, CHUNK = 200_000, 5, 1_500_000
#: Classes that a task remembers as sent; beyond that it starts anew, and some are sent twice.
MOST_SEEN = 1_000_000
#: Sets that one task verifies against the same other set, and points of a node that one task deals out, about.
STAR, DEALT = 4096, 2000
PARTS = 1 << 32


def _sets(batch: pa.RecordBatch, column: int, k: int):
    data, offsets = doc_bytes(batch.column(column))
    for i, j in slices(offsets):
        hashes, off = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], NOT_SPACE)
        yield from shingle_sets(hashes, off, k)


def class_id(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def needed(a, percent: int):
    """The least overlap of a set of size ``a`` with any that links to it."""
    return -(-np.asarray(a, np.int64) * percent // 100)


def overlap_needed(a, b, percent: int):
    """The least overlap of two sets of these sizes that link."""
    return -(-(np.asarray(a, np.int64) + b) * percent // (100 + percent))


def count_vector(s: np.ndarray) -> bytes:
    """The counts over groups, by the hashes' leading bits: 32 groups, or so many more that eight shingles fall into one.

    The scale by which counts fit into bytes, then the counts, rounded up.
    """
    bits = COARSE_BITS
    while (8 << bits) < len(s) and bits < MOST_BITS:
        bits += 1
    count = np.bincount((s >> U64(64 - bits)).astype(np.int64), minlength=1 << bits)
    scale = 1 + int(count.max(initial=0)) // 256
    return np.array([scale], "<u4").tobytes() + (-(-count // scale)).astype(np.uint8).tobytes()


def read_vectors(raw: list[bytes], groups: int = 1 << COARSE_BITS) -> np.ndarray:
    """Counts over ``groups`` groups: finer ones are summed, as groups are told apart by leading bits."""
    out = np.zeros((len(raw), groups), np.int32)
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        flat = np.frombuffer(b"".join([raw[i] for i in rows]), np.uint8).reshape(len(rows), n)
        scale = np.ascontiguousarray(flat[:, :4]).view("<u4").astype(np.int32)
        out[rows] = (flat[:, 4:].astype(np.int32) * scale).reshape(len(rows), groups, -1).sum(2)
    return out


def within_reach(raw: list[bytes], n: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the summed minima of the pairs (indices), over the finest groups that both have, allow a link."""
    size = np.fromiter(map(len, raw), np.int64, len(raw)) - 4
    both, ok = np.minimum(size[a], size[b]), np.zeros(len(a), bool)
    for groups in np.unique(both).tolist():
        mine = np.flatnonzero(both == groups)
        used, back = np.unique(np.concatenate([a[mine], b[mine]]), return_inverse=True)
        step = max(1, 2_000_000 // groups)
        for i in range(0, len(mine), step):
            x, y = back[: len(mine)][i : i + step], back[len(mine) :][i : i + step]
            rows, at = np.unique(np.concatenate([x, y]), return_inverse=True)
            vec = read_vectors([raw[used[r]] for r in rows], groups)
            least = np.minimum(vec[at[: len(x)]], vec[at[len(x) :]]).sum(1)
            part = mine[i : i + step]
            ok[part] = least >= overlap_needed(n[a[part]], n[b[part]], percent)
    return ok


def heavy_groups(rows: DataFrame, k: int, most: int = MOST_HEAVY) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that several documents of some stretch of the table share, and how many: what is common over all is common in some stretch."""

    def count(batches):
        held, size = [], 0
        for b in batches:
            for s in _sets(b, 0, k):
                held.append(s)
                size += len(s)
                if size >= CHUNK:
                    yield _common(held)
                    held, size = [], 0
        yield _common(held)

    counts = rows.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    got = counts.orderBy(F.desc("n"), "h").limit(most).toArrow()
    h, n = got.column(0).to_numpy().view(U64), got.column(1).to_numpy()
    order = np.argsort(h)
    return h[order], n[order].astype(np.int64)


def _common(sets: list[np.ndarray]) -> pa.RecordBatch:
    all_ = np.sort(np.concatenate(sets)) if sets else np.zeros(0, U64)
    first = np.flatnonzero(np.append(True, all_[1:] != all_[:-1])) if len(all_) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(all_)))
    keep = n >= HEAVY_FROM
    return pa.RecordBatch.from_arrays([pa.array(all_[first[keep]].view(np.int64)), pa.array(n[keep])], ["h", "n"])


def points(rows: DataFrame, k: int, percent: int, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(id, body) -> id, n and cid (class) of each row; counts and root nodes once for each class and task, so copies are not sent on.

    A node that many share is dealt in parts (``dealt``), so that none of its tasks holds all of them.
    """
    sent = rows.sparkSession.sparkContext.broadcast(heavy)  # at most MOST_HEAVY numbers

    def make(batches):
        h, n_of = sent.value
        seen: set[int] = set()  # classes whose point this task has sent
        for b in batches:
            n, cid, vec, nodes, dealt = [], [], [], [], []
            for s in _sets(b, 1, k):
                n.append(len(s))
                cid.append(class_id(s) if len(s) else None)
                if not len(s) or cid[-1] in seen:
                    vec.append(None)
                    nodes.append(s[:0].view(np.int64))
                    dealt.append(np.zeros(0, np.int32))
                    continue
                if len(seen) > MOST_SEEN:
                    seen.clear()
                seen.add(cid[-1])
                vec.append(count_vector(s))
                p = len(s) - int(needed(len(s), percent)) + 1
                common = np.zeros(len(s), np.int64)
                if len(h):
                    where = np.minimum(np.searchsorted(h, s), len(h) - 1)
                    common = np.where(h[where] == s, n_of[where], 0)
                    order = np.argsort(common, kind="stable")
                    s, common = s[order], common[order]
                nodes.append(s[:p].view(np.int64))
                dealt.append((1 + common[:p] // DEALT).astype(np.int32))
            flat = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
            parts = np.concatenate(dealt) if dealt else np.zeros(0, np.int32)
            off = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in nodes])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.array(vec, pa.binary()), pa.ListArray.from_arrays(off, pa.array(flat)), pa.ListArray.from_arrays(off, pa.array(parts))], ["id", "n", "cid", "counts", "nodes", "dealt"]
            )

    return rows.mapInArrow(make, "id long, n long, cid long, counts binary, nodes array<long>, dealt array<int>")


def tree_pairs(n: np.ndarray, vec: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of points of a node (indices) whose bound allows a link.

    Points are packed by size into leaves; a leaf is passed over when no size in it can
    fit, or when the summed minima with its greatest counts stay below what is needed.
    """
    order = np.argsort(n, kind="stable")
    n, vec = n[order], vec[order]
    m = len(n)
    starts = np.arange(0, m, LEAF)
    top = np.maximum.reduceat(vec, starts, 0)
    low, high = n[starts], n[np.minimum(starts + LEAF, m) - 1]
    left, right = [], []
    for leaf, s in enumerate(starts):
        e = min(s + LEAF, m)
        # of later leaves (larger sets) those whose least size is still in reach
        reach = np.flatnonzero(needed(low, percent) <= high[leaf])
        reach = reach[reach >= leaf]
        box = np.minimum(top[leaf], top[reach]).sum(1) >= overlap_needed(low[leaf], low[reach], percent)
        for other in reach[box]:
            s2, e2 = starts[other], min(starts[other] + LEAF, m)
            bound = np.minimum(vec[s:e, None, :], vec[None, s2:e2, :]).sum(2)
            ok = bound >= overlap_needed(n[s:e, None], n[None, s2:e2], percent)
            if other == leaf:
                ok &= np.tri(e - s, e2 - s2, -1, bool).T
            i, j = np.nonzero(ok)
            left.append(order[s + i])
            right.append(order[s2 + j])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def whole_units(batches, keys: list[str]):
    """Record batches in order of ``keys`` -> tables that end where a unit ends.  A unit is bounded by how it was dealt."""
    held = None
    for b in batches:
        if not len(b):
            continue
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        key = np.stack([held.column(c).to_numpy() for c in keys], 1)
        change = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        if len(change):
            yield held.slice(0, int(change[-1]))
            held = held.slice(int(change[-1]))
    if held is not None and len(held):
        yield held


def unit_ranges(t: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each unit of a table that is in order of ``keys``."""
    key = np.stack([t.column(c).to_numpy() for c in keys], 1)
    start = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
    return start, np.append(start[1:], len(key))


def _near_groups(percent: int):
    """Nodes, in order (node, cid, n, counts) -> (spot, cid): the groups of a node's points that the tree's bounds connect.

    A group is named by a hash of its members, so the same group found in many nodes is one.
    """

    def search(batches):
        for t in whole_units(batches, ["node"]):
            cid, n, raw = t.column("cid").to_numpy(), t.column("n").to_numpy(), t.column("counts").to_pylist()
            vec = read_vectors(raw)
            start, end = unit_ranges(t, ["node"])
            two = end - start == 2
            a, b = start[two], start[two] + 1  # most nodes hold two points
            ok = np.minimum(vec[a], vec[b]).sum(1) >= overlap_needed(n[a], n[b], percent)
            left, right = [a[ok]], [b[ok]]
            for s, e in zip(start[end - start > 2].tolist(), end[end - start > 2].tolist()):
                x, y = tree_pairs(n[s:e], vec[s:e], percent)
                left.append(x + s)
                right.append(y + s)
            a, b = np.concatenate(left), np.concatenate(right)
            ok = within_reach(raw, n, a, b, percent)
            a, b = a[ok], b[ok]
            # the least point that is connected to each: pairs never leave their node
            least = np.arange(len(cid))
            while len(a):
                low = np.minimum(least[a], least[b])
                before = least.copy()
                np.minimum.at(least, a, low)
                np.minimum.at(least, b, low)
                least = least[least]
                if (before == least).all():
                    break
            row = np.unique(np.concatenate([a, b]))
            row = row[np.lexsort((cid[row], least[row]))]
            cut_ = np.flatnonzero(np.append(True, least[row][1:] != least[row][:-1])) if len(row) else row
            spots, members = [], cid[row]
            for s, e in zip(cut_.tolist(), [*cut_[1:].tolist(), len(row)]):
                spots += [class_id(members[s:e].astype(U64))] * (e - s)
            yield pa.RecordBatch.from_arrays([pa.array(spots, pa.int64()), pa.array(members)], ["spot", "cid"])

    return search


def fine_counts(s: np.ndarray) -> bytes:
    """The counts over 2**32 groups: the group of each shingle, in order."""
    return (s >> U64(32)).astype("<u4").tobytes()


def overlaps(lists: list[np.ndarray]) -> np.ndarray:
    """The summed minima of the counts of each two points, from their groups in order."""
    m = len(lists)
    of = np.repeat(np.arange(m), [len(x) for x in lists])
    value = np.concatenate(lists).astype(np.int64)
    # the i-th time that a point has a group counts as a group of its own: so minima become common groups
    place = np.arange(len(value))
    new = np.append(True, (value[1:] != value[:-1]) | (of[1:] != of[:-1]))[: len(value)]
    again = place - np.maximum.accumulate(np.where(new, place, 0))
    group, number, times = np.unique(value | (again << 32), return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.cumsum(shared) - 1
    keep = shared[number]
    of, at = of[keep], column[number[keep]]
    out = np.zeros((m, m), np.float32)
    width = max(1, 4_000_000 // m)
    order = np.argsort(at, kind="stable")
    of, at = of[order], at[order]
    for c in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(at, [c, c + width])
        x = np.zeros((m, min(width, int(shared.sum()) - c)), np.float32)
        x[of[lo:hi], at[lo:hi] - c] = 1
        out += x @ x.T
    return out.astype(np.int64)


def _fine_pairs(percent: int):
    """Units, in order (spot, i, j, side, cid, comp, n, fine) -> pairs (a, b), a < b, of different components whose finest counts allow a link."""

    def search(batches):
        for t in whole_units(batches, ["spot", "i", "j"]):
            i, j, side, cid, comp, n = (t.column(c).to_numpy() for c in ("i", "j", "side", "cid", "comp", "n"))
            raw = t.column("fine").to_pylist()
            left, right = [], []
            for s, e in zip(*(x.tolist() for x in unit_ranges(t, ["spot", "i", "j"]))):
                have = overlaps([np.frombuffer(r, "<u4") for r in raw[s:e]])
                ok = have >= overlap_needed(n[s:e, None], n[None, s:e], percent)
                ok &= comp[s:e, None] != comp[None, s:e]
                if i[s] != j[s]:
                    ok &= side[s:e, None] != side[None, s:e]
                x, y = np.nonzero(np.triu(ok, 1))
                left.append(cid[s + x])
                right.append(cid[s + y])
            a, b = np.concatenate(left), np.concatenate(right)
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return search


def _beside(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """(a, part, role, cid, info's columns): each ``b`` of pairs (a, b) beside its ``a``, whose own row comes first (role 0).  An ``a`` with many pairs is split."""
    many = cut(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > STAR).select("a", F.ceil(F.col("n") / STAR).cast("int").alias("parts")), "dup-many")
    salted = pairs.join(sized(many), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    own = salted.select("a", "part").distinct().select(F.col("a").alias("cid"), "a", "part", F.lit(0).alias("role"))
    roles = own.union(salted.select(F.col("b").alias("cid"), "a", "part", F.lit(1).alias("role")))
    rows = info.join(roles, "cid").select("a", "part", "role", *info.columns)
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", "role")


def in_reach(pairs: DataFrame, point: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose counts allow a link.  point: (cid, n, counts)."""

    def bound(batches):
        centre = None
        for b in batches:
            a, role, cid, n, raw = (b.column(c).to_pylist() for c in ("a", "role", "cid", "n", "counts"))
            if centre is not None:  # the pairs of an ``a`` may go on in the next batch
                a, role, cid, n, raw = ([x, *y] for x, y in zip(centre, (a, role, cid, n, raw)))
            if not a:
                continue
            of = np.maximum.accumulate(np.where(np.array(role) == 0, np.arange(len(a)), 0))
            here = np.flatnonzero(np.array(role) == 1)
            ok = here[within_reach(raw, np.array(n, np.int64), of[here], here, percent)]
            k = int(of[-1])
            centre = (a[k], 0, cid[k], n[k], raw[k])
            yield pa.RecordBatch.from_arrays([pa.array([a[x] for x in ok], pa.int64()), pa.array([cid[x] for x in ok], pa.int64())], ["a", "b"])

    return _beside(pairs, point.select("cid", "n", "counts")).mapInArrow(bound, "a long, b long")


class Texts:
    """Looks the sets of classes up again: rows (id, body), and first (cid, id), the id of a document of each class."""

    def __init__(self, rows: DataFrame, first: DataFrame, k: int):
        self.rows, self.first, self.k = rows, first, k

    def made(self, classes: DataFrame, name: str, make) -> DataFrame:
        """(cid, n, name): make(set) of each class in ``classes`` (cid); of copies within a task only one is sent."""
        k, ids = self.k, self.first.join(classes.select("cid").distinct(), "cid", "left_semi").select(F.col("id").alias("id_")).distinct()
        ids = sized(cut(ids, "dup-ids"))
        texts = self.rows.join(ids, F.col("id").eqNullSafe(F.col("id_")), "left_semi")

        def run(batches):
            seen: set[int] = set()
            for b in batches:
                cid, n, out = [], [], []
                for s in _sets(b, 0, k):
                    c = class_id(s) if len(s) else None
                    if c is None or c in seen:
                        continue
                    if len(seen) > MOST_SEEN:
                        seen.clear()
                    seen.add(c)
                    cid.append(c)
                    n.append(len(s))
                    out.append(make(s))
                yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(n, pa.int64()), pa.array(out, pa.binary())], ["cid", "n", name])

        return texts.select("body").mapInArrow(run, f"cid long, n long, {name} binary")


def verified(pairs: DataFrame, texts: Texts, percent: int) -> DataFrame:
    """The pairs (a, b) of classes, a working table, that link: decided on whole sets, which are made anew from the texts."""
    tune_arrow(pairs.sparkSession)
    used = pairs.select(F.col("a").alias("cid")).union(pairs.select("b"))
    sets = texts.made(used, "set", lambda s: s.tobytes())

    def check(batches):
        centre = own_set = None
        for b in batches:
            left, right = [], []
            for a, role, cid, raw in zip(*(b.column(c).to_pylist() for c in ("a", "role", "cid", "set"))):
                s = np.frombuffer(raw, U64)
                if role == 0:
                    centre, own_set = a, s
                    continue
                if a != centre:
                    raise ValueError("a set without the set that it is compared with")
                x, y = (s, own_set) if len(s) <= len(own_set) else (own_set, s)
                at = np.searchsorted(y, x)
                shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    left.append(a)
                    right.append(cid)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return _beside(pairs, sets.select("cid", "set")).mapInArrow(check, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(x, root): the least vertex of each vertex's component, for vertices with a link, by alternating large and small stars."""
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "dup-edges")
    seen = None
    while True:
        size = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if size == seen or not size[0]:
            break
        seen = size
        ways = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = ways.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        edges = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "dup-edges")
    return edges.select(F.col("u").alias("x"), F.col("v").alias("root")).union(edges.select("v", "v")).distinct()


class Tree:
    """The points of all rows, and the groups of points (spots) within which links can lie.

    pts: (id, n, cid, ..) of each row; classes: (cid, least id); spots: (spot, cid, m).
    """

    def __init__(self, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str):
        tune_arrow(docs.sparkSession)
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
        self.percent = percent
        self.pts = cut(points(rows, k, percent, heavy_groups(rows.select("body"), k)), "dup-points")
        self.classes = cut(self.pts.filter("cid IS NOT NULL").groupBy("cid").agg(F.min("id").alias("least")), "dup-classes")
        self.texts = Texts(rows, self.classes.select("cid", F.col("least").alias("id")), k)
        member = cut(self._members(), "dup-nodes")
        point = self.pts.filter("counts IS NOT NULL").select("cid", "n", "counts").join(member.select("cid").distinct(), "cid", "left_semi").dropDuplicates(["cid"])
        self.point = cut(point, "dup-info")
        # a node of many points isn't searched for groups: it is one
        found = member.filter(F.col("m") <= BLOCK).join(self.point, "cid").select("node", "cid", "n", "counts")
        found = found.repartition("node").sortWithinPartitions("node").mapInArrow(_near_groups(percent), "spot long, cid long").distinct()
        spots = cut(found.union(member.filter(F.col("m") > BLOCK).select("node", "cid")), "dup-groups")
        size = sized(cut(spots.groupBy("spot").agg(F.count(F.lit(1)).alias("m")), "dup-sizes"))
        self.spots = cut(spots.join(size, "spot"), "dup-spots")

    def _members(self) -> DataFrame:
        """(node, cid, m) of the root's nodes that hold several classes; of nodes that hold the same classes, one."""
        each = self.pts.select("cid", F.explode(F.arrays_zip("nodes", "dealt")).alias("x")).select("cid", F.col("x.nodes").alias("node"), F.col("x.dealt").cast("long").alias("parts"))
        # a node's part, with the number of its parts in front: the same columns and conditions for all uses, so that they share one exchange
        each = each.select("cid", "node", (F.col("parts") * PARTS + F.pmod(F.xxhash64("cid"), F.col("parts"))).alias("part"))
        # dealt once: the copies that several tasks have sent, the counts and the join all keep that
        each = each.filter("node IS NOT NULL AND part IS NOT NULL").repartition("node", "part").dropDuplicates(["node", "part", "cid"])
        held = [F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("cid")).alias("h"), F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("g")]
        some = each.groupBy("node", "part").agg(*held).withColumn("parts", F.shiftright("part", 32)).filter("m > 1 OR parts > 1")
        node = some.groupBy("node").agg(F.first("parts").alias("parts"), F.sum("m").alias("m"), F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g")).filter("m > 1")
        one = node.groupBy("m", "h", "g").agg(F.min(F.struct("node", "parts")).alias("x"))
        one = one.select("x.node", "m", F.explode(F.sequence(F.col("x.parts") * PARTS, F.col("x.parts") * (PARTS + 1) - 1)).alias("part"))
        return each.join(one, ["node", "part"]).select("node", "cid", "m")

    def pairs(self, here: DataFrame) -> DataFrame:
        """(spot, cid, comp) -> the distinct pairs of classes of different ``comp`` that share a spot and whose finest counts allow a link.

        A spot of many points, or of large ones, is dealt in blocks.  Those of its largest component
        meet only the blocks of others, as links between them are known to be of no use.
        """
        here = cut(joined_spots(here), "dup-here")
        here = cut(here.join(self.point.select("cid", "n"), "cid"), "dup-here")
        total = here.groupBy("spot").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
        large = cut(total.filter("blocks > 1"), "dup-large")
        most = here.join(sized(large), "spot").groupBy("spot", "comp").agg(F.count(F.lit(1)).alias("c"), F.first("blocks").alias("blocks"))
        most = most.groupBy("spot").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.first("blocks").alias("blocks"))
        here = here.join(sized(cut(most, "dup-main")), "spot", "left")
        # blocks 0 .. b - 1 hold the main component, b .. 2 b - 1 all others
        b = F.coalesce("blocks", F.lit(1))
        main = F.coalesce(F.col("comp") == F.col("main"), F.lit(False))
        side = F.when(F.isnull("blocks"), 0).otherwise(F.pmod(F.xxhash64("cid"), b) + F.when(main, 0).otherwise(b)).cast("int")
        other = F.when(F.isnull("blocks"), F.array(F.lit(0))).when(main, F.sequence(b, 2 * b - 1)).otherwise(F.sequence(F.lit(0), 2 * b - 1))
        units = here.withColumn("side", side).withColumn("other", F.explode(other))
        units = units.select("spot", F.least("side", "other").cast("int").alias("i"), F.greatest("side", "other").cast("int").alias("j"), "side", "cid", "comp", "n")
        fine = self.texts.made(here, "fine", fine_counts).select("cid", "fine").dropDuplicates(["cid"])
        units = units.join(fine, "cid").repartition("spot", "i", "j").sortWithinPartitions("spot", "i", "j")
        found = units.select("spot", "i", "j", "side", "cid", "comp", "n", "fine").mapInArrow(_fine_pairs(self.percent), "a long, b long")
        return cut(found.distinct(), "dup-rest")


def joined_spots(here: DataFrame) -> DataFrame:
    """(spot, cid, comp), a working table -> spots that share points are one, as long as that has at most ``BLOCK`` points; larger ones stay as they are.

    A family of copies has many spots that differ by a few members; joined, each of its points stands in one.
    """
    least = here.groupBy("spot").agg(F.min("cid").alias("a"))
    root = cut(components(here.join(least, "spot").select("a", F.col("cid").alias("b"))), "dup-families")
    small = root.groupBy("root").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") <= BLOCK).select("root")
    small = cut(root.join(small, "root").select(F.col("x").alias("cid"), "root"), "dup-families")
    both = here.join(small, "cid", "left")
    return both.filter("root IS NULL").select("spot", "cid", "comp").union(both.filter("root IS NOT NULL").select("root", "cid", "comp").distinct())


def near_duplicates(docs: DataFrame, k: int = K, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id and class_id (equal sets) of each row."""
    tree = Tree(docs, k, percent, id_col, text_col)
    # a spot is compared with its most central member first: the one whose spots hold most points, as the text
    # that copies were edited from has its nodes in common with all of them, and a copy has some of its own
    central = tree.spots.groupBy("cid").agg(F.sum("m").alias("weight"))
    best = tree.spots.join(central, "cid").groupBy("spot").agg(F.max(F.struct("weight", "cid"))["cid"].alias("first"))
    spots = cut(tree.spots.join(sized(cut(best, "dup-best")), "spot"), "dup-stars")
    star = cut(spots.filter("cid <> first").select(F.col("first").alias("a"), F.col("cid").alias("b")).distinct(), "dup-star")
    star = cut(in_reach(star, tree.point, percent), "dup-star")
    links = cut(verified(star, tree.texts, percent), "dup-links")
    comp = cut(components(links), "dup-components")
    # what is left: the others of a spot (a spot of two has none) whose components still differ
    here = spots.filter("cid <> first AND m > 2").join(comp.select(F.col("x").alias("cid"), "root"), "cid", "left").select("spot", "cid", F.coalesce("root", "cid").alias("comp"))
    here = cut(here, "dup-open")
    mixed = here.groupBy("spot").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("spot")
    more = verified(tree.pairs(cut(here.join(mixed, "spot", "left_semi"), "dup-mixed")), tree.texts, percent)
    comp = components(links.union(more))
    named = tree.classes.join(comp.select(F.col("x").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    named = cut(named.select("cid", "root", "least"), "dup-named")
    names = named.groupBy("root").agg(F.min("least").alias("component"))
    of_class = named.select("cid", "root").join(names, "root").select("cid", "component")
    out = tree.pts.select("id", "n", "cid").join(of_class, "cid", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"), F.col("cid").alias("class_id"))


def near_duplicate_links(docs: DataFrame, k: int = K, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links, those inside components too: (id, class_id) of each row, class_id null without words, and (a, b), every pair of classes that link, once."""
    tree = Tree(docs, k, percent, id_col, text_col)
    pairs = tree.pairs(tree.spots.select("spot", "cid", F.col("cid").alias("comp")))
    return tree.pts.select(F.col("id").alias(id_col), F.col("cid").alias("class_id")), verified(pairs, tree.texts, percent)


def link_counts(docs: DataFrame, k: int = K, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id (the least id of a document with an equal set) and n_links (other classes that link to the row's) of each row."""
    of_row, links = near_duplicate_links(docs, k, percent, id_col, text_col)
    links = cut(links, "dup-links")
    ends = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("cid")).agg(F.count(F.lit(1)).alias("n_links"))
    classes = of_row.filter("class_id IS NOT NULL").groupBy(F.col("class_id").alias("cid")).agg(F.min(id_col).alias("least")).join(ends, "cid", "left")
    out = of_row.join(classes, F.col("class_id") == F.col("cid"), "left")
    return out.select(id_col, F.coalesce("least", id_col).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def without_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group stays: the one with the least id, null ids last.  Rows are told apart by a key of their own, as ids may repeat or be null."""
    key, = temp_name(docs, "row")
    rows = cut(docs.withColumn(key, F.monotonically_increasing_id()), "dup-rows")
    groups = near_duplicates(rows, k, percent, id_col=key).select(key, F.col("component_id").alias("group"))
    groups = cut(groups.join(rows.select(key, F.col("doc_id").alias("id")), key), "dup-groups")
    stays = groups.groupBy("group").agg(F.min(F.struct(F.isnull("id"), "id", key))[key].alias("kept"))
    gone = cut(groups.join(stays, "group").filter(F.col(key) != F.col("kept")).select(key), "dup-gone")
    return rows.join(sized(gone), key, "left_anti").select(*docs.columns)


def op7_jaccard_groups(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(docs_table(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op7_link_counts(spark, sf_dir: str) -> DataFrame:
    return link_counts(docs_table(spark, sf_dir))


OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[p : p + 3], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS p FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*)::BIGINT AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(v, r) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.v, ways.b FROM reach JOIN ways ON reach.r = ways.a
), least AS (SELECT v, min(r) AS r FROM reach GROUP BY v)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, r AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON v = d.doc_id
"""

OP7_LINKS_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[p : p + 3], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS p FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*)::BIGINT AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b, c = x.n AND c = y.n AS same FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), classes AS (
  SELECT doc_id, least(doc_id, min(b)) AS class_id FROM documents LEFT JOIN links ON a = doc_id AND same GROUP BY doc_id
), counts AS (
  SELECT a, count(DISTINCT class_id) AS n_links FROM links JOIN classes ON doc_id = b WHERE NOT same GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links FROM classes LEFT JOIN counts ON a = doc_id
"""
