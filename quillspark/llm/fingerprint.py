"""Operator 6: document fingerprints from closed syncmers.

A text's k-mers of code points are taken as anchors when the least of their inner
s-mers (by hash) is the first or the last one.  Whether a k-mer is an anchor
depends on its own characters only, so an edit moves no anchor elsewhere.

A fingerprint is the sequence of all anchors, of the whole text: of each its distance
from the one before and 12 bits of its hash, as three characters (more for distances
over 62).  Distance and hash together are the anchor's token.  The likeness of two
fingerprints is the positional match: the longest sequence of tokens that both have in
the same order, repeated tokens included, as a share of all
tokens of both (the matched ones counted once).  It isn't sampled; two tokens of unrelated texts are equal once in some 10**5
pairs, which brings near 0.001 to the likeness of unrelated texts of 1,000 words.

Neighbours come from one range sort by descending id: inside a partition each row
meets its successor while the rows stream by; the rows at the partitions' edges,
one pair for each partition, are finished afterwards.

Defined cases: null counts as empty; an empty text has the empty fingerprint, which
is like itself (1.0) and unlike all others (0.0); a text shorter than ``K`` is one
anchor, and so is any other that has none (which only texts of up to 54 code points can); ids that repeat are ordered by their texts, null ids come last; a single row
follows itself; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, docs_table, tune_arrow
from .vector import U64, mix

K, S = 32, 8
_DIGITS = np.frombuffer(b"-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz", np.uint8)
_VALUE = np.zeros(256, np.int64)
_VALUE[_DIGITS] = np.arange(64)
#: The greatest distance that one character says; the last character stands for "so many more".
FAR = 63
_A = [U64(pow(0xD1342543DE82EF95, 1 << i, 1 << 64)) for i in range(5)]


def _whole(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text of at least one code point as one anchor."""
    h = np.array([len(codes)], U64)
    for x in mix(codes.astype(U64)):
        h = mix(h + x)
    return np.zeros(1, np.int64), h


def anchors(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions (code points) and 64-bit hashes of a text's closed syncmers."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    if n < K:
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return _whole(codes)
    h = mix(codes.astype(U64) + U64(1))
    for i, a in enumerate(_A[:3]):  # 2, 4, 8 code points
        h = h[: -(1 << i)] * a + h[1 << i :]
    inner = mix(h)
    least = inner
    for w in (1, 2, 4, 8):  # over 2, 4, 8, 16 places
        least = np.minimum(least[:-w], least[w:])
    last = K - S  # over all K - S + 1 places
    least = np.minimum(least[: len(inner) - last], least[last - 15 :])
    at = np.flatnonzero((inner[: len(least)] == least) | (inner[last:] == least))
    return at, mix(((h[at] * _A[3] + h[at + 8]) * _A[4]) + h[at + 16] * _A[3] + h[at + 24])


def anchors_or_whole(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """As ``anchors``; a text that isn't empty and has none is one anchor itself."""
    at, h = anchors(text)
    return _whole(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)) if text and not len(at) else (at, h)


def tokens(text: str | None) -> np.ndarray:
    """Of each anchor in order its distance from the one before, above 12 bits of its hash."""
    at, h = anchors_or_whole(text)
    return np.diff(at, prepend=0) << 12 | (h >> U64(52)).astype(np.int64)


def write_tokens(values: np.ndarray) -> str:
    gap, more = values >> 12, values >> 12 >= FAR
    digits = np.stack([gap % FAR, values >> 6 & 63, values & 63], 1)
    if not more.any():
        return _DIGITS[digits].tobytes().decode()
    shown = _DIGITS[digits].tobytes().decode()
    return "".join(chr(_DIGITS[63]) * int(g) + shown[3 * i : 3 * i + 3] for i, g in enumerate((gap // FAR).tolist()))


def read_tokens(fingerprint: str) -> np.ndarray:
    value, out, far = _VALUE[np.frombuffer(fingerprint.encode(), np.uint8)], [], 0
    if len(value) % 3 == 0 and not (value[::3] == 63).any():
        return value[::3] << 12 | value[1::3] << 6 | value[2::3]
    i = 0
    while i < len(value):
        if value[i] == 63:
            far, i = far + FAR, i + 1
            continue
        out.append((far + int(value[i])) << 12 | int(value[i + 1]) << 6 | int(value[i + 2]))
        far, i = 0, i + 3
    return np.array(out, np.int64)


#: Pairs of equal tokens, for each token of both, up to which sequences are grown pair by pair.
FEW_PAIRS = 20
#: Tokens in a block of the table otherwise.
BLOCK_BITS = 1 << 15


def by_pairs(a: np.ndarray, b: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray) -> int:
    """Pair by pair: of the sequences of each length so far the least last place; an element's own places from the last down, so that it counts once."""
    ends: list[int] = []
    for x, y in zip(low.tolist(), high.tolist()):
        for p in order[x:y][::-1].tolist():
            k = bisect_left(ends, p)
            ends[k : k + 1] = [p]
    return len(ends)


def by_rows(a: np.ndarray, b: np.ndarray) -> int:
    """Row by row of the table of longest common sequences, a row's steps as bits of one number, block by block of ``a``; steps go over between blocks as carries."""
    carries, shared, other = [0] * len(b), 0, b.tolist()
    for at in range(0, len(a), BLOCK_BITS):
        part = a[at : at + BLOCK_BITS].tolist()
        where: dict[int, int] = {}
        for i, t in enumerate(part):
            where[t] = where.get(t, 0) | 1 << i
        full = row = (1 << len(part)) - 1
        for j, t in enumerate(other):
            at_t, carry = where.get(t, 0), carries[j]
            if at_t or carry:
                new = row + (row & at_t) + carry
                carries[j] = new >> len(part)
                row = (new | (row & ~at_t)) & full
        shared += len(part) - row.bit_count()
    return shared


def common_in_order(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest sequence of values that both have in the same order, however often values repeat."""
    m = min(len(a), len(b))
    other = a[:m] != b[:m]
    before = int(other.argmax()) if other.any() else m
    a, b, m = a[before:], b[before:], m - before
    other = a[len(a) - m :][::-1] != b[len(b) - m :][::-1]
    after = int(other.argmax()) if other.any() else m
    a, b = a[: len(a) - after], b[: len(b) - after]
    a, b = a[np.isin(a, b)], b[np.isin(b, a)]
    if not len(a):
        return before + after
    order = np.argsort(b, kind="stable")
    low, high = (np.searchsorted(b[order], a, side) for side in ("left", "right"))
    few = int((high - low).sum()) <= FEW_PAIRS * (len(a) + len(b))
    return before + after + (by_pairs(a, b, order, low, high) if few else by_rows(a, b))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The longest sequence of tokens common in order, as a share of all tokens of both."""
    if not len(a) and not len(b):
        return 1.0
    shared = common_in_order(a, b)
    return shared / (len(a) + len(b) - shared)


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the beginning of ``following``, or all of it."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


#: The working table.  An edited text's fingerprint begins as the text's own does: only ``kept`` (so many characters of that) and the rest are stored.
OUT = pa.schema([("part", pa.int32()), ("edge", pa.string()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("kept", pa.int32()), ("rest", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())])
OUT_SQL = "part int, edge string, doc_id long, n_chars long, edited_sha256 string, fingerprint string, kept int, rest string, near_edited double, near_next double, text string"


def _finish(text: str, own: np.ndarray, following: str, next_tokens: np.ndarray) -> tuple:
    new = edited(text, following)
    s = tokens(new) if new != text else own
    m = min(len(own), len(s))
    other = own[:m] != s[:m]
    same = int(other.argmax()) if other.any() else m
    shown = write_tokens(own)
    kept = 3 * same + int(((own[:same] >> 12) // FAR).sum())
    return hashlib.sha256(new.encode()).hexdigest(), shown, kept, write_tokens(s[same:]), likeness(own, s), likeness(own, next_tokens)


def _stream(batches):
    """Rows in order -> finished rows; the partition's last row and its first keep their texts."""
    from pyspark import TaskContext

    part, held, first = TaskContext.get().partitionId(), None, True
    for b in batches:
        rows = []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            text = text or ""
            own = tokens(text)
            if held is not None:
                d, t, s = held
                rows.append((part, "", d, len(t), *_finish(t, s, text, own), None))
            if first:
                rows.append((part, "head", doc, len(text), None, write_tokens(own), None, None, None, None, text))
                first = False
            held = (doc, text, own)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(OUT), OUT)], schema=OUT)
    if held is not None:
        d, t, s = held
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((part, "tail", d, len(t), None, write_tokens(s), None, None, None, None, t), OUT)], schema=OUT)


def _ends(batches):
    """The partitions' last rows, each with its successor's text and fingerprint."""
    for b in batches:
        doc, text, own, following, other = (c.to_pylist() for c in b.columns)
        rows = [(0, "", d, len(t), *_finish(t, read_tokens(s), f, read_tokens(o)), None) for d, t, s, f, o in zip(doc, text, own, following, other)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(OUT), OUT)], schema=OUT)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row."""
    tune_arrow(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    by = [F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first()]
    # rows of one id may be many: how their texts begin tells them apart
    rows = rows.repartitionByRange(by[0], F.substring("text", 1, 64).asc_nulls_first()).sortWithinPartitions(*by)
    rows = cut(rows.mapInArrow(_stream, OUT_SQL), "fingerprints")
    # one head and one tail for each partition; the order of partitions is found without their texts
    heads = rows.filter("edge = 'head'")
    parts, order = heads.select("part"), Window.orderBy("part")
    before = F.coalesce(F.lag("part").over(order), F.last("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    parts = parts.select(F.col("part").alias("p"), before.alias("of"))
    heads = heads.select("part", F.col("text").alias("following"), F.col("fingerprint").alias("other")).join(parts, F.col("part") == F.col("p")).drop("part", "p")
    tails = rows.filter("edge = 'tail'").join(heads, F.col("part") == F.col("of")).select("doc_id", "text", "fingerprint", "following", "other")
    out = rows.filter("edge = ''").unionByName(tails.mapInArrow(_ends, OUT_SQL))
    new = F.concat(F.substring("fingerprint", F.lit(1), F.col("kept")), F.col("rest"))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", new.alias("edited_fingerprint"), "near_edited", "near_next")


def document_anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, position, hash) of every anchor, for matching passages by position."""
    tune_arrow(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def spans(batches):
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at, h = anchors_or_whole(text)
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array(h.view(np.int64))], ["doc_id", "position", "hash"])

    return rows.mapInArrow(spans, "doc_id long, position long, hash long")


def op6_syncmer_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(docs_table(spark, sf_dir))
