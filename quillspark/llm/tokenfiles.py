"""Operator 10: token ids in binary files with a minimal perfect hash index.

``write_token_files`` sorts documents by id over the cluster, encodes them and
writes one file per sorted range to the shared folder.  Ranges also go by text and
row, so that the rows of one much repeated (or null) id fill many files:

    payload   ids, end to end, little-endian
    index     level sizes (u64 each), level bits (u64 words), then for each slot its
              fingerprint (u32) and document number (u32)
    keys      the documents' ids (i64), then n_docs + 1 offsets into the payload (u64)
    footer    8 x u64: n_docs, n_ids, bytes per id, number of levels, number of bit
              words, number of slots, number of documents without an id (the last
              ones; no index leads to them), crc32 of the payload; then the magic "QTOKENS2"

A document key (its id) is looked up without a search: a minimal perfect hash
(levels of bit sets; a key belongs to the first level where its bit is its own;
its slot is the number of bits before) gives the slot, whose stored fingerprint
tells a foreign key from a stored one.  A reader takes the footer and the index, and then
seeks: the payload of other documents isn't read.

Only the manifest (one row per file) is gathered; files are written to a name of
their attempt and then moved, so a lost executor's work is simply done again.

Defined cases: null text is empty (only the end id); a null id sorts last;
repeated ids keep their own runs of ids, in the order of their texts' first ``LEAD``
characters and then of a hash, and each file's index leads to its first of them; an
empty table writes no file and gives an empty result.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, docs_table, fresh_path, tune_arrow
from .vector import doc_bytes, mix, ragged

MAGIC, FOOTER = b"QTOKENS2", 72
GAMMA = 1.5
#: Characters of a text that ranges of one id are told apart by, before a hash of all.
LEAD = 64
#: Bytes of payload that a reader takes at once, about.
READ_BYTES = 4 << 20


def _level_hash(keys: np.ndarray, level: int) -> np.ndarray:
    return mix(keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))


class PerfectHash:
    """A minimal perfect hash of distinct int64 keys: 0..n-1 without gaps."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        ones = np.bitwise_count(bits).astype(np.int64)
        self.ones_before = np.concatenate([[0], np.cumsum(ones)])
        self.starts = np.concatenate([[0], np.cumsum([s // 64 for s in sizes])]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, words, level, left = [], [], 0, np.asarray(keys, np.int64)
        while len(left):
            size = -(-max(64, int(len(left) * GAMMA)) // 64) * 64
            at = (_level_hash(left, level) % np.uint64(size)).astype(np.int64)
            own = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(own, bitorder="little").view(np.uint64))
            left = left[~own[at]]
            level += 1
        return cls(sizes, np.concatenate(words) if words else np.zeros(0, np.uint64))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """-1 for keys that no level holds; other foreign keys get some slot."""
        keys = np.asarray(keys, np.int64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = (_level_hash(keys[open_], level) % np.uint64(size)).astype(np.int64)
            word, bit = self.starts[level] + at // 64, (at % 64).astype(np.uint64)
            w = self.bits[word]
            hit = (w >> bit) & np.uint64(1) == 1
            rank = self.ones_before[word] + np.bitwise_count(w & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = rank[hit]
            open_ = open_[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(np.asarray(keys, np.int64).astype(np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype(np.uint32)


def _file(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _index(ids: np.ndarray, lengths: np.ndarray, n_null: int) -> tuple[bytes, list[int]]:
    """Index and keys, and the numbers of levels, bit words, slots and documents without an id."""
    keys, first = np.unique(ids[: len(ids) - n_null], return_index=True)
    table = PerfectHash.build(keys)
    slot = table.slot(keys)
    prints, number = np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<u4")
    prints[slot], number[slot] = fingerprints(keys), first
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    parts = (np.array(table.sizes, "<u8"), table.bits.astype("<u8"), prints, number, ids.astype("<i8"), offsets.astype("<u8"))
    return b"".join(p.tobytes() for p in parts), [len(table.sizes), len(table.bits), len(keys), n_null]


class TokenFile:
    """Access to one file by key; what is read of the payload is what is asked for."""

    def __init__(self, path: str):
        system, name = _file(path)
        self.path, self.file = path, system.open_input_file(name)
        end = self.file.size()
        foot = self.file.read_at(FOOTER, end - FOOTER) if end >= FOOTER else b""
        if foot[-8:] != MAGIC:
            raise ValueError(f"not a token file: {path}")
        self.n_docs, self.n_ids, self.width, levels, words, slots, self.n_null, self.crc = map(int, np.frombuffer(foot, "<u8", 8))
        raw, at, parts = self.file.read_at(end - FOOTER - self.n_ids * self.width, self.n_ids * self.width), 0, []
        for kind, n in (("<u8", levels), ("<u8", words), ("<u4", slots), ("<u4", slots), ("<i8", self.n_docs), ("<u8", self.n_docs + 1)):
            parts.append(np.frombuffer(raw, kind, n, at))
            at += n * int(kind[2])
        sizes, bits, self.prints, self.number, self.keys, offsets = parts
        self.offsets = offsets.astype(np.int64)
        self.table = PerfectHash([int(s) for s in sizes], bits)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key's (first) document, -1 for keys that the file doesn't hold."""
        keys = np.asarray(keys, np.int64)
        slot = self.table.slot(keys)
        known = np.flatnonzero(slot >= 0)
        known = known[self.prints[slot[known]] == fingerprints(keys[known])]
        out = np.full(len(keys), -1, np.int64)
        number = self.number[slot[known]].astype(np.int64)
        same = self.keys[number] == keys[known]  # a fingerprint errs once in 2**32
        out[known[same]] = number[same]
        return out

    def read(self, first: int, last: int) -> np.ndarray:
        """The ids of documents ``first`` to ``last - 1``, end to end."""
        a, b = int(self.offsets[first]), int(self.offsets[last])
        return np.frombuffer(self.file.read_at((b - a) * self.width, a * self.width), f"<u{self.width}")

    def get(self, key: int) -> np.ndarray | None:
        """The ids of a document, or None if the file doesn't hold it."""
        d = int(self.find(np.array([key]))[0])
        return self.read(d, d + 1) if d >= 0 else None

    def documents(self):
        """(keys, whether each is one, start and end of its ids, ids of all, where they start) of all documents in order, some MB at a time, each looked up by its key.

        A repeated key leads to its first document, which the others follow; those without an id come last.
        """
        crc, i = 0, 0
        while i < self.n_docs:
            j = min(self.n_docs, max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + READ_BYTES // self.width, "right")) - 1))
            keys, has = self.keys[i:j], np.arange(i, j) < self.n_docs - self.n_null
            at = self.find(keys)
            if (at[has] < 0).any():
                raise ValueError(f"damaged index: {self.path}")
            number = np.where(has, at + (np.arange(i, j) - np.searchsorted(self.keys[: self.n_docs - self.n_null], keys)), np.arange(i, j))
            ids = self.read(i, j)
            crc = zlib.crc32(ids, crc)
            yield keys, has, self.offsets[number], self.offsets[number + 1], ids, int(self.offsets[i])
            i = j
        if crc != self.crc:
            raise ValueError(f"damaged token file: {self.path}")


MANIFEST = "first_id long, last_id long, n_docs long, n_ids long, path string, part long"


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files as it is evaluated, and returns their manifest, one row per file, in no order.

    part: tells files apart that begin and end with the same id; they follow each other by it.
    """
    tune_arrow(docs.sparkSession)

    def write(batches):
        from .pretoken import PieceEncoder

        out, ids, lengths, crc, total, nulls = None, [], [], 0, 0, 0
        system, base = _file(folder)
        temp = f"{base}/.{uuid.uuid4().hex}"
        for b in batches:
            if not len(b):
                continue
            if out is None:
                system.create_dir(base, recursive=True)
                encoder, out = PieceEncoder(tokenizer), system.open_output_stream(temp)
                width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
            flat, n = encoder.encode(*doc_bytes(b.column(1)))
            with_end = np.full(len(flat) + len(n), end_id, f"<u{width}")
            with_end[ragged(np.cumsum(n + 1) - (n + 1), n)] = flat
            raw = with_end.tobytes()
            crc, total = zlib.crc32(raw, crc), total + len(with_end)
            out.write(raw)
            ids.append(b.column(0).fill_null(0).to_numpy(zero_copy_only=False))
            nulls += b.column(0).null_count
            lengths.append(n + 1)
        if out is None:
            return
        ids, lengths = np.concatenate(ids), np.concatenate(lengths)
        index, numbers = _index(ids, lengths, nulls)
        out.write(index)
        out.write(np.array([len(ids), total, width, *numbers, crc], "<u8").tobytes() + MAGIC)
        out.close()
        name = f"{uuid.uuid4().hex}.tok"
        system.move(temp, f"{base}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.string() if isinstance(x, str) else pa.int64()) for x in (int(ids[0]) if nulls < len(ids) else None, int(ids[-nulls - 1]) if nulls < len(ids) else None, len(ids), total, f"{folder}/{name}", TaskContext.get().partitionId())], ["first_id", "last_id", "n_docs", "n_ids", "path", "part"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumns({"lead": F.left("text", F.lit(LEAD)), "hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.col("id").asc_nulls_last(), "lead", "hash", "row"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text").mapInArrow(write, MANIFEST)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files, found by its key through the index.

    The running sum goes over the manifest: one row per file.
    """
    spark = manifest.sparkSession
    manifest = cut(manifest, "token-manifest")
    in_order = Window.orderBy(F.isnull("first_id"), "first_id", "last_id", "part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(in_order), F.lit(0)))
    n = max(1, min(manifest.count(), 100_000))

    def read(batches):
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with TokenFile(path) as f:
                    for keys, has, start, end, ids, at in f.documents():
                        wide = ids.astype("<u4")
                        crc = [zlib.crc32(wide[s:e]) for s, e in zip((start - at).tolist(), (end - at).tolist())]
                        yield pa.RecordBatch.from_arrays([pa.array(keys, mask=~has), pa.array(base + start), pa.array(end - start), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("path", "base").repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_token_files(write_token_files(docs_table(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), fresh_path(spark, "token-files")))
