"""Operator 9: token counts through a digest cache.

The cache is a Parquet table of (tokenizer digest, content digest, n_tokens).
Texts are looked up by SHA-256 of their content and the digest of the tokenizer's
file; only distinct contents that the cache doesn't hold are encoded, and their
counts are appended to it.  "Normalised" content is the text with null as the
empty text: nothing further may be folded, as these tokenizers see every byte.

Defined cases: null counts as empty (0 bytes, 0 tokens); repeated rows share one
encoding; columns other than the id and the text are ignored; an empty table gives
an empty result and appends nothing.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, docs_table, fold, fresh_path, sized, tune_arrow
from .vector import doc_bytes

LIMIT = 512
#: Digests that a task remembers as encoded; beyond that it starts anew.
MOST_SEEN = 1_000_000
CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _counter(path: str):
    """A function from an Arrow text column to counts: tokenizers for .json, sentencepiece for .model."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda column: [len(x) for x in model.encode([t or "" for t in column.to_pylist()], num_threads=1)]
    from .pretoken import PieceEncoder

    encoder = PieceEncoder(path)
    return lambda column: encoder.counts(*doc_bytes(column))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, digest and n_tokens of each row; misses are appended to the Parquet table at ``cache``.

    The cache is asked by digests alone.  Of each content that it lacks, the row of the least id is encoded;
    texts move only if there are more of those than may be sent to all tasks.
    """
    spark = docs.sparkSession
    tune_arrow(spark)
    version = tokenizer_digest(tokenizer)
    content = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(content.cast("binary"), 256))
    rows = cut(docs.select(F.col(id_col).alias("id"), F.octet_length(content).cast("long").alias("n_bytes"), digest.alias("digest")), "count-rows")
    known = cached(spark, cache).filter(F.col("tokenizer") == version)
    misses = rows.groupBy("digest").agg(F.min("id").alias("least")).join(known, "digest", "left_anti")
    misses = cut(misses, "count-misses")
    if misses.head(1):
        texts = docs.select(F.col(id_col).alias("id"), digest.alias("digest"), content.alias("text"))
        owner = sized(misses.select(F.col("digest").alias("d_"), "least"))
        texts = texts.join(owner, (F.col("digest") == F.col("d_")) & F.col("id").eqNullSafe(F.col("least")), "left_semi").select("digest", "text")

        def encode(batches):
            count, seen = _counter(tokenizer), set()
            for b in batches:
                fresh = []
                for i, d in enumerate(b.column(0).to_pylist()):  # rows that repeat an id and its text
                    if d not in seen:
                        seen.add(d)
                        fresh.append(i)
                if len(seen) > MOST_SEEN:
                    seen.clear()
                b = b.take(pa.array(fresh, pa.int64()))
                n = pa.array(count(b.column(1)), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([version] * len(b), pa.string()), b.column(0), n], ["tokenizer", "digest", "n_tokens"])

        made = texts.mapInArrow(encode, CACHE_SCHEMA).groupBy("tokenizer", "digest").agg(F.first("n_tokens").alias("n_tokens"))
        made.write.mode("append").parquet(cache)
    known = cached(spark, cache).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))
    known = cut(known, "count-known")  # a table, so that the join can split the rows of a hot text
    return rows.join(known, "digest", "left").select(F.col("id").alias(id_col), "n_bytes", "digest", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))


def cached(spark, cache: str) -> DataFrame:
    """The cache's rows; none where it doesn't exist yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, path, cache = docs_table(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), fresh_path(spark, "token-cache")
    # as a pipeline meets the cache: an earlier part of the table has filled some of it
    count_tokens(docs.filter(fold("doc_id", 2) == 0), path, cache)
    out = count_tokens(docs, path, cache)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
