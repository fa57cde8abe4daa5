"""The corpus pipeline: what is fit for training, once each, clean of benchmarks, mixed by source and dealt into shards.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and
returns the columns of documents; the last returns where each document goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontam, mixing, neardup, sharding, toxicity
from quillspark.llm.common import cut, docs_table, sized, temp_name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold go."""
    model = toxicity.fit(toxicity.labelled(docs, docs_table(spark, sf_dir, "labels")))
    score, = temp_name(docs, "score")
    return toxicity.score(docs, model, keep=docs.columns, name=score).filter(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle sets with a similarity of 0.8 or more stays."""
    return neardup.without_near_duplicates(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in benchmark windows go."""
    out = decontam.match_benchmark(docs, docs_table(spark, sf_dir, "benchmark"), keep=docs.columns, prefix=(at := temp_name(docs, "match")[0]))
    return out.filter(~decontam.contaminated(F.col(f"{at}n_hit"), F.col(f"{at}n_words"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    quality = cut(mixing.label_quality(docs_table(spark, sf_dir, "labels")), "quality")
    return mixing.mixed_documents(docs, sized(quality))


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard."""
    return sharding.shard_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: A trained classifier decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_table(spark, sf_dir)
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}") if stage is not STAGES[-1][1] else stage(spark, docs, sf_dir)
    return docs
