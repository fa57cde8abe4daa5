"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch handed to Python.  Documents are a few kB, so a batch stays at some MB.
ARROW_ROWS = 1000
ARROW_BYTES = 8 << 20
_own_dir: dict[str, str] = {}
_swept: set[str] = set()


def docs_table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` has set; a temporary one only on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="quill-")
    return _own_dir[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    top = f"{shared_dir(spark)}/quill-{spark.sparkContext.applicationId}"
    if top not in _swept:  # results are read from these tables as long as the session lives
        _swept.add(top)
        path = spark._jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes a working table to the shared folder and reads it back: later steps start from it, whatever executors are lost."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of ids that are sent to all tasks at most, instead of a shuffle of whole texts.
MOST_SENT = 2_000_000


def sized(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows; a shuffle join otherwise.  Counts it, so it should be a working table."""
    return F.broadcast(df) if df.count() <= most else df


def sweep(spark: SparkSession) -> None:
    """Deletes this application's working tables now; they go by themselves when it ends."""
    top = f"{shared_dir(spark)}/quill-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(top)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tune_arrow(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Keeps Arrow batches of whole texts small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def fold(doc_id: Column | str, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % mod


def temp_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that clash with none of ``df``'s (Spark compares them without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for w in wanted:
        name = f"_{w}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
