"""Arrow batches of bounded size, for tasks that make much of each row."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes that a task's Python is handed at once, and bytes of which it makes something at once.
ROWS, BYTES, PIECE = 1000, 8 << 20, 1 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's batches for Python to ``ROWS`` and ``BYTES``; lower ones stay."""
    for name, most in (("maxRecordsPerBatch", ROWS), ("maxBytesPerBatch", BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def pieces(batches: Iterable, size: int = PIECE) -> Iterator:
    """The batches' rows in order, in slices of about ``size`` bytes of strings and binaries; a larger row is a slice of its own."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    wide = (pa.types.is_string, pa.types.is_binary, pa.types.is_large_string, pa.types.is_large_binary)
    for b in batches:
        width = np.zeros(b.num_rows, np.int64)
        for c in b.columns:
            if any(is_(c.type) for is_ in wide):
                width += pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False)
        begin = 0
        while begin < b.num_rows:
            end = begin + max(1, int(np.searchsorted(np.cumsum(width[begin : begin + ROWS]), size, "right")))
            yield b.slice(begin, end - begin)
            begin = end


def map_pieces(df: DataFrame, run: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """``mapInArrow`` over pieces."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(lambda batches: run(pieces(batches)), schema)
