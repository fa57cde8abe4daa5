"""Models of one's own after the redaction chain: one that finds entities in a text, one that rewrites a text chunk by chunk.

They run in Arrow batches, between the chain and the return of transcripts' headers.  Where a model fails, the
text stays as the chain left it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .redact import ENTITY_LABELS, HEADER, chain, pack_lines, stash_headers


@dataclass(frozen=True)
class EntityEngine:
    """Replaces people, organisations and places.  load: called once in a task; gives a function from a text to (start, end, label)."""

    load: Callable[[], Callable[[str], list[tuple[int, int, str]]]]
    #: Characters that the model reads at once.
    chunk: int = 100_000

    def rewrite(self, model, text: str, lines: list[str]) -> str:
        out = []
        for at in range(0, len(text), self.chunk):
            part, done, upto = text[at : at + self.chunk], "", 0
            for start, end, label in sorted(model(part)):
                if label in ENTITY_LABELS and start >= upto:
                    done, upto = done + part[upto:start] + ENTITY_LABELS[label], end
            out.append(done + part[upto:])
        return "".join(out)


@dataclass(frozen=True)
class TextEngine:
    """Rewrites a text in chunks of whole lines.  load: called once in a task; gives a function from a chunk to its new form.

    Blank chunks aren't asked for, and an empty answer keeps the chunk.
    """

    load: Callable[[], Callable[[str], str]]
    chunk: int = 4000

    def rewrite(self, model, text: str, lines: list[str]) -> str:
        return "\n".join(c if not c.strip() else (model(c) or "").strip() or c for c in lines)


def redact_with(rows: DataFrame, engine: EntityEngine | TextEngine, column: str = "markdown", terms: str | list[str] | None = None, error: str | None = None) -> DataFrame:
    """rows with ``column`` redacted by the chain and then by the engine; turn headers stay as they are.

    error: the name of a further column that says why the engine left a text to the chain alone.  A model that can't
    be loaded is tried once in a task.
    """
    text = F.col(column)
    stashed = chain(stash_headers(text), terms)
    ready = rows.withColumn("heads_", F.regexp_extract_all(text, F.lit(HEADER), F.lit(1))).withColumn(column, stashed)
    ready = ready.withColumn("lines_", pack_lines(F.col(column), engine.chunk) if isinstance(engine, TextEngine) else F.lit(None).cast("array<string>"))
    at, names = rows.columns.index(column), rows.columns

    def run(batches):
        import pyarrow as pa

        model = broken = None
        for b in batches:
            out, said = [], []
            for t, heads, lines in zip(*(b.column(c).to_pylist() for c in (column, "heads_", "lines_"))):
                why = None
                if t is not None:
                    if model is None and broken is None:
                        try:
                            model = engine.load()
                        except Exception as e:  # noqa: BLE001  a model that fails must not end the batch
                            broken = f"{type(e).__name__}: {e}"
                    why = broken
                    if broken is None:
                        try:
                            t = engine.rewrite(model, t, lines)
                        except Exception as e:  # noqa: BLE001
                            why = f"{type(e).__name__}: {e}"
                    for i, h in enumerate(heads or ()):
                        t = t.replace(f"[[KEPT_TURN_{i}]]", h)
                out.append(t)
                said.append(why)
            cols = [pa.array(out, pa.string()) if i == at else b.column(c) for i, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(said, pa.string())][: len(kinds.fields)], kinds.names)

    kinds = StructType([*rows.schema.fields, *([StructField(error, StringType())] if error else [])])
    return ready.mapInArrow(run, kinds)
