"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.sources.scratch import CLEANUP as CLEANUP
from tessera.sources.scratch import discard as discard
from tessera.sources.scratch import materialize as materialize
from tessera.sources.scratch import settings as settings

#: White space of the word definitions: space and \x09 to \x0D.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def release() -> None:
    """Gives memory that a Python worker no longer uses back to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that gives back its memory when it has ended."""

    def lean_run(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return lean_run


def lean_group(run: Callable) -> Callable:
    """The same for a function of a group."""

    def lean_run(pdf):
        out = run(pdf)
        release()
        return out

    return lean_run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. lower() does, but for the two characters whose lower case has ASCII letters, and for letters beyond ASCII."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(text.rlike(r"\A\p{ASCII}*+\z"), F.lower(text)).otherwise(F.translate(text, upper, low))


def n_words(text: Column) -> Column:
    """Number of words by WORD, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def packed(df: DataFrame, keep: list[str]) -> Column:
    """The columns keep in one struct _row, so that their names can't clash with working columns."""
    return F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias("_")).alias("_row")


def unpacked(keep: list[str]) -> list[Column]:
    return [F.col(f"_row.`{c}`").alias(c) for c in keep]


def from_text(df: DataFrame, text: str, keep: list[str], compute: Callable[[str], tuple], fields: T.StructType) -> DataFrame:
    """The columns keep of df, and what compute makes of each row's text (null: empty) as fields.

    A field that has the name of a kept column takes its place. Kept columns stay in Arrow as they are.
    """
    kept = [c for c in keep if c not in fields.names]
    schema = T.StructType([df.schema[c] for c in kept] + list(fields))
    kinds = to_arrow_schema(fields).types
    df = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                made = [compute(t or "") for t in part.column(len(kept)).to_pylist()]
                columns = [pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *columns], [*kept, *fields.names])

    return df.mapInArrow(lean(run), schema)
