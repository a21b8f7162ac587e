"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.plans.staging import discard, stage, work_folder

__all__ = ["UPPER", "again", "arrow_batches", "crc_mod", "discard", "free_names", "id_text", "packed", "slices", "stage", "staged_in_batches", "table", "work_folder"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def again(staged: DataFrame) -> DataFrame:
    """A staged table read anew, with attributes of its own."""
    return staged.sparkSession.read.schema(staged.schema).parquet(staged.staged_path)


def give_back() -> None:
    """Return memory that this process holds but doesn't use to the system: Python workers serve one task after the other."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a Python worker unpacks ``rows`` rows and about ``size`` bytes at once at most; empty ones go.

    What the worker's task before has left is given back first, and at the end what this one has.
    """
    give_back()
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
        del batch
    give_back()


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Inside, an action sends ``rows`` rows in a batch to Python at most; the session's own setting comes back after it.

    A matter of memory only: no result depends on the batches.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def staged_in_batches(df: DataFrame, name: str, rows: int) -> DataFrame:
    """``stage`` of a frame made in Python, with ``rows`` rows in a batch at most."""
    with arrow_batches(df.sparkSession, rows):
        return stage(df, name)


def id_text(col: Column) -> Column:
    """An id as text; a null id is the empty text."""
    return F.coalesce(col.cast("string"), F.lit(""))


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of an id's text modulo n, by which folds are dealt."""
    return F.crc32(id_text(col).cast("binary")) % n


def packed(df: DataFrame, name: str = "row") -> DataFrame:
    """All columns in one struct, so that helper columns can't clash with theirs."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``df`` has it, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
