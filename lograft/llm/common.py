"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: the white space that separates words ---
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def by_place(docs: DataFrame, step: Callable[[DataFrame], DataFrame], *known: str) -> DataFrame:
    """``step`` on the table with all columns but ``known`` named by their place, so that no name clashes with one that it uses inside.

    The step may add columns; those of the table come back under their names.
    """
    inner = docs.toDF(*[c if c in known else f"c{i}" for i, c in enumerate(docs.columns)])
    return step(inner).select(*inner.columns).toDF(*docs.columns)


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null and for blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def crc_mod(column: Column, divisor: int) -> Column:
    """crc32 of the value as text, modulo; null stays null."""
    return F.crc32(column.cast("string").cast("binary")) % divisor


#: Characters of text that a Python task handles at once.
BLOCK_CHARS = 4_000_000


def blocks(batches, column: str = "text", size: int = BLOCK_CHARS):
    """Arrow batches cut so that a block has one row, or no more than ``size`` bytes of text: memory does not depend on text lengths."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype("int64")
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def tidy(run: Callable) -> Callable:
    """The function for mapInArrow, with memory that it has freed given back at its end: workers stay, and wait beside other stages' tasks."""

    def tidied(batches):
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return tidied
