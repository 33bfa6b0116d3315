"""State between micro-batches, as one parquet folder per batch.

Batch ``n`` reads what batch ``n - 1`` wrote and overwrites its own folder, so a batch that runs
twice after a failure leaves the same state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lograft.sources.files import names, remove


def each_batch(fold: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Run ``fold`` on batches that are read from their source once, though used several times."""
    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            fold(batch, number)
        finally:
            batch.unpersist()

    return run


def read(spark: SparkSession, folder: str, batch: int, schema: str) -> DataFrame:
    """State before ``batch``."""
    if batch == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/batch={batch - 1}")


def write(state: DataFrame, folder: str, batch: int) -> None:
    state.write.mode("overwrite").parquet(f"{folder}/batch={batch}")
    if batch > 1:
        remove(state.sparkSession, f"{folder}/batch={batch - 2}")


def last_batch(spark: SparkSession, folder: str) -> int:
    """Number of the last batch that wrote ``folder``; -1 before the first."""
    return max((int(n.split("=")[1]) for n in names(spark, folder) if n.startswith("batch=")), default=-1)


def output(rows: DataFrame, folder: str, batch: int, *by: str) -> None:
    """Results of one batch; replaced, not repeated, when the batch runs again."""
    rows.write.mode("overwrite").partitionBy(*by).parquet(f"{folder}/batch={batch}")
