"""Sequential walks over sorted groups, many small groups per Python call.

``applyInPandas`` starts over for every group and holds a whole group. Here Spark hash-partitions
and sorts the rows, and one pass over the Arrow batches of a partition walks all of its groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lograft.session import ship

Columns = dict[str, list]


def runs(frames: Iterable[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[tuple, Columns]]:
    """(key, columns) for each stretch of equal keys; a group that spans batches comes in pieces."""
    for pdf in frames:
        if not len(pdf):
            continue
        change = np.zeros(len(pdf), dtype=bool)
        change[0] = True
        for k in keys:
            values = pdf[k].to_numpy()
            change[1:] |= values[1:] != values[:-1]
        columns = {c: pdf[c].tolist() for c in pdf.columns}
        starts = np.flatnonzero(change).tolist()
        for low, high in zip(starts, [*starts[1:], len(pdf)]):
            yield tuple(columns[k][low] for k in keys), {c: v[low:high] for c, v in columns.items()}


def groups(frames: Iterable[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[tuple, Columns]]:
    """Like ``runs`` with each group in one piece, for groups of a bounded size."""
    current: tuple | None = None
    held: Columns = {}
    for key, columns in runs(frames, keys):
        if key == current:
            for c, v in columns.items():
                held[c].extend(v)
            continue
        if current is not None:
            yield current, held
        current, held = key, columns
    if current is not None:
        yield current, held


def arranged(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Every group in one partition, in order."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def walk(rows: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[tuple]], schema: str, batch: int = 10_000) -> DataFrame:
    """Run ``fn`` over the batches of each partition; it yields result tuples."""
    ship(rows.sparkSession)
    names = [part.split()[0].strip("`") for part in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for row in fn(frames):
            out.append(row)
            if len(out) >= batch:
                yield pd.DataFrame(out, columns=names, dtype=object)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names, dtype=object)

    return rows.mapInPandas(run, schema)
