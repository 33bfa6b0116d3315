"""Joins in which one key may hold a large part of the left rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 32


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join with a right side that has at most one row per key.

    Left rows of a key are dealt to ``salts`` parts and the one right row is repeated for each, so a
    hot key is never one task, also where adaptive execution is off, as inside ``foreachBatch``. A
    right side small enough to broadcast is still broadcast.
    """
    part = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int").alias("_salt")
    dealt = left.select("*", part)
    repeated = right.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    return dealt.join(repeated, [*keys, "_salt"], how).drop("_salt")
