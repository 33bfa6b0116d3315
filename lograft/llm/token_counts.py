"""Token counts without encoding every word: a broadcast table of frequent pre-tokens, worker caches for the rest.

Texts are parted at single blanks into units, each a whole number of pre-tokens. A first pass over all texts finds the units that make up
at least SHARE of all. Each task counts its own with bounded memory and reports those with that share among its own: what is frequent in all is
frequent in some task, so none is missed, and what is kept of the sum is at most 1 / SHARE units, whatever the input. Their pre-tokens
with their lengths are broadcast. The second pass looks units up in the worker's cache; a unit that is new there is split into pre-tokens,
which are looked up in the table, then in the cache, and only then encoded. Pre-tokens of texts are never shuffled.

Defined results: null text is empty and counts 0; every row is handled by itself; empty tables give an empty table of frequent pre-tokens.
"""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograft import session
from lograft.llm.bpe import byte_letters
from lograft.llm.common import blocks

# --- fixed value: how byte-level vocabularies part a text before merging ---
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SHARE = 2e-5
#: Different units that a task counts at once; its error is below 2 / COUNTED of its units.
COUNTED = 400_000
CACHE = 300_000


@lru_cache(maxsize=2)
def _library(source: str):
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_str(source)


class Lengths:
    """Numbers of tokens of texts: by the broadcast table, by this worker's caches, or by encoding."""

    def __init__(self, source: str, table: dict[str, int]):
        import regex

        self.library = _library(source)
        self.special = [t["content"] for t in json.loads(source)["added_tokens"]]
        self.table, self.split = table, regex.compile(PATTERN).findall
        self.odd = regex.compile(r" \s|\s |^\s|\s$").search
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.parts: dict[str, int] = {}
        self.units: dict[str, int] = {}

    def part(self, part: str) -> int:
        n = self.table.get(part)
        if n is None:
            n = self.parts.get(part)
            if n is None:
                if len(self.parts) > CACHE:
                    self.parts.clear()
                mapped = part.encode().decode("latin-1").translate(self.letters)
                n = self.parts[part] = len(self.library.model.tokenize(mapped))
        return n

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        if any(s in text for s in self.special):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        if self.odd(text):  # white space that may hang together across a blank
            return sum(map(self.part, self.split(text)))
        first, *rest = text.split(" ")
        found = list(map(self.units.get, rest))
        total = sum(map(self.part, self.split(first)))
        if None in found:
            if len(self.units) > CACHE:
                self.units.clear()
            for i, n in enumerate(found):
                if n is None:
                    n = self.units.get(rest[i])
                    if n is None:
                        n = self.units[rest[i]] = sum(map(self.part, self.split(" " + rest[i])))
                    found[i] = n
        return total + sum(found)


def frequent(docs: DataFrame, source: str) -> dict[str, int]:
    """Pre-tokens of the units with a share of SHARE or more, 1 / SHARE units at most, and their numbers of tokens."""
    import numpy as np

    spark = docs.sparkSession
    session.ship(spark)

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        counter, total, lost = Counter(), 0, 0
        for block in blocks(batches):
            for text in block.column("text").to_pylist():
                if text:
                    units = text.split(" ")
                    total += len(units)
                    counter.update(units)
            if len(counter) > COUNTED:
                sizes = np.fromiter(counter.values(), "int64", len(counter))
                least = int(np.partition(sizes, -COUNTED // 2)[-COUNTED // 2])
                lost += least
                counter = Counter({k: v - least for k, v in counter.items() if v > least})
        found = {k: v + lost for k, v in counter.items() if v + lost >= SHARE * total}
        names = [None, *found]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([total, *found.values()], pa.int64())], names=["part", "n"])

    counts = docs.select("text").mapInArrow(run, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))
    total = F.sum(F.when(F.col("part").isNull(), F.col("n")))
    counts = counts.checkpoint(eager=True) if session.shared_dir(spark) else counts
    whole = counts.agg(total.alias("total")).first()["total"] or 0
    rows = counts.where(F.col("part").isNotNull() & (F.col("n") >= SHARE * whole)).orderBy(F.desc("n"), "part").limit(int(1 / SHARE)).collect()
    lengths = Lengths(source, {})
    return {part: lengths.part(part) for r in rows for part in lengths.split(" " + r["part"])}


def count(docs: DataFrame, source: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row. ``source``: the content of a byte-level vocabulary file."""
    spark = docs.sparkSession
    session.ship(spark)
    table = spark.sparkContext.broadcast((source, frequent(docs, source)))
    def run(batches):
        import pyarrow as pa

        lengths = Lengths(*table.value)
        for block in blocks(batches):
            counts = [lengths.text(t) for t in block.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(counts, pa.int64()), block.column("n_bytes")], names=["doc_id", "n_tokens", "n_bytes"])

    given = docs.select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    schema = given.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), "n_bytes").schema
    return given.mapInArrow(run, schema).select("doc_id", "n_bytes", "n_tokens")
