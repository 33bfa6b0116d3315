"""Configuration documents, fingerprints of their sources, and the secrets kept beside them."""

from __future__ import annotations

import contextlib
import itertools
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lograft.functions import text
from lograft.session import ship

UNREADABLE = "<unreadable>"


def document_text(content: Column, limit: int | None = None) -> Column:
    """The bytes as text without escapes. With ``limit`` the first so many; a character cut in half becomes U+FFFD."""
    kept = content if limit is None else F.substring(content, 1, limit)
    return text.strip_ansi(F.make_valid_utf8(kept.cast("string")))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "modificationTime", document_text(F.col("content")).alias("content"))


def source_hash(watched: DataFrame, files: DataFrame) -> DataFrame:
    """Fingerprint per device over its watched files, in list order.

    ``watched``: device, pos, path. ``files``: path, content (binary). Each file is hashed where it
    is read; only digests are grouped, as many per device as its watch list is long.
    """
    digests = files.select("path", F.sha2("content", 256).alias("_digest"))
    found = watched.join(digests, "path", "left")
    entry = F.struct("pos", F.concat_ws("|", "path", F.coalesce("_digest", F.lit(UNREADABLE))).alias("entry"))
    listed = found.groupBy("device").agg(F.array_sort(F.collect_list(entry)).alias("_files"))
    return listed.select("device", F.sha2(F.array_join(F.col("_files.entry"), "\n"), 256).alias("source_hash"))


def _parsed(document: str):
    """The value of a JSON document, or of a YAML one where a reader for that is installed; None if neither reads it."""
    readers = [(json.loads, ValueError)]
    with contextlib.suppress(ImportError):
        import yaml

        readers.append((yaml.safe_load, yaml.YAMLError))
    for read, fault in readers:
        with contextlib.suppress(fault):
            return read(document)
    return None


def scalar_leaves(document: str | None) -> list[str]:
    """All texts and numbers of a nested document (not booleans); none if it cannot be read."""
    level, found = [_parsed(document)] if document is not None else [], set()
    while level:
        found.update(str(v) for v in level if type(v) in (str, int, float))
        inner = [v.values() if isinstance(v, dict) else v for v in level if isinstance(v, (dict, list))]
        level = [*itertools.chain.from_iterable(inner)]
    return sorted(found)


def secret_values(documents: DataFrame, device: str = "device", content: str = "content") -> DataFrame:
    """(device, value) for every scalar of the devices' secret documents."""

    ship(documents.sparkSession)

    @F.pandas_udf("array<string>")
    def leaves(texts: pd.Series) -> pd.Series:
        return texts.map(scalar_leaves)

    return documents.select(device, F.explode(leaves(F.col(content))).alias("value")).distinct()
