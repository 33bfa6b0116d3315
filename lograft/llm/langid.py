"""Language of mixed text: scripts narrow the candidates, then a Viterbi path over word scores with a price for each switch.

A word scores for each language by hashed letter triples and by itself, as log probabilities learned from labelled texts. A language is a
candidate for a word if the word's script makes up at least SCRIPT_SHARE of that language's training words; a word whose script no language has
leaves all open. The path through all words of a text labels its spans; the language with most letters is that of the text.

Long texts do not make long loops: words are cut into pieces of PIECE, what a piece does to the state before it is a small max-plus
matrix, matrices are chained per text, and the path inside all pieces is found at once.

Training takes at most about PER_LANGUAGE labelled texts of each language, chosen by a hash of doc_id (a documented bound);
every text is predicted whole. Defined results: ``und`` and score 0 where text is null or has no letter, or nothing is labelled; ties go
to the language first in order; every row is handled by itself, so repeated rows and null ids need nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograft import session
from lograft.llm.common import blocks

PER_LANGUAGE = 1500
BUCKETS = 1 << 16
SCRIPT_SHARE = 0.01
SWITCH = 12.0
PIECE = 64
CACHE = 200_000
WORD = re.compile(r"[^\W\d_]+")
# --- fixed values: first code points of script ranges, and the script that begins there ---
SCRIPT_STARTS = (0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x900, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3400, 0xAC00, 0xD7B0, 0xF900, 0xFB00)
SCRIPTS = ("latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "indic", "thai", "lao", "georgian", "hangul", "other", "latin", "greek", "other", "kana", "han", "han", "hangul", "other", "han", "other")
NAMES = tuple(dict.fromkeys(SCRIPTS))
_SCRIPT_OF = np.array([NAMES.index(s) for s in SCRIPTS])


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the letter triples of all words in a row, where each word's begin, the bucket of each word, its script."""
    import zlib

    text = "\n" + "\n".join(words) + "\n"
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype("int64")
    middle = np.flatnonzero(codes[1:-1] != 10) + 1
    triple = (codes[middle - 1] * 7919 + codes[middle] * 104729 + codes[middle + 1] * 1299709) % BUCKETS
    firsts = np.flatnonzero(codes[:-1] == 10)
    starts = np.searchsorted(middle, firsts + 1)
    whole = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in words), "int64", len(words))
    return triple, starts, whole, _SCRIPT_OF[np.searchsorted(SCRIPT_STARTS, codes[firsts + 1], side="right") - 1]


@dataclass
class Model:
    """Languages, log probabilities by bucket of triples and of words, and which languages may have a script."""

    languages: list[str]
    triples: np.ndarray
    wholes: np.ndarray
    allowed: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        triple, starts, whole, script = grams(words)
        out = np.add.reduceat(self.triples[triple], starts, axis=0) + self.wholes[whole]
        out -= out.max(axis=1, keepdims=True)
        return np.where(self.allowed[script], np.maximum(out, -40.0), -60.0)


def train(docs: DataFrame, labelled: Column) -> Model:
    """Counts of triples and words of a bounded sample of the labelled rows, summed in Spark: 2 * BUCKETS rows a language at most."""
    spark = docs.sparkSession
    session.ship(spark)
    rows = docs.where(labelled & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    have = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    share = F.create_map(*[x for k, n in have.items() for x in (F.lit(k), F.lit(min(1.0, PER_LANGUAGE / n)))]) if have else None
    if share is None:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((BUCKETS, 0)), np.zeros((len(NAMES), 0), bool))
    chance = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(chance < F.try_element_at(share, "lang"))

    def run(batches):
        import pyarrow as pa

        found: dict[str, np.ndarray] = {}
        for block in blocks(batches):
            for lang, text in zip(block.column("lang").to_pylist(), block.column("text").to_pylist(), strict=True):
                words = WORD.findall(text.lower())
                if words:
                    triple, _, whole, script = grams(words)
                    own = found.setdefault(lang, np.zeros(2 * BUCKETS + len(NAMES), "int64"))
                    own += np.bincount(np.concatenate([triple, whole + BUCKETS, script + 2 * BUCKETS]), minlength=len(own))
        for lang, counts in found.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(counts[at])], names=["lang", "at", "n"])

    counts = sample.select("lang", "text").mapInArrow(run, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(counts["lang"]))
    size = 2 * BUCKETS + len(NAMES)
    dense = np.zeros((size, len(languages)))
    dense[counts["at"].to_numpy("int64"), [languages.index(x) for x in counts["lang"]]] = counts["n"].to_numpy("float64")
    logs = lambda part: np.log((part + 0.5) / (part.sum(axis=0) + 0.5 * BUCKETS))
    scripts = dense[2 * BUCKETS:]
    allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
    allowed[~allowed.any(axis=1)] = True
    return Model(languages, logs(dense[:BUCKETS]), logs(dense[BUCKETS:2 * BUCKETS]), allowed)


def best_paths(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Label of every word; ``lengths``: words of each text in a row. Of equal paths, the one that stays."""
    n, k = scores.shape
    if not n:
        return np.zeros(0, "int64")
    pieces = -(-lengths // PIECE)
    owner = np.repeat(np.arange(len(lengths)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    row = np.repeat(np.cumsum(pieces) - pieces, lengths) + (np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)) // PIECE
    column = (np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)) % PIECE
    # pieces stand last in all arrays, so that each step runs along them
    m = len(owner)
    padded = np.zeros((PIECE, k, m), "float32")
    padded[column, :, row] = scores
    effect = np.where(np.eye(k, dtype=bool), 0.0, -1e9).astype("float32")[:, :, None].repeat(m, axis=2)
    for t in range(PIECE):
        effect = padded[t][None] + np.maximum(effect, effect.max(axis=1, keepdims=True) - np.float32(switch))
    # chain the pieces of each text; entered: best label before a piece for every label after it
    state, entered = np.zeros((k, len(lengths))), np.zeros((k, m), "int8")
    order = np.argsort(nth, kind="stable")
    cuts = np.searchsorted(nth[order], np.arange(nth.max() + 2))
    for j in range(nth.max() + 1):
        at = order[cuts[j]:cuts[j + 1]]
        through = state[:, None, owner[at]] + effect[:, :, at]
        entered[:, at] = through.argmax(axis=0)
        state[:, owner[at]] = through.max(axis=0)
    ends, before = np.zeros(m, "int64"), np.zeros(m, "int64")
    current = state.argmax(axis=0)
    for j in range(nth.max(), -1, -1):
        at = order[cuts[j]:cuts[j + 1]]
        ends[at] = current[owner[at]]
        before[at] = entered[ends[at], at]
        current[owner[at]] = before[at]
    names = np.arange(k, dtype="int8")[:, None]
    value = np.where(names == before[None], 0.0, -1e9).astype("float32")
    came = np.zeros((PIECE, k, m), "int8")
    for t in range(PIECE):
        moved = value.max(axis=0) - np.float32(switch)
        came[t] = np.where(value >= moved, names, value.argmax(axis=0).astype("int8"))
        value = padded[t] + np.maximum(value, moved)
    labels = np.zeros((PIECE, m), "int8")
    label, every = ends, np.arange(m)
    for t in range(PIECE - 1, -1, -1):
        labels[t] = label
        label = came[t, label, every]
    return labels[column, row].astype("int64")


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, spans) of every row; spans: (lang, words) of the runs of one language, in order."""
    import pyarrow as pa

    spark = docs.sparkSession
    session.ship(spark)
    shared = spark.sparkContext.broadcast(model)
    given = docs.select("doc_id", "text")
    schema = given.select("doc_id", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.expr("array(named_struct('lang', '', 'words', 0))").alias("spans")).schema
    kind = pa.struct([("lang", pa.string()), ("words", pa.int32())])

    def run(batches):
        model = shared.value
        k = len(model.languages)
        known: dict[str, int] = {}
        table = np.zeros((CACHE, max(k, 1)))
        for block in blocks(batches, size=2_000_000):
            texts = [WORD.findall(t.lower()) if t and k else [] for t in block.column("text").to_pylist()]
            texts = [w if any(c.isalpha() for x in w for c in x) else [] for w in texts]
            lengths = np.array([len(w) for w in texts], "int64")
            flat = [w for words in texts for w in words]
            new = list({w for w in flat if w not in known})
            if len(known) + len(new) > len(table):
                known.clear()
                new = list(set(flat))
                table = table if len(new) <= len(table) else np.zeros((len(new), k))
            if new:
                table[len(known):len(known) + len(new)] = model.scores(new)
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            at = np.fromiter(map(known.__getitem__, flat), "int64", len(flat))
            labels = best_paths(table[at], lengths) if len(flat) else np.zeros(0, "int64")
            owner = np.repeat(np.arange(len(texts)), lengths)
            letters = np.fromiter(map(len, flat), "int64", len(flat))
            weight = np.bincount(owner * max(k, 1) + labels, weights=letters, minlength=len(texts) * max(k, 1)).reshape(len(texts), -1)
            top, total = weight.argmax(axis=1), weight.sum(axis=1)
            names = [model.languages[i] if n else "und" for i, n in zip(top, total, strict=True)]
            share = np.where(total > 0, weight.max(axis=1) / np.maximum(total, 1), 0.0)
            new_run = np.ones(len(flat), bool)
            new_run[1:] = (labels[1:] != labels[:-1]) | (owner[1:] != owner[:-1])
            runs = np.flatnonzero(new_run)
            sizes = np.diff(np.append(runs, len(flat)))
            spans = pa.StructArray.from_arrays(
                [pa.array([model.languages[i] for i in labels[runs]], pa.string()), pa.array(sizes, pa.int32())], fields=list(kind))
            offsets = np.append(0, np.cumsum(np.bincount(owner[runs], minlength=len(texts))))
            yield pa.RecordBatch.from_arrays([
                block.column("doc_id"), pa.array(names, pa.string()), pa.array(share),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)], names=["doc_id", "lang_pred", "score", "spans"])

    return given.mapInArrow(run, schema)
