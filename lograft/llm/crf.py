"""Document quality from line labels: a linear-chain conditional random field over the lines, marginals weighted by length.

A line is described by shares of letter classes, its length, its variety of words and whether it repeats an earlier line of its document; its features are
its own and those of both neighbours. The field is binary, so messages are single log odds. Lines of a labelled document carry its
label in training; a document's score is the mean probability of a good line, weighted by line length.

Training takes about PER_LABEL documents of each label, chosen by a hash of doc_id, whole, as long as LINES lines of a label are not used up; documents of
over DOC_LINES lines are not among them (documented bounds of the sample). Of rows with one doc_id one text is taken. Every text is scored whole. Defined results: null text is empty text, one line without characters, and gets that line's probability; without
labelled rows of both labels every score is 0.5; rows are handled by themselves, so ties, repeated rows and null ids need nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograft import session
from lograft.llm.common import blocks

PER_LABEL = 2000
LINES, DOC_LINES = 40_000, 2_000
STEPS, RATE, DECAY = 300, 0.1, 2e-5
OWN = 10

# --- fixed values: letter classes ---
SYMBOLS, MARKS = "#*$%&|<>", "!?"
UPPER, LOWER, DIGIT, BLANK, SYMBOL, MARK, REST = range(7)


def _classes() -> np.ndarray:
    """Class of each code point below 0x600; later ones count as lower-case letters."""
    out = np.full(0x600, REST, "int8")
    for c in range(0x600):
        x = chr(c)
        out[c] = (SYMBOL if x in SYMBOLS else MARK if x in MARKS else UPPER if x.isupper() else LOWER if x.isalpha()
                  else DIGIT if x.isdigit() else BLANK if x.isspace() else REST)
    return out


_CLASS = _classes()


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of all lines, their lengths, and the number of lines of each text."""
    lines = [t.split("\n") for t in texts]
    counts = np.fromiter(map(len, lines), "int64", len(lines))
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kind = np.where(codes < 0x600, _CLASS[np.minimum(codes, 0x5FF)], LOWER)
    ends = np.flatnonzero(codes == 10)
    starts = np.append(0, ends[:-1] + 1)
    lengths = ends - starts
    safe = np.maximum(lengths, 1)
    share = lambda c: (np.add.reduceat((kind == c).astype("int32"), starts) - (c == BLANK)) / safe
    variety, n_words, again = np.ones(len(ends)), np.zeros(len(ends)), np.zeros(len(ends))
    i = 0
    for own in lines:
        seen = set()
        for line in own:
            words = line.split()
            n_words[i] = len(words)
            if words:
                variety[i] = len(set(words)) / len(words)
                again[i] = line in seen
                seen.add(line)
            i += 1
    out = np.stack([share(UPPER), share(DIGIT), share(SYMBOL), share(MARK), share(REST), share(BLANK), np.log1p(lengths) / 5,
                    lengths / np.maximum(n_words, 1) / 10, variety, again], axis=1)
    return out, lengths, counts


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bias, own features, and those of the line before and after; zeros beyond a text's ends."""
    ends = np.cumsum(counts)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[ends - counts] = 0
    after[ends - 1] = 0
    return np.concatenate([np.ones((len(own), 1)), own, before, after], axis=1)


@dataclass
class Field:
    """Weights of the features for good, and of the pairs (good good, good bad, bad good, bad bad)."""

    weights: np.ndarray
    pairs: np.ndarray

    def pass_on(self, odds: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        gg, gb, bg, bb = pairs
        return np.logaddexp(odds + gg, bg) - np.logaddexp(odds + gb, bb)

    def messages(self, emit: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of good by the lines up to each line, itself included, and by the lines after it."""
        starts = np.cumsum(counts) - counts
        order = np.argsort(-counts, kind="stable")
        longer = np.searchsorted(-counts[order], -np.arange(counts.max()), side="left")
        ahead, back = emit.astype("float64").copy(), np.zeros(len(emit))
        turned = self.pairs[[0, 2, 1, 3]]
        for t in range(1, counts.max()):
            at = starts[order[:longer[t]]] + t
            ahead[at] += self.pass_on(ahead[at - 1], self.pairs)
        for t in range(counts.max() - 1, 0, -1):
            at = starts[order[:longer[t]]] + t
            back[at - 1] = self.pass_on(back[at] + emit[at], turned)
        return ahead, back

    def scores(self, texts: list[str]) -> np.ndarray:
        own, lengths, counts = line_features(texts)
        emit = with_neighbours(own, counts) @ self.weights
        ahead, back = self.messages(emit, counts)
        good = 1 / (1 + np.exp(-np.clip(ahead + back, -500, 500)))
        starts = np.cumsum(counts) - counts
        weight = lengths.astype("float64")
        total = np.add.reduceat(weight, starts)
        weight = np.where(np.repeat(total, counts) > 0, weight, 1.0)
        return np.add.reduceat(weight * good, starts) / np.add.reduceat(weight, starts)


def fit(own: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> Field:
    """Maximum likelihood with weight decay; the gradient is observed less expected counts. Good documents weigh 0.7 in sum, bad ones 0.3."""
    x = with_neighbours(own, counts)
    y = np.repeat(labels, counts).astype("float64")
    starts = np.cumsum(counts) - counts
    first = np.zeros(len(y), bool)
    first[starts] = True
    balance = np.where(labels == 1, 0.7 / max((labels == 1).sum(), 1), 0.3 / max((labels == 0).sum(), 1))
    weight = np.repeat(balance / counts, counts)
    field = Field(np.zeros(x.shape[1]), np.array([0.5, 0.0, 0.0, 0.5]))
    size, inner = len(field.weights), np.flatnonzero(~first)
    mean, square = np.zeros(size + 4), np.zeros(size + 4)
    for step in range(1, STEPS + 1):
        emit = x @ field.weights
        ahead, back = field.messages(emit, counts)
        good = 1 / (1 + np.exp(-np.clip(ahead + back, -500, 500)))
        later = back[inner] + emit[inner]
        logs = np.stack([ahead[inner - 1] + later, ahead[inner - 1], later, np.zeros(len(inner))]) + field.pairs[:, None]
        joint = np.exp(logs - np.logaddexp.reduce(logs, axis=0))
        a, b = y[inner - 1], y[inner]
        seen = np.stack([a * b, a * (1 - b), (1 - a) * b, (1 - a) * (1 - b)])
        gradient = np.concatenate([(weight * (y - good)) @ x, (seen - joint) @ weight[inner]])
        gradient -= DECAY * np.concatenate([field.weights, field.pairs])
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        move = RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        field = Field(field.weights + move[:size], field.pairs + move[size:])
    return field


def train(docs: DataFrame, labels: DataFrame, usable: Column) -> Field | None:
    """A field for the labelled rows that ``usable`` (over doc_id) admits; None if a label is missing."""
    spark = docs.sparkSession
    session.ship(spark)
    rows = labels.where(usable & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    have = {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    if set(have) != {0, 1}:
        return None
    chance = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.when(F.col("quality") == 1, min(1.0, PER_LABEL / have[1])).otherwise(min(1.0, PER_LABEL / have[0]))
    # about 2 * PER_LABEL rows of two numbers, whatever the input
    sample = F.broadcast(rows.where(chance < share))

    text = F.coalesce("text", F.lit(""))
    lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("_lines")
    given = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_text_hash"), lines).join(sample, "doc_id")
    # one text of each sampled doc_id; as many rows as the sample has
    sizes = given.groupBy("doc_id", "quality").agg(F.min(F.struct("_text_hash", "_lines")).alias("_one")).select("doc_id", "quality", "_one.*").collect()
    taken, used = [], {0: 0, 1: 0}
    for r in sorted(sizes, key=lambda r: (r["_text_hash"], r["doc_id"])):
        if r["_lines"] <= min(DOC_LINES, LINES - used[r["quality"]]):
            used[r["quality"]] += r["_lines"]
            taken.append((r["doc_id"], r["_text_hash"]))
    chosen = F.broadcast(spark.createDataFrame(taken, "doc_id long, _text_hash long"))
    whole = given.join(chosen, ["doc_id", "_text_hash"]).groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def run(batches):
        import pyarrow as pa

        for block in blocks(batches):
            own, _, counts = line_features(block.column("text").to_pylist())
            packed = [x.astype("<f4").tobytes() for x in np.split(own, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("quality"), pa.array(packed, pa.binary())], names=["doc_id", "quality", "lines"])

    found = whole.mapInArrow(run, "doc_id long, quality int, lines binary").toPandas().sort_values("doc_id", kind="stable")
    if set(found["quality"]) != {0, 1}:
        return None
    own = [np.frombuffer(x, "<f4").reshape(-1, OWN).astype("float64") for x in found["lines"]]
    return fit(np.concatenate(own), np.array([len(x) for x in own]), found["quality"].to_numpy())


def score(docs: DataFrame, field: Field | None) -> DataFrame:
    """(doc_id, score) of every row."""
    spark = docs.sparkSession
    session.ship(spark)
    if field is None:
        return docs.select("doc_id", F.lit(0.5).alias("score"))
    shared = spark.sparkContext.broadcast(field)
    given = docs.select("doc_id", "text")

    def run(batches):
        import pyarrow as pa

        for block in blocks(batches, size=2_000_000):
            scores = shared.value.scores([t or "" for t in block.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(np.clip(scores, 0.0, 1.0))], names=["doc_id", "score"])

    return given.mapInArrow(run, given.select("doc_id", F.lit(0.0).alias("score")).schema)
