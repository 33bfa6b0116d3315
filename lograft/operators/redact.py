"""Redaction of streamed lines, where a secret may span several rows of a session."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograft.functions import redaction
from lograft.plans import folds, lists
from lograft.plans.salted import salted_join

# rows of one chunk; only four integers a row travel to Python
FOLD_BITS = 20


def line_codes(lines: DataFrame, keys: Sequence[str], order: str, line: str, extra_keys: Sequence[str]) -> DataFrame:
    text = F.col(line)
    return lines.select(
        *keys, order, redaction.pem_code(text).alias("pem"), redaction.indent_of(text).alias("indent"),
        redaction.opens_block(text, extra_keys).alias("opens"),
    )


def block_states(
    codes: DataFrame, keys: Sequence[str], order: str, initial: DataFrame | None = None, bits: int = FOLD_BITS
) -> tuple[DataFrame, DataFrame]:
    """Swallowed rows (``order`` values) and the closing state of every key.

    A key is walked in chunks of at most ``2**bits`` rows. What a chunk does to the state entering
    it needs three numbers per PEM state: with ``m`` the smallest indent seen, an open block above
    column ``m`` survives, anything else ends as if the chunk had started clean. Those are chained
    per key, then every chunk is walked from its true starting state.
    """
    keys = list(keys)
    group = [*keys, "_chunk"]
    key_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.select(*keys).schema)
    rows = folds.arranged(codes.withColumn("_chunk", F.shiftright(F.col(order), bits)), group, [order])
    fields = ("pem", "indent", "opens")

    def summarise(frames):
        current, state = None, None
        for key, columns in folds.runs(frames, group):
            if key != current:
                if current is not None:
                    yield (*current, *state[0], *state[1])
                current, state = key, [(bool(i), redaction.NO_BLOCK, redaction.NO_BLOCK) for i in (0, 1)]
            for i, (in_pem, block, least) in enumerate(state):
                in_pem, block, lower = redaction.walk(*(columns[f] for f in fields), in_pem, block)
                state[i] = in_pem, block, min(least, lower)
        if current is not None:
            yield (*current, *state[0], *state[1])

    summary_fields = ", ".join(f"pem_{i} boolean, block_{i} int, least_{i} int" for i in (0, 1))
    summaries = folds.walk(rows, summarise, f"{key_fields}, _chunk long, {summary_fields}")
    # the state a key starts with goes before its first chunk
    known = [F.col("pem").alias("pem_0"), F.col("block").alias("block_0")]
    if initial is not None:
        begin = initial.select(*keys, F.lit(-1).cast("long").alias("_chunk"), *known)
        summaries = summaries.unionByName(begin, allowMissingColumns=True)

    def chain(frames):
        current, state = None, None
        for key, columns in folds.runs(frames, keys):
            if key != current:
                if current is not None:
                    yield (*current, -1, *state)
                current, state = key, (False, redaction.NO_BLOCK)
            for at, chunk in enumerate(columns["_chunk"]):
                if chunk < 0:
                    state = bool(columns["pem_0"][at]), int(columns["block_0"][at])
                    continue
                yield (*key, chunk, *state)
                i, (_, block) = int(state[0]), state
                kept = block < columns[f"least_{i}"][at]
                state = bool(columns[f"pem_{i}"][at]), block if kept else int(columns[f"block_{i}"][at])
        if current is not None:
            yield (*current, -1, *state)

    starts = folds.walk(
        folds.arranged(summaries, keys, ["_chunk"]), chain, f"{key_fields}, _chunk long, in_pem boolean, in_block int")

    def mark(frames):
        current, state = None, None
        for key, columns in folds.runs(frames, group):
            if key != current:
                current, state = key, (columns["in_pem"][0], columns["in_block"][0])
            gone: list[bool] = []
            *state, _ = redaction.walk(*(columns[f] for f in fields), *state, gone)
            yield from ((row,) for row, hidden in zip(columns[order], gone) if hidden)

    begun = folds.arranged(rows.join(starts, group), group, [order])
    swallowed = folds.walk(begun, mark, f"`{order}` long")
    closing = starts.filter(F.col("_chunk") == -1).select(*keys, F.col("in_pem").alias("pem"), F.col("in_block").alias("block"))
    return swallowed, closing


def redact_lines(
    lines: DataFrame, keys: Sequence[str] = ("device", "session_id"), order: str = "id", line: str = "raw",
    extra_keys: Sequence[str] = (), patterns: Sequence[str] = (), secrets: Iterable[str] = (),
    initial: DataFrame | None = None, bits: int = FOLD_BITS, device_secrets: DataFrame | None = None, device: str = "device",
) -> tuple[DataFrame, DataFrame]:
    """Redact ``line`` in ``order`` within ``keys``; also returns the block state each key ends in.

    ``secrets`` hold for all lines; ``device_secrets`` (device, value) only for lines of their device, also where sessions of two devices
    have the same name.

    Sessions in which no PEM section or block ever opens (nearly all) need no state: they are
    found with a cheap aggregate and every line of them is redacted on its own.
    """
    keys = list(keys)
    codes = line_codes(lines, keys, order, line, extra_keys)
    opening = (F.col("pem").bitwiseAND(redaction.STAYS_OPEN) != 0) | (F.col("opens") != redaction.NO_BLOCK)
    stateful = codes.filter(opening).select(*keys).distinct()
    if initial is not None:
        stateful = stateful.unionByName(initial.select(*keys)).distinct()
    risky = line_codes(salted_join(lines, stateful, keys, "left_semi"), keys, order, line, extra_keys)
    swallowed, closing = block_states(risky, keys, order, initial, bits)
    marked = lines.join(swallowed.withColumn("_gone", F.lit(True)), order, "left")
    shown = F.when(F.col("_gone"), F.lit("")).otherwise(redaction.redact_line(F.col(line), extra_keys, patterns, secrets))
    if device_secrets is None:
        return marked.select(*[shown.alias(c) if c == line else F.col(c) for c in lines.columns]), closing
    return _with_device_secrets(marked, lines.columns, shown, order, line, extra_keys, patterns, secrets, device_secrets, device), closing


def _with_device_secrets(
    marked: DataFrame, columns: Sequence[str], shown: Column, order: str, line: str, extra_keys: Sequence[str], patterns: Sequence[str],
    secrets: Iterable[str], device_secrets: DataFrame, device: str,
) -> DataFrame:
    """Lists of both kinds count as one, longest first, so shared secrets go to every device that has lines.

    A line travels as the one text that is left of it, not also as it was.
    """
    plain = F.col("_gone").isNull() & redaction.is_plain(F.col(line), extra_keys)
    inline = F.when(plain, redaction.redact_patterns(redaction.redact_urls(F.col(line)), patterns))
    rows = marked.select(*[c for c in columns if c != line], inline.alias("_inline"), F.when(~F.coalesce(plain, F.lit(False)), shown).alias("_shown"))
    shared = tuple(secrets)
    scrubbed = lists.with_values(
        rows, "_inline", device_secrets, device, order, lambda values: redaction.Scrubber((*shared, *values)))
    return scrubbed.select(*[F.coalesce("_inline", "_shown").alias(c) if c == line else F.col(c) for c in columns])
