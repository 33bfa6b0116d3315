"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation estimates how far each can be trusted.

Every rule looks at a few counts of a document and votes good (1), bad (-1) or abstains (0). Good and bad are two hidden classes of
given balance; a rule that votes is right with a probability of its own, its accuracy. The accuracies are estimated by
expectation-maximisation over the table of vote patterns (3^rules rows at most), and the posterior probability of good decides.

Defined results: null text has no words, all counts 0, and fails the base check; an empty table gives an empty result; every row is judged by
itself, so ties, repeated rows and null ids need nothing; other columns stay untouched. Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograft import session
from lograft.llm.common import by_place, words

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_same_next")


@dataclass(frozen=True)
class Rule:
    """good and bad hold for (counts) -> condition; neither: the rule abstains. Bad goes first."""

    name: str
    bad: Callable[[Callable[[str], Column]], Column]
    good: Callable[[Callable[[str], Column]], Column]

    def vote(self, of: Callable[[str], Column]) -> Column:
        return F.when(self.bad(of), -1).when(self.good(of), 1).otherwise(0).cast("tinyint")


def _never(of: Callable[[str], Column]) -> Column:
    return F.lit(False)


def _prose(c: Callable[[str], Column]) -> Column:
    return ((c("n_words") >= 50) & (20 * c("n_symbols") < c("n_words")) & (10 * c("n_upper") < c("word_chars"))
            & (10 * c("n_repeat_words") <= c("n_words")) & (20 * c("n_same_next") < c("n_words")))


RULES = (
    Rule("length", lambda c: c("n_words") < 20, _never),
    Rule("symbols", lambda c: 10 * c("n_symbols") > 3 * c("n_words"), _never),
    Rule("capitals", lambda c: 10 * c("n_upper") > 3 * c("word_chars"), _never),
    Rule("lines", lambda c: 2 * c("n_dup_lines") > c("n_lines"), _never),
    Rule("repeats", lambda c: 10 * c("n_repeat_words") > 3 * c("n_words"), _never),
    Rule("stutter", lambda c: 5 * c("n_same_next") > c("n_words"), _never),
    Rule("word_length", lambda c: (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 14 * c("n_words")), _never),
    Rule("prose", _never, _prose),
)
ROUNDS = 25
#: Balance of the classes, where every accuracy starts, the votes that this start weighs, and the least accuracy of a rule.
SHARE, START, PSEUDO, LEAST = 0.5, 0.9, 10.0, 0.55
THRESHOLD = 0.5
WINDOW = 8


def with_counts(docs: DataFrame, prefix: str = "_q_") -> DataFrame:
    """The table with the counts of every text as extra columns named ``prefix`` + count.

    Repeated windows are found inside the row: word hashes are combined to window hashes by doubling, and only a text with
    an equal pair sorts them. Steps are columns of their own, so that nothing is computed again for each array element.
    """
    c = lambda name: F.col(prefix + name)
    text, empty = c("text"), F.array().cast("array<bigint>")
    out = docs.withColumn(prefix + "text", F.coalesce(F.col("text"), F.lit("")))
    out = out.withColumns({
        prefix + "h": F.transform(words(text), lambda w: F.xxhash64(w)),
        prefix + "lines": F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != ""),
        prefix + "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"),
        prefix + "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        prefix + "n_upper": (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long"),
    }).drop(prefix + "text")
    out = out.withColumns({
        prefix + "n_words": F.size(c("h")).cast("long"), prefix + "n_lines": F.size(c("lines")).cast("long"),
        prefix + "n_dup_lines": (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long"),
        prefix + "n_same_next": F.size(F.filter(
            F.zip_with(c("h"), F.slice(c("h"), F.lit(2), F.size(c("h"))), lambda a, b: a == b), lambda x: x)).cast("long"),
    }).drop(prefix + "lines")
    step = 1
    while step < WINDOW:
        later = F.slice(c("h"), F.lit(step + 1), F.size(c("h")))
        out = out.withColumn(prefix + "h", F.zip_with(c("h"), later, lambda a, b: F.xxhash64(a, b)))
        step *= 2
    out = out.withColumn(prefix + "h", F.slice(c("h"), F.lit(1), F.greatest(c("n_words") - (WINDOW - 1), F.lit(0)).cast("int")))
    placed = F.array_sort(F.transform(c("h"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn(prefix + "h", F.when(F.size(F.array_distinct(c("h"))) < F.size(c("h")), placed))
    same = F.zip_with(c("h"), F.slice(c("h"), F.lit(2), F.size(c("h"))), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
    out = out.withColumn(prefix + "same", same)
    either = F.zip_with(c("same"), F.concat(F.array(F.lit(False)), c("same")), lambda a, b: F.coalesce(a, F.lit(False)) | b)
    starts = F.array_sort(F.filter(
        F.zip_with(c("h"), either, lambda x, twice: F.when(twice, x["i"])), lambda i: i.isNotNull()))
    out = out.withColumn(prefix + "h", F.coalesce(starts, F.array().cast("array<int>"))).drop(prefix + "same")
    covered = F.zip_with(
        c("h"), F.slice(c("h"), F.lit(2), F.size(c("h"))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    return out.withColumn(
        prefix + "n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x)).drop(prefix + "h")


def base_failed(of: Callable[[str], Column]) -> Column:
    return (of("n_words") < 20) | (100 * of("n_repeat_words") > 30 * of("n_words"))


@dataclass(frozen=True)
class Trust:
    """By rule the probability that its vote is right."""

    accuracy: tuple[float, ...]

    def posterior(self, votes: list[Column]) -> Column:
        """Probability that a document with these votes is good."""
        odds = F.lit(math.log(SHARE / (1 - SHARE)))
        for v, a in zip(votes, self.accuracy, strict=True):
            odds = odds + v * F.lit(math.log(a / (1 - a)))
        return 1 / (1 + F.exp(-odds))


#: One round over the pattern rows ``p`` (n, v), from the accuracies ``s``; the inner one-element array names the weighted rows.
_ROUND = """transform(array(transform(p, x -> named_struct('n', x.n, 'v', x.v, 'good', 1 / (1 + exp(-(
    ln({share} / (1 - {share})) + aggregate(zip_with(x.v, s, (v, a) -> v * ln(a / (1 - a))), 0D, (t, y) -> t + y))))))),
    r -> transform(s, (a, j) -> greatest({least}, ({pseudo} * {start}
        + aggregate(r, 0D, (t, x) -> t + CASE WHEN x.v[j] > 0 THEN x.n * x.good WHEN x.v[j] < 0 THEN x.n * (1 - x.good) ELSE 0D END))
        / ({pseudo} + aggregate(r, 0D, (t, x) -> t + IF(x.v[j] != 0, x.n, 0D))))))[0]"""


def estimate(counted: DataFrame, of: Callable[[str], Column], rules: tuple[Rule, ...] = RULES) -> Trust:
    """Expectation-maximisation over the vote patterns of all rows, 3^rules at most, as one expression over one row."""
    patterns = counted.select(F.array(*[r.vote(of).cast("int") for r in rules]).alias("v")).groupBy("v").agg(
        F.count("*").cast("double").alias("n"))
    one = patterns.agg(F.array_sort(F.collect_list(F.struct("n", "v"))).alias("p"))
    step = _ROUND.format(share=f"{SHARE}D", start=f"{START}D", pseudo=f"{PSEUDO}D", least=f"{LEAST}D")
    last = F.expr(f"aggregate(sequence(1, {ROUNDS}), array_repeat({START}D, {len(rules)}), (s, i) -> {step})")
    return Trust(tuple(one.select(last.alias("s")).first()["s"]))


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, kept) of every row. The counts are kept in the shared folder, so texts are read once."""
    session.shared_dir(docs.sparkSession)
    of = lambda name: F.col("_q_" + name)
    counted = with_counts(docs.select("doc_id", "text")).drop("text").checkpoint()
    trust = estimate(counted, of)
    kept = ~base_failed(of) & (trust.posterior([r.vote(of) for r in RULES]) >= THRESHOLD)
    return counted.select(
        "doc_id", *[of(n).alias(n) for n in COUNTS[:5]], base_failed(of).alias("base_failed"), kept.alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows whose document passes the base check and is good with a posterior of THRESHOLD or more."""
    return by_place(docs, _keep_good, "text")


def _keep_good(docs: DataFrame) -> DataFrame:
    of = lambda name: F.col("_q_" + name)
    counted = with_counts(docs)
    trust = estimate(with_counts(docs.select("text")).drop("text"), of)
    kept = ~base_failed(of) & (trust.posterior([r.vote(of) for r in RULES]) >= THRESHOLD)
    # a generated column keeps the filter above the steps that count; below them it would repeat all of them
    return counted.select(*docs.columns, F.explode(F.array(kept)).alias("_q_kept")).where(F.col("_q_kept")).drop("_q_kept")
