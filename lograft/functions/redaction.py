"""Removal of credentials: stateless line expressions, block state, and whole documents."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lograft import fixed
from lograft.plans import lists
from lograft.session import ship

# --- fixed patterns; %s is the whitespace class, spelled out because the dialects differ on it ---
_KEY_LINE = r"""^([%s]*)((?:-[%s]+)*)("[^"]*"|'[^']*'|[^%s:#'"][^:#]*?)[%s]*:(?:[%s]+|$)(.*)$"""
_URL_USER = r"([a-zA-Z][a-zA-Z0-9+.-]*://)[^/%s:@]+:[^/%s@]*@"
_BLOCK_VALUE = r"^(?:[|>][+-]?\d*)?$"
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

KEY_LINE = "(?d)" + _KEY_LINE.replace("%s", SPACE)
URL_USER = _URL_USER.replace("%s", SPACE)
NO_BLOCK = 2**31 - 1
BEGINS, STAYS_OPEN, ENDS = 1, 2, 4


def key_pattern(extra: Sequence[str] = ()) -> str:
    return "|".join(f"(?:{p})" for p in (fixed.SENSITIVE_KEY, *extra))


def known_secrets(values: Iterable[str]) -> list[str]:
    """Distinct values worth replacing, longest first."""
    usable = {v for v in values if v and len(v) >= fixed.MIN_SECRET_LENGTH}
    return sorted(usable, key=lambda v: (-len(v), v))


class Scrubber:
    """Replaces secrets one after the other, longest first, but looks only at those a line holds.

    An automaton over all secrets finds them in one pass, so a line costs its length, however many secrets there are. A replacement can
    make a secret appear only where it overlaps the placeholder; the few that could are tried whenever something was replaced.
    """

    def __init__(self, secrets: Iterable[str]) -> None:
        self.secrets, self.automaton = known_secrets(secrets), None
        if self.secrets:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for rank, secret in enumerate(self.secrets):
                self.automaton.add_word(secret, rank)
            self.automaton.make_automaton()
        self.late = {rank for rank, secret in enumerate(self.secrets) if _may_overlap(secret, fixed.REDACTED)}

    def __call__(self, line: str) -> str:
        if self.automaton is None:
            return line
        found = {rank for _, rank in self.automaton.iter(line)}
        if found:
            for rank in sorted(found | self.late):
                line = line.replace(self.secrets[rank], fixed.REDACTED)
        return line


def _may_overlap(secret: str, mark: str) -> bool:
    """Whether an occurrence of ``secret`` can share a character with ``mark``."""
    return secret in mark or mark in secret or any(
        secret.endswith(mark[:n]) or secret.startswith(mark[-n:]) for n in range(1, min(len(mark), len(secret)) + 1))


# --- stateless expressions ---

def redact_urls(line: Column) -> Column:
    cleaned = F.regexp_replace(line, URL_USER, "$1" + fixed.REDACTED + "@")
    return F.when(F.contains(line, F.lit("://")), cleaned).otherwise(line)


def redact_patterns(line: Column, patterns: Sequence[str]) -> Column:
    for pattern in patterns:
        line = F.regexp_replace(line, pattern, fixed.REDACTED)
    return line


def redact_known(line: Column, secrets: Iterable[str]) -> Column:
    for secret in known_secrets(secrets):
        line = F.replace(line, F.lit(secret), F.lit(fixed.REDACTED))
    return line


def redact_known_of_row(line: Column, secrets: Column) -> Column:
    """The same for an array column of secrets, such as one list per device."""
    usable = F.filter(F.array_distinct(secrets), lambda s: F.length(s) >= fixed.MIN_SECRET_LENGTH)
    longest_first = F.array_sort(F.transform(usable, lambda s: F.struct((-F.length(s)).alias("n"), s.alias("s"))))
    return F.coalesce(
        F.aggregate(longest_first, line, lambda acc, s: F.replace(acc, s["s"], F.lit(fixed.REDACTED))), line
    )


def scrub(line: Column, patterns: Sequence[str] = (), secrets: Iterable[str] = ()) -> Column:
    return redact_known(redact_patterns(redact_urls(line), patterns), secrets)


def line_key(line: Column) -> Column:
    """The mapping key a line starts with, quotes included; empty if it is not such a line."""
    return F.when(F.contains(line, F.lit(":")), F.regexp_extract(line, KEY_LINE, 3)).otherwise(F.lit(""))


def is_sensitive(key: Column, extra: Sequence[str] = ()) -> Column:
    bare = F.regexp_replace(key, "^['\"]+|['\"]+$", "")
    return (key != "") & F.rlike(bare, F.lit("(?iu)" + key_pattern(extra)))


def redact_key_line(line: Column) -> Column:
    return F.regexp_replace(line, KEY_LINE, "$1$2$3: " + fixed.REDACTED)


def has_pem_begin(line: Column) -> Column:
    return F.contains(line, F.lit("-----BEGIN ")) & F.rlike(line, F.lit(fixed.PEM_BEGIN))


def is_plain(line: Column, extra_keys: Sequence[str] = ()) -> Column:
    """Whether a line taken alone only has its inline values replaced."""
    return ~(has_pem_begin(line) | is_sensitive(line_key(line), extra_keys))


def redact_line(
    line: Column, extra_keys: Sequence[str] = (), patterns: Sequence[str] = (), secrets: Iterable[str] = ()
) -> Column:
    """One line taken alone: PEM start, sensitive key, or inline values."""
    before_pem = F.regexp_extract(line, "(?s)^(.*?)" + fixed.PEM_BEGIN, 1)
    return (
        F.when(has_pem_begin(line), F.concat(before_pem, F.lit(fixed.REDACTED)))
        .when(is_sensitive(line_key(line), extra_keys), redact_key_line(line))
        .otherwise(scrub(line, patterns, secrets))
    )


# --- what a line does to the block state: swallow codes ---

def pem_code(line: Column) -> Column:
    stays = ~F.rlike(line, F.lit("(?s)" + fixed.PEM_BEGIN + ".*" + fixed.PEM_END))
    begins = F.when(has_pem_begin(line), F.lit(BEGINS) + F.when(stays, STAYS_OPEN).otherwise(0)).otherwise(0)
    ends = F.when(F.contains(line, F.lit("-----END ")) & F.rlike(line, F.lit(fixed.PEM_END)), ENDS).otherwise(0)
    return (begins + ends).cast("int")


def indent_of(line: Column) -> Column:
    """Leading spaces; -1 for a blank line, which never ends a block."""
    blank = F.rlike(line, F.lit(f"^[{SPACE}]*$"))
    return F.when(blank, -1).otherwise(F.length(line) - F.length(F.ltrim(line))).cast("int")


def opens_block(line: Column, extra_keys: Sequence[str] = ()) -> Column:
    """Column of a sensitive key whose value is on the following lines, else NO_BLOCK."""
    group = lambda i: F.regexp_extract(line, KEY_LINE, i)
    value = F.regexp_replace(group(4), f"^[{SPACE}]+|[{SPACE}]+$", "")
    opens = F.when(F.rlike(value, F.lit(_BLOCK_VALUE)), F.length(group(1)) + F.length(group(2))).otherwise(NO_BLOCK)
    # nested, so that the further groups are only taken from the few sensitive lines
    return F.when(is_sensitive(line_key(line), extra_keys), opens).otherwise(NO_BLOCK).cast("int")


def walk(
    pem: Iterable[int], indent: Iterable[int], opens: Iterable[int], in_pem: bool, block: int,
    swallowed: list[bool] | None = None,
) -> tuple[bool, int, int]:
    """Follow the block state over lines; optionally note which of them disappear.

    Returns the closing state and the smallest indent among the lines that can end a block.
    """
    least = NO_BLOCK
    for code, depth, opened in zip(pem, indent, opens):
        hidden = False
        if in_pem:
            hidden, in_pem = True, not code & ENDS
        elif code & BEGINS:
            in_pem = bool(code & STAYS_OPEN)
        elif depth < 0:
            hidden = block != NO_BLOCK
        else:
            least, hidden = min(least, depth), depth > block
            if not hidden:
                block = opened
        if swallowed is not None:
            swallowed.append(hidden)
    return in_pem, block, least


# --- whole documents, in Python's regex dialect ---

def document_redactor(
    extra_keys: Sequence[str] = (), patterns: Sequence[str] = (), secrets: Iterable[str] = ()
) -> Callable[[str], str]:
    key_line = re.compile(_KEY_LINE.replace("%s", r"\s"))
    url_user = re.compile(_URL_USER.replace("%s", r"\s"))
    sensitive = re.compile(key_pattern(extra_keys), re.IGNORECASE)
    begin, end, block_value = re.compile(fixed.PEM_BEGIN), re.compile(fixed.PEM_END), re.compile(_BLOCK_VALUE)
    values, known = [re.compile(p) for p in patterns], Scrubber(secrets)

    def read(line: str) -> tuple[int, int, int, str]:
        """Swallow codes of a line and what is shown for it."""
        start = begin.search(line) if "-----BEGIN " in line else None
        code = 0
        if start:
            code = BEGINS if end.search(line, start.end()) else BEGINS | STAYS_OPEN
        if "-----END " in line and end.search(line):
            code |= ENDS
        stripped = line.strip()
        depth = len(line) - len(line.lstrip(" ")) if stripped else -1
        if start:
            return code, depth, NO_BLOCK, line[: start.start()] + fixed.REDACTED
        found = key_line.match(line) if ":" in line else None
        if found and sensitive.search(found[3].strip("'\"")):
            rest = found[4].strip()
            opens = len(found[1]) + len(found[2]) if block_value.match(rest) else NO_BLOCK
            return code, depth, opens, f"{found[1]}{found[2]}{found[3]}: {fixed.REDACTED}"
        line = url_user.sub(r"\g<1>" + fixed.REDACTED + "@", line)
        for pattern in values:
            line = pattern.sub(lambda _: fixed.REDACTED, line)
        return code, depth, NO_BLOCK, known(line)

    def redact(text: str) -> str:
        lines = [read(line) for line in text.splitlines()]
        hidden: list[bool] = []
        walk(*([l[i] for l in lines] for i in range(3)), False, NO_BLOCK, hidden)
        shown = ("" if gone else l[3] for l, gone in zip(lines, hidden))
        return "\n".join(shown) + ("\n" if text.endswith("\n") else "")

    return redact


def redact_device_documents(
    documents: DataFrame, secrets: DataFrame, device: str = "device", order: str = "id", content: str = "content",
    extra_keys: Sequence[str] = (), patterns: Sequence[str] = (),
) -> DataFrame:
    """Documents redacted with the secrets of their own device; ``secrets`` has the columns (device, value)."""
    for pattern in (*extra_keys, *patterns):
        re.compile(pattern)
    extra_keys, patterns = tuple(extra_keys), tuple(patterns)
    return lists.with_values(documents, content, secrets, device, order, lambda values: document_redactor(extra_keys, patterns, values))


def redact_document(
    text: Column, extra_keys: Sequence[str] = (), patterns: Sequence[str] = (), secrets: Iterable[str] = ()
) -> Column:
    """Redact documents row by row (no shuffle); bad user patterns fail here, not in a task.

    A plain UDF takes a hundred rows at a time. An Arrow batch is ten thousand, whatever they weigh, and every worker would hold such a batch of
    documents several times over.
    """
    for pattern in (*extra_keys, *patterns):
        re.compile(pattern)
    extra_keys, patterns, secrets = tuple(extra_keys), tuple(patterns), tuple(secrets)
    ship(SparkSession.active())

    made: list[Callable[[str], str]] = []

    def redact(content: str | None) -> str | None:
        if not made:  # once for each worker
            made.append(document_redactor(extra_keys, patterns, secrets))
        return None if content is None else made[0](content)

    return F.udf(redact, "string", useArrow=False)(text)
