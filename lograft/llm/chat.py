"""Chat formatting: turn order checked by a finite-state machine, text segments with loss flags from a template.

A conversation is formatted turn by turn with a declarative template: what stands before and after the text of a role, and
whether the loss covers that text. Control strings inside a text are broken up by an escape that can be undone, so the
formatted string can be split into its turns again.

Defined results: rows are ordered by (turn, role, text), nulls first; repeated rows stay; null text is empty text; a null or unknown
role is written with the general form, null as the empty role; rows whose conv_id is null form one conversation; an empty table gives an
empty result; other columns are ignored. One conversation is one output value, so its turns meet in one row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Form:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Forms of the known roles, the form of any other role (its name stands behind ``before``), and allowed turn orders."""

    forms: dict[str, Form] = field(default_factory=lambda: {
        "system": Form("<<SYS>>\n", "\n<</SYS>>\n\n"),
        "user": Form("<s>[INST] ", " [/INST]"),
        "assistant": Form(" ", " </s>", loss=True),
    })
    other: Form = Form("<s>[ROLE]", "[/ROLE]")
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "briefed", ("start", "user"): "asked", ("briefed", "user"): "asked",
        ("asked", "assistant"): "answered", ("answered", "user"): "asked",
    })
    accepting: tuple[str, ...] = ("answered",)


DEFAULT = Template()


def escape(text: Column, template: Template = DEFAULT) -> Column:
    """Break up control strings: every escape sign gets a ``-``, and ``\\+`` stands behind the first sign of a control string."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "-"))
    for c in template.controls:
        out = F.replace(out, F.lit(c), F.lit(c[0] + ESCAPE + "+" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    out = F.replace(text, F.lit(ESCAPE + "|"), F.lit("\n"))
    return F.replace(F.replace(out, F.lit(ESCAPE + "+"), F.lit("")), F.lit(ESCAPE + "-"), F.lit(ESCAPE))


def _segment(text: Column, loss: bool) -> Column:
    return F.struct(text.alias("text"), F.lit(loss).alias("loss"))


def _segments(turn: Column, template: Template) -> Column:
    body = escape(turn["text"], template)
    name = F.replace(escape(turn["role"], template), F.lit("\n"), F.lit(ESCAPE + "|"))
    out = F.array(
        _segment(F.concat(F.lit(template.other.before), name, F.lit("\n")), False),
        _segment(body, template.other.loss), _segment(F.lit(template.other.after), False),
    )
    for role, form in template.forms.items():
        out = F.when(turn["role"] == role, F.array(
            _segment(F.lit(form.before), False), _segment(body, form.loss), _segment(F.lit(form.after), False),
        )).otherwise(out)
    return out


def format_conversations(rows: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """(conv_id, segments array of (text, loss), formatted, valid): one row per conversation."""
    turn = F.struct(
        "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    moves = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state} {role}", to)])
    final = F.aggregate(
        "turns", F.lit("start"),
        lambda state, t: F.coalesce(F.try_element_at(moves, F.concat_ws(" ", state, t["role"])), F.lit("refused")))
    segments = F.flatten(F.transform("turns", lambda t: _segments(t, template)))
    return turns.select(
        "conv_id", segments.alias("segments"), final.isin(*template.accepting).alias("valid"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if c in r"\[](){}|.*+?^$" else c for c in text)


def read_turns(formatted: Column, template: Template = DEFAULT) -> Column:
    """The turns of a formatted conversation as an array of (role, text)."""
    forms = [*template.forms.items(), ("", template.other)]
    # the form that begins with no control string comes last, as its start also occurs elsewhere
    forms.sort(key=lambda x: not x[1].before.strip())
    pattern = "|".join(f"{_quoted(f.before)}.*?{_quoted(f.after)}" for _, f in forms)

    def parse(piece: Column) -> Column:
        out = None
        for role, form in reversed(forms):
            inner = F.substr(piece, F.lit(len(form.before) + 1), F.length(piece) - F.lit(len(form.before) + len(form.after)))
            if role:
                read = F.struct(F.lit(role).alias("role"), unescape(inner).alias("text"))
            else:
                cut = F.locate("\n", inner)
                read = F.struct(
                    unescape(F.substr(inner, F.lit(1), cut - 1)).alias("role"), unescape(F.substr(inner, cut + 1)).alias("text"))
            out = read if out is None else F.when(F.startswith(piece, F.lit(form.before)), read).otherwise(out)
        return out

    return F.transform(F.regexp_extract_all(formatted, F.lit(f"(?s){pattern}"), F.lit(0)), parse)


def digests(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """What the formatted output holds, read back from it."""
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    read = formatted.select("conv_id", "valid", "formatted", loss.alias("loss"), read_turns(F.col("formatted"), template).alias("turns"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )
