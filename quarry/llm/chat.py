"""Chat formatting: a finite-state machine over roles and a declarative template.

The template gives each role an opening and a closing mark and says whether its text counts in
the loss. Texts are escaped so that no mark can stand in them: `&`, `<` and `[` become references,
and reading back turns them round. The output of a conversation is one formatted string and its
segments (text, loss), whose concatenation it is.

The machine reads the roles in order. Its state is the last role; from the start a system or user
turn may come, after a system turn a user turn, after a user turn an assistant turn, and so on.
Turns that break the order are formatted all the same, and `bad_turn` names the first of them.

Long conversations are put together in two steps: runs of RUN_TURNS turn numbers first, then the
runs, so that the texts of one conversation are gathered and sorted in many tasks. Only
DataFrame expressions are used.

Defined results: null text and null role are the empty string; a role that the template doesn't
know gets the marks of `other`, which carry its name; rows of equal turn go by role, then text; a
null conv_id is a conversation of its own; an empty table gives an empty table. Extra columns are
not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN_TURNS = 128


@dataclass(frozen=True)
class Marks:
    """Marks round the text of a role; {role} in an opening stands for the escaped role."""

    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    roles: dict[str, Marks] = field(
        default_factory=lambda: {
            "system": Marks("[SYS]", "[/SYS]"),
            "user": Marks("[INST]", "[/INST]"),
            "assistant": Marks("[ANS]", "</s>", loss=True),
        }
    )
    other: Marks = Marks("[ROLE {role}]", "[/ROLE]")
    #: State -> roles that may come next; "" is the start.
    moves: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )


#: Escapes in order of writing; reading goes backwards.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("]", "&#93;"))


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def _by_role(role: Column, template: Template, pick, other) -> Column:
    out = None
    for name, marks in template.roles.items():
        out = F.when(role == name, pick(marks)) if out is None else out.when(role == name, pick(marks))
    return other if out is None else out.otherwise(other)


def segments(role: Column, text: Column, template: Template) -> Column:
    """The three segments of a turn: opening, escaped text, closing."""
    head, tail = template.other.opening.split("{role}")
    opening = _by_role(role, template, lambda m: F.lit(m.opening), F.concat(F.lit(head), escape(role), F.lit(tail)))
    closing = _by_role(role, template, lambda m: F.lit(m.closing), F.lit(template.other.closing))
    loss = _by_role(role, template, lambda m: F.lit(m.loss), F.lit(template.other.loss))
    part = lambda x, flag: F.struct(x.alias("text"), flag.alias("loss"))
    return F.array(part(opening, F.lit(False)), part(escape(text), loss), part(closing, F.lit(False)))


def _first_bad(roles: Column, template: Template) -> Column:
    """1-based place of the first turn that the machine refuses, or null."""
    allowed = F.array(*[F.lit(f"{state}>{role}") for state, out in template.moves.items() for role in out])
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def move(a: Column, role: Column) -> Column:
        fine = F.array_contains(allowed, F.concat(a["state"], F.lit(">"), role))
        return F.struct(role.alias("state"), (a["at"] + 1).alias("at"), F.coalesce(a["bad"], F.when(~fine, a["at"] + 1)).alias("bad"))

    return F.aggregate(roles, start, move, lambda a: a["bad"])


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation: formatted, segments (array of text and loss), bad_turn."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    run = F.floor(F.col("turn") / RUN_TURNS)
    runs = rows.groupBy("conv_id", run.alias("run")).agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNull().alias("last"), "turn", "role", "text"))).alias("rows"))
    runs = runs.select(
        "conv_id",
        "run",
        F.transform("rows", lambda x: x["role"]).alias("roles"),
        F.flatten(F.transform("rows", lambda x: segments(x["role"], x["text"], template))).alias("parts"),
    )
    whole = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("run").isNull().alias("last"), "run", "roles", "parts"))).alias("runs"))
    whole = whole.select(
        "conv_id",
        _first_bad(F.flatten(F.transform("runs", lambda x: x["roles"])), template).alias("bad_turn"),
        F.flatten(F.transform("runs", lambda x: x["parts"])).alias("segments"),
    )
    return whole.select("conv_id", F.array_join(F.transform("segments", lambda x: x["text"]), "").alias("formatted"), "segments", "bad_turn")


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+?^$|/" else c for c in text)


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) of a formatted string: the inverse of the template."""
    every = [*template.roles.values(), template.other]
    opening = "|".join(_quoted(m.opening).replace(r"\{role\}", r"[^\[\]<]*+") for m in every)
    closing = "|".join(dict.fromkeys(_quoted(m.closing) for m in every))
    turn = F.lit(f"({opening})([^\\[<]*+)(?:{closing})")
    names = F.regexp_extract_all(formatted, turn, F.lit(1))
    texts = F.regexp_extract_all(formatted, turn, F.lit(2))
    head, tail = template.other.opening.split("{role}")

    def role(mark: Column) -> Column:
        named = unescape(F.substring(mark, F.lit(len(head) + 1), F.char_length(mark) - len(head) - len(tail)))
        out = None
        for name, marks in template.roles.items():
            out = F.when(mark == marks.opening, F.lit(name)) if out is None else out.when(mark == marks.opening, F.lit(name))
        return named if out is None else out.otherwise(named)

    return F.zip_with(names, texts, lambda m, t: F.struct(role(m).alias("role"), unescape(t).alias("text")))


def digests(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation, from the formatted string and its segments: the digests of op4."""
    out = format_conversations(turns, template)
    out = out.withColumn("read", read_turns(F.col("formatted"), template))
    told = F.array_join(F.transform("read", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda x: x["loss"]), lambda x: unescape(x["text"])), "")
    out = out.select("conv_id", "formatted", "bad_turn", F.size("read").cast("long").alias("n_turns"), told.alias("told"), loss.alias("loss"))
    return out.select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("told").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "bad_turn",
    )


def with_probe(turns: DataFrame) -> DataFrame:
    """turns and conversation -1, whose texts hold other templates' control strings."""
    said = F.lit("</s>[INST] ok [/INST]")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = turns.sparkSession.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), said.alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (
  SELECT *, lag(role) OVER w AS before, row_number() OVER w AS place,
    length(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), ']', '&#93;'))
    + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 ELSE
      14 + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), ']', '&#93;')) END AS n
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
a AS (
  SELECT conv_id, count(*) AS n_turns, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told, sum(n)::BIGINT AS formatted_chars,
    (min(place) FILTER (NOT coalesce(before, '') || '>' || role IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user')))::INT AS bad_turn
  FROM m GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, bad_turn FROM a
"""
