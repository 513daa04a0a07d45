"""Chat formatting by a declarative template, in DataFrame functions only.

A conversation's rows are put in the order of turn (then role and text, for repeated turns). A
finite-state machine reads the roles and says whether the order is legal. Every conversation is
formatted, legal or not: each turn gives three segments, opening marker, escaped text, closing
marker, and a loss flag for each. The escapes leave no angle bracket in a role or text, so no
control string of the template can stand inside one, and they are undone exactly.

Null text and null role are empty (an empty role is illegal); null turns come first; rows with
null conv_id form one conversation. A conversation is one output string, so its rows meet in
one task; conversations are spread over all. Other columns are left out. An empty table gives
no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm import common


@dataclass(frozen=True)
class Template:
    """Markers, escapes, the roles that are learned from, and the machine over roles."""

    before_role: str = "<turn "
    after_role: str = ">\n"
    after_text: str = "</turn>\n"
    #: In order; the first escapes the escape character itself.
    escapes: tuple = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
    loss_roles: tuple = ("assistant",)
    start: str = "start"
    moves: dict = field(default_factory=lambda: {
        "start": {"system": "ready", "user": "asked"},
        "ready": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked", "tool": "asked"},
    })
    accept: tuple = ("answered",)


CHAT = Template()


def escape(text: Column, template: Template = CHAT) -> Column:
    for plain, coded in template.escapes:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, template: Template = CHAT) -> Column:
    for plain, coded in reversed(template.escapes):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def is_legal(turns: Column, template: Template = CHAT) -> Column:
    """Does the machine accept the roles of ``turns``?"""
    steps = [x for state, out in template.moves.items() for role, to in out.items()
             for x in (F.lit(f"{state}\n{role}"), F.lit(to))]
    table = F.create_map(*steps)
    end = F.aggregate(turns, F.lit(template.start), lambda state, turn: F.coalesce(
        F.try_element_at(table, F.concat(state, F.lit("\n"), turn["role"])), F.lit("illegal")))
    return end.isin(*template.accept)


def format_turns(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row per conversation: conv_id, legal, segments (text, loss)."""
    rows = conversations.select(
        "conv_id", F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                            common.text_or_empty().alias("text")).alias("_t"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("_t")).alias("_turns"))

    def segment(text: Column, loss) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    segments = F.flatten(F.transform("_turns", lambda t: F.array(
        segment(F.concat(F.lit(template.before_role), escape(t["role"], template), F.lit(template.after_role)),
                F.lit(False)),
        segment(escape(t["text"], template), t["role"].isin(*template.loss_roles)),
        segment(F.lit(template.after_text), F.lit(False)))))
    return turns.select("conv_id", is_legal(F.col("_turns"), template).alias("legal"), segments.alias("segments"))


def formatted(segments: Column) -> Column:
    """The conversation's string."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_turns(text: Column, template: Template = CHAT) -> Column:
    """Roles and texts back from a formatted string."""
    parts = F.slice(F.split(text, template.before_role), 2, 1 << 30)

    def turn(part: Column) -> Column:
        role = F.substring_index(part, template.after_role, 1)
        rest = F.substr(part, F.length(role) + 1 + len(template.after_role))
        return F.struct(unescape(role, template).alias("role"),
                        unescape(F.substring_index(rest, template.after_text, 1), template).alias("text"))

    return F.transform(parts, turn)


def loss_text(segments: Column, template: Template = CHAT) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]),
                                    lambda s: unescape(s["text"], template)), "")


PROBE = r"\### Assistant: </turn> ok"


def query(spark, sf_dir: str) -> DataFrame:
    """Every conversation and the probe, formatted and read back."""
    table = common.read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    out = format_turns(table.unionByName(probe)).select(
        "conv_id", "legal", formatted(F.col("segments")).alias("_text"), loss_text(F.col("segments")).alias("_loss"))
    out = out.select("*", read_turns(F.col("_text")).alias("_turns"))
    return out.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("_turns", lambda t: F.concat(
            t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("_text").cast("long").alias("formatted_chars"), "legal")


SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
             lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev FROM c),
-- what each state may be left with: here a state is fixed by the role before it
s AS (SELECT *, CASE WHEN prev IS NULL THEN role IN ('system', 'user')
                     WHEN prev = 'system' THEN role = 'user' AND k = 2
                     WHEN prev IN ('user', 'tool') THEN role = 'assistant'
                     WHEN prev = 'assistant' THEN role IN ('user', 'tool') ELSE false END AS ok FROM n)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<turn ' || '>' || chr(10) || '</turn>' || chr(10)) + length(role) + length(text)
           + length(regexp_replace(role || text, '[^<>\\]', '', 'g')))::BIGINT AS formatted_chars,
       bool_and(ok) AND last(role ORDER BY k) = 'assistant' AS legal
FROM s GROUP BY conv_id
"""
