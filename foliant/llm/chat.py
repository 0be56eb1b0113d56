"""Chat formatting with Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import let, running

# Fixed control strings of the template.
ROLE, TEXT, NEXT, END = "<|role|>", "<|text|>", "<|next|>", "<|end|>"
#: What must not stand in a text as it is: the template's own marks and those of common chat templates.
CONTROL_REST = r"/?s>|/?INST\]|\|[A-Za-z_]+\|>|</?SYS>>"


def escape(text: Column) -> Column:
    """Puts one backslash more after the first character of each control string, so that none is left."""
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={CONTROL_REST})", r"$1\\$2")


def unescape(text: Column) -> Column:
    """Takes that backslash away again."""
    return F.regexp_replace(text, rf"([<\[])\\(\\*)(?={CONTROL_REST})", "$1$2")


def _quoted(mark: str) -> str:
    return mark.replace("|", r"\|")


def format_chats(turns: DataFrame, key: str = "conv_id", trained_role: str = "assistant") -> DataFrame:
    """Formats conversations (key, turn, role, text): key, formatted, loss (array of (begin, width) in code points).

    Turns go by turn, ties by role and text; null turns come first; null roles and texts are empty;
    repeated rows are turns of their own; a null key is a conversation of its own; very long texts are formatted
    whole; other columns are ignored; an empty table gives no rows. Adjacent turns of a role share one block, in which NEXT parts
    the messages, so that the rows can be read back. The loss mask covers each text of trained_role.
    """
    empty = F.lit("")
    rows = turns.select(
        F.col(key).alias("_key"),
        F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role"), empty).alias("role"), F.coalesce(F.col("text"), empty).alias("text")).alias("_t"),
    )

    def merged(ts: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(ts)), lambda i: (i == 1) | (F.element_at(ts, i).role != F.try_element_at(ts, F.when(i > 1, i - 1).otherwise(F.lit(1))).role))

        def runs(at: Column) -> Column:
            def one(s: Column, k: Column) -> Column:
                after = F.coalesce(F.try_element_at(at, k + 2), F.size(ts) + 1)
                return F.struct(F.element_at(ts, s).role.alias("role"), F.transform(F.slice(ts, s, after - s), lambda t: escape(t.text)).alias("texts"))

            return F.transform(at, one)

        return let(starts, runs)

    def pieces(runs: Column) -> Column:
        # a piece is a mark or a text, with whether the loss covers it
        mark = lambda s: F.struct(s.alias("s"), F.lit(False).alias("loss"))

        def block(r: Column) -> Column:
            head = F.array(mark(F.concat(F.lit(ROLE), escape(r.role), F.lit(TEXT))))
            body = F.flatten(F.transform(r.texts, lambda t, i: F.when(i == 0, F.array(F.struct(t.alias("s"), (r.role == trained_role).alias("loss")))).otherwise(F.array(mark(F.lit(NEXT)), F.struct(t.alias("s"), (r.role == trained_role).alias("loss"))))))
            return F.concat(head, body, F.array(mark(F.lit(END))))

        return F.flatten(F.transform(runs, block))

    grouped = rows.groupBy("_key").agg(F.array_sort(F.collect_list("_t")).alias("_ts"))
    blocks = grouped.select("_key", let(F.col("_ts"), merged).alias("_runs"))
    parted = blocks.select("_key", let(F.col("_runs"), pieces).alias("_pieces"))
    ends = running(F.transform("_pieces", lambda p: F.length(p.s)))
    spans = F.zip_with(ends, "_pieces", lambda e, p: F.when(p.loss, F.struct((e - F.length(p.s)).alias("begin"), F.length(p.s).alias("width"))))
    return parted.select(
        F.col("_key").alias(key),
        F.array_join(F.transform("_pieces", lambda p: p.s), "").alias("formatted"),
        F.filter(spans, lambda s: s.isNotNull()).alias("loss"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    blocks = F.filter(F.split(formatted, _quoted(END)), lambda b: b != "")

    def turns(block: Column) -> Column:
        def of(halves: Column) -> Column:
            role = unescape(F.substring(F.element_at(halves, 1), len(ROLE) + 1, 2**31 - 1))
            return F.transform(F.split(F.element_at(halves, 2), _quoted(NEXT), -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

        return let(F.split(block, _quoted(TEXT), 2), of)

    return F.flatten(F.transform(blocks, turns))


def op3_chat_format(conversations: DataFrame) -> DataFrame:
    """The thin query over format_chats: every conversation, and conversation -1 with control strings as texts."""
    probe = conversations.sparkSession.sql(
        "SELECT -1L conv_id, t turn, IF(t = 0, 'user', 'assistant') role, '</s>[INST] ok [/INST]' text FROM VALUES (0L), (1L) AS v(t)"
    )
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
    loss = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s.begin + 1, s.width)))
    read = format_chats(rows).select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), F.array_join(loss, "").alias("loss_text"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP3_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS starts,
         len(regexp_extract_all(text, '[<\[]\\*(/?s>|/?INST\]|\|[A-Za-z_]+\|>|</?SYS>>)')) AS text_marks,
         len(regexp_extract_all(role, '[<\[]\\*(/?s>|/?INST\]|\|[A-Za-z_]+\|>|</?SYS>>)')) AS role_marks
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(text) + text_marks + CASE WHEN starts = 1 THEN 8 + length(role) + role_marks + 8 + 7 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
