"""Chat formatting with Spark expressions only.

A conversation's turn structs are collected and sorted once; runs of neighbouring
turns with one role are aggregated into a block; a block is written as

    <s>role[INST]text[/INST][INST]text[/INST]...</s>

with one ``[INST]...[/INST]`` a turn, and blocks are concatenated.  Roles and texts
are escaped: inside them a backslash is put behind the bracket of everything that
reads like a control string with any number of backslashes behind its bracket.  So
no control string is left inside a text, and taking one backslash away from each
such place gives exactly the text back.

``segments`` is the formatted text cut where the loss mask changes: their texts
concatenated are ``formatted``, and those with ``loss`` are the (escaped) texts of the
roles that are learned.

Runs are found by their first positions and sliced, and never folded into a growing
array, so the work is linear in a conversation's length.  A formatted conversation is
one value: it must fit in a row, as must its turns while they are sorted.

Defined results: a null text or role counts as empty; a null turn comes first; turns
with equal numbers stand by role, then text, and repeated rows are turns of their
own; rows without a conv_id form one conversation without an id; an empty table gives
an empty table.  Other columns of the caller do not enter the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinio.llm.common import let, table, text_or_empty

#: Each control string starts with a bracket that none holds at another place.
BLOCK, BLOCK_END, TURN, TURN_END = "<s>", "</s>", "[INST]", "[/INST]"
LOSS_ROLES = ("assistant",)

_REST = {"<": r"/?s>", r"\[": r"/?INST\]"}
_TO_ESCAPE = "|".join(rf"{bracket}(?=\\*+{rest})" for bracket, rest in _REST.items())
_ESCAPED = "|".join(rf"{bracket}(?=\\++{rest})" for bracket, rest in _REST.items())


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(f"({_TO_ESCAPE})"), F.lit(r"$1\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(rf"({_ESCAPED})\\"), F.lit("$1"))


def _runs(turns: Column) -> Column:
    """Blocks (role, texts) of neighbouring turns that share a role."""
    def sliced(starts: Column) -> Column:
        return F.transform(starts, lambda at, k: F.struct(
            F.get(turns, at)["role"].alias("role"),
            F.transform(F.slice(turns, at + 1, F.coalesce(F.get(starts, k + 1), F.size(turns)) - at),
                        lambda t: t["text"]).alias("texts")))

    positions = F.transform(turns, lambda t, i: F.when((i > 0) & (t["role"] == F.get(turns, i - 1)["role"]), -1)
                            .otherwise(i))
    return let(F.filter(positions, lambda i: i >= 0), sliced)


def _segments(block: Column, loss_roles: tuple[str, ...]) -> Column:
    """The block's text, cut where the mask changes."""
    loss = block["role"].isin(*loss_roles)
    part = lambda text, under: F.struct(text.alias("text"), under.alias("loss"))
    head = F.concat(F.lit(BLOCK), escape(block["role"]))
    body = F.array_join(F.transform(block["texts"], lambda t: F.concat(F.lit(TURN), escape(t), F.lit(TURN_END))), "")
    plain = F.array(part(F.concat(head, body, F.lit(BLOCK_END)), F.lit(False)))
    texts = F.flatten(F.transform(block["texts"], lambda t, i: F.array(
        part(F.concat(F.when(i == 0, head).otherwise(F.lit(TURN_END)), F.lit(TURN)), F.lit(False)),
        part(escape(t), F.lit(True)))))
    learned = F.concat(texts, F.array(part(F.lit(TURN_END + BLOCK_END), F.lit(False))))
    return F.when(loss, learned).otherwise(plain)


def format_chats(turns: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES, conv_col: str = "conv_id",
                 turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, n_blocks, segments, formatted): a row a conversation.  One shuffle, lazy."""
    row = F.struct(F.col(f"`{turn_col}`").alias("turn"), text_or_empty(f"`{role_col}`").alias("role"),
                   text_or_empty(f"`{text_col}`").alias("text"))
    chats = (turns.select(F.col(f"`{conv_col}`").alias("conv_id"), row.alias("t"))
             .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")))
    blocks = chats.select("conv_id", _runs(F.col("turns")).alias("blocks"))
    cut = blocks.select("conv_id", F.size("blocks").cast("long").alias("n_blocks"),
                        F.flatten(F.transform("blocks", lambda b: _segments(b, loss_roles))).alias("segments"))
    return cut.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def _between(text: Column, start: str, stop: str) -> Column:
    """Pieces between each ``start`` and its ``stop``, where one follows the other throughout."""
    return F.transform(F.filter(F.split(text, stop.replace("[", r"\[")), lambda x: x != ""),
                       lambda x: F.substring(x, F.lit(len(start) + 1), F.char_length(x)))


def read_chat(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, from the text alone."""
    def block(b: Column) -> Column:
        role = unescape(F.substring_index(b, TURN, 1))
        texts = _between(F.substring(b, F.instr(b, TURN), F.char_length(b)), TURN, TURN_END)
        return let(role, lambda r: F.transform(texts, lambda t: F.struct(r.alias("role"), unescape(t).alias("text"))))

    return F.flatten(F.transform(_between(formatted, BLOCK, BLOCK_END), block))


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


MARKED = "</s>[INST] ok [/INST]"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all formatted conversations and of one that speaks in control strings."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", MARKED), (-7, 1, "assistant", MARKED)],
                                  "conv_id long, turn long, role string, text string")
    chats = format_chats(c.unionByName(added))
    back = chats.select("conv_id", F.char_length("formatted").cast("long").alias("formatted_chars"),
                        read_chat(F.col("formatted")).alias("turns"), read_loss(F.col("segments")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
                       F.char_length("loss").cast("long").alias("loss_chars"),
                       F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS opens,
    length(role) + len(regexp_extract_all(role, '<\\*/?s>|\[\\*/?INST\]')) AS role_chars,
    length(text) + len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?INST\]')) AS text_chars,
    row_number() OVER w AS k FROM c
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(13 + text_chars + opens * (7 + role_chars)) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
