"""Chat formatting as relational work, with Spark expressions only.

A conversation's turns are collected as structs and sorted by turn (ties by role, then text). Adjacent turns of
one role become one block: the block's mark opens at the first of them, `[TURN]` stands between them, and the
closing mark follows the last. Whether a turn is first or last of its run is read from its neighbours in the sorted
array, so the pass is linear where a fold that appends would copy the array for every turn. The parts are
concatenated into one string.

    system      <<SYS>>text<</SYS>>
    user        [INST]text[/INST]
    assistant   <s>text</s>
    any other   [ROLE hex-of-its-name]text[/ROLE]

A control string inside a text gets a backslash after its first character, one more than it already has there
(`[INST]` -> `[\\INST]`, `[\\INST]` -> `[\\\\INST]`), which reading back takes away again. The loss mask covers the
texts of assistant blocks, without marks.

Null text is empty, a null role is the empty role, rows of null conv_id form one conversation, a null turn sorts
first; repeated rows stay. Other columns are not carried. A conversation is one string and has to fit one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's marks by role.
OPENING = {"system": "<<SYS>>", "user": "[INST]", "assistant": "<s>"}
CLOSING = {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"}
BETWEEN = "[TURN]"
_REST = r"/?INST\]|TURN\]|/ROLE\]|ROLE |/?s>|</?SYS>>"
_CONTROL = rf"([\[<])(\\*)({_REST})"
_ESCAPED = rf"([\[<])\\(\\*)({_REST})"
_BLOCK = r"(?s)(<<SYS>>|\[INST\]|<s>|\[ROLE [0-9A-F]*\])(.*?)(<</SYS>>|\[/INST\]|</s>|\[/ROLE\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _by_role(role: Column, marks: dict[str, str], other: Column) -> Column:
    out = None
    for name, mark in marks.items():
        out = F.when(role == name, mark) if out is None else out.when(role == name, mark)
    return out.otherwise(other)


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted: one row per conversation, from rows of (conv_id, turn, role, text)."""
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    collected = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def part(x: Column, i: Column) -> Column:
        before, after = F.get("turns", i - 1), F.get("turns", i + 1)
        opens = before.isNull() | (before["role"] != x["role"])
        closes = after.isNull() | (after["role"] != x["role"])
        opening = _by_role(x["role"], OPENING, F.concat(F.lit("[ROLE "), F.hex(x["role"]), F.lit("]")))
        return F.concat(F.when(opens, opening).otherwise(BETWEEN), escape(x["text"]), F.when(closes, _by_role(x["role"], CLOSING, F.lit("[/ROLE]"))).otherwise(""))

    return collected.select("conv_id", F.array_join(F.transform("turns", part), "").alias("formatted"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (array of role and text as they went in), loss (array of the texts under the loss mask)."""
    whole = F.col("formatted")
    blocks = F.arrays_zip(F.regexp_extract_all(whole, F.lit(_BLOCK), 1).alias("mark"), F.regexp_extract_all(whole, F.lit(_BLOCK), 2).alias("body"))
    named = formatted.withColumn("blocks", blocks)

    def role(mark: Column) -> Column:
        hexed = F.regexp_extract(mark, r"^\[ROLE ([0-9A-F]*)\]$", 1)
        return _by_role(mark, {v: k for k, v in OPENING.items()}, F.decode(F.unhex(hexed), "UTF-8"))

    def texts(body: Column) -> Column:
        return F.transform(F.split(body, r"\[TURN\]", -1), unescape)

    turns = F.flatten(F.transform("blocks", lambda b: F.transform(texts(b["body"]), lambda t: F.struct(role(b["mark"]).alias("role"), t.alias("text")))))
    loss = F.flatten(F.transform(F.filter("blocks", lambda b: b["mark"] == OPENING["assistant"]), lambda b: texts(b["body"])))
    return named.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))


def digest(read: DataFrame) -> DataFrame:
    """The contract's columns, all from the formatted text as read back."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
