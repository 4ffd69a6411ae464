"""Chat formatting with Spark expressions only.

Each conversation's turns are collected, sorted, merged where neighbours have the same role, and concatenated:

    <|im_start|>role\\nfirst text<|im_sep|>second text<|im_end|>\\n

Inside texts, a `<` that backslashes (or none) and `|` follow gets one backslash more, so no control string occurs in
them and taking one away restores the text. Roles are percent-encoded, which leaves plain names as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def format_conversations(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per conversation: conv_id, formatted.

    Turns go by (turn, role, text), nulls first, so repeated turn numbers have a fixed order and equal rows stay apart.
    A null role or text counts as empty. Rows of a null conversation id form one conversation. An empty table gives no
    row; other columns are not read. A conversation is held whole by one task, as its formatted text
    is; time is in proportion to its turns.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).cast("long").alias("turn"),
            F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        ).alias("one"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    # Runs of one role begin where the turn before has another one; each run becomes one block. Every turn is visited once.
    begins = F.filter(
        F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (F.get("turns", i - 1)["role"] != F.get("turns", F.greatest(i - 2, F.lit(0)))["role"])
    )
    runs = whole.withColumn("begins", begins)

    def block(i: Column, k: Column) -> Column:
        after = F.coalesce(F.get("begins", k + 1), F.size("turns") + 1)
        texts = F.transform(F.slice("turns", i, after - i), lambda t: escape(t["text"]))
        return F.concat(F.lit(START), F.url_encode(F.get("turns", i - 1)["role"]), F.lit("\n"), F.array_join(texts, SEPARATOR), F.lit(END))

    return runs.select("conv_id", F.array_join(F.transform("begins", block), "").alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted and ``turns``: array of (role, text), one per turn, from formatted text alone."""
    parts = F.split("formatted", r"<\|im_end\|>\n", -1)
    blocks = F.slice(parts, 1, F.size(parts) - 1)

    def turns_of(b: Column) -> Column:
        body = F.substring(b, F.lit(len(START) + 1), F.length(b))
        role = F.url_decode(F.substring_index(body, "\n", 1))
        text = F.substring(body, F.length(F.substring_index(body, "\n", 1)) + 2, F.length(body))
        return F.transform(F.split(text, r"<\|im_sep\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return formatted.withColumn("turns", F.flatten(F.transform(blocks, turns_of)))


def with_loss_text(read: DataFrame, role: str = "assistant") -> DataFrame:
    """Adds loss_text: the texts under the loss mask, those of ``role``, in order with nothing between."""
    return read.withColumn("loss_text", F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == role), lambda t: t["text"]), ""))
