r"""Chat formatting [native]: prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only that
reply is trainable. A conversation that doesn't end with an assistant turn gets one more example
whose loss span is empty, so that its last turns stay in the output.

A turn is written `<|turn|>role<|text|>text<|end|>`. Inside roles and texts every backslash is
doubled, and a backslash goes after the first character of each control string, this template's
and those of other common templates, so that none of them remains; `unescape` takes both back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings that may not occur inside a text.
CONTROL = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]")

_INSIDE = r"([<\[])(\|turn\|>|\|text\|>|\|end\|>|s>|/s>|INST\]|/INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _INSIDE, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_chats(chats: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row an example: conv_id, example (from 1), n_turns, formatted, loss_start, loss_end (code points, end excluded).

    Turns go by `turn` (null first), then role, then text, so ties and repeated rows have one order;
    repeated rows are turns of their own. Null roles and texts are empty. Rows without a conv_id are
    one conversation. An empty table gives no example. Other columns are left out.
    """
    turns = chats.select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(TURN), escape(t.role), F.lit(TEXT))
    parts = F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t.text).alias("body"), (t.role == "assistant").alias("reply")))
    whole = whole.select("conv_id", F.size("turns").alias("n_turns"), parts.alias("parts"))
    last = F.col("n_turns")
    ends = F.filter(F.sequence(F.lit(1), last), lambda i: (i == last) | F.element_at("parts", i).reply)
    one = whole.select("conv_id", "n_turns", "parts", F.posexplode(ends).alias("at", "upto"))
    written = F.concat(F.array_join(F.transform(F.slice("parts", F.lit(1), F.col("upto")), lambda p: F.concat(p["head"], p.body)), END), F.lit(END))
    body = F.length(F.element_at("parts", F.col("upto")).body)
    stop = F.length("formatted") - len(END)
    return one.select(
        "conv_id",
        (F.col("at") + 1).alias("example"),
        "n_turns",
        written.alias("formatted"),
        F.when(F.element_at("parts", F.col("upto")).reply, body).otherwise(0).alias("_loss"),
    ).select("conv_id", "example", "n_turns", "formatted", (stop - F.col("_loss")).alias("loss_start"), stop.alias("loss_end"))


def trainable(formatted: Column, loss_start: Column, loss_end: Column) -> Column:
    """The unescaped text under the loss mask."""
    return unescape(F.substring(formatted, loss_start + 1, loss_end - loss_start))


def parse(formatted: Column) -> Column:
    """Turns read back: array of (role, text)."""
    pieces = F.split(formatted, r"<\|end\|>")
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return F.transform(pieces, lambda p: F.struct(unescape(F.substring_index(F.substring(p, len(TURN) + 1, 1 << 30), TEXT, 1)).alias("role"), unescape(F.substring_index(p, TEXT, -1)).alias("text")))


def digests(examples: DataFrame) -> DataFrame:
    """One row a conversation, from its examples alone: what was written, and what is trained on.

    A null conv_id is a conversation like others; empty replies count as no characters; without examples there is no row.
    """
    read = examples.select("conv_id", "example", "formatted", trainable(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("reply"))
    per = read.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.array_sort(F.collect_list(F.struct("example", "reply"))).alias("replies"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    turns = parse(F.col("whole"))
    lost = F.array_join(F.transform("replies", lambda r: r.reply), "")
    return per.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"),
        F.sha2(lost, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long"),
    )
