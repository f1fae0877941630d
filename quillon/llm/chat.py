r"""Relational chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of one role are numbered alike and merged by an
array aggregation for each block; blocks are collected, sorted and concatenated:

    <turn ROLE>TEXT<next>TEXT</turn>\n

Inside roles and texts a backslash is written \s, "<" is \l and ">" is \g, so no text can hold a control
string and `unescape` gives the text back.  The loss mask is a list of (start, length) spans in code points
of the formatted string, one for each text of a trained role; byte places stand beside them, so that a reader need not count code points.

Every step is linear in the turns but for sorting.  A conversation is one string in the end, so its blocks meet in one task.

Order within a conversation: turn, then role, then text; nulls come first.  A null text or role counts as empty;
repeated rows are turns of their own; null conv_ids form one conversation; an empty table gives none; further
columns are ignored.  Nothing has a length limit but Spark's own for a string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NEXT, CLOSE = "<next>", "</turn>\n"
TRAINED = ("assistant",)


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def format_chats(rows: DataFrame, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """conv_id, formatted (string), loss_spans (array of start, length, byte_start, byte_length), n_blocks."""
    conversation = W.partitionBy("conv_id")
    order = conversation.orderBy("turn", "role", "text")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    turns = turns.select("conv_id", "role", F.row_number().over(order).alias("seq"), F.lag("role").over(order).alias("before"), escape(F.col("text")).alias("text"))
    fresh = ~F.col("before").eqNullSafe(F.col("role"))
    opening = F.concat(F.lit("<turn "), escape(F.col("role")), F.lit(">"))
    head = F.when(~fresh, F.lit(NEXT)).when(F.col("before").isNull(), opening).otherwise(F.concat(F.lit(CLOSE), opening))
    so_far = conversation.orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    sizes = {"start": (F.char_length(head), F.char_length("text")), "byte_start": (F.octet_length(head), F.octet_length("text"))}
    places = [(F.sum((h + t).cast("long")).over(so_far) - t).cast("long").alias(name) for name, (h, t) in sizes.items()]
    turns = turns.select("*", F.sum(fresh.cast("int")).over(so_far).alias("block"), *places)
    turn = F.struct("seq", "text", "start", F.char_length("text").cast("long").alias("length"), "byte_start", F.octet_length("text").cast("long").alias("byte_length"))
    blocks = turns.groupBy("conv_id", "block", "role").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    merged = F.concat(opening, F.array_join(F.col("t.text"), NEXT), F.lit(CLOSE))
    spans = F.transform("t", lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"), x["byte_start"].alias("byte_start"), x["byte_length"].alias("byte_length")))
    spans = F.when(F.col("role").isin(*trained), spans).otherwise(F.slice(spans, 1, 0))
    chats = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", merged.alias("text"), spans.alias("spans")))).alias("b"))
    return chats.select("conv_id", F.array_join(F.col("b.text"), "").alias("formatted"), F.flatten(F.col("b.spans")).alias("loss_spans"), F.size("b").alias("n_blocks"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """Read formatted strings back: adds turns (array of role, text, unescaped) and loss_text (unescaped text under the mask)."""
    blocks = F.filter(F.split("formatted", CLOSE, -1), lambda b: b != "")  # what is behind the last mark
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substr(b, F.instr(b, ">") + 1), NEXT, -1),
                lambda x: F.struct(unescape(F.substring_index(F.substr(b, F.lit(7)), ">", 1)).alias("role"), unescape(x).alias("text")),
            ),
        )
    )
    # The bytes are bound to a name of their own, so they are made once and not for each span.
    cut = lambda data, s: F.decode(F.substr(data, (s["byte_start"] + 1).cast("int"), s["byte_length"].cast("int")), "utf-8")
    masked = F.flatten(F.transform(F.array(F.col("formatted").cast("binary")), lambda data: F.transform("loss_spans", lambda s: cut(data, s))))
    return formatted.withColumns({"turns": turns, "loss_text": unescape(F.array_join(masked, ""))})


def digests(read: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
