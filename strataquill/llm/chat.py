"""Chat formatting as relational expressions.

The turns of a conversation are sorted by (turn, role, text), as they were given; a window marks where the role changes and
sums up lengths, so that each turn knows its block and its place. The turn structs of a block are collected, sorted and
merged by array aggregation, the blocks of a conversation are collected, sorted and concatenated. The template is

    <turn>role<says>text<then>text of the next merged turn</turn>

with a new line between blocks. In roles and texts a backslash is doubled and a backslash is put behind the ``<`` of any
control string, so that control strings of the template can't occur inside a text and unescaping restores each text.
The loss mask lists the spans (start, length, in code points) of the assistant texts in the formatted string.

Only built-in Spark expressions run, in time linear in the length of a conversation. A conversation is the unit of output,
so its turns meet in one row; no other group is ever collected.

Defined results: a null text or role counts as empty; a null turn sorts first; rows with a null conv_id form one
conversation; rows repeated are turns repeated; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The control strings of the template, and the words in them. (fixed values)
OPEN, SAYS, THEN, CLOSE, BETWEEN = "<turn>", "<says>", "<then>", "</turn>", "\n"
_CONTROL = r"<(/?turn|says|then)>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit(_CONTROL), F.lit(r"<\\$1>"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def format_chats(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_blocks, formatted, loss_spans."""
    c, nothing = conversations, F.lit("")
    rows = c.select(c[conv_col].cast("long").alias("conv_id"), c[turn_col].alias("turn"), F.coalesce(c[role_col], nothing).alias("role"), F.coalesce(c[text_col], nothing).alias("text"))
    told = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumns({"new": ~F.lag("role").over(told).eqNullSafe(F.col("role")), "said": escaped(F.col("text"))})
    # What stands before a turn's text: the head of a block, behind the end of the one before, or the mark between merged turns.
    head = F.char_length(escaped(F.col("role"))) + len(OPEN) + len(SAYS) + len(CLOSE) + len(BETWEEN)
    before = F.when(F.col("new"), head).otherwise(F.lit(len(THEN)))
    upto = told.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("length", F.char_length("said").cast("long"))
    rows = rows.withColumns({"block": F.sum(F.col("new").cast("long")).over(upto), "start": F.sum(before + F.col("length")).over(upto) - F.col("length") - (len(CLOSE) + len(BETWEEN))})
    turn = F.struct("start", "length", "said")
    blocks = rows.groupBy("conv_id", "block").agg(F.sort_array(F.array_agg(turn)).alias("turns"), F.first("role").alias("role"))
    texts = F.transform("turns", lambda t: t["said"])
    spans = F.transform("turns", lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    written = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(SAYS), F.array_join(texts, THEN), F.lit(CLOSE))
    block = F.struct("block", written.alias("written"), F.when(F.col("role") == loss_role, spans).otherwise(F.array().cast("array<struct<start:bigint,length:bigint>>")).alias("spans"))
    whole = blocks.select("conv_id", block.alias("b")).groupBy("conv_id").agg(F.sort_array(F.array_agg("b")).alias("blocks"))
    return whole.select(
        "conv_id",
        F.size("blocks").cast("long").alias("n_blocks"),
        F.array_join(F.transform("blocks", lambda b: b["written"]), BETWEEN).alias("formatted"),
        F.flatten(F.transform("blocks", lambda b: b["spans"])).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text), unescaped, read back from a formatted conversation."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: F.length(b) > 0)

    def turns(b: Column) -> Column:
        said = F.split(F.regexp_replace(b, F.lit("^\n?<turn>"), F.lit("")), SAYS)
        role = unescaped(said[0])
        return F.transform(F.split(said[1], THEN), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order. They are cut from UTF-32, where a place is found at once."""
    # The byte order mark in front keeps one that a text begins with.
    slice_of = lambda b, s: F.substring(b, (s["start"] * 4 + 1).cast("int"), (s["length"] * 4).cast("int"))
    cut = lambda b, s: F.decode(F.concat(F.lit(b"\0\0\xfe\xff"), slice_of(b, s)), "UTF-32")
    return F.transform(F.array(F.encode(formatted, "UTF-32")), lambda b: F.transform(spans, lambda s: unescaped(cut(b, s))))[0]
