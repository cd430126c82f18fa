"""Chat formatting from event logs, in DataFrame operations only.

A log row is (conv_id, seq, message, kind, role, text).  Kinds:

* ``open`` starts a message and gives its role; its place is its first seq
* ``delta`` appends text
* ``edit`` replaces all text so far
* ``regenerate`` discards all text so far; deltas that follow are the new text
* ``delete`` takes the message out (a later open or edit brings it back)

`fold` partitions the log by message, sorts by seq and folds it into final
messages before anything is moved by conversation, so a conversation with very
many deltas reaches its group as a few messages.  `render` puts messages in
order under the template

    <|im_start|>ROLE<|im_sep|>TEXT<|im_end|>

and keeps the character spans that carry loss (the texts of assistants).
Control strings inside roles and texts are escaped by a backslash after their
first character, and backslashes are doubled, so a rendered text never holds a
control string of its own and `parse` gets the exact texts back.

Defined cases: null text and null role are empty; a null conv_id is a
conversation of its own; null seq comes first; repeated rows are messages of
their own, ties of one turn go by role and text; events without an open have an
empty role; a very long text is one piece, and a conversation's formatted text is
one value; other columns, whatever their names, are left out; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: fixed values: control strings of common chat templates, as first character and rest
CONTROL = r"([<\[])(\|im_(?:start|sep|end)\|>|\|endoftext\|>|/?s>|</?SYS>>|/?INST\])"
LOSS_ROLE = "assistant"


def escape(x: Column) -> Column:
    return F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"\\([\s\S])", "$1")


def events_of_rows(rows: DataFrame, order: str = "turn") -> DataFrame:
    """The log of a table with one row for each message: an open and a delta each."""
    place = F.row_number().over(Window.partitionBy("conv_id", order).orderBy("role", "text"))
    two = F.array(F.struct(F.lit(0).alias("k"), F.lit("open").alias("kind"), F.lit(None).cast("string").alias("text")), F.struct(F.lit(1).alias("k"), F.lit("delta").alias("kind"), F.col("text").alias("text")))
    return (
        rows.select("conv_id", F.col(order).alias("turn"), "role", "text")
        .withColumn("n", place.cast("long") if order == "turn" else place)
        .withColumn("e", F.explode(two))
        .select("conv_id", F.struct("turn", "n", F.col("e.k").alias("k")).alias("seq"), F.struct("turn", "n").alias("message"), F.col("e.kind").alias("kind"), "role", F.col("e.text").alias("text"))
    )


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, place, role, text."""
    log = F.sort_array(F.collect_list(F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    last = lambda kinds: F.array_max(F.transform("log", lambda e, i: F.when(e["kind"].isin(*kinds), i).otherwise(F.lit(-1))))
    folded = (
        events.groupBy("conv_id", "message")
        .agg(log.alias("log"))
        .withColumn("reset", last(["open", "edit", "regenerate"]))
        .withColumn("gone", last(["delete"]))
        .withColumn("opened", F.filter("log", lambda e: e["kind"] == "open"))
    )
    live = F.filter(F.slice("log", F.greatest(F.col("reset"), F.lit(0)) + 1, F.size("log")), lambda e: e["kind"].isin("delta", "edit"))
    return folded.filter(F.col("gone") <= F.greatest(last(["open", "edit"]), F.lit(-1))).select(
        "conv_id",
        F.struct(F.col("log")[0]["seq"].alias("seq"), "message").alias("place"),
        F.coalesce(F.get("opened", F.size("opened") - 1)["role"], F.lit("")).alias("role"),
        F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, formatted, loss (spans of characters)."""
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP))
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        messages.withColumn("head", head)
        .withColumn("body", escape(F.col("text")))
        .withColumn("piece", F.concat("head", "body", F.lit(END)))
        .withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0).cast("long")) + F.length("head"))
    )
    one = F.struct("place", "piece", "start", F.length("body").alias("size"), (F.col("role") == LOSS_ROLE).alias("loss"))
    return (
        pieces.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(one)).alias("all"))
        .select(
            "conv_id",
            F.array_join(F.transform("all", lambda m: m["piece"]), "").alias("formatted"),
            F.transform(F.filter("all", lambda m: m["loss"]), lambda m: F.struct(m["start"].alias("start"), m["size"].alias("size"))).alias("loss"),
        )
    )


def parse(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>", -1), F.lit(2), F.greatest(F.size(F.split(formatted, r"<\|im_start\|>", -1)) - 1, F.lit(0)))
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring_index(p, SEP, 1)).alias("role"),
            unescape(F.substring_index(F.substring_index(p, SEP, -1), END, 1)).alias("text"),
        ),
    )


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["size"]))), "")


def format_chat(events: DataFrame) -> DataFrame:
    return render(fold(events))


def digest(out: DataFrame) -> DataFrame:
    """The contract's columns of op4, read back from the output."""
    back = out.withColumn("turns", parse(F.col("formatted"))).withColumn("under", loss_text(F.col("formatted"), F.col("loss")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"),
        F.sha2("under", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
