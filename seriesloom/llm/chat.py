r"""Chat formatting from an event log.

Events of a conversation are partitioned by conversation, sorted by sequence, and folded:

* ``message`` opens a message with a role and a text;
* ``delta`` appends text to a message (streaming);
* ``edit`` replaces the text of a message;
* ``regenerate`` replaces it too, usually by nothing, for the deltas that follow.

The last three change message number ``target`` (from 0) or, where that is null, the latest one; those before any message,
with a target that does not exist or of an unknown kind are ignored. The folded messages are rendered as
``<|im_start|>role\ntext<|im_end|>\n``. Inside texts, each ``<``, backslashes, ``|`` gets one backslash more, so no text
can hold a control string; roles are percent-encoded. Both are undone by ``read_back``.

One sort by conversation and sequence serves all steps. Its output, the rendered conversation, is one row by definition,
so a conversation must fit a task; within that, nothing is gathered but the finished messages.

Null text is empty, a null role is the empty role, a null conversation id is an id like others. Ties in the sequence are
ordered by kind, role and text; repeated rows are events of their own. An empty log gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def fold(events: DataFrame) -> DataFrame:
    """``conv_id, number, role, text``: the messages as they stand after all events.

    ``events``: conv_id, seq, kind, target, role, text. Other columns are not read.
    """
    rows = events.select(
        "conv_id",
        "seq",
        F.coalesce("kind", F.lit("")).alias("kind"),
        F.col("target").cast("long").alias("target"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).where(F.col("kind").isin("message", "delta", "edit", "regenerate"))
    order = ("seq", F.when(F.col("kind") == "message", 0).otherwise(1), "kind", "role", "text")
    by_seq = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    opened = F.count(F.when(F.col("kind") == "message", 1)).over(by_seq) - 1
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
    rows = rows.withColumn("opened", opened)
    number = F.when(F.col("kind") == "message", F.col("opened")).otherwise(F.coalesce("target", "opened"))
    rows = rows.withColumn("number", number).where("number >= 0 AND number <= opened")
    whole = Window.partitionBy("conv_id", "number")
    reset = F.max(F.when(F.col("kind") != "delta", F.col("at"))).over(whole)
    live = rows.withColumn("reset", reset).withColumn("text", F.when(F.col("at") >= F.col("reset"), F.col("text")))
    parts = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("at", "text"))))
    return (
        live.groupBy("conv_id", "number")
        .agg(F.max(F.when(F.col("kind") == "message", F.col("role"))).alias("role"), parts.alias("parts"))
        .select("conv_id", "number", "role", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))
    )


def render(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_spans``: spans are (start, end) in code points over the texts of role ``trained``."""
    rows = messages.select(
        "conv_id",
        "number",
        (F.col("role") == trained).alias("loss"),
        F.concat(F.lit(START), F.url_encode("role"), F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"),
    )
    tail = F.lit(f"{END}\n")
    before = Window.partitionBy("conv_id").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END) + 1
    start = (F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head")).cast("int")
    rows = rows.withColumn("start", start).withColumn("end", F.col("start") + F.length("body"))
    turn = F.struct("number", "loss", "head", "body", "start", "end")
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], tail)), "")
    masked = F.filter("turns", lambda t: t["loss"])
    spans = F.transform(masked, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return turns.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """array<role, text> from a rendered conversation."""
    turns = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda t: t != "")

    def turn(t: Column) -> Column:
        at = F.locate("\n", t)
        text = F.substring(t, at + 1, F.length(t) - at - len(END) - 1)
        return F.struct(F.url_decode(F.substring(t, F.lit(1), at - 1)).alias("role"), unescape(text).alias("text"))

    return F.transform(turns, turn)


def under_mask(chats: DataFrame) -> DataFrame:
    """``conv_id, loss``: the texts under the loss mask, unescaped, in order, for ``conv_id, formatted, loss_spans``.

    The rendered text is cut into turns once. A turn's place is the running sum of the lengths before it, and spans meet the
    turns at their places, so the work grows with the text, however many turns it has.
    """
    pieces = chats.select("conv_id", F.posexplode(F.split("formatted", r"<\|im_start\|>")).alias("at", "piece")).where("at > 0")
    before = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length("piece") + len(START)).over(before), F.lit(0))
    head = F.locate("\n", F.col("piece"))
    pieces = pieces.select("conv_id", "piece", head.alias("head"), (begin + len(START) + head).cast("int").alias("start"))
    spans = chats.select(F.col("conv_id").alias("_conv"), F.explode("loss_spans").alias("s")).select("_conv", "s.start", "s.end")
    met = pieces.join(
        spans.withColumnRenamed("start", "_start"), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("start") == F.col("_start"))
    )
    text = unescape(F.substring(F.col("piece"), F.col("head") + 1, F.col("end") - F.col("start")))
    found = met.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("start", text.alias("text")))).alias("found"))
    found = found.select(F.col("conv_id").alias("_conv"), F.transform("found", lambda f: f["text"]).alias("loss"))
    rows = chats.select("conv_id").join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return rows.select("conv_id", F.coalesce("loss", F.array().cast("array<string>")).alias("loss"))


def streamed(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """A log of events that ends as ``messages`` (conv_id, turn, role, text; turn, role and text give the order).

    What ``trained`` says comes as a streaming service tells it, by a hash of the message: whole, in three deltas, as a draft
    that is thrown away and generated anew, or with a slip that an edit corrects two messages later.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(order).alias("n"))
    text, n = F.col("text"), F.col("n").cast("long")
    way = F.when(F.col("role") == trained, F.pmod(F.xxhash64("conv_id", "n", "text"), F.lit(4))).otherwise(0)

    def event(step: int, kind: str, said: Column, later: int = 0) -> Column:
        target = n - 1 if later else F.lit(None).cast("long")
        seq = (n + later) * 8 + step
        return F.struct(seq.alias("seq"), F.lit(kind).alias("kind"), target.alias("target"), said.alias("text"))

    third = F.call_function("div", F.length(text), F.lit(3)).cast("int")
    parts = [F.substring(text, F.lit(1), third), F.substring(text, third + 1, third), F.substring(text, 2 * third + 1, F.length(text))]
    deltas = [event(3 + i, "delta", part) for i, part in enumerate(parts)]
    whole = F.array(event(0, "message", text))
    streams = F.array(event(0, "message", F.lit("")), *deltas)
    anew = F.array(event(0, "message", F.lit("a draft that nobody wanted")), event(1, "delta", text), event(2, "regenerate", F.lit("")), *deltas)
    slip = F.array(event(0, "message", F.concat(text, F.lit(" sic"))), event(7, "edit", text, later=2))
    events = F.when(way == 1, streams).when(way == 2, anew).when(way == 3, slip).otherwise(whole)
    return rows.select("conv_id", "role", F.explode(events).alias("e")).select("conv_id", "e.seq", "e.kind", "e.target", "role", "e.text")


def format_chats(events: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans`` for each conversation of an event log."""
    return render(fold(events))
