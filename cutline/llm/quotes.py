"""Quotation linking: replies joined to what they quote, with DataFrame functions only.

A line's quote level is the number of ``>`` before its text. Consecutive quoted lines of one level
are a passage. Passages are normalised (markers off, lower case, single spaces) and hashed, whole, by
their first line and by each line; messages are hashed in the same way, whole and by every line of their own text.
A passage joins the earliest message of its conversation with its hash that comes before the reply,
or else the earliest such message of any other conversation (smallest conv_id, then turn). A whole passage
counts before a first line, that before any other line, and the outermost, first passage of a message names its parent. Threads
are roots of parent links inside a conversation, found by pointer doubling; (conv_id, thread_turn,
turn) is the reply order.

Originals are reduced to two conversations per hash before the join, so a passage quoted by everyone makes one
row per quote.

Defined results: a null or empty text has an empty body and no quotes; a line of markers only is
blank; messages without a key (null conv_id or turn) are returned without parent or thread; messages
that repeat (conv_id, turn) are one node with the smallest text first; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutline.llm.store import stored

_MARKS = r"^[ \t]*(?:>[ \t]*)+"


def _level(line):
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), "[^>]", ""))


def _plain(text):
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _hash(text):
    return F.sha2(_plain(text), 256)


def link_quotes(messages: DataFrame) -> DataFrame:
    """Per row of ``messages`` (conv_id, turn, role, text): its own text, quotes, parent and thread."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    body = F.trim(F.array_join(F.filter(lines, lambda s: ~s.rlike(_MARKS)), "\n"))
    rows = stored(
        messages.select("conv_id", "turn", "role", "text")
        .withColumn("body", body)
        .withColumn("row", F.monotonically_increasing_id()),
        "messages",
    )
    quoting = rows.where(F.col("text").rlike("(?m)" + _MARKS))
    told = quoting.select("row", "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("at", "line")).select(
        "row", "conv_id", "turn", "at", _level("line").alias("level"), F.regexp_replace("line", _MARKS, "").alias("line")
    )
    # One message is one window: its size bounds the group.
    own = Window.partitionBy("row").orderBy("at")
    runs = told.withColumn("new", (F.col("level") != F.lag("level", 1, -1).over(own)).cast("int")).withColumn(
        "run", F.sum("new").over(own)
    )
    passages = stored(
        runs.where("level > 0")
        .groupBy("row", "conv_id", "turn", "run", "level")
        .agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("parts"))
        .withColumn("words", F.array_join("parts.line", " "))
        .withColumn("said", F.filter("parts.line", lambda s: F.trim(s) != ""))
        .withColumn("head", F.get("said", F.lit(0)))
        .where("head is not null")
        .select("row", "conv_id", "turn", "run", "level", _hash(F.col("words")).alias("whole"), _hash(F.col("head")).alias("first"), F.transform("said", _hash).alias("each")),
        "passages",
    )
    keys = passages.select("row", "conv_id", "turn", "run", "level", F.posexplode(F.concat(F.array("whole", "first"), "each")).alias("rank", "hash"))
    asked = keys.select("hash").distinct()
    texts = rows.where("conv_id is not null and turn is not null and body <> ''").select(
        "conv_id", "turn", F.explode(F.array_distinct(F.concat(F.array("body"), F.split("body", "\n")))).alias("part")
    )
    originals = stored(
        texts.where(F.trim("part") != "").select("conv_id", "turn", _hash(F.col("part")).alias("hash"))
        .join(asked, "hash", "left_semi")
        .groupBy("hash", "conv_id").agg(F.min("turn").alias("turn")),
        "originals",
    )
    near = originals.withColumnRenamed("turn", "near_turn")
    # The two smallest conversations: one of them is not the reply's own.
    two = originals.withColumn("n", F.row_number().over(Window.partitionBy("hash").orderBy("conv_id"))).where("n <= 2")
    place = F.struct("conv_id", "turn")
    far = two.groupBy("hash").agg(F.min(place).alias("far"), F.max(place).alias("other"))
    met = keys.join(near, ["hash", "conv_id"], "left").join(far, "hash", "left")
    here = F.col("near_turn") < F.col("turn")
    away = F.when(F.col("far.conv_id") != F.col("conv_id"), F.col("far")).when(F.col("other.conv_id") != F.col("conv_id"), F.col("other"))
    linked = met.withColumn(
        "to", F.when(here, F.struct("conv_id", F.col("near_turn").alias("turn"))).otherwise(away)
    ).where("to is not null")
    best = linked.groupBy("row").agg(
        F.min(F.struct("level", (F.col("rank") > 1).alias("by_line"), F.when(here, 0).otherwise(1).alias("abroad"), "rank", "run", "to")).alias("best")
    )
    counts = passages.groupBy("row").agg(F.count("*").alias("n_quotes"), F.max("level").alias("max_level"))
    joined = stored(
        rows.join(counts, "row", "left").join(best, "row", "left").select(
            "row", "conv_id", "turn", "role", "body",
            F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("max_level", F.lit(0)).alias("max_level"),
            F.col("best.to.conv_id").alias("parent_conv"), F.col("best.to.turn").alias("parent_turn"),
        ),
        "replies",
    )
    threads = _threads(joined)
    return joined.join(threads, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "body", "n_quotes", "max_level", "parent_conv", "parent_turn",
        F.coalesce("thread_turn", F.when(F.col("conv_id").isNotNull(), F.col("turn"))).alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
    )


def _threads(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_turn, depth) of every reply to a message of its own conversation."""
    state = stored(
        replies.where("conv_id = parent_conv and parent_turn < turn")
        .groupBy("conv_id", "turn").agg(F.min("parent_turn").alias("up"))
        .select("conv_id", "turn", "up", F.lit(1).alias("depth")),
        "threads",
    )
    while True:
        above = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("top"), F.col("depth").alias("more"))
        step = state.join(above, ["conv_id", "up"], "left")
        if step.where("top is not null").isEmpty():
            return state.select("conv_id", "turn", F.col("up").alias("thread_turn"), "depth")
        state = stored(
            step.select("conv_id", "turn", F.coalesce("top", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")),
            "threads",
        )
