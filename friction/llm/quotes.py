"""Quotation linking, in DataFrame operations only.

Lines that begin with > marks are quotes, as deep as they have marks. Adjacent lines of one level form a passage. A
passage, its paragraphs and its lines are hashed after normalisation and joined to the same units of what messages say
themselves; of all messages of a conversation that say it, the earliest is the original. A message replies to the
original of its shallowest quote. Following replies by doubling gives each message's thread and depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from friction.llm.common import dropped, written

MARKS = r"^((?:[ \t]*>)+)"
QUOTED = r"(?m)^[ \t]*>"
#: A line that announces a quote and is not part of what the message says.
ANNOUNCES = r"(?i)\bwrote:\s*$"
MESSAGE = ["conv_id", "turn"]


def normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[\s ]+", " ")))


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, run, level, body: adjacent lines of one quote level, of each distinct message with a quote.

    One message's lines are sorted together; nothing else meets."""
    rows = messages.where(F.col("text").rlike(QUOTED)).select(*MESSAGE, "text").distinct().withColumn("mid", F.xxhash64("text"))
    lines = rows.select(*MESSAGE, "mid", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    level = F.length(F.regexp_replace(F.regexp_extract("line", MARKS, 1), r"[^>]", ""))
    lines = lines.select(*MESSAGE, "mid", "pos", level.alias("level"), F.regexp_replace("line", MARKS + " ?", "").alias("line"))
    order = Window.partitionBy(*MESSAGE, "mid").orderBy("pos")
    announces = (F.col("level") == 0) & F.col("line").rlike(ANNOUNCES) & (F.lead("level", 1, 0).over(order) > 0)
    change = (F.col("level") != F.lag("level", 1, -1).over(order)).cast("int")
    lines = lines.select("*", announces.alias("announces"), change.alias("change")).withColumn("run", F.sum("change").over(order))
    line = F.when(~F.col("announces"), F.struct("pos", "line"))
    grouped = lines.groupBy(*MESSAGE, "mid", "run", "level").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return grouped.select(*MESSAGE, "mid", "run", "level", F.array_join(F.col("lines.line"), "\n").alias("body"))


def units(rows: DataFrame, body: str) -> DataFrame:
    """A row for each distinct unit of a text (whole, paragraph, line): its digest and length."""
    all_units = F.array_distinct(F.concat(F.array(body), F.split(body, r"\n[ \t]*\n"), F.split(body, r"\n")))
    rows = rows.withColumn("unit", F.explode(F.transform(all_units, normal))).where("unit <> ''")
    return rows.withColumn("unit_length", F.length("unit")).withColumn("unit", F.unhex(F.sha2("unit", 256))).drop(body)


def link_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, run, level, source_turn: each quoted passage with the message it was first said in (null: none)."""
    parts = written(passages(messages), "passages")
    return _links(messages, parts)


def _own(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """conv_id, turn, mid, own_text: what messages with quotes say themselves."""
    said = F.when(F.col("level") == 0, F.struct("run", "body"))
    own = parts.groupBy(*MESSAGE, "mid").agg(F.array_sort(F.collect_list(said)).alias("said"), F.max("level").alias("quote_depth"))
    return own.select(*MESSAGE, "mid", F.regexp_replace(F.array_join(F.col("said.body"), "\n"), r"^\s+|\s+$", "").alias("own_text"), "quote_depth")


def _links(messages: DataFrame, parts: DataFrame) -> DataFrame:
    quotes = parts.where("level > 0")
    plain = messages.where(F.col("text").isNotNull() & ~F.col("text").rlike(QUOTED)).select(*MESSAGE, F.col("text").alias("own_text"))
    talks = quotes.select("conv_id").distinct()
    said = plain.unionByName(_own(messages, parts).select(*MESSAGE, "own_text")).join(talks, "conv_id", "left_semi")
    originals = units(said, "own_text").groupBy("conv_id", "unit").agg(F.min("turn").alias("source_turn"))
    found = units(quotes, "body").join(originals, ["conv_id", "unit"]).where(F.col("source_turn") < F.col("turn"))
    best = F.max_by("source_turn", F.struct("unit_length", -F.col("source_turn")))
    found = found.groupBy(*MESSAGE, "mid", "run", "level").agg(best.alias("source_turn"))
    return quotes.select(*MESSAGE, "mid", "run", "level").join(found, [*MESSAGE, "mid", "run", "level"], "left")


def threads(parents: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn, thread_turn, depth of each reply (conv_id, turn, parent_turn), by doubling."""
    state = written(parents.select(*MESSAGE, "parent_turn", F.col("parent_turn").alias("thread_turn"), F.lit(1).alias("depth")), "threads")
    while True:
        up = state.select(F.col("conv_id").alias("up_conv"), F.col("turn").alias("up_turn"), F.col("thread_turn").alias("up_thread"), F.col("depth").alias("up_depth"))
        joined = state.join(up, (F.col("conv_id") == F.col("up_conv")) & (F.col("thread_turn") == F.col("up_turn")), "left")
        if joined.where("up_turn is not null").isEmpty():
            return state
        before = state
        state = written(joined.select(*MESSAGE, "parent_turn", F.coalesce("up_thread", "thread_turn").alias("thread_turn"), (F.col("depth") + F.coalesce("up_depth", F.lit(0))).alias("depth")), "threads")
        dropped(before)


def link_conversations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, own_text, quote_depth, parent_turn, thread_turn, depth, reply_order: one row for each row of
    messages (conv_id, turn, role, text; others ignored).

    own_text is the text without quotes and the lines that announce them. parent_turn is null where no quote links to an
    earlier message of the conversation; such a message starts a thread, at depth and reply_order 0. In a thread replies
    are numbered by turn, so none is before what it replies to. A null text stays null, a text of quotes alone has an
    empty own_text. A null conv_id or turn links to nothing. Of rows that repeat a turn those with quotes share the links of all of them.
    An empty table gives an empty result; texts of any length are parsed whole."""
    rows = messages.select(*MESSAGE, "role", "text")
    parts = written(passages(rows), "passages")
    links = _links(rows, parts).where("source_turn is not null")
    parents = links.groupBy(*MESSAGE).agg(F.max_by("source_turn", F.struct(-F.col("level"), F.col("source_turn"))).alias("parent_turn"))
    replies = threads(parents)
    number = F.row_number().over(Window.partitionBy("conv_id", "thread_turn").orderBy("turn"))
    replies = replies.withColumn("reply_order", number)
    plain = rows.where(F.col("text").isNull() | ~F.col("text").rlike(QUOTED)).select(*MESSAGE, "role", F.col("text").alias("own_text"), F.lit(0).alias("quote_depth"))
    quoting = rows.where(F.col("text").rlike(QUOTED)).select(*MESSAGE, "role", F.xxhash64("text").alias("mid"))
    own = _own(rows, parts)
    same = [quoting[c].eqNullSafe(own[c]) for c in [*MESSAGE, "mid"]]
    quoting = quoting.join(own, same[0] & same[1] & same[2], "left").select(quoting.conv_id, quoting.turn, "role", "own_text", "quote_depth")
    linked = quoting.join(replies, MESSAGE, "left")
    first = [F.lit(None).cast("long").alias("parent_turn"), F.col("turn").alias("thread_turn"), F.lit(0).alias("depth"), F.lit(0).alias("reply_order")]
    linked = linked.select(*MESSAGE, "role", "own_text", "quote_depth", "parent_turn", F.coalesce("thread_turn", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("reply_order", F.lit(0)).alias("reply_order"))
    return plain.select("*", *first).unionByName(linked)
