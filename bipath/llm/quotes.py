"""Conversations rebuilt from quotations, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bipath.llm.asof import latest_before
from bipath.operators.indexing import running_total
from bipath.runtime import written

_MARKS = "^((?:> ?)*)"
# How a line that introduces a quotation begins and ends, in the languages of the test tables.
ATTRIBUTION = r"(?i)^\s*(on|am|le|el)\s.*\s(wrote|schrieb[^:]*|a écrit|escribió)\s*:\s*$"
PART_WORDS = 4  # of a line or paragraph within a quoted block; fewer are common talk and name no message


def parsed_lines(body: Column) -> Column:
    """array<struct<level, text>>: how many quote marks open each line, and what follows them."""
    lines = F.split(F.coalesce(body, F.lit("")), "\r?\n")

    def parsed(line):
        marks = F.regexp_extract(line, _MARKS, 1)
        level = F.length(F.regexp_replace(marks, " ", ""))
        return F.struct(level.alias("level"), F.substring(line, F.length(marks) + 1, F.length(line)).alias("text"))

    return F.transform(lines, parsed)


def without_attributions(lines: Column) -> Column:
    """The lines but those that introduce a quotation, right above a line of a deeper level."""
    deeper = F.slice(lines, F.lit(2), F.size(lines))
    marked = F.zip_with(
        lines, deeper,
        lambda x, below: F.struct(x.alias("line"), ((below["level"] > x["level"]) & x["text"].rlike(ATTRIBUTION)).alias("introduces")),
    )
    return F.transform(F.filter(marked, lambda x: ~F.coalesce(x["introduces"], F.lit(False))), lambda x: x["line"])


def at_level(lines: Column, level: Column) -> Column:
    """The text of one quote level."""
    return F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == level), lambda x: x["text"]), "\n")


def _normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, "\\s+", " ")))


def passages(lines: Column, level: Column) -> Column:
    """array<struct<size, key>> of one quote level: all of it, each unbroken block, and its paragraphs and lines.

    A paragraph or line of a quoted block only counts with ``PART_WORDS`` words: a common short one next to others says nothing.
    Keys are hashes without regard to case and white space, each once; what is left empty has none.
    """
    cut = "\x1e"
    blocks = F.array_join(F.transform(lines, lambda x: F.when(x["level"] == level, x["text"]).otherwise(cut)), "\n")
    whole = F.transform(F.concat(F.array(at_level(lines, level)), F.split(blocks, cut)), _normal)
    parts = F.transform(F.concat(F.split(blocks, f"{cut}|\n\\s*\n"), F.split(blocks, f"{cut}|\n")), _normal)
    parts = F.filter(parts, lambda x: (level == 0) | (F.size(F.split(x, " ")) >= PART_WORDS))
    normal = F.array_distinct(F.concat(whole, parts))
    return F.transform(
        F.filter(normal, lambda x: x != ""), lambda x: F.struct(F.length(x).alias("size"), F.sha2(x, 256).alias("key"))
    )


def link_quotes(messages: DataFrame) -> DataFrame:
    """(msg_id, sent, parent_id, own): each message with the message it replies to and its text without quotes.

    The passages of each quote level, whole and in parts, are looked up among the parts of the own texts of
    earlier messages. The parent is the latest message with the longest passage of the lowest level at which one is found, so
    a reply to a lost message hangs on the one which that quoted.
    """
    lines = messages.select("msg_id", "sent", parsed_lines(F.col("body")).alias("lines"))
    lines = lines.select("msg_id", "sent", without_attributions(F.col("lines")).alias("lines"))
    own = at_level(F.col("lines"), F.lit(0))
    texts = written(lines.select("msg_id", "sent", F.trim(own).alias("own"), "lines"), "messages")
    levels = F.array_distinct(F.transform("lines", lambda x: x["level"]))
    parts = texts.select("msg_id", "sent", "lines", F.explode(levels).alias("level"))
    parts = parts.select("msg_id", "sent", "level", F.explode(passages(F.col("lines"), F.col("level"))).alias("part"))
    both = parts.select(
        "msg_id", "sent", "level", "part.size", "part.key", F.when(F.col("level") == 0, F.col("msg_id")).alias("said"),
        (F.col("level") == 0).cast("int").alias("_own"),
    )
    # Of one message the quotes come before its own text, so that it never answers itself.
    found = latest_before(both, "key", ["sent", "msg_id", "_own"], "said", "parent_id")
    parents = found.filter("level > 0 AND parent_id IS NOT NULL").groupBy("msg_id").agg(
        F.min_by("parent_id", F.struct("level", -F.col("size"), "key")).alias("parent_id")
    )
    return texts.select("msg_id", "sent", "own").join(parents, "msg_id", "left")


def conversations(messages: DataFrame) -> DataFrame:
    """(thread_id, position, msg_id, parent_id, depth, text): all messages, replies after what they answer.

    ``messages`` has msg_id (unique, not null), sent (orderable) and body; other columns are ignored.
    thread_id is the msg_id at the root, position counts from 0 in the order of sending, which puts every
    reply after its parent. Null or empty bodies are messages without text that nobody can quote. Where several messages
    share a passage, a quote means the latest earlier one. A quote counts if all of it, one of its blocks, or one of their lines or
    paragraphs of ``PART_WORDS`` words is all, a paragraph or a line of a text; a part of a line is none. Lines that introduce a
    quotation belong to no text. Rows with a null msg_id are ignored; of rows that share one, any one's place in the thread counts for all.

    Roots are found by doubling: each round every message jumps to the root of its current ancestor, so the
    number of rounds is the logarithm of the longest thread. Positions come from running totals over range
    partitions; no thread has to fit a task.
    """
    linked = written(link_quotes(messages.filter(F.col("msg_id").isNotNull())), "links")
    state = written(
        linked.select("msg_id", F.col("parent_id").alias("up"), F.when(F.col("parent_id").isNotNull(), 1).otherwise(0).cast("long").alias("depth")),
        "roots",
    )
    while True:
        above = state.select(F.col("msg_id").alias("up"), F.col("up").alias("upper"), F.col("depth").alias("more"))
        jumped = state.join(above, "up", "left").select(
            "msg_id",
            F.coalesce("upper", "up").alias("up"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.col("upper").isNotNull().alias("moved"),
        )
        state = written(jumped, "roots")
        moved = state.filter("moved").limit(1).count()
        state = state.drop("moved")
        if not moved:
            break
    whole = linked.join(state, "msg_id").select(
        F.coalesce("up", "msg_id").alias("thread_id"), "msg_id", "sent", "parent_id", "depth", F.col("own").alias("text")
    )
    counted = running_total(
        whole.withColumn("one", F.lit(1)), F.col("thread_id"), F.col("sent"), F.col("msg_id"), value="one", name="before"
    )
    starts = counted.groupBy("thread_id").agg(F.min("before").alias("start"))
    return counted.join(starts, "thread_id").select(
        "thread_id", (F.col("before") - F.col("start")).alias("position"), "msg_id", "parent_id", "depth", "text"
    )
