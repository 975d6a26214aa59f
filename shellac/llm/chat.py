"""Chat formatting with Spark expressions only: turns are collected, sorted, merged and written into a marked template.

Template, for each run of turns with the same role::

    <|im_start|>role
    text<|im_sep|>text<|im_end|>

followed by a line feed. Texts and roles cannot hold a control string: every ``<``, backslashes, ``|`` in them gets one
backslash more, which reading back takes away again; a line feed in a role becomes ``<|im_nl|>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns whose spans are worked out together.
CHUNK = 256
START, END, SEP, NEWLINE = "<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|im_nl|>"


def escape(c: Column) -> Column:
    """Make a text free of ``<|`` reversibly."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    """Undo ``escape``."""
    return F.regexp_replace(c, r"<(\\*)\\\|", r"<$1|")


def format_chats(turns: DataFrame, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a conversation: conv_id, formatted, loss_spans (array of start, end in code points, one for each text of a
    learned role, control strings not included).

    Rows (conv_id, turn, role, text) are ordered by turn, then role, then text; a null turn comes first, null
    texts and roles are empty, rows with a null conv_id form one conversation, repeated rows are turns of their own.
    Neighbours with the same role share one header. An empty table gives no rows. A conversation becomes one string,
    so it has to fit one row, whatever the plan; rows of a conversation meet once, after its turns were escaped.
    """
    clean = F.struct(
        "turn",
        F.regexp_replace(escape(F.coalesce("role", F.lit(""))), "\n", NEWLINE).alias("role"),
        escape(F.coalesce("text", F.lit(""))).alias("text"),
        F.coalesce(F.col("role").isin(*learned), F.lit(False)).alias("learned"),
    )
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(clean)).alias("turns"))

    def parts(t: Column, i: Column) -> Column:
        same_before = F.coalesce(F.get("turns", i - 1)["role"] == t["role"], F.lit(False))
        same_after = F.coalesce(F.get("turns", i + 1)["role"] == t["role"], F.lit(False))
        head = F.when(same_before, F.lit(SEP)).otherwise(F.concat(F.lit(START), t["role"], F.lit("\n")))
        return F.struct(head.alias("head"), t["text"].alias("text"), F.when(same_after, F.lit("")).otherwise(F.lit(END + "\n")).alias("tail"), t["learned"].alias("learned"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def advance(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["text"])
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.struct((end + F.length(p["tail"])).alias("at"), F.when(p["learned"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    # spans inside runs of CHUNK parts, then the place of each run: appending copies, so one long run would cost its square
    merged = chats.select("conv_id", F.transform("turns", parts).alias("parts"))
    count = F.floor((F.size("parts") - 1) / CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), count), lambda k: F.aggregate(F.slice("parts", k * CHUNK + 1, F.lit(CHUNK)), zero, advance))
    begin = F.aggregate("chunks", F.array(F.lit(0)), lambda acc, c: F.array_append(acc, F.element_at(acc, -1) + c["at"]))
    moved = lambda c, k: F.transform(c["spans"], lambda s: F.struct((s["start"] + F.get("begin", k)).alias("start"), (s["end"] + F.get("begin", k)).alias("end")))
    placed = merged.withColumn("chunks", chunks).withColumn("begin", begin)
    return placed.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["text"], p["tail"])), "").alias("formatted"),
        F.flatten(F.transform("chunks", moved)).alias("loss_spans"),
    )


def read_turns(chats: DataFrame) -> DataFrame:
    """Turns read back from ``formatted``: conv_id, turns (array of role, text), loss_texts (the texts under the
    mask, in order)."""

    def run(block: Column) -> Column:
        at = F.instr(block, "\n")
        role = unescape(F.regexp_replace(F.substring(block, F.lit(1), at - 1), r"<\|im_nl\|>", "\n"))
        body = F.substring(block, at + 1, F.length(block) - at - len(END) - 1)
        return F.transform(F.split(body, r"<\|im_sep\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, 1 << 30)
    # the text is cut to what some spans cover before each is cut out, as cutting counts characters from the start
    count = F.floor((F.size("loss_spans") - 1) / CHUNK).cast("int")
    some = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(0))), lambda k: F.slice("loss_spans", k * CHUNK + 1, F.lit(CHUNK))), lambda x: F.size(x) > 0)

    def cut(x: Column) -> Column:
        first, last = F.element_at(x, 1)["start"], F.element_at(x, -1)["end"]
        own = F.array(F.struct(F.substring(F.col("formatted"), first + 1, last - first).alias("piece"), first.alias("first"), x.alias("spans")))
        return F.flatten(F.transform(own, lambda o: F.transform(o["spans"], lambda s: unescape(F.substring(o["piece"], s["start"] - o["first"] + 1, s["end"] - s["start"])))))

    return chats.select("conv_id", F.flatten(F.transform(blocks, run)).alias("turns"), F.flatten(F.transform(some, cut)).alias("loss_texts"), F.length("formatted").cast("long").alias("formatted_chars"))
