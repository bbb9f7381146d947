"""Chat formatting: reply trees to formatted conversations, with DataFrame functions only.

Template, for each turn: ``<turn ROLE>``, a line feed, the text, ``</turn>``, a line feed. Inside roles and texts a
backslash is doubled and a backslash is put into every ``<turn`` and ``</turn`` (in roles also before ``>``), so no
text can open or close a turn; dropping one backslash before any character restores the text exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import staged

OPEN, CLOSE = "<turn ", "</turn>\n"


def escaped(text: Column, role: bool = False) -> Column:
    out = F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), "<(?=/?turn)", "<\\\\")
    return F.replace(out, F.lit(">"), F.lit("\\>")) if role else out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def root_to_leaf_paths(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """Members of the chosen root-to-leaf paths: path_id (the leaf), node, dist (steps above the leaf), rank.

    ``messages``: id, parent (null or unknown: a root), score. Self-joins double the distance of each round's jumps:
    the jump table takes every node 2^k steps up, and each path found so far is copied 2^k steps further up, so a
    tree of depth d needs log2(d) rounds and no more rows than the paths have members. Leaves are ranked per root by
    the mean score of their path (null counts as 0), then by length (longer first), then by id; ``best`` keeps that
    many per root, None keeps all. Members of a cycle reach no root and are in no path. Ids must be unique.
    """
    known = messages.select(F.col("id").alias("parent"))
    links = messages.join(known, "parent", "left_semi").select("id", "parent")
    leaves = messages.join(links.select(F.col("parent").alias("id")).distinct(), "id", "left_anti")
    jumps = staged(links.select("id", F.col("parent").alias("up")), "chat-jumps")
    paths = staged(leaves.select(F.col("id").alias("path_id"), F.col("id").alias("node"), F.lit(0).cast("long").alias("dist")), "chat-paths")
    step, limit = 1, messages.count()
    while step <= limit and not jumps.isEmpty():
        further = paths.join(jumps.withColumnRenamed("id", "node"), "node").select("path_id", F.col("up").alias("node"), (F.col("dist") + step).alias("dist"))
        paths = staged(paths.unionByName(further), "chat-paths")
        jumps = staged(jumps.join(jumps.select(F.col("id").alias("up"), F.col("up").alias("top")), "up").select("id", F.col("top").alias("up")), "chat-jumps")
        step *= 2
    scored = paths.join(messages.select(F.col("id").alias("node"), F.coalesce("score", F.lit(0.0)).alias("score")), "node")
    branches = scored.groupBy("path_id").agg(F.avg("score").alias("score"), F.count("*").alias("length"), F.max_by("node", "dist").alias("root"))
    order = [F.desc("score"), F.desc("length"), F.asc("path_id")]
    branches = branches.withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy(*order)))
    chosen = branches if best is None else branches.where(F.col("rank") <= best)
    return paths.join(chosen.select("path_id", "rank", "length"), "path_id")


def linear_replies(conversations: DataFrame) -> DataFrame:
    """Rows conv_id, turn, role, text as messages: each row replies to the one before it in its conversation.

    Rows go by turn (null first), then role, then text; repeated rows stay. Null roles and texts become
    empty. A null conv_id is one conversation of its own.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = rows.withColumn("place", place.cast("long"))
    key = lambda p: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), p.cast("string"))
    return rows.select(
        "conv_id", "role", "text", key(F.col("place")).alias("id"), F.lit(None).cast("double").alias("score"),
        F.when(F.col("place") > 1, key(F.col("place") - 1)).alias("parent"),
    )


def format_conversations(messages: DataFrame, best: int | None = 1, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per chosen path: path_id, rank, conv_id, formatted, loss_spans (array of start, end in code points).

    ``messages``: conv_id, id, parent, role, text, score. The loss spans cover the (escaped) texts of the roles in
    ``learn``. A path is one output row, so its turns meet in one task; paths of one root may share turns.
    """
    paths = root_to_leaf_paths(messages, best)
    turns = paths.join(messages.select(F.col("id").alias("node"), "conv_id", "role", "text"), "node").select(
        "path_id", "rank", "conv_id",
        F.struct(
            (-F.col("dist")).alias("place"),
            F.concat(F.lit(OPEN), escaped(F.col("role"), role=True), F.lit(">\n")).alias("head"), escaped(F.col("text")).alias("body"),
            F.col("role").isin(*learn).alias("learn"),
        ).alias("turn"),
    )
    turns = turns.withColumn("turn", F.col("turn").withField("size", F.length("turn.head") + F.length("turn.body") + len(CLOSE)))
    whole = turns.groupBy("path_id", "rank", "conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t["head"])
        span = F.struct(begin.alias("start"), (begin + F.length(t["body"])).alias("end"))
        return F.struct((acc["at"] + t["size"]).alias("at"), F.when(t["learn"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("turns", start, add, lambda acc: acc["spans"])
    return whole.select("path_id", "rank", "conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation as array<struct<role, text>>, unescaped."""
    parts = F.slice(F.split(formatted, "</turn>\n"), 1, F.greatest(F.size(F.split(formatted, "</turn>\n")) - 1, F.lit(0)))

    def turn(part: Column) -> Column:
        head = F.regexp_extract(part, r"(?s)^<turn ((?:\\.|[^>\\])*+)>\n", 0)
        role = F.substring(head, F.lit(len(OPEN) + 1), F.length(head) - len(OPEN) - 2)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substring(part, F.length(head) + 1, F.length(part))).alias("text"))

    return F.transform(parts, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
