"""Chat formatting of reply trees: self-joins enumerate root-to-leaf paths, branches are ranked by score, and each chosen path
becomes one conversation in a template whose marks can't occur inside texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.llm.common import cut, drop

OPEN, MIDDLE, END = "### ", ": ", " </turn>\n"


def escape(text: Column) -> Column:
    r"""Backslash, "#" and "<" become \\, \h and \l (and ":" in roles \c), so no mark is left in a text."""
    for plain, coded in (("\\", "\\\\"), ("#", "\\h"), ("<", "\\l")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    parts = F.split(text, r"\\\\", -1)  # pairs of backslashes, from the left

    def one(x: Column) -> Column:
        for plain, coded in ((":", "\\c"), ("<", "\\l"), ("#", "\\h")):
            x = F.replace(x, F.lit(coded), F.lit(plain))
        return x

    return F.array_join(F.transform(parts, one), "\\")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def format_turns(turns: Column, learn_role: str = "assistant") -> tuple[Column, Column]:
    """The formatted conversation of an array of (role, text), and its loss mask: (start, length) spans in code points of the
    texts of learn_role."""
    head = lambda t: F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit(MIDDLE))
    pieces = F.transform(turns, lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == learn_role).alias("learn")))
    text = F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    empty = F.expr("named_struct('at', 0L, 'spans', cast(array() as array<struct<start: bigint, length: bigint>>))")

    def step(s, p):
        start, n = s["at"] + F.length(p["head"]), F.length(p["body"]).cast("long")
        span = F.when(p["learn"], F.array(F.struct(start.alias("start"), n.alias("length")))).otherwise(F.expr("cast(array() as array<struct<start: bigint, length: bigint>>)"))
        return F.struct((start + n + len(END)).alias("at"), F.concat(s["spans"], span).alias("spans"))

    return text, F.aggregate(pieces, empty, step, lambda s: s["spans"])


def parse_turns(formatted: Column) -> Column:
    """The array of (role, text) of a formatted conversation."""
    pieces = F.split(formatted, " </turn>\n", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    return F.transform(pieces, lambda p: F.struct(unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), MIDDLE, 1)).alias("role"), unescape(F.substr(p, F.instr(p, MIDDLE) + len(MIDDLE))).alias("text")))


def masked_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


MESSAGE = ["node", "parent", "tree", "role", "text", "score"]


def reply_paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, leaf, path_rank, turns) for each chosen root-to-leaf path of messages (node, parent, tree, role, text, score).

    Rows that repeat a node count once, as the smallest of them; rows without a node are left out; other columns are ignored.
    A parent that no message has makes a root. Siblings rank by falling score (null last), then node; paths rank by their
    branches from the root on; `best` keeps that many for each tree, None keeps all. Distances double with every pair of
    self-joins, so a path of n messages takes log2 n rounds. These rounds see names only; texts join the finished paths.
    Messages on a cycle, a self-parent included, and those below one reach no root and are left out before paths are
    enumerated. No messages: no rows.
    """
    rest = [c for c in MESSAGE if c != "node"]
    first = messages.select(*MESSAGE).where("node is not null").groupBy("node").agg(F.min(F.struct(*rest)).alias("m"))
    known = cut(first.select("node", *[F.col(f"m.{c}").alias(c) for c in rest]), "messages")
    slim = known.select("node", "parent", "tree", "score")
    siblings = Window.partitionBy("tree", "parent").orderBy(F.desc_nulls_last("score"), "node")
    linked = slim.join(known.select(F.col("node").alias("parent")), "parent", "left_semi").select("node", F.col("parent").alias("up"))
    nodes = cut(slim.withColumn("branch", F.row_number().over(siblings)).join(linked, "node", "left").select("node", "tree", "branch", "up"), "nodes")
    n = nodes.count()
    jumps, reach = [cut(nodes.where("up is not null").select("node", "up"), "jump")], 1
    while reach <= n and not jumps[-1].isEmpty():
        jump, reach = jumps[-1], 2 * reach
        jumps.append(cut(jump.join(jump.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", F.col("top").alias("up")), "jump"))
    # after more steps than messages only what never reaches a root is left
    leaves = nodes.join(nodes.select(F.col("up").alias("node")), "node", "left_anti").join(jumps[-1], "node", "left_anti")
    paths = cut(leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("depth")), "paths")
    for i, jump in enumerate(jumps[:-1]):
        more = paths.join(jump, "node").select("leaf", F.col("up").alias("node"), (F.col("depth") + 2**i).alias("depth"))
        before, paths = paths, cut(paths.union(more), "paths")
        drop(before)
        drop(jump)
    paths = paths.join(nodes.select("node", "tree", "branch"), "node")
    branches = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("at"), "branch"))), lambda x: x["branch"])
    if best is None:
        paths = paths.withColumn("path_rank", F.lit(None).cast("int"))
    else:
        order = Window.partitionBy("tree").orderBy("branches", "leaf")
        ranked = paths.groupBy("tree", "leaf").agg(branches.alias("branches")).withColumn("path_rank", F.row_number().over(order))
        paths = paths.join(ranked.where(F.col("path_rank") <= best).select("leaf", "path_rank"), "leaf")
    full = paths.join(known.select("node", "role", "text"), "node")
    parts = F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("at"), "role", "text")))
    found = full.groupBy("tree", "leaf", "path_rank").agg(parts.alias("parts"))
    return found.select("tree", "leaf", "path_rank", F.transform("parts", lambda p: F.struct(p["role"], p["text"])).alias("turns"))


def format_chats(messages: DataFrame, best: int | None = None, learn_role: str = "assistant") -> DataFrame:
    """(tree, leaf, path_rank, formatted, loss) for each path of reply_paths: the conversation as one text and its loss mask.
    Null roles and texts count as empty; see reply_paths for odd rows. No messages: no rows."""
    clean = messages.select(*MESSAGE).withColumn("role", F.coalesce(F.col("role").cast("string"), F.lit(""))).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    formatted, loss = format_turns(F.col("turns"), learn_role)
    return reply_paths(clean, best).select("tree", "leaf", "path_rank", formatted.alias("formatted"), loss.alias("loss"))


def chains(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as messages: each row replies to the row before. Rows go by turn, null first,
    then role and text; rows alike in all follow each other. Rows without a conv_id are one conversation. Other columns are
    ignored."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("at", F.row_number().over(order))
    name = lambda at: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")), at.cast("string"))
    parent = F.when(F.col("at") > 1, name(F.col("at") - 1))
    return rows.select(name(F.col("at")).alias("node"), parent.alias("parent"), F.col("conv_id").alias("tree"), "role", "text", F.lit(None).cast("double").alias("score"))
