"""Chat formatting of reply trees (DataFrame functions only).

Messages form trees (``parent`` is another message of the same tree, or null
at a root). Self-joins by pointer doubling give every message its depth, its
score sum to the root and its ancestors at distances 1, 2, 4, ...; leaves are
ranked by path score, and the chosen leaves walk up through the same distances
from large to small, so a path of n messages takes 2 log2(n) joins and every
(leaf, ancestor) pair is made once. Each path becomes one text:

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n ...

Control strings inside texts are escaped reversibly: ``<|`` becomes ``<\\|``,
``<\\|`` becomes ``<\\\\|`` and so on, so an escaped text never holds ``<|``.
Roles are percent-encoded for ``%``, newline and ``<``.

Defined results: null text or role counts as empty; an unknown parent makes
the message a root; of several messages with one (tree, node) id the smallest
(parent, role, text, score) counts; a null tree id is one tree and null node
ids are one node of it; messages in or below a parent cycle have no root and
give no path; ties of path score go to the longer path, then the smaller leaf
id as text; a null score counts as 0; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from settlekit.llm.common import written

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def encode_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def decode_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _id(c: Column) -> Column:
    """Ids as text with null as a value of its own."""
    return F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n"))


def format_paths(messages: DataFrame, tree: str = "tree_id", node: str = "node_id", parent: str = "parent_id",
                 role: str = "role", text: str = "text", score: str | None = None,
                 max_paths: int | None = None, loss_role: str = "assistant") -> DataFrame:
    """One row per chosen root-to-leaf path of every tree.

    Returns tree (as given), path_rank long, leaf (as given), path_score
    double, n_turns long, formatted string, loss_spans and loss_byte_spans
    (arrays of start, end; code points and UTF-8 bytes, end exclusive) of the
    texts of ``loss_role``. ``max_paths`` keeps that many paths of each tree,
    best score first; None keeps all.
    """
    col = lambda c: F.col(f"`{c}`")
    s = F.coalesce(col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    given = messages.select(
        col(tree).alias("tree"), col(node).alias("node"), _id(col(tree)).alias("t"), _id(col(node)).alias("n"),
        F.when(col(parent).isNotNull(), _id(col(parent))).alias("p"),
        F.coalesce(col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(col(text), F.lit("")).alias("text"), s.alias("s"))
    # one row per (tree, node); the struct keeps the values of one message together
    nodes = (given.groupBy("t", "n").agg(F.min(F.struct("p", "role", "text", "s", "tree", "node")).alias("m"))
             .select("t", "n", "m.*"))
    nodes = written(nodes, "chat-nodes")

    known = nodes.select("t", F.col("n").alias("p"), F.lit(True).alias("known"))
    base = nodes.select("t", "n", "p", "s")
    level = (base.where(F.col("p").isNotNull()).join(known, ["t", "p"], "left")
             .select("t", "n", F.when(F.col("known"), F.col("p")).alias("up"), "s")
             .unionByName(base.where(F.col("p").isNull()).select("t", "n", F.lit(None).cast("string").alias("up"), "s"))
             .withColumn("c", F.lit(1).cast("long")))
    level = written(level, "chat-level")
    parents = level.where(F.col("up").isNotNull()).select("t", F.col("up").alias("n"))
    total, jumps = level.count(), []
    while 2 ** len(jumps) <= total:
        active = level.where(F.col("up").isNotNull())
        if active.isEmpty():
            break
        jumps.append(active.select("t", "n", "up"))
        above = level.select("t", F.col("n").alias("up"), F.col("up").alias("up2"), F.col("s").alias("s2"), F.col("c").alias("c2"))
        level = written(active.join(above, ["t", "up"])
                        .select("t", "n", F.col("up2").alias("up"), (F.col("s") + F.col("s2")).alias("s"), (F.col("c") + F.col("c2")).alias("c"))
                        .unionByName(level.where(F.col("up").isNull())), "chat-level")
    rooted = level.where(F.col("up").isNull()).select("t", "n", "s", "c")

    leaves = rooted.join(parents, ["t", "n"], "left_anti")
    by_score = Window.partitionBy("t").orderBy(F.desc("s"), F.desc("c"), "n")
    chosen = leaves.withColumn("path_rank", F.row_number().over(by_score).cast("long"))
    if max_paths is not None:
        chosen = chosen.where(F.col("path_rank") <= max_paths)

    # (leaf, ancestor) pairs: every distance is a sum of the powers of two below
    path = chosen.select("t", F.col("n").alias("leaf"), "path_rank", F.col("s").alias("path_score"), F.col("c").alias("n_turns"),
                         "n", F.lit(0).cast("long").alias("d"))
    for k in reversed(range(len(jumps))):
        here = F.struct(F.col("n").alias("n"), F.col("d").alias("d"))
        up = F.struct(F.col("up").alias("n"), (F.col("d") + 2 ** k).alias("d"))
        path = (path.join(jumps[k], ["t", "n"], "left")
                .withColumn("x", F.explode(F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, up))))
                .select("t", "leaf", "path_rank", "path_score", "n_turns", F.col("x.n").alias("n"), F.col("x.d").alias("d")))

    turns = path.join(nodes.select("t", "n", "role", "text", "tree", "node"), ["t", "n"])
    header = F.concat(F.lit(START), encode_role(F.col("role")), F.lit("\n"))
    body, tail = escape(F.col("text")), f"{END}\n"
    turns = (turns.select("t", "leaf", "path_rank", "path_score", "n_turns", "tree",
                          F.when(F.col("d") == 0, F.struct("node")).alias("leaf_node"),
                          (F.col("n_turns") - F.col("d")).alias("i"), (F.col("role") == loss_role).alias("loss"),
                          header.alias("header"), body.alias("body"))
             .withColumn("piece", F.concat("header", "body", F.lit(tail))))
    before = Window.partitionBy("t", "leaf").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)

    def spans(length):
        start = (F.coalesce(F.sum(length(F.col("piece"))).over(before), F.lit(0)) + length(F.col("header"))).cast("long")
        return F.struct(start.alias("start"), (start + length(F.col("body"))).alias("end"))

    turns = turns.select("t", "leaf", "path_rank", "path_score", "n_turns", "tree", "leaf_node", "i", "loss", "piece",
                         spans(F.char_length).alias("span"), spans(F.octet_length).alias("byte_span"))
    gathered = turns.groupBy("t", "leaf").agg(
        F.first("tree").alias("tree"), F.first("path_rank").alias("path_rank"),
        F.max("leaf_node").alias("leaf_node"), F.first("path_score").alias("path_score"), F.first("n_turns").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("i", "piece", "loss", "span", "byte_span"))).alias("x"))
    masked = F.filter("x", lambda e: e["loss"])
    return gathered.select(
        F.col("tree").alias(tree), "path_rank", F.col("leaf_node.node").alias("leaf"), "path_score", "n_turns",
        F.array_join(F.transform("x", lambda e: e["piece"]), "").alias("formatted"),
        F.transform(masked, lambda e: e["span"]).alias("loss_spans"),
        F.transform(masked, lambda e: e["byte_span"]).alias("loss_byte_spans"))


def parse(formatted: Column) -> Column:
    """Turns (array of role, text) read back from a formatted text."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda p: F.char_length(p) > 0)

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        size = F.char_length(head)
        text = F.substr(p, size + 2, F.char_length(p) - size - F.lit(1 + len(END) + 1))
        return F.struct(decode_role(head).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def masked_text(formatted: Column, byte_spans: Column) -> Column:
    """Unescaped text under a loss mask, nothing between the spans."""
    # bytes, because cutting code points out of a long text counts from its start each time
    return F.transform(F.array(formatted.cast("binary")), lambda b: F.array_join(F.transform(
        byte_spans, lambda x: unescape(F.decode(
            F.substr(b, (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")), "UTF-8"))), ""))[0]


def linear_messages(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations given as numbered turns, as reply chains.

    Turns are ordered by (turn, role, text), nulls first; every row is a
    message, repeated rows too.
    """
    order = Window.partitionBy(F.col(f"`{conv}`")).orderBy(F.col(f"`{turn}`"), F.col(f"`{role}`"), F.col(f"`{text}`"))
    i = F.row_number().over(order).cast("long")
    return turns.select(F.col(f"`{conv}`").alias("tree_id"), i.alias("node_id"), F.nullif(i - 1, F.lit(0)).alias("parent_id"),
                        F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
