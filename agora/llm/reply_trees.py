"""Chat formatting from reply trees.

Messages form trees: each row names its parent. Iterative self-joins list, for
every leaf, the messages on its path to the root; the paths of a tree are ranked
by their score, and each chosen path becomes one formatted conversation.

Template (ChatML-like): each turn is ``<|im_start|>`` role newline text
``<|im_end|>`` newline. Inside roles and texts ``&``, ``<`` and ``[`` (and the
newline inside a role) are written as character references, so no control
string — neither this template's nor ``</s>``, ``[INST]`` and the like — can
arise from data, and the writing is reversible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agora.session import write_shared

TURN_BEGIN, TURN_END = "<|im_start|>", "<|im_end|>\n"
#: Reversible writing of control characters; ``&`` first, and last when read back.
_TEXT = [("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")]
_ROLE = [*_TEXT, ("\n", "&#10;")]


def _replaced(c: Column, pairs) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(c: Column, role: bool = False) -> Column:
    return _replaced(c, _ROLE if role else _TEXT)


def unescape(c: Column) -> Column:
    return _replaced(c, [(b, a) for a, b in reversed(_ROLE)])


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """``(tree, leaf, node, up)``: every node on the path from each leaf to its
    root, ``up`` steps above the leaf.

    ``nodes``: ``(tree, node, parent)`` with non-null ``tree`` and ``node``; a
    null parent, or one that isn't in the tree, makes a root. The k-th self-join
    extends all paths by up to 2^k ancestors at once and squares the jump table,
    so a chain of n turns takes log2(n) rounds. Ids must be unique in a tree. Nodes on a cycle have no
    leaf and so give no path; a branch that runs into a cycle never reaches a
    root, and is dropped when as many steps as there are nodes are exceeded.
    """
    ids = nodes.select("tree", "node", "parent")
    known = ids.select("tree", F.col("node").alias("parent"))
    jump = write_shared(ids.join(known, ["tree", "parent"], "left_semi")
                        .select("tree", "node", F.col("parent").alias("to")), "jump")
    inner = jump.select("tree", F.col("to").alias("node")).distinct()
    paths = (ids.join(inner, ["tree", "node"], "left_anti")
             .select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")))
    paths = write_shared(paths, "paths")
    largest, step = None, 1
    while not jump.isEmpty():
        if largest is None:
            largest = ids.groupBy("tree").count().agg(F.max("count")).first()[0]
        if step > largest:  # only jumps round a cycle are left
            endless = paths.join(jump, ["tree", "node"], "left_semi").select("tree", "leaf").distinct()
            return paths.join(endless, ["tree", "leaf"], "left_anti")
        further = paths.join(jump, ["tree", "node"]).select(
            "tree", "leaf", F.col("to").alias("node"), (F.col("up") + step).alias("up"))
        paths = write_shared(paths.unionByName(further), "paths")
        second = jump.select("tree", F.col("node").alias("to"), F.col("to").alias("next"))
        jump = write_shared(jump.join(second, ["tree", "to"]).select(
            "tree", "node", F.col("next").alias("to")), "jump")
        step *= 2
    return paths


def format_trees(messages: DataFrame, best: int = 1) -> DataFrame:
    """Format the ``best`` best-scored root-to-leaf paths of every tree.

    ``messages``: ``tree`` (not null), ``node`` (long, unique in its tree),
    ``parent`` (null: root), ``role``, ``text``, ``score`` (of one message; a
    path scores their sum, null counts 0). Ties go to the smaller leaf. Null
    roles and texts count as empty; an empty table gives an empty table; other
    columns are ignored.

    Returns ``tree, rank, leaf, path_score, n_turns, formatted`` and
    ``loss_spans``: array of (start, length) in code points of ``formatted``, one
    per assistant turn, covering its escaped text.
    """
    own = messages.select("tree", "node", "parent", "role", "text", F.col("score").cast("double").alias("score"))
    on_path = leaf_paths(own).join(own.drop("parent"), ["tree", "node"])
    scored = on_path.groupBy("tree", "leaf").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("path_score"))
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("path_score"), F.asc("leaf")))
    chosen = scored.withColumn("rank", rank).filter(F.col("rank") <= best)

    role = F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(TURN_BEGIN), escape(role, True), F.lit("\n"))
    body = escape(F.coalesce("text", F.lit("")))
    turns = (on_path.join(chosen, ["tree", "leaf"])
             .groupBy("tree", "leaf", "rank", "path_score")
             .agg(F.sort_array(F.collect_list(F.struct(
                 (-F.col("up")).alias("at"), (role == "assistant").alias("learn"),
                 head.alias("head"), body.alias("body")))).alias("turns")))
    formatted = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(TURN_END))))
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"),
                 F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + len(TURN_END)).cast("long").alias("at"),
            F.when(t["learn"], F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + F.length(t["head"])).cast("long").alias("start"),
                F.length(t["body"]).cast("long").alias("length"))))).otherwise(acc["spans"]).alias("spans")))
    return turns.select("tree", F.col("rank").cast("int").alias("rank"), "leaf", "path_score",
                        F.size("turns").cast("long").alias("n_turns"),
                        formatted.alias("formatted"), spans["spans"].alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from formatted conversations."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b: b != "")
    # a block ends with the control string; all before it is role, newline, text
    inner = F.transform(blocks, lambda b: F.substring(b, F.lit(1), F.length(b) - len(TURN_END)))
    return F.transform(inner, lambda b: F.struct(
        unescape(F.substring_index(b, "\n", 1)).alias("role"),
        unescape(F.substring(b, F.length(F.substring_index(b, "\n", 1)) + 2, F.length(b))).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """Unescaped text under the loss mask, spans in order, nothing between."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(
        F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))))


def as_chain(rows: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """Linear conversations as trees: each row replies to the one before it by
    ``turn`` (nulls first, then role and text). A null conversation id names one
    conversation of its own. ``conversation`` stays as column ``id``."""
    key = F.coalesce(F.concat(F.lit("="), F.col(conversation).cast("string")), F.lit("null"))
    at = F.row_number().over(W.partitionBy("tree").orderBy(
        F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text")))
    named = rows.select(key.alias("tree"), F.col(conversation).alias("id"), F.col(turn).alias("turn"),
                        F.col(role).alias("role"), F.col(text).alias("text"))
    return (named.withColumn("node", at.cast("long"))
            .withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))
            .withColumn("score", F.lit(0.0)))
