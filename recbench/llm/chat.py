"""Operator 2, chat formatting: root-to-leaf paths of reply trees, ranked by score, one conversation for each chosen path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, text_of

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Put one more backslash between < and | wherever only backslashes stand there; so no text holds a control string."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    """As escape, and a role stays on one line."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    """The reverse of escape_role: each backslash with what follows it, from left to right."""
    marked = F.regexp_extract_all(unescape(role), F.lit(r"(?s)(\\.|[^\\])"), F.lit(1))
    return F.array_join(F.transform(marked, lambda x: F.when(x == "\\n", F.lit("\n")).when(x == "\\\\", F.lit("\\")).otherwise(x)), "")


def root_to_leaf_paths(nodes: DataFrame, tables: Tables, top: int = 1) -> DataFrame:
    """(tree, path, position, node) of the best `top` paths of each tree.

    nodes: (tree, node, parent, score). Ancestors are found by self-joins that double the distance each time, so a
    thread of n replies takes log2(n) rounds. Each round is a written table. A path's score is the sum of its nodes'
    scores (null: 0); ties go to the smaller leaf. A node whose parent isn't in its tree is a root; nodes in a cycle
    lie on no path.
    """
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("_known")).distinct()
    jump = nodes.join(known, ["tree", "parent"], "left").groupBy("tree", "node").agg(F.min(F.when(F.col("_known"), F.col("parent"))).alias("up"), F.max(F.coalesce("score", F.lit(0.0))).alias("score"))
    jumps = [tables.write(jump.withColumn("depth", F.lit(1).cast("long")), "jump0")]
    most = 1
    while not jumps[-1].filter("up is not null").isEmpty() and most <= jumps[0].count():
        # Only nodes that haven't reached their root go on; the others stay as they are.
        b = jumps[-1].select("tree", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("score").alias("_score"), F.col("depth").alias("_depth"))
        on = jumps[-1].filter("up is not null").join(b, ["tree", "up"]).select("tree", "node", F.col("_up").alias("up"), (F.col("score") + F.col("_score")).alias("score"), (F.col("depth") + F.col("_depth")).alias("depth"))
        jumps.append(tables.write(jumps[-1].filter("up is null").select(*on.columns).unionByName(on), f"jump{len(jumps)}"))
        most *= 2
    parents = jumps[0].filter("up is not null").select("tree", F.col("up").alias("node")).distinct()
    leaves = jumps[-1].filter("up is null").join(parents, ["tree", "node"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.col("score").desc(), F.col("node"))
    chosen = leaves.withColumn("path", F.row_number().over(best)).filter(F.col("path") <= top)
    found = chosen.select("tree", "path", "node", F.col("depth").alias("position"))
    for k in range(len(jumps) - 2, -1, -1):
        up = jumps[k].filter("up is not null").select("tree", "node", "up")
        more = found.join(up, ["tree", "node"]).select("tree", "path", F.col("up").alias("node"), (F.col("position") - (1 << k)).alias("position"))
        # Written, as the next round reads it twice.
        found = tables.write(found.unionByName(more), f"found{k}")
    return found


def format_reply_trees(messages: DataFrame, tables: Tables, top: int = 1, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per chosen path: tree, path (rank from 1), n_turns, formatted, loss_mask.

    messages: (tree, node, parent, role, text, score). A turn is written as the start mark, role, newline, text, end
    mark, newline. Control strings inside texts and roles are escaped reversibly. loss_mask: (start, length) in code
    points of the texts of loss_roles in formatted.

    Null text or role: empty. Null tree: a tree of its own. Rows that repeat (tree, node): the least by (parent,
    role, text) stays. Empty table: no rows. Other columns are ignored. One conversation is one value, so it must fit
    in a task; all else is dealt out by (tree, node).
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("tree").cast("string")), F.lit("null"))
    rows = messages.select(F.col("tree").alias("_tree"), key.alias("tree"), "node", "parent", text_of(F.col("role")).alias("role"), text_of(F.col("text")).alias("text"), F.col("score").cast("double").alias("score"))
    rows = tables.write(rows.groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score", "_tree")).alias("m")).select("tree", "node", "m.*"), "messages")
    paths = root_to_leaf_paths(rows.select("tree", "node", "parent", "score"), tables, top)
    turns = paths.join(rows.select("tree", "node", "_tree", "role", "text"), ["tree", "node"])
    turns = turns.withColumn("_text", escape(F.col("text"))).withColumn("_head", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))).withColumn("_turn", F.concat("_head", "_text", F.lit(f"{END}\n")))
    before = Window.partitionBy("tree", "path").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("_start", F.coalesce(F.sum(F.length("_turn")).over(before), F.lit(0)) + F.length("_head"))
    turns = turns.withColumn("_loss", F.when(F.col("role").isin(*loss_roles), F.struct(F.col("_start").cast("long").alias("start"), F.length("_text").cast("long").alias("length"))))
    whole = turns.groupBy("tree", "path").agg(F.first("_tree").alias("_tree"), F.sort_array(F.collect_list(F.struct("position", "_turn", "_loss"))).alias("_turns"))
    return whole.select(F.col("_tree").alias("tree"), F.col("path").cast("long").alias("path"), F.size("_turns").cast("long").alias("n_turns"), F.array_join("_turns._turn", "").alias("formatted"), F.filter("_turns._loss", lambda x: x.isNotNull()).alias("loss_mask"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    parts = F.split(formatted, r"<\|im_start\|>")
    parts = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.transform(parts, lambda x: F.struct(unescape_role(F.substring_index(x, "\n", 1)).alias("role"), unescape(F.substr(x, F.instr(x, "\n") + 1, F.length(x) - F.instr(x, "\n") - len(f"{END}\n"))).alias("text")))


def linear_threads(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as reply trees in which every turn answers the one before."""
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(by_turn).cast("long"))
    return rows.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
