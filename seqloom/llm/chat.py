"""Chat formatting over reply trees, in DataFrame operations only.

Messages are nodes (tree, node, parent). Iterative self-joins enumerate every root-to-leaf path, branches are ranked
by score, and each chosen path is written as one conversation in a ChatML-like template. Control strings inside texts
are escaped by one backslash after their opening bracket, reversibly, and `parse` reads the output back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import cut, text_or_empty

START, END = "<|im_start|>", "<|im_end|>"
#: What may follow the opening bracket of a control string of this and other common templates.
_TAIL = r"(\||/?s>|/?INST\]|</?SYS>>)"
ESCAPE = (r"([<\[])(\\*)" + _TAIL, r"$1\\$2$3")
UNESCAPE = (r"([<\[])\\(\\*)" + _TAIL, r"$1$2$3")


def escape(text: Column) -> Column:
    """One backslash more between the bracket and the rest of every control string, escaped or not."""
    return F.regexp_replace(text, *ESCAPE)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, *UNESCAPE)


def _doubled(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(roots, jumps): tree, node, size, total (nodes and scores from a node to its root) of every node that has one;
    and tables (tree, node, to) of the ancestors 1, 2, 4, ... steps up.

    Each round joins every node's ancestor with that one's own, so depth d takes log2(d) rounds over narrow rows. Nodes
    on a cycle or below one have no root; they are left over when a path can't be longer.
    """
    known = nodes.select("tree", F.col("node").alias("parent"))
    up = nodes.where(F.col("parent").isNotNull()).select("tree", "node", "parent").join(known, ["tree", "parent"], "left_semi").distinct()
    state = cut(nodes.join(up.withColumnRenamed("parent", "to"), ["tree", "node"], "left").select("tree", "node", "to", F.lit(1).cast("long").alias("size"), F.col("score").alias("total")))
    longest = nodes.groupBy("tree").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    done, rest, jumps, step = [state.where(F.col("to").isNull())], state.where(F.col("to").isNotNull()), [], 1
    while step < longest and not rest.isEmpty():
        jumps.append(rest.select("tree", "node", "to"))
        on = reduce(DataFrame.unionByName, [*done, rest]).select("tree", F.col("node").alias("to"), F.col("to").alias("far"), F.col("size").alias("more"), F.col("total").alias("plus"))
        state = cut(rest.join(on, ["tree", "to"]).select("tree", "node", F.col("far").alias("to"), (F.col("size") + F.col("more")).alias("size"), (F.col("total") + F.col("plus")).alias("total")))
        done.append(state.where(F.col("to").isNull()))
        rest, step = state.where(F.col("to").isNotNull()), 2 * step
    return reduce(DataFrame.unionByName, done).select("tree", "node", "size", "total"), jumps


def reply_paths(nodes: DataFrame, per_tree: int = 1, max_depth: int | None = None) -> DataFrame:
    """(tree, leaf, branch_rank, depth, node) for the `per_tree` best root-to-leaf paths of each tree.

    nodes: tree, node, parent (null at a root), score (null: 0). A leaf is a node without replies. Self-joins of doubling
    length carry sums of scores to each leaf, branches rank by mean score of their nodes, best first, ties to the
    smaller leaf, and only the chosen leaves' ancestors are listed, again by doubling. A parent that isn't there makes
    its child a root. A cycle has no leaf, and what hangs off it no root: neither has a path. A (tree, node) that
    repeats is one node, of the least (parent, score), null first; a null tree or node takes no part. A path longer than
    a max_depth given is an error.
    """
    nodes = nodes.where(F.col("tree").isNotNull() & F.col("node").isNotNull()).select("tree", "node", "parent", F.coalesce(F.col("score"), F.lit(0.0)).alias("score"))
    nodes = cut(nodes.groupBy("tree", "node").agg(F.sort_array(F.collect_set(F.struct("parent", "score")))[0].alias("one")).select("tree", "node", "one.parent", "one.score"))
    roots, jumps = _doubled(nodes)
    leaves = roots.join(nodes.select("tree", F.col("parent").alias("node")), ["tree", "node"], "left_anti")
    order = Window.partitionBy("tree").orderBy((F.col("total") / F.col("size")).desc(), "node")
    best = leaves.withColumn("branch_rank", F.row_number().over(order)).where(F.col("branch_rank") <= per_tree)
    best = cut(best.select("tree", F.col("node").alias("leaf"), "branch_rank", "size"))
    if max_depth is not None and not best.where(F.col("size") > max_depth + 1).isEmpty():
        raise ValueError(f"a path is longer than {max_depth} replies")
    paths = best.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up"))
    for k, jump in enumerate(jumps):
        paths = cut(paths.unionByName(paths.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + (1 << k)).alias("up"))))
    return paths.join(best, ["tree", "leaf"]).select("tree", "leaf", "branch_rank", (F.col("size") - 1 - F.col("up")).alias("depth"), "node")


def format_turns(turns: DataFrame, by: list[str], order: str) -> DataFrame:
    """by, text, spans: the turns (role, text) of each group in `order`, as one templated string.

    A role is written URL-encoded, so that it has no line break or bracket. spans: start and length, in code points,
    of every assistant text in the string: the loss mask.
    """
    role, body = F.url_encode(text_or_empty("role")), escape(text_or_empty("text"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    turns = turns.select(*by, F.col(order).alias("at"), (text_or_empty("role") == "assistant").alias("learn"), F.concat(head, body, F.lit(END + "\n")).alias("all"), F.length(head).alias("lead"), F.length(body).alias("length"))
    # running starts within the group, which is shuffled and sorted once for them and for the string
    start = F.sum(F.length("all")).over(Window.partitionBy(*by).orderBy("at", "all").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("all") + F.col("lead")
    turns = turns.withColumn("start", start.cast("int"))
    rows = turns.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("at", "start", "learn", "length", "all"))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t.learn), lambda t: F.struct(t.start.alias("start"), t.length.alias("length")))
    return rows.select(*by, F.array_join(F.transform("turns", lambda t: t.all), "").alias("text"), spans.alias("spans"))


def parse(formatted: DataFrame, by: list[str]) -> DataFrame:
    """Read the strings back: by, text, spans, turns (array of role, text) and loss_text."""
    pieces = F.slice(F.split("text", r"<\|im_start\|>"), 2, F.size(F.split("text", r"<\|im_start\|>")))
    turns = F.transform(pieces, lambda p: F.struct(F.url_decode(F.substring_index(p, "\n", 1)).alias("role"), unescape(p.substr(F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p) - F.length(F.substring_index(p, "\n", 1)) - F.lit(len(END) + 2))).alias("text")))
    loss = F.array_join(F.transform("spans", lambda s: unescape(F.col("text").substr(s.start + 1, s.length))), "")
    return formatted.select(*by, "text", "spans", turns.alias("turns"), loss.alias("loss_text"))


def format_conversations(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """tree, leaf, branch_rank, text, spans: each chosen path of a reply tree as one conversation.

    messages: tree, node, parent, role, text, score. Null texts and roles are empty.
    """
    chosen = reply_paths(messages, per_tree).join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    return format_turns(chosen, ["tree", "leaf", "branch_rank"], "depth")


def linear_trees(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as trees without branches: each turn replies to the one before.

    Turns order by turn, then role, then text; repeated rows stay as turns of their own. A null conv_id is one
    conversation; a null turn comes first.
    """
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").withColumn("node", F.row_number().over(by).cast("long"))
    return rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
