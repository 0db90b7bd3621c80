"""Chat formatting from reply trees, by DataFrame operations only (operator 4).

Self-joins that double the distance each time give every leaf its ancestors, so a tree of depth n
takes log2(n) rounds; branches are ranked by score and each chosen branch becomes one formatted
conversation with a loss mask over the assistant's texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import Rounds, cut

#: The template's control strings. Escaping leaves no ``<|`` inside roles and texts.
START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escape(col: Column) -> Column:
    """Double every backslash, then break every ``<|`` by a backslash, so no control string is left."""
    return F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(col: Column) -> Column:
    return F.regexp_replace(col, r"(?s)\\(.)", "$1")


def replies_of_turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turn tables as reply trees: ``tree, node, parent, role, text, score``; each row answers the one before.

    Rows go by turn, ties by role and text; repeated rows are turns of their own. Null roles and
    texts are empty. Rows whose conversation is null form one conversation with a null id.
    """
    order = Window.partitionBy("tree").orderBy("_turn", "role", "text")
    plain = rows.select(
        F.col(conv_id).alias("tree"),
        F.col(turn).alias("_turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    node = F.row_number().over(order).cast("long")
    numbered = plain.select("tree", node.alias("node"), "role", "text")
    numbered = cut(numbered)
    return numbered.select("tree", "node", F.expr("if(node > 1, node - 1, null)").alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def branches(replies: DataFrame) -> DataFrame:
    """Every (leaf, ancestor) pair of reply trees: ``tree, leaf, node, up`` with ``up`` steps from leaf to node.

    A leaf is a node that nobody answers. After round k each leaf has the ancestors fewer than
    2**k steps up, and each node's jump points 2**k steps up; the pairs are the output's own size.
    Parents that do not exist end a branch, as does a node that answers itself. Nodes of longer
    cycles have no root: they, and leaves above them, give no branch. No path has more nodes than the
    largest tree, so jumps that are left after log2 of its size belong to cycles, of whatever length.
    """
    links = cut(replies.select("tree", "node", "parent").where("node is not null").groupBy("tree", "node").agg(F.max("parent").alias("parent")))
    largest = links.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    known = links.select("tree", F.col("node").alias("parent"))
    has_parent = links.where("parent is not null and parent <> node")
    same_tree = F.expr("a.tree <=> b.tree")
    jumps = has_parent.alias("a").join(known.alias("b"), same_tree & F.expr("a.parent = b.parent")).select("a.tree", "a.node", F.col("a.parent").alias("to"))
    tables = Rounds(replies.sparkSession)
    jumps = tables.put("jumps0", jumps)
    answered = jumps.select("tree", F.col("to").alias("node")).distinct()
    leaves = links.alias("a").join(answered.alias("b"), same_tree & F.expr("a.node = b.node"), "left_anti")
    pairs = [tables.put("pairs0", leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")))]
    k, step, more = 0, 1, not jumps.isEmpty()
    while more and step < largest:
        k += 1
        so_far = reduce(DataFrame.unionByName, pairs)
        further = so_far.alias("a").join(jumps.alias("b"), same_tree & F.expr("a.node = b.node")).select("a.tree", "a.leaf", F.col("b.to").alias("node"), (F.col("a.up") + step).alias("up"))
        pairs.append(tables.put(f"pairs{k}", further))
        jumps = tables.put(f"jumps{k}", jumps.alias("a").join(jumps.alias("b"), same_tree & F.expr("a.to = b.node")).select("a.tree", "a.node", F.col("b.to").alias("to")))
        tables.drop(f"jumps{k - 1}")
        step, more = step * 2, not jumps.isEmpty()
    found = reduce(DataFrame.unionByName, pairs)
    if more:
        found = found.alias("a").join(jumps.alias("b"), same_tree & F.expr("a.leaf = b.node"), "left_anti")
    found = cut(found)
    tables.drop()
    return found


def reply_tree_chats(replies: DataFrame, best: int | None = None, loss_role: str = LOSS_ROLE) -> DataFrame:
    """Format the branches of reply trees: ``tree, leaf, branch_rank, score, n_turns, formatted, loss_spans``.

    ``replies`` has ``tree, node, parent, role, text, score``, nodes unique within their tree. A
    branch's score is the sum of its nodes' scores (null: 0); ranks go by score downwards, ties by
    leaf; ``best`` keeps that many branches a tree (a top-k feature), None keeps all. Texts and
    roles that are null count as empty. ``loss_spans`` are code-point ranges of ``formatted``, end
    exclusive, one for each text of ``loss_role``. A branch is one string, so it must fit in one
    row; its turns meet in one task, each with its own text only. Branches are found and ranked
    without texts, which are shuffled to meet the chosen branches and to be put together.
    """
    head = F.concat(F.lit(START), escape(F.coalesce("role", F.lit(""))), F.lit(SEPARATOR))
    body = escape(F.coalesce("text", F.lit("")))
    turns = replies.select("tree", "node", "score", (F.coalesce("role", F.lit("")) == loss_role).alias("loss"), head.alias("head"), body.alias("body"))
    sizes = turns.select("tree", "node", F.coalesce("score", F.lit(0.0)).alias("score"), "loss", F.length("head").cast("long").alias("skip"), F.length("body").cast("long").alias("size"))
    same_node, same_leaf = F.expr("a.tree <=> b.tree and a.node = b.node"), F.expr("a.tree <=> b.tree and a.leaf = b.leaf")
    paths = cut(branches(replies).alias("a").join(sizes.alias("b"), same_node).select("a.tree", "a.leaf", "a.node", "a.up", "b.score", "b.loss", "b.skip", "b.size"))

    so_far = Window.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    piece = F.col("skip") + F.col("size") + len(END) + 1
    placed = paths.withColumn("start", F.sum(piece).over(so_far) - piece + F.col("skip"))
    span = F.when(F.col("loss"), F.struct("start", (F.col("start") + F.col("size")).alias("end")))
    scored = placed.groupBy("tree", "leaf").agg(F.sum("score").alias("score"), F.count("*").alias("n_turns"), F.sort_array(F.collect_list(span)).alias("loss_spans"))
    ranked = scored.withColumn("branch_rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    if best is not None:
        ranked = ranked.where(F.col("branch_rank") <= best)
    ranked = cut(ranked)

    chosen = paths.alias("a").join(ranked.alias("b"), same_leaf, "left_semi").select("tree", "leaf", "node", "up")
    pieces = F.concat("b.head", "b.body", F.lit(END + "\n"))
    on_path = chosen.alias("a").join(turns.alias("b"), same_node).select("a.tree", "a.leaf", F.struct((-F.col("a.up")).alias("at"), pieces.alias("piece")).alias("turn"))
    in_order = F.sort_array(F.collect_list("turn"))
    put = on_path.groupBy("tree", "leaf").agg(F.array_join(F.transform(in_order, lambda t: t["piece"]), "").alias("formatted"))
    return ranked.alias("a").join(put.alias("b"), same_leaf).select("a.tree", "a.leaf", "branch_rank", "score", "n_turns", "formatted", "loss_spans")


def turns_of(formatted: Column) -> Column:
    """Read a formatted conversation back: an array of structs ``role, text``."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)
    return F.transform(
        pieces,
        lambda piece: F.struct(
            unescape(F.substring_index(piece, SEPARATOR, 1)).alias("role"),
            unescape(F.substring_index(F.substring_index(piece, SEPARATOR, -1), END, 1)).alias("text"),
        ),
    )


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")
