"""Exact embedding near-duplicates by cover-tree dual traversal (operator 8).

Vectors of a label are dealt to the nearest of a few pivots and, where a pivot's cell is large, to
blocks by hash. Every block becomes a cover tree: nested levels of centres whose radii halve. Block
pairs, then node pairs inside them, are pruned by covering-radius bounds: pairs too far apart for
any link are skipped, pairs so close that all their vectors link are counted without comparing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import connected_components, cut

THRESHOLD = 0.93
#: Pivots of a label and vectors in a block.
PIVOTS, BLOCK = 16, 1024
#: Nodes of at most this many vectors are compared vector by vector.
LEAF = 32
#: Slack for rounding of distances; pairs within it are always compared as cosines.
SLACK = 1e-6


def _unit(vectors: pd.Series) -> np.ndarray:
    rows = np.array(vectors.tolist(), np.float64)
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


class Node:
    """A cover-tree node: ``rows`` lie within ``radius`` of the centre; children have half the level's radius."""

    __slots__ = ("centre", "centres", "children", "radii", "radius", "rows", "weight")

    def __init__(self, points: np.ndarray, weights: np.ndarray, apart: np.ndarray, rows: np.ndarray, level: float):
        self.rows, self.centre = rows, points[rows[0]]
        self.radius = float(apart[rows[0], rows].max())
        self.weight, self.children = int(weights[rows].sum()), []
        if len(rows) > LEAF and self.radius > 0:
            while level / 2 >= self.radius:
                level /= 2
            left = rows
            while len(left):  # centres more than level / 2 apart, each with what lies within level / 2 of it
                near = apart[left[0], left] <= level / 2
                self.children.append(Node(points, weights, apart, left[near], level / 2))
                left = left[~near]
        self.centres = np.array([c.centre for c in self.children or [self]])
        self.radii = np.array([c.radius for c in self.children or [self]])


class Block:
    """The vectors of one block with their tree, the counts of links found and a forest of them."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.weights = np.frombuffer(row["weights"], np.int64)
        self.points = np.frombuffer(row["points"], np.float64).reshape(len(self.ids), -1)
        self.counts = np.zeros(len(self.ids), np.int64)
        apart = _distances(self.points, self.points)
        np.fill_diagonal(apart, 0)
        self.tree = Node(self.points, self.weights, apart, np.arange(len(self.ids)), 2.0)


class Forest:
    """Edges that span the components of all edges added."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    def add(self, us: list[int], vs: list[int]) -> None:
        for u, v in zip(us, vs):
            p, q = self.root(u), self.root(v)
            if p != q:
                self.parent[max(p, q)] = min(p, q)
                self.edges.append((u, v))

    def star(self, hub: np.int64, others: np.ndarray) -> None:
        self.add([int(hub)] * len(others), others.tolist())


def _traverse(a: Block, b: Block, least: float) -> list[tuple[int, int]]:
    """Count all links between two blocks, or within one, and return edges that span them."""
    far = float(np.sqrt(max(0.0, 2 - 2 * least)))
    same, forest = a is b, Forest()

    def all_link(x: Node, y: Node) -> None:
        if same and x is y:
            a.counts[x.rows] += x.weight - a.weights[x.rows]
            forest.star(a.ids[x.rows[0]], a.ids[x.rows[1:]])
        else:
            a.counts[x.rows] += y.weight
            b.counts[y.rows] += x.weight
            forest.star(a.ids[x.rows[0]], b.ids[y.rows])
            forest.star(b.ids[y.rows[0]], a.ids[x.rows])

    def compare(x: Node, y: Node) -> None:
        close = a.points[x.rows] @ b.points[y.rows].T >= least
        if same and x is y:
            np.fill_diagonal(close, False)
            a.counts[x.rows] += close @ a.weights[x.rows]
        else:
            a.counts[x.rows] += close @ b.weights[y.rows]
            b.counts[y.rows] += close.T @ a.weights[x.rows]
        i, j = np.nonzero(close)
        forest.add(a.ids[x.rows[i]].tolist(), b.ids[y.rows[j]].tolist())

    work = [(a.tree, b.tree)]
    while work:
        x, y = work.pop()
        if not x.children and not y.children:
            compare(x, y)
            continue
        one = same and x is y
        apart = _distances(x.centres, y.centres)
        if one:
            np.fill_diagonal(apart, 0)
        reach = x.radii[:, None] + y.radii[None, :]
        inside = apart + reach < far - SLACK
        meet = apart - reach <= far + SLACK
        if one:
            meet = np.triu(meet)
        left, right = x.children or [x], y.children or [y]
        for i, j in zip(*map(np.ndarray.tolist, np.nonzero(meet))):
            if inside[i, j]:
                all_link(left[i], right[j])
            else:
                work.append((left[i], right[j]))
    return forest.edges


def _dual(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for left, right in zip(batch["left"], batch["right"]):
                a = Block(left)
                b = a if right is None else Block(right)
                edges = _traverse(a, b, least)
                counted = [(i, n) for block in ((a,) if a is b else (a, b)) for i, n in zip(block.ids.tolist(), block.counts.tolist()) if n]
                yield pd.DataFrame(
                    {"vec": [u for u, _ in edges] + [i for i, _ in counted], "other": pd.array([v for _, v in edges] + [None] * len(counted), "Int64"), "links": [0] * len(edges) + [n for _, n in counted]}
                )

    return run


def _block(batch: pd.DataFrame) -> pd.DataFrame:
    batch = batch.sort_values("rep")
    points = _unit(batch["vector"])
    centre = points.mean(axis=0)
    radius = float(np.sqrt(((points - centre) ** 2).sum(axis=1).max()))
    packed = {"ids": batch["rep"].to_numpy(np.int64).tobytes(), "weights": batch["weight"].to_numpy(np.int64).tobytes(), "points": points.tobytes()}
    return pd.DataFrame({"label": batch["label"].iloc[:1].to_numpy(), "block": batch["block"].iloc[:1].to_numpy(), "centre": [centre], "radius": [radius], "body": [packed]})


def _nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        cells = []
        for vector, pivots in zip(batch["vector"], batch["pivots"]):
            table = np.array([np.asarray(p, np.float64) for p in pivots if len(p) == len(vector)])
            table /= np.sqrt((table * table).sum(axis=1))[:, None]
            cells.append(int((table @ np.asarray(vector, np.float64)).argmax()) if len(table) else 0)
        yield batch[["label", "rep", "weight", "vector"]].assign(cell=cells)


def embedding_neardup(rows: DataFrame, least: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Exact links at cosine >= ``least`` within labels: ``id_col, n_links, component_id, kept``, one row per input row.

    Ids are integers. Vectors link only with vectors of the same length and label. Null labels, and
    vectors that are null, empty, zero or have null or non-finite components, link with nothing and
    are kept. ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest id
    reachable, ``kept`` says that a row is its component's first. Rows that share an id are vectors
    of their own that count each other if they link; a null id links with nothing.
    """
    usable = F.expr(
        "_id is not null and label is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vector, x -> x <> 0)"
    )
    all_rows = rows.select(F.col(id_col).alias("_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    good = all_rows.where(usable).withColumn("label", F.concat(F.col("label").cast("string"), F.lit("/"), F.size("vector").cast("string")))
    # Equal vectors are one point with a weight, however many they are.
    points = cut(good.groupBy("label", "vector").agg(F.min("_id").alias("rep"), F.count("*").alias("weight")).withColumn("rep_id", F.col("rep")))
    points = points.drop("rep").withColumn("rep", F.monotonically_increasing_id())
    points = cut(points)

    by_hash = Window.partitionBy("label").orderBy(F.xxhash64("vector"), "rep")
    pivots = points.select("label", "vector", F.row_number().over(by_hash).alias("rank"), "rep").where(F.col("rank") <= PIVOTS)
    pivots = pivots.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("rank", "vector"))).alias("p")).select("label", F.expr("transform(p, x -> x.vector)").alias("pivots"))
    celled = points.select("label", "rep", "weight", "vector").join(pivots, "label").mapInPandas(_nearest, "label string, rep bigint, weight bigint, vector array<double>, cell int")
    celled = cut(celled)
    parts = celled.groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = celled.join(parts, ["label", "cell"]).withColumn("block", F.concat_ws("/", "cell", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("string")))
    blocks = dealt.select("label", "block", "rep", "weight", "vector").groupBy("label", "block").applyInPandas(
        _block, "label string, block string, centre array<double>, radius double, body struct<ids: binary, weights: binary, points: binary>"
    )
    blocks = cut(blocks)

    gap = F.sqrt(F.expr("aggregate(zip_with(a.centre, b.centre, (x, y) -> (x - y) * (x - y)), 0d, (s, x) -> s + x)"))
    reach = F.lit(float(np.sqrt(max(0.0, 2 - 2 * least)) + SLACK)) + F.col("a.radius") + F.col("b.radius")
    heads = blocks.select("label", "block", "centre", "radius")
    meet = heads.alias("a").join(heads.alias("b"), F.expr("a.label = b.label and a.block <= b.block") & (gap <= reach))
    meet = meet.select("a.label", F.col("a.block").alias("_l"), F.col("b.block").alias("_r"))
    left = blocks.select("label", F.col("block").alias("_l"), F.col("body").alias("left"))
    right = blocks.select("label", F.col("block").alias("_r"), F.col("body").alias("right"))
    pairs = meet.join(left, ["label", "_l"]).join(right, ["label", "_r"]).select("left", F.expr("if(_l = _r, null, right)").alias("right"))
    found = cut(pairs.mapInPandas(_dual(least), "vec bigint, other bigint, links bigint"))

    classes = connected_components(found.where("other is not null").select(F.col("vec").alias("src"), F.col("other").alias("dst")))
    counts = found.where("other is null").groupBy(F.col("vec").alias("rep")).agg(F.sum("links").alias("links"))
    judged = points.join(counts, "rep", "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
    judged = judged.select("label", "vector", "rep_id", F.coalesce("links", F.lit(0)).alias("links"), "weight", F.coalesce("component", "rep").alias("_class"))
    first = judged.groupBy("_class").agg(F.min("rep_id").alias("_first"))
    judged = judged.join(first, "_class").select(F.col("label").alias("_label"), F.col("vector").alias("_vector"), (F.col("links") + F.col("weight") - 1).alias("links"), "_first")
    keyed = all_rows.withColumn("_label", F.when(usable, F.concat(F.col("label").cast("string"), F.lit("/"), F.size("vector").cast("string"))))
    out = keyed.join(judged, (keyed["_label"] == judged["_label"]) & (keyed["vector"] == judged["_vector"]), "left")
    component = F.coalesce("_first", "_id")
    return out.select(
        F.col("_id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"),
    )
