"""Density clustering as joins and aggregates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.operators.similarity import block_pairs, near_boxes
from metricloom.session import cut_lineage

#: Edges that a task folds into its forest at a time.
FOREST_EDGES = 1 << 20


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of the edges, each as edges from its nodes to the smallest one."""
    nodes, places = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = places[: len(u)], places[len(u) :]
    root = np.arange(len(nodes))
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    inner = root != np.arange(len(nodes))
    return nodes[inner], nodes[root[inner]]


def spanning_forest(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) replaced, partition by partition, by as few that connect the same
    nodes: a partition returns fewer rows than it has nodes, however many edges it reads."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += len(batch)
            if size >= FOREST_EDGES:
                held, size = [stars(*map(np.concatenate, zip(*held)))], 0
        if held:
            u, v = stars(*map(np.concatenate, zip(*held)))
            for at in range(0, len(u), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(u[at : at + 100_000]), pa.array(v[at : at + 100_000])], ["u", "v"])

    wide = edges.filter("u <> v").select(F.col("u").cast("bigint"), F.col("v").cast("bigint"))
    return wide.mapInArrow(fold, "u bigint, v bigint")


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node id of the component of every node: columns (node, root).

    Alternating star contraction (Kiveris et al., 2014): each round links nodes
    to the smallest known neighbour, so the rounds grow with the logarithm of
    the diameter.  A partition's edges are thinned to a forest before the first
    shuffle, so the rounds carry few edges a node.  Minima are partial aggregates joined back; no neighbour list
    is collected.  Every round is a written table.
    """
    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def large_star(e: DataFrame) -> DataFrame:
        linked = both(e)
        low = linked.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return linked.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(low.select("u", F.col("m").alias("v")))

    def settle(e: DataFrame) -> DataFrame:
        return cut_lineage(e.filter("u <> v").distinct())

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("bigint")), F.min("v")).first()

    current = settle(spanning_forest(edges))
    seen = mark(current)
    while True:
        current = settle(small_star(large_star(current)))
        now = mark(current)
        if now == seen:
            break
        seen = now
    roots = current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _names(prefix: str, size: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(size)]


def _box(columns: list[str]) -> list[Column]:
    """Bounding box of a group, one pair of columns per dimension."""
    return [f(c).alias(f"{name}{i}") for name, f in (("lo", F.min), ("hi", F.max)) for i, c in enumerate(columns)]


def _squares(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [p * p for p in parts])


def _gap2(size: int, lo: str, hi: str, o_lo: str, o_hi: str) -> Column:
    """Squared distance between two boxes given by column prefixes (a point is a box with lo = hi)."""
    return _squares([
        F.greatest(F.col(f"{o_lo}{i}") - F.col(f"{hi}{i}"), F.col(f"{lo}{i}") - F.col(f"{o_hi}{i}"), F.lit(0.0)) for i in range(size)
    ])


def _reach2(size: int, lo: str, hi: str, o_lo: str, o_hi: str) -> Column:
    """Squared distance between the farthest corners of two boxes."""
    return _squares([
        F.greatest(F.col(f"{o_hi}{i}") - F.col(f"{lo}{i}"), F.col(f"{hi}{i}") - F.col(f"{o_lo}{i}")) for i in range(size)
    ])


def _other(boxes: DataFrame, size: int) -> DataFrame:
    """The boxes as the other side of a pair."""
    return boxes.select(
        F.col("cell").alias("other"), *[F.col(c).alias(f"o_{c}") for p in ("lo", "hi") for c in _names(p, size)]
    )


def _cell_pairs(cells: DataFrame, size: int, eps2: float, **blocks: int) -> DataFrame:
    """Ordered pairs of different cells whose boxes are within eps.

    ``inside`` tells that even their farthest points are within eps.
    """
    lo, hi = _names("lo", size), _names("hi", size)

    def found(i: np.ndarray, j: np.ndarray, left: pd.DataFrame, right: pd.DataFrame, _: np.ndarray) -> pd.DataFrame:
        reach = np.zeros(len(i))
        for low, high in zip(lo, hi):
            a, b = (left[c].to_numpy()[i] for c in (low, high))
            c, d = (right[c].to_numpy()[j] for c in (low, high))
            widest = np.maximum(d - a, b - c)
            reach += widest * widest
        out = pd.DataFrame({"cell": left["cell"].to_numpy()[i], "other": right["cell"].to_numpy()[j], "inside": reach <= eps2})
        return out[out["cell"] != out["other"]]

    return near_boxes(cells.select("cell", *lo, *hi), "cell", lo, hi, eps2, found, "cell bigint, other bigint, inside boolean", **blocks)


def _touching(pairs: DataFrame, cores: DataFrame, boxes: DataFrame, size: int, eps2: float) -> DataFrame:
    """Of the given core-cell pairs, those with two core points within eps.

    Only points near the other cell's box are looked at, block by block; a task
    answers with at most one row per pair.
    """
    far = _other(boxes, size)
    back = pairs.select(F.col("other").alias("cell"), F.col("cell").alias("other"))
    axes = _names("x", size)

    def facing(wanted: DataFrame, id_name: str, first: str, second: str) -> DataFrame:
        near = _gap2(size, "x", "x", "o_lo", "o_hi") <= eps2
        return cores.join(wanted, "cell").join(far, "other").filter(near).select(
            F.col(first).alias("u"), F.col(second).alias("v"), F.col("rep").alias(id_name), *axes
        )

    def score(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if p.empty or q.empty:
            return pd.DataFrame(columns=["u", "v"])
        b = q[axes].to_numpy()
        for row in p[axes].to_numpy():
            if (((b - row) ** 2).sum(axis=1) <= eps2).any():
                return p[["u", "v"]].iloc[:1]
        return pd.DataFrame(columns=["u", "v"])

    left, right = facing(pairs, "probe", "cell", "other"), facing(back, "held", "other", "cell")
    return block_pairs(left, right, ["u", "v"], "probe", "held", score, "u bigint, v bigint").distinct()


def density_clusters(
    points: DataFrame, key: str, columns: list[str], eps: float = 0.3, min_points: int = 5
) -> DataFrame:
    """DBSCAN labels: (key, core, label); the label is the smallest core id, -1 is noise.

    Points are laid in cells so small that all points of a cell are neighbours.
    Exact copies are one weighted point.  A cell of enough weight is core as a
    whole; only the few points of light cells are compared one by one, and two
    core cells are linked by their boxes or, failing that, by one block search.
    So a dense region never turns into pairs of its points.  A border point
    joins the lowest core cluster in reach.  The key must be an integer.
    """
    eps2, size = eps * eps, len(columns)
    axes = _names("x", size)
    side = eps / len(columns) ** 0.5 * (1 - 1e-9)
    fine = F.array(*[F.floor(F.col(c) / F.lit(side)).cast("bigint") for c in columns])
    source = cut_lineage(points.select(F.col(key).cast("bigint").alias("id"), *columns))
    copies = source.groupBy(*columns).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    shaped = copies.withColumn("fine", fine)
    named = shaped.groupBy("fine").agg(
        F.min("rep").alias("cell"), F.sum("weight").alias("cell_weight"), *_box(columns)
    )
    cells = cut_lineage(named)
    base = cut_lineage(shaped.join(cells.select("fine", "cell", "cell_weight"), "fine").select(
        "rep", "weight", "cell", "cell_weight", *[F.col(c).alias(a) for c, a in zip(columns, axes)]
    ))
    pairs = cut_lineage(_cell_pairs(cells, size, eps2))
    light = base.filter(F.col("cell_weight") < min_points)

    def close(left: DataFrame, right: DataFrame) -> DataFrame:
        """Left points (rep, cell, x..) with right points (o_cell, o_x.., ...) of a partly reachable cell, within eps."""
        reach = pairs.filter(~F.col("inside")).select("cell", "other")
        apart = _squares([F.col(a) - F.col(f"o_{a}") for a in axes])
        return left.join(reach, "cell").join(right, F.col("other") == F.col("o_cell")).filter(apart <= eps2)

    def facing(rows: DataFrame, *payload: str) -> DataFrame:
        return rows.select(F.col("cell").alias("o_cell"), *[F.col(a).alias(f"o_{a}") for a in axes], *payload)

    whole = (
        light.select("rep", "cell").join(pairs.filter("inside").select("cell", "other"), "cell")
        .join(cells.select(F.col("cell").alias("other"), F.col("cell_weight").alias("w")), "other").select("rep", "w")
    )
    partly = close(light.select("rep", "cell", *axes), facing(base.withColumnRenamed("weight", "w"), "w")).select("rep", "w")
    around = whole.unionByName(partly).groupBy("rep").agg(F.sum("w").alias("near"))
    marked = cut_lineage(base.join(around, "rep", "left").withColumn(
        "core", (F.col("cell_weight") + F.coalesce("near", F.lit(0))) >= min_points
    ).select("rep", "cell", *axes, "core"))
    cores = marked.filter("core")
    boxes = cut_lineage(cores.groupBy("cell").agg(*_box(axes)))
    ends = (size, "lo", "hi", "o_lo", "o_hi")
    # pairs of a dense region are many: they meet ids of cells, and only those that may still link two components meet boxes
    near = pairs.filter("cell < other")
    named_cores = boxes.select("cell")
    whole_links = near.filter("inside").join(named_cores, "cell").join(named_cores.withColumnRenamed("cell", "other"), "other")
    known = connected_components(whole_links.select(F.col("cell").alias("u"), F.col("other").alias("v")))
    rooted = cut_lineage(named_cores.join(known.withColumnRenamed("node", "cell"), "cell", "left").select("cell", F.coalesce("root", "cell").alias("root")))
    apart = (
        near.filter(~F.col("inside")).join(rooted.withColumnRenamed("root", "_r"), "cell")
        .join(rooted.select(F.col("cell").alias("other"), F.col("root").alias("_s")), "other").filter("_r <> _s").select("cell", "other")
    )
    linked = cut_lineage(
        apart.join(boxes, "cell").join(_other(boxes, size), "other")
        .filter(_gap2(*ends) <= eps2).select("cell", "other", (_reach2(*ends) <= eps2).alias("sure"))
    )
    sure = linked.filter("sure").select(F.col("cell").alias("u"), F.col("other").alias("v"))
    open_pairs = linked.filter(~F.col("sure")).select("cell", "other")
    roots = connected_components(
        rooted.select(F.col("cell").alias("u"), F.col("root").alias("v")).unionByName(sure).unionByName(_touching(open_pairs, cores, boxes, size, eps2))
    )
    # cells are named by their smallest point; a cluster by its smallest core point
    core_cells = cores.groupBy("cell").agg(F.min("rep").alias("lowest")).join(
        roots.withColumnRenamed("node", "cell"), "cell", "left"
    ).withColumn("root", F.coalesce("root", "cell"))
    clusters = core_cells.groupBy("root").agg(F.min("lowest").alias("label"))
    cell_labels = cut_lineage(core_cells.join(clusters, "root").select("cell", "label"))
    core_labels = cores.join(cell_labels, "cell").select("rep", "label", F.lit(True).alias("core"))
    loose = marked.filter(~F.col("core")).select("rep", "cell", *axes)
    own = loose.join(cell_labels, "cell").select("rep", "label")
    reached = (
        loose.select("rep", "cell").join(pairs.filter("inside").select("cell", "other"), "cell")
        .join(cell_labels.select(F.col("cell").alias("other"), "label"), "other").select("rep", "label")
    )
    labelled = facing(cores.join(cell_labels, "cell"), "label")
    border = (
        own.unionByName(reached).unionByName(close(loose, labelled).select("rep", "label"))
        .groupBy("rep").agg(F.min("label").alias("label")).withColumn("core", F.lit(False))
    )
    labels = core_labels.unionByName(border)
    back = source.join(copies.select(*columns, "rep"), columns).join(labels, "rep", "left")
    return back.select(
        F.col("id").alias(key), F.coalesce("core", F.lit(False)).alias("core"), F.coalesce("label", F.lit(-1)).alias("label")
    )
