"""Vectors within a cosine of each other, by a pigeonhole over subspaces.

Unit vectors at a cosine of ``c`` lie at a squared distance of 2 - 2c.  A fixed
rotation spreads that distance over all axes; the axes are cut into blocks, and a
linked pair must stay within a block's proportional share of the distance in one
block at least.  So every block is range-joined under its own budget: vectors lie in
cells along the block's leading axes, and visit the neighbour cells that the budget
reaches.  A pair counts in its first block within budget, there it is verified exactly
in double precision, so no pair is counted twice and none has to be emitted: a task
returns link counts and a spanning forest.

The vectors are dealt into parts of bounded size by hash, and two parts meet in one
task, which joins all blocks: a vector moves once for each part, not for each cell, and
is rotated where it is compared.

Defined cases: equal vectors are one node with a multiplicity before anything is
joined; nodes have numbers of their own, ids only name the components.  Vectors that
are null, empty, zero or hold null or non-finite components link with nothing, nor do
vectors of different sizes; a null ``vec_id`` links with nothing and stays; rows that
repeat an id with unlike vectors are separate vectors.  Lengths do not matter: each
vector is scaled by a power of two before products are formed, so neither very small
nor very large components under- or overflow.  Other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.llm.common import small_or_merge
from metricloom.operators.clustering import connected_components
from metricloom.session import cut_lineage

SLACK = 1e-5  # of the squared distance, for single-precision rotated values
AXES, BLOCK_SIZE = 2, 8
#: Vectors are spread over this many parts before parts grow, if they have as many rows.
PARTS, SPREAD_ROWS = 8, 4096
FOUND = "a long, b long, links long"


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to [1/2, 1):
    exact, and products of components stay in range."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


@lru_cache(maxsize=8)
def rotation(size: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(size).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def blocks_of(size: int) -> list[slice]:
    n = max(1, size // BLOCK_SIZE)
    cuts = [size * i // n for i in range(n + 1)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:])]


def budgets(size: int, cosine: float) -> np.ndarray:
    share = np.array([b.stop - b.start for b in blocks_of(size)]) / size
    return (2 - 2 * cosine + SLACK) * share


def _pack(batches: Iterator[pa.RecordBatch], single: bool) -> Iterator[pa.RecordBatch]:
    """Rows (size, node, mult, vector); ``single`` keeps single-precision components in four bytes."""
    for batch in batches:
        values = batch.column("embedding")
        sizes = values.value_lengths().to_numpy()
        flat = values.flatten().to_numpy().astype(np.float32 if single else np.float64)
        ends = np.cumsum(sizes)
        own = pa.array([flat[end - size : end].tobytes() for size, end in zip(sizes, ends)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int32()), batch.column("node"), batch.column("mult"), own], ["size", "node", "mult", "vector"])


PACKED = "size int, node long, mult long, vector binary"


class Forest:
    """Union-find over rows, keeping the edges that join two trees."""

    def __init__(self, n: int):
        self.parent, self.edges = np.arange(n), []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.edges.append((i, j))


def cell_code(cells: np.ndarray) -> np.ndarray:
    code = np.zeros(len(cells), np.int64)
    for axis in cells.T:
        code = code * 100_003 + axis
    return code


def _join_parts(table: pa.Table, cosine: float, single: bool, tile: int = 1024) -> pa.Table:
    """Links inside one part, or between two parts."""
    size, lo, hi = (table.column(c)[0].as_py() for c in ("size", "lo", "hi"))
    node, mult, side = (table.column(c).to_numpy() for c in ("node", "mult", "side"))
    vectors = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float32 if single else np.float64).reshape(-1, size).astype(np.float64)
    vectors = scaled(vectors)
    norm = np.sqrt((vectors * vectors).sum(axis=1))
    turned = ((vectors / norm[:, None]) @ rotation(size)).astype(np.float32)
    cuts, budget = blocks_of(size), budgets(size, cosine)
    least = np.float32(cosine - 1e-4 - 2e-7 * size)  # of a single-precision cosine
    left_side, right_side = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
    links, forest = np.zeros(len(node), np.int64), Forest(len(node))

    def join_block(k: int) -> None:
        """Rows of the left side visit the cells of the right side that the budget reaches."""
        part = np.ascontiguousarray(turned[:, cuts[k]])
        square, ones = (part * part).sum(axis=1)[:, None], np.ones((len(node), 1), np.float32)
        # the product of these rows is a squared distance
        left_rows, right_rows = np.hstack([-2 * part, square, ones]), np.hstack([part, ones, square])
        along = part[:, min(AXES, part.shape[1] - 1)]  # sorted by an axis that the cells leave open
        lead = part[:, :AXES].astype(np.float64)
        reach = np.sqrt(budget[k]) + 1e-9
        home, low, high = (np.floor((lead + by) / (2 * reach)).astype(np.int64) for by in (0, -reach, reach))
        visitors, visited = [], []
        for step in np.array(np.meshgrid(*[(-1, 0, 1)] * lead.shape[1], indexing="ij")).reshape(lead.shape[1], -1).T:
            cell = home[left_side] + step
            r = ((cell >= low[left_side]) & (cell <= high[left_side])).all(axis=1)
            visitors.append(left_side[r])
            visited.append(cell_code(cell[r]))
        left, code = np.concatenate(visitors), np.concatenate(visited)
        order = np.lexsort((along[left], code))
        left, code = left[order], code[order]
        at_home = cell_code(home[right_side])
        order = np.lexsort((along[right_side], at_home))
        right, at_home = right_side[order], at_home[order]
        for cell in np.unique(at_home):
            i, j = (slice(*np.searchsorted(c, [cell, cell + 1])) for c in (code, at_home))
            meet(k, left[i], right[j], along, left_rows, right_rows)

    def meet(k: int, left: np.ndarray, right: np.ndarray, along: np.ndarray, left_rows: np.ndarray, right_rows: np.ndarray) -> None:
        """Compare rows ``left`` with rows ``right``, both sorted by ``along``."""
        reach = np.float32(np.sqrt(budget[k] + SLACK)) + np.float32(1e-6)
        place, facing = along[right], right_rows[right]
        for a in range(0, len(left), tile):
            i = left[a : a + tile]
            start = int(np.searchsorted(place, along[i[0]] - reach))
            stop = int(np.searchsorted(place, along[i[-1]] + reach, side="right"))
            for b in range(start, stop, 4 * tile):
                j = right[b : min(stop, b + 4 * tile)]
                hits = np.flatnonzero(left_rows[i] @ facing[b : b + len(j)].T <= np.float32(budget[k] + SLACK))
                for at in range(0, len(hits), 1 << 15):
                    x, y = np.divmod(hits[at : at + (1 << 15)], len(j))
                    verify(k, i[x], j[y])

    def verify(k: int, p: np.ndarray, q: np.ndarray) -> None:
        """Count a pair in the first block that holds it, if it is a link."""
        if lo == hi:  # a pair comes in both orders
            once = p < q
            p, q = p[once], q[once]
        likely = np.einsum("ij,ij->i", turned[p], turned[q]) >= least
        p, q = p[likely], q[likely]
        apart = turned[p].astype(np.float64) - turned[q]
        gaps = np.stack([(apart[:, c] ** 2).sum(axis=1) for c in cuts[: k + 1]], axis=1)
        first = (gaps[:, k] <= budget[k]) & ~(gaps[:, :k] <= budget[:k]).any(axis=1)
        p, q = p[first], q[first]
        good = np.einsum("ij,ij->i", vectors[p], vectors[q]) >= cosine * (norm[p] * norm[q])
        p, q = p[good], q[good]
        np.add.at(links, p, mult[q])
        np.add.at(links, q, mult[p])
        for u, v in zip(p, q):
            forest.join(u, v)

    for k in range(len(cuts)):
        join_block(k)
    linked = np.flatnonzero(links)
    edges = np.array(forest.edges, np.int64).reshape(-1, 2)
    a = np.concatenate([node[linked], node[edges[:, 0]]])
    b = np.concatenate([node[linked], node[edges[:, 1]]])
    n = np.concatenate([links[linked], np.zeros(len(edges), np.int64)])
    return pa.table({"a": pa.array(a), "b": pa.array(b), "links": pa.array(n)})


def part_pairs(nodes: DataFrame, single: bool, part_rows: int) -> DataFrame:
    """Every vector once for each part of its size, with the two parts that meet: ``lo`` and ``hi``, its own in ``side``."""
    size = F.size("embedding").alias("size")
    many = F.greatest(F.ceil(F.col("n") / part_rows), F.least(F.lit(PARTS), F.ceil(F.col("n") / SPREAD_ROWS))).cast("int")
    parts = cut_lineage(nodes.groupBy(size).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("size", many.alias("parts")))
    packed = nodes.select("node", "mult", "embedding").mapInArrow(lambda b: _pack(b, single), PACKED)
    spread = packed.join(small_or_merge(parts, parts.count(), 16, 8 << 20), "size")
    spread = spread.withColumn("side", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return spread.withColumns({"lo": F.least("side", "other"), "hi": F.greatest("side", "other")}).drop("parts", "other")


def vector_links(vectors: DataFrame, cosine: float = 0.9, part_rows: int = 32_768) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): n_links, component_id, kept.

    The vectors of a size are cut by hash into parts of about ``part_rows`` rows, or
    of fewer rows while there are under ``PARTS``; a task holds two parts at most.
    """
    key = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")]
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    valid = rows.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0))).filter(usable)  # -0.0 equals 0.0
    groups = valid.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("mult"))
    nodes = cut_lineage(groups.withColumn("node", F.monotonically_increasing_id()))
    if nodes.isEmpty():
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    single = vectors.schema["embedding"].dataType.elementType == T.FloatType()
    spread = part_pairs(nodes, single, part_rows)
    found = cut_lineage(spread.groupBy("size", "lo", "hi").applyInArrow(lambda t: _join_parts(t, cosine, single), FOUND))
    counts = cut_lineage(found.filter("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links")))
    roots = connected_components(found.filter("links = 0 and a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")))
    # only now do ids come in: the smallest of a component names it
    names = cut_lineage(roots.join(nodes.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("name")))
    named = nodes.join(counts, "node", "left").join(roots, "node", "left").join(names, "root", "left")
    named = cut_lineage(named.select(*key, (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("name", "least").alias("component_id")))
    plain = rows.withColumn("embedding", F.when(usable, F.transform("embedding", lambda x: x + F.lit(0.0))))
    joined = plain.select("vec_id", F.when(F.col("embedding").isNotNull(), key[0]).alias("h1"), F.when(F.col("embedding").isNotNull(), key[1]).alias("h2")).join(named, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
