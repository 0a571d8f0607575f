"""Exact sliding quantiles of keys whose window does not fit into one task.

Every value enters its window at its time and leaves it one window later.  These
events, in common order, are cut into panes of a bounded number of events.  A pane
changes the window by no more than its own events, so the quantiles inside it lie
within a known range of ranks of what the window held at its start.  A grid of values
per key, with counts per pane, turns that range into a range of grid bins; only the
values of these bins are sent to the pane, equal ones added up, all others are counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions.scalars import MICROS, micros
from metricloom.operators.chunks import CHUNK, DAY, ordered_chunks
from metricloom.session import cut_lineage

#: Events of a pane, bins of the grid, panes that are looked up together.
PANE_EVENTS, BINS, BLOCK = 20_000, 256, 64
LEAVE, ENTER, ASK, HELD = 0, 1, 2, -1


class RankedCounts:
    """Counts of a fixed ascending list of values: change one, find the k-th."""

    def __init__(self, counts: np.ndarray):
        self.size = len(counts)
        self.top = 1 << max(0, self.size.bit_length() - 1)
        sums = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(1, self.size + 1)
        self.tree = [0, *(sums[at] - sums[at - (at & -at)]).tolist()]

    def add(self, place: int, n: int) -> None:
        place += 1
        while place <= self.size:
            self.tree[place] += n
            place += place & -place

    def find(self, k: int) -> int:
        """Place of the value with ``k`` others before it."""
        place, step = 0, self.top
        while step:
            if place + step <= self.size and self.tree[place + step] <= k:
                place += step
                k -= self.tree[place]
            step >>= 1
        return place


def pane_quantiles(kind: np.ndarray, at: np.ndarray, value: np.ndarray, n: np.ndarray, bins: np.ndarray, lo: int, hi: int, below: int, held: int, q: float) -> tuple[list, list]:
    """(times, quantiles) of the asking events of a pane, in the order given.

    Rows of kind ``HELD`` are the values of the bins ``lo`` to ``hi`` at the start of
    the pane; ``below`` of the ``held`` values lie in lower bins.
    """
    inside = (bins >= lo) & (bins <= hi) & (kind != ASK)
    known, place = np.unique(value[inside], return_inverse=True)
    where = np.full(len(value), -1)
    where[inside] = place
    start = kind == HELD
    counts = RankedCounts(np.bincount(where[start], n[start], len(known)).astype(np.int64))
    times, found = [], []
    lower = (bins < lo).tolist()
    for k, t, w, weight, low in zip(kind.tolist(), at.tolist(), where.tolist(), n.tolist(), lower):
        if k == HELD:
            continue
        if k == ASK:
            times.append(t)
            if not held:
                found.append(None)
                continue
            rank = q * (held - 1)
            first = int(rank)
            a = known[counts.find(first - below)]
            b = known[counts.find(first + 1 - below)] if first + 1 < held else a
            found.append(float(a + (b - a) * (rank - first)))
            continue
        change = weight if k == ENTER else -weight
        held += change
        if low:
            below += change
        elif w >= 0:
            counts.add(w, change)
    return times, found


def _brackets(net: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """(keys, pane, lo, hi, below, held) of every pane: one row per pane comes in, in
    order of its key, and one count per bin is all that is carried on."""
    kinds = {f.name: f.dataType.simpleString() for f in net.schema}
    named = ", ".join(f"`{c}` {kinds[c]}" for c in keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, counts = None, None
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                own = tuple(getattr(r, f"k{i}") for i in range(len(keys)))
                if counts is None or own != key:
                    key, counts = own, np.zeros(bins + 1, np.int64)
                held, sums = int(counts.sum()), np.cumsum(counts)
                least = int(r.q * (max(held - r.leaving, 1) - 1)) - r.entering
                most = int(r.q * (held + r.entering - 1)) + 1 + r.leaving
                lo = int(np.searchsorted(sums, least, side="right")) if 0 <= least < held else 0
                hi = int(np.searchsorted(sums, most, side="right")) if most < held else bins
                rows.append((*own, r.pane, lo, hi, int(sums[lo - 1]) if lo else 0, held))
                for x in r.changes:
                    counts[x["bin"]] += x["net"]
            yield pd.DataFrame(rows, columns=[*keys, "pane", "lo", "hi", "below", "held"], dtype=object)

    renamed = net.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], "pane", "q", "entering", "leaving", "changes")
    order = [f"k{i}" for i in range(len(keys))]
    ordered = renamed.repartition(*order).sortWithinPartitions(*order, "pane")
    return ordered.mapInPandas(run, f"{named}, pane bigint, lo int, hi int, below bigint, held bigint")


def sliding_quantile(
    points: DataFrame, keys: list[str], percentile: str, ts: str = "ts", value: str = "value", window_seconds: int = 3600,
    name: str = "percentile_value", events: int = PANE_EVENTS, bins: int = BINS,
) -> DataFrame:
    """(keys, ts, ``name``): exact linear quantile of (ts - window, ts] at every instant
    of a key; null where the window holds no value.  ``percentile`` is constant per key.
    """
    window = window_seconds * MICROS
    v = F.col(value).cast("double")
    base = points.select(*keys, ts, micros(ts).alias("_t"), (F.col(percentile) / 100.0).alias("_q"), F.when(~F.isnan(v), v).alias("_v"))
    cells = base.filter("_v is not null").groupBy(*keys, "_t", "_v").agg(F.count(F.lit(1)).alias("_n"))
    asks = base.select(*keys, "_t").distinct().select(*keys, "_t", F.lit(None).cast("double").alias("_v"), F.lit(0).cast("bigint").alias("_n"), F.lit(ASK).alias("_kind"), F.col("_t").alias("_at"))
    moves = F.explode(F.array(F.struct(F.lit(LEAVE).alias("_kind"), (F.col("_t") + window).alias("_at")), F.struct(F.lit(ENTER).alias("_kind"), F.col("_t").alias("_at"))))
    both = cells.withColumn("_m", moves).select(*keys, "_t", "_v", "_n", "_m.*")
    timed = both.unionByName(asks).withColumn("_when", F.timestamp_micros("_at").cast("timestamp_ntz"))
    cut = ordered_chunks(timed, keys, "_when", ["_kind", "_v"], DAY, events).drop("_when")
    grid = cells.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("_v", [i / bins for i in range(1, bins)], 10_000)).alias("_grid"))
    rates = base.groupBy(*keys).agg(F.max("_q").alias("q"))
    number = cut.select(*keys, CHUNK).distinct()
    number = number.withColumn("pane", F.row_number().over(Window.partitionBy(*keys).orderBy(CHUNK)).cast("bigint"))
    bin_of = F.when(F.col("_v").isNull(), -1).otherwise(F.size(F.filter("_grid", lambda g: g <= F.col("_v"))))
    placed = cut_lineage(cut.join(number, [*keys, CHUNK]).join(grid, keys, "left").withColumn("_bin", bin_of).drop(CHUNK, "_grid"))

    enters, leaves = F.when(F.col("_kind") == ENTER, F.col("_n")).otherwise(0), F.when(F.col("_kind") == LEAVE, F.col("_n")).otherwise(0)
    per_bin = placed.groupBy(*keys, "pane", "_bin").agg(F.sum(enters).alias("e"), F.sum(leaves).alias("l"))
    changes = F.collect_list(F.when(F.col("_bin") >= 0, F.struct(F.col("_bin").alias("bin"), (F.col("e") - F.col("l")).alias("net"))))
    net = per_bin.groupBy(*keys, "pane").agg(F.sum("e").alias("entering"), F.sum("l").alias("leaving"), changes.alias("changes")).join(rates, keys)
    brackets = cut_lineage(_brackets(net, keys, bins))

    # a value is held at the start of every pane after the one it enters in, up to the one it leaves in
    stays = placed.filter(F.col("_kind") != ASK).groupBy(*keys, "_t", "_v", "_n", "_bin").agg(F.min("pane").alias("came"), F.max("pane").alias("goes"))
    block = F.explode(F.sequence(F.floor((F.col("came") + 1) / BLOCK), F.floor(F.col("goes") / BLOCK)))
    listed = brackets.groupBy(*keys, F.floor(F.col("pane") / BLOCK).alias("_block")).agg(F.collect_list(F.struct("pane", "lo", "hi")).alias("_panes"))
    met = stays.filter("goes > came").withColumn("_block", block).join(listed, [*keys, "_block"])
    wanted = F.filter("_panes", lambda p: (p["pane"] > F.col("came")) & (p["pane"] <= F.col("goes")) & (p["lo"] <= F.col("_bin")) & (p["hi"] >= F.col("_bin")))
    held = met.withColumn("pane", F.explode(F.transform(wanted, lambda p: p["pane"]))).groupBy(*keys, "pane", "_v", "_bin").agg(F.sum("_n").alias("_n"))
    held = held.select(*keys, "pane", F.lit(HELD).alias("_kind"), F.lit(None).cast("bigint").alias("_at"), "_v", "_n", "_bin")
    rows = placed.select(*keys, "pane", "_kind", "_at", "_v", "_n", "_bin").unionByName(held)
    rows = rows.join(brackets.join(rates, keys), [*keys, "pane"])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_at", "_kind"], kind="stable", na_position="first")
        own = pdf.iloc[0]
        times, found = pane_quantiles(
            pdf["_kind"].to_numpy(), pdf["_at"].fillna(0).to_numpy(np.int64), pdf["_v"].to_numpy(float), pdf["_n"].to_numpy(np.int64), pdf["_bin"].to_numpy(),
            int(own["lo"]), int(own["hi"]), int(own["below"]), int(own["held"]), float(own["q"]),
        )
        same = {c: pd.Series([own[c]] * len(times), dtype=object) for c in keys}
        return pd.DataFrame({**same, "_at": times, name: pd.array(found, dtype="Float64")})

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + f", _at bigint, `{name}` double"
    out = rows.groupBy(*keys, "pane").applyInPandas(answer, schema)
    kind = points.schema[ts].dataType
    return out.select(*keys, F.timestamp_micros("_at").cast(kind).alias(ts), name)
