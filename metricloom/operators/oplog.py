"""Operation, rollback, container, snapshot and proposal logs."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.functions.scalars import MICROS, floor_time, micros, seconds_between
from metricloom.operators.chunks import (
    CHUNK, CHUNK_ROWS, DAY, in_order, ordered_chunks, positions, prefix_by_chunk, previous_values, running_total,
)
from metricloom.session import cut_lineage

BUCKET = 3600
# Timeouts and the number of cluster nodes.
OPERATION_TIMEOUT = 300
PROPOSAL_SECONDS = 30
COOLDOWN = 300
NODES = 3
#: A span of seconds that no key outgrows on either side of 1970.
AGE = 1 << 40
#: Lines of one row of a long text.
PART_LINES = 1000


def operation_metrics(points: DataFrame, operations: DataFrame, key: str, bucket_seconds: int = BUCKET) -> DataFrame:
    """Mean metric of each running operation per minute.

    The interval join is made an equi join: every operation is listed once per
    hour bucket it overlaps, points carry their own bucket, and the exact
    interval test follows.
    """
    width = bucket_seconds * MICROS
    bucket = lambda c: F.floor(micros(c) / F.lit(width)).cast("bigint")
    spans = operations.filter(F.col("completed_at") > F.col("created_at")).withColumn(
        "_b", F.explode(F.sequence(bucket("created_at"), bucket("completed_at")))
    )
    inside = (F.col("ts") >= F.col("created_at")) & (F.col("ts") < F.col("completed_at"))
    return (
        points.withColumn("_b", bucket("ts"))
        .join(spans, [key, "_b"])
        .filter(inside)
        .groupBy("operation_id", floor_time("ts", 60).alias("minute"))
        .agg(F.avg("value").alias("avg_value"), F.count(F.lit(1)).alias("n_points"))
    )


def history(
    log: DataFrame, kind: str, ts: str, key: str, value: str | None = None,
    start: Column | None = None, end: Column | None = None, limit: int | None = None,
) -> DataFrame:
    """Log rows of one type and time range (inclusive), newest first."""
    if value is not None:
        log = log.filter(F.col(kind) == value)
    if start is not None:
        log = log.filter(F.col(ts) >= start)
    if end is not None:
        log = log.filter(F.col(ts) <= end)
    log = log.orderBy(F.col(ts).desc(), F.col(key).desc())
    return log.limit(limit) if limit else log


def filter_events(
    events: DataFrame, types: Sequence[str] | None = None, sources: Sequence | None = None,
    start: Column | None = None, end: Column | None = None, metadata: Mapping[str, str] | None = None,
) -> DataFrame:
    """Events by type list, source list, time range and metadata equality; each optional."""
    if types:
        events = events.filter(F.col("event_type").isin(list(types)))
    if sources:
        events = events.filter(F.col("source").isin(list(sources)))
    if start is not None:
        events = events.filter(F.col("ts") >= start)
    if end is not None:
        events = events.filter(F.col("ts") <= end)
    for field, value in (metadata or {}).items():
        events = events.filter(F.get_json_object("metadata", f"$.{field}") == value)
    return events


def flag_timeouts(operations: DataFrame, now: Column, seconds: int = OPERATION_TIMEOUT) -> DataFrame:
    """Fail operations in progress for longer than the timeout."""
    late = (F.col("status") == "in_progress") & (seconds_between("created_at", now) > seconds)
    return operations.withColumns({
        "error": F.when(late, F.lit("Operation timeout exceeded")),
        "status": F.when(late, F.lit("failed")).otherwise(F.col("status")),
    })


def rolled_back(operations: DataFrame) -> DataFrame:
    """Failed operations whose rollback operation completed become rolled_back."""
    rollbacks = operations.filter(F.col("rollback_for").isNotNull()).select(
        F.col("rollback_for").alias("operation_id"), F.col("status").alias("_rollback_status")
    ).groupBy("operation_id").agg(F.max((F.col("_rollback_status") == "completed").cast("int")).alias("_done"))
    undone = (F.col("status") == "failed") & (F.coalesce("_done", F.lit(0)) == 1)
    return operations.join(rollbacks, "operation_id", "left").withColumn(
        "status", F.when(undone, F.lit("rolled_back")).otherwise(F.col("status"))
    ).drop("_done")


def rollback_outcome(steps: DataFrame, order: Sequence[str]) -> DataFrame:
    """Overall status and the joined failure texts of each operation's steps.

    The texts of one operation are gathered in step order; a plan holds a
    bounded list of steps.
    """
    failed = F.when(F.col("status") == "failed", F.struct(*order, "error"))
    return steps.groupBy("operation_id").agg(
        F.when(F.bool_and(F.col("status") == "completed"), "completed").otherwise("failed").alias("status"),
        F.array_join(F.transform(
            F.sort_array(F.collect_list(failed)),
            lambda s: F.concat(F.lit("Step "), s[order[0]].cast("string"), F.lit(" failed: "), s["error"]),
        ), "\n").alias("error"),
    )


def state_snapshots(steps: DataFrame, order: Sequence[str]) -> DataFrame:
    """Map step -> {before, after} per operation; the last entry of a step wins."""
    last = steps.groupBy("operation_id", "step_id").agg(
        F.max_by(F.struct("before", "after"), F.struct(*order)).alias("state")
    )
    return last.groupBy("operation_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("step_id", "state")))).alias("states")
    )


def rollback_status(steps: DataFrame) -> DataFrame:
    """One row per operation: completed if all of its steps are."""
    done = F.bool_and(F.coalesce(F.col("status") == "completed", F.lit(False)))
    return steps.groupBy("operation_id").agg(F.when(done, "completed").otherwise("failed").alias("status"), F.count_if(F.col("status") == "failed").alias("failures"))


def rollback_error_parts(steps: DataFrame, order: Sequence[str], size: int = PART_LINES, rows: int = CHUNK_ROWS) -> DataFrame:
    """(operation_id, part, error): the failure texts of each operation in step order,
    ``size`` of them in a row, for operations of any number of steps.

    Failures are numbered by chunks of their operation, so neither the order nor the
    texts of a long operation meet in one task.  Joined by line ends in the order of
    ``part``, the rows are the text of ``rollback_outcome``.
    """
    said = F.concat(F.lit("Step "), F.col(order[0]).cast("string"), F.lit(" failed: "), F.col("error"))
    failed = steps.filter(F.col("status") == "failed").select("operation_id", *order, said.alias("_said"), F.timestamp_seconds(F.lit(0)).alias("_at"))
    # no time of their own: the operation is one span, cut by the order of its steps
    placed = positions(failed, ["operation_id"], "_at", [*order, "_said"], "_place", rows=rows)
    texts = F.sort_array(F.collect_list(F.struct("_place", "_said")))
    return placed.groupBy("operation_id", F.floor(F.col("_place") / size).cast("bigint").alias("part")).agg(
        F.array_join(F.transform(texts, lambda s: s["_said"]), "\n").alias("error")
    )


def state_snapshot_rows(steps: DataFrame, order: Sequence[str]) -> DataFrame:
    """(operation_id, step_id, before, after): the last entry of every step as a row."""
    last = F.max_by(F.struct("before", "after"), F.struct(*order)).alias("_s")
    return steps.groupBy("operation_id", "step_id").agg(last).select("operation_id", "step_id", "_s.before", "_s.after")


def step_durations(steps: DataFrame, start: str, end: str) -> DataFrame:
    return steps.withColumn("duration_seconds", seconds_between(start, end))


def container_retention(containers: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Drop records of deleted containers that finished more than ``days`` ago."""
    old = (F.col("state") == "deleted") & (seconds_between("finished_at", now) > days * DAY)
    return containers.filter(~F.coalesce(old, F.lit(False)))


def merge_config(defaults: Column, given: Column) -> Column:
    """Defaults with the given entries on top."""
    kept = F.map_filter(defaults, lambda k, v: ~F.map_contains_key(given, k))
    return F.map_concat(kept, given)


# --- snapshots -----------------------------------------------------------------------


def snapshot_log(snapshots: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """Version per type (from 1), parent snapshot and checksum of the data."""
    linked = in_order(snapshots, ["state_type"], "ts", [key], position="version", previous={"parent_id": key})
    return linked.withColumn("version", F.col("version") + 1).withColumn("checksum", F.sha2("data", 256))


def latest_snapshots(log: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct(*[c for c in log.columns if c != "state_type"]), F.col("version"))
    return log.groupBy("state_type").agg(newest.alias("_s")).select("state_type", "_s.*")


def snapshot_at(log: DataFrame, state_type: str, version: int) -> DataFrame:
    return log.filter((F.col("state_type") == state_type) & (F.col("version") == version))


def version_gate(
    updates: DataFrame, self_node, ts: str = "ts", tie_break: Sequence[str] = ("update_id",), chunk_seconds: int = 30 * DAY, rows: int = CHUNK_ROWS
) -> DataFrame:
    """Updates applied in arrival order: not from this node and newer than the version held."""
    foreign = ordered_chunks(updates.filter(F.col("node") != self_node), ["state_type"], ts, list(tie_break), chunk_seconds, rows)
    before = prefix_by_chunk(foreign, ["state_type"], {"_pre": (F.max("version"), "max")})
    earlier = (
        Window.partitionBy("state_type", CHUNK).orderBy(ts, *tie_break).rowsBetween(Window.unboundedPreceding, -1)
    )
    held = F.greatest(F.col("_pre"), F.col("_local"))  # greatest skips nulls
    return (
        foreign.withColumn("_local", F.max("version").over(earlier))
        .join(before, ["state_type", CHUNK])
        .filter(F.col("version") > F.coalesce(held, F.lit(0)))
        .drop("_pre", "_local", CHUNK)
    )


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page (from 1) of an ordered listing with the total count."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.orderBy(*order).offset((number - 1) * size).limit(size).withColumn("total_count", total)


# --- proposals and votes -------------------------------------------------------------


def first_proposals(messages: DataFrame, order: Sequence[str], lifetime_seconds: int = PROPOSAL_SECONDS) -> DataFrame:
    """The first message of each proposal with its expiration."""
    fields = [c for c in messages.columns if c != "proposal_id"]
    first = F.min_by(F.struct(*fields), F.struct("ts", *order))
    return messages.groupBy("proposal_id").agg(first.alias("_f")).select("proposal_id", "_f.*").withColumn(
        "expiration", F.col("ts") + F.expr(f"INTERVAL {lifetime_seconds} SECONDS")
    )


def allowed_proposals(proposals: DataFrame, allowed_types: DataFrame, cluster: DataFrame) -> DataFrame:
    """Proposals of an allowed type from a member of the cluster."""
    return proposals.join(allowed_types, "proposal_type", "left_semi").join(cluster, "proposer", "left_semi")


def accepted_votes(votes: DataFrame, proposals: DataFrame) -> DataFrame:
    """Votes cast before their proposal expired, and not before it was known if
    the proposals carry their own ``ts``."""
    known = "ts" in proposals.columns
    limits = proposals.select("proposal_id", "expiration", *[F.col("ts").alias("proposed_at")] * known)
    early = F.col("ts") < F.col("proposed_at") if known else F.lit(False)
    return votes.join(limits, "proposal_id").filter(~early & (F.col("ts") <= F.col("expiration")))


def tally(votes: DataFrame, order: Sequence[str], nodes: int = NODES) -> DataFrame:
    """Consensus state of each proposal, final at the first vote that settles it.

    Votes count in ``order`` (the event time first), a voter's later vote replaces
    the earlier.  Accepted with q yes votes, rejected when q votes are in and more
    than n - q are no; q = n // 2 + 1.  Votes after the decision change nothing.
    """
    quorum = nodes // 2 + 1
    ts, ties = order[0], list(order[1:])
    before = previous_values(votes, ["proposal_id", "voter"], ts, ties, {"_had": "vote"})
    change = F.col("vote").cast("bigint") - F.coalesce(F.col("_had").cast("bigint"), F.lit(0))
    # a repeated vote moves no count
    moves = cut_lineage(before.filter(F.col("_had").isNull() | (change != 0)))  # read twice: counted, then ordered
    running = running_total(moves, ["proposal_id"], ts, ties, {"total": F.col("_had").isNull().cast("bigint"), "yes": change})
    enough = F.col("total") >= quorum
    state = F.when(enough & (F.col("yes") >= quorum), "accepted").when(enough & (F.col("total") - F.col("yes") > nodes - quorum), "rejected")
    at = F.struct(ts, *ties)
    counts = F.struct("total", "yes", "state")
    out = running.withColumn("state", state).groupBy("proposal_id").agg(
        F.min_by(F.when(F.col("state").isNotNull(), counts), F.when(F.col("state").isNotNull(), at)).alias("_first"), F.max_by(counts, at).alias("_last")
    )
    found = F.coalesce("_first", "_last")
    return out.select("proposal_id", found["total"].alias("total"), found["yes"].alias("yes"), F.coalesce(found["state"], F.lit("open")).alias("state"))


def final_status(proposals: DataFrame, tallied: DataFrame, now: Column) -> DataFrame:
    """Accepted proposals are executed, rejected ones kept, undecided ones removed once expired."""
    joined = proposals.join(tallied.select("proposal_id", "state"), "proposal_id", "left")
    state = F.coalesce("state", F.lit("open"))
    return (
        joined.withColumn("state", F.when(state == "accepted", "executed").otherwise(state))
        .filter((F.col("state") != "open") | (F.col("expiration") >= now))
    )


def _cooldown_map(t: np.ndarray, cooldown: int) -> tuple[np.ndarray, np.ndarray]:
    """What a chunk of instants does to the time of the last applied action.

    (starts, exits): an action applied at ``e`` before the chunk lets the first
    instant of at least ``e + cooldown`` go; the first of ``starts`` not before that
    has its place in ``exits``, the last applied instant of the chunk.  None left
    means that the chunk applies nothing.  Starts with one exit share an entry, and
    later starts than a cooldown into the chunk are reached by no entry.
    """
    after = np.searchsorted(t, t + cooldown)
    last = np.arange(len(t))
    for i in range(len(t) - 1, -1, -1):
        if after[i] < len(t):
            last[i] = last[after[i]]
    reached = min(len(t), int(np.searchsorted(t, t[0] + cooldown)) + 1)
    exits = t[last[:reached]]
    ends = np.flatnonzero(np.append(exits[1:] != exits[:-1], True))
    return t[ends], exits[ends]


def apply_cooldown(
    candidates: DataFrame, keys: list[str], ts: str, tie_break: list[str], seconds: int = COOLDOWN, chunk_seconds: int = AGE, rows: int = 100_000
) -> DataFrame:
    """Mark the candidates applied when each applied one silences its key for ``seconds``.

    Of the candidates of an instant only the first by ``tie_break`` may be applied;
    rows that agree in both share their mark.  A key of up to ``rows`` instants in
    ``chunk_seconds`` is one chunk, larger ones are cut into chunks of about ``rows``.
    Tasks stream sorted chunks, so small keys cost no call of their own.  Where a key
    has several chunks, each becomes a map from the last action before it to the last
    action in it, the maps of a key are chained in order by a task that holds one of
    them at a time, and every chunk is then replayed from its own entry.
    """
    marked = candidates.select(*keys, ts, *tie_break)
    if seconds <= 0:
        return marked.withColumn("applied", F.lit(True))
    cooldown = seconds * MICROS
    tie = F.struct(F.lit(0), *tie_break)
    first = F.min(tie).alias("_first")
    known = marked
    for c in (*keys, ts):  # rows without meet no instant in the end
        known = known.filter(F.col(c).isNotNull())
    instants = ordered_chunks(known.groupBy(*keys, ts).agg(first), keys, ts, [], chunk_seconds, rows)
    cut = isinstance(instants.schema[CHUNK].dataType, T.StructType)
    several = cut or chunk_seconds < AGE  # chunks of a key
    span, part = (F.col(f"{CHUNK}.span"), F.col(f"{CHUNK}.part")) if cut else (F.col(CHUNK) if several else F.lit(0), F.lit(0))
    instants = instants.select(*keys, span.alias("_span"), part.alias("_part"), ts, "_first", micros(ts).alias("_t"))
    chunk = [*keys, "_span", "_part"]
    kinds = {f.name: f.dataType.simpleString() for f in instants.schema}
    named = ", ".join(f"`{c}` {kinds[c]}" for c in chunk)

    def runs(pdf: pd.DataFrame) -> np.ndarray:
        """Bounds of the rows that share a chunk."""
        new = np.zeros(len(pdf), bool)
        for c in chunk:
            new[1:] |= pdf[c].to_numpy()[1:] != pdf[c].to_numpy()[:-1]
        return np.concatenate([[0], np.flatnonzero(new), [len(pdf)]])

    def shorten(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the chunk that the next frame may continue
        for pdf in frames:
            bounds = runs(pdf)
            heads = list(pdf.iloc[bounds[:-1]][chunk].itertuples(index=False, name=None))
            if held and next(held[0].iloc[:1][chunk].itertuples(index=False, name=None)) != heads[0]:
                yield maps_of(held)
                held = []
            if len(heads) > 1:
                yield maps_of([*held, pdf.iloc[: bounds[-2]]])
                held = []
            held.append(pdf.iloc[bounds[-2] :])
        if held:
            yield maps_of(held)

    def maps_of(whole: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(whole, ignore_index=True)
        bounds, t = runs(pdf), pdf["_t"].to_numpy()
        found = [_cooldown_map(t[a:b], cooldown) for a, b in zip(bounds[:-1], bounds[1:])]
        return pdf.iloc[bounds[:-1]][chunk].assign(_starts=[s for s, _ in found], _exits=[e for _, e in found])

    def chain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = last = None
        for pdf in frames:
            entries = []
            for own, starts, exits in zip(pdf[keys].itertuples(index=False, name=None), pdf["_starts"], pdf["_exits"]):
                key, last = own, (last if own == key else None)
                entries.append(last)
                i = 0 if last is None else int(np.searchsorted(starts, last + cooldown))
                last = int(exits[i]) if i < len(starts) else last
            yield pdf[chunk].assign(_entry=pd.array(entries, dtype="Int64"))

    def replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = free = None  # the chunk at hand and the first instant that may go
        for pdf in frames:
            bounds, t = runs(pdf), pdf["_t"].to_numpy()
            heads = pdf.iloc[bounds[:-1]][chunk].itertuples(index=False, name=None)
            entries = pdf["_entry"].iloc[bounds[:-1]]
            applied = np.zeros(len(t), bool)
            for head, entry, a, b in zip(heads, entries, bounds[:-1], bounds[1:]):
                if head != own:
                    own, free = head, (None if pd.isna(entry) else int(entry) + cooldown)
                i = a if free is None else a + int(np.searchsorted(t[a:b], free))
                while i < b:
                    applied[i], free = True, int(t[i]) + cooldown
                    i = a + int(np.searchsorted(t[a:b], free))
            yield pdf[[*keys, "_t"]].assign(_go=applied)

    def in_runs(df: DataFrame) -> DataFrame:
        return df.repartition(*chunk).sortWithinPartitions(*chunk, "_t")

    entered = instants.select(*chunk, "_t")
    if several:
        maps = in_runs(entered).mapInPandas(shorten, f"{named}, _starts array<bigint>, _exits array<bigint>")
        entries = maps.repartition(*keys).sortWithinPartitions(*chunk).mapInPandas(chain, f"{named}, _entry bigint")
        entered = entered.join(entries, chunk)
    else:
        entered = entered.withColumn("_entry", F.lit(None).cast("bigint"))
    replayed = in_runs(entered.select(*chunk, "_t", F.col("_entry").cast("string"))).mapInPandas(
        replay, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", _t bigint, _go boolean"
    )
    going = instants.select(*keys, ts, "_first", "_t").join(replayed, [*keys, "_t"]).drop("_t")
    out = marked.join(going, [*keys, ts])
    return out.select(*keys, ts, *tie_break, (F.col("_go") & (tie == F.col("_first"))).alias("applied"))
