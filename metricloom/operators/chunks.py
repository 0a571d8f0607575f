"""Ordered work on keys that may hold a large share of all rows.

A window partitioned by a hot key sorts that key in one task.  The helpers here
split every key along its order: rows are shuffled by (key, chunk), and only one
summary row per chunk is combined per key.  A chunk is a calendar span; a span that
holds more than ``CHUNK_ROWS`` rows of a key is cut further by (ts, tie break), so a
chunk is bounded by rows, however many share a day, a minute or an instant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions.scalars import MICROS, micros
from metricloom.session import cut_lineage

DAY = 86_400
CHUNK = "_chunk"
#: Rows of a key that an ordered chunk holds, about; samples that place a cut.
CHUNK_ROWS, SAMPLES = 1_000_000, 32
#: No key has more rows than this: keys are ordered whole, in a plain window.
WHOLE_ROWS = 10_000
#: Groups of a count by hash.
HASH_GROUPS = 1 << 16


def chunk_of(ts: Column | str, chunk_seconds: int) -> Column:
    return F.floor(micros(ts) / F.lit(chunk_seconds * MICROS)).cast("bigint")


def largest_group(df: DataFrame, by: list[Column | str]) -> int:
    """No group of equal ``by`` has more rows than this: the largest count by hash."""
    group = F.pmod(F.xxhash64(*by), F.lit(HASH_GROUPS)).alias("_group")
    counts = df.select(group).groupBy("_group").agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.coalesce(F.max("_n"), F.lit(0))).first()[0]


def ordered_chunks(
    df: DataFrame, keys: list[str], ts: str, tie_break: list[str], chunk_seconds: int = DAY, rows: int = CHUNK_ROWS
) -> DataFrame:
    """``df`` with its chunk, which sorts like (ts, tie_break): the number of the span, or
    a struct (span, part) if some spans are cut.

    The spans of a key with more than ``rows`` rows, at most one for each ``rows``
    rows of the table, are counted first; without any, the span alone is the chunk.
    Spans are counted by hash before, in so few groups that nothing but their counts is
    shuffled; only if one of them is large are they counted one by one.
    Cuts lie at every ``SAMPLES``-th of the rows that a hash of their order picks, one
    in ``rows / SAMPLES``: a hot span has as many cuts as it has chunks.  Rows that
    agree in ``ts`` and ``tie_break`` have no order and share a chunk.
    """
    span, order = chunk_of(ts, chunk_seconds), F.struct(ts, *tie_break)
    whole = df.withColumn(CHUNK, span)
    if largest_group(df, [*keys, span]) <= rows:
        return whole
    sizes = df.groupBy(*keys, span.alias("_span")).agg(F.count(F.lit(1)).alias("_n"))
    heavy = cut_lineage(sizes.filter(F.col("_n") > rows).drop("_n"))
    if heavy.isEmpty():
        return whole
    picked = F.pmod(F.xxhash64(*keys, ts, *tie_break), F.lit(max(1, rows // SAMPLES))) == 0
    spans = df.withColumn("_span", span)
    samples = spans.filter(picked).join(heavy, [*keys, "_span"]).groupBy(*keys, "_span").agg(F.sort_array(F.collect_set(order)).alias("_cuts"))
    cuts = cut_lineage(samples.withColumn("_cuts", F.filter("_cuts", lambda _, i: (i + 1) % SAMPLES == 0)))
    part = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= order)), F.lit(0))
    out = spans.join(cuts, [*keys, "_span"], "left")
    part = F.when(F.col("_cuts").isNull(), 0).otherwise(part)
    return out.withColumn(CHUNK, F.struct(F.col("_span").alias("span"), part.alias("part"))).drop("_span", "_cuts")


def with_halo(
    df: DataFrame, ts: str, chunk_seconds: int = DAY, before: int = 0, after: int = 0
) -> DataFrame:
    """Copy rows into the chunks whose windows can see them.

    ``before``/``after`` are the look-back and look-ahead of the window in
    seconds.  Rows outside their own chunk carry ``_own = false`` and must be
    dropped after the window has run.  The copies are a before/chunk share.
    """
    width = chunk_seconds * MICROS
    m = micros(ts)
    first = F.floor((m - F.lit(after * MICROS)) / F.lit(width)).cast("bigint")
    last = F.floor((m + F.lit(before * MICROS)) / F.lit(width)).cast("bigint")
    return (
        df.withColumn(CHUNK, F.explode(F.sequence(first, last)))
        .withColumn("_own", F.col(CHUNK) == chunk_of(ts, chunk_seconds))
    )


def prefix_by_chunk(
    df: DataFrame, keys: list[str], totals: dict[str, tuple[Column, str]]
) -> DataFrame:
    """For each (key, chunk): the combination of all *earlier* chunks of the key.

    ``totals`` maps an output name to (aggregate over one chunk, combiner), the
    combiner being one of sum, max, min or last.
    """
    per_chunk = df.groupBy(*keys, CHUNK).agg(*[agg.alias(n) for n, (agg, _) in totals.items()])
    earlier = (
        Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    )
    combine = {
        "sum": F.sum,
        "max": F.max,
        "min": F.min,
        "last": lambda c: F.last(c, ignorenulls=True),
    }
    return per_chunk.select(
        *keys, CHUNK, *[combine[how](n).over(earlier).alias(n) for n, (_, how) in totals.items()]
    )


def in_order(
    df: DataFrame, keys: list[str], ts: str, tie_break: list[str], *, position: str | None = None,
    sums: dict[str, Column] | None = None, previous: dict[str, str] | None = None,
    chunk_seconds: int = DAY, rows: int = CHUNK_ROWS,
) -> DataFrame:
    """What each row knows of the earlier rows of its key, ordered by (ts, tie_break).

    ``position``: name of its 0-based place; ``sums``: cumulative sums up to and
    including the row; ``previous``: output name -> column of the row before.  All
    come from one sort of the chunks and one summary row per chunk.  Where all keys are
    small, keys are sorted whole: rows are shuffled once, or not at all if they lie by key.
    """
    sums, previous = sums or {}, previous or {}
    order = [ts, *tie_break]
    if keys and largest_group(df, [*keys]) <= min(rows, WHOLE_ROWS):
        return _in_order_whole(df, keys, order, position, sums, previous, chunk_of(ts, chunk_seconds))
    chunked = ordered_chunks(df.withColumns({f"_in_{n}": c for n, c in sums.items()}), keys, ts, tie_break, chunk_seconds, rows)
    local = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    so_far = local.rowsBetween(Window.unboundedPreceding, 0)
    totals, inside, out = {}, {}, {}
    if position:
        totals["_before"] = (F.count(F.lit(1)), "sum")
        inside["_local"] = F.row_number().over(local)
        out[position] = (F.coalesce("_before", F.lit(0)) + F.col("_local") - 1).cast("bigint")
    for n in sums:
        totals[f"_pre_{n}"] = (F.sum(f"_in_{n}"), "sum")
        inside[f"_loc_{n}"] = F.sum(f"_in_{n}").over(so_far)
        out[n] = F.col(f"_loc_{n}") + F.coalesce(f"_pre_{n}", F.lit(0))
    if previous:
        packed = F.struct(*[F.col(c).alias(n) for n, c in previous.items()])
        # the first row of a chunk takes the last row of the latest earlier chunk
        totals["_carry"] = (F.max_by(packed, F.struct(*order)), "last")
        inside["_lag"] = F.lag(packed).over(local)
        out |= {n: F.coalesce("_lag", "_carry")[n] for n in previous}
    before = prefix_by_chunk(chunked, keys, totals)
    joined = chunked.withColumns(inside).join(before, [*keys, CHUNK]).withColumns(out)
    return joined.drop(CHUNK, *totals, *inside, *[f"_in_{n}" for n in sums])


def _in_order_whole(
    df: DataFrame, keys: list[str], order: list[str], position: str | None, sums: dict[str, Column], previous: dict[str, str], span: Column
) -> DataFrame:
    """``in_order`` for small keys.  As in chunks, rows without key or time are left
    out in the end, and a sum is null until its span holds a value."""
    named = {f"_in_{n}": c for n, c in sums.items()}
    whole = Window.partitionBy(*keys).orderBy(*order)
    so_far = whole.rowsBetween(Window.unboundedPreceding, 0)
    out = {position: (F.row_number().over(whole) - 1).cast("bigint")} if position else {}
    for n in sums:
        held = F.last(F.when(F.col(f"_in_{n}").isNotNull(), F.col(CHUNK)), ignorenulls=True).over(so_far) == F.col(CHUNK)
        out[n] = F.when(held, F.sum(f"_in_{n}").over(so_far))
    if previous:
        packed = F.lag(F.struct(*[F.col(c).alias(n) for n, c in previous.items()])).over(whole)
        out |= {n: packed[n] for n in previous}
    done = df.withColumns({**named, CHUNK: span}).withColumns(out).drop(CHUNK, *named)
    for c in (*keys, order[0]):
        done = done.filter(F.col(c).isNotNull())
    return done


def positions(
    df: DataFrame, keys: list[str], ts: str, tie_break: list[str], name: str = "position", chunk_seconds: int = DAY, rows: int = CHUNK_ROWS
) -> DataFrame:
    """0-based position of each row within its key, ordered by (ts, tie_break)."""
    return in_order(df, keys, ts, tie_break, position=name, chunk_seconds=chunk_seconds, rows=rows)


def running_total(
    df: DataFrame, keys: list[str], ts: str, tie_break: list[str], sums: dict[str, Column], chunk_seconds: int = DAY, rows: int = CHUNK_ROWS
) -> DataFrame:
    """Cumulative sums per key up to and including each row."""
    return in_order(df, keys, ts, tie_break, sums=sums, chunk_seconds=chunk_seconds, rows=rows)


def previous_values(
    df: DataFrame, keys: list[str], ts: str, tie_break: list[str], values: dict[str, str], chunk_seconds: int = DAY, rows: int = CHUNK_ROWS
) -> DataFrame:
    """Lag by one row per key: output name -> input column."""
    return in_order(df, keys, ts, tie_break, previous=values, chunk_seconds=chunk_seconds, rows=rows)


def with_row_halo(
    df: DataFrame, keys: list[str], position: str, before: int, after: int = 0, size: int = 100_000
) -> DataFrame:
    """Chunks of ``size`` consecutive positions plus the rows their frames reach.

    For windows counted in rows: partition by (keys, chunk), order by position,
    then keep the rows with ``_own``.
    """
    first = F.floor((F.col(position) - after) / F.lit(size)).cast("bigint")
    last = F.floor((F.col(position) + before) / F.lit(size)).cast("bigint")
    return (
        df.withColumn(CHUNK, F.explode(F.sequence(first, last)))
        .withColumn("_own", F.col(CHUNK) == F.floor(F.col(position) / F.lit(size)))
    )
