"""Row-level expressions used across operators.  All stay inside Catalyst."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def iso(ts: Column | str) -> Column:
    """ISO-8601 text with microseconds."""
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def parse_iso(text: Column | str) -> Column:
    """ISO-8601 text to a zone-less timestamp; unreadable text gives null."""
    return F.try_to_timestamp(col(text)).cast("timestamp_ntz")


def micros(ts: Column | str) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    return (micros(end) - micros(start)) / F.lit(float(MICROS))


def from_micros(m: Column) -> Column:
    return F.timestamp_micros(m).cast("timestamp_ntz")


def floor_time(ts: Column | str, step_seconds: int) -> Column:
    """Start of the fixed-width bucket (aligned to the epoch) that holds ``ts``."""
    width = step_seconds * MICROS
    m = micros(ts)
    return from_micros(m - F.pmod(m, F.lit(width)))


def clamp(c: Column, low: float | Column, high: float | Column) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.least(F.greatest(c, low), high)


# Comparison operators by name.  Equality uses a fixed tolerance of 1e-6.
TOLERANCE = 1e-6
COMPARATORS: dict[str, Callable[[Column, Column], Column]] = {
    ">": lambda x, t: x > t,
    "<": lambda x, t: x < t,
    ">=": lambda x, t: x >= t,
    "<=": lambda x, t: x <= t,
    "==": lambda x, t: F.abs(x - t) < TOLERANCE,
    "!=": lambda x, t: F.abs(x - t) >= TOLERANCE,
}


def register_comparator(name: str, rule: Callable[[Column, Column], Column]) -> None:
    """Add a comparison by name; it is used like the built-in six."""
    COMPARATORS[name] = rule


def violates(operator: Column | str, value: Column | str, threshold: Column | str) -> Column:
    """Whether ``value`` violates ``threshold`` under the operator named in a column."""
    op, v, t = col(operator), col(value), col(threshold)
    branches = list(COMPARATORS.items())
    name, rule = branches[0]
    chain = F.when(op == name, rule(v, t))
    for name, rule in branches[1:]:
        chain = chain.when(op == name, rule(v, t))
    return chain


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def outcome_similarity(a: Column | str, b: Column | str) -> Column:
    """1 minus the relative difference of two outcome values, in [0, 1]."""
    a, b = F.coalesce(col(a), F.lit(0.0)), F.coalesce(col(b), F.lit(0.0))
    top = F.greatest(F.abs(a), F.abs(b))
    return F.when(top == 0, F.lit(1.0)).otherwise(
        F.lit(1.0) - F.least(F.try_divide(F.abs(a - b), top), F.lit(1.0))
    )


def cpu_percent(cpu_delta: Column, system_delta: Column) -> Column:
    """Share of the system's time spent, in percent; 0 unless both deltas grow."""
    return F.when(
        (cpu_delta > 0) & (system_delta > 0), F.try_divide(cpu_delta, system_delta) * 100.0
    ).otherwise(F.lit(0.0))


def memory_percent(usage: Column, limit: Column) -> Column:
    return F.coalesce(F.try_divide(usage, limit) * 100.0, F.lit(0.0))


def stable_id(*parts: Column) -> Column:
    """sha256 over the parts joined by ':'; stable because no clock takes part."""
    return F.sha2(F.concat_ws(":", *parts), 256)


def text_bucket(text: Column | str, buckets: int = 1000) -> Column:
    """Bucket number of a text from the first 28 bits of its md5."""
    return F.pmod(F.conv(F.substring(F.md5(col(text)), 1, 7), 16, 10).cast("bigint"), F.lit(buckets))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; 0 when either has no length."""
    a, b = F.transform(a, lambda x: x.cast("double")), F.transform(b, lambda x: x.cast("double"))
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.try_divide(dot(a, b), norms), F.lit(0.0))
