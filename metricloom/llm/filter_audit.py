"""How filters interact: who removes what, in every order.

Each filter has one table of the rows it fails.  The survivors of a prefix of
filters depend on the set of its filters only, so they are built set by set: the
survivors of a set, left-anti joined with the failing ids of one more filter.  A
filter removes, after a prefix, its failing ids left-semi joined with the survivors
of that prefix; the others of its failing ids (left anti) were redundant there.
Rows that fail nothing survive every prefix, so they are counted and never joined,
and all tables hold ids, never texts.

All joins are by row id (and set), so no key is hotter than another; groups are only
counted, which combines before the shuffle.  Only the search for exact copies joins
by text, with one row per text on its right side: AQE splits a hot text there.

Defined cases: a null text is empty, a null part is the empty string; rows, not ids,
are counted, so repeated or null ids are separate documents; a null id is neither
smaller nor larger than another and has no labels; a document is labelled if any row
of ``labels`` says so; an empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import small_or_merge
from metricloom.session import cut_lineage, shared_folder

Filters = Sequence[tuple[str, Column | None]]
WORD_BREAK = r"[\x20\x09-\x0D]+"


def standard_filters() -> list[tuple[str, Column | None]]:
    """Conditions of failure over ``text`` (not null); None is the exact-copy filter."""
    text = F.col("text")
    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return [
        ("A", F.size(words) < 200),
        ("B", 100 * F.size(F.array_distinct(words)) < 50 * F.size(words)),
        ("C", 100 * capitals.cast("long") > 3 * F.char_length(text).cast("long")),
        ("D", text.rlike("[#$%&*|]")),
        ("E", None),
    ]


def failing_ids(docs: DataFrame, part: str, filters: Filters) -> tuple[DataFrame, DataFrame]:
    """(rows, failing): the written rows (row, doc_id, part) and one written table of
    failing rows for each filter, a folder ``filter=number`` of one path."""
    spark = docs.sparkSession
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")
    )
    own = [F.when(c, F.lit(i)) for i, (_, c) in enumerate(filters) if c is not None]
    failed = F.array_compact(F.array(*own)) if own else F.array().cast("array<int>")
    rows = cut_lineage(base.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "part", F.sha2("text", 256).alias("text_key"), failed.alias("failed")
    ))
    failing = rows.select(F.explode("failed").alias("filter"), "row", "doc_id", "part")
    for i, (_, condition) in enumerate(filters):
        if condition is None:
            texts = rows.groupBy("text_key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
            texts = cut_lineage(texts.select("text_key", "least"))
            first = small_or_merge(texts, texts.count(), 96, 16 << 20)
            copies = rows.join(first, (rows["text_key"] == first["text_key"]) & (rows["doc_id"] > first["least"]), "left_semi")
            failing = failing.unionByName(copies.select(F.lit(i).alias("filter"), "row", "doc_id", "part"))
    path = shared_folder(spark, "failing")
    failing.write.partitionBy("filter").parquet(path)
    return rows.select("row", "doc_id", "part"), spark.read.schema(failing.schema).parquet(path)


def survivors_by_set(failing: DataFrame, n: int) -> DataFrame:
    """(mask, row, part): failing rows that survive each proper subset of the filters.

    A set grows by a filter later than all its own, so every set is made once.
    """
    level = cut_lineage(failing.select("row", "part").distinct().withColumn("mask", F.lit(0)))
    levels = [level]
    for _ in range(1, n):
        grown = level.withColumn("filter", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).filter(F.expr("mask < shiftleft(1, filter)"))
        level = cut_lineage(
            grown.join(failing.select("filter", "row"), ["filter", "row"], "left_anti")
            .select("row", "part", F.expr("mask | shiftleft(1, filter)").alias("mask"))
        )
        levels.append(level)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def audit(docs: DataFrame, labels: DataFrame, filters: Filters | None = None, part: str = "lang") -> DataFrame:
    """One row per part, order of all filters and step, zeros included: kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley."""
    filters = list(filters or standard_filters())
    n, spark = len(filters), docs.sparkSession
    names = [name for name, _ in filters]
    rows, failing = failing_ids(docs, part, filters)
    survivors = survivors_by_set(failing, n)

    # labels are looked up once for each failing row: they travel with it
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id is not null and (quality = 1 or toxic = 1)")
    marked = marked.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    labelled = cut_lineage(failing.join(marked, "doc_id", "left").select("filter", "row", "part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")))
    masks = F.filter(F.sequence(F.lit(0), F.lit((1 << n) - 1)), lambda m: m.bitwiseAND(F.expr("shiftleft(1, filter)")) == 0)
    asked = labelled.withColumn("mask", F.explode(masks))
    alive = survivors.select("mask", "row")
    keys = ["part", "mask", "filter"]
    removed = asked.join(alive, ["mask", "row"], "left_semi").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("removed"), F.sum("good").alias("good_lost"), F.sum("toxic").alias("toxic_lost")
    )
    redundant = asked.join(alive, ["mask", "row"], "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("redundant"))
    left = survivors.groupBy("part", F.col("mask").alias("after")).agg(F.count(F.lit(1)).alias("left"))

    # from here on: one row per part and (set, filter), a number that the filters fix
    touched = failing.select("row", "part").distinct().groupBy("part").agg(F.count(F.lit(1)).alias("touched"))
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("total")).join(touched, "part", "left")
    every = parts.withColumn("filter", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("mask", F.explode(masks))
    every = every.withColumn("after", F.expr("mask | shiftleft(1, filter)"))
    table = every.join(removed, keys, "left").join(redundant, keys, "left").join(left, ["part", "after"], "left")
    table = cut_lineage(table.na.fill(0).withColumn("kept", F.col("total") - F.col("touched") + F.col("left")))
    size = F.bit_count("mask")
    weight = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), size + 1)
    alone = F.col("mask") == F.lit((1 << n) - 1).bitwiseXOR(F.expr("shiftleft(1, filter)"))
    whole = table.groupBy("part", "filter").agg(F.sum(F.col("removed") * weight).alias("shapley"), F.sum(F.when(alone, F.col("removed")).otherwise(0)).alias("unique_fails"))
    steps = [("".join(names[i] for i in order), k + 1, sum(1 << i for i in order[:k]), order[k]) for order in permutations(range(n)) for k in range(n)]
    steps = spark.createDataFrame(steps, "filter_order string, step int, mask int, filter int")
    return table.join(whole, ["part", "filter"]).join(steps, ["mask", "filter"]).select(
        "part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
    )
