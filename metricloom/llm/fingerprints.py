"""Merkle fingerprints of documents.

A text is cut into sections (at empty lines), paragraphs (lines) and leaves
(runs up to a closing mark); a leaf is hashed with its text, every node above
with the hashes below it, each level under its own prefix.  Equal roots mean
equal texts; where roots differ, the branches that differ locate the edits.
Everything is a built-in expression on the row.

Defined cases: a null text is empty, and the empty text has a fingerprint like
any other; the next document of the only one is itself; equal ids follow each
other in the order of their texts, null ids come last; repeated rows are separate
documents.  Other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.common import small_or_merge
from metricloom.session import cut_lineage

LEAF = r"[^.!?|]*[.!?|]+|[^.!?|]+"


def _hash(level: str, parts: Column) -> Column:
    return F.sha2(F.concat(F.lit(level), F.array_join(parts, "")), 256)


def leaves(paragraph: Column) -> Column:
    """Hashes of the leaves of a paragraph; the leaves tile it."""
    return F.transform(F.regexp_extract_all(paragraph, F.lit(LEAF), F.lit(0)), lambda x: F.sha2(F.concat(F.lit("l"), x), 256))


def branches(text: Column) -> Column:
    """The tree: an array of sections, each an array of paragraphs, each an array
    of leaf hashes."""
    return F.transform(F.split(text, "\n\n"), lambda s: F.transform(F.split(s, "\n"), leaves))


def root(tree: Column) -> Column:
    return _hash("r", F.transform(tree, lambda s: _hash("s", F.transform(s, lambda p: _hash("p", p)))))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal leaves of two trees (Dice, by different leaves): 0 to 1."""
    x, y = F.array_distinct(F.flatten(F.flatten(a))), F.array_distinct(F.flatten(F.flatten(b)))
    both = F.size(x) + F.size(y)
    return F.when(both == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / both)


def differing_paragraphs(a: Column, b: Column) -> Column:
    """(section, paragraph) places of ``a`` whose hashes ``b`` does not have there."""
    def places(s: Column, i: Column) -> Column:
        other = F.get(b, i)
        return F.filter(
            F.transform(s, lambda p, j: F.struct(i.alias("section"), j.alias("paragraph"), p.eqNullSafe(F.get(other, j)).alias("same"))),
            lambda x: ~x["same"])
    return F.transform(F.flatten(F.transform(a, places)), lambda x: F.struct(x["section"], x["paragraph"]))


def edits(a: Column, b: Column) -> Column:
    """Array of (side, section, paragraph): where two trees differ, side ``a`` for
    what only the first holds (removed), ``b`` for what only the second does (added).

    Children are aligned by hash, so what moves or is shifted is no edit: sections
    with an equal one in the other tree are left out whole, and of the others
    only paragraphs that no unequal section of the other tree holds are reported.
    Equal trees give an empty array; how often a paragraph repeats is no edit.
    """
    def nodes(tree: Column) -> Column:
        hashed = F.transform(tree, lambda s: F.transform(s, lambda p: _hash("p", p)))
        return F.transform(hashed, lambda ps, i: F.struct(i.alias("section"), _hash("s", ps).alias("hash"), ps.alias("paragraphs")))

    def once(value: Column, use: Callable[[Column], Column]) -> Column:  # one evaluation, however often ``use`` names it
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def among(items: Column, hashes: Column) -> Column:
        return once(F.struct(items.alias("items"), hashes.alias("hashes")),
                    lambda t: F.filter(t["items"], lambda x: F.array_contains(t["hashes"], x["hash"])))

    def unequal(own: Column, other: Column) -> Column:
        return among(own, F.array_except(own["hash"], other["hash"]))

    def places(own: Column, other: Column, side: str) -> Column:
        every = F.flatten(F.transform(own, lambda s: F.transform(s["paragraphs"], lambda p, j: F.struct(
            F.lit(side).alias("side"), s["section"].alias("section"), j.alias("paragraph"), p.alias("hash")))))
        found = among(every, F.array_except(F.flatten(own["paragraphs"]), F.flatten(other["paragraphs"])))
        return F.transform(found, lambda x: F.struct(x["side"].alias("side"), x["section"].alias("section"), x["paragraph"].alias("paragraph")))

    both = F.struct(nodes(a).alias("a"), nodes(b).alias("b"))
    left = lambda t: F.struct(unequal(t["a"], t["b"]).alias("a"), unequal(t["b"], t["a"]).alias("b"))
    return once(once(both, left), lambda t: F.concat(places(t["a"], t["b"], "a"), places(t["b"], t["a"], "b")))


def with_next_text(docs: DataFrame, bucket_rows: int = 1000, ranges: int = 1024) -> DataFrame:
    """(doc_id, text, next_text) in descending order of doc_id, the last followed
    by the first.

    Ids are dealt into buckets: quantiles bound ``ranges`` of them, each split
    evenly, so a bucket holds about ``bucket_rows`` documents.  A window orders
    each bucket, and the first document of a bucket is also sent to the bucket
    before it.  Texts move once.
    """
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    points = [i / ranges for i in range(ranges + 1)]
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("doc_id", points, 10 * ranges).alias("q")).first()
    bounds = sorted(set(stats.q or [0]))
    each = max(1, -(-stats.n // (bucket_rows * max(1, len(bounds) - 1))))
    table = F.array(*[F.lit(b) for b in bounds])
    # binary search in the bounds: the highest range that starts at or below the id
    at = F.lit(0)
    step = 1 << max(0, (len(bounds) - 1).bit_length() - 1)
    ordered = rows
    ordered = ordered.withColumn("_at", at)
    while step:
        go = F.coalesce(F.get(table, F.col("_at") + step) <= F.col("doc_id"), F.lit(False))
        ordered = ordered.withColumn("_at", F.when(go, F.col("_at") + step).otherwise(F.col("_at")))
        step >>= 1
    low, high = F.get(table, F.col("_at")), F.coalesce(F.get(table, F.col("_at") + 1), F.get(table, F.col("_at")))
    part = F.when(high > low, F.least(F.lit(each - 1), F.greatest(F.lit(0), F.floor((F.col("doc_id") - low).cast("double") * each / (high - low).cast("double")))))
    # descending: high ids first; nulls last; a key of the text splits an id that many rows repeat
    bucket = F.when(F.col("doc_id").isNull(), F.lit(1).cast("long")).otherwise(-(F.col("_at").cast("long") * each + F.coalesce(part, F.lit(0)).cast("long")))
    ordered = ordered.withColumn("bucket", bucket).drop("_at")
    heads = ordered.groupBy("bucket").agg(F.min(F.struct((-F.col("doc_id")).alias("k"), F.xxhash64("text").alias("h"), F.xxhash64("text", F.lit(1)).alias("g"))).alias("s"))
    line = Window.orderBy("bucket")
    whole = Window.partitionBy(F.lit(0))
    heads = heads.select("bucket", "s.*").withColumn("_to", F.coalesce(F.lag("bucket").over(line), F.max("bucket").over(whole)))
    heads = cut_lineage(heads)
    count = heads.count()
    keyed = ordered.withColumns({"k": -F.col("doc_id"), "h": F.xxhash64("text"), "g": F.xxhash64("text", F.lit(1))})
    first = small_or_merge(heads.select(F.col("k").alias("_k"), F.col("h").alias("_h"), F.col("g").alias("_g"), "_to"), count, 40, 8 << 20)
    halo = keyed.join(first, F.col("k").eqNullSafe(F.col("_k")) & (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g")))
    halo = halo.select("doc_id", "text", "k", "h", "g", F.col("_to").alias("bucket"), F.lit(1).alias("edge")).dropDuplicates(["bucket"])
    order = Window.partitionBy("bucket").orderBy("edge", F.col("k").asc_nulls_last(), "h", "g")
    both = keyed.select("doc_id", "text", "k", "h", "g", "bucket", F.lit(0).alias("edge")).unionByName(halo)
    return both.withColumn("next_text", F.lead("text").over(order)).filter("edge = 0").select("doc_id", "text", "next_text")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edit (the second half replaced by the
    start of the next document) and how like both are."""
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    texts = with_next_text(docs).select("doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), "next_text")
    trees = texts.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        branches(F.col("text")).alias("tree"), branches(F.col("edited")).alias("edited_tree"), branches(F.col("next_text")).alias("next_tree"),
    )
    return trees.select(
        "doc_id", "n_chars", "edited_sha256", root(F.col("tree")).alias("fingerprint"), root(F.col("edited_tree")).alias("edited_fingerprint"),
        likeness(F.col("tree"), F.col("edited_tree")).alias("near_edited"), likeness(F.col("tree"), F.col("next_tree")).alias("near_next"),
        F.size(differing_paragraphs(F.col("tree"), F.col("edited_tree"))).cast("long").alias("n_differing"),
    )
