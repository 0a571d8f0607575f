"""Line deduplication by log templates.

A fixed-depth tree parses every line: its first level is the number of tokens,
the next ones its leading tokens, where a token with a digit counts as variable.
Within a leaf, a token that few lines share at its place is a variable field
too; what stays is the line's template.  Templates found in many different texts
are boilerplate, and their lines are dropped from every text.  The tree is a set of
keys, so the work is counting by key: the order of lines has no influence, nothing is
gathered per leaf, and counts are combined before every shuffle.

Near copies of one text share nearly all their lines, without any of these being
boilerplate.  They also share leaves where they differ in a word.  So a template is
supported only by texts with something of their own: at least ``own_share`` of their
words in lines whose leaf fewer than ``min_docs`` texts reach.

Defined cases: only different texts count, so exact copies of a document never make
its lines recur; a line of less than ``short_tokens`` tokens recurs only if
``short_share`` of all different texts support it, longer ones from ``min_docs`` texts
on; lines without tokens stay; null texts stay null, a text of nothing but
boilerplate becomes empty.  Equal texts get equal results, whatever their ids, so null
and repeated ids need no care.  Other columns are carried, whatever their names, except
that ``lines_dropped`` is added (or replaced); an integer ``n_chars`` follows the new
text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.llm.common import small_or_merge
from metricloom.session import cut_lineage

VARIABLE = "<*>"


def _tokens(line: Column) -> Column:
    return F.filter(F.split(line, " "), lambda x: x != "")


def _masked(tokens: Column) -> Column:
    return F.transform(tokens, lambda x: F.when(x.rlike("[0-9]"), VARIABLE).otherwise(x))


def _text_key(text: Column | str) -> list[Column]:
    """Two independent hashes of a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


KEY = ["k1", "k2"]


def parsed_lines(docs: DataFrame, depth: int) -> DataFrame:
    """(k1, k2, pos, tokens, leaf) of the lines with tokens; ``leaf`` is the node of the
    tree: token count and masked leading tokens."""
    lines = docs.select(*_text_key("text"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    cut = lines.select(*KEY, "pos", _tokens(F.col("line")).alias("tokens")).filter(F.size("tokens") > 0)
    return cut.withColumn("leaf", F.xxhash64(F.size("tokens"), _masked(F.slice("tokens", 1, depth))))


def _checked(table: DataFrame, row_bytes: int) -> DataFrame:
    """A written table, broadcast only if its counted rows are few."""
    return small_or_merge(table, table.count(), row_bytes, 8 << 20)


def recurring_lines(
    docs: DataFrame, depth: int = 3, min_docs: int = 3, min_constant: float = 0.7,
    own_share: float = 0.2, short_tokens: int = 3, short_share: float = 0.001,
) -> tuple[DataFrame, DataFrame]:
    """(lines of live leaves, line keys of recurring templates).

    A leaf is live if at least ``min_docs`` different texts reach it.  A token is
    constant if lines of at least ``min_docs`` texts share it at its place; a
    template counts if ``min_constant`` of its tokens are constant and enough
    different texts with lines of their own hold its lines.
    """
    lines = parsed_lines(docs, depth)
    leaves = lines.select("leaf", *KEY).distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("texts"))
    live = _checked(cut_lineage(leaves.filter(F.col("texts") >= min_docs).select("leaf")), 16)
    found = lines.join(live, "leaf", "left_semi").select(*KEY, "pos", "leaf", _masked(F.col("tokens")).alias("tokens"))
    found = cut_lineage(found.withColumn("line_key", F.xxhash64("leaf", "tokens")))

    texts_of = found.select("line_key", *KEY).distinct().groupBy("line_key").agg(F.count(F.lit(1)).alias("texts"))
    shapes = found.groupBy("line_key").agg(F.first("leaf").alias("leaf"), F.first("tokens").alias("tokens"))
    shapes = cut_lineage(shapes.join(texts_of, "line_key"))
    cells = shapes.select("line_key", "leaf", "texts", F.posexplode("tokens").alias("place", "token"))
    cells = cells.select("line_key", "texts", F.xxhash64("leaf", "place", "token").alias("cell"), (F.col("token") != VARIABLE).alias("fixed"))
    support = cells.filter("fixed").groupBy("cell").agg(F.sum("texts").alias("support"))
    constant = cells.join(cut_lineage(support.filter(F.col("support") >= min_docs).select("cell", F.lit(True).alias("shared"))), "cell", "left")
    kept = F.col("fixed") & F.coalesce("shared", F.lit(False))
    templates = constant.groupBy("line_key").agg(
        F.count(F.lit(1)).alias("size"), F.count(F.when(kept, 1)).alias("constants"),
        F.bit_xor(F.when(kept, F.xxhash64("cell", F.lit(1)))).alias("a"), F.bit_xor(F.when(kept, F.xxhash64(F.lit(2), "cell"))).alias("b"),
    ).filter(F.col("constants") >= F.col("size") * min_constant)
    templates = cut_lineage(templates.select("line_key", "a", "b", "size"))

    # texts with lines of their own: their words and those in live leaves, as counts
    words = F.size(F.filter(F.split(F.regexp_replace("text", "\n", " "), " "), lambda x: x != ""))
    whole = docs.filter(F.col("text").isNotNull()).select(*_text_key("text"), words.alias("words")).groupBy(*KEY).agg(F.max("words").alias("words"))
    shared = found.select(*KEY, "pos", F.size("tokens").alias("n")).distinct().groupBy(*KEY).agg(F.sum("n").alias("shared"))
    n_texts = whole.count()
    own = cut_lineage(shared.join(whole, KEY).filter(F.col("words") - F.col("shared") >= F.col("words") * own_share).select(*KEY))
    held = found.select("line_key", *KEY).distinct().join(_checked(own, 24), KEY, "left_semi")
    seen = held.join(templates, "line_key").select("a", "b", "size", *KEY).distinct()
    enough = F.when(F.col("size") < short_tokens, F.greatest(F.lit(min_docs), F.lit(short_share * n_texts))).otherwise(F.lit(min_docs))
    often = cut_lineage(seen.groupBy("a", "b", "size").agg(F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= enough))
    return found, cut_lineage(templates.join(often, ["a", "b", "size"]).select("line_key", "texts"))


def drop_recurring_lines(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``; ``lines_dropped`` added."""
    found, recurring = recurring_lines(docs, **how)
    recurring = _checked(recurring.select("line_key"), 16)
    hits = found.join(recurring, "line_key", "left_semi").select(*KEY, "pos").distinct()
    drops = cut_lineage(hits.groupBy(*KEY).agg(F.array_sort(F.collect_list("pos")).alias("places")))
    size = drops.agg(F.coalesce(F.sum(F.size("places") * 4 + 64), F.lit(0))).first()[0]  # as measured, not per row
    drops = small_or_merge(drops, size, 1, 16 << 20)
    rest = docs.drop("lines_dropped")
    # the caller's columns travel in one, so no name of theirs meets one of ours
    packed = rest.select(F.struct(*[F.col(f"`{c}`") for c in rest.columns]).alias("row"), *_text_key("text"))
    joined = packed.join(drops, KEY, "left")
    text, cut = F.col("row.text"), F.col("row.text").isNotNull() & F.col("places").isNotNull()
    # the text is split once; a line does not split it again
    kept = F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains("places", i))
    cleaned = F.when(cut, F.array_join(kept, "\n")).otherwise(text)
    columns = []
    for f in rest.schema:
        if f.name == "text":
            columns.append(cleaned.alias("text"))
        elif f.name == "n_chars" and isinstance(f.dataType, T.IntegralType):
            columns.append(F.when(cut, F.char_length(cleaned)).otherwise(F.col("row.n_chars")).cast(f.dataType).alias("n_chars"))
        else:
            columns.append(F.col(f"row.`{f.name}`"))
    return joined.select(*columns, F.when(cut, F.size("places")).otherwise(0).alias("lines_dropped"))
