"""Near-duplicate classes by BagMinHash over word shingles.

A text is a multiset of shingles (five words, split at Unicode white space, lower case).
Every shingle drives hierarchical Poisson processes over discretised weights:
one process per doubling of the weight, (0, 1], (1, 2], (2, 4], ..., whose points
carry a time, a weight level and a register; points above the shingle's weight
are void.  A register keeps its earliest time, so two texts agree in a register
with a probability equal to their weighted Jaccard similarity, and the work per
shingle grows with the logarithm of its weight.  A process ends once its time
passes the latest register.

Registers are banded; texts that share a band meet the most central text of the
bucket first, and the exact multiset overlap of each such pair decides.  Of two
similar texts in different classes each must hold one of the other's rarest
shingles (a fifth of its weight, see ``open_nodes``); texts that hold none of
another class, such as those that only share a passage, are settled there.  The
rest is compared member by member in the buckets that still hold several classes:
on registers in bounded blocks, and what looks similar is verified exactly in the
same task, so that no candidate pairs are emitted.

Defined cases: exact copies are one node before any banding, so a group of
copies costs one text; a null text is empty; texts without words equal only each
other, shorter ones than a shingle are one shingle of all their words.  A node is
a text, by its key ``k1``; ids only name classes in the result.  A null ``doc_id``
is replaced by a hash of the text; rows that repeat an id with different texts are
of a common class only if similar.  Other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import small_or_merge, text_slices
from metricloom.llm.tokens import bounds_of, gather
from metricloom.operators.clustering import connected_components
from metricloom.session import cut_lineage

WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 42, 6
U = np.uint64
SLOTS = 1 << 18  # of the count that orders shingles by rarity: 2 MB
MAX_SLICE = 4096  # rows of a slice: the place of a row takes 12 bits beside a 52-bit shingle


def mix(z: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, weight) of at most ``MAX_SLICE`` texts, by row and shingle."""
    import xxhash

    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    n = len(texts)
    flat = lists.flatten()
    bounds = lists.offsets.to_numpy()
    row = np.repeat(np.arange(n, dtype=np.uint64), np.diff(bounds))
    filled = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    codes = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    row, word = row[filled], (codes[coded.indices.to_numpy()] if len(codes) else np.zeros(0, np.uint64))[filled]
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    number = np.bincount(row.astype(np.int64), minlength=n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
    left = np.repeat(number, number) - place  # words from here to the end of the text
    sums = np.zeros(len(row), np.uint64)
    for k in range(min(words, len(row))):
        inside = left > k
        sums[: len(row) - k] += np.where(inside[: len(row) - k], word[k:] * U(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)), U(0))
    starts = (left >= words) | (place == 0)
    key = np.sort((row[starts] << U(52)) | (mix(sums[starts]) >> U(12)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    weight = np.diff(np.append(first, len(key)))
    return (key[first] >> U(52)).astype(np.int64), key[first] & U((1 << 52) - 1), weight


def signatures(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """(n, m) register times; infinite for rows without shingles."""
    level = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1  # processes per shingle
    own = np.repeat(np.arange(len(row)), level)
    step = np.arange(len(own)) - np.repeat(np.cumsum(level) - level, level)
    low = np.where(step > 0, 1 << np.maximum(step - 1, 0), 0)
    width = np.maximum(low, 1)
    doc, limit = row[own], weight[own]
    seed = mix(shingle[own] + U(0x9E3779B97F4A7C15) * step.astype(np.uint64))
    time, point = np.zeros(len(own)), np.zeros(len(own), np.int64)
    best = np.full(n * m, np.inf)
    total = np.bincount(row, weight, n)
    each = np.maximum(1, np.ceil((np.log(m) + 1) * m / np.maximum(total, 1)))
    burst = (1 << np.ceil(np.log2(each)).astype(np.int64))  # points drawn at once, a power of two
    active = np.arange(len(own))
    while len(active):
        sizes = burst[doc[active]]
        for size in np.unique(sizes):
            rows = active[sizes == size]
            for at in range(0, len(rows), max(1, (1 << 18) // int(size))):
                r = rows[at : at + max(1, (1 << 18) // int(size))]
                z = mix(seed[r, None] + (point[r, None] + np.arange(1, size + 1)).astype(np.uint64) * U(0xD1B54A32D192ED03))
                gap = -np.log(((z >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[r, None]
                gap[:, 0] += time[r]
                times = np.cumsum(gap, axis=1)
                time[r] = times[:, -1]
                z = mix(z)
                register = ((z & U(0xFFFFFFFF)) * U(m) >> U(32)).astype(np.int64)
                height = low[r, None] + 1 + ((z >> U(32)) * width[r, None].astype(np.uint64) >> U(32)).astype(np.int64)
                valid = height <= limit[r, None]
                np.minimum.at(best, (doc[r, None] * m + register)[valid], times[valid])
        point[active] += sizes
        latest = best.reshape(n, m).max(axis=1)
        active = active[time[active] < latest[doc[active]]]
        burst = np.maximum(burst // 2, 1)
    return best.reshape(n, m)


def _signed(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(id, k1, k2, bands, registers) of every document."""
    m = bands * rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for whole, all_texts in text_slices(batch, size=2 << 20):
                for at in range(0, len(whole), MAX_SLICE):
                    part, texts = whole.slice(at, MAX_SLICE), all_texts.slice(at, MAX_SLICE)
                    row, shingle, weight = shingles(texts, words)
                    times = signatures(row, shingle, weight, len(part), m)
                    bits = mix(times.view(np.uint64)).reshape(len(part), bands, rows)
                    key = np.zeros((len(part), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
                    for k in range(rows):
                        key = mix(key * U(0x9E3779B97F4A7C15) + bits[:, :, k])
                    filled = np.isfinite(times[:, 0])
                    lists = pa.array([list(k) if f else [] for k, f in zip(key.view(np.int64), filled)], pa.list_(pa.int64()))
                    short = (bits.reshape(len(part), m) & U(0xFFFF)).astype(np.uint16)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id"), part.column("k1"), part.column("k2"), lists, pa.array([s.tobytes() for s in short], pa.binary())],
                        ["id", "k1", "k2", "bands", "registers"],
                    )

    text = F.coalesce("text", F.lit(""))
    k1, k2 = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), k1).alias("id"), k1.alias("k1"), k2.alias("k2"), "text")
    return keyed.mapInArrow(sign, "id long, k1 long, k2 long, bands array<long>, registers binary")


def overlaps(left: pa.Array, right: pa.Array, words: int = WORDS) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets of paired texts."""
    coded = pa.concat_arrays([left, right]).dictionary_encode()
    place = coded.indices.to_numpy().astype(np.int64)
    return paired_overlaps(coded.dictionary, place[: len(left)], place[len(left) :], words)


def paired_overlaps(texts: pa.Array, left: np.ndarray, right: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Similarities of the texts at the places ``left`` and ``right``.

    Each text is cut into shingles once; pairs are compared in groups of about a
    million shingles.
    """
    n = len(left)
    if not n:
        return np.zeros(0)
    parts = [shingles(texts.slice(at, MAX_SLICE), words) for at in range(0, len(texts), MAX_SLICE)]
    row = np.concatenate([p[0] + i * MAX_SLICE for i, p in enumerate(parts)])
    shingle, weight = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
    bounds = bounds_of(np.bincount(row, minlength=len(texts)))
    total = np.bincount(row, weight, len(texts))
    sizes = np.diff(bounds)
    ends, out, start = np.cumsum(sizes[left] + sizes[right]), np.zeros(n), 0
    while start < n:
        stop = min(start + MAX_SLICE, max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + (1 << 20)))))
        pairs = np.concatenate([left[start:stop], right[start:stop]])
        which, _ = gather(np.arange(len(row)), bounds, pairs)
        pair = np.repeat(np.tile(np.arange(stop - start, dtype=np.uint64), 2), sizes[pairs])
        key, w = (pair << U(52)) | shingle[which], weight[which]
        order = np.argsort(key, kind="stable")
        key, w = key[order], w[order]
        same = np.flatnonzero(key[1:] == key[:-1])
        shared = np.bincount((key[same] >> U(52)).astype(np.int64), np.minimum(w[same], w[same + 1]), stop - start)
        union = total[left[start:stop]] + total[right[start:stop]] - shared
        out[start:stop] = np.where(union > 0, shared / np.maximum(union, 1), 0)
        start = stop
    return out


def node_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the nodes in ``wanted``, a written table, one row each; other
    texts do not move."""
    text = F.coalesce("text", F.lit(""))
    nodes = docs.select(F.xxhash64(text).alias("node"), text.alias("text"))
    found = nodes.join(small_or_merge(wanted, wanted.count(), 16, 8 << 20), "node", "left_semi")
    return found.dropDuplicates(["node"])


def verified(pairs: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) whose texts overlap enough, as edges (u, v).

    The texts of paired nodes alone are shuffled, once for each side; AQE splits
    the pairs of a text that many others meet.
    """
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    wanted = cut_lineage(wanted.distinct())
    nodes = node_texts(docs, wanted)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, left in text_slices(batch, "text_a", 2 << 20):
                right = part.column("text_b").cast(pa.large_string())
                good = pa.array(overlaps(left, right, words) >= similarity)
                yield part.select(["u", "v"]).filter(good)

    left = nodes.withColumnsRenamed({"node": "a", "text": "text_a"})
    right = nodes.withColumnsRenamed({"node": "b", "text": "text_b"})
    both = pairs.join(left, "a").join(right, "b")
    return both.select(F.col("a").alias("u"), F.col("b").alias("v"), "text_a", "text_b").mapInArrow(check, "u long, v long")


def open_nodes(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node) of the ``texts`` (node, root, text) that may be similar to one of another root.

    All shingles have one order, rare ones first.  A text's prefix holds its first
    shingles up to the one with which their weight exceeds a share of 1 - ``similarity``.
    Two texts with a weighted Jaccard similarity of ``similarity`` share more than the
    weight behind either prefix, so their prefixes meet; a text whose prefix meets none
    of another root is similar to none.  Any order is right: rarity is counted in
    ``SLOTS`` slots of a hash, a table of fixed size.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, all_texts in text_slices(batch, size=2 << 20):
                for at in range(0, len(all_texts), MAX_SLICE):
                    _, shingle, _ = shingles(all_texts.slice(at, MAX_SLICE), words)
                    total += np.bincount((shingle % U(SLOTS)).astype(np.int64), minlength=SLOTS)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], ["slot", "n"])

    slots = texts.select("text").mapInArrow(counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(SLOTS, np.int64)
    table[slots["slot"].to_numpy(np.int64)] = slots["n"].to_numpy(np.int64)
    table = texts.sparkSession.sparkContext.broadcast(table)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for whole, all_texts in text_slices(batch, size=2 << 20):
                for at in range(0, len(whole), MAX_SLICE):
                    part = whole.slice(at, MAX_SLICE)
                    row, shingle, weight = shingles(all_texts.slice(at, MAX_SLICE), words)
                    order = np.lexsort((shingle, table.value[(shingle % U(SLOTS)).astype(np.int64)], row))
                    row, shingle, weight = row[order], shingle[order], weight[order]
                    total = np.bincount(row, weight, len(part))
                    before = np.cumsum(weight) - weight - (np.cumsum(total) - total)[row]
                    early = before <= (1 - similarity) * total[row] + 1e-6
                    which = pa.array(row[early])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shingle[early].astype(np.int64)), part.column("node").take(which), part.column("root").take(which)], ["shingle", "node", "root"]
                    )

    keyed = cut_lineage(texts.select("node", "root", "text").mapInArrow(prefixes, "shingle long, node long, root long"))
    mixed = keyed.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("shingle")
    return keyed.select("shingle", "node").join(mixed, "shingle", "left_semi").select("node").distinct()


def _links_across(members: DataFrame, words: int, similarity: float, block: int) -> DataFrame:
    """Edges (u, v) between the roots of similar members of a bucket.

    ``members`` (bucket, node, root, registers, text) is dealt into blocks of
    about ``block`` members; each pair of blocks of a bucket is one group of rows,
    and groups stream through a task sorted, so a task holds two blocks.  Pairs
    whose registers agree to within five standard errors are verified exactly
    where they are: only links leave the task.
    """
    sizes = cut_lineage(members.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")))
    dealt = members.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = dealt.withColumn("other", other)
    spread = spread.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("blocks", "other")
    keys = ["bucket", "lo", "hi"]

    def pairs_of(g: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(g["registers"]), np.uint16).reshape(len(g), -1)
        root, own = (g[c].to_numpy() for c in ("root", "own"))
        m = sig.shape[1]
        least = (similarity - 5 * np.sqrt(similarity * (1 - similarity) / m)) * m
        one_block = g["lo"].iat[0] == g["hi"].iat[0]
        left, right = [], []
        for i in range(len(g)):
            js = np.arange(i + 1, len(g))
            js = js[(root[js] != root[i]) & (one_block | (own[js] != own[i]))]
            for at in range(0, len(js), 4096):
                j = js[at : at + 4096]
                j = j[(sig[j] == sig[i]).sum(1) >= least]
                left.append(np.full(len(j), i))
                right.append(j)
        i, j = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right))
        good = paired_overlaps(pa.array(g["text"].to_list(), pa.large_string()), i, j, words) >= similarity
        return pd.DataFrame({"u": root[i[good]], "v": root[j[good]]}).drop_duplicates()

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for df in frames:
            df = df if rest is None else pd.concat([rest, df], ignore_index=True)
            key = df[keys].to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for a, b in zip(np.append(0, cuts[:-1]), cuts):
                yield pairs_of(df.iloc[a:b])
            rest = df.iloc[cuts[-1] if len(cuts) else 0 :]
        if rest is not None and len(rest):
            yield pairs_of(rest)

    return spread.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(stream, "u long, v long").distinct()


def near_duplicates(
    docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, block: int = 500
) -> DataFrame:
    """(doc_id, k1, k2, class_key, class_id): one row per document; ``class_key`` tells
    classes apart, ``class_id`` is the smallest id in the class.  Classes of
    different texts that repeat an id may have the same ``class_id``."""
    signed = cut_lineage(_signed(docs, words, bands, rows).withColumn("place", F.monotonically_increasing_id()))
    ids = signed.select("id", "k1", "k2", "place")
    groups = cut_lineage(ids.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.min("place").alias("place")))
    nodes = signed.join(groups.drop("id"), ["k1", "k2", "place"], "left_semi").filter(F.size("bands") > 0)
    nodes = nodes.select(F.col("k1").alias("node"), "bands", "registers")
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = cut_lineage(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    joined = cut_lineage(banded.join(shared, "bucket"))
    # the text that meets most others leads a bucket: copies of a common origin differ less from it than from each other
    degree = cut_lineage(joined.groupBy("node").agg(F.sum("n").alias("degree")))
    central = F.max_by("node", F.struct("degree", "node"))
    leaders = cut_lineage(joined.join(degree, "node").groupBy("bucket").agg(central.alias("b")))
    members = cut_lineage(joined.join(leaders, "bucket").select("bucket", F.col("node").alias("a"), "b", "n"))
    met = cut_lineage(members.filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("bands")))
    check = partial(verified, docs=docs, words=words, similarity=similarity)

    # the leader that a text meets most often settles most classes; others are checked only across those seen so far
    first = cut_lineage(met.groupBy("a").agg(F.max_by("b", F.struct("bands", "b")).alias("b")))
    links = cut_lineage(check(first))

    def root_of(df: DataFrame, column: str, name: str, roots: DataFrame) -> DataFrame:
        joined = df.join(roots.withColumnsRenamed({"node": column, "root": name}), column, "left")
        return joined.withColumn(name, F.coalesce(name, column))

    hop = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    hops = cut_lineage(root_of(hop.withColumnRenamed("root", "next"), "next", "then", hop).select("node", F.least("next", "then").alias("root")))
    across = met.join(first, ["a", "b"], "left_anti")
    across = root_of(root_of(across, "a", "ra", hops), "b", "rb", hops).filter("ra <> rb")
    links = cut_lineage(links.unionByName(check(cut_lineage(across.select("a", "b")))))
    roots = connected_components(links)

    rooted = cut_lineage(root_of(members.filter("n > 2").select("bucket", F.col("a").alias("node")), "node", "root", roots))
    wanted = cut_lineage(rooted.select("node", "root").distinct())
    texts = cut_lineage(node_texts(docs, wanted.select("node")).join(wanted, "node"))
    still = cut_lineage(open_nodes(texts, words, similarity))
    rooted = cut_lineage(rooted.join(still, "node", "left_semi"))
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("bucket")
    open_members = cut_lineage(rooted.join(cut_lineage(mixed), "bucket", "left_semi"))
    whole = nodes.select("node", "registers").join(texts.drop("root"), "node")
    more = cut_lineage(_links_across(open_members.join(whole, "node"), words, similarity, block))
    if not more.isEmpty():
        # classes that were found similar become one: components of roots
        upper = cut_lineage(connected_components(more))
        alone = upper.select("node", F.col("node").alias("root")).join(roots, "node", "left_anti")
        joined = roots.unionByName(alone).withColumnRenamed("root", "under")
        roots = cut_lineage(root_of(joined, "under", "root", upper).select("node", "root"))

    # ids come in last: the smallest of a class names it
    named = roots.join(groups.select(F.col("k1").alias("node"), "id"), "node")
    named = cut_lineage(named.groupBy(F.col("root").alias("class_key")).agg(F.min("id").alias("least")))
    classes = root_of(groups.drop("place"), "k1", "class_key", roots).join(small_or_merge(named, named.count(), 16, 8 << 20), "class_key", "left")
    classes = cut_lineage(classes.select("k1", "k2", "class_key", F.coalesce("least", "id").alias("class_id")))
    rows_of = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k1"), F.xxhash64(F.lit(1), F.coalesce("text", F.lit(""))).alias("k2"))
    return rows_of.join(classes, ["k1", "k2"])


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """One document of each class: the one whose id names the class, of several such
    texts the one of the smallest key.  Rows that repeat its id and text are reduced
    to one."""
    text = F.coalesce("text", F.lit(""))
    node = F.coalesce(F.col("doc_id").cast("long"), "k1")
    kept = near_duplicates(docs, **how).filter(node == F.col("class_id")).groupBy("class_key", "class_id", "k1", "k2").agg(F.count(F.lit(1)).alias("_rows"))
    kept = kept.groupBy("class_key").agg(F.min(F.struct("k1", "k2", "class_id", "_rows")).alias("s"))
    kept = cut_lineage(kept.select(F.col("s.class_id").alias("_node"), F.col("s.k1").alias("_k1"), F.col("s.k2").alias("_k2"), "s._rows"))
    keyed = docs.withColumns({"_node": F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)), "_k1": F.xxhash64(text), "_k2": F.xxhash64(F.lit(1), text)})
    n = kept.count()
    out = keyed.join(small_or_merge(kept, n, 32, 8 << 20), ["_node", "_k1", "_k2"])
    if kept.filter("_rows > 1").isEmpty():
        return out.select(*docs.columns)
    return out.filter("_rows = 1").select(*docs.columns).unionByName(out.filter("_rows > 1").dropDuplicates(["_node", "_k1", "_k2"]).select(*docs.columns))
