"""Ranked lexical search over FP-trees of documents.

Documents are reduced to the terms that the items use, with their counts.  Terms are
numbered by falling document frequency, so the sorted term lists of documents share
prefixes, which are the paths of a trie: a node is a run of documents that share a
prefix.  Every node keeps, over its subtree, the largest count of each term and the
smallest length factor m.  A score grows with the counts and falls with m, so these
give an upper bound of the subtree.  Each item searches the trie depth first, the
best bound first, and leaves out what its bound proves to be below its 20 best so far;
the documents of a leaf are scored exactly.  Trees are built by each task from the
rows it streams, ``cells`` table cells at a time, and an item's best carry over from
tree to tree, so no documents move; a task sends at most ``best`` rows per item, and
these are ranked in two steps.

Items are searched in blocks of about ``block_bytes`` of text, one pass over the
documents each; what a pass ships to the tasks is bounded by that, not by documents.

Defined cases: texts without a term (null, empty) match nothing; rows that repeat an id
are separate documents, equal scores are ranked by id, null ids last; an item without
terms or matches has no rows; rows of ``items`` that repeat an id are separate items.
Ids are longs below 2^63 - 1.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.common import small_or_merge, text_slices, trim
from metricloom.session import cut_lineage

BEST, LEAF, CELLS, BLOCK_BYTES = 20, 32, 8 << 20, 8 << 20
NO_ID = np.iinfo(np.int64).max
#: Bytes of terms: digits, letters (A-Z lower-cased) and all of other characters; the rest are blanks.
TERM_BYTES = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
VECTORS = "doc_id long, n long, terms array<int>, counts array<long>"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def restricted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of every document with a term; ``terms`` holds those
    of the vocabulary alone."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.keys()
        for batch in batches:
            for part, texts in text_slices(batch):
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), texts.cast(pa.large_binary()).to_pylist()):
                    words = terms_of(text)
                    if words:
                        found = Counter(words)
                        own = found.keys() & known
                        rows.append((doc_id, len(words), [vocabulary[t] for t in own], [found[t] for t in own]))
                columns = list(zip(*rows)) or [[]] * 4
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, VECTORS)


def term_scores(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Share of a term's weight, in thousandths of a thousandth: grows with tf, falls with m."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m[:, None])


class Tree:
    """FP-tree of documents given by ``lists`` of ascending term numbers."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, lists: list[np.ndarray], counts: list[np.ndarray], width: int, leaf: int = LEAF):
        paths = [x.astype(">u4").tobytes() for x in lists]
        order = sorted(range(len(paths)), key=paths.__getitem__)
        self.ids, self.m = ids[order], m[order]
        largest = max((int(c.max()) for c in counts if len(c)), default=0)
        self.tf = np.zeros((len(order), width), np.int32 if largest < 1 << 31 else np.int64)
        for row, i in enumerate(order):
            self.tf[row, lists[i]] = counts[i]
        shared = np.zeros(len(order), np.int64)  # leading terms in common with the row before
        for row in range(1, len(order)):
            a, b = lists[order[row - 1]], lists[order[row]]
            k = min(len(a), len(b))
            unlike = np.flatnonzero(a[:k] != b[:k])
            shared[row] = unlike[0] if len(unlike) else k
        self._grow(shared, leaf)

    def _grow(self, shared: np.ndarray, leaf: int) -> None:
        """Nodes in preorder: row range and children.  Small neighbours under one
        node share a leaf."""
        self.lo, self.hi, self.children = [], [], []
        todo = [(0, len(self.ids), -1)]
        while todo:
            lo, hi, parent = todo.pop()
            node = len(self.lo)
            self.lo.append(lo)
            self.hi.append(hi)
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if hi - lo <= leaf:
                continue
            inner = shared[lo + 1 : hi]
            starts = np.concatenate([[lo], lo + 1 + np.flatnonzero(inner == inner.min())])
            sizes = np.diff(np.append(starts, hi))
            group = 0  # rows of the open group of small subtrees
            cuts = []
            for start, size in zip(starts.tolist(), sizes.tolist()):
                if not cuts or group == 0 or size > leaf or group + size > leaf:
                    cuts.append(start)
                    group = 0
                group = 0 if size > leaf else group + size
            if len(cuts) > 1:
                todo += [(a, b, node) for a, b in zip(cuts, [*cuts[1:], hi])]
        n = len(self.lo)
        self.most = np.zeros((n, self.tf.shape[1]), self.tf.dtype)
        self.least_m, self.least_id = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for node in reversed(range(n)):
            below = self.children[node]
            rows = slice(self.lo[node], self.hi[node])
            self.most[node] = self.most[below].max(axis=0) if below else self.tf[rows].max(axis=0)
            self.least_m[node], self.least_id[node] = self.m[rows].min(), self.ids[rows].min()

    def search(self, terms: np.ndarray, weights: np.ndarray, best: "Best") -> int:
        """Adds the documents that belong to the ``best``; returns the rows scored."""
        bound = term_scores(self.most[:, terms].astype(np.int64), self.least_m) @ weights
        stack, scored = [0], 0
        while stack:
            node = stack.pop()
            if not best.open_to(int(bound[node]), int(self.least_id[node])):
                continue
            below = self.children[node]
            if below:
                stack += sorted(below, key=bound.__getitem__)  # the best bound is on top
                continue
            rows = slice(self.lo[node], self.hi[node])
            score = term_scores(self.tf[rows][:, terms].astype(np.int64), self.m[rows]) @ weights
            scored += len(score)
            best.add(score, self.ids[rows])
        return scored


class Best:
    """The ``size`` highest scores above 0, equal ones by ascending id."""

    def __init__(self, size: int = BEST):
        self.size, self.score, self.ids = size, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def open_to(self, bound: int, least_id: int) -> bool:
        """Whether a document of at most this score and at least this id may enter."""
        if bound <= 0:
            return False
        if len(self.score) < self.size:
            return True
        last = int(self.score[-1])
        return bound > last or (bound == last and least_id < int(self.ids[-1]))

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        found = score > 0 if len(self.score) < self.size else score >= self.score[-1]
        if found.any():
            score, ids = np.concatenate([self.score, score[found]]), np.concatenate([self.ids, ids[found]])
            order = np.lexsort((ids, -score))[: self.size]
            self.score, self.ids = score[order], ids[order]


def _search_block(vectors: DataFrame, items: list[tuple[int, np.ndarray, np.ndarray]], number: np.ndarray, n_docs: int, n_terms: int, cells: int, best: int) -> DataFrame:
    """(item_no, doc_id, score): the best of each item in each task.  ``number`` gives
    the place of each term by falling document frequency."""
    width = len(number)
    rows_of_tree = max(16, cells // max(width, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Best(best) for _ in items]
        ids, m, lists, counts = [], [], [], []

        def grow() -> None:
            tree = Tree(np.concatenate(ids), np.concatenate(m), lists, counts, width)
            for (_, terms, weights), own in zip(items, found):
                tree.search(terms, weights, own)
            for x in (ids, m, lists, counts):
                x.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, rows_of_tree):
                part = batch.slice(at, rows_of_tree)
                if len(lists) + part.num_rows > rows_of_tree:
                    grow()
                length = part.column("n").to_numpy()
                ids.append(part.column("doc_id").fill_null(NO_ID).to_numpy())
                m.append(75 + (25 * length * n_docs) // n_terms)
                bounds = np.append(0, np.cumsum(part.column("terms").value_lengths().to_numpy()))
                terms, tf = number[part.column("terms").flatten().to_numpy()], part.column("counts").flatten().to_numpy()
                for a, b in zip(bounds, bounds[1:]):
                    order = np.argsort(terms[a:b])
                    lists.append(terms[a:b][order])
                    counts.append(tf[a:b][order])
        if lists:
            grow()
        trim()
        for (item, _, _), own in zip(items, found):
            doc_ids = pa.array(own.ids, mask=own.ids == NO_ID)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own.ids), item, np.int64)), doc_ids, pa.array(own.score)], ["item_no", "doc_id", "score"])

    return vectors.filter(F.size("terms") > 0).mapInArrow(run, "item_no long, doc_id long, score long")


def _weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def search(docs: DataFrame, items: DataFrame, best: int = BEST, cells: int = CELLS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` documents of each item."""
    asked = cut_lineage(items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("item_no", F.monotonically_increasing_id()))
    total = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    parts = []
    for block in range(blocks):
        # a block is bounded by ``block_bytes`` (and one text)
        own = asked.filter(F.pmod(F.xxhash64("item_no"), F.lit(blocks)) == block).select("item_no", "text").collect()
        texts = [(r["item_no"], Counter(terms_of(r["text"].encode()))) for r in own]
        vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for _, c in texts for t in c))}
        vectors = cut_lineage(restricted(docs, vocabulary))
        n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs or not vocabulary:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row per term of the block
            df[r["t"]] = r["count"]
        order = np.argsort(-df, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        w = _weights(df, n_docs)
        wanted = []
        for item, counted in texts:
            ids = np.array([vocabulary[t] for t in counted], np.int64)
            if len(ids):
                wanted.append((item, number[ids], w[ids] * np.array(list(counted.values()), np.int64)))
        parts.append(_search_block(vectors, wanted, number, n_docs, n_terms, cells, best))
    schema = "item_no long, doc_id long, score long"
    found = reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)
    # every task sends its best: they are ranked by groups of tasks first, so that no item's rows meet in one task
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    some = Window.partitionBy("item_no", "group").orderBy(*order)
    found = found.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(64)))
    found = found.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= best)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_no").orderBy(*order))).filter(F.col("rank") <= best)
    named = asked.select("item_no", "item_id")
    return ranked.join(small_or_merge(named, named.count(), 40, 8 << 20), "item_no").select("item_id", "rank", "doc_id", "score")
