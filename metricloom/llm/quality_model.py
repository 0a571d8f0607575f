"""Quality classifier: boosted histogram trees over document statistics.

Statistics are computed from whole texts on Arrow buffers.  Trees are grown on a
bounded sample of labelled documents (``max_rows``, a documented bound; training
needs no more and the sample is the only thing gathered), flattened into arrays
of feature, cut, value per node, and walked by numpy for a whole batch at once.

Defined cases: a null or empty text has zero statistics and a score like any
other; labels with a null id or quality, or an id without a document, are
ignored; contradicting labels of one id are separate rows; without labels every
score is 0.5, with labels of one kind it is the smoothed share of ones.
Columns besides ``doc_id`` and ``text`` are carried through unread.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.llm.common import text_slices

FEATURES = (
    "bytes", "words", "word_bytes", "upper", "digit", "symbol", "stop", "pipe", "non_ascii", "line_bytes", "lines",
    "repeated_lines", "repeated_words", "shout", "marked_words", "longest_run", "packed", "plain_ends", "hash_marks",
)
MAX_ROWS = 20_000
#: Byte classes: one bit of each class that a byte belongs to.
UPPER, DIGIT, SYMBOL, STOP, PIPE, WIDE, LETTER, HARSH = range(8)
CLASSES = np.zeros(256, np.uint8)
for _byte in range(256):
    _c = chr(_byte)
    CLASSES[_byte] = (
        ("A" <= _c <= "Z") << UPPER | _c.isdigit() * (_byte < 128) << DIGIT | (33 <= _byte < 127 and not _c.isalnum()) << SYMBOL
        | (_c in ".?!") << STOP | (_c == "|") << PIPE | (_byte >= 128) << WIDE | (_byte < 128 and _c.isalpha() or _byte >= 128) << LETTER
        | (_c in "#$%&*@^~<>{}[]\\") << HARSH
    )


def _per_text(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out, filled = np.zeros(len(bounds) - 1, np.int64), bounds[1:] > bounds[:-1]
    if filled.any():
        out[filled] = np.add.reduceat(mask.view(np.uint8), bounds[:-1][filled], dtype=np.int32)
    return out


def _repeated(lists: pa.Array, n: int) -> np.ndarray:
    """Share of the items of each list that occurred in it before."""
    bounds = lists.offsets.to_numpy()
    bounds = bounds - bounds[0]
    sizes = np.diff(bounds)
    coded = lists.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    key = np.repeat(np.arange(n), sizes) << 32 | coded
    distinct = np.bincount(np.unique(key) >> 32, minlength=n)
    return 1 - distinct / np.maximum(sizes, 1) * (sizes > 0) - (sizes == 0)


def statistics(texts: pa.Array) -> np.ndarray:
    """Rows of ``FEATURES`` for a null-free large string array."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    bounds = offsets - offsets[0]
    kind = CLASSES[raw]
    count = {c: _per_text(kind >> c & 1, bounds) for c in range(8)}
    space = (raw == 32) | (raw == 10)
    first = np.zeros(len(raw) + 1, bool)
    first[bounds[:-1]] = True
    starts = ~space & (first[:-1] | np.concatenate([[True], space[:-1]]))[: len(raw)]
    ends = np.concatenate([~space[:-1] & space[1:], [True]])[: len(raw)] & ~space if len(raw) else space
    last = bounds[1:][bounds[1:] > bounds[:-1]] - 1
    ends[last] = ~space[last]
    words, size = _per_text(starts, bounds), np.diff(bounds)
    lines = pc.split_pattern(texts, "\n")
    n_lines = _per_text(raw == 10, bounds) + 1
    per = lambda x, of: x / np.maximum(of, 1)
    marked = _per_text(ends & (kind >> HARSH & 1 > 0), bounds)
    shout = np.zeros(len(raw), bool)
    if len(raw) > 1:
        shout[1:] = (kind[1:] >> UPPER & 1 > 0) & (kind[:-1] >> UPPER & 1 > 0)
    same = np.zeros(len(raw), bool)
    if len(raw) > 1:
        same[1:] = (raw[1:] == raw[:-1]) & ~space[1:]
    alpha_end = _per_text(ends & (kind >> LETTER & 1 > 0), bounds)
    view = memoryview(raw)
    packed = [len(zlib.compress(view[a:b], 1)) / (b - a) if b > a else 0.0 for a, b in zip(bounds[:-1], bounds[1:])]
    return np.column_stack([
        np.log1p(size), np.log1p(words), per(size - _per_text(space, bounds), words), per(count[UPPER], size), per(count[DIGIT], size),
        per(count[SYMBOL], size), per(count[STOP], words), per(count[PIPE], words), per(count[WIDE], size), np.log1p(per(size, n_lines)),
        np.log1p(n_lines), _repeated(lines, n), _repeated(pc.split_pattern(pc.replace_substring(texts, "\n", " "), " "), n),
        per(_per_text(shout, bounds), size), per(marked, words), per(_per_text(same, bounds), size), packed, per(alpha_end, words),
        per(count[HARSH], words),
    ]).astype(np.float32)


@dataclass(frozen=True)
class Forest:
    """Trees of one depth as arrays: node i has children 2i+1 and 2i+2."""

    edges: np.ndarray  # (feature, cut) upper edges of the bins
    feature: np.ndarray  # (tree, inner node)
    cut: np.ndarray  # (tree, inner node): bins above it go right
    value: np.ndarray  # (tree, leaf)
    start: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)]).astype(np.uint8)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: all trees step down one level at a time."""
        if not len(self.feature) or not len(x):
            return np.full(len(x), 1 / (1 + np.exp(-self.start)))
        binned, total = self.bins(x), np.full(len(x), self.start)
        inner = self.feature.shape[1]
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(inner.bit_length()):
                node = 2 * node + 1 + (binned[np.arange(len(x)), feature[node]] > cut[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 2.0, least: float = 1.0) -> Forest:
    """Second-order boosting of the log loss over per-feature histograms."""
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else 0.0
    edges = np.array([np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]) for j in range(x.shape[1])]) if len(y) else np.zeros((x.shape[1], bins - 1))
    forest = Forest(edges, np.zeros((0, 2**depth - 1), int), np.zeros((0, 2**depth - 1), int), np.zeros((0, 2**depth)), start)
    if len(np.unique(y)) < 2:
        return forest
    binned, raw = forest.bins(x), np.full(len(y), start)
    features, cuts, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(2**depth - 1, int), np.full(2**depth - 1, bins)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            best = np.full(width, 1e-9)
            for j in range(x.shape[1]):
                place = at * bins + binned[:, j]
                gs = np.bincount(place, g, width * bins).reshape(width, bins).cumsum(1)
                hs = np.bincount(place, h, width * bins).reshape(width, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < least) | (ht - hs < least)] = 0
                k = gain.argmax(1)
                better = gain[np.arange(width), k] > best
                best = np.where(better, gain[np.arange(width), k], best)
                feature[first : first + width][better] = j
                cut[first : first + width][better] = k[better]
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - (2**depth - 1)
        value = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        raw += value[leaf]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    return Forest(edges, np.array(features), np.array(cuts), np.array(values), start)


def held_out() -> Column:
    """Documents that no model learns from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Forest:
    """Fit on at most ``max_rows`` labelled documents, chosen by hash of the id.

    The hash order picks among ids; the documents come by an equi-join with the
    chosen ids, so texts that are not chosen are neither shuffled nor parsed.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    usable = usable.filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out())
    chosen = usable.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                x = statistics(texts).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    measured = sample.mapInArrow(measure, "doc_id long, y int, x array<double>")
    # repeated documents may exceed the bound on ids; the order makes the fit repeatable
    rows = measured.orderBy(F.xxhash64("doc_id"), "doc_id", "y", "x").limit(max_rows).toArrow()
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)).astype(np.float32)
    return fit_forest(x, rows.column("y").to_numpy().astype(float))


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """``docs`` with ``score`` (and every column as it was); no shuffle."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                got = pa.array(forest.score(statistics(texts)), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, got], [*part.schema.names, "score"])

    plain = docs.drop("score")
    return plain.mapInArrow(walk, T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())]))
