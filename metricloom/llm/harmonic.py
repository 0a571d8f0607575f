"""Harmonic packing: every worker fills sequences of equal pieces on its own.

A piece of class k is a k-th of the capacity, and a sequence of that class holds
exactly k of them, so no worker needs to know what others hold: there is no
shuffle, no histogram and no driver.  Documents may be cut freely, so each one is
cut into pieces that have exactly the lengths of classes, as few as possible (a
table over all lengths below the capacity, from the capacity alone).  Only classes
whose k pieces leave at most ``pad`` tokens of a sequence open are used.

What is left in the open sequences of a task, fewer than k pieces for each class, is
laid end to end and cut at the capacity; the last stretch becomes sequences whose
lengths are powers of two, which need no padding.

Defined cases: a null or empty text is the end id alone; null or repeated ``doc_id``
values are separate documents; a text of any length is cut in its task; an empty
table gives no rows.  Columns besides ``doc_id`` and ``text`` are ignored.  Which
sequence holds a piece depends on the partitions of ``docs``; a task that runs again
gives the same rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import text_slices
from metricloom.llm.tokens import encoder

CAPACITY, END_ID, PAD = 4096, 2, 1
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
KINDS = [pa.int64()] * len(COLUMNS)
#: Sequences of a task: 2^36 of them at most.
TASK_BITS = 36


@lru_cache(maxsize=4)
def classes(capacity: int, pad: int = PAD) -> dict[int, int]:
    """Length of a piece -> how many fill a sequence, for every class that leaves at
    most ``pad`` tokens open."""
    sizes = {capacity // k for k in range(1, capacity + 1)}
    return {size: capacity // size for size in sorted(sizes, reverse=True) if capacity % size <= pad}


@lru_cache(maxsize=4)
def cuts(capacity: int, pad: int = PAD) -> np.ndarray:
    """For every length below the capacity the last piece of a shortest cut into
    lengths of classes; of several, the largest."""
    sizes = sorted(classes(capacity, pad))
    number, last = np.zeros(capacity, np.int64), np.zeros(capacity, np.int64)
    for length in range(1, capacity):
        number[length], last[length] = min((number[length - s] + 1, -s) for s in sizes if s <= length)
    return -last


class Worker:
    """Open sequences of one task.  ``add`` returns the rows that it settles."""

    def __init__(self, task: int, capacity: int = CAPACITY, pad: int = PAD):
        self.capacity, self.count = capacity, classes(capacity, pad)
        self.last, self.next = cuts(capacity, pad), task << TASK_BITS
        self.open: dict[int, list[tuple]] = {size: [] for size in self.count}

    def _sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> list[tuple]:
        total, rest = len(ids), len(ids) % self.capacity
        lengths = [self.capacity] * (total // self.capacity)
        while rest:
            lengths.append(int(self.last[rest]))
            rest -= lengths[-1]
        rows, start = [], 0
        for size in lengths:
            waiting = self.open[size]
            # a copy: a view would keep the ids of a whole batch
            waiting.append((doc_id, start, ids[start : start + size].copy(), total))
            start += size
            if len(waiting) == self.count[size]:
                rows += self._filled(waiting)
                self.open[size] = []
        return rows

    def _filled(self, pieces: list[tuple]) -> list[tuple]:
        sequence, offset, rows = self._sequence(), 0, []
        for doc_id, start, ids, total in pieces:
            rows.append((doc_id, start, ids, total, sequence, offset))
            offset += len(ids)
        return rows

    def finish(self) -> list[tuple]:
        """Rows of what is still open, laid end to end."""
        pieces = [p for size in self.count for p in self.open[size]]
        left = sum(len(p[2]) for p in pieces)
        lengths = [self.capacity] * (left // self.capacity)
        lengths += [1 << b for b in reversed(range(self.capacity.bit_length())) if left % self.capacity >> b & 1]
        ends, sequences = np.cumsum(lengths), [self._sequence() for _ in lengths]
        rows, at, k = [], 0, 0
        for doc_id, start, ids, total in pieces:
            done = 0
            while done < len(ids):
                taken = min(len(ids) - done, int(ends[k]) - at)
                offset = at - int(ends[k]) + lengths[k]
                rows.append((doc_id, start + done, ids[done : done + taken], total, sequences[k], offset))
                done, at = done + taken, at + taken
                k += at == ends[k]
        return rows


def _table(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    ids = [r[2] for r in rows]
    columns = [
        [r[0] for r in rows], [r[1] for r in rows], [len(x) for x in ids], [zlib.crc32(x.tobytes()) for x in ids],
        [r[3] for r in rows], [r[4] for r in rows], [r[5] for r in rows],
    ]
    arrays = [pa.array(c, t) for c, t in zip(columns, KINDS)]
    if with_ids:
        arrays.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
    return pa.RecordBatch.from_arrays(arrays, COLUMNS + ["ids"] * with_ids)


def harmonic_pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, pad: int = PAD, with_ids: bool = False
) -> DataFrame:
    """One row per piece with its sequence and its place there; ``with_ids`` adds the ids."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, worker = encoder(tokenizer), Worker(TaskContext.get().partitionId(), capacity, pad)
        for batch in batches:
            for part, texts in text_slices(batch):
                ids, bounds = encode.encode(texts)
                rows = []
                for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                    rows += worker.add(doc_id, own)
                yield _table(rows, with_ids)
        yield _table(worker.finish(), with_ids)

    schema = ", ".join(f"{c} long" for c in COLUMNS) + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(fill, schema)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, pad: int = PAD) -> DataFrame:
    """(sequence_id, ids): the sequences themselves, each at most ``capacity`` ids."""
    pieces = harmonic_pack(docs, tokenizer, capacity, end_id, pad, with_ids=True)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
