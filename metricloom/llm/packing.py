"""Best-fit packing of documents into token sequences of a fixed capacity.

Only the number of pieces of each length matters, and lengths are bounded by the
capacity, so the search runs over a histogram of at most ``capacity`` entries
whatever the corpus holds.  Bin completion: the largest remaining length is
completed by an undominated filling of the space beside it; all of them are
enumerated, one at a time and by waste, in passes that allow more and more
departures from the first choice.  A branch ends when its waste leaves no room for
fewer sequences than the incumbent, which is best-fit decreasing at the start.  The
pieces then find their places by their rank within their length, computed in
parallel over chunks of each length.

Defined cases: a null or empty text is one piece of the end id alone; a document
longer than the capacity is cut into full pieces and a last shorter one; null or
repeated ``doc_id`` values are separate documents; an empty table gives no rows.
Columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.common import small_or_merge, text_slices
from metricloom.llm.tokens import encoder
from metricloom.session import cut_lineage

CAPACITY = 2048
ENCODE_BYTES = 1 << 20  # text that a task encodes at a time
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
Plan = list[tuple[tuple[int, ...], int]]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece of at most ``capacity`` ids; ``with_ids`` adds the ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for part, texts in text_slices(batch, size=ENCODE_BYTES):
                ids, bounds = encode.encode(texts)
                rows = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []} | ({"ids": []} if with_ids else {})
                for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                    for k, start in enumerate(range(0, len(own), capacity)):
                        piece = own[start : start + capacity]
                        rows["doc_id"].append(doc_id)
                        rows["piece"].append(k)
                        rows["start"].append(start)
                        rows["length"].append(len(piece))
                        rows["ids_crc32"].append(zlib.crc32(piece.tobytes()))
                        if with_ids:
                            rows["ids"].append(piece.astype(np.int32))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds)], list(rows))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Fewest sequences by total length, and with pieces over any share of the
    capacity that cannot meet each other (Martello and Toth's L2)."""
    lengths = np.arange(len(counts))
    number, total = np.cumsum(counts), np.cumsum(counts * lengths)
    best = -(-int(total[-1]) // capacity)
    for k in range(capacity // 2 + 1):
        # over capacity - k: alone; over capacity / 2: one each, with room for lengths from k on
        alone = int(number[-1] - number[min(capacity - k, len(counts) - 1)])
        half = int(number[capacity - k] - number[capacity // 2]) if capacity - k > capacity // 2 else 0
        filled = int(total[capacity - k] - total[capacity // 2]) if half else 0
        small = int(total[capacity // 2] - (total[k - 1] if k else 0))
        best = max(best, alone + half + max(0, -(-(small - (half * capacity - filled)) // capacity)))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Best-fit decreasing over the histogram: equal pieces move together."""
    bins: dict[int, list[list]] = {}  # room left -> [pattern, number]
    for length in range(len(counts) - 1, 0, -1):
        left = int(counts[length])
        while left:
            room = min((r for r in bins if r >= length), default=None)
            if room is None:
                fits = min(capacity // length, left)
                whole = left // fits
                bins.setdefault(capacity - fits * length, []).append([(length,) * fits, whole])
                left -= whole * fits
                continue
            pattern, number = bins[room].pop()
            fits = min(room // length, left)
            used = min(number, left // fits)
            if used < number:
                bins[room].append([pattern, number - used])
            if not bins[room]:
                del bins[room]
            bins.setdefault(room - fits * length, []).append([pattern + (length,) * fits, used])
            left -= used * fits
    return [(tuple(p), n) for groups in bins.values() for p, n in groups]


def _bits(lengths: Iterable[int]) -> int:
    out = 0
    for x in lengths:
        out |= 1 << int(x)
    return out


def _smeared(sums: int, places: int) -> int:
    """Each sum and the ``places`` above it."""
    done = 0
    while done < places:
        by = min(done + 1, places - done)
        sums |= sums << by
        done += by
    return sums


def dominated(items: tuple[int, ...], left: int, waste: int) -> bool:
    """Whether one piece that is left over (bits of ``left``) fits in the place of
    no, one or several pieces of a filling and wastes no more: larger than one
    piece, or as large as several together."""
    one, several = 0, 0  # sums of one piece, of at least two
    for x in items:
        several |= (several | one) << x
        one |= 1 << x
    reach = _smeared(several, waste) | (_smeared(one << 1, waste - 1) if waste else 0)
    return bool(left & (reach | (1 << waste + 1) - 2))


def fillings(counts: np.ndarray, room: int, most_waste: int, spend: Callable[[], None], sums: dict[bytes, np.ndarray]) -> Iterator[tuple[int, ...]]:
    """All undominated fillings of ``room`` that waste at most ``most_waste``, one
    at a time: least waste first, larger pieces first.  ``spend`` is called for
    every step and may end the search; ``sums`` remembers which totals a set of
    lengths can reach."""
    have = np.flatnonzero(counts[: room + 1])
    if not len(have):
        if room <= most_waste:
            yield ()
        return
    key = have.tobytes() + room.to_bytes(4, "little")
    if key not in sums:
        every, reach = (1 << room + 1) - 1, 1
        for x in have.tolist():
            step = x
            while step <= room:  # any number of x
                reach |= reach << step & every
                step *= 2
        sums[key] = np.array(list(bin(reach)[:1:-1].ljust(room + 1, "0"))) == "1"
    reachable, left, number = sums[key], _bits(have), counts.tolist()
    for total in range(room, max(room - most_waste, 1) - 1, -1):
        if not reachable[total]:
            continue
        items: list[int] = []
        open_: list[Iterator[int]] = []

        def choices(rest: int, most: int) -> Iterator[int]:
            fit = have[: np.searchsorted(have, min(rest, most), side="right")]
            return iter(fit[reachable[rest - fit]][::-1].tolist())

        open_.append(choices(total, total))
        rest = total
        while open_:
            spend()
            x = next(open_[-1], None)
            if x is None:
                open_.pop()
                if items:
                    rest += items.pop()
                continue
            if items.count(x) >= number[x]:
                continue
            items.append(x)
            rest -= x
            if rest:
                open_.append(choices(rest, x))
                continue
            spare = left & ~_bits(y for y in set(items) if items.count(y) >= number[y])
            if not dominated(tuple(items), spare, room - total):
                yield tuple(items)
            rest += items.pop()


class _Spent(Exception):
    """The steps of a search are used up."""


def plan_sequences(counts: np.ndarray, capacity: int = CAPACITY, steps: int | None = None) -> Plan:
    """Patterns of lengths and how many sequences use each.

    The largest piece is completed by each undominated filling in turn, for as many
    sequences as it can serve and for one.  Passes allow 0, 1, 2, ... departures
    from the first choice; a pass that leaves nothing out proves its plan best.
    ``steps`` (by default 200,000 and a hundred for every length) bounds the search,
    not the result: every piece is placed, and the best plan found so far stands.
    """
    counts = counts.astype(np.int64).copy()
    counts[0] = 0
    total = int((counts * np.arange(len(counts))).sum())
    best = best_fit(counts, capacity)
    fewest, bound = sum(n for _, n in best), lower_bound(counts, capacity)
    steps = steps or 200_000 + 100 * int(np.count_nonzero(counts))
    sums: dict[bytes, np.ndarray] = {}

    def spend() -> None:
        nonlocal steps
        steps -= 1
        if steps < 0:
            raise _Spent

    def children(left: np.ndarray, slack: int) -> Iterator[tuple[tuple[int, ...], int]]:
        largest = int(np.flatnonzero(left)[-1])
        rest = left.copy()
        rest[largest] -= 1
        for filling in fillings(rest, capacity - largest, slack, spend, sums):
            pattern = (largest, *filling)
            times = min(int(left[x]) // pattern.count(x) for x in set(pattern))
            yield pattern, times
            if times > 1:
                yield pattern, 1

    departures, cut = 0, True
    try:
        while cut and fewest > bound:
            cut = False
            # what is left, patterns so far, sequences, waste, departures allowed, choices
            slack = (fewest - 1) * capacity - total
            path: list[tuple[tuple[int, ...], int]] = []
            stack = [[counts, 0, 0, departures, children(counts, slack)]]
            while stack and fewest > bound:
                left, used, waste, allowed, choices = stack[-1]
                choice = next(choices, None)
                if choice is None or allowed < 0:
                    cut |= choice is not None
                    stack.pop()
                    if path:
                        path.pop()
                    continue
                stack[-1][3] -= 1
                pattern, times = choice
                wasted = waste + times * (capacity - sum(pattern))
                slack = (fewest - 1) * capacity - total - wasted
                if slack < 0:
                    stack[-1][3] += 1  # a choice that cannot win is no departure
                    continue
                after = left.copy()
                np.subtract.at(after, list(pattern), times)
                if after.any():
                    path.append((pattern, times))
                    stack.append([after, used + times, wasted, allowed, children(after, slack)])
                elif used + times < fewest:
                    fewest, best = used + times, [*path, (pattern, times)]
            departures += 1
    except _Spent:
        pass
    return best


def _places(plan: Plan) -> dict[str, np.ndarray]:
    """Ranges of ranks within a length and the places they get."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in plan:
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            each = pattern.count(length)
            rows.append((length, taken.get(length, 0), sequence, offset, each))
            taken[length] = taken.get(length, 0) + each * times
            offset += each * length
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "offset", "each"), table.T))


def ranked(pieces: DataFrame, counts: np.ndarray, chunk_rows: int = 500) -> DataFrame:
    """Adds ``rank``: the 0-based number of a piece among those of its length.

    Each length is dealt into chunks of about ``chunk_rows`` by hash; a window
    numbers each chunk, and one row per chunk carries the sum of earlier chunks.
    """
    chunks = F.array(*[F.lit(int(-(-c // chunk_rows) or 1)) for c in counts])
    dealt = pieces.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(chunks, F.col("length").cast("int"))))
    earlier = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("length", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    before = small_or_merge(before, len(counts) + int(counts.sum()) // chunk_rows, 24)
    order = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")
    numbered = dealt.withColumn("number", F.row_number().over(order) - 1)
    return numbered.join(before, ["length", "chunk"]).withColumn("rank", F.col("before") + F.col("number")).drop("chunk", "number", "before")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``; ``pieces`` is read twice (a table)."""
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["count"]
    places = _places(plan_sequences(counts, capacity))
    at = places["length"] << 40 | places["rank"]
    names = [f.name for f in pieces.schema]

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            i = np.searchsorted(at, (df["length"].to_numpy(np.int64) << 40) | df["rank"].to_numpy(np.int64), side="right") - 1
            step = df["rank"].to_numpy(np.int64) - places["rank"][i]
            out = df[names].copy()
            out["sequence_id"] = places["sequence"][i] + step // places["each"][i]
            out["offset"] = places["offset"][i] + step % places["each"][i] * places["length"][i]
            yield out

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked(pieces, counts).mapInPandas(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Places of every piece of every document; ids stay out of the shuffle."""
    return pack(cut_lineage(token_pieces(docs, tokenizer, capacity, end_id)), capacity)


def assemble(places: DataFrame, docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(sequence_id, ids): the sequences themselves, each at most ``capacity``
    ids.  Repeated documents are told apart by a number among equal pieces."""
    key = ["doc_id", "piece", "ids_crc32"]
    same = Window.partitionBy(*key).orderBy(F.lit(0))
    left = places.withColumn("copy", F.row_number().over(same))
    right = token_pieces(docs, tokenizer, capacity, end_id, with_ids=True).select(*key, "ids").withColumn("copy", F.row_number().over(same))
    both = left.join(right, on=[left[c].eqNullSafe(right[c]) for c in (*key, "copy")]).select(left["sequence_id"], left["offset"], right["ids"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return both.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
