"""Token ids as length-delimited binary records with a separate offset index.

A shard is a sequence of frames: 8-byte length, masked checksum of these bytes,
payload, masked checksum of the payload (little-endian; CRC-32, rotated right by
15 bits plus a constant, so that a checksum of data that holds checksums stays
strong).  The payload is a header (has-id flag, id width, document id, number of
ids) and the ids, in two bytes each where the vocabulary allows it.  Beside each
shard lies an index with one fixed-size entry per record, so that a reader can
visit records in any order without scanning.

Defined cases: a null text is empty and gives a record with only the end id; a
null ``doc_id`` sorts first and comes back as null; repeated rows are repeated
records, ordered by text among equal ids; an empty table gives no shards.
Columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm.common import text_slices
from metricloom.llm.tokens import encoder

LENGTH, CHECK, HEADER = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<BBqI")
INDEX = np.dtype([("offset", "<i8"), ("size", "<i8"), ("has_id", "u1"), ("doc_id", "<i8"), ("before", "<i8"), ("n_tokens", "<i8")])
MANIFEST = "shard int, records long, tokens long"
RECORD = "doc_id long, start long, n_tokens long, ids_crc32 long"
READ_BYTES = 4 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    data = HEADER.pack(doc_id is not None, width, doc_id or 0, len(ids)) + ids.astype(f"<u{width}").tobytes()
    length = LENGTH.pack(len(data))
    return b"".join((length, CHECK.pack(masked(length)), data, CHECK.pack(masked(data))))


def parse(data: bytes) -> tuple[int | None, np.ndarray]:
    has_id, width, doc_id, n = HEADER.unpack_from(data)
    return doc_id if has_id else None, np.frombuffer(data, f"<u{width}", n, HEADER.size).astype("<u4")


def _names(folder: str, shard: int) -> tuple[fs.FileSystem, str, str]:
    store, base = fs.FileSystem.from_uri(folder)
    return store, f"{base}/shard-{shard:06d}.rec", f"{base}/shard-{shard:06d}.idx"


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` (doc_id, text) in ascending order of doc_id; one shard per task.

    Returns the manifest (shard, records, tokens); shards are numbered in order.
    A task streams its records to a file of its own attempt and renames it at
    the end, so a repeated task replaces its own result.  ``folder`` is a URI
    that all executors share.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, records, index = _names(folder, context.partitionId())
        store.create_dir(records.rpartition("/")[0], recursive=True)
        mark = f".{context.taskAttemptId()}"
        encode, offset, before, count = encoder(tokenizer), 0, 0, 0
        width = 2 if max(encode.size, end_id + 1) <= 1 << 16 else 4
        with store.open_output_stream(records + mark) as out, store.open_output_stream(index + mark) as listed:
            for batch in batches:
                for part, texts in text_slices(batch):
                    ids, bounds = encode.encode(texts)
                    entries = np.zeros(len(part), INDEX)
                    for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                        own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id))
                        data = frame(doc_id, own, width)
                        out.write(data)
                        entries[i] = (offset, len(data), doc_id is not None, doc_id or 0, before, len(own))
                        offset, before = offset + len(data), before + len(own)
                    listed.write(entries.tobytes())
                    count += len(part)
        for name in (records, index):
            if store.get_file_info(name).type != fs.FileType.NotFound:
                store.delete_file(name)
            store.move(name + mark, name)
        yield pa.RecordBatch.from_pylist(
            [{"shard": context.partitionId(), "records": count, "tokens": before}],
            pa.schema([("shard", pa.int32()), ("records", pa.int64()), ("tokens", pa.int64())]),
        )

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first())
    return ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(write, MANIFEST)


def frames(stream) -> Iterator[bytes]:
    """Payloads of a stream of frames; a broken checksum or a cut is an error."""
    while head := stream.read(LENGTH.size + CHECK.size):
        if len(head) < LENGTH.size + CHECK.size or CHECK.unpack_from(head, LENGTH.size)[0] != masked(head[: LENGTH.size]):
            raise ValueError("broken length")
        size = LENGTH.unpack_from(head)[0]
        data = stream.read(size + CHECK.size)
        if len(data) < size + CHECK.size or CHECK.unpack_from(data, size)[0] != masked(data[:size]):
            raise ValueError("broken record")
        yield data[:size]


def shard_starts(manifest: DataFrame) -> DataFrame:
    """(shard, start): tokens before each shard.  One row per shard, so the sum
    over the driver's list is small."""
    rows = sorted(manifest.select("shard", "tokens").collect())
    starts = np.concatenate([[0], np.cumsum([r.tokens for r in rows])]).astype(int)
    return manifest.sparkSession.createDataFrame([(r.shard, int(s)) for r, s in zip(rows, starts)], "shard int, start long")


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record in file order: doc_id, start, n_tokens, ids_crc32."""
    starts = shard_starts(manifest)

    def scan(frames_of: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shards in frames_of:
            for shard, start in zip(shards["shard"], shards["start"]):
                store, records, _ = _names(folder, shard)
                rows = []
                with store.open_input_stream(records, buffer_size=READ_BYTES) as stream:
                    for data in frames(stream):
                        doc_id, ids = parse(data)
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(rows) == 20_000:
                            yield _frame_of(rows)
                            rows = []
                yield _frame_of(rows)

    n = max(1, starts.count())
    return starts.repartition(n).mapInPandas(scan, RECORD)


def _frame_of(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
    return out.astype({"doc_id": "Int64", "start": "int64", "n_tokens": "int64", "ids_crc32": "int64"})


def read_index(manifest: DataFrame, folder: str) -> DataFrame:
    """The offset index as a table: shard, offset, size, doc_id, start, n_tokens."""
    starts = shard_starts(manifest)

    def scan(frames_of: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shards in frames_of:
            for shard, start in zip(shards["shard"], shards["start"]):
                store, _, index = _names(folder, shard)
                with store.open_input_stream(index) as stream:
                    while data := stream.read(INDEX.itemsize * 50_000):
                        e = np.frombuffer(data, INDEX)
                        ids = pd.array(e["doc_id"], "Int64")
                        ids[e["has_id"] == 0] = pd.NA
                        yield pd.DataFrame({"shard": np.int32(shard), "offset": e["offset"], "size": e["size"], "doc_id": ids, "start": e["before"] + start, "n_tokens": e["n_tokens"]})

    n = max(1, starts.count())
    return starts.repartition(n).mapInPandas(scan, "shard int, offset long, size long, doc_id long, start long, n_tokens long")


def read_shuffled(spark: SparkSession, manifest: DataFrame, folder: str, seed: int, partitions: int | None = None) -> DataFrame:
    """Records in a seeded random order (doc_id, ids, place): index entries are
    dealt and sorted by hash, and each task fetches its records by offset."""
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = read_index(manifest, folder).withColumn("place", F.xxhash64("shard", "offset", F.lit(seed)))
    ordered = dealt.repartitionByRange(parts, "place").sortWithinPartitions("place")

    def fetch(frames_of: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_files = {}
        for wanted in frames_of:
            for at in range(0, len(wanted), 1000):
                rows = []
                for r in wanted.iloc[at : at + 1000].itertuples(index=False):
                    if r.shard not in open_files:
                        if len(open_files) >= 64:
                            open_files.clear()
                        store, records, _ = _names(folder, r.shard)
                        open_files[r.shard] = store.open_input_file(records)
                    data = open_files[r.shard].read_at(r.size, r.offset)
                    doc_id, ids = parse(next(frames(pa.BufferReader(data))))
                    rows.append((doc_id, ids.astype(np.int64), r.place))
                yield pd.DataFrame(rows, columns=["doc_id", "ids", "place"]).astype({"doc_id": "Int64"})

    return ordered.mapInPandas(fetch, "doc_id long, ids array<long>, place long")
