"""WARC archives: one gzip member per record, read back in splits.

Equal payloads are stored once: the record with the smallest page id is a
response, the others are revisits that carry the digest, the length and the id
of the response.  The reader needs no index: a task owns a byte range, looks for
the gzip magic, accepts a candidate only if the bytes there decode to a WARC
header, and owns the records that start inside its range; the last of them may
end beyond it.

Defined cases: a null html is an empty payload, a null url leaves the target out,
line breaks in a url are percent-encoded; null page ids never name a response
unless all ids of the payload are null, then all are responses; rows that repeat
the smallest id are all responses; an empty table gives no archives.  A cut last
member is no record.  Other columns are not stored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import small_or_merge
from metricloom.session import cut_lineage

GZIP_MAGIC = b"\x1f\x8b\x08"
MANIFEST = "path string, size long, records long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
BLOCK = 1 << 18


def _crlf(fields: list[tuple[str, object]], first: str) -> bytes:
    return "".join([first, "\r\n", *[f"{k}: {v}\r\n" for k, v in fields if v is not None], "\r\n"]).encode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member; ``payload`` is None for a revisit."""
    http = _crlf([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", size)], "HTTP/1.1 200 OK")
    block = http if payload is None else http + payload
    head = _crlf([
        ("WARC-Type", "revisit" if payload is None else "response"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Refers-To", _urn(refers_to) if payload is None else None),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if payload is None else None),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)),
    ], "WARC/1.1")
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head + block + b"\r\n\r\n") + pack.flush()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One archive per task under ``folder`` (a URI that all executors share);
    returns the manifest (path, size, records).

    First ids per digest are counted on digests alone, and only repeated digests
    are joined; a digest that many pages share is split by AQE.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    counted = rows.filter(F.length("payload") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    firsts = cut_lineage(counted.filter("n > 1 and first_id is not null").select("digest", "first_id"))
    marked = rows.join(small_or_merge(firsts, firsts.count(), 80, 8 << 20), "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    marked = marked.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name, count = f"part-{context.partitionId():06d}.warc.gz", 0
        mark = f"{base}/{name}.{context.taskAttemptId()}"
        with store.open_output_stream(mark) as out:
            for batch in batches:
                for i in range(len(batch)):
                    page_id, url, data, digest, refers_to = (c[i].as_py() for c in batch.columns)
                    short = base64.b32encode(bytes.fromhex(digest)).decode()
                    out.write(record(page_id, url, data if refers_to is None else None, len(data), short, refers_to, date))
                    count += 1
            size = out.tell()
        if store.get_file_info(f"{base}/{name}").type != fs.FileType.NotFound:
            store.delete_file(f"{base}/{name}")
        store.move(mark, f"{base}/{name}")
        if count:
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "size": size, "records": count}], pa.schema([("path", pa.string()), ("size", pa.int64()), ("records", pa.int64())]))

    return marked.mapInArrow(write, MANIFEST)


class ByteRange:
    """Buffered reads at any place of a file."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.block = file, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        if not self.at <= at <= at + n <= self.at + len(self.block):
            self.at, self.block = at, self.file.read_at(min(max(n, BLOCK), max(0, self.size - at)), at)
        return self.block[at - self.at : at - self.at + n]


def find_magic(data: ByteRange, start: int, end: int) -> int | None:
    """First place in [start, end) where the magic begins."""
    while start < end:
        part = data.get(start, min(BLOCK, end - start) + 2)
        at = part.find(GZIP_MAGIC)
        if 0 <= at and start + at < end:
            return start + at
        start += max(1, len(part) - 2)
    return None


def decode_member(data: ByteRange, at: int) -> tuple[bytes, int] | None:
    """(content, end) of the member at ``at`` if it is a whole WARC record."""
    unpack, out, place, checked = zlib.decompressobj(31), bytearray(), at, False
    try:
        while not unpack.eof:
            part = data.get(place, min(1 << 14, data.size - place))
            if not part:
                return None
            out += unpack.decompress(part)
            place += len(part)
            if not checked and len(out) >= 7:
                if not out.startswith(b"WARC/1."):
                    return None
                if b"\r\n\r\n" in out:
                    head = bytes(out[: out.index(b"\r\n\r\n")]).lower()
                    if b"\r\nwarc-type:" not in head or b"\r\ncontent-length:" not in head:
                        return None
                    checked = True
    except zlib.error:
        return None
    return (bytes(out), place - len(unpack.unused_data)) if checked else None


def records_in(data: ByteRange, start: int, end: int) -> Iterator[bytes]:
    """Contents of the records that start in [start, end)."""
    while (at := find_magic(data, start, end)) is not None:
        got = decode_member(data, at)
        if got is None:
            start = at + 1
        else:
            yield got[0]
            start = got[1]


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def _page(urn: str | None) -> int | None:
    name = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(name) if re.fullmatch(r"-?\d+", name) else None


def parse(content: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of a record; a payload that does not
    match its digest is an error."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = _fields(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    if fields["warc-type"] == "response":
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if fields["warc-payload-digest"] != f"sha1:{digest}":
            raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    return fields, _fields(http), payload


def read_archives(manifest: DataFrame, split_bytes: int = 4 << 20, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives in ``manifest`` (path, size)."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    splits = manifest.filter("size > 0").select("path", "size", starts.alias("start"))
    n = max(1, splits.count())
    columns = [c.split()[0] for c in RECORD.split(", ")] + ["payload"] * with_payload

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for split in df.itertuples(index=False):
                store, path = fs.FileSystem.from_uri(split.path)
                rows, held = [], 0
                with store.open_input_file(path) as file:
                    for content in records_in(ByteRange(file, split.size), split.start, min(split.size, split.start + split_bytes)):
                        warc, http, payload = parse(content)
                        rows.append((
                            _page(warc["warc-record-id"]), warc.get("warc-target-uri"), len(payload) if warc["warc-type"] == "response" else int(http["content-length"]),
                            warc["warc-payload-digest"].removeprefix("sha1:"), warc["warc-type"], _page(warc.get("warc-refers-to")),
                        ) + ((payload,) if with_payload else ()))
                        held += 500 + len(payload) * with_payload
                        if held > 8 << 20:
                            yield frame(rows)
                            rows, held = [], 0
                yield frame(rows)

    return splits.repartition(n).mapInPandas(scan, RECORD + (", payload binary" if with_payload else ""))
