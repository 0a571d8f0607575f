"""Token ids, binary records and packing against the tokenizer and brute force."""

import itertools
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from metricloom.llm import packing, token_records
from metricloom.llm.tokens import WordEncoder
from metricloom.session import cut_lineage, shared_folder

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\n\n", "it's X''s 'start don't", "İstanbul IS étude É", "<|startoftext|>a<|endoftext|> x<|", "a b c\x1cd",
       "Ünï,code... (x)_y 12.5% ½ Ⅷ", "ΑΣ ΑΣ. ß ẞ", "你好 world", "a" * 5000, "ab " * 3000, "don't'", "x|y <b>|</b>", "tab\tx\r\ny", "�\U0001f600ok"]
SCHEMA = "doc_id long, text string, n_chars string"


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.lit("x").alias("n_chars"))
    odd = spark.createDataFrame([(1000 + i, t, None) for i, t in enumerate(ODD)] + [(None, "no id", "1"), (3, "again", None), (3, "again", None), (2000, None, None)], SCHEMA)
    return cut_lineage(real.unionByName(odd))


TOKENIZER = Tokenizer.from_file(PATH)


def own_ids(text, end):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [end]


def test_ids_equal_the_tokenizer(spark):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    encoder = WordEncoder(PATH, cache_words=300)  # forgets in between
    for _ in range(2):
        ids, bounds = encoder.encode(pa.array(texts, pa.large_string()))
        for i, text in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == own_ids(text, 0)[:-1], text[:50]


def test_records_round_trip(spark, docs):
    folder = shared_folder(spark, "records")
    manifest = cut_lineage(token_records.write_records(docs, folder, PATH, 2))
    want, start = [], 0
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    for r in rows:
        ids = own_ids(r.text, 2)
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_records.read_records(manifest, folder).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    shuffled = token_records.read_shuffled(spark, manifest, folder, seed=5, partitions=3).collect()
    assert sorted((r.doc_id or -1, tuple(r.ids)) for r in shuffled) == sorted((r.doc_id or -1, tuple(own_ids(r.text, 2))) for r in rows)


def test_broken_record_is_an_error():
    data = bytearray(token_records.frame(7, np.arange(5, dtype=np.uint32), 2))
    assert token_records.parse(next(token_records.frames(pa.BufferReader(bytes(data)))))[1].tolist() == list(range(5))
    data[-6] ^= 1
    with pytest.raises(ValueError):
        next(token_records.frames(pa.BufferReader(bytes(data))))


def test_empty_table(spark, docs):
    folder = shared_folder(spark, "none")
    manifest = cut_lineage(token_records.write_records(docs.limit(0), folder, PATH))
    assert token_records.read_records(manifest, folder).count() == 0
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def check_plan(counts, plan, capacity):
    left = np.array(counts)
    for pattern, times in plan:
        assert sum(pattern) <= capacity
        np.subtract.at(left, list(pattern), times)
    assert not left.any()
    return sum(n for _, n in plan)


def fewest(items, capacity):
    """Brute force: every way to put each piece into an open or a new sequence."""
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= items[i]:
                rest = list(rooms)
                rest.remove(room)
                go(i + 1, [*rest, room - items[i]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


def test_plans_are_optimal_on_small_cases():
    rng = np.random.default_rng(3)
    for _ in range(150):
        items = sorted(rng.integers(1, 21, rng.integers(1, 10)).tolist(), reverse=True)
        counts = np.bincount(items, minlength=21)
        n = check_plan(counts, packing.plan_sequences(counts, 20), 20)
        assert packing.lower_bound(counts, 20) <= fewest(items, 20) == n, items


def test_undominated_fillings():
    """Against every multiset: a dominated one can swap pieces for one that is left."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        pieces = rng.integers(1, 12, rng.integers(1, 9)).tolist()
        counts, room = np.bincount(pieces, minlength=31), int(rng.integers(1, 20))
        every = {tuple(sorted(c, reverse=True)) for k in range(len(pieces) + 1) for c in itertools.combinations(pieces, k) if sum(c) <= room}
        want = set()
        for c in every:
            rest = counts - np.bincount(c, minlength=31) if c else counts
            parts = [p for k in range(len(c) + 1) for p in itertools.combinations(c, k)]
            better = any(rest[x] and sum(p) <= x <= sum(p) + room - sum(c) and not (len(p) == 1 and x == p[0]) for x in range(1, 12) for p in parts)
            if not better:
                want.add(c)
        got = list(packing.fillings(counts, room, room, lambda: None, {}))
        assert sorted(got) == sorted(want) and [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True)


def test_plans_are_the_fewest_in_a_thousand_cases():
    rng = np.random.default_rng(5)
    for _ in range(1000):
        items = rng.integers(3, 60, rng.integers(9, 14)).tolist()
        counts = np.bincount(items, minlength=101)
        assert check_plan(counts, packing.plan_sequences(counts, 100), 100) == fewest(sorted(items, reverse=True), 100), items


def test_plan_of_many(spark):
    rng = np.random.default_rng(1)
    counts = np.bincount(np.minimum(rng.lognormal(6, 1, 100_000).astype(int) + 1, 2048), minlength=2049)
    n = check_plan(counts, packing.plan_sequences(counts), 2048)
    assert n <= packing.lower_bound(counts, 2048) * 1.001


def test_packing_places_every_piece(spark, docs):
    out = packing.pack_documents(docs, PATH).toPandas()
    want = []
    for r in docs.collect():
        ids = own_ids(r.text, 0)
        want += [(-1 if r.doc_id is None else r.doc_id, k, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    out["doc_id"] = out["doc_id"].fillna(-1).astype(int)
    assert sorted(map(tuple, out[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist())) == sorted(want)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *itertools.accumulate(g.length)][:-1] and g.length.sum() <= 2048
    counts = np.bincount(out.length, minlength=2049)
    assert out.sequence_id.nunique() <= packing.lower_bound(counts, 2048) + 1


def test_assembled_sequences(spark, docs):
    few = docs.filter("doc_id < 20 or doc_id >= 1000 or doc_id is null")
    places = cut_lineage(packing.pack_documents(few, PATH, capacity=64))
    got = {r.sequence_id: r.ids for r in packing.assemble(places, few, PATH, capacity=64).collect()}
    for r in places.collect():
        piece = np.array(got[r.sequence_id][r.offset : r.offset + r.length], "<u4")
        assert zlib.crc32(piece.tobytes()) == r.ids_crc32
    assert sum(map(len, got.values())) == sum(len(own_ids(r.text, 0)) for r in few.collect())


def test_ranks_are_dense_on_a_hot_length(spark):
    rows = [(i, 0, 0, 7, i % 3) for i in range(3000)] + [(5, 0, 0, 7, 1)] * 4 + [(i, 0, 0, 9, 0) for i in range(10)]
    pieces = spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]))
    counts = np.bincount([r[3] for r in rows], minlength=17)
    got = packing.ranked(pieces, counts, chunk_rows=100).toPandas()
    assert sorted(got[got.length == 7]["rank"]) == list(range(3004)) and sorted(got[got.length == 9]["rank"]) == list(range(10))
