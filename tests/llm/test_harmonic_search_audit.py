"""Harmonic packing, ranked search and filter audit against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from metricloom.llm import filter_audit, fp_search, harmonic
from metricloom.session import cut_lineage

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def with_oddities(spark, extra):
    """Real documents beside null, empty, very long, repeated and equal rows; clashing columns."""
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame(
        [(9001, None, None), (9002, "", ""), (None, "no id at all", "en"), (3, "again and again", "en"), (3, "again and again", "en"),
         (9003, "word " * 30_000, "fr"), (9004, "\n\t ", None), (9005, "ÄÖÜ 你好 #tag ABC", "zz")],
        "doc_id long, text string, lang string",
    )
    docs = real.unionByName(odd)
    for name in extra:
        docs = docs.withColumn(name, F.lit("x"))
    return cut_lineage(docs)


# --- harmonic packing -----------------------------------------------------------------


def check_places(rows, docs, capacity, end):
    """Every id in one piece, right checksums, sequences gapless and within capacity."""
    tokenizer = Tokenizer.from_file(PATH)
    whole = Counter()
    for r in docs.collect():
        ids = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [end], "<u4")
        whole[(r.doc_id, len(ids), zlib.crc32(ids.tobytes()))] += 1
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length, r))
    for own in places.values():
        at = 0
        for offset, length, r in sorted(own, key=lambda p: p[0]):
            assert offset == at and length > 0 and len(r.ids) == length
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            at += length
        assert at <= capacity
    copies = defaultdict(list)
    for r in rows:
        copies[(r.doc_id, r.doc_tokens)].append(r)
    for (doc_id, n), own in copies.items():
        own.sort(key=lambda r: r.start)
        sums = Counter(r.start for r in own)
        k = sums[0]  # equal documents have equal cuts or different ones, but cover alike
        assert sum(r.length for r in own) == k * n
    got = Counter()
    for (doc_id, n), own in copies.items():
        if Counter(r.start for r in own)[0] == 1:
            ids = np.concatenate([np.array(r.ids, "<u4") for r in own])
            assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
            got[(doc_id, n, zlib.crc32(ids.tobytes()))] += 1
    assert not got - whole and len(got) >= len(whole) - 3
    return {s: sum(x[1] for x in own) for s, own in places.items()}


def padding(totals, capacity):
    return sum(0 if t & (t - 1) == 0 else capacity - t for t in totals.values())


@pytest.mark.parametrize("capacity", [4096, 100])
def test_harmonic_places(spark, capacity):
    docs = with_oddities(spark, ["length", "start", "sequence_id"]).repartition(3)
    docs = cut_lineage(docs)
    rows = harmonic.harmonic_pack(docs, PATH, capacity, with_ids=True).collect()
    totals = check_places(rows, docs, capacity, 2)
    tokens = sum(totals.values())
    full = [t for t in totals.values() if t not in {1 << b for b in range(13)}]
    assert padding(totals, capacity) <= harmonic.PAD * len(full) + (capacity if capacity != 4096 else 0) <= tokens / 50 + capacity


def test_harmonic_classes_and_cuts_by_brute_force():
    for capacity in (1, 2, 7, 64, 100):
        sizes = harmonic.classes(capacity)
        assert all(capacity - k * s <= harmonic.PAD and k == capacity // s for s, k in sizes.items()) and 1 in sizes and capacity in sizes
        last, fewest = harmonic.cuts(capacity), [0] + [10**9] * capacity
        for n in range(1, capacity):
            fewest[n] = 1 + min(fewest[n - s] for s in sizes if s <= n)
            left, pieces = n, 0
            while left:
                assert last[left] in sizes
                left, pieces = left - last[left], pieces + 1
            assert pieces == fewest[n]


def test_harmonic_sequences_of_a_class_hold_equal_pieces():
    worker = harmonic.Worker(5, 12)
    rows = []
    for i, n in enumerate([12, 6, 6, 4, 4, 4, 30, 5, 1, 11, 7] * 20):
        rows += worker.add(i, np.arange(n, dtype="<u4"))
    by = defaultdict(list)
    for _, _, ids, _, sequence, _ in rows:
        by[sequence].append(len(ids))
    assert all(len(set(x)) == 1 and len(x) == 12 // x[0] for x in by.values())
    rest = worker.finish()
    sums = Counter()
    for r in rest:
        sums[r[4]] += len(r[2])
    assert all(t == 12 or t & (t - 1) == 0 for t in sums.values()) and not by.keys() & sums.keys()
    assert sum(map(len, (r[2] for r in rows + rest))) == 20 * 90 and min(by) >= 5 << harmonic.TASK_BITS


def test_harmonic_empty_and_sequences(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert harmonic.harmonic_pack(empty, PATH).count() == 0
    docs = cut_lineage(with_oddities(spark, []))
    sequences = harmonic.sequences(docs, PATH, 256).collect()
    places = harmonic.harmonic_pack(docs, PATH, 256).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert {r.sequence_id: len(r.ids) for r in sequences} == {r.sequence_id: r.n for r in places}


# --- ranked search --------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute_search(docs, items, best=20):
    own = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    own = [(d, c, sum(c.values())) for d, c in own if c]
    n_docs, total, df = len(own), sum(n for *_, n in own), Counter(t for _, c, _ in own for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for d, c, n in own:
            m = 75 + (25 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                        for t in TERM.findall((text or "").translate(LOWER)) if t in c)
            if score > 0:
                scores.append((-score, d is None, d))
        out += [(item_id, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scores)[:best])]
    return out


@pytest.mark.parametrize("cells, block_bytes", [(fp_search.CELLS, fp_search.BLOCK_BYTES), (1, 2000)])
def test_search_equals_brute_force(spark, cells, block_bytes):
    """Tiny trees and several blocks of items give the same ranks."""
    docs = with_oddities(spark, ["n", "terms", "score", "item_id"])
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    items = items.unionByName(spark.createDataFrame([(900, None), (901, ""), (902, "AGAIN again no"), (903, "unheardof"), (None, "你好 word")], "item_id long, text string"))
    items = cut_lineage(items.withColumn("item_no", F.lit("x")).withColumn("doc_id", F.lit(1)))
    got = sorted(map(tuple, fp_search.search(docs, items, cells=cells, block_bytes=block_bytes).collect()), key=str)
    want = brute_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got == sorted(want, key=str)


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert fp_search.search(none, items).count() == 0
    assert fp_search.search(with_oddities(spark, []), items.limit(0)).count() == 0


def test_trees_leave_out_what_their_bounds_exclude():
    """Copies share one path: ranks are exact although few rows are scored."""
    rng = np.random.default_rng(1)
    lists, counts = [], []
    for i in range(1500):
        own = np.sort(rng.choice(60, 3, replace=False)) if i % 3 else np.arange(40, 44)
        lists.append(own)
        counts.append(rng.integers(1, 5, len(own)))
    ids, m = rng.permutation(1500).astype(np.int64), rng.integers(75, 200, 1500).astype(np.int64)
    tree = fp_search.Tree(ids, m, lists, counts, 60)
    terms, weights = np.array([40, 41, 42, 43, 7]), np.array([900, 800, 700, 600, 50])
    best = fp_search.Best(20)
    scored = tree.search(terms, weights, best)
    dense = np.zeros((1500, 60), np.int64)
    for i, (a, b) in enumerate(zip(lists, counts)):
        dense[i, a] = b
    score = fp_search.term_scores(dense[:, terms], m) @ weights
    order = np.lexsort((ids, -score))[:20]
    assert best.ids.tolist() == ids[order].tolist() and best.score.tolist() == score[order].tolist()
    assert scored < 700


# --- filter audit ---------------------------------------------------------------------


def brute_audit(docs, labels):
    first = {}
    for d, text, _ in docs:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    judged = []
    for d, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                 "D": bool(re.search("[#$%&*|]", text)), "E": d is not None and d > first[text]}
        judged.append((part or "", {f for f, x in fails.items() if x}, d is not None and d in good, d is not None and d in toxic))
    out = {}
    for part in {j[0] for j in judged}:
        own, shapley = [j for j in judged if j[0] == part], Counter()
        for order in permutations("ABCDE"):
            alive = own
            for step, f in enumerate(order):
                gone = [j for j in alive if f in j[1]]
                alive = [j for j in alive if f not in j[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step + 1] = [
                    len(alive), len(gone), sum(f in j[1] for j in own) - len(gone), sum(j[1] == {f} for j in own), sum(j[2] for j in gone), sum(j[3] for j in gone)]
        for key in out:
            if key[0] == part:
                out[key].append(shapley[key[1][key[2] - 1]])
    return {(*k, *v) for k, v in out.items()}


def test_audit_equals_brute_force(spark):
    docs = with_oddities(spark, ["filter", "mask", "row", "text_key"])
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").cast("int"), F.col("toxic").cast("int"))
    labels = cut_lineage(labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, 0, 0), (3, 1, None), (9002, None, 1), (9002, 1, 0)], "doc_id long, quality int, toxic int")))
    got = filter_audit.audit(docs, labels.withColumn("part", F.lit(0))).collect()
    want = brute_audit([(r.doc_id, r.text, r.lang) for r in docs.collect()], [tuple(r) for r in labels.collect()])
    assert len(got) == len(want) and set(map(tuple, got)) == want
    assert all(r.removed + r.redundant >= r.unique_fails for r in got)


def test_audit_of_nothing_and_of_clean_documents(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filter_audit.audit(none, labels).count() == 0
    clean = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(300)), "en")], none.schema)
    rows = filter_audit.audit(clean, labels).collect()
    assert len(rows) == 600 and all(r.kept == 1 and r.removed == r.redundant == r.shapley == 0 for r in rows)
