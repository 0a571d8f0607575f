"""URL filter, WARC, fingerprints, pieces and vectors: SQL twins, edge cases, brute force."""

import hashlib
import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from metricloom.llm import fingerprints, piece_viterbi, registered, subspace_join, url_filter, warc
from metricloom.llm.q_urls import RULES
from metricloom.session import cut_lineage, shared_folder
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.01"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_sql_twin(spark, name):
    ok, note, _ = compare(spark, duck(SF), name, SF)
    assert ok is True, note


def test_url_rules_and_list(spark):
    rows = [
        (1, "http://WWW.Example.COM/en/x?q=1#f", "x"), (2, "https://a.example.com/en/", None), (3, "http://example.com/de/", None),
        (4, "http://notexample.net/es/1", None), (5, "http://com", None), (6, "http://com?x/", None), (7, None, None), (8, "no scheme", None),
        (9, "http://Spam.org/a/?b=2&utm_source=z&a=1", None), (10, "https://spam.org/a?a=1&b=2#t", None), (11, "http://spam.org/a?a=1", None),
        (None, "ftp://x.fr//y", None), (None, "ftp://x.fr//y", None), (12, "http://É.org/", None), (13, "http://x.org/" + "p/" * 5000, None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    listed = spark.createDataFrame([("http://spam.org/a?a=1&b=2",), (None,), ("bad",), ("http://www.example.com/en/x?q=1",)], "url string")
    out = {r.page_id: r for r in url_filter.filter_urls(pages, listed, RULES).collect()}
    got = {k: (r.host, r.path[:6], r.rule, r.verdict) for k, r in out.items()}
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and out[1].listed
    assert got[2][2:] == ("example.com/en/", "block") and got[3][2:] == ("com/", "allow") and got[4][2:] == ("net/es/", "block")
    assert got[5] == ("com", "", None, "allow") and got[6] == ("com", "", None, "allow") and got[7] == ("", "", None, "allow") == got[8]
    assert got[9][3] == got[10][3] == "block" and got[11][3] == "allow" and got[12][0] == "É.org" and got[None][0] == "x.fr"
    assert url_filter.filter_urls(pages, listed, RULES).count() == len(rows) and url_filter.filter_urls(pages.limit(0), listed.limit(0), RULES).count() == 0


def test_false_positives_of_the_bloom_filter_are_removed(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.org/"), F.col("id")).alias("url"))
    listed = pages.filter("page_id < 1000").select("url")
    keys = listed.select(url_filter.canonical(F.col("url")).alias("url_key"))
    blocks = 2
    table = url_filter.bloom_blocks(keys, blocks)
    maybe = url_filter.possible_hits(pages.select("page_id", url_filter.canonical(F.col("url")).alias("url_key")), table, blocks)
    assert maybe.filter("maybe and page_id < 1000").count() == 1000 and maybe.filter("maybe").count() > 1500
    out = url_filter.filter_urls(pages, listed, [], bits_per_url=1)
    assert {r.page_id for r in out.filter("verdict = 'block'").collect()} == set(range(1000))
    few = url_filter.possible_hits(pages.select("page_id", url_filter.canonical(F.col("url")).alias("url_key")), url_filter.bloom_blocks(keys, 32), 32)
    assert few.filter("maybe").count() < 1100


PAGES = [(1, "http://a/", "same"), (2, "http://b/\r\nx", "same"), (3, None, None), (4, "u", ""), (None, "n", "same"), (5, "ü", "é" * 70_000),
         (6, "v", "é" * 70_000), (7, "w", "one"), (7, "w", "one"), (9, "z", "x" * 3)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    for min_bytes, revisits in ((0, {2: 1, 4: 3, None: 1, 6: 5}), (4, {2: 1, None: 1, 6: 5})):
        manifest = cut_lineage(warc.write_archives(pages, shared_folder(spark, "warc"), min_bytes))
        for split in (37, 1000, 1 << 20):
            got = warc.read_archives(manifest, split, with_payload=True).collect()
            assert len(got) == len(PAGES)
            html = {(p, u): (h or "").encode() for p, u, h in PAGES}
            for r in got:
                data = html[r.page_id, r.url.replace("%0D%0A", "\r\n") if r.url else None]
                assert r.payload_bytes == len(data) and r.refers_to == revisits.get(r.page_id)
                assert r.record_type == ("revisit" if r.refers_to is not None else "response") and bytes(r.payload) == (b"" if r.refers_to else data)
                assert len(r.payload_digest) == 32
    assert warc.read_archives(cut_lineage(warc.write_archives(pages.limit(0), shared_folder(spark, "warc")))).count() == 0


def test_reader_ignores_magic_that_is_no_record():
    noise = warc.GZIP_MAGIC + b"\0" * 30 + zlib.compress(b"x", wbits=31)
    one = warc.record(1, "u", noise * 3, len(noise) * 3, "A" * 32, None, "d")
    data = one + noise + warc.record(2, "u", b"ok", 2, "A" * 32, None, "d") + one[: len(one) // 2]
    for split in (1, 7, 64, 10_000):
        found = []
        for start in range(0, len(data), split):
            found += list(warc.records_in(warc.ByteRange(pa.PythonFile(io.BytesIO(data), "r"), len(data)), start, min(len(data), start + split)))
        assert [b"<urn:page:1>" in f for f in found] == [True, False], split


def tree_root(text):
    h = lambda level, parts: hashlib.sha256((level + "".join(parts)).encode()).hexdigest()
    import re

    return h("r", [h("s", [h("p", [h("l", [x]) for x in re.findall(fingerprints.LEAF, p)]) for p in s.split("\n")]) for s in text.split("\n\n")])


def test_fingerprints(spark):
    rows = [(5, "One. Two!\nThree\n\nFour"), (3, None), (9, "é\U0001f600x. y"), (9, "another nine"), (None, "nobody"), (7, "a" * 100_000), (1, "same"), (0, "same")]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, fingerprint string")
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for bucket_rows in (1000, 1):
        pairs = fingerprints.with_next_text(docs, bucket_rows, ranges=4).collect()
        assert len(pairs) == len(rows)
        follows = {(r.doc_id, r.text): r.next_text for r in pairs}
        at = next(k for k, _ in follows.items() if k[0] == 9)
        seen = [at if follows[(9, "another nine")] == rows[2][1] else None]  # ties: either order, but one circle
        text, circle = want[0][1], []
        for _ in rows:
            circle.append(text)
            text = next(n for (i, t), n in follows.items() if t == text and n != "same" or t == text and (text != "same" or i == (1 if circle.count("same") == 1 else 0)))
        assert sorted(circle) == sorted((t or "") for _, t in rows), (circle, seen)
    for r in fingerprints.fingerprint_edits(docs).collect():
        own = next((t or "") for i, t in rows if i == r.doc_id and len(t or "") == r.n_chars)
        assert r.fingerprint == tree_root(own) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    one = fingerprints.fingerprint_edits(docs.filter("doc_id = 1")).first()
    assert one.fingerprint != one.edited_fingerprint and one.near_next == 1.0
    assert fingerprints.fingerprint_edits(docs.limit(0)).count() == 0


def test_differing_paragraphs(spark):
    row = spark.createDataFrame([("a\nb\n\nc", "a\nX\n\nc\nd", "a")], "a string, b string, c string")
    tree = {c: fingerprints.branches(F.col(c)) for c in "abc"}
    got = row.select(fingerprints.differing_paragraphs(tree["a"], tree["b"]).alias("x"), fingerprints.differing_paragraphs(tree["a"], tree["c"]).alias("y")).first()
    assert [tuple(p) for p in got.x] == [(0, 1)] and [tuple(p) for p in got.y] == [(0, 1), (1, 0)]


def test_edits_are_aligned_by_hash(spark):
    cases = [
        ("one\ntwo\nthree\n\nfour", "one\nnew\ntwo\nthree\n\nfour", [("b", 0, 1)]),  # an inserted line
        ("one\ntwo\nthree", "one\nthree", [("a", 0, 1)]),  # a line taken out
        ("one\ntwo", "one\ntwo!", [("a", 0, 1), ("b", 0, 1)]),  # a changed line
        ("s\nt\n\nu\n\nv", "v\n\ns\nt\n\nu", []),  # moved sections
        ("s\n\nu", "s\n\nnew\nlines\n\nu", [("b", 1, 0), ("b", 1, 1)]),  # an inserted section
        ("same", "same", []), ("", "", []), ("", "x", [("a", 0, 0), ("b", 0, 0)]),
        ("r\nr\nq", "r\nq", []),  # repeats
        ("\n".join(f"line {i}" for i in range(20_000)), "\n".join(f"line {i}" for i in range(20_000) if i != 7_000), [("a", 0, 7_000)]),
    ]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = rows.select("i", fingerprints.edits(fingerprints.branches(F.col("a")), fingerprints.branches(F.col("b"))).alias("e")).collect()
    assert {r.i: [tuple(x) for x in r.e] for r in got} == {i: want for i, (_, _, want) in enumerate(cases)}


def best_cut(v, text):
    best = [(0.0, [])]
    for end in range(1, len(text) + 1):
        found = [(best[s][0] + v.scores[v.ids[text[s:end]]], s, v.ids[text[s:end]]) for s in range(max(0, end - v.longest), end) if text[s:end] in v.ids]
        if text[end - 1] not in v.ids:
            found.append((best[end - 1][0] + v.scores[v.unknown], end - 1, v.unknown))
        score, start, piece = max(found, key=lambda f: (f[0], -f[1]))
        best.append((score, best[start][1] + v.expand(piece, text[start])))
    return best[-1][1]


def test_pieces_equal_brute_force(spark):
    encoder = piece_viterbi.PieceEncoder(PIECES, cache_words=500)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    texts += ["", " ", "\n\nx", "  two  spaces ", "你好é\U0001f600 ñ\x00\x01", "a" * 500, "ab" * 300 + " c", "\x00\x01\x02\x03\x04\x05\x06\x07 all", "▁mark ▁"]
    for _ in range(2):
        ids, bounds = encoder.encode(pa.array(texts, pa.large_string()))
        back = encoder.decode(ids, bounds).to_pylist()
        for i, t in enumerate(texts):
            marked = "▁" + t.replace(" ", "▁") if t else ""
            own = ids[bounds[i] : bounds[i + 1]].tolist()
            assert own == list(piece_viterbi.stream_ids(encoder.vocabulary, marked)), t[:40]
            assert len(t) > 3000 or own == best_cut(encoder.vocabulary, marked), t[:40]
            assert back[i] == t.replace("▁", " ")


def test_stream_holds_a_bounded_window():
    v = piece_viterbi.Vocabulary(PIECES)
    stream, rng, held = piece_viterbi.StreamingViterbi(v), np.random.default_rng(0), 0
    text = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz▁é"), 20_000))
    out = []
    for c in text:
        out += stream.push(c)
        held = max(held, stream.held)
    assert out + stream.finish() == best_cut(v, text[:0]) + list(piece_viterbi.stream_ids(v, text)) and held < 10 * v.longest


def test_piece_columns(spark):
    docs = spark.createDataFrame([(1, "some text\nhere", 2.0), (None, None, None), (3, "", 1.0)], "doc_id long, text string, ids double")
    out = piece_viterbi.decode_pieces(piece_viterbi.encode_pieces(docs, PIECES), PIECES).collect()
    assert [r.decoded for r in out] == ["some text\nhere", "", ""]
    assert all(r.round_trip for r in piece_viterbi.digests(docs, PIECES).collect()) and piece_viterbi.digests(docs.limit(0), PIECES).count() == 0


def brute_links(rows, cosine):
    ok = [(i, np.array(e, float)) for i, e in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    n, root = {k: 0 for k in range(len(ok))}, list(range(len(ok)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(ok)):
        for b in range(a):
            x, y = ok[a][1], ok[b][1]
            if len(x) == len(y) and x @ y >= cosine * np.sqrt((x @ x) * (y @ y)):
                n[a], n[b] = n[a] + 1, n[b] + 1
                root[find(a)] = find(b)
    least = {}
    for k in range(len(ok)):
        least[find(k)] = min(ok[k][0], least.get(find(k), ok[k][0]))
    return sorted((ok[k][0], n[k], least[find(k)]) for k in range(len(ok)))


@pytest.mark.parametrize("size", [1, 5, 24, 64])
def test_vector_links_equal_brute_force(spark, size):
    rng = np.random.default_rng(size)
    base = rng.normal(size=(12, size))
    rows = [(1000 - i, (base[i % 12] * rng.uniform(0.1, 9) + rng.normal(size=size) * 0.25 * (i % 3)).tolist()) for i in range(240)]
    rows += [(2000 + i, rows[3][1]) for i in range(5)] + [(3000, [0.5] * (size + 1)), (3001, [1.0] * (size + 1)), (3002, rows[9][1])]
    odd = [(4000, None), (4001, []), (4002, [0.0] * size), (4003, [float("nan")] * size), (4004, [float("inf")] * size), (4005, [None] * size), (None, rows[0][1])]
    table = spark.createDataFrame([(i, e, "x") for i, e in rows + odd], "vec_id long, embedding array<double>, n_links string")
    for cell_rows in (8192, 30):
        out = subspace_join.vector_links(table, 0.9, cell_rows).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in out if r.vec_id is not None and r.vec_id < 4000) == brute_links(rows, 0.9)
        assert [r.kept for r in out if r.vec_id is None or r.vec_id >= 4000] == [True] * len(odd) and len(out) == len(rows) + len(odd)
    assert subspace_join.vector_links(table.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [1e-200, 5e-324, 1e200, 1e307])
def test_vector_links_of_any_length(spark, scale):
    """Products of raw components would under- or overflow; the links are those of the unit vectors."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 64))
    base[20:40] = base[:20] + rng.normal(size=(20, 64)) * 0.2
    if scale == 5e-324:  # whole multiples of the least number
        base = np.round(base * 1000)
    vectors = base * scale
    units = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    out = subspace_join.vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = brute_links([(i, u.tolist()) for i, u in enumerate(units)], 0.9)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out) == want and 0 < sum(w[1] for w in want) < 200


def test_unlike_vectors_under_one_id(spark):
    rows = [(5, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (7, [1.0, 0.1, 0.0]), (8, [1.0, 0.0, 0.1]), (3, [0.0, 1.0, 0.1]), (3, [0.0, 0.0, 1.0])]
    out = subspace_join.vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out) == [(3, 0, 3), (3, 1, 3), (5, 1, 3), (5, 2, 5), (7, 2, 5), (8, 2, 5)]


@pytest.mark.parametrize("n, part_rows, copies", [(600, 32_768, 1), (600, 100, 6), (9000, 32_768, 3)])
def test_a_vector_moves_once_for_each_part(spark, n, part_rows, copies):
    """Neither the number of cells that a vector visits nor the blocks multiply what is shuffled."""
    rng = np.random.default_rng(n)
    nodes = spark.createDataFrame([(i, 1, rng.normal(size=64).tolist()) for i in range(n)], "node long, mult long, embedding array<double>")
    dealt = subspace_join.part_pairs(nodes, True, part_rows)
    got = dealt.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("vector")).alias("bytes")).agg(F.count(F.lit(1)), F.min("n"), F.max("n"), F.max("bytes")).first()
    assert tuple(got) == (n, copies, copies, 256)
    assert dealt.groupBy("lo", "hi").count().count() == copies * (copies + 1) // 2
