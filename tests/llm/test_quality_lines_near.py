"""Classifier by held-out accuracy; lines by hand; near copies by brute force."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from metricloom.llm import bag_minhash as bm
from metricloom.llm import quality_model as qm
from metricloom.llm.line_templates import drop_recurring_lines
from metricloom.llm.q_quality_model import op4_quality_classifier

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_classifier_on_held_out_documents(spark):
    got = op4_quality_classifier(spark, SF).toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    both = got.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    assert (both[both.held_out].predicted == both[both.held_out].quality).mean() > 0.97


def test_flat_trees_equal_a_walk_by_node():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 4)).astype(np.float32)
    forest = qm.fit_forest(x, (x[:, 0] * x[:, 1] > 0).astype(float), trees=20, depth=3)
    binned = forest.bins(x)
    for i in range(0, 400, 37):
        total = forest.start
        for f, c, v in zip(forest.feature, forest.cut, forest.value):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if binned[i, f[node]] > c[node] else 1)
            total += v[node - len(f)]
        assert forest.score(x[i : i + 1])[0] == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((forest.score(x) >= 0.5) == (x[:, 0] * x[:, 1] > 0)).mean() > 0.9


def test_classifier_edge_cases(spark):
    docs = spark.createDataFrame([(None, None, 1.5), (1, "", 2.0), (1, "", 2.0), (2, "x " * 200_000, None)], "doc_id long, text string, score double")
    none = spark.createDataFrame([(None, 1, 0), (7, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    forest = qm.train(docs, none)
    assert [r.score for r in qm.score(docs, forest).collect()] == [0.5] * 4
    ones = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert all(r.score > 0.5 for r in qm.score(docs, qm.train(docs, ones)).collect())
    assert qm.score(docs.limit(0), forest).count() == 0


def test_statistics_do_not_depend_on_the_batch():
    texts = ["", "One line.\nOne line.\nB 12!", "ÀÉ ü", " ", "\n", "abc|def ###", "A" * 1000]
    whole = qm.statistics(pa.array(texts, pa.large_string()))
    for i, t in enumerate(texts):
        assert np.array_equal(whole[i], qm.statistics(pa.array([t], pa.large_string()))[0])


def test_lines_by_hand(spark):
    own = lambda i: f"alpha{chr(97 + i)} beta gamma delta w{chr(97 + i)} epsilon zeta eta theta iota kappa"
    rows = [(i, f"{own(i)}\nPosted by user {name} on {i} May 2020\nAll rights reserved.\nshort line", "en", "s", 0)
            for i, name in enumerate(["Ann", "Bob", "Cid", "Dan"])]
    rows += [(10, "Posted by user Eve on 9 May 2020", "en", "s", 0), (None, None, None, None, None), (11, "", "en", "s", 0)]
    rows += [(20 + i, own(9) + "\n" + own(8), "en", "s", 5) for i in range(4)]  # exact copies keep their lines
    out = {r.doc_id: r for r in drop_recurring_lines(spark.createDataFrame(rows, DOCS), min_constant=0.6).collect()}
    for i in range(4):
        assert out[i].text == own(i) and out[i].n_chars == len(out[i].text) and out[i].lines_dropped == 3
    assert out[10].text == "" and out[10].n_chars == 0 and out[10].lines_dropped == 1  # nothing but boilerplate
    assert out[None].text is None and out[11].text == "" and out[20].text == rows[-1][1] and out[20].n_chars == 5
    assert drop_recurring_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_lines_of_mostly_boilerplate_and_short_ones(spark):
    """Short lines and texts of mostly boilerplate lose it as any other text does."""
    rows = [(i, f"one{chr(97 + i)} own{chr(97 + i)}\nSubscribe now\nShare this", "en", "s", 0) for i in range(6)]
    rows += [(10 + i, f"Read more about our cookie policy here\nonly{chr(97 + i)} few{chr(97 + i)} words", "en", "s", 0) for i in range(6)]
    out = {r.doc_id: r.text for r in drop_recurring_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert out == {r[0]: (r[1].split("\n")[0] if r[0] < 10 else r[1].split("\n")[1]) for r in rows}
    # a short line has to recur in a share of all texts
    few = {r.doc_id: r.text for r in drop_recurring_lines(spark.createDataFrame(rows, DOCS), short_share=0.6).collect()}
    assert few == {r[0]: (r[1] if r[0] < 10 else out[r[0]]) for r in rows}


def test_lines_of_near_copies_stay(spark):
    """Texts that differ in a word here and there support nothing; a passage in texts of other content goes."""
    rng = np.random.default_rng(8)
    base = [[f"v{rng.integers(0, 10**6):x}q".translate(str.maketrans("0123456789", "ghijklmnop")) for _ in range(20)] for _ in range(8)]
    rows = []
    for i in range(6):
        edit = [list(line) for line in base]
        edit[i][10] = "changed" + chr(97 + i)
        rows.append((i, "\n".join(" ".join(line) for line in edit), "en", "s", 0))
    passage = " ".join(f"passage{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(55))
    for i in range(4):
        words = [f"z{chr(97 + i)}{rng.integers(0, 10**6):x}".translate(str.maketrans("0123456789", "ghijklmnop")) for _ in range(40)]
        rows.append((10 + i, " ".join(words) + "\n" + passage, "en", "s", 0))
    out = {r.doc_id: r.text for r in drop_recurring_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert out == {r[0]: (r[1] if r[0] < 10 else r[1].split("\n")[0]) for r in rows}


def test_lines_carry_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, f"own{chr(97 + i)} text{chr(97 + i)}\nAll rights reserved here", 7) for i in range(4)], "doc_id long, text string, k1 int")
    for name in ("k2", "places", "row", "pos", "leaf", "line_key", "_key", "lines_dropped"):
        docs = docs.withColumn(name, F.lit(name))
    out = drop_recurring_lines(docs).collect()
    assert all(r.k1 == 7 and r.places == "places" and r.row == "row" and r.lines_dropped == 1 and "rights" not in r.text for r in out) and len(out) == 4


def bag(text, k=5):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute_classes(rows, similarity=0.8):
    texts = sorted({t or "" for _, t in rows})
    bags, parent = [bag(t) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if min(map(lambda b: b.total(), (bags[i], bags[j]))) >= similarity * max(bags[i].total(), bags[j].total()) > 0 and jaccard(bags[i], bags[j]) >= similarity:
                parent[find(i)] = find(j)
    group = {t: find(i) for i, t in enumerate(texts)}
    least = {}
    for i, t in rows:
        g = group[t or ""]
        least[g] = min(i, least.get(g, i))
    return {(i, least[group[t or ""]]) for i, t in rows}


def test_registers_estimate_weighted_jaccard():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)]
    for _ in range(4):
        a = " ".join(rng.choice(words, 150, p=np.arange(60, 0, -1) / 1830))
        b = " ".join([*a.split()[:100], *rng.choice(words, 60)])
        texts = pa.array([a, b], pa.large_string())
        row, s, w = bm.shingles(texts, 1)
        sig = bm.signatures(row, s, w, 2, 2000)
        assert abs((sig[0] == sig[1]).mean() - jaccard(bag(a, 1), bag(b, 1))) < 0.06
        alone = bm.signatures(*bm.shingles(texts.slice(1, 1), 1), 1, 2000)
        assert np.array_equal(alone[0], sig[1])  # the batch has no influence
        assert bm.overlaps(texts.slice(0, 1), texts.slice(1, 1), 1)[0] == pytest.approx(jaccard(bag(a, 1), bag(b, 1)))


@pytest.fixture(scope="module")
def planted(spark):
    """Near copies in chains and stars, a hot group, a passage that many share."""
    rng = np.random.default_rng(2)
    new = lambda n: " ".join(f"x{i}" for i in rng.integers(0, 10**6, n))
    rows, base, passage = [], new(120).split(), new(60)
    for i in range(60):
        edit = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 4)):
            edit[k] = f"e{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(edit)))
    chain = new(100).split()
    for i in range(8):
        chain = [*chain[3:], *new(3).split()]
        rows.append((100 + i, " ".join(chain)))
    rows += [(200 + i, f"{passage} {new(30)}") for i in range(60)]
    rows += [(300 + i, base_ := new(40)) for i in range(3)] + [(400 + i, base_) for i in range(5)]
    rows += [(500, ""), (501, None), (502, " \n"), (503, "two words"), (504, "Two  words"), (505, "a b c d"), (506, "la " * 30), (507, "la " * 33)]
    return rows


def test_near_duplicates_equal_brute_force(spark, planted):
    docs = spark.createDataFrame(planted, "doc_id long, text string")
    for block in (1000, 7):
        got = {(r.doc_id, r.class_id) for r in bm.near_duplicates(docs, block=block).collect()}
        assert got == brute_classes(planted)


def test_open_nodes_hold_every_similar_pair(spark):
    """Texts that share a passage alone are settled; no text similar to one of another root is."""
    rng = np.random.default_rng(8)
    new = lambda n: [f"p{i}" for i in rng.integers(0, 10**6, n)]
    passage, texts = new(60), []
    for _ in range(150):
        texts.append([*passage, *new(rng.integers(40, 80))])
    for share in np.linspace(0.7, 1, 60):  # pairs on both sides of the threshold, the common passage in each
        own = new(120)
        cut = int(120 * share)
        texts += [[*passage, *own], [*passage, *own[:cut], *new(120 - cut)]]
    texts += [["la"] * n for n in (40, 44, 60, 90)]
    rows = [(i, i, " ".join(t)) for i, t in enumerate(texts)]
    still = {r.node for r in bm.open_nodes(spark.createDataFrame(rows, "node long, root long, text string"), 5, 0.8).collect()}
    bags = [bag(t) for _, _, t in rows]
    similar = {k for i in range(len(rows)) for j in range(i) if jaccard(bags[i], bags[j]) >= 0.8 for k in (i, j)}
    assert similar and similar <= still and not still & set(range(150))


def test_keep_one_and_edge_cases(spark, planted):
    rows = [(i, t, "l", None, 1) for i, t in planted] + [(503, "two words", "l", None, 1)] * 2 + [(None, "no id here", None, None, None)] * 2
    kept = bm.keep_one(spark.createDataFrame(rows, DOCS)).collect()
    want = {i for i, c in brute_classes(planted) if i == c}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(want) and sum(r.doc_id is None for r in kept) == 1
    assert bm.keep_one(spark.createDataFrame([], DOCS)).count() == 0


def test_words_end_at_unicode_white_space(spark):
    words = [f"z{i}" for i in range(60)]
    rows = [(1, "\u00a0".join(words)), (2, "\u3000".join([*words, "more"])), (3, "\u2003 ".join(["less", *words])), (4, "\u00a0\u3000"), (5, "a\u200bb"), (6, "a b")]
    got = {(r.doc_id, r.class_id) for r in bm.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows) == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6)}


def test_unlike_texts_under_one_id(spark):
    rng = np.random.default_rng(6)
    new = lambda: " ".join(f"y{i}" for i in rng.integers(0, 10**6, 60))
    a, b = new(), new()
    rows = [(5, a), (7, a + " tail"), (5, b), (9, b + " end"), (5, b), (11, new()), (11, new()), (11, None)]
    docs = spark.createDataFrame([(i, t, "l", None, 1) for i, t in rows], DOCS)
    classes = bm.near_duplicates(docs.select("doc_id", "text")).collect()
    assert sorted((r.doc_id, r.class_id) for r in classes) == [(5, 5), (5, 5), (5, 5), (7, 5), (9, 5), (11, 11), (11, 11), (11, 11)]
    assert len({r.class_key for r in classes}) == 5
    kept = bm.keep_one(docs).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == sorted([(5, a), (5, b), *((i, t or "") for i, t in rows[5:])])


def test_near_duplicates_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {(r.doc_id, r.class_id) for r in bm.near_duplicates(docs).collect()}
    assert got == brute_classes([tuple(r) for r in docs.collect()])


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf).toPandas()
    good = docs.join(spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 0"), "doc_id", "left_semi").select("doc_id").toPandas()
    assert out.groupby("sequence_id").length.sum().max() <= 2048 and len(set(out.doc_id)) > docs.count() / 2
    assert len(set(good.doc_id) & set(out.doc_id)) <= 0.1 * len(good)
    assert docs.filter(F.col("doc_id").isin([int(i) for i in set(out.doc_id)])).count() == out.doc_id.nunique()


def test_dropping_lines_splits_a_text_once(spark):
    """A split inside the loop over lines would be made again for every line kept."""
    rows = [(i, f"own{chr(97 + i)} words of text {chr(97 + i)}\nAll rights reserved by us here.\nfor {chr(97 + i)} ever and {chr(98 + i)}", "en", "s", 0) for i in range(6)]
    out = drop_recurring_lines(spark.createDataFrame(rows, DOCS))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    cleaned = plan[plan.index("array_join(") :]
    assert cleaned[: cleaned.index(" AS text")].count("split(") == 1
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {i: "\n".join(x for x in t.split("\n") if "reserved" not in x) for i, t, *_ in rows}
