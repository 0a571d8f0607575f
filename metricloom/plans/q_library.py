"""Series features, similarity, clustering and the pattern library."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.functions.scalars import cosine, iso, stable_id, text_bucket
from metricloom.operators import clustering, features, library, similarity
from metricloom.plans import inputs
from metricloom.plans.inputs import table
from metricloom.plans.oracle import SNAPSHOTS, USER_POINTS, iso as siso, r6
from metricloom.plans.registry import query
from metricloom.plans.rounding import round6

SEGMENT = 32
TYPES = ["workload", "performance", "resource"]


def segments(spark, sf):
    """Library patterns: a user's series cut into arrays of at most 32 values."""
    p = inputs.user_points(spark, sf).withColumn("seg", F.floor(F.col("idx") / SEGMENT).cast("bigint"))
    packed = F.sort_array(F.collect_list(F.struct("idx", "value", "event_type")))
    out = p.groupBy("user_id", "seg").agg(packed.alias("p"), F.min("ts").alias("ts"))
    return out.select(
        (F.col("user_id") * F.lit(1 << 32) + F.col("seg")).alias("pattern_id"),
        F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("user_id") % 3 + 1).cast("int")).alias("pattern_type"),
        "seg", "ts", F.col("p.value").alias("values"),
        F.sort_array(F.array_distinct("p.event_type")).alias("tags"),
    )


def featured(spark, sf, season_lag=8):
    return features.with_category(features.series_features(segments(spark, sf)), season_lag=season_lag)


FEATURES = f"""
{USER_POINTS},
sp AS (SELECT user_id * 4294967296 + idx // 32 AS pid, user_id, idx // 32 AS seg, idx % 32 AS i, ts, event_type, value FROM up),
sized AS (SELECT sp.*, count(*) OVER (PARTITION BY pid) AS n, avg(value) OVER (PARTITION BY pid) AS mu,
  value - lag(value) OVER (PARTITION BY pid ORDER BY i) AS d,
  lag(value, 8) OVER (PARTITION BY pid ORDER BY i) AS lagged FROM sp),
basic AS (
  SELECT pid, user_id, seg, n, min(ts) AS ts, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS lo, max(value) AS hi,
    CASE WHEN max(value) > min(value) THEN avg((value - mu) ** 3) / stddev_pop(value) ** 3 END AS skewness,
    CASE WHEN max(value) > min(value) THEN kurtosis_pop(value) END AS kurtosis,
    CASE WHEN max(value) > min(value) THEN regr_r2(value, i) END AS trend,
    avg(d) AS mroc, max(abs(d)) AS xroc, CASE WHEN n >= 16 THEN corr(value, lagged) END AS acf,
    list_sort(list(DISTINCT event_type)) AS tags
  FROM sized WHERE n >= 10 GROUP BY pid, user_id, seg, n),
power AS (
  SELECT pid, n, k, (sum((value - mu) * cos(2 * pi() * k * i / n)) ** 2 + sum((value - mu) * sin(2 * pi() * k * i / n)) ** 2)
    * CASE WHEN 2 * k = n THEN 1 ELSE 2 END AS p
  FROM sized JOIN (SELECT unnest(generate_series(1, 16)) AS k) ON 2 * k <= n
  WHERE n > 10 GROUP BY pid, n, k),
spectrum AS (
  SELECT pid, max_by(k, p) / CAST(any_value(n) AS DOUBLE) AS freq, -sum(CASE WHEN p > 0 THEN p / t * ln(p / t) ELSE 0 END) AS entropy
  FROM (SELECT *, sum(p) OVER (PARTITION BY pid) AS t FROM power) GROUP BY pid),
feats AS (
  SELECT basic.*, freq, entropy,
    CASE user_id % 3 WHEN 0 THEN 'workload' WHEN 1 THEN 'performance' ELSE 'resource' END AS pattern_type,
    CASE WHEN entropy < 0.7 THEN 'periodic' WHEN xroc > 3 * std THEN 'spike' WHEN trend > 0.7 THEN 'gradual'
      WHEN abs(acf) > 0.7 THEN 'seasonal' WHEN trend > 0.3 THEN 'trend' ELSE 'random' END AS category,
    [mean, std, lo, hi, hi - lo, coalesce(skewness, 0), coalesce(kurtosis, 0), coalesce(trend, 0)] AS vec
  FROM basic LEFT JOIN spectrum USING (pid))
"""


@query("series_statistics", "A11 A12 A14", f"""
WITH {FEATURES} SELECT pid AS pattern_id, {r6('mean')} AS mean, {r6('std')} AS std, lo AS min, hi AS max, {r6('hi - lo')} AS range,
  {r6('skewness')} AS skewness, {r6('kurtosis')} AS kurtosis, {r6('trend')} AS trend_strength,
  {r6('mroc')} AS mean_rate_of_change, {r6('xroc')} AS max_rate_of_change FROM feats
""")
def series_statistics(spark, sf):
    cols = ["mean", "std", "range", "skewness", "kurtosis", "trend_strength", "mean_rate_of_change", "max_rate_of_change"]
    return features.series_features(segments(spark, sf)).select("pattern_id", "min", "max", *[round6(c).alias(c) for c in cols])


@query("series_spectrum", "A13", f"""
WITH {FEATURES} SELECT pid AS pattern_id, {r6('freq')} AS dominant_frequency, {r6('entropy')} AS spectral_entropy FROM feats
""")
def series_spectrum(spark, sf):
    out = features.series_features(segments(spark, sf))
    return out.select("pattern_id", *[round6(c).alias(c) for c in ("dominant_frequency", "spectral_entropy")])


@query("series_spectrum_numpy", "X2", f"""
WITH {FEATURES} SELECT pid AS pattern_id, {r6('freq')} AS dominant_frequency, {r6('entropy')} AS spectral_entropy
FROM feats WHERE freq IS NOT NULL
""")
def series_spectrum_numpy(spark, sf):
    """The series with a spectrum; the numeric routine itself is a built-in expression."""
    out = features.series_features(segments(spark, sf)).filter(F.col("dominant_frequency").isNotNull())
    return out.select("pattern_id", *[round6(c).alias(c) for c in ("dominant_frequency", "spectral_entropy")])


@query("series_category", "F9 W14 D8", f"WITH {FEATURES} SELECT pid AS pattern_id, category FROM feats")
def series_category(spark, sf):
    return featured(spark, sf).select("pattern_id", "category")


CUMULATIVE = FEATURES.replace(
    "sp AS (SELECT user_id * 4294967296", "sp0 AS (SELECT user_id * 4294967296"
).replace("value FROM up),\nsized", "value FROM up),\nsp AS (SELECT * REPLACE (sum(value) OVER (PARTITION BY pid ORDER BY i) AS value) FROM sp0),\nsized")


@query("running_sum_category", "F9", f"WITH {CUMULATIVE} SELECT pid AS pattern_id, category, {r6('trend')} AS trend_strength FROM feats")
def running_sum_category(spark, sf):
    sums = F.aggregate(
        "values", F.array().cast("array<double>"),
        lambda acc, x: F.array_append(acc, x + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0))),
    )
    out = features.with_category(features.series_features(segments(spark, sf).withColumn("values", sums)), season_lag=8)
    return out.select("pattern_id", "category", round6("trend_strength").alias("trend_strength"))


@query("categorical_features", "F7", """
SELECT event_id, 1 AS has_source, CAST(('0x' || substr(md5(event_type), 1, 7)) AS BIGINT) % 1000 AS source_value,
  CASE WHEN user_id % 4 = 0 THEN 0 ELSE 1 END AS has_region,
  CASE WHEN user_id % 4 <> 0 THEN CAST(('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 7)) AS BIGINT) % 1000 END AS region_value
FROM events
""")
def categorical_features(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("source"),
        F.when(F.col("user_id") % 4 != 0, F.col("user_id").cast("string")).alias("region"),
    )
    return features.categorical_features(e, ["source", "region"]).drop("source", "region")


@query("cosine_of_arrays", "F4", f"""
SELECT a.vec_id, {r6('list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])')} AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def cosine_of_arrays(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(n, "vec_id").select("vec_id", round6(cosine(F.col("embedding"), F.col("next"))).alias("similarity"))


def vectors(spark, sf):
    return featured(spark, sf).withColumn("vector", features.feature_vector())


@query("best_library_match", "J7 D7", f"""
WITH {FEATURES},
m AS (
  SELECT p.pid AS probe_id, l.pid AS library_id, p.pattern_type, list_cosine_similarity(p.vec, l.vec) AS s
  FROM feats p JOIN feats l ON p.pattern_type = l.pattern_type AND p.seg > 0 AND l.seg = 0)
SELECT probe_id, pattern_type, min_by(library_id, (-round(s, 12), library_id)) AS library_id, {r6('max(s)')} AS similarity
FROM m GROUP BY 1, 2 HAVING max(s) >= 0.8
""")
def best_library_match(spark, sf):
    v = vectors(spark, sf)
    out = similarity.best_matches(
        v.filter("seg > 0").withColumnRenamed("pattern_id", "probe_id"),
        v.filter("seg = 0").withColumnRenamed("pattern_id", "library_id"), ["pattern_type"],
    )
    return out.withColumn("similarity", round6("similarity"))


@query("best_embedding_match", "J7 F4", f"""
WITH m AS (
  SELECT p.vec_id AS probe_id, l.vec_id AS library_id, p.label,
    list_cosine_similarity(p.embedding::DOUBLE[], l.embedding::DOUBLE[]) AS s
  FROM embeddings p JOIN embeddings l ON p.label = l.label AND p.vec_id <> l.vec_id)
SELECT probe_id, label, min_by(library_id, (-round(s, 12), library_id)) AS library_id, {r6('max(s)')} AS similarity
FROM m GROUP BY 1, 2 HAVING max(s) >= 0.3
""")
def best_embedding_match(spark, sf):
    e = table(spark, sf, "embeddings")
    out = similarity.best_matches(
        e.select(F.col("vec_id").alias("probe_id"), "label", F.col("embedding").alias("vector")),
        e.select(F.col("vec_id").alias("library_id"), "label", F.col("embedding").alias("vector")),
        ["label"], 0.3, exclude_self=True,
    )
    return out.withColumn("similarity", round6("similarity"))


@query("embedding_pairs_above_threshold", "J6 J7", f"""
SELECT a.vec_id AS left_id, b.vec_id AS right_id, {r6('list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])')} AS similarity
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3
""")
def embedding_pairs_above_threshold(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("all", F.lit(1))
    out = similarity.similar_within(e.select("all", "vec_id", F.col("embedding").alias("vector")), ["all"], 0.3, "vec_id")
    return out.select("left_id", "right_id", round6("similarity").alias("similarity"))


MERGED = f"""
{FEATURES},
lib AS (SELECT *, 1 AS frequency, 0.5 AS confidence FROM feats WHERE seg = 0),
inc AS (SELECT * FROM feats WHERE seg > 0),
best AS (
  SELECT p.pid AS probe, p.tags AS ptags, min_by(l.pid, (-round(list_cosine_similarity(p.vec, l.vec), 12), l.pid)) AS hit
  FROM inc p JOIN lib l ON p.pattern_type = l.pattern_type GROUP BY 1, 2
  HAVING max(list_cosine_similarity(p.vec, l.vec)) >= 0.9999),
hits AS (SELECT hit, count(*) AS c FROM best GROUP BY 1),
hit_tags AS (SELECT hit, list(DISTINCT t) AS tags FROM (SELECT hit, unnest(ptags) AS t FROM best) GROUP BY 1),
merged AS (
  SELECT pid AS pattern_id, pattern_type, 1 + coalesce(c, 0) AS frequency, least(1.0, 0.5 + 0.1 * coalesce(c, 0)) AS confidence,
    array_to_string(list_sort(list_distinct(list_concat(lib.tags, coalesce(hit_tags.tags, [])))), ',') AS tags
  FROM lib LEFT JOIN hits ON hits.hit = pid LEFT JOIN hit_tags ON hit_tags.hit = pid
  UNION ALL
  SELECT pid, pattern_type, 1, 0.5, array_to_string(list_sort(tags), ',') FROM inc WHERE pid NOT IN (SELECT probe FROM best))
"""


@query("merge_patterns", "M7 U4", f"""
WITH {MERGED}
SELECT pattern_id, pattern_type, CAST(frequency AS BIGINT) AS frequency, {r6('CAST(confidence AS DOUBLE)')} AS confidence, tags FROM merged
""")
def merge_patterns(spark, sf):
    v = vectors(spark, sf)
    lib = v.filter("seg = 0").withColumns({"frequency": F.lit(1).cast("bigint"), "confidence": F.lit(0.5)})
    out = library.merge_into_library(lib, v.filter("seg > 0"), 0.9999, start_confidence=0.5)
    return out.select(
        "pattern_id", "pattern_type", "frequency", round6("confidence").alias("confidence"),
        F.array_join(F.sort_array("tags"), ",").alias("tags"),
    )


LIB = f"""
{FEATURES},
lib AS (SELECT pid AS pattern_id, pattern_type, category, tags, ts, round(1 - coalesce(trend, 0), 6) AS confidence,
  CAST(floor(hi) AS BIGINT) AS frequency FROM feats)
"""


def lib_table(spark, sf):
    return featured(spark, sf).select(
        "pattern_id", "pattern_type", "category", "tags", "ts",
        F.round(1 - F.coalesce("trend_strength", F.lit(0.0)), 6).alias("confidence"), F.floor("max").alias("frequency"),
    )


@query("library_query", "P4 L2", f"""
WITH {LIB} SELECT pattern_id, category, frequency, {r6('confidence')} AS confidence FROM lib
WHERE confidence >= 0.95 AND pattern_type = 'workload' AND category = 'random' AND list_has_all(tags, ['click', 'view'])
ORDER BY frequency DESC, pattern_id LIMIT 20
""")
def library_query(spark, sf):
    out = library.query_library(lib_table(spark, sf), "workload", "random", ["click", "view"], 0.95, 20)
    return out.select("pattern_id", "category", "frequency", round6("confidence").alias("confidence"))


@query("library_tag_filter", "P4", f"WITH {LIB} SELECT pattern_id FROM lib WHERE confidence >= 0.9 AND list_has_all(tags, ['signup', 'error'])")
def library_tag_filter(spark, sf):
    return library.query_library(lib_table(spark, sf), tags=["signup", "error"], min_confidence=0.9).select("pattern_id")


@query("temporal_histogram", "A16", f"""
WITH {LIB}, s AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi, least(count(*), 50) AS m FROM lib),
b AS (SELECT unnest(generate_series(0, m - 2)) AS bin FROM s),
c AS (SELECT CAST(least(floor((epoch_us(ts) - lo) / ((hi - lo) / (m - 1)::DOUBLE)), m - 2) AS BIGINT) AS bin, count(*) AS n FROM lib, s GROUP BY 1)
SELECT b.bin, coalesce(n, 0) AS n, {siso('make_timestamp(CAST(floor(lo + (hi - lo) / (m - 1)::DOUBLE * b.bin) AS BIGINT))')} AS bin_start
FROM b CROSS JOIN s LEFT JOIN c ON c.bin = b.bin
""")
def temporal_histogram(spark, sf):
    out = library.temporal_histogram(lib_table(spark, sf))
    return out.select("bin", "n", iso("bin_start").alias("bin_start"))


COLUMNS = features.VECTOR
SCALED = f"""
{FEATURES},
raw AS (SELECT pid, mean AS v0, std AS v1, lo AS v2, hi AS v3, hi - lo AS v4, coalesce(skewness, 0) AS v5, coalesce(kurtosis, 0) AS v6, coalesce(trend, 0) AS v7 FROM feats),
scaled AS (SELECT pid, {', '.join(f'(v{i} - avg(v{i}) OVER ()) / CASE WHEN stddev_pop(v{i}) OVER () = 0 THEN 1 ELSE stddev_pop(v{i}) OVER () END AS v{i}' for i in range(8))} FROM raw),
pairs AS (
  SELECT a.pid AS a, b.pid AS b, sqrt({' + '.join(f'(a.v{i} - b.v{i}) ** 2' for i in range(8))}) AS d
  FROM scaled a JOIN scaled b ON a.pid <> b.pid)
"""


def scaled(spark, sf):
    f = features.series_features(segments(spark, sf)).select("pattern_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in COLUMNS])
    return similarity.standardise(f, COLUMNS)


@query("epsilon_neighbours", "J14", f"WITH {SCALED} SELECT a AS pattern_id, b AS other, {r6('d')} AS distance FROM pairs WHERE d <= 1.0")
def epsilon_neighbours(spark, sf):
    out = similarity.neighbour_pairs(scaled(spark, sf), "pattern_id", COLUMNS, 1.0)
    return out.withColumn("distance", round6("distance"))


CLUSTERS = f"""
{SCALED},
near AS (SELECT a, b FROM pairs WHERE d <= 1.0),
cores AS (SELECT a AS pid FROM near GROUP BY a HAVING count(*) + 1 >= 5),
reach(a, b) AS (
  SELECT pid, pid FROM cores
  UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b JOIN cores c ON c.pid = n.b),
core_labels AS (SELECT a AS pid, min(b) AS label FROM reach GROUP BY a),
labels AS (
  SELECT pid, true AS core, label FROM core_labels
  UNION ALL SELECT s.pid, false, coalesce((SELECT min(label) FROM near JOIN core_labels c ON c.pid = near.b WHERE near.a = s.pid), -1)
  FROM scaled s WHERE s.pid NOT IN (SELECT pid FROM cores))
"""


@query("density_clusters", "M6 J14", f"WITH RECURSIVE {CLUSTERS} SELECT pid AS pattern_id, core, label FROM labels")
def density_clusters(spark, sf):
    return clustering.density_clusters(scaled(spark, sf), "pattern_id", COLUMNS, 1.0)


@query("library_analysis", "A15 M6", f"""
WITH RECURSIVE {CLUSTERS}
SELECT 'total' AS kind, 'all' AS item, count(*) AS n FROM feats
UNION ALL SELECT 'category', category, count(*) FROM feats GROUP BY 2
UNION ALL SELECT 'tag', t, count(*) FROM (SELECT unnest(tags) AS t FROM feats) GROUP BY 2
UNION ALL SELECT 'cluster', CAST(label AS VARCHAR), count(*) FROM labels WHERE label <> -1 GROUP BY 2
""")
def library_analysis(spark, sf):
    labels = clustering.density_clusters(scaled(spark, sf), "pattern_id", COLUMNS, 1.0)
    return library.library_counts(lib_table(spark, sf), labels)


@query("stable_ids_and_checksums", "F2", f"""
WITH {SNAPSHOTS}, j AS (SELECT *, '{{"price":' || CAST(price AS VARCHAR) || ',"priority":"' || priority || '"}}' AS data FROM snaps)
SELECT snapshot_id, sha256(state_type || ':' || data || ':' || {siso('ts')}) AS entry_id, sha256(data) AS checksum,
  md5(CAST(snapshot_id AS VARCHAR)) AS validation_id, CAST(('0x' || substr(md5(priority), 1, 7)) AS BIGINT) % 1000 AS bucket FROM j
""")
def stable_ids_and_checksums(spark, sf):
    s = inputs.snapshots(spark, sf)
    data = F.to_json(F.struct("price", "priority"))  # keys in sorted order
    return s.select(
        "snapshot_id", stable_id(F.col("state_type"), data, iso("ts")).alias("entry_id"), F.sha2(data, 256).alias("checksum"),
        F.md5(F.col("snapshot_id").cast("string")).alias("validation_id"), text_bucket("priority").alias("bucket"),
    )
