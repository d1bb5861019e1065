"""Queries of the quality checks over the spectra table (with duplicates, spikes and gaps made in the query where a check needs them)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import layout
from ..functions.spectral import r6
from ..operators import quality as Q
from ..registry import query
from .sqlkit import solved

#: Cells with gaps: every 37th cell (counted along a sample by a fixed rule) is missing.
GAPS = "gaps AS (SELECT sample_idx, label, role, band, CASE WHEN (sample_idx * 7 + band * 5) % 37 = 0 THEN NULL ELSE v END AS v FROM cells)"


def _gaps(spark, sf):
    long = layout.to_long(layout.spectra(spark, sf), "sample_idx", "label", "role")
    return long.withColumn("v", F.when((F.col("sample_idx") * 7 + F.col("band") * 5) % 37 == 0, None).otherwise(F.col("v")))


def _long(spark, sf):
    return layout.to_long(layout.spectra(spark, sf), "sample_idx", "label", "role")


@query("qc_contract", "SELECT count(*) = 500 AS samples_ok, bool_and(len(embedding) = 64) AS bands_ok, count(vec_id) = count(*) AS ids_present, count(DISTINCT vec_id) = count(vec_id) AS ids_unique, count(label) = count(*) AS labels_ok FROM embeddings")
def contract(spark, sf):
    return Q.contract_check(layout.spectra(spark, sf), 500, 64, supervised=True)


@query("qc_missing", f"WITH $LONG, {GAPS} SELECT sample_idx, band, count(*) FILTER (v IS NULL) AS n_missing, count(*) AS n, R(count(*) FILTER (v IS NULL) / count(*)::DOUBLE) AS rate FROM gaps GROUP BY GROUPING SETS ((sample_idx), (band), ())")
def missing(spark, sf):
    return Q.missing(_gaps(spark, sf)).withColumn("rate", r6(F.col("rate")))


@query("qc_max_abs", "WITH $LONG SELECT R(max(abs(v))) AS max_abs, max(abs(v)) > 1e12 AS warn FROM cells")
def max_abs(spark, sf):
    return Q.numeric_quality(_long(spark, sf))[2].withColumn("max_abs", r6(F.col("max_abs")))


@query("qc_zero_bands", "WITH $LONG, z AS (SELECT band, CASE WHEN band % 16 = 3 THEN 0 ELSE v END AS v FROM cells) SELECT band FROM z GROUP BY band HAVING bool_and(coalesce(v, 0) = 0)")
def zero_bands(spark, sf):
    return Q.numeric_quality(_long(spark, sf).withColumn("v", F.when(F.col("band") % 16 == 3, 0.0).otherwise(F.col("v"))))[1]


@query("qc_axis", "WITH a AS (SELECT unnest(range(64)) AS i), b AS (SELECT i, CASE WHEN i >= 40 THEN 2000 ELSE 900 END + 10 * i AS value FROM a), s AS (SELECT *, value - lag(value) OVER (ORDER BY i) AS step FROM b), g AS (SELECT median(abs(step)) AS g FROM s) SELECT bool_and(step > 0) OR bool_and(step < 0) AS monotonic, count(value) - count(DISTINCT value) AS repeated, count(*) FILTER (abs(step) > 10 * g) AS large_gaps, count(*) FILTER (value IS NULL) AS not_numeric FROM s, g")
def axis(spark, sf):
    a = spark.range(64).select(F.col("id").cast("int").alias("band_idx"), (F.when(F.col("id") >= 40, 2000.0).otherwise(900.0) + 10 * F.col("id")).alias("value"))
    return Q.axis_check(a)


@query("qc_constant_bands", "WITH $LONG, c AS (SELECT band, CASE WHEN band IN (5, 9) THEN 5 ELSE v END AS v FROM cells) SELECT band FROM c GROUP BY band HAVING count(DISTINCT v) <= 1 AND count(v) > 0")
def constant_bands(spark, sf):
    return Q.constant_bands(_long(spark, sf).withColumn("v", F.when(F.col("band").isin(5, 9), 5.0).otherwise(F.col("v"))))


@query("qc_low_variance_bands", "WITH $LONG, c AS (SELECT band, v * CASE WHEN band % 10 = 4 THEN 1e-7 ELSE 1 END AS v FROM cells) SELECT band FROM c GROUP BY band HAVING count(v) >= 2 AND var_samp(v) <= 1e-12")
def low_variance(spark, sf):
    return Q.low_variance_bands(_long(spark, sf).withColumn("v", F.col("v") * F.when(F.col("band") % 10 == 4, 1e-7).otherwise(1.0))).select("band")


@query("qc_class_distribution", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def class_distribution(spark, sf):
    return Q.class_distribution(layout.spectra(spark, sf))


@query("qc_class_balance", "WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT count(*) AS classes, min(n) AS least, max(n) AS most, R(max(n) / min(n)::DOUBLE) AS ratio, 0::BIGINT AS unlabelled, CASE WHEN min(n) < 3 THEN 'blocked' WHEN max(n) / min(n)::DOUBLE > 10 THEN 'severe' WHEN min(n) < 5 OR max(n) / min(n)::DOUBLE > 5 THEN 'warning' ELSE 'passed' END AS status FROM c")
def class_balance(spark, sf):
    return Q.class_balance(layout.spectra(spark, sf)).withColumn("ratio", r6(F.col("ratio")))


@query("qc_target_outliers", "WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders) SELECT o_orderkey AS sample_idx, R(o_totalprice) AS y FROM orders, q WHERE o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1)")
def target_outliers(spark, sf):
    df = layout.table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_idx"), F.col("o_totalprice").alias("y"))
    return Q.target_check(df).withColumn("y", r6(F.col("y")))


_STATS = "d AS (SELECT *, v - lag(v) OVER (PARTITION BY sample_idx ORDER BY band) AS d1 FROM cells), e AS (SELECT *, d1 - lag(d1) OVER (PARTITION BY sample_idx ORDER BY band) AS d2 FROM d), st AS (SELECT sample_idx, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max, max(v) - min(v) AS range, sum(v) AS area, sqrt(sum(v * v)) AS l2, stddev_samp(d1) AS d1_std, stddev_samp(d2) AS d2_std, max(abs(d1)) AS max_jump, avg(abs(d2)) AS roughness FROM e GROUP BY sample_idx)"


@query("qc_sample_statistics", f"WITH $LONG, {_STATS} SELECT sample_idx, " + ", ".join(f"R({c}) AS {c}" for c in Q.STATISTICS) + " FROM st")
def sample_statistics(spark, sf):
    return Q.sample_statistics(layout.spectra(spark, sf)).select("sample_idx", *(r6(F.col(c)).alias(c) for c in Q.STATISTICS))


@query("qc_robust_z", f"WITH $LONG, {_STATS}, l AS (UNPIVOT (SELECT sample_idx, mean, std, max, area, roughness FROM st) ON mean, std, max, area, roughness INTO NAME metric VALUE value), m AS (SELECT metric, median(value) AS med FROM l GROUP BY metric), a AS (SELECT metric, median(abs(value - med)) AS mad FROM l JOIN m USING (metric) GROUP BY metric) SELECT sample_idx, metric, R((value - med) / (1.4826 * mad)) AS z FROM l JOIN m USING (metric) JOIN a USING (metric)")
def robust_z(spark, sf):
    z = Q.robust_z(Q.sample_statistics(layout.spectra(spark, sf)), ("mean", "std", "max", "area", "roughness"))
    return z.select("sample_idx", "metric", r6(F.col("z")).alias("z"))


@query("qc_spikes", "WITH $LONG, s AS (SELECT sample_idx, band, v + CASE WHEN band = sample_idx % 64 AND sample_idx % 5 = 0 THEN 3 ELSE 0 END AS v FROM cells), w AS (SELECT a.sample_idx, a.band, a.v, b.v AS u FROM s a JOIN s b ON a.sample_idx = b.sample_idx AND b.band BETWEEN a.band - 2 AND a.band + 2), m AS (SELECT sample_idx, band, v, median(u) AS med FROM w GROUP BY ALL), d AS (SELECT w.sample_idx, w.band, any_value(w.v) AS v, any_value(med) AS med, median(abs(u - med)) AS mad FROM w JOIN m ON w.sample_idx = m.sample_idx AND w.band = m.band GROUP BY w.sample_idx, w.band), c AS (SELECT sample_idx, band, CASE WHEN mad < 1e-8 THEN CASE WHEN abs(v - med) < 1e-8 THEN 0 ELSE 999 END ELSE least(abs(v - med) / (1.4826 * mad), 999) END AS score FROM d) SELECT sample_idx, band, R(score) AS score FROM c WHERE score > 6")
def spikes(spark, sf):
    df = layout.spectra(spark, sf)
    df = df.withColumn("x", F.transform("x", lambda v, i: v + F.when((i == F.col("sample_idx") % 64) & (F.col("sample_idx") % 5 == 0), 3.0).otherwise(0.0)))
    return Q.spikes(df).withColumn("score", r6(F.col("score")))


@query("qc_drift", f"WITH $LONG, mb AS (SELECT band, avg(v) AS m FROM cells GROUP BY band), {_STATS}, o AS (SELECT sample_idx, avg(v - m) AS mean_off, (max(v) FILTER (band = 63) - max(v) FILTER (band = 0)) / 63 AS slope FROM cells JOIN mb USING (band) GROUP BY sample_idx), t AS (SELECT sample_idx, slope, roughness AS curvature, mean_off AS offs FROM o JOIN st USING (sample_idx)), l AS (UNPIVOT t ON slope, curvature, offs INTO NAME metric VALUE value), m AS (SELECT metric, median(value) AS med FROM l GROUP BY metric), a AS (SELECT metric, median(abs(value - med)) AS mad FROM l JOIN m USING (metric) GROUP BY metric) SELECT sample_idx, R(max(abs((value - med) / (1.4826 * mad)))) AS max_z, max(abs((value - med) / (1.4826 * mad))) > 3.5 AS flag FROM l JOIN m USING (metric) JOIN a USING (metric) GROUP BY sample_idx")
def drift(spark, sf):
    return Q.drift(layout.spectra(spark, sf)).withColumn("max_z", r6(F.col("max_z")))


@query("qc_similarity", "WITH $LONG, g AS (SELECT band, avg(v) AS m FROM cells GROUP BY band), cm AS (SELECT label AS other, band, avg(v) AS m FROM cells GROUP BY ALL), a AS (SELECT sample_idx, label, corr(v, m) AS pearson, sum(v * m) / sqrt(sum(v * v) * sum(m * m)) AS cosine FROM cells JOIN g USING (band) GROUP BY ALL), b AS (SELECT sample_idx, label, other, corr(v, m) AS r FROM cells JOIN cm USING (band) GROUP BY ALL), c AS (SELECT sample_idx, max(r) FILTER (label = other) AS own, max(r) FILTER (label <> other) AS best_other FROM b GROUP BY ALL) SELECT sample_idx, label, R(pearson) AS pearson, R(cosine) AS cosine, R(own) AS own, R(best_other) AS best_other, pearson < 0.95 OR cosine < 0.98 AS low_similarity, own < 0.95 AS low_own_class, best_other - own > 0.05 AS mislabel FROM a JOIN c USING (sample_idx)")
def similarity(spark, sf):
    return Q.similarity(layout.spectra(spark, sf)).select("sample_idx", "label", *(r6(F.col(c)).alias(c) for c in ("pearson", "cosine", "own", "best_other")), "low_similarity", "low_own_class", "mislabel")


def _with_copies(spark, sf):
    """The spectra, exact copies of every 50th (id + 100000) and scaled, slightly changed ones of every 60th (id + 200000)."""
    df = layout.spectra(spark, sf)
    exact = df.where("sample_idx % 50 = 0").withColumn("sample_idx", F.col("sample_idx") + 100000)
    near = df.where("sample_idx % 60 = 7").withColumn("sample_idx", F.col("sample_idx") + 200000).withColumn("x", F.transform("x", lambda v, i: v * 1.0001 + F.when(i == 3, 1e-5).otherwise(0.0)))
    return df.unionByName(exact).unionByName(near)


_COPIES = "x AS (SELECT vec_id AS sample_idx, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings UNION ALL SELECT vec_id + 100000, list_transform(embedding, lambda v: v::DOUBLE) FROM embeddings WHERE vec_id % 50 = 0 UNION ALL SELECT vec_id + 200000, list_transform(embedding, lambda v, i: v::DOUBLE * 1.0001e0 + CASE WHEN i = 4 THEN 1e-5 ELSE 0e0 END) FROM embeddings WHERE vec_id % 60 = 7)"


@query("qc_exact_duplicates", f"WITH {_COPIES}, g AS (SELECT e, min(sample_idx) AS keep FROM x GROUP BY e HAVING count(*) > 1) SELECT sample_idx, keep FROM x JOIN g USING (e)")
def exact_duplicates(spark, sf):
    return Q.exact_duplicates(_with_copies(spark, sf)).select("sample_idx", "keep")


@query("qc_near_duplicates", f"WITH {_COPIES}, d AS (SELECT e, min(sample_idx) AS i FROM x GROUP BY e), u AS (SELECT i, unnest(range(64)) AS band, unnest(e) AS v FROM d), n AS (SELECT a.i AS a, b.i AS b, corr(a.v, b.v) AS c FROM u a JOIN u b ON a.band = b.band AND a.i < b.i GROUP BY ALL) SELECT a, b, R(c) AS corr FROM n WHERE c > 0.999")
def near_duplicates(spark, sf):
    return Q.near_duplicates(_with_copies(spark, sf)).select("a", "b", r6(F.col("corr")).alias("corr"))


@query("qc_drop_duplicates", f"WITH {_COPIES} SELECT min(sample_idx) AS sample_idx FROM x GROUP BY e")
def drop_duplicates(spark, sf):
    return Q.drop_duplicates(_with_copies(spark, sf)).select("sample_idx")


@query("qc_duplicate_groups", "WITH RECURSIVE e AS MATERIALIZED (SELECT o_orderkey AS a, o_custkey AS b FROM orders WHERE o_orderkey <> o_custkey UNION SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey <> o_custkey), c(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM e UNION (SELECT e.b, min(c.component) FROM c JOIN e ON e.a = c.node JOIN recurring.c AS old ON old.node = e.b WHERE c.component < old.component GROUP BY e.b)) SELECT node, component FROM c")
def duplicate_groups(spark, sf):
    pairs = layout.table(spark, sf, "orders").where("o_orderkey <> o_custkey").select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b"))
    return Q.duplicate_groups(pairs)


@query("qc_pca_distances")
def pca_distances(spark, sf):
    return Q.pca_distances(layout.spectra(spark, sf))


@query("qc_mahalanobis", f"""WITH RECURSIVE $LONG, mu AS (SELECT band, avg(v) AS m FROM cells GROUP BY band), z AS MATERIALIZED (SELECT sample_idx, band, v - m AS v FROM cells JOIN mu USING (band)),
    a AS MATERIALIZED (SELECT 0 AS c, a.band::BIGINT AS i, b.band::BIGINT AS j, sum(a.v * b.v) / (count(*) - 1) + any_value(CASE WHEN a.band = b.band THEN 1e-9 ELSE 0e0 END) AS v FROM z a JOIN z b USING (sample_idx) GROUP BY ALL UNION ALL SELECT 0, band, 64 + sample_idx, v FROM z), {solved("a", 64)},
    d AS (SELECT sample_idx, sqrt(sum(g.v * z.v)) AS d FROM g JOIN z ON z.band = i AND z.sample_idx = j - 64 WHERE k = 64 AND j >= 64 GROUP BY sample_idx) SELECT sample_idx, R(d) AS distance, d > (SELECT quantile_cont(d, 0.975) FROM d) AS flag FROM d""")
def mahalanobis(spark, sf):
    return Q.mahalanobis(layout.spectra(spark, sf)).withColumn("distance", r6(F.col("distance")))


@query("qc_resampled_outliers")
def resampled(spark, sf):
    return Q.resampled_outliers(layout.spectra(spark, sf))


@query("qc_intensity_mad", "WITH m AS (SELECT vec_id AS sample_idx, list_sum(list_transform(embedding, lambda v: v::DOUBLE)) / 64 AS v FROM embeddings), a AS (SELECT median(v) AS med FROM m), b AS (SELECT median(abs(v - med)) AS mad FROM m, a) SELECT sample_idx, R((v - med) / (1.4826 * mad)) AS score, abs((v - med) / (1.4826 * mad)) > 3.5 AS flag FROM m, a, b")
def intensity_mad(spark, sf):
    return Q.intensity_outliers(layout.spectra(spark, sf), "MAD").withColumn("score", r6(F.col("score")))


@query("qc_intensity_iqr", "WITH m AS (SELECT vec_id AS sample_idx, list_sum(list_transform(embedding, lambda v: v::DOUBLE)) / 64 AS v FROM embeddings), q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM m) SELECT sample_idx, R(v) AS score, v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a) AS flag FROM m, q")
def intensity_iqr(spark, sf):
    return Q.intensity_outliers(layout.spectra(spark, sf), "IQR").withColumn("score", r6(F.col("score")))


@query("qc_consensus", "WITH r AS (SELECT doc_id AS sample_idx, 'pca_q' AS reason FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 'low_similarity' FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'robust_z' FROM labels WHERE doc_id % 11 = 0) SELECT sample_idx, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons, CASE WHEN count(DISTINCT reason) >= 2 AND bool_or(starts_with(reason, 'pca')) THEN 'high' ELSE 'medium' END AS risk_level FROM r GROUP BY sample_idx")
def consensus(spark, sf):
    t = layout.table(spark, sf, "labels")
    one = lambda where, reason: t.where(where).select(F.col("doc_id").alias("sample_idx"), F.lit(reason).alias("reason"))
    return Q.consensus(one("quality = 0", "pca_q").union(one("toxic = 1", "low_similarity")).union(one("doc_id % 11 = 0", "robust_z")))


def _impute(name, f, sql):
    query(f"qc_impute_{name}", sql)(lambda spark, sf: f(_gaps(spark, sf)).select("sample_idx", "band", r6(F.col("v")).alias("v")))


for _how, _agg in (("mean", "avg(v)"), ("median", "quantile_cont(v, 0.5)"), ("zero", "0e0")):
    _impute(_how, lambda long, how=_how: Q.impute_bands(long, how), f"WITH $LONG, {GAPS}, f AS (SELECT band, {_agg} AS fill FROM gaps GROUP BY band) SELECT sample_idx, band, R(coalesce(v, fill, 0)) AS v FROM gaps JOIN f USING (band)")
_SIDES = f"WITH $LONG, {GAPS}, k AS (SELECT * FROM gaps WHERE v IS NOT NULL), l AS (SELECT g.sample_idx, g.band, g.v, l.band AS lb, l.v AS lv, r.band AS rb, r.v AS rv FROM gaps g ASOF LEFT JOIN k l ON g.sample_idx = l.sample_idx AND g.band >= l.band ASOF LEFT JOIN k r ON g.sample_idx = r.sample_idx AND g.band <= r.band)"
_impute("linear", lambda long: Q.impute_along(long, "linear"), _SIDES + " SELECT sample_idx, band, R(CASE WHEN v IS NOT NULL THEN v WHEN lb IS NULL THEN rv WHEN rb IS NULL THEN lv ELSE lv + (rv - lv) * (band - lb) / (rb - lb) END) AS v FROM l")
_impute("nearest", lambda long: Q.impute_along(long, "nearest"), _SIDES + " SELECT sample_idx, band, R(CASE WHEN v IS NOT NULL THEN v WHEN lb IS NULL THEN rv WHEN rb IS NULL THEN lv WHEN band - lb <= rb - band THEN lv ELSE rv END) AS v FROM l")


@query("qc_clean", f"WITH $LONG, {GAPS}, f AS (SELECT band, avg(v) AS fill FROM gaps GROUP BY band) SELECT sample_idx, band, R(coalesce(v, fill)) AS v FROM gaps JOIN f USING (band) WHERE sample_idx % 17 <> 0 AND band NOT IN (0, 63)")
def clean(spark, sf):
    long = _gaps(spark, sf)
    out = Q.clean(long, impute="mean", drop_samples=long.where("sample_idx % 17 = 0").select("sample_idx").distinct(), drop_bands=[0, 63], confirmed=True)
    return out.select("sample_idx", "band", r6(F.col("v")).alias("v"))


@query("qc_remove_bands", "WITH $LONG, s AS (SELECT *, row_number() OVER (PARTITION BY sample_idx ORDER BY band) - 1 AS pos FROM cells WHERE band NOT IN (2, 40)) SELECT sample_idx, pos::INT AS band, R(v) AS v FROM s WHERE sample_idx % 10 <> 3")
def remove_bands(spark, sf):
    df = layout.spectra(spark, sf)
    kept = Q.remove_samples(df, df.where("sample_idx % 10 = 3").select("sample_idx"))
    return layout.to_long(Q.remove_bands(kept, [2, 40]), "sample_idx").select("sample_idx", "band", r6(F.col("v")).alias("v"))


@query("qc_profile", "SELECT count(*) AS n, max(len(embedding))::INT AS p, 0::BIGINT AS n_missing, count(DISTINCT label) AS classes, R(max(len(embedding)) / count(*)::DOUBLE) AS p_over_n, count(*) < 20 OR max(len(embedding)) / count(*)::DOUBLE > 10 AS small_sample FROM embeddings")
def profile(spark, sf):
    return Q.profile(layout.spectra(spark, sf)).withColumn("p_over_n", r6(F.col("p_over_n")))
