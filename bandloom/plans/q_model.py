"""Queries of features, models and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import layout
from ..functions.shared import scratch
from ..functions.spectral import r6
from ..operators import evaluate as V
from ..operators import feature as X
from ..operators import metrics as E
from ..operators import model as M
from ..operators import split as D
from ..registry import query
from ..sources import bundle as B
from ..sources import package
from .sqlkit import solved


def _train(df):
    return df.where("role = 'train'")


def _with_y(spark, sf):
    df = layout.spectra(spark, sf)
    return df.withColumn("y", 2 * F.col("x")[0] - F.col("x")[4] + 0.5 * F.col("x")[9] + F.col("sample_idx") % 7 / 50.0)


_Y = "yy AS (SELECT vec_id AS sample_idx, 2 * embedding[1]::DOUBLE - embedding[5]::DOUBLE + 0.5e0 * embedding[10]::DOUBLE + (vec_id % 7) / 50e0 AS y FROM embeddings)"


@query("feature_variance", "WITH $LONG SELECT band, R(var_pop(v)) AS score FROM cells WHERE role = 'train' GROUP BY band HAVING var_pop(v) > 0.0156")
def variance(spark, sf):
    return X.over(X.variance_scores(_train(layout.spectra(spark, sf))), 0.0156, strict=True).withColumn("score", r6(F.col("score")))


@query("feature_correlation", f"WITH $LONG, {_Y} SELECT band, R(abs(corr(v, y))) AS score FROM cells JOIN yy USING (sample_idx) WHERE role = 'train' GROUP BY band")
def correlation(spark, sf):
    return X.correlation_scores(_train(_with_y(spark, sf))).withColumn("score", r6(F.col("score")))


@query("feature_spearman", f"WITH $LONG, {_Y}, r AS (SELECT band, row_number() OVER (PARTITION BY band ORDER BY v, sample_idx)::DOUBLE AS a, row_number() OVER (PARTITION BY band ORDER BY y, sample_idx)::DOUBLE AS b FROM cells JOIN yy USING (sample_idx) WHERE role = 'train') SELECT band, R(abs(corr(a, b))) AS score FROM r GROUP BY band")
def spearman(spark, sf):
    return X.correlation_scores(_train(_with_y(spark, sf)), ordinal=True).withColumn("score", r6(F.col("score")))


_ANOVA = "a AS (SELECT band, label, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS w FROM cells WHERE role = 'train' GROUP BY ALL), g AS (SELECT band, avg(v) AS g FROM cells WHERE role = 'train' GROUP BY band), f AS (SELECT band, (sum(n * (m - g) ** 2) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))) AS score FROM a JOIN g USING (band) GROUP BY band)"


@query("feature_anova", f"WITH $LONG, {_ANOVA} SELECT band, R(score) AS score FROM f")
def anova(spark, sf):
    return X.anova_scores(_train(layout.spectra(spark, sf))).withColumn("score", r6(F.col("score")))


@query("feature_select_k_best", f"WITH $LONG, {_ANOVA}, r AS (SELECT band, row_number() OVER (ORDER BY score DESC, band) AS rank FROM f) SELECT band, 900e0 + 10 * band AS value, rank::INT AS rank, rank <= 10 AS selected FROM r")
def select_k_best(spark, sf):
    scores = X.anova_scores(_train(layout.spectra(spark, sf)))
    axis = spark.range(64).select(F.col("id").cast("int").alias("band_idx"), (900.0 + 10 * F.col("id")).alias("value"))
    return X.score_table(scores, X.top_k(scores, 10), axis).select("band", "value", "rank", "selected")


@query("feature_f_regression", f"WITH $LONG, {_Y}, r AS (SELECT band, corr(v, y) AS r, count(*) AS n FROM cells JOIN yy USING (sample_idx) WHERE role = 'train' GROUP BY band) SELECT band, R(r * r / (1 - r * r) * (n - 2)) AS score FROM r")
def f_regression(spark, sf):
    return X.f_regression_scores(_train(_with_y(spark, sf))).withColumn("score", r6(F.col("score")))


def _cells(df):
    return layout.to_long(df, "sample_idx").select("sample_idx", "band", r6(F.col("v")).alias("v"))


@query("feature_dct", "WITH $LONG SELECT sample_idx, k::INT AS band, R(sum(v * cos(pi() * k * (2 * band + 1) / 128)) * sqrt(2e0 / 64) * any_value(CASE WHEN k = 0 THEN sqrt(0.5e0) ELSE 1e0 END)) AS v FROM cells, (SELECT unnest(range(10)) AS k) GROUP BY sample_idx, k")
def dct(spark, sf):
    return _cells(layout.spectra(spark, sf).withColumn("x", X.dct_features(F.col("x"), 64)))


@query("feature_fft", "WITH $LONG SELECT sample_idx, k::INT AS band, R(sqrt(sum(v * cos(2 * pi() * k * band / 64)) ** 2 + sum(v * sin(2 * pi() * k * band / 64)) ** 2)) AS v FROM cells, (SELECT unnest(range(10)) AS k) GROUP BY ALL")
def fft(spark, sf):
    return _cells(layout.spectra(spark, sf).withColumn("x", X.fft_features(F.col("x"), 64)))


def _projection(name, f):
    query(f"feature_{name}")(lambda spark, sf: _cells(f(spark, sf)))


def _scores(projection, df):
    """Long scores of the training rows by a projection that was fitted on them."""
    return layout.to_long(_train(projection.transform(df)), "sample_idx", "label")


def _covariances(long, *keys):
    """(keys, i, j, v): population covariances of the scores for i <= j."""
    a, b = (long.select("sample_idx", *keys, F.col("band").alias(c), F.col("v").alias(f"v_{c}")) for c in "ij")
    both = a.join(b, ["sample_idx", *keys]).where("i <= j")
    return both.groupBy(*keys, "i", "j").agg((F.avg(F.col("v_i") * F.col("v_j")) - F.avg("v_i") * F.avg("v_j")).alias("v"), F.count(F.lit(1)).alias("n"))


@query("feature_pca", "WITH $LONG, m AS (SELECT band, avg(v) AS m FROM cells WHERE role = 'train' GROUP BY band) SELECT 'norm' AS what, sample_idx AS i, 0::BIGINT AS j, R(sum((v - m) ** 2)) AS v FROM cells JOIN m USING (band) GROUP BY ALL UNION ALL SELECT 'covariance', a.i, b.i, 0e0 FROM (SELECT unnest(range(64)) AS i) a JOIN (SELECT unnest(range(64)) AS i) b ON a.i < b.i")
def feature_pca(spark, sf):
    """All components of the whole table: lengths stay as they are (the components are orthonormal), and training scores are uncorrelated."""
    df = layout.spectra(spark, sf)
    fitted = X.pca(_train(df), 64)
    norms = layout.to_long(fitted.transform(df), "sample_idx").groupBy("sample_idx").agg(F.sum(F.col("v") * F.col("v")).alias("v")).select(F.lit("norm").alias("what"), F.col("sample_idx").alias("i"), F.lit(0).cast("long").alias("j"), r6(F.col("v")).alias("v"))
    apart = _covariances(_scores(fitted, df)).where("i < j").select(F.lit("covariance").alias("what"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), r6(F.col("v")).alias("v"))
    return norms.unionByName(apart)


def _apart(k, same="0e0"):
    """DuckDB: covariances of k uncorrelated scores."""
    return f"SELECT a.i::INT AS i, b.i::INT AS j, CASE WHEN a.i = b.i THEN {same} ELSE 0e0 END AS v FROM (SELECT unnest(range({k})) AS i) a JOIN (SELECT unnest(range({k})) AS i) b ON a.i <= b.i"


@query("feature_lda", _apart(9, "1e0"))
def feature_lda(spark, sf):
    """Scores are uncorrelated with unit variance within the classes, pooled over them."""
    df = layout.spectra(spark, sf)
    within = _covariances(_scores(X.lda_projection(_train(df)), df), "label").groupBy("i", "j").agg((F.sum(F.col("v") * F.col("n")) / (F.sum("n") - F.count(F.lit(1)))).alias("v"))
    return within.select("i", "j", r6(F.col("v")).alias("v"))


@query("feature_pls", _apart(10) + " AND a.i < b.i")
def feature_pls(spark, sf):
    """The latent scores of the training rows are uncorrelated."""
    df = layout.spectra(spark, sf)
    return _covariances(_scores(X.pls_latent(_train(df)), df)).where("i < j").select("i", "j", r6(F.col("v")).alias("v"))


@query("feature_kernel_pca", _apart(10) + " AND a.i < b.i")
def feature_kernel_pca(spark, sf):
    df = layout.spectra(spark, sf)
    return _covariances(_scores(X.kernel_pca(_train(df)), df)).where("i < j").select("i", "j", r6(F.col("v")).alias("v"))


@query("feature_ica", _apart(10, "1e0"))
def feature_ica(spark, sf):
    """Sources of the training rows are uncorrelated with unit variance."""
    df = layout.spectra(spark, sf)
    return _covariances(_scores(X.ica(_train(df)), df)).select("i", "j", r6(F.col("v")).alias("v"))


_projection("sparse_pca", lambda spark, sf: X.sparse_pca(_train(df := layout.spectra(spark, sf))).transform(df))
_projection("nmf", lambda spark, sf: X.nmf(_train(df := layout.spectra(spark, sf).withColumn("x", F.transform("x", lambda v: v + 1)))).transform(df))
_projection("dictionary", lambda spark, sf: X.dictionary_learning(_train(df := layout.spectra(spark, sf))).transform(df))
_projection("isomap", lambda spark, sf: X.isomap(_train(df := layout.spectra(spark, sf))).transform(df))
_projection("lle", lambda spark, sf: X.lle(_train(df := layout.spectra(spark, sf))).transform(df))


def _bands(spark, values, name="score"):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], f"band int, {name} double")


@query("feature_vip")
def vip(spark, sf):
    return X.over(_bands(spark, X.vip(_train(_with_y(spark, sf)), 5, "y")), 1.0)


@query("feature_interval_pls")
def interval_pls(spark, sf):
    return X.interval_pls(_train(_with_y(spark, sf)), y="y")


@query("feature_spa", """WITH RECURSIVE $LONG, m AS (SELECT band, avg(v) AS m, stddev_pop(v) AS s FROM cells WHERE role = 'train' GROUP BY band), z AS MATERIALIZED (SELECT sample_idx, band, (v - m) / s AS v FROM cells JOIN m USING (band) WHERE role = 'train'),
    r AS (SELECT 1 AS k, a.band::BIGINT AS i, b.band::BIGINT AS j, sum(a.v * b.v) AS v, 0::BIGINT AS pick FROM z a JOIN z b USING (sample_idx) GROUP BY ALL UNION ALL SELECT k + 1, i, j, v, arg_max(i, CASE WHEN i = j THEN v ELSE -1e0 END) OVER () FROM (SELECT k, i, j,
        v - max(v) FILTER (WHERE j = pick) OVER (PARTITION BY i) * max(v) FILTER (WHERE i = pick) OVER (PARTITION BY j) / max(v) FILTER (WHERE i = pick AND j = pick) OVER () AS v FROM r WHERE k < 5)) SELECT DISTINCT pick::INT AS band FROM r""")
def spa(spark, sf):
    return spark.createDataFrame([(b,) for b in X.spa(_train(layout.spectra(spark, sf)))], "band int")


@query("feature_cars")
def cars(spark, sf):
    return spark.createDataFrame([(b,) for b in X.cars(_train(_with_y(spark, sf)), y="y")[0]], "band int")


@query("feature_uve")
def uve(spark, sf):
    return X.uve(_train(_with_y(spark, sf)), y="y").where("selected").select("band", "score")


@query("feature_mcuve")
def mcuve(spark, sf):
    return X.uve(_train(_with_y(spark, sf)), y="y", monte_carlo=True).where("selected").select("band", "score")


# Models.

_NEAR = "d AS (SELECT a.sample_idx, b.sample_idx AS other, any_value(b.label) AS label, sum((a.v - b.v) ** 2) AS d FROM cells a JOIN cells b ON a.band = b.band WHERE a.role = 'test' AND b.role = 'train' GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY sample_idx ORDER BY d, other) AS r FROM d)"


@query("model_knn", f"WITH $LONG, {_NEAR}, v AS (SELECT sample_idx, label, count(*) AS c FROM n WHERE r <= 5 GROUP BY ALL) SELECT sample_idx, arg_max(label, c * 1000 - label)::VARCHAR AS y_pred FROM v GROUP BY sample_idx")
def model_knn(spark, sf):
    df = layout.spectra(spark, sf)
    return M.knn(_train(df), df.where("role = 'test'")).select("sample_idx", "y_pred")


@query("model_knn_regression", f"WITH $LONG, {_Y}, {_NEAR} SELECT n.sample_idx, R(avg(y)) AS y_pred FROM n JOIN yy ON yy.sample_idx = n.other WHERE r <= 3 GROUP BY ALL")
def model_knn_regression(spark, sf):
    df = _with_y(spark, sf)
    return M.knn(_train(df), df.where("role = 'test'"), 3, y="y").select("sample_idx", r6(F.col("y_pred")).alias("y_pred"))


@query("model_gaussian_nb", "WITH $LONG, e AS (SELECT 1e-9 * max(s) AS e FROM (SELECT var_pop(v) AS s FROM cells WHERE role = 'train' GROUP BY band)), m AS (SELECT label AS c, band, avg(v) AS m, var_pop(v) + any_value(e) AS s, count(*) AS n FROM cells, e WHERE role = 'train' GROUP BY ALL), l AS (SELECT sample_idx, c, ln(any_value(n)) - 0.5 * sum((v - m) ** 2 / s + ln(2 * pi() * s)) AS l FROM cells JOIN m USING (band) WHERE role = 'test' GROUP BY ALL) SELECT sample_idx, arg_max(c, l)::VARCHAR AS y_pred FROM l GROUP BY sample_idx")
def model_nb(spark, sf):
    df = layout.spectra(spark, sf)
    return M.gaussian_nb(_train(df)).predict(df.where("role = 'test'")).select("sample_idx", "y_pred")


@query("model_prototypes", "WITH $LONG, m AS (SELECT label AS c, band, avg(v) AS m FROM cells WHERE role = 'train' GROUP BY ALL), d AS (SELECT sample_idx, c, sum((v - m) ** 2) AS d FROM cells JOIN m USING (band) WHERE role = 'test' GROUP BY ALL) SELECT sample_idx, arg_min(c, d) AS y_pred FROM d GROUP BY sample_idx")
def model_prototypes(spark, sf):
    df = layout.spectra(spark, sf)
    return M.prototype_votes(_train(df), df.where("role = 'test'"))


def _classify(name, sql=None, **p):
    def run(spark, sf):
        df = layout.spectra(spark, sf)
        return M.fit_model(_train(df), name, **p).predict(df.where("role = 'test'")).select("sample_idx", "y_pred")

    query(f"model_{name}", sql)(run)


_CLASSES = "t AS (SELECT * FROM cells WHERE role = 'train'), mu AS MATERIALIZED (SELECT label, band, avg(v) AS m, count(*) AS n FROM t GROUP BY ALL), z AS MATERIALIZED (SELECT sample_idx, label, band, v - m AS v FROM t JOIN mu USING (label, band)), total AS (SELECT count(DISTINCT sample_idx)::DOUBLE AS total FROM t)"
_classify("lda", f"""WITH RECURSIVE $LONG, {_CLASSES}, a AS MATERIALIZED (SELECT 0 AS c, a.band::BIGINT AS i, b.band::BIGINT AS j, sum(a.v * b.v) / any_value(total) AS v FROM z a JOIN z b USING (sample_idx), total GROUP BY ALL
    UNION ALL SELECT 0, band, 64 + label, m FROM mu), {solved("a", 64)}, w AS (SELECT i AS band, (j - 64)::INT AS label, v AS w FROM g WHERE k = 64 AND j >= 64), b AS (SELECT label, ln(any_value(n) / any_value(total)) - 0.5 * sum(m * w) AS b FROM mu JOIN w USING (label, band), total GROUP BY label),
    s AS (SELECT sample_idx, w.label, sum(v * w) + any_value(b) AS s FROM cells JOIN w USING (band) JOIN b ON b.label = w.label WHERE role = 'test' GROUP BY ALL) SELECT sample_idx, arg_max(label, s)::VARCHAR AS y_pred FROM s GROUP BY sample_idx""")
_classify("qda", f"""WITH RECURSIVE $LONG, {_CLASSES}, a AS MATERIALIZED (SELECT a.label AS c, a.band::BIGINT AS i, b.band::BIGINT AS j, 0.5e0 * sum(a.v * b.v) / (count(*) - 1) + any_value(CASE WHEN a.band = b.band THEN 0.5e0 ELSE 0e0 END) AS v FROM z a JOIN z b USING (sample_idx) GROUP BY ALL
    UNION ALL SELECT m.label, m.band, 64 + sample_idx, v - m FROM mu m JOIN cells c USING (band) WHERE role = 'test'), {solved("a", 64)},
    d AS (SELECT c AS label, sum(ln(v)) AS d FROM g WHERE k < 64 AND i = k AND j = k GROUP BY c), x AS (SELECT g.c AS label, j - 64 AS sample_idx, sum(g.v * (e.v - m)) AS q FROM g JOIN mu m ON m.label = c AND m.band = i JOIN cells e ON e.sample_idx = j - 64 AND e.band = i WHERE k = 64 AND j >= 64 GROUP BY ALL),
    p AS (SELECT label, ln(any_value(n) / any_value(total)) AS p FROM mu, total GROUP BY label) SELECT sample_idx, arg_max(label, p - 0.5 * d - 0.5 * q)::VARCHAR AS y_pred FROM x JOIN d USING (label) JOIN p USING (label) GROUP BY sample_idx""", reg_param=0.5)
_classify("proto_spectral_classifier", "WITH $LONG, m AS (SELECT label AS c, band, avg(v) AS m FROM cells WHERE role = 'train' GROUP BY ALL), d AS (SELECT sample_idx, c, sum(v * m) / sqrt(sum(v * v) * sum(m * m)) AS s FROM cells JOIN m USING (band) WHERE role = 'test' GROUP BY ALL) SELECT sample_idx, arg_max(c, s)::VARCHAR AS y_pred FROM d GROUP BY sample_idx", metric="cosine")
for _name, _p in (("pls_da", {}), ("simca", {}), ("svm", {}), ("logistic_regression", {}), ("linear_svm", {}), ("random_forest_classifier", {}), ("extra_trees_classifier", {}), ("mlp_classifier", {})):
    _classify(_name, **_p)


@query("model_gradient_boosting_classifier")
def model_gbt(spark, sf):
    df = layout.spectra(spark, sf)
    return M.fit_model(_train(df), "gradient_boosting_classifier", n_estimators=20).predict(df.where("role = 'test'")).select("sample_idx", "y_pred")


def _regress(name, sql=None, **p):
    def run(spark, sf):
        df = _with_y(spark, sf)
        return M.fit_model(_train(df), name, "y", **p).predict(df.where("role = 'test'")).select("sample_idx", r6(F.col("y_pred")).alias("y_pred"))

    query(f"model_{name}", sql)(run)


_MOMENTS = f"{_Y}, t AS MATERIALIZED (SELECT sample_idx, band, v, y FROM cells JOIN yy USING (sample_idx) WHERE role = 'train'), mu AS MATERIALIZED (SELECT band, avg(v) AS m, stddev_pop(v) AS s, count(*) AS n, avg(y) AS my FROM t GROUP BY band), z AS MATERIALIZED (SELECT sample_idx, band, (v - m) / s AS v, y - my AS y FROM t JOIN mu USING (band))"


def _line_sql(alpha):
    """DuckDB: least squares on standardised bands with a penalty, solved by elimination."""
    return f"""WITH RECURSIVE $LONG, {_MOMENTS}, a AS MATERIALIZED (SELECT 0 AS c, a.band::BIGINT AS i, b.band::BIGINT AS j, sum(a.v * b.v) + any_value(CASE WHEN a.band = b.band THEN {alpha} ELSE 0e0 END) AS v FROM z a JOIN z b USING (sample_idx) GROUP BY ALL
        UNION ALL SELECT 0, band, 64, sum(v * y) FROM z GROUP BY band), {solved("a", 64)}, w AS (SELECT i AS band, v AS w FROM g WHERE k = 64 AND j = 64)
        SELECT sample_idx, R(any_value(my) + sum((v - m) / s * w)) AS y_pred FROM cells JOIN mu USING (band) JOIN w USING (band) WHERE role = 'test' GROUP BY sample_idx"""


_regress("linear_regression", _line_sql("0e0"))
_regress("ridge", _line_sql("1e0"))
_regress("proto_spectral_regressor", f"WITH $LONG, {_Y}, tr AS (SELECT DISTINCT sample_idx, y FROM cells JOIN yy USING (sample_idx) WHERE role = 'train'), e AS (SELECT quantile_cont(y, [0.2e0, 0.4e0, 0.6e0, 0.8e0]) AS e FROM tr), k AS (SELECT sample_idx, y, len(list_filter(e, lambda q: q <= y)) AS c FROM tr, e), m AS (SELECT c, band, avg(v) AS m FROM cells JOIN k USING (sample_idx) GROUP BY ALL), u AS (SELECT c, avg(y) AS u FROM k GROUP BY c), d AS (SELECT sample_idx, c, exp(-sqrt(sum((v - m) ** 2))) AS w FROM cells JOIN m USING (band) WHERE role = 'test' GROUP BY ALL) SELECT sample_idx, R(sum(w * u) / sum(w)) AS y_pred FROM d JOIN u USING (c) GROUP BY sample_idx")


def _penalised(name, alpha, l1):
    """A penalised line is right if each band's gradient meets the optimality conditions; ``off`` is by how much it doesn't."""

    def run(spark, sf):
        df = _train(_with_y(spark, sf))
        fitted = M.fit_model(df, name, "y", alpha=alpha, **({"l1_ratio": l1} if name == "elastic_net" else {}))
        rest = fitted.predict(df).withColumn("r", F.col("y") - F.col("y_pred"))
        sums = layout.to_long(rest, "r").groupBy("band").agg((F.avg(F.col("v") * F.col("r")) - F.avg("v") * F.avg("r")).alias("g"), F.stddev_pop("v").alias("s"))
        w = F.get(F.array(*(F.lit(float(c)) for c in fitted.state["coef"])), F.col("band")) * F.col("s")
        pull = F.col("g") / F.col("s") - alpha * (1 - l1) * w
        off = F.when(w != 0, F.abs(pull - alpha * l1 * F.signum(w))).otherwise(F.greatest(F.abs(pull) - alpha * l1, F.lit(0.0)))
        return sums.select("band", r6(off).alias("off"))

    query(f"model_{name}", "SELECT unnest(range(64))::INT AS band, 0e0 AS off")(run)


_penalised("lasso", 0.01, 1.0)
_penalised("elastic_net", 0.01, 0.5)


def _scored(name, projection):
    """Residuals of the training rows are uncorrelated with the components that the fit regresses on, and mean zero."""

    def run(spark, sf):
        df = _train(_with_y(spark, sf))
        rest = M.fit_model(df, name, "y").predict(df).withColumn("r", F.col("y") - F.col("y_pred"))
        long = layout.to_long(projection(df).transform(rest), "r")
        return long.groupBy(F.col("band").alias("component")).agg(r6(F.avg(F.col("v") * F.col("r"))).alias("with_scores"), r6(F.avg("r")).alias("mean"))

    query(f"model_{name}", "SELECT unnest(range(5))::INT AS component, 0e0 AS with_scores, 0e0 AS mean")(run)


_scored("plsr", lambda df: X.pls_latent(df, 5, "y"))
_scored("pcr", lambda df: X.pca(df, 5))
for _name, _p in (("bayesian_ridge", {}), ("svr", {}), ("gpr", {}), ("random_forest_regressor", {}), ("extra_trees_regressor", {}), ("gradient_boosting_regressor", {})):
    _regress(_name, **_p)


# Metrics, on the labels table: quality as truth and toxic as a prediction.


def _pairs(spark, sf):
    return layout.table(spark, sf, "labels").select(F.col("quality").cast("string").alias("y_true"), F.col("toxic").cast("string").alias("y_pred"))


@query("metric_classification", "WITH p AS (SELECT quality AS t, toxic AS p FROM labels), k AS (SELECT c, count(*) FILTER (t = c) AS s, count(*) FILTER (p = c) AS q, count(*) FILTER (t = c AND p = c) AS k FROM p, (SELECT unnest([0, 1]) AS c) GROUP BY c), m AS (SELECT s, k, CASE WHEN q > 0 THEN k / q::DOUBLE ELSE 0 END AS pr, CASE WHEN s > 0 THEN k / s::DOUBLE ELSE 0 END AS re FROM k), f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f FROM m) SELECT R(sum(k) / sum(s)::DOUBLE) AS accuracy, R(avg(re)) AS balanced_accuracy, R(sum(pr * s) / sum(s)) AS precision, R(sum(re * s) / sum(s)) AS recall, R(sum(f * s) / sum(s)) AS f1, R(avg(pr)) AS macro_precision, R(avg(re)) AS macro_recall, R(avg(f)) AS macro_f1 FROM f")
def metric_classification(spark, sf):
    df = E.classification(_pairs(spark, sf))
    return df.select(*(r6(F.col(c)).alias(c) for c in df.columns))


@query("metric_confusion", "SELECT quality::VARCHAR AS y_true, count(*) FILTER (toxic = 0) AS \"0\", count(*) FILTER (toxic = 1) AS \"1\" FROM labels GROUP BY quality")
def metric_confusion(spark, sf):
    return E.confusion(_pairs(spark, sf), ["0", "1"])


@query("metric_auc", "WITH s AS (SELECT toxic AS y, doc_id % 50 AS score FROM labels), p AS (SELECT avg(CASE WHEN a.score > b.score THEN 1e0 WHEN a.score = b.score THEN 0.5e0 ELSE 0e0 END) AS auc FROM s a, s b WHERE a.y = 1 AND b.y = 0) SELECT R(auc) AS auc FROM p")
def metric_auc(spark, sf):
    df = layout.table(spark, sf, "labels").select(F.col("toxic").alias("y"), (F.col("doc_id") % 50).alias("score"))
    return E.auc(df).select(r6(F.col("auc")).alias("auc"))


@query("metric_roc_points", "WITH s AS (SELECT toxic AS y, doc_id % 50 AS score FROM labels), g AS (SELECT score, count(*) AS n, sum(y) AS p FROM s GROUP BY score), c AS (SELECT score, sum(p) OVER w AS tp, sum(n - p) OVER w AS fp FROM g WINDOW w AS (ORDER BY score DESC)) SELECT score, R(fp / (SELECT count(*) - sum(y) FROM s)::DOUBLE) AS fpr, R(tp / (SELECT sum(y) FROM s)::DOUBLE) AS tpr FROM c")
def metric_roc(spark, sf):
    df = layout.table(spark, sf, "labels").select(F.col("toxic").alias("y"), (F.col("doc_id") % 50).alias("score"))
    return E.roc_points(df).select("score", r6(F.col("fpr")).alias("fpr"), r6(F.col("tpr")).alias("tpr"))


@query("metric_regression", "WITH p AS (SELECT l_linestatus AS part, l_extendedprice AS t, l_quantity * 1500 AS p FROM lineitem) SELECT part, R(1 - sum((t - p) ** 2) / (var_pop(t) * count(*))) AS r2, R(sqrt(avg((t - p) ** 2))) AS rmse, R(avg(abs(t - p))) AS mae, R(stddev_samp(t) / sqrt(avg((t - p) ** 2))) AS rpd FROM p GROUP BY part")
def metric_regression(spark, sf):
    df = layout.table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("part"), F.col("l_extendedprice").alias("y_true"), (F.col("l_quantity") * 1500).alias("y_pred"))
    out = E.regression(df, "part")
    return out.select("part", *(r6(F.col(c)).alias(c) for c in ("r2", "rmse", "mae", "rpd")))


@query("metric_uncertainty", "WITH p AS (SELECT value AS t, 50e0 AS p, 10e0 + event_id % 30 AS s FROM events) SELECT R(avg(s)) AS mean_std, R(avg(CASE WHEN t BETWEEN p - 1.96 * s AND p + 1.96 * s THEN 1e0 ELSE 0e0 END)) AS coverage FROM p")
def metric_uncertainty(spark, sf):
    df = layout.table(spark, sf, "events").select(F.col("value").alias("y_true"), F.lit(50.0).alias("y_pred"), (10.0 + F.col("event_id") % 30).alias("y_std"))
    return E.uncertainty(df).select(r6(F.col("mean_std")).alias("mean_std"), r6(F.col("coverage")).alias("coverage"))


@query("metric_summary", "WITH m AS (SELECT l_returnflag AS model, l_linenumber AS it, avg(l_discount) AS f1, avg(l_tax) AS acc FROM lineitem GROUP BY ALL), s AS (SELECT model, avg(f1) AS a, stddev_samp(f1) AS b, avg(acc) AS c, stddev_samp(acc) AS d FROM m GROUP BY model) SELECT model, R(a) AS f1_mean, R(b) AS f1_std, R(c) AS acc_mean, R(d) AS acc_std, (rank() OVER (ORDER BY a DESC))::INT AS rank FROM s")
def metric_summary(spark, sf):
    m = layout.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("model"), "l_linenumber").agg(F.avg("l_discount").alias("f1"), F.avg("l_tax").alias("acc"))
    out = E.summary(m, "model", "f1", "acc")
    return out.select("model", *(r6(F.col(c)).alias(c) for c in ("f1_mean", "f1_std", "acc_mean", "acc_std")), "rank")


@query("metric_best_per_model", "WITH t AS (SELECT p_brand AS model, p_partkey AS candidate, p_retailprice AS f1 FROM part), b AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, candidate) AS r FROM t) SELECT model, candidate, R(f1) AS f1, (row_number() OVER (ORDER BY f1 DESC, model))::INT AS rank FROM b WHERE r = 1")
def metric_best(spark, sf):
    t = layout.table(spark, sf, "part").select(F.col("p_brand").alias("model"), F.col("p_partkey").alias("candidate"), F.col("p_retailprice").alias("f1"))
    return E.best_per_model(t, "f1").withColumn("f1", r6(F.col("f1")))


@query("metric_entropy", "WITH p AS (SELECT event_id, [0.5e0, 0.25e0 + (event_id % 5) / 40e0, 0.25e0 - (event_id % 5) / 40e0] AS p FROM events) SELECT event_id, R(list_max(p)) AS confidence, R(-list_sum(list_transform(p, lambda x: x * ln(x)))) AS entropy FROM p")
def metric_entropy(spark, sf):
    d = F.col("event_id") % 5 / 40.0
    df = layout.table(spark, sf, "events").select("event_id", F.array(F.lit(0.5), 0.25 + d, 0.25 - d).alias("probabilities"))
    return E.with_entropy(df).select("event_id", r6(F.col("confidence")).alias("confidence"), r6(F.col("entropy")).alias("entropy"))


# Evaluation over folds, and saved bundles.


def _nb_sql(cells, part, where, out):
    """DuckDB: Gaussian naive Bayes of the training cells of each ``part``, and a prediction for its rows that fit ``where``."""
    return f"""e AS (SELECT {part}, 1e-9 * max(s) AS e FROM (SELECT {part}, band, var_pop(v) AS s FROM {cells} WHERE role = 'train' GROUP BY ALL) GROUP BY {part}), m AS (SELECT {part}, label AS c, band, avg(v) AS m, var_pop(v) + any_value(e) AS s, count(*) AS n FROM {cells} JOIN e USING ({part}) WHERE role = 'train' GROUP BY ALL),
        l AS (SELECT {part}, sample_idx, any_value(label) AS truth, c, ln(any_value(n)) - 0.5 * sum((v - m) ** 2 / s + ln(2 * pi() * s)) AS l FROM {cells} JOIN m USING ({part}, band) WHERE {where} GROUP BY ALL), {out} AS (SELECT {part}, sample_idx, any_value(truth) AS truth, arg_max(c, l) AS y_pred FROM l GROUP BY ALL)"""


_FOLDS = "f AS (SELECT vec_id AS sample_idx, (row_number() OVER (ORDER BY md5(concat('42', ':', vec_id::VARCHAR)), vec_id) - 1) % 5 AS fold FROM embeddings), fc AS (SELECT i AS it, sample_idx, label, band, v, CASE WHEN fold = i THEN 'val' ELSE 'train' END AS role FROM (SELECT sample_idx, label, band, v FROM cells) JOIN f USING (sample_idx), (SELECT unnest(range(5)) AS i))"


@query("model_cross_validation", f"WITH $LONG, {_FOLDS}, {_nb_sql('fc', 'it', chr(39).join(['role = ', 'val', '']), 'p')} SELECT 'gaussian_nb' AS model, it::INT AS iteration_id, R(avg((truth = y_pred)::INT)) AS accuracy FROM p GROUP BY it")
def model_cross_validation(spark, sf):
    """Five folds, a model fitted in each, scores of all in one aggregate."""
    df = layout.spectra(spark, sf)
    _, scores = V.cross_validate(df, D.kfold(df), ["gaussian_nb"])
    return scores.select("model", "iteration_id", r6(F.col("accuracy")).alias("accuracy"))


@query("model_comparison", f"WITH $LONG, {_FOLDS}, {_nb_sql('fc', 'it', chr(39).join(['role = ', 'val', '']), 'p')}, a AS (SELECT it, avg((truth = y_pred)::INT) AS a FROM p GROUP BY it) SELECT 'gaussian_nb' AS model, R(avg(a)) AS mean, R(stddev_samp(a)) AS std, 1 AS rank FROM a")
def model_comparison(spark, sf):
    df = layout.spectra(spark, sf)
    _, scores = V.cross_validate(df, D.kfold(df), ["gaussian_nb"])
    return V.compare(scores).select("model", r6(F.col("accuracy_mean")).alias("mean"), r6(F.col("accuracy_std")).alias("std"), "rank")


@query("bundle_round_trip", f"WITH $LONG, s AS (SELECT sample_idx, label, role, band, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS v, 0 AS it FROM cells WINDOW w AS (PARTITION BY sample_idx)), {_nb_sql('s', 'it', chr(39).join(['role = ', 'test', '']), 'p')} SELECT sample_idx, y_pred::VARCHAR AS y_pred FROM p")
def bundle_round_trip(spark, sf):
    """Fitted, saved, loaded, applied."""
    df = layout.spectra(spark, sf)
    path = scratch(spark, "bundle")
    B.save(spark, B.fit_bundle(df, chain=["snv", "mean_centering"], model="gaussian_nb"), path)
    return B.load(spark, path).predict(df.where("role = 'test'")).select("sample_idx", "y_pred")


@query("iteration_round_trip", "SELECT i::INT AS iteration_id, role, count(*) AS n FROM (SELECT i, CASE WHEN fold = i THEN 'val' ELSE 'train' END AS role FROM (SELECT (row_number() OVER (ORDER BY md5(concat('42', ':', vec_id::VARCHAR)), vec_id) - 1) % 5 AS fold FROM embeddings), (SELECT unnest(range(5)) AS i)) WHERE i = 2 GROUP BY ALL")
def iteration_round_trip(spark, sf):
    """Rows of all folds written, one fold read back."""
    df = layout.spectra(spark, sf)
    splits = D.kfold(df)
    path = scratch(spark, "iterations")
    data = df.drop("role").join(splits, "sample_idx")
    package.write_iterations(data, path)
    V.match_iterations(package.read_iterations(spark, path), splits)
    return package.read_iterations(spark, path, 2).groupBy("iteration_id", "role").agg(F.count(F.lit(1)).alias("n"))
