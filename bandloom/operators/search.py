"""Pipeline search: candidate spaces, trials, budget, execution with shared prefixes, and the choice of the best."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import BandloomError, confirm, require

#: Default spaces by purpose.
SPACES = {
    "pipeline": {"preprocess": ["none", "snv", "first_derivative"], "feature": ["none", "pca", "pls_latent_variables", "variance_threshold", "anova_f", "dct_features"], "model": ["pls_da", "lda", "knn_classifier", "random_forest_classifier"]},
    "pipeline_regression": {"preprocess": ["none", "snv", "first_derivative"], "feature": ["none", "pca", "variance_threshold", "f_regression"], "model": ["plsr", "ridge", "knn_regressor", "random_forest_regressor"]},
    "compare_quick": {"preprocess": ["none"], "feature": ["none", "pca", "anova_f"], "model": ["lda", "pls_da"]},
}
#: Feature spaces of a comparison, by its depth; the deep one needs networks and isn't offered.
COMPARISONS = {
    "quick": {"none": {}, "pca": {"n_components": [10]}, "pls_latent_variables": {"n_components": [10]}, "vip": {"top_k": [30]}, "select_k_best": {"top_k": [50]}, "spa": {"top_k": [50]}},
    "recommended": {
        "none": {}, "pca": {"n_components": [5, 10, 20, 30]}, "pls_latent_variables": {"n_components": [3, 5, 10]}, "vip": {"top_k": [10, 20, 30, 50, 80, 100]},
        "select_k_best": {"top_k": [20, 30, 50, 80]}, "spa": {"top_k": [20, 30, 50, 80]},
    },
    "extended": {
        "none": {}, "pca": {"n_components": [5, 10, 20, 30]}, "pls_latent_variables": {"n_components": [3, 5, 10]}, "vip": {"top_k": [10, 20, 30, 50, 80, 100]},
        "select_k_best": {"top_k": [20, 30, 50, 80]}, "spa": {"top_k": [20, 30, 50, 80]}, "anova_f": {"top_k": [20, 30, 50, 80]}, "dct_features": {"count": [10, 20, 30]}, "variance_threshold": {"threshold": [0.0]}, "kernel_pca": {"n_components": [5, 10]},
    },
}
#: The model that judges a comparison of features.
VALIDATORS = {"classification": "svm", "regression": "plsr"}
#: Order of preference among equals.
PREPROCESS_ORDER = ("none", "mean_centering", "standardization", "snv", "msc", "sg_smoothing", "first_derivative", "second_derivative")
HIGHER = {"macro_f1": True, "accuracy": True, "balanced_accuracy": True, "r2": True, "rpd": True, "rmse": False, "mae": False}


def expand(options: dict[str, list]) -> list[dict]:
    """Lists to their product, in order."""
    out: list[dict] = [{}]
    for key, values in options.items():
        out = [{**o, key: v} for o in out for v in (values if isinstance(values, list) else [values])]
    return out


def trials(spark: SparkSession, space: dict[str, list[str]]) -> DataFrame:
    """trial_id, preprocess, feature and model of each combination, numbered in the order of the lists."""
    cols = [list(dict.fromkeys(space[k])) for k in ("preprocess", "feature", "model")]
    rows = [(f"trial_{i:04d}", *r) for i, r in enumerate(itertools.product(*cols), 1)]
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 1), "trial_id string, preprocess string, feature string, model string")


def comparison(spark: SparkSession, depth: str = "quick", task: str = "classification") -> DataFrame:
    """Trials of a comparison of features: each method with each of its parameters, judged by one model."""
    require(depth in COMPARISONS, "COMPARISON", "an unknown depth of comparison", depth=depth, known=sorted(COMPARISONS))
    points = [(m, p) for m, g in COMPARISONS[depth].items() for p in expand(g)]
    rows = [(f"trial_{i:04d}", "none", m, VALIDATORS[task], {k: float(v) for k, v in p.items()}) for i, (m, p) in enumerate(points, 1)]
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 1), "trial_id string, preprocess string, feature string, model string, feature_parameters map<string,double>")


def audit_budget(rows: DataFrame, max_trials: int = 30, agreed: bool = False) -> int:
    n = rows.count()
    confirm(agreed or n <= max_trials, "TRIAL_BUDGET", "there are more trials than the budget allows", trials=n, budget=max_trials)
    return n


def recommend(n: int, p: int) -> dict:
    """Size class and method lists by the numbers of samples and bands."""
    small, wide = n < 200, p > n
    return {"p_over_n": p / max(n, 1), "small": small, "high_dimensional": wide, "models": ["pls_da", "lda", "svm"] if small or wide else ["random_forest_classifier", "svm", "pls_da"], "features": ["pca", "pls_latent_variables"] if wide else ["none", "pca"], "follow_up": "repeated_split" if n <= 200 else "none"}


def _feature(df: DataFrame, name: str, y: str | None, parameters: dict | None = None) -> DataFrame:
    """The features of a trial, fitted on its training rows; numbers above the bands are cut to them."""
    from . import feature as X

    train = df.where("role = 'train'")
    width = df.select(F.size("x").alias("p")).first()["p"]
    p = dict(parameters or {})
    k = min(width, int(p.get("top_k") or X.default_k(width)))
    components = {"n_components": int(p["n_components"])} if "n_components" in p else {}
    if name == "none":
        return df
    if name == "dct_features":
        return df.withColumn("x", X.dct_features(F.col("x"), width, int(p.get("count", 10))))
    if name == "variance_threshold":
        return X.keep_bands(df, X.over(X.variance_scores(train), p.get("threshold", 0.0), strict=True))
    if name in ("anova_f", "select_k_best"):
        return X.keep_bands(df, X.top_k(X.f_regression_scores(train, y) if y else X.anova_scores(train), k))
    if name == "f_regression":
        return X.keep_bands(df, X.top_k(X.f_regression_scores(train, y or "y"), k))
    if name in ("vip", "spa"):
        bands = sorted(np.argsort(-X.vip(train, 10, y), kind="stable")[:k].tolist()) if name == "vip" else X.spa(train, k)
        return X.keep_bands(df, df.sparkSession.createDataFrame([(int(b),) for b in bands], "band int"))
    if name == "pls_latent_variables":
        return X.fit_feature(df, name, y=y, **components).transform(df)
    return X.fit_feature(df, name, **components).transform(df)


def execute(df: DataFrame, rows: DataFrame, y: str | None = None, *, parallel: int = 4, prepare: Callable | None = None) -> DataFrame:
    """Validation metrics and fit time (seconds) of each trial. Each (preprocess, feature) prefix is made once and shared by its models.

    A prefix that fails ends the search; a model that fails is a row with its error.
    """
    from . import metrics
    from .model import fit_model
    from .preprocess import preprocess

    spark = df.sparkSession
    given = rows if "feature_parameters" in rows.columns else rows.withColumn("feature_parameters", F.lit(None).cast("map<string,double>"))
    by: dict[tuple, list] = {}
    for r in given.select("trial_id", "preprocess", "feature", "model", "feature_parameters").orderBy("trial_id").collect():  # a row per trial, within the budget
        by.setdefault((r["preprocess"], r["feature"], tuple(sorted((r["feature_parameters"] or {}).items()))), []).append(r)
    width = df.select(F.size("x").alias("p")).first()["p"]
    out = []
    for (pre, feat, parameters), own in by.items():
        data, _ = preprocess(df, [pre], width=width, window_length=7, polyorder=2)
        data = _feature(data, feat, y, dict(parameters)).persist()

        def one(r):
            began = time.perf_counter()
            try:
                pred = fit_model(data.where("role = 'train'"), r["model"], y).predict(data.where("role = 'val'"))
                m = metrics.regression(pred.withColumn("y_true", F.col(y))) if y else metrics.classification(pred.withColumn("y_true", F.col("label").cast("string")))
                return (*r, {k: float(v) for k, v in m.first().asDict().items() if v is not None}, time.perf_counter() - began, None)
            except BandloomError as e:
                return (*r, {}, time.perf_counter() - began, e.code)

        with ThreadPoolExecutor(parallel) as pool:
            out += pool.map(one, own)
        data.unpersist()
    return spark.createDataFrame(out, "trial_id string, preprocess string, feature string, model string, feature_parameters map<string,double>, metrics map<string,double>, fit_time double, error string")


def best(results: DataFrame, primary: str, secondary: tuple[str, ...] = ()) -> DataFrame:
    """Trials with their rank: by the primary metric, secondary ones, fewer steps, the preprocess order, then the id.

    Only validation metrics count; a missing metric ranks last whichever way it points.
    """
    require(primary in HIGHER, "METRIC", "an unknown metric", metric=primary)
    order = [(F.col("metrics")[m].desc_nulls_last() if HIGHER[m] else F.col("metrics")[m].asc_nulls_last()) for m in (primary, *secondary)]
    place = F.array_position(F.array(*(F.lit(p) for p in PREPROCESS_ORDER)), F.col("preprocess"))
    order += [(F.col("preprocess") != "none").cast("int").asc(), F.when(place > 0, place).otherwise(99).asc(), (F.col("feature") != "none").cast("int").asc(), F.col("trial_id").asc()]
    return results.where("error is null").withColumn("rank", F.row_number().over(Window.orderBy(*order)))
