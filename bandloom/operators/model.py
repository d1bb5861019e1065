"""Models behind one registry: fitted on training rows, applied to any number of rows.

Three kinds: closed forms from grouped moments (Bayes, discriminants, linear, prototypes), NumPy fits
on a bounded training matrix (PLS, kernels, Gaussian processes), and MLlib estimators. A fitted model
has ``predict(df)``, which adds ``y_pred`` (and ``probabilities`` or ``y_std`` where it has them).
"""

from __future__ import annotations

import io
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml import classification as mlc
from pyspark.ml import regression as mlr
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import BandloomError, needs, require
from ..functions import arrow, blocks, gram, shared
from .feature import class_moments, matrix, nipals, one_hot, pls_predict
from .quality import moments

#: Other names of models.
ALIASES = {
    "logistic": "logistic_regression", "lr": "logistic_regression", "svc": "svm", "svm_classifier": "svm", "linear_svc": "linear_svm", "linear_svm_classifier": "linear_svm",
    "lda_classifier": "lda", "qda_classifier": "qda", "naive_bayes": "gaussian_nb", "gnb": "gaussian_nb", "rf": "random_forest_classifier", "random_forest": "random_forest_classifier",
    "extra_trees": "extra_trees_classifier", "gradient_boosting": "gradient_boosting_classifier", "knn": "knn_classifier", "plsda": "pls_da", "pls_discriminant_analysis": "pls_da",
    "pls": "plsr", "pls_regression": "plsr", "principal_component_regression": "pcr", "ols": "linear_regression", "ridge_regression": "ridge", "elasticnet": "elastic_net", "svm_regression": "svr",
    "rf_regressor": "random_forest_regressor", "extra_trees_reg": "extra_trees_regressor", "gradient_boosting_reg": "gradient_boosting_regressor", "gaussian_process_regression": "gpr",
    "xgb_classifier": "xgboost_classifier", "xgb_regressor": "xgboost_regressor", "lgbm_classifier": "lightgbm_classifier", "lgbm_regressor": "lightgbm_regressor",
    "dkl_gp_classifier": "spectral_dkl_gp_classifier", "dkl_gp_regressor": "spectral_dkl_gp_regressor", "proto_classifier": "proto_spectral_classifier", "proto_regressor": "proto_spectral_regressor",
    "clsformer": "cls_former_classifier", "cls_former": "cls_former_classifier", "cls_former_svm": "cls_former_embedding_svm",
}
#: Parameter grids of the registry. Numbers of components and neighbours above what the training rows allow are left out.
GRIDS: dict[str, dict[str, list]] = {
    "logistic_regression": {"C": [0.1, 1.0, 10.0], "penalty": ["l2"], "class_weight": [None, "balanced"]},
    "svm": {"C": [0.1, 1.0, 10.0, 100.0], "gamma": ["scale", 0.01, 0.1], "class_weight": [None, "balanced"]},
    "linear_svm": {"C": [0.1, 1.0, 10.0], "class_weight": [None, "balanced"]},
    "lda": {"shrinkage": [None, "auto", 0.1]},
    "qda": {"reg_param": [0.0, 0.1, 0.5, 0.9]},
    "gaussian_nb": {"var_smoothing": [1e-11, 1e-9, 1e-7]},
    "random_forest_classifier": {"n_estimators": [100, 300], "max_depth": [None, 5], "max_features": ["sqrt", 0.5], "min_samples_leaf": [1]},
    "extra_trees_classifier": {"n_estimators": [100, 300], "max_depth": [None, 5], "max_features": ["sqrt", 0.5], "min_samples_leaf": [1]},
    "gradient_boosting_classifier": {"n_estimators": [50, 100], "learning_rate": [0.05, 0.1]},
    "knn_classifier": {"n_neighbors": [1, 3, 5, 7, 9], "weights": ["uniform", "distance"], "metric": ["euclidean"]},
    "pls_da": {"n_components": [1, 2, 5, 10]},
    "simca": {"n_components": [1, 2, 5, 10], "quantile": [0.95]},
    "mlp_classifier": {"hidden_layer_sizes": [(32,), (64,)], "max_iter": [500]},
    "plsr": {"n_components": [1, 2, 5, 10]},
    "pcr": {"n_components": [1, 2, 5, 10]},
    "linear_regression": {"fit_intercept": [True]},
    "ridge": {"alpha": [0.1, 1.0, 10.0]},
    "lasso": {"alpha": [0.001, 0.01, 0.1]},
    "elastic_net": {"alpha": [0.001, 0.01, 0.1], "l1_ratio": [0.2, 0.5, 0.8]},
    "bayesian_ridge": {"alpha_1": [1e-6], "lambda_1": [1e-6]},
    "svr": {"C": [0.1, 1.0, 10.0], "gamma": ["scale", "auto"]},
    "knn_regressor": {"n_neighbors": [1, 3, 5], "weights": ["uniform", "distance"]},
    "random_forest_regressor": {"n_estimators": [50, 100], "max_depth": [None, 5]},
    "extra_trees_regressor": {"n_estimators": [100, 200], "max_depth": [None, 5]},
    "gradient_boosting_regressor": {"n_estimators": [50, 100], "learning_rate": [0.05, 0.1]},
    "gpr": {"alpha": [1e-8, 1e-6]},
    "proto_spectral_classifier": {"metric": ["euclidean", "cosine"]},
    "proto_spectral_regressor": {"bins": [5, 10]},
}
#: Parameters that a model takes beyond its grid.
FURTHER = {"svr": ("epsilon",), "gpr": ("kernel", "length_scale", "noise_level"), "random_forest_regressor": ("max_features", "min_samples_leaf"), "extra_trees_regressor": ("max_features", "min_samples_leaf")}
GATED = {"xgboost_classifier": "xgboost", "xgboost_regressor": "xgboost", "lightgbm_classifier": "lightgbm", "lightgbm_regressor": "lightgbm", "catboost_classifier": "catboost", "catboost_regressor": "catboost", **dict.fromkeys(("spectral_dkl_gp_classifier", "spectral_dkl_gp_regressor", "cls_former_classifier", "cls_former_regressor", "cls_former_embedding_svm"), "torch")}


@dataclass
class Model:
    """Fitted: ``predict`` adds y_pred; ``state`` is what was learnt."""

    name: str
    predict: Callable[[DataFrame], DataFrame]
    state: dict = field(default_factory=dict)
    kernel: Callable | None = None  #: the NumPy function behind predict, where there is one
    label: str = "string"


def _numpy(name: str, f: Callable[[np.ndarray], dict[str, np.ndarray]], state: dict | None = None, label: str = "string") -> Model:
    """A model whose f maps a matrix to columns y_pred (and probabilities or y_std)."""

    def predict(df: DataFrame) -> DataFrame:
        kinds = {"y_pred": label, "probabilities": "array<double>", "y_std": "double"}
        probe = f(np.zeros((1, state["width"])))
        return arrow.with_columns(df, f, {c: kinds[c] for c in probe})

    return Model(name, predict, state or {}, f, label)


def _scores(classes: list, z: np.ndarray) -> dict:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    return {"y_pred": np.array([str(c) for c in classes], object)[p.argmax(axis=1)], "probabilities": p}


def gaussian_nb(train: DataFrame, var_smoothing: float = 1e-9) -> Model:
    """Means and population variances by class and band, from one grouped aggregate."""
    cells = train.select("label", F.posexplode("x").alias("band", "v")).groupBy("label", "band").agg(F.avg("v").alias("m"), F.var_pop("v").alias("s"), F.count("v").alias("n")).orderBy("label", "band").collect()
    classes = sorted({r["label"] for r in cells})
    m, s, n = (np.array([r[c] for r in cells], float).reshape(len(classes), -1) for c in "msn")
    s = s + var_smoothing * np.diag(moments(train)[2]).max() / n[:, 0].sum()
    prior = np.log(n[:, 0] / n[:, 0].sum())
    return _numpy("gaussian_nb", lambda x: _scores(classes, prior - 0.5 * (((x[:, None] - m) ** 2 / s + np.log(2 * np.pi * s)).sum(axis=2))), {"classes": classes, "mean": m, "var": s, "width": m.shape[1]})


def _ledoit_wolf(x: np.ndarray) -> float:
    """The shrinkage of the covariance of centred rows towards its mean variance that loses least (Ledoit and Wolf, 2004)."""
    n, p = x.shape
    cov = x.T @ x / n
    far = ((cov - np.trace(cov) / p * np.eye(p)) ** 2).sum() / p
    noise = (((x**2).sum(axis=1) ** 2).sum() / n - (cov**2).sum()) / (n * p)
    return float(min(noise, far) / far) if far > 0 else 0.0


def lda(train: DataFrame, shrinkage: float | str | None = None) -> Model:
    """Discriminants on standardised bands; the covariance within classes is shrunk by a share, by ``auto`` (Ledoit-Wolf) or not."""
    classes, size, mean, within = class_moments(train)
    cov = within / size.sum()
    total = cov + ((mean - size @ mean / size.sum()) ** 2 * size[:, None]).sum(axis=0) / size.sum() * np.eye(mean.shape[1])
    s = np.sqrt(np.where(np.diag(total) > 0, np.diag(total), 1.0))
    cov = cov / np.outer(s, s)
    if shrinkage == "auto":
        x, label = matrix(train, "label")
        at = {c: i for i, c in enumerate(classes)}
        shrinkage = _ledoit_wolf((x - mean[[at[v] for v in label]]) / s)
    g = float(shrinkage or 0.0)
    cov = (1 - g) * cov + g * np.trace(cov) / len(cov) * np.eye(len(cov))
    m = mean / s
    w = np.linalg.solve(cov + 1e-10 * np.trace(cov) * np.eye(len(cov)), m.T)
    b = np.log(size / size.sum()) - 0.5 * (m.T * w).sum(axis=0)
    w = w / s[:, None]
    return _numpy("lda", lambda x: _scores(classes, x @ w + b), {"classes": classes, "coef": w, "width": mean.shape[1]})


def qda(train: DataFrame, reg_param: float = 0.1) -> Model:
    classes = [r["label"] for r in train.select("label").distinct().orderBy("label").collect()]
    parts = []
    total = train.count()
    for c in classes:
        n, m, scatter = moments(train.where(F.col("label") == c))
        cov = (1 - reg_param) * scatter / max(1, n - 1) + reg_param * np.eye(len(m))
        parts.append((m, np.linalg.pinv(cov), np.linalg.slogdet(cov + 1e-12 * np.eye(len(m)))[1], np.log(n / total)))
    f = lambda x: _scores(classes, np.column_stack([p - 0.5 * d - 0.5 * (((x - m) @ i) * (x - m)).sum(axis=1) for m, i, d, p in parts]))
    return _numpy("qda", f, {"classes": classes, "width": len(parts[0][0])})


def pls_da(train: DataFrame, n_components: int = 5) -> Model:
    x, label = matrix(train, "label")
    classes, hot = one_hot(label)
    m = nipals(x, hot, min(n_components, len(x) - 1, x.shape[1]))
    return _numpy("pls_da", lambda a: _scores(classes, pls_predict(m, a)), {"classes": classes, "width": x.shape[1]})


def simca(train: DataFrame, n_components: int = 5, quantile: float = 0.95) -> Model:
    """A PCA per class; a row goes to the class whose residual and score distances are least against their limits."""
    classes = [r["label"] for r in train.select("label").distinct().orderBy("label").collect()]
    parts = []
    for c in classes:
        (x,) = matrix(train.where(F.col("label") == c))
        m = x.mean(axis=0)
        _, s, vt = np.linalg.svd(x - m, full_matrices=False)
        v = vt[: max(1, min(n_components, len(x) - 1))]
        std = np.maximum(s[: len(v)] / np.sqrt(max(1, len(x) - 1)), 1e-12)
        parts.append([m, v, std, 1.0, 1.0])
        q, t = _simca_distance(parts[-1], x)
        parts[-1][3:] = [max(np.quantile(q, quantile), 1e-12), max(np.quantile(t, quantile), 1e-12)]

    def f(a):
        d = np.column_stack([(q := _simca_distance(p, a))[0] / p[3] + q[1] / p[4] for p in parts])
        return _scores(classes, -d)

    return _numpy("simca", f, {"classes": classes, "width": len(parts[0][0])})


def _simca_distance(p, x):
    t = (x - p[0]) @ p[1].T
    return np.sqrt(((x - p[0] - t @ p[1]) ** 2).sum(axis=1)), np.sqrt(((t / p[2]) ** 2).sum(axis=1))


def prototypes(train: DataFrame, metric: str = "euclidean") -> Model:
    """Class means; the nearest one (squared distance or cosine) wins, softmax of the negative distance."""
    classes, _, mean, _ = class_moments(train)

    def f(x):
        if metric == "cosine":
            d = 1 - x @ mean.T / np.maximum(np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(mean, axis=1), 1e-12)
        else:
            d = ((x[:, None] - mean) ** 2).sum(axis=2)
        return _scores(classes, -d)

    return _numpy("proto_spectral_classifier", f, {"classes": classes, "width": mean.shape[1]})


def prototype_regressor(train: DataFrame, bins: int = 5, y: str = "y") -> Model:
    """Means of quantile bins of y; the prediction is the mean y of the bins weighted by exp(-distance)."""
    edges = train.agg(F.percentile(y, F.array(*(F.lit(i / bins) for i in range(1, bins)))).alias("e")).first()["e"]
    place = F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e <= F.col(y)))
    _, size, mean, _ = class_moments(train.withColumn("label", place))
    target = np.array([r["m"] for r in train.groupBy(place.alias("b")).agg(F.avg(y).alias("m")).orderBy("b").collect()])

    def f(x):
        w = np.exp(-np.sqrt(((x[:, None] - mean) ** 2).sum(axis=2)))
        return {"y_pred": (w * target).sum(axis=1) / w.sum(axis=1)}

    return _numpy("proto_spectral_regressor", f, {"width": mean.shape[1], "size": size}, "double")


def _votes(value: np.ndarray, near: np.ndarray, weights: str, mean: bool) -> np.ndarray:
    """A prediction per row from its neighbours' values and distances."""
    w = np.ones_like(near) if weights == "uniform" else 1 / np.maximum(near, 1e-12)
    if mean:
        return (value.astype(float) * w).sum(axis=1) / w.sum(axis=1)
    classes = np.array(sorted(set(value.ravel().tolist())))
    votes = np.column_stack([((value == c) * w).sum(axis=1) for c in classes])
    return classes[votes.argmax(axis=1)].astype(str)


#: Rows of a block of neighbours' search.
KNN_BLOCK = 16_384


def knn(train: DataFrame, df: DataFrame, k: int = 5, weights: str = "uniform", y: str | None = None, max_train: int = 50_000) -> DataFrame:
    """df with y_pred by the k nearest training rows (ties to the lower sample): against the broadcast training matrix, above a bound block by block."""
    kind = "double" if y else "string"
    n = train.count()
    if n > max_train:
        require(not df.isStreaming, "KNN_ROWS", "neighbours of a stream keep the training matrix on every executor", rows=n, bound=max_train)
        return _knn_blocks(train, df, k, weights, y)
    x, target = matrix(train, y or "label")
    known = df.sparkSession.sparkContext.broadcast((x, target))

    def run(q: np.ndarray) -> dict:
        t, value = known.value
        at, near = blocks.nearest(q, t, k)
        return {"y_pred": _votes(value[at], near, weights, bool(y))}

    return arrow.with_columns(df, run, {"y_pred": kind})


def _knn_blocks(train: DataFrame, df: DataFrame, k: int, weights: str, y: str | None) -> DataFrame:
    """Every block of rows against every block of training rows, then the nearest of each row's block results."""
    own = y or "label"
    value = F.col(own).cast("double") if y else F.col(own)
    value_kind = "double" if y else train.schema[own].dataType.simpleString()
    known = blocks.numbered(train.select("sample_idx", "x", value.alias("_v")), "knn-train")
    rows = blocks.numbered(df, "knn-rows")
    size = KNN_BLOCK

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({"_row": pa.array([], pa.int64()), "d": pa.array([], pa.float64()), "id": pa.array([], pa.int64()), "v": pa.array([], b["_v"].type)})
        ids = b["sample_idx"].to_numpy()
        at, near = blocks.nearest(arrow.matrix_of(a["x"].combine_chunks()), arrow.matrix_of(b["x"].combine_chunks()), k, ids)
        flat = at.ravel()
        return pa.table({"_row": np.repeat(a["_row"].to_numpy(), at.shape[1]), "d": near.ravel(), "id": ids[flat].astype(np.int64), "v": b["_v"].combine_chunks().take(pa.array(flat))})

    left = blocks.cut(rows.select("_row", "x"), blocks.count(rows.count(), size), "_a")
    found = blocks.against(left, blocks.cut(known, blocks.count(known.count(), size), "_b"), search, f"_row long, d double, id long, v {value_kind}")
    best = found.groupBy("_row").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "id", "v"))), 1, k).alias("n")).select("_row", F.col("n.v").alias("v"), F.col("n.d").alias("d"))
    kind = "double" if y else "string"

    def vote(batches):
        for batch in batches:
            at = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            if batch.num_rows:
                v = at("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                made = _votes(v, arrow.matrix_of(at("d")), weights, bool(y))
                yield pa.RecordBatch.from_arrays([at("_row"), pa.array(made.tolist(), arrow.ARROW[kind])], ["_row", "y_pred"])

    return rows.join(best.mapInArrow(vote, f"_row long, y_pred {kind}"), "_row").select(*(c for c in df.columns if c != "y_pred"), "y_pred")


def _knn_model(train: DataFrame, y: str | None = None, n_neighbors: int = 5, weights: str = "uniform", metric: str = "euclidean") -> Model:
    require(metric == "euclidean", "METRIC", "neighbours are taken by Euclidean distance", metric=metric)
    kept = train.select("sample_idx", "x", y or "label")
    return Model("knn_regressor" if y else "knn_classifier", lambda df: knn(kept, df, n_neighbors, weights, y), {"train": kept, "parameters": {"y": y, "n_neighbors": n_neighbors, "weights": weights}})


# Linear family: closed forms from moments with the target as one more band.


def _linear_moments(train: DataFrame, y: str):
    n, mean, scatter = moments(train.select(F.concat("x", F.array(F.col(y).cast("double"))).alias("x")))
    return n, mean[:-1], mean[-1], scatter[:-1, :-1], scatter[:-1, -1], scatter[-1, -1]


def _line(name: str, w: np.ndarray, b: float, **state) -> Model:
    return _numpy(name, lambda x: {"y_pred": x @ w + b}, {"coef": w, "intercept": b, "width": len(w), **state}, "double")


def ridge(train: DataFrame, alpha: float = 1.0, y: str = "y", scaled: bool = True) -> Model:
    """Least squares with a penalty on standardised bands (divisor n)."""
    n, mx, my, sxx, sxy, _ = _linear_moments(train, y)
    s = np.sqrt(np.diag(sxx) / n) if scaled else np.ones(len(mx))
    s = np.where(s > 0, s, 1.0)
    w = np.linalg.lstsq(sxx / np.outer(s, s) + alpha * np.eye(len(mx)), sxy / s, rcond=None)[0] / s
    return _line("ridge" if alpha else "linear_regression", w, my - mx @ w)


def elastic_net(train: DataFrame, alpha: float = 0.01, l1_ratio: float = 0.5, y: str = "y", rounds: int = 1000) -> Model:
    """Coordinate descent on the Gram matrix of standardised bands."""
    n, mx, my, sxx, sxy, _ = _linear_moments(train, y)
    s = np.sqrt(np.diag(sxx) / n)
    s = np.where(s > 0, s, 1.0)
    g, c = sxx / np.outer(s, s) / n, sxy / s / n
    w = np.zeros(len(c))
    for _ in range(rounds):
        old = w.copy()
        for j in range(len(w)):
            r = c[j] - g[j] @ w + g[j, j] * w[j]
            w[j] = np.sign(r) * max(abs(r) - alpha * l1_ratio, 0) / (g[j, j] + alpha * (1 - l1_ratio))
        if np.abs(w - old).max() < 1e-9:
            break
    w = w / s
    return _line("lasso" if l1_ratio == 1 else "elastic_net", w, my - mx @ w)


def bayesian_ridge(train: DataFrame, alpha_1: float = 1e-6, lambda_1: float = 1e-6, y: str = "y", rounds: int = 300) -> Model:
    """Evidence maximisation of noise and weight precision under Gamma priors; predicts a deviation too."""
    n, mx, my, sxx, sxy, syy = _linear_moments(train, y)
    value, vector = np.linalg.eigh(sxx)
    value = np.maximum(value, 0)
    a, lam, proj = n / max(syy, 1e-12), 1.0, vector.T @ sxy
    for _ in range(rounds):
        w = vector @ (proj / (value + lam / a))
        gamma = (a * value / (lam + a * value)).sum()
        rest = max(syy - 2 * w @ sxy + w @ sxx @ w, 1e-12)
        new_lam, new_a = (gamma + 2 * lambda_1) / (max(w @ w, 1e-12) + 2e-6), (n - gamma + 2 * alpha_1) / (rest + 2e-6)
        done = abs(new_lam - lam) < 1e-6 * lam
        lam, a = new_lam, new_a
        if done:
            break
    cov = vector / (lam + a * value) @ vector.T
    return _numpy("bayesian_ridge", lambda x: {"y_pred": (x - mx) @ w + my, "y_std": np.sqrt(1 / a + (((x - mx) @ cov) * (x - mx)).sum(axis=1))}, {"coef": w, "width": len(w)}, "double")


def plsr(train: DataFrame, n_components: int = 5, y: str = "y") -> Model:
    x, t = matrix(train, y)
    m = nipals(x, t.astype(float)[:, None], min(n_components, len(x) - 1, x.shape[1]))
    return _line("plsr", m["coef"][:, 0], float(m["my"][0] - m["mx"] @ m["coef"][:, 0]))


def pcr(train: DataFrame, n_components: int = 5, y: str = "y") -> Model:
    n, mx, my, sxx, sxy, _ = _linear_moments(train, y)
    value, vector = np.linalg.eigh(sxx)
    v, s = vector[:, ::-1][:, :n_components], np.maximum(value[::-1][:n_components], 1e-12)
    w = v @ (v.T @ sxy / s)
    return _line("pcr", w, my - mx @ w)


# Kernels.



def _standard(x):
    m, s = x.mean(axis=0), x.std(axis=0)
    s = np.where(s > 0, s, 1.0)
    return lambda a: (a - m) / s


def svm(train: DataFrame, C: float = 1.0, gamma: float | str = "scale", class_weight: str | None = None) -> Model:
    """RBF kernel, one class against the rest, on standardised bands, with a regularised bias (the kernel plus one)."""
    x, label = arrow.collected(train, "label")[1:]
    scale = _standard(x)
    z = scale(x)
    g = 1 / (z.shape[1] * max(z.var(), 1e-12)) if gamma == "scale" else float(gamma)
    classes, hot = one_hot(label)
    n_pos = hot.sum(axis=0)
    y, c = 2 * hot - 1, np.full(hot.shape, float(C))
    if class_weight == "balanced":
        c *= np.where(hot == 1, len(z) / (2 * n_pos), len(z) / (2 * (len(z) - n_pos)))
    coef = gram.boxed(z, g, y, np.minimum(c * y, 0), np.maximum(c * y, 0), 0.0, 1e-4 * c.max(axis=0), 100)
    score = gram.sliced(lambda a: 2 * ((gram.rbf(a, z, g) + 1) @ coef), len(z))
    return _numpy("svm", lambda a: _scores(classes, score(scale(a))), {"classes": classes, "width": x.shape[1]})


def svr(train: DataFrame, C: float = 1.0, gamma: float | str = "scale", epsilon: float = 0.1, y: str = "y") -> Model:
    """Epsilon-insensitive regression with an RBF kernel, by coordinate descent on the dual."""
    x, t = arrow.collected(train, y)[1:]
    scale, t = _standard(x), t.astype(float)
    z = scale(x)
    g = 1 / (z.shape[1] * max(z.var(), 1e-12)) if gamma == "scale" else 1 / z.shape[1] if gamma == "auto" else float(gamma)
    mean, box = t.mean(), np.full((len(t), 1), float(C))
    b = gram.boxed(z, g, (t - mean)[:, None], -box, box, epsilon, 1e-6, 200)[:, 0]
    line = gram.sliced(lambda a: (gram.rbf(a, z, g) + 1) @ b, len(z))
    return _numpy("svr", lambda a: {"y_pred": line(scale(a)) + mean}, {"width": x.shape[1]}, "double")


#: Training rows up to which a Gaussian process keeps its Cholesky factor in the driver.
GPR_ROWS = 4000
#: Cells of a block of the factor's rows, summed over the tasks that send one to the driver.
GPR_CELLS = 36_000_000
#: Rows of a block that is held against the factor's table.
GPR_BLOCK = 1024


def gpr(train: DataFrame, alpha: float = 1e-6, kernel: str = "rbf", length_scale: float = 10.0, noise_level: float = 1e-2, y: str = "y") -> Model:
    """RBF or Matern 3/2 kernel plus white noise and ``alpha``; mean and deviation. Above GPR_ROWS training rows the factor is a table."""
    x, t = arrow.collected(train, y)[1:]
    scale, t = _standard(x), t.astype(float)
    z, mean, var = scale(x), t.mean(), max(t.var(), 1e-12)
    noise = noise_level + alpha
    t = (t - mean) / np.sqrt(var)

    def near(a, b):
        if kernel == "rbf":
            return gram.rbf(a, b, 1 / (2 * length_scale**2))
        d = np.sqrt(3 * np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T, 0)) / length_scale
        return (1 + d) * np.exp(-d)

    if len(z) > GPR_ROWS:
        table, dual = _inverse_root(train.sparkSession, z, t, near, noise)
        return _gpr_model(table, {"z": z, "dual": dual, "scale": scale, "near": near, "mean": mean, "var": var, "noise": noise})
    root = np.linalg.cholesky(near(z, z) + noise * np.eye(len(z)))
    dual = np.linalg.solve(root.T, np.linalg.solve(root, t))

    def f(a):
        k = near(scale(a), z)
        return {"y_pred": k @ dual * np.sqrt(var) + mean, "y_std": np.sqrt(var * np.maximum(1 + noise - (np.linalg.solve(root, k.T) ** 2).sum(axis=0), 1e-12))}

    return _numpy("gpr", f, {"width": x.shape[1]}, "double")


def _gpr_model(table: DataFrame, said: dict) -> Model:
    z, dual, scale, near, mean, var, noise = (said[c] for c in ("z", "dual", "scale", "near", "mean", "var", "noise"))
    middle = gram.sliced(lambda a: near(a, z) @ dual * np.sqrt(var) + mean, len(z))

    def predict(df):
        require(not df.isStreaming, "GPR_STREAM", "a stream can't be held against a factor that is a table", rows=len(z))
        rows = blocks.numbered(df.drop("y_pred", "y_std"), "gpr-rows")
        spread = _explained(rows, table, z, scale, near).select("_row", F.sqrt(F.greatest(1 + noise - F.col("_known"), F.lit(1e-12)) * var).alias("y_std"))
        return arrow.with_columns(rows, lambda a: {"y_pred": middle(scale(a))}, {"y_pred": "double"}).join(spread, "_row").drop("_row")

    return Model("gpr", predict, {"factor": table, "process": said, "width": z.shape[1]}, None, "double")


def _panel(v, j: int) -> np.ndarray:
    return np.frombuffer(v.as_buffer(), float).reshape(-1, j)


def _inverse_root(spark, z: np.ndarray, t: np.ndarray, near: Callable, noise: float) -> tuple[DataFrame, np.ndarray]:
    """The inverse N of the Cholesky factor of the kernel matrix with noise, as a table of panels of rows, and the dual N'N t.

    Rows are bordered block by block: with a the kernels of a block to the rows before, l = a N' are
    the factor's rows, and -inv(root) l N those of the inverse; tasks sum l N over the panels they read.
    """
    n, tasks = len(z), spark.sparkContext.defaultParallelism
    size = max(16, min(1024, GPR_CELLS // tasks // n))  # so that the tasks' sums fit the driver
    path = shared.scratch(spark, "gpr")
    kind = "j int, v binary"  # a panel has columns up to j
    dual = np.zeros(n)
    for i, j in gram.cuts(n, 1, size):
        a = near(z[i:j], z[:j])
        own, before = a[:, i:] + noise * np.eye(j - i), a[:, :i]
        if i:
            held = spark.sparkContext.broadcast(before)

            def run(batches, held=held):
                a = held.value
                total, square = np.zeros_like(a), np.zeros((len(a), len(a)))
                for batch in batches:
                    for j, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                        p = _panel(v, j)
                        part = a[:, :j] @ p.T
                        total[:, :j] += part @ p
                        square += part @ part.T
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([square.tobytes()], pa.binary())], ["total", "square"])

            shared.ship(spark)
            total = np.zeros_like(before)
            made = spark.read.schema(kind).parquet(path).coalesce(tasks).mapInArrow(run, "total binary, square binary").toArrow()
            for v, q in zip(made["total"], made["square"]):
                total += _panel(v, i)
                own -= _panel(q, j - i)
            del made
            held.destroy()
        inverse = np.linalg.inv(np.linalg.cholesky(own))
        rows = np.hstack([-inverse @ total, inverse]) if i else inverse
        dual[:j] += rows.T @ (rows @ t[:j])
        step = max(1, (1 << 19) // j)
        panels = [np.ascontiguousarray(rows[k : k + step]).tobytes() for k in range(0, len(rows), step)]
        spark.createDataFrame(pa.table({"j": pa.array([j] * len(panels), pa.int32()), "v": pa.array(panels, pa.binary())})).coalesce(tasks).write.mode("append").parquet(path)
    return spark.read.schema(kind).parquet(path), dual


def _explained(rows: DataFrame, table: DataFrame, z: np.ndarray, scale: Callable, near: Callable) -> DataFrame:
    """``_row`` and ``_known``, the squared length of N k for its kernels k: every block of rows meets every panel."""
    packed = blocks.cut(rows, blocks.count(rows.count(), GPR_BLOCK), "_a").groupBy("_a").agg(F.collect_list("_row").alias("rows"), F.collect_list("x").alias("xs"))

    def run(batches):
        known = {}
        for batch in batches:
            for a, r, xs, j, v in zip(*(batch.column(i) for i in range(5))):
                a = a.as_py()
                if a not in known:
                    r = r.values.to_numpy()
                    known[a] = [r, scale(arrow.matrix_of(xs.values)), np.zeros(len(r)), 0, None]
                one, j = known[a], j.as_py()
                if one[3] != j:
                    one[3:] = j, near(one[1], z[:j])
                one[2] += ((one[4] @ _panel(v, j).T) ** 2).sum(axis=1)
        for r, _, total, *_ in known.values():
            yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(total)], ["_row", "part"])

    shared.ship(rows.sparkSession)
    return packed.crossJoin(table).mapInArrow(run, "_row long, part double").groupBy("_row").agg(F.sum("part").alias("_known"))


# MLlib.


def _mllib(name: str, estimator, train: DataFrame, y: str | None) -> Model:
    """Standardised by training rows (divisor n), then an MLlib estimator; labels in alphabetical order."""
    from .preprocess import fit_bands

    fit = fit_bands(train).select("mean", "std").first()
    mean, std = [float(v) for v in fit["mean"]], [float(s) if s else 1.0 for s in fit["std"]]
    scaled = _scaled(mean, std)
    estimator = estimator.setFeaturesCol("_x").setPredictionCol("_pred")
    if y:
        fitted = Pipeline(stages=[estimator.setLabelCol("_y")]).fit(scaled(train).withColumn("_y", F.col(y).cast("double")).select("_x", "_y"))
        return _mllib_model(name, fitted, mean, std, None)
    classes = sorted(str(r["label"]) for r in train.select("label").distinct().collect())
    order = F.array(*(F.lit(c) for c in classes))
    coded = scaled(train).withColumn("_y", (F.array_position(order, F.col("label").cast("string")) - 1).cast("double"))
    weights = coded.groupBy("_y").agg(F.count(F.lit(1)).alias("_n"))
    coded = coded.join(F.broadcast(weights), "_y").withColumn("_w", coded.count() / (len(classes) * F.col("_n")))
    return _mllib_model(name, estimator.setLabelCol("_y").fit(coded.select("_x", "_y", "_w")), mean, std, classes)


def _scaled(mean: list[float], std: list[float]) -> Callable[[DataFrame], DataFrame]:
    m, s = (F.array(*(F.lit(v) for v in values)) for values in (mean, std))
    return lambda df: df.withColumn("_x", array_to_vector(F.zip_with(F.zip_with("x", m, lambda v, a: v - a), s, lambda v, a: v / a)))


def _mllib_model(name: str, fitted, mean: list[float], std: list[float], classes: list[str] | None) -> Model:
    """A fitted MLlib model over standardised bands; with classes, predictions are their names."""
    scaled = _scaled(mean, std)
    said = F.get(F.array(*(F.lit(c) for c in classes)), F.col("_pred").cast("int")) if classes else F.col("_pred")
    return Model(name, lambda df: fitted.transform(scaled(df)).withColumn("y_pred", said).select(*df.columns, "y_pred"), {"model": fitted, "mean": mean, "std": std, "classes": classes})


def _ovr(base):
    return mlc.OneVsRest(classifier=base, parallelism=4)


def _classifier(name: str, train: DataFrame, p: dict) -> Model:
    n = train.count()
    weighted = lambda e: e.setWeightCol("_w") if p.get("class_weight") == "balanced" else e
    if name == "logistic_regression":
        require(p.get("penalty", "l2") == "l2", "PENALTY", "only l2 is offered", penalty=p.get("penalty"))
        return _mllib(name, weighted(mlc.LogisticRegression(maxIter=200, regParam=1 / (p.get("C", 1) * n), standardization=False)), train, None)
    if name == "linear_svm":
        return _mllib(name, weighted(_ovr(mlc.LinearSVC(maxIter=100, regParam=1 / (p.get("C", 1) * n), standardization=False))), train, None)
    if name == "gradient_boosting_classifier":
        return _mllib(name, _ovr(mlc.GBTClassifier(maxIter=p.get("n_estimators", 100), stepSize=p.get("learning_rate", 0.1), maxDepth=3, seed=42)), train, None)
    width = train.select(F.size("x").alias("p")).first()["p"]
    k = train.select("label").distinct().count()
    return _mllib(name, mlc.MultilayerPerceptronClassifier(layers=[width, *p.get("hidden_layer_sizes", (32,)), k], maxIter=p.get("max_iter", 500), seed=42), train, None)


def _regressor(name: str, train: DataFrame, p: dict, y: str) -> Model:
    return _mllib(name, mlr.GBTRegressor(maxIter=p.get("n_estimators", 100), stepSize=p.get("learning_rate", 0.1), maxDepth=3, seed=42), train, y)


# Forests: a tree a task, over the bounded training matrix.


def _random_tree(x: np.ndarray, t: np.ndarray, rng, max_depth: int | None, tried: int, least: int) -> np.ndarray:
    """Rows of (band or -1, threshold, left, right, *mean of t) by a random threshold in each of ``tried`` bands that vary; the least squared error wins."""
    rows, todo = [], [(np.arange(len(x)), 0, -1, 0)]
    while todo:
        at, depth, parent, side = todo.pop()
        me = len(rows)
        if parent >= 0:
            rows[parent][2 + side] = me
        own = t[at]
        rows.append([-1, 0.0, -1, -1, *own.mean(axis=0)])
        if (max_depth is not None and depth >= max_depth) or len(at) < 2 * least or (own == own[0]).all():
            continue
        low, high = x[at].min(axis=0), x[at].max(axis=0)
        vary = np.flatnonzero(high > low)
        bands = rng.permutation(vary)[:tried]
        if not len(bands):
            continue
        cut = rng.uniform(low[bands], high[bands])
        left = x[np.ix_(at, bands)] <= cut
        n = left.sum(axis=0)
        a, whole = left.T @ own, own.sum(axis=0)
        fine = (n >= least) & (len(at) - n >= least)
        if not fine.any():
            continue
        gain = (a**2).sum(axis=1) / np.maximum(n, 1) + ((whole - a) ** 2).sum(axis=1) / np.maximum(len(at) - n, 1)
        best = int(np.where(fine, gain, -np.inf).argmax())
        rows[me][:2] = [int(bands[best]), float(cut[best])]
        todo += [(at[left[:, best]], depth + 1, me, 0), (at[~left[:, best]], depth + 1, me, 1)]
    return np.array(rows, float)


def _tree_values(tree: np.ndarray, x: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    while (live := np.flatnonzero(tree[node, 0] >= 0)).size:
        here = node[live]
        right = x[live, tree[here, 0].astype(int)] > tree[here, 1]
        node[live] = np.where(right, tree[here, 3], tree[here, 2]).astype(int)
    return tree[node, 4:]


#: Bytes of trees that may be collected into a model; more of them stay a table.
MAX_FOREST_BYTES = 64_000_000
#: Rows that one task sends through trees at once.
FOREST_BLOCK = 50_000
#: Trees of a task that predicts from a table of trees.
FOREST_TREES = 4


def _packed(tree: np.ndarray) -> bytes:
    """A tree's arrays; equal leaf values are kept once."""
    value, at = np.unique(tree[:, 4:], axis=0, return_inverse=True)
    out = io.BytesIO()
    np.savez(out, band=tree[:, 0].astype(np.int32), cut=tree[:, 1], child=tree[:, 2:4].astype(np.int32), value=value, at=at.ravel().astype(np.int32))
    return out.getvalue()


def _unpacked(content: bytes) -> np.ndarray:
    t = np.load(io.BytesIO(content))
    return np.column_stack([t["band"], t["cut"], t["child"], t["value"][t["at"]]])


def _grown(name: str, train: DataFrame, y: str | None, n_estimators: int, grow: Callable, **state) -> Model:
    """A forest whose tree i is grow(x, t, i), a tree a task over the broadcast training matrix.

    Few trees are collected; a forest above MAX_FOREST_BYTES stays a table, which meets blocks of rows in tasks.
    """
    x, target = matrix(train, y or "label")
    classes, t = (None, target.astype(float)[:, None]) if y else one_hot(target)
    spark = train.sparkSession
    shared_rows = spark.sparkContext.broadcast((x, t))

    def run(batches):
        a, b = shared_rows.value
        for pdf in batches:
            for i in pdf["id"]:
                yield pd.DataFrame({"id": [i], "tree": [_packed(grow(a, b, int(i)))]})

    shared.ship(spark)
    table = shared.stored(spark.range(n_estimators).repartition(min(n_estimators, 64)).mapInPandas(run, "id long, tree binary"), "trees")
    shared_rows.unpersist()
    label = "double" if y else "string"

    def said(p):
        return {"y_pred": p[:, 0]} if y else {"y_pred": np.array([str(c) for c in classes], object)[p.argmax(axis=1)], "probabilities": p}

    about = {"width": x.shape[1], **({} if y else {"classes": classes})}
    if table.agg(F.sum(F.length("tree"))).first()[0] <= MAX_FOREST_BYTES:
        trees = [_unpacked(r["tree"]) for r in table.orderBy("id").collect()]
        return _numpy(name, lambda a: said(sum(_tree_values(tree, a) for tree in trees) / len(trees)), about, label)
    return _forest_model(name, table, n_estimators, said, about, label)


def _forest_model(name: str, table: DataFrame, n_estimators: int, said: Callable, about: dict, label: str) -> Model:
    """Predictions of trees in a table: sums over each block of trees, added in the order of the trees."""

    def partial(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({"_row": pa.array([], pa.int64()), "b": pa.array([], pa.int32()), "s": pa.array([], pa.list_(pa.float64()))})
        x = arrow.matrix_of(a["x"].combine_chunks())
        pairs = sorted(zip(b["id"].to_pylist(), b["tree"].to_pylist()))
        total = sum(_tree_values(_unpacked(tree), x) for _, tree in pairs)
        return pa.table({"_row": a["_row"], "b": pa.array([b["_b"][0].as_py()] * len(a), pa.int32()), "s": pa.array(list(total), pa.list_(pa.float64()))})

    def predict(df: DataFrame) -> DataFrame:
        require(not df.isStreaming, "FOREST_STREAM", "a forest of this size is a table and can't score a stream")
        rows = blocks.numbered(df, "forest-rows")
        left = blocks.cut(rows.select("_row", "x"), blocks.count(rows.count(), FOREST_BLOCK), "_a")
        right = table.withColumn("_b", F.floor(F.col("id") / FOREST_TREES).cast("int"))
        sums = blocks.against(left, right, partial, "_row long, b int, s array<double>")
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("b", "s"))), lambda c: c["s"])
        added = sums.groupBy("_row").agg(F.aggregate(F.slice(ordered, 2, n_estimators), F.get(ordered, F.lit(0)), lambda u, v: F.zip_with(u, v, lambda p, q: p + q)).alias("x"))
        kinds = {"y_pred": label} | ({"probabilities": "array<double>"} if label == "string" else {})
        made = arrow.with_columns(added, lambda p: said(p / n_estimators), kinds).drop("x")
        return rows.drop(*kinds).join(made, "_row").select(*(c for c in df.columns if c not in kinds), *kinds)

    return Model(name, predict, {**about, "trees": table, "forest": (said, n_estimators)}, None, label)


def _tried(share: str | float, width: int) -> int:
    return max(1, {"sqrt": int(np.sqrt(width)), "all": width}[share] if isinstance(share, str) and share in ("sqrt", "all") else int(float(share) * width))


def extra_trees(train: DataFrame, y: str | None = None, n_estimators: int = 100, max_depth: int | None = None, max_features: str | float | None = None, min_samples_leaf: int = 1, seed: int = 42) -> Model:
    """Extremely randomised trees (Geurts and others, 2006) on all training rows; votes are mean class shares. Trees are tasks."""
    share = max_features or (1.0 if y else "sqrt")
    grow = lambda x, t, i: _random_tree(x, t, np.random.default_rng([seed, i]), max_depth, _tried(share, x.shape[1]), min_samples_leaf)
    return _grown("extra_trees_regressor" if y else "extra_trees_classifier", train, y, n_estimators, grow)


def _best_tree(x: np.ndarray, t: np.ndarray, rng, max_depth: int | None, tried: int, least: int) -> np.ndarray:
    """A tree over rows drawn with repeats, grown a level at a time: the exact best cut in ``tried`` bands drawn for each node (Gini or squared error)."""
    n, width = x.shape
    place = np.argsort(np.argsort(x, axis=0, kind="stable"), axis=0, kind="stable")  # each row's place along each band
    along = np.argsort(x, axis=0, kind="stable")
    at = rng.integers(0, n, n)
    node = np.zeros(n, np.int64)  # of the level
    made = [[-1, 0.0, -1, -1, *t[at].mean(axis=0)]]
    ids, depth = np.zeros(1, np.int64), 0
    while len(ids) and (max_depth is None or depth < max_depth):
        size = np.bincount(node, minlength=len(ids))
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        draws = np.argsort(rng.random((len(ids), width)), axis=1)[:, :tried] if tried < width else None
        best, band, cut = np.full(len(ids), -np.inf), np.full(len(ids), -1), np.zeros(len(ids))
        for k in range(tried):
            b = np.full(len(ids), k) if draws is None else draws[:, k]
            mine = b[node]
            order = np.argsort(node * n + place[at, mine])  # rows by node and along the node's band
            row, own = at[order], node[order]
            v = x[row, b[own]]
            sums = np.cumsum(t[row], axis=0)
            before = sums[start] - t[row][start]
            left = sums - before[own]
            whole = (sums[start + size - 1] - before)[own]
            count = np.arange(len(row)) - start[own] + 1
            rest = size[own] - count
            fine = np.concatenate([(own[:-1] == own[1:]) & (v[:-1] < v[1:]), [False]]) & (count >= least) & (rest >= least)
            gain = np.where(fine, (left**2).sum(axis=1) / count + ((whole - left) ** 2).sum(axis=1) / np.maximum(rest, 1), -np.inf)
            top = np.maximum.reduceat(gain, start)
            better = top > best
            first = np.full(len(ids), len(row))
            hit = np.flatnonzero(fine & (gain == top[own]))
            np.minimum.at(first, own[hit], hit)
            p = first[better]
            best[better], band[better] = top[better], b[better]
            mid = v[p] + (v[p + 1] - v[p]) / 2
            cut[better] = np.where(mid < v[p + 1], mid, v[p])
        # a node of one value is a leaf
        order = np.argsort(node, kind="stable")
        low, high = (f.reduceat(t[at[order]], start, axis=0) for f in (np.minimum, np.maximum))
        split = (band >= 0) & (low < high).any(axis=1)
        keep = split[node]
        at, node = at[keep], node[keep]
        side = x[at, band[node]] > cut[node]
        number = np.cumsum(split) - 1
        node = 2 * number[node] + side
        parents = np.flatnonzero(split)
        if not len(parents):
            break
        order = np.argsort(node, kind="stable")
        size = np.bincount(node, minlength=2 * len(parents))
        mean = np.add.reduceat(t[at[order]], np.concatenate([[0], np.cumsum(size)[:-1]]), axis=0) / size[:, None]
        base = len(made)
        for i, p in enumerate(parents):
            made[ids[p]][:4] = [int(band[p]), float(cut[p]), base + 2 * i, base + 2 * i + 1]
        made += [[-1, 0.0, -1, -1, *m] for m in mean]
        ids, depth = base + np.arange(2 * len(parents)), depth + 1
    return np.array(made, float)


def random_forest(train: DataFrame, y: str | None = None, n_estimators: int = 100, max_depth: int | None = None, max_features: str | float | None = None, min_samples_leaf: int = 1, seed: int = 42) -> Model:
    """Bootstrapped trees with exact best cuts (Breiman, 2001) on all training rows, without a bound on depth. Trees are tasks."""
    share = max_features or ("all" if y else "sqrt")
    grow = lambda x, t, i: _best_tree(x, t, np.random.default_rng([seed, i]), max_depth, _tried(share, x.shape[1]), min_samples_leaf)
    return _grown("random_forest_regressor" if y else "random_forest_classifier", train, y, n_estimators, grow)


CLASSIFIERS = ("logistic_regression", "svm", "linear_svm", "lda", "qda", "gaussian_nb", "random_forest_classifier", "extra_trees_classifier", "gradient_boosting_classifier", "knn_classifier", "pls_da", "simca", "mlp_classifier", "proto_spectral_classifier")
REGRESSORS = ("plsr", "pcr", "linear_regression", "ridge", "lasso", "elastic_net", "bayesian_ridge", "knn_regressor", "random_forest_regressor", "extra_trees_regressor", "gradient_boosting_regressor", "svr", "gpr", "proto_spectral_regressor")


def fit_model(train: DataFrame, name: str, y: str | None = None, **params) -> Model:
    """Fit a model of the registry; parameters by plain, ``model__`` or ``model_`` names."""
    name = ALIASES.get(name, name)
    if name in GATED:
        needs(GATED[name], name)
    p = resolve_parameters(name, params)
    plain = {"svm": svm, "lda": lda, "qda": qda, "gaussian_nb": gaussian_nb, "pls_da": pls_da, "simca": simca, "proto_spectral_classifier": prototypes}
    target = {"plsr": plsr, "pcr": pcr, "ridge": ridge, "elastic_net": elastic_net, "bayesian_ridge": bayesian_ridge, "svr": svr, "gpr": gpr, "proto_spectral_regressor": prototype_regressor}
    if name in plain:
        return plain[name](train, **p)
    if name in target:
        return target[name](train, y=y or "y", **p)
    if name == "linear_regression":
        require(p.get("fit_intercept", True), "INTERCEPT", "a line without an intercept isn't offered")
        return ridge(train, alpha=0.0, y=y or "y")
    if name == "lasso":
        return elastic_net(train, l1_ratio=1.0, y=y or "y", **p)
    if name in ("extra_trees_classifier", "extra_trees_regressor"):
        return extra_trees(train, (y or "y") if name == "extra_trees_regressor" else None, **p)
    if name in ("random_forest_classifier", "random_forest_regressor"):
        return random_forest(train, (y or "y") if name == "random_forest_regressor" else None, **p)
    if name in ("knn_classifier", "knn_regressor"):
        return _knn_model(train, (y or "y") if name == "knn_regressor" else None, **p)
    if name in CLASSIFIERS:
        return _classifier(name, train, p)
    if name in REGRESSORS:
        return _regressor(name, train, p, y or "y")
    raise BandloomError("UNKNOWN_MODEL", f"{name} isn't in the registry", model=name)


def resolve_parameters(name: str, params: dict) -> dict:
    """Parameters by plain name, or with the name of a step (``model__``, ``pca__``) or of the stage (``model_``) before it."""
    known = {*GRIDS.get(name, {}), *FURTHER.get(name, ())}
    out = {}
    for key, value in params.items():
        plain = key.split("__")[-1]
        plain = plain if plain in known else plain.removeprefix("model_")
        require(plain in known, "UNKNOWN_PARAMETER", f"{name} has no parameter {key}", known=sorted(known))
        out[plain] = value
    return out


def grid(name: str, rows: int | None = None, bands: int | None = None) -> list[dict]:
    """Every point of a model's grid that so many training rows and bands allow, in the order of its lists."""
    out: list[dict] = [{}]
    most = {"n_neighbors": rows, "n_components": min(rows - 1 if rows else 10, bands or 10, 10)}
    for key, values in GRIDS[ALIASES.get(name, name)].items():
        bound = most.get(key)
        fit = list(dict.fromkeys(min(v, max(1, bound)) for v in values)) if bound and key == "n_components" else [v for v in values if not bound or v <= bound] or values[:1]
        out = [{**p, key: v} for p in out for v in fit]
    return out


def select_candidate(df: DataFrame, name: str, y: str | None = None) -> tuple[dict, Model]:
    """The grid point that is best on rows with role 'val' (macro F1, or RMSE), fitted on train; the first of equals."""
    from . import metrics

    train, val = df.where("role = 'train'"), df.where("role = 'val'")
    best = None
    size = train.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("p")).first()
    for p in grid(name, size["n"], size["p"]):
        m = fit_model(train, name, y, **p)
        pred = m.predict(val)
        if y:
            score = -metrics.regression(pred.withColumn("y_true", F.col(y))).first()["rmse"]
        else:
            score = metrics.classification(pred.withColumn("y_true", F.col("label").cast("string"))).first()["macro_f1"]
        if best is None or score > best[0]:
            best = (score, p, m)
    return best[1], best[2]


def prototype_votes(train: DataFrame, df: DataFrame) -> DataFrame:
    """Nearest class mean in columns alone: (sample_idx, y_pred), ties to the lower class."""
    from .joins import class_distances

    near = F.row_number().over(Window.partitionBy("sample_idx").orderBy("distance", "other"))
    return class_distances(train, df).withColumn("r", near).where("r = 1").select("sample_idx", F.col("other").alias("y_pred"))
