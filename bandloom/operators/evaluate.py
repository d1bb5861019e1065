"""Evaluation over folds and repeats: fits by iteration, scores of all of them, comparison of models, and stability.

Iterations come as the long splits of ``split``: (iteration_id, role, sample_idx). Every fit sees the
training rows of its iteration only. Fits run side by side as Spark jobs; the predictions of all
iterations and models are one table, so that their metrics are one grouped aggregate.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BandloomError, confirm, require
from ..functions import shared
from . import metrics
from .feature import semantics
from .model import Model, fit_model, select_candidate

#: Iterations that an evaluation fits one by one.
MAX_ITERATIONS = 500


def iterations(splits: DataFrame) -> list:
    ids = [r["iteration_id"] for r in splits.select("iteration_id").distinct().orderBy("iteration_id").limit(MAX_ITERATIONS + 1).collect()]
    require(0 < len(ids) <= MAX_ITERATIONS, "ITERATIONS", "an evaluation needs iterations, and not more than its bound", bound=MAX_ITERATIONS)
    return ids


def match_iterations(data: DataFrame, splits: DataFrame) -> None:
    """Data by iteration and splits must name the same iterations."""
    a, b = (d.select("iteration_id").distinct() for d in (data, splits))
    lost = [r["iteration_id"] for r in a.join(b, "iteration_id", "left_anti").unionByName(b.join(a, "iteration_id", "left_anti")).limit(20).collect()]
    require(not lost, "ITERATION_MISMATCH", "data and splits have different iterations", iterations=lost)


def feature_gate(method: str, *, agreed: bool = False) -> None:
    """Features for looking at only must not be modelled; manifold features only if that is agreed."""
    gate = semantics(method)["modeling"]
    require(gate != "blocked", "VISUAL_ONLY", f"{method} is for looking at and can't be modelled", method=method)
    confirm(gate != "consent" or agreed, "MANIFOLD_CONSENT", f"modelling {method} features must be agreed to", method=method)


def of_iteration(df: DataFrame, splits: DataFrame, iteration) -> DataFrame:
    """The rows of one iteration with their role; data that holds all iterations is cut to its own."""
    own = splits.where(F.col("iteration_id") == F.lit(iteration)).select("sample_idx", "role")
    data = df.where(F.col("iteration_id") == F.lit(iteration)).drop("iteration_id") if "iteration_id" in df.columns else df
    return data.drop("role").join(own, "sample_idx")


def eval_role(splits: DataFrame) -> str:
    """``test`` where an iteration has test rows (repeats), else ``val`` (folds)."""
    roles = {r["role"] for r in splits.select("role").distinct().collect()}
    role = "test" if "test" in roles else "val"
    require(role in roles, "EVAL_SPLIT_EMPTY", "iterations need rows to evaluate", roles=sorted(roles))
    return role


def cross_validate(df: DataFrame, splits: DataFrame, models: list[str], y: str | None = None, *, parameters: dict[str, dict] | None = None, search: bool = False, prepare: Callable[[DataFrame], DataFrame] | None = None, parallel: int = 4) -> tuple[DataFrame, DataFrame]:
    """(predictions, metrics by model and iteration) of each model, fitted anew in each iteration.

    ``prepare`` is fitted and applied inside each iteration. With ``search``, a model's grid is searched
    on the validation rows of iterations that have test rows; otherwise given parameters hold.
    """
    splits = shared.stored(splits.select("iteration_id", "role", "sample_idx"), "splits")
    role = eval_role(splits)
    require(not search or role == "test", "SEARCH_WITHOUT_VAL", "a search inside iterations needs validation rows beside the test rows")

    def one(job):
        iteration, name = job
        data = of_iteration(df, splits, iteration)
        data = prepare(data) if prepare else data
        require(bool(data.where(F.col("role") == role).limit(1).count()), "EVAL_SPLIT_EMPTY", "an iteration has no rows to evaluate", iteration=iteration)
        fitted = select_candidate(data, name, y)[1] if search else fit_model(data.where("role = 'train'"), name, y, **(parameters or {}).get(name, {}))
        truth = F.col(y) if y else F.col("label").cast("string")
        return fitted.predict(data.where(F.col("role") == role)).select(F.lit(name).alias("model"), F.lit(iteration).alias("iteration_id"), "sample_idx", truth.alias("y_true"), "y_pred")

    jobs = [(i, m) for i in iterations(splits) for m in models]
    with ThreadPoolExecutor(parallel) as pool:
        predictions = reduce(DataFrame.unionByName, pool.map(one, jobs))
    measure = metrics.regression if y else metrics.classification
    return predictions, measure(predictions, "model", "iteration_id")


def compare(by_iteration: DataFrame, y: bool = False) -> DataFrame:
    """Mean, deviation and rank of each model over its iterations."""
    names = ("r2", "rmse", "mae", "rpd") if y else ("macro_f1", "accuracy", "balanced_accuracy")
    return metrics.summary(by_iteration, "model", *names)


def stability(df: DataFrame, splits: DataFrame, ranked: DataFrame, y: str | None = None, *, top: int = 3, parallel: int = 4) -> DataFrame:
    """The best trials of a search again over repeated splits: mean and deviation of the metric, and how often each one won.

    ``ranked`` holds rank, trial_id, preprocess, feature and model; ties of an iteration go to the lower trial.
    """
    from .preprocess import preprocess
    from .search import _feature

    width = df.select(F.size("x").alias("p")).first()["p"]
    best = ranked.where(F.col("rank") <= top).orderBy("rank").collect()  # top rows
    metric = "r2" if y else "macro_f1"
    out = None
    for r in best:
        prepare = lambda d, r=r: _feature(preprocess(d, [r["preprocess"]], width=width, window_length=7, polyorder=2)[0], r["feature"], y)
        _, scores = cross_validate(df, splits, [r["model"]], y, prepare=prepare, parallel=parallel)
        scores = scores.select(F.lit(r["trial_id"]).alias("trial_id"), "iteration_id", F.col(metric).alias("score"))
        out = scores if out is None else out.unionByName(scores)
    won = out.groupBy("iteration_id").agg(F.max_by("trial_id", F.struct("score", -F.xxhash64("trial_id"))).alias("trial_id")).groupBy("trial_id").agg(F.count(F.lit(1)).alias("wins"))
    means = out.groupBy("trial_id").agg(F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("std"), F.count(F.lit(1)).alias("iterations"))
    return means.join(won, "trial_id", "left").na.fill(0, ["wins"])


def auto_model(df: DataFrame, names: list[str], y: str | None = None) -> tuple[str, Model]:
    """The model whose best grid point does best on the validation rows; the first of equals. Models that can't be fitted are passed over."""
    truth = F.col(y) if y else F.col("label").cast("string")
    found = None
    for name in names:
        try:
            _, fitted = select_candidate(df, name, y)
        except BandloomError:
            continue
        pred = fitted.predict(df.where("role = 'val'")).withColumn("y_true", truth)
        score = -metrics.regression(pred).first()["rmse"] if y else metrics.classification(pred).first()["macro_f1"]
        if found is None or score > found[0]:
            found = (score, name, fitted)
    require(found is not None, "NO_MODEL", "none of the models could be fitted", models=names)
    return found[1], found[2]
