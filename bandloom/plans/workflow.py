"""The driver of a whole analysis: package or spectra in, metrics out, with the gates between the stages."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import confirm, require
from ..operators import metrics, quality, split
from ..operators.model import fit_model
from ..operators.preprocess import preprocess
from ..operators.evaluate import auto_model
from ..operators.search import _feature, recommend

#: Names of goals.
GOALS = {"qc": "quality", "quality": "quality", "check": "quality", "split": "split", "preprocess": "preprocess", "feature": "feature", "model": "model", "modeling": "model", "train": "model", "classification": "model", "regression": "model"}
AUTO_REGRESSION = ("plsr", "ridge", "pcr")
STAGES = ("quality", "split", "preprocess", "feature", "model")


@dataclass
class Analysis:
    """What each stage left: frames by name, warnings, and confirmations that were given."""

    frames: dict[str, DataFrame] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    decisions: dict[str, object] = field(default_factory=dict)


def run(df: DataFrame, goal: str = "model", *, y: str | None = None, ratio: str = "7:1:2", method: str = "random", chain: tuple[str, ...] = ("snv",), feature: str = "none", model: str = "pls_da", evaluate_test: bool = False, clean_ok: bool = False, conflict_ok: bool = False, **options) -> Analysis:
    """Stages in order, up to the goal. Test rows are scored only if that is confirmed.

    Equal spectra with different labels block the stages after quality until that is accepted. With the
    model ``auto``, the models that suit the table's size are searched on validation rows.
    """
    goal = GOALS.get(goal.lower(), goal.lower())
    require(goal in STAGES, "GOAL", "an unknown goal", goal=goal)
    shares = split.parse_ratio(ratio)
    out = Analysis(decisions={"goal": goal, "ratio": ratio, "evaluate_test": evaluate_test})
    found = quality.exact_duplicates(df)
    out.frames["duplicates"] = found
    conflict = bool(found.where("label_conflict").limit(1).count())
    out.decisions["qc_status"] = "blocked" if conflict else "warning" if found.limit(1).count() else "passed"
    confirm(goal == "quality" or not conflict or conflict_ok, "QC_BLOCKED", "equal spectra have different labels; later stages wait for a decision")
    if clean_ok:
        df = quality.drop_duplicates(df, conflict_ok=conflict_ok)
    out.frames["outliers"] = quality.intensity_outliers(df, "ROBUST_ZSCORE")
    if goal == "quality":
        return out
    made = {"random": split.random_split, "stratified": split.stratified_split}[method](df, shares)
    split.require_complete(df, made)
    df = df.drop("role").join(made, "sample_idx")
    out.frames["split"] = made
    if goal == "split":
        return out
    width = df.select(F.size("x").alias("p")).first()["p"]
    df, warnings = preprocess(df, list(chain), width=width, **options)
    out.warnings += warnings
    out.frames["preprocessed"] = df
    if goal == "preprocess":
        return out
    df = _feature(df, feature, y)
    out.frames["features"] = df
    if goal == "feature":
        return out
    if model == "auto":
        size = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("p")).first()
        names = list(AUTO_REGRESSION) if y else recommend(size["n"], size["p"])["models"]
        model, fitted = auto_model(df, names, y)
    else:
        fitted = fit_model(df.where("role = 'train'"), model, y)
    out.decisions["model"] = model
    truth = (lambda d: d.withColumn("y_true", F.col(y))) if y else (lambda d: d.withColumn("y_true", F.col("label").cast("string")))
    measure = metrics.regression if y else metrics.classification
    out.frames["predictions"] = truth(fitted.predict(df.where("role = 'val'")))
    out.frames["metrics"] = measure(out.frames["predictions"])
    if evaluate_test:
        out.frames["test_metrics"] = measure(truth(fitted.predict(df.where("role = 'test'"))))
    return out


def log_test_access(log: DataFrame, run_id: str, *, confirmatory: bool = False) -> DataFrame:
    """The append-only log with this access; another look at the test rows must be called confirmatory."""
    n = log.where(F.col("run_id") == run_id).count()
    confirm(n == 0 or confirmatory, "TEST_ACCESS", "the test rows were looked at before", times=n)
    return log.unionByName(log.sparkSession.createDataFrame([(run_id, n + 1, confirmatory)], "run_id string, access int, confirmatory boolean"))
