"""Metrics from predictions as aggregates: classification, regression, confusion, AUC, uncertainty, summaries, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ranks


def confusion(pred: DataFrame, labels: list | None = None) -> DataFrame:
    """Counts of y_true by y_pred as columns, zero where none."""
    wide = pred.groupBy("y_true").pivot("y_pred", labels).agg(F.count(F.lit(1)))
    return wide.na.fill(0)


def class_counts(pred: DataFrame, *keys: str) -> DataFrame:
    """By class (and key): support, predicted and correct."""
    pairs = pred.groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    truth = pairs.groupBy(*keys, F.col("y_true").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("correct"))
    said = pairs.groupBy(*keys, F.col("y_pred").alias("label")).agg(F.sum("n").alias("predicted"))
    return truth.join(said, [*keys, "label"], "full").na.fill(0, ["support", "correct", "predicted"])


def classification(pred: DataFrame, *keys: str) -> DataFrame:
    """One row (by key): accuracy, balanced accuracy, weighted and macro precision, recall and F1."""
    c = class_counts(pred, *keys)
    p = F.when(F.col("predicted") > 0, F.col("correct") / F.col("predicted")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("correct") / F.col("support")).otherwise(0.0)
    c = c.select(*keys, "label", "support", "correct", p.alias("p"), r.alias("r"))
    c = c.withColumn("f", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))
    weighted = lambda x: F.sum(F.col(x) * F.col("support")) / F.sum("support")
    return c.groupBy(*keys).agg(
        (F.sum("correct") / F.sum("support")).alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("r"))).alias("balanced_accuracy"),
        weighted("p").alias("precision"), weighted("r").alias("recall"), weighted("f").alias("f1"), F.avg("p").alias("macro_precision"), F.avg("r").alias("macro_recall"), F.avg("f").alias("macro_f1"),
    )


def auc(scores: DataFrame, *keys: str) -> DataFrame:
    """ROC AUC (by key) of score against a 0/1 column y from rank sums; tied scores share their mean rank.

    Ranks come from counts by distinct score, so equal scores cost one row.
    """
    by = scores.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("pos"))
    summed = ranks.running(ranks.with_bucket(by, "score"), F.col("_cut"), ["score"], {"upto": F.col("n")}, *keys)
    ranked = summed.withColumn("rank", F.col("upto") - (F.col("n") - 1) / 2)
    one = ranked.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return one.select(*keys, ((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))).alias("auc"))


def auc_ovr(scores: DataFrame) -> DataFrame:
    """Weighted one-versus-rest AUC of rows (y_true, label, score), one row per sample and label."""
    one = scores.withColumn("y", F.col("y_true") == F.col("label"))
    support = one.where("y").groupBy("label").agg(F.count(F.lit(1)).alias("support"))
    return auc(one, "label").join(support, "label").agg((F.sum(F.col("auc") * F.col("support")) / F.sum("support")).alias("auc"))


def regression(pred: DataFrame, *keys: str) -> DataFrame:
    """R2, RMSE, MAE and RPD (sample deviation over RMSE) of y_true and y_pred."""
    e = F.col("y_true") - F.col("y_pred")
    rmse = F.sqrt(F.avg(e * e))
    return pred.groupBy(*keys).agg((1 - F.sum(e * e) / (F.var_pop("y_true") * F.count("y_true"))).alias("r2"), rmse.alias("rmse"), F.avg(F.abs(e)).alias("mae"), (F.coalesce(F.stddev_samp("y_true"), F.lit(0.0)) / rmse).alias("rpd"))


def uncertainty(pred: DataFrame) -> DataFrame:
    """Mean predicted deviation and the share of true values inside mean +- 1.96 deviations."""
    inside = F.col("y_true").between(F.col("y_pred") - 1.96 * F.col("y_std"), F.col("y_pred") + 1.96 * F.col("y_std"))
    return pred.agg(F.avg("y_std").alias("mean_std"), F.avg(inside.cast("double")).alias("coverage"))


def with_entropy(pred: DataFrame, probabilities: str = "probabilities") -> DataFrame:
    """Adds the largest probability and the entropy of an array of class probabilities."""
    h = F.aggregate(probabilities, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log(p)).otherwise(0.0))
    return pred.withColumn("confidence", F.array_max(probabilities)).withColumn("entropy", h)


def summary(metrics: DataFrame, by: str, *names: str) -> DataFrame:
    """Mean and sample deviation over iterations of each metric, finite values only, and a rank by the first."""
    fine = lambda n: F.when(~F.isnan(n) & (F.abs(n) < float("inf")), F.col(n))
    out = metrics.groupBy(by).agg(*(f(fine(n)).alias(f"{n}_{s}") for n in names for s, f in (("mean", F.avg), ("std", lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))))))
    return out.withColumn("rank", F.rank().over(Window.orderBy(F.desc(f"{names[0]}_mean"))))


def best_per_model(trials: DataFrame, metric: str, higher: bool = True) -> DataFrame:
    """The best candidate of each model and the models' rank; ties by candidate."""
    order = F.desc(metric) if higher else F.asc(metric)
    best = trials.withColumn("_r", F.row_number().over(Window.partitionBy("model").orderBy(order, "candidate"))).where("_r = 1").drop("_r")
    return best.withColumn("rank", F.row_number().over(Window.orderBy(order, "model")))


def roc_points(scores: DataFrame) -> DataFrame:
    """False and true positive rates at each distinct score, from the highest; a chart's data."""
    by = scores.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("pos"))
    both = ranks.running(ranks.with_bucket(by, "score", falling=True), F.col("_cut"), [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("n") - F.col("pos")})
    total = scores.agg(F.sum(F.col("y").cast("long")).alias("all_p"), F.count(F.lit(1)).alias("all_n"))
    return both.crossJoin(F.broadcast(total)).select("score", (F.col("fp") / (F.col("all_n") - F.col("all_p"))).alias("fpr"), (F.col("tp") / F.col("all_p")).alias("tpr"))
