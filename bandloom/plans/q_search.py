"""Queries of pipeline search, the workflow and streaming inference."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import layout
from ..functions.shared import scratch
from ..functions.spectral import r6
from ..operators import search as S
from ..registry import query
from ..streaming import inference
from . import workflow

_SPACE = S.SPACES["pipeline"]
_UNNEST = ", ".join(f"(SELECT unnest({v!r}) AS {k}, unnest(range({len(v)})) AS {k}_i)" for k, v in _SPACE.items())


@query("trial_grid", f"SELECT 'trial_' || lpad(((preprocess_i * 6 + feature_i) * 4 + model_i + 1)::VARCHAR, 4, '0') AS trial_id, preprocess, feature, model FROM {_UNNEST}")
def trial_grid(spark, sf):
    rows = S.trials(spark, _SPACE)
    assert S.audit_budget(rows, 30, agreed=True) == 72
    return rows


@query("trial_best", "WITH t AS (SELECT 'trial_' || lpad(p_partkey::VARCHAR, 4, '0') AS trial_id, CASE p_size % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'snv' ELSE 'msc' END AS preprocess, CASE p_size % 2 WHEN 0 THEN 'none' ELSE 'pca' END AS feature, floor(p_retailprice / 50) AS f, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size % 4 END AS e FROM part) SELECT trial_id, (row_number() OVER (ORDER BY f DESC, e ASC NULLS LAST, CASE WHEN preprocess = 'none' THEN 0 ELSE 1 END, CASE preprocess WHEN 'none' THEN 1 WHEN 'snv' THEN 4 ELSE 5 END, CASE WHEN feature = 'none' THEN 0 ELSE 1 END, trial_id))::INT AS rank FROM t")
def trial_best(spark, sf):
    p = layout.table(spark, sf, "part")
    pick = lambda c, *v: F.element_at(F.array(*(F.lit(x) for x in v)), (c + 1).cast("int"))
    error = F.when(F.col("p_partkey") % 5 != 0, (F.col("p_size") % 4).cast("double"))
    rows = p.select(F.concat(F.lit("trial_"), F.when(F.length(F.col("p_partkey").cast("string")) >= 4, F.substring(F.col("p_partkey").cast("string"), 1, 4)).otherwise(F.lpad(F.col("p_partkey").cast("string"), 4, "0"))).alias("trial_id"), pick(F.col("p_size") % 3, "none", "snv", "msc").alias("preprocess"), pick(F.col("p_size") % 2, "none", "pca").alias("feature"), F.create_map(F.lit("macro_f1"), F.floor(F.col("p_retailprice") / 50).cast("double"), F.lit("rmse"), error).alias("metrics"), F.lit(None).cast("string").alias("error"))
    return S.best(rows, "macro_f1", ("rmse",)).select("trial_id", "rank")


@query("trial_execution")
def trial_execution(spark, sf):
    results = S.execute(layout.spectra(spark, sf), S.trials(spark, S.SPACES["compare_quick"]))
    return S.best(results, "macro_f1").select("rank", "trial_id", "preprocess", "feature", "model", r6(F.col("metrics")["macro_f1"]).alias("macro_f1"))


@query("workflow_metrics")
def workflow_metrics(spark, sf):
    a = workflow.run(layout.spectra(spark, sf), "classification", method="stratified", feature="pca", model="lda")
    return a.frames["metrics"]


@query("stream_inference", "WITH $LONG SELECT sample_idx, band, R((v - avg(v) OVER w) / stddev_pop(v) OVER w) AS v FROM cells WINDOW w AS (PARTITION BY sample_idx)")
def stream_inference(spark, sf):
    """SNV over a stream of files, drained into a table."""
    base = scratch(spark)
    layout.spectra(spark, sf).select("sample_idx", "x").repartition(3).write.parquet(f"{base}/in")
    out = inference.score_stream(spark, f"{base}/in", "sample_idx long, x array<double>", ["snv"])
    q = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    q.awaitTermination()
    return layout.to_long(spark.read.parquet(f"{base}/out"), "sample_idx").select("sample_idx", "band", r6(F.col("v")).alias("v"))
