"""Saved pipelines: a fitted preprocessing chain, features and a model in one folder, to be loaded and applied later.

Fitted statistics are JSON, NumPy models are pickled by value with their arrays, MLlib models are
saved by MLlib, neighbours keep their training rows as a table. A bundle is code to whoever loads it:
load none that you don't trust.
"""

from __future__ import annotations

import io
import json
from dataclasses import dataclass, field

import numpy as np
from pyspark import cloudpickle
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import require
from ..operators import model as M
from ..operators.feature import Projection
from ..operators.preprocess import FITTED, METHODS, apply_fitted, fit_bands, normalise
from .package import exists, read_json, write_json

VERSION = 1


@dataclass
class Chain:
    """Preprocessing methods with the statistics that their training rows gave, and the parameters."""

    methods: list[str]
    statistics: list[dict | None]
    parameters: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        for method, stats in zip(self.methods, self.statistics):
            if method in FITTED:
                names = list(stats)
                one = df.sparkSession.createDataFrame([[stats[n] for n in names]], ", ".join(f"{n} array<double>" for n in names))
                df = apply_fitted(df, one, method)
            elif METHODS[method] is not None:
                df = df.withColumn("x", METHODS[method](F.col("x"), self.parameters))
        return df


def fit_chain(train: DataFrame, methods: list[str], **parameters) -> Chain:
    """A chain fitted on training rows; band selections aren't part of a chain (they change the axis)."""
    order, _ = normalise(methods)
    require(not {"band_range_select", "remove_band_ranges"} & set(order), "CHAIN_BANDS", "select bands before fitting a chain")
    chain = Chain([], [], {"width": train.select(F.size("x").alias("p")).first()["p"], **parameters})
    for method in order:
        stats = None
        if method in FITTED:
            row = fit_bands(chain.transform(train), quantiles=method == "robust_scaling").first()
            stats = {k: [float(v) for v in row[k]] for k in row.asDict()}
        chain.methods.append(method)
        chain.statistics.append(stats)
    return chain


@dataclass
class Bundle:
    """Everything between raw spectra and predictions."""

    chain: Chain
    model: M.Model
    projection: Projection | None = None
    meta: dict = field(default_factory=dict)

    def predict(self, df: DataFrame) -> DataFrame:
        out = self.chain.transform(df)
        return self.model.predict(self.projection.transform(out) if self.projection else out)


def fit_bundle(df: DataFrame, *, chain: list[str] = ("none",), feature: str | None = None, model: str, y: str | None = None, feature_parameters: dict | None = None, parameters: dict | None = None, **options) -> Bundle:
    """Fitted on the rows with role ``train``."""
    from ..operators.evaluate import feature_gate
    from ..operators.feature import fit_feature

    train = df.where("role = 'train'")
    fitted = fit_chain(train, list(chain), **options)
    made = fitted.transform(train)
    projection = None
    if feature and feature != "none":
        feature_gate(feature)
        projection = fit_feature(made, feature, **(feature_parameters or {}))
        made = projection.transform(made)
    return Bundle(fitted, M.fit_model(made, model, y, **(parameters or {})), projection, {"model": model, "feature": feature or "none", "y": y})


def _bytes(spark: SparkSession, path: str, content: bytes) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(content))
    out.close()


def save(spark: SparkSession, bundle: Bundle, path: str, *, overwrite: bool = False) -> None:
    require(overwrite or not exists(spark, path), "EXISTS", "the folder exists", path=path)
    m, kind = bundle.model, "numpy"
    if m.kernel is not None:
        buffer = io.BytesIO()
        buffer.write(cloudpickle.dumps({"name": m.name, "kernel": m.kernel, "state": m.state, "kind": m.label}))
        _bytes(spark, f"{path}/model.pickle", buffer.getvalue())
    elif "trees" in m.state:
        kind = "forest"
        m.state["trees"].write.mode("overwrite").parquet(f"{path}/trees")
        about = {k: v for k, v in m.state.items() if k not in ("trees", "forest")}
        _bytes(spark, f"{path}/model.pickle", cloudpickle.dumps({"name": m.name, "said": m.state["forest"], "state": about, "kind": m.label}))
    elif "factor" in m.state:
        kind = "process"
        m.state["factor"].write.mode("overwrite").parquet(f"{path}/factor")
        _bytes(spark, f"{path}/model.pickle", cloudpickle.dumps(m.state["process"]))
    elif "train" in m.state:
        kind = "neighbours"
        m.state["train"].write.mode("overwrite").parquet(f"{path}/train")
    else:
        kind = "mllib"
        m.state["model"].write().overwrite().save(f"{path}/mllib")
    if bundle.projection:
        _bytes(spark, f"{path}/projection.pickle", cloudpickle.dumps(bundle.projection))
    plain = {k: v for k, v in m.state.items() if k in ("classes", "mean", "std", "parameters") and kind not in ("numpy", "forest")}
    plain = json.loads(json.dumps(plain, default=lambda v: v.tolist() if isinstance(v, np.ndarray) else v.item()))
    write_json(spark, f"{path}/bundle.json", {"version": VERSION, "kind": kind, "name": m.name, "state": plain, "chain": bundle.chain.__dict__, "projection": bundle.projection is not None, "meta": bundle.meta})


def load(spark: SparkSession, path: str) -> Bundle:
    about = read_json(spark, f"{path}/bundle.json")
    require(about["version"] == VERSION, "BUNDLE_VERSION", "this bundle was written by another version", version=about["version"])
    read = lambda name: bytes(spark.read.format("binaryFile").load(f"{path}/{name}").select("content").first()[0])
    if about["kind"] == "numpy":
        got = cloudpickle.loads(read("model.pickle"))
        model = M._numpy(got["name"], got["kernel"], got["state"], got["kind"])
    elif about["kind"] == "forest":
        got = cloudpickle.loads(read("model.pickle"))
        said, n = got["said"]
        model = M._forest_model(got["name"], spark.read.parquet(f"{path}/trees"), n, said, got["state"], got["kind"])
    elif about["kind"] == "process":
        model = M._gpr_model(spark.read.parquet(f"{path}/factor"), cloudpickle.loads(read("model.pickle")))
    elif about["kind"] == "neighbours":
        model = M._knn_model(spark.read.parquet(f"{path}/train"), **about["state"]["parameters"])
    else:
        fitted = DefaultParamsReader.loadParamsInstance(f"{path}/mllib", spark.sparkContext)
        model = M._mllib_model(about["name"], fitted, about["state"]["mean"], about["state"]["std"], about["state"].get("classes"))
    projection = cloudpickle.loads(read("projection.pickle")) if about["projection"] else None
    return Bundle(Chain(**about["chain"]), model, projection, about["meta"])
