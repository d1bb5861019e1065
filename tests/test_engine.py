"""The spectra engine: golden values, invariants, gates, and every SQL query against DuckDB on the smallest tables."""

import collections

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom import catalog, errors
from bandloom.functions import kernels
from bandloom.operators import feature, metrics, model, preprocess, project, quality, search, split
from bandloom.sources import text

SF = "/root/testdata/sf0.001"


def frame(spark, rows, label="A"):
    return spark.createDataFrame([(i, label, [float(v) for v in r]) for i, r in enumerate(rows)], "sample_idx long, label string, x array<double>")


def values(df):
    return np.array([r["x"] for r in df.orderBy("sample_idx").collect()])


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v)
    return repr(v) if v is None or isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = collections.Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == collections.Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_snv_rows_have_mean_zero_and_deviation_one(spark):
    out = values(frame(spark, [[1, 2, 4, 9], [5, 1, 2, 2]]).withColumn("x", preprocess.snv(F.col("x"))))
    assert np.allclose(out.mean(axis=1), 0) and np.allclose(out.std(axis=1), 1)


def test_constant_spectrum_raises(spark):
    with pytest.raises(Exception, match="SNV_ZERO_VARIANCE"):
        frame(spark, [[2, 2, 2]]).withColumn("x", preprocess.snv(F.col("x"))).collect()


def test_fit_uses_training_rows_only(spark):
    rows = [[i + j for j in range(5)] for i in range(6)]
    df = frame(spark, rows).withColumn("role", F.when(F.col("sample_idx") < 5, "train").otherwise("test"))
    changed = df.withColumn("x", F.when(F.col("role") == "test", F.transform("x", lambda v: v * 100)).otherwise(F.col("x")))
    a, b = (preprocess.fit_bands(d.where("role = 'train'")).first() for d in (df, changed))
    assert a == b and a["mean"] == [2.0, 3.0, 4.0, 5.0, 6.0]


def test_minmax_training_rows_span_the_unit_interval(spark):
    df = frame(spark, [[0, 10], [5, 20], [10, 30]]).withColumn("role", F.lit("train"))
    out = values(preprocess.preprocess(df, ["minmax_scaling"])[0])
    assert out.min() == 0 and out.max() == 1


def test_msc_of_scaled_reference_is_the_reference(spark):
    df = frame(spark, [[1, 2, 3, 5], [2, 4, 6, 10], [4, 7, 10, 16]]).withColumn("role", F.lit("train"))
    out = values(preprocess.preprocess(df, ["msc"])[0])
    assert np.allclose(out, out[0])


def test_gates(spark):
    df = frame(spark, [[1, 2, 3], [2, 1, 4]])
    with pytest.raises(errors.NeedsConfirmation):
        preprocess.preprocess(df, ["mean_centering"])
    with pytest.raises(errors.NeedsConfirmation):
        preprocess.preprocess(df, ["linear_baseline"])
    with pytest.raises(errors.BandloomError):
        preprocess.normalise(["wavelet"])
    with pytest.raises(errors.DependencyMissing):
        feature.fit_feature(df, "umap_embedding", unsplit_ok=True)
    with pytest.raises(errors.NeedsConfirmation):
        split.parse_ratio("6:2:")
    with pytest.raises(errors.NeedsConfirmation):
        search.audit_budget(search.trials(spark, search.SPACES["pipeline"]))
    assert preprocess.normalise(["snv", "msc"])[1] == ["SNV_WITH_MSC"]


def test_kernels():
    x = np.arange(20.0) ** 2
    assert np.allclose(kernels.savgol(20, 7, 2) @ x, x)
    assert np.allclose(kernels.savgol(20, 7, 2, 1) @ x, 2 * np.arange(20))
    assert np.allclose(kernels.polynomial_residual(20, 2) @ x, 0, atol=1e-8)
    assert np.allclose(kernels.gaussian(20) @ np.ones(20), 1)
    assert np.allclose(kernels.dct(8, 8) @ kernels.dct(8, 8).T, np.eye(8))
    hat = kernels.rubberband(np.array([0.0, 3, 1, 5, 2]))
    assert hat.min() >= -1e-12 and hat[0] == hat[-1] == 0
    base = np.linspace(1, 3, 60)
    peak = base + np.exp(-0.5 * ((np.arange(60) - 30) / 2) ** 2)
    left = kernels.als(peak[None])[0]
    w = np.ones(60)
    d = np.diff(np.eye(60), 2, axis=0)
    for _ in range(10):
        z = np.linalg.solve(np.diag(w) + 1e5 * d.T @ d, w * peak)
        w = np.where(peak > z, 1e-3, 1 - 1e-3)
    assert np.allclose(left, peak - z, atol=1e-6)


def test_allocate():
    assert split.allocate(10, split.parse_ratio("6:2:2")) == [6, 2, 2]
    assert split.allocate(5, split.parse_ratio("8:1:1")) == [3, 1, 1]
    assert sum(split.allocate(101, split.parse_ratio("7:1:2"))) == 101


def test_splits_cover_every_sample(spark):
    df = frame(spark, np.random.default_rng(1).standard_normal((40, 4))).withColumn("label", F.when(F.col("sample_idx") % 4 == 0, "B").otherwise("A"))
    for made in (split.random_split(df, [0.7, 0.3]), split.stratified_split(df, [0.6, 0.2, 0.2]), split.kennard_stone(df, [0.5, 0.25, 0.25]), split.duplex(df, [0.5, 0.5])):
        split.require_complete(df, made)
    folds = split.stratified_kfold(df, 5).where("role = 'val'")
    assert folds.count() == 40 and folds.select("sample_idx").distinct().count() == 40


def test_kennard_stone_starts_with_the_farthest_pair(spark):
    df = frame(spark, [[0.0], [1.0], [2.0], [10.0], [5.0]])
    train = {r["sample_idx"] for r in split.kennard_stone(df, [0.6, 0.4]).where("role = 'train'").collect()}
    assert train == {0, 3, 4}


def test_spikes_single_and_flat(spark):
    flat = [[1.0] * 20 for _ in range(3)]
    flat[0][10] = 8.0
    got = quality.spikes(frame(spark, flat)).collect()
    assert [(r["sample_idx"], r["band"], r["score"]) for r in got] == [(0, 10, 999.0)]


def test_label_conflict_blocks(spark):
    df = frame(spark, [[1, 2], [1, 2], [3, 4]]).withColumn("label", F.col("sample_idx").cast("string"))
    with pytest.raises(errors.BandloomError, match="LABEL_CONFLICT"):
        quality.drop_duplicates(df)


def test_pca_distances_against_numpy(spark):
    x = np.random.default_rng(2).standard_normal((60, 8))
    got = quality.pca_distances(frame(spark, x), 3).orderBy("sample_idx").collect()
    c = x - x.mean(axis=0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    t = c @ vt[:3].T
    assert np.allclose([r["t2"] for r in got], (t**2 / (s[:3] ** 2 / 59)).sum(axis=1))
    assert np.allclose([r["q"] for r in got], ((c - t @ vt[:3]) ** 2).sum(axis=1))


def test_pls_fits_a_linear_target(spark):
    x = np.random.default_rng(3).standard_normal((50, 4))
    m = feature.nipals(x, (x @ [1.0, -2, 0.5, 0])[:, None], 4)
    assert np.allclose(feature.pls_predict(m, x)[:, 0], x @ [1.0, -2, 0.5, 0])


@pytest.mark.parametrize("name", ["plsr", "pcr", "linear_regression", "ridge", "bayesian_ridge", "elastic_net", "gpr"])
def test_regressors_learn(spark, name):
    x = np.random.default_rng(4).standard_normal((80, 3))
    df = frame(spark, x).withColumn("y", F.col("x")[0] * 2 - F.col("x")[1])
    pred = model.fit_model(df, name, "y").predict(df).withColumn("y_true", F.col("y"))
    assert metrics.regression(pred).first()["r2"] > 0.9


@pytest.mark.parametrize("name", ["lda", "qda", "gaussian_nb", "pls_da", "simca", "svm", "knn_classifier", "logistic_regression", "proto_spectral_classifier"])
def test_classifiers_separate(spark, name):
    rng = np.random.default_rng(5)
    rows = [(i, "ab"[i % 2], [float(v) for v in rng.standard_normal(3) + 4 * (i % 2)]) for i in range(60)]
    df = spark.createDataFrame(rows, "sample_idx long, label string, x array<double>")
    pred = model.fit_model(df, name).predict(df).withColumn("y_true", F.col("label"))
    assert metrics.classification(pred).first()["accuracy"] >= 0.95


def test_unknown_parameter_and_gated_model(spark):
    df = frame(spark, [[1, 2]])
    with pytest.raises(errors.BandloomError, match="UNKNOWN_PARAMETER"):
        model.fit_model(df, "ridge", "y", nonsense=1)
    with pytest.raises(errors.DependencyMissing):
        model.fit_model(df, "xgboost_classifier")


def test_header_rules():
    assert text.sniff_delimiter(["a;b;c", "1,5;2;3"]) == ";"
    assert text.header_row(["# x", "sample_id,900 nm,910 nm,class", "s1,1,2,A"], ",") == 1
    assert text.flatten_header([["a", "", "b"], ["x", "", "x"]]) == ["x", "column_1", "x_2"]
    assert project.column_range(["id", "900", "910.0", "920"], "900..910") == ["900", "910.0"]
    assert project.band_indices("1,3:5,7-6", 8) == [1, 3, 4, 5, 7, 6]
    names, unit = project.numeric_block([f"{900 + i}" for i in range(60)] + ["class"])
    assert len(names) == 60 and unit == "nm"
    with pytest.raises(errors.NeedsConfirmation):
        project.infer(["id", "sample_id", "900"])


def test_strict_cells(spark):
    df = spark.createDataFrame([(0, "s", "1", "bad")], "_row long, sample_id string, `900` string, `910` string")
    with pytest.raises(Exception, match="NON_NUMERIC_CELL"):
        project.project(df, project.infer(["sample_id", "900", "910"])).collect()


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
