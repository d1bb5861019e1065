"""Methods that look at all pairs of training rows, without the matrix of all pairs and without a bound on rows."""

import numpy as np
import pytest
from test_sizes import frame

from bandloom.operators import feature, model
from bandloom.sources import bundle


def column(df, name):
    return np.array([r[name] for r in df.select("sample_idx", name).orderBy("sample_idx").collect()])


@pytest.fixture
def no_whole_matrix(monkeypatch):
    """Fails where a matrix over all pairs of 200 rows (or as many as it is told) meets a dense solver of the driver, or rows are refused."""
    limit = [200]
    for name in ("eigh", "cholesky"):
        f = getattr(np.linalg, name)

        def small(a, *more, f=f, **p):
            assert len(a) < limit[0]
            return f(a, *more, **p)

        monkeypatch.setattr(np.linalg, name, small)
    for module in (feature, model):
        f = module.require

        def asked(good, code, *more, f=f, **p):
            assert not code.endswith("_ROWS") or p.get("bound", 0) > 5000
            f(good, code, *more, **p)

        monkeypatch.setattr(module, "require", asked)
    monkeypatch.setattr(feature, "PAIRS_ROWS", 100, raising=False)
    monkeypatch.setattr(model, "GPR_ROWS", 100, raising=False)
    monkeypatch.setattr(model, "GPR_CELLS", 50_000, raising=False)
    return limit


def test_kernel_pca_by_products(spark, no_whole_matrix):
    x = np.random.default_rng(7).standard_normal((230, 4))
    df = frame(spark, x)
    got = column(feature.kernel_pca(df.where("sample_idx < 200"), 3).transform(df), "x")
    d = ((x[:, None] - x[None, :200]) ** 2).sum(axis=2)
    k = np.exp(-d / 4)
    own = k[:200]
    value, vector = np.linalg.eig(own - own.mean(axis=0) - own.mean(axis=1)[:, None] + own.mean())
    best = np.argsort(-value.real)[:3]
    want = (k - k.mean(axis=1)[:, None] - own.mean(axis=0) + own.mean()) @ vector.real[:, best] / np.sqrt(value.real[best])
    assert np.abs(np.abs(got) - np.abs(want)).max() < 1e-8


def test_a_split_anchor_sends_a_class_of_windows_once(spark):
    from bandloom.llm import suffixdedup

    rng = np.random.default_rng(8)
    passage = bytes(rng.integers(97, 123, 600, dtype=np.uint8))
    texts = [passage[:450] + bytes(rng.integers(97, 123, 40, dtype=np.uint8)) for _ in range(30)]
    rows = [(5, i, 0, i, 1, 9, True, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "gram long, lk long, rk long, c1 long, copies long, shard long, split boolean, t binary").repartition(1)
    found = suffixdedup._sort_shards(df, 400, 1 << 20, 1).collect()
    marks = [r["fp"] for r in found if r["fp"] is not None]
    windows = {t[i : i + 400] for t in texts for i in range(len(t) - 399)}
    assert len(marks) == len(set(marks)) == len(windows)
    runs = {(r["c1"], r["first"]): r["last"] for r in found if r["fp"] is None}
    assert all(runs[i, 0] >= 50 for i in range(30))


def test_kernel_machines_have_no_bound_on_rows(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((5200, 2))
    df = frame(spark, x, label=np.where(x[:, 0] > 0, "a", "b"), y=x[:, 0])
    fitted = model.fit_model(df, "svm", C=0.1)
    assert (column(fitted.predict(df), "y_pred") == np.where(x[:, 0] > 0, "a", "b")).mean() > 0.97
    fitted = model.fit_model(df, "svr", "y", epsilon=1.0)
    assert np.abs(column(fitted.predict(df), "y_pred") - x[:, 0]).mean() < 0.8


def test_coordinates_are_moved_as_with_the_whole_kernel():
    from bandloom.functions import gram

    rng = np.random.default_rng(10)
    z, y = rng.standard_normal((150, 3)), rng.standard_normal(150)
    k = gram.rbf(z, z, 0.3) + 1
    b, out = np.zeros(150), np.zeros(150)
    for _ in range(20):
        for i in range(150):
            r = y[i] - out[i] + k[i, i] * b[i]
            new = float(np.clip(np.sign(r) * max(abs(r) - 0.1, 0) / k[i, i], -1, 1))
            out += (new - b[i]) * k[:, i]
            b[i] = new
    one = np.ones((150, 1))
    assert np.abs(gram.boxed(z, 0.3, y[:, None], -one, one, 0.1, 0.0, 20, block=40)[:, 0] - b).max() < 1e-9


def test_manifolds_by_products(spark, no_whole_matrix):
    no_whole_matrix[0] = 500
    t = np.random.default_rng(11).random((560, 2)) * [6, 2]
    df = frame(spark, np.column_stack([t[:, 0], t[:, 1], 0.1 * np.sin(t[:, 0])]))
    for method in (feature.isomap, feature.lle):
        got = column(method(df.where("sample_idx < 500"), 2, 10).transform(df), "x")
        best = max(abs(np.corrcoef(got[:, i], t[:, 0])[0, 1]) for i in range(2))
        assert got.shape == (560, 2) and best > (0.98 if method is feature.isomap else 0.8)


def test_a_gaussian_process_of_many_rows_is_the_closed_form(spark, no_whole_matrix, monkeypatch, tmp_path):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((260, 3))
    y = np.sin(x[:, 0]) + x[:, 1]
    df = frame(spark, x, y=y)
    monkeypatch.setattr(model.gram, "CELLS", 5000) if hasattr(model, "gram") else None
    fitted = model.fit_model(df.where("sample_idx < 200"), "gpr", "y", length_scale=2.0)
    z = (x - x[:200].mean(axis=0)) / x[:200].std(axis=0)
    k = np.exp(-((z[:, None] - z[None, :200]) ** 2).sum(axis=2) / 8)
    noise = 1e-2 + 1e-6
    inverse = np.linalg.inv(k[:200] + noise * np.eye(200))
    mean, var = y[:200].mean(), y[:200].var()
    made = fitted.predict(df)
    bundle.save(spark, bundle.Bundle(bundle.fit_chain(df, ["none"]), fitted, None, {}), f"file://{tmp_path}/bundle")
    for said in (made, bundle.load(spark, f"file://{tmp_path}/bundle").predict(df)):
        assert np.abs(column(said, "y_pred") - (k @ inverse @ (y[:200] - mean) + mean)).max() < 1e-8
        assert np.abs(column(said, "y_std") - np.sqrt(var * (1 + noise - ((k @ inverse) * k).sum(axis=1)))).max() < 1e-7
