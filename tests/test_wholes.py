"""What took too much disk, memory or time on larger tables, in small."""

import numpy as np
from test_sizes import frame

from bandloom.functions import gram
from bandloom.operators import feature, joins


def test_distances_copy_no_block_for_each_partner(spark, monkeypatch):
    x = np.random.default_rng(13).standard_normal((200, 3))
    monkeypatch.setattr(joins, "PAIR_BLOCK", 16)
    made = joins.distance_matrix(frame(spark, x))
    pairs = {(r["a"], r["b"]): r["distance"] for r in made.collect()}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate explode" not in plan
    assert len(pairs) == 200 * 199 // 2 and all(abs(d - np.linalg.norm(x[a] - x[b])) < 1e-12 for (a, b), d in pairs.items())


def test_paths_are_read_a_few_rows_at_a_time(spark, monkeypatch):
    kept, stored = [], feature.shared.stored
    monkeypatch.setattr(feature.gram, "CELLS", 1 << 12)
    monkeypatch.setattr(feature.shared, "stored", lambda df, name: kept.append((name, stored(df, name))) or kept[-1][1])
    x = np.random.default_rng(14).random((150, 2)) * [5, 1]
    got = {r["sample_idx"]: r["x"] for r in feature.isomap(frame(spark, x), 2, 8).transform(frame(spark, x)).collect()}
    assert max(abs(np.corrcoef([got[i][k] for i in range(150)], x[:, 0])[0, 1]) for k in range(2)) > 0.98
    (conf,) = [table.sparkSession.conf for name, table in kept if name == "geodesics"]
    for name in ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch"):
        assert int(conf.get(name)) <= 8
        assert int(spark.conf.get(name)) > 8  # the caller's session stays as it is


def test_neighbours_sort_only_what_is_near(monkeypatch):
    x = np.round(np.random.default_rng(15).standard_normal((400, 3)))  # with many ties
    d = np.sqrt(((x[:30, None] - x[None]) ** 2).sum(axis=2))
    want = np.argsort(d, axis=1, kind="stable")[:, :9]
    sort = np.argsort

    def narrow(a, *more, **p):
        assert np.ndim(a) == 1 or np.shape(a)[1] <= 9
        return sort(a, *more, **p)

    monkeypatch.setattr(np, "argsort", narrow)
    at, near = feature._neighbours(x[:30], x, 9)
    assert (at == want).all() and np.abs(near - np.take_along_axis(d, want, axis=1)).max() < 1e-12


def test_eigenvectors_are_found_with_restarts():
    a = np.random.default_rng(16).standard_normal((300, 300))
    a = a @ a.T
    value, vector = gram.largest(lambda v: a @ v, 300, 3, 1e-10, most=40)
    assert np.abs(value - np.linalg.eigvalsh(a)[:-4:-1]).max() < 1e-7 and np.abs(a @ vector - vector * value).max() < 1e-6


def test_rows_further_on_get_many_moves_at_once(monkeypatch):
    monkeypatch.setattr(gram, "NEAR_ROWS", 7)
    rng = np.random.default_rng(17)
    z, y = rng.standard_normal((120, 3)), rng.choice([-1.0, 1.0], (120, 4))
    k = gram.rbf(z, z, 0.3) + 1
    b = np.zeros((120, 4))
    for _ in range(10):
        for i in range(120):
            b[i] = np.clip((y[i] - k[i] @ b + 2 * b[i]) / 2, np.minimum(y[i], 0), np.maximum(y[i], 0))
    got = gram.boxed(z, 0.3, y, np.minimum(y, 0), np.maximum(y, 0), 0.0, 0.0, 10, block=40)
    assert np.abs(got - b).max() < 1e-9
