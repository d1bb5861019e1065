"""What failed on larger tables, in small."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.functions import blocks
from bandloom.operators import joins, model, project, quality, split
from bandloom.sources import bundle, text


@pytest.fixture
def small_splits(spark):
    """Files of a few kilobytes are read as several splits."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    for name, value in zip(names, ("8k", "1k")):
        spark.conf.set(name, value)
    yield
    for name, value in zip(names, old):
        spark.conf.set(name, value)


def frame(spark, x, **more):
    """sample_idx, x and further columns."""
    rows = [(i, [float(v) for v in r], *(float(c[i]) if np.asarray(c).dtype.kind == "f" else str(c[i]) for c in more.values())) for i, r in enumerate(x)]
    kinds = "".join(f", {k} {'double' if np.asarray(c).dtype.kind == 'f' else 'string'}" for k, c in more.items())
    return spark.createDataFrame(rows, "sample_idx long, x array<double>" + kinds)


def test_a_header_before_several_splits_is_no_cell(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text("# about\nsample_id;class;900 nm;910 nm\n" + "".join(f"s{i};c;{i},5;1\n" for i in range(3000)))
    df = text.read_delimited(spark, f"file://{tmp_path}/a.csv", delimiter=";", header_rows=[1])
    got = project.project(df, project.infer([c for c in df.columns if c != "_row"]))
    cells = got.select("sample_id", F.posexplode("x").alias("band", "v")).where("band = 0").collect()
    assert {r["sample_id"]: r["v"] for r in cells} == {f"s{i}": i + 0.5 for i in range(3000)}


def test_a_duplicate_does_not_take_another_sample_of_its_id_along(spark):
    rows = [(0, [1.0, 2.0], "a"), (5, [3.0, 4.0], "a"), (5, [1.0, 2.0], "a"), (5, [1.0, 2.0], "a"), (7, [9.0, 9.0], "a"), (7, [9.0, 9.0], "a")]
    left = quality.drop_duplicates(spark.createDataFrame(rows, "sample_idx long, x array<double>, label string"))
    assert left.columns == ["sample_idx", "x", "label"] and sorted((r["sample_idx"], r["x"]) for r in left.collect()) == [(0, [1.0, 2.0]), (5, [3.0, 4.0]), (7, [9.0, 9.0])]


def test_neighbours_in_blocks_are_those_of_the_whole_matrix(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((300, 3)), 1)  # with ties
    df = frame(spark, x, label=np.array([f"c{v}" for v in rng.integers(0, 3, 300)]), y=rng.standard_normal(300))
    train, rest = df.where("sample_idx < 200"), df.where("sample_idx >= 200")
    monkeypatch.setattr(model, "KNN_BLOCK", 64)
    for y in (None, "y"):
        whole, cut = ({r["sample_idx"]: r["y_pred"] for r in model.knn(train, rest, 4, "distance", y, bound).collect()} for bound in (1000, 10))
        assert len(whole) == 100 and whole == cut
    near = np.sqrt(((x[200:, None] - x[None, :200]) ** 2).sum(axis=2))
    want = [np.lexsort((np.arange(200), d))[:4] for d in near]
    assert (blocks.nearest(x[200:], x[:200], 4)[0] == want).all()


def test_distances_in_blocks_have_every_pair_once(spark, monkeypatch):
    x = np.random.default_rng(4).standard_normal((50, 3))
    monkeypatch.setattr(joins, "PAIR_BLOCK", 16)
    monkeypatch.setattr(joins, "MAX_PAIRS_ROWS", 10, raising=False)
    got = joins.distance_matrix(frame(spark, x)).collect()
    assert len(got) == 50 * 49 // 2 and {(r["a"], r["b"]) for r in got} == {(a, b) for b in range(50) for a in range(b)}
    assert all(abs(r["distance"] - np.linalg.norm(x[r["a"]] - x[r["b"]])) < 1e-12 for r in got)


def _selected(x, counts, y=None):
    """Max-min selection by the definition: each pick looks at all distances."""
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    d = np.array([np.sqrt(((z - v) ** 2).sum(axis=1)) for v in z])
    if y is not None:
        d = d / d.max() + np.abs(y[:, None] - y) / (y.max() - y.min())
    i, j = np.unravel_index(d.argmax(), d.shape)
    chosen = [int(i), int(j)]
    while len(chosen) < counts[0]:
        near = d[chosen].min(axis=0)
        near[chosen] = -1
        chosen.append(int(near.argmax()))
    return set(chosen)


def _turns(x, counts):
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    d = np.array([np.sqrt(((z - v) ** 2).sum(axis=1)) for v in z])
    free, parts = np.ones(len(x), bool), [[] for _ in counts]
    while free.any():
        for p, n in enumerate(counts):
            if len(parts[p]) == n or not free.any():
                continue
            if not parts[p]:
                picked = np.unravel_index(np.where(free[:, None] & free, d, -1).argmax(), d.shape)
            else:
                picked = [np.where(free, d[parts[p]].min(axis=0), -1).argmax()]
            for k in picked:
                parts[p].append(int(k))
                free[k] = False
    return [set(p) for p in parts]


def test_sequential_selection_is_that_of_the_definition_at_any_size(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((90, 3)), np.round(rng.standard_normal((60, 3)))])
    x = np.concatenate([x, x[:50]])  # equal rows
    y = rng.standard_normal(200)
    monkeypatch.setattr(split, "MAX_SEQUENTIAL", 100)
    monkeypatch.setattr(split._Part if hasattr(split, "_Part") else split, "LEADERS", 8, raising=False)
    df = frame(spark, x, y=y)
    role = lambda made, name: {r["sample_idx"] for r in made.where(F.col("role") == name).collect()}
    assert role(split.kennard_stone(df, [0.9, 0.1]), "train") == _selected(x, [180])
    assert role(split.kennard_stone(df, [0.7, 0.3], "y"), "train") == _selected(x, [140], y)
    made = split.duplex(df, [0.6, 0.4])
    assert [role(made, "train"), role(made, "test")] == _turns(x, [120, 80])


def test_transposed_text_makes_no_column_of_a_sample(spark, tmp_path, monkeypatch):
    n = 3000
    rows = ["band," + ",".join(f"s{i}" for i in range(n - 1)) + ",s0", *(",".join([str(910 - b), *(f"{i}.{b}" for i in range(n - b))]) for b in range(2))]
    (tmp_path / "a.csv").write_text("\n".join(rows))
    monkeypatch.setattr(text, "read_transposed", None)
    got = {r["sample_id"]: (r["x"], r["axis"]) for r in text.read_transposed_text(spark, f"file://{tmp_path}/a.csv").collect()}
    assert len(got) == n and got["s7"] == ([7.1, 7.0], [909.0, 910.0]) and got["s0_2"] == ([None, n - 1.0], [909.0, 910.0])


def test_a_large_forest_stays_a_table_and_predicts_the_same(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((150, 4))
    df = frame(spark, x, label=np.where(x[:, 0] + x[:, 1] > 0, "a", "b"), y=x[:, 0] * 2 + x[:, 2])
    for name in ("random_forest_classifier", "extra_trees_classifier", "random_forest_regressor"):
        said = []
        for bound in (10**9, 0):
            monkeypatch.setattr(model, "MAX_FOREST_BYTES", bound, raising=False)
            monkeypatch.setattr(model, "FOREST_BLOCK", 40, raising=False)
            fitted = model.fit_model(df, name, n_estimators=10)
            assert ("trees" in fitted.state) == (not bound)
            said.append({r["sample_idx"]: r["y_pred"] for r in fitted.predict(df).collect()})
        assert said[0].keys() == said[1].keys() and all(v == said[1][k] or abs(v - said[1][k]) < 1e-9 for k, v in said[0].items())
        if name.endswith("classifier"):
            assert sum(said[0][i] == ("a" if x[i, 0] + x[i, 1] > 0 else "b") for i in range(150)) >= 147
        else:
            assert np.corrcoef([said[0][i] for i in range(150)], x[:, 0] * 2 + x[:, 2])[0, 1] > 0.97
    made = bundle.Bundle(bundle.fit_chain(df, ["none"]), fitted, None, {})
    bundle.save(spark, made, f"file://{tmp_path}/bundle")
    again = {r["sample_idx"]: r["y_pred"] for r in bundle.load(spark, f"file://{tmp_path}/bundle").predict(df).collect()}
    assert again == said[1]
