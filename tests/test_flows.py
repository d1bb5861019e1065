"""Evaluation, saved bundles, looking at sources, workbooks, ranks and comparisons."""

import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom import errors
from bandloom.functions import ranks, shared
from bandloom.operators import evaluate, feature, model, preprocess, project, search, split
from bandloom.plans import workflow
from bandloom.sources import bundle, inspect, package, text, workbook


def spectra(spark, n=60, p=12, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = rng.standard_normal(p) + 4 + (i % 2) * np.linspace(0, 3, p)
        rows.append((i, "AB"[i % 2], [float(v) for v in x], float(x[0] - 2 * x[3] + 1), ("train", "train", "train", "val", "test")[i // 2 % 5]))
    return spark.createDataFrame(rows, "sample_idx long, label string, x array<double>, y double, role string")


def put(spark, path, content):
    with open(path, "wb") as f:
        f.write(content)
    return str(path)


def test_cross_validation_by_fold_equals_single_fits(spark):
    df = spectra(spark)
    splits = split.kfold(df, 3)
    pred, scores = evaluate.cross_validate(df, splits, ["gaussian_nb", "ridge"][:1])
    own = {(r["iteration_id"], r["sample_idx"]): r["y_pred"] for r in pred.collect()}
    assert len(own) == 60
    for i in range(3):
        data = evaluate.of_iteration(df, splits, i)
        alone = model.gaussian_nb(data.where("role = 'train'")).predict(data.where("role = 'val'"))
        assert {r["sample_idx"]: r["y_pred"] for r in alone.collect()} == {s: v for (k, s), v in own.items() if k == i}
    table = evaluate.compare(scores).collect()
    assert len(table) == 1 and table[0]["rank"] == 1 and table[0]["accuracy_mean"] > 0.8


def test_repeats_evaluate_test_rows_and_may_search(spark):
    df = spectra(spark)
    splits = split.monte_carlo(df, 2, split.parse_ratio("6:2:2"))
    pred, scores = evaluate.cross_validate(df, splits, ["knn_regressor"], "y", search=True)
    assert pred.groupBy("iteration_id").count().where("count = 12").count() == 2 and scores.where("rmse > 0").count() == 2
    with pytest.raises(errors.BandloomError, match="SEARCH_WITHOUT_VAL"):
        evaluate.cross_validate(df, split.kfold(df, 3), ["ridge"], "y", search=True)


def test_iterations_must_match_and_feature_gates(spark):
    a = spark.createDataFrame([(0,), (1,)], "iteration_id int")
    evaluate.match_iterations(a, a)
    with pytest.raises(errors.BandloomError, match="ITERATION_MISMATCH"):
        evaluate.match_iterations(a, a.where("iteration_id = 0"))
    evaluate.feature_gate("pca")
    with pytest.raises(errors.BandloomError, match="VISUAL_ONLY"):
        evaluate.feature_gate("tsne_embedding")
    with pytest.raises(errors.NeedsConfirmation):
        evaluate.feature_gate("isomap_embedding")


@pytest.mark.parametrize("name,y", [("gaussian_nb", None), ("knn_classifier", None), ("logistic_regression", None), ("random_forest_regressor", "y"), ("ridge", "y"), ("extra_trees_classifier", None)])
def test_bundles_predict_the_same_after_loading(spark, tmp_path, name, y):
    df = spectra(spark)
    made = bundle.fit_bundle(df, chain=["snv", "robust_scaling"], feature="pca", model=name, y=y, feature_parameters={"n_components": 4}, parameters={"n_estimators": 5} if "tree" in name or "forest" in name else {})
    path = f"file://{tmp_path}/b"
    bundle.save(spark, made, path)
    again = bundle.load(spark, path)
    new = df.where("role = 'test'").select("sample_idx", "x")
    a, b = ({r["sample_idx"]: r["y_pred"] for r in m.predict(new).collect()} for m in (made, again))
    assert a == b and len(a) == 12 and again.meta["model"] == name
    with pytest.raises(errors.BandloomError, match="EXISTS"):
        bundle.save(spark, made, path)


def test_fitted_chain_equals_the_chain_at_once(spark):
    df = spectra(spark)
    chain = bundle.fit_chain(df.where("role = 'train'"), ["snv", "mean_centering", "minmax_scaling"])
    want = preprocess.preprocess(df, ["snv", "mean_centering", "minmax_scaling"], width=12)[0]
    a, b = (np.array([r["x"] for r in d.orderBy("sample_idx").collect()]) for d in (chain.transform(df), want))
    assert np.allclose(a, b)


def test_iteration_and_split_packages(spark, tmp_path):
    df = spectra(spark)
    splits = split.kfold(df, 3)
    contract = package.write_split(splits, f"file://{tmp_path}/s")
    assert contract == {"roles": {"train": 120, "val": 60}, "iterations": 3}
    assert package.read_split(spark, f"file://{tmp_path}/s").count() == 180
    package.write_iterations(df.drop("role").join(splits, "sample_idx"), f"file://{tmp_path}/i")
    assert package.read_iterations(spark, f"file://{tmp_path}/i", 1, "val").count() == 20
    with pytest.raises(errors.BandloomError, match="NO_SUCH_PART"):
        package.read_iterations(spark, f"file://{tmp_path}/i", 9)


def test_lines_are_numbered_over_the_splits_of_a_file(spark, tmp_path):
    path = put(spark, tmp_path / "big.csv", b"\xef\xbb\xbf" + b"\n".join(b"line %d,%d" % (i, i) for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        rows = text.lines(spark, f"file://{path}")
        assert rows.rdd.getNumPartitions() > 3
        assert {r["n"]: r["value"] for r in rows.collect()} == {i: f"line {i},{i}" for i in range(5000)}
        got = text.read_delimited(spark, f"file://{path}", delimiter=",", header_rows=[0], data_start=4990, data_end=4995)
        assert sorted(r[1] for r in got.collect()) == [f"line {i}" for i in range(4990, 4996)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_ranks_over_buckets_equal_a_single_window(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(v), ("a", "b", None)[i % 3]) for i, v in enumerate(rng.integers(0, 40, 700))]
    df = spark.createDataFrame(rows, "id int, v int, k string")
    got = ranks.running(ranks.with_bucket(df, "v"), F.col("_cut"), ["v", "id"], {"place": F.lit(1).cast("long"), "total": F.col("v").cast("long")}, "k")
    for k in ("a", "b", None):
        own = sorted((v, i) for i, v, c in rows if c == k)
        want = {i: (n + 1, sum(v for v, _ in own[: n + 1])) for n, (_, i) in enumerate(own)}
        assert {r["id"]: (r["place"], r["total"]) for r in got.where(F.col("k").eqNullSafe(F.lit(k))).collect()} == want


def test_samples_as_columns_and_folder_roles(spark, tmp_path):
    found = inspect.samples_as_columns(["nm", "s1", "s2"], [["900", "1.0", "2"], ["910", "1,5", "x"], ["920", "3", "4"]])
    assert found["candidate"] and found["monotonic"] and found["cells_numeric"] == 0.833
    assert not inspect.samples_as_columns(["a", "b"], [["x", "1"]])["candidate"]
    put(spark, tmp_path / "spectra.csv", b"sample_id,900,910,920\ns1,1,2,3\n")
    put(spark, tmp_path / "label.csv", b"sample_id,class\ns1,A\n")
    put(spark, tmp_path / "wavelength.csv", b"band\n900\n")
    put(spark, tmp_path / "notes.md", b"nothing")
    roles = inspect.folder_roles(spark, f"file://{tmp_path}")
    assert {k: len(v) for k, v in roles.items()} == {"spectra": 1, "label": 1, "metadata": 0, "band_axis": 1}
    assert inspect.choose_files(roles)["spectra"].endswith("spectra.csv")
    put(spark, tmp_path / "more.csv", b"sample_id,900,910\ns1,1,2\n")
    with pytest.raises(errors.NeedsConfirmation):
        inspect.choose_files(inspect.folder_roles(spark, f"file://{tmp_path}"))


def test_paths_and_plans(spark, tmp_path):
    put(spark, tmp_path / "a.csv", b"x\n1\n")
    base = f"file://{tmp_path}"
    assert inspect.resolve_path(spark, "a.csv", source_dir=f"{base}/none", plan_dir=base)["base"] == "plan_dir"
    assert not inspect.resolve_path(spark, "b.csv", source_dir=base)["exists"] and inspect.resolve_path(spark, None)["resolved"] is None
    plan = {"source_path": f"{base}/a.csv", "mode": "matrix_file.samples_as_rows", "read_plan_status": "confirmed", "band_columns": "900..910"}
    assert inspect.check_plan(spark, plan).ready
    assert inspect.check_plan(spark, plan | {"mode": "json_table"}).blocking == ["UNSUPPORTED_MODE"]
    assert inspect.check_plan(spark, plan | {"band_columns": None}).missing == ["band_columns"]
    assert inspect.check_plan(spark, plan | {"source_path": "gone.csv"}).blocking == ["SOURCE_PATH_NOT_FOUND"]


def test_assertions(spark, tmp_path):
    df = spectra(spark, 4)
    inspect.require_rows(df)
    inspect.require_axis(df, list(range(12)))
    labels = spark.createDataFrame([(i, "A") for i in range(4)], "sample_idx long, label2 string")
    inspect.require_labels(df, labels, "sample_idx")
    inspect.require_numeric(spark.createDataFrame([("1", "NA")], "a string, b string"), ["a", "b"])
    for code, call in (
        ("EMPTY_X", lambda: inspect.require_rows(df.limit(0))),
        ("BAND_AXIS_LENGTH_MISMATCH", lambda: inspect.require_axis(df, [1])),
        ("LABEL_ALIGNMENT_FAILED", lambda: inspect.require_labels(df, labels.limit(2), "sample_idx")),
        ("DUPLICATE_LABEL_KEYS", lambda: inspect.require_labels(df, labels.union(labels), "sample_idx")),
        ("X_NON_NUMERIC", lambda: inspect.require_numeric(spark.createDataFrame([("1", "x")], "a string, b string"), ["a", "b"])),
        ("METADATA", lambda: inspect.require_aligned(df, labels.limit(1), "METADATA")),
        ("STATUS_INVALID", lambda: inspect.require_status("open")),
        ("BAND_AXIS_COLUMN_INVALID", lambda: inspect.require_axis_column(["a"], 1)),
        ("JOIN_KEY_NOT_FOUND", lambda: inspect.require_join_key(["a"], "b")),
        ("DATA_REF_NOT_FOUND", lambda: inspect.require_refs(spark, f"file://{tmp_path}", {"X": "X.csv"}, ["X"])),
    ):
        with pytest.raises(errors.BandloomError, match=code):
            call()


XLSX = {
    "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="One" r:id="r1"/><sheet name="Two" r:id="r2"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
    "xl/sharedStrings.xml": "<sst><si><t>sample_id</t></si><si><r><t>9</t></r><r><t>00</t></r></si></sst>",
    "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row><row r="4"><c r="A4" t="inlineStr"><is><t>s1</t></is></c><c r="C4"><v>2.0</v></c></row></sheetData></worksheet>',
    "xl/worksheets/sheet2.xml": '<worksheet><sheetData><row><c t="str"><v>a</v></c></row><row><c><v>1.5</v></c></row></sheetData></worksheet>',
}
ODS = '<o:doc xmlns:o="o" xmlns:t="t" xmlns:x="x"><t:table t:name="S"><t:table-row><t:table-cell><x:p>id</x:p></t:table-cell><t:table-cell t:number-columns-repeated="2" o:value="7"/></t:table-row><t:table-row t:number-rows-repeated="1048000"><t:table-cell t:number-columns-repeated="16000"/></t:table-row></t:table></o:doc>'


def test_workbooks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        for name, part in XLSX.items():
            z.writestr(name, part)
    with zipfile.ZipFile(tmp_path / "b.ods", "w") as z:
        z.writestr("content.xml", ODS)
    path = f"file://{tmp_path}/b.xlsx"
    one = workbook.read_workbook(spark, path, "One")
    assert one.columns == ["_row", "sample_id", "900"] and [tuple(r) for r in one.collect()] == [(0, "s1", "2")]
    assert [r["a"] for r in workbook.read_workbook(spark, path, 1).collect()] == ["1.5"]
    with pytest.raises(Exception, match="SHEET"):
        workbook.read_workbook(spark, path)
    assert workbook.sheets((tmp_path / "b.ods").read_bytes(), "b.ods") == {"S": [["id", "7", "7"]]}
    with pytest.raises(errors.BandloomError, match="WORKBOOK_KIND"):
        workbook.sheets(b"", "b.xls")


def test_comparisons_and_trials(spark):
    assert [search.comparison(spark, d).count() for d in ("quick", "recommended", "extended")] == [6, 22, 32]
    df = spectra(spark)
    rows = search.comparison(spark, "quick").where("feature in ('none', 'spa', 'vip', 'select_k_best')").withColumn("model", F.lit("lda"))
    results = search.execute(df, rows)
    assert results.where("error is null and fit_time > 0").count() == 4
    ranked = search.best(results, "macro_f1")
    again = evaluate.stability(df, split.monte_carlo(df, 2, split.parse_ratio("8:2")), ranked, top=2)
    assert again.count() == 2 and again.agg(F.sum("wins")).first()[0] == 2


def test_workflow_blocks_conflicts_and_chooses_models(spark):
    df = spectra(spark).drop("role")
    a = workflow.run(df, "classification", model="auto", method="stratified", chain=("none",))
    assert a.decisions["qc_status"] == "passed" and a.decisions["model"] in ("pls_da", "lda", "svm") and a.frames["metrics"].first()["accuracy"] > 0.5
    twice = df.union(df.where("sample_idx = 0").selectExpr("sample_idx + 1000", "'B'", "x", "y"))
    with pytest.raises(errors.NeedsConfirmation, match="QC_BLOCKED"):
        workflow.run(twice, "split")
    assert workflow.run(twice, "quality").decisions["qc_status"] == "blocked"


def test_names_and_parameters(spark):
    assert preprocess.normalise(["1st-Derivative", "area", "mean center"])[0] == ["first_derivative", "area_normalization", "mean_centering"]
    found = project.evidence(["Unnamed: 0", "品种", "protein content", "序号", "900 cm⁻¹", "-3"])
    assert found == {"id": ["Unnamed: 0"], "label": ["品种"], "target": ["protein content"], "metadata": ["序号"], "band": ["900 cm⁻¹"]}
    assert model.resolve_parameters("svm", {"model__C": 1, "model_gamma": "scale"}) == {"C": 1, "gamma": "scale"}
    assert [p["n_components"] for p in model.grid("plsr", rows=4, bands=9)] == [1, 2, 3]
    assert [p["n_neighbors"] for p in model.grid("knn_regressor", rows=3)] == [1, 1, 3, 3]
    df = spectra(spark)
    shrunk = model.fit_model(df, "lda", shrinkage="auto").predict(df)
    assert shrunk.where("y_pred = label").count() > 50
    trees = model.fit_model(df, "extra_trees", n_estimators=10).predict(df)
    assert trees.where("y_pred = label").count() == 60


def test_selectors_name_their_bands(spark):
    df = spectra(spark, 80)
    bands, trace, kept = feature.cars(df, 20, y="y")
    assert {0, 3} <= set(bands) and len(trace) == 20 and trace[-1][1] == 2 and kept[3] == 1
    got = {r["band"]: r for r in feature.uve(df, 20, y="y").collect()}
    assert got[3]["selected"] and got[0]["selected"] and len(got) == 12
    assert feature.uve(df, 10, y="y", top_k=3, monte_carlo=True).where("selected").count() == 3


def test_stored_tables_can_be_dropped(spark):
    t = shared.stored(spark.range(5), "t")
    assert t.count() == 5
    shared.drop(t)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        spark.read.parquet(t.inputFiles()[0]).count()
