"""Queries of sources and projection. Files are written from the tables to the shared folder first, then read back by the source."""

from __future__ import annotations

import json
from urllib.parse import urlsplit

from pyspark.sql import functions as F

from .. import layout
from ..functions.shared import scratch
from ..functions.spectral import r6
from ..operators import project as P
from ..registry import query
from ..sources import containers, package, text


def put(spark, path: str, content: bytes) -> str:
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(content))
    out.close()
    return path


def _put_all(spark, files, base: str) -> None:
    """A file per (name, content) under base: written by tasks where the shared folder is a plain path, else one by one."""
    if urlsplit(base).scheme not in ("", "file"):
        for r in files.toLocalIterator():
            put(spark, f"{base}/{r['name']}", r["content"].encode())
        return
    root = urlsplit(base).path

    def write(batches):
        import os

        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"]):
                path = f"{root}/{name}"
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as f:
                    f.write(content.encode())
            yield pdf[["name"]].iloc[:0]

    files.repartition(24).mapInPandas(write, "name string").count()


BANDS = 64


def _rows(spark, sf):
    """The embeddings as vec_id, sample_id, label and an array of texts."""
    return layout.table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("s"), F.col("vec_id")).alias("sample_id"), F.col("label").cast("string").alias("label"), F.transform("embedding", lambda v: F.format_string("%.5f", v.cast("double"))).alias("t"))


def _written(spark, path, head, lines):
    """A folder with one text file: the head, then the values of (k, value) in order."""
    top = spark.createDataFrame([(i - len(head), h) for i, h in enumerate(head)], "k long, value string")
    lines.select(F.col("k").cast("long").alias("k"), "value").unionByName(top).repartition(1).sortWithinPartitions("k").select("value").write.text(path)
    return path


def _cells(df, key="sample_id"):
    return df.select(key, F.posexplode("x").alias("band", "v")).select(key, "band", r6(F.col("v")).alias("v"))


_WIDE = f"w AS (SELECT vec_id, 's' || vec_id AS sample_id, label::VARCHAR AS label, embedding FROM embeddings), c AS (SELECT vec_id, sample_id, label, unnest(range({BANDS}))::INT AS band, round(unnest(embedding)::DOUBLE, 5) AS v FROM w)"


@query("read_delimited", f"WITH {_WIDE} SELECT sample_id, label, band, R(v) AS v FROM c")
def read_delimited(spark, sf):
    """Preamble, header with units, semicolons and decimal commas."""
    head = ["# instrument x", "# operator y", ";".join(["sample_id", "class", *(f"{900 + 10 * i} nm" for i in range(BANDS))])]
    cells = F.transform("t", lambda v: F.replace(v, F.lit("."), F.lit(",")))
    path = _written(spark, scratch(spark) + "/data.csv", head, _rows(spark, sf).select(F.col("vec_id").alias("k"), F.concat_ws(";", "sample_id", "label", cells).alias("value")))
    sample = text.preview(spark, path)
    d = text.sniff_delimiter(sample[2:])
    df = text.read_delimited(spark, path, delimiter=d, header_rows=[text.header_row(sample, d)])
    got = P.project(df, P.infer([c for c in df.columns if c != "_row"]))
    return got.select("sample_id", "label", F.posexplode("x").alias("band", "v")).select("sample_id", "label", "band", r6(F.col("v")).alias("v"))


@query("read_whitespace", f"WITH {_WIDE} SELECT sample_id, label AS class, R(v) AS v FROM c WHERE band = 0")
def read_whitespace(spark, sf):
    path = _written(spark, scratch(spark) + "/data.txt", ["sample_id  class   v"], _rows(spark, sf).select(F.col("vec_id").alias("k"), F.concat(F.col("sample_id"), F.lit("   "), F.col("label"), F.lit(" "), F.col("t")[0]).alias("value")))
    return text.read_whitespace(spark, path).select("sample_id", "class", r6(layout.number(F.col("v"))).alias("v"))


@query("read_multirow_header", f"WITH {_WIDE} SELECT sample_id, label AS class, R(max(v) FILTER (band = 0)) AS b0, R(max(v) FILTER (band = 1)) AS b1 FROM c GROUP BY ALL")
def read_multirow(spark, sf):
    path = _written(spark, scratch(spark) + "/data.csv", ["meta,meta,spectra,spectra", "sample_id,class,band_0,band_1"], _rows(spark, sf).select(F.col("vec_id").alias("k"), F.concat_ws(",", "sample_id", "label", F.slice("t", 1, 2)).alias("value")))
    df = text.read_delimited(spark, path, delimiter=",", header_rows=[0, 1])
    return df.select("sample_id", "class", r6(layout.number(F.col("band_0"))).alias("b0"), r6(layout.number(F.col("band_1"))).alias("b1"))


def _short(spark, sf):
    return _rows(spark, sf).select(F.col("vec_id").alias("k"), "sample_id", "label", F.col("t")[0].alias("v"))


@query("read_row_range", f"WITH {_WIDE} SELECT sample_id, R(v) AS v FROM c WHERE band = 0 AND vec_id BETWEEN 5 AND 20")
def read_row_range(spark, sf):
    path = _written(spark, scratch(spark) + "/data.csv", ["sample_id,class,v"], _short(spark, sf).select("k", F.concat_ws(",", "sample_id", "label", "v").alias("value")))
    df = text.read_delimited(spark, path, delimiter=",", header_rows=[0], data_start=6, data_end=21)
    return df.select("sample_id", r6(layout.number(F.col("v"))).alias("v"))


@query("read_headerless", f"WITH {_WIDE} SELECT vec_id AS row_number, sample_id, R(v) AS v FROM c WHERE band = 0")
def read_headerless(spark, sf):
    path = _written(spark, scratch(spark) + "/data.tsv", [], _short(spark, sf).select("k", F.concat_ws("\t", "sample_id", "label", "v").alias("value")))
    df = text.read_delimited(spark, path, header_rows=[])
    return df.select(F.col("_row").cast("long").alias("row_number"), F.col("column_0").alias("sample_id"), r6(layout.number(F.col("column_2"))).alias("v"))


@query("read_transposed", f"WITH {_WIDE} SELECT sample_id, band, R(v) AS v FROM c")
def read_transposed(spark, sf):
    cells = _rows(spark, sf).select("vec_id", "sample_id", F.posexplode("t").alias("band", "v"))
    line = lambda own: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", own))), lambda c: c[own]), ",")
    head = cells.where("band = 0").agg(line("sample_id").alias("ids")).first()["ids"]
    body = cells.groupBy("band").agg(line("v").alias("v")).select(F.col("band").alias("k"), F.concat_ws(",", (900 + 10 * F.col("band")).cast("string"), "v").alias("value"))
    return _cells(text.read_transposed_text(spark, _written(spark, scratch(spark) + "/data.csv", [f"band,{head}"], body)))


@query("read_folder", f"WITH {_WIDE} SELECT 'class_' || label AS label, sample_id, band, R(v) AS v FROM c")
def read_folder(spark, sf):
    base = scratch(spark)
    lines = F.concat(F.array(F.lit("wavelength,intensity")), F.transform("t", lambda v, i: F.concat((900 + 10 * i).cast("string"), F.lit(","), v)))
    _put_all(spark, _rows(spark, sf).select(F.concat(F.lit("class_"), "label", F.lit("/"), "sample_id", F.lit(".csv")).alias("name"), F.array_join(lines, "\n").alias("content")), base)
    df = text.read_folder(spark, base, label="folder")
    return df.select("label", "sample_id", F.posexplode("x").alias("band", "v")).select("label", "sample_id", "band", r6(F.col("v")).alias("v"))


@query("read_axis_and_ids", f"SELECT vec_id AS position, 's' || vec_id AS sample_id, 900e0 + 10 * (vec_id % {BANDS}) AS axis FROM embeddings")
def read_axis_and_ids(spark, sf):
    base = scratch(spark)
    values = text.read_axis(spark, put(spark, base + "/bands.csv", "\n".join(["band", *(str(900 + 10 * i) for i in range(BANDS))]).encode()), BANDS)
    ids = text.read_ids(spark, _written(spark, base + "/ids.csv", ["sample_id"], _short(spark, sf).select("k", F.col("sample_id").alias("value"))))
    return ids.select(F.col("_row").cast("long").alias("position"), "sample_id", F.array(*(F.lit(v) for v in values))[(F.col("_row") % BANDS).cast("int")].alias("axis"))


@query("read_npz", "SELECT vec_id AS sample_idx, R(embedding[3]::DOUBLE) AS v FROM embeddings")
def read_npz(spark, sf):
    import io

    import numpy as np

    rows = layout.table(spark, sf, "embeddings").orderBy("vec_id").collect()  # a container is one array
    buffer = io.BytesIO()
    np.savez(buffer, X=np.array([r["embedding"] for r in rows], np.float32), wavelength=np.arange(64.0))
    df = containers.read_matrix(spark, put(spark, scratch(spark) + "/data.npz", buffer.getvalue()))
    return df.select("sample_idx", r6(F.col("x")[2]).alias("v"))


@query("read_package", "SELECT vec_id AS sample_idx, R(embedding[1]::DOUBLE) AS v, 64::BIGINT AS bands FROM embeddings")
def read_package(spark, sf):
    path = scratch(spark) + "/package"
    package.write_package(layout.spectra(spark, sf), [900.0 + 10 * i for i in range(64)], path, unit="nm", task="classification")
    df, axis, _ = package.read_package(spark, path)
    return df.select("sample_idx", r6(F.col("x")[0]).alias("v"), F.lit(axis.count()).cast("long").alias("bands"))


@query("read_nullable_cells", "SELECT event_id, R(CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END) AS a, R(value * 2) AS b FROM events")
def read_nullable(spark, sf):
    cells = layout.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.element_at(F.array(F.lit("NA"), F.lit("missing"), F.lit(" nan ")), (F.col("event_id") % 3 + 1).cast("int"))).otherwise(F.col("value").cast("string")).alias("a"), (F.col("value") * 2).cast("string").alias("b"))
    return package.nullable_cells(cells, ["a", "b"]).select("event_id", r6(F.col("x")[0]).alias("a"), r6(F.col("x")[1]).alias("b"))


@query("read_split_contract", "SELECT * FROM (VALUES ('holdout', 'holdout', 'train', 0::BIGINT), ('holdout', 'holdout', 'train', 2), ('holdout', 'holdout', 'test', 1), ('fold_1', 'fold', 'train', 0), ('fold_1', 'fold', 'val', 1), ('repeat_1', 'repeat', 'train', 1), ('repeat_1', 'repeat', 'test', 0), ('holdout', 'holdout', 'train', 5), ('holdout', 'holdout', 'test', 6)) t(iteration_id, iteration_type, role, sample_idx)")
def read_split_contract(spark, sf):
    docs = [{"indices": {"train": [0, 2], "test": [1]}}, {"folds": [{"fold_id": 1, "train_indices": [0], "val_indices": [1]}]}, {"repeats": [{"repeat_id": 1, "train_indices": [1], "test_indices": [0]}]}, {"sample_ids": {"train": ["s5"], "test": ["s6"]}}]
    ids = spark.range(10).select(F.concat(F.lit("s"), F.col("id")).alias("sample_id"), F.col("id").alias("sample_idx"))
    return package.parse_split_contract(spark.createDataFrame([(json.dumps(d),) for d in docs], "contract string"), ids)


@query("write_iterations", "SELECT CASE WHEN vec_id % 10 <= 6 THEN 'train' WHEN vec_id % 10 = 7 THEN 'val' ELSE 'test' END AS role, count(*) AS n FROM embeddings GROUP BY 1")
def write_iterations(spark, sf):
    path = scratch(spark)
    package.write_iterations(layout.spectra(spark, sf).withColumn("iteration_id", F.lit("holdout")), path)
    return spark.read.parquet(path).where("iteration_id = 'holdout'").groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("run_index_upsert", "SELECT n_nationkey AS run_id, CASE WHEN n_nationkey = 7 THEN 'again' ELSE n_name END AS status FROM nation UNION ALL SELECT 99, 'new'")
def run_index(spark, sf):
    index = layout.table(spark, sf, "nation").select(F.col("n_nationkey").alias("run_id"), F.col("n_name").alias("status"))
    return package.upsert_run(index, spark.createDataFrame([(7, "again"), (99, "new")], "run_id int, status string"))


@query("number_parsing", "SELECT event_id, R(CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 1.5 WHEN 2 THEN NULL WHEN 3 THEN value WHEN 4 THEN NULL ELSE -2500 END) AS v FROM events")
def number_parsing(spark, sf):
    """A missing text, a decimal comma, infinity, a number, an unreadable text (no error in the lenient reading), an exponent."""
    t = F.element_at(F.array(F.lit(" N/A"), F.lit("1,5"), F.lit("inf"), F.col("value").cast("string"), F.lit("1,5.2"), F.lit("-2.5e3")), (F.col("event_id") % 6 + 1).cast("int"))
    return layout.table(spark, sf, "events").select("event_id", r6(layout.number(t)).alias("v"))


@query("generated_ids", "SELECT s_suppkey AS sample_idx, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'sample_' || CASE WHEN s_suppkey + 1 < 1000 THEN lpad((s_suppkey + 1)::VARCHAR, 3, '0') ELSE (s_suppkey + 1)::VARCHAR END END AS sample_id FROM supplier")
def generated_ids(spark, sf):
    df = layout.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample_idx"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise(F.lit(" ")).alias("sample_id"))
    return P.fill_ids(df)


@query("column_summary", "SELECT 'value' AS \"column\", 1e0 AS share, true AS numeric UNION ALL SELECT 'event_type', 0e0, false")
def column_summary(spark, sf):
    return P.column_summary(layout.table(spark, sf, "events"), ["value", "event_type"])


_EVIDENCE = {
    "id": ["Sample_ID", "Unnamed: 0", "样品编号", "my sample", "name"], "label": ["Class", "type", "产地", "等级"], "target": ["Target_1", "protein content", "value", "水分含量"],
    "metadata": ["No.", "batch", "仪器", "Notes"], "band": ["900 nm", "wl_1000.5", "band_7", "4000cm-1", "1200 cm⁻¹", "850 cm1"],
}


@query("header_evidence", "SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{c}')" for r, cs in _EVIDENCE.items() for c in cs) + ") t(role, \"column\")")
def header_evidence(spark, sf):
    found = P.evidence([*(c for cs in _EVIDENCE.values() for c in cs), "-3", "9a", "Remark 2", "typ"])
    return spark.createDataFrame([(r, c) for r, cs in found.items() for c in cs], "role string, column string")


@query("feature_band_indices", "WITH $LONG, s(k, band) AS (VALUES (0, 1), (1, 3), (2, 4), (3, 5), (4, 7), (5, 6)) SELECT sample_idx, k::INT AS band, R(v) AS v FROM cells JOIN s USING (band)")
def band_indices(spark, sf):
    from ..operators.preprocess import take_bands

    df = layout.spectra(spark, sf)
    return _cells(df.withColumn("x", take_bands(F.col("x"), P.band_indices("1,3:5,7-6", 64))), "sample_idx")


@query("pivot_measurements", "SELECT l_orderkey AS sample_idx, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1)::INT AS band, R(l_quantity) AS v FROM lineitem")
def pivot_measurements(spark, sf):
    """Long measurements to arrays and back: a ragged table keeps its rows."""
    long = layout.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sample_idx"), (F.col("l_linenumber") - 1).alias("band"), F.col("l_quantity").alias("v"))
    arrays = layout.to_array(long, "sample_idx")
    return layout.to_long(arrays, "sample_idx").select("sample_idx", "band", r6(F.col("v")).alias("v"))


@query("axis_ragged", "WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT n AS bands, count(*) AS samples FROM c GROUP BY n")
def axis_ragged(spark, sf):
    return layout.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("bands")).groupBy("bands").agg(F.count(F.lit(1)).alias("samples"))


@query("json_preview", "SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.k')) AS with_k FROM events GROUP BY 1")
def json_preview(spark, sf):
    return layout.table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.get_json_object("props", "$.k")).alias("with_k"))
