"""Queries of splitting and of joins by sample."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import layout
from ..functions.spectral import r6, r6_column
from ..operators import joins as J
from ..operators import split as D
from ..registry import LONG, query


def _h(seed: str, key: str = "vec_id") -> str:
    return f"md5(concat({seed}, ':', {key}::VARCHAR))"


def _role(place: str, train: int, val: int) -> str:
    return f"CASE WHEN {place} <= {train} THEN 'train' WHEN {place} <= {train + val} THEN 'val' ELSE 'test' END"


@query("split_random", f"SELECT vec_id AS sample_idx, {_role('row_number() OVER (ORDER BY ' + _h('42') + ', vec_id)', 300, 100)} AS role FROM embeddings")
def split_random(spark, sf):
    return D.random_split(layout.spectra(spark, sf), D.parse_ratio("6:2:2"))


def _by_class(train: float, seed: str, repeats: str = "(SELECT 0 AS it)", total: bool = True) -> str:
    """DuckDB: two parts cut in each class by its own counts; single samples then move so that the totals are those of the whole."""
    cut = lambda n: f"(greatest(1, floor({n} * {train} + 1e-9)) + CASE WHEN greatest(1, floor({n} * {train} + 1e-9)) + greatest(1, floor({n} * (1 - {train}) + 1e-9)) < {n} AND {n} * {train} - greatest(1, floor({n} * {train} + 1e-9)) >= {n} * (1 - {train}) - greatest(1, floor({n} * (1 - {train}) + 1e-9)) THEN 1 ELSE 0 END)::INT"
    return f"""WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), b AS (SELECT label, n, {cut("n")} AS t FROM c),
        w AS (SELECT sum(t) - {cut("sum(n)")} AS d FROM b),
        m AS (SELECT label, t, d, row_number() OVER (ORDER BY CASE WHEN d > 0 THEN t - n * {train} ELSE n - t - n * (1 - {train}) END DESC, label::VARCHAR DESC) AS k FROM b, w),
        e AS (SELECT label, t - CASE WHEN {total} AND k <= abs(d) THEN sign(d) ELSE 0 END AS t FROM m),
        r AS (SELECT it, label, vec_id, row_number() OVER (PARTITION BY it, label ORDER BY {_h(seed)}, vec_id) AS place FROM embeddings, {repeats})
        """


@query("split_stratified", _by_class(0.7, "'42'") + "SELECT vec_id AS sample_idx, CASE WHEN place <= t THEN 'train' ELSE 'test' END AS role FROM r JOIN e USING (label)")
def split_stratified(spark, sf):
    return D.stratified_split(layout.spectra(spark, sf), D.parse_ratio("7:3"))


@query("split_predefined", "SELECT vec_id AS sample_idx, CASE WHEN vec_id % 10 <= 6 THEN 'train' WHEN vec_id % 10 = 7 THEN 'val' ELSE 'test' END AS role FROM embeddings")
def split_predefined(spark, sf):
    df = layout.spectra(spark, sf)
    return D.predefined(df.withColumn("part", F.when(df.role == "val", "Validation ").otherwise(F.initcap("role"))), "part")


@query("split_kfold", f"WITH f AS (SELECT vec_id, (row_number() OVER (ORDER BY {_h('42')}, vec_id) - 1) % 5 AS fold FROM embeddings) SELECT i::INT AS iteration_id, CASE WHEN fold = i THEN 'val' ELSE 'train' END AS role, vec_id AS sample_idx FROM f, (SELECT unnest(range(5)) AS i)")
def split_kfold(spark, sf):
    return D.kfold(layout.spectra(spark, sf))


@query("split_stratified_kfold", f"WITH f AS (SELECT vec_id, (row_number() OVER (PARTITION BY label ORDER BY {_h('42')}, vec_id) - 1) % 4 AS fold FROM embeddings) SELECT i::INT AS iteration_id, CASE WHEN fold = i THEN 'val' ELSE 'train' END AS role, vec_id AS sample_idx FROM f, (SELECT unnest(range(4)) AS i)")
def split_stratified_kfold(spark, sf):
    return D.stratified_kfold(layout.spectra(spark, sf), 4)


@query("split_leave_one_out", "SELECT a.n_nationkey::BIGINT AS iteration_id, CASE WHEN a.n_nationkey = b.n_nationkey THEN 'val' ELSE 'train' END AS role, b.n_nationkey::BIGINT AS sample_idx FROM nation a, nation b")
def split_loo(spark, sf):
    return D.leave_one_out(layout.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("sample_idx")))


@query("split_monte_carlo", f"SELECT i::INT AS iteration_id, {_role('row_number() OVER (PARTITION BY i ORDER BY ' + _h('(i + 41)::VARCHAR') + ', vec_id)', 400, 0)} AS role, vec_id AS sample_idx FROM embeddings, (SELECT unnest(range(1, 5)) AS i)")
def split_monte_carlo(spark, sf):
    return D.monte_carlo(layout.spectra(spark, sf), 4, D.parse_ratio("8:2"))


@query("split_stratified_monte_carlo", _by_class(0.8, "(it + 41)::VARCHAR", "(SELECT unnest(range(1, 4)) AS it)", False) + "SELECT it::INT AS iteration_id, CASE WHEN place <= t THEN 'train' ELSE 'test' END AS role, vec_id AS sample_idx FROM r JOIN e USING (label)")
def split_stratified_monte_carlo(spark, sf):
    return D.monte_carlo(layout.spectra(spark, sf), 3, D.parse_ratio("8:2"), label="label")


@query("split_y_bins", "WITH y AS (SELECT vec_id AS sample_idx, embedding[1]::DOUBLE * 2 + embedding[5]::DOUBLE AS y FROM embeddings), r AS (SELECT *, row_number() OVER (ORDER BY y, sample_idx) - 1 AS k FROM y) SELECT sample_idx, R(y) AS y, (least(9, floor(k * 10 / 500)) + 1)::INT AS bin FROM r")
def split_y_bins(spark, sf):
    df = layout.spectra(spark, sf).select("sample_idx", (F.col("x")[0] * 2 + F.col("x")[4]).alias("y"))
    return D.y_bins(df, df.count(), 2).withColumn("y", r6(F.col("y")))


@query("split_group", f"WITH g AS (SELECT DISTINCT vec_id % 23 AS g FROM embeddings), r AS (SELECT g, {_role('row_number() OVER (ORDER BY ' + _h('42', 'g') + ', g)', 16, 0)} AS role FROM g) SELECT vec_id AS sample_idx, role FROM embeddings JOIN r ON g = vec_id % 23")
def split_group(spark, sf):
    df = layout.spectra(spark, sf).withColumn("batch", F.col("sample_idx") % 23)
    return D.group_split(df, D.parse_ratio("7:3"), "batch")


@query("split_balanced_groups", """WITH RECURSIVE g AS MATERIALIZED (SELECT vec_id % 23 AS g, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, (vec_id % 23)::VARCHAR) AS k FROM embeddings GROUP BY 1),
    r AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS g, NULL::VARCHAR AS role, sum(n) * 0.6e0 AS a, sum(n) * 0.2e0 AS b, sum(n) * 0.2e0 AS c FROM g
        UNION ALL SELECT g.k, g.g, CASE WHEN a >= b AND a >= c THEN 'train' WHEN b >= c THEN 'val' ELSE 'test' END, a - CASE WHEN a >= b AND a >= c THEN n ELSE 0 END, b - CASE WHEN NOT (a >= b AND a >= c) AND b >= c THEN n ELSE 0 END, c - CASE WHEN NOT (a >= b AND a >= c) AND b < c THEN n ELSE 0 END FROM r JOIN g ON g.k = r.k + 1)
    SELECT vec_id AS sample_idx, role FROM embeddings JOIN r ON r.g = vec_id % 23""")
def split_balanced_groups(spark, sf):
    return D.balanced_groups(layout.spectra(spark, sf).withColumn("batch", F.col("sample_idx") % 23), D.parse_ratio("6:2:2"), "batch")


def _sequential(away: str, more: str = "") -> str:
    """DuckDB: the max-min selection as a recursion over a list of least distances; chosen samples have -1."""
    return f"""WITH RECURSIVE {LONG}, s AS (SELECT band, avg(v) AS m, CASE WHEN stddev_samp(v) > 0 THEN stddev_samp(v) ELSE 1 END AS s FROM cells GROUP BY band),
        z AS (SELECT sample_idx, list((v - m) / s ORDER BY band) AS z FROM cells JOIN s USING (band) GROUP BY sample_idx), o AS MATERIALIZED (SELECT sample_idx, z, row_number() OVER (ORDER BY sample_idx) AS i FROM z){more},
        p AS MATERIALIZED (SELECT a.i AS i, b.i AS j, sqrt(list_sum(list_transform(list_zip(a.z, b.z), lambda t: (t[1] - t[2]) ** 2))) AS x, a.sample_idx AS ia, b.sample_idx AS ib FROM o a, o b),
        d AS MATERIALIZED (SELECT i, list({away} ORDER BY j) AS d FROM p GROUP BY i), m AS MATERIALIZED (SELECT list(d ORDER BY i) AS m FROM d),
        f AS (SELECT i AS a, list_position(d, list_max(d)) AS b, list_max(d) AS far FROM d ORDER BY far DESC, i LIMIT 1),
        r AS (SELECT 2 AS k, a AS pick, list_transform(range(1, len(m) + 1), lambda j: CASE WHEN j = a OR j = b THEN -1e0 ELSE least(m[a][j], m[b][j]) END) AS near, b AS other FROM f, m
            UNION ALL SELECT k + 1, list_position(near, list_max(near)), list_transform(range(1, len(near) + 1), lambda j: CASE WHEN near[j] < 0 OR near[j] = list_max(near) AND j = list_position(near, list_max(near)) THEN -1e0 ELSE least(near[j], m[list_position(near, list_max(near))][j]) END), NULL
            FROM r, m WHERE k < floor(len(near) * 0.7 + 1e-9)),
        t AS (SELECT pick AS i FROM r UNION SELECT other FROM r WHERE other IS NOT NULL)
        SELECT sample_idx, CASE WHEN t.i IS NULL THEN 'test' ELSE 'train' END AS role FROM o LEFT JOIN t USING (i)"""


@query("split_kennard_stone", _sequential("x"))
def split_kennard_stone(spark, sf):
    return D.kennard_stone(layout.spectra(spark, sf), D.parse_ratio("7:3"))


@query("split_spxy", _sequential("x / (SELECT max(x) FROM p) + abs(ya.y - yb.y) / (SELECT max(y) - min(y) FROM y)", ", y AS (SELECT vec_id, embedding[1]::DOUBLE * 2 + embedding[5]::DOUBLE AS y FROM embeddings)").replace("FROM p GROUP BY i)", "FROM p JOIN y ya ON ya.vec_id = ia JOIN y yb ON yb.vec_id = ib GROUP BY i)"))
def split_spxy(spark, sf):
    return D.kennard_stone(layout.spectra(spark, sf).withColumn("y", F.col("x")[0] * 2 + F.col("x")[4]), D.parse_ratio("7:3"), y="y")


def _duplex() -> str:
    """DuckDB: both parts by turns, a round a step; chosen samples have -1 in both lists."""
    start = _sequential("x")
    start = start[: start.index("f AS (")]
    mask = lambda near, k, row: f"list_transform(range(1, len({near}) + 1), lambda i: CASE WHEN {near}[i] < 0 OR i = {k} THEN -1e0 ELSE {row} END)"
    return f"""{start} f AS (SELECT i AS a, list_position(d, list_max(d)) AS b FROM d ORDER BY list_max(d) DESC, i LIMIT 1),
        h AS (SELECT i AS c, min(j) AS e FROM (SELECT i, j, x, max(x) OVER () AS far FROM p, f WHERE i NOT IN (a, b) AND j NOT IN (a, b)) WHERE x = far GROUP BY i ORDER BY i LIMIT 1),
        r AS (SELECT 2 AS n, a AS k0, c AS k1, b AS b0, e AS b1, list_transform(range(1, len(m) + 1), lambda i: CASE WHEN i IN (a, b, c, e) THEN -1e0 ELSE least(m[a][i], m[b][i]) END) AS near0, list_transform(range(1, len(m) + 1), lambda i: CASE WHEN i IN (a, b, c, e) THEN -1e0 ELSE least(m[c][i], m[e][i]) END) AS near1 FROM f, h, m
            UNION ALL SELECT n + 1, k0, k1, NULL, NULL, {mask("near0", "k1", "near0[i]")}, CASE WHEN k1 = 0 THEN near1 ELSE {mask("near1", "k1", "least(near1[i], m[k1][i])")} END
            FROM (SELECT n, m, k0, near0, near1, CASE WHEN n < len(m) - floor(len(m) * 0.7 + 1e-9) THEN list_position(near1, list_max(near1)) ELSE 0 END AS k1
                FROM (SELECT n, m, k AS k0, {mask("near0", "k", "least(near0[i], m[k][i])")} AS near0, {mask("near1", "k", "near1[i]")} AS near1 FROM (SELECT n, m, near0, near1, list_position(near0, list_max(near0)) AS k FROM r, m WHERE n < floor(len(m) * 0.7 + 1e-9))))),
        t AS (SELECT k0 AS i FROM r UNION SELECT b0 FROM r WHERE b0 IS NOT NULL)
        SELECT sample_idx, CASE WHEN t.i IS NULL THEN 'test' ELSE 'train' END AS role FROM o LEFT JOIN t USING (i)"""


@query("split_duplex", _duplex())
def split_duplex(spark, sf):
    return D.duplex(layout.spectra(spark, sf), D.parse_ratio("7:3"))


_FIXED = "s AS (SELECT vec_id AS sample_idx, label, CASE WHEN vec_id % 10 <= 6 THEN 'train' WHEN vec_id % 10 = 7 THEN 'val' ELSE 'test' END AS role FROM embeddings)"


@query("split_label_distribution", f"WITH {_FIXED} SELECT role, label, count(*) AS n FROM s GROUP BY ALL")
def label_distribution(spark, sf):
    df = layout.spectra(spark, sf)
    return D.label_distribution(df, df.select("sample_idx", "role"))


@query("split_leakage", f"WITH {_FIXED} SELECT sample_idx % 20 AS batch, count(DISTINCT role) AS roles FROM s GROUP BY ALL HAVING count(DISTINCT role) > 1")
def split_leakage(spark, sf):
    df = layout.spectra(spark, sf)
    return D.leakage(df.withColumn("batch", F.col("sample_idx") % 20), df.select("sample_idx", "role"), "batch")


@query("split_coverage", "WITH $LONG, m AS (SELECT band, avg(v) AS m FROM cells GROUP BY band), d AS (SELECT sample_idx, role, sqrt(sum((v - m) ** 2)) AS d FROM cells JOIN m USING (band) GROUP BY ALL) SELECT role, R(avg(d)) AS mean_distance, count(*) AS n FROM d GROUP BY role")
def split_coverage(spark, sf):
    df = layout.spectra(spark, sf)
    return D.coverage(df, df.select("sample_idx", "role")).withColumn("mean_distance", r6(F.col("mean_distance")))


@query("split_sizes", "SELECT * FROM (VALUES ('train', 400::BIGINT, 400::BIGINT, 400e0), ('val', 100, 100, 100e0)) t(role, least, most, mean)")
def split_sizes(spark, sf):
    return D.sizes(D.kfold(layout.spectra(spark, sf)))


# Joins by sample.


@query("join_labels_left", "SELECT d.doc_id AS sample_idx, coalesce(quality::VARCHAR, '') AS label, toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def join_labels_left(spark, sf):
    docs = layout.table(spark, sf, "documents").select(F.col("doc_id").alias("sample_idx"))
    labels = layout.table(spark, sf, "labels").select(F.col("doc_id").alias("sample_idx"), F.col("quality").cast("string").alias("label"), "toxic")
    return J.join_labels(docs, labels)


@query("join_label_counts", "SELECT count(*) FILTER (l.doc_id IS NOT NULL) AS matched, count(*) FILTER (l.doc_id IS NULL) AS unlabelled, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)) AS unmatched_labels FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.doc_id % 3 <> 0")
def join_label_counts(spark, sf):
    docs = layout.table(spark, sf, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("sample_idx"))
    return J.match_counts(docs, layout.table(spark, sf, "labels").select(F.col("doc_id").alias("sample_idx")))


@query("join_by_position", "WITH a AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS k FROM embeddings), b AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier) SELECT vec_id AS sample_idx, s_name AS label FROM a JOIN b USING (k)")
def join_by_position(spark, sf):
    a = layout.spectra(spark, sf).orderBy("sample_idx").limit(layout.table(spark, sf, "supplier").count()).select("sample_idx")
    b = layout.table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("label"))
    return J.join_positions(a, "sample_idx", b, "s_suppkey", allowed=True).select("sample_idx", "label")


@query("join_metadata", "SELECT s_suppkey AS sample_idx, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_metadata(spark, sf):
    nation, region = layout.table(spark, sf, "nation"), layout.table(spark, sf, "region")
    s = layout.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample_idx"), F.col("s_nationkey").alias("n_nationkey"))
    one = J.join_metadata(s, nation, "n_nationkey").withColumnRenamed("n_regionkey", "r_regionkey")
    return J.join_metadata(one, region, "r_regionkey").select("sample_idx", "n_name", "r_name")


@query("join_split_check", "SELECT 'unknown' AS problem, count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 4 <> 1) UNION ALL SELECT 'omitted', count(*) FROM documents WHERE doc_id % 4 <> 1 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def join_split_check(spark, sf):
    docs = layout.table(spark, sf, "documents").where("doc_id % 4 <> 1").select(F.col("doc_id").alias("sample_idx"))
    return J.coverage_problems(docs, layout.table(spark, sf, "labels").select(F.col("doc_id").alias("sample_idx")))


@query("join_class_mean_distance", "WITH $LONG, m AS (SELECT label AS other, band, avg(v) AS m FROM cells WHERE role = 'train' GROUP BY ALL) SELECT sample_idx, other, R(sqrt(sum((v - m) ** 2))) AS distance FROM cells JOIN m USING (band) WHERE role = 'test' GROUP BY ALL")
def join_class_means(spark, sf):
    df = layout.spectra(spark, sf)
    return J.class_distances(df.where("role = 'train'"), df.where("role = 'test'")).withColumn("distance", r6(F.col("distance")))


@query("join_distance_matrix", "WITH u AS (SELECT vec_id AS i, unnest(range(64)) AS band, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT a.i AS a, b.i AS b, R(sqrt(sum((a.v - b.v) ** 2))) AS distance FROM u a JOIN u b ON a.band = b.band AND a.i < b.i GROUP BY ALL")
def join_distance_matrix(spark, sf):
    return J.distance_matrix(layout.spectra(spark, sf)).withColumn("distance", r6_column(F.col("distance")))


@query("join_grid", "SELECT r_name, n_name, part_kind FROM region, nation, (SELECT unnest(['x', 'y']) AS part_kind)")
def join_grid(spark, sf):
    kinds = spark.createDataFrame([("x",), ("y",)], "part_kind string")
    return J.product(layout.table(spark, sf, "region").select("r_name"), layout.table(spark, sf, "nation").select("n_name"), kinds)


@query("join_semi_anti", "SELECT doc_id AS sample_idx, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents")
def join_semi_anti(spark, sf):
    docs = layout.table(spark, sf, "documents").select(F.col("doc_id").alias("sample_idx"))
    ids = layout.table(spark, sf, "labels").select(F.col("doc_id").alias("sample_idx"))
    return docs.join(ids, "sample_idx", "left_semi").withColumn("labelled", F.lit(True)).unionByName(docs.join(ids, "sample_idx", "left_anti").withColumn("labelled", F.lit(False)))
