"""Queries of the preprocessing operators over the spectra table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .. import layout
from ..functions import kernels
from ..functions.spectral import r6
from ..operators import preprocess as P
from ..registry import query

WIDTH = 64


def _cells(df):
    return layout.to_long(df, "sample_idx").select("sample_idx", "band", r6(F.col("v")).alias("v"))


def _applied(m: np.ndarray, source: str = "cells") -> str:
    rows = ", ".join(f"({int(i)}, {int(j)}, {float(m[i, j])!r}::DOUBLE)" for i, j in zip(*np.nonzero(m)))
    return f"WITH $LONG, m(i, j, w) AS (VALUES {rows}) SELECT sample_idx, i::INT AS band, R(sum(w * v)) AS v FROM {source} JOIN m ON band = j GROUP BY ALL"


@query("snv_class_mean", "WITH $LONG, n AS (SELECT *, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS z FROM cells WINDOW w AS (PARTITION BY sample_idx)) SELECT label, band, R(avg(z)) AS v FROM n GROUP BY ALL")
def snv_class_mean(spark, sf):
    df = layout.spectra(spark, sf).withColumn("x", P.snv(F.col("x")))
    return layout.to_long(df, "label").groupBy("label", "band").agg(r6(F.avg("v")).alias("v"))


def _row(name, expression, sql, shift=0.0):
    def run(spark, sf):
        df = layout.spectra(spark, sf)
        if shift:
            df = df.withColumn("x", F.transform("x", lambda v: v + shift))
        return _cells(df.withColumn("x", expression(F.col("x"))))

    query(f"prep_{name}", sql)(run)


_W = "WINDOW w AS (PARTITION BY sample_idx), o AS (PARTITION BY sample_idx ORDER BY band)"
_row("snv", P.snv, f"WITH $LONG SELECT sample_idx, band, R((v - avg(v) OVER w) / stddev_pop(v) OVER w) AS v FROM cells {_W}")
_row("l2", P.l2_normalization, f"WITH $LONG SELECT sample_idx, band, R(v / sqrt(sum(v * v) OVER w)) AS v FROM cells {_W}")
_row("area", P.area_normalization, f"WITH $LONG, c AS (SELECT sample_idx, band, v + 2e0 AS v FROM cells) SELECT sample_idx, band, R(v / sum(v) OVER w) AS v FROM c {_W}", 2.0)
_row("max_abs", P.max_abs_normalization, f"WITH $LONG SELECT sample_idx, band, R(v / max(abs(v)) OVER w) AS v FROM cells {_W}")
_row("moving_average", P.moving_average, "WITH $LONG SELECT sample_idx, band, R(avg(v) OVER (PARTITION BY sample_idx ORDER BY band ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS v FROM cells")
_row("median_filter", P.median_filter, "WITH $LONG, k(d) AS (VALUES (-2), (-1), (0), (1), (2)) SELECT a.sample_idx, a.band, R(median(b.v)) AS v FROM cells a, k JOIN cells b ON b.sample_idx = a.sample_idx AND b.band = greatest(0, least(63, a.band + d)) GROUP BY ALL")
_row("detrend", P.detrend, "WITH $LONG, s AS (SELECT sample_idx, regr_slope(v, band) AS b FROM cells GROUP BY ALL) SELECT sample_idx, band, R(v - b * (band - 31.5e0)) AS v FROM cells JOIN s USING (sample_idx)")
_row("snv_detrend", lambda x: P.detrend(P.snv(x)), f"WITH $LONG, n AS (SELECT sample_idx, band, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS v FROM cells {_W}), s AS (SELECT sample_idx, regr_slope(v, band) AS b FROM n GROUP BY ALL) SELECT sample_idx, band, R(v - b * (band - 31.5e0)) AS v FROM n JOIN s USING (sample_idx)")
_row("linear_baseline", P.linear_baseline, "WITH $LONG, e AS (SELECT sample_idx, embedding[1]::DOUBLE AS a, embedding[64]::DOUBLE AS z FROM spec) SELECT sample_idx, band, R(v - (a + (z - a) / 63 * band)) AS v FROM cells JOIN e USING (sample_idx)")
_row("absorbance", P.absorbance, "WITH $LONG SELECT sample_idx, band, R(-log10(v + 2e0)) AS v FROM cells", 2.0)
_row("log", P.log_transform, "WITH $LONG SELECT sample_idx, band, R(ln(v + 2e0)) AS v FROM cells", 2.0)
_row("none", lambda x: x, "WITH $LONG SELECT sample_idx, band, R(v) AS v FROM cells")
_row("savgol", lambda x: P.smooth(x, WIDTH, 7, 2), _applied(kernels.savgol(WIDTH, 7, 2)))
_row("first_derivative", lambda x: P.smooth(x, WIDTH, 7, 2, 1), _applied(kernels.savgol(WIDTH, 7, 2, 1)))
_row("second_derivative", lambda x: P.smooth(x, WIDTH, 9, 3, 2), _applied(kernels.savgol(WIDTH, 9, 3, 2)))
_row("gaussian", lambda x: P.gaussian_smoothing(x, WIDTH), _applied(kernels.gaussian(WIDTH)))
_row("polynomial_baseline", lambda x: P.polynomial_baseline(x, WIDTH, 2), "WITH $LONG, t AS (SELECT *, band - 31.5e0 AS u, (band - 31.5e0) ** 2 - 341.25e0 AS q FROM cells), c AS (SELECT sample_idx, avg(v) AS a, sum(v * u) / sum(u * u) AS b, sum(v * q) / sum(q * q) AS d FROM t GROUP BY ALL) SELECT sample_idx, band, R(v - (a + b * u + d * q)) AS v FROM t JOIN c USING (sample_idx)")
_row("rubberband", P.rubberband_baseline, "WITH $LONG, h AS (SELECT a.sample_idx, m.band, min(a.v + (b.v - a.v) * (m.band - a.band) / (b.band - a.band)) AS h FROM cells a JOIN cells b ON a.sample_idx = b.sample_idx AND a.band < b.band JOIN (SELECT unnest(range(64)) AS band) m ON m.band BETWEEN a.band AND b.band GROUP BY ALL) SELECT sample_idx, c.band, R(v - h) AS v FROM cells c JOIN h USING (sample_idx, band)")
_row("als", lambda x: P.als_baseline(x), None)
_row("band_select", lambda x: P.take_bands(x, P.band_positions(list(range(900, 900 + 10 * WIDTH, 10)), P.parse_ranges("1000:950,1400:1450"))), "WITH $LONG, k AS (SELECT *, 900 + 10 * band AS nm FROM cells), s AS (SELECT *, row_number() OVER (PARTITION BY sample_idx ORDER BY band) - 1 AS pos FROM k WHERE nm BETWEEN 950 AND 1000 OR nm BETWEEN 1400 AND 1450) SELECT sample_idx, pos::INT AS band, R(v) AS v FROM s")
_row("band_remove", lambda x: P.take_bands(x, P.band_positions(list(range(900, 900 + 10 * WIDTH, 10)), P.parse_ranges("1000:1400"), keep=False)), "WITH $LONG, k AS (SELECT *, 900 + 10 * band AS nm FROM cells), s AS (SELECT *, row_number() OVER (PARTITION BY sample_idx ORDER BY band) - 1 AS pos FROM k WHERE nm NOT BETWEEN 1000 AND 1400) SELECT sample_idx, pos::INT AS band, R(v) AS v FROM s")


def _fitted(method, statistics, value):
    sql = f"WITH $LONG, f AS (SELECT band, {statistics} FROM cells WHERE role = 'train' GROUP BY ALL) SELECT sample_idx, band, R({value}) AS v FROM cells JOIN f USING (band)"

    def run(spark, sf):
        df, _ = P.preprocess(layout.spectra(spark, sf), [method])
        return _cells(df)

    query(f"prep_{method}", sql)(run)


_fitted("mean_centering", "avg(v) AS m", "v - m")
_fitted("standardization", "avg(v) AS m, stddev_pop(v) AS s", "(v - m) / s")
_fitted("minmax_scaling", "min(v) AS a, max(v) AS b", "(v - a) / (b - a)")
_fitted("robust_scaling", "quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.75) AS b", "(v - m) / (b - a)")
_fitted("pareto_scaling", "avg(v) AS m, stddev_pop(v) AS s", "(v - m) / sqrt(s)")


@query("prep_msc", "WITH $LONG, f AS (SELECT band, avg(v) AS m FROM cells WHERE role = 'train' GROUP BY ALL), c AS (SELECT sample_idx, regr_slope(v, m) AS b, regr_intercept(v, m) AS a FROM cells JOIN f USING (band) GROUP BY ALL) SELECT sample_idx, band, R((v - a) / b) AS v FROM cells JOIN c USING (sample_idx) WHERE abs(b) > 0.01")
def msc(spark, sf):
    # slopes near zero magnify the last bits, which engines sum in different orders
    df = layout.spectra(spark, sf)
    fit = P.fit_bands(df.where("role = 'train'"))
    slope = df.crossJoin(F.broadcast(fit)).select("sample_idx", F.expr("x"), "mean")
    long = slope.select("sample_idx", F.posexplode(F.arrays_zip("x", "mean")).alias("band", "c")).groupBy("sample_idx").agg(F.regr_slope("c.x", "c.mean").alias("b"))
    return _cells(P.apply_fitted(df, fit, "msc").join(long.where("abs(b) > 0.01"), "sample_idx"))


@query("prep_chain", "WITH $LONG, k AS (SELECT * FROM cells WHERE 900 + 10 * band <= 1200), n AS (SELECT *, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS z FROM k WINDOW w AS (PARTITION BY sample_idx)), f AS (SELECT band, avg(z) AS m FROM n WHERE role = 'train' GROUP BY ALL) SELECT sample_idx, band, R(z - m) AS v FROM n JOIN f USING (band)")
def chain(spark, sf):
    """Band methods are hoisted: the range is cut before SNV although it is named last."""
    df, warnings = P.preprocess(layout.spectra(spark, sf), ["snv", "mean_centering", "band_range_select"], axis=[900.0 + 10 * i for i in range(WIDTH)], band_range="900:1200")
    assert warnings == ["PREPROCESS_ORDER_NORMALIZED"]
    return _cells(df)


@query("prep_iterations", "WITH $LONG, it AS (SELECT unnest(range(3)) AS iteration_id), r AS (SELECT iteration_id::INT AS iteration_id, sample_idx, band, v, CASE WHEN sample_idx % 3 = iteration_id THEN 'val' ELSE 'train' END AS role FROM cells, it), f AS (SELECT iteration_id, band, avg(v) AS m, stddev_pop(v) AS s FROM r WHERE role = 'train' GROUP BY ALL) SELECT iteration_id, sample_idx, band, R((v - m) / s) AS v FROM r JOIN f USING (iteration_id, band) WHERE role = 'val'")
def iterations(spark, sf):
    """Three folds standardised in one job, each by its own training rows."""
    df = layout.spectra(spark, sf).drop("role").select(F.explode(F.array(*(F.lit(i) for i in range(3)))).alias("iteration_id"), "*")
    df = df.withColumn("role", F.when(F.col("sample_idx") % 3 == F.col("iteration_id"), "val").otherwise("train"))
    out, _ = P.preprocess(df, ["standardization"], iteration="iteration_id")
    return layout.to_long(out.where("role = 'val'"), "iteration_id", "sample_idx").select("iteration_id", "sample_idx", "band", r6(F.col("v")).alias("v"))
