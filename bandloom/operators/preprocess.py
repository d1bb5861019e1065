"""Preprocessing: scatter correction, scaling, smoothing, derivatives, baselines.

Row methods are expressions over the array column. Fitted methods take statistics from training
rows only (``role = 'train'``), one row of arrays by iteration, and join it back; folds and repeats
are fitted in one job by putting ``iteration_id`` among the keys.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BandloomError, confirm, require
from ..functions import kernels, spectral

#: Other names of methods.
ALIASES = {
    "savitzky_golay": "sg_smoothing", "sg": "sg_smoothing", "savgol": "sg_smoothing", "1st_derivative": "first_derivative", "derivative_1": "first_derivative", "2nd_derivative": "second_derivative",
    "derivative_2": "second_derivative", "mean_center": "mean_centering", "center": "mean_centering", "zscore": "standardization", "standardize": "standardization", "minmax": "minmax_scaling",
    "min_max": "minmax_scaling", "robust": "robust_scaling", "pareto": "pareto_scaling", "l2": "l2_normalization", "area": "area_normalization", "max_abs": "max_abs_normalization",
    "reflectance_absorbance": "reflectance_to_absorbance", "transmittance_absorbance": "transmittance_to_absorbance", "baseline_linear": "linear_baseline", "baseline_polynomial": "polynomial_baseline",
    "poly_baseline": "polynomial_baseline", "rubberband": "rubberband_baseline", "als": "als_baseline", "band_select": "band_range_select", "select_band_range": "band_range_select", "remove_band_range": "remove_band_ranges",
}
#: Names that this engine takes besides.
OWN_ALIASES = {"standard_normal_variate": "snv", "autoscale": "standardization", "multiplicative_scatter_correction": "msc", "d1": "first_derivative", "d2": "second_derivative", "raw": "none"}
#: Known methods that are left out on purpose.
ADVANCED = ("osc", "emsc", "wavelet", "airpls", "arpls", "opls", "epo", "glsw")


def snv(x: Column) -> Column:
    """Each spectrum minus its mean over its standard deviation (divisor n); a constant one is an error."""

    def centre(r):
        guarded = F.when(r["s"] == 0, F.raise_error(F.lit("SNV_ZERO_VARIANCE_SPECTRUM")).cast("double")).otherwise(r["s"])
        return spectral.let(lambda q: F.transform(q["x"], lambda v: (v - q["m"]) / q["s"]), x=r["x"], m=r["m"], s=guarded)

    return spectral.let(lambda t: spectral.let(centre, x=t["x"], m=spectral.mean(t["x"]), s=spectral.std0(t["x"])), x=x)


def l2_normalization(x: Column) -> Column:
    return spectral.let(lambda t: spectral.over(t["x"], spectral.norm(t["x"]), "L2_ZERO_NORM"), x=x)


def area_normalization(x: Column) -> Column:
    return spectral.let(lambda t: spectral.over(t["x"], spectral.total(t["x"]), "AREA_ZERO_SUM"), x=x)


def max_abs_normalization(x: Column) -> Column:
    return spectral.let(lambda t: spectral.over(t["x"], F.array_max(F.transform(t["x"], lambda v: F.abs(v))), "MAX_ABS_ZERO"), x=x)


def moving_average(x: Column, window: int = 5) -> Column:
    """Mean over an odd window that is cut off at the ends."""
    require(window % 2 == 1, "WINDOW_EVEN", "the window must be odd", window=window)
    half = window // 2

    def at(x, i):
        lo, hi = F.greatest(i - half, F.lit(0)), F.least(i + half, F.size(x) - 1)
        return spectral.total(F.slice(x, lo + 1, hi - lo + 1)) / (hi - lo + 1)

    return spectral.let(lambda t: F.transform(t["x"], lambda v, i: at(t["x"], i)), x=x)


def median_filter(x: Column, window: int = 5) -> Column:
    """Median over an odd window; the end values are repeated."""
    require(window % 2 == 1, "WINDOW_EVEN", "the window must be odd", window=window)
    half = window // 2
    padded = lambda x: F.concat(F.array_repeat(x[0], half), x, F.array_repeat(F.element_at(x, -1), half))
    middle = lambda p, i: F.element_at(F.array_sort(F.slice(p, i + 1, window)), half + 1)
    return spectral.let(lambda t: spectral.let(lambda q: F.transform(q["x"], lambda v, i: middle(q["p"], i)), x=t["x"], p=padded(t["x"])), x=x)


def _index_slope(x: Column) -> Column:
    n = F.size(x)
    centred = F.aggregate(F.transform(x, lambda v, i: v * (i - (n - 1) / 2)), F.lit(0.0), lambda a, v: a + v)
    return centred / (n * (n * n - 1) / 12.0)


def detrend(x: Column) -> Column:
    """Minus the slope of the line over the band index; the mean stays."""
    return spectral.let(lambda t: spectral.let(lambda q: F.transform(q["x"], lambda v, i: v - q["b"] * (i - (F.size(q["x"]) - 1) / 2)), x=t["x"], b=_index_slope(t["x"])), x=x)


def linear_baseline(x: Column) -> Column:
    """Minus the chord between the ends."""
    step = lambda x: (F.element_at(x, -1) - x[0]) / (F.size(x) - 1)
    return spectral.let(lambda t: spectral.let(lambda q: F.transform(q["x"], lambda v, i: v - (q["x"][0] + q["d"] * i)), x=t["x"], d=step(t["x"])), x=x)


def _positive(x: Column, f: Callable[[Column], Column], code: str) -> Column:
    return F.transform(x, lambda v: F.when(v <= 0, F.raise_error(F.lit(code)).cast("double")).otherwise(f(v)))


def absorbance(x: Column) -> Column:
    """-log10 of reflectance or transmittance."""
    return _positive(x, lambda v: -F.log10(v), "ABSORBANCE_NON_POSITIVE")


def log_transform(x: Column) -> Column:
    return _positive(x, lambda v: F.log(v), "LOG_NON_POSITIVE")


def smooth(x: Column, width: int, window: int, polyorder: int, deriv: int = 0) -> Column:
    """Savitzky-Golay: a banded matrix built once, applied row by row inside generated code."""
    return spectral.matvec(kernels.savgol(width, window, polyorder, deriv), x)


def gaussian_smoothing(x: Column, width: int, sigma: float = 1.0) -> Column:
    return spectral.matvec(kernels.gaussian(width, sigma), x)


def polynomial_baseline(x: Column, width: int, degree: int = 2) -> Column:
    return spectral.matvec(kernels.polynomial_residual(width, degree), x)


def rubberband_baseline(x: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        import numpy as np

        return v.map(lambda a: kernels.rubberband(np.asarray(a, float)))

    return run(x)


def als_baseline(x: Column, lam: float = 1e5, p: float = 1e-3, rounds: int = 10) -> Column:
    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series(list(kernels.als(np.array(v.tolist(), float), lam, p, rounds))) if len(v) else v

    return run(x)


def in_ranges(value: Column, ranges: list[tuple[float, float]]) -> Column:
    hit = F.lit(False)
    for a, b in ranges:
        hit = hit | value.between(min(a, b), max(a, b))
    return hit


def parse_ranges(text: str) -> list[tuple[float, float]]:
    """``a:b`` ranges, comma-separated; reversed bounds are swapped."""
    out = []
    for part in text.split(","):
        bits = part.split(":")
        require(len(bits) == 2, "BAND_RANGE", "a range is written low:high", text=part)
        a, b = map(float, bits)
        out.append((min(a, b), max(a, b)))
    return out


def band_positions(axis: list[float], ranges: list[tuple[float, float]], keep: bool = True) -> list[int]:
    """Positions of the bands inside (or outside) the ranges; none is an error."""
    out = [i for i, v in enumerate(axis) if any(a <= v <= b for a, b in ranges) == keep]
    require(bool(out), "BAND_RANGE_EMPTY", "no band is left", ranges=ranges)
    return out


def take_bands(x: Column, positions: list[int]) -> Column:
    return spectral.let(lambda t: F.transform(F.array(*(F.lit(int(p)) for p in positions)), lambda i: F.element_at(t["x"], i + 1)), x=x)


# Fitted methods: statistics by band over training rows.

FITTED = ("mean_centering", "standardization", "minmax_scaling", "robust_scaling", "pareto_scaling", "msc")


def fit_bands(train: DataFrame, *keys: str, quantiles: bool = False) -> DataFrame:
    """One row (by iteration): arrays of mean, std0, min, max (and quartiles) of each band, from training rows."""
    stats = [F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")]
    if quantiles:
        stats += [F.percentile("v", F.lit(q)).alias(n) for n, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    long = train.select(*keys, F.posexplode("x").alias("band", "v")).groupBy(*keys, "band").agg(*stats)
    names = ["mean", "std", "min", "max", *(["q1", "median", "q3"] if quantiles else [])]
    cells = F.array_sort(F.collect_list(F.struct("band", *names)))
    return long.groupBy(*keys).agg(cells.alias("cells")).select(*keys, *(F.col(f"cells.{n}").alias(n) for n in names))


def apply_fitted(df: DataFrame, fit: DataFrame, method: str, *keys: str) -> DataFrame:
    """df with x transformed by the statistics of its iteration (a row per iteration, broadcast)."""
    both = df.join(F.broadcast(fit), list(keys)) if keys else df.crossJoin(F.broadcast(fit))
    guard = lambda d: F.when(d == 0, F.raise_error(F.lit(f"{method.upper()}_ZERO_SCALE")).cast("double")).otherwise(d)
    centred = lambda c: F.zip_with("x", c, lambda v, m: v - m)
    if method == "mean_centering":
        x = centred("mean")
    elif method == "standardization":
        x = F.zip_with(centred("mean"), "std", lambda v, d: v / guard(d))
    elif method == "pareto_scaling":
        x = F.zip_with(centred("mean"), "std", lambda v, d: v / F.sqrt(guard(d)))
    elif method == "minmax_scaling":
        x = F.zip_with(centred("min"), F.zip_with("max", "min", lambda a, b: a - b), lambda v, d: v / guard(d))
    elif method == "robust_scaling":
        x = F.zip_with(centred("median"), F.zip_with("q3", "q1", lambda a, b: a - b), lambda v, d: v / guard(d))
    elif method == "msc":
        means = dict(x=F.col("x"), r=F.col("mean"), xm=spectral.mean(F.col("x")), rm=spectral.mean(F.col("mean")))

        def corrected(t):
            slope = spectral.total(F.zip_with(t["x"], t["r"], lambda v, r: (v - t["xm"]) * (r - t["rm"]))) / spectral.total(F.transform(t["r"], lambda r: (r - t["rm"]) * (r - t["rm"])))
            return spectral.let(lambda q: F.transform(q["x"], lambda v: (v - (q["xm"] - q["b"] * q["rm"])) / q["b"]), x=t["x"], xm=t["xm"], rm=t["rm"], b=guard(slope))

        x = spectral.let(corrected, **means)
    else:
        raise BandloomError("UNKNOWN_METHOD", f"{method} isn't a fitted method")
    return both.select(*(x.alias("x") if c == "x" else F.col(c) for c in df.columns))


def normalise(methods: list[str]) -> tuple[list[str], list[str]]:
    """Canonical method names with band methods first, and warnings; ``none`` stands alone."""
    plain = [m.strip().lower().replace("-", "_").replace(" ", "_") for m in methods]
    names = [ALIASES.get(m) or OWN_ALIASES.get(m, m) for m in plain] or ["none"]
    for m in names:
        require(m not in ADVANCED, "ADVANCED_METHOD", f"{m} isn't offered", method=m)
        require(m in METHODS, "UNKNOWN_METHOD", f"{m} isn't a preprocessing method", method=m)
    require(len(names) == 1 or "none" not in names, "NONE_EXCLUSIVE", "none can't be combined")
    first = [m for m in names if m in ("band_range_select", "remove_band_ranges")]
    order = first + [m for m in names if m not in first]
    warnings = ["PREPROCESS_ORDER_NORMALIZED"] if order != names else []
    warnings += ["SNV_WITH_MSC"] if {"snv", "msc"} <= set(order) else []
    warnings += ["LONG_CHAIN"] if len(order) > 5 else []
    return order, warnings


def preprocess(df: DataFrame, methods: list[str], *, axis: list[float] | None = None, iteration: str | None = None, unsplit_ok: bool = False, baseline_ok: bool = False, absorbance_ok: bool = False, **p) -> tuple[DataFrame, list[str]]:
    """Apply a chain to x. Fitted methods use rows with role 'train' (of each iteration)."""
    order, warnings = normalise(methods)
    keys = (iteration,) if iteration else ()
    for m in order:
        x = F.col("x")
        if m in ("band_range_select", "remove_band_ranges"):
            require(axis is not None, "BAND_AXIS_MISSING", "band ranges need the band axis")
            at = band_positions(axis, parse_ranges(p["band_range"]), keep=m == "band_range_select")
            axis = [axis[i] for i in at]
            df = df.withColumn("x", take_bands(x, at))
        elif m in FITTED:
            if "role" not in df.columns:
                confirm(unsplit_ok, "UNSPLIT_FIT", f"{m} would be fitted on all rows: split first, or say that it's meant", method=m)
            train = df.where("role = 'train'") if "role" in df.columns else df
            df = apply_fitted(df, fit_bands(train, *keys, quantiles=m == "robust_scaling"), m, *keys)
        elif m != "none":
            if m.endswith("_baseline"):
                confirm(baseline_ok, "BASELINE_CONFIRM", "a baseline correction changes peak heights", method=m)
            if m.endswith("_to_absorbance"):
                confirm(absorbance_ok, "ABSORBANCE_CONFIRM", "check that the values are reflectance or transmittance", method=m)
            df = df.withColumn("x", METHODS[m](x, p | {"width": len(axis) if axis else p.get("width")}))
    return df, warnings


#: Every method: expression from x and the parameters; None where the chain handles it.
METHODS: dict[str, Callable[[Column, dict], Column] | None] = {
    "none": None, "band_range_select": None, "remove_band_ranges": None, **dict.fromkeys(FITTED),
    "snv": lambda x, p: snv(x),
    "l2_normalization": lambda x, p: l2_normalization(x),
    "area_normalization": lambda x, p: area_normalization(x),
    "max_abs_normalization": lambda x, p: max_abs_normalization(x),
    "sg_smoothing": lambda x, p: smooth(x, p["width"], p["window_length"], p["polyorder"]),
    "first_derivative": lambda x, p: smooth(x, p["width"], p["window_length"], p["polyorder"], 1),
    "second_derivative": lambda x, p: smooth(x, p["width"], p["window_length"], p["polyorder"], 2),
    "moving_average": lambda x, p: moving_average(x, p.get("window_length", 5)),
    "gaussian_smoothing": lambda x, p: gaussian_smoothing(x, p["width"], p.get("sigma", 1.0)),
    "median_filter": lambda x, p: median_filter(x, p.get("window_length", 5)),
    "detrend": lambda x, p: detrend(x),
    "snv_detrend": lambda x, p: detrend(snv(x)),
    "linear_baseline": lambda x, p: linear_baseline(x),
    "polynomial_baseline": lambda x, p: polynomial_baseline(x, p["width"], p.get("poly_degree", 2)),
    "rubberband_baseline": lambda x, p: rubberband_baseline(x),
    "als_baseline": lambda x, p: als_baseline(x, p.get("als_lambda", 1e5), p.get("als_p", 1e-3), p.get("als_iterations", 10)),
    "reflectance_to_absorbance": lambda x, p: absorbance(x),
    "transmittance_to_absorbance": lambda x, p: absorbance(x),
    "log_transform": lambda x, p: log_transform(x),
}
