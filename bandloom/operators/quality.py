"""Quality checks over spectra: missing cells, axis, constants, statistics, spikes, similarity, duplicates, outliers, imputation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import confirm, require
from ..functions import arrow, shared, spectral

#: Thresholds of the checks.
ROBUST_Z, MAD_SCALE, SPIKE, SPIKE_CAP, LOW_VARIANCE = 3.5, 1.4826, 6.0, 999.0, 1e-12
STATISTICS = ("mean", "std", "min", "max", "range", "area", "l2", "d1_std", "d2_std", "max_jump", "roughness")


def contract_check(df: DataFrame, n_samples: int, n_bands: int, supervised: bool = False) -> DataFrame:
    """One row: whether counts and ids agree with the contract."""
    return df.agg(
        (F.count(F.lit(1)) == n_samples).alias("samples_ok"), F.coalesce(F.bool_and(F.size("x") == n_bands), F.lit(True)).alias("bands_ok"),
        (F.count("sample_idx") == F.count(F.lit(1))).alias("ids_present"), (F.count_distinct("sample_idx") == F.count("sample_idx")).alias("ids_unique"),
        (F.lit(not supervised) | (F.count("label") == F.count(F.lit(1)))).alias("labels_ok"),
    )


def missing(long: DataFrame) -> DataFrame:
    """Missing cells by sample, by band and in all; one pass with grouping sets."""
    return long.groupingSets([["sample_idx"], ["band"], []], "sample_idx", "band").agg(F.count_if(F.col("v").isNull()).alias("n_missing"), F.count(F.lit(1)).alias("n"), (F.count_if(F.col("v").isNull()) / F.count(F.lit(1))).alias("rate"))


def numeric_quality(long: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All-zero samples, all-zero bands (a missing cell counts as zero), and the largest absolute value."""
    zero = F.bool_and(F.coalesce("v", F.lit(0.0)) == 0)
    return long.groupBy("sample_idx").agg(zero.alias("z")).where("z").select("sample_idx"), long.groupBy("band").agg(zero.alias("z")).where("z").select("band"), long.agg(F.max(F.abs("v")).alias("max_abs"), (F.coalesce(F.max(F.abs("v")), F.lit(0.0)) > 1e12).alias("warn"))


def axis_check(axis: DataFrame) -> DataFrame:
    """One row about a band axis (band_idx, value): strictly monotonic, repeats, large gaps. The axis is a small table."""
    w = Window.orderBy("band_idx")
    steps = axis.withColumn("step", F.col("value") - F.lag("value").over(w))
    gap = steps.agg(F.median(F.abs("step")).alias("g"))
    return steps.crossJoin(gap).agg(
        (F.coalesce(F.bool_and(F.col("step") > 0), F.lit(True)) | F.coalesce(F.bool_and(F.col("step") < 0), F.lit(True))).alias("monotonic"),
        (F.count("value") - F.count_distinct("value")).alias("repeated"), F.count_if(F.abs("step") > 10 * F.col("g")).alias("large_gaps"), F.count_if(F.col("value").isNull()).alias("not_numeric"),
    )


def constant_bands(long: DataFrame) -> DataFrame:
    return long.groupBy("band").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo = hi").select("band")


def low_variance_bands(long: DataFrame, threshold: float = LOW_VARIANCE) -> DataFrame:
    return long.groupBy("band").agg(F.var_samp("v").alias("variance"), F.count("v").alias("n")).where((F.col("n") >= 2) & (F.col("variance") <= threshold)).select("band", "variance")


def class_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def class_balance(df: DataFrame) -> DataFrame:
    """One row: smallest and largest class, ratio, status by the sizes and the ratio."""
    counts = class_distribution(df.where("label is not null"))
    empty = df.where("label is null").agg(F.count(F.lit(1)).alias("unlabelled"))
    one = counts.agg(F.count(F.lit(1)).alias("classes"), F.min("n").alias("least"), F.max("n").alias("most"))
    ratio = F.col("most") / F.col("least")
    status = F.when(F.col("least") < 3, "blocked").when(ratio > 10, "severe").when((F.col("least") < 5) | (ratio > 5), "warning").otherwise("passed")
    return one.crossJoin(empty).select("classes", "least", "most", ratio.alias("ratio"), "unlabelled", status.alias("status"))


def target_check(df: DataFrame, y: str = "y") -> DataFrame:
    """Regression targets outside Tukey's fences."""
    q = df.agg(F.percentile(y, F.lit(0.25)).alias("q1"), F.percentile(y, F.lit(0.75)).alias("q3"))
    return df.crossJoin(F.broadcast(q)).where((F.col(y) < F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) | (F.col(y) > F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))).select("sample_idx", y)


def sample_statistics(df: DataFrame) -> DataFrame:
    """Eleven measures of each spectrum, without a shuffle."""
    x = F.col("x")
    d = df.select("sample_idx", "x", spectral.diff(x).alias("d1")).withColumn("d2", spectral.diff(F.col("d1")))
    value = {
        "mean": spectral.mean(x), "std": spectral.std1(x), "min": F.array_min("x"), "max": F.array_max("x"), "range": F.array_max("x") - F.array_min("x"), "area": spectral.total(x), "l2": spectral.norm(x),
        "d1_std": spectral.std1(F.col("d1")), "d2_std": spectral.std1(F.col("d2")), "max_jump": F.array_max(F.transform("d1", lambda v: F.abs(v))), "roughness": spectral.mean(F.transform("d2", lambda v: F.abs(v))),
    }
    return d.select("sample_idx", *(value[k].alias(k) for k in STATISTICS))


def robust_z(metrics: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(sample_idx, metric, value, z): distance to the median over the scaled MAD; without spread, over the sample deviation."""
    long = metrics.select("sample_idx", F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names))).alias("m")).select("sample_idx", "m.metric", "m.value")
    med = long.groupBy("metric").agg(F.median("value").alias("med"), F.stddev_samp("value").alias("sd"))
    away = long.join(F.broadcast(med), "metric")  # a row per metric
    mad = away.groupBy("metric").agg(F.median(F.abs(F.col("value") - F.col("med"))).alias("mad"))
    both = away.join(F.broadcast(mad), "metric")
    scale = F.when(F.col("mad") > 0, MAD_SCALE * F.col("mad")).otherwise(F.greatest("sd", F.lit(1e-12)))
    return both.select("sample_idx", "metric", "value", ((F.col("value") - F.col("med")) / scale).alias("z"))


def spikes(df: DataFrame, half: int = 2) -> DataFrame:
    """Hampel scores above the threshold: (sample_idx, band, score); windows are cut off at the ends."""

    def middle(w):
        s = F.array_sort(w)
        n = F.size(s)
        return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / 2

    def score(w, v):
        def scored(t):
            spread = MAD_SCALE * t["mad"]
            away = F.abs(v - t["m"])
            return F.when(t["mad"] < 1e-8, F.when(away < 1e-8, 0.0).otherwise(SPIKE_CAP)).otherwise(F.least(away / spread, F.lit(SPIKE_CAP)))

        return spectral.let(lambda t: spectral.let(scored, m=t["m"], mad=middle(F.transform(t["w"], lambda u: F.abs(u - t["m"])))), m=middle(w), w=w)

    def around(x, i):
        lo, hi = F.greatest(i - half, F.lit(0)), F.least(i + half, F.size(x) - 1)
        return F.slice(x, lo + 1, hi - lo + 1)

    scores = F.transform("x", lambda v, i: score(around(F.col("x"), i), v))
    return df.select("sample_idx", F.posexplode(scores).alias("band", "score")).where(F.col("score") > SPIKE)


def spike_summary(df: DataFrame, half: int = 2) -> DataFrame:
    """By sample with spikes: count, ratio, largest score and a severity before corroboration."""
    width = F.size("x")
    found = spikes(df, half).groupBy("sample_idx").agg(F.count(F.lit(1)).alias("n_spikes"), F.max("score").alias("max_score"))
    both = found.join(df.select("sample_idx", width.alias("p")), "sample_idx")
    ratio = F.col("n_spikes") / F.col("p")
    return both.select("sample_idx", "n_spikes", "max_score", ratio.alias("ratio"), F.when((F.col("max_score") >= 8) | (ratio >= 0.003), "moderate").otherwise("minor").alias("severity"), (F.col("n_spikes") >= F.greatest(F.lit(5), F.ceil(0.003 * F.col("p")))).alias("enough"))


def refine_spikes(summary: DataFrame, rough: DataFrame, residual: DataFrame, dissimilar: DataFrame) -> DataFrame:
    """Severe only with enough high spikes and a second witness: roughness, Q residual or low similarity (frames of sample_idx)."""
    witness = rough.select("sample_idx").union(residual.select("sample_idx")).union(dissimilar.select("sample_idx")).distinct().withColumn("seen", F.lit(True))
    both = summary.join(witness, "sample_idx", "left")
    severe = F.col("enough") & (F.col("ratio") >= 0.003) & (F.col("max_score") >= 15) & F.coalesce("seen", F.lit(False))
    return both.select("sample_idx", "n_spikes", "max_score", F.when(severe, "severe").otherwise(F.col("severity")).alias("severity"))


def drift(df: DataFrame) -> DataFrame:
    """End-to-end slope, curvature and offset to the mean spectrum of each sample, as robust z, and a flag."""
    mean = band_means(df)
    both = df.crossJoin(F.broadcast(mean))
    x = F.col("x")
    m = both.select("sample_idx", ((F.element_at(x, -1) - x[0]) / (F.size(x) - 1)).alias("slope"), spectral.mean(F.transform(spectral.diff(spectral.diff(x)), lambda v: F.abs(v))).alias("curvature"), spectral.mean(F.zip_with("x", "mean_x", lambda a, b: a - b)).alias("offset"))
    z = robust_z(m, ("slope", "curvature", "offset"))
    return z.groupBy("sample_idx").agg(F.max(F.abs("z")).alias("max_z")).withColumn("flag", F.col("max_z") > ROBUST_Z)


def band_means(df: DataFrame, *keys: str) -> DataFrame:
    """Mean spectrum (by key) as one array."""
    means = df.select(*keys, F.posexplode("x").alias("band", "v")).groupBy(*keys, "band").agg(F.avg("v").alias("m"))
    cells = F.array_sort(F.collect_list(F.struct("band", "m")))
    return means.groupBy(*keys).agg(F.transform(cells, lambda c: c["m"]).alias("mean_x"))


def _pearson(x: Column, y: Column) -> Column:
    def with_means(t):
        a, b = F.transform(t["x"], lambda v: v - t["mx"]), F.transform(t["y"], lambda v: v - t["my"])
        return spectral.let(lambda q: spectral.dot(q["a"], q["b"]) / (spectral.norm(q["a"]) * spectral.norm(q["b"])), a=a, b=b)

    return spectral.let(with_means, x=x, y=y, mx=spectral.mean(x), my=spectral.mean(y))


def similarity(df: DataFrame) -> DataFrame:
    """Pearson and cosine to the mean spectrum, Pearson to the own and the best other class mean, and flags."""
    overall = F.broadcast(band_means(df))
    by_class = band_means(df, "label")  # a row per class
    base = df.crossJoin(overall).select("sample_idx", "label", "x", _pearson(F.col("x"), F.col("mean_x")).alias("pearson"), (spectral.dot(F.col("x"), F.col("mean_x")) / (spectral.norm(F.col("x")) * spectral.norm(F.col("mean_x")))).alias("cosine"))
    pairs = base.crossJoin(F.broadcast(by_class.select(F.col("label").alias("other"), "mean_x"))).withColumn("r", _pearson(F.col("x"), F.col("mean_x")))
    own = F.max(F.when(F.col("label") == F.col("other"), F.col("r")))
    best = F.max(F.when(F.col("label") != F.col("other"), F.col("r")))
    out = pairs.groupBy("sample_idx", "label", "pearson", "cosine").agg(own.alias("own"), best.alias("best_other"))
    return out.select("*", ((F.col("pearson") < 0.95) | (F.col("cosine") < 0.98)).alias("low_similarity"), (F.col("own") < 0.95).alias("low_own_class"), (F.col("best_other") - F.col("own") > 0.05).alias("mislabel"))


def _repeated(df: DataFrame) -> DataFrame:
    """A row per spectrum that several samples have: x, keep (the first of them), n and labels."""
    return df.groupBy("x").agg(F.min("sample_idx").alias("keep"), F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("labels")).where("n > 1")


def exact_duplicates(df: DataFrame) -> DataFrame:
    """(sample_idx, keep): samples whose spectrum another sample has too; keep is the first of them. Grouping, no pairs."""
    return df.join(_repeated(df), "x").select("sample_idx", "keep", (F.col("labels") > 1).alias("label_conflict"))


def _signed_buckets(df: DataFrame, planes: np.ndarray) -> DataFrame:
    """(sample_idx, bucket, signs): a row per table; the signs of all projections of the centred spectrum as one number a table."""
    tables, bits, _ = planes.shape
    flat, value = planes.reshape(tables * bits, -1).T, 1 << np.arange(bits)

    def run(batches):
        for batch in batches:
            x = arrow.matrix_of(batch.column(batch.schema.get_field_index("x")))
            if not len(x):
                continue
            signs = ((x - x.mean(axis=1, keepdims=True)) @ flat > 0).reshape(len(x), tables, bits) @ value
            keys = signs + (np.arange(tables) << bits)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("sample_idx")).cast(pa.int64()), pa.array(list(keys), pa.list_(pa.int64())), pa.array(list(signs), pa.list_(pa.int64()))], ["sample_idx", "keys", "signs"])

    made = df.select("sample_idx", "x").mapInArrow(run, "sample_idx long, keys array<long>, signs array<long>")
    return made.select("sample_idx", "signs", F.explode("keys").alias("bucket"))


def near_duplicates(df: DataFrame, *, high: float = 0.999, tables: int = 12, bits: int = 10) -> DataFrame:
    """Pairs of high correlation with their measures and whether they are strict duplicates.

    Pairs are looked for among samples that share a random-projection bucket in one of ``tables``
    tables of the standardised spectra: at a correlation of 0.999 a pair differs in one sign with
    probability 0.014, so it shares none of twelve ten-bit buckets with probability 1e-11.
    Equal spectra are left to exact_duplicates(); each distinct spectrum stands once, by its first sample.
    """
    width = df.select(F.size("x").alias("p")).first()
    if width is None:
        return df.select(F.col("sample_idx").alias("a"), F.col("sample_idx").alias("b")).limit(0)
    planes = np.random.default_rng(97).standard_normal((tables, bits, width.p))
    distinct = df.groupBy("x").agg(F.min("sample_idx").alias("sample_idx"), F.min_by("label", "sample_idx").alias("label"))
    a, b = (_signed_buckets(distinct, planes).select("bucket", *(F.col(c).alias(f"{c}_{s}") for c in ("sample_idx", "signs"))) for s in "ab")
    # of all signs of a pair at 0.999 about one in seventy differs; ten times as many are 1e-12 away
    differ = F.aggregate(F.zip_with("signs_a", "signs_b", lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, v: s + v)
    ids = a.join(b, (a.bucket == b.bucket) & (F.col("sample_idx_a") < F.col("sample_idx_b"))).where(differ <= -(-tables * bits // 7)).select("sample_idx_a", "sample_idx_b").distinct()
    side = lambda s: distinct.select(*(F.col(c).alias(f"{c}_{s}") for c in ("sample_idx", "label", "x")))
    pairs = ids.join(side("a"), "sample_idx_a").join(side("b"), "sample_idx_b")
    x, y = F.col("x_a"), F.col("x_b")
    cosine = spectral.dot(x, y) / (spectral.norm(x) * spectral.norm(y))
    rmse = F.sqrt(spectral.mean(F.zip_with(x, y, lambda u, v: (u - v) * (u - v)))) / F.greatest(F.sqrt(spectral.mean(F.transform(x, lambda u: u * u))), F.lit(1e-12))
    measured = pairs.select(F.col("sample_idx_a").alias("a"), F.col("sample_idx_b").alias("b"), _pearson(x, y).alias("corr"), cosine.alias("cosine"), rmse.alias("rel_rmse"), F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))).alias("sam"), (F.col("label_a") != F.col("label_b")).alias("label_conflict"))
    strict = (F.col("corr") > 0.9999) & (F.col("cosine") > 0.9999) & (F.col("rel_rmse") < 1e-3) & (F.col("sam") < 0.01)
    return measured.where((F.col("corr") > high) | strict).withColumn("strict", strict)


def duplicate_groups(pairs: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) of the pairs (a, b): their true closure, by joins and grouped minima, a written table a round.

    Each round links every neighbour of a node to the least of them, then lets labels jump to their own
    label's label, so the rounds are logarithmic in the longest chain.
    """
    edges = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    now, seen = shared.stored(edges, "edges"), None
    for _ in range(rounds):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        then = shared.stored(moved.union(small.select("a", F.col("m").alias("b"))).distinct(), "edges")
        shared.drop(now)
        now, was = then, seen
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == was:
            return nodes.join(now, nodes.node == now.a, "left").select("node", F.coalesce("b", "node").alias("component"))
    require(False, "GROUPS_UNSETTLED", "duplicate groups didn't settle", rounds=rounds)


def drop_duplicates(df: DataFrame, *, conflict_ok: bool = False) -> DataFrame:
    """The first sample of each exact duplicate group stays; groups with several labels are an error. Rows are told apart by spectrum, so that ids may repeat."""
    groups = _repeated(df)
    if not conflict_ok:
        require(not groups.where("labels > 1").limit(1).count(), "LABEL_CONFLICT", "equal spectra have different labels")
    first = df.join(groups.select("x", "keep"), "x").where(F.col("sample_idx") == F.col("keep")).dropDuplicates(["x"]).drop("keep")
    return df.join(groups.select("x"), "x", "left_anti").unionByName(first).select(*df.columns)


# Multivariate distances: the p x p moments are summed in Spark, the small matrix work is on the driver.


def moments(df: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and the centred scatter matrix (p x p) of x; partial sums by partition, one small row each."""

    def sums(batches):
        import pyarrow as pa

        n, s, g = 0, None, None
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float)
            if len(x):
                n += len(x)
                s = x.sum(axis=0) if s is None else s + x.sum(axis=0)
                g = x.T @ x if g is None else g + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([g.ravel().tolist()])], ["n", "s", "g"])

    parts = df.select("x").mapInArrow(sums, "n long, s array<double>, g array<double>")
    cells = parts.select("n", F.posexplode(F.concat("s", "g")).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("i").collect()  # p + p * p numbers
    require(bool(cells), "NO_ROWS", "there are no rows to take moments of")
    n, flat = int(cells[0]["n"]), np.array([r["v"] for r in cells])
    p = int((np.sqrt(1 + 4 * len(flat)) - 1) / 2 + 0.5)
    mean = flat[:p] / n
    return n, mean, flat[p:].reshape(p, p) - n * np.outer(mean, mean)


def pca_distances(df: DataFrame, components: int | None = None) -> DataFrame:
    """T2, Q residual and score distance of each sample, with the 97.5 % flags of their own distribution."""
    n, mean, scatter = moments(df)
    require(n >= 3, "PCA_SMALL", "PCA distances need three samples", samples=n)
    k = min(components or 10, n - 1, len(mean))
    value, vector = np.linalg.eigh(scatter)
    v = vector[:, ::-1][:, :k]
    var = np.maximum(value[::-1][:k], 0) / (n - 1)
    var = np.where(var > 0, var, 1.0)
    centred = F.zip_with("x", F.array(*(F.lit(float(m)) for m in mean)), lambda a, b: a - b)
    scores = spectral.matvec(v.T, F.col("c"))
    t2 = spectral.total(F.zip_with("t", F.array(*(F.lit(float(w)) for w in var)), lambda a, w: a * a / w))
    q = spectral.total(F.transform("c", lambda a: a * a)) - spectral.total(F.transform("t", lambda a: a * a))
    out = df.select("sample_idx", centred.alias("c")).withColumn("t", scores).select("sample_idx", t2.alias("t2"), F.greatest(q, F.lit(0.0)).alias("q"), F.sqrt(t2).alias("distance"))
    cut = out.agg(*(F.percentile(c, F.lit(0.975)).alias(f"{c}_cut") for c in ("t2", "q", "distance")))
    return out.crossJoin(F.broadcast(cut)).select("sample_idx", "t2", "q", "distance", *((F.col(c) > F.col(f"{c}_cut")).alias(f"{c}_flag") for c in ("t2", "q", "distance")))


def mahalanobis(df: DataFrame, ridge: float = 1e-9) -> DataFrame:
    """Mahalanobis distance with the full covariance plus a ridge; flag above the 97.5 % quantile."""
    n, mean, scatter = moments(df)
    inverse = np.linalg.pinv(scatter / max(1, n - 1) + ridge * np.eye(len(mean)))
    value, vector = np.linalg.eigh(inverse)
    root = (vector * np.sqrt(np.maximum(value, 0))).T
    centred = F.zip_with("x", F.array(*(F.lit(float(m)) for m in mean)), lambda a, b: a - b)
    out = df.select("sample_idx", centred.alias("c")).select("sample_idx", spectral.norm(spectral.matvec(root, F.col("c"))).alias("distance"))
    cut = out.agg(F.percentile("distance", F.lit(0.975)).alias("cut"))
    return out.crossJoin(F.broadcast(cut)).select("sample_idx", "distance", (F.col("distance") > F.col("cut")).alias("flag"))


def intensity_outliers(df: DataFrame, method: str) -> DataFrame:
    """(sample_idx, score, flag) from the mean intensity: ROBUST_ZSCORE and MAD (the same rule) or IQR."""
    m = df.select("sample_idx", spectral.mean(F.col("x")).alias("value"))
    if method in ("ROBUST_ZSCORE", "MAD"):
        return robust_z(m, ("value",)).select("sample_idx", F.col("z").alias("score"), (F.abs("z") > ROBUST_Z).alias("flag"))
    q = m.agg(F.percentile("value", F.lit(0.25)).alias("q1"), F.percentile("value", F.lit(0.75)).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    return m.crossJoin(F.broadcast(q)).select("sample_idx", F.col("value").alias("score"), ((F.col("value") < F.col("q1") - 1.5 * iqr) | (F.col("value") > F.col("q3") + 1.5 * iqr)).alias("flag"))


def resampled_outliers(df: DataFrame, *, method: str = "mccv", runs: int = 100, seed: int = 1) -> DataFrame:
    """How often (classes) or how far (targets) a least-squares fit on half or 70 % misses each held-out sample.

    Each run is one group; a run holds the whole table, so this is for tables that fit one task and
    is refused above 200 000 rows.
    """
    share = 0.5 if method == "half_resampling" else 0.7
    rows = df.count()
    require(rows <= 200_000, "RESAMPLE_ROWS", "resampled outlier detection keeps a whole table in a task", rows=rows)

    def one(pdf):
        import pandas as pd

        x = np.array(pdf["x"].tolist(), float)
        classes = pdf["label"].dropna().unique()
        classes.sort()
        y = (pdf["label"].to_numpy()[:, None] == classes[None, :]).astype(float)
        rng = np.random.default_rng(seed + int(pdf["run"].iloc[0]))
        order = rng.permutation(len(x))
        cut = max(2, int(share * len(x)))
        train, rest = order[:cut], order[cut:]
        mean = x[train].mean(axis=0)
        a = x[train] - mean
        w = np.linalg.solve(a.T @ a + 1e-3 * np.trace(a.T @ a) / a.shape[1] * np.eye(a.shape[1]), a.T @ (y[train] - y[train].mean(axis=0)))
        guess = ((x[rest] - mean) @ w + y[train].mean(axis=0)).argmax(axis=1)
        return pd.DataFrame({"sample_idx": pdf["sample_idx"].to_numpy()[rest], "error": (classes[guess] != pdf["label"].to_numpy()[rest]).astype(float)})

    each = df.select("sample_idx", "label", "x").withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    errors = each.groupBy("run").applyInPandas(one, "sample_idx long, error double").groupBy("sample_idx").agg(F.avg("error").alias("frequency"), F.count(F.lit(1)).alias("evaluations"))
    cut = errors.agg(F.percentile("frequency", F.lit(0.95)).alias("p95"), F.percentile("frequency", F.lit(0.75)).alias("p75"))
    level = F.when((F.col("frequency") >= F.col("p95")) & (F.col("frequency") > 0), "candidate").when((F.col("frequency") >= F.col("p75")) & (F.col("frequency") > 0), "medium").otherwise("low")
    return errors.crossJoin(F.broadcast(cut)).select("sample_idx", "frequency", "evaluations", (F.col("evaluations") >= 20).alias("stable"), level.alias("level"))


def consensus(reasons: DataFrame) -> DataFrame:
    """(sample_idx, reason) rows to one row each: high with two reasons of which one is from PCA, else medium."""
    got = reasons.groupBy("sample_idx").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    high = (F.size("reasons") >= 2) & F.exists("reasons", lambda r: F.startswith(r, F.lit("pca")))
    return got.select("sample_idx", F.array_join("reasons", ",").alias("reasons"), F.when(high, "high").otherwise("medium").alias("risk_level"))


def status(blocked: Column, warned: Column) -> Column:
    return F.when(blocked, "blocked").when(warned, "warning").otherwise("passed")


def quantile_threshold(text: str) -> tuple[str, float]:
    """``quantile_0.975``, ``percentile_95`` or a number -> ('quantile' or 'value', number)."""
    if text.startswith("quantile_"):
        return "quantile", float(text[9:])
    if text.startswith("percentile_"):
        return "quantile", float(text[11:]) / 100
    return "value", float(text)


# Imputation and cleaning.


def impute_bands(long: DataFrame, how: str = "mean") -> DataFrame:
    """Missing cells by the band's mean, exact median or zero; a band without any value gives 0."""
    value = {"mean": F.avg("v"), "median": F.percentile("v", F.lit(0.5)), "zero": F.lit(0.0)}[how]
    if how == "zero":
        return long.withColumn("v", F.coalesce("v", F.lit(0.0)))
    fill = long.groupBy("band").agg(value.alias("fill"))  # a row per band
    return long.join(F.broadcast(fill), "band").select("sample_idx", "band", F.coalesce("v", "fill", F.lit(0.0)).alias("v"))


def impute_along(long: DataFrame, how: str = "linear") -> DataFrame:
    """Missing cells from their neighbours along the band index: linear, or nearest with ties to the left; ends extend."""
    back = Window.partitionBy("sample_idx").orderBy("band")
    ahead = Window.partitionBy("sample_idx").orderBy(F.desc("band"))
    known = F.when(F.col("v").isNotNull(), F.struct("band", "v"))
    sides = long.select("sample_idx", "band", "v", F.last(known, ignorenulls=True).over(back).alias("l"), F.last(known, ignorenulls=True).over(ahead).alias("r"))
    gap = F.col("r.band") - F.col("l.band")
    if how == "linear":
        inner = F.col("l.v") + (F.col("r.v") - F.col("l.v")) * (F.col("band") - F.col("l.band")) / gap
    else:
        inner = F.when(F.col("band") - F.col("l.band") <= F.col("r.band") - F.col("band"), F.col("l.v")).otherwise(F.col("r.v"))
    return sides.select("sample_idx", "band", F.coalesce("v", F.when(F.col("l").isNull(), F.col("r.v")).when(F.col("r").isNull(), F.col("l.v")).otherwise(inner), F.lit(0.0)).alias("v"))


def remove_samples(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the samples of ids (sample_idx); an unknown id, or nothing left, is an error."""
    require(not ids.join(df, "sample_idx", "left_anti").limit(1).count(), "UNKNOWN_SAMPLE", "a sample to remove doesn't exist")
    out = df.join(ids, "sample_idx", "left_anti")
    require(bool(out.limit(1).count()), "ALL_REMOVED", "no sample would be left")
    return out


def remove_bands(df: DataFrame, positions: list[int]) -> DataFrame:
    gone = F.array(*(F.lit(int(i)) for i in positions)) if positions else F.array().cast("array<int>")
    return df.withColumn("x", F.filter("x", lambda v, i: ~F.array_contains(gone, i)))


def clean(long: DataFrame, *, impute: str | None = None, drop_samples: DataFrame | None = None, drop_bands: list[int] | None = None, confirmed: bool = False) -> DataFrame:
    """Imputation, then removal; changes data, so it must be confirmed."""
    confirm(confirmed, "QC_CONFIRM", "cleaning changes the data")
    if impute:
        long = impute_along(long, impute) if impute in ("linear", "nearest") else impute_bands(long, impute)
    if drop_samples is not None:
        long = long.join(drop_samples.select("sample_idx"), "sample_idx", "left_anti")
    return long.where(~F.col("band").isin(drop_bands)) if drop_bands else long


def profile(df: DataFrame) -> DataFrame:
    """One row: size, missing cells, ratio of bands to samples and the small-sample flag."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("p"), F.sum(F.size(F.filter("x", lambda v: v.isNull()))).alias("n_missing"), F.count_distinct("label").alias("classes"))
    return row.select("n", "p", "n_missing", "classes", (F.col("p") / F.col("n")).alias("p_over_n"), ((F.col("n") < 20) | (F.col("p") / F.col("n") > 10)).alias("small_sample"))


#: The method pool by name: least number of samples and function.
METHODS = {
    "NOE": (0, None), "MD": (3, mahalanobis), "PCA_DISTANCE": (3, lambda df: pca_distances(df, 5)), "ROBUST_ZSCORE": (3, lambda df: intensity_outliers(df, "ROBUST_ZSCORE")), "IQR": (4, lambda df: intensity_outliers(df, "IQR")),
    "MAD": (3, lambda df: intensity_outliers(df, "MAD")), "half_resampling": (8, lambda df: resampled_outliers(df, method="half_resampling")), "mccv": (8, lambda df: resampled_outliers(df)),
}
