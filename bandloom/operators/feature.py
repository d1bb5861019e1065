"""Features: projections and band selectors, fitted on training rows.

Statistics by band come from grouped aggregates. Small matrix work (p x p, or methods that need the
training matrix itself) is done with NumPy on a training matrix of at most ``MAX_FIT_ROWS`` rows; a
larger one is refused rather than sampled. Kernel PCA and the manifolds, which look at all pairs of
training rows, have no such bound: no pairs' matrix is held. Fitted projections are applied over Arrow batches or as
expressions, to any number of rows. Ties of scores go to the lower band.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import BandloomError, confirm, needs, require
from ..functions import arrow, gram, kernels, shared, spectral
from .preprocess import take_bands
from .quality import moments

MAX_FIT_ROWS = 100_000


@dataclass
class Projection:
    """A fitted transform of x to a vector: a name, its NumPy function of a matrix, and what was fitted."""

    name: str
    apply: Callable[[np.ndarray], np.ndarray]
    state: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame, out: str = "x") -> DataFrame:
        return arrow.with_columns(df, lambda x: {out: np.ascontiguousarray(self.apply(x))}, {out: "array<double>"})


def matrix(train: DataFrame, *more: str) -> tuple[np.ndarray, ...]:
    """The training matrix and further columns, in sample order; refused above MAX_FIT_ROWS."""
    n = train.count()
    require(n <= MAX_FIT_ROWS, "FIT_ROWS", "this method needs the whole training matrix in memory", rows=n, bound=MAX_FIT_ROWS)
    return arrow.collected(train, *more)[1:]


def clip_components(requested: int, n: int, p: int) -> tuple[int, list[str]]:
    k = max(1, min(requested, n - 1, p))
    return k, [] if k == requested else ["COMPONENTS_CLIPPED"]


def _signed(v: np.ndarray) -> np.ndarray:
    """Columns turned so that their largest entry is positive: a fixed sign."""
    return v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)


def pca(train: DataFrame, n_components: int | None = 10, explained: float | None = None) -> Projection:
    """From the p x p scatter, summed in Spark; components by number or by share of the variance."""
    n, mean, scatter = moments(train)
    value, vector = np.linalg.eigh(scatter)
    value, vector = np.maximum(value[::-1], 0), _signed(vector[:, ::-1])
    k, warnings = clip_components(int(np.searchsorted(np.cumsum(value) / value.sum(), explained)) + 1 if explained else n_components, n, len(mean))
    v = vector[:, :k]
    return Projection("pca", lambda x: (x - mean) @ v, {"mean": mean, "components": v.T, "variance": value[:k] / max(1, n - 1), "ratio": value[:k] / value.sum()}, warnings)


#: Training rows up to which a matrix over all their pairs is held in the driver.
PAIRS_ROWS = 3000


def kernel_pca(train: DataFrame, n_components: int = 10, gamma: float | None = None) -> Projection:
    """RBF kernel; above PAIRS_ROWS training rows, tasks make the kernel's rows anew for each product."""
    x = arrow.collected(train)[1]
    n, g = len(x), gamma or 1 / x.shape[1]
    c, warnings = clip_components(n_components, n, n)
    if n <= PAIRS_ROWS:
        k = gram.rbf(x, x, g)
        row = k.mean(axis=0)
        value, vector = np.linalg.eigh(k - row[:, None] - row[None] + row.mean())
        value, vector = value[::-1][:c], vector[:, ::-1][:, :c]
    else:
        product = gram.rbf_product(train.sparkSession, x, g)
        row = product(np.ones((n, 1)))[:, 0] / n
        value, vector = gram.largest(lambda v: product(v) - row @ v - np.outer(row - row.mean(), v.sum(axis=0)), n, c)
    value, vector, total = np.maximum(value, 1e-12), _signed(vector), row.mean()
    place = gram.sliced(lambda a: ((kb := gram.rbf(a, x, g)) @ vector - kb.mean(axis=1)[:, None] * vector.sum(axis=0) - (row - total) @ vector) / np.sqrt(value), n)
    return Projection("kernel_pca", place, {"values": value}, warnings)


def sparse_pca(train: DataFrame, n_components: int = 10, alpha: float = 1.0, rounds: int = 200) -> Projection:
    """Alternate ridge scores and soft-thresholded loadings."""
    n, mean, scatter = moments(train)
    k, warnings = clip_components(n_components, n, len(mean))
    load = _signed(np.linalg.eigh(scatter)[1][:, ::-1][:, :k])
    for _ in range(rounds):
        q = np.linalg.svd(scatter @ load, full_matrices=False)
        a = q[0] @ q[2]
        b = scatter @ a / n
        new = np.sign(b) * np.maximum(np.abs(b) - alpha / n, 0)
        size = np.linalg.norm(new, axis=0)
        new = np.where(size > 0, new / np.where(size > 0, size, 1), 0)
        if np.abs(new - load).max() < 1e-10:
            break
        load = new
    back = np.linalg.pinv(load.T @ load + 1e-6 * np.eye(k)) @ load.T
    return Projection("sparse_pca", lambda x: (x - mean) @ back.T, {"components": load.T}, warnings)


def nmf(train: DataFrame, n_components: int = 10, rounds: int = 300, seed: int = 42) -> Projection:
    """Multiplicative updates; training rows must not be negative."""
    (x,) = matrix(train)
    require(x.min() >= 0, "NMF_NEGATIVE", "NMF needs values of at least zero")
    k, warnings = clip_components(n_components, *x.shape)
    rng = np.random.default_rng(seed)
    scale = np.sqrt(x.mean() / k)
    w, h = scale * np.abs(rng.standard_normal((len(x), k))), scale * np.abs(rng.standard_normal((k, x.shape[1])))
    for _ in range(rounds):
        h *= (w.T @ x) / np.maximum(w.T @ w @ h, 1e-12)
        w *= (x @ h.T) / np.maximum(w @ (h @ h.T), 1e-12)

    def encode(a):
        u = np.full((len(a), k), a.mean() + 1e-9)
        for _ in range(rounds):
            u *= (a @ h.T) / np.maximum(u @ (h @ h.T), 1e-12)
        return u

    return Projection("nmf", encode, {"components": h}, warnings)


def ica(train: DataFrame, n_components: int = 10, rounds: int = 300, seed: int = 42) -> Projection:
    """FastICA with tanh on whitened training rows; sources of unit variance."""
    (x,) = matrix(train)
    k, warnings = clip_components(n_components, *x.shape)
    mean = x.mean(axis=0)
    u, s, vt = np.linalg.svd(x - mean, full_matrices=False)
    k = min(k, int((s > 1e-10 * s[0]).sum()))
    white = vt[:k].T / s[:k] * np.sqrt(len(x))
    z = (x - mean) @ white
    w = np.linalg.qr(np.random.default_rng(seed).standard_normal((k, k)))[0]
    for _ in range(rounds):
        g = np.tanh(z @ w.T)
        new = g.T @ z / len(z) - (1 - g**2).mean(axis=0)[:, None] * w
        a, _, b = np.linalg.svd(new)
        new = a @ b
        done = np.abs(np.abs((new * w).sum(axis=1)) - 1).max() < 1e-6
        w = new
        if done:
            break
    back = white @ w.T
    return Projection("ica_embedding", lambda a: (a - mean) @ back, {"unmixing": back.T}, warnings)


def class_moments(train: DataFrame) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Classes in order, their sizes and means, and the within-class scatter; sums by class in Spark."""
    cells = train.select("label", F.posexplode("x").alias("band", "v")).groupBy("label", "band").agg(F.count("v").alias("n"), F.avg("v").alias("m")).orderBy("label", "band").collect()
    classes = sorted({r["label"] for r in cells})
    width = max(r["band"] for r in cells) + 1
    size = np.array([next(r["n"] for r in cells if r["label"] == c) for c in classes])
    mean = np.array([r["m"] for r in cells]).reshape(len(classes), width)
    n, all_mean, total = moments(train)
    between = (mean - all_mean).T @ ((mean - all_mean) * size[:, None])
    return classes, size, mean, total - between


def lda_projection(train: DataFrame, n_components: int | None = None) -> Projection:
    classes, size, mean, within = class_moments(train)
    overall = (mean * size[:, None]).sum(axis=0) / size.sum()
    k = min(len(classes) - 1, mean.shape[1], n_components or len(classes) - 1)
    root = np.linalg.cholesky(within + 1e-9 * np.trace(within) / len(within) * np.eye(len(within)))
    inverse = np.linalg.inv(root)
    between = (mean - overall).T @ ((mean - overall) * size[:, None])
    _, vector = np.linalg.eigh(inverse @ between @ inverse.T)
    w = _signed(inverse.T @ vector[:, ::-1][:, :k] * np.sqrt(size.sum() - len(classes)))
    return Projection("lda_projection", lambda x: (x - overall) @ w, {"scalings": w.T})


def dct_features(x: Column, width: int, count: int = 10) -> Column:
    return spectral.matvec(kernels.dct(width, min(count, width)), x)


def fft_features(x: Column, width: int, count: int = 10) -> Column:
    """|rfft| of the first frequencies, as two fixed matrices inside generated code."""
    k = np.arange(min(count, width // 2 + 1))[:, None] * np.arange(width)[None] * 2 * np.pi / width
    return F.zip_with(spectral.matvec(np.cos(k), x), spectral.matvec(np.sin(k), x), lambda a, b: F.sqrt(a * a + b * b))


def dictionary_learning(train: DataFrame, n_components: int = 10, alpha: float = 1.0, rounds: int = 100) -> Projection:
    """Alternate sparse codes (iterative soft thresholding) and normed least-squares atoms."""
    (x,) = matrix(train)
    k, warnings = clip_components(n_components, *x.shape)
    mean = x.mean(axis=0)
    atoms = np.linalg.svd(x - mean, full_matrices=False)[2][:k]

    def code(a, steps=100):
        gram = atoms @ atoms.T
        step = 1 / max(np.linalg.norm(gram, 2), 1e-12)
        c, target = np.zeros((len(a), k)), (a - mean) @ atoms.T
        for _ in range(steps):
            c = c - step * (c @ gram - target)
            c = np.sign(c) * np.maximum(np.abs(c) - step * alpha * np.abs(target).mean(), 0)
        return c

    for _ in range(rounds // 10):
        c = code(x, 50)
        atoms = np.linalg.lstsq(c.T @ c + 1e-9 * np.eye(k), c.T @ (x - mean), rcond=None)[0]
        size = np.linalg.norm(atoms, axis=1, keepdims=True)
        atoms = np.where(size > 1e-12, atoms / np.maximum(size, 1e-12), np.linalg.svd(x - mean, full_matrices=False)[2][:k])
    return Projection("dictionary_learning", code, {"atoms": atoms}, warnings)


def _neighbours(a: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the k nearest rows of x to each row of a, nearest first, ties by place; only those k are sorted."""
    made = []
    for i, j in gram.cuts(len(a), len(x)):
        d = (-2 * a[i:j]) @ x.T
        d += (a[i:j] ** 2).sum(1)[:, None]
        d += (x**2).sum(1)
        np.sqrt(np.maximum(d, 0, out=d), out=d)
        at = np.sort(np.argpartition(d, k - 1, axis=1)[:, :k], axis=1)
        last = np.take_along_axis(d, at, axis=1).max(axis=1)
        for r in np.flatnonzero((d <= last[:, None]).sum(axis=1) > k):  # equals of the last one: the first of them count
            can = np.flatnonzero(d[r] <= last[r])
            at[r] = np.sort(can[np.argsort(d[r, can], kind="stable")[:k]])
        near = np.take_along_axis(d, at, axis=1)
        order = np.argsort(near, axis=1, kind="stable")
        made.append((np.take_along_axis(at, order, axis=1), np.take_along_axis(near, order, axis=1)))
    return tuple(np.concatenate(c) for c in zip(*made))


def _paths(near: np.ndarray, d: np.ndarray, graph: tuple) -> np.ndarray:
    """Lengths of the shortest paths from rows to all training rows (inf without one), by their nearest training rows; training rows down, rows across.

    Edges are relaxed a slice of their ends after the other, for all rows together, until nothing becomes shorter. ``graph``:
    the edges' origins and lengths in order of their ends, and where the edges of an end begin.
    """
    origin, length, begin = graph
    n = len(begin) - 1
    far = np.full((n, len(near)), np.inf)
    far[near, np.arange(len(near))[:, None]] = d
    step = max(1, (gram.CELLS >> 4) // max(1, len(near)) * n // len(origin))
    moved = True
    while moved:
        moved = False
        for i in range(0, n, step):
            j = min(i + step, n)
            e = slice(begin[i], begin[j])
            new = np.minimum.reduceat(far[origin[e]] + length[e, None], begin[i:j] - begin[i], axis=0)
            if (new < far[i:j]).any():
                moved = True
                np.minimum(far[i:j], new, out=far[i:j])
    return far


def isomap(train: DataFrame, n_components: int = 2, neighbours: int = 10) -> Projection:
    """Geodesic distances over the neighbour graph, classical scaling; new rows by their neighbours' distances.

    Tasks find the paths from a slice of the rows each; half of the symmetric matrix of squared
    lengths lies as a table in the shared folder until its eigenvectors are found.
    """
    spark = train.sparkSession.newSession()  # of the paths' table, whose cells are megabytes, a few rows at a time are read
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "4")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    x = arrow.collected(train)[1]
    n, k = len(x), min(neighbours, len(x) - 1)
    found = gram.over(spark, gram.cuts(n, n), lambda i, j, t: _neighbours(t[i:j], t, k + 1), x)
    at, d = (np.concatenate(c) for c in zip(*found))
    # both ways, and every row to itself: no end is without an edge
    own, other = np.repeat(np.arange(n), k + 1), at.ravel()
    ends, origins, lengths = np.concatenate([own, other, np.arange(n)]), np.concatenate([other, own, np.arange(n)]), np.concatenate([d.ravel(), d.ravel(), np.zeros(n)])
    order = np.lexsort((lengths, origins, ends))
    ends, origins, lengths = ends[order], origins[order], lengths[order]
    new = np.append(True, (ends[1:] != ends[:-1]) | (origins[1:] != origins[:-1]))
    graph = (origins[new], lengths[new], np.searchsorted(ends[new], np.arange(n + 1)))
    slices = gram.cuts(n, n, 1 << 20)

    def spread(batches):
        for batch in batches:
            for i, j in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                g = np.ascontiguousarray(_paths(np.arange(i, j)[:, None], np.zeros((j - i, 1)), sent.value)[:j].T)
                longest = g[np.isfinite(g)].max()
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([float(longest)]), pa.array([g.tobytes()], pa.binary())], ["i", "j", "longest", "g"])

    sent = spark.sparkContext.broadcast(graph)
    shared.ship(spark)
    rows = spark.createDataFrame(slices, "i int, j int").repartition(min(len(slices), 4 * spark.sparkContext.defaultParallelism))
    table = shared.stored(rows.mapInArrow(spread, "i int, j int, longest double, g binary"), "geodesics")
    apart = 2 * table.agg(F.max("longest")).first()[0]  # between parts of the graph

    def times(v):
        held = spark.sparkContext.broadcast(v)

        def run(batches):
            w = held.value
            out = np.zeros_like(w)
            for batch in batches:
                for i, j, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    g = np.frombuffer(g.as_buffer(), float).reshape(j - i, j)
                    sq = np.where(np.isinf(g), apart, g) ** 2
                    low = np.arange(j)[None] < np.arange(i, j)[:, None]
                    out[i:j] += np.where(low, sq, 0) @ w[:j]
                    out[:j] += np.where(low, sq, 0).T @ w[i:j]
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["v"])

        made = table.select("i", "j", "g").coalesce(spark.sparkContext.defaultParallelism).mapInArrow(run, "v binary").toArrow()["v"]
        held.destroy()
        return sum(np.frombuffer(b.as_buffer(), float).reshape(v.shape) for b in made)

    row = times(np.ones((n, 1)))[:, 0] / n
    total = row.mean()
    value, vector = gram.largest(lambda v: -0.5 * (times(v) - row @ v - np.outer(row - total, v.sum(axis=0))), n, min(n_components, n))
    shared.drop(table)
    value, vector = np.maximum(value, 1e-12), _signed(vector)

    def place(a):
        made = []
        for i, j in gram.cuts(len(a), n, 1 << 20):
            near, dist = _neighbours(a[i:j], x, k)
            geo = np.minimum(_paths(near, dist, graph), apart + dist[:, 0]).T ** 2
            made.append(-0.5 * (geo - geo.mean(axis=1, keepdims=True) - row[None] + total) @ vector / np.sqrt(value))
        return np.concatenate(made)

    return Projection("isomap_embedding", place, {"values": value})


def lle(train: DataFrame, n_components: int = 2, neighbours: int = 10, ridge: float = 1e-3) -> Projection:
    """Locally linear embedding; new rows by their reconstruction weights.

    Above PAIRS_ROWS training rows the weights stay sparse, and the vectors come from products with them.
    """
    x = arrow.collected(train)[1]
    n, k = len(x), min(neighbours, len(x) - 1)

    def weights(a, near):
        out = np.zeros(near.shape)
        for i, j in gram.cuts(len(a), near.shape[1] * x.shape[1]):
            z = x[near[i:j]] - a[i:j, None]
            c = z @ z.transpose(0, 2, 1)
            size = np.maximum(np.trace(c, axis1=1, axis2=2), 1e-12)[:, None, None]
            w = np.linalg.solve(c + ridge * size * np.eye(near.shape[1]), np.ones((*near[i:j].shape, 1)))[..., 0]
            out[i:j] = w / w.sum(axis=1, keepdims=True)
        return out

    near = np.concatenate(gram.over(train.sparkSession, gram.cuts(n, n), lambda i, j, t: _neighbours(t[i:j], t, k + 1)[0][:, 1:], x))
    w = weights(x, near)
    if n <= PAIRS_ROWS:
        m = np.eye(n)
        m[np.arange(n)[:, None], near] -= w
        y = np.linalg.eigh(m.T @ m)[1][:, 1 : n_components + 1]
    else:
        y = _lowest(near, w, n_components)
    y = _signed(y) * np.sqrt(n)

    def place(a):
        at = _neighbours(a, x, k)[0]
        return (weights(a, at)[:, :, None] * y[at]).sum(axis=1)

    return Projection("lle_embedding", place)


def _lowest(near: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """Vectors of the k least eigenvalues of (I - W)'(I - W) beside the constant one, W sparse with rows that sum to one."""
    n, wide = near.shape
    order = np.argsort(near.ravel(), kind="stable")
    target, origin, weight = near.ravel()[order], order // wide, w.ravel()[order][:, None]
    begin = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
    ends = target[begin]
    bounds = np.append(begin, len(target))
    pool = ThreadPoolExecutor(os.cpu_count())

    def product(v):
        r = v.copy()

        def ahead(part):
            for c in range(wide):
                r[slice(*part)] -= w[slice(*part), c, None] * v[near[slice(*part), c]]

        list(pool.map(ahead, gram.cuts(n, v.shape[1], 1 << 15)))
        out = r.copy()

        def back(part):
            i, j = part
            e = slice(bounds[i], bounds[j])
            out[ends[i:j]] -= np.add.reduceat(weight[e] * r[origin[e]], begin[i:j] - bounds[i], axis=0)

        list(pool.map(back, gram.cuts(len(ends), v.shape[1], 1 << 15)))
        return out

    with pool:
        top = 1.02 * gram.largest(product, n, 1, 1e-3)[0][0]
        flat = lambda v: v - v.mean(axis=0)  # noqa: E731  without the constant vector
        return gram.largest(lambda v: flat(top * (u := flat(v)) - product(u)), n, k, 1e-12, most=400)[1]


def gated(method: str) -> None:
    """Methods whose library isn't part of this engine."""
    module = {"umap_embedding": "umap", "tsne_embedding": "sklearn"}.get(method, "torch")
    needs(module, method)


DEEP = ("autoencoder_embedding", "denoising_autoencoder_embedding", "cnn_1d_embedding", "resnet1d_embedding", "cls_former_embedding", "masked_spectral_autoencoder_embedding", "contrastive_spectral_embedding", "transformer_embedding")

# PLS and what is built on it.


def nipals(x: np.ndarray, y: np.ndarray, k: int, scale: bool = True, rounds: int = 500, tol: float = 1e-8) -> dict:
    """PLS2 by NIPALS: means, scales, weights, loadings, rotations and coefficients."""
    mx, my = x.mean(axis=0), y.mean(axis=0)
    sx, sy = (x.std(axis=0, ddof=1), y.std(axis=0, ddof=1)) if scale and len(x) > 1 else (np.ones(x.shape[1]), np.ones(y.shape[1]))
    sx, sy = np.where(sx > 0, sx, 1), np.where(sy > 0, sy, 1)
    e, f = (x - mx) / sx, (y - my) / sy
    w_, p_, q_, t_ = [], [], [], []
    for _ in range(k):
        u = f[:, np.abs(f).sum(axis=0).argmax()]
        if not np.abs(u).sum() > 1e-14:
            break
        w = np.zeros(e.shape[1])
        for _ in range(rounds):
            new = e.T @ u
            new /= max(np.linalg.norm(new), 1e-14)
            t = e @ new
            q = f.T @ t / max(t @ t, 1e-14)
            u = f @ q / max(q @ q, 1e-14)
            done = np.linalg.norm(new - w) < tol
            w = new
            if done or f.shape[1] == 1:
                break
        t = e @ w
        p, q = e.T @ t / (t @ t), f.T @ t / (t @ t)
        e, f = e - np.outer(t, p), f - np.outer(t, q)
        for into, v in zip((w_, p_, q_, t_), (w, p, q, t)):
            into.append(v)
    w, p, q, t = (np.array(v).T for v in (w_, p_, q_, t_))
    rotation = w @ np.linalg.pinv(p.T @ w)
    return {"mx": mx, "my": my, "sx": sx, "sy": sy, "w": w, "p": p, "q": q, "t": t, "rotation": rotation, "coef": (rotation @ q.T) * sy / sx[:, None]}


def pls_predict(m: dict, x: np.ndarray) -> np.ndarray:
    return (x - m["mx"]) @ m["coef"] + m["my"]


def one_hot(label: np.ndarray) -> tuple[list, np.ndarray]:
    classes = sorted(set(label.tolist()))
    return classes, (label[:, None] == np.array(classes)[None]).astype(float)


def targets(train: DataFrame, y: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The training matrix and the target: y, or the classes as 0 and 1 (more than two one-hot)."""
    x, t = matrix(train, y or "label")
    if y:
        return x, t.astype(float)[:, None]
    _, hot = one_hot(t)
    return x, hot if hot.shape[1] > 2 else hot[:, 1:]


def pls_latent(train: DataFrame, n_components: int = 10, y: str | None = None) -> Projection:
    x, t = targets(train, y)
    k, warnings = clip_components(n_components, *x.shape)
    m = nipals(x, t, k)
    return Projection("pls_latent_variables", lambda a: ((a - m["mx"]) / m["sx"]) @ m["rotation"], m, warnings)


def vip(train: DataFrame, n_components: int = 10, y: str | None = None) -> np.ndarray:
    """Variable importance in projection of each band."""
    m = pls_latent(train, n_components, y).state
    share = (m["t"] ** 2).sum(axis=0) * (m["q"] ** 2).sum(axis=0)
    return np.sqrt(len(m["w"]) * ((m["w"] / np.linalg.norm(m["w"], axis=0)) ** 2 @ share) / share.sum())


# Selectors: scores by band as a DataFrame (band, score), then top-k or a threshold.


def variance_scores(train: DataFrame) -> DataFrame:
    return train.select(F.posexplode("x").alias("band", "v")).groupBy("band").agg(F.var_pop("v").alias("score"))


def correlation_scores(train: DataFrame, y: str = "y", ordinal: bool = False) -> DataFrame:
    """|Pearson| by band, or of ordinal ranks (ties by sample, not averaged)."""
    long = train.select("sample_idx", y, F.posexplode("x").alias("band", "v"))
    if ordinal:
        rank = lambda c: F.row_number().over(Window.partitionBy("band").orderBy(c, "sample_idx")).cast("double")
        long = long.select("band", rank("v").alias("v"), rank(y).alias(y))
    return long.groupBy("band").agg(F.coalesce(F.abs(F.corr("v", y)), F.lit(0.0)).alias("score"))


def anova_scores(train: DataFrame) -> DataFrame:
    """F statistic of the classes by band, from sums by class."""
    by = train.select("label", F.posexplode("x").alias("band", "v")).groupBy("band", "label").agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    one = by.groupBy("band").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.count(F.lit(1)).alias("k"))
    between = (F.col("b") - F.col("s") * F.col("s") / F.col("n")) / (F.col("k") - 1)
    within = (F.col("q") - F.col("b")) / (F.col("n") - F.col("k"))
    f = F.when(within > 0, between / within)
    return one.select("band", F.coalesce(F.when(F.isnan(f), 0.0).otherwise(f), F.lit(0.0)).alias("score"))


def f_regression_scores(train: DataFrame, y: str = "y") -> DataFrame:
    """r^2 / (1 - r^2) * (n - 2) by band."""
    r = train.select(y, F.posexplode("x").alias("band", "v")).groupBy("band").agg(F.corr("v", y).alias("r"), F.count("v").alias("n"))
    f = F.col("r") * F.col("r") / (1 - F.col("r") * F.col("r")) * (F.col("n") - 2)
    return r.select("band", F.coalesce(f, F.lit(0.0)).alias("score"))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The k best bands; scores has a row per band."""
    return scores.orderBy(F.desc("score"), "band").limit(k)


def default_k(p: int) -> int:
    return min(50, max(5, -(-5 * p // 100)), p)


def over(scores: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    return scores.where(F.col("score") > threshold if strict else F.col("score") >= threshold)


def score_table(scores: DataFrame, selected: DataFrame, axis: DataFrame) -> DataFrame:
    """band, value on the axis, score, rank and whether it was selected (a row per band)."""
    ranked = scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "band")))
    marks = selected.select("band", F.lit(True).alias("selected"))
    return ranked.join(axis.select(F.col("band_idx").alias("band"), "value"), "band").join(marks, "band", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def keep_bands(df: DataFrame, selected: DataFrame) -> DataFrame:
    """df with only the selected bands in x, in band order."""
    bands = [r["band"] for r in selected.select("band").orderBy("band").collect()]
    require(bool(bands), "NOTHING_SELECTED", "no band was selected")
    return df.withColumn("x", take_bands(F.col("x"), bands))


def _cv_rmse(x: np.ndarray, y: np.ndarray, k: int, folds: int = 5) -> float:
    fold = np.arange(len(x)) % min(folds, len(x))
    error = np.zeros_like(y)
    for f in np.unique(fold):
        m = nipals(x[fold != f], y[fold != f], max(1, min(k, x.shape[1], (fold != f).sum() - 1)))
        error[fold == f] = y[fold == f] - pls_predict(m, x[fold == f])
    return float(np.sqrt((error**2).mean()))


def interval_pls(train: DataFrame, intervals: int | None = None, n_components: int = 5, y: str | None = None) -> DataFrame:
    """Cross-validated RMSE of PLS on each interval, one task per interval: (interval, first, last, score)."""
    x, t = targets(train, y)
    p = x.shape[1]
    parts = [c for c in np.array_split(np.arange(p), intervals or (10 if p < 200 else 20)) if len(c)]
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast((x, t))

    def one(batches):
        a, b = shared.value
        for pdf in batches:
            yield pdf.assign(score=[_cv_rmse(a[:, lo : hi + 1], b, n_components) for lo, hi in zip(pdf["first"], pdf["last"])])

    rows = spark.createDataFrame([(i, int(c[0]), int(c[-1])) for i, c in enumerate(parts)], "interval int, first int, last int")
    return rows.repartition(len(parts)).mapInPandas(one, "interval int, first int, last int, score double")


def spa(train: DataFrame, k: int | None = None, start: int | None = None) -> list[int]:
    """Successive projections on standardised bands: each next band is the one farthest from the span, from the Gram matrix; ties go to the lower band."""
    n, mean, scatter = moments(train)
    std = np.sqrt(np.diag(scatter) / n)
    std = np.where(std > 1e-12, std, 1.0)
    gram = scatter / np.outer(std, std)
    k = k or min(30, max(5, -(-3 * len(mean) // 100)), len(mean))
    first = np.diag(gram)
    out = [int(np.round(first / max(first.max(), 1e-300), 9).argmax()) if start is None else start]  # scaled bands are equally long but for rounding
    while len(out) < k:
        v = gram[:, out[-1]] / max(np.sqrt(max(gram[out[-1], out[-1]], 0)), 1e-12)
        gram = gram - np.outer(v, v)
        left = np.diag(gram).copy()
        left[out] = -np.inf
        if left.max() <= 1e-10:
            break
        out.append(int(left.argmax()))
    return sorted(out)


def _runs_allowed(runs: int) -> None:
    require(1 <= runs <= 500, "RUNS", "at most 500 runs", runs=runs)


def _drawn(n: int, share: float, rng) -> np.ndarray:
    """A share of the rows, three at least."""
    return rng.choice(n, max(3, min(n, int(np.ceil(share * n)))), replace=False)


def cars(train: DataFrame, runs: int = 50, n_components: int = 10, y: str | None = None, seed: int = 42, *, top_k: int | None = None, sample_ratio: float = 0.8, folds: int = 5) -> tuple[list[int], list[tuple[int, int, float]], np.ndarray]:
    """Competitive adaptive reweighted sampling: (bands, (run, bands left, RMSE) of each run, share of runs that kept each band).

    Each run fits PLS to a share of the rows and keeps the bands with the largest coefficients, as many
    as an exponential schedule from all bands to ``top_k`` (one in twenty) leaves. The set with the
    least cross-validated RMSE wins, the first of equals. Runs build on each other, so they are a loop.
    """
    _runs_allowed(runs)
    x, t = targets(train, y)
    p, rng = x.shape[1], np.random.default_rng(seed)
    least = min(p, top_k or max(2, -(-p // 20)))
    keep, trace, kept, best = np.arange(p), [], np.zeros(p), (np.inf, np.arange(p))
    for run in range(1, runs + 1):
        rows = _drawn(len(x), sample_ratio, rng)
        m = nipals(x[np.ix_(rows, keep)], t[rows], max(1, min(n_components, len(keep), len(rows) - 1)))
        weight = np.abs(m["coef"]).mean(axis=1)
        size = max(least, int(round(p * (least / p) ** (run / runs))))
        keep = np.sort(keep[np.argsort(-weight, kind="stable")[:size]])
        kept[keep] += 1
        score = _cv_rmse(x[:, keep], t, n_components, folds)
        trace.append((run, len(keep), score))
        if score < best[0]:
            best = (score, keep)
    return best[1].tolist(), trace, kept / runs


def uve(train: DataFrame, runs: int | None = None, n_components: int = 10, y: str | None = None, seed: int = 42, monte_carlo: bool = False, *, top_k: int | None = None, score_threshold: float | None = None, sample_ratio: float = 0.8) -> DataFrame:
    """(band, score, frequency, cut, selected): stability of PLS coefficients over runs against that of noise; runs are tasks.

    Each run draws a share of the rows and puts fresh noise of each band's scale beside the bands. A
    band's stability is its mean coefficient over the deviation. Bands above the best noise are
    selected, or above ``score_threshold``, or the ``top_k`` best. 50 runs, 100 by Monte Carlo.
    """
    runs = runs or (100 if monte_carlo else 50)
    _runs_allowed(runs)
    x, t = targets(train, y)
    p = x.shape[1]
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast((x, t))

    def one(batches):
        a, b = shared.value
        scale = np.where(a.std(axis=0) > 1e-12, a.std(axis=0), 1.0)
        for pdf in batches:
            for r in pdf["id"]:
                rng = np.random.default_rng([seed, int(r)])
                rows = _drawn(len(a), sample_ratio, rng)
                wide = np.hstack([a[rows], rng.normal(0.0, scale, (len(rows), p))])
                c = nipals(wide, b[rows], max(1, min(n_components, len(rows) - 1)))["coef"].mean(axis=1)
                often = np.append(np.abs(c[:p]) > np.median(np.abs(c[:p])), np.zeros(p, bool))
                yield pd.DataFrame({"band": np.arange(len(c)), "c": c, "often": often.astype(float)})

    each = spark.range(runs).repartition(min(runs, 64)).mapInPandas(one, "band int, c double, often double")
    stable = each.groupBy("band").agg((F.abs(F.avg("c")) / (F.stddev_samp("c") + 1e-12)).alias("score"), F.avg("often").alias("frequency"))
    cut = stable.where(F.col("band") >= p).agg(F.max("score").alias("cut")) if score_threshold is None else spark.range(1).select(F.lit(float(score_threshold)).alias("cut"))
    both = stable.where(F.col("band") < p).crossJoin(F.broadcast(cut))  # one row
    if top_k is None:
        return both.withColumn("selected", F.col("score") > F.col("cut"))
    return both.withColumn("selected", F.row_number().over(Window.orderBy(F.desc("score"), "band")) <= top_k)


#: Parameters that must be named by the caller, by method.
CONFIRM_PARAMETERS = {"pca": ("n_components", "explained"), "pls_latent_variables": ("n_components",), "vip": ("threshold", "top_k"), "select_k_best": ("k",), "correlation_filter": ("k", "threshold")}
SUPERVISED = ("lda_projection", "pls_latent_variables", "vip", "correlation_filter", "select_k_best", "anova_f", "f_regression", "interval_pls", "cars", "uve", "mcuve")
VISUAL_ONLY = ("tsne_embedding",)
MANIFOLD = ("umap_embedding", "isomap_embedding", "lle_embedding")
PROJECTIONS = {"pca": pca, "kernel_pca": kernel_pca, "sparse_pca": sparse_pca, "nmf": nmf, "ica_embedding": ica, "lda_projection": lda_projection, "dictionary_learning": dictionary_learning, "isomap_embedding": isomap, "lle_embedding": lle, "pls_latent_variables": pls_latent}


def semantics(method: str) -> dict:
    """Intended use, whether new rows can be placed, and the gate before modeling."""
    return {"supervised": method in SUPERVISED, "out_of_sample": method not in VISUAL_ONLY, "modeling": "blocked" if method in VISUAL_ONLY else "consent" if method in MANIFOLD else "open"}


def fit_feature(df: DataFrame, method: str, *, unsplit_ok: bool = False, deep_ok: bool = False, **p) -> Projection:
    """Fit a projection on rows with role 'train'."""
    if method in DEEP:
        confirm(deep_ok, "DEEP_TRAINING", "training a network must be agreed to", method=method)
    if method in DEEP or method in ("umap_embedding", "tsne_embedding"):
        gated(method)
    if "role" not in df.columns:
        confirm(unsplit_ok, "UNSPLIT_FIT", f"{method} would be fitted on all rows", method=method)
    if method not in PROJECTIONS:
        raise BandloomError("UNKNOWN_METHOD", f"{method} isn't a projection", method=method)
    return PROJECTIONS[method](df.where("role = 'train'") if "role" in df.columns else df, **p)
