"""Fixed matrices and sequential kernels of spectral preprocessing (NumPy; built once or run per Arrow batch)."""

from __future__ import annotations

from math import factorial

import numpy as np

from ..errors import require


def savgol(width: int, window: int, order: int, deriv: int = 0) -> np.ndarray:
    """width x width matrix of Savitzky-Golay filtering; the ends use the polynomial of the end windows."""
    require(window % 2 == 1 and window <= width, "SG_WINDOW", "the window must be odd and at most the number of bands", window=window, bands=width)
    require(order < window, "SG_ORDER", "the order must be below the window", order=order, window=window)
    require(deriv <= order, "SG_DERIV", "the derivative must not exceed the order", deriv=deriv, order=order)
    half = window // 2
    powers = np.vander(np.arange(window) - half, order + 1, increasing=True).astype(float)
    fit = np.linalg.pinv(powers)  # window values -> polynomial coefficients around its middle

    def at(t: float) -> np.ndarray:
        """Weights of the derivative at offset t from the middle."""
        d = np.array([factorial(k) / factorial(k - deriv) * t ** (k - deriv) if k >= deriv else 0.0 for k in range(order + 1)])
        return d @ fit

    out = np.zeros((width, width))
    for i in range(width):
        lo = min(max(i - half, 0), width - window)
        out[i, lo : lo + window] = at(i - lo - half)
    return out


def gaussian(width: int, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing with a kernel cut at four sigma and edge values repeated."""
    require(sigma > 0, "GAUSSIAN_SIGMA", "sigma must be positive", sigma=sigma)
    radius = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    w /= w.sum()
    out = np.zeros((width, width))
    for i in range(width):
        np.add.at(out[i], np.clip(np.arange(i - radius, i + radius + 1), 0, width - 1), w)
    return out


def polynomial_residual(width: int, degree: int) -> np.ndarray:
    """I - H: what a fitted polynomial of the band index leaves."""
    require(1 <= degree < width, "POLY_DEGREE", "the degree must be at least 1 and below the number of bands", degree=degree)
    t = np.linspace(-1, 1, width)  # an affine change of the index spans the same polynomials
    q, _ = np.linalg.qr(np.vander(t, degree + 1))
    return np.eye(width) - q @ q.T


def dct(width: int, count: int) -> np.ndarray:
    """First rows of the orthonormal DCT-II."""
    k, n = np.arange(count)[:, None], np.arange(width)[None, :]
    out = np.cos(np.pi * k * (2 * n + 1) / (2 * width)) * np.sqrt(2 / width)
    out[0] /= np.sqrt(2)
    return out


def rubberband(x: np.ndarray) -> np.ndarray:
    """x minus its lower convex hull, interpolated linearly."""
    hull: list[int] = []
    for i in range(len(x)):
        while len(hull) > 1 and (x[hull[-1]] - x[hull[-2]]) * (i - hull[-2]) >= (x[i] - x[hull[-2]]) * (hull[-1] - hull[-2]):
            hull.pop()
        hull.append(i)
    return x - np.interp(np.arange(len(x)), hull, x[hull])


def als(x: np.ndarray, lam: float = 1e5, p: float = 1e-3, rounds: int = 10) -> np.ndarray:
    """x minus its asymmetric-least-squares baseline; rows of x are spectra.

    The normal matrix is pentadiagonal: its LDL' factors are found for all spectra at once, band by band.
    """
    n, m = x.shape
    require(m >= 3, "ALS_WIDTH", "an ALS baseline needs three bands at least", bands=m)
    d = np.diff(np.eye(m), 2, axis=0)
    penalty = lam * d.T @ d
    c0, c1, c2 = penalty.diagonal(), np.append(penalty.diagonal(1), 0), np.append(penalty.diagonal(2), [0, 0])
    w, z = np.ones_like(x), x
    for _ in range(rounds):
        diag, e, f, y = (np.zeros((n, m)) for _ in range(4))
        for i in range(m):
            diag[:, i] = w[:, i] + c0[i]
            e[:, i], f[:, i] = c1[i], c2[i]
            y[:, i] = w[:, i] * x[:, i]
            if i > 0:
                diag[:, i] -= diag[:, i - 1] * e[:, i - 1] ** 2
                e[:, i] -= diag[:, i - 1] * e[:, i - 1] * f[:, i - 1]
                y[:, i] -= e[:, i - 1] * y[:, i - 1]
            if i > 1:
                diag[:, i] -= diag[:, i - 2] * f[:, i - 2] ** 2
                y[:, i] -= f[:, i - 2] * y[:, i - 2]
            e[:, i] /= diag[:, i]
            f[:, i] /= diag[:, i]
        z = y / diag
        for i in range(m - 2, -1, -1):
            z[:, i] -= e[:, i] * z[:, i + 1]
            if i + 2 < m:
                z[:, i] -= f[:, i] * z[:, i + 2]
        w = np.where(x > z, p, 1 - p)
    return x - z
