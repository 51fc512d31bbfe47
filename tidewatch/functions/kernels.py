"""Kernels between two feature arrays as column expressions, and as matrices in a task."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby
from math import pi

import numpy as np
from pyspark.sql import Column, functions as F

from tidewatch.functions.numeric import dot, num

NAMES = ("rbf", "polynomial", "sigmoid", "laplacian", "periodic")


@dataclass(frozen=True)
class Kernel:
    name: str
    gamma: float = 1.0
    degree: int = 3
    coef0: float = 1.0
    alpha: float = 0.01
    period: float = 10.0
    length_scale: float = 1.0

    def __post_init__(self):
        if self.name not in NAMES:
            raise ValueError(f"unknown kernel {self.name!r}, expected one of {NAMES}")

    def column(self, a: Column, b: Column) -> Column:
        def added(f):
            return F.aggregate(F.zip_with(a, b, f), num(0), lambda s, v: s + v)

        if self.name == "rbf":
            return F.exp(-self.gamma * added(lambda x, y: (x - y) * (x - y)))
        if self.name == "polynomial":
            return F.pow(dot(a, b) + self.coef0, num(self.degree))
        if self.name == "sigmoid":
            return F.tanh(self.alpha * dot(a, b) + self.coef0)
        if self.name == "laplacian":
            return F.exp(-self.gamma * added(lambda x, y: F.abs(x - y)))
        wave = added(lambda x, y: F.pow(F.sin(pi * F.abs(x - y) / self.period), num(2)))
        return F.exp(-2 * wave / self.length_scale**2)

    def matrix(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if self.name == "polynomial":
            value = base = x @ y.T + self.coef0
            for _ in range(self.degree - 1):
                value = value * base
            return value
        if self.name == "sigmoid":
            return np.tanh(self.alpha * (x @ y.T) + self.coef0)
        if self.name == "rbf":
            d2 = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
            return np.exp(-self.gamma * np.maximum(d2, 0.0))
        total = np.zeros((len(x), len(y)))
        for j in range(x.shape[1]):
            diff = np.abs(x[:, j, None] - y[None, :, j])
            total += diff if self.name == "laplacian" else np.sin(pi * diff / self.period) ** 2
        return np.exp(-self.gamma * total) if self.name == "laplacian" else np.exp(-2 * total / self.length_scale**2)


# fixed values: parameters tried by the automatic choice
def candidates(periods) -> list[Kernel]:
    out = [Kernel("rbf", gamma=g) for g in (0.01, 0.05, 0.1, 0.3, 0.5, 1.0, 2.0, 5.0, 10.0)]
    out += [Kernel("polynomial", degree=d, coef0=c) for d in (2, 3, 4, 5, 7) for c in (0.0, 0.5, 1.0, 2.0)]
    out += [Kernel("sigmoid", alpha=a, coef0=0.0) for a in (0.001, 0.01, 0.1, 1.0)]
    out += [Kernel("laplacian", gamma=g) for g in (0.01, 0.05, 0.1, 0.3, 0.5, 1.0, 2.0)]
    return out + [Kernel("periodic", period=float(p), length_scale=s) for p in periods for s in (0.5, 1.0, 2.0)]


ENSEMBLE = (Kernel("rbf", gamma=1.0), Kernel("polynomial", degree=7, coef0=1.0), Kernel("laplacian", gamma=0.5))


def triangles(x: np.ndarray, kernels):
    """Each kernel's values over the pairs i <= j of the rows of ``x`` (``np.triu_indices``), to rounding.

    What kernels of a kind share is computed once: inner products, distances, and the wave of a period, whose
    squared sines follow from products of cosines and sines.
    """
    upper = np.triu_indices(len(x))
    product = (x @ x.T)[upper]
    shared: dict = {}

    def base(name: str, period: float) -> np.ndarray:
        key = (name, period if name == "periodic" else None)
        if key not in shared:
            if name == "rbf":
                sq = (x * x).sum(1)
                shared[key] = np.maximum(sq[upper[0]] + sq[upper[1]] - 2 * product, 0.0)
            elif name == "laplacian":
                shared[key] = sum(np.abs(x[:, j, None] - x[None, :, j]) for j in range(x.shape[1]))[upper]
            else:
                c, s = np.cos(2 * pi * x / period), np.sin(2 * pi * x / period)
                shared[key] = np.maximum((x.shape[1] - c @ c.T - s @ s.T) / 2, 0.0)[upper]
        return shared[key]

    for k in kernels:
        if k.name == "polynomial":
            value = power = product + k.coef0
            for _ in range(k.degree - 1):
                value = value * power
        elif k.name == "sigmoid":
            value = np.tanh(k.alpha * product + k.coef0)
        elif k.name == "periodic":
            value = np.exp(-2 * base(k.name, k.period) / k.length_scale**2)
        else:
            value = np.exp(-k.gamma * base(k.name, 0.0))
        yield value


@lru_cache(maxsize=4)
def _upper(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs i <= j in a flat n x n matrix, and how often each pair counts."""
    i, j = np.triu_indices(n)
    return i * n + j, np.where(i == j, 1.0, 2.0)


def squares(x: np.ndarray, kernels):
    """The place of each kernel and its squares over the pairs i <= j of the rows of ``x``, to rounding (see ``triangles``).

    Kernels come by kind, since what they share is computed once.  All use the same few arrays, so that these stay in the
    cache: what is given is valid until the next.
    """
    at, _ = _upper(len(x))
    product, buffer, base = (np.empty(len(at)) for _ in range(3))

    def pairs(matrix: np.ndarray, out: np.ndarray) -> np.ndarray:
        return np.take(matrix.ravel(), at, out=out, mode="clip")

    def kind(i: int) -> tuple:
        k = kernels[i]
        return k.name, {"polynomial": k.coef0, "periodic": k.period}.get(k.name, 0.0)

    pairs(x @ x.T, product)
    for (name, setting), members in groupby(sorted(range(len(kernels)), key=lambda i: (*kind(i), kernels[i].degree)), key=kind):
        if name == "polynomial":
            np.add(product, setting, out=base)
            np.multiply(base, base, out=base)
            buffer[:] = 1.0
            degree = 0
        elif name == "rbf":
            sq = (x * x).sum(1)
            np.maximum(pairs(sq[:, None] + sq[None, :] - 2 * (x @ x.T), base), 0.0, out=base)
        elif name == "laplacian":
            pairs(sum(np.abs(x[:, j, None] - x[None, :, j]) for j in range(x.shape[1])), base)
        elif name == "periodic":
            turns = 2 * pi * x / setting
            waves = np.hstack([np.cos(turns), np.sin(turns)])
            pairs(waves @ waves.T, base)
            np.subtract(x.shape[1], base, out=base)
            np.maximum(np.multiply(base, 0.5, out=base), 0.0, out=base)
        for i in members:
            k = kernels[i]
            if name == "polynomial":
                for degree in range(degree + 1, k.degree + 1):
                    np.multiply(buffer, base, out=buffer)
                degree = k.degree
            elif name == "sigmoid":
                np.add(np.multiply(product, k.alpha, out=buffer), k.coef0, out=buffer)
                np.tanh(buffer, out=buffer)
                np.multiply(buffer, buffer, out=buffer)
            else:
                np.exp(np.multiply(base, -4 / k.length_scale**2 if name == "periodic" else -2 * k.gamma, out=buffer), out=buffer)
            yield i, buffer


def weighted_sums(kernel: Kernel, x: np.ndarray, p: np.ndarray, cells: int = 1 << 16) -> np.ndarray:
    """Per row i the sums over all rows j of K^2, K^2 P and K^2 P^2, where P is ``p @ p.T``.

    Rows meet themselves and the rows after them in strips of about ``cells`` pairs; the other half is their transpose.
    """
    n = len(x)
    out = np.zeros((3, n))
    lo = 0
    while lo < n:
        hi = min(n, lo + max(1, cells // (n - lo)))
        sq = kernel.matrix(x[lo:hi], x[lo:])
        sq = sq * sq
        weight = p[lo:hi] @ p[lo:].T
        for i in range(3):
            if i:
                sq *= weight
            out[i, lo:hi] += sq.sum(1)
            out[i, hi:] += sq[:, hi - lo:].sum(0)
        lo = hi
    return out


def path_error(m: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Error of a kernel matrix against its path-weighted form, both of unit norm: in all, and per row."""
    r = m * weight
    m, r = m / (np.linalg.norm(m) or 1.0), r / (np.linalg.norm(r) or 1.0)
    return np.linalg.norm(m - r), np.linalg.norm(m - r, axis=1)


def best_kernel(x: np.ndarray, weight: np.ndarray, kernels) -> tuple[float, Kernel, np.ndarray]:
    """The first kernel of the smallest ``path_error``, with that error and its rows.

    All kernels are compared by three sums over half of the pairs; those within rounding of the best are then
    computed in full.
    """
    at, twice = _upper(len(x))
    half = weight.ravel()[at]
    factors = np.stack([twice, twice * half, twice * half * half])
    rough = np.empty(len(kernels))
    for i, sq in squares(x, kernels):
        a, b, c = factors @ sq
        rough[i] = ((a > 0) + (c > 0) - 2 * b / np.sqrt(a * c) if a > 0 and c > 0 else float((a > 0) + (c > 0)))
    best = None
    for at in np.flatnonzero(~(rough > np.nanmin(rough) + 1e-9)) if not np.isnan(rough).all() else range(len(kernels)):
        error, rows = path_error(kernels[at].matrix(x, x), weight)
        if best is None or error < best[0]:
            best = (error, kernels[at], rows)
    return best
