"""Figures of trailing windows of an array, all windows at once.

Values enter a window one by one, oldest first, as in a frame of rows, so ties fall the same way and a window in which
nothing changes has a deviation of exactly 0.  Values that are not ``known`` (nulls) are left out.
"""

from __future__ import annotations

import numpy as np


def _lags(n: int, window: int, current: bool) -> range:
    return range(min(window - current, n - 1), -current, -1)


def moments(x: np.ndarray, known: np.ndarray, window: int, current: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, sum and squares about the mean of the last ``window`` values, with or without the current one."""
    n, whole = len(x), bool(known.all())
    count, total, mean, square = (np.zeros(n) for _ in range(4))
    for lag in _lags(n, window, current):
        value, c, m = x[: n - lag], count[lag:], mean[lag:]
        if whole:
            c += 1
            total[lag:] += value
            apart = value - m
            step = apart / c
        else:
            here = known[: n - lag]
            c += here
            total[lag:] += np.where(here, value, 0.0)
            apart = np.where(here, value - m, 0.0)
            step = apart / np.maximum(c, 1)
        m += step
        square[lag:] += apart * (apart - step)
    return count, total, square


def sums(x: np.ndarray, known: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum of the last ``window`` values, with the current one."""
    n = len(x)
    x, count, total = np.where(known, x, 0.0), np.zeros(n), np.zeros(n)
    for lag in _lags(n, window, True):
        count[lag:] += known[: n - lag]
        total[lag:] += x[: n - lag]
    return count, total


def correlation(x: np.ndarray, y: np.ndarray, known: np.ndarray, window: int) -> np.ndarray:
    """Pearson correlation over the last ``window`` pairs; NaN where one side does not vary."""
    n = len(x)
    count, mx, my, xy, xx, yy = (np.zeros(n) for _ in range(6))
    for lag in _lags(n, window, True):
        here = known[: n - lag]
        c, p, q = count[lag:], mx[lag:], my[lag:]
        c += here
        a, b = np.where(here, x[: n - lag], p), np.where(here, y[: n - lag], q)
        dx, dy = a - p, b - q
        p += dx / np.maximum(c, 1)
        q += dy / np.maximum(c, 1)
        dq = b - q
        xy[lag:] += dx * dq
        xx[lag:] += dx * (a - p)
        yy[lag:] += dy * dq
    spread = np.sqrt(xx) * np.sqrt(yy)
    return np.where(spread > 0, xy / np.where(spread > 0, spread, 1.0), np.where(np.isnan(spread), spread, np.nan))
