"""Natural breaks in one dimension: exact optimal classes, adaptive band counts, modality."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed default of the guard: the bimodality coefficient of the uniform distribution.
UNIFORM_BC = 5 / 9


@dataclass(frozen=True)
class Banding:
    """Options of banding. Beyond ``size_threshold`` values Ckmeans takes the place of Fisher's programme."""

    max_bands: int = 5
    floor: int = 5
    min_bands: int = 2
    variance_eps: float = 0.0
    size_threshold: float = 1500

    def __post_init__(self) -> None:
        whole = lambda x: isinstance(x, int) and not isinstance(x, bool) and x >= 1
        for name in ("max_bands", "min_bands", "floor"):
            if not whole(getattr(self, name)):
                raise ValueError(f"{name} must be an integer of 1 or more, got {getattr(self, name)}")
        if self.min_bands > self.max_bands:
            raise ValueError(f"min_bands ({self.min_bands}) must not be above max_bands ({self.max_bands})")
        for name in ("variance_eps", "size_threshold"):
            if not getattr(self, name) >= 0:
                raise ValueError(f"{name} must be 0 or more, got {getattr(self, name)}")


class _Cost:
    """Squared deviation of the distinct values i..j-1 from their mean, each as often as it occurs, from running sums."""

    def __init__(self, a: np.ndarray, times: np.ndarray):
        self.n, self.p1, self.p2 = (np.concatenate(([0], np.cumsum(x))) for x in (times, a * times, a * a * times))

    def __call__(self, i, j):
        s = self.p1[j] - self.p1[i]
        return np.maximum(self.p2[j] - self.p2[i] - s * s / (self.n[j] - self.n[i]), 0.0)


def _starts(choice: np.ndarray) -> list[int]:
    starts, end = [], choice.shape[1] - 1
    for c in range(len(choice) - 1, 0, -1):
        end = int(choice[c, end])
        starts.append(end)
    return starts[::-1]


def optimal_starts(a: np.ndarray, k: int, times: np.ndarray | None = None) -> list[int]:
    """Starts of the ``k`` classes of sorted distinct ``a`` with the least squared deviation; the lowest start on ties.

    A layer's best start never moves back as its end grows, so each layer splits its ends in half
    and looks only between the neighbours' starts (Ckmeans).
    """
    n, cost = len(a), _Cost(a, np.ones(len(a), int) if times is None else times)
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    choice = np.zeros((k + 1, n + 1), np.int64)
    for c in range(1, k + 1):
        now = np.full(n + 1, np.inf)
        todo = [(c, n, c - 1, n - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(first, min(last, mid - 1) + 1)
            total = best[i] + cost(i, mid)
            at = int(np.argmin(total))
            now[mid], choice[c, mid] = total[at], first + at
            todo += [(lo, mid - 1, first, first + at), (mid + 1, hi, first + at, last)]
        best = now
    return _starts(choice)


def fisher_starts(a: np.ndarray, k: int, times: np.ndarray | None = None) -> list[int]:
    """The same by Fisher's programme: every start is tried for every end, whatever the neighbours chose."""
    n, cost = len(a), _Cost(a, np.ones(len(a), int) if times is None else times)
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    choice = np.zeros((k + 1, n + 1), np.int64)
    for c in range(1, k + 1):
        now = np.full(n + 1, np.inf)
        for end in range(c, n + 1):
            start = np.arange(c - 1, end)
            total = best[start] + cost(start, end)
            choice[c, end] = start[np.argmin(total)]
            now[end] = total.min()
        best = now
    return _starts(choice)


def choose_bands(values: np.ndarray, options: Banding = Banding(), times: np.ndarray | None = None) -> tuple[int, list[float], str, str | None]:
    """(k, breaks, method, flag): the most bands, each of at least ``floor`` values; 1 where none fits.

    ``times`` tells how often each of distinct ``values`` occurs. ``breaks`` holds the upper edge of
    all bands but the last. A class never ends inside a run of equal values: bands are assigned by
    value. Up to ``size_threshold`` values Fisher's programme is used, beyond that Ckmeans; both
    find the same classes.
    """
    values = np.asarray(values, float)
    if not np.isfinite(values).all():
        raise ValueError("values must be finite; leave missing ones out")
    if times is None:
        a, times = np.unique(values, return_counts=True)
    else:
        order = np.argsort(values)
        a, times = values[order], np.asarray(times)[order]
    n = int(times.sum())
    if not n:
        return 0, [], "single-unit", "insufficient-points"
    if a[-1] - a[0] <= options.variance_eps:
        return 1, [], "single-unit", "homogeneous"
    many = n > options.size_threshold
    for k in range(min(options.max_bands, len(a)), options.min_bands - 1, -1):
        if n < k * options.floor:
            continue
        starts = (optimal_starts if many else fisher_starts)(a, k, times)
        if np.add.reduceat(times, starts).min() >= options.floor:
            return k, [float(a[s - 1]) for s in starts[1:]], "ckmeans" if many else "fisher-jenks", None
    return 1, [], "single-unit", "insufficient-points"


def band_table(points: DataFrame, value: str, keys: list[str], options: Banding = Banding()) -> DataFrame:
    """(keys, n, lo, hi, k, breaks, method, flag) for each group of non-null values.

    Equal values are counted first, before and in the shuffle. A group's distinct values are one
    task's work: the optimal classes of one dimension need them all. That is 16 bytes a value.
    """

    def kernel(group: pd.DataFrame) -> pd.DataFrame:
        v, times = group[value].to_numpy(float), group["_times"].to_numpy()
        k, breaks, method, flag = choose_bands(v, options, times)
        return pd.DataFrame([{**{c: group[c].iloc[0] for c in keys}, "n": times.sum(), "lo": v.min(), "hi": v.max(), "k": k, "breaks": breaks, "method": method, "flag": flag}])

    fields = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in keys)
    counted = points.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_times"))
    return counted.groupBy(*keys).applyInPandas(kernel, f"{fields}, n long, lo double, hi double, k int, breaks array<double>, method string, flag string")


def band_of(value: Column, breaks: Column) -> Column:
    """A value's band: the number of upper edges below it."""
    return F.size(F.filter(breaks, lambda b: value > b))


def bimodality(points: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, bc): the bimodality coefficient with sample-corrected moments; null below four values or without spread."""
    v = F.col(value)
    m = points.where(v.isNotNull()).groupBy(*keys).agg(F.count(v).cast("double").alias("n"), F.skewness(v).alias("s"), F.kurtosis(v).alias("e"), F.var_pop(v).alias("m2"))
    n, s, e = F.col("n"), F.col("s"), F.col("e")
    big = (n >= 4) & (F.col("m2") > 0)
    n4 = F.when(n >= 4, n)
    g1 = s * F.sqrt(n4 * (n4 - 1)) / (n4 - 2)
    g2 = ((n4 + 1) * e + 6) * (n4 - 1) / ((n4 - 2) * (n4 - 3))
    return m.select(*keys, F.when(big, (g1 * g1 + 1) / (g2 + 3 * (n4 - 1) * (n4 - 1) / ((n4 - 2) * (n4 - 3)))).alias("bc"))


def unimodal(bc: Column, threshold: float = UNIFORM_BC) -> Column:
    """Whether a coefficient tells of one smooth group; false for null."""
    return F.coalesce(bc <= threshold, F.lit(False))
