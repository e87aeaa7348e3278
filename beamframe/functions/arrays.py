"""Column functions on sample arrays: smoothing, baselines, peaks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return total(x) / F.when(F.size(x) > 0, F.size(x))


def at(x: Column, i: Column) -> Column:
    """Element by index from 0, null outside."""
    return F.get(x, i.cast("int"))


def smooth_triangular(x: Column, order: int) -> Column:
    """Weighted mean with weights 1 - j / (order + 1); a pair of neighbours counts if both exist."""
    if order < 1:
        return x

    def one(v: Column, i: Column) -> Column:
        num, den = v, F.lit(1.0)
        for j in range(1, order + 1):
            both = (i - j >= 0) & (i + j < F.size(x))
            w = 1.0 - j / (order + 1)
            num = num + F.when(both, w * (at(x, i - j) + at(x, i + j))).otherwise(0.0)
            den = den + F.when(both, 2 * w).otherwise(0.0)
        return num / den

    return F.transform(x, one)


def moving_average(x: Column, half: int) -> Column:
    """Mean over the neighbours that exist."""
    return F.transform(x, lambda v, i: mean(F.slice(x, F.greatest(i - half, F.lit(0)) + 1, F.least(i + half, F.size(x) - 1) - F.greatest(i - half, F.lit(0)) + 1)))


def argmax(x: Column) -> Column:
    """Index from 0 of the first largest element, null if empty."""
    return F.nullif(F.array_position(x, F.array_max(x)), F.lit(0)) - 1


def windowed_peak_mean(x: Column, first: int, last: int, half: int) -> Column:
    """Mean of the samples within `half` of the largest one of first..last."""
    top = argmax(F.slice(x, first + 1, last - first + 1)) + first
    lo = F.greatest(top - half, F.lit(0))
    return mean(F.slice(x, (lo + 1).cast("int"), (F.least(top + half, F.size(x) - 1) - lo + 1).cast("int")))


def pedestal_subtracted_sum(x: Column, n_pedestal: int) -> Column:
    """Sum of all samples less the mean of the first ones, each."""
    return total(x) - F.size(x) * mean(F.slice(x, 1, n_pedestal))


def mean_without_top(x: Column, n: int) -> Column:
    """Common mode: mean after the n largest go."""
    kept = F.slice(F.array_sort(x), 1, F.greatest(F.size(x) - n, F.lit(0)))
    return mean(kept)


def trimmed_mean(x: Column, low: int, high: int) -> Column:
    kept = F.slice(F.array_sort(x), low + 1, F.greatest(F.size(x) - low - high, F.lit(0)))
    return mean(kept)


def two_pass_mean(x: Column, low: float, high: float, width: float) -> Column:
    """Mean of the values in [low, high], then of those at most `width` above that mean.

    The first mean is bound to a variable, so that it is worked out once and not for every value."""
    first = mean(F.filter(x, lambda v: (v >= low) & (v <= high)))
    return F.transform(F.array(first), lambda m: F.coalesce(mean(F.filter(x, lambda v: v < m + width)), m))[0]


def best_peak(peaks: Column, by: str = "height", low: float | None = None, high: float | None = None, time: str = "time") -> Column:
    """Index from 0 of the largest peak (struct array) in an optional time window, -1 if there is none."""
    indexed = F.transform(peaks, lambda p, i: F.struct(p.getField(by).alias("v"), (-i).alias("i"), p.getField(time).alias("t")))
    kept = indexed
    if low is not None:
        kept = F.filter(kept, lambda p: p.getField("t") >= low)
    if high is not None:
        kept = F.filter(kept, lambda p: p.getField("t") <= high)
    return F.coalesce(-F.array_max(kept).getField("i"), F.lit(-1))


def keep_peaks(peaks: Column, bounds: dict[str, tuple[float | None, float | None]], quality: str | None = None, accept: int = 0, reject: int = 0) -> Column:
    """Peaks within inclusive bounds by field, and by quality bits."""

    def ok(p: Column) -> Column:
        c = F.lit(True)
        for name, (lo, hi) in bounds.items():
            v = p.getField(name)
            if lo is not None:
                c = c & (v >= lo)
            if hi is not None:
                c = c & (v <= hi)
        if quality is not None:
            q = p.getField(quality)
            c = c & (q.bitwiseAND(reject) == 0)
            if accept:
                c = c & (q.bitwiseAND(accept) != 0)
        return c

    return F.filter(peaks, ok)
