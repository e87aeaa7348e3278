"""Histograms, occupancies, efficiencies and summary statistics.

Everything is a grouped aggregation, so it combines before the shuffle; bins that hold nothing are
left out unless a dense result is asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_of(v: Column, low: float, step: float, n: int) -> Column:
    """Bin number, -1 under and n over; null stays null."""
    b = F.floor((v - low) / step)
    return F.when(v < low, -1).when(b >= n, n).otherwise(b).cast("bigint")


def histogram(df: DataFrame, value: str | Column, low: float, step: float, n: int, keys: Sequence[str | Column] = (), weight: Column | None = None) -> DataFrame:
    """keys, bin, n_rows (or their weight); under- and overflow are bins -1 and n."""
    v = F.col(value) if isinstance(value, str) else value
    total = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.where(v.isNotNull()).groupBy(*keys, bin_of(v, low, step, n).alias("bin")).agg(total.alias("n_rows"))


def dense(hist: DataFrame, n: int) -> DataFrame:
    """All bins 0..n-1 of a one-dimensional histogram, with zeros."""
    bins = hist.sparkSession.range(n).select(F.col("id").alias("bin"))
    return bins.join(hist.where((F.col("bin") >= 0) & (F.col("bin") < n)), "bin", "left").select("bin", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def histogram_2d(df: DataFrame, x: Column, y: Column, bx: tuple[float, float, int], by: tuple[float, float, int], truncate: bool = False) -> DataFrame:
    """xbin, ybin, n_rows inside the ranges; `truncate` lets values up to a step below the edge into bin 0."""

    def index(v: Column, low: float, step: float) -> Column:
        q = (v - low) / step
        return (q.cast("bigint") if truncate else F.floor(q)).cast("bigint")

    i, j = index(x, bx[0], bx[1]), index(y, by[0], by[1])
    return df.select(i.alias("xbin"), j.alias("ybin")).where(F.col("xbin").between(0, bx[2] - 1) & F.col("ybin").between(0, by[2] - 1)).groupBy("xbin", "ybin").agg(F.count(F.lit(1)).alias("n_rows"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.when(b != 0, a / b)


def ratio_histogram(num: DataFrame, den: DataFrame) -> DataFrame:
    """Bins of both histograms, and their ratio where the denominator has rows."""
    d = den.select("bin", F.col("n_rows").alias("den"))
    return num.select("bin", F.col("n_rows").alias("num")).join(d, "bin").where("den <> 0").select("bin", "num", "den", (F.col("num") / F.col("den")).alias("ratio"))


def mean_rms(value: str) -> list[Column]:
    return [F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("rms")]


def line_fit(x: Column, y: Column) -> list[Column]:
    return [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")]


def weighted_line(df: DataFrame, z: str, axis: str, weight: str, keys: Sequence[str]) -> DataFrame:
    """Weighted least squares axis = a + b z per key, chi2 per degree of freedom (null under 3 points)."""
    w, x, y = F.col(weight), F.col(z), F.col(axis)
    s = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("s"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy"), F.sum(w * y * y).alias("syy"))
    det = F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx")
    b = (F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(det, F.lit(0.0))
    s = s.withColumn("b", b).withColumn("a", (F.col("sy") - F.col("b") * F.col("sx")) / F.col("s"))
    chi2 = F.col("syy") - F.col("a") * F.col("sy") - F.col("b") * F.col("sxy")
    return s.select(*keys, "n", "a", "b", F.when(F.col("n") > 2, chi2 / (F.col("n") - 2)).alias("chi2_dof"))


def level(value: Column, warn: float, alert: float) -> Column:
    return F.when(value.isNull(), "none").when(value >= alert, "alert").when(value >= warn, "warn").otherwise("ok")


def gaussian_noise(key: Column, seed: int = 0) -> Column:
    """A normal deviate that depends on the key and seed alone, so a task that runs again draws the same:
    two uniform numbers from an md5 digest, by Box and Muller's rule."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f"/{seed}")).cast("binary"))
    uniform = lambda at: (F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint") + 0.5) / F.lit(2.0**32)
    return F.sqrt(-2 * F.ln(uniform(1))) * F.cos(2 * F.pi() * uniform(9))
