"""Operators on ordered streams: forward fill, as-of lookup, adjacent pairs, merged order.

Streams without a key are cut into blocks of the ordering number, so that no window gathers the
whole stream: rows are filled within their block, and only one summary row per block goes through
a window over all blocks. A keyed stream is partitioned by its keys, with blocks as well if given."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beamframe.scratch import stored

_B = "_block"


def _block(order: str, block: int | None) -> Column:
    return F.floor(F.col(order) / F.lit(block)) if block else F.lit(0).cast("bigint")


def forward_fill(df: DataFrame, order: Sequence[str], values: Sequence[str], keys: Sequence[str] = (), block: int | None = None) -> DataFrame:
    """Replace nulls of `values` by the last value before, in `order` within `keys`.

    order[0] is a number; the others break ties. With `block` the carry comes from block summaries."""
    x = df.withColumn(_B, _block(order[0], block))
    w = Window.partitionBy(*keys, _B).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = x.select(*[c for c in x.columns if c not in values], *[F.last(v, ignorenulls=True).over(w).alias(v) for v in values])
    if not block:
        return filled.select(*df.columns)
    at = F.struct(*order)
    ends = x.groupBy(*keys, _B).agg(*[F.max(F.when(F.col(v).isNotNull(), F.struct(at.alias("at"), F.col(v).alias("v")))).getField("v").alias(v) for v in values])
    over = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, _B, *[F.last(v, ignorenulls=True).over(over).alias(f"_carry_{v}") for v in values])
    on = [*keys, _B]
    out = filled.join(carry, on, "left")
    return out.select(*[F.coalesce(c, f"_carry_{c}").alias(c) if c in values else F.col(c) for c in df.columns])


def as_of(left: DataFrame, right: DataFrame, left_on: str, right_on: str, values: Sequence[str], keys: Sequence[str] = (), strict: bool = False, block: int | None = None) -> DataFrame:
    """Columns of `left` and `values` of the last right row at or before it (before it, if strict).

    Right rows with equal keys and order resolve to the largest `values`."""
    side = F.lit(1 if strict else 0)
    found = F.struct(*[F.col(v) for v in values])
    right_rows = right.select(*keys, F.col(right_on).alias("_t"), side.alias("_side"), found.alias("_found"), F.lit(None).alias("_row"))
    right_rows = right_rows.groupBy(*keys, "_t", "_side").agg(F.max("_found").alias("_found"))
    left_rows = left.select(*keys, F.col(left_on).alias("_t"), (1 - side).alias("_side"), F.struct(*left.columns).alias("_row"))
    both = left_rows.unionByName(right_rows, allowMissingColumns=True)
    filled = forward_fill(both, ["_t", "_side"], ["_found"], keys, block).where("_row IS NOT NULL")
    return filled.select("_row.*", *[F.col("_found").getField(v).alias(v) for v in values])


def neighbour(df: DataFrame, order: str, values: Sequence[str], keys: Sequence[str] = (), block: int | None = None, after: bool = False, name: str = "_near") -> DataFrame:
    """Add the struct `name` of `values` of the row before (or after), null where there is none."""
    x = df.withColumn(_B, _block(order, block))
    w = Window.partitionBy(*keys, _B).orderBy(order)
    shift = F.lead if after else F.lag
    own = F.struct(*values)
    if not block:
        return x.withColumn(name, shift(own).over(w)).drop(_B)
    x = x.withColumn("_own", own).withColumn("_in", shift("_own").over(w))
    edge = (F.min_by if after else F.max_by)("_own", order)
    ends = x.groupBy(*keys, _B).agg(edge.alias("_edge"))
    over = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(_B)
    carry = ends.select(*keys, _B, shift("_edge").over(over).alias("_carry"))
    return x.join(carry, [*keys, _B], "left").select(*df.columns, F.coalesce("_in", "_carry").alias(name))


def running_totals(df: DataFrame, order: str, values: dict[str, Column], keys: Sequence[str] = (), block: int | None = None, ties: Sequence[Column | str] = ()) -> DataFrame:
    """Add cumulative sums of `values` in the order of a number column (and `ties`): sums inside blocks of that
    number, plus the sums of the blocks before, so that a long stream is many tasks."""
    x = df.withColumn(_B, _block(order, block))
    w = Window.partitionBy(*keys, _B).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    own = x.select("*", *[F.sum(v).over(w).alias(f"_own_{n}") for n, v in values.items()])
    if not block:
        return own.select(*df.columns, *[F.col(f"_own_{n}").alias(n) for n in values])
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    sums = x.groupBy(*keys, _B).agg(*[F.sum(v).alias(f"_all_{n}") for n, v in values.items()])
    sums = sums.select(*keys, _B, *[F.coalesce(F.sum(f"_all_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in values])
    return own.join(sums, [*keys, _B]).select(*df.columns, *[(F.col(f"_own_{n}") + F.col(f"_before_{n}")).alias(n) for n in values])


def number_rows(df: DataFrame, order: str, block: int, name: str = "number", keys: Sequence[str] = (), ties: Sequence[Column | str] = ()) -> DataFrame:
    """Add the row's number from 1 in the order of a number column, without one task seeing all rows of a key."""
    return running_totals(df, order, {name: F.lit(1)}, keys, block, ties)


def over_last(df: DataFrame, order: str, n: int, values: dict[str, Column], keys: Sequence[str] = (), block: int | None = None, stretch: int = 100) -> DataFrame:
    """Add aggregates of `values` over a row and the n - 1 rows before it.

    Rows are numbered and dealt out in stretches of `stretch` times n; each also gets the n - 1 rows before it."""
    span = stretch * n
    x = number_rows(df, order, block, "_no", keys)
    part = F.floor((F.col("_no") - 1) / span)
    last = (F.col("_no") - 1) % span >= span - n + 1  # the next part needs these too
    dealt = x.withColumn("_part", F.explode(F.when(last, F.array(part, part + 1)).otherwise(F.array(part))))
    w = Window.partitionBy(*keys, "_part").orderBy("_no").rowsBetween(1 - n, 0)
    out = dealt.select("*", *[v.over(w).alias(name) for name, v in values.items()]).where(F.col("_part") == part)
    return out.select(*df.columns, *values)


def adjacent_intervals(checkpoints: DataFrame, order: str, good: str, keys: Sequence[str] = (), block: int | None = None) -> DataFrame:
    """keys, lo, hi of neighbouring checkpoints that are both good."""
    x = neighbour(checkpoints.select(*keys, order, good), order, [order, good], keys, block)
    return x.where(F.col(good) & F.col("_near").getField(good)).select(*keys, F.col("_near").getField(order).alias("lo"), F.col(order).alias("hi"))


def in_good_interval(events: DataFrame, checkpoints: DataFrame, order: str, good: str, keys: Sequence[str] = (), block: int | None = None) -> DataFrame:
    """Events that lie in some (lo, hi] of neighbouring good checkpoints (an interval semi join).

    The last checkpoint before the event and the next one, which is at it or after it, decide."""
    x = neighbour(checkpoints.select(*keys, order, good), order, [good], keys, block, after=True)
    marks = x.select(*keys, F.col(order).alias("_at"), (F.col(good) & F.coalesce(F.col("_near").getField(good), F.lit(False))).alias("_keep"))
    return as_of(events, marks, order, "_at", ["_keep"], keys, strict=True, block=block).where("_keep").drop("_keep")


def counter_ratio(df: DataFrame, order: str, gated: str, ungated: str, keys: Sequence[str], block: int | None = None, name: str = "live") -> DataFrame:
    """Add the live fraction between readouts: increments of two counters. A counter that runs backwards was
    reset, both then start from zero, as before the first readout; no advance gives -1."""
    x = neighbour(df, order, [gated, ungated], keys, block, name="_last")
    pg, pu = (F.coalesce(F.col("_last").getField(c), F.lit(0)) for c in (gated, ungated))
    reset = (F.col(gated) < pg) | (F.col(ungated) < pu)
    dg, du = F.col(gated) - F.when(reset, 0).otherwise(pg), F.col(ungated) - F.when(reset, 0).otherwise(pu)
    return x.select(*df.columns, F.when(du > 0, dg / du).otherwise(F.lit(-1.0)).alias(name))


def with_one(df: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of a table of a single row."""
    return df.join(F.broadcast(one), F.lit(True), "left")


def value_ranges(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, _v, _c, _range: different values with their counts, stored in ranges of a global sort."""
    x = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    counted = x.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    return stored(counted.orderBy(*keys, "_v").withColumn("_range", F.spark_partition_id()), "ranges")


def exact_median(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, n, median (even n: mean of the middle two) of a number column's values, exact.

    Different values with their counts are sorted into ranges of about equal numbers of rows, whatever the
    values are, so neither tails nor outliers nor a value that repeats make one range large. The ranges'
    counts tell which of them hold the middle ranks; only these are looked at again, each in a task."""
    keys = list(keys)
    ranges = value_ranges(df, value, keys)
    whole = Window.partitionBy(*(keys or [F.lit(0)]))  # a row a range
    sizes = ranges.groupBy(*keys, "_range").agg(F.sum("_c").alias("_in"))
    sizes = sizes.withColumn("n", F.sum("_in").over(whole)).withColumn("_before", F.sum("_in").over(whole.orderBy("_range")) - F.col("_in"))
    first, second = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    holds = lambda r, size: (F.col("_before") < r) & (r <= F.col("_before") + F.col(size))
    middle = sizes.where(holds(first, "_in") | holds(second, "_in")).select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys)), F.col("_range").alias("_r"), "_before", "n")
    on = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_{i}"))
    own = F.sum("_c").over(Window.partitionBy(*keys, "_range").orderBy("_v"))
    r = ranges.join(middle, on).withColumn("_before", F.col("_before") + own - F.col("_c"))
    pick = lambda k: F.max(F.when(holds(k, "_c"), F.col("_v")))
    return r.groupBy(*keys, "n").agg(((pick(first) + pick(second)) / 2).alias("median"))


def robust_stats(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """n, median, mad and sigma = 1.4826 mad, exact; is_valid where n > 1 and sigma > 0.

    A group without values gives no row. Both medians are stored, so what reads the result runs neither again."""
    keys = list(keys)
    rows = df.select(*keys, F.col(value).alias("_x")).where("_x IS NOT NULL")
    med = stored(exact_median(rows, "_x", keys), "medians")
    joined = rows.join(med, keys) if keys else with_one(rows, med)
    off = exact_median(joined.select(*keys, F.abs(F.col("_x") - F.col("median")).alias("_off")), "_off", keys).withColumnRenamed("median", "mad").drop("n")
    both = med.join(off, keys) if keys else with_one(med, off)
    return stored(both.withColumn("sigma", 1.4826 * F.col("mad")).withColumn("is_valid", (F.col("n") > 1) & (F.col("sigma") > 0)), "robust")


def within(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Inclusive cut with optional bounds; a missing value fails."""
    ok = value.isNotNull()
    if low is not None:
        ok = ok & (value >= low)
    if high is not None:
        ok = ok & (value <= high)
    return F.coalesce(ok, F.lit(False))


def within_sigma(value: Column, median: Column, sigma: Column, is_valid: Column, n: float) -> Column:
    """Relative cut around the median; passes where the statistics are not valid."""
    return F.coalesce(value.isNotNull() & (~F.coalesce(is_valid, F.lit(False)) | (F.abs(value - median) <= n * sigma)), F.lit(False))


def trapezoid_charge(df: DataFrame, order: str, time: str, live: str, current: str, keys: Sequence[str], block: int | None = None) -> DataFrame:
    """Per key: sum of live fraction * seconds * mean current over neighbouring rows; steps that do not
    advance or lack a value are skipped and counted."""
    x = neighbour(df, order, [time, current], keys, block, name="_last")
    before = F.col("_last").getField(time)
    dt = F.col(time) - before
    mid = 0.5 * (F.col(current) + F.col("_last").getField(current))
    step = x.select(*keys, before.isNotNull().alias("pair"), F.when((dt > 0) & (F.col(live) >= 0), F.col(live) * dt * mid).alias("q"))
    return step.groupBy(*keys).agg(F.sum("q").alias("charge"), F.count_if("pair").alias("steps"), F.count("q").alias("integrated"), F.count_if(F.col("pair") & F.col("q").isNull()).alias("skipped"))
