"""Accumulators and stateful operators on streams (Structured Streaming).

Aggregations are the batch ones on a streaming table. State is kept by key and is of fixed size (a
previous readout, a latest value, a bounded history); rows of a key inside a batch are put in order
before they are applied, so a batch run and any split into batches give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from beamframe.scratch import file_system


def read_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files: int = 8) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)


def windowed(stream: DataFrame, time: str, late: str, width: str, slide: str | None = None, keys: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """Counts and sums by window and keys; rows later than `late` are dropped."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    g = stream.withWatermark(time, late).groupBy(w.alias("w"), *keys)
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(stream: DataFrame, time: str, late: str, gap: str, key: str) -> DataFrame:
    g = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key)
    return g.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def latest_per_key(stream: DataFrame, key: str, order: str, value: str, least: float | None = None) -> DataFrame:
    """The value of the greatest order per key; values under `least` don't count."""
    rows = stream if least is None else stream.where(F.col(value) >= least)
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def once_per_key(stream: DataFrame, keys: list[str], time: str, within: str) -> DataFrame:
    """The first row of a key inside a time window, as for run starts that several sources report."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def _stateful(stream: DataFrame, key: str, order: str, step: Callable, out: str, state: str) -> DataFrame:
    """step(state tuple or None, rows of the key in order) -> (new state tuple, output table without the key)."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        new, table = step(held.get if held.exists else None, rows)
        held.update(new)
        table.insert(0, key, k[0])
        yield table

    schema = f"{key} {stream.schema[key].dataType.simpleString()}, {out}"
    return stream.groupBy(key).applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.NoTimeout)


def live_fraction(stream: DataFrame, key: str, order: str, gated: str, ungated: str) -> DataFrame:
    """Increments of two counters since the previous readout of the key, reset where one runs backwards."""

    def step(held, rows: pd.DataFrame):
        pg, pu = held or (0, 0)
        live = []
        for g, u in zip(rows[gated], rows[ungated], strict=True):
            if g < pg or u < pu:
                pg = pu = 0
            live.append((g - pg) / (u - pu) if u > pu else -1.0)
            pg, pu = int(g), int(u)
        return (pg, pu), pd.DataFrame({order: rows[order].to_numpy(), "live": live})

    return _stateful(stream, key, order, step, f"{order} bigint, live double", "gated bigint, ungated bigint")


def carry_forward(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Every row with the latest value that is not null."""

    def step(held, rows: pd.DataFrame):
        filled = rows[value].astype(float)
        if held is not None and held[0] is not None and len(filled) and pd.isna(filled.iloc[0]):
            filled.iloc[0] = held[0]
        filled = filled.ffill()
        last = filled.iloc[-1]
        return (None if pd.isna(last) else float(last),), pd.DataFrame({order: rows[order].to_numpy(), value: filled.to_numpy()})

    return _stateful(stream, key, order, step, f"{order} bigint, {value} double", "last double")


def boundaries(stream: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """Rows where the label of a key changes (a run starts), with the one before."""

    def step(held, rows: pd.DataFrame):
        before = held[0] if held else None
        was = [before, *rows[label].tolist()[:-1]]
        new = [a != b for a, b in zip(was, rows[label], strict=True)]
        out = pd.DataFrame({order: rows[order], label: rows[label], "before": was})[new]
        return (rows[label].iloc[-1],), out

    return _stateful(stream, key, order, step, f"{order} bigint, {label} string, before string", "label string")


def history(stream: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first n rows of every key, as a capped history keeps them."""

    def step(held, rows: pd.DataFrame):
        seen = held[0] if held else 0
        kept = rows.head(max(0, n - seen))
        return (seen + len(kept),), pd.DataFrame({order: kept[order].to_numpy(), "position": range(seen + 1, seen + len(kept) + 1)})

    return _stateful(stream, key, order, step, f"{order} bigint, position bigint", "n bigint")


def anchored_times(stream: DataFrame, key: str, order: str, kind: str, tick: str, unix: str, tick_seconds: float = 4e-9) -> DataFrame:
    """Seconds of each `pulse` row since the key's first one, and its unix time from the key's first `sync` row.

    A sync row ties unix time to a tick. One that comes before any pulse waits for the first pulse, whose
    tick is the zero of seconds; later sync rows and those without a unix time change nothing. Pulses
    before the anchor is known have no unix time."""

    def step(held, rows: pd.DataFrame):
        first, at_unix, at_tick = held or (None, None, None)
        out = []
        for o, k, t, u in zip(rows[order], rows[kind], rows[tick], rows[unix], strict=True):
            if k == "sync" and at_unix is None and not pd.isna(u) and u:
                at_unix, at_tick = int(u), int(t)
            elif k == "pulse":
                first = int(t) if first is None else first
                known = at_unix is not None
                out.append((o, (int(t) - first) * tick_seconds, at_unix + (int(t) - at_tick) * tick_seconds if known else None))
        return (first, at_unix, at_tick), pd.DataFrame(out, columns=[order, "seconds", "unix_time"])

    return _stateful(stream, key, order, step, f"{order} bigint, seconds double, unix_time double", "first bigint, at_unix bigint, at_tick bigint")


def at_most_every(stream: DataFrame, key: str, order: str, gap: int) -> DataFrame:
    """Rows of a key that come at least `gap` (in units of `order`) after the last one let through."""

    def step(held, rows: pd.DataFrame):
        last, kept = held[0] if held else None, []
        for o in rows[order].tolist():
            if last is None or o - last >= gap:
                last = o
                kept.append(o)
        return (last,), pd.DataFrame({order: kept})

    return _stateful(stream, key, order, step, f"{order} bigint", "last bigint")


def flush_groups(stream: DataFrame, key: str, order: str, size: int, age: int) -> DataFrame:
    """Rows with the number of the group that they are flushed with: a group ends when it has `size` rows, or
    with the first row that comes `age` or more (in units of `order`) after the group began."""

    def step(held, rows: pd.DataFrame):
        group, n, begun = held or (0, 0, 0)
        out = []
        for o in rows[order].tolist():
            if n and (n >= size or o - begun >= age):
                group, n = group + 1, 0
            begun = o if n == 0 else begun
            n += 1
            out.append((o, group))
        return (group, n, begun), pd.DataFrame(out, columns=[order, "flush"])

    return _stateful(stream, key, order, step, f"{order} bigint, flush bigint", "n_group bigint, n_rows bigint, begun bigint")


def run_to_table(stream: DataFrame, path: str, mode: str = "append", provider: str | None = None) -> DataFrame:
    """Run a stream over all that its source holds and read the result back; `provider` keeps its state.

    Each batch goes to its own folder, so a batch that is retried replaces itself; in complete and
    update mode the batch is the whole result or the newest rows by folder."""
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={number if mode != 'complete' else 0}")

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    if provider:
        spark.conf.set(key, provider)
    try:
        q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        if provider:
            spark.conf.set(key, before) if before else spark.conf.unset(key)
    return spark.read.schema(stream.schema).parquet(f"{path}/data/batch=*")


def keep_last(batch: DataFrame, number: int, path: str, order: str, n: int) -> None:
    """For foreachBatch: a ring of the last n rows, as a folder per batch. The ring before stays until the
    next batch, so that a batch that is delivered again finds what it found the first time."""
    spark = batch.sparkSession
    ring = lambda k: file_system(spark, f"{path}/ring={k}")
    before, fs = ring(number - 1)
    rows = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/ring={number - 1}")) if fs.exists(before) else batch
    rows.orderBy(F.desc(order)).limit(n).write.mode("overwrite").parquet(f"{path}/ring={number}")
    fs.delete(ring(number - 2)[0], True)


def read_ring(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The ring after the last batch."""
    rings = spark.read.schema(schema).option("basePath", path).parquet(f"{path}/ring=*")
    return rings.join(rings.agg(F.max("ring").alias("ring")), "ring").drop("ring")  # a table of one row
