"""Stateful processors with timers, maps and lists (Structured Streaming's arbitrary state).

Flushing by size or age, snapshots of all channels, and throttled rings. State is kept by key in RocksDB,
rows of a key inside a batch are put in order, and what is emitted depends on the rows, not on how they
are split into batches. State and results commit together with the checkpoint, so a batch that is
delivered again finds the state that it found the first time. Many keys of few rows are handled as rows,
as a table for each key costs more than its work; few keys of many rows as tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _in_order(rows: Iterator[Row], columns: list[str]) -> list[tuple]:
    """A key's rows of one batch by their first column, then the others, so that ties don't follow how the rows
    came in; nulls are last."""
    return sorted((tuple(r[c] for c in columns) for r in rows), key=lambda r: [(v is None, v) for v in r])


class Flush(StatefulProcessor):
    """Rows of a key wait until there are `size` of them, or the first has waited `age` milliseconds.

    With event time, age is told by the rows' own times and by the watermark; with processing time by the
    clock. A timer is set when a group begins, so a group that no later row follows is flushed as well. A row
    without a time ends no group by age, and a group that begins with one has no age: it is flushed by size."""

    def __init__(self, key: str, order: str, time_ms: str, size: int, age_ms: int, by_clock: bool):
        self.key, self.order, self.time_ms, self.size, self.age, self.by_clock = key, order, time_ms, size, age_ms, by_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "item bigint")
        self.group = handle.getValueState("group", "number bigint, begun bigint")

    def _flushed(self, key: tuple, number: int, items: list[int | None], reason: str) -> Row:
        known = [i for i in items if i is not None] or [None]
        return Row(**{self.key: key[0], "flush": number, "n_rows": len(items), "first": known[0], "last": known[-1], "reason": reason})

    def _held(self) -> tuple[list[int | None], int, int | None]:
        group = self.group.get()
        return ([v[0] for v in self.waiting.get()], *group) if group else ([], 0, 0)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        items, number, begun = self._held()
        before = begun if items else None
        clock = timerValues.getCurrentProcessingTimeInMs() if self.by_clock else 0
        out = []
        for item, at in _in_order(rows, [self.order, self.time_ms]):
            now = clock if self.by_clock else at
            if items and None not in (now, begun) and now - begun >= self.age:
                out.append(self._flushed(key, number, items, "age"))
                items, number = [], number + 1
            begun = now if not items else begun
            items.append(item)
            if len(items) >= self.size:
                out.append(self._flushed(key, number, items, "size"))
                items, number = [], number + 1
        if items:
            self.waiting.put([(i,) for i in items])
        else:
            self.waiting.clear()
        self.group.update((number, begun))
        after = begun if items else None
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before + self.age)
            if after is not None:
                self.handle.registerTimer(after + self.age)
        yield from out

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        items, number, begun = self._held()
        if items and begun is not None and expiredTimerInfo.getExpiryTimeInMs() >= begun + self.age:
            self.waiting.clear()
            self.group.update((number + 1, begun))
            yield self._flushed(key, number, items, "age")

    def close(self) -> None:
        pass


def flush_by_size_or_age(stream: DataFrame, key: str, order: str, time: str, size: int, age_ms: int, late: str | None = None) -> DataFrame:
    """key, flush, n_rows, first, last, reason of every group that was flushed.

    `late` makes it event time, with that watermark on the column `time`; without it the clock decides. Rows that
    come later than the watermark, or from before 1970, where it starts, are flushed like others: the column
    itself stays behind, as Spark drops what it finds late by it."""
    rows = stream.withWatermark(time, late) if late else stream
    rows = rows.select(key, F.col(order).cast("bigint").alias(order), F.unix_millis(F.col(time)).alias("time_in_ms"))
    kind = stream.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, flush bigint, n_rows bigint, first bigint, last bigint, reason string"
    return rows.groupBy(key).transformWithState(Flush(key, order, "time_in_ms", size, age_ms, late is None), schema, "Append", "EventTime" if late else "ProcessingTime")


class Snapshots(StatefulProcessor):
    """The latest value of every channel of a key, in one map; every marked row gets the whole map.

    A key's rows of one batch are held as three numbers each; the result leaves in tables of about `SLICE` rows."""

    SLICE = 1 << 17

    def __init__(self, key: str, order: str, channel: str, value: str):
        self.key, self.order, self.channel, self.value = key, order, channel, value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "channel string", "value double")

    def _columns(self, rows: Iterator[pd.DataFrame], names: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order, number of the channel (-1: none) and value; new channels are added to `names`."""
        at, number, value = [], [], []
        for part in rows:
            codes, found = pd.factorize(part[self.channel])
            numbers = np.array([*(names.setdefault(c, len(names)) for c in found), -1], np.int32)
            at.append(part[self.order].astype(np.int64).to_numpy())
            number.append(numbers[codes])
            value.append(part[self.value].to_numpy(float, na_value=np.nan))
        return np.concatenate(at), np.concatenate(number), np.concatenate(value)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        latest = {k[0]: v[0] for k, v in self.known.iterator()}
        names = {c: i for i, c in enumerate(latest)}
        at, number, value = self._columns(rows, names)
        channels = np.array([*names, None], object)[:-1]
        held = np.full(len(names), np.nan)
        held[: len(latest)] = list(latest.values())
        changed = np.zeros(len(names), bool)
        order = np.argsort(at, kind="stable")
        step = max(1, self.SLICE // max(1, len(names)))
        for i in range(0, len(order), step):
            own = order[i : i + step]
            marks = np.flatnonzero(number[own] < 0)
            read = np.flatnonzero((number[own] >= 0) & ~np.isnan(value[own]))
            read = read[np.argsort(number[own[read]], kind="stable")]
            which, first = np.unique(number[own[read]], return_index=True)
            seen = np.repeat(held[:, None], len(marks), axis=1)
            for c, places in zip(which, np.split(read, first[1:]), strict=False):
                k = np.searchsorted(places, marks) - 1
                seen[c] = np.where(k >= 0, value[own[places[k]]], held[c])
                held[c] = value[own[places[-1]]]
                changed[c] = True
            c, m = np.nonzero(~np.isnan(seen))
            if len(c):
                yield pd.DataFrame({self.key: key[0], self.order: at[own[marks[m]]], self.channel: channels[c], self.value: seen[c, m]})
        for c in np.flatnonzero(changed):
            self.known.updateValue((channels[c],), (float(held[c]),))

    def close(self) -> None:
        pass


def snapshots(stream: DataFrame, key: str, order: str, channel: str, value: str) -> DataFrame:
    """For every row without a channel (an event): a row per channel of its key that was read before, with the
    latest value. Readings are rows with a channel; those without a value change nothing."""
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(key, F.col(order).cast("bigint").alias(order), channel, F.col(value).cast("double").alias(value))
    return rows.groupBy(key).transformWithStateInPandas(Snapshots(key, order, channel, value), f"{key} {kind}, {order} bigint, {channel} string, {value} double", "Append", "None")


class Ring(StatefulProcessor):
    """The last `n` rows let in, at most one every `gap`; the list is the state, its changes are emitted."""

    def __init__(self, key: str, order: str, at: str, n: int, gap: int, ttl_ms: int | None):
        self.key, self.order, self.at, self.n, self.gap, self.ttl = key, order, at, n, gap, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "seq bigint, item bigint, at bigint", self.ttl)
        self.last = handle.getValueState("last", "seq bigint, at bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held = self.last.get()
        ring = list(self.ring.get()) if held else []
        seq, last = held or (0, None)
        pushed = Row(self.key, "slot", "seq", self.order, "evicted")
        out = []
        for item, at in _in_order(rows, [self.order, self.at]):
            if last is None or at - last >= self.gap:
                seq, last = seq + 1, at
                ring.append((seq, item, at))
                out.append(pushed(key[0], seq % self.n, seq, item, ring[-self.n - 1][1] if len(ring) > self.n else None))
                ring = ring[-self.n :]
        if out:
            self.ring.put(ring)
            self.last.update((seq, last))
        yield from out

    def close(self) -> None:
        pass


def throttled_ring(stream: DataFrame, key: str, order: str, at: str, n: int, gap: int, ttl_ms: int | None = None) -> DataFrame:
    """key, slot, seq, order, evicted: rows let into the key's ring, at least `gap` (in units of `at`) after the
    one before, each with the slot that it takes and the row that leaves. A slot's row of the greatest seq is
    the ring's content. After `ttl_ms` without use the list of a key goes; its numbering stays."""
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(key, F.col(order).cast("bigint").alias(order), F.col(at).cast("bigint").alias("ring_at"))
    schema = f"{key} {kind}, slot bigint, seq bigint, {order} bigint, evicted bigint"
    return rows.groupBy(key).transformWithState(Ring(key, order, "ring_at", n, gap, ttl_ms), schema, "Append", "ProcessingTime" if ttl_ms else "None")


def ring_content(pushed: DataFrame, key: str, order: str) -> DataFrame:
    """What a throttled ring holds after all that was pushed."""
    return pushed.groupBy(key, "slot").agg(F.max_by(order, "seq").alias(order))
