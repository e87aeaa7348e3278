"""A live stream of events from a folder that a run is being written to.

    spark.dataSource.register(LiveSource)
    spark.readStream.format("live_banks").load(folder)

The run comes in files, by name; the last one may still grow. An offset is a file, a place in it and the
number of the event there, so a restart goes on where the checkpoint says, and only whole events are
taken: an event whose end is not written yet waits. In a file that a later one follows, an unfinished
event is given as it is, marked broken.

When the folder can't be read (its store is away), the stream stays up without new rows and tries again
after 3 s, 6 s, ... 30 s (`retry_ms`, `most_retry_ms`), as a live station is waited for; the first success sets
the wait back. Tasks try again as often as `attempts`, then leave it to Spark.

Options: path; max_events of a batch (all); retry_ms, most_retry_ms, attempts; station, the dotted name of
a class to use in place of `FolderStation`."""

from __future__ import annotations

import importlib
import time
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from beamframe.sources import bank_source as S
from beamframe.sources import banks


class BackOff:
    """Waits that double from `first` to `most` seconds while attempts fail."""

    def __init__(self, first: float, most: float):
        self.first, self.most, self.wait, self.ready = first, most, first, 0.0

    def due(self, now: float) -> bool:
        return now >= self.ready

    def failed(self, now: float) -> float:
        wait, self.ready = self.wait, now + self.wait
        self.wait = min(self.most, 2 * self.wait)
        return wait

    def worked(self) -> None:
        self.wait, self.ready = self.first, 0.0


class FolderStation:
    """The files of a run, read where they are. Any OSError is a station that is away."""

    def __init__(self, path: str):
        self.path = path

    def files(self) -> list[tuple[str, int]]:
        """(file, bytes) by name."""
        fs, _ = S.open_path(self.path)
        return [(i.path, i.size) for i in fs.get_file_info(S.bank_files(self.path))]

    def open(self, file: str) -> pa.NativeFile:
        fs, _ = S.open_path(self.path)
        return fs.open_input_file(file)


class LiveReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.rows = S.BankReader(schema, options)
        module, _, name = options.get("station", "beamframe.streaming.live.FolderStation").rpartition(".")
        self.station = getattr(importlib.import_module(module), name)(options["path"])
        self.most = int(options.get("max_events", 1 << 62))
        self.attempts = int(options.get("attempts", 3))
        self.waits = [float(options.get(k, d)) / 1000 for k, d in (("retry_ms", 3000), ("most_retry_ms", 30_000))]
        self.back_off = BackOff(*self.waits)
        self.head = self.initialOffset()

    def initialOffset(self) -> dict:
        return {"file": "", "at": 0, "event": 0}

    def latestOffset(self) -> dict:
        """The end of the last whole event, or where the stream is while the station is away."""
        if self.back_off.due(time.monotonic()):
            try:
                self.head = self._ahead(self.head)
                self.back_off.worked()
            except OSError:
                self.back_off.failed(time.monotonic())
        return self.head

    def _ahead(self, start: dict) -> dict:
        head, left = dict(start), self.most
        files = [(f, n) for f, n in self.station.files() if f >= head["file"]]
        for i, (name, size) in enumerate(files):
            if name != head["file"]:
                head = {"file": name, "at": 0, "event": 0}
            with self.station.open(name) as f:
                for at, n, _ in S.events_of(f, head["at"], size, iter(lambda: False, None)):
                    whole = at + n <= size
                    if not left or not whole and i + 1 == len(files):
                        break
                    head = {"file": name, "at": min(at + n, size), "event": head["event"] + 1}
                    left -= 1
            if not left:
                break
        return head

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        """A range of events for each file between two offsets."""
        self.head = max(self.head, end, key=lambda o: (o["file"], o["at"]))  # after a restart
        out = []
        for name, size in self._retried(self.station.files):
            if start["file"] <= name <= end["file"]:
                at, event = (start["at"], start["event"]) if name == start["file"] else (0, 0)
                stop = end["at"] if name == end["file"] else size
                if stop > at:
                    out.append(S.Range(name, event, at, stop - at, None))
        return out

    def _retried(self, call):
        back_off = BackOff(*self.waits)
        for k in range(self.attempts):
            try:
                return call()
            except OSError:
                if k + 1 == self.attempts:
                    raise
                time.sleep(back_off.failed(0.0))

    def read(self, partition: S.Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        with self._retried(lambda: self.station.open(partition.file)) as f:
            events = (words for _, _, words in S.events_of(f, partition.begin, partition.begin + partition.size))
            yield from self.rows.batches(partition.file, enumerate(events, partition.first_event))

    def commit(self, end: dict) -> None:
        pass  # the run's files stay


class LiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "live_banks"

    def schema(self) -> str:
        return banks.NODES

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return LiveReader(schema, self.options)


def live_banks(spark: SparkSession, path: str, columns: str | None = None, **options: object) -> DataFrame:
    """Banks of a run as they are written."""
    spark.dataSource.register(LiveSource)
    r = spark.readStream.format("live_banks")
    r = r.schema(columns) if columns else r
    for k, v in options.items():
        r = r.option(k, str(v))
    return r.load(path)
