"""Bank files as a data source: read by ranges of events from an index, with filters inside the reader,
and written event by event.

    spark.dataSource.register(BankSource)
    index_banks(spark, folder).write.parquet(index)
    spark.read.format("banks").option("index", index).load(folder).where("tag IN (7, 8) AND event >= 1000")

Events follow one another without marks, so a file can only be cut where an event begins. The index has
a row for every range of about `range_bytes` of a file: its first event, how many events it has, and
its place. With an index a partition is a range, and files may be of any size; without one it is a file,
which is read as a stream of events all the same. Only one range's rows of the index, not of its events,
reach the planner: a row for every `range_bytes` of data. Where more than 256 ranges are left, neighbours are
read by one task, so that small ranges of a large run don't become as many tasks.

Filters on `file` and `event` choose ranges (and skip events inside them by their first words), filters
on `tag` choose banks: payloads of other tags are passed over and never decoded. All three are taken
over by the reader when the session has `spark.sql.python.filterPushdown.enabled`: the plan's own filter
keeps the others only. A schema given to the
reader (`.schema("event bigint, tag int")`) is what it yields: without `words` no payload is decoded.

Paths are read and written with pyarrow's file systems (a plain path, file:, hdfs:, s3:, gs:).

Defined cases: a last event that is cut off ends its file, its broken bank marked as in `banks.scan`; an
empty file has no events; an index of other files' events leaves those files out; null tags or events
in a filter select nothing."""

from __future__ import annotations

import itertools
import os
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from beamframe.sources import banks

INDEX = "file string, first_event bigint, n_events bigint, begin bigint, size bigint"
EVENTS = "file string, event bigint, payload binary"
CHUNK = 4 << 20
TASKS, TASK_BYTES = 256, 64 << 20  # more ranges are put together, up to so many bytes or a 256th of all
BLOCK_EVENTS, BLOCK_WORDS = 4096, 1 << 18  # decoded at once


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]+:", path):
        path = re.sub(r"^file:/+", "file:///", path)
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def bank_files(path: str) -> list[str]:
    """Data files of a folder, or the file itself, as paths of its file system; hidden ones are left out."""
    fs, at = open_path(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [info.path]
    return sorted(f.path for f in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if f.is_file and not any(p.startswith(("_", ".")) for p in f.path.removeprefix(at).strip("/").split("/")))


def events_of(file: pa.NativeFile, begin: int, end: int, wanted: Iterable[bool] | None = None, chunk: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray | None]]:
    """(place, bytes, words) of the events of one range, read in chunks; an event that `wanted` denies is
    passed over with words None, its payload not read if it lies beyond the chunk."""
    asked = iter(wanted) if wanted is not None else None
    at, held, base = begin, b"", begin
    while at < end:
        if at + 4 > base + len(held):
            file.seek(at)
            held, base = file.read(min(chunk, end - at)), at
            if len(held) < 4:
                return
        size = 4 * (1 + int.from_bytes(held[at - base : at - base + 4], "big"))
        take = next(asked, True) if asked is not None else True
        if not take:
            yield at, size, None
            at += size
            continue
        stop = min(at + size, end)
        if stop > base + len(held):
            file.seek(at)
            held, base = file.read(max(stop - at, min(chunk, end - at))), at
        body = held[at - base : stop - base]
        yield at, size, np.frombuffer(body[: len(body) // 4 * 4], ">u4")
        at += size


def index_banks(spark: SparkSession, path: str, range_bytes: int = 64 << 20) -> DataFrame:
    """A row for every range of a file; one task a file passes from event to event by their lengths."""
    files = spark.createDataFrame([(f,) for f in bank_files(path)], "file string")
    if not (n := len(bank_files(path))):
        return spark.createDataFrame([], INDEX)
    fs_of = path

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = open_path(fs_of)
        for pdf in batches:
            for name in pdf["file"]:
                out, first, begin, event = [], 0, 0, 0
                with fs.open_input_file(name) as f:
                    end = f.size()
                    for at, size, _ in events_of(f, 0, end, iter(lambda: False, None)):
                        event += 1
                        if at + size - begin >= range_bytes:
                            out.append((name, first, event - first, begin, min(at + size, end) - begin))
                            first, begin = event, at + size
                if event > first:
                    out.append((name, first, event - first, begin, end - begin))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in INDEX.split(", ")])

    return files.repartitionByRange(min(n, 4096), "file").mapInPandas(run, INDEX)


@dataclass
class Range(InputPartition):
    """Events of one file that a task reads."""

    file: str
    first_event: int
    begin: int
    size: int | None  # None: to the end of the file
    n_events: int | None


@dataclass
class Bounds:
    """What the pushed filters ask for; None is no limit."""

    tags: set[int] | None = None
    files: set[str] | None = None
    low: int = 0
    high: int | None = None
    pushed: list[Filter] = field(default_factory=list)

    def add(self, f: Filter) -> bool:
        """Take a filter over, if its column is one that the reader can choose by."""
        name = f.attribute if hasattr(f, "attribute") else ()
        if isinstance(f, IsNotNull) and name in (("tag",), ("file",), ("event",)):
            pass  # they never are
        elif name in (("tag",), ("file",)) and isinstance(f, EqualTo | EqualNullSafe | In):
            values = set(f.value if isinstance(f, In) else (f.value,))
            if isinstance(f, EqualNullSafe) and None in values:
                return False
            values.discard(None)
            kind = "tags" if name == ("tag",) else "files"
            old = getattr(self, kind)
            setattr(self, kind, values if old is None else old & values)
        elif name == ("event",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and isinstance(f.value, int):
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                most = f.value - isinstance(f, LessThan)
                self.high = most if self.high is None else min(self.high, most)
        else:
            return False
        self.pushed.append(f)
        return True


def joined_ranges(ranges: list[Range]) -> list[Range]:
    """Neighbouring ranges of a file put together, if there are many."""
    if len(ranges) <= TASKS or any(r.size is None for r in ranges):
        return ranges
    most = min(TASK_BYTES, sum(r.size for r in ranges) // TASKS)
    out: list[Range] = []
    for r in ranges:
        last = out[-1] if out else None
        if last and last.file == r.file and last.begin + last.size == r.begin and last.size + r.size <= most:
            out[-1] = Range(r.file, last.first_event, last.begin, last.size + r.size, last.n_events + r.n_events)
        else:
            out.append(r)
    return out


class BankReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.columns = schema.names
        known = [c.split()[0] for c in banks.NODES.split(", ")]
        if not set(self.columns) <= set(known):
            raise ValueError(f"banks have the columns {known}")
        self.arrow = to_arrow_schema(schema)
        self.path, self.index = options["path"], options.get("index")
        self.bounds = Bounds()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self.bounds.add(f):
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        b = self.bounds
        if b.tags == set() or b.files == set() or (b.high is not None and b.high < b.low):
            return []
        if self.index:
            fs, at = open_path(self.index)
            t = pq.read_table(at, filesystem=fs, columns=["file", "first_event", "n_events", "begin", "size"]).to_pylist()
            ranges = [Range(r["file"], r["first_event"], r["begin"], r["size"], r["n_events"]) for r in t]
        else:
            ranges = [Range(f, 0, 0, None, None) for f in bank_files(self.path)]
        kept = [r for r in ranges if (b.files is None or r.file in b.files) and (b.high is None or r.first_event <= b.high) and (r.n_events is None or r.first_event + r.n_events > b.low)]
        return joined_ranges(sorted(kept, key=lambda r: (r.file, r.begin)))

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no ranges are left
            return
        b = self.bounds
        fs, _ = open_path(self.path)
        last = b.high if b.high is not None else 1 << 62
        with fs.open_input_file(partition.file) as f:
            end = f.size() if partition.size is None else partition.begin + partition.size
            wanted = (b.low <= e <= last for e in iter(_counter(partition.first_event), None))
            numbered = enumerate((w for _, _, w in events_of(f, partition.begin, end, wanted)), partition.first_event)
            yield from self.batches(partition.file, itertools.takewhile(lambda e: e[0] <= last, numbered))

    def batches(self, file: str, events: Iterable[tuple[int, np.ndarray | None]]) -> Iterator[pa.RecordBatch]:
        """Banks of numbered events that the filters ask for; events without words are passed over."""
        numbers, held, size = [], [], 0
        for event, words in events:
            if words is not None:
                numbers.append(event)
                held.append(words)
                size += len(words)
            if len(held) >= BLOCK_EVENTS or size >= BLOCK_WORDS:
                yield from self.batch(file, numbers, held)
                numbers, held, size = [], [], 0
        if held:
            yield from self.batch(file, numbers, held)

    def batch(self, file: str, numbers: list[int], held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        words = np.concatenate(held).astype(np.int64)
        ends = np.cumsum([len(w) for w in held])
        found = banks.scan_events(words, np.append(0, ends[:-1]), ends)
        tags = self.bounds.tags
        if tags is not None:
            kept = np.isin(found["tag"], list(tags))
            found = {n: c[kept] for n, c in found.items()}
        n = len(found["node"])
        if not n:
            return
        columns = []
        for name, kind in zip(self.columns, self.arrow.types, strict=True):
            if name == "file":
                columns.append(pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), [file]).cast(kind))
            elif name == "event":
                columns.append(pa.array(np.array(numbers, np.int64)[found["event"]], kind))
            elif name == "words":
                bodies = [self.payload(k, words[a:b]) for k, a, b in zip(found["type"].tolist(), found["begin"].tolist(), found["end"].tolist(), strict=True)]
                none = np.array([w is None for w in bodies])
                offsets = np.append(0, np.cumsum([0 if w is None else len(w) for w in bodies])).astype(np.int32)
                body = np.concatenate([np.zeros(0, np.int64), *(w for w in bodies if w is not None)])
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(body), mask=pa.array(none)).cast(kind))
            else:
                columns.append(pa.array(found[name]).cast(kind))
        yield pa.RecordBatch.from_arrays(columns, schema=self.arrow)

    def payload(self, kind: int, words: np.ndarray) -> np.ndarray | None:
        return None if kind in (*banks.BANKS, *banks.SEGMENTS, *banks.TAG_SEGMENTS) else words


def _counter(start: int):
    at = start - 1

    def step() -> int:
        nonlocal at
        at += 1
        return at

    return step


@dataclass
class Written(WriterCommitMessage):
    """Files of one task, under their temporary and their final names."""

    moves: list[tuple[str, str]]


class BankWriter(DataSourceArrowWriter):
    """Events (file, event, payload) into one file per name and task. Files get their names when all tasks
    are done, so a task that is repeated, or a job that fails, leaves nothing."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, at = open_path(self.path)
        moves: list[tuple[str, str]] = []
        out = name = None
        fs.create_dir(f"{at}/_{self.job}", recursive=True)
        for batch in iterator:
            files, payload = batch.column("file"), batch.column("payload").cast(pa.large_binary())
            if files.null_count or payload.null_count:
                raise ValueError("an event to be written has no file or no payload")
            _, place, data = payload.buffers()
            place = np.frombuffer(place, np.int64)[payload.offset : payload.offset + len(payload) + 1]
            new = np.flatnonzero(pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False)) + 1
            for begin, end in itertools.pairwise([0, *new.tolist(), len(files)] if len(files) else []):
                if files[begin].as_py() != name:
                    if out is not None:
                        out.close()
                    name = files[begin].as_py()
                    temporary = f"{at}/_{self.job}/{uuid.uuid4().hex}"
                    moves.append((temporary, f"{at}/{name}"))
                    out = fs.open_output_stream(temporary)
                if place[end] > place[begin]:
                    out.write(data[int(place[begin]) : int(place[end])])
        if out is not None:
            out.close()
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = open_path(self.path)
        names = [final for m in messages if m for _, final in m.moves]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("rows of one file were written by several tasks, or not next to each other")
        old = [] if not self.overwrite else [f for f in bank_files(self.path) if f not in names]
        for m in messages:
            for temporary, final in m.moves if m else ():
                fs.move(temporary, final)
        for f in old:
            fs.delete_file(f)
        fs.delete_dir(f"{at}/_{self.job}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = open_path(self.path)
        if fs.get_file_info(f"{at}/_{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{at}/_{self.job}")


class BankSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "banks"

    def schema(self) -> str:
        return banks.NODES

    def reader(self, schema: StructType) -> DataSourceReader:
        return BankReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if not {"file", "payload"} <= set(schema.names):
            raise ValueError("a bank file is written from the columns file and payload")
        return BankWriter(self.options, overwrite)


def use_bank_files(spark: SparkSession) -> None:
    """Register the source and let filters into it."""
    spark.dataSource.register(BankSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# --- trees back into words ---------------------------------------------------------------------------


def encode_tree(nodes: Sequence[tuple[int, int, int, int, int, Sequence[int] | None]]) -> bytes:
    """(node, parent, tag, type, num, words) of one event's banks, parents first -> the event's bytes."""
    inner: dict[int, list[int]] = {}
    for node, *_ in nodes:
        inner[node] = []
    kinds = {n[0]: n[3] for n in nodes}
    for node, parent, tag, kind, num, words in reversed(nodes):
        body = inner[node] if kind in (*banks.BANKS, *banks.SEGMENTS, *banks.TAG_SEGMENTS) else list(words or ())
        above = kinds.get(parent)
        if above in banks.SEGMENTS:
            whole = [tag << 24 | kind << 16 | len(body), *body]
        elif above in banks.TAG_SEGMENTS:
            whole = [tag << 20 | kind << 16 | len(body), *body]
        else:
            whole = [len(body) + 1, tag << 16 | kind << 8 | num, *body]
        if parent < 0:
            return np.array(whole, ">u4").tobytes()
        inner[parent] = whole + inner[parent]
    return b""


def encode_trees(event: np.ndarray, node: np.ndarray, parent: np.ndarray, tag: np.ndarray, kind: np.ndarray, num: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Bank rows of many events (ascending, their nodes as well; `sizes` of the rows' words, which follow one another) as
    big-endian words and the place where each event begins; None if an event isn't one plain tree."""
    n = len(node)
    new = np.append(True, event[1:] != event[:-1]) if n else np.zeros(0, bool)
    containers, segments, tag_segments = ((*banks.BANKS, *banks.SEGMENTS, *banks.TAG_SEGMENTS), banks.SEGMENTS, banks.TAG_SEGMENTS)
    key = event << 32 | node
    if not n or node.min() < 0 or node.max() >= 1 << 32 or (key[1:] <= key[:-1]).any() or ((parent < 0) != new).any() or (parent >= node).any():
        return None
    up = np.minimum(np.searchsorted(key, event << 32 | np.maximum(parent, 0)), n - 1)
    inside = ~new
    holds = np.isin(kind, containers)
    if (key[up] != (event << 32 | parent))[inside].any() or not holds[up[inside]].all():
        return None
    above = np.where(inside, kind[up], 0)
    short, shorter = np.isin(above, segments), np.isin(above, tag_segments)
    head = np.where(short | shorter, 1, 2)
    depth, at = np.zeros(n, np.int64), np.where(inside, up, -1)
    while (at >= 0).any():
        depth += at >= 0
        at = np.where((at >= 0) & inside[at], up[at], -1)
    levels = [np.flatnonzero(depth == d) for d in range(depth.max() + 1)]
    body = np.where(holds, 0, sizes)
    for rows in levels[:0:-1]:
        np.add.at(body, up[rows], head[rows] + body[rows])
    whole = head + body
    before = np.zeros(n, np.int64)  # words of a bank's earlier siblings
    order = np.flatnonzero(inside)[np.argsort(up[inside], kind="stable")]
    if len(order):
        total = np.cumsum(whole[order]) - whole[order]
        fresh = np.append(True, up[order][1:] != up[order][:-1])
        before[order] = total - total[fresh][np.cumsum(fresh) - 1]
    start = np.zeros(n, np.int64)
    start[new] = np.cumsum(whole[new]) - whole[new]
    for rows in levels[1:]:
        start[rows] = start[up[rows]] + head[up[rows]] + before[rows]
    one = np.where(short, tag << 24 | kind << 16 | body, np.where(shorter, tag << 20 | kind << 16 | body, body + 1))
    two = tag << 16 | kind << 8 | num
    long = head == 2
    data = np.repeat(~holds, sizes)
    used = words[data]
    if any(len(v) and (v.min() < 0 or v.max() >= 1 << 32) for v in (one, two[long], used)):
        return None
    out = np.zeros(int(whole[new].sum()), np.int64)
    out[start] = one
    out[start[long] + 1] = two[long]
    first = np.cumsum(sizes) - sizes
    out[(np.repeat(start + head - first, sizes) + np.arange(len(words)))[data]] = used
    return out.astype(">u4"), start[new]


def encoded_events(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and payload, one row per event, from bank rows (keys, node, parent, tag, type, num, words).

    The trees of a batch are laid out together; a batch with a tree that is no plain one goes event by event."""
    numbers = ("node", "parent", "tag", "type", "num")
    tree = F.sort_array(F.collect_list(F.struct(*numbers, "words"))).alias("tree")
    trees = nodes.select(*keys, *[F.col(c).cast("bigint").alias(c) for c in numbers], "words")

    def payloads(tree: pa.ListArray) -> pa.Array:
        rows, n = tree.flatten(), tree.value_lengths().to_numpy()
        columns = [rows.field(c) for c in numbers]
        words = rows.field("words")
        got = None
        if not rows.null_count and not any(c.null_count for c in columns) and n.all():
            sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy().astype(np.int64)
            flat = words.flatten()
            if not flat.null_count:
                got = encode_trees(np.repeat(np.arange(len(n)), n), *[c.to_numpy() for c in columns], sizes, flat.to_numpy().astype(np.int64))
        if got is None or 4 * len(got[0]) >= 1 << 31:
            return pa.array([encode_tree([(b["node"], b["parent"], b["tag"], b["type"], b["num"], b["words"]) for b in t]) for t in tree.to_pylist()], pa.binary())
        place = np.append(4 * got[1], 4 * len(got[0])).astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(place), pa.py_buffer(got[0])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), payloads(b.column("tree"))], [*keys, "payload"])

    grouped = trees.groupBy(*keys).agg(tree)
    schema = StructType([grouped.schema[k] for k in keys]).add("payload", "binary")
    return grouped.mapInArrow(run, schema)


def write_events(events: DataFrame, path: str, file: str, event: str) -> None:
    """Write events(file, event, payload) as bank files named by the column `file`, in the order of `event`.

    A file is written by one task, as its events have to follow one another: a run is cut into files. These are
    dealt out over many partitions, so that few of them meet in one."""
    use_bank_files(events.sparkSession)
    rows = events.select(F.col(file).cast("string").alias("file"), F.col(event).cast("bigint").alias("event"), "payload")
    n = max(64, int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows.repartition(n, "file").sortWithinPartitions("file", "event").write.format("banks").option("path", path).mode("append").save()


def read_events(spark: SparkSession, path: str, index: str | None = None, columns: str | None = None) -> DataFrame:
    """Banks of a folder of bank files; `columns` as a schema, if not all are wanted."""
    use_bank_files(spark)
    r = spark.read.format("banks")
    r = r.schema(columns) if columns else r
    return (r.option("index", index) if index else r).load(path)
