"""Event files of nested banks: a scan that gives one row per bank.

Files are read by Spark's binary reader (any store, at most 2 GB a file; runs are written in segments
of less), and a file is decoded where it was read. A file is a row of banks of 32-bit big-endian words:

    bank        length of what follows, tag << 16 | type << 8 | number, payload
    segment     tag << 24 | type << 16 | length, payload
    tag segment tag << 20 | type << 16 | length, payload

Types 0x0e and 0x10 hold banks, 0x0d and 0x20 segments, 0x0c tag segments; others are data. A bank
whose length runs past its parent's end stops the scan of that parent; `broken` marks it."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

BANKS, SEGMENTS, TAG_SEGMENTS = (0x0E, 0x10), (0x0D, 0x20), (0x0C,)
NODES = "file string, event bigint, node int, parent int, depth int, tag int, type int, num int, words array<bigint>, broken boolean"


def scan(words: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int, int, int, int, bool]]:
    """(event, node, parent, depth, tag, type, num, begin, end, broken) of every bank, parents first."""
    at = event = 0
    while at < len(words):
        # (begin, end, parent, depth, kind of header) of regions still to be read
        regions = [(at, min(at + 1 + int(words[at]), len(words)), -1, 0, "bank")]
        node = 0
        while regions:
            p, end, parent, depth, kind = regions.pop()
            children = []
            while p < end:
                w = int(words[p])
                if kind == "bank":
                    if p + 1 >= end:
                        break
                    head = int(words[p + 1])
                    begin, stop, tag, typ, num = p + 2, p + 1 + w, head >> 16, head >> 8 & 0x3F, head & 0xFF
                elif kind == "segment":
                    begin, stop, tag, typ, num = p + 1, p + 1 + (w & 0xFFFF), w >> 24, w >> 16 & 0x3F, 0
                else:
                    begin, stop, tag, typ, num = p + 1, p + 1 + (w & 0xFFFF), w >> 20, w >> 16 & 0xF, 0
                broken = stop > end or stop < begin
                yield event, node, parent, depth, tag, typ, num, begin, min(max(stop, begin), end), broken
                inner = "bank" if typ in BANKS else "segment" if typ in SEGMENTS else "tagsegment" if typ in TAG_SEGMENTS else None
                if inner and not broken:
                    children.append((begin, stop, node, depth + 1, inner))
                node += 1
                if broken:
                    break
                p = stop
            regions += children[::-1]
        at += 1 + int(words[at])
        event += 1


def scan_events(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """What `scan` says of each of many events (words[start:end] of one array), as columns in the same order;
    event counts from 0, begin and end are places in `words`.

    Regions of a level are read together, a bank of each at a time. A region's banks are numbered in a row, then
    those inside its first container, and so on, so numbers follow from how many banks each region has in all."""
    words = words.astype(np.int64)
    starts, ends = (np.asarray(v, np.int64) for v in (starts, ends))
    filled = np.flatnonzero(ends > starts)
    event, at = filled, starts[filled]
    stop_at = np.minimum(at + 1 + words[at], ends[filled])
    up, kind = np.full(len(at), -1), np.zeros(len(at), np.int64)  # bank above (a row), kind of header (0 bank, 1 segment, 2 tag segment)
    levels, found, n_rows = [], [], 0  # per level: bank above and number of banks of each region
    while len(at):
        region, sizes = np.arange(len(at)), np.zeros(len(at), np.int64)
        parts = []
        while len(region):
            p, end, k = at[region], stop_at[region], kind[region]
            ok = np.where(k == 0, p + 1 < end, p < end)
            region, p, end, k = region[ok], p[ok], end[ok], k[ok]
            w = words[p]
            head = np.where(k == 0, words[np.minimum(p + 1, len(words) - 1)], w)
            begin, stop = p + 1 + (k == 0), p + 1 + np.where(k == 0, w, w & 0xFFFF)
            tag = np.where(k == 0, head >> 16, np.where(k == 1, head >> 24, head >> 20))
            typ = np.where(k == 0, head >> 8 & 0x3F, np.where(k == 1, head >> 16 & 0x3F, head >> 16 & 0xF))
            broken = (stop > end) | (stop < begin)
            parts.append((region, sizes[region], tag, typ, np.where(k == 0, head & 0xFF, 0), begin, np.minimum(np.maximum(stop, begin), end), broken))
            sizes[region] += 1
            at[region] = stop
            region = region[~broken]
        levels.append((up, sizes))
        if not parts:
            break
        region, place, tag, typ, num, begin, end, broken = (np.concatenate(c) for c in zip(*parts, strict=True))
        found.append((event[region], np.full(len(region), len(levels) - 1), up[region], region, place, tag, typ, num, begin, end, broken))
        inner = np.where(np.isin(typ, BANKS), 0, np.where(np.isin(typ, SEGMENTS), 1, np.where(np.isin(typ, TAG_SEGMENTS), 2, -1)))
        inside = np.flatnonzero((inner >= 0) & ~broken)
        inside = inside[np.lexsort((place[inside], region[inside]))]
        event, at, stop_at, up, kind = event[region[inside]], begin[inside], end[inside], n_rows + inside, inner[inside]
        n_rows += len(region)
    if not found:
        return {n: np.zeros(0, bool if n == "broken" else np.int64) for n in ("event", "node", "parent", "depth", "tag", "type", "num", "begin", "end", "broken")}
    event, depth, up, region, place, tag, typ, num, begin, end, broken = (np.concatenate(c) for c in zip(*found, strict=True))
    whole = [sizes.copy() for _, sizes in levels]  # banks of a region and all inside it
    for k in range(len(levels) - 1, 0, -1):
        np.add.at(whole[k - 1], region[levels[k][0]], whole[k])
    first = [np.zeros(len(levels[0][1]), np.int64)]  # the number of a region's first bank in its event
    for k in range(1, len(levels)):
        above = region[levels[k][0]]  # ascending, containers of a region in order
        before = np.cumsum(whole[k]) - whole[k]
        new = np.append(True, above[1:] != above[:-1]) if len(above) else np.zeros(0, bool)
        group = before[new][np.cumsum(new) - 1]
        first.append(first[k - 1][above] + levels[k - 1][1][above] + before - group)
    node = np.concatenate([f[region[depth == k]] for k, f in enumerate(first)]) + place
    order = np.lexsort((node, event))
    parent = np.where(up >= 0, node[up], -1)
    out = {"event": event, "node": node, "parent": parent, "depth": depth, "tag": tag, "type": typ, "num": num, "begin": begin, "end": end, "broken": broken}
    return {n: c[order] for n, c in out.items()}


def read_banks(spark: SparkSession, path: str, tags: list[int] | None = None, pattern: str = "*") -> DataFrame:
    """One row per bank: place in the tree, and the words of data banks (null for containers)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.col("path").alias("file"), "content")
    wanted = None if tags is None else set(tags)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["file"], pdf["content"], strict=True):
                words = np.frombuffer(content[: len(content) // 4 * 4], ">u4")
                rows = []
                for event, node, parent, depth, tag, typ, num, begin, end, broken in scan(words):
                    if wanted is None or tag in wanted:
                        data = None if typ in (*BANKS, *SEGMENTS, *TAG_SEGMENTS) else words[begin:end].astype(np.int64)
                        rows.append((file, event, node, parent, depth, tag, typ, num, data, broken))
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=[c.split()[0] for c in NODES.split(", ")])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in NODES.split(", ")])

    return files.mapInPandas(run, NODES)


def tag_paths(nodes: DataFrame) -> DataFrame:
    """How often each path of tags occurs, and how often for each parent; trees of any depth."""
    level = nodes.where("parent = -1").select("file", "event", "node", F.hex("tag").alias("path"))
    every = level
    depth = nodes.agg(F.max("depth").alias("d")).first().d or 0
    for d in range(1, depth + 1):
        inner = nodes.where(F.col("depth") == d).select("file", "event", F.col("parent").alias("up"), "node", "tag")
        up = level.select("file", "event", F.col("node").alias("up"), "path")
        level = inner.join(up, ["file", "event", "up"]).select("file", "event", "node", F.concat_ws("/", "path", F.hex("tag")).alias("path"))
        every = every.unionByName(level)
    n = every.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    parents = n.select(F.col("path").alias("parent"), F.col("n").alias("n_parent"))
    return n.withColumn("parent", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).join(parents, "parent", "left").select("path", "n", (F.col("n") / F.col("n_parent")).alias("per_parent"))


def bank_summary(nodes: DataFrame) -> DataFrame:
    """Banks, events and words of each tag and type."""
    return nodes.groupBy("tag", "type").agg(F.count(F.lit(1)).alias("n_banks"), F.countDistinct("file", "event").alias("n_events"), F.sum(F.coalesce(F.size("words"), F.lit(0))).alias("n_words"))


COMPOSITE = "slot int, trigger int, timestamp bigint, channel int, samples array<int>"
_SLOT, _CHANNEL = struct.Struct("<BiqI"), struct.Struct("<BI")


def encode_composite(slots: list[tuple[int, int, int, list[tuple[int, list[int]]]]]) -> bytes:
    """(slot, trigger, timestamp, [(channel, samples)]) as a composite payload: packed little-endian, a slot's
    head of 17 bytes, then for each channel its number, how many samples, and these as 16-bit words."""
    out = []
    for slot, trigger, timestamp, channels in slots:
        out.append(_SLOT.pack(slot, trigger, timestamp, len(channels)))
        out += [_CHANNEL.pack(c, len(x)) + np.asarray(x, "<u2").tobytes() for c, x in channels]
    return b"".join(out)


def composite_rows(payload: bytes, slots: int = 32, channels: int = 64, samples: int = 200) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(slot, trigger, timestamp, channel, samples). A slot or channel number or a length that the hardware
    can't have ends the payload; samples that run past its end are cut."""
    at = 0
    while at + _SLOT.size <= len(payload):
        slot, trigger, timestamp, n = _SLOT.unpack_from(payload, at)
        at += _SLOT.size
        if slot >= slots or n > channels:
            return
        for _ in range(n):
            if at + _CHANNEL.size > len(payload):
                break
            channel, length = _CHANNEL.unpack_from(payload, at)
            at += _CHANNEL.size
            if channel >= channels or length > samples:
                return
            x = np.frombuffer(payload, "<u2", min(length, (len(payload) - at) // 2), at)
            at += 2 * len(x)
            yield slot, trigger, timestamp, channel, x


def decode_composite(df: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """A row per channel of every composite payload: keys, slot, trigger, timestamp, channel, samples."""
    schema = StructType([df.schema[k] for k in keys])
    for part in COMPOSITE.split(", "):
        name, kind = part.split()
        schema = schema.add(name, {"int": "integer", "bigint": "long"}.get(kind) or ArrayType(IntegerType()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*k, *r[:4], r[4].astype(np.int32)) for *k, body in pdf[[*keys, payload]].itertuples(index=False) for r in composite_rows(bytes(body) if body is not None else b"")]
            yield pd.DataFrame(rows, columns=schema.names)

    return df.select(*keys, payload).mapInPandas(run, schema)
