"""Decoders of tagged word streams and of bank trees, as DataFrame operations.

A tagged stream is a row of 32-bit words. Words with the top bit set define what follows: their type
stands in the next bits. Words without it continue the last defined type. Seen as a table of words, the
state of such a decoder is what the last defining word said, a window over the words of one readout.
Readouts are small and independent; they spread over tasks by their keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beamframe.functions.bits import field
from beamframe.functions.decode import strip_words, timestamp_48
from beamframe.operators.ordered import forward_fill

STRIPS = 128  # of a front-end chip; words that name others are void
FRAME, COMMON_MODE = 5, 13  # types of strip readout words
BLOCK_HEAD, BLOCK_END, EVENT_HEAD, TRIGGER_TIME, PEAK, CLUSTER = range(6)  # types of trigger-processor words


def tagged_words(df: DataFrame, keys: Sequence[str], words: str) -> DataFrame:
    """keys, pos, word, defines, type (of the last defining word), head (its position), k (words since)."""
    w = Window.partitionBy(*keys).orderBy("pos")
    x = df.select(*keys, F.posexplode(words).alias("pos", "word")).withColumn("defines", field(F.col("word"), 31, 31) == 1)
    last = lambda c: F.last(F.when(F.col("defines"), c), ignorenulls=True).over(w)
    x = x.withColumn("type", last(field(F.col("word"), 30, 27))).withColumn("head", last(F.col("pos")))
    return x.withColumn("k", F.col("pos") - F.col("head"))


def _strip_stream(df: DataFrame, keys: Sequence[str], words: str) -> DataFrame:
    """Tagged words with the frame they are in and, for data words, the strip record and its part.

    Three data words make a strip. Words after the third one of a common-mode record are strip data again."""
    w = Window.partitionBy(*keys).orderBy("pos")
    x = tagged_words(df, keys, words)
    frame = F.when(F.col("defines") & (F.col("type") == FRAME), F.struct(field(F.col("word"), 21, 16).alias("fiber"), field(F.col("word"), 26, 22).alias("flags")))
    i = F.when((F.col("type") == FRAME) & ~F.col("defines"), F.col("k") - 1).when((F.col("type") == COMMON_MODE) & (F.col("k") >= 3), F.col("k") - 3)
    x = x.withColumn("frame", F.last(frame, ignorenulls=True).over(w)).withColumn("i", i)
    return x.withColumn("record", F.floor(F.col("i") / 3)).withColumn("part", F.col("i") % 3)


def strip_readout(df: DataFrame, keys: Sequence[str], words: str) -> DataFrame:
    """keys, fiber, chip, strip, flags, ts: six signed samples of every strip; where a strip comes twice the
    later record stays. Records outside a frame, cut-off ones and strips that no chip has are void."""
    x = _strip_stream(df, keys, words).where("frame IS NOT NULL AND record IS NOT NULL")
    part = lambda n: F.max(F.when(F.col("part") == n, F.col("word"))).alias(f"w{n}")
    r = x.groupBy(*keys, "head", "record").agg(part(0), part(1), part(2), F.max("frame").alias("frame"), F.max("pos").alias("pos")).where("w2 IS NOT NULL")
    r = r.withColumn("s", strip_words(F.array("w0", "w1", "w2"))).where(F.col("s.strip") < STRIPS)
    ids = [*keys, "fiber", "chip", "strip"]
    r = r.select(*keys, "frame.fiber", F.col("s.chip").alias("chip"), F.col("s.strip").alias("strip"), "pos", "frame.flags", "s.ts")
    return r.groupBy(*ids).agg(F.max(F.struct("pos", "flags", "ts")).alias("m")).select(*ids, "m.flags", "m.ts")


def online_common_modes(df: DataFrame, keys: Sequence[str], words: str) -> DataFrame:
    """keys, fiber, chip, cm: the six common modes that the readout computed for the chip just read."""
    w = Window.partitionBy(*keys).orderBy("pos")
    x = _strip_stream(df, keys, words)
    x = x.withColumn("chip", F.last(F.when(F.col("part") == 2, field(F.col("word"), 30, 26)), ignorenulls=True).over(w))
    x = x.where((F.col("type") == COMMON_MODE) & (F.col("k") < 3) & F.col("frame").isNotNull() & F.col("chip").isNotNull())
    pair = lambda n: [F.max(F.when(F.col("k") == n, field(F.col("word"), lo + 12, lo))) for lo in (0, 13)]
    r = x.groupBy(*keys, "head").agg(F.max("frame.fiber").alias("fiber"), F.max("chip").alias("chip"), F.array(*pair(0), *pair(1), *pair(2)).alias("cm"))
    return r.select(*keys, "fiber", "chip", "cm")


def trigger_records(df: DataFrame, keys: Sequence[str], words: str) -> dict[str, DataFrame]:
    """Tables `blocks`, `peaks` and `clusters` of a trigger processor's words.

    A block runs from its header to the next one; it has the event number, the 48-bit trigger time and,
    if a trailer came, its word count and whether the trailer names another slot. Peaks and clusters are
    records of two words; one whose second word is missing is void."""
    w = Window.partitionBy(*keys).orderBy("pos")
    x = tagged_words(df, keys, words)
    is_head = F.col("defines") & (F.col("type") == BLOCK_HEAD)
    x = x.withColumn("block", F.last(F.when(is_head, F.col("pos")), ignorenulls=True).over(w))
    word = F.col("word")
    at = lambda kind, k, value: F.max(F.when((F.col("type") == kind) & (F.col("k") == k), value))
    latest = lambda kind, k, value: F.max_by(value, F.when((F.col("type") == kind) & (F.col("k") == k), F.col("pos")))
    slot = field(word, 26, 22)
    blocks = (
        x.where("block IS NOT NULL").groupBy(*keys, "block")
        .agg(
            at(BLOCK_HEAD, 0, slot).alias("slot"), at(BLOCK_HEAD, 0, field(word, 21, 18)).alias("module"), at(BLOCK_HEAD, 0, field(word, 17, 8)).alias("number"), at(BLOCK_HEAD, 0, field(word, 7, 0)).alias("level"),
            latest(EVENT_HEAD, 0, field(word, 26, 0)).alias("event_number"), latest(TRIGGER_TIME, 0, field(word, 23, 0)).alias("low"), latest(TRIGGER_TIME, 1, field(word, 23, 0)).alias("high"),
            latest(BLOCK_END, 0, field(word, 21, 0)).alias("n_words"), latest(BLOCK_END, 0, slot).alias("end_slot"),
        )
    )
    time = F.coalesce(F.shiftleft(F.coalesce("high", F.lit(0)), 24).bitwiseOR(F.col("low")), F.lit(0))
    blocks = blocks.select(*keys, "slot", "module", "number", "level", F.coalesce("event_number", F.lit(0)).alias("event_number"), time.alias("trigger_time"), "n_words", (F.col("end_slot") != F.col("slot")).alias("wrong_end"))

    def pairs(kind: int) -> DataFrame:
        part = lambda k: F.max(F.when(F.col("k") == k, word)).alias(f"w{k}")
        return x.where((F.col("type") == kind) & (F.col("k") <= 1)).groupBy(*keys, "head").agg(part(0), part(1)).where("w1 IS NOT NULL")

    bits = lambda c, hi, lo, name: field(F.col(c), hi, lo).alias(name)
    peaks = pairs(PEAK).select(*keys, "head", bits("w0", 26, 26, "side"), bits("w0", 25, 24, "view"), bits("w0", 23, 16, "time"), bits("w1", 25, 16, "coordinate"), bits("w1", 15, 0, "energy"))
    clusters = pairs(CLUSTER).select(*keys, "head", bits("w0", 26, 26, "side"), bits("w0", 23, 16, "time"), bits("w0", 15, 0, "energy"), bits("w1", 29, 20, "w"), bits("w1", 19, 10, "v"), bits("w1", 9, 0, "u"))
    return {"blocks": blocks, "peaks": peaks, "clusters": clusters}


#: Tags of banks, fixed by the readout
TRIGGER_BANK, TRIGGER_INTERFACE, RUN_INFO, MASTER_CRATE = 0xC000, 0xE10A, 0xE10F, 0x27
WORDS = 0x1  # the type of banks of 32-bit words


def event_info(nodes: DataFrame, physics_base: int = 0x80) -> DataFrame:
    """Banks (`sources.banks.read_banks`) to file, event, tag, trigger_type, event_number, trigger_number,
    timestamp, trigger_bits, run, unix_time; null where an event has no such bank.

    The first trigger-interface bank gives trigger number and time; the first with a word of front-panel
    bits, which only the master's has, gives these. Run info is looked for in the master crate only."""
    node = F.col("node")
    word = lambda i: F.get("words", F.lit(i))
    ti = (F.col("tag") == TRIGGER_INTERFACE) & (F.col("type") == WORDS)
    first = lambda value, ok: F.min_by(value, F.when(ok, node))
    masters = F.collect_list(F.when((F.col("tag") == MASTER_CRATE) & (F.col("depth") == 1), node))
    run_infos = F.collect_list(F.when((F.col("tag") == RUN_INFO) & (F.col("type") == WORDS), F.struct("node", "parent", word(1).alias("run"), word(3).alias("unix_time"))))
    tag = F.max(F.when(F.col("depth") == 0, F.col("tag")))
    g = nodes.groupBy("file", "event").agg(
        tag.alias("tag"), first(word(0), F.col("tag") == TRIGGER_BANK).alias("event_number"),
        first(F.struct(word(1).alias("number"), word(2).alias("low"), word(3).alias("high")), ti).alias("ti"),
        first(word(5), ti & (F.coalesce(word(5), F.lit(0)) != 0)).alias("trigger_bits"), masters.alias("masters"), run_infos.alias("run_infos"),
    )
    g = g.withColumn("r", F.array_min(F.filter("run_infos", lambda b: F.array_contains("masters", b["parent"]))))  # nodes differ
    return g.select("file", "event", "tag", F.when(F.col("tag") >= physics_base, F.col("tag") - physics_base).alias("trigger_type"), "event_number", F.col("ti.number").alias("trigger_number"), timestamp_48(F.col("ti.low"), F.col("ti.high")).alias("timestamp"), "trigger_bits", "r.run", "r.unix_time")


#: fixed values: the bank of sync events, the tags of prestart, go and end (two generations each), and where
#: their words stand
SYNC_HEAD = 0xE112
CONTROL_TAGS = (0x11, 0x12, 0x14, 0xFFD1, 0xFFD2, 0xFFD4)
HEAD_PLACES = {"run": 1, "counter": 2, "unix_time": 3, "event_tag": 4}
CONTROL_PLACES = {"unix_time": 0, "run": 1, "run_type": 2}


def sync_snapshots(nodes: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Banks to file, event, run, counter, unix_time, event_tag, run_type: what sync and control events had said
    up to each event of a file.

    A sync bank anywhere in the event tells run, counter, time and tag (an empty tag is the event's own) and
    leaves the run type; else the first bank of words right under a control event tells time, run and
    type and leaves the counter. Words that a bank is too short for are 0. Other events leave all as it is;
    null before the first."""
    word = lambda i: F.coalesce(F.get("words", F.lit(i)), F.lit(0)).cast("bigint")
    data = (F.col("type") == WORDS) & (F.size("words") > 0)
    first = lambda places, ok: F.min_by(F.struct(*[word(i).alias(n) for n, i in places.items()]), F.when(ok, F.col("node")))
    top = F.max(F.when(F.col("depth") == 0, F.col("tag"))).cast("bigint")
    g = nodes.groupBy("file", "event").agg(top.alias("tag"), first(HEAD_PLACES, data & (F.col("tag") == SYNC_HEAD)).alias("head"), first(CONTROL_PLACES, data & (F.col("depth") == 1)).alias("control"))
    head, control = F.col("head").isNotNull(), F.col("tag").isin(*CONTROL_TAGS) & F.col("control").isNotNull()
    either = lambda of_head, of_control: F.when(head, of_head).when(control, of_control)
    told = g.select(
        "file", "event",
        either(F.col("head.run"), F.col("control.run")).alias("run"), F.when(head, F.col("head.counter")).alias("counter"),
        either(F.col("head.unix_time"), F.col("control.unix_time")).alias("unix_time"),
        either(F.when(F.col("head.event_tag") != 0, F.col("head.event_tag")).otherwise(F.col("tag")), F.col("tag")).alias("event_tag"),
        F.when(~head & control, F.col("control.run_type").bitwiseAND(0xFF)).alias("run_type"),
    )
    return forward_fill(told, ["event"], ["run", "counter", "unix_time", "event_tag", "run_type"], ["file"], block)


def event_index(info: DataFrame, skip: Column, block: int = 1 << 16) -> DataFrame:
    """file, number, event: events that are not skipped, numbered from 1 in every file. Blocks of events
    are numbered on their own and shifted by those before, so a long file isn't one task."""
    x = info.where(~F.coalesce(skip, F.lit(False))).select("file", "event", F.floor(F.col("event") / block).alias("_block"))
    sizes = x.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("file", "_block").orderBy("event"))
    return x.withColumn("_own", own).join(sizes.select("file", "_block", before.alias("_before")), ["file", "_block"]).select("file", (F.col("_own") + F.col("_before")).alias("number"), "event")


def map_strip(channel: Column, plane_index: Column, flip: Column, rotate: int = 0, shared: int | None = None, hybrid: bool = True, channels: int = 128, centre: int = 32) -> Column:
    """Strip of a plane that a chip's channel reads: the chip's wiring, the board's pins, the fan-out around
    the connector's centre, the chip's range, its direction, its place on the plane."""
    c = channel.cast("bigint")
    wired = 32 * (c % 4) + 8 * F.floor(c / 4) - 31 * F.floor(c / 16)
    pinned = wired + 1 + wired % 4 - 5 * (F.floor(wired / 4) % 2) if hybrid else wired
    middle = centre + rotate
    fanned = F.when(pinned % 2 == 1, middle - F.floor((pinned + 1) / 2)).otherwise(middle + F.floor(pinned / 2)) if middle > 0 else pinned
    own = fanned.bitwiseAND(channels - 1)
    turned = F.when(flip, channels - 1 - own).otherwise(own)
    place = plane_index if shared is None else F.lit(shared)
    return turned + place * channels - rotate


def strip_hits(samples: Column, noise: Column, zero_sigma: float = 5.0, cross_sigma: float = 8.0) -> Column:
    """Largest sample, its time bin and the sum of a strip's samples; `cross_talk` marks hits that pass the
    zero suppression but are too small to be sure of."""
    top = F.array_max(samples)
    small = (top < noise * cross_sigma) & (top > noise * zero_sigma)
    return F.struct(top.alias("charge"), (F.array_position(samples, top) - 1).alias("time_bin"), F.aggregate(samples, F.lit(0.0), lambda a, v: a + v).alias("total"), small.alias("cross_talk"))


def mark_cross_talk(clusters: DataFrame, keys: Sequence[str], distances: Sequence[float], width: float) -> DataFrame:
    """Clusters (centre, peak, pure: of cross-talk hits only) with `cross_talk`: pure ones that lie one of the
    characteristic distances, give or take `width`, from a cluster of a larger peak in the same plane."""
    other = clusters.select(*keys, F.col("centre").alias("_c"), F.col("peak").alias("_p"))
    pure = clusters.where("pure").select(*keys, "centre", "peak")
    apart = F.abs(F.col("centre") - F.col("_c"))
    near = [(apart > d - width) & (apart < d + width) for d in distances]
    any_near = F.lit(False)
    for n in near:
        any_near = any_near | n
    marked = pure.join(other, list(keys)).where((F.col("_p") > F.col("peak")) & any_near).select(*keys, "centre", "peak").distinct().withColumn("cross_talk", F.lit(True))
    return clusters.join(marked, [*keys, "centre", "peak"], "left").withColumn("cross_talk", F.coalesce("cross_talk", F.lit(False)))
