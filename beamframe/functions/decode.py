"""Column functions that take packed readout words (bigint, 32 bits) apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from beamframe.functions.bits import field, sign_extend


def tdc_word(word: Column) -> Column:
    """slot 31..27, edge 26, channel 25..19, value 18..0."""
    return F.struct(field(word, 31, 27).alias("slot"), field(word, 26, 26).alias("edge"), field(word, 25, 19).alias("channel"), field(word, 18, 0).alias("value"))


def adc_word(word: Column) -> Column:
    """slot 31..27, channel 22..17, value 13..0."""
    return F.struct(field(word, 31, 27).alias("slot"), field(word, 22, 17).alias("channel"), field(word, 13, 0).alias("value"))


def sparsify(value: Column, pedestal: Column, rms: Column, n: float) -> Column:
    """Pedestal-subtracted value, null where it is under n rms."""
    return F.when(value - pedestal >= n * rms, value - pedestal)


def sample_pair(word: Column) -> Column:
    """Two 13-bit samples of a raw-window word, the earlier in the high half."""
    return F.array(field(word, 28, 16), field(word, 12, 0))


def strip_words(words: Column) -> Column:
    """Three words of a strip to six signed 13-bit samples, the strip number and the chip's number."""
    w = lambda i: F.get(words, F.lit(i))
    half = lambda x, lo: sign_extend(field(x, lo + 12, lo), 13)
    strip = field(w(0), 30, 26).bitwiseOR(F.shiftleft(field(w(1), 30, 26), 5))
    return F.struct(F.array(*[half(w(i), lo) for i in range(3) for lo in (0, 13)]).alias("ts"), strip.alias("strip"), field(w(2), 30, 26).alias("chip"))


def timestamp_48(low: Column, high: Column) -> Column:
    return F.shiftleft(high.bitwiseAND(0xFFFF), 32).bitwiseOR(low.bitwiseAND(0xFFFFFFFF))


def ticks_to_seconds(ticks: Column, tick_ns: float = 4.0) -> Column:
    return ticks * (tick_ns * 1e-9)


def event_class(tag: Column, ranges: dict[str, tuple[int, int]]) -> Column:
    """The first class whose inclusive tag range holds the tag, else `other`."""
    out = F.lit("other")
    for name, (lo, hi) in reversed(list(ranges.items())):
        out = F.when(tag.between(lo, hi), name).otherwise(out)
    return out


def scaler_block(words: Column, ratio_channel: int) -> Column:
    """16 gated then 16 ungated counters: the arrays, and gated / ungated of a channel where they make sense."""
    gated, ungated = F.slice(words, 1, 16), F.slice(words, 17, 16)
    g, u = F.get(gated, F.lit(ratio_channel)), F.get(ungated, F.lit(ratio_channel))
    return F.struct(gated.alias("gated"), ungated.alias("ungated"), F.when((g > 0) & (u >= g), g / u).alias("live"))


def parse_readings(text: Column) -> Column:
    """Lines `<number> <name>` to an array of (name, value); other lines are skipped."""
    lines = F.transform(F.split(text, r"\n"), lambda s: F.trim(s))
    got = F.transform(lines, lambda s: F.struct(F.trim(F.regexp_extract(s, r"^\S+\s+(.+)$", 1)).alias("name"), F.regexp_extract(s, r"^(\S+)\s+.+$", 1).try_cast("double").alias("value")))
    return F.filter(got, lambda p: (p["name"] != "") & p["value"].isNotNull())
