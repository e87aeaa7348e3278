"""Column functions on bit masks and binary words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask_of(bits: list[int]) -> int:
    return reduce(lambda m, b: m | 1 << b, bits, 0)


def parse_bits(names: list[str | int], labels: dict[str, int]) -> tuple[int, list[str]]:
    """Mask of bit names, labels or numbers, and those that are unknown."""
    mask, unknown = 0, []
    for n in names:
        text = str(n).strip()
        if text in labels:
            mask |= 1 << labels[text]
        elif text.isdigit() and int(text) < 63:
            mask |= 1 << int(text)
        else:
            unknown.append(text)
    return mask, unknown


def bit_labels(mask: Column, labels: dict[str, int]) -> Column:
    """Names of the set bits, in bit order."""
    named = F.array(*[F.when(mask.bitwiseAND(1 << b) != 0, F.lit(n)) for n, b in sorted(labels.items(), key=lambda x: x[1])])
    return F.array_compact(named)


def passes_trigger(mask: Column, accept: int = 0, reject: int = 0) -> Column:
    """Any rejected bit fails; no accepted bits asked for means all pass."""
    ok = mask.bitwiseAND(reject) == 0
    return ok if accept == 0 else ok & (mask.bitwiseAND(accept) != 0)


def field(word: Column, high: int, low: int) -> Column:
    """Bits high..low of a word held in a bigint."""
    return F.shiftrightunsigned(word, low).bitwiseAND((1 << (high - low + 1)) - 1)


def sign_extend(value: Column, bits: int) -> Column:
    half = 1 << (bits - 1)
    return F.when(value >= half, value - (1 << bits)).otherwise(value)
