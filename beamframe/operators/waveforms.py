"""Waveform analysis that is sequential in the samples: pedestals, pulses, firmware emulation.

Each waveform is analysed alone, in Arrow batches of rows; nothing is shuffled here, so a table of few splits is
best dealt out before."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

# quality bits of firmware pulses
PEAK_AT_EDGE, BEFORE_CUT, AFTER_CUT, NO_MIDPOINT = 1, 2, 4, 8
# quality bits of pedestals
NOT_CONVERGED, FLOOR_ACTIVE, TOO_FEW, PULSE_INSIDE, SATURATED, TRAILING = 1, 2, 4, 8, 16, 32
# quality bits of pulses
PILED, DECONVOLVED = 1, 2
# states of a deconvolution
NOT_RUN, NO_TEMPLATE, BAD_TEMPLATE, FIT_FAILED, APPLIED = range(5)
# values that are closer than this are equal: sums in another order differ by less
EDGE = 1e-9


@dataclass(frozen=True)
class FirmwareConfig:
    """Times are in ns; a sample takes `clock`."""

    threshold: float = 50.0
    before: float = 16.0
    after: float = 40.0
    max_pulses: int = 4
    over: int = 1  # samples in a row over the threshold
    n_pedestal: int = 4
    max_pedestal: float = 0.0  # pedestal samples over it don't count, 0: all count
    clock: float = 4.0


@dataclass(frozen=True)
class PulseConfig:
    order: int = 2  # of the triangular smoothing
    n_sigma: float = 5.0
    min_height: float = 10.0
    n_pedestal: int = 30
    flat: float = 1.0  # least clipping width
    iterations: int = 3
    tail: float = 0.1  # of the height, where integration ends
    tail_samples: int = 2  # in a row under it
    gap: int = 2  # samples between windows that pile up
    max_peaks: int = 8
    min_ratio: float = 0.3  # of an earlier peak's height, for a peak that overlaps it
    saturation: float = 4095.0  # raw samples from there on are cut off by the hardware
    clock: float = 4.0


def firmware_pulses(raw: np.ndarray, pedestal: float, cfg: FirmwareConfig = FirmwareConfig()) -> list[dict]:
    """Pulses as the digitiser's firmware reports them: half-height time in 1/64 samples, window sums."""
    s = np.maximum(np.asarray(raw, float) - pedestal, 0.0)
    n, first = len(s), max(1, cfg.n_pedestal)
    if n < first + 1:
        return []
    lead = s[:first]
    kept = lead[lead <= cfg.max_pedestal] if cfg.max_pedestal > 0 else lead
    noise = float((kept if len(kept) else lead).mean())
    quiet = np.append(np.flatnonzero(s <= noise), n)  # where a pulse may end
    until = lambda i: int(quiet[np.searchsorted(quiet, i)])
    falls = np.append(np.flatnonzero(np.diff(s) < 0), n - 1)  # last samples before a decrease
    over = s > cfg.threshold
    before, after = int(cfg.before / cfg.clock), int(cfg.after / cfg.clock)
    out: list[dict] = []
    i = first
    while i < n - 1 and len(out) < cfg.max_pulses:
        if s[i] <= noise:
            i += 1
            continue
        start, top = i, int(falls[np.searchsorted(falls, i)])
        i = until(top + 1)
        if not over[top]:
            continue
        cross = start + int(over[start : top + 1].argmax())
        if cross + cfg.over > n and cfg.over > 1 or not over[cross : cross + cfg.over].all():
            continue
        quality = 0
        middle = noise + (s[top] - noise) / 2
        k = start + int((s[start : top + 1] >= middle).argmax())
        if k == start:
            quality |= NO_MIDPOINT
        low = s[k - 1]
        steps = 64 * (k - 1) + (int(np.floor((middle - low) / (s[k] - low) * 64 + 0.5)) if s[k] > low else 0)
        lo, hi = cross - before, cross + after
        quality |= (BEFORE_CUT if lo < 0 else 0) | (AFTER_CUT if hi >= n else 0) | (PEAK_AT_EDGE if top >= n - 1 else 0)
        lo, hi = max(lo, 0), min(hi, n - 1)
        out.append({"vpeak": float(s[top]), "va": middle, "coarse": steps // 64, "fine": steps % 64, "time": steps * cfg.clock / 64, "cross": cross, "pos": top, "integral": float(s[lo : hi + 1].sum()), "lo": lo, "hi": hi, "quality": quality})
    return out


@dataclass(frozen=True)
class Pedestal:
    mean: float
    rms: float
    used: int
    slope: float  # per sample, of the samples used
    quality: int


NO_PEDESTAL = Pedestal(float("nan"), float("nan"), 0, 0.0, 0)


def robust_pedestal(window: np.ndarray, cfg: PulseConfig = PulseConfig()) -> Pedestal:
    """Mean and rms after clipping: the median and the median deviation tell which samples are near, and
    each round keeps, of those left, the ones within the rms (or `flat`) of the mean; those just as far go."""
    x = np.asarray(window, float)
    at = np.arange(len(x))
    mean = float(np.median(x))
    rms = 1.4826 * float(np.median(np.abs(x - mean)))
    quality = NOT_CONVERGED
    for _ in range(cfg.iterations):
        near = np.abs(x - mean) < max(rms, cfg.flat) - EDGE
        if near.all():
            quality = 0
            break
        x, at = x[near], at[near]
        if len(x) < 5:
            quality = TOO_FEW
            break
        mean, rms = float(x.mean()), float(x.std())
    if rms < cfg.flat - EDGE:
        quality |= FLOOR_ACTIVE
    d = at - at.mean() if len(at) else at
    slope = float((d * x).sum() / (d * d).sum()) if len(x) > 1 else 0.0
    return Pedestal(mean, rms, len(x), slope, quality)


def choose_pedestal(raw: np.ndarray, smoothed: np.ndarray, cfg: PulseConfig = PulseConfig()) -> tuple[Pedestal, int, int]:
    """The pedestal, and the window it comes from: the leading one, unless that looks bad and the trailing
    one, which must not overlap it, is quieter."""
    n, k = len(raw), min(cfg.n_pedestal, len(raw))

    def of(a: int, flag: int) -> Pedestal:
        p = robust_pedestal(smoothed[a : a + k], cfg)
        cut = SATURATED if (raw[a : a + k] >= cfg.saturation).any() else 0
        return replace(p, quality=p.quality | cut | flag)

    head = of(0, 0)
    bad = head.quality & (NOT_CONVERGED | TOO_FEW | SATURATED) or 2 * head.used < k
    if bad and n >= 2 * k:
        tail = of(n - k, TRAILING)
        if tail.rms < head.rms - EDGE or tail.rms <= head.rms + EDGE and tail.used > head.used:
            return tail, n - k, n
    return head, 0, k


def smooth(x: np.ndarray, order: int) -> np.ndarray:
    """Triangular weights; a pair of neighbours counts where both exist."""
    num, den = x.astype(float), np.ones(len(x))
    for j in range(1, order + 1):
        w = 1 - j / (order + 1)
        num[j:-j] += w * (x[: -2 * j] + x[2 * j :])
        den[j:-j] += 2 * w
    return num / den


def peaks(y: np.ndarray, z: np.ndarray, rms: float, least: float, cfg: PulseConfig) -> list[tuple[int, int, int, int]]:
    """Accepted maxima of the smoothed samples y, how far the raw maximum in z may lie from each, and the
    range from its rise to its fall.

    A maximum, or the middle of a plateau, counts if it is `least` over the pedestal and over the line
    between the ends of its range, and, where its range meets an earlier one's, `min_ratio` of that
    peak's height over the line. Only accepted maxima count towards `max_peaks`."""
    n = len(y)
    tolerance = max(0.1, 0.5 * rms)
    d = np.diff(y)
    turn = np.where(np.abs(d) < tolerance - EDGE, 0, np.sign(d)).astype(int).tolist()  # from each sample to the next
    out: list[tuple[int, int, int, int]] = []
    ranges: list[tuple[int, int, float]] = []
    i = 0
    while i < n - 2 and len(out) < cfg.max_peaks:
        i += 1
        up, down = turn[i - 1], -turn[i]
        if up * down < 0 or up == down == 0:
            continue
        flat = i
        if down == 0:
            while flat < n - 1 and turn[flat] == 0:
                flat += 1
            if flat >= n - 1 or turn[flat] > 0:
                continue
        if up < 0 or down < 0:
            continue
        top, left, right = (i + flat) // 2, i, flat
        while left > 0 and turn[left - 1] > 0:
            left -= 1
        while right < n - 1 and turn[right] <= 0:
            right += 1
        if right <= left:
            continue
        over = y[top] - (y[left] * (right - top) + y[right] * (top - left)) / (right - left)
        reach = max(1, cfg.order) + (flat - i) // 2
        small = any(left <= r and right >= l and over < cfg.min_ratio * h - EDGE for l, r, h in ranges)
        if min(over, y[top]) >= least - EDGE and not small:
            out.append((top, reach, left, right))
            ranges.append((left, right, float(z[max(top - reach, 0) : top + reach + 1].max())))
        i = right
    return out


def tail_cut(y: np.ndarray, top: int, left: int, right: int, rms: float, cfg: PulseConfig) -> tuple[int, int]:
    """Outermost samples of a pulse: walking out from its top to the ends of its range, samples under the
    tail cut or the noise count only if the pulse comes back before `tail_samples` of them in a row."""
    weak = (y < cfg.tail * y[top] - EDGE) | (y < rms - EDGE) | (y * y[top] < 0)
    ends = []
    for path in (range(top - 1, left - 1, -1), range(top + 1, right + 1)):
        end, low = top, 0
        for j in path:
            low = low + 1 if weak[j] else 0
            if low >= max(1, cfg.tail_samples):
                break
            if not low:
                end = j
        ends.append(end)
    return ends[0], ends[1]


def find_pulses(samples: np.ndarray, cfg: PulseConfig = PulseConfig()) -> tuple[Pedestal, list[dict]]:
    """Pedestal, and pulses over it: height, vertex time, tail-cut integral of the smoothed samples, whether
    the top is saturated, and quality bits. Windows that come within `gap` of one another pile up."""
    x = np.asarray(samples, float)
    n = len(x)
    if n < 2 * cfg.order + 1 or not n:
        return NO_PEDESTAL, []
    smoothed = smooth(x, cfg.order)
    ped, begin, end = choose_pedestal(x, smoothed, cfg)
    y, z = smoothed - ped.mean, x - ped.mean
    least = max(cfg.n_sigma * ped.rms, cfg.min_height)
    out: list[dict] = []
    for top, reach, left, right in peaks(y, z, ped.rms, least, cfg):
        # the raw sample under the smoothed one: the largest, the nearest of equal ones
        near = np.arange(max(top - reach, 0), min(top + reach, n - 1) + 1)
        i = int(near[np.lexsort((near, np.abs(near - top), -z[near]))[0]])
        shift = 0.0
        if 0 < i < n - 1 and (bend := x[i - 1] - 2 * x[i] + x[i + 1]) < -1e-3:
            shift = float(np.clip(0.5 * (x[i - 1] - x[i + 1]) / bend, -1, 1))
        lo, hi = tail_cut(y, top, left, right, ped.rms, cfg)
        p = {"pos": i, "time": (i + shift) * cfg.clock, "height": float(z[i]), "integral": float(y[lo : hi + 1].sum()), "lo": lo, "hi": hi, "saturated": int(x[i] >= cfg.saturation), "quality": 0}
        for q in out:
            if lo <= q["hi"] + max(1, cfg.gap) and hi >= q["lo"] - max(1, cfg.gap):
                p["quality"] |= PILED
                q["quality"] |= PILED
        out.append(p)
    if any(begin <= p["pos"] < end for p in out):
        ped = replace(ped, quality=ped.quality | PULSE_INSIDE)
    return ped, out


def _pulse_type(ints: tuple[str, ...], doubles: tuple[str, ...]) -> ArrayType:
    return ArrayType(StructType([*(StructField(c, IntegerType()) for c in ints), *(StructField(c, DoubleType()) for c in doubles)]))


FIRMWARE_PULSES = _pulse_type(("coarse", "fine", "cross", "pos", "lo", "hi", "quality"), ("vpeak", "va", "time", "integral"))
PULSES = _pulse_type(("pos", "lo", "hi", "saturated", "quality"), ("time", "height", "integral"))


def with_pulses(df: DataFrame, samples: str, cfg: PulseConfig = PulseConfig()) -> DataFrame:
    """Add ped_mean, ped_rms, ped_used, ped_slope, ped_quality and pulses; null or short waveforms have none."""
    fields = [("mean", DoubleType()), ("rms", DoubleType()), ("used", IntegerType()), ("slope", DoubleType()), ("quality", IntegerType())]
    schema = StructType([*df.schema.fields, *(StructField(f"ped_{n}", t) for n, t in fields), StructField("pulses", PULSES)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [find_pulses(x if x is not None else [], cfg) for x in pdf[samples]]
            yield pdf.assign(**{f"ped_{n}": [getattr(p, n) for p, _ in got] for n, _ in fields}, pulses=[q for _, q in got])

    return df.mapInPandas(run, schema)


def with_pedestals(df: DataFrame, samples: str, cfg: PulseConfig = PulseConfig()) -> DataFrame:
    """Add ped_mean, ped_rms, ped_used, ped_slope, ped_quality and the window (ped_from, ped_to) that was chosen."""
    schema = StructType([*df.schema.fields, *(StructField(f"ped_{n}", t) for n, t in (("mean", DoubleType()), ("rms", DoubleType()), ("used", IntegerType()), ("slope", DoubleType()), ("quality", IntegerType()), ("from", IntegerType()), ("to", IntegerType())))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for x in pdf[samples]:
                x = np.asarray(x if x is not None else [], float)
                ped, a, b = choose_pedestal(x, smooth(x, cfg.order), cfg) if len(x) > 2 * cfg.order else (NO_PEDESTAL, 0, 0)
                rows.append((ped.mean, ped.rms, ped.used, ped.slope, ped.quality, a, b))
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(rows, columns=schema.names[-7:])], axis=1)

    return df.mapInPandas(run, schema)


def with_firmware_pulses(df: DataFrame, samples: str, pedestal: str, cfg: FirmwareConfig = FirmwareConfig()) -> DataFrame:
    """Add fw_pulses by the emulator, with each row's own pedestal."""
    schema = StructType([*df.schema.fields, StructField("fw_pulses", FIRMWARE_PULSES)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(fw_pulses=[firmware_pulses(x if x is not None else [], p, cfg) for x, p in zip(pdf[samples], pdf[pedestal], strict=True)])

    return df.mapInPandas(run, schema)


@dataclass(frozen=True)
class Template:
    """Pulse shape (1 - exp(-t / rise)) ** power * exp(-t / fall), times in ns."""

    rise: float
    fall: float
    power: float = 1.0

    def __call__(self, t: np.ndarray) -> np.ndarray:
        u = np.maximum(t, 0.0)
        return np.where(t > 0, (1 - np.exp(-u / self.rise)) ** self.power * np.exp(-u / self.fall), 0.0)

    @property
    def top(self) -> float:
        return self.rise * np.log1p(self.power * self.fall / self.rise)

    @property
    def height(self) -> float:
        return float(self(np.array([self.top]))[0])


@dataclass(frozen=True)
class ShapeConfig:
    """How far a fit may go from the template and from the found pulses."""

    rise: tuple[float, float] = (0.5, 10.0)  # templates outside are not used
    fall: tuple[float, float] = (2.0, 100.0)
    shape: float = 1.5  # factor on rise and fall
    start: float = 8.0  # ns
    amplitude: float = 2.0  # factor
    before: int = 8  # samples of the window
    after: int = 40
    rounds: int = 100
    clock: float = 4.0


def pulse_sum(t: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of pulses with parameters p [pulse, (amplitude, start, rise, fall, power)] at times t, and its
    derivatives [time, pulse, parameter]."""
    a, t0, rise, fall, power = (p[:, k, None] for k in range(5))
    u = t - t0
    on = u > 0
    u = np.where(on, u, 1.0)
    decay, e = np.exp(-u / fall), np.exp(-u / rise)
    h = np.maximum(1 - e, 1e-300)
    g = np.where(on, h**power * decay, 0.0)
    slope = np.where(on, power * h ** (power - 1) * decay * e, 0.0)  # by what e multiplies
    d = np.stack([g, -a * (slope / rise - g / fall), -a * slope * u / rise**2, a * g * u / fall**2, a * g * np.log(h)], 2)
    return (a * g).sum(0), d.transpose(1, 0, 2)


def bounded_pulse_fit(t: np.ndarray, y: np.ndarray, p: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int) -> tuple[np.ndarray, float, bool]:
    """Damped least squares of pulses inside bounds: parameters, cost, whether a step improved on the start.
    Parameters whose bounds meet stay as they are."""
    free = (high > low).ravel()
    fit, d = pulse_sum(t, p)
    cost, damp, moved = float(((y - fit) ** 2).sum()), 1e-3, False
    for _ in range(rounds):
        j = d.reshape(len(t), -1)[:, free]
        h = j.T @ j
        move = np.zeros(p.size)
        move[free] = np.linalg.solve(h + np.diag(damp * np.diag(h) + 1e-9), j.T @ (y - fit))
        q = np.clip(p + move.reshape(p.shape), low, high)
        trial, d_trial = pulse_sum(t, q)
        c = float(((y - trial) ** 2).sum())
        if c < cost:
            small = cost - c < 1e-7 * cost
            p, fit, d, cost, damp, moved = q, trial, d_trial, c, damp / 3, True
            if small:
                break
        else:
            damp *= 4
            if damp > 1e6:
                break
    return p, cost, moved


def deconvolve(samples: np.ndarray, pedestal: float, pulses: list[dict], shape: Template, cfg: ShapeConfig = ShapeConfig()) -> list[dict] | None:
    """Overlapping pulses fitted at once, each with an amplitude, a start and its own rise and fall near those
    of the template; None if no step improves on the first guess."""
    x = np.asarray(samples, float) - pedestal
    lo, hi = max(min(p["pos"] for p in pulses) - cfg.before, 0), min(max(p["pos"] for p in pulses) + cfg.after, len(x))
    t, y = np.arange(lo, hi) * cfg.clock, x[lo:hi]
    guess = np.array([[max(q["height"], 1.0) / shape.height, q["time"] - shape.top, shape.rise, shape.fall, 1.0] for q in pulses], float)
    low, high = guess.copy(), guess.copy()
    low[:, 0], high[:, 0] = 0, cfg.amplitude * guess[:, 0]
    low[:, 1] -= cfg.start
    high[:, 1] += cfg.start
    low[:, 2:4] /= cfg.shape
    high[:, 2:4] *= cfg.shape
    got, _, moved = bounded_pulse_fit(t, y, guess, low, high, cfg.rounds)
    if not moved:
        return None
    out = []
    for q, (a, t0, r, f, _) in zip(pulses, got, strict=True):
        own = Template(r, f)
        area = f * f / (r + f) / cfg.clock
        out.append({**q, "height": float(a * own.height), "time": float(t0 + own.top), "integral": float(a * area), "quality": q.get("quality", 0) | DECONVOLVED})
    return out


def fit_shape(samples: np.ndarray, pedestal: float, pulse: dict, free_power: bool = False, cfg: ShapeConfig = ShapeConfig()) -> dict | None:
    """Amplitude, start, rise and fall (and power) of one pulse, and the squared residual a degree of freedom."""
    x = np.asarray(samples, float) - pedestal
    lo, hi = max(pulse["pos"] - cfg.before, 0), min(pulse["pos"] + cfg.after, len(x))
    t, y = np.arange(lo, hi) * cfg.clock, x[lo:hi]
    first = Template(3.0, 12.0)
    guess = np.array([[max(pulse["height"], 1.0) / first.height, pulse["time"] - first.top, first.rise, first.fall, 1.0]])
    low = np.array([[0.0, guess[0, 1] - 2 * cfg.start, cfg.rise[0], cfg.fall[0], 0.5 if free_power else 1.0]])
    high = np.array([[10 * guess[0, 0], guess[0, 1] + 2 * cfg.start, cfg.rise[1], cfg.fall[1], 4.0 if free_power else 1.0]])
    got, cost, moved = bounded_pulse_fit(t, y, guess, low, high, cfg.rounds)
    if not moved:
        return None
    a, t0, rise, fall, power = got[0].tolist()
    return {"amplitude": a, "start": t0, "rise": rise, "fall": fall, "power": power, "chi2_dof": cost / max(len(t) - 4 - free_power, 1)}


SHAPE = StructType([StructField(c, DoubleType()) for c in ("amplitude", "start", "rise", "fall", "power", "chi2_dof")])


def with_shape(df: DataFrame, samples: str, free_power: bool = False, cfg: ShapeConfig = ShapeConfig()) -> DataFrame:
    """Rows of `with_pulses` with `shape`, the fit of a waveform's only pulse; null with none or several."""
    schema = StructType([*df.schema.fields, StructField("shape", SHAPE)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [fit_shape(x, m, p[0] if isinstance(p[0], dict) else p[0].asDict(), free_power, cfg) if len(p) == 1 else None for x, m, p in zip(pdf[samples], pdf["ped_mean"], pdf["pulses"], strict=True)]
            yield pdf.assign(shape=got)

    return df.mapInPandas(run, schema)


def with_templates(df: DataFrame, channels: DataFrame, templates: DataFrame, keys: list[str], cfg: ShapeConfig = ShapeConfig()) -> DataFrame:
    """Add rise and fall of each channel's type: channels(keys, type), templates(type, rise, fall). A
    channel without a type, a type without a template, and constants out of range leave them null;
    `template_state` says which."""
    store = channels.join(templates, "type", "left").select(*keys, "rise", "fall")
    ok = F.col("rise").between(*cfg.rise) & F.col("fall").between(*cfg.fall)
    state = F.when(F.col("rise").isNull() | F.col("fall").isNull(), NO_TEMPLATE).when(~ok, BAD_TEMPLATE).otherwise(NOT_RUN)
    x = df.join(store, keys, "left").withColumn("template_state", state)
    good = lambda c: F.when(F.col("template_state") == NOT_RUN, F.col(c)).alias(c)
    return x.select(*df.columns, good("rise"), good("fall"), "template_state")


def with_deconvolution(df: DataFrame, samples: str, cfg: ShapeConfig = ShapeConfig(), all_pulses: bool = False) -> DataFrame:
    """Rows of `with_pulses` and `with_templates` with piled-up pulses taken apart by the row's template; the
    others pass untouched, in the same pass, so that only piled-up waveforms pay for the fit. `state` is
    NOT_RUN where nothing is piled up, else APPLIED, FIT_FAILED or what the template lacks."""
    schema = StructType([*df.schema.fields, StructField("state", IntegerType())])

    def one(x: np.ndarray, ped: float, pulses: list, rise: float, fall: float, state: int) -> tuple[list, int]:
        pulses = [p if isinstance(p, dict) else p.asDict() for p in pulses]
        if not pulses or not all_pulses and not any(p["quality"] & PILED for p in pulses):
            return pulses, NOT_RUN
        if state != NOT_RUN:
            return pulses, int(state)
        got = deconvolve(x, ped, pulses, Template(rise, fall), cfg)
        return (got, APPLIED) if got else (pulses, FIT_FAILED)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [one(*r) for r in zip(pdf[samples], pdf["ped_mean"], pdf["pulses"], pdf["rise"], pdf["fall"], pdf["template_state"], strict=True)]
            yield pdf.assign(pulses=[p for p, _ in got], state=[s for _, s in got])

    return df.mapInPandas(run, schema)
