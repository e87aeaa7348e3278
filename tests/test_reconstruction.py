import itertools

import numpy as np
import pytest

from beamframe.functions import bits as B
from beamframe.functions import decode as D
from beamframe.operators import clusters, fits, waveforms
from beamframe.operators import matching as M
from pyspark.sql import functions as F

P = [100]
T1 = P * 4 + [110, 130, 170, 250, 200, 130, 110] + P * 9
CASES = {
    "one": (T1, {}, [(150, 75, 6, 4, 24.25, 6, 7, 400, 2, 16, 0)]),
    "under": (P * 4 + [105, 110, 130, 110, 105] + P * 5, {}, []),
    "two": (T1[:11] + P * 14 + [110, 140, 200, 260, 180, 120, 105] + P * 8, {}, [(150, 75, 6, 4, 24.25, 6, 7, 400, 2, 16, 0), (160, 80, 26, 43, 106.6875, 27, 28, 415, 23, 37, 0)]),
    "late": (P * 8 + [170, 250, 200, 130, 110, 100], {}, [(150, 75, 8, 4, 32.25, 8, 9, 360, 4, 13, waveforms.AFTER_CUT)]),
    "early": (P * 4 + [170, 250, 200, 130, 110] + P * 11, {"before": 24.0}, [(150, 75, 4, 4, 16.25, 4, 5, 360, 0, 14, waveforms.BEFORE_CUT)]),
    "edge": (P * 4 + [110, 130, 170, 200, 230, 260], {"after": 16.0}, [(160, 80, 6, 21, 25.3125, 6, 9, 500, 2, 9, waveforms.PEAK_AT_EDGE | waveforms.AFTER_CUT)]),
    "carry": (P * 4 + [120, 140, 180, 260, 180, 140, 120] + P * 9, {}, [(160, 80, 6, 0, 24.0, 6, 7, 440, 2, 16, 0)]),
}


@pytest.mark.parametrize("name", CASES)
def test_firmware_pulses(name):
    raw, cfg, want = CASES[name]
    got = waveforms.firmware_pulses(np.array(raw), 100, waveforms.FirmwareConfig(**cfg))
    assert [tuple(p[k] for k in ("vpeak", "va", "coarse", "fine", "time", "cross", "pos", "integral", "lo", "hi", "quality")) for p in got] == want


def test_pulse_over_noise():
    r = np.random.default_rng(1)
    x = 100 + r.normal(0, 1, 100)
    x[50:60] += [20, 60, 120, 150, 120, 80, 50, 30, 15, 5]
    ped, pulses = waveforms.find_pulses(x)
    assert abs(ped.mean - 100) < 0.5 and ped.rms < 2 and ped.used > 15
    assert len(pulses) == 1 and abs(pulses[0]["time"] - 53 * 4) < 4 and abs(pulses[0]["integral"] - 650) < 40


def test_neighbouring_pulses_pile_up():
    x = np.full(100, 100.0)
    x[40:46] += [50, 150, 60, 50, 160, 60]
    _, pulses = waveforms.find_pulses(x, waveforms.PulseConfig(order=0))
    assert [p["quality"] for p in pulses] == [waveforms.PILED] * 2


def test_pedestal_step_by_step():
    """The clipping of the pedestal, one sample at a time, and every quality bit."""
    cfg = waveforms.PulseConfig()

    def plain(window):
        left = list(enumerate(window))
        middle = lambda v: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2
        mean = middle([v for _, v in left])
        rms = 1.4826 * middle([abs(v - mean) for _, v in left])
        flags = waveforms.NOT_CONVERGED
        for _ in range(3):
            near = [(i, v) for i, v in left if abs(v - mean) < max(rms, 1.0)]
            if len(near) == len(left):
                flags = 0
                break
            left = near
            if len(left) < 5:
                flags = waveforms.TOO_FEW
                break
            mean = sum(v for _, v in left) / len(left)
            rms = (sum((v - mean) ** 2 for _, v in left) / len(left)) ** 0.5
        flags |= waveforms.FLOOR_ACTIVE if rms < 1.0 else 0
        slope = np.polyfit([i for i, _ in left], [v for _, v in left], 1)[0] if len(left) > 1 else 0.0
        return mean, rms, len(left), slope, flags

    r = np.random.default_rng(2)
    seen = 0
    for k in range(300):
        window = r.normal(100, [0.3, 1, 8][k % 3], 30) + (r.random(30) < 0.2) * r.normal(0, 60, 30) * (k % 5 > 2)
        if k % 10 == 9:
            window = np.where(np.arange(30) % 2, 0.0, 1000.0) + np.arange(30) ** 3
        p = waveforms.robust_pedestal(window, cfg)
        assert (p.mean, p.rms, p.used, p.slope, p.quality) == pytest.approx(plain(window))
        seen |= p.quality
    assert seen == waveforms.NOT_CONVERGED | waveforms.FLOOR_ACTIVE | waveforms.TOO_FEW
    x = np.full(100, 100.0)
    x[5:20] = 4095
    ped, pulses = waveforms.find_pulses(x, waveforms.PulseConfig(order=0))
    assert ped.quality & waveforms.SATURATED and any(p["saturated"] for p in pulses) or ped.quality & waveforms.TRAILING
    y = 100 + r.normal(0, 2, 100)
    y[8:12] += [60, 200, 200, 60]
    assert waveforms.find_pulses(y)[0].quality & waveforms.PULSE_INSIDE
    y[:30] = r.normal(100, 300, 30)
    assert waveforms.find_pulses(y)[0].quality & waveforms.TRAILING


def test_tails_end_after_weak_samples_in_a_row():
    y = np.array([0, 0.5, 2, 0.5, 3, 10, 4, 0.2, 3, 0.1, 0.1, 5, 0])
    cfg = waveforms.PulseConfig(tail=0.1, tail_samples=2)
    assert waveforms.tail_cut(y, 5, 0, 12, 0.0, cfg) == (2, 8)
    assert waveforms.tail_cut(y, 5, 3, 7, 0.0, cfg) == (4, 6)
    assert waveforms.tail_cut(y, 5, 0, 12, 3.5, cfg) == (5, 6)


def test_piled_pulses_come_apart():
    shape = waveforms.Template(2.5, 14.0)
    t = np.arange(100) * 4.0
    for gap in (24.0, 40.0):
        truth = [(800.0, 150.0), (500.0, 150.0 + gap)]
        x = 100 + sum(a * shape(t - t0) for a, t0 in truth)
        pulses = [{"pos": int((t0 + shape.top) // 4), "height": float(a * shape.height * 1.2), "time": float(t0 + shape.top + 2), "integral": 0.0, "quality": waveforms.PILED} for a, t0 in truth]
        got = waveforms.deconvolve(x, 100.0, pulses, waveforms.Template(2.3, 13.0))
        for p, (a, t0) in zip(got, truth, strict=True):
            assert p["height"] == pytest.approx(a * shape.height, rel=0.02) and p["time"] == pytest.approx(t0 + shape.top, abs=0.3)
            assert p["integral"] == pytest.approx(a * 14.0**2 / 16.5 / 4, rel=0.03) and p["quality"] & waveforms.DECONVOLVED


def test_derivatives_of_pulses():
    r = np.random.default_rng(3)
    t = np.arange(60) * 4.0
    p = np.column_stack([r.uniform(10, 90, 3), r.uniform(20, 100, 3), r.uniform(1, 5, 3), r.uniform(5, 20, 3), r.uniform(0.8, 2, 3)])
    _, d = waveforms.pulse_sum(t, p)
    for k in np.ndindex(*p.shape):
        e = np.zeros_like(p)
        e[k] = 1e-6
        assert d[:, k[0], k[1]] == pytest.approx((waveforms.pulse_sum(t, p + e)[0] - waveforms.pulse_sum(t, p - e)[0]) / 2e-6, abs=1e-3)


@pytest.mark.parametrize("power", [1.0, 2.0])
def test_shape_of_a_single_pulse(power):
    truth = waveforms.Template(2.0, 18.0, power)
    x = 100 + 900 * truth(np.arange(100) * 4.0 - 121.0)
    _, (pulse,) = waveforms.find_pulses(x, waveforms.PulseConfig(order=1))
    got = waveforms.fit_shape(x, 100.0, pulse, free_power=power != 1.0)
    assert got["fall"] == pytest.approx(18.0, rel=0.05) and got["start"] == pytest.approx(121.0, abs=1.5) and got["chi2_dof"] < 2


def test_templates_by_channel(spark):
    df = spark.createDataFrame([(c, 1) for c in (1, 2, 3, 4)], "ch int, rise_other int")
    channels = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "ch int, type string")
    got = {r.ch: (r.rise, r.template_state) for r in waveforms.with_templates(df, channels, spark.createDataFrame([("a", 2.0, 9.0), ("b", 2.0, 900.0)], "type string, rise double, fall double"), ["ch"]).collect()}
    assert got == {1: (2.0, waveforms.NOT_RUN), 2: (None, waveforms.BAD_TEMPLATE), 3: (None, waveforms.NO_TEMPLATE), 4: (None, waveforms.NO_TEMPLATE)}


def test_ripple_does_not_crowd_out_later_pulses():
    x = np.full(200, 100.0)
    x[40:100] += np.concatenate([np.linspace(0, 400, 10), np.linspace(400, 0, 50)])
    x[54] += 30  # overlaps the pulse and is small beside it
    x[58:98:4] += 9.5  # ten ripples on the falling side, low over their own baseline
    x[150:157] += [20, 80, 200, 300, 200, 80, 20]
    _, pulses = waveforms.find_pulses(x, waveforms.PulseConfig(order=0))
    assert [p["pos"] for p in pulses if p["pos"] > 100] == [153] and len(pulses) == 2


def test_waveform_columns_take_nulls_and_short(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [1.0, 2.0])], "id bigint, samples array<double>")
    assert [r.pulses for r in waveforms.with_pulses(df, "samples").orderBy("id").collect()] == [[], [], []]


def test_islands_against_flood_fill():
    r = np.random.default_rng(2)
    for _ in range(20):
        cells = sorted({(int(a), int(b)) for a, b in r.integers(0, 8, (30, 2))})
        x, y = np.array(cells).T
        for corners in (False, True):
            label = clusters.islands(x, y, corners)
            for i, j in itertools.combinations(range(len(x)), 2):
                d = abs(x[i] - x[j]), abs(y[i] - y[j])
                if max(d) == 1 and (corners or sum(d) == 1):
                    assert label[i] == label[j]
            assert len(set(label.tolist())) == label.max() + 1


def test_split_keeps_the_energy():
    x, y = np.array([0, 1, 2, 3, 4]), np.zeros(5, int)
    e = np.array([50.0, 100, 20, 90, 40])
    tops, share = clusters.split_island(x, y, e, clusters.IslandConfig())
    assert tops.tolist() == [1, 3] and np.allclose(share.sum(0), 1)
    assert share[0, 0] > 0.95 and share[1, 4] > 0.95


def test_split_finds_two_showers():
    """Two showers of the profile itself, three modules apart: energies and places come back."""
    cfg = clusters.IslandConfig()
    x, y = (a.ravel() for a in np.mgrid[0:9, 0:5])
    truth = [(900.0, 2, 2), (500.0, 5, 2)]
    e = sum(t * clusters.shower_share(np.hypot(x - a, y - b), cfg) for t, a, b in truth)
    keep = e > 0.5
    x, y, e = x[keep], y[keep], e[keep]
    tops, share = clusters.split_island(x, y, e, cfg)
    for top, part, (t, a, b) in zip(tops, share * e, truth, strict=True):
        assert (x[top], y[top]) == (a, b) and part.sum() == pytest.approx(sum(t * clusters.shower_share(np.hypot(x - a, y - b), cfg)), rel=0.02)
        assert clusters.centroid(x, y, part, top, part.sum(), cfg) == pytest.approx((a, b), abs=0.05)


def test_profiles_and_lone_centres():
    cfg = clusters.IslandConfig(profile=((0.0, 0.8), (1.0, 0.1), (2.0, 0.0)))
    assert clusters.shower_share(np.array([0.0, 0.5, 1.0, 5.0]), cfg).tolist() == pytest.approx([0.8, 0.45, 0.1, 0.0])
    x, y = np.array([0, 1, 30]), np.zeros(3, int)
    assert clusters.centroid(x, y, np.array([1.0, 1.0, 5000.0]), 0, 5002.0, clusters.IslandConfig()) == (0.0, 0.0)


def test_gaussian_fit_finds_the_peak():
    c = np.arange(-5, 5, 0.1) + 0.05
    n = np.random.default_rng(3).poisson(1000 * np.exp(-0.5 * ((c - 0.7) / 0.4) ** 2))
    a, m, s, _ = fits.gaussian_fit(c, n)
    assert abs(m - 0.7) < 0.02 and abs(s - 0.4) < 0.03 and abs(a - 1000) < 60


def test_greedy_pairs_against_loop(spark):
    r = np.random.default_rng(4)
    rows = [(int(e), int(a), int(b), float(100 - a), float(d)) for e in range(5) for a in range(6) for b, d in enumerate(r.integers(0, 9, 7)) if d < 6]
    df = spark.createDataFrame(rows, "ev bigint, a bigint, b bigint, p double, d double")
    got = sorted((x.ev, x.a, x.b) for x in M.greedy_pairs(df, "ev", "a", "b", "p", "d").collect())
    want = []
    for e in range(5):
        used = set()
        for a in range(6):
            best = min(((d, b) for ev, i, b, _, d in rows if ev == e and i == a and b not in used), default=None)
            if best:
                used.add(best[1])
                want.append((e, a, best[1]))
    assert got == sorted(want)


def test_greedy_plane_pairs_against_loop(spark):
    r = np.random.default_rng(6)
    rows = [(e, a, int(p), int(b), float(50 - a % 4), float(r.integers(0, 9))) for e in range(6) for a in range(7) for p in range(5) for b in range(4) if r.random() < 0.4]
    df = spark.createDataFrame(rows, "ev bigint, a bigint, plane int, b bigint, e double, d double")
    got = sorted((x.ev, x.a, x.pair, x.plane, x.b) for x in M.greedy_plane_pairs(df, "ev", "a", "plane", "b", "e", "d", [(0, 1), (2, 3)]).collect())
    want = []
    for e in range(6):
        used = set()
        for a in sorted(range(7), key=lambda a: (-(50 - a % 4), a)):
            free = [(d, p, b) for ev, i, p, b, _, d in rows if ev == e and i == a and (p, b) not in used]
            best = [min((f for f in free if f[1] in pair), default=None) for pair in ((0, 1), (2, 3))]
            if None not in best:
                used |= {f[1:] for f in best}
                want += [(e, a, n, f[1], f[2]) for n, f in enumerate(best)]
    assert got == sorted(want) and want


def test_frames_invert():
    m = M.rotation(3, -7, 40)
    assert np.allclose(m @ m.T, np.eye(3)) and np.isclose(np.linalg.det(m), 1)


def test_bit_names():
    assert B.parse_bits(["a", "3", "zz"], {"a": 0}) == (9, ["zz"])
    assert B.mask_of([0, 2]) == 5


def test_strip_words(spark):
    values, strip = [5, -3, 4095, -4096, 0, 77], 100
    v = [x & 0x1FFF for x in values]
    words = [v[0] | v[1] << 13 | (strip & 31) << 26, v[2] | v[3] << 13 | (strip >> 5) << 26, v[4] | v[5] << 13 | 9 << 26]
    got = spark.createDataFrame([(words,)], "w array<bigint>").select(D.strip_words(F.col("w")).alias("s")).first().s
    assert list(got.ts) == values and got.strip == strip and got.chip == 9


def test_scaler_block(spark):
    words = list(range(1, 17)) + list(range(2, 34, 2))
    got = spark.createDataFrame([(words,)], "w array<bigint>").select(D.scaler_block(F.col("w"), 2).alias("s")).first().s
    assert got.gated[2] == 3 and got.ungated[2] == 6 and got.live == 0.5


def test_crystal_ball_finds_peak_over_tail():
    c = np.arange(0, 100, 1.0) + 0.5
    truth = np.array([800.0, 70.0, 4.0, 1.2, 3.0])
    n = np.random.default_rng(9).poisson(fits.crystal_ball(c, truth))
    _, m, s, _ = fits.crystal_ball_fit(c, n)
    assert abs(m - 70) < 0.5 and abs(s - 4) < 0.5


def test_valleys_against_their_definition():
    """A valley is the least strip that has, somewhere on its left in the part, a fall of more than `depth`
    just before the stretch it lies in and, at the stretch's end, a rise of more than `depth`."""

    def parts(q, depth):
        falls = [i for i in range(len(q) - 1) if q[i] - q[i + 1] > depth] if len(q) > 2 else []
        rises = [j for j in range(falls[0] + 1, len(q) - 1) if q[j + 1] - q[j] > depth] if falls else []
        if not rises:
            return [(len(q), sum(q))]
        stretch = q[falls[0] + 1 : rises[0] + 1]
        m = falls[0] + 1 + stretch.index(min(stretch))
        return [(m, sum(q[:m])), *parts([q[m] / 2, *q[m + 1 :]], depth)]

    r = np.random.default_rng(11)
    for _ in range(300):
        q = r.integers(0, 100, r.integers(1, 15)).astype(float)
        first, cut = clusters.valley_cuts(q, 14.0)
        got = [(z - a, cut[a:z].sum()) for a, z in zip(first, [*first[1:], len(q)], strict=True)]
        assert got == parts(q.tolist(), 14.0)
