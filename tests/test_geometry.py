"""Islands by joins, borders between sectors, tracks of all combinations, table functions, sync snapshots."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from beamframe.functions.tables import register_tables
from beamframe.operators import clusters, matching, readout, tracking
from beamframe.plans import ALL
from tests.compare import rows, same


@pytest.mark.parametrize("corners", [False, True])
def test_island_labels_are_the_islands(spark, corners):
    r = random.Random(3)
    hits = {(e, r.randrange(14), r.randrange(14)) for e in (1, 2, None) for _ in range(90)} | {(3, i, 0) for i in range(60)} | {(4, 5, 5)}
    got = {(x.e, x.x, x.y): (x.island_x, x.island_y) for x in matching.island_labels(spark.createDataFrame([h for h in hits if h[0]] + [(3, 7, 0)], "e bigint, x bigint, y bigint"), ["e"], "x", "y", corners).collect()}
    want = {}
    for e in (1, 2, 3, 4):
        own = sorted((x, y) for k, x, y in hits if k == e)
        label = clusters.islands(np.array([x for x, _ in own]), np.array([y for _, y in own]), corners)
        first = {}
        for cell, k in zip(own, label.tolist(), strict=True):
            first.setdefault(k, cell)
            want[e, *cell] = first[k]
    assert got == want


def test_share_of_the_way_inside(spark):
    r = np.random.default_rng(2)
    ways = [(*map(float, r.uniform(-3, 3, 2)), *map(float, r.uniform(-4, 4, 2))) for _ in range(60)] + [(0.5, 0.5, 0.0, 0.0), (0.5, 9.0, 0.0, 0.0), (-2.0, 0.5, 4.0, 0.0), (-2.0, 5.0, 4.0, 0.0), (0.0, -1.0, 0.0, 4.0)]
    box = tuple(F.lit(v) for v in (-1.0, 1.0, -0.5, 2.0))
    df = spark.createDataFrame(ways, "x double, y double, dx double, dy double")
    t = (np.arange(20_000) + 0.5) / 20_000
    for w in df.withColumn("share", matching.share_inside(F.col("x"), F.col("y"), F.col("dx"), F.col("dy"), box)).collect():
        px, py = w.x + t * w.dx, w.y + t * w.dy
        assert w.share == pytest.approx(((px >= -1) & (px <= 1) & (py >= -0.5) & (py <= 2)).mean(), abs=2e-4)


def test_neighbours_across_a_border(spark):
    """A fine module at x = 0 (size 1) whose sector ends at 0.5, coarse ones (size 2, 3) beyond, and two coarse sectors
    on both sides of the fine one."""
    m = [("c", 0, 0.0, 0.0, 1.0), ("r", 1, 1.5, 0.0, 2.0), ("l", 2, -1.5, 0.5, 2.0), ("rr", 1, 3.5, 0.0, 2.0), ("up", 3, 1.5, 2.0, 2.0)]
    df = spark.createDataFrame([(i, s, x, y, z, z) for i, s, x, y, z in m], "id string, sector int, x double, y double, sx double, sy double")
    got = {(e.id, e.near): (round(e.dx, 6), round(e.dy, 6)) for e in matching.border_neighbours(df, 0, reach=2.0).collect()}
    assert got["c", "r"] == (1.0, 0.0) and got["r", "c"] == (-1.0, 0.0)  # 0.5 in fine modules, 1 in coarse ones
    assert got["r", "rr"] == (1.0, 0.0) and got["r", "up"] == (0.0, 1.0)
    assert got["r", "l"] == (-2.0, round(0.5 * (1 / 3 / 1 + 2 / 3 / 2), 6))  # 3 to the left, a third of it inside


def brute_tracks(clusters_, hits, cfg, least, skip=None):
    out = {}
    z = {p: (zz, s) for p, zz, s in cfg.planes}
    for e, c, cx, cy, cz, cs in clusters_:
        own = {p: [(h, x, y) for k, q, h, x, y in hits if k == e and q == p] for p in z if p != skip}
        best = None
        for n in range(least, len(own) + 1):
            for planes in itertools.combinations(sorted(own), n):
                for combo in itertools.product(*(own[p] for p in planes)):
                    pts = np.array([[cz, cx, cy, 1 / cs**2], *([z[p][0], x, y, 1 / z[p][1] ** 2] for p, (_, x, y) in zip(planes, combo, strict=True))])
                    fit = [np.polyfit(pts[:, 0], pts[:, k], 1, w=np.sqrt(pts[:, 3])) for k in (1, 2)]
                    off = np.array([np.polyval(f, pts[:, 0]) - pts[:, k] for f, k in zip(fit, (1, 2), strict=True)])
                    chi2 = (pts[:, 3] * (off**2).sum(0)).sum() / (2 * len(pts) - 4)
                    if chi2 <= cfg.max_chi2 and ((off[:, 1:] ** 2).sum(0) * pts[1:, 3] <= cfg.n_sigma**2).all() and (best is None or chi2 < best[0]):
                        best = (chi2, fit, tuple(zip(planes, (h for h, _, _ in combo), strict=True)))
        if best:
            out[e, c] = best
    return out


def test_combined_tracks_are_those_of_nested_loops(spark):
    r = random.Random(5)
    cfg = tracking.TrackConfig(tuple((p, 1000.0 + 300 * p, 0.5) for p in range(4)), max_chi2=4.0)
    cl = [(e, c, r.uniform(-50, 50), r.uniform(-50, 50), 3000.0, 2.0) for e in range(6) for c in range(2)]
    hits = [(e, p, n * 10 + p, x * z / 3000 + r.gauss(0, 0.6), y * z / 3000 + r.gauss(0, 0.6)) for e, c, x, y, _, _ in cl for n in [c] for p, z, _ in cfg.planes if r.random() < 0.85]
    hits += [(e, r.randrange(4), 100 + k, r.uniform(-20, 20), r.uniform(-20, 20)) for e in range(6) for k in range(6)] + [(0, 9, 1, 0.0, 0.0)]
    cdf = spark.createDataFrame(cl, "event bigint, cluster bigint, x double, y double, z double, sigma double")
    hdf = spark.createDataFrame(hits, "event bigint, plane bigint, hit bigint, x double, y double")
    got = {(t.event, t.cluster): t for t in tracking.combined_tracks(cdf, hdf, "event", cfg).collect()}
    want = brute_tracks(cl, hits, cfg, 3)
    assert set(got) == set(want) and len(want) > 6
    for k, (chi2, fit, names) in want.items():
        t = got[k]
        assert t.chi2_dof == pytest.approx(chi2, rel=1e-6) and tuple((h.plane, h.hit) for h in t.hits) == names
        assert (t.line.bx, t.line.ax, t.line.by, t.line.ay) == pytest.approx((*fit[0], *fit[1]), rel=1e-6, abs=1e-6)
    eff = {x.test: (x.den, x.num) for x in tracking.unbiased_efficiency(cdf, hdf, "event", cfg).collect()}
    for p, z, s in cfg.planes:
        found = brute_tracks(cl, hits, cfg, 3, skip=p)
        num = sum(any((np.polyval(f[0], z) - x) ** 2 + (np.polyval(f[1], z) - y) ** 2 < (cfg.n_sigma * s) ** 2 for k, q, _, x, y in hits if k == e and q == p) for (e, _), (_, f, _) in found.items())
        assert eff.get(p, (0, 0)) == (len(found), num)


def test_seedless_line_of_any_unit(spark):
    """The same points in metres and in micrometres give the same chi2."""
    cfg = lambda u: tracking.TrackConfig(tuple((p, (1 + p) * u, 0.1 * u) for p in range(3)), max_chi2=1e9, n_sigma=1e6)
    at = [(0.0, 0.1), (0.3, 0.0), (0.2, 0.4)]
    out = []
    for u in (1e-3, 1.0, 1e6):
        c = spark.createDataFrame([(1, 1, 0.5 * u, 0.5 * u, 5 * u, 0.1 * u)], "event bigint, cluster bigint, x double, y double, z double, sigma double")
        h = spark.createDataFrame([(1, p, p, x * u, y * u) for p, (x, y) in enumerate(at)], "event bigint, plane bigint, hit bigint, x double, y double")
        out.append(tracking.combined_tracks(c, h, "event", cfg(u)).first().chi2_dof)
        hit = tracking.leave_one_out(c, h, "event", tracking.TrackConfig(cfg(u).planes, mode=tracking.HIT_SEED, n_sigma=1e6, max_chi2=1e9))
        assert hit.where("chi2_dof IS NULL OR px IS NULL").count() == 0 and hit.count() == 3
    assert out[1] > 0 and out == pytest.approx([out[1]] * 3, rel=1e-6)


def test_table_functions_take_any_table(spark, small):
    register_tables(spark)
    assert same(rows(ALL["grid_clusters_in_sql"].build(spark, small).toPandas()), rows(ALL["island_clusters"].build(spark, small).toPandas()))
    spark.createDataFrame([("a", 5, 2.0), ("a", 3, 1.0), ("a", 4, None), ("b", 9, 1.0), (None, 1, 4.0), ("a", None, 1.0), ("a", 8, 3.0)], "Run string, Strip int, Q double").createOrReplaceTempView("strips_t")
    got = spark.sql("SELECT * FROM strip_groups(TABLE(strips_t), key => 'run', position => 'strip', charge => 'q', gap => 2)")
    assert got.columns == ["Run", "first", "n", "total", "centroid"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 3, 2, 3.0, 13 / 3), ("a", 8, 1, 3.0, 8.0), ("b", 9, 1, 1.0, 9.0), (None, 1, 1, 4.0, 1.0)], key=str)
    for call in ("key => 'none', position => 'strip', charge => 'q'", "key => 5, position => 'strip', charge => 'q'"):
        with pytest.raises(Exception, match="column"):
            spark.sql(f"SELECT * FROM strip_groups(TABLE(strips_t), {call})").collect()


def test_sync_snapshots(spark):
    none = None
    nodes = [
        ("f", 0, 0, 0, 0x80, 0x10, none), ("f", 0, 1, 1, 0x80, 1, [1, 2, 3]),  # physics: nothing is known
        ("f", 1, 0, 0, 0x11, 0x10, none), ("f", 1, 1, 1, 0x11, 1, [100, 7, 300]),  # prestart
        ("f", 2, 0, 0, 0x80, 0x10, none), ("f", 2, 1, 1, 0xE10A, 1, [9]),
        ("f", 3, 0, 0, 0x1F, 0x10, none), ("f", 3, 1, 2, 0xE112, 1, [0, 8, 55, 200]),  # sync, its tag word is missing
        ("f", 4, 0, 0, 0x14, 0x10, none), ("f", 4, 1, 1, 0x14, 1, []), ("f", 4, 2, 1, 0x14, 1, [300, 8]),  # end
        ("g", 0, 0, 0, 0x80, 0x10, none),
    ]
    df = spark.createDataFrame(nodes, "file string, event bigint, node int, depth int, tag int, type int, words array<bigint>")
    got = {(r.file, r.event): (r.run, r.counter, r.unix_time, r.event_tag, r.run_type) for r in readout.sync_snapshots(df, 2).collect()}
    assert got == {("f", 0): (none,) * 5, ("f", 1): (7, none, 100, 0x11, 44), ("f", 2): (7, none, 100, 0x11, 44), ("f", 3): (8, 55, 200, 0x1F, 44), ("f", 4): (8, 55, 300, 0x14, 0), ("g", 0): (none,) * 5}
