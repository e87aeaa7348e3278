"""Islands of grid hits: connected hits are split among their local maxima by a shower profile.

An event's hits are few and one task holds them; events are spread over tasks by their key."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StructField, StructType


@dataclass(frozen=True)
class IslandConfig:
    least_hit: float = 0.0  # hits must be over it
    least_centre: float = 10.0
    least_cluster: float = 50.0
    least_size: int = 1
    corners: bool = False  # whether hits that meet at a corner are connected
    iterations: int = 6
    least_share: float = 0.01  # of a hit, for it to be counted to a cluster
    log_base: float = 3.6
    centre_share: float = 0.78  # of a shower's energy in its central module
    width: float = 0.36  # of the profile, in modules
    profile: tuple[tuple[float, float], ...] = ()  # (distance, share) to interpolate in place of the rule
    most_hits: int = 100  # islands from this size on, or with so many maxima, are not split
    most_maxima: int = 10


def islands(x: np.ndarray, y: np.ndarray, corners: bool) -> np.ndarray:
    """Island number of each hit."""
    at = {p: i for i, p in enumerate(zip(x.tolist(), y.tolist(), strict=True))}
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (corners or not (i and j))]
    out = np.full(len(x), -1)
    n = 0
    for start in range(len(x)):
        if out[start] >= 0:
            continue
        stack = [start]
        out[start] = n
        while stack:
            k = stack.pop()
            for i, j in steps:
                m = at.get((x[k] + i, y[k] + j))
                if m is not None and out[m] < 0:
                    out[m] = n
                    stack.append(m)
        n += 1
    return out


def shower_share(distance: np.ndarray, cfg: IslandConfig = IslandConfig()) -> np.ndarray:
    """Share of a shower's energy in a module at a distance (in modules) from its centre."""
    if cfg.profile:
        at, share = np.array(cfg.profile).T
        return np.interp(distance, at, share, right=0.0)
    return np.where(distance < 0.01, cfg.centre_share, cfg.centre_share * np.exp(-(distance**2) / (2 * cfg.width**2)))


def centroid(x: np.ndarray, y: np.ndarray, e: np.ndarray, top: int, total: float, cfg: IslandConfig) -> tuple[float, float]:
    """Mean of the hits in the 3 x 3 around the central one, weights max(0, log_base + ln(e / total)); the
    centre itself where no weight is left."""
    near = (np.abs(x - x[top]) <= 1) & (np.abs(y - y[top]) <= 1) & (e > 0)
    w = np.maximum(0.0, cfg.log_base + np.log(e[near] / total)) if total > 0 else np.zeros(int(near.sum()))
    if w.sum() <= 0:
        return float(x[top]), float(y[top])
    return float((w * x[near]).sum() / w.sum()), float((w * y[near]).sum() / w.sum())


def split_island(x: np.ndarray, y: np.ndarray, e: np.ndarray, cfg: IslandConfig) -> tuple[np.ndarray, np.ndarray]:
    """Places of the local maxima, and the share of each hit's energy in the cluster of each [cluster, hit].

    Shares start from the shower profile around the maxima; each round puts a cluster's centre at the
    centroid of its part and takes the profile from there, times the energy around it."""
    near = (np.abs(x[:, None] - x) <= 1) & (np.abs(y[:, None] - y) <= 1)
    tops = np.flatnonzero((np.where(near, e, -np.inf).max(1) <= e) & (e >= cfg.least_centre))
    if len(tops) < 2 or len(e) >= cfg.most_hits or len(tops) >= cfg.most_maxima:
        tops = tops[np.argsort(-e[tops], kind="stable")][:1]
        return tops, np.ones((len(tops), len(e)))
    weight = shower_share(np.hypot(x - x[tops][:, None], y - y[tops][:, None]), cfg) * e[tops][:, None]
    for _ in range(cfg.iterations):
        share = weight / np.maximum(weight.sum(0), 1e-300)
        for k, top in enumerate(tops.tolist()):
            part = share[k] * e
            part[top] = e[top]
            around = near[top] & (part > 0)
            total = part[around].sum()
            cx, cy = centroid(x, y, np.where(around, part, 0.0), top, total, cfg)
            weight[k] = shower_share(np.hypot(x - cx, y - cy), cfg) * total
    share = weight / np.maximum(weight.sum(0), 1e-300)
    share[share < cfg.least_share] = 0
    return tops, share / np.maximum(share.sum(0), 1e-300)


def event_clusters(hx: np.ndarray, hy: np.ndarray, he: np.ndarray, cfg: IslandConfig) -> list[tuple[float, float, float, int]]:
    """(energy, x, y, n_blocks) of one event's clusters, by falling energy; a cell is there once."""
    rows = []
    label = islands(hx, hy, cfg.corners)
    for k in range(label.max() + 1):
        own = label == k
        ox, oy, oe = hx[own], hy[own], he[own]
        tops, shares = split_island(ox, oy, oe, cfg)
        for top, share in zip(tops.tolist(), shares, strict=True):
            part = share * oe
            total, n = float(part.sum()), int((part > 0).sum())
            if total >= cfg.least_cluster and n >= cfg.least_size:
                rows.append((total, *centroid(ox, oy, part, top, total, cfg), n))
    return sorted(rows, key=lambda r: (-r[0], r[1], r[2]))


def form_clusters(hits: DataFrame, event: str, x: str, y: str, energy: str, cfg: IslandConfig = IslandConfig()) -> DataFrame:
    """event, cluster, energy, x, y, n_blocks: clusters numbered by falling energy."""
    schema = StructType([hits.schema[event], StructField("cluster", LongType()), StructField("energy", DoubleType()), StructField("x", DoubleType()), StructField("y", DoubleType()), StructField("n_blocks", LongType())])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf[energy] > cfg.least_hit].groupby([x, y], as_index=False)[energy].sum() if len(pdf) else pdf
        rows = event_clusters(*(pdf[c].to_numpy() for c in (x, y, energy)), cfg) if len(pdf) else []
        return pd.DataFrame([(key[0], k, *r) for k, r in enumerate(rows)], columns=schema.names)

    return hits.select(event, x, y, energy).groupBy(event).applyInPandas(run, schema)


def valley_cuts(charge: np.ndarray, depth: float) -> tuple[list[int], np.ndarray]:
    """First strips of the parts of a run that is cut at its valleys, and the charges after the cuts.

    A valley is the least strip between a fall and a rise of more than `depth`; half its charge goes,
    and the rest belongs to the part on its right, which is looked at again from there."""
    q = np.array(charge, float)
    first = [0]
    while len(q) - first[-1] >= 3:
        a = first[-1]
        step = np.diff(q[a:])
        fall = np.flatnonzero(step < -depth)
        if not len(fall):
            break
        low = int(fall[0]) + 1
        rise = np.flatnonzero(step[low:] > depth)
        if not len(rise):
            break
        m = a + low + int(q[a + low : a + low + int(rise[0]) + 1].argmin())
        q[m] /= 2
        first.append(m)
    return first, q


def strip_clusters(strips: DataFrame, keys: list[str], position: str, charge: str, depth: float = 14.0, gap: int = 1, sizes: tuple[int, int] = (1, 20)) -> DataFrame:
    """Runs of neighbouring strips cut at their valleys: keys, first, size, total, peak, centre.

    A key (event and plane) has few strips and one task holds them."""
    schema = StructType([*(strips.schema[k] for k in keys), StructField("first", LongType()), StructField("size", LongType()), *(StructField(c, DoubleType()) for c in ("total", "peak", "centre"))])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(position, kind="stable")
        pos, all_q = pdf[position].to_numpy(), pdf[charge].to_numpy(float)
        rows = []
        for part in np.split(np.arange(len(pos)), np.flatnonzero(np.diff(pos) > gap) + 1):
            first, q = valley_cuts(all_q[part], depth)
            # a cut strip has lost half its charge before the part on its left ends, which leaves it out
            for a, z in zip(first, [*first[1:], len(part)], strict=True):
                x, w = pos[part][a:z], q[a:z]
                if sizes[0] <= z - a <= sizes[1]:
                    rows.append((*key, int(x[0]), z - a, w.sum(), w.max(), (x * w).sum() / w.sum() if w.sum() > 0 else float(x.mean())))
        return pd.DataFrame(rows, columns=schema.names)

    return strips.select(*keys, position, charge).groupBy(*keys).applyInPandas(run, schema)
