"""Joins of hits: spatial windows by cells, best hit, rank pairs, greedy exclusive pairs, groups of strips."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from beamframe.operators.tracking import spread_over
from beamframe.scratch import stored

#: modules of one kind in a list
LISTED = 512


def spatial_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], lx: str, ly: str, rx: str, ry: str, radius: float, square: bool = False) -> DataFrame:
    """Pairs with equal keys whose distance is at most `radius` (in each axis, if square).

    Both sides are cut into cells of that size; the right side goes to the nine cells around its own,
    so the distance condition becomes an equality join with a residual."""
    cell = lambda c: F.floor(F.col(c) / F.lit(radius))
    near = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    a = left.withColumn("_cx", cell(lx)).withColumn("_cy", cell(ly))
    b = right.withColumn("_cx", F.explode(F.transform(near, lambda k: cell(rx) + k))).withColumn("_cy", F.explode(F.transform(near, lambda k: cell(ry) + k)))
    dx, dy = F.col(lx) - F.col(rx), F.col(ly) - F.col(ry)
    ok = (F.abs(dx) <= radius) & (F.abs(dy) <= radius) if square else dx * dx + dy * dy <= radius * radius
    return a.join(b, [*keys, "_cx", "_cy"]).where(ok).drop("_cx", "_cy")


def best_of(pairs: DataFrame, keys: Sequence[str], by: Sequence[Column | str]) -> DataFrame:
    """The first row of every key in the order `by`."""
    w = Window.partitionBy(*keys).orderBy(*by)
    return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def rank_pairs(x: DataFrame, y: DataFrame, keys: Sequence[str], order_x: Sequence[Column | str], order_y: Sequence[Column | str]) -> DataFrame:
    """Rows of equal rank on both sides."""
    ranked = lambda d, o: d.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*o)).cast("bigint"))
    return ranked(x, order_x).join(ranked(y, order_y), [*keys, "rank"])


def runs_of(df: DataFrame, keys: Sequence[str], position: str, gap: int = 1) -> DataFrame:
    """Add `run`, the number of the group of neighbouring positions (a step over `gap` starts the next)."""
    w = Window.partitionBy(*keys).orderBy(position)
    new = F.coalesce((F.col(position) - F.lag(position).over(w) > gap).cast("bigint"), F.lit(0))
    return df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def greedy_pairs(candidates: DataFrame, event: str, left: str, right: str, priority: str, distance: str) -> DataFrame:
    """Exclusive assignment inside an event: left objects in falling `priority` (then rising id) each
    take their nearest right object that is still free (ties: the smaller id).

    candidates has a row per possible pair; an event's candidates are few and one task holds them."""
    spec = candidates.select(event, left, right, priority, distance)

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf.sort_values([priority, left, distance, right], ascending=[False, True, True, True], kind="stable")
        used: set = set()
        done: set = set()
        keep = []
        for i, a, b in zip(order.index, order[left], order[right], strict=True):
            if a not in done and b not in used:
                done.add(a)
                used.add(b)
                keep.append(i)
        return order.loc[keep]

    return spec.groupBy(event).applyInPandas(assign, spec.schema)


def greedy_plane_pairs(candidates: DataFrame, event: str, left: str, plane: str, right: str, priority: str, distance: str, pairs: Sequence[Sequence[int]]) -> DataFrame:
    """Exclusive matches through pairs of detector planes: left objects in falling `priority` (then rising
    id) need a free candidate in some plane of every pair; of each pair they take the nearest one (ties:
    the plane that stands first, then the smaller id). Rows: event, left, pair number, plane, right.

    candidates has a row per possible match; an event's candidates are few and one task holds them."""
    spec = candidates.select(event, left, F.col(plane).cast("int").alias(plane), right, priority, distance)
    place = {p: (n, k) for n, pair in enumerate(pairs) for k, p in enumerate(pair)}
    schema = StructType([spec.schema[event], spec.schema[left], StructField("pair", IntegerType()), spec.schema[plane], spec.schema[right]])

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set = set()
        out = []
        for (_, a), own in sorted(pdf.groupby([priority, left]), key=lambda g: (-g[0][0], g[0][1])):
            free = [(d, *place[p][::-1], p, b) for p, b, d in zip(own[plane], own[right], own[distance], strict=True) if p in place and (p, b) not in used]
            best = [min((f for f in free if f[2] == n), key=lambda f: (f[0], f[1], f[4]), default=None) for n in range(len(pairs))]
            if all(best):
                used |= {(f[3], f[4]) for f in best}
                out += [(own[event].iloc[0], a, n, f[3], f[4]) for n, f in enumerate(best)]
        return pd.DataFrame(out, columns=schema.names)

    return spec.groupBy(event).applyInPandas(assign, schema)


def _dealt(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An equality join that deals out both sides and sorts them. Compressed files look small enough to be
    sent whole to every task, also where rows are multiplied before they meet."""
    return left.join(right.hint("merge"), list(keys))


def quantised_neighbours(modules: DataFrame, reach: float = 1.01, digits: int | None = None) -> DataFrame:
    """Edges (id, near, dx, dy) between modules (id, sector, x, y, sx, sy) of any sectors whose distance, in
    modules, is at most `reach` in both axes.

    Within a sector a module's own size is the unit. Across sectors the way is measured in the first
    module's size up to the border half-way, and in the other's beyond it, that is by the mean of both
    sizes. Modules of one sector, place and size are of a kind. Kinds meet first, in cells of the largest
    module's size that make it an equality join; a pair of kinds then meets lists of at most about `LISTED` of
    the ids of each. Lists are what is dealt out, evenly; pairs of modules are made last, where they leave, so
    no task holds more than two lists, however many modules share a place. `digits` rounds dx and dy, once a
    pair of kinds."""
    kind = F.struct("sector", "x", "y", "sx", "sy")
    kinds = modules.select("sector", "x", "y", "sx", "sy").distinct()
    size = kinds.agg(F.max(F.greatest("sx", "sy")).alias("_size"))
    m = kinds.withColumn("_own", kind).join(F.broadcast(size), F.lit(True))  # of one row
    cell = lambda v, k=0: F.floor(F.col(v) / (F.col("_size") * reach)) + k
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = m.withColumn("_s", F.explode(near)).withColumn("_cx", cell("x") + F.col("_s.i")).withColumn("_cy", cell("y") + F.col("_s.j"))
    b = m.select(F.col("_own").alias("_near"), F.col("sector").alias("_sector"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("sx").alias("_sx"), F.col("sy").alias("_sy"), cell("x").alias("_cx"), cell("y").alias("_cy"))
    unit = lambda own, other: F.when(F.col("sector") == F.col("_sector"), F.col(own)).otherwise((F.col(own) + F.col(other)) / 2)
    x = _dealt(a, b, ["_cx", "_cy"])
    x = x.select("_own", "_near", ((F.col("_x") - F.col("x")) / unit("sx", "_sx")).alias("dx"), ((F.col("_y") - F.col("y")) / unit("sy", "_sy")).alias("dy"))
    x = x.where((F.abs("dx") <= reach) & (F.abs("dy") <= reach))
    if digits is not None:
        x = x.withColumn("dx", F.round("dx", digits)).withColumn("dy", F.round("dy", digits))
    ids = modules.where("id IS NOT NULL").select("id", kind.alias("_own"))
    lists = F.ceil(F.col("_n") / LISTED)
    ids = _dealt(ids, ids.groupBy("_own").agg(F.count(F.lit(1)).alias("_n")), ["_own"])
    ids = ids.groupBy("_own", F.pmod(F.xxhash64("id"), lists).alias("_list")).agg(F.collect_list("id").alias("_ids"))
    x = _dealt(x, ids, ["_own"])
    x = _dealt(x, ids.select(F.col("_own").alias("_near"), F.col("_list").alias("_near_list"), F.col("_ids").alias("_near_ids")), ["_near"])
    tasks = spread_over(modules)
    x = x.repartition(tasks, "_own", "_near", "_list", "_near_list").select(F.explode("_ids").alias("id"), "_near_ids", "dx", "dy")
    # as many partitions as there are: it ends Spark's piece of code, which would hold all pairs of two lists
    return x.coalesce(tasks).select("id", F.explode("_near_ids").alias("near"), "dx", "dy").where("id <> near")


def share_inside(x: Column, y: Column, dx: Column, dy: Column, box: tuple[Column, Column, Column, Column]) -> Column:
    """Share of the way from (x, y) by (dx, dy) that lies inside the rectangle (x1, x2, y1, y2)."""
    far = F.lit(float("inf"))

    def span(p: Column, d: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
        """Where on the way the slab is entered and left."""
        a, b = (lo - p) / F.nullif(d, F.lit(0.0)), (hi - p) / F.nullif(d, F.lit(0.0))
        inside = (p >= lo) & (p <= hi)
        return F.coalesce(F.least(a, b), F.when(inside, -far).otherwise(far)), F.coalesce(F.greatest(a, b), F.when(inside, far).otherwise(-far))

    (ax, bx), (ay, by) = span(x, dx, box[0], box[1]), span(y, dy, box[2], box[3])
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), bx, by) - F.greatest(F.lit(0.0), ax, ay))


def border_neighbours(modules: DataFrame, centre: str | int, keys: Sequence[str] = (), reach: float = 1.01) -> DataFrame:
    """Edges (keys, id, near, dx, dy) between modules (keys, id, sector, x, y, sx, sy) around a central sector,
    whose distance, in modules, is at most `reach` in both axes.

    The way between two centres is cut where it crosses the central sector's border (the rectangle around
    its modules): inside, it is measured in that sector's modules, outside in those of the sector that it
    leaves or reaches; a way between two outer sectors in those of the first. Within a sector, and between
    outer sectors past the centre, the own module is the unit. Modules of a sector are of one size."""
    mid = F.col("sector") == F.lit(centre)
    lo = lambda v, s: F.min(F.when(mid, F.col(v) - F.col(s) / 2))
    hi = lambda v, s: F.max(F.when(mid, F.col(v) + F.col(s) / 2))
    border = modules.agg(lo("x", "sx").alias("_x1"), hi("x", "sx").alias("_x2"), lo("y", "sy").alias("_y1"), hi("y", "sy").alias("_y2"), F.max(F.when(mid, F.col("sx"))).alias("_mx"), F.max(F.when(mid, F.col("sy"))).alias("_my"), F.max(F.greatest("sx", "sy")).alias("_size"))
    m = modules.join(F.broadcast(border), F.lit(True))  # of one row
    cell = lambda v, k=0: F.floor(F.col(v) / (F.col("_size") * reach)) + k
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = m.withColumn("_s", F.explode(around)).withColumn("_cx", cell("x") + F.col("_s.i")).withColumn("_cy", cell("y") + F.col("_s.j"))
    theirs = [F.col(n).alias(f"_{n}") for n in ("sector", "x", "y", "sx", "sy")]
    x = _dealt(a, m.select(*keys, F.col("id").alias("near"), *theirs, cell("x").alias("_cx"), cell("y").alias("_cy")), [*keys, "_cx", "_cy"]).where("id <> near")
    dx, dy = F.col("_x") - F.col("x"), F.col("_y") - F.col("y")
    share = share_inside(F.col("x"), F.col("y"), dx, dy, tuple(F.col(n) for n in ("_x1", "_x2", "_y1", "_y2")))

    def units(own: str, other: str, middle: str) -> Column:
        outer = F.when(mid, F.col(other)).otherwise(F.col(own))
        across = F.coalesce(share / F.col(middle), F.lit(0.0)) + (1 - F.coalesce(share, F.lit(0.0))) / outer
        return F.when(F.col("sector") == F.col("_sector"), 1 / F.col(own)).otherwise(across)

    x = x.select(*keys, "id", "near", (dx * units("sx", "_sx", "_mx")).alias("dx"), (dy * units("sy", "_sy", "_my")).alias("dy"))
    return x.where((F.abs("dx") <= reach) & (F.abs("dy") <= reach))


def line_vertex(df: DataFrame, keys: Sequence[str], order: str, x: str, y: str, least: float = 0.0) -> DataFrame:
    """Where the line through rows 1 and 2 meets that through rows 3 and 4, and so on in steps of two;
    lines whose determinant is at most `least` (parallel ones) are left out."""
    w = Window.partitionBy(*keys).orderBy(order)
    nxt = lambda c: F.lead(c).over(w)
    p = df.withColumn("x2", nxt(x)).withColumn("y2", nxt(y)).withColumn("x3", F.lead(x, 2).over(w)).withColumn("y3", F.lead(y, 2).over(w)).withColumn("x4", F.lead(x, 3).over(w)).withColumn("y4", F.lead(y, 3).over(w))
    p = p.withColumn("_k", F.row_number().over(w)).where("_k % 2 = 1 AND x4 IS NOT NULL")
    c = lambda n: F.col(n)
    det = (c(x) - c("x2")) * (c("y3") - c("y4")) - (c(y) - c("y2")) * (c("x3") - c("x4"))
    a, b = c(x) * c("y2") - c(y) * c("x2"), c("x3") * c("y4") - c("y3") * c("x4")
    p = p.where(F.abs(det) > least)
    vx = (a * (c("x3") - c("x4")) - (c(x) - c("x2")) * b) / det
    vy = (a * (c("y3") - c("y4")) - (c(y) - c("y2")) * b) / det
    return p.select(*keys, order, vx.alias("vx"), vy.alias("vy"))


def point_in_rectangle(points: DataFrame, modules: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """points joined to the module (id, mx, my, sx, sy) whose rectangle holds them; borders belong to the
    module above them. Cells of `size`, the largest module side, make it an equality join."""
    cell = lambda v: F.floor(v / F.lit(size))
    span = lambda m, s: F.sequence(cell(F.col(m) - F.col(s) / 2), cell(F.col(m) + F.col(s) / 2))
    m = modules.withColumn("_cx", F.explode(span("mx", "sx"))).withColumn("_cy", F.explode(span("my", "sy")))
    p = points.withColumn("_cx", cell(F.col(x))).withColumn("_cy", cell(F.col(y)))
    inside = lambda v, c, s: (F.col(v) >= F.col(c) - F.col(s) / 2) & (F.col(v) < F.col(c) + F.col(s) / 2)
    return p.join(m, ["_cx", "_cy"]).where(inside(x, "mx", "sx") & inside(y, "my", "sy")).drop("_cx", "_cy")


def grid_neighbours(modules: DataFrame, corners: bool = False) -> DataFrame:
    """Edges (id, near) between modules of one sector in neighbouring rows and columns."""
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (corners or not (i and j))]
    m = modules.select("id", "sector", "row", "col")
    shifted = m.withColumn("s", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])))
    asked = shifted.select("id", "sector", (F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"))
    return _dealt(asked, m.withColumnRenamed("id", "near"), ["sector", "row", "col"]).select("id", "near")


def local_maxima(hits: DataFrame, keys: Sequence[str], x: str, y: str, energy: str, least: float, strict: bool = False) -> DataFrame:
    """Hits over `least` without a neighbour (corners included) of more energy, or of as much, if strict."""
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    n = hits.select(*keys, F.explode(near).alias("s"), x, y, F.col(energy).alias("_e"))
    around = n.groupBy(*keys, (F.col(x) + F.col("s.i")).alias(x), (F.col(y) + F.col("s.j")).alias(y)).agg(F.max("_e").alias("_e"))
    beaten = F.col("_e") >= F.col(energy) if strict else F.col("_e") > F.col(energy)
    return hits.where(F.col(energy) >= least).join(around, [*keys, x, y], "left").where(F.col("_e").isNull() | ~beaten).drop("_e")


def xy_pairs(x: DataFrame, y: DataFrame, keys: Sequence[str], asymmetry: float, window: float) -> DataFrame:
    """All pairs of an event's x and y clusters (charge q*, time t*) within the cuts."""
    a = F.abs(F.col("qx") - F.col("qy")) / (F.col("qx") + F.col("qy"))
    return x.join(y, list(keys)).where((a <= asymmetry) & (F.abs(F.col("tx") - F.col("ty")) <= window)).withColumn("asymmetry", a)


def rotation(ax: float, ay: float, az: float) -> np.ndarray:
    """Rz Ry Rx for angles in degrees."""
    a, b, c = np.radians([ax, ay, az])
    rx = np.array([[1, 0, 0], [0, np.cos(a), -np.sin(a)], [0, np.sin(a), np.cos(a)]])
    ry = np.array([[np.cos(b), 0, np.sin(b)], [0, 1, 0], [-np.sin(b), 0, np.cos(b)]])
    rz = np.array([[np.cos(c), -np.sin(c), 0], [np.sin(c), np.cos(c), 0], [0, 0, 1]])
    return rz @ ry @ rx


def to_lab(x: Column, y: Column, z: Column, matrix: np.ndarray, shift: Sequence[float]) -> list[Column]:
    m = matrix.tolist()
    return [m[i][0] * x + m[i][1] * y + m[i][2] * z + shift[i] for i in range(3)]


def to_local(x: Column, y: Column, z: Column, matrix: np.ndarray, shift: Sequence[float]) -> list[Column]:
    m = matrix.T.tolist()
    d = [x - shift[0], y - shift[1], z - shift[2]]
    return [m[i][0] * d[0] + m[i][1] * d[1] + m[i][2] * d[2] for i in range(3)]


def project(x: Column, y: Column, z: Column, plane: float) -> list[Column]:
    """Position on a plane across the beam of the ray from the origin; null at z = 0."""
    s = F.lit(plane) / F.nullif(z, F.lit(0.0))
    return [x * s, y * s]


def island_labels(hits: DataFrame, keys: Sequence[str], x: str, y: str, corners: bool = False) -> DataFrame:
    """keys, x, y, island_x, island_y: each cell that is hit, with the least cell that it is connected to.

    Every cell takes the least label of its neighbours, then the label of the cell that its label names, so
    labels run over an island in few rounds. Rounds are joins on cells, each stored; they end when nothing
    changes, and no island or event has to fit in a task. Hits whose key is null are not connected."""
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (corners or not (i and j))]
    cells = stored(hits.select(*keys, F.col(x).alias("x"), F.col(y).alias("y")).distinct(), "cells")
    beside = cells.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])))
    beside = beside.select(*keys, "x", "y", (F.col("x") + F.col("_s.i")).alias("nx"), (F.col("y") + F.col("_s.j")).alias("ny"))
    named = lambda d, a, b, label: d.select(*keys, F.col("x").alias(a), F.col("y").alias(b), F.col("label").alias(label))
    edges = stored(beside.join(cells.select(*keys, F.col("x").alias("nx"), F.col("y").alias("ny")), [*keys, "nx", "ny"]), "cell-edges")
    cur = cells.withColumn("label", F.struct("x", "y"))
    while True:
        # a cell's own label, those of its neighbours, and the one of the cell that its label names
        own = cur.select(*keys, "x", "y", "label", F.col("label").alias("_was"))
        none = F.lit(None).cast(cur.schema["label"].dataType).alias("_was")
        beside = edges.join(named(cur, "nx", "ny", "_label"), [*keys, "nx", "ny"]).select(*keys, "x", "y", F.col("_label").alias("label"), none)
        named_by = cur.select(*keys, "x", "y", F.col("label.x").alias("tx"), F.col("label.y").alias("ty"))
        far = named_by.join(named(cur, "tx", "ty", "_far"), [*keys, "tx", "ty"]).select(*keys, "x", "y", F.col("_far").alias("label"), none)
        met = own.unionByName(beside).unionByName(far).groupBy(*keys, "x", "y")
        cur = stored(met.agg(F.min("label").alias("label"), F.max("_was").alias("_was")), "labels")
        if cur.where("label <> _was").isEmpty():
            return cur.select(*keys, "x", "y", F.col("label.x").alias("island_x"), F.col("label.y").alias("island_y"))
        cur = cur.drop("_was")
