"""Tracking efficiency, spectrum edges, stamped slow rows and time cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beamframe.operators import counting as C
from beamframe.operators import fits
from beamframe.operators import ordered as O
from beamframe.operators import tracking as K
from beamframe.plans.counting import peaks
from beamframe.plans.registry import query, table
from beamframe.plans.scratch import stored

BLOCK = 1 << 20
_HITS = "h AS (SELECT vec_id, unnest(range(1, 5)) AS plane, unnest(embedding[1:4]::DOUBLE[]) * 10 AS x FROM embeddings)"


@query(f"""WITH {_HITS}, f AS (SELECT t.plane AS plane, t.vec_id, any_value(t.x) AS x, regr_slope(o.x, o.plane) AS b, regr_intercept(o.x, o.plane) AS a, regr_syy(o.x, o.plane) * (1 - regr_r2(o.x, o.plane)) AS chi2
FROM h t JOIN h o ON t.vec_id = o.vec_id AND t.plane <> o.plane GROUP BY t.plane, t.vec_id), r AS (SELECT plane, x - (a + b * plane) AS res, chi2 FROM f WHERE chi2 <= 1.5)
SELECT plane, count(*) AS den, count(*) FILTER (abs(res) < 2) AS num, round(100.0 * count(*) FILTER (abs(res) < 2) / count(*), 6) AS efficiency, round(avg(res), 6) AS mean_residual FROM r GROUP BY plane""")
def leave_one_out_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each plane's share of hits near the track that the other planes make, for good tracks."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.slice(F.col("embedding").cast("array<double>"), 1, 4)).alias("p", "x"))
    h = e.select("vec_id", (F.col("p") + 1).cast("bigint").alias("plane"), (F.col("x") * 10).alias("x"))
    target = h.select("vec_id", F.col("plane").alias("target"), F.col("x").alias("tx"))
    pairs = target.join(h, "vec_id").where("plane <> target").withColumn("w", F.lit(1.0))
    line = C.weighted_line(pairs, "plane", "x", "w", ["vec_id", "target", "tx"]).where("chi2_dof <= 1.5")
    res = line.select(F.col("target").alias("plane"), (F.col("tx") - F.col("a") - F.col("b") * F.col("target")).alias("res"))
    den, num = F.count(F.lit(1)), F.count_if(F.abs("res") < 2)
    return res.groupBy("plane").agg(den.alias("den"), num.alias("num"), F.round(100.0 * num / den, 6).alias("efficiency"), F.round(F.avg("res"), 6).alias("mean_residual"))


@query("""WITH h AS (SELECT l_linenumber::BIGINT AS channel, floor(l_extendedprice / 2000)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY ALL), s AS (SELECT channel, bin, avg(n) OVER (PARTITION BY channel ORDER BY bin RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM h),
b AS (SELECT *, v >= 0.05 * max(v) OVER (PARTITION BY channel) AS body FROM s), g AS (SELECT *, sum(ln(1 + v)) OVER (PARTITION BY channel ORDER BY bin DESC) / sum(ln(1 + v)) OVER (PARTITION BY channel) AS c FROM b WHERE body)
SELECT channel, max(bin) FILTER (c >= 0.05) AS edge, max(bin) AS last FROM g GROUP BY channel""")
def spectrum_right_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right edge of every channel's spectrum: smoothed, cut to its body, 5 % of the log counts from the right."""
    h = C.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 0.0, 2000.0, 1 << 30, [F.col("l_linenumber").cast("bigint").alias("channel")])
    w = Window.partitionBy("channel")
    s = h.select("channel", "bin", F.avg("n_rows").over(w.orderBy("bin").rangeBetween(-2, 2)).alias("v"))
    b = s.withColumn("most", F.max("v").over(w)).where("v >= 0.05 * most").withColumn("l", F.log1p("v"))
    c = F.sum("l").over(w.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)) / F.sum("l").over(w)
    return b.withColumn("c", c).groupBy("channel").agg(F.max(F.when(F.col("c") >= 0.05, F.col("bin"))).alias("edge"), F.max("bin").alias("last"))


@query("""SELECT s.event_id, s.event_type, coalesce(p.at, -1) AS last_physics, coalesce(p.us, -1) AS us FROM (SELECT * FROM events WHERE event_type IN ('error', 'signup')) s
ASOF LEFT JOIN (SELECT event_id AS at, epoch_us(ts) AS us FROM events WHERE event_type = 'click') p ON s.event_id >= p.at""")
def stamped_slow_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slow rows with the number and tick of the last physics event before them, -1 if there is none."""
    e = table(spark, sf_dir, "events")
    p = e.where("event_type = 'click'").select(F.col("event_id").alias("at"), F.col("event_id").alias("last"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    out = O.as_of(e.where(F.col("event_type").isin("error", "signup")).select("event_id", "event_type"), p, "event_id", "at", ["last", "us"], block=BLOCK)
    return out.select("event_id", "event_type", F.coalesce("last", F.lit(-1)).alias("last_physics"), F.coalesce("us", F.lit(-1)).alias("us"))


@query()
def two_phase_time_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Gaussian on the time difference of channel pairs, then the pairs within three sigma of it."""
    p = peaks(spark, sf_dir)
    first = p.groupBy("event", "channel").agg(F.min("time").alias("t"))
    pair = first.where("channel = 1").select("event", F.col("t").alias("t1")).join(first.where("channel > 1"), "event").select("event", "channel", (F.col("t1") - F.col("t")).alias("dt"))
    fit = fits.fit_peaks(C.histogram(pair, "dt", -50.0, 2.0, 50, ["channel"]), ["channel"], -50.0, 2.0).select("channel", "mean", "sigma")
    kept = pair.join(fit, "channel").where(F.abs(F.col("dt") - F.col("mean")) <= 3 * F.col("sigma"))
    return kept.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.round(F.first("mean"), 4).alias("mean"), F.round(F.first("sigma"), 4).alias("sigma"))


def tracks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Calorimeter clusters (every 16th vector) and hits of four planes that scatter around the way to the
    cluster of their group; events of 64 vectors."""
    at = lambda i, k: F.get("embedding", F.lit(i)).cast("double") * k
    e = table(spark, sf_dir, "embeddings")
    event, group = F.floor(F.col("vec_id") / 64).alias("event"), F.floor(F.col("vec_id") / 16).alias("cluster")
    c = e.where("vec_id % 16 = 0").select(event, group, at(0, 900.0).alias("x"), at(1, 900.0).alias("y"), F.lit(6000.0).alias("z"), F.lit(3.0).alias("sigma"))
    z = 4000.0 + 500.0 * F.col("plane")
    h = e.where("vec_id % 16 > 0").select(event, group, (F.col("vec_id") % 4).alias("plane"), F.col("vec_id").alias("hit"), at(2, 9.0).alias("ex"), at(3, 9.0).alias("ey"))
    h = h.join(c.select("cluster", "x", "y"), "cluster")
    return c, h.select("event", "plane", "hit", (F.col("x") * z / 6000 + F.col("ex")).alias("x"), (F.col("y") * z / 6000 + F.col("ey")).alias("y"))


PLANES = tuple((p, 4000.0 + 500.0 * p, 0.8) for p in range(4))


def _efficiency(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    c, h = tracks(spark, sf_dir)
    found = K.efficiency(K.leave_one_out(c, h, "event", K.TrackConfig(PLANES, mode=mode)))
    return found.select("test", "den", "num", *[F.round(n, 6).alias(n) for n in ("efficiency", "dx", "dy")])


_FIT = """s AS (SELECT *, list_sum(list_transform(pts, lambda p: p.w)) AS sw, list_sum(list_transform(pts, lambda p: p.w * p.z)) AS sz, list_sum(list_transform(pts, lambda p: p.w * p.z * p.z)) AS szz, list_sum(list_transform(pts, lambda p: p.w * p.x)) AS sx, list_sum(list_transform(pts, lambda p: p.w * p.y)) AS sy,
  list_sum(list_transform(pts, lambda p: p.w * p.z * p.x)) AS szx, list_sum(list_transform(pts, lambda p: p.w * p.z * p.y)) AS szy FROM q),
l AS (SELECT *, (sw * szx - sz * sx) / (sw * szz - sz * sz) AS bx, (sw * szy - sz * sy) / (sw * szz - sz * sz) AS by_ FROM s), a AS (SELECT *, (sx - bx * sz) / sw AS ax, (sy - by_ * sz) / sw AS ay FROM l),
r AS (SELECT *, list_sum(list_transform(pts, lambda p: p.w * ((ax + bx * p.z - p.x) ** 2 + (ay + by_ * p.z - p.y) ** 2))) / (2 * len(pts) - 4) AS chi2, list_bool_and(list_transform(pts[2:], lambda p: p.w * ((ax + bx * p.z - p.x) ** 2 + (ay + by_ * p.z - p.y) ** 2) <= 9)) AS near FROM a)"""
_TRACKS = """e AS (SELECT vec_id, vec_id // 64 AS event, vec_id // 16 AS cluster, embedding[1]::DOUBLE * 900 AS ex, embedding[2]::DOUBLE * 900 AS ey, embedding[3]::DOUBLE * 9 AS hx, embedding[4]::DOUBLE * 9 AS hy FROM embeddings),
c AS (SELECT event, cluster, ex AS cx, ey AS cy FROM e WHERE vec_id % 16 = 0),
h AS (SELECT e.event, vec_id AS hit, vec_id % 4 AS plane, cx * (4000 + 500 * (vec_id % 4)) / 6000 + hx AS x, cy * (4000 + 500 * (vec_id % 4)) / 6000 + hy AS y, 4000.0 + 500 * (vec_id % 4) AS z FROM e JOIN c USING (cluster) WHERE vec_id % 16 > 0)"""


@query(f"""WITH {_TRACKS}, n AS (SELECT c.event, c.cluster, cx, cy, t.test, h.plane, h.hit, h.x, h.y, h.z, (h.x - cx * h.z / 6000) ** 2 + (h.y - cy * h.z / 6000) ** 2 AS d2 FROM c JOIN h ON h.event = c.event JOIN (VALUES (0), (1), (2), (3)) t(test) ON t.test <> h.plane
  WHERE (h.x - cx * h.z / 6000) ** 2 + (h.y - cy * h.z / 6000) ** 2 < 9 * ((3 * h.z / 6000) ** 2 + 0.64)),
k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY event, cluster, test, plane ORDER BY d2, hit) = 1),
q AS (SELECT event, cluster, test, list_prepend({{'z': 6000.0::DOUBLE, 'x': any_value(cx), 'y': any_value(cy), 'w': (1 / 9.0)::DOUBLE}}, list({{'z': z::DOUBLE, 'x': x, 'y': y, 'w': (1 / 0.64)::DOUBLE}} ORDER BY plane)) AS pts FROM k GROUP BY event, cluster, test HAVING count(*) = 3), {_FIT},
o AS (SELECT event, cluster, test, ax + bx * (4000 + 500 * test) AS px, ay + by_ * (4000 + 500 * test) AS py FROM r WHERE chi2 <= 3.5 AND near),
f AS (SELECT o.event, o.cluster, o.test, arg_min({{'dx': x - px, 'dy': y - py}}, {{'r': (x - px) ** 2 + (y - py) ** 2, 'h': hit}}) AS d FROM o JOIN h ON h.event = o.event AND h.plane = o.test WHERE (x - px) ** 2 + (y - py) ** 2 < 9 * 0.64 GROUP BY 1, 2, 3)
SELECT test, count(*) AS den, count(d) AS num, round(100.0 * count(d) / count(*), 6) AS efficiency, round(avg(d.dx), 6) AS dx, round(avg(d.dy), 6) AS dy FROM o LEFT JOIN f USING (event, cluster, test) GROUP BY test""")
def target_seed_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes' efficiencies by tracks from the target (tested by brute force)."""
    return _efficiency(spark, sf_dir, K.TARGET_SEED)


@query()
def hit_seed_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes' efficiencies by the best of all tracks that hits seed, with the target in the fit."""
    return _efficiency(spark, sf_dir, K.HIT_SEED_WITH_TARGET)


@query()
def plane_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of the planes from the residuals of tracks, three rounds."""
    c, h = tracks(spark, sf_dir)
    moved = h.withColumn("x", F.col("x") + 0.3 * F.col("plane"))
    s = K.calibrate_planes(c, moved, "event", K.TrackConfig(PLANES), store=stored)
    return s.select("plane", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


_FOUR = ", ".join(f"p{k} AS (SELECT event, hit, x, y FROM h WHERE plane = {k} UNION ALL SELECT DISTINCT event, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE FROM h)" for k in range(4))
_POINTS = "[{'z': 6000.0, 'x': cx, 'y': cy, 'w': 1 / 9.0}, " + ", ".join(f"{{'z': {4000.0 + 500 * k}, 'x': x{k}, 'y': y{k}, 'w': 1 / 0.64}}" for k in range(4)) + "]"


@query(f"""WITH {_TRACKS}, {_FOUR},
m AS (SELECT c.event, c.cluster, cx, cy, {", ".join(f"p{k}.hit AS h{k}, p{k}.x AS x{k}, p{k}.y AS y{k}" for k in range(4))} FROM c JOIN p0 ON p0.event = c.event JOIN p1 ON p1.event = c.event JOIN p2 ON p2.event = c.event JOIN p3 ON p3.event = c.event
  WHERE (p0.hit IS NOT NULL)::INT + (p1.hit IS NOT NULL)::INT + (p2.hit IS NOT NULL)::INT + (p3.hit IS NOT NULL)::INT >= 3),
q AS (SELECT *, list_filter({_POINTS}, lambda p: p.x IS NOT NULL) AS pts FROM m),
{_FIT}
SELECT event, cluster, round(chi2, 6) AS chi2_dof, (len(pts) - 1)::BIGINT AS n_planes, h0, h1, h2, h3 FROM r WHERE chi2 <= 3.5 AND near QUALIFY row_number() OVER (PARTITION BY event, cluster ORDER BY chi2) = 1""")
def combination_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cluster's best track of all combinations of hits of three or four planes, without a seed."""
    c, h = tracks(spark, sf_dir)
    t = K.combined_tracks(c, h, "event", K.TrackConfig(PLANES))
    hit = lambda k: F.get(F.transform(F.filter("hits", lambda q: q.plane == k), lambda q: q.hit), F.lit(0)).alias(f"h{k}")
    return t.select("event", "cluster", F.round("chi2_dof", 6).alias("chi2_dof"), F.col("n_planes").cast("bigint").alias("n_planes"), *[hit(k) for k in range(4)])


@query()
def unbiased_plane_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes' efficiencies by the best combination of the other planes' hits (tested by nested loops)."""
    c, h = tracks(spark, sf_dir)
    found = K.unbiased_efficiency(c, h, "event", K.TrackConfig(PLANES))
    return found.select("test", "den", "num", F.round("efficiency", 6).alias("efficiency"))
