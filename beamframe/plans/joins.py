"""Matching and reconstruction queries. Grid hits stand for detector modules: column p_size, row
p_partkey % 34, energy p_retailprice; lineitem rows for time stamps; embeddings for positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beamframe.operators import counting as C
from beamframe.operators import matching as M
from beamframe.operators import ordered as O
from beamframe.plans.counting import peaks
from beamframe.plans.registry import query, table

_P = "p AS (SELECT l_orderkey AS event, l_linenumber::BIGINT AS channel, l_quantity AS time, l_extendedprice AS integral, l_discount AS quality FROM lineitem)"
_H = "h AS (SELECT p_brand AS event, p_size::BIGINT AS x, p_partkey % 34 AS y, max(p_retailprice) AS e FROM part GROUP BY ALL)"
_XY = "v AS (SELECT vec_id, label, round(embedding[1]::DOUBLE * 100, 3) AS x, round(embedding[2]::DOUBLE * 100, 3) AS y FROM embeddings), a AS (SELECT * FROM v WHERE vec_id % 2 = 0), b AS (SELECT label, vec_id AS hit, x AS hx, y AS hy FROM v WHERE vec_id % 2 = 1)"


def grid_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.groupBy(F.col("p_brand").alias("event"), F.col("p_size").cast("bigint").alias("x"), (F.col("p_partkey") % 34).alias("y")).agg(F.max("p_retailprice").alias("e"))


def positions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Clusters (even ids) and tracker hits (odd ids) with a position, by event (label)."""
    at = lambda i: F.round(F.get("embedding", F.lit(i)).cast("double") * 100, 3)
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", at(0).alias("x"), at(1).alias("y"))
    return v.where("vec_id % 2 = 0"), v.where("vec_id % 2 = 1").select("label", F.col("vec_id").alias("hit"), F.col("x").alias("hx"), F.col("y").alias("hy"))


@query(f"WITH {_P}, f AS (SELECT event, channel, min(time) AS t FROM p GROUP BY ALL) SELECT a.event, a.t AS t1, b.t AS t2, a.t - b.t AS dt FROM f a JOIN f b USING (event) WHERE a.channel = 1 AND b.channel = 2")
def time_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earliest hit of two channels in an event, and the difference."""
    first = peaks(spark, sf_dir).where("channel IN (1, 2)").groupBy("event").agg(F.min(F.when(F.col("channel") == 1, F.col("time"))).alias("t1"), F.min(F.when(F.col("channel") == 2, F.col("time"))).alias("t2"))
    return first.where("t1 IS NOT NULL AND t2 IS NOT NULL").select("event", "t1", "t2", (F.col("t1") - F.col("t2")).alias("dt"))


@query(f"WITH {_P} SELECT event, channel, min(time) AS time, arg_min(integral, (time, integral)) AS integral FROM p GROUP BY ALL")
def earliest_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hit of every channel in an event."""
    first = F.min(F.struct("time", "integral"))
    return peaks(spark, sf_dir).groupBy("event", "channel").agg(first.alias("m")).select("event", "channel", "m.time", "m.integral")


@query(f"WITH {_XY} SELECT a.vec_id, b.hit FROM a JOIN b USING (label) WHERE (a.x - b.hx)**2 + (a.y - b.hy)**2 <= 9")
def spatial_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = positions(spark, sf_dir)
    return M.spatial_pairs(a, b, ["label"], "x", "y", "hx", "hy", 3.0).select("vec_id", "hit")


@query(f"WITH {_XY} SELECT vec_id, hit FROM a JOIN b USING (label) WHERE abs(x - hx) <= 3 AND abs(y - hy) <= 3 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round((x - hx)**2 + (y - hy)**2, 6), hit) = 1")
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest tracker hit of a cluster in a square window."""
    a, b = positions(spark, sf_dir)
    pairs = M.spatial_pairs(a, b, ["label"], "x", "y", "hx", "hy", 3.0, square=True)
    dx, dy = F.col("x") - F.col("hx"), F.col("y") - F.col("hy")
    return M.best_of(pairs, ["vec_id"], [F.round(dx * dx + dy * dy, 6), "hit"]).select("vec_id", "hit")


_EVENT = "v AS (SELECT vec_id, vec_id // 64 AS event, round(embedding[1]::DOUBLE * 100, 3) AS x, round(embedding[2]::DOUBLE * 100, 3) AS y FROM embeddings)"


def event_positions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Clusters (even ids) and tracker hits (odd ids) of events of 64 objects."""
    a, b = positions(spark, sf_dir)
    return a.select(F.floor(F.col("vec_id") / 64).alias("event"), "vec_id", "x", "y"), b.select(F.floor(F.col("hit") / 64).alias("event"), "hit", "hx", "hy")


@query(f"""WITH RECURSIVE {_EVENT}, p AS (SELECT a.event, a.vec_id, b.vec_id AS hit, round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), 6) AS d, a.x AS w FROM v a JOIN v b ON a.event = b.event AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 100),
t AS (SELECT event, vec_id, list(hit ORDER BY d, hit) AS hits, row_number() OVER (PARTITION BY event ORDER BY max(w) DESC, vec_id) AS turn FROM p GROUP BY event, vec_id),
g AS (SELECT t.event, t.turn, t.vec_id, t.hits[1] AS hit, [t.hits[1]] AS used FROM t WHERE turn = 1
UNION ALL SELECT t.event, t.turn, t.vec_id, list_filter(t.hits, lambda h: NOT list_contains(g.used, h))[1], list_append(g.used, list_filter(t.hits, lambda h: NOT list_contains(g.used, h))[1]) FROM g JOIN t ON t.event = g.event AND t.turn = g.turn + 1)
SELECT event, vec_id, hit FROM g WHERE hit IS NOT NULL""")
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusive matches inside an event, clusters of more charge first."""
    a, b = event_positions(spark, sf_dir)
    dx, dy = F.col("x") - F.col("hx"), F.col("y") - F.col("hy")
    pairs = M.spatial_pairs(a, b, ["event"], "x", "y", "hx", "hy", 10.0).withColumn("d", F.round(dx * dx + dy * dy, 6))
    return M.greedy_pairs(pairs, "event", "vec_id", "hit", "x", "d").select("event", "vec_id", "hit")


@query()
def greedy_plane_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusive matches in both pairs of four detector planes (sequential: tested by brute force)."""
    a, b = event_positions(spark, sf_dir)
    dx, dy = F.col("x") - F.col("hx"), F.col("y") - F.col("hy")
    pairs = M.spatial_pairs(a, b, ["event"], "x", "y", "hx", "hy", 15.0).withColumn("d", F.round(dx * dx + dy * dy, 6)).withColumn("plane", ((F.col("hit") - 1) / 2 % 4).cast("int"))
    return M.greedy_plane_pairs(pairs, "event", "vec_id", "plane", "hit", "x", "d", [(0, 1), (2, 3)])


@query(f"""WITH {_P}, x AS (SELECT event, integral AS qx, time AS tx FROM p WHERE channel % 2 = 1), y AS (SELECT event, integral AS qy, time AS ty FROM p WHERE channel % 2 = 0)
SELECT event, qx, qy, round(abs(qx - qy) / (qx + qy), 9) AS asymmetry FROM x JOIN y USING (event) WHERE abs(qx - qy) / (qx + qy) <= 0.3 AND abs(tx - ty) <= 15""")
def xy_cluster_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = peaks(spark, sf_dir)
    x = p.where("channel % 2 = 1").select("event", F.col("integral").alias("qx"), F.col("time").alias("tx"))
    y = p.where("channel % 2 = 0").select("event", F.col("integral").alias("qy"), F.col("time").alias("ty"))
    return M.xy_pairs(x, y, ["event"], 0.3, 15.0).select("event", "qx", "qy", F.round("asymmetry", 9).alias("asymmetry"))


@query(f"""WITH {_P}, x AS (SELECT event, integral AS qx, row_number() OVER (PARTITION BY event ORDER BY integral DESC, time) AS rank FROM p WHERE channel % 2 = 1), y AS (SELECT event, integral AS qy, row_number() OVER (PARTITION BY event ORDER BY integral DESC, time) AS rank FROM p WHERE channel % 2 = 0)
SELECT event, rank, qx, qy FROM x JOIN y USING (event, rank)""")
def rank_cluster_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x and y clusters paired by falling charge."""
    p = peaks(spark, sf_dir)
    x = p.where("channel % 2 = 1").select("event", F.col("integral").alias("qx"), F.col("time").alias("tx"))
    y = p.where("channel % 2 = 0").select("event", F.col("integral").alias("qy"), F.col("time").alias("ty"))
    return M.rank_pairs(x, y, ["event"], [F.desc("qx"), "tx"], [F.desc("qy"), "ty"]).select("event", "rank", "qx", "qy")


@query(f"WITH {_H} SELECT a.event, a.x, a.y, a.e FROM h a WHERE a.e >= 950 AND NOT EXISTS (SELECT 1 FROM h b WHERE a.event = b.event AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND b.e > a.e)")
def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.local_maxima(grid_hits(spark, sf_dir), ["event"], "x", "y", "e", 950.0).select("event", "x", "y", "e")


@query(f"WITH {_H}, m AS (SELECT a.event FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE a.event = b.event AND (a.x <> b.x OR a.y <> b.y) AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND b.e >= a.e)) SELECT event, count(*) AS n FROM m GROUP BY 1")
def strict_maxima_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.local_maxima(grid_hits(spark, sf_dir), ["event"], "x", "y", "e", 0.0, strict=True)
    return m.groupBy("event").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_H}, c AS (SELECT a.event, a.x AS cx, a.y AS cy FROM h a WHERE a.e >= 950 AND NOT EXISTS (SELECT 1 FROM h b WHERE a.event = b.event AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND b.e > a.e)),
n AS (SELECT c.event, cx, cy, h.x, h.y, e, sum(e) OVER (PARTITION BY c.event, cx, cy) AS tot FROM c JOIN h ON c.event = h.event AND abs(h.x - cx) <= 1 AND abs(h.y - cy) <= 1), w AS (SELECT *, greatest(0, 3.6 + ln(e / tot)) AS w FROM n)
SELECT event, cx, cy, count(*) AS n_blocks, round(max(tot), 4) AS energy, round(sum(w * x) / sum(w), 6) AS x, round(sum(w * y) / sum(w), 6) AS y FROM w GROUP BY 1, 2, 3""")
def log_weighted_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of 3 x 3 clusters around local maxima, weights max(0, 3.6 + ln(E / E_total))."""
    h = grid_hits(spark, sf_dir)
    c = M.local_maxima(h, ["event"], "x", "y", "e", 950.0).select("event", F.col("x").alias("cx"), F.col("y").alias("cy"))
    near = F.array(*[F.lit(k).cast("bigint") for k in (-1, 0, 1)])
    cells = c.withColumn("x", F.explode(F.transform(near, lambda k: F.col("cx") + k))).withColumn("y", F.explode(F.transform(near, lambda k: F.col("cy") + k)))
    n = cells.join(h, ["event", "x", "y"]).withColumn("tot", F.sum("e").over(Window.partitionBy("event", "cx", "cy")))
    n = n.withColumn("w", F.greatest(F.lit(0.0), 3.6 + F.ln(F.col("e") / F.col("tot"))))
    at = lambda v: F.round(F.sum(F.col("w") * F.col(v)) / F.sum("w"), 6).alias(v)
    return n.groupBy("event", "cx", "cy").agg(F.count(F.lit(1)).alias("n_blocks"), F.round(F.max("tot"), 4).alias("energy"), at("x"), at("y"))


_R = M.rotation(1.0, -2.0, 30.0)
_SHIFT = (10.0, -5.0, 6000.0)


def _lab_sql() -> str:
    m = _R.tolist()
    return ", ".join(f"({m[i][0]!r} * x + {m[i][1]!r} * y + {m[i][2]!r} * 2.0 + {_SHIFT[i]!r}) AS l{i}" for i in range(3))


@query(f"WITH {_XY}, l AS (SELECT vec_id, x, y, {_lab_sql()} FROM v) SELECT vec_id, round(l0, 6) AS lx, round(l1, 6) AS ly, round(l2, 6) AS lz, round(l0 * 5800.0 / l2, 6) AS px, round(l1 * 5800.0 / l2, 6) AS py, round(x, 6) AS bx, round(y, 6) AS by FROM l")
def lab_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector to laboratory frame, projected to a plane, and back."""
    a, b = positions(spark, sf_dir)
    v = a.select("vec_id", "x", "y").unionByName(b.select(F.col("hit").alias("vec_id"), F.col("hx").alias("x"), F.col("hy").alias("y")))
    lab = M.to_lab(F.col("x"), F.col("y"), F.lit(2.0), _R, _SHIFT)
    v = v.select("vec_id", *[c.alias(n) for c, n in zip(lab, ("lx", "ly", "lz"), strict=True)])
    lx, ly, lz = F.col("lx"), F.col("ly"), F.col("lz")
    px, py = M.project(lx, ly, lz, 5800.0)
    bx, by, _ = M.to_local(lx, ly, lz, _R, _SHIFT)
    return v.select("vec_id", *[F.round(c, 6).alias(n) for c, n in ((lx, "lx"), (ly, "ly"), (lz, "lz"), (px, "px"), (py, "py"), (bx, "bx"), (by, "by"))])


@query("""WITH d AS (SELECT p_partkey AS id, p_retailprice AS e FROM part) SELECT id, round(sqrt((3.6 / sqrt(e / 1000)) ** 2), 6) AS sigma, round(3 * sqrt(3.6 ** 2 / (e / 1000) + 0.25), 6) AS radius, round(ln(e / 10.5) * 8.9 + 4.45, 6) AS depth FROM d""")
def resolution_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position resolution of a shower, the 3 sigma search radius and the depth of its maximum."""
    e = F.col("p_retailprice") / 1000
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(3.6 / F.sqrt(e), 6).alias("sigma"), F.round(3 * F.sqrt(3.6**2 / e + 0.25), 6).alias("radius"), F.round(F.ln(F.col("p_retailprice") / 10.5) * 8.9 + 4.45, 6).alias("depth"))


_E, _MP, _ME = 2200.0, 938.272046, 0.510998928


@query(f"""WITH a AS (SELECT p_partkey AS id, radians(p_size * 0.1) AS t, p_retailprice AS e FROM part)
SELECT id, round({_E} / (1 + {_E} / {_MP} * (1 - cos(t))), 6) AS elastic, round({_ME} * (({_E} + {_ME}) + ({_E} - {_ME}) * cos(t)**2) / (({_E} + {_ME}) - ({_E} - {_ME}) * cos(t)**2), 6) AS two_arm, abs(e - {_E} / (1 + {_E} / {_MP} * (1 - cos(t)))) < 900 AS near FROM a""")
def expected_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scattered electron energy at an angle: off protons, and off electrons."""
    t = F.radians(F.col("p_size") * 0.1)
    el = _E / (1 + _E / _MP * (1 - F.cos(t)))
    c2 = F.pow(F.cos(t), 2)
    ee = _ME * ((_E + _ME) + (_E - _ME) * c2) / ((_E + _ME) - (_E - _ME) * c2)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(el, 6).alias("elastic"), F.round(ee, 6).alias("two_arm"), (F.abs(F.col("p_retailprice") - el) < 900).alias("near"))


@query(f"""WITH {_P}, e AS (SELECT event, count(*) AS n, sum(time) AS total, max(time) AS t1, min(time) AS t2 FROM p GROUP BY 1 HAVING count(*) = 2),
a AS (SELECT *, degrees(atan2(t1, 20)) AS p1, degrees(atan2(-t2, 20)) AS p2 FROM e) SELECT event, total, round(abs(p1 - p2) - 90, 6) AS dphi FROM a WHERE abs(total - 50) <= 20 AND abs(abs(p1 - p2) - 90) <= 30""")
def two_arm_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of exactly two clusters with the right sum and opening angle."""
    e = peaks(spark, sf_dir).groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.sum("time").alias("total"), F.max("time").alias("t1"), F.min("time").alias("t2")).where("n = 2")
    angle = F.abs(F.degrees(F.atan2("t1", F.lit(20))) - F.degrees(F.atan2(-F.col("t2"), F.lit(20))))
    return e.withColumn("a", angle).where((F.abs(F.col("total") - 50) <= 20) & (F.abs(F.col("a") - 90) <= 30)).select("event", "total", F.round(F.col("a") - 90, 6).alias("dphi"))


@query("""WITH m AS (SELECT s_suppkey AS id, (s_suppkey % 10) * 10.0 AS mx, (s_suppkey // 10) * 10.0 AS my FROM supplier), q AS (SELECT l_orderkey AS event, l_linenumber::BIGINT AS n, l_quantity * 2 - 5 AS x, l_discount * 1000 AS y FROM lineitem)
SELECT event, n, x, id FROM q JOIN m ON x >= mx - 5 AND x < mx + 5 AND y >= my - 5 AND y < my + 5""")
def point_in_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("s_suppkey")
    m = table(spark, sf_dir, "supplier").select(i.alias("id"), ((i % 10) * 10.0).alias("mx"), (F.floor(i / 10) * 10.0).alias("my"), F.lit(10.0).alias("sx"), F.lit(10.0).alias("sy"))
    q = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_linenumber").cast("bigint").alias("n"), (F.col("l_quantity") * 2 - 5).alias("x"), (F.col("l_discount") * 1000).alias("y"))
    return M.point_in_rectangle(q, m, "x", "y", 10.0).select("event", "n", "x", "id")


@query("""WITH m AS (SELECT p_partkey AS id, (p_partkey % 3) AS sector, (p_size * 1.0)::DOUBLE AS x, (p_partkey % 34 * 1.0)::DOUBLE AS y, CASE WHEN p_partkey % 3 = 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS s FROM part),
d AS (SELECT a.id, b.id AS near, (b.x - a.x) / CASE WHEN a.sector = b.sector THEN a.s ELSE (a.s + b.s) / 2 END AS dx, (b.y - a.y) / CASE WHEN a.sector = b.sector THEN a.s ELSE (a.s + b.s) / 2 END AS dy FROM m a JOIN m b ON a.id <> b.id AND abs(a.x - b.x) <= 2.1 AND abs(a.y - b.y) <= 2.1)
SELECT id, near, round(dx, 6) AS dx, round(dy, 6) AS dy FROM d WHERE abs(dx) <= 1.01 AND abs(dy) <= 1.01""")
def quantised_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours across sectors of different module sizes."""
    k = F.col("p_partkey")
    size = F.when(k % 3 == 0, 2.0).otherwise(1.0)
    m = table(spark, sf_dir, "part").select(k.alias("id"), (k % 3).alias("sector"), F.col("p_size").cast("double").alias("x"), (k % 34).cast("double").alias("y"), size.alias("sx"), size.alias("sy"))
    return M.quantised_neighbours(m, digits=6)


@query("""WITH m AS (SELECT p_partkey AS id, p_brand AS sector, p_partkey // 34 AS row, p_partkey % 34 AS col FROM part) SELECT a.id, b.id AS near FROM m a JOIN m b ON a.sector = b.sector AND abs(a.row - b.row) + abs(a.col - b.col) = 1""")
def module_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("p_partkey")
    m = table(spark, sf_dir, "part").select(i.alias("id"), F.col("p_brand").alias("sector"), F.floor(i / 34).alias("row"), (i % 34).alias("col"))
    return M.grid_neighbours(m)


@query(f"""WITH {_P}, s AS (SELECT event, channel AS paddle FROM p WHERE channel <= 2 AND time > 30 GROUP BY ALL), m AS (SELECT event, channel AS module FROM p WHERE channel >= 4 AND integral > 40000 GROUP BY ALL) SELECT paddle, module, count(*) AS n FROM s JOIN m USING (event) GROUP BY ALL""")
def paddle_module_coincidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = peaks(spark, sf_dir)
    s = p.where("channel <= 2 AND time > 30").select("event", F.col("channel").alias("paddle")).distinct()
    m = p.where("channel >= 4 AND integral > 40000").select("event", F.col("channel").alias("module")).distinct()
    return s.join(m, "event").groupBy("paddle", "module").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_P}, o AS (SELECT event, time AS x, integral / 1000 AS y, row_number() OVER (PARTITION BY event ORDER BY channel, time, integral) AS k FROM p),
l AS (SELECT event, k, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(x, 2) OVER w AS x3, lead(y, 2) OVER w AS y3, lead(x, 3) OVER w AS x4, lead(y, 3) OVER w AS y4 FROM o WINDOW w AS (PARTITION BY event ORDER BY k)),
d AS (SELECT *, (x-x2)*(y3-y4) - (y-y2)*(x3-x4) AS det FROM l WHERE k % 2 = 1 AND x4 IS NOT NULL)
SELECT event, k, round(((x*y2-y*x2)*(x3-x4) - (x-x2)*(x3*y4-y3*x4)) / nullif(det, 0), 4) AS vx, round(((x*y2-y*x2)*(y3-y4) - (y-y2)*(x3*y4-y3*x4)) / nullif(det, 0), 4) AS vy FROM d WHERE abs(det) > 1""")
def pair_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the lines of consecutive pairs of points cross."""
    w = Window.partitionBy("event").orderBy("channel", "time", "integral")
    o = peaks(spark, sf_dir).select("event", F.col("time").alias("x"), (F.col("integral") / 1000).alias("y"), F.row_number().over(w).cast("bigint").alias("k"))
    v = M.line_vertex(o, ["event"], "k", "x", "y", least=1.0)
    return v.select("event", "k", F.round("vx", 4).alias("vx"), F.round("vy", 4).alias("vy"))


@query("""WITH n AS (SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS a, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS b),
u AS (SELECT o_orderkey, 'a' AS source FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'b' FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus = 'O'), n WHERE k <= floor(n.a * 0.4)) SELECT * FROM u""")
def luminosity_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of one simulation and as many of another as its cross section asks for."""
    o = table(spark, sf_dir, "orders")
    a = o.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("a").alias("source"))
    wanted = a.agg(F.floor(F.count(F.lit(1)) * 0.4).alias("wanted"))
    b = O.with_one(O.number_rows(o.where("o_orderstatus = 'O'").select("o_orderkey"), "o_orderkey", 1 << 20), wanted)
    return a.unionByName(b.where("number <= wanted").select("o_orderkey", F.lit("b").alias("source")))


@query("""WITH u AS (SELECT l_orderkey AS event, l_extendedprice AS e, md5(l_orderkey || '-' || l_linenumber || '-' || l_partkey || '/3') AS d, l_linenumber, l_partkey FROM lineitem)
SELECT event, l_linenumber AS line, l_partkey AS part, round(e + 0.026 * sqrt(e * 1000) * sqrt(-2 * ln((('0x' || substr(d, 1, 8))::BIGINT + 0.5) / 4294967296.0)) * cos(2 * pi() * (('0x' || substr(d, 9, 8))::BIGINT + 0.5) / 4294967296.0), 4) AS smeared FROM u""")
def smeared_energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated energies smeared by the calorimeter's resolution, the same on every run."""
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")
    e = F.col("l_extendedprice")
    smeared = e + 0.026 * F.sqrt(e * 1000) * C.gaussian_noise(key, 3)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.round(smeared, 4).alias("smeared"))


_BORDER = """p AS (SELECT p_partkey AS id, p_partkey // 512 AS layer, p_partkey % 512 AS k FROM part),
m AS (SELECT id, layer, CASE WHEN k < 256 THEN 0 ELSE 1 + (k - 256) % 4 END AS sector, CASE WHEN k < 256 THEN k % 16 WHEN (k - 256) % 4 = 0 THEN 16.5 + 2 * ((k - 256) // 44) WHEN (k - 256) % 4 = 2 THEN -1.5 - 2 * ((k - 256) // 44) ELSE -1.0 + 2 * ((k - 256) // 4 % 11) END::DOUBLE AS x,
CASE WHEN k < 256 THEN k // 16 WHEN (k - 256) % 4 = 1 THEN 16.5 + 2 * ((k - 256) // 44) WHEN (k - 256) % 4 = 3 THEN -1.5 - 2 * ((k - 256) // 44) ELSE -1.0 + 2 * ((k - 256) // 4 % 11) END::DOUBLE AS y, CASE WHEN k < 256 THEN 1.0 ELSE 2.0 END::DOUBLE AS s FROM p)"""


@query(f"""WITH {_BORDER}, b AS (SELECT min(x) - 0.5 AS x1, max(x) + 0.5 AS x2, min(y) - 0.5 AS y1, max(y) + 0.5 AS y2 FROM m WHERE sector = 0),
d AS (SELECT a.layer, a.id, c.id AS near, a.sector AS sa, c.sector AS sc, a.s AS ua, c.s AS uc, c.x - a.x AS dx, c.y - a.y AS dy, a.x, a.y, b.* FROM m a JOIN m c ON a.layer = c.layer AND a.id <> c.id AND abs(a.x - c.x) <= 2.02 AND abs(a.y - c.y) <= 2.02, b),
t AS (SELECT *, CASE WHEN dx <> 0 THEN least((x1 - x) / dx, (x2 - x) / dx) WHEN x BETWEEN x1 AND x2 THEN -1e9 ELSE 1e9 END AS ax, CASE WHEN dx <> 0 THEN greatest((x1 - x) / dx, (x2 - x) / dx) WHEN x BETWEEN x1 AND x2 THEN 1e9 ELSE -1e9 END AS ex,
CASE WHEN dy <> 0 THEN least((y1 - y) / dy, (y2 - y) / dy) WHEN y BETWEEN y1 AND y2 THEN -1e9 ELSE 1e9 END AS ay, CASE WHEN dy <> 0 THEN greatest((y1 - y) / dy, (y2 - y) / dy) WHEN y BETWEEN y1 AND y2 THEN 1e9 ELSE -1e9 END AS ey FROM d),
u AS (SELECT layer, id, near, dx, dy, CASE WHEN sa = sc THEN 1 / ua ELSE greatest(0, least(1, ex, ey) - greatest(0, ax, ay)) / 1.0 + (1 - greatest(0, least(1, ex, ey) - greatest(0, ax, ay))) / CASE WHEN sa = 0 THEN uc ELSE ua END END AS unit FROM t)
SELECT layer, id, near, round(dx * unit, 6) AS dx, round(dy * unit, 6) AS dy FROM u WHERE abs(dx * unit) <= 1.01 AND abs(dy * unit) <= 1.01""")
def border_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in layers of a fine central sector and four coarse ones around it, measured across its border."""
    k, j = F.col("k"), F.col("k") - 256
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 512).alias("layer"), (F.col("p_partkey") % 512).alias("k"))
    side, out, along = j % 4, 2 * F.floor(j / 44), -1.0 + 2 * (F.floor(j / 4) % 11)
    at = lambda fine, plus, minus: F.when(k < 256, fine).when(side == plus, 16.5 + out).when(side == minus, -1.5 - out).otherwise(along).cast("double")
    size = F.when(k < 256, 1.0).otherwise(2.0)
    m = part.select("id", "layer", F.when(k < 256, 0).otherwise(1 + side).alias("sector"), at(k % 16, 0, 2).alias("x"), at(F.floor(k / 16), 1, 3).alias("y"), size.alias("sx"), size.alias("sy"))
    n = M.border_neighbours(m, 0, ["layer"])
    return n.select("layer", "id", "near", F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"))


@query(f"""WITH RECURSIVE {_H}, r AS (SELECT event, x, y, x AS rx, y AS ry FROM h UNION SELECT r.event, r.x, r.y, h.x, h.y FROM r JOIN h ON h.event = r.event AND abs(h.x - r.rx) + abs(h.y - r.ry) = 1)
SELECT event, x, y, min(s).x AS island_x, min(s).y AS island_y, count(*) AS n_hits FROM (SELECT event, x, y, {{'x': rx, 'y': ry}} AS s FROM r) GROUP BY 1, 2, 3""")
def island_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with the first hit of their island and the island's size, by joins: no event is one task's."""
    labels = M.island_labels(grid_hits(spark, sf_dir), ["event"], "x", "y")
    sizes = labels.groupBy("event", "island_x", "island_y").agg(F.count(F.lit(1)).alias("n_hits"))
    return labels.join(sizes, ["event", "island_x", "island_y"]).select("event", "x", "y", "island_x", "island_y", "n_hits")
