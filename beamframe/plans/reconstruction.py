"""Reconstruction that is sequential inside a waveform, an event or a histogram: no SQL gives these
rows; tests hold them against golden vectors, brute force and known shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamframe.functions.tables import register_tables
from beamframe.operators import clusters, counting, fits, waveforms
from beamframe.operators.tracking import spread_over
from beamframe.plans.counting import samples
from beamframe.plans.joins import _H, grid_hits
from beamframe.plans.registry import query, table
from beamframe.plans.scratch import stored


def dealt_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waveforms dealt out over tasks: pulse search and fits take milliseconds a row, and few bytes make few tasks."""
    s = samples(spark, sf_dir)
    return s.repartition(spread_over(s), "vec_id")


_CLIP = "CASE WHEN {x}.done THEN {x}.d ELSE list_filter({x}.d, lambda p: abs(p.v - {x}.mean) < greatest({x}.rms, 1.0) - 1e-9) END"
_MEAN = "list_avg(list_transform({d}, lambda p: p.v))"
_RMS = "list_aggregate(list_transform({d}, lambda p: p.v), 'stddev_pop')"


def _round(before: str, after: str) -> str:
    """SQL of one round of clipping: a full round ends it, as do fewer than five samples."""
    k = f"SELECT *, {_CLIP.format(x=before)} AS near FROM {before}"
    full, few = "len(near) = len(d)", "len(near) < 5"
    return f"""{after} AS (SELECT vec_id, side, near AS d, CASE WHEN done OR {full} OR {few} THEN mean ELSE {_MEAN.format(d="near")} END AS mean, CASE WHEN done OR {full} OR {few} THEN rms ELSE {_RMS.format(d="near")} END AS rms,
CASE WHEN done THEN q WHEN {full} THEN 0 WHEN {few} THEN 4 ELSE q END AS q, done OR {full} OR {few} AS done FROM ({k}))"""


_PEDESTALS = f"""s AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda v: 100.0 + round(500 * v)) AS s FROM embeddings),
y AS (SELECT vec_id, list_transform(range(1, 65), lambda i: (s[i] + CASE WHEN i > 1 AND i < 64 THEN (1 - 1::DOUBLE / 3) * (s[i - 1] + s[i + 1]) ELSE 0 END + CASE WHEN i > 2 AND i < 63 THEN (1 - 2::DOUBLE / 3) * (s[i - 2] + s[i + 2]) ELSE 0 END)
  / (1 + CASE WHEN i > 1 AND i < 64 THEN 2 * (1 - 1::DOUBLE / 3) ELSE 0 END + CASE WHEN i > 2 AND i < 63 THEN 2 * (1 - 2::DOUBLE / 3) ELSE 0 END)) AS y FROM s),
w AS (SELECT vec_id, side, list_transform(range(30), lambda i: {{'v': y[i + 1 + side], 'at': i}}) AS d FROM y, (VALUES (0), (34)) t(side)),
m AS (SELECT *, list_median(list_transform(d, lambda p: p.v)) AS mean FROM w),
r0 AS (SELECT vec_id, side, d, mean, 1.4826 * list_median(list_transform(d, lambda p: abs(p.v - mean))) AS rms, 1 AS q, FALSE AS done FROM m), {_round("r0", "r1")}, {_round("r1", "r2")}, {_round("r2", "r3")},
f AS (SELECT vec_id, side, mean, rms, len(d) AS used, list_avg(list_transform(d, lambda p: p.at)) AS c, d, q | CASE WHEN rms < 1.0 - 1e-9 THEN 2 ELSE 0 END | CASE WHEN side > 0 THEN 32 ELSE 0 END AS quality FROM r3),
g AS (SELECT *, CASE WHEN used > 1 THEN list_sum(list_transform(d, lambda p: (p.at - c) * p.v)) / list_sum(list_transform(d, lambda p: (p.at - c) ** 2)) ELSE 0 END AS slope FROM f),
b AS (SELECT h.vec_id, ((h.quality & 5) > 0 OR 2 * h.used < 30) AND (t.rms < h.rms - 1e-9 OR (t.rms <= h.rms + 1e-9 AND t.used > h.used)) AS tail FROM g h JOIN g t ON h.vec_id = t.vec_id AND h.side = 0 AND t.side = 34),
ped AS (SELECT vec_id, mean, rms, used, slope, quality, side FROM g JOIN b USING (vec_id) WHERE (side = 34) = tail)"""

# samples are numbered from 1 here; values closer than 1e-9 are equal, as in the operator; t[k] is the turn from sample k to the next
_PULSES = """base AS (SELECT vec_id, mean, rms, slope, quality, side, s AS x, list_transform(y, lambda v: v - mean) AS y, list_transform(s, lambda v: v - mean) AS z, greatest(5 * rms, 10.0) AS least, greatest(0.1, 0.5 * rms) AS tol FROM ped JOIN y USING (vec_id) JOIN s USING (vec_id)),
turns AS (SELECT *, list_transform(range(1, 64), lambda k: CASE WHEN abs(y[k + 1] - y[k]) < tol - 1e-9 THEN 0 ELSE sign(y[k + 1] - y[k])::INT END) AS t FROM base),
places AS (SELECT *, unnest(range(2, 64)) AS i FROM turns),
flat AS (SELECT *, CASE WHEN t[i] = 0 THEN coalesce(list_min(list_filter(range(i, 64), lambda k: t[k] <> 0)), 64) ELSE i END AS f FROM places WHERE t[i - 1] >= 0 AND t[i] <= 0 AND NOT (t[i - 1] = 0 AND t[i] = 0)),
ends AS (SELECT *, (i + f) // 2 AS top, 2 + (f - i) // 2 AS reach, 1 + coalesce(list_max(list_filter(range(1, i), lambda k: t[k] <= 0)), 0) AS l, coalesce(list_min(list_filter(range(f, 64), lambda k: t[k] > 0)), 64) AS r FROM flat WHERE f < 64 AND t[f] <= 0),
cand AS (SELECT vec_id, i, top, reach, l, r, y[top] - (y[l] * (r - top) + y[r] * (top - l)) / (r - l) AS over, y[top] AS high, least, list_max(z[greatest(top - reach, 1):least(top + reach, 64)]) AS h FROM ends WHERE r > l),
linked AS (SELECT c.*, (SELECT min(d.i) FROM cand d WHERE d.vec_id = c.vec_id AND d.i > c.r) AS nxt FROM cand c),
walk AS (
  SELECT vec_id, min(i) AS i, []::STRUCT(l BIGINT, r BIGINT, h DOUBLE)[] AS seen, 0 AS n, NULL::BIGINT AS found FROM cand GROUP BY vec_id
  UNION ALL
  SELECT vec_id, nxt, CASE WHEN ok THEN list_append(seen, {'l': l, 'r': r, 'h': h}) ELSE seen END, n + ok::INT, CASE WHEN ok THEN i END FROM (
    SELECT c.*, w.seen, w.n, least(c.over, c.high) >= c.least - 1e-9 AND len(list_filter(w.seen, lambda p: c.l <= p.r AND c.r >= p.l AND c.over < 0.3 * p.h - 1e-9)) = 0 AS ok
    FROM walk w JOIN linked c ON c.vec_id = w.vec_id AND c.i = w.i WHERE w.n < 8)),
top AS (SELECT b.*, c.top, c.reach, c.l, c.r, c.i FROM walk w JOIN cand c ON c.vec_id = w.vec_id AND c.i = w.found JOIN base b ON b.vec_id = w.vec_id),
weak AS (SELECT *, list_min(list_transform(range(greatest(top - reach, 1), least(top + reach, 64) + 1), lambda k: {'a': -z[k], 'b': abs(k - top), 'c': k})).c AS k, list_transform(y, lambda v: v < 0.1 * y[top] - 1e-9 OR v < rms - 1e-9 OR v * y[top] < 0) AS w FROM top),
stops AS (SELECT *, coalesce(list_max(list_filter(range(l, top - 1), lambda j: w[j] AND w[j + 1])), l) AS from_, coalesce(list_min(list_filter(range(top + 2, r + 1), lambda j: w[j] AND w[j - 1])), r) AS to_, x[k - 1] - 2 * x[k] + x[k + 1] AS bend FROM weak),
cut AS (SELECT *, coalesce(list_min(list_filter(range(from_, top), lambda j: NOT w[j])), top) AS lo, coalesce(list_max(list_filter(range(top + 1, to_ + 1), lambda j: NOT w[j])), top) AS hi,
  CASE WHEN k > 1 AND k < 64 AND bend < -1e-3 THEN greatest(-1, least(1, 0.5 * (x[k - 1] - x[k + 1]) / bend)) ELSE 0 END AS shift FROM stops),
piled AS (SELECT c.*, EXISTS (SELECT 1 FROM cut o WHERE o.vec_id = c.vec_id AND o.i <> c.i AND c.lo <= o.hi + 2 AND c.hi >= o.lo - 2) AS pile FROM cut c),
inside AS (SELECT vec_id, bool_or(k - 1 >= side AND k - 1 < side + 30) AS ins FROM cut GROUP BY vec_id)"""


@query(f"""WITH RECURSIVE {_PEDESTALS}, {_PULSES}
SELECT p.vec_id, round(p.mean, 6) AS ped_mean, round(p.slope, 6) AS ped_slope, (p.quality | CASE WHEN ins THEN 8 ELSE 0 END)::BIGINT AS ped_quality, (k - 1)::BIGINT AS pos, round((k - 1 + shift) * 4, 6) AS time, round(z[k], 6) AS height,
round(list_sum(y[lo:hi]), 6) AS integral, (x[k] >= 4095)::BIGINT AS saturated, CASE WHEN k IS NOT NULL THEN pile::BIGINT END AS quality FROM ped p LEFT JOIN inside USING (vec_id) LEFT JOIN piled c USING (vec_id)""")
def waveform_pulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pedestal and pulses of every waveform, with their quality bits."""
    p = waveforms.with_pulses(dealt_samples(spark, sf_dir).select("vec_id", "samples"), "samples")
    p = p.select("vec_id", F.round("ped_mean", 6).alias("ped_mean"), F.round("ped_slope", 6).alias("ped_slope"), "ped_quality", F.explode_outer("pulses").alias("p"))
    long = lambda c: F.col(c).cast("bigint").alias(c.removeprefix("p."))
    return p.select("vec_id", "ped_mean", "ped_slope", long("ped_quality"), long("p.pos"), F.round("p.time", 6).alias("time"), F.round("p.height", 6).alias("height"), F.round("p.integral", 6).alias("integral"), long("p.saturated"), long("p.quality"))


@query(f"WITH {_PEDESTALS} SELECT vec_id, round(mean, 6) AS mean, round(rms, 6) AS rms, used, round(slope, 6) AS slope, quality, side AS first FROM ped")
def waveform_pedestals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The robust pedestal of every waveform, from its leading samples or the quieter trailing ones."""
    p = waveforms.with_pedestals(dealt_samples(spark, sf_dir).select("vec_id", "samples"), "samples")
    long = lambda c: F.col(c).cast("bigint")
    return p.select("vec_id", F.round("ped_mean", 6).alias("mean"), F.round("ped_rms", 6).alias("rms"), long("ped_used").alias("used"), F.round("ped_slope", 6).alias("slope"), long("ped_quality").alias("quality"), long("ped_from").alias("first"))


@query()
def firmware_pulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the digitiser's firmware would report of every waveform."""
    s = dealt_samples(spark, sf_dir).select("vec_id", "samples", F.lit(90.0).alias("pedestal"))
    p = waveforms.with_firmware_pulses(s, "samples", "pedestal")
    return p.select("vec_id", F.explode("fw_pulses").alias("p")).select("vec_id", "p.cross", "p.coarse", "p.fine", "p.time", "p.integral", "p.quality")


_SHARE = "CASE WHEN {d} < 0.01 THEN 0.78 ELSE 0.78 * exp(-({d} * {d}) / (2 * 0.36 * 0.36)) END"
_TOP = "PARTITION BY event, isl, tx, ty"


def _refined(before: str, after: str) -> str:
    """SQL of one round: parts of the hits, their sum around each maximum, its centroid, new weights from there."""
    part = f"SELECT *, CASE WHEN own THEN e ELSE w / greatest(sum(w) OVER (PARTITION BY event, isl, x, y), 1e-300) * e END AS part FROM {before}"
    total = f"SELECT *, sum(CASE WHEN near AND part > 0 THEN part END) OVER ({_TOP}) AS tot FROM ({part})"
    logs = f"SELECT *, CASE WHEN near AND part > 0 THEN greatest(0, 3.6 + ln(part / tot)) ELSE 0 END AS lw FROM ({total})"
    sums = f"SELECT *, sum(lw) OVER ({_TOP}) AS sw, sum(lw * x) OVER ({_TOP}) AS sx, sum(lw * y) OVER ({_TOP}) AS sy FROM ({logs})"
    way = f"SELECT *, sqrt((x - CASE WHEN sw > 0 THEN sx / sw ELSE tx END) ** 2 + (y - CASE WHEN sw > 0 THEN sy / sw ELSE ty END) ** 2) AS d FROM ({sums})"
    return f"{after} AS (SELECT event, isl, tx, ty, te, split, x, y, e, near, own, CASE WHEN split THEN {_SHARE.format(d='d')} * tot ELSE 1.0 END AS w FROM ({way}))"


_CLUSTERS = f"""WITH RECURSIVE {_H}, r AS (SELECT event, x, y, x AS rx, y AS ry FROM h UNION SELECT r.event, r.x, r.y, h.x, h.y FROM r JOIN h ON h.event = r.event AND abs(h.x - r.rx) <= 1 AND abs(h.y - r.ry) <= 1),
lab AS (SELECT event, x, y, min(s) AS isl, count(*) AS size FROM (SELECT event, x, y, {{'x': rx, 'y': ry}} AS s FROM r) GROUP BY 1, 2, 3), g AS (SELECT h.*, isl, size FROM h JOIN lab USING (event, x, y)),
m AS (SELECT a.* FROM g a WHERE a.e >= 903 AND NOT EXISTS (SELECT 1 FROM g b WHERE b.event = a.event AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND b.e > a.e)), n AS (SELECT *, count(*) OVER (PARTITION BY event, isl) AS nt FROM m),
tops AS (SELECT event, isl, x AS tx, y AS ty, e AS te, nt >= 2 AND size < 100 AND nt < 10 AS split FROM n QUALIFY (nt >= 2 AND size < 100 AND nt < 10) OR row_number() OVER (PARTITION BY event, isl ORDER BY e DESC, x, y) = 1),
q AS (SELECT t.*, g.x, g.y, g.e, abs(g.x - tx) <= 1 AND abs(g.y - ty) <= 1 AS near, g.x = tx AND g.y = ty AS own, sqrt((g.x - tx) ** 2 + (g.y - ty) ** 2) AS d FROM tops t JOIN g ON g.event = t.event AND g.isl = t.isl),
w0 AS (SELECT * EXCLUDE (d), CASE WHEN split THEN {_SHARE.format(d="d")} * te ELSE 1.0 END AS w FROM q), {", ".join(_refined(f"w{k}", f"w{k + 1}") for k in range(6))},
s1 AS (SELECT *, w / greatest(sum(w) OVER (PARTITION BY event, isl, x, y), 1e-300) AS share FROM w6), s2 AS (SELECT *, CASE WHEN share < 0.01 THEN 0 ELSE share END AS kept FROM s1),
s3 AS (SELECT *, kept / greatest(sum(kept) OVER (PARTITION BY event, isl, x, y), 1e-300) * e AS part FROM s2), s4 AS (SELECT *, sum(part) OVER ({_TOP}) AS total FROM s3),
s5 AS (SELECT *, CASE WHEN near AND part > 0 THEN greatest(0, 3.6 + ln(part / total)) ELSE 0 END AS lw FROM s4),
c AS (SELECT event, tx, ty, max(total) AS energy, count(*) FILTER (part > 0) AS n_blocks, CASE WHEN sum(lw) > 0 THEN sum(lw * x) / sum(lw) ELSE tx END AS cx, CASE WHEN sum(lw) > 0 THEN sum(lw * y) / sum(lw) ELSE ty END AS cy FROM s5 GROUP BY event, isl, tx, ty HAVING max(total) >= 50 AND count(*) FILTER (part > 0) >= 1)
SELECT event, row_number() OVER (PARTITION BY event ORDER BY energy DESC, cx, cy) - 1 AS cluster, n_blocks, round(energy, 5) AS energy, round(cx, 5) AS x, round(cy, 5) AS y FROM c"""


@query(_CLUSTERS)
def island_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of connected hits, split among their maxima."""
    cfg = clusters.IslandConfig(least_centre=903.0, least_cluster=50.0, corners=True)  # the energies here are all alike
    c = clusters.form_clusters(grid_hits(spark, sf_dir), "event", "x", "y", "e", cfg)
    return c.select("event", "cluster", "n_blocks", *[F.round(n, 5).alias(n) for n in ("energy", "x", "y")])


@query(_CLUSTERS)
def grid_clusters_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same clusters by a table function, in SQL text."""
    register_tables(spark)
    columns = "event, cluster, n_blocks, round(energy, 5) AS energy, round(x, 5) AS x, round(y, 5) AS y"
    return spark.sql(f"SELECT {columns} FROM grid_clusters(TABLE({{h}}), key => 'event', x => 'x', y => 'y', energy => 'e', centre => 903.0D, least => 50.0D, corners => true)", h=grid_hits(spark, sf_dir))


@query()
def gaussian_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Gaussian on every label's spectrum of vector components."""
    v = table(spark, sf_dir, "embeddings").select("label", F.explode(F.col("embedding").cast("array<double>")).alias("v"))
    f = fits.fit_peaks(counting.histogram(v, "v", -0.6, 0.02, 60, ["label"]), ["label"], -0.6, 0.02)
    return f.select("label", "n", *[F.round(n, 5).alias(n) for n in ("amplitude", "mean", "sigma", "chi2_dof")])


@query()
def gain_iteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration factors after three rounds of factor * clamp(expected / fitted, 0.5, 2)."""
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("bigint").alias("channel"), F.col("l_quantity").alias("adc"))
    factor = stored(hits.select("channel").distinct().withColumn("factor", F.lit(1.0)), "gain-factors")
    for _ in range(3):
        h = counting.histogram(hits.join(factor, "channel").withColumn("e", F.col("adc") * F.col("factor")), "e", 0.0, 2.0, 60, ["channel"])
        peak = fits.fit_peaks(h, ["channel"], 0.0, 2.0).select("channel", "mean")
        step = F.greatest(F.lit(0.5), F.least(F.lit(2.0), 30.0 / F.col("mean")))
        factor = factor.join(peak, "channel", "left").select("channel", F.when(F.col("mean") > 0, F.col("factor") * step).otherwise(F.col("factor")).alias("factor"))
        factor = stored(factor, "gain-factors")  # a row a channel; the next round reads it twice
    return factor.select("channel", F.round("factor", 5).alias("factor"))


def pulse_templates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Channels (labels) with their types, and the types' templates, one of them out of range."""
    channels = table(spark, sf_dir, "embeddings").select("label").distinct().where("label % 7 <> 5").select("label", (F.col("label") % 4).alias("type"))
    templates = spark.createDataFrame([(0, 3.0, 12.0), (1, 2.0, 9.0), (2, 40.0, 12.0)], "type int, rise double, fall double")
    return channels, templates


@query("""WITH c AS (SELECT DISTINCT label, label % 4 AS type FROM embeddings WHERE label % 7 <> 5), t(type, rise, fall) AS (VALUES (0, 3.0::DOUBLE, 12.0::DOUBLE), (1, 2.0, 9.0), (2, 40.0, 12.0))
SELECT vec_id, CASE WHEN rise BETWEEN 0.5 AND 10 THEN rise END AS rise, CASE WHEN rise BETWEEN 0.5 AND 10 THEN fall END AS fall, CASE WHEN rise IS NULL THEN 1 WHEN rise BETWEEN 0.5 AND 10 THEN 0 ELSE 2 END::INT AS template_state
FROM embeddings LEFT JOIN c USING (label) LEFT JOIN t USING (type)""")
def channel_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each waveform's pulse template, by channel and type."""
    channels, templates = pulse_templates(spark, sf_dir)
    return waveforms.with_templates(table(spark, sf_dir, "embeddings").select("vec_id", "label"), channels, templates, ["label"]).drop("label")


@query()
def deconvolved_pulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piled-up pulses taken apart by a fit of their channel's template."""
    s = waveforms.with_templates(samples(spark, sf_dir).select("vec_id", "label", "samples"), *pulse_templates(spark, sf_dir), ["label"])
    p = waveforms.with_pulses(s.repartition(spread_over(s), "vec_id"), "samples", waveforms.PulseConfig(order=1, n_pedestal=20))
    d = waveforms.with_deconvolution(p, "samples")
    x = d.select("vec_id", "state", F.explode("pulses").alias("p")).where("state > 0")
    return x.select("vec_id", "state", "p.pos", "p.quality", F.round("p.height", 3).alias("height"), F.round("p.time", 3).alias("time"))


@query()
def pulse_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rise, fall and power of waveforms with a single pulse."""
    p = waveforms.with_pulses(dealt_samples(spark, sf_dir).select("vec_id", "samples"), "samples", waveforms.PulseConfig(order=1, n_pedestal=20, min_height=60))
    s = waveforms.with_shape(p, "samples", free_power=True).where("shape IS NOT NULL")
    return s.select("vec_id", *[F.round(F.col("shape").getField(n), 2).alias(n) for n in ("amplitude", "start", "rise", "fall", "power")])


@query()
def crystal_ball_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The right-most peak of every channel's spectrum, with a tail to the left."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("bigint").alias("channel"), "l_extendedprice")
    h = counting.histogram(p, "l_extendedprice", 0.0, 2000.0, 60, ["channel"])
    f = fits.fit_peaks(h, ["channel"], 0.0, 2000.0, fits.crystal_ball_fit)
    return f.select("channel", "n", *[F.round(n, 3).alias(n) for n in ("amplitude", "mean", "sigma", "chi2_dof")])


@query()
def valley_split_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips over threshold, grouped and cut at their valleys."""
    s = samples(spark, sf_dir).select("vec_id", F.posexplode("samples").alias("strip", "q")).where("q > 95")
    c = clusters.strip_clusters(s.withColumn("strip", F.col("strip").cast("bigint")), ["vec_id"], "strip", "q")
    return c.select("vec_id", "first", "size", *[F.round(n, 5).alias(n) for n in ("total", "peak", "centre")])
