"""Histogram, efficiency and statistics queries. lineitem rows stand for peaks: l_orderkey is the
event, l_linenumber the channel, l_quantity the time and l_extendedprice the integral."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beamframe.operators import counting as C
from beamframe.operators import ordered as O
from beamframe.plans.registry import query, table


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_linenumber").cast("bigint").alias("channel"), F.col("l_quantity").alias("time"), F.col("l_extendedprice").alias("integral"), F.col("l_discount").alias("quality"))


_P = "p AS (SELECT l_orderkey AS event, l_linenumber::BIGINT AS channel, l_quantity AS time, l_extendedprice AS integral, l_discount AS quality FROM lineitem)"


def _bin(v: str, low: float, step: float, n: int) -> str:
    return f"(CASE WHEN {v} < {low} THEN -1 WHEN floor(({v} - {low}) / {step}) >= {n} THEN {n} ELSE floor(({v} - {low}) / {step}) END)::BIGINT"


@query(f"WITH {_P} SELECT {_bin('integral', 0, 1000, 80)} AS bin, count(*) AS n_rows FROM p GROUP BY 1")
def histogram_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.histogram(peaks(spark, sf_dir), "integral", 0.0, 1000.0, 80)


@query(f"WITH {_P} SELECT b.bin::BIGINT AS bin, count(p.event) AS n_rows FROM (SELECT unnest(range(60)) AS bin) b LEFT JOIN p ON floor((time - 5) / 1) = b.bin AND time >= 5 GROUP BY 1")
def histogram_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dense(C.histogram(peaks(spark, sf_dir), "time", 5.0, 1.0, 60), 60)


@query(f"WITH {_P} SELECT floor(time / 4)::BIGINT AS xbin, floor((integral - 20000) / 5000)::BIGINT AS ybin, count(*) AS n_rows FROM p WHERE floor(time / 4) BETWEEN 0 AND 9 AND floor((integral - 20000) / 5000) BETWEEN 0 AND 7 GROUP BY 1, 2")
def histogram_two_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.histogram_2d(peaks(spark, sf_dir), F.col("time"), F.col("integral"), (0.0, 4.0, 10), (20000.0, 5000.0, 8))


@query(f"WITH {_P} SELECT trunc((time - 10) / 4)::BIGINT AS xbin, trunc((integral - 20000) / 5000)::BIGINT AS ybin, count(*) AS n_rows FROM p WHERE trunc((time - 10) / 4) BETWEEN 0 AND 9 AND trunc((integral - 20000) / 5000) BETWEEN 0 AND 7 GROUP BY 1, 2")
def histogram_two_dims_truncating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.histogram_2d(peaks(spark, sf_dir), F.col("time"), F.col("integral"), (10.0, 4.0, 10), (20000.0, 5000.0, 8), truncate=True)


@query(f"WITH {_P} SELECT channel, {_bin('time', 0, 4, 10)} AS bin, count(*) AS n_rows FROM p GROUP BY 1, 2")
def histogram_per_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.histogram(peaks(spark, sf_dir), "time", 0.0, 4.0, 10, ["channel"])


@query(f"WITH {_P} SELECT channel, count(*) AS n, count(*) FILTER (time BETWEEN 10 AND 30) AS n_cut, round(count(*) FILTER (time BETWEEN 10 AND 30) / count(*)::DOUBLE, 9) AS fraction FROM p GROUP BY 1")
def occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, cut = F.count(F.lit(1)), F.count_if(F.col("time").between(10, 30))
    return peaks(spark, sf_dir).groupBy("channel").agg(n.alias("n"), cut.alias("n_cut"), F.round(cut / n, 9).alias("fraction"))


@query(f"WITH {_P}, e AS (SELECT event, least(count(*), 4) AS n_clusters, sum(time) AS e FROM p GROUP BY 1) SELECT n_clusters, {_bin('e', 0, 20, 15)} AS bin, count(*) AS n_rows FROM e GROUP BY 1, 2")
def histogram_by_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed energy of an event, by how many clusters it has (4: more)."""
    e = peaks(spark, sf_dir).groupBy("event").agg(F.least(F.count(F.lit(1)), F.lit(4)).alias("n_clusters"), F.sum("time").alias("e"))
    return C.histogram(e, "e", 0.0, 20.0, 15, ["n_clusters"])


@query(f"WITH {_P}, h AS (SELECT floor(time / 5)::BIGINT AS xbin, floor(integral / 4000)::BIGINT AS ybin, count(*) AS n FROM p GROUP BY 1, 2) SELECT xbin, sum(n)::BIGINT AS n_rows, round(sum(n * (ybin + 0.5) * 4000) / sum(n), 6) AS profile FROM h WHERE ybin BETWEEN 0 AND 19 GROUP BY 1")
def profile_of_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yield and mean of a two-dimensional histogram along its second axis."""
    h = C.histogram_2d(peaks(spark, sf_dir), F.col("time"), F.col("integral"), (0.0, 5.0, 1000), (0.0, 4000.0, 20))
    return h.groupBy("xbin").agg(F.sum("n_rows").alias("n_rows"), F.round(F.sum(F.col("n_rows") * (F.col("ybin") + 0.5) * 4000) / F.sum("n_rows"), 6).alias("profile")).select("xbin", "n_rows", "profile")


@query(f"WITH {_P}, h AS (SELECT {_bin('time', 0, 2, 25)} AS bin, count(*) FILTER (quality > 0.05) AS num, count(*) AS den FROM p GROUP BY 1) SELECT bin, num, den, round(num / den::DOUBLE, 9) AS ratio FROM h WHERE den > 0 AND num > 0")
def ratio_of_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = peaks(spark, sf_dir)
    r = C.ratio_histogram(C.histogram(p.where("quality > 0.05"), "time", 0.0, 2.0, 25), C.histogram(p, "time", 0.0, 2.0, 25))
    return r.withColumn("ratio", F.round("ratio", 9))


@query(f"WITH {_P} SELECT event, round(sum(integral), 4) AS total_energy, count(*) AS n FROM p GROUP BY 1")
def event_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks(spark, sf_dir).groupBy("event").agg(F.round(F.sum("integral"), 4).alias("total_energy"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_P} SELECT channel, count(time) AS n, round(avg(time), 9) AS mean, round(stddev_pop(time), 9) AS rms, stddev_pop(time) / avg(time) > 0.55 AS warn FROM p GROUP BY 1")
def channel_mean_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = peaks(spark, sf_dir).groupBy("channel").agg(*C.mean_rms("time"))
    return s.select("channel", "n", F.round("mean", 9).alias("mean"), F.round("rms", 9).alias("rms"), (F.col("rms") / F.col("mean") > 0.55).alias("warn"))


@query("WITH s AS (SELECT vec_id % 20 AS channel, (100 + round(500 * unnest(embedding[1:30]::DOUBLE[])))::DOUBLE AS v FROM embeddings) SELECT channel, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS rms FROM s GROUP BY 1")
def pedestal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and rms of the first 30 samples of a channel's waveforms."""
    s = samples(spark, sf_dir).select((F.col("vec_id") % 20).alias("channel"), F.explode(F.slice("samples", 1, 30)).alias("v"))
    return s.groupBy("channel").agg(*C.mean_rms("v")).select("channel", "n", F.round("mean", 6).alias("mean"), F.round("rms", 6).alias("rms"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waveforms of 64 samples around 100, from the embeddings."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: 100.0 + F.round(500 * v.cast("double"))).alias("samples"))


@query("WITH c AS (SELECT p_type, p_brand, median(p_retailprice) AS m FROM part GROUP BY ALL) SELECT p_type, count(*) AS n, round(median(m), 6) AS median FROM c GROUP BY 1")
def median_of_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per type, the median of its channels' medians."""
    c = table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.percentile("p_retailprice", 0.5).alias("m"))
    return c.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("m", 0.5), 6).alias("median"))


@query(f"""WITH {_P}, h AS (SELECT DISTINCT event, channel FROM p WHERE time > 25), n AS (SELECT channel, count(*) AS n FROM h GROUP BY 1),
b AS (SELECT a.channel AS first, b.channel AS second, count(*) AS n_both FROM h a JOIN h b USING (event) WHERE a.channel < b.channel GROUP BY ALL)
SELECT first, second, x.n AS n_first, y.n AS n_second, n_both, x.n + y.n - n_both AS n_either, round(n_both / x.n::DOUBLE, 9) AS rate_given_first FROM b JOIN n x ON first = x.channel JOIN n y ON second = y.channel""")
def coincidence_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often two channels fire in one event (and), either of them (or), and given the first.

    A channel list per event is small; pairs are made inside it."""
    h = peaks(spark, sf_dir).where("time > 25").groupBy("event").agg(F.array_sort(F.collect_set("channel")).alias("c"))
    n = h.select(F.explode("c").alias("channel")).groupBy("channel").agg(F.count(F.lit(1)).alias("n"))
    pairs = h.select(F.explode(F.flatten(F.transform("c", lambda a: F.transform(F.filter("c", lambda b: b > a), lambda b: F.struct(a.alias("first"), b.alias("second")))))).alias("x")).groupBy("x.first", "x.second").agg(F.count(F.lit(1)).alias("n_both"))
    one = lambda k: n.select(F.col("channel").alias(k), F.col("n").alias(f"n_{k}"))
    return pairs.join(one("first"), "first").join(one("second"), "second").select("first", "second", "n_first", "n_second", "n_both", (F.col("n_first") + F.col("n_second") - F.col("n_both")).alias("n_either"), F.round(F.col("n_both") / F.col("n_first"), 9).alias("rate_given_first"))


@query(f"""WITH {_P} SELECT channel, floor(time / 10)::BIGINT AS cell, count(*) AS den, count(*) FILTER (quality >= 0.03) AS num, round(100.0 * count(*) FILTER (quality >= 0.03) / count(*), 9) AS efficiency,
CASE WHEN count(*) < 20 THEN 'few' WHEN 100.0 * count(*) FILTER (quality >= 0.03) / count(*) >= 70 THEN 'good' ELSE 'low' END AS status FROM p GROUP BY 1, 2""")
def efficiency_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    den, num = F.count(F.lit(1)), F.count_if(F.col("quality") >= 0.03)
    eff = 100.0 * num / den
    status = F.when(den < 20, "few").when(eff >= 70, "good").otherwise("low")
    return peaks(spark, sf_dir).groupBy("channel", F.floor(F.col("time") / 10).alias("cell")).agg(den.alias("den"), num.alias("num"), F.round(eff, 9).alias("efficiency"), status.alias("status"))


@query(f"WITH {_P} SELECT count(*) AS n_all, count(*) FILTER (time > 10) AS n_time, count(*) FILTER (time > 10 AND integral > 20000) AS n_integral, count(*) FILTER (time > 10 AND integral > 20000 AND quality < 0.05) AS n_quality FROM p")
def cut_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = F.col("time") > 10, F.col("integral") > 20000, F.col("quality") < 0.05
    return peaks(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_all"), F.count_if(a).alias("n_time"), F.count_if(a & b).alias("n_integral"), F.count_if(a & b & c).alias("n_quality"))


@query("SELECT p_brand, round(regr_slope(ln(p_retailprice), ln(p_size)), 6) AS slope, round(regr_intercept(ln(p_retailprice), ln(p_size)), 6) AS intercept, round(regr_r2(ln(p_retailprice), ln(p_size)), 6) AS r2 FROM part GROUP BY 1")
def power_law_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = table(spark, sf_dir, "part").groupBy("p_brand").agg(*C.line_fit(F.ln("p_size"), F.ln("p_retailprice")))
    return fits.select("p_brand", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")])


@query(f"""WITH {_P}, s AS (SELECT channel, count(*) AS n, sum(w) AS s, sum(w*z) AS sx, sum(w*y) AS sy, sum(w*z*z) AS sxx, sum(w*z*y) AS sxy, sum(w*y*y) AS syy FROM (SELECT channel, time AS z, integral / 1000 AS y, 1 + quality AS w FROM p) GROUP BY 1),
f AS (SELECT *, (s*sxy - sx*sy) / nullif(s*sxx - sx*sx, 0) AS b FROM s), g AS (SELECT *, (sy - b*sx) / s AS a FROM f)
SELECT channel, n, round(a, 5) AS a, round(b, 5) AS b, round(CASE WHEN n > 2 THEN (syy - a*sy - b*sxy) / (n - 2) END, 4) AS chi2_dof FROM g""")
def weighted_line_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = peaks(spark, sf_dir).select("channel", F.col("time").alias("z"), (F.col("integral") / 1000).alias("y"), (1 + F.col("quality")).alias("w"))
    f = C.weighted_line(x, "z", "y", "w", ["channel"])
    return f.select("channel", "n", F.round("a", 5).alias("a"), F.round("b", 5).alias("b"), F.round("chi2_dof", 4).alias("chi2_dof"))


@query("""WITH r AS (SELECT event_type AS ref, avg(value) AS lms, median(value) AS alpha FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1), m AS (SELECT user_id, avg(value) AS lms FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT user_id, round(avg(m.lms * r.alpha / r.lms), 6) AS gain FROM m CROSS JOIN r WHERE r.lms > 0 GROUP BY 1""")
def gain_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monitor mean times reference source over reference monitor, averaged over the references."""
    e = table(spark, sf_dir, "events")
    references = e.where(F.col("event_type").isin("error", "signup"))
    alpha = O.exact_median(references, "value", ["event_type"]).select("event_type", F.col("median").alias("alpha"))
    r = references.groupBy("event_type").agg(F.avg("value").alias("lms")).where("lms > 0").join(alpha, "event_type")
    scale = r.agg(F.avg(F.col("alpha") / F.col("lms")).alias("scale"))
    m = e.where("event_type = 'click'").groupBy("user_id").agg(F.avg("value").alias("lms"))
    return O.with_one(m, scale).select("user_id", F.round(F.col("lms") * F.col("scale"), 6).alias("gain"))


@query("""WITH g AS (SELECT user_id, event_id // 2000 AS run, avg(value) AS gain FROM events GROUP BY ALL), r AS (SELECT user_id, gain AS ref FROM g WHERE run = 0)
SELECT g.user_id, g.run, round(CASE WHEN g.gain > 0 AND r.ref > 0 THEN r.ref / g.gain ELSE 1.0 END, 9) AS correction FROM g LEFT JOIN r USING (user_id)""")
def gain_correction_to_reference_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference run over each run; 1 where either is missing."""
    g = run_gains(spark, sf_dir)
    r = g.where("run = 0").select("user_id", F.col("gain").alias("ref"))
    ok = (F.col("gain") > 0) & (F.col("ref") > 0)
    return g.join(r, "user_id", "left").select("user_id", "run", F.round(F.when(ok, F.col("ref") / F.col("gain")).otherwise(1.0), 9).alias("correction"))


def run_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", F.floor(F.col("event_id") / 2000).alias("run")).agg(F.avg("value").alias("gain"))


_G = "g AS (SELECT user_id, event_id // 2000 AS run, avg(value) AS gain FROM events GROUP BY ALL)"


@query(f"""WITH {_G}, d AS (SELECT user_id, run, gain, lag(gain) OVER (PARTITION BY user_id ORDER BY run) AS prev FROM g)
SELECT user_id, run, round(200 * (gain - prev) / (gain + prev), 6) AS change_pct, abs(200 * (gain - prev) / (gain + prev)) > 10 AS drifted FROM d WHERE prev IS NOT NULL""")
def gain_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetric relative change against the previous run."""
    w = Window.partitionBy("user_id").orderBy("run")
    d = run_gains(spark, sf_dir).withColumn("prev", F.lag("gain").over(w)).where("prev IS NOT NULL")
    change = 200 * (F.col("gain") - F.col("prev")) / (F.col("gain") + F.col("prev"))
    return d.select("user_id", "run", F.round(change, 6).alias("change_pct"), (F.abs(change) > 10).alias("drifted"))


@query(f"""WITH {_G}, d AS (SELECT user_id, run, abs(gain - lag(gain) OVER (PARTITION BY user_id ORDER BY run)) AS step FROM g)
SELECT user_id, count(*) FILTER (step > 5) AS n_drifts, round(max(step), 6) AS largest, arg_max(run, (step, -run)) FILTER (step IS NOT NULL) AS at_run FROM d GROUP BY 1""")
def drift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("run")
    d = run_gains(spark, sf_dir).withColumn("step", F.abs(F.col("gain") - F.lag("gain").over(w)))
    top = F.max(F.when(F.col("step").isNotNull(), F.struct("step", (-F.col("run")).alias("r")))).getField("r")
    return d.groupBy("user_id").agg(F.count_if(F.col("step") > 5).alias("n_drifts"), F.round(F.max("step"), 6).alias("largest"), (-top).alias("at_run"))


@query(f"""WITH {_G}, z AS (SELECT user_id, run, gain, count(*) OVER w AS n, avg(gain) OVER w AS m, stddev_pop(gain) OVER w AS s FROM g WINDOW w AS (PARTITION BY user_id))
SELECT user_id, run, round((gain - m) / s, 6) AS z, abs(gain - m) > 1.5 * s AS outlier FROM z WHERE n >= 5 AND s > 0""")
def outlier_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    z = run_gains(spark, sf_dir).select("*", F.count(F.lit(1)).over(w).alias("n"), F.avg("gain").over(w).alias("m"), F.stddev_pop("gain").over(w).alias("s")).where("n >= 5 AND s > 0")
    d = F.col("gain") - F.col("m")
    return z.select("user_id", "run", F.round(d / F.col("s"), 6).alias("z"), (F.abs(d) > 1.5 * F.col("s")).alias("outlier"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'view') AS accepted, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 3) AS seconds, round(count(*) FILTER (event_type = 'view') / nullif(0.001 * (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 0), 6) AS live FROM events GROUP BY 1""")
def pulser_livetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted pulses over those expected at a known rate in the elapsed time."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    n, span = F.count_if(F.col("event_type") == "view"), F.max(us) - F.min(us)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(n.alias("accepted"), F.round(span / 1e6, 3).alias("seconds"), F.round(n / F.nullif(0.001 * span / 1e6, F.lit(0.0)), 6).alias("live"))


@query("SELECT event_type, count(DISTINCT user_id) AS n_channels, list_sort(list(DISTINCT user_id))[1] AS first_channel FROM events GROUP BY 1")
def channel_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("n_channels"), F.min("user_id").alias("first_channel"))


@query("""WITH s AS (SELECT user_id, stddev_pop(value) AS rms FROM events GROUP BY 1), m AS (SELECT median(rms) AS med FROM s)
SELECT user_id, round(100 * abs(rms - med) / med, 6) AS off_pct, CASE WHEN 100 * abs(rms - med) / med >= 20 THEN 'alert' WHEN 100 * abs(rms - med) / med >= 10 THEN 'warn' ELSE 'ok' END AS level FROM s, m""")
def warning_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.stddev_pop("value").alias("rms"))
    off = 100 * F.abs(F.col("rms") - F.col("med")) / F.col("med")
    return O.with_one(s, O.exact_median(s, "rms").select(F.col("median").alias("med"))).select("user_id", F.round(off, 6).alias("off_pct"), C.level(off, 10, 20).alias("level"))


@query("""SELECT user_id, event_id, round(avg(value) OVER w, 9) AS recent_mean, CASE WHEN abs(value - avg(value) OVER w) >= 0.2 * avg(value) OVER w THEN 'alert' WHEN abs(value - avg(value) OVER w) >= 0.1 * avg(value) OVER w THEN 'warn' ELSE 'ok' END AS level
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def recent_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    x = O.over_last(e, "event_id", 20, {"m": F.avg("value")}, ["user_id"], 1 << 20)
    off = F.abs(F.col("value") - F.col("m"))
    return x.select("user_id", "event_id", F.round("m", 9).alias("recent_mean"), F.when(off >= 0.2 * F.col("m"), "alert").when(off >= 0.1 * F.col("m"), "warn").otherwise("ok").alias("level"))


@query("""SELECT user_id, event_id, 'last' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 5
UNION ALL SELECT user_id, event_id, 'first' FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k <= 5""")
def history_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five snapshots of a key, and its first five."""
    e = table(spark, sf_dir, "events")

    def top(order, kind: str) -> DataFrame:
        w = Window.partitionBy("user_id").orderBy(order)
        return e.withColumn("k", F.row_number().over(w)).where("k <= 5").select("user_id", "event_id", F.lit(kind).alias("kind"))

    return top(F.desc("event_id"), "last").unionByName(top("event_id", "first"))


@query(f"WITH {_P}, h AS (SELECT channel, floor(time)::BIGINT AS bin, count(*) AS n FROM p GROUP BY ALL) SELECT channel, bin, n AS n_rows, (sum(n) OVER (PARTITION BY channel ORDER BY bin DESC))::BIGINT AS from_right, round(sum(ln(1 + n)) OVER (PARTITION BY channel ORDER BY bin DESC), 6) AS log_from_right FROM h")
def cumulative_from_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = C.histogram(peaks(spark, sf_dir), "time", 0.0, 1.0, 1 << 30, ["channel"])
    w = Window.partitionBy("channel").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    return h.select("channel", "bin", "n_rows", F.sum("n_rows").over(w).alias("from_right"), F.round(F.sum(F.log1p("n_rows")).over(w), 6).alias("log_from_right"))
