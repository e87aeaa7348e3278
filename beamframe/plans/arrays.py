"""Waveform queries: the embeddings, scaled to samples around 100, are 64-sample waveforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamframe.functions import arrays as A
from beamframe.functions.tables import register_tables
from beamframe.plans.counting import samples
from beamframe.plans.registry import query, table

_W = "w AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda v: 100.0 + round(500 * v)) AS s FROM embeddings)"
_L = f"{_W}, x AS (SELECT vec_id, unnest(s) AS v, unnest(range(64)) AS i FROM w)"


@query(f"""WITH {_L} SELECT a.vec_id, a.i::BIGINT AS i, round((a.v + CASE WHEN b.v IS NOT NULL AND c.v IS NOT NULL THEN 2.0/3 * (b.v + c.v) ELSE 0 END + CASE WHEN d.v IS NOT NULL AND e.v IS NOT NULL THEN 1.0/3 * (d.v + e.v) ELSE 0 END)
 / (1 + CASE WHEN b.v IS NOT NULL AND c.v IS NOT NULL THEN 4.0/3 ELSE 0 END + CASE WHEN d.v IS NOT NULL AND e.v IS NOT NULL THEN 2.0/3 ELSE 0 END), 5) AS v
FROM x a LEFT JOIN x b ON a.vec_id = b.vec_id AND b.i = a.i - 1 LEFT JOIN x c ON a.vec_id = c.vec_id AND c.i = a.i + 1 LEFT JOIN x d ON a.vec_id = d.vec_id AND d.i = a.i - 2 LEFT JOIN x e ON a.vec_id = e.vec_id AND e.i = a.i + 2""")
def smoothed_waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).select("vec_id", F.posexplode(A.smooth_triangular(F.col("samples"), 2)).alias("i", "v"))
    return s.select("vec_id", F.col("i").cast("bigint").alias("i"), F.round("v", 5).alias("v"))


@query(f"WITH {_L} SELECT vec_id, i::BIGINT AS i, round(avg(v) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS v FROM x")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).select("vec_id", F.posexplode(A.moving_average(F.col("samples"), 2)).alias("i", "v"))
    return s.select("vec_id", F.col("i").cast("bigint").alias("i"), F.round("v", 6).alias("v"))


@query(f"""WITH {_L}, t AS (SELECT vec_id, min(i) AS top FROM (SELECT *, max(v) OVER (PARTITION BY vec_id) AS m FROM x WHERE i BETWEEN 40 AND 60) WHERE v = m GROUP BY 1)
SELECT vec_id, top::BIGINT AS top, round(avg(v), 6) AS mean FROM t JOIN x USING (vec_id) WHERE i BETWEEN top - 3 AND top + 3 GROUP BY ALL""")
def peak_window_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("samples")
    return samples(spark, sf_dir).select("vec_id", (A.argmax(F.slice(s, 41, 21)) + 40).cast("bigint").alias("top"), F.round(A.windowed_peak_mean(s, 40, 60, 3), 6).alias("mean"))


@query(f"WITH {_L} SELECT vec_id, round(sum(v) - 64 * avg(v) FILTER (i < 10), 6) AS integral FROM x GROUP BY 1")
def simple_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("vec_id", F.round(A.pedestal_subtracted_sum(F.col("samples"), 10), 6).alias("integral"))


@query(f"""WITH {_L}, r AS (SELECT vec_id, v, row_number() OVER (PARTITION BY vec_id ORDER BY v) AS k FROM x), f AS (SELECT vec_id, avg(v) AS m FROM x WHERE v BETWEEN 50 AND 150 GROUP BY 1)
SELECT vec_id, round(avg(v) FILTER (k <= 44), 6) AS without_top, round(avg(v) FILTER (k > 10 AND k <= 54), 6) AS trimmed, round(coalesce(avg(v) FILTER (v < m + 20), max(m)), 6) AS two_pass FROM r LEFT JOIN f USING (vec_id) GROUP BY vec_id""")
def common_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three estimates of the common baseline of a set of strips."""
    s = F.col("samples")
    return samples(spark, sf_dir).select("vec_id", F.round(A.mean_without_top(s, 20), 6).alias("without_top"), F.round(A.trimmed_mean(s, 10, 10), 6).alias("trimmed"), F.round(A.two_pass_mean(s, 50, 150, 20), 6).alias("two_pass"))


@query(f"""WITH {_L}, c AS (SELECT vec_id, avg(v) AS cm, stddev_pop(v) AS noise FROM x GROUP BY 1) SELECT vec_id, i::BIGINT AS strip, round(v - cm, 5) AS charge FROM x JOIN c USING (vec_id) WHERE v - cm > 1.5 * noise""")
def strip_zero_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips over the common mode by more than 1.5 times the noise."""
    s = samples(spark, sf_dir).withColumn("cm", A.mean(F.col("samples")))
    s = s.withColumn("noise", F.sqrt(A.mean(F.transform("samples", lambda v: v * v)) - F.col("cm") * F.col("cm")))
    x = s.select("vec_id", "cm", "noise", F.posexplode("samples").alias("strip", "v")).where(F.col("v") - F.col("cm") > 1.5 * F.col("noise"))
    return x.select("vec_id", F.col("strip").cast("bigint").alias("strip"), F.round(F.col("v") - F.col("cm"), 5).alias("charge"))


@query(f"""WITH {_L}, g AS (SELECT vec_id, i // 6 AS strip, i % 6 AS t, v FROM x WHERE i < 60) SELECT vec_id, strip::BIGINT AS strip, max(v) AS charge, arg_max(t, (v, -t))::BIGINT AS time_bin, sum(v) AS total FROM g GROUP BY 1, 2
HAVING max(v) > 120 AND arg_max(t, (v, -t)) BETWEEN 1 AND 4""")
def strip_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six time samples a strip: largest, its bin, sum; hits peak inside and over a threshold."""
    six = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.slice("samples", k * 6 + 1, 6))
    x = samples(spark, sf_dir).select("vec_id", F.posexplode(six).alias("strip", "ts"))
    x = x.select("vec_id", F.col("strip").cast("bigint").alias("strip"), F.array_max("ts").alias("charge"), A.argmax(F.col("ts")).cast("bigint").alias("time_bin"), A.total(F.col("ts")).alias("total"))
    return x.where((F.col("charge") > 120) & F.col("time_bin").between(1, 4))


@query(f"""WITH {_L}, r AS (SELECT vec_id, i, v, sum(CASE WHEN v > 115 THEN 0 ELSE 1 END) OVER (PARTITION BY vec_id ORDER BY i) AS g FROM x), k AS (SELECT vec_id, min(i) AS first, count(*) AS n, sum(v) AS q, sum(i * v) / sum(v) AS c FROM r WHERE v > 115 GROUP BY vec_id, g)
SELECT vec_id, first::BIGINT AS first, n, q, round(c, 6) AS centroid FROM k""")
def strip_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of neighbouring strips over threshold, with charge and centroid."""
    from beamframe.operators.matching import runs_of

    x = samples(spark, sf_dir).select("vec_id", F.posexplode("samples").alias("i", "v")).where("v > 115").withColumn("i", F.col("i").cast("bigint"))
    g = runs_of(x, ["vec_id"], "i")
    return g.groupBy("vec_id", "run").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("v").alias("q"), F.round(F.sum(F.col("i") * F.col("v")) / F.sum("v"), 6).alias("centroid")).drop("run")


@query(f"""WITH {_L}, r AS (SELECT vec_id, i, v, sum(CASE WHEN v > 115 THEN 0 ELSE 1 END) OVER (PARTITION BY vec_id ORDER BY i) AS g FROM x), k AS (SELECT vec_id, min(i) AS first, count(*) AS n, sum(v) AS q, sum(i * v) / sum(v) AS c FROM r WHERE v > 115 GROUP BY vec_id, g)
SELECT vec_id, first::BIGINT AS first, n, round(q, 6) AS total, round(c, 6) AS centroid FROM k""")
def strip_groups_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of neighbouring strips by a table function, in SQL text."""
    register_tables(spark)
    strips = samples(spark, sf_dir).select("vec_id", F.posexplode("samples").alias("strip", "q"))
    return spark.sql("SELECT vec_id, first, n, round(total, 6) AS total, round(centroid, 6) AS centroid FROM strip_groups(TABLE(SELECT * FROM {s} WHERE q > 115), key => 'vec_id', position => 'strip', charge => 'q')", s=strips)


@query("SELECT vec_id, round(list_sum(list_transform(range(1, 7), lambda i: embedding[i]::DOUBLE ** 2 * 25 * (i - 1))) / list_sum(list_transform(range(1, 7), lambda i: embedding[i]::DOUBLE ** 2)), 6) AS seed_time FROM embeddings")
def seed_mean_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charge-weighted mean time of a strip's six samples, 25 ns apart."""
    q = F.transform(F.slice("embedding", 1, 6), lambda v: F.pow(v.cast("double"), 2))
    weighted = F.zip_with(q, F.sequence(F.lit(0), F.lit(5)), lambda a, i: a * 25 * i)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(A.total(weighted) / A.total(q), 6).alias("seed_time"))
