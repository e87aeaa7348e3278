"""Selections on triggers, peaks and clusters, and lookups of addresses and calibrations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beamframe.functions import arrays as A
from beamframe.functions import bits as B
from beamframe.plans.counting import peaks
from beamframe.plans.registry import query, table

LABELS = {"sum": 0, "lms": 1, "alpha": 2, "cosmic": 3, "pulser": 4, "master": 5, "veto": 6}
_T = "t AS (SELECT l_orderkey AS event, bit_or(1::BIGINT << (l_linenumber - 1)) AS bits FROM lineitem GROUP BY 1)"
_P = "p AS (SELECT l_orderkey AS event, l_linenumber::BIGINT AS channel, l_quantity AS time, l_extendedprice AS integral, l_discount AS quality FROM lineitem)"


def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event, bits: a trigger bit for each line number."""
    bit = F.expr("shiftleft(1L, cast(l_linenumber as int) - 1)")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("event")).agg(F.bit_or(bit).alias("bits"))


def peak_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event, peaks: struct array of channel, time, height (from the integral) and quality bits."""
    p = peaks(spark, sf_dir)
    one = F.struct("channel", "time", (F.col("integral") / 10).alias("height"), F.round(F.col("quality") * 100).cast("bigint").alias("quality"))
    return p.groupBy("event").agg(F.array_sort(F.collect_list(one)).alias("peaks"))


@query(f"WITH {_T} SELECT event, bits FROM t WHERE (bits & 8) = 0 AND (bits & 6) <> 0")
def trigger_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with lms or alpha that lack cosmic."""
    accept, _ = B.parse_bits(["lms", "alpha"], LABELS)
    reject, _ = B.parse_bits(["3"], LABELS)
    return triggers(spark, sf_dir).where(B.passes_trigger(F.col("bits"), accept, reject))


@query(f"""WITH {_T} SELECT event, array_to_string(list_filter([CASE WHEN bits & 1 <> 0 THEN 'sum' END, CASE WHEN bits & 2 <> 0 THEN 'lms' END, CASE WHEN bits & 4 <> 0 THEN 'alpha' END, CASE WHEN bits & 8 <> 0 THEN 'cosmic' END,
CASE WHEN bits & 16 <> 0 THEN 'pulser' END, CASE WHEN bits & 32 <> 0 THEN 'master' END, CASE WHEN bits & 64 <> 0 THEN 'veto' END], lambda x: x IS NOT NULL), ',') AS labels, bit_count(bits)::BIGINT AS n_bits FROM t""")
def trigger_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers(spark, sf_dir).select("event", F.array_join(B.bit_labels(F.col("bits"), LABELS), ",").alias("labels"), F.bit_count("bits").cast("bigint").alias("n_bits"))


@query(f"WITH {_T} SELECT bits, count(*) AS n FROM t WHERE bits = 3 OR bits = 1 GROUP BY 1")
def trigger_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers(spark, sf_dir).where(F.col("bits").isin(1, 3)).groupBy("bits").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view')")
def event_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view")).select("event_id", "event_type")


@query(f"WITH {_P}, f AS (SELECT event, count(*) AS n, round(sum(integral / 10), 4) AS height FROM p WHERE time BETWEEN 10 AND 30 AND integral / 10 >= 2000 AND (round(quality * 100)::BIGINT & 1) = 0 GROUP BY 1) SELECT event, n, height FROM f")
def peak_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of an event in a time window, over a height, without quality bit 0."""
    kept = A.keep_peaks(F.col("peaks"), {"time": (10, 30), "height": (2000, None)}, "quality", reject=1)
    x = peak_lists(spark, sf_dir).select("event", kept.alias("k")).where(F.size("k") > 0)
    return x.select("event", F.size("k").cast("bigint").alias("n"), F.round(A.total(F.transform("k", lambda p: p["height"])), 4).alias("height"))


@query(f"WITH {_P} SELECT event, arg_max(channel, (time, -channel, -integral)) AS channel, max(time) AS time FROM p WHERE time BETWEEN 5 AND 40 GROUP BY 1")
def best_peak_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest peak of an event inside a window, the first of equals."""
    x = peak_lists(spark, sf_dir).withColumn("i", A.best_peak(F.col("peaks"), "time", 5, 40)).where("i >= 0")
    return x.select("event", F.get("peaks", F.col("i"))["channel"].alias("channel"), F.get("peaks", F.col("i"))["time"].alias("time"))


@query(f"WITH {_P} SELECT event FROM p WHERE time > 20 AND channel IN (1, 2, 3) GROUP BY event, channel HAVING count(*) BETWEEN 1 AND 2 INTERSECT SELECT event FROM p")
def waveform_event_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in which any of the configured channels has one or two qualifying peaks."""
    q = peaks(spark, sf_dir).where((F.col("time") > 20) & F.col("channel").isin(1, 2, 3)).groupBy("event", "channel").agg(F.count(F.lit(1)).alias("n")).where("n BETWEEN 1 AND 2")
    return q.select("event").distinct()


@query(f"WITH {_P} SELECT event, count(*) FILTER (time >= 15 AND integral > 30000) AS n FROM p GROUP BY 1 HAVING count(*) FILTER (time >= 15 AND integral > 30000) BETWEEN 2 AND 3 AND count(*) FILTER (time >= 15 AND integral > 30000 AND channel IN (1, 4)) > 0")
def cluster_event_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with two or three clusters over the cuts, one of them at a wanted centre."""
    good = F.filter("peaks", lambda p: (p["time"] >= 15) & (p["height"] * 10 > 30000))
    x = peak_lists(spark, sf_dir).select("event", good.alias("g"))
    centres = F.array(F.lit(1).cast("bigint"), F.lit(4).cast("bigint"))
    return x.where(F.size("g").between(2, 3) & F.arrays_overlap(F.transform("g", lambda p: p["channel"]), centres)).select("event", F.size("g").cast("bigint").alias("n"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS idx FROM events WHERE event_type = 'purchase' AND value > 10")
def kept_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, from 1, of the kept events of each run."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    kept = table(spark, sf_dir, "events").where("event_type = 'purchase' AND value > 10")
    return kept.select("user_id", "event_id", F.row_number().over(w).cast("bigint").alias("idx"))


@query(f"WITH {_P} SELECT event, count(*) AS n FROM p GROUP BY 1 HAVING count(*) <= 3")
def multiplicity_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peak_lists(spark, sf_dir).where(F.size("peaks") <= 3).select("event", F.size("peaks").cast("bigint").alias("n"))


@query("SELECT p_type, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 25 GROUP BY 1")
def address_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel addresses to modules; unmapped ones are dropped."""
    modules = table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return table(spark, sf_dir, "lineitem").join(modules, "l_partkey").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey <= 1156 THEN 'G' || p_partkey WHEN p_partkey <= 2000 THEN 'W' || (p_partkey - 1000) END AS name,
CASE WHEN p_partkey <= 1156 THEN p_partkey WHEN p_partkey <= 2000 THEN p_partkey - 1000 + 1000 END AS back FROM part""")
def module_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids to names and back: glass 1..1156, crystals from 1000 on after them."""
    i = F.col("p_partkey")
    x = table(spark, sf_dir, "part").select(i.alias("id"), F.when(i <= 1156, F.concat(F.lit("G"), i)).when(i <= 2000, F.concat(F.lit("W"), i - 1000)).alias("name"))
    n = F.regexp_extract("name", r"^[GW](\d+)$", 1).cast("bigint")
    return x.withColumn("back", F.when(F.col("name").startswith("G"), n).when(F.col("name").startswith("W"), n + 1000))


@query(f"""WITH {_P}, c AS (SELECT l_orderkey AS event, l_linenumber AS channel, l_extendedprice / 1000 AS adc, p_size AS f, p_retailprice / 10000 AS nl FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10)
SELECT event, channel::BIGINT AS channel, floor(1000 * 1.02 * CASE WHEN adc - 5 < 0 THEN 0 WHEN f IS NULL THEN (adc - 5) * 0.5 ELSE f * 0.01 * (adc - 5) + nl * (f * 0.01 * (adc - 5) - 2) / 1000 END + 0.0137)::BIGINT AS energy FROM c""")
def calibrate_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear calibration with a small non-linear term, a default factor where there is none, times gain, in thousandths."""
    cal = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") * 0.01).alias("f"), (F.col("p_retailprice") / 10000).alias("nl"))
    adc = F.col("l_extendedprice") / 1000 - 5
    e = F.col("f") * adc
    energy = F.when(adc < 0, 0.0).when(F.col("f").isNull(), adc * 0.5).otherwise(e + F.col("nl") * (e - 2) / 1000)
    return table(spark, sf_dir, "lineitem").join(cal, "l_partkey", "left").select(F.col("l_orderkey").alias("event"), F.col("l_linenumber").cast("bigint").alias("channel"), F.floor(1000 * 1.02 * energy + 0.0137).alias("energy"))
