"""Tables written in each format that the library reads, and read back. Files go to the scratch folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamframe.plans.registry import query, table
from beamframe.plans.scratch import scratch_path
from beamframe.sources import files as S


@query("SELECT o_custkey % 5 AS run_number, o_orderkey // 20000 AS segment, count(*) AS n, max(o_orderkey) AS last FROM orders WHERE o_custkey % 5 = 3 GROUP BY 1, 2")
def run_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's segments out of a replay that is written by run and segment; other runs aren't read."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("run_number"), F.floor(F.col("o_orderkey") / 20000).alias("segment"), "o_orderkey")
    path = scratch_path(spark, "replay")
    S.write_run(o, path)
    back = spark.read.parquet(path).where("run_number = 3")
    return back.groupBy(F.col("run_number").cast("bigint").alias("run_number"), F.col("segment").cast("bigint").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last"))


@query("SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM customer")
def table_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table through tab-separated text with a header."""
    path = scratch_path(spark, "table-text")
    S.write_table_text(table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal")), path)
    return spark.read.option("sep", "\t").option("header", True).schema("c_custkey bigint, c_name string, c_acctbal double").csv(path)


@query("SELECT event_type, count(*) AS n, round(max(value), 4) AS top FROM events GROUP BY 1")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of streams as JSON lines, read back."""
    s = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 4).alias("top"))
    path = scratch_path(spark, "report")
    S.report_json(s).write.text(path)
    return spark.read.schema("event_type string, n bigint, top double").json(path)


@query("SELECT 'W' || s_suppkey AS name, round(s_acctbal, 2) AS lms_peak, s_suppkey % 7 / 2.0 AS g1, (s_suppkey % 3)::DOUBLE AS g3 FROM supplier")
def gain_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains through the seven-column text format."""
    k = F.col("s_suppkey")
    number = lambda c, n: c.cast("double").alias(n)
    g = table(spark, sf_dir, "supplier").select(F.concat(F.lit("W"), k).alias("name"), F.round("s_acctbal", 2).alias("lms_peak"), number(k % 2, "lms_sigma"), number(k % 5, "lms_chi2ndf"), number(k % 7 / 2, "g1"), number(F.lit(1), "g2"), number(k % 3, "g3"))
    path = scratch_path(spark, "gains")
    S.write_gains(g, path)
    return S.read_gains(spark, path).select("name", "lms_peak", "g1", "g3")


@query("SELECT 'M' || p_partkey AS name, CASE WHEN p_size % 2 = 0 THEN 'glass' ELSE 'crystal' END AS type, p_size::DOUBLE AS x, CASE WHEN p_partkey % 4 > 0 THEN (p_partkey % 16)::INT END AS slot FROM part")
def module_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON list of modules, some without an address, with a comment in it."""
    k = F.col("p_partkey")
    geo = F.struct(F.col("p_size").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(2.0).alias("sx"), F.lit(2.0).alias("sy"))
    daq = F.when(k % 4 > 0, F.struct(F.lit(1).alias("crate"), (k % 16).cast("int").alias("slot"), F.lit(0).alias("channel")))
    one = F.to_json(F.struct(F.concat(F.lit("M"), k).alias("n"), F.when(F.col("p_size") % 2 == 0, "glass").otherwise("crystal").alias("t"), geo.alias("geo"), daq.alias("daq")))
    # a file per hundred of modules, each a list
    lists = table(spark, sf_dir, "part").groupBy(F.floor(k / 100).alias("file")).agg(F.array_join(F.collect_list(one), ",\n").alias("l"))
    path = scratch_path(spark, "modules")
    lists.select(F.concat(F.lit("// modules\n["), "l", F.lit("]")).alias("value"), "file").write.partitionBy("file").text(path)
    m = S.read_modules(spark, f"{path}/file=*")
    return m.select("name", "type", "x", "slot")


@query("SELECT CASE WHEN l_suppkey % 4 = 2 THEN 20 ELSE l_suppkey % 4 END::INT AS crate, (l_partkey % 16)::INT AS slot, l_linenumber::INT AS channel, count(*) AS n, round(max(l_quantity), 2) AS mean FROM lineitem GROUP BY 1, 2, 3")
def pedestal_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pedestals as text lines among comments, with one crate renumbered."""
    li = table(spark, sf_dir, "lineitem")
    line = F.concat_ws(" ", (F.col("l_suppkey") % 4).cast("string"), (F.col("l_partkey") % 16).cast("string"), F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("string"), F.lit("1.5"))
    path = scratch_path(spark, "pedestals")
    li.select(F.explode(F.array(line, F.lit("# comment"), F.lit("1 2 x"))).alias("value")).write.text(path)
    p = S.remap(S.read_pedestals(spark, path), "crate", {2: 20})
    return p.groupBy("crate", "slot", "channel").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("mean"), 2).alias("mean"))
