"""Bank files, written from the orders table as segments of a run, indexed and read back by ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamframe.operators import readout as R
from beamframe.plans.readout import bank_trees
from beamframe.plans.registry import query, table
from beamframe.scratch import scratch_path, stored
from beamframe.sources import bank_source as S
from beamframe.sources import banks as B
from beamframe.streaming.live import live_banks
from beamframe.streaming.operators import run_to_table

SEGMENTS = 8
RANGE = 256 << 10  # small ones here, so that a segment is several ranges


def run_files(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """A run in segments and its index; order k is an event of segment k % SEGMENTS."""
    path, index = scratch_path(spark, "run"), scratch_path(spark, "run-index")
    nodes = bank_trees(spark, sf_dir).withColumn("num", F.lit(0))
    events = S.encoded_events(nodes, ["event"]).withColumn("file", F.concat(F.lit("run."), F.col("event") % SEGMENTS))
    S.write_events(events, path, "file", "event")
    S.index_banks(spark, path, RANGE).write.parquet(index)
    return path, index


def segment(file: str = "file"):
    return F.regexp_extract(file, r"run\.(\d+)$", 1).cast("bigint").alias("segment")


@query(f"""SELECT o_orderkey % {SEGMENTS} AS segment, row_number() OVER (PARTITION BY o_orderkey % {SEGMENTS} ORDER BY o_orderkey) - 1 AS event, o_custkey % 8 AS trigger_type, o_orderkey AS event_number,
o_orderkey AS trigger_number, (o_custkey % 65536) * 4294967296 + o_orderkey * 3 AS timestamp, CASE WHEN o_custkey % 256 > 0 THEN o_custkey % 256 END AS trigger_bits, o_custkey % 20 AS run, 1700000000 + o_orderkey AS unix_time FROM orders""")
def bank_file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, times and trigger bits of all events of all segments; only banks with the tags that this
    needs are decoded."""
    path, index = run_files(spark, sf_dir)
    tags = [R.TRIGGER_BANK, R.TRIGGER_INTERFACE, R.MASTER_CRATE, R.RUN_INFO, *(0x80 + k for k in range(8))]
    info = R.event_info(S.read_events(spark, path, index).where(F.col("tag").isin(tags)))
    return info.select(segment(), "event", "trigger_type", "event_number", "trigger_number", "timestamp", "trigger_bits", "run", "unix_time")


@query(f"""SELECT segment, event, o_orderkey AS event_number FROM (SELECT o_orderkey % {SEGMENTS} AS segment, row_number() OVER (PARTITION BY o_orderkey % {SEGMENTS} ORDER BY o_orderkey) - 1 AS event, o_orderkey FROM orders) WHERE event BETWEEN 20 AND 49""")
def bank_file_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trigger banks of events 20 to 49 of every segment: other ranges are not opened, other banks not decoded."""
    path, index = run_files(spark, sf_dir)
    banks = S.read_events(spark, path, index, "file string, event bigint, tag int, words array<bigint>")
    return banks.where((F.col("tag") == R.TRIGGER_BANK) & F.col("event").between(20, 49)).select(segment(), "event", F.get("words", F.lit(0)).alias("event_number"))


@query("""SELECT tag, n AS n_banks, n AS n_events, w * n AS n_words FROM (SELECT count(*) AS n FROM orders), (VALUES (49152, 2), (39, 0), (57615, 4)) t(tag, w) UNION ALL SELECT 57610, 2 * count(*), count(*), 11 * count(*) FROM orders
UNION ALL SELECT 128 + k, count(*), count(*), 0 FROM (SELECT o_custkey % 8 AS k FROM orders) WHERE k > 0 GROUP BY k UNION ALL SELECT 128, count(*) + count(*) FILTER (o_custkey % 8 = 0), count(*), 0 FROM orders""")
def bank_file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Banks, events and words of each tag, from the files."""
    path, index = run_files(spark, sf_dir)
    s = B.bank_summary(S.read_events(spark, path, index))
    return s.select(F.col("tag").cast("bigint").alias("tag"), "n_banks", "n_events", F.col("n_words").cast("bigint").alias("n_words"))


@query(f"""WITH e AS (SELECT o_orderkey % {SEGMENTS} AS segment, row_number() OVER (PARTITION BY o_orderkey % {SEGMENTS} ORDER BY o_orderkey) - 1 AS event, o_custkey % 8 AS kind FROM orders)
SELECT segment, row_number() OVER (PARTITION BY segment ORDER BY event) AS number, event FROM e WHERE kind <> 2""")
def bank_file_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the events of each segment that are no monitoring events; top banks only, no payload."""
    path, index = run_files(spark, sf_dir)
    top = S.read_events(spark, path, index, "file string, event bigint, depth int, tag int").where("depth = 0 AND tag >= 128")
    info = stored(top.select("file", "event", (F.col("tag") - 128).alias("trigger_type")), "event-kinds")  # read twice
    return R.event_index(info, F.col("trigger_type") == 2, block=1000).select(segment(), "number", "event")


@query(f"""SELECT segment, event, kind AS trigger_type FROM (SELECT o_orderkey % {SEGMENTS} AS segment, row_number() OVER (PARTITION BY o_orderkey % {SEGMENTS} ORDER BY o_orderkey) - 1 AS event, o_custkey % 8 AS kind FROM orders) WHERE kind <> 2""")
def stream_live_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a run that is read while it may still be written, without monitoring events."""
    path, _ = run_files(spark, sf_dir)
    top = live_banks(spark, path, "file string, event bigint, depth int, tag int").where("depth = 0 AND tag >= 128 AND tag <> 130")
    return run_to_table(top.select(segment(), "event", (F.col("tag").cast("bigint") - 128).alias("trigger_type")), scratch_path(spark, "live"))
