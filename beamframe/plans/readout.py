"""Readout streams, bank trees and strips. Words and banks are packed from the tables, then taken apart."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamframe.operators import readout as R
from beamframe.plans.decoding import _word
from beamframe.plans.registry import query, table
from beamframe.sources import banks as B

TOP = 1 << 31


def _define(kind: int, *parts: tuple[str, int]):
    return F.lit(TOP | kind << 27).bitwiseOR(_word(*parts))


def strip_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream per part: filler, a frame with three strips (one of them void), common modes, a fourth strip."""
    s = lambda k: f"((p_partkey * {k} + p_size) % 8192)"
    strip = lambda n, k: [_word((s(k), 0), (s(k + 1), 13), (f"({n}) % 32", 26)), _word((s(k + 2), 0), (s(k + 3), 13), (f"({n}) div 32", 26)), _word((s(k + 4), 0), (s(k + 5), 13), ("p_partkey % 16", 26))]
    cm = [_define(R.COMMON_MODE, ("p_size", 0), ("p_size + 1", 13)), _word(("p_size + 2", 0), ("p_size + 3", 13)), _word(("p_size + 4", 0), ("p_size + 5", 13))]
    words = F.array(F.lit(TOP | 15 << 27), _word(("7", 0)), _define(R.FRAME, ("p_partkey % 64", 16), ("p_size % 32", 22)), *strip("p_size", 1), *strip("p_size + 64", 7), *strip("200", 3), *cm, *strip("127", 11), _word(("5", 0)))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("event"), words.alias("words"))


_TS = lambda k: ", ".join(f"CASE WHEN v{j} >= 4096 THEN v{j} - 8192 ELSE v{j} END" for j in range(k, k + 6))
_V = ", ".join(f"(p_partkey * {k} + p_size) % 8192 AS v{k}" for k in range(1, 17))


@query(f"""WITH v AS (SELECT p_partkey AS event, p_partkey % 64 AS fiber, p_partkey % 16 AS chip, p_size % 32 AS flags, p_size::BIGINT AS p_size, {_V} FROM part), s AS (
SELECT event, fiber, chip, p_size AS strip, flags, [{_TS(1)}] AS ts FROM v UNION ALL SELECT event, fiber, chip, p_size + 64, flags, [{_TS(7)}] FROM v UNION ALL SELECT event, fiber, chip, 127, flags, [{_TS(11)}] FROM v)
SELECT event, fiber, chip, strip::BIGINT AS strip, flags::BIGINT AS flags, ts[1]::BIGINT AS first, ts[6]::BIGINT AS last, list_sum(ts)::BIGINT AS total FROM s""")
def strip_readout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips of tagged readout streams: frames, void strips, a common-mode record between them."""
    s = R.strip_readout(strip_streams(spark, sf_dir), ["event"], "words")
    return s.select("event", "fiber", "chip", "strip", "flags", F.get("ts", F.lit(0)).alias("first"), F.get("ts", F.lit(5)).alias("last"), F.aggregate("ts", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total"))


@query("SELECT p_partkey AS event, p_partkey % 64 AS fiber, p_partkey % 16 AS chip, [p_size, p_size + 1, p_size + 2, p_size + 3, p_size + 4, p_size + 5]::BIGINT[] AS cm FROM part")
def online_common_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.online_common_modes(strip_streams(spark, sf_dir), ["event"], "words")


def trigger_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream per order: a block with event number and time, two peaks, a cluster, a peak cut short."""
    k = "o_orderkey"
    peak = lambda n: [_define(R.PEAK, (f"{k} % 2", 26), (f"({k} + {n}) % 4", 24), (f"({k} * {n}) % 256", 16)), _word((f"({k} + {n}) % 1024", 16), (f"({k} * {n}) % 65536", 0))]
    words = F.array(
        _define(R.BLOCK_HEAD, ("o_custkey % 32", 22), ("3", 18), (f"{k} % 1024", 8), ("1", 0)), _define(R.EVENT_HEAD, (f"{k} % 134217728", 0)),
        _define(R.TRIGGER_TIME, (f"({k} * 7) % 16777216", 0)), _word(("o_custkey % 16777216", 0)),
        *peak(1), *peak(5), _define(R.CLUSTER, (f"{k} % 2", 26), (f"{k} % 256", 16), ("o_custkey % 65536", 0)), _word((f"{k} % 1024", 20), ("o_custkey % 1024", 10), (f"({k} + o_custkey) % 1024", 0)),
        _define(R.PEAK, ("1", 26)), _define(R.BLOCK_END, (f"(o_custkey + {k} % 5 div 4) % 32", 22), ("12", 0)),
    )
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event"), words.alias("words"))


@query("""SELECT o_orderkey AS event, o_custkey % 32 AS slot, 3::BIGINT AS module, o_orderkey % 1024 AS number, 1::BIGINT AS level, o_orderkey % 134217728 AS event_number,
(o_custkey % 16777216) * 16777216 + (o_orderkey * 7) % 16777216 AS trigger_time, 12::BIGINT AS n_words, o_orderkey % 5 = 4 AS wrong_end FROM orders""")
def trigger_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a trigger processor with event number, 48-bit time and trailer check."""
    return R.trigger_records(trigger_streams(spark, sf_dir), ["event"], "words")["blocks"]


@query("""SELECT event, kind, side, view, time, a, b, c, energy FROM (
SELECT o_orderkey AS event, 'peak' AS kind, o_orderkey % 2 AS side, (o_orderkey + n) % 4 AS view, (o_orderkey * n) % 256 AS time, (o_orderkey + n) % 1024 AS a, NULL::BIGINT AS b, NULL::BIGINT AS c, (o_orderkey * n) % 65536 AS energy FROM orders, (VALUES (1), (5)) t(n)
UNION ALL SELECT o_orderkey, 'cluster', o_orderkey % 2, NULL, o_orderkey % 256, o_orderkey % 1024, o_custkey % 1024, (o_orderkey + o_custkey) % 1024, o_custkey % 65536 FROM orders)""")
def trigger_peaks_and_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = R.trigger_records(trigger_streams(spark, sf_dir), ["event"], "words")
    none = F.lit(None).cast("bigint")
    p = t["peaks"].select("event", F.lit("peak").alias("kind"), "side", "view", "time", F.col("coordinate").alias("a"), none.alias("b"), none.alias("c"), "energy")
    c = t["clusters"].select("event", F.lit("cluster").alias("kind"), "side", none.alias("view"), "time", F.col("w").alias("a"), F.col("v").alias("b"), F.col("u").alias("c"), "energy")
    return p.unionByName(c)


def bank_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank trees as `read_banks` gives them, from orders: event, trigger bank, master crate with its
    interface and run info, a crate with a shorter interface bank."""
    arr = lambda *w: F.array(*[F.expr(x).cast("bigint") for x in w])
    bank = lambda node, parent, depth, tag, kind, words: F.struct(F.lit(node).alias("node"), F.lit(parent).alias("parent"), F.lit(depth).alias("depth"), tag.alias("tag"), F.lit(kind).alias("type"), words.alias("words"))
    none = F.lit(None).cast("array<bigint>")
    t = lambda x: F.lit(x).cast("bigint")
    short = arr("0", "o_orderkey", "o_orderkey * 3", "o_custkey")
    tree = F.array(
        bank(0, -1, 0, F.col("o_custkey") % 8 + 0x80, 0x10, none), bank(1, 0, 1, t(R.TRIGGER_BANK), 1, arr("o_orderkey", "0")),
        bank(2, 0, 1, t(0x80), 0x10, none), bank(3, 2, 2, t(R.TRIGGER_INTERFACE), 1, short),
        bank(4, 0, 1, t(R.MASTER_CRATE), 0x10, none), bank(5, 4, 2, t(R.TRIGGER_INTERFACE), 1, arr("0", "7", "8", "9", "0", "o_custkey % 256", "0")),
        bank(6, 4, 2, t(R.RUN_INFO), 1, arr("0", "o_custkey % 20", "1", "1700000000 + o_orderkey")),
    )
    o = table(spark, sf_dir, "orders").select(F.lit("run").alias("file"), F.col("o_orderkey").alias("event"), F.explode(tree).alias("b"))
    return o.select("file", "event", "b.*")


@query("""SELECT o_orderkey AS event, o_custkey % 8 AS trigger_type, o_orderkey AS event_number, o_orderkey AS trigger_number, (o_custkey % 65536) * 4294967296 + o_orderkey * 3 AS timestamp,
CASE WHEN o_custkey % 256 > 0 THEN o_custkey % 256 END AS trigger_bits, o_custkey % 20 AS run, 1700000000 + o_orderkey AS unix_time FROM orders""")
def event_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event, trigger and run numbers, times and trigger bits of bank trees."""
    return R.event_info(bank_trees(spark, sf_dir)).drop("file", "tag")


@query("SELECT o_orderkey AS event, row_number() OVER (ORDER BY o_orderkey) AS number FROM orders WHERE o_custkey % 8 <> 2")
def event_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the events of a file that are no monitoring events."""
    info = R.event_info(bank_trees(spark, sf_dir))
    return R.event_index(info, F.col("trigger_type") == 2, block=1000).drop("file")


@query("SELECT tag, n AS n_banks, n AS n_events, w * n AS n_words FROM (SELECT count(*) AS n FROM orders), (VALUES (49152, 2), (39, 0), (57615, 4)) t(tag, w) UNION ALL SELECT 57610, 2 * count(*), count(*), 11 * count(*) FROM orders UNION ALL SELECT 128 + k, count(*), count(*), 0 FROM (SELECT o_custkey % 8 AS k FROM orders) WHERE k > 0 GROUP BY k UNION ALL SELECT 128, count(*) + count(*) FILTER (o_custkey % 8 = 0), count(*), 0 FROM orders")
def bank_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bank_summary(bank_trees(spark, sf_dir)).select("tag", "n_banks", "n_events", F.col("n_words").cast("bigint").alias("n_words"))


@query("""SELECT vec_id, (3 + c)::INT AS slot, c::INT AS channel, (vec_id * 10)::BIGINT AS timestamp, list_sum(list_transform(embedding[c * 16 + 1:c * 16 + 16]::DOUBLE[], lambda v: (4000 + round(500 * v))::BIGINT))::BIGINT AS total
FROM embeddings, (VALUES (0), (1), (2), (3)) t(c)""")
def composite_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite payloads, encoded from the embeddings and decoded again."""
    s = F.transform("embedding", lambda v: (4000 + F.round(500 * v.cast("double"))).cast("int"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"vec_id": pdf.vec_id, "payload": [B.encode_composite([(3 + c, int(i), int(i) * 10, [(c, x[c * 16 : c * 16 + 16])]) for c in range(4)]) for i, x in zip(pdf.vec_id, pdf.s, strict=True)]})

    packed = table(spark, sf_dir, "embeddings").select("vec_id", s.alias("s")).mapInPandas(pack, "vec_id bigint, payload binary")
    return B.decode_composite(packed, ["vec_id"], "payload").select("vec_id", "slot", "channel", "timestamp", F.aggregate("samples", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total"))


@query("""WITH c AS (SELECT s_suppkey, s_suppkey % 128 AS ch, s_suppkey % 12 AS plane, s_suppkey % 3 = 0 AS flip FROM supplier), w AS (SELECT *, 32 * (ch % 4) + 8 * (ch // 4) - 31 * (ch // 16) AS a FROM c),
p AS (SELECT *, a + 1 + a % 4 - 5 * ((a // 4) % 2) AS b FROM w), f AS (SELECT *, CASE WHEN b % 2 = 1 THEN 32 - (b + 1) // 2 ELSE 32 + b // 2 END & 127 AS own FROM p)
SELECT s_suppkey, CASE WHEN flip THEN 127 - own ELSE own END + plane * 128 AS strip FROM f""")
def strip_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of chips mapped to strips of their planes."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", R.map_strip(k % 128, k % 12, k % 3 == 0).alias("strip"))


@query("""WITH x AS (SELECT vec_id, label::BIGINT AS label, unnest(embedding::DOUBLE[]) * 500 AS v, unnest(range(64)) AS i FROM embeddings), g AS (SELECT vec_id, label, i // 6 AS strip, max(v) AS charge, arg_max(i % 6, (v, -i)) AS time_bin, sum(v) AS total FROM x WHERE i < 60 GROUP BY ALL)
SELECT vec_id, strip::BIGINT AS strip, round(charge, 6) AS charge, time_bin::BIGINT AS time_bin, round(total, 6) AS total, charge < 80 AND charge > 50 AS cross_talk FROM g WHERE charge > 50""")
def strip_hits_with_cross_talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits over five times the noise; under eight times it they may be cross-talk."""
    x = F.transform("embedding", lambda v: v.cast("double") * 500)
    six = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.slice(x, k * 6 + 1, 6))
    s = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(six).alias("strip", "ts")).select("vec_id", F.col("strip").cast("bigint").alias("strip"), R.strip_hits(F.col("ts"), F.lit(10.0)).alias("h"))
    return s.where("h.charge > 50").select("vec_id", "strip", F.round("h.charge", 6).alias("charge"), F.col("h.time_bin").cast("bigint").alias("time_bin"), F.round("h.total", 6).alias("total"), "h.cross_talk")


@query("""WITH c AS (SELECT l_orderkey AS plane, l_quantity AS centre, max(l_extendedprice) AS peak, min(l_extendedprice) < 30000 AS pure FROM lineitem GROUP BY 1, 2)
SELECT plane, centre, peak, pure, pure AND EXISTS (SELECT 1 FROM c o WHERE o.plane = c.plane AND o.peak > c.peak AND ((abs(o.centre - c.centre) > 5 AND abs(o.centre - c.centre) < 9) OR (abs(o.centre - c.centre) > 18 AND abs(o.centre - c.centre) < 22))) AS cross_talk FROM c""")
def cross_talk_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of doubtful hits at characteristic distances from larger ones."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("plane"), F.col("l_quantity").alias("centre")).agg(F.max("l_extendedprice").alias("peak"), (F.min("l_extendedprice") < 30000).alias("pure"))
    return R.mark_cross_talk(c, ["plane"], [7.0, 20.0], 2.0)


_SYNC = """e AS (SELECT o_orderkey AS event, o_custkey % 8 AS kind, o_custkey, o_orderkey FROM orders), t AS (SELECT event, CASE kind WHEN 0 THEN o_custkey % 20 WHEN 1 THEN o_custkey % 30 END AS run, CASE WHEN kind = 0 THEN o_orderkey END AS counter,
CASE kind WHEN 0 THEN 1700000000 + o_orderkey WHEN 1 THEN 1600000000 + o_orderkey END AS unix_time, CASE kind WHEN 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 31 ELSE o_orderkey % 3 END WHEN 1 THEN 17 END AS event_tag, CASE WHEN kind = 1 THEN o_custkey % 256 END AS run_type FROM e)"""


@query(f"""WITH {_SYNC} SELECT event, last_value(run IGNORE NULLS) OVER w AS run, last_value(counter IGNORE NULLS) OVER w AS counter, last_value(unix_time IGNORE NULLS) OVER w AS unix_time, last_value(event_tag IGNORE NULLS) OVER w AS event_tag, last_value(run_type IGNORE NULLS) OVER w AS run_type FROM t
WINDOW w AS (ORDER BY event ROWS UNBOUNDED PRECEDING)""")
def sync_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run, counter, time and run type as sync banks and control events left them, for every event."""
    t = lambda x: F.lit(x).cast("bigint")
    arr = lambda *w: F.array(*[F.expr(x).cast("bigint") for x in w])
    bank = lambda node, parent, depth, tag, kind, words: F.struct(F.lit(node).alias("node"), F.lit(parent).alias("parent"), F.lit(depth).alias("depth"), tag.alias("tag"), F.lit(kind).alias("type"), words.alias("words"))
    none = F.lit(None).cast("array<bigint>")
    kind = F.col("o_custkey") % 8
    sync = F.array(bank(0, -1, 0, t(0x1F), 0x10, none), bank(1, 0, 1, t(0x27), 0x10, none), bank(2, 1, 2, t(R.SYNC_HEAD), 1, arr("0", "o_custkey % 20", "o_orderkey", "1700000000 + o_orderkey", "o_orderkey % 3")))
    control = F.array(bank(0, -1, 0, t(0x11), 0x10, none), bank(1, 0, 1, t(0x11), 1, arr("1600000000 + o_orderkey", "o_custkey % 30", "o_custkey")))
    other = F.array(bank(0, -1, 0, t(0x80), 0x10, none), bank(1, 0, 1, t(R.TRIGGER_BANK), 1, arr("o_orderkey", "7", "7")))
    trees = table(spark, sf_dir, "orders").select(F.lit("run").alias("file"), F.col("o_orderkey").alias("event"), F.explode(F.when(kind == 0, sync).when(kind == 1, control).otherwise(other)).alias("b"))
    return R.sync_snapshots(trees.select("file", "event", "b.*"), 4096).drop("file")
