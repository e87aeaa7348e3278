"""Decoding, parsing and file queries. Readout words are packed from lineitem, then taken apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamframe.functions import decode as D
from beamframe.plans.registry import query, table
from beamframe.sources import files as S


def _word(*parts: tuple[str, int]):
    out = F.lit(0).cast("bigint")
    for e, shift in parts:
        out = out.bitwiseOR(F.shiftleft(F.expr(f"cast({e} as bigint)"), shift))
    return out


@query("SELECT l_orderkey AS event, l_linenumber::BIGINT AS slot, (l_suppkey % 2)::BIGINT AS edge, (l_partkey % 128)::BIGINT AS channel, (floor(l_extendedprice)::BIGINT % 524288)::BIGINT AS value FROM lineitem")
def tdc_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TDC words packed and decoded again."""
    price = "cast(floor(l_extendedprice) as bigint)"
    w = _word(("l_linenumber", 27), ("l_suppkey % 2", 26), ("l_partkey % 128", 19), (f"{price} % 524288", 0))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event"), D.tdc_word(w).alias("h")).select("event", "h.slot", "h.edge", "h.channel", "h.value")


@query("""WITH w AS (SELECT l_orderkey AS event, l_linenumber::BIGINT AS slot, l_partkey % 64 AS channel, (floor(l_extendedprice)::BIGINT // 10) % 16384 AS value FROM lineitem) SELECT event, slot, channel, value - 2000 AS value FROM w WHERE value - 2000 >= 3.0 * 150""")
def sparsified_adc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ADC words decoded, pedestal subtracted and zero suppressed."""
    price = "cast(floor(l_extendedprice) as bigint)"
    w = _word(("l_linenumber", 27), ("l_partkey % 64", 17), (f"({price} div 10) % 16384", 0))
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event"), D.adc_word(w).alias("h")).select("event", "h.slot", "h.channel", D.sparsify(F.col("h.value"), F.lit(2000), F.lit(150), 3.0).cast("bigint").alias("value"))
    return x.where("value IS NOT NULL")


@query("WITH t AS (SELECT o_orderkey AS event, ((o_custkey % 65536) * 4294967296 + (o_orderkey * 40503) % 4294967296)::BIGINT AS ticks FROM orders) SELECT event, ticks, round(ticks * 4e-9, 6) AS seconds FROM t")
def wide_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """48-bit ticks from two words, and seconds."""
    t = D.timestamp_48(F.col("o_orderkey") * 40503, F.col("o_custkey"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event"), t.alias("ticks"), F.round(D.ticks_to_seconds(t), 6).alias("seconds"))


@query("SELECT vec_id, list_aggregate(list_transform(embedding[1:16]::DOUBLE[], lambda v: (4000 + round(500 * v))::BIGINT), 'sum')::BIGINT AS total, (4000 + round(500 * embedding[1]::DOUBLE))::BIGINT AS first FROM embeddings")
def raw_window_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples packed two to a word and unpacked."""
    s = F.transform(F.slice("embedding", 1, 16), lambda v: (4000 + F.round(500 * v.cast("double"))).cast("bigint"))
    words = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.shiftleft(F.get(s, i * 2), 16).bitwiseOR(F.get(s, i * 2 + 1)))
    back = F.flatten(F.transform(words, D.sample_pair))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.aggregate(back, F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total"), F.get(back, F.lit(0)).alias("first"))


@query("SELECT CASE WHEN p_size BETWEEN 1 AND 10 THEN 'physics' WHEN p_size BETWEEN 11 AND 20 THEN 'monitoring' WHEN p_size BETWEEN 21 AND 24 THEN 'control' WHEN p_size = 31 THEN 'epics' ELSE 'other' END AS class, count(*) AS n FROM part GROUP BY 1")
def event_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.event_class(F.col("p_size"), {"physics": (1, 10), "monitoring": (11, 20), "control": (21, 24), "epics": (31, 31)})
    return table(spark, sf_dir, "part").groupBy(c.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_type AS name, count(*) AS n, round(sum(round(value, 2)), 4) AS total FROM events GROUP BY ALL")
def parsed_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slow-control text `<number> <name>` parsed; a bad line in every text is skipped."""
    e = table(spark, sf_dir, "events")
    text = F.concat(F.lit("bad\n  "), F.round("value", 2).cast("string"), F.lit("  "), F.col("event_type"), F.lit(" \nx y"))
    r = e.select("user_id", F.explode(D.parse_readings(text)).alias("r")).select("user_id", "r.name", "r.value")
    return r.groupBy("user_id", "name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT (json_extract(props, '$.k'))::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def json_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events")
def flattened_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.flatten_json(table(spark, sf_dir, "events").select("event_id", "props"), "event_id", "props", depth=2)


@query("SELECT r.n FROM (SELECT unnest(range((SELECT min(s_suppkey) FROM supplier WHERE s_suppkey % 7 <> 3), (SELECT max(s_suppkey) FROM supplier WHERE s_suppkey % 7 <> 3) + 1)) AS n) r WHERE r.n NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 <> 3)")
def missing_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.missing_segments(table(spark, sf_dir, "supplier").where("s_suppkey % 7 <> 3").select(F.col("s_suppkey").alias("n")), "n")


@query("SELECT o_orderkey, o_totalprice AS value, NULL::VARCHAR AS name FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT c_custkey, NULL, c_name FROM customer WHERE c_custkey % 10 = 0")
def concatenated_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables with different columns, every tenth row of each."""
    a = S.every_nth(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("value")), "o_orderkey", 10)
    b = S.every_nth(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_orderkey"), F.col("c_name").alias("name")), "o_orderkey", 10)
    return S.concat(a, b)


@query("SELECT l_returnflag || '/' || l_linestatus AS path, count(*) AS n, round(count(*) / (SELECT count(DISTINCT l_orderkey) FROM lineitem x WHERE x.l_returnflag = l.l_returnflag)::DOUBLE, 6) AS per_parent FROM lineitem l GROUP BY l_returnflag, l_linestatus")
def tag_path_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a tag path occurs, in all and for each of its parents."""
    li = table(spark, sf_dir, "lineitem")
    parents = li.groupBy("l_returnflag").agg(F.countDistinct("l_orderkey").alias("parents"))
    n = li.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n")).join(parents, "l_returnflag")
    return n.select(F.concat_ws("/", "l_returnflag", "l_linestatus").alias("path"), "n", F.round(F.col("n") / F.col("parents"), 6).alias("per_parent"))


@query("""WITH w AS (SELECT o_orderkey AS event, list_transform(range(16), lambda i: ((o_orderkey * (i + 1)) % 97)::BIGINT) AS g, list_transform(range(16), lambda i: ((o_custkey * (i + 1)) % 101)::BIGINT) AS u FROM orders)
SELECT event, g[3] AS gated, u[3] AS ungated, round(CASE WHEN g[3] > 0 AND u[3] >= g[3] THEN g[3] / u[3]::DOUBLE END, 9) AS live FROM w""")
def scaler_readouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 gated and 16 ungated counters of a readout, and a channel's live fraction where it makes sense."""
    numbers = F.sequence(F.lit(1), F.lit(16))
    words = F.concat(F.transform(numbers, lambda i: (F.col("o_orderkey") * i) % 97), F.transform(numbers, lambda i: (F.col("o_custkey") * i) % 101))
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event"), D.scaler_block(words, 2).alias("s"))
    return s.select("event", F.get("s.gated", F.lit(2)).alias("gated"), F.get("s.ungated", F.lit(2)).alias("ungated"), F.round("s.live", 9).alias("live"))


@query("""SELECT page_id, split_part(split_part(url, '?', 1), '#', 1) AS plain, regexp_extract(url, '[?&]([^=&#]*)=', 1) AS name FROM pages""")
def decoded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent-encoded channel names as plain text; here page addresses are encoded first. A name with a bad
    escape stays as it came."""
    u = table(spark, sf_dir, "pages").select("page_id", F.url_encode("url").alias("u"))
    plain = F.coalesce(F.try_url_decode("u"), F.col("u"))
    return u.select("page_id", F.regexp_extract(plain, "^[^?#]*", 0).alias("plain"), F.regexp_extract(plain, "[?&]([^=&#]*)=", 1).alias("name"))
