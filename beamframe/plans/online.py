"""Streaming queries, run over all that the events file holds; each gives what the batch SQL gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamframe.operators import counting as C
from beamframe.plans.registry import query, table
from beamframe.plans.scratch import scratch_path
from beamframe.streaming import operators as T
from beamframe.streaming import stateful as ST


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return T.read_stream(spark, sf_dir, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_type, (CASE WHEN floor(value / 5) >= 20 THEN 20 ELSE floor(value / 5) END)::BIGINT AS bin, count(*) AS n_rows FROM events GROUP BY 1, 2")
def stream_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = C.histogram(event_stream(spark, sf_dir), "value", 0.0, 5.0, 20, ["event_type"])
    return T.run_to_table(h, scratch_path(spark, "stream"), "complete")


@query("""SELECT epoch_us(w) AS start, event_type, n, total FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that the watermark has closed; their state is gone."""
    w = T.windowed(event_stream(spark, sf_dir), "ts", "10 minutes", "1 hour", keys=("event_type",))
    out = T.run_to_table(w, scratch_path(spark, "stream"))
    return out.select(F.unix_micros("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE value >= 5 GROUP BY 1")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.run_to_table(T.latest_per_key(event_stream(spark, sf_dir), "user_id", "event_id", "value", 5.0), scratch_path(spark, "stream"), "complete")


@query("""WITH g AS (SELECT user_id, event_id, event_id % 53 AS ungated, event_id % 47 AS gated FROM events), p AS (SELECT *, coalesce(lag(gated) OVER w, 0) AS pg, coalesce(lag(ungated) OVER w, 0) AS pu FROM g WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
d AS (SELECT user_id, event_id, gated - CASE WHEN gated < pg OR ungated < pu THEN 0 ELSE pg END AS dg, ungated - CASE WHEN gated < pg OR ungated < pu THEN 0 ELSE pu END AS du FROM p)
SELECT user_id, event_id, round(CASE WHEN du > 0 THEN dg / du::DOUBLE ELSE -1.0 END, 9) AS live FROM d""")
def stream_live_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_stream(spark, sf_dir).select("user_id", "event_id", (F.col("event_id") % 53).alias("ungated"), (F.col("event_id") % 47).alias("gated"))
    out = T.run_to_table(T.live_fraction(e, "user_id", "event_id", "gated", "ungated"), scratch_path(spark, "stream"))
    return out.withColumn("live", F.round("live", 9))


@query("SELECT user_id, event_id, last_value(CASE WHEN event_type = 'error' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reading FROM events")
def stream_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_stream(spark, sf_dir).select("user_id", "event_id", F.when(F.col("event_type") == "error", F.col("value")).alias("reading"))
    out = T.run_to_table(T.carry_forward(e, "user_id", "event_id", "reading"), scratch_path(spark, "stream"))
    return out.withColumn("reading", F.nanvl("reading", F.lit(None).cast("double")))


@query("SELECT user_id, event_id, event_type, before FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type")
def stream_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_stream(spark, sf_dir).select("user_id", "event_id", "event_type")
    return T.run_to_table(T.boundaries(e, "user_id", "event_id", "event_type"), scratch_path(spark, "stream"))


@query("SELECT user_id, event_id, position FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position FROM events) WHERE position <= 10")
def stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_stream(spark, sf_dir).select("user_id", "event_id")
    return T.run_to_table(T.history(e, "user_id", "event_id", 10), scratch_path(spark, "stream"))


@query("""WITH g AS (SELECT user_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events), s AS (SELECT user_id, ts, sum(CASE WHEN gap IS NULL OR gap >= 600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, count(*) AS n FROM s GROUP BY user_id, s HAVING max(ts) + INTERVAL 10 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that the watermark has closed."""
    out = T.run_to_table(T.sessions(event_stream(spark, sf_dir), "ts", "10 minutes", "10 minutes", "user_id"), scratch_path(spark, "stream"))
    return out.select("user_id", "n")


@query("""WITH e AS (SELECT user_id, event_id, event_type, event_id * 1000003 AS tick, 1700000000 + event_id AS unix FROM events), f AS (SELECT user_id, min(tick) AS first FROM e WHERE event_type = 'click' GROUP BY 1), s AS (SELECT user_id, min(event_id) AS at, min(tick) AS tick, min(unix) AS unix FROM e WHERE event_type = 'error' GROUP BY 1)
SELECT e.user_id, e.event_id, round((e.tick - f.first) * 4e-9, 6) AS seconds, round(CASE WHEN s.at < e.event_id THEN s.unix + (e.tick - s.tick) * 4e-9 END, 4) AS unix_time FROM e JOIN f USING (user_id) LEFT JOIN s USING (user_id) WHERE e.event_type = 'click'""")
def stream_sync_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pulses with seconds since the first one and unix time from the first sync row of their run."""
    kind = F.when(F.col("event_type") == "error", "sync").when(F.col("event_type") == "click", "pulse").otherwise("other")
    e = event_stream(spark, sf_dir).select("user_id", "event_id", kind.alias("kind"), (F.col("event_id") * 1000003).alias("tick"), (F.col("event_id") + 1700000000).alias("unix"))
    out = T.run_to_table(T.anchored_times(e, "user_id", "event_id", "kind", "tick", "unix"), scratch_path(spark, "stream"))
    return out.select("user_id", "event_id", F.round("seconds", 6).alias("seconds"), F.round(F.nanvl("unix_time", F.lit(None).cast("double")), 4).alias("unix_time"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), g AS (SELECT user_id, event_id, k, event_id AS last, TRUE AS kept FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN e.event_id - g.last >= 500 THEN e.event_id ELSE g.last END, e.event_id - g.last >= 500 FROM g JOIN e ON e.user_id = g.user_id AND e.k = g.k + 1)
SELECT user_id, event_id FROM g WHERE kept""")
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notifications of a user, at most one in 500 event numbers."""
    e = event_stream(spark, sf_dir).select("user_id", "event_id")
    return T.run_to_table(T.at_most_every(e, "user_id", "event_id", 500), scratch_path(spark, "stream"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), g AS (SELECT user_id, event_id, k, 0::BIGINT AS flush, 1::BIGINT AS n, event_id AS begun FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.event_id, e.k, g.flush + CASE WHEN g.n >= 8 OR e.event_id - g.begun >= 900 THEN 1 ELSE 0 END, CASE WHEN g.n >= 8 OR e.event_id - g.begun >= 900 THEN 1 ELSE g.n + 1 END, CASE WHEN g.n >= 8 OR e.event_id - g.begun >= 900 THEN e.event_id ELSE g.begun END FROM g JOIN e ON e.user_id = g.user_id AND e.k = g.k + 1)
SELECT user_id, event_id, flush FROM g""")
def stream_flush_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that are flushed at eight rows or after 900 event numbers."""
    e = event_stream(spark, sf_dir).select("user_id", "event_id")
    return T.run_to_table(T.flush_groups(e, "user_id", "event_id", 8, 900), scratch_path(spark, "stream"))


_FLUSHED = """e AS (SELECT user_id, event_id, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
g AS (SELECT user_id, event_id, k, ms AS begun, ms, 0::BIGINT AS flush, 1::BIGINT AS n, ''::VARCHAR AS why FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN g.n >= 8 OR e.ms - g.begun >= 7200000 THEN e.ms ELSE g.begun END, e.ms, g.flush + CASE WHEN g.n >= 8 OR e.ms - g.begun >= 7200000 THEN 1 ELSE 0 END, CASE WHEN g.n >= 8 OR e.ms - g.begun >= 7200000 THEN 1 ELSE g.n + 1 END, '' FROM g JOIN e ON e.user_id = g.user_id AND e.k = g.k + 1)"""


@query(f"""WITH RECURSIVE {_FLUSHED}, w AS (SELECT user_id, flush, count(*) AS n_rows, min(event_id) AS first, max(event_id) AS last, min(begun) AS begun FROM g GROUP BY 1, 2),
c AS (SELECT *, flush < max(flush) OVER (PARTITION BY user_id) AS followed FROM w)
SELECT user_id, flush, n_rows, first, last, CASE WHEN n_rows = 8 THEN 'size' ELSE 'age' END AS reason FROM c
WHERE n_rows = 8 OR followed OR begun + 7200000 <= (SELECT epoch_ms(max(ts)) FROM events) - 600000""")
def stream_timed_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups flushed at eight rows or two hours after the first one: by a later row or, where none comes, by the
    timer that the watermark reaches."""
    e = event_stream(spark, sf_dir).select("user_id", "event_id", "ts")
    return T.run_to_table(ST.flush_by_size_or_age(e, "user_id", "event_id", "ts", 8, 7_200_000, "10 minutes"), scratch_path(spark, "stream"), provider=ST.ROCKSDB)


@query("""WITH r AS (SELECT user_id % 4 AS run, event_id, event_type AS channel, value FROM events WHERE event_type <> 'click' AND value IS NOT NULL), c AS (SELECT DISTINCT run, channel FROM r), p AS (SELECT user_id % 4 AS run, event_id FROM events WHERE event_type = 'click'),
x AS (SELECT run, channel, event_id, value, FALSE AS wanted FROM r UNION ALL SELECT run, channel, event_id, NULL, TRUE FROM p JOIN c USING (run)), f AS (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY run, channel ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS latest FROM x)
SELECT run, event_id, channel, latest AS value FROM f WHERE wanted AND latest IS NOT NULL""")
def stream_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every physics event with the latest reading of all channels of its run."""
    channel = F.when(F.col("event_type") != "click", F.col("event_type"))
    e = event_stream(spark, sf_dir).select((F.col("user_id") % 4).alias("run"), "event_id", channel.alias("channel"), "value")
    return T.run_to_table(ST.snapshots(e, "run", "event_id", "channel", "value"), scratch_path(spark, "stream"), provider=ST.ROCKSDB)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), g AS (SELECT user_id, event_id, k, event_id AS last, TRUE AS kept FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN e.event_id - g.last >= 50 THEN e.event_id ELSE g.last END, e.event_id - g.last >= 50 FROM g JOIN e ON e.user_id = g.user_id AND e.k = g.k + 1),
s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, count(*) OVER (PARTITION BY user_id) AS n FROM g WHERE kept)
SELECT user_id, seq % 20 AS slot, event_id FROM s WHERE seq > n - 20""")
def stream_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ring of a user's last 20 events, let in at least 50 event numbers apart."""
    e = event_stream(spark, sf_dir).select("user_id", "event_id")
    pushed = T.run_to_table(ST.throttled_ring(e, "user_id", "event_id", "event_id", 20, 50), scratch_path(spark, "stream"), provider=ST.ROCKSDB)
    return ST.ring_content(pushed, "user_id", "event_id")
