"""Slow-control queries on the events table: `click` rows are physics events, `error` and `signup`
rows are readings of a gate channel and of a gated channel, in the order of event_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamframe.operators import ordered as O
from beamframe.plans.registry import query, table
from beamframe.plans.scratch import stored

BLOCK = 1 << 20  # event numbers in a block
GATE_MIN, N_SIGMA = 20.0, 3.0

_FILLED = """
s AS (SELECT event_id, event_type, value,
        last_value(CASE WHEN event_type = 'error' THEN value END IGNORE NULLS) OVER w AS gate,
        last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER w AS gated
      FROM events WHERE event_type IN ('error', 'signup')
      WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT value FROM s WHERE event_type = 'signup' AND gate >= 20),
m AS (SELECT median(value) AS med, count(*) AS n FROM g),
st AS (SELECT m.med, m.n, 1.4826 * median(abs(g.value - m.med)) AS sigma FROM g, m GROUP BY m.med, m.n),
c AS (SELECT s.event_id, s.gate, s.gated, coalesce(s.gate >= 20, FALSE) AS gate_ok,
        coalesce(s.gated IS NOT NULL AND (NOT (st.n > 1 AND st.sigma > 0) OR abs(s.gated - st.med) <= 3 * st.sigma), FALSE) AS gated_ok
      FROM s LEFT JOIN st ON TRUE)
"""


def filled_readings(events: DataFrame) -> DataFrame:
    """Readings in order, each with the latest value of both channels."""
    slow = events.where(F.col("event_type").isin("error", "signup")).select(
        "event_id", "event_type", "value", F.when(F.col("event_type") == "error", F.col("value")).alias("gate"), F.when(F.col("event_type") == "signup", F.col("value")).alias("gated")
    )
    return O.forward_fill(slow, ["event_id"], ["gate", "gated"], block=BLOCK)


def gated_stats(filled: DataFrame) -> DataFrame:
    return O.robust_stats(filled.where((F.col("event_type") == "signup") & O.within(F.col("gate"), GATE_MIN)), "value")


def checkpoints(events: DataFrame) -> DataFrame:
    filled = stored(filled_readings(events), "readings")  # for the statistics, the verdicts and the marks
    both = O.with_one(filled, gated_stats(filled))  # one row, none without readings
    gate_ok = O.within(F.col("gate"), GATE_MIN)
    gated_ok = O.within_sigma(F.col("gated"), F.col("median"), F.col("sigma"), F.col("is_valid"), N_SIGMA)
    return both.select("event_id", "gate", "gated", gate_ok.alias("gate_ok"), gated_ok.alias("gated_ok")).withColumn("good", F.col("gate_ok") & F.col("gated_ok"))


@query(f"""WITH {_FILLED},
k AS (SELECT event_id, gate_ok AND gated_ok AS good, lead(event_id) OVER (ORDER BY event_id) AS hi,
        lead(gate_ok AND gated_ok) OVER (ORDER BY event_id) AS next_good FROM c)
SELECT e.event_id, e.user_id, e.value FROM events e JOIN k ON e.event_id > k.event_id AND e.event_id <= k.hi
WHERE e.event_type = 'click' AND k.good AND k.next_good""")
def slow_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physics events inside intervals whose two checkpoints pass every cut."""
    events = table(spark, sf_dir, "events")
    physics = events.where(F.col("event_type") == "click").select("event_id", "user_id", "value")
    return O.in_good_interval(physics, checkpoints(events), "event_id", "good", block=BLOCK)


@query(f"WITH {_FILLED} SELECT event_id, gate, gated, gate_ok, gated_ok, gate_ok AND gated_ok AS good FROM c")
def slow_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoints(table(spark, sf_dir, "events"))


@query(f"""WITH {_FILLED}, v AS (SELECT 'gate' AS channel, gate_ok AS ok FROM c UNION ALL SELECT 'gated', gated_ok FROM c UNION ALL SELECT 'overall', gate_ok AND gated_ok FROM c)
SELECT channel, count(*) AS n, count(*) FILTER (ok) AS n_pass, count(*) FILTER (NOT ok) AS n_fail, round(100.0 * count(*) FILTER (ok) / count(*), 6) AS pass_pct FROM v GROUP BY channel""")
def slow_channel_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass and fail counts of every channel over the checkpoints."""
    c = checkpoints(table(spark, sf_dir, "events"))
    v = c.select(F.explode(F.array(*[F.struct(F.lit(n).alias("channel"), F.col(o).alias("ok")) for n, o in (("gate", "gate_ok"), ("gated", "gated_ok"), ("overall", "good"))])).alias("x")).select("x.*")
    n, ok = F.count(F.lit(1)), F.count_if("ok")
    return v.groupBy("channel").agg(n.alias("n"), ok.alias("n_pass"), F.count_if(~F.col("ok")).alias("n_fail"), F.round(100.0 * ok / n, 6).alias("pass_pct"))


@query(f"""WITH {_FILLED}, k AS (SELECT event_id AS hi, gate_ok AND gated_ok AS good, lag(event_id) OVER (ORDER BY event_id) AS lo, lag(gate_ok AND gated_ok) OVER (ORDER BY event_id) AS prev FROM c)
SELECT lo, hi FROM k WHERE good AND prev""")
def slow_keep_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.adjacent_intervals(checkpoints(table(spark, sf_dir, "events")), "event_id", "good", block=BLOCK)


@query(f"WITH {_FILLED} SELECT n, med AS median, round(sigma, 9) AS sigma FROM st")
def gated_robust_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = gated_stats(filled_readings(table(spark, sf_dir, "events")))
    return s.select("n", "median", F.round("sigma", 9).alias("sigma"))


@query("""WITH m AS (SELECT event_type, count(value) AS n, median(value) AS median FROM events GROUP BY event_type),
d AS (SELECT event_type, n, median, median(abs(value - median)) AS mad FROM events JOIN m USING (event_type) GROUP BY ALL)
SELECT event_type, n, median, round(mad, 9) AS mad, round(1.4826 * mad, 9) AS sigma, n > 1 AND mad > 0 AS is_valid FROM d""")
def robust_stats_by_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = O.robust_stats(table(spark, sf_dir, "events"), "value", ["event_type"])
    return s.select("event_type", "n", "median", F.round("mad", 9).alias("mad"), F.round("sigma", 9).alias("sigma"), "is_valid")


@query("""WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1), d AS (SELECT event_type, med, 1.4826 * median(abs(value - med)) AS sg FROM events JOIN m USING (event_type) GROUP BY ALL)
SELECT event_id, event_type, value FROM events JOIN d USING (event_type) WHERE value >= 1 AND abs(value - med) <= 2 * sg""")
def absolute_and_relative_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    s = O.robust_stats(e, "value", ["event_type"])
    kept = e.join(s, "event_type").where(O.within(F.col("value"), 1.0) & O.within_sigma(F.col("value"), F.col("median"), F.col("sigma"), F.col("is_valid"), 2.0))
    return kept.select("event_id", "event_type", "value")


def counters(events: DataFrame) -> DataFrame:
    """Two cumulative counters per user that wrap round, so that some readouts run backwards."""
    e = events.select("user_id", "event_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.col("event_type") != "error").cast("bigint").alias("ok"))
    c = O.running_totals(e, "event_id", {"all": F.lit(1), "good": F.coalesce("ok", F.lit(0))}, ["user_id"], BLOCK)
    return c.select("user_id", "event_id", "value", "us", (F.col("all") % 53).alias("ungated"), (F.col("good") % 47).alias("gated"))


_COUNTERS = """
c AS (SELECT user_id, event_id, value, epoch_us(ts) AS us,
        count(*) OVER w % 53 AS ungated, count(*) FILTER (event_type <> 'error') OVER w % 47 AS gated
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
p AS (SELECT *, coalesce(lag(gated) OVER v, 0) AS pg, coalesce(lag(ungated) OVER v, 0) AS pu FROM c WINDOW v AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT user_id, event_id, us, value, gated - CASE WHEN gated < pg OR ungated < pu THEN 0 ELSE pg END AS dg, ungated - CASE WHEN gated < pg OR ungated < pu THEN 0 ELSE pu END AS du FROM p),
l AS (SELECT user_id, event_id, us, value, CASE WHEN du > 0 THEN dg / du::DOUBLE ELSE -1.0 END AS live FROM r)
"""


@query(f"WITH {_COUNTERS} SELECT user_id, event_id, round(live, 9) AS live FROM l")
def live_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = counters(table(spark, sf_dir, "events"))
    return O.counter_ratio(c, "event_id", "gated", "ungated", ["user_id"], BLOCK).select("user_id", "event_id", F.round("live", 9).alias("live"))


@query(f"""WITH {_COUNTERS}, q AS (SELECT user_id, lag(us) OVER v AS pus, us - lag(us) OVER v AS dt, live, 0.5 * (value + lag(value) OVER v) AS mid FROM l WINDOW v AS (PARTITION BY user_id ORDER BY event_id)),
z AS (SELECT user_id, pus IS NOT NULL AS pair, CASE WHEN dt > 0 AND live >= 0 THEN live * dt * mid END AS q FROM q)
SELECT user_id, round(sum(q) / 1e6, 3) AS charge, count(*) FILTER (pair) AS steps, count(q) AS integrated, count(*) FILTER (pair AND q IS NULL) AS skipped FROM z GROUP BY user_id""")
def live_charge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = counters(table(spark, sf_dir, "events"))
    live = O.counter_ratio(c, "event_id", "gated", "ungated", ["user_id"], BLOCK)
    return O.trapezoid_charge(live, "event_id", "us", "live", "value", ["user_id"], BLOCK).withColumn("charge", F.round(F.col("charge") / 1e6, 3))


@query("""SELECT c.event_id, c.user_id, c.value, e.value AS reading FROM (SELECT * FROM events WHERE event_type = 'click') c
ASOF LEFT JOIN (SELECT event_id AS at, user_id, value FROM events WHERE event_type = 'error') e ON c.user_id = e.user_id AND c.event_id >= e.at""")
def snapshot_at_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest reading at or before every physics event, per user."""
    e = table(spark, sf_dir, "events")
    right = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("at"), F.col("value").alias("reading"))
    return O.as_of(e.where("event_type = 'click'").select("event_id", "user_id", "value"), right, "event_id", "at", ["reading"], ["user_id"], block=BLOCK)


@query("""SELECT v.event_id, round(v.value / nullif(a.value, 0), 9) AS ratio FROM (SELECT * FROM events WHERE event_type = 'view') v
ASOF LEFT JOIN (SELECT event_id AS at, value FROM events WHERE event_type = 'purchase') a ON v.event_id > a.at""")
def latest_reference_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monitored value over the latest reference value of another stream, strictly before it, without a key."""
    e = table(spark, sf_dir, "events")
    ref = e.where("event_type = 'purchase'").select(F.col("event_id").alias("at"), F.col("value").alias("ref"))
    out = O.as_of(e.where("event_type = 'view'").select("event_id", "value"), ref, "event_id", "at", ["ref"], strict=True, block=BLOCK)
    return out.select("event_id", F.round(F.col("value") / F.nullif("ref", F.lit(0.0)), 9).alias("ratio"))


@query("""SELECT event_id, event_type, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1e6 AS seconds FROM events""")
def relative_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds since the earliest tick of all streams."""
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    first = e.agg(F.min("us").alias("t0"))
    return O.with_one(e, first).select("event_id", "event_type", ((F.col("us") - F.col("t0")) / 1e6).alias("seconds"))


@query("""WITH t AS (SELECT l_orderkey, min_by(l_shipdate, (l_linenumber, l_shipdate)) AS tick FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(epoch_us(tick), epoch_us(o_orderdate)) AS tick FROM orders LEFT JOIN t ON o_orderkey = l_orderkey""")
def first_tick_of_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tick of the first row of an event, its own time where there is none."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_shipdate", F.struct("l_linenumber", "l_shipdate")).alias("tick"))
    o = table(spark, sf_dir, "orders")
    return o.join(t, o.o_orderkey == t.l_orderkey, "left").select("o_orderkey", F.coalesce(us("tick"), us("o_orderdate")).alias("tick"))


@query("""SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id // 10, event_type = 'error', event_id) AS position FROM events WHERE event_type IN ('view', 'error')""")
def merged_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams merged by event number (here tens), the scaler stream first on a tie, then by load order."""
    e = table(spark, sf_dir, "events")
    pick = lambda t, n: e.where(F.col("event_type") == t).select("user_id", "event_id", "event_type", F.lit(n).alias("stream"))
    both = pick("view", 0).unionByName(pick("error", 1)).withColumn("number", F.floor(F.col("event_id") / 10))
    out = O.number_rows(both, "number", BLOCK // 10, "position", ["user_id"], ["stream", "event_id"])
    return out.select("user_id", "event_id", "event_type", "position")


@query("""WITH v AS (SELECT o_orderkey AS run, o_custkey AS cfg FROM orders WHERE o_orderkey % 97 = 5)
SELECT l.l_orderkey AS run, coalesce(arg_max(v.cfg, v.run) FILTER (v.run <= l.l_orderkey), (SELECT arg_min(cfg, run) FROM v)) AS cfg
FROM (SELECT DISTINCT l_orderkey FROM lineitem) l CROSS JOIN v GROUP BY l.l_orderkey""")
def run_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configuration whose run is the largest at or below the asked one, else the nearest above."""
    v = table(spark, sf_dir, "orders").where("o_orderkey % 97 = 5").select(F.col("o_orderkey").alias("start"), F.col("o_custkey").alias("cfg"))
    runs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run")).distinct()
    first = v.agg(F.min_by("cfg", "start").alias("first_cfg"))
    out = O.as_of(runs, v, "run", "start", ["cfg"], block=BLOCK)
    return O.with_one(out, first).select("run", F.coalesce("cfg", "first_cfg").alias("cfg"))


@query("""SELECT c.name, s.event_id, last_value(CASE WHEN s.event_type = c.name THEN s.value END IGNORE NULLS) OVER (PARTITION BY c.name ORDER BY s.event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
FROM (SELECT unnest(['error', 'signup']) AS name) c CROSS JOIN (SELECT * FROM events WHERE event_type IN ('error', 'signup')) s""")
def dense_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every channel's latest value at every checkpoint."""
    f = filled_readings(table(spark, sf_dir, "events"))
    pair = lambda n, c: F.struct(F.lit(n).alias("name"), F.col(c).alias("value"))
    return f.select("event_id", F.explode(F.array(pair("error", "gate"), pair("signup", "gated"))).alias("x")).select("x.name", "event_id", "x.value")
