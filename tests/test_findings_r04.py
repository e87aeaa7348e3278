"""Cases of the fourth review."""

from datetime import datetime, timedelta
from itertools import permutations

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from beamframe.operators import matching
from beamframe.streaming import operators, stateful
from tests.test_findings_r03 import agree, write
from tests.test_streaming import split_stream


def test_pairs_of_one_kind_of_modules_are_dealt_out(spark):
    """All 1200 modules share a place: their pairs used to be made by the one task that the place fell to. A module
    without an id has no pairs."""
    at = [F.lit(v).cast(t).alias(n) for n, v, t in (("sector", 1, "int"), ("x", 2, "double"), ("y", 3, "double"), ("sx", 1, "double"), ("sy", 1, "double"))]
    modules = spark.range(1200).select(F.when(F.col("id") != 7, F.col("id")).alias("id"), *at)
    pairs = matching.quantised_neighbours(modules, digits=6)
    made = pairs.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"), F.max(F.greatest(F.abs("dx"), F.abs("dy"))).alias("far")).collect()
    assert sum(r.n for r in made) == 1199 * 1198 and all(r.far == 0 for r in made)
    assert len(made) >= 4 and max(r.n for r in made) < 1199 * 1198 / 2
    assert pairs.distinct().count() == 1199 * 1198 and pairs.where("id = 7 OR near = 7").isEmpty()


@pytest.mark.parametrize("without", ["ts", "event_id"])
def test_rows_without_a_time_or_a_number_are_flushed(spark, tmp_path, without):
    """User 1: the 2nd row has none, user 2: the first of ten, user 3: the first of two, user 4: the last, user 5: none has."""
    start = datetime(2024, 1, 1)
    rows = [(1, 10, False), (1, 20, True), (1, 30, False), (1, 200, False), (2, 40, True), *((2, 40 + 180 * i, False) for i in range(1, 10)), (3, 50, True), (3, 500, False), (4, 60, False), (4, 600, True), (5, 70, True), (6, 3000, False)]
    columns = {"event_id": list(range(len(rows))), "ts": [start + timedelta(minutes=m) for _, m, _ in rows]}
    columns[without] = [None if n else v for v, (_, _, n) in zip(columns[without], rows, strict=True)]
    write(tmp_path, "events", event_id=pa.array(columns["event_id"], pa.int64()), user_id=[u for u, _, _ in rows], ts=pa.array(columns["ts"], pa.timestamp("us")), event_type=["click"] * len(rows), value=[1.0] * len(rows), props=["{}"] * len(rows))
    got = agree(spark, tmp_path, "stream_timed_flush")
    assert {r[-1] for r in got} == ({1, 2, 4} if without == "ts" else {1, 2, 3, 4, 5})


def test_rows_from_before_1970_are_flushed(spark, tmp_path):
    """A watermark starts at 1970, and Spark took rows from before for late ones."""
    when = [datetime(1969, 12, 31, h, m) for h, m in ((3, 0), (4, 0), (20, 0), (21, 58), (23, 0))] + [datetime(1970, 1, 1, h) for h in (0, 3)]
    user = [1, 1, 1, 2, 3, 2, 3]
    write(tmp_path, "events", event_id=list(range(7)), user_id=user, ts=pa.array(when, pa.timestamp("us")), event_type=["click"] * 7, value=[1.0] * 7, props=["{}"] * 7)
    got = agree(spark, tmp_path, "stream_timed_flush")
    assert sum(r[3] for r in got) == 6 and len(got) == 5


@pytest.mark.parametrize("parts", [1, 2])
def test_late_rows_are_flushed(spark, tmp_path, parts):
    """Where the second file comes, the watermark is past its first row, which belongs to a group of before."""
    rows = [(1, 0, "2024-01-01 00:00:00"), (2, 1, "2024-01-01 09:00:00"), (1, 2, "2024-01-01 00:01:00"), (2, 3, "2024-01-01 09:00:00")]
    s = split_stream(spark, f"{tmp_path}/s", rows, "k bigint, t bigint, at string", parts).withColumn("at", F.to_timestamp("at"))
    got = operators.run_to_table(stateful.flush_by_size_or_age(s, "k", "t", "at", 8, 3_600_000, "1 minute"), f"{tmp_path}/out", provider=stateful.ROCKSDB)
    assert list(map(tuple, got.collect())) == [(1, 0, 2, 0, 2, "age")]


def test_rows_of_one_number_are_taken_by_their_time():
    """In whatever order they come in, the group that they make is one."""

    class Kept:
        def __init__(self, *held):
            self.get, self.put, self.update, self.clear = lambda: held[0], lambda v: None, lambda v: None, lambda: None

    class Timers:
        def registerTimer(self, at):  # noqa: N802 - as Spark names it
            seen.append(at)

    results = set()
    for rows in permutations([(1, 0), (2, 50), (2, 99), (2, 150), (3, 160)]):
        flush, seen = stateful.Flush("k", "t", "at", 3, 100, False), []
        flush.handle, flush.waiting, flush.group = Timers(), Kept([]), Kept(None)
        out = list(flush.handleInputRows((5,), iter([Row(k=5, t=t, at=at) for t, at in rows]), None))
        results.add((tuple(map(tuple, out)), tuple(seen)))
    assert results == {(((5, 0, 3, 1, 2, "size"),), (250,))}
