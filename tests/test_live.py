"""Processors with timers, maps and lists; the live source. Any split into batches gives the same rows."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from beamframe.sources import bank_source as S
from beamframe.streaming import live
from beamframe.streaming import operators as T
from beamframe.streaming import stateful as ST
from tests.test_streaming import split_stream


def until(condition, seconds=90):
    end = time.time() + seconds
    while not condition() and time.time() < end:
        time.sleep(0.2)
    assert condition()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def written(spark, out, schema):
    """What a running query has written so far."""
    try:
        return rows_of(spark.read.schema(schema).parquet(f"{out}/batch=*"))
    except Exception:  # noqa: BLE001 - no batch yet, or one that is being written
        return []


@pytest.mark.parametrize("parts", [1, 5])
def test_snapshots_of_all_channels(spark, tmp_path, parts):
    rows = [(i % 2, i, None if i % 3 == 0 else "abc"[i % 5 % 3], float(i) if i % 7 else None) for i in range(60)]
    got = rows_of(T.run_to_table(ST.snapshots(split_stream(spark, f"{tmp_path}/s", rows, "k bigint, t bigint, c string, v double", parts), "k", "t", "c", "v"), f"{tmp_path}/out", provider=ST.ROCKSDB))
    known, want = {}, []
    for k, t, c, v in rows:
        if c is None:
            want += [(k, t, c2, v2) for (k2, c2), v2 in known.items() if k2 == k]
        elif v is not None:
            known[k, c] = v
    assert got == sorted(want, key=str) and want


@pytest.mark.parametrize("parts", [1, 4])
def test_ring_in_any_batches(spark, tmp_path, parts):
    rows = [(i % 3, i, i * i % 17 + 4 * i) for i in range(80)]
    s = split_stream(spark, f"{tmp_path}/s", rows, "k bigint, t bigint, at bigint", parts)
    pushed = T.run_to_table(ST.throttled_ring(s, "k", "t", "at", 4, 20), f"{tmp_path}/out", provider=ST.ROCKSDB)
    want = []
    for k in range(3):
        kept, last = [], None
        for _, t, at in [r for r in rows if r[0] == k]:
            if last is None or at - last >= 20:
                kept, last = [*kept, t], at
        want += [(k, t) for t in kept[-4:]]
        assert rows_of(pushed.where((F.col("k") == k) & F.col("evicted").isNotNull()).select("evicted")) == sorted([(t,) for t in kept[:-4]], key=str)
    assert rows_of(ST.ring_content(pushed, "k", "t").select("k", "t")) == sorted(want, key=str)


def test_a_repeated_batch_leaves_the_ring_as_it_was(spark, tmp_path):
    """The second batch is written, then its query fails; started again, it comes once more."""
    rows = [(0, i) for i in range(30)]
    before = split_stream(spark, f"{tmp_path}/s", rows, "k bigint, t bigint", 3)
    pushed = ST.throttled_ring(before, "k", "t", "t", 5, 2)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ST.ROCKSDB)
    failed = []

    def put(batch, number):
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("the driver is lost after the write")

    try:
        for _ in range(2):
            q = pushed.writeStream.foreachBatch(put).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
            try:
                q.awaitTermination()
            except Exception:  # noqa: BLE001 - the planned failure
                assert failed
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(f"{tmp_path}/out/batch=*")
    assert failed and rows_of(got.select("t")) == sorted([(t,) for t in range(0, 30, 2)], key=str)
    assert rows_of(ST.ring_content(got, "k", "t").select("t")) == sorted([(t,) for t in range(20, 30, 2)], key=str)


@pytest.mark.parametrize("parts", [1, 4])
def test_flush_by_event_time(spark, tmp_path, parts):
    rows = [(i % 2, i, f"2024-01-01 00:{i // 2:02d}:00") for i in range(60)] + [(9, 100, "2024-01-01 02:00:00")]
    s = split_stream(spark, f"{tmp_path}/s", rows, "k bigint, t bigint, at string", parts).withColumn("at", F.to_timestamp("at"))
    got = rows_of(T.run_to_table(ST.flush_by_size_or_age(s, "k", "t", "at", 4, 180_000, "1 minute"), f"{tmp_path}/out", provider=ST.ROCKSDB))
    want = [(k, n, 3, k + 6 * n, k + 6 * n + 4, "age") for k in (0, 1) for n in range(10)]
    assert got == sorted(want, key=str)


def test_the_clock_flushes_what_no_later_row_follows(spark, tmp_path):
    s = split_stream(spark, f"{tmp_path}/s", [(1, i, "2024-01-01 00:00:00") for i in range(5)], "k bigint, t bigint, at string", 1).withColumn("at", F.to_timestamp("at"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ST.ROCKSDB)
    out = f"{tmp_path}/out"
    seen = lambda: written(spark, out, "k bigint, flush bigint, n_rows bigint, first bigint, last bigint, reason string")
    try:
        q = ST.flush_by_size_or_age(s, "k", "t", "at", 4, 1500).writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="300 milliseconds").start()
        try:
            until(lambda: len(seen()) == 2)
        finally:
            q.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert seen() == [(1, 0, 4, 0, 3, "size"), (1, 1, 1, 4, 4, "age")]


class Flaky(live.FolderStation):
    """Away at its second and fifth call; the calls are counted in a file, as several processes make them."""

    def files(self):
        with open(f"{self.path}/_calls", "a+") as f:
            f.write(".")
            f.seek(0)
            if len(f.read()) in (2, 5):
                raise OSError("station is away")
        return super().files()


def event(n):
    return S.encode_tree([(0, -1, 200, 0x10, 0, None), (1, 0, 7, 1, 0, list(range(n % 5)) + [n])])


def test_a_live_run_gives_each_event_once(spark, tmp_path):
    run, out = tmp_path / "run", f"{tmp_path}/out"
    run.mkdir()
    body = [event(n) for n in range(40)]
    (run / "run.0").write_bytes(b"".join(body[:10]) + body[10][:9])
    banks = live.live_banks(spark, str(run), station="tests.test_live.Flaky", retry_ms=100, most_retry_ms=300, max_events=7)
    values = banks.where("tag = 7").select("event", F.element_at("words", -1).alias("n"))
    seen = lambda: written(spark, out, "event bigint, n bigint")

    def start():
        return values.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="100 milliseconds").start()

    q = start()
    try:
        until(lambda: len(seen()) == 10)
        with (run / "run.0").open("ab") as f:
            f.write(body[10][9:] + b"".join(body[11:25]))
        until(lambda: len(seen()) == 25)
    finally:
        q.stop()
    (run / "run.1").write_bytes(b"".join(body[25:]))
    q = start()  # goes on where the checkpoint says
    try:
        until(lambda: len(seen()) == 40)
    finally:
        q.stop()
    assert len((run / "_calls").read_text()) > 5
    assert seen() == sorted([(n if n < 25 else n - 25, n) for n in range(40)], key=str)


def test_back_off_doubles_and_starts_again():
    b = live.BackOff(3, 30)
    assert [b.failed(0) for _ in range(6)] == [3, 6, 12, 24, 30, 30] and not b.due(29) and b.due(30)
    b.worked()
    assert b.due(0) and b.failed(0) == 3


def test_offsets_stop_at_whole_events(spark, tmp_path):
    body = [np.array([2, 200 << 16 | 1 << 8, n], ">u4").tobytes() for n in range(6)]
    (tmp_path / "a").write_bytes(b"".join(body[:3]) + body[3][:9])
    from pyspark.sql.types import _parse_datatype_string

    r = live.LiveReader(_parse_datatype_string("event bigint, tag int"), {"path": str(tmp_path), "max_events": "2"})
    a = str(tmp_path / "a")
    first = r.latestOffset()
    assert first == {"file": a, "at": 24, "event": 2}
    assert r.latestOffset() == r.latestOffset() == {"file": a, "at": 36, "event": 3}
    (tmp_path / "b").write_bytes(body[4])
    assert r.latestOffset()["file"] == str(tmp_path / "b")  # the cut event of a is passed on, broken
    got = [t for p in r.partitions(first, r.latestOffset()) for x in r.read(p) for t in x.column(0).to_pylist()]
    assert got == [2, 3, 0]
