"""Cases of the third review: rows for which a query and its SQL differed, and plans that grew faster than their input."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Row

from beamframe.operators import matching
from beamframe.plans import ALL
from beamframe.sources import bank_source as S
from beamframe.sources import banks
from beamframe.streaming import stateful
from tests.compare import rows, same, sql_rows


def agree(spark, folder, name):
    """Rows of a query, after a check that its SQL gives the same."""
    mine = rows(ALL[name].build(spark, str(folder)).toPandas())
    assert same(mine, rows(sql_rows(str(folder), ALL[name].sql)))
    return mine


def write(folder, name, **columns):
    pq.write_table(pa.table(columns), folder / f"{name}.parquet")


def test_low_word_of_a_timestamp_has_32_bits(spark, tmp_path):
    """40503 * 106040 fits the low word, 40503 * 106041 does not and must not carry into the high one."""
    key = [1, 106040, 106041, 9_000_000]
    write(tmp_path, "orders", o_orderkey=key, o_custkey=[5, 65535, 65536 + 7, 3])
    got = agree(spark, tmp_path, "wide_timestamps")
    high = {1: 5, 106040: 65535, 106041: 7, 9_000_000: 3}
    assert {(e, t) for e, _, t in got} == {(k, high[k] << 32 | (k * 40503 & 0xFFFFFFFF)) for k in key}


def test_group_that_a_row_flushes_by_age_near_the_end(spark, tmp_path):
    """User 1's first group ends by a row two hours later, before the watermark gets there; user 2's by the timer
    that is due exactly at the watermark; user 3's a millisecond later, so it still waits, as does user 4's."""
    end = datetime(2024, 1, 1, 12)
    due = end - timedelta(hours=2, minutes=10)
    when = [(1, end - timedelta(hours=2)), (1, end), (2, due), (3, due + timedelta(milliseconds=1)), (4, end - timedelta(minutes=1))]
    write(tmp_path, "events", event_id=list(range(5)), user_id=[u for u, _ in when], ts=pa.array([t for _, t in when], pa.timestamp("us")), event_type=["click"] * 5, value=[1.0] * 5, props=["{}"] * 5)
    got = agree(spark, tmp_path, "stream_timed_flush")
    assert [r[-1] for r in got] == [1, 2]


#: samples of two vectors whose clipping or tail cut meets a sample that lies just on the limit
ON_THE_EDGE = [
    [68, -6, 68, -46, -58, 35, 14, -42, -74, -21, 33, -16, 58, -121, 82, -97, 52, -57, 3, -67, 18, -59, 14, -73, -31, 74, -14, 75, 33, 81, -132, 30, 53, -33, -110, -72, -32, -72, 33, 74, 135, -11, -19, 73, 13, -31, 90, -53, 57, -21, 99, 26, -48, 1, 67, 58, 70, -66, -19, -28, -92, -24, 12, 135],
    [29, 25, -13, -101, 33, -4, 42, 59, -94, 34, -70, -27, -124, -83, -11, 141, -68, 15, 41, -27, 4, -79, 8, 54, -93, -19, -129, 12, 5, 17, -68, 86, -78, 75, -85, 133, -31, 37, 57, -20, -17, 77, 56, 60, -11, 46, 15, -59, -82, 9, 66, 8, -101, 91, 83, 67, -3, -43, -42, -83, 3, -61, -21, 44],
]


def test_samples_just_on_a_limit(spark, tmp_path):
    vectors = pa.array([[v / 500 for v in x] for x in ON_THE_EDGE], pa.list_(pa.float32()))
    write(tmp_path, "embeddings", vec_id=[0, 1], embedding=vectors, label=pa.array([0, 0], pa.int32()))
    assert len(agree(spark, tmp_path, "waveform_pulses")) > 2
    agree(spark, tmp_path, "waveform_pedestals")


def test_banks_of_many_events_at_once():
    """Trees laid out and scanned together are what they are one by one, broken ones included."""
    kids = [(1, 0, 7, 1, 0, [5, 6]), (2, 0, 8, 0x20, 0, None), (3, 2, 3, 1, 0, [5]), (4, 0, 9, 0x0C, 0, None), (5, 4, 40, 1, 0, [9])]
    trees = [[(0, -1, 100 + i, 0x10, i, None), *kids[: i % 6]] for i in range(9)]
    flat = [row for t in trees for row in t]
    number = lambda k: np.array([row[k] for row in flat], np.int64)
    sizes = np.array([len(row[5] or ()) for row in flat])
    got, place = S.encode_trees(np.repeat(np.arange(9), [len(t) for t in trees]), *map(number, range(5)), sizes, np.array([w for row in flat for w in row[5] or ()], np.int64))
    one = [S.encode_tree(t) for t in trees]
    assert got.tobytes() == b"".join(one) and place.tolist() == [sum(map(len, one[:i])) // 4 for i in range(9)]
    words = [np.frombuffer(b, ">u4").copy() for b in one]
    words[5][3] = 1 << 20  # a bank past its parent's end
    words[7] = words[7][:-2]
    ends = np.cumsum([len(w) for w in words])
    found = banks.scan_events(np.concatenate(words), np.append(0, ends[:-1]), ends)
    want = [(e, *r[1:7], r[7] + a, r[8] + a, r[9]) for e, (w, a) in enumerate(zip(words, [0, *ends], strict=False)) for r in banks.scan(w)]
    assert list(zip(*(c.tolist() for c in found.values()), strict=True)) == want and any(r[-1] for r in want)


def test_small_ranges_of_a_large_run_share_tasks(spark, tmp_path):
    rows = [("run.0", i, bytearray(S.encode_tree([(0, -1, 1, 1, 0, [i])]))) for i in range(2000)]
    S.write_events(spark.createDataFrame(rows, S.EVENTS), f"{tmp_path}/run", "file", "event")
    S.index_banks(spark, f"{tmp_path}/run", 24).write.parquet(f"{tmp_path}/index")
    df = S.read_events(spark, f"{tmp_path}/run", f"{tmp_path}/index", "event bigint, words array<bigint>")
    assert spark.read.parquet(f"{tmp_path}/index").count() == 1000 and df.rdd.getNumPartitions() <= 334
    assert sorted((r.event, r.words[0]) for r in df.collect()) == [(i, i) for i in range(2000)]


def test_event_info_joins_nothing(spark, small):
    plan = ALL["event_info"].build(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_tracks_meet_hits_by_cells(spark, small):
    """Seeds join hits of their plane and cell, not all of their event."""
    plan = ALL["hit_seed_efficiency"].build(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "_cx" in plan and "_cy" in plan


def test_combinations_are_dealt_over_many_tasks(spark, small):
    """By their bytes an event's hits would all go to one task."""
    plan = ALL["combination_tracks"].build(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and ", 64" in plan


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_modules_of_a_kind_meet_once(spark):
    """Cells hold one row a kind, not one a module: with 400 modules on one of two places only their pairs are
    made. Modules without a sector are a kind of their own, as are those of another size."""
    m = [(i, 0, 0.0, 0.0, 1.0) for i in range(400)] + [(400, 0, 3.0, 0.0, 1.0), (401, None, 1.0, 0.0, 1.0), (402, 1, 0.0, 1.0, 2.0), (403, 1, None, 0.0, 2.0)]
    df = spark.createDataFrame([(i, s, x, y, z, z) for i, s, x, y, z in m], "id bigint, sector int, x double, y double, sx double, sy double")
    pairs = matching.quantised_neighbours(df, digits=3)
    got = {(e.id, e.near): (e.dx, e.dy) for e in pairs.collect()}
    want = {}
    for i, s, x, y, z in m:
        for j, t, u, v, w in m:
            if i != j and x is not None and u is not None:
                unit = z if s is not None and s == t else (z + w) / 2
                if max(abs(u - x), abs(v - y)) <= 1.01 * unit:
                    want[i, j] = (round((u - x) / unit, 3), round((v - y) / unit, 3))
    assert got == want and len(got) > 400 * 399
    assert "BroadcastHashJoin" not in physical(pairs) and pairs._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") >= 3


def test_neighbours_of_modules_are_not_sent_whole(spark, small):
    """Modules multiplied by their cells stay under the size of a broadcast by the size of their file alone."""
    for name in ("module_adjacency", "border_neighbours"):
        assert "BroadcastHashJoin" not in physical(ALL[name].build(spark, small))


def test_snapshots_leave_in_slices(monkeypatch):
    """A key's rows come in any order and many tables; no table that leaves is larger than a slice."""

    class Known(dict):
        def iterator(self):
            return iter([((k,), (v,)) for k, v in self.items()])

        def updateValue(self, k, v):  # noqa: N802 - as Spark names it
            self[k[0]] = v[0]

    monkeypatch.setattr(stateful.Snapshots, "SLICE", 64)
    r = np.random.default_rng(4)
    rows = [(int(t), [None, "a", "b", "c"][r.integers(4)], float(r.integers(9)) if r.random() < 0.8 else None) for t in r.permutation(3000)]
    p = stateful.Snapshots("k", "t", "c", "v")
    p.known = Known(b=-1.0)
    out = list(p.handleInputRows((7,), iter([pd.DataFrame(rows[i : i + 500], columns=["t", "c", "v"]) for i in range(0, 3000, 500)]), None))
    known, want = {"b": -1.0}, []
    for t, c, v in sorted(rows, key=lambda x: x[0]):
        if c is None:
            want += [(7, t, c2, v2) for c2, v2 in known.items()]
        elif v is not None:
            known[c] = v
    got = [tuple(x) for o in out for x in o.itertuples(index=False)]
    assert sorted(got) == sorted(want) and p.known == known
    assert len(out) > 10 and max(map(len, out)) <= 64


def test_ring_handles_rows_with_few_calls_of_its_state():
    """A table for each key, and asking whether state exists before reading it, cost more than the ring itself."""
    calls = []

    class State:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def put(self, v):
            calls.append("put")
            self.held = v

        update = put

    ring = stateful.Ring("k", "t", "at", 3, 2, None)
    ring.ring, ring.last = State(), State()
    out = list(ring.handleInputRows((5,), iter([Row(k=5, t=t, at=t) for t in (4, 1, 0, 3, 9, 6)]), None))
    assert [tuple(r) for r in out] == [(5, 1, 1, 0, None), (5, 2, 2, 3, None), (5, 0, 3, 6, None), (5, 1, 4, 9, 0)]
    assert calls == ["get", "put", "put"] and out[-1].evicted == 0
    assert [tuple(r) for r in ring.handleInputRows((5,), iter([Row(k=5, t=10, at=10), Row(k=5, t=12, at=12)]), None)] == [(5, 2, 5, 12, 3)]
    assert calls[3:] == ["get", "get", "put", "put"]


def test_waveforms_are_dealt_out_over_tasks(spark, small):
    """The file of the waveforms is one task's; searches and fits take milliseconds a row."""
    for name in ("deconvolved_pulses", "pulse_shapes", "waveform_pulses", "waveform_pedestals", "firmware_pulses"):
        plan = physical(ALL[name].build(spark, small))
        assert "REPARTITION_BY_NUM" in plan[plan.index("MapInPandas") :], name
