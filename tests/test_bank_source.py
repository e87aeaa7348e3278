"""The bank files' data source: ranges, pushed filters, projection, writing."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual
from pyspark.sql.types import _parse_datatype_string

from beamframe.sources import bank_source as S
from beamframe.sources import banks


def tree(i):
    kids = [(1, 0, 7, 1, 0, [i, i + 1]), (2, 0, 8, 0x20, 0, None), (3, 2, 3, 1, 0, [5] * (i % 4)), (4, 0, 9, 0x0C, 0, None), (5, 4, 40, 1, 0, [9])]
    return [(0, -1, 100 + i % 3, 0x10, 2, None), *kids]


def written(spark, path, files=3, n=40):
    rows = [(f"run.{f}", i, bytearray(S.encode_tree(tree(i + f)))) for f in range(files) for i in range(n)]
    S.write_events(spark.createDataFrame(rows, S.EVENTS).repartition(5), path, "file", "event")
    return rows


def rows_of(df):
    return sorted(((r.file.rsplit("/", 1)[-1], *r[1:]) for r in df.collect()), key=str)


def test_ranges_give_what_whole_files_give(spark, tmp_path):
    path = f"{tmp_path}/run"
    rows = written(spark, path)
    whole = rows_of(banks.read_banks(spark, path))
    assert len(whole) == 3 * 40 * 6
    assert {b: S.encode_tree(tree(i)) for i in (0, 1, 3) for b in ["x"]}["x"] == bytes(rows[3][2])
    assert rows_of(S.read_events(spark, path)) == whole
    for size in (1, 200, 1 << 20):
        index = f"{tmp_path}/index{size}"
        S.index_banks(spark, path, size).write.parquet(index)
        assert spark.read.parquet(index).agg(F.sum("n_events")).first()[0] == 120
        df = S.read_events(spark, path, index)
        assert df.rdd.getNumPartitions() == spark.read.parquet(index).count()
        assert rows_of(df) == whole


def test_filters_are_pushed_and_touch_their_ranges_only(spark, tmp_path):
    path, index = f"{tmp_path}/run", f"{tmp_path}/index"
    written(spark, path)
    S.index_banks(spark, path, 300).write.parquet(index)
    df = S.read_events(spark, path, index).where("tag IN (7, 3) AND event >= 10 AND event < 13 AND node > 0")
    plan = df._jdf.queryExecution().executedPlan().toString()
    left = plan[plan.index("Filter") : plan.index("BatchScan")]
    assert "node" in left and "tag" not in left and "event" not in left
    want = [r for r in rows_of(banks.read_banks(spark, path)) if r[5] in (7, 3) and 10 <= r[1] < 13]
    assert rows_of(df) == want and want
    assert df.rdd.getNumPartitions() < spark.read.parquet(index).count() / 3
    one = S.read_events(spark, path, index).where(F.col("file") == S.bank_files(path)[1])
    assert {r.file for r in one.collect()} == {S.bank_files(path)[1]}
    assert S.read_events(spark, path, index).where("tag = 7 AND tag = 8").count() == 0
    assert S.read_events(spark, path, index).where("event > 10000").count() == 0


def test_payloads_of_other_tags_and_columns_are_not_decoded(spark, tmp_path):
    path = f"{tmp_path}/run"
    written(spark, path, 1)

    def decoded(columns, *filters):
        class Counting(S.BankReader):
            n = 0

            def payload(self, kind, words):
                Counting.n += 1
                return super().payload(kind, words)

        r = Counting(_parse_datatype_string(columns), {"path": path})
        left = list(r.pushFilters(list(filters)))
        n = sum(b.num_rows for p in r.partitions() for b in r.read(p))
        return left, n, Counting.n

    assert decoded(banks.NODES) == ([], 240, 240)
    assert decoded(banks.NODES, EqualTo(("tag",), 7)) == ([], 40, 40)
    assert decoded(banks.NODES, In(("tag",), (7, 3)), GreaterThan(("event",), 4), LessThanOrEqual(("event",), 6)) == ([], 4, 4)
    other = EqualTo(("num",), 1)
    assert decoded("event bigint, tag int", other) == ([other], 240, 0)
    df = S.read_events(spark, path, columns="event bigint, tag int")
    assert df.columns == ["event", "tag"] and df.count() == 240


def test_events_larger_than_a_chunk_and_cut_files(spark, tmp_path):
    events = [S.encode_tree([(0, -1, 1, 1, 0, list(range(n)))]) for n in (0, 3, 5000, 1, 70_000)]
    body = b"".join(events)
    (tmp_path / "a").write_bytes(body)
    for chunk in (8, 1000, 1 << 20):
        with pa.OSFile(str(tmp_path / "a")) as f:
            got = list(S.events_of(f, 0, len(body), chunk=chunk))
        assert [(s, len(w)) for _, s, w in got] == [(len(e), len(e) // 4) for e in events]
        with pa.OSFile(str(tmp_path / "a")) as f:
            some = list(S.events_of(f, 0, len(body), iter([True, False, False, True, False]), chunk))
        assert [w is not None for *_, w in some] == [True, False, False, True, False] and np.array_equal(some[3][2], got[3][2])
    (tmp_path / "a").write_bytes(body[:-30])
    (tmp_path / "empty").write_bytes(b"")
    S.index_banks(spark, str(tmp_path), 100).write.parquet(f"{tmp_path}/_index")
    for index in (None, f"{tmp_path}/_index"):
        got = S.read_events(spark, str(tmp_path), index).orderBy("event").collect()
        assert [r.broken for r in got] == [False] * 4 + [True]


def test_writing_leaves_whole_files_or_nothing(spark, tmp_path):
    path = f"{tmp_path}/run"
    written(spark, path, 2)
    assert [f.rsplit("/", 1)[-1] for f in S.bank_files(path)] == ["run.0", "run.1"] and not [f for f in (tmp_path / "run").iterdir() if f.name.startswith("_")]
    bad = spark.createDataFrame([("a", 1, bytearray(b"\0" * 8))] * 2, S.EVENTS).repartition(2)
    with pytest.raises(Exception, match="several tasks"):
        bad.write.format("banks").option("path", path).mode("append").save()
    assert [f.rsplit("/", 1)[-1] for f in S.bank_files(path)] == ["run.0", "run.1"] and not [f for f in (tmp_path / "run").iterdir() if f.name.startswith("_")]
