import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from beamframe.operators import ordered as O


def brute_keep(events, marks):
    marks = sorted(marks)
    keep = [(a[0], b[0]) for a, b in zip(marks, marks[1:], strict=False) if a[1] and b[1]]
    return sorted(e for e in events if any(lo < e <= hi for lo, hi in keep))


@pytest.mark.parametrize("block", [None, 1, 7, 1000])
def test_interval_semi_join(spark, block):
    r = random.Random(3)
    events = r.sample(range(200), 80)
    marks = [(x, r.random() < 0.7) for x in r.sample(range(200), 40)]
    e = spark.createDataFrame([(x,) for x in events], "t bigint")
    m = spark.createDataFrame(marks, "t bigint, good boolean")
    got = sorted(x.t for x in O.in_good_interval(e, m, "t", "good", block=block).collect())
    assert got == brute_keep(events, marks)


def test_interior_checkpoint_is_kept(spark):
    e = spark.createDataFrame([(x,) for x in range(14)], "t bigint")
    m = spark.createDataFrame([(1, True), (5, True), (9, True), (12, True)], "t bigint, good boolean")
    assert sorted(x.t for x in O.in_good_interval(e, m, "t", "good").collect()) == list(range(2, 13))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.integers(0, 30), st.one_of(st.none(), st.integers(0, 9))), max_size=25, unique_by=lambda r: r[0]), block=st.sampled_from([None, 3, 10]))
def test_forward_fill(spark, rows, block):
    df = spark.createDataFrame(rows, "t bigint, v bigint")
    got = {r.t: r.v for r in O.forward_fill(df, ["t"], ["v"], block=block).collect()}
    last, want = None, {}
    for t, v in sorted(rows):
        last = v if v is not None else last
        want[t] = last
    assert got == want


def test_forward_fill_twice_is_once(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, None), (9, None)], "t bigint, v bigint")
    once = O.forward_fill(df, ["t"], ["v"], block=2)
    assert sorted(once.collect()) == sorted(O.forward_fill(once, ["t"], ["v"], block=2).collect())


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("block", [None, 4])
def test_as_of(spark, strict, block):
    r = random.Random(5)
    left = [(r.randrange(3), r.randrange(30)) for _ in range(40)]
    right = list({(r.randrange(3), r.randrange(30)): i for i in range(30)}.items())
    got = O.as_of(spark.createDataFrame(left, "k bigint, t bigint"), spark.createDataFrame([(k, t, v) for (k, t), v in right], "k bigint, u bigint, v bigint"), "t", "u", ["v"], ["k"], strict, block)
    want = [(k, t, max(((u, v) for (j, u), v in right if j == k and (u < t if strict else u <= t)), default=(0, None))[1]) for k, t in left]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_empty_tables(spark):
    e = spark.createDataFrame([], "t bigint")
    m = spark.createDataFrame([], "t bigint, good boolean")
    assert O.in_good_interval(e, m, "t", "good", block=5).count() == 0
    assert O.robust_stats(spark.createDataFrame([], "v double"), "v").count() == 0


def test_counter_resets(spark):
    rows = [(1, 5, 10), (2, 8, 20), (3, 2, 4), (4, 2, 4)]
    df = spark.createDataFrame([("a", *r) for r in rows], "k string, t bigint, g bigint, u bigint")
    for block in (None, 2):
        got = [r.live for r in O.counter_ratio(df, "t", "g", "u", ["k"], block).orderBy("t").collect()]
        assert got == [0.5, 0.3, 0.5, -1.0]


def test_row_numbers_over_blocks(spark):
    r = random.Random(8)
    xs = r.sample(range(1000), 100)
    got = {x.t: x.number for x in O.number_rows(spark.createDataFrame([(x,) for x in xs], "t bigint"), "t", 37).collect()}
    assert got == {x: i + 1 for i, x in enumerate(sorted(xs))}


def test_exact_medians(spark):
    r = np.random.default_rng(4)
    groups = {1: r.normal(size=500), 2: np.append(r.normal(size=300) * 1e-9, [1e12, -1e12]), 3: np.repeat(5.0, 40), 4: np.array([7.0]), 5: np.array([1.0, 2.0]), 6: r.integers(0, 3, 1000).astype(float)}
    df = spark.createDataFrame([(k, float(v)) for k, g in groups.items() for v in g] + [(1, None), (9, None)], "k int, v double")
    got = {x.k: (x.n, x.median) for x in O.exact_median(df, "v", ["k"]).collect()}
    assert got == {k: (len(g), pytest.approx(float(np.median(g)))) for k, g in groups.items()}
    every = np.concatenate(list(groups.values()))
    assert [(x.n, x.median) for x in O.exact_median(df, "v").collect()] == [(len(every), pytest.approx(float(np.median(every))))]
    assert O.robust_stats(df.where("v IS NULL"), "v").collect() == []


@pytest.mark.parametrize("block", [None, 7, 1000])
def test_blocks_change_nothing(spark, block):
    r = random.Random(5)
    rows = [(k, t, r.randrange(9)) for k in range(3) for t in sorted(r.sample(range(300), 90))]
    df = spark.createDataFrame(rows, "k int, t bigint, v bigint")
    want, sums = {}, {}
    for k, t, v in rows:
        own = [x for q, u, x in rows if q == k and u <= t]
        sums[k, t], want[k, t] = sum(own), sum(own[-4:])
    got = O.running_totals(df, "t", {"s": F.col("v")}, ["k"], block).collect()
    assert {(g.k, g.t): g.s for g in got} == sums
    for stretch in (1, 2, 100):
        got = O.over_last(df, "t", 4, {"s": F.sum("v")}, ["k"], block, stretch).collect()
        assert len(got) == len(rows) and {(g.k, g.t): g.s for g in got} == want


@pytest.mark.parametrize("keyed", [False, True])
def test_exact_median_of_odd_values(spark, keyed):
    r = random.Random(6)
    rows = [(k, r.choice([r.random(), 1e300, -1e300, 5.0, float(r.randrange(4))])) for k in (None, "a", "b", "c") for _ in range(r.choice([1, 2, 31, 40]))] + [("d", None), ("e", 2.5)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {x[0] if keyed else "": (x.n, x.median) for x in O.exact_median(df, "v", ["k"] if keyed else []).collect()}
    want = {}
    for k in {k for k, v in rows if v is not None} if keyed else {""}:
        v = [x for j, x in rows if x is not None and (j == k or not keyed)]
        want[k] = (len(v), float(np.median(v)))
    assert got == want


def test_an_outlier_does_not_unbalance_the_ranges(spark):
    v = F.when(F.col("id") == 77, F.lit(1e300)).when(F.col("id") % 3 == 0, F.lit(1.0)).otherwise(F.rand(3))
    key = "spark.sql.adaptive.coalescePartitions.enabled"  # small ranges would be put together
    spark.conf.set(key, "false")
    try:
        ranges = O.value_ranges(spark.range(200_000).select(v.alias("v")), "v")
    finally:
        spark.conf.unset(key)
    sizes = [x["count"] for x in ranges.groupBy("_range").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1.5 * sum(sizes) / len(sizes)


def test_another_thread_keeps_its_scratch_tables(spark):
    import threading

    from beamframe.scratch import scratch_scope, stored

    inside, opened, written = {}, threading.Event(), threading.Event()

    def other():
        opened.wait(30)
        inside["df"] = stored(spark.range(5).toDF("v"), "thread")
        written.set()

    t = threading.Thread(target=other)
    t.start()
    with scratch_scope():
        opened.set()
        assert written.wait(60)
        own = stored(spark.range(3).toDF("v"), "own")
        assert own.count() == 3
    t.join()
    assert inside["df"].count() == 5
    with pytest.raises(Exception, match="(?i)does not exist|not found|FILE_NOT_EXIST"):
        own.count()
