from pyspark.sql import functions as F

from beamframe.sources import files as S
from beamframe.streaming import operators as T


def split_stream(spark, folder, rows, schema, parts=3):
    """A stream whose batches are consecutive parts of the rows."""
    n = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * n : (i + 1) * n], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return T.read_stream(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema, files=1)


def test_batches_give_what_one_batch_gives(spark, tmp_path):
    rows = [(i % 3, i, (i * 7) % 11, (i * 5) % 13, None if i % 4 else float(i)) for i in range(60)]
    schema = "k bigint, t bigint, g bigint, u bigint, v double"
    for name, op in (("live", lambda s: T.live_fraction(s, "k", "t", "g", "u")), ("fill", lambda s: T.carry_forward(s, "k", "t", "v")), ("hist", lambda s: T.history(s, "k", "t", 5)), ("rate", lambda s: T.at_most_every(s, "k", "t", 7)), ("flush", lambda s: T.flush_groups(s, "k", "t", 4, 10)), ("anchor", lambda s: T.anchored_times(s.withColumn("kind", F.when(F.col("t") % 5 == 4, "sync").otherwise("pulse")), "k", "t", "kind", "g", "u"))):
        got = [sorted(map(repr, T.run_to_table(op(split_stream(spark, f"{tmp_path}/{name}{n}", rows, schema, n)), f"{tmp_path}/{name}{n}/out").collect())) for n in (1, 4)]
        assert got[0] == got[1] and got[0], name


def test_a_repeated_report_counts_once(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:05:00"), (2, "2024-01-01 00:06:00")]
    s = split_stream(spark, f"{tmp_path}/d", rows, "run bigint, at string", 1).withColumn("at", F.to_timestamp("at"))
    out = T.run_to_table(T.once_per_key(s, ["run"], "at", "15 minutes"), f"{tmp_path}/d/out")
    assert sorted(r.run for r in out.collect()) == [1, 2]


def test_ring_keeps_the_last(spark, tmp_path):
    s = split_stream(spark, f"{tmp_path}/r", [(i,) for i in range(30)], "t bigint", 3)
    q = s.writeStream.foreachBatch(lambda b, n: T.keep_last(b, n, f"{tmp_path}/ring", "t", 5)).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    schema = spark.read.parquet(f"{tmp_path}/r/in").schema
    assert sorted(r.t for r in T.read_ring(spark, f"{tmp_path}/ring", schema).collect()) == list(range(25, 30))


def test_ring_of_a_batch_that_comes_again(spark, tmp_path):
    for number, rows in [(0, [1, 2, 3]), (1, [4, 5]), (1, [4, 5]), (2, [6]), (2, [6])]:
        T.keep_last(spark.createDataFrame([(t,) for t in rows], "t bigint"), number, f"{tmp_path}/ring", "t", 4)
    assert sorted(r.t for r in T.read_ring(spark, f"{tmp_path}/ring", spark.createDataFrame([], "t bigint").schema).collect()) == [3, 4, 5, 6]


def test_files_round_trip(spark, tmp_path):
    g = spark.createDataFrame([("W1", 1.0, 0.1, 1.5, 0.9, 1.0, 1.1)], "name string, lms_peak double, lms_sigma double, lms_chi2ndf double, g1 double, g2 double, g3 double")
    S.write_gains(g, f"{tmp_path}/g")
    assert S.read_gains(spark, f"{tmp_path}/g").collect() == g.collect()
    run = spark.createDataFrame([(1, 0, 5), (1, 2, 6)], "run_number bigint, segment bigint, v bigint")
    S.write_run(run, f"{tmp_path}/run")
    assert spark.read.parquet(f"{tmp_path}/run").where("run_number = 1").count() == 2
    assert [r.segment for r in S.missing_segments(run, "segment").collect()] == [1]
    S.write_table_text(run, f"{tmp_path}/t")
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/t").count() == 2
    text = '{"a": "//x,]", /* y, */ "b": [1, 2,], // z\n "c": {"d": "\\",}",},}'
    assert S.parse_config(text) == {"a": "//x,]", "b": [1, 2], "c": {"d": '",}'}}
    (tmp_path / "c.json").write_text(text)
    assert S.read_config(spark, f"{tmp_path}/c.json")["b"] == [1, 2]
    assert S.strip_comments('{"a": "//x" /* y */ } // z').strip() == '{"a": "//x"  }'


def test_flatten_json(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": 1, "c": "x", "e": {}}, "d": [1, 2]}'), (2, "bad{"), (3, None)], "id bigint, j string")
    got = {(r.id, r.path): r.value for r in S.flatten_json(df, "id", "j").collect()}
    assert got == {(1, "a.b"): "1", (1, "a.c"): "x", (1, "a.e"): "{}", (1, "d"): "[1,2]"}


def test_maps_and_pedestals(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"n": "W1", "t": "crystal", "geo": {"sx": 2, "sy": 2, "x": 1, "y": -1}, "daq": {"crate": 1, "slot": 3, "channel": 7}}, // last\n {"n": "G2", "t": "glass", "geo": {"sx": 4, "sy": 4, "x": 9, "y": 9}}]')
    assert [(r.name, r.slot, r.x) for r in S.read_modules(spark, str(tmp_path / "m.json")).orderBy("name").collect()] == [("G2", None, 9.0), ("W1", 3, 1.0)]
    (tmp_path / "p.txt").write_text("# pedestals\n1 3 7 100.5 1.25\nbad line\n2 3 8 x 1\n2 4 8 99 2\n")
    p = S.remap(S.read_pedestals(spark, str(tmp_path / "p.txt")), "crate", {2: 20})
    assert sorted(map(tuple, p.collect())) == [(1, 3, 7, 100.5, 1.25), (20, 4, 8, 99.0, 2.0)]
