import numpy as np

from beamframe.operators import waveforms
from beamframe.sources import banks


def bank(tag, typ, num, payload):
    return [len(payload) + 1, tag << 16 | typ << 8 | num, *payload]


def segment(tag, typ, payload):
    return [tag << 24 | typ << 16 | len(payload), *payload]


def test_nested_banks_come_back(spark, tmp_path):
    inner = [*bank(7, 1, 1, [10, 11, 12]), *bank(8, 0x20, 0, [*segment(3, 1, [5]), *segment(4, 1, [])])]
    first = bank(0xFF50, 0x10, 2, inner)
    second = bank(5, 1, 0, [99])
    (tmp_path / "a.dat").write_bytes(np.array(first + second, ">u4").tobytes())
    rows = banks.read_banks(spark, str(tmp_path)).orderBy("event", "node").collect()
    assert [(r.event, r.parent, r.depth, r.tag, r.type, r.words) for r in rows] == [
        (0, -1, 0, 0xFF50, 0x10, None), (0, 0, 1, 7, 1, [10, 11, 12]), (0, 0, 1, 8, 0x20, None), (0, 2, 2, 3, 1, [5]), (0, 2, 2, 4, 1, []), (1, -1, 0, 5, 1, [99]),
    ]
    assert [r.tag for r in banks.read_banks(spark, str(tmp_path), [7]).collect()] == [7]
    paths = {r.path: (r.n, r.per_parent) for r in banks.tag_paths(banks.read_banks(spark, str(tmp_path))).collect()}
    assert paths["FF50/8/3"] == (1, 1.0) and paths["5"] == (1, None)


def test_a_bank_past_the_end_is_broken(spark, tmp_path):
    (tmp_path / "b.dat").write_bytes(np.array(bank(1, 0x10, 0, [9, 7 << 16 | 1 << 8, 1]), ">u4").tobytes())
    assert [(r.tag, r.broken) for r in banks.read_banks(spark, str(tmp_path)).orderBy("node").collect()] == [(1, False), (7, True)]


def test_overlapping_pulses_come_apart():
    shape = waveforms.Template(4.0, 20.0)
    t = np.arange(100) * 4.0
    x = 100 + 300 * shape(t - 120) + 200 * shape(t - 150)
    found = [{"pos": 32, "height": 180.0, "time": 128.0, "integral": 0.0}, {"pos": 39, "height": 150.0, "time": 157.0, "integral": 0.0}]
    got = waveforms.deconvolve(x, 100.0, found, shape)
    assert [round(p["height"] / shape.height) for p in got] == [300, 200]
    assert np.allclose([p["time"] - shape.top for p in got], [120, 150], atol=0.05)


def test_composite_payloads_come_back_and_end_where_they_break(spark):
    slots = [(3, 7, 1 << 40, [(0, [1, 2, 65535]), (15, [])]), (4, 8, -1, [(63, list(range(200)))])]
    body = banks.encode_composite(slots)
    want = [(s, t, at, c, x) for s, t, at, channels in slots for c, x in channels]
    got = [(*r[:4], r[4].tolist()) for r in banks.composite_rows(body)]
    assert got == want
    cut = [(*r[:4], r[4].tolist()) for r in banks.composite_rows(body[:-31])]
    assert cut[:2] == want[:2] and cut[2][4] == list(range(200 - 16))
    assert list(banks.composite_rows(banks.encode_composite([(40, 0, 0, [(1, [1])])]))) == []
    rows = banks.decode_composite(spark.createDataFrame([(1, bytearray(body)), (2, None), (3, bytearray(b"xx"))], "id int, body binary"), ["id"], "body").collect()
    assert sorted((r.slot, r.trigger, r.timestamp, r.channel, list(r.samples)) for r in rows) == sorted(want)
