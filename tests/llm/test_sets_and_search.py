"""Exact and near copies, vector search, URLs and chats: brute force, edge cases, SQL."""

import hashlib
import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from beamframe.llm import bayes_jaccard, chat_format, exact_dedup, multi_index_hashing, queries, url_reputation
from beamframe.llm.common import components, materialise
from tests.compare import rows, same, sql_rows

DOC = "doc_id bigint, text string, k string, name string, label string"


def docs_of(spark, pairs):
    return materialise(spark.createDataFrame([(i, t, "x", "y", "z") for i, t in pairs], DOC).repartition(3), "test-docs")


@pytest.mark.parametrize("bits", [64, 2])
@pytest.mark.parametrize("block", [4096, 4])
def test_exact_groups(spark, bits, block):
    r = random.Random(1)
    texts = [None, "", "", "a", "abcd", "abcde", "abcdabcd", "abcdabcd", "é" * 9, "é" * 9, "x" * 10_000 + "y", "x" * 10_000 + "y", "x" * 10_001] + ["".join(r.choice("ab") for _ in range(r.randrange(9))) for _ in range(60)]
    pairs = [(i, t) for i, t in enumerate(texts)] + [(5, "abcde"), (None, "abcd")]
    if bits == 2:
        pairs = pairs[:40] + pairs[-2:]
    got = exact_dedup.exact_dedup(docs_of(spark, pairs), exact_dedup.BlockNamingConfig(block, bits)).collect()
    groups = {}
    for i, t in pairs:
        groups.setdefault(t or "", []).append(i)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_exact_empty_table(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], DOC)).collect() == []


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent}


def near_texts():
    r = random.Random(3)
    words = lambda n: ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    out = []
    base = words(150)
    for _ in range(120):  # one large group of near copies
        w = list(base)
        for _ in range(r.randrange(0, 7)):
            w[r.randrange(len(w))] = words(1)[0]
        out.append(" ".join(w))
    for _ in range(30):  # small groups, chains
        w = words(r.randrange(5, 120))
        out.append(" ".join(w))
        for _ in range(r.randrange(3)):
            w = w[2:] + words(2)
            out.append(" ".join(w))
    out += out[:20] + [None, "", "  ", "one two", "One  two", "one two three four five", "one two three four five six"]
    return list(enumerate(out)) + [(3, out[3]), (None, out[40])]


def brute_classes(pairs, threshold=0.8):
    def shingles(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    s = [shingles(t) for _, t in pairs]
    label = list(range(len(pairs)))
    linked = [False] * len(pairs)
    for i in range(len(pairs)):
        for j in range(i):
            if s[i] and len(s[i] & s[j]) >= threshold * len(s[i] | s[j]):
                linked[i] = linked[j] = True
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for x, (i, _) in zip(label, pairs, strict=True):
        least[x] = i if least.get(x) is None else least[x] if i is None else min(least[x], i)
    return [(i, least[x], linked[k]) for k, (x, (i, _)) in enumerate(zip(label, pairs, strict=True))]


@pytest.mark.parametrize("cfg", [bayes_jaccard.JaccardConfig(), bayes_jaccard.JaccardConfig(cell=16, small=4)])
def test_similarity_classes(spark, cfg):
    pairs = near_texts()
    got = bayes_jaccard.similarity_classes(docs_of(spark, pairs), cfg).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.class_id, r.n_links > 0) for r in got), key=key) == sorted(brute_classes(pairs), key=key)


def brute_links(pairs, threshold=0.8):
    """Other copies and different texts that reach the threshold, of each row."""
    shingles = lambda w: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    s = [shingles((t or "").lower().split()) for _, t in pairs]
    near = {x: sum(x != y and len(x & y) >= threshold * len(x | y) for y in set(s)) for x in set(s)}
    return [(i, s.count(x) - 1 + near[x] if x else 0) for x, (i, _) in zip(s, pairs, strict=True)]


@pytest.mark.parametrize("cfg", [bayes_jaccard.JaccardConfig(), bayes_jaccard.JaccardConfig(cell=16, small=4), bayes_jaccard.JaccardConfig(shingles=1000)])
def test_all_links_of_a_group_count(spark, cfg):
    pairs = near_texts()
    got = bayes_jaccard.similarity_classes(docs_of(spark, pairs), cfg).collect()
    want = brute_links(pairs)
    assert max(n for _, n in want) >= 60
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.n_links) for r in got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("threshold", ["3000", "-1", "10485760"])
def test_repeated_rows_are_one_set_in_every_plan(spark, tmp_path, threshold):
    """Rows repeated in every file, several texts of one id, ids that are null: streamed, sorted or broadcast."""
    pairs = near_texts()[:90]
    pairs += [(3, pairs[50][1]), (3, pairs[51][1]), (None, pairs[8][1]), (None, pairs[8][1]), (None, pairs[70][1])]
    for i in range(6):
        part = spark.createDataFrame([(d, t, "x", "y", "z") for d, t in pairs[i % 2 :: 2] + pairs[:20] * (i % 3)], DOC)
        part.coalesce(1).write.parquet(f"{tmp_path}/d", mode="append")
    docs = spark.read.parquet(f"{tmp_path}/d")
    all_pairs = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(all_pairs) > 380
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        rows_ = bayes_jaccard.materialise(bayes_jaccard.describe(docs, bayes_jaccard.JaccardConfig()), "t")
        nodes = bayes_jaccard.materialise(bayes_jaccard.chosen_rows(rows_), "t")
        sets = bayes_jaccard._sets(nodes.select("k"), nodes, docs, bayes_jaccard.JaccardConfig())
        assert sets.count() == nodes.count() == sets.select("k").distinct().count()
        got = bayes_jaccard.similarity_classes(docs).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.n_links) for r in got), key=key) == sorted(brute_links(all_pairs), key=key)
    assert sorted(((r.doc_id, r.class_id, r.n_links > 0) for r in got), key=key) == sorted(brute_classes(all_pairs), key=key)


def test_a_stray_label_costs_few_rows(spark):
    """A bucket of 5000 members of one label and one stray: about as many rows as members, all pairs found."""
    cfg = bayes_jaccard.JaccardConfig(cell=512, small=4)
    r = np.random.default_rng(1)
    sig = r.integers(0, 1 << 16, cfg.long_hashes).astype("<u2")
    key = lambda i: int(i).to_bytes(16, "big")
    members = spark.createDataFrame([(7, 0, key(i)) for i in range(5001)], "band bigint, no int, k binary")
    sets = spark.createDataFrame([(key(i), bytearray(sig.tobytes())) for i in range(5001)], "k binary, long_sig binary")
    labels = spark.createDataFrame([(key(i), key(0)) for i in range(5000)], "k binary, label binary")
    cells = bayes_jaccard.across_cells(members, sets, labels, cfg)
    assert cells.count() == 5001 + -(-5001 // 256)
    got = {(bytes(x.a), bytes(x.b)) for x in bayes_jaccard._across(members, sets, labels, cfg).collect()}
    assert got == {(key(i), key(5000)) for i in range(5000)}


def test_similarity_of_nothing(spark):
    assert bayes_jaccard.similarity_classes(spark.createDataFrame([], DOC)).collect() == []


def test_posterior_bound():
    cfg = bayes_jaccard.JaccardConfig()
    for n, m in bayes_jaccard.least_matches(cfg)[:6]:
        p = lambda m: sum(math.comb(n + 1, i) * 0.8**i * 0.2 ** (n + 1 - i) for i in range(m + 1))  # noqa: B023, E731
        assert p(m) >= cfg.tolerance > (p(m - 1) if m else 0)


def test_names_do_not_depend_on_partitions(spark):
    pairs = [(i, f"{'ab' * (i % 7)}{i % 5}" * 3) for i in range(60)]
    cfg = exact_dedup.BlockNamingConfig(4)
    names = [sorted((r.doc_id, r.depth, r.n_bytes, r.name) for r in exact_dedup.block_identities(spark.createDataFrame(pairs, "doc_id bigint, text string").repartition(n), cfg).collect()) for n in (1, 5)]
    assert names[0] == names[1]


VEC = "vec_id bigint, embedding array<float>, label int, v string, code string, q string"


@pytest.mark.parametrize("cfg", [multi_index_hashing.MihConfig(flips=4, bits=8, target=1.0, keep=1.0, block_rows=64, chunk_queries=8, together=3), multi_index_hashing.MihConfig(most_substrings=1, flips=0, target=0.0, block_rows=64, chunk_queries=8)])
def test_neighbours_exact_when_few(spark, cfg):
    """By probes that reach all, over blocks and chunks; by the exact way, where probes find too few."""
    r = np.random.default_rng(4)
    x = r.normal(size=(150, 12)).astype(np.float32)
    x[40:60] = x[40]  # copies: ties
    data = [(i, v.tolist(), 0, "a", "b", "c") for i, v in enumerate(x)]
    bad = [(1000, None), (1100, []), (1200, [0.0] * 12), (1300, [float("nan")] * 12), (1400, [None] * 12), (1500, [float("inf")] + [1.0] * 11), (1600, [1.0] * 5), (None, [1.0] * 12)]
    data += [(i, v, 0, "a", "b", "c") for i, v in bad] + [data[7]]
    df = spark.createDataFrame(data, VEC).repartition(4)
    got = multi_index_hashing.neighbours(df, F.col("vec_id") % 10 == 0, cfg).collect()
    d = np.sqrt(((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(-1))
    want = []
    for q in range(0, 150, 10):
        ids = [i for i in np.lexsort((np.arange(150), d[q])) if i != q][:10]
        want += [(q, k + 1, int(i)) for k, i in enumerate(ids)]
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == want
    assert all(abs(r.score - d[r.query_id, r.vec_id]) < 1e-12 for r in got)


def test_neighbours_of_nothing_and_few(spark):
    assert multi_index_hashing.neighbours(spark.createDataFrame([], VEC), F.lit(True)).collect() == []
    two = spark.createDataFrame([(0, [1.0, 2.0], 0, "", "", ""), (1, [1.0, 3.0], 0, "", "", "")], VEC)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in multi_index_hashing.neighbours(two, F.lit(True)).collect()) == [(0, 1, 1, 1.0), (1, 1, 0, 1.0)]


def test_vectors_of_each_length_have_their_own_neighbours(spark):
    data = [(i, [float(i), 1.0] if i % 3 else [float(i), 1.0, 2.0], 0, "", "", "") for i in range(1, 40)]
    got = multi_index_hashing.neighbours(spark.createDataFrame(data, VEC), F.col("vec_id") == 9, multi_index_hashing.MihConfig(flips=16, k=3)).collect()
    assert sorted((r.rank, r.vec_id) for r in got) == [(1, 6), (2, 12), (3, 3)]


def test_probing_retrieves_the_whole_radius():
    r = np.random.default_rng(5)
    x = r.normal(size=(500, 16)).cumsum(0)
    mean, rotations = multi_index_hashing.learn_rotations(x, 64, 5)
    codes = multi_index_hashing.Codes(mean, rotations, 16, 4, 64, 64, 2)
    values, short = codes.of(x)
    assert np.array_equal((short.view(np.uint8) != 0).any(1), (values != 0).any(1))
    pop = np.bitwise_count(values[:, None] ^ values[None]).sum(2)
    for flips in (0, 1, 2):
        near = multi_index_hashing.masks(16, flips)
        assert len(set(near.tolist())) == len(near) == sum(math.comb(16, i) for i in range(flips + 1))
        found = multi_index_hashing.BlockIndex(replace(codes, flips=flips), np.arange(500), x).probe(values[:20])
        assert found[pop[:20] <= 4 * (flips + 1) - 1].all()
        assert np.array_equal(found, (np.bitwise_count(values[:20, None] ^ values[None]) <= flips).any(2))


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op4_multi_index_hashing(spark, sf).toPandas()
    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.array(e.embedding.tolist(), float), e.vec_id.to_numpy()
    hit = n = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        hit += len(set(ids[np.lexsort((ids, d))[:10]]) & set(got.vec_id[got.query_id == q]))
        n += 10
    assert hit / n >= 0.9


def recall_of(spark, x, cfg=multi_index_hashing.MihConfig()):
    df = spark.createDataFrame([(i, v.tolist(), 0, "", "", "") for i, v in enumerate(x)], VEC).repartition(4)
    got = {}
    for r in multi_index_hashing.neighbours(df, F.col("vec_id") % 40 == 0, cfg).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, len(x), 40):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(set(np.argsort(d, kind="stable")[:10].tolist()) & got[q])
    return hit / (10 * len(range(0, len(x), 40)))


@pytest.mark.parametrize(("dim", "kind"), [(64, "normal"), (384, "normal"), (768, "normal"), (384, "clusters")])
def test_recall_of_other_shapes(spark, dim, kind):
    """Where 192 substrings don't reach the target, more flips or the exact way do."""
    r = np.random.default_rng(dim)
    x = r.normal(size=(2500, dim)).astype(np.float32)
    if kind == "clusters":
        x = (x * 0.4 + r.normal(size=(40, dim))[r.integers(0, 40, len(x))]).astype(np.float32)
    assert recall_of(spark, x, multi_index_hashing.MihConfig(rounds=3)) >= 0.9


def test_a_target_out_of_reach_goes_the_exact_way(spark):
    x = np.random.default_rng(9).normal(size=(400, 40)).astype(np.float32)
    cfg = multi_index_hashing.MihConfig(most_substrings=2, target=0.99, most_flips=2)
    assert recall_of(spark, x, cfg) == 1.0


def test_more_than_1000_lengths_raise(spark):
    df = spark.createDataFrame([(i, [1.0] * i, 0, "", "", "") for i in range(1, 1002)], VEC)
    with pytest.raises(ValueError, match="1000 lengths"):
        multi_index_hashing.neighbours(df, F.lit(True))


URLS = [None, "", "no scheme", "http://", "https://A.Example.ORG/es/x?q#f", "http://example.org/en/1/2", "http://notexample.org/es/", "ftp://x.com/de/", "http://x.com/fr/1", "http://x.com?/fr/", "http://x.net#a/b", "a://b://c/d", "http://x.com/de\n/é"]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(URLS)] + [(None, URLS[4], "h", "p"), (4, URLS[4], "h", "p")], "page_id bigint, url string, host string, good string")
    outcomes = spark.createDataFrame([(8, 0), (9, 0), (7, None)], "page_id bigint, good int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.judge_urls(pages, outcomes).collect()}
    assert got[0] == got[1] == got[2] and got[0][:3] == ("", "", None)
    assert got[4][:4] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[5][2:] == ("example.org/en/1", "block")
    assert got[6][2:] == ("org/", "allow") and got[7][2:] == ("com/de/", "block") and got[8][2:] == ("com/fr/", "allow")
    assert got[9][:3] == ("x.com", "", None) and got[10][:2] == ("x.net", "") and got[11][:2] == ("b:", "//c/d")
    assert url_reputation.judge_urls(pages.limit(0), outcomes).collect() == []
    assert len(url_reputation.judge_urls(pages, outcomes.limit(0)).collect()) == len(URLS) + 2


def test_hosts_of_the_reputation(spark):
    hosts = {"a.b.co.uk": ("a.b.co.uk", "b.co.uk", "co.uk"), "u:p@x.a.org:8080": ("x.a.org", "a.org", "org"), "10.0.0.1:80": ("10.0.0.1",) * 3, "[::1]:80": ("[::1]",) * 3, "localhost": ("localhost",) * 3, "co.uk": ("co.uk",) * 3, "": ("", "", ""), "a." + "b" * 5000 + ".com": ("a." + "b" * 5000 + ".com", "b" * 5000 + ".com", "com")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string").withColumn("name", url_reputation.reputation_host(F.col("host")))
    df = df.withColumn("suffix", url_reputation.suffix_of(F.col("name"))).withColumn("domain", url_reputation.registered_domain(F.col("name"), F.col("suffix")))
    assert {r.host: (r.name, r.domain, r.suffix) for r in df.collect()} == hosts


def test_posterior_tail_against_integration(spark):
    ab = [(0.1, 1.9), (0.5, 0.5), (2.0, 3.0), (1.0, 1.0), (30.0, 10.0), (400.0, 420.0)]
    got = spark.createDataFrame(ab, "a double, b double").select("a", "b", url_reputation.beta_below(F.col("a"), F.col("b"), 0.5, 64).alias("p")).collect()
    u = (np.arange(400_000) + 0.5) / 400_000  # x = u^20 / 2 from below, mirrored above, keeps both ends tame

    def half(a, b):
        x = 0.5 * u**20
        return np.mean(np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-x)) * 10 * u**19)

    for r in got:
        low, high = half(r.a, r.b), half(r.b, r.a)
        assert r.p == pytest.approx(low / (low + high), abs=1e-6)


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    assert same(rows(queries.queries()[name](spark, sf).toPandas()), rows(sql_rows(sf, queries.oracle_sql()[name])))


def test_escapes_are_reversible():
    r = random.Random(6)
    for _ in range(5000):
        text = "".join(r.choice(["\\", "#", "###", "</turn>", "</turn", ">", "a", ":", "\n", "### A:\n"]) for _ in range(r.randrange(9)))
        role = "".join(r.choice(["u", "\\", ":", "\n", "###", "n"]) for _ in range(r.randrange(4)))
        out = chat_format.render_turn(role, text) + chat_format.render_turn("x", text)
        back = list(chat_format.read_back(out))
        assert [(a, b) for a, b, _, _ in back] == [(role, text), ("x", text)]
        assert all(chat_format.unescape(out[a:z]) == text for _, _, a, z in back)


def test_events_fold(spark):
    log = [
        (1, 1, "begin", 0, "user", "h"), (1, 2, "delta", 0, None, "i"), (1, 3, "begin", 1, "assistant", None), (1, 4, "delta", 1, None, "wrong"), (1, 5, "regenerate", 1, None, ""),
        (1, 6, "delta", 1, None, "right"), (1, 7, "message", 2, "user", "bye"), (1, 8, "edit", 0, None, "hello"), (1, 9, "begin", 3, "user", "?"), (1, 10, "remove", 3, None, None),
        (2, 0, "message", 0, "user", None), (2, 1, "message", 1, "assistant", "a"), (2, 1, "message", 1, "assistant", "a"), (None, 5, "delta", 5, None, "x"), (3, 1, "begin", 0, "user", "a"), (3, 2, "remove", 0, None, None),
    ]
    random.Random(7).shuffle(log)
    df = spark.createDataFrame([(*e[:4], None, *e[4:], "clash") for e in log], chat_format.EVENTS + ", formatted string")
    got = {r.conv_id: r for r in chat_format.format_digests(df).collect()}
    want = {1: [("user", "hello"), ("assistant", "right"), ("user", "bye")], 2: [("user", ""), ("assistant", "a"), ("assistant", "a")], None: [("", "x")]}
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars) == (len(turns), len(loss))
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    whole = {}
    for r in sorted(chat_format.format_conversations(df).collect(), key=lambda r: (str(r.conv_id), r.turn_no)):
        whole[r.conv_id] = whole.get(r.conv_id, "") + r.formatted
    assert {c: [(a, b) for a, b, _, _ in chat_format.read_back(t)] for c, t in whole.items()} == want
    assert {c: len(t) for c, t in whole.items()} == {c: got[c].formatted_chars for c in want}
    assert chat_format.format_digests(df.limit(0)).collect() == []


def test_later_turns_go_with_a_regeneration(spark):
    log = [(1, 1, "begin", 0, None, "user", "a"), (1, 2, "begin", 1, None, "assistant", "b"), (1, 3, "begin", 2, None, "user", "gone"), (1, 4, "regenerate", 1, None, None, "c"), (1, 5, "begin", 3, None, "user", "d"), (1, None, "begin", 4, None, "user", "gone too"), (1, 6, "regenerate", 0, None, None, "a2"), (1, 7, "delta", 3, None, None, "new")]
    got = chat_format.format_conversations(spark.createDataFrame(log, chat_format.EVENTS)).orderBy("turn_no").collect()
    assert [(a, b) for a, b, _, _ in chat_format.read_back("".join(r.formatted for r in got))] == [("user", "a2"), ("", "new")]
    with pytest.raises(Exception, match="unknown kind"):
        chat_format.format_digests(spark.createDataFrame([(1, 1, None, 0, None, "user", "a")], chat_format.EVENTS)).collect()


def test_reader_takes_any_pieces():
    r = random.Random(2)
    turns = [(r.choice(["user", "assistant"]), "".join(r.choice(["\\", "###", "</turn>", "\n", "x" * 50]) for _ in range(r.randrange(60)))) for _ in range(300)]
    whole = "".join(chat_format.render_turn(*t) for t in turns)
    reader, got, at = chat_format.Reader(), [], 0
    while at < len(whole):
        step = r.randrange(1, 90_000)
        got += reader.feed(whole[at : at + step])
        at += step
    assert got + list(reader.feed("", True)) == turns
    with pytest.raises(ValueError):
        list(chat_format.Reader().feed("### user:\nno end", True))


def test_streamed_conversations_come_out_whole(spark):
    """Every turn through drafts, deltas, edits and regenerations; repeated rows, nulls and equal turns too."""
    sf = "/root/testdata/sf0.001"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    more = [(-1, 0, "user", "twice"), (-1, 0, "user", "twice"), (-1, 1, "assistant", "b"), (-1, 1, "assistant", "a"), (-1, 1, None, None), (-1, None, "user", "no turn"), (None, 3, "user", "x" * 99_999), (-2, 5, "assistant", "")]
    df = spark.createDataFrame(rows + more, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    got = {r.conv_id: r for r in chat_format.format_digests(chat_format.streamed_events(df)).collect()}
    want = {}
    for c, t, role, text in sorted(rows + more, key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars, got[c].formatted_chars) == (len(turns), len(said), sum(len(chat_format.render_turn(*t)) for t in turns))
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_probe_conversation(spark):
    got = {r.conv_id: r for r in queries.op3_chat_format(spark, "/root/testdata/sf0.001").collect()}[-7]
    said = "\\### Assistant: </turn> ok"
    assert got.n_turns == 2 and got.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
