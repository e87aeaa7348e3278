"""Merkle manifest: against a plain recursion, and on defined cases."""

import hashlib
import random
import zlib

import pytest

from beamframe.llm import merkle_manifest, queries
from tests.compare import rows, same, sql_rows

DOC = "doc_id bigint, text string, source string, lang string, n_chars bigint, idx string, tree_id string, h string, path string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """Root and, for each node, what stands left and right of it on every level."""
    beside = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for leaf, i in enumerate(at):
            run = runs[i // 3]
            beside[leaf].append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
            at[leaf] = i // 3
        nodes = [sha("".join(r)) for r in runs]
    return nodes[0], beside


def brute(docs):
    leaf = lambda d, text: sha("".join(field(x) for x in (d[0], d[2], d[3], d[4], text)))
    trees = {}
    for d in docs:
        trees.setdefault(d[2], []).append(d)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in names:
        trees[s].sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf(d, d[1])))
        built[s] = climb([leaf(d, d[1]) for d in trees[s]])
    root, upper = climb([built[s][0] for s in names])
    out = []
    for s, above in zip(names, upper, strict=True):
        for d, below in zip(trees[s], built[s][1], strict=True):
            text = d[1]
            if text is not None and d[0] is not None and zlib.crc32(str(d[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            h = leaf(d, text)
            for left, right in below + above:
                h = sha(left + h + right)
            out.append((d[0], leaf(d, d[1]), built[s][0], root, sha("".join(a + b for a, b in below + above)), h, h == root))
    return sorted(out, key=str)


def check(spark, docs):
    df = spark.createDataFrame([(*d, "i", "t", "h", "p") for d in docs], DOC).repartition(3)
    got = merkle_manifest.verify_manifest(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs)


def test_trees_of_many_sizes(spark):
    r = random.Random(3)
    docs, at = [], 0
    for source, n in [(None, 4), ("", 1), ("a", 28), ("ä", 2), ("z", 3), ("hot", 83), ("Z", 9), ("10", 1)]:
        for _ in range(n):
            text = r.choice([None, "", "\n", "one\ntwo\n", "one two", "ü\n" * 50, "x" * 3000])
            docs.append((at, text, source, r.choice([None, "en"]), r.choice([None, 0, 7])))
            at += 1
    check(spark, docs)


def test_repeated_rows_ids_and_nulls(spark):
    docs = [(5, "a\nb", "s", "en", 3)] * 5 + [(5, "a\nc", "s", None, None), (None, "q\n", "s", "en", 2), (None, None, None, None, None), (-1, "\n", "s", "en", 1)]
    check(spark, docs)


def test_fields_do_not_run_into_one_another(spark):
    check(spark, [(1, "x", "ab", "c", 1), (1, "x", "a", "bc", 1), (1, "-", "-", "-", 1)])


def test_one_source_and_one_row(spark):
    check(spark, [(7, "t\n", "only", "en", 2)])
    check(spark, [(i, "t\n", "only", "en", 2) for i in range(10)])


def test_empty_table(spark):
    assert merkle_manifest.verify_manifest(spark.createDataFrame([], DOC)).collect() == []


def test_same_as_sql(spark, small):
    mine = queries.queries()["op11_merkle_manifest"](spark, small)
    assert same(rows(mine.toPandas()), rows(sql_rows(small, queries.oracle_sql()["op11_merkle_manifest"])))


@pytest.mark.parametrize("fanout", [2, 5])
def test_other_fanouts_verify(spark, small, fanout):
    cfg = merkle_manifest.ManifestConfig(fanout=fanout)
    docs = queries.table(spark, small, "documents")
    from pyspark.sql import functions as F

    out = merkle_manifest.manifest(docs, {"text": F.concat("text", F.lit("!"))}, F.col("doc_id") % 7 == 0, cfg)
    found = {(x.doc_id % 7 == 0, x.verified) for x in out.select("doc_id", "verified").join(docs.where("text is not null").select("doc_id"), "doc_id").distinct().collect()}
    assert found == {(True, False), (False, True)}
