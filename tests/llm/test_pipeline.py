"""The corpus pipeline against brute force, stage by stage."""

import math
import random

import corpus_pipeline
from pyspark.sql import functions as F

from beamframe.llm import cross_parsing
from beamframe.llm.common import id_fold, materialise
from tests.llm.test_sets_and_search import brute_classes
from tests.llm.test_text_operators import brute_phrases, check_pieces

SF = "/root/testdata/sf0.001"


def brute_rejected(sample, text, worst=2.0):
    """No letter, or coded twice as long as letter by letter by the language that codes it best."""
    fold = lambda t: " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split())
    letters = sum(c.isalpha() for c in (text or "").lower())
    if not letters:
        return True
    train = {g: fold("\n".join(t for h, t in sample if h == g)) for g, _ in sample}
    alphabet = math.log2(len(set("".join(train.values())) - {" "}))
    cost = {g: math.log2(len(t)) + alphabet for g, t in train.items()}
    return min((brute_phrases(train[g], fold(text)) - 1) * cost[g] for g in train) >= worst * letters * alphabet


def test_rejection_against_brute_phrases():
    r = random.Random(3)
    sample = [(g, " ".join("".join(r.choice(a) for _ in range(5)) for _ in range(300))) for g, a in (("aa", "abcdefgh"), ("bb", "efghijkl"))]
    p = cross_parsing.CrossParser(sample, cross_parsing.LangConfig())
    texts = ["".join(r.choice("abcdefgh " * (k % 5 * 4) + "жзийклмн") for _ in range(r.randrange(1, 200))) for k in range(100)] + ["", "1 2", "жж", "ab"]
    got = p.predict(texts)[3].tolist()
    for t, rejected in zip(texts, got, strict=True):
        f = " ".join("".join(c if c.isalpha() else " " for c in t).split())
        train = {g: " ".join(x.split()) for g, x in sample}
        alphabet = math.log2(len(set("".join(train.values())) - {" "}))
        code = [brute_phrases(train[g], f) * (math.log2(len(train[g])) + alphabet) for g in ("aa", "bb")] if f else [0, 0]
        own = math.log2(len(train["aa" if code[0] <= code[1] else "bb"])) + alphabet
        letters = sum(c.isalpha() for c in t)
        assert rejected == (letters == 0 or min(code) - own >= 2 * letters * alphabet)
    assert 5 < sum(got) < 100


def test_rows_that_share_an_id(spark):
    base = " ".join(f"word{i}" for i in range(80))
    rows = [(3, base, "x"), (5, base + " tail", "x"), (5, "quite another text of more than five words", "x"), (7, "same", "b"), (7, "same", "a"), (8, base + " one", "x"), (3, base + " two", "x"), (None, base + " three", "x"), (None, "alone with no id", "x")]
    docs = materialise(spark.createDataFrame(rows, "doc_id bigint, text string, kind string"), "test-docs")
    out = [tuple(r) for r in corpus_pipeline.exact(spark, docs, SF).collect()]
    assert len(out) == 8 and sum(r[0] == 7 for r in out) == 1
    again = [tuple(r) for r in corpus_pipeline.exact(spark, materialise(docs.repartition(3), "test-docs"), SF).collect()]
    assert sorted(map(str, out)) == sorted(map(str, again))
    kept = [tuple(r)[:2] for r in corpus_pipeline.near(spark, docs, SF).collect()]
    assert sum(i == 3 for i, _ in kept) == 1 and (5, rows[2][1]) in kept and (5, rows[1][1]) not in kept and (None, rows[8][1]) in kept and (None, rows[7][1]) not in kept and not any(i == 8 for i, _ in kept)
    none = docs.limit(0)
    assert all(stage(spark, none, SF).collect() == [] for _, stage in corpus_pipeline.STAGES[2:])


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    extra = [(9001, None), (9002, ""), (9003, "12 34"), (9004, docs.first().text), (9006, "Привет, как твои дела сегодня? Это письмо на другом языке и его не знает никто"), (9005, "IDIOT moron scum trash loser idiot pathetic stupid clown worthless " * 3)]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in extra], docs.schema)).withColumn("score", F.lit("clash")).withColumn("_others", F.lit(1))
    columns = docs.columns
    was = {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "exact", "near", "packing"]
    sample = cross_parsing.training_sample(docs, id_fold("doc_id", 5) != 0)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), "test-stage")
        got = docs.collect()
        if name == "packing":
            assert check_pieces(got, list(was.items())) < 0.5
            break
        assert docs.columns == columns and all(was[r.doc_id] == r.text for r in got)
        kept = {r.doc_id for r in got}
        assert len(kept) == len(got)
        gone = set(was) - kept
        if name == "language":
            assert gone == {9001, 9002, 9003, 9006} == {i for i in [*range(9001, 9007), *sorted(was)[:6]] if brute_rejected(sample, was[i])}
        elif name == "toxicity":
            assert 9005 in gone and len(gone) < 0.2 * len(was)
        elif name == "exact":
            assert kept == {max(i for i in was if was[i] == t) for t in was.values()}
        else:
            assert kept == {c for _, c, _ in brute_classes(list(was.items()))}
        was = {i: was[i] for i in kept}


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "ids_crc32" in out.columns
