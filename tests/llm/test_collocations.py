"""Phrase collocations against counting by hand."""

import random
import re
from collections import Counter

import pytest

from beamframe.llm import collocations, queries
from beamframe.llm.collocations import PhraseConfig
from tests.compare import rows, same, sql_rows

DOC = "doc_id bigint, text string, lang string, phrase string, n bigint, words string"


def brute(docs, cfg):
    f, total = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, cfg.longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    cand = {p: a for p, a in f.items() if len(p[1]) >= 2 and a >= cfg.least}
    gone = set()
    for (lang, w), a in cand.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                part = (lang, w[i : i + m])
                if 100 * a >= cfg.inside * cand[part]:
                    gone.add(part)
    found = {}
    for (lang, w), a in cand.items():
        if (lang, w) not in gone:
            score, _, left, right = min((cfg.scale * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    out = []
    for lang, best in found.items():
        for rank, (s, a, p, left, right) in enumerate(sorted(best)[: cfg.top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def check(spark, docs, cfg):
    df = spark.createDataFrame([(i, t, lang, "p", 1, "w") for i, (t, lang) in enumerate(docs)], DOC).repartition(3)
    got = collocations.collocations(df, cfg)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(docs, cfg)


WORDS = ["a", "b", "A", "ab", "the", "The", "é", "É", "x\x01", "a\x0e", "\xa0", "日本", "1", "a-b", " "]


@pytest.mark.parametrize(
    "cfg",
    [
        PhraseConfig(least=5),
        PhraseConfig(least=3, block_bytes=40),
        PhraseConfig(least=4, block_bytes=1, sieve_bits=2),
        PhraseConfig(least=2, top=7, longest=3),
        PhraseConfig(least=3, longest=5, inside=60, block_bytes=300),
    ],
)
def test_like_counting_by_hand(spark, cfg):
    r = random.Random(cfg.least)
    docs = [(None, "en"), ("", None), ("   \t\n.", "en"), ("a b", "und"), ("a b", None), ("b a" * 3, "")]
    for i in range(60):
        n = r.choice([0, 1, 2, 5, 30, 400 if i % 20 == 0 else 8])
        text = "".join(r.choice(WORDS[: r.choice([4, 15])]) + r.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\r\n", "\x0b"][: r.choice([3, 10])]) for _ in range(n))
        docs.append((text, r.choice(["en", "en", "de", None])))
    docs += [("one very long line that is copied many times", "en")] * 40
    check(spark, docs, cfg)


def test_one_piece_of_many_blocks(spark):
    check(spark, [("a b c a b d  " * 400, "en"), ("x" * 500 + " a b" * 100, "en"), ("y" * 3000, "en")], PhraseConfig(least=10, block_bytes=64))


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], DOC)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, None, None, "p", 1, "w")], DOC)).collect() == []


def test_counts_past_64_bits_of_products(spark):
    n = 2**61
    assert spark.sql(f"SELECT (CAST({n}L AS DECIMAL(19,0)) * 2000000) DIV (CAST({n}L AS DECIMAL(19,0)) + CAST({n}L AS DECIMAL(19,0))) AS s").first().s == 1000000


def test_same_as_sql(spark, small):
    mine = queries.queries()["op13_collocations"](spark, small)
    assert same(rows(mine.toPandas()), rows(sql_rows(small, queries.oracle_sql()["op13_collocations"])))
