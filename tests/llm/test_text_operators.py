"""Language, toxicity, encoding, packing and token counts: edge cases, libraries and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from beamframe.llm import chunked_bpe, cross_parsing, packing, queries, token_rollup, toxicity
from beamframe.llm.word_bpe import default_vocab, load_tokenizer

SCHEMA = "doc_id bigint, text string, lang string, source string, score string, features string, sample_order bigint"
LONG = "the hand and the other of that thing " * 20_000
ODD = [
    (1, None), (2, ""), (3, "   \n\t"), (4, "123 ... 456"), (5, "The hand of the other."), (5, "The hand of the other."), (None, "no id at all"), (6, LONG),
    (7, "naïve façade — 東京 😀 İstanbul ﬁ e\u0301"), (8, "don't we'll I'm o'clock's 'tis"), (9, "<|endoftext|> a<|startoftext|>b"), (10, "x" * 9000), (11, "a\x1cb\u2028c\x85d\u3000e"), (12, "!!!???" * 700),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en" if i != 4 else None, None, "1", "2", 3) for i, t in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_phrases(train: str, text: str) -> int:
    n = i = 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in train:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


@pytest.mark.parametrize("block", [7, 64, 1024])
def test_phrases_are_greedy_longest_matches(block):
    """Whatever the block, phrases run over its border."""
    r = random.Random(1)
    train = {g: "".join(r.choice(a) for _ in range(n)) for g, a, n in (("aa", "abcd ", 400), ("bb", "cdef ", 900), ("cc", "日月火水 ", 50))}
    p = cross_parsing.CrossParser(sorted(train.items()), cross_parsing.LangConfig(block=block, rows=50))
    texts = ["".join(r.choice("abcdefg日 ") for _ in range(r.randrange(1, 300))).strip() for _ in range(40)]
    texts += [train["aa"] * 3, train["bb"][100:800], train["aa"][:200] + train["bb"][:200], "zz" * 99]
    counts, _ = p.phrases(texts)
    folded = {g: " ".join(t.split()) for g, t in train.items()}
    for t, got in zip(texts, counts.tolist(), strict=True):
        assert got == [brute_phrases(folded[g], " ".join(t.split())) for g in sorted(train)]


def test_large_alphabets_stay_sparse():
    r = random.Random(8)
    letters = [chr(0x4E00 + i) for i in range(3000)]
    zh = ["".join(r.choice(letters) for _ in range(400)) for _ in range(24)]
    en = [" ".join("".join(r.choice("etaoinshr") for _ in range(5)) for _ in range(80)) for _ in range(24)]
    p = cross_parsing.CrossParser([("en", t) for t in en] + [("zh", t) for t in zh], cross_parsing.LangConfig())
    assert len(p.owner) < 8 * sum(map(len, zh + en))
    assert p.predict([zh[3][50:90], en[5][40:90], "жж ялла ъ"])[0][:2] == ["zh", "en"]
    assert p.predict([zh[3][50:90], en[5][40:90], "жж ялла ъ щж ъъыэ"])[3].tolist() == [False, False, True]


def test_ties_go_to_the_first_language():
    p = cross_parsing.CrossParser([("bb", "abcabc"), ("aa", "abcabc")], cross_parsing.LangConfig())
    lang, score, _, _ = p.predict(["abc cab"])
    assert lang == ["aa"] and score[0] == 0


def test_sample_is_of_whole_short_documents(spark):
    rows = [(i, f"word{i} " * (5000 if i % 2 else 3), "en") for i in range(400)] + [(1000, "lang " * 9000, "xx"), (1001, None, "yy")]
    got = cross_parsing.training_sample(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True))
    texts = {t for _, t, _ in rows}
    assert len(got) == 25 and all(t in texts for _, t in got)
    assert sum(len(t) > 8192 for g, t in got if g == "en") == 0 and [g for g, _ in got].count("xx") == 1


def test_the_sample_is_bounded_in_rows_and_characters(spark):
    """One id with very many texts; long texts; more characters than the languages' part."""
    rows = [(7, f"text {i} of one id", "en") for i in range(5000)] + [(i, "langer text " * 600, "de") for i in range(50)] + [(99, "x" * 30_000, "fr"), (98, "y" * 29_000, "fr")] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = cross_parsing.training_sample(docs, F.lit(True), cross_parsing.LangConfig(sample_chars=60_000))
    n = {g: [len(t) for h, t in got if h == g] for g in ("en", "de", "fr")}
    assert len(n["en"]) == 24 and n["de"] == [7200, 7200] and len(n["fr"]) == 1
    assert {g for g, _ in cross_parsing.training_sample(docs, F.lit(True), cross_parsing.LangConfig(most_chars=10_000))} == {"en", "de"}
    with pytest.raises(ValueError, match="more than 1 labels"):
        cross_parsing.training_sample(docs, F.lit(True), cross_parsing.LangConfig(max_langs=1, sample_docs=2))


def test_automata_of_tasks_are_those_of_the_driver(spark):
    sample = [("aa", "one two three"), ("bb", "zwei drei vier"), ("cc", "日月 火水"), ("dd", "123")]
    here, there = (cross_parsing.CrossParser(sample, cross_parsing.LangConfig(), b) for b in (cross_parsing._here, cross_parsing.by_tasks(spark)))
    assert here.langs == there.langs == ["aa", "bb", "cc"] and here.starts == there.starts
    assert all(np.array_equal(getattr(here, a), getattr(there, a)) for a in ("base", "owner", "target", "first"))


def test_languages_of_odd_texts(odd, none):
    got = cross_parsing.identify_languages(odd).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {1, 2, 3, 4, 12} <= {r.doc_id for r in got if r.rejected}
    assert cross_parsing.identify_languages(none).collect() == []
    assert {r.lang_pred for r in cross_parsing.identify_languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


@pytest.mark.parametrize("rare", ["lorem ipsum dol", "e", "123 456", ""])
def test_a_rare_language_leaves_the_others_whole(rare):
    r = random.Random(4)
    vocab = {g: ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 8))) for _ in range(150)] for g in ("bb", "cc", "dd")}
    text = lambda g, n: " ".join(r.choice(vocab[g]) for _ in range(n))
    full = [(g, text(g, 150)) for g in vocab for _ in range(20)]
    evens = [math.log2(len(" ".join(t for h, t in full if h == g))) for g in vocab]
    p = cross_parsing.CrossParser([("aa", rare), *full], cross_parsing.LangConfig())
    assert p.langs == (["aa"] if any(c.isalpha() for c in rare) else []) + ["bb", "cc", "dd"] and np.allclose(p.bits[-3:], evens, atol=0.01)
    held = [(g, text(g, 30)) for g in vocab for _ in range(30)]
    got, score, _, _ = p.predict([t for _, t in held])
    assert got == [g for g, _ in held] and score.min() > 0
    alone = cross_parsing.CrossParser(full, cross_parsing.LangConfig()).predict([t for _, t in held])
    assert alone[0] == got
    if len(rare) > 9:
        assert p.predict([rare])[0] == ["aa"]


def test_language_accuracy_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op1_cross_parsing(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id)


def test_prediction_ignores_labels(spark, odd):
    sample = [("en", "the hand and the other of that thing"), ("fr", "la main et autre chose de cela")]
    a = sorted((str(r.doc_id), r.lang_pred) for r in cross_parsing.predict_languages(odd, sample).collect())
    b = sorted((str(r.doc_id), r.lang_pred) for r in cross_parsing.predict_languages(odd.withColumn("lang", F.lit("zz")), sample).collect())
    assert a == b


def test_toxicity_of_odd_texts(spark, odd, none):
    labels = spark.createDataFrame([(5, 1, 0), (6, 1, 0), (7, None, None), (99, 0, 1), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    got = toxicity.score_toxicity(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert toxicity.score_toxicity(none, labels).collect() == []
    assert len(toxicity.score_toxicity(odd, labels.limit(0)).collect()) == len(ODD)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out AND toxic IS NOT NULL").toPandas()
    rank = got.score.rank()
    n1 = int(got.toxic.sum())
    assert (rank[got.toxic == 1].sum() - n1 * (n1 + 1) / 2) / n1 / (len(got) - n1) > 0.85
    assert got[got.predicted == 1].toxic.mean() > 0.85


def test_obfuscated_words_fold():
    assert toxicity.fold("1d10t!!") == "idiot" and toxicity.fold("s.c.u.m") == "scum" and toxicity.fold("Stuuuupid") == "stupid"
    f = dict(zip(toxicity.FEATURES, toxicity.features_of("You are an 1d10t and i d i o t", toxicity.TokenFlags(frozenset()), toxicity.ToxicityConfig()), strict=True))
    assert f["lexicon_count"] == pytest.approx(np.log1p(2)) and f["hidden_count"] > 0 and f["near_second"] > 0


def brute_features(text, lexicon, cfg):
    """The features from their definitions, token by token."""
    tokens = (text or "").split()
    letters = lambda t: "".join(c for c in t.translate(toxicity.LEET) if c.isalpha())
    bare = lambda t: re.sub(r"^\W+|\W+$", "", t)
    run, spelt = "", []
    for t in [*tokens, "end of text"]:
        if re.fullmatch(r"[^\W_]([.*_-][^\W_])*", bare(t)):
            run += letters(t)
        else:
            spelt += [run] if len(run) >= 4 else []
            run = ""
    tokens += spelt
    n = len(tokens)
    if not n:
        return [0.0] * len(toxicity.FEATURES)
    listed = lambda w: w in toxicity.SEED or any(s in lexicon for s in toxicity.stems_of(w))
    plain = [listed(bare(t).lower()) for t in tokens]
    hits = [i for i, t in enumerate(tokens) if plain[i] or listed(toxicity.fold(t))]
    second = [i for i, t in enumerate(tokens) if bare(t).lower() in toxicity.SECOND_PERSON]
    seeded = sum(toxicity.fold(t) in toxicity.SEED for t in tokens)
    gaps = [min(abs(i - j) for j in second) for i in hits] if second else []
    stretched = sum(bool(re.search(r"(.)\1\1", bare(t).lower())) for t in tokens)
    mixed = sum(bool(bare(t)) and not bare(t).isalpha() and not bare(t).isdigit() and any(c.isalpha() for c in bare(t)) for t in tokens)
    return [
        len(hits) / n, math.log1p(len(hits)), float(len({toxicity.fold(tokens[i]) for i in hits})), math.log1p(sum(not plain[i] for i in hits)), seeded / n, math.log1p(seeded),
        max((sum(i <= j < i + cfg.peak for j in hits) for i in hits), default=0) / min(n, cfg.peak), len(second) / n, math.log1p(sum(g <= cfg.near for g in gaps)), 1 / (1 + min(gaps)) if gaps else 0.0,
        sum(len(bare(t)) > 1 and bare(t).isupper() and bare(t).isalpha() for t in tokens) / n, sum(len(t) - len(bare(t)) > 1 for t in tokens) / n,
        text.count("!") / n, text.count("?") / n, mixed / n, stretched / n, math.log1p(n),
    ]


def test_features_against_their_definitions():
    r = random.Random(9)
    lexicon = frozenset(["zorp ", "blark", "qui"])
    flags, cfg = toxicity.TokenFlags(lexicon), toxicity.ToxicityConfig(peak=6)
    words = "idiot 1d10t i.d.i.o.t i d i o t YOU you, (you) tu zorp zorpy blarks BLARKED quiet qui hello!! wow?? St00pid stuuupid _x_ a I 7 b2b 123 -- İ ß".split()
    for _ in range(600):
        text = " ".join(r.choice(words) for _ in range(r.randrange(0, 25)))
        assert toxicity.features_of(text, flags, cfg) == pytest.approx(brute_features(text, lexicon, cfg))


def test_calibration_is_the_monotone_least_squares_fit(spark):
    r = np.random.default_rng(3)
    data = [(f"{'idiot you ' * int(r.integers(0, 4))} word{i} " + " ".join("some other words here".split() * int(r.integers(1, 9))), i) for i in range(900)]
    docs = spark.createDataFrame([(i, t) for t, i in data], "doc_id bigint, text string")
    toxic = [(i, int(r.random() < 0.1 + 0.25 * t.count("idiot"))) for t, i in data]
    labels = spark.createDataFrame(toxic, "doc_id bigint, toxic int")
    cfg = toxicity.ToxicityConfig(trees=3)
    model = toxicity.fit_toxicity(docs, labels, F.lit(True), cfg)
    held = toxicity.training_rows(docs, labels, F.lit(True), cfg).where("part = 'calibration'")
    x = model._margin(toxicity.with_features(held, model.lexicon, ["doc_id", "toxic"], cfg)).toPandas().sort_values("margin")
    assert set(x.doc_id).isdisjoint({r.doc_id for r in toxicity.training_rows(docs, labels, F.lit(True), cfg).where("part <> 'calibration'").collect()})
    pools = []  # pool adjacent violators, equal margins together
    for m, g in x.groupby("margin"):
        pools.append([g.toxic.sum(), len(g), [m]])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            b = pools.pop()
            pools[-1] = [pools[-1][0] + b[0], pools[-1][1] + b[1], pools[-1][2] + b[2]]
    want = {m: s / n for s, n, ms in pools for m in ms}
    got = model.calibration.transform(spark.createDataFrame([(float(m),) for m in want], "margin double")).collect()
    assert all(abs(g.calibrated - want[g.margin]) < 1e-9 for g in got) and len(want) > 3


def test_rows_that_share_an_id_share_the_label(spark):
    docs = spark.createDataFrame([(i, "you idiot " * 3 if i % 2 else "fine words here") for i in range(60)] + [(1, "other words"), (1, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 0)], "doc_id bigint, toxic int")
    rows = toxicity.training_rows(docs, labels, F.lit(True), toxicity.ToxicityConfig()).where("doc_id = 1").collect()
    assert len(rows) == 1 and rows[0].toxic == 1 and rows[0].text in (None, "other words", "you idiot " * 3)


def test_one_id_with_many_texts_does_not_grow_the_fit(spark):
    docs = spark.createDataFrame([(1, f"text number {i}") for i in range(2000)] + [(2, "x" * 3000), (3, "y")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id bigint, toxic int")
    rows = toxicity.training_rows(docs, labels, F.lit(True), toxicity.ToxicityConfig(most_chars=1000)).collect()
    assert sorted(r.doc_id for r in rows) == [1, 3]


def test_encoding_is_the_library_s(odd, none):
    tok = load_tokenizer(default_vocab())
    cfg = chunked_bpe.ChunkConfig(window=8, mask_bits=4, min_chars=8, max_chars=64)
    for c in (chunked_bpe.ChunkConfig(), cfg):
        got = sorted(((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in chunked_bpe.encode_digests(odd, cfg=c).collect()))
        want = []
        for i, t in ODD:
            ids = tok.encode(t or "", add_special_tokens=False).ids
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            want.append((str(i), len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
        assert got == sorted(want)
    assert chunked_bpe.encode_digests(none).collect() == []
    assert [list(r.ids) for r in chunked_bpe.encode_texts(odd.where("doc_id = 8")).collect()] == [tok.encode(ODD[9][1], add_special_tokens=False).ids]


def odd_strings(n):
    """Random strings over all planes: letters whose small form has a mark, marks, separators, special tokens."""
    r = random.Random(5)
    pools = ["İIıiĞğŞş", "\u0307\u0301\u0338\u0327\u20d0\u1ab0", ".,!?'’-–—:;()<|>/\\@#$%^&*_+=~`\"", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789½²", "àéîõüÿŒœßǅǄſɏɐ", "ΣσςЖё", "東京かな한국ﾅ", "\u200d\u200b\xad\ufeff\u2060", "ªº×÷😀"]
    gaps = [" ", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u2000", "\u2028", "\u202f", "\u3000", "\u180e", "", "", "", ""]
    special = ["<|endoftext|>", "<|startoftext|>", "<|", "'s", "'re", "İ,", "GAZİ!", "İSTANBUL'DA Kİ.", "BİRİNCİ,"]
    planes = [(32, 0x250), (0x250, 0xD800), (0xE000, 0x110000), (0x300, 0x370)]

    def word():
        k = r.randrange(4)
        if k == 0:
            return r.choice(special)
        if k == 1:
            return "".join(chr(r.randrange(*r.choice(planes))) for _ in range(r.randrange(1, 5)))
        return "".join(r.choice(r.choice(pools)) for _ in range(r.randrange(1, 9)))

    return ["".join(word() + r.choice(gaps) for _ in range(r.randrange(1, 7))) for _ in range(n)]


def test_ids_of_odd_strings_are_the_library_s():
    tok = load_tokenizer(default_vocab())
    enc = chunked_bpe.ChunkEncoder(default_vocab(), chunked_bpe.ChunkConfig(window=4, mask_bits=3, min_chars=4, max_chars=32))
    texts = odd_strings(100_000)
    for at in range(0, len(texts), 5000):
        part = texts[at : at + 5000]
        for t, want in zip(part, tok.encode_batch(part, add_special_tokens=False), strict=True):
            assert np.frombuffer(enc.encode(t), "<u2").tolist() == want.ids, repr(t)
    assert enc.reused > 1000


def test_joins_without_agreement_are_encoded_whole():
    enc = chunked_bpe.ChunkEncoder(default_vocab(), chunked_bpe.ChunkConfig(window=4, mask_bits=3, min_chars=4, max_chars=8))
    text = "some words that are cut in the middle of themselves"
    want = enc.words.library(text)
    assert enc.encode(text) == want and enc.widened == 0
    enc._repaired = lambda *_: None
    assert enc.encode(text) == want and enc.widened == 1


def test_shared_chunks_are_encoded_once():
    enc = chunked_bpe.ChunkEncoder(default_vocab())
    r = random.Random(2)
    passage = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(4000))
    enc.encode("first " + passage)
    before = enc.encoded
    enc.encode("another beginning " + passage)
    assert enc.encoded - before <= 2 and enc.reused > 5


def check_pieces(pieces, docs, limit=4096):
    """Every id once, sequences gapless and whole, checksums right; padding share returned."""
    tok = load_tokenizer(default_vocab())
    by_seq, by_doc = {}, {}
    for p in pieces:
        by_seq.setdefault(p.sequence_id, []).append(p)
        by_doc.setdefault(p.doc_id, []).append(p)
    pad = total = 0
    for seq in by_seq.values():
        at = 0
        for p in sorted(seq, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= limit
        total += at
        pad += 0 if at & (at - 1) == 0 else limit - at
    for i, text in docs:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    return pad / max(total, 1)


def test_packing_odd_texts(odd, none):
    once = [d for k, d in enumerate(ODD) if d not in ODD[:k]]
    check_pieces(packing.pack_documents(odd.dropDuplicates(["doc_id"])).collect(), once)
    assert packing.pack_documents(none).collect() == []
    assert sum(p.doc_id == 5 for p in packing.pack_documents(odd).collect()) >= 2


def test_packing_wastes_little(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    pad = check_pieces(packing.pack_documents(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert pad < 0.01


def test_cuts_are_optimal():
    cfg = packing.PackConfig(limit=32, least_power=8)
    r = random.Random(3)
    for _ in range(30):
        ends = np.cumsum([r.randrange(1, 20) for _ in range(12)])
        cuts, pen = packing.possible_cuts(ends, ends[:0], int(ends[-1]), cfg)
        _, cost = packing.choose_cuts(cuts, pen, cfg)
        best = [0] + [10**9] * (len(cuts) - 1)
        for j in range(1, len(cuts)):
            for i in range(j):
                n = int(cuts[j] - cuts[i])
                if n <= cfg.limit:
                    power = n >= cfg.least_power and n & (n - 1) == 0
                    best[j] = min(best[j], best[i] + (0 if power else cfg.limit - n) + int(pen[j]) + cfg.sequence_cost)
        assert cost == best[-1]


def test_rollup_counts_deltas_once(spark, tmp_path):
    cols = ["op", "source", "lang", "tokenizer_version", "n_tokens", "old_source", "old_lang", "old_tokenizer_version", "old_n_tokens"]
    e = lambda *rows: spark.createDataFrame([dict(zip(cols, r, strict=True)) for r in rows], token_rollup.EVENTS)
    store = token_rollup.TokenRollup(spark, f"{tmp_path}/rollup")
    assert store.totals().collect() == []
    first = e(("insert", "a", "en", "v1", 10, None, None, None, None), ("insert", None, "en", "v1", None, None, None, None, None), ("insert", "a", "en", "v1", 7, None, None, None, None))
    assert store.commit("b1", first) and not store.commit("b1", first)
    assert store.commit("b2", e(("revise", "b", "en", "v1", 8, "a", "en", "v1", 7), ("delete", "a", "en", "v1", 10, None, None, None, None)))
    assert store.commit("b3", e())
    assert {(r.source, r.docs, r.tokens) for r in store.totals().collect()} == {(None, 1, 0), ("b", 1, 8)}
    with pytest.raises(ValueError):
        store.commit("../x", first)


@pytest.mark.parametrize("op", [None, "upsert"])
def test_unknown_events_raise(spark, op):
    e = spark.createDataFrame([(op, "a", "en", "v", 1, None, None, None, None)], token_rollup.EVENTS)
    with pytest.raises(Exception, match="unknown op"):
        token_rollup.deltas(e).collect()


def test_writers_that_die_or_race_count_once(spark, tmp_path):
    store = token_rollup.TokenRollup(spark, f"{tmp_path}/rollup")
    e = spark.createDataFrame([("insert", "a", "en", "v", 1, None, None, None, None, "clash")], token_rollup.EVENTS + ", docs string")
    name = "b~" + "0" * 32
    token_rollup.deltas(e).write.parquet(f"{tmp_path}/rollup/deltas/{name}")  # died before its marker
    assert store.totals().collect() == [] and not store.committed("b")
    assert store.commit("b", e) and [(r.docs, r.tokens) for r in store.totals().collect()] == [(1, 1)]
    store._mark(f"batch~{name}")  # it was not dead: both have committed
    assert [(r.docs, r.tokens) for r in store.totals().collect()] == [(1, 1)] and not store.commit("b", e)


def test_a_compacted_store_counts_and_remembers(spark, tmp_path):
    store = token_rollup.TokenRollup(spark, f"{tmp_path}/rollup")
    e = lambda n: spark.createDataFrame([("insert", "a", "en", "v", n, None, None, None, None)], token_rollup.EVENTS)
    store.compact()
    for round_ in range(3):
        for k in range(3):
            assert store.commit(f"b{round_}{k}", e(10**k))
        before = [tuple(r) for r in store.totals().collect()]
        store.compact()
        assert [tuple(r) for r in store.totals().collect()] == before == [("a", "en", "v", 3 * (round_ + 1), 111 * (round_ + 1))]
        assert not any(store.commit(f"b{r}{k}", e(5)) for r in range(round_ + 1) for k in range(3))
        assert [f.name for f in (tmp_path / "rollup" / "deltas").iterdir()] == [] and len(list((tmp_path / "rollup" / "bases").iterdir())) == 1
    # a compaction that dies before its marker, and one that dies before it deletes, change nothing
    assert store.commit("late", e(1000))
    store.spark.range(1).write.parquet(f"{tmp_path}/rollup/bases/9~{'f' * 32}/totals")
    base, batches = store._listed()
    assert base.startswith("4~") and list(batches) == ["late"]
    delete, token_rollup.delete_path = token_rollup.delete_path, lambda *_: None
    try:
        store.compact()
    finally:
        token_rollup.delete_path = delete
    assert [tuple(r) for r in store.totals().collect()] == [("a", "en", "v", 10, 1333)]


def test_rollup_through_its_whole_life(spark, none):
    sf = "/root/testdata/sf0.001"
    tok = load_tokenizer(default_vocab())
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        d = want.setdefault((r.source, r.lang), [0, 0])
        d[0] += 1
        d[1] += len(tok.encode(r.text or "", add_special_tokens=False).ids)
    got = {(r.source, r.lang): [r.docs, r.tokens] for r in queries.op9_token_rollup(spark, sf).collect()}
    assert got == want
    assert token_rollup.count_tokens(none).collect() == []


def test_rollup_of_documents(spark, odd):
    tok = load_tokenizer(default_vocab())
    got = {r.doc_id: r.n_tokens for r in token_rollup.count_tokens(odd).collect()}
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in ODD}
