"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The features of a text are densities and counts of insulting words (a fixed seed list and a lexicon
induced from labelled rows), their nearness to second-person words, and rates of capitals,
punctuation and obfuscation (letters swapped for digits or marks, marks between letters, stretched
letters, words spelt letter by letter). Trees are boosted on them, and an isotonic fit on rows that
neither the lexicon nor the trees have seen turns their margin into a probability.

Fitting reads a bounded sample of labelled rows (`ToxicityConfig.sample_rows` of each class, chosen
by hash, one text an id, none of more than `most_chars` characters), split by hash into three parts: for the lexicon, for the trees and for the calibration. The
lexicon takes every word and stem that passes its thresholds; as each must stand in a share of the
sampled toxic rows, the sample bounds it. Scoring reads whole texts and shuffles nothing: what a word
tells is worked out once for each distinct word of a batch, the rest is arithmetic on arrays.

Defined cases: a null text counts as empty; an empty text has all-zero features and gets the score
that these have; null labels and labels of unknown documents do not count, a document with
differing labels counts as toxic; of rows that share a doc_id one, chosen by a hash of its text, is learned from, and each is scored; where a class has fewer than `least_rows` labelled rows for
the trees, texts are scored by the seed list alone, where it has fewer for the calibration, by the trees; repeated rows are scored each; extra columns are ignored; an empty table gives no rows."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from beamframe.llm.common import held, id_fold, materialise, slot_sample_ids, small_batches

#: Seed list of insults; words are matched after folding
SEED = frozenset(
    """idiot idiots moron morons stupid imbecile fool dumb dumbass loser losers clown scum trash garbage
    pathetic worthless disgusting filth filthy vermin pig scumbag jerk bastard asshole retard freak creep
    liar coward parasite degenerate subhuman
    idiota imbecil estupido estupida tonto basura asqueroso inutil payaso escoria cabron
    idiote imbecile stupide cretin ordure pathetique degoutant salaud connard dechet clochard
    dummkopf trottel dumm abschaum widerlich wertlos arschloch versager muell dreck""".split()
)
SECOND_PERSON = frozenset(
    """you your yours yourself yourselves ur ya tu tus te ti tuyo usted ustedes vosotros vuestro toi ton tes
    vous votre vos du dich dir dein deine deiner euch euer ihr""".split()
)
STEM_LETTERS = (3, 4, 5, 6, 7, 8)
LEET = str.maketrans("013457@$!", "oieastasi")
_EDGES = re.compile(r"^\W+|\W+$", re.UNICODE)
_NOT_LETTER = re.compile(r"[\W\d_]+", re.UNICODE)
_STRETCH = re.compile(r"(.)\1{2,}")
_SINGLE = re.compile(r"[^\W_](?:[.*_-][^\W_])*", re.UNICODE)  # letters standing alone, or with a mark between
SPELT_LETTERS = 4  # so many letters in a row spell a word
HIT, HIDDEN, SEEDED, SECOND, CAPS, MIXED, STRETCHED, LOUD, SINGLE = (1 << k for k in range(9))

FEATURES = (
    "lexicon_density", "lexicon_count", "lexicon_distinct", "hidden_count", "seed_density", "seed_count", "lexicon_peak",
    "second_density", "near_second", "nearest_second", "caps_rate", "loud_rate", "exclaim_rate", "question_rate",
    "mixed_rate", "stretched_rate", "log_tokens",
)


@dataclass(frozen=True)
class ToxicityConfig:
    sample_rows: int = 6000  # labelled rows of each class
    most_chars: int = 1 << 20  # longer texts are not learned from
    least_docs: int = 3  # toxic documents with the word or stem
    least_share: float = 0.01  # of the toxic documents
    least_ratio: float = 10.0  # toxic rate over clean rate
    near: int = 5  # words between a hit and a second-person word
    peak: int = 64  # words in a window
    trees: int = 20
    depth: int = 3
    step: float = 0.3
    least_rows: int = 8  # of each class, to grow trees or to calibrate
    threshold: float = 0.7


def fold(token: str) -> str:
    """Lower case, without marks around it, swapped letters restored, marks inside and stretches removed."""
    t = _EDGES.sub("", token).lower()
    if not t.isalpha():
        t = _NOT_LETTER.sub("", t.translate(LEET)) if any(c.isalpha() for c in t) else ""
    return _STRETCH.sub(r"\1", t)


class TokenFlags(dict):
    """token -> flags, remembered; cleared when it holds `limit` tokens."""

    def __init__(self, lexicon: frozenset[str], limit: int = 100_000):
        super().__init__()
        self.words = SEED | {s[:-1] for s in lexicon if s.endswith(" ")}
        self.stems = frozenset(s for s in lexicon if not s.endswith(" "))
        self.lengths = sorted({len(s) for s in self.stems})
        self.limit = limit

    def listed(self, word: str) -> bool:
        if word in self.words:
            return True
        n = len(word)
        for k in self.lengths:
            if k < n and word[:k] in self.stems:
                return True
        return False

    def __missing__(self, token: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        bare = token if token[:1].isalnum() and token[-1:].isalnum() else _EDGES.sub("", token)
        low, letters = bare.lower(), bare.isalpha()
        stretched = _STRETCH.search(low) is not None
        folded = low if low.isalpha() and not stretched else fold(token)
        f = STRETCHED if stretched else 0
        if self.listed(low):
            f |= HIT
        elif folded != low and self.listed(folded):
            f |= HIT | HIDDEN
        if folded in SEED:
            f |= SEEDED
        if low in SECOND_PERSON:
            f |= SECOND
        if letters:
            if len(bare) == 1:
                f |= SINGLE
            elif bare.isupper():
                f |= CAPS
        elif bare:
            if not bare.isdigit() and any(c.isalpha() for c in bare):
                f |= MIXED
            if _SINGLE.fullmatch(bare):
                f |= SINGLE
        if len(token) - len(bare) > 1:
            f |= LOUD
        if len(token) <= 40:
            self[token] = f
        return f


def spelt_words(tokens: list[str], single: np.ndarray) -> list[str]:
    """Words that neighbouring tokens of single letters spell; `single` are the tokens' places."""
    out = []
    for run in np.split(single, np.flatnonzero(np.diff(single) != 1) + 1):
        letters = "".join(_NOT_LETTER.sub("", tokens[i].translate(LEET)) for i in run.tolist())
        if len(letters) >= SPELT_LETTERS:
            out.append(letters)
    return out


def features_of(text: str | None, flags: TokenFlags, cfg: ToxicityConfig) -> list[float]:
    """Dense features of a whole text, in the order of FEATURES."""
    out = [0.0] * len(FEATURES)
    tokens = (text or "").split()
    if not tokens:
        return out
    f = np.fromiter(map(flags.__getitem__, tokens), np.int16, len(tokens))
    single = np.flatnonzero(f & SINGLE)
    if len(single) and (spelt := spelt_words(tokens, single)):
        tokens += spelt
        f = np.append(f, np.fromiter(map(flags.__getitem__, spelt), np.int16, len(spelt)))
    n = len(tokens)
    hits = np.flatnonzero(f & HIT)
    second = np.flatnonzero(f & SECOND)
    share = lambda bit: float(np.count_nonzero(f & bit)) / n
    seeded = int(np.count_nonzero(f & SEEDED))
    out[0], out[1], out[4], out[5] = len(hits) / n, np.log1p(len(hits)), seeded / n, np.log1p(seeded)
    if len(hits):
        out[2] = float(len({fold(tokens[i]) for i in hits.tolist()}))
        out[3] = np.log1p(int(np.count_nonzero(f & HIDDEN)))
        out[6] = float((np.searchsorted(hits, hits + cfg.peak) - np.arange(len(hits))).max()) / min(n, cfg.peak)
        if len(second):
            at = np.searchsorted(second, hits)
            gap = np.minimum(np.abs(second[np.minimum(at, len(second) - 1)] - hits), np.abs(hits - second[np.maximum(at - 1, 0)]))
            out[8], out[9] = np.log1p(int((gap <= cfg.near).sum())), 1.0 / (1.0 + float(gap.min()))
    out[7], out[10], out[11] = share(SECOND), share(CAPS), share(LOUD)
    out[12], out[13] = text.count("!") / n, text.count("?") / n
    out[14], out[15], out[16] = share(MIXED), share(STRETCHED), np.log1p(n)
    return [float(x) for x in out]


def token_flags(lexicon: frozenset[str]) -> TokenFlags:
    """One per Python worker and lexicon, kept between tasks."""
    return held("toxicity", lexicon, lambda: TokenFlags(lexicon))


def with_features(docs: DataFrame, lexicon: frozenset[str], carried: list[str], cfg: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """The columns `carried` of docs, and features array<double>."""
    small_batches(docs.sparkSession)
    cols = list(dict.fromkeys([*carried, "text"]))
    schema = StructType([docs.schema[c] for c in carried]).add("features", ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = token_flags(lexicon)
        for b in batches:
            got = [features_of(t.as_py(), flags, cfg) for t in b.column(cols.index("text"))]
            yield pa.RecordBatch.from_arrays([*(b.column(cols.index(c)) for c in carried), pa.array(got, pa.list_(pa.float64()))], [*carried, "features"])

    return docs.select(*cols).mapInArrow(run, schema)


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column, cfg: ToxicityConfig) -> DataFrame:
    """The bounded sample: doc_id, toxic 0/1, part (lexicon, trees, calibration), text; written once."""
    known = labels.where(usable).select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = slot_sample_ids(known, "doc_id", cfg.sample_rows, by="toxic").select("doc_id", "toxic")
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(23)), F.lit(3))
    name = F.when(part == 0, "lexicon").when(part == 1, "trees").otherwise("calibration")
    texts = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= cfg.most_chars).select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    # of an id's texts the one of the least hash: a grouped minimum, a row an id
    texts = texts.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text")).getField("text").alias("text"))
    return materialise(texts.select("doc_id", "toxic", name.alias("part"), "text"), "toxicity-sample")


def stems_of(word: str) -> list[str]:
    """The word itself, marked by a space at its end, and its first letters: the lexicon holds either."""
    return [word + " ", *(word[:k] for k in STEM_LETTERS if k < len(word))]


def induced_lexicon(rows: DataFrame, cfg: ToxicityConfig) -> frozenset[str]:
    """Words and stems far more frequent, by documents, in toxic rows of the lexicon part."""
    rows = rows.where("part = 'lexicon'")

    def stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: tuple[Counter, Counter] = (Counter(), Counter())
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n[y].update({s for w in set(map(fold, set((t or "").split()))) if len(w) > 2 for s in stems_of(w)})
            found = [*(n[0].keys() | n[1].keys())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *(pa.array([c[w] for w in found], pa.int64()) for c in n)], ["stem", "c0", "c1"])

    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return frozenset()
    c = rows.select("toxic", "text").mapInArrow(stems, "stem string, c0 bigint, c1 bigint").groupBy("stem").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
    rate1, rate0 = F.col("c1") / F.lit(n1), (F.col("c0") + 0.5) / F.lit(n0)
    top = c.where((F.col("c1") >= cfg.least_docs) & (rate1 >= cfg.least_share) & (rate1 >= cfg.least_ratio * rate0))
    found = {r.stem for r in top.collect()}
    return frozenset(s for s in found if not any(s[:k] in found for k in STEM_LETTERS if k < len(s)))


@dataclass
class ToxicityModel:
    lexicon: frozenset[str]
    trees: object | None  # GBTClassificationModel
    calibration: object | None  # IsotonicRegressionModel
    cfg: ToxicityConfig

    def score(self, docs: DataFrame, carried: list[str]) -> DataFrame:
        """The columns `carried` of docs, and score."""
        x = with_features(docs, self.lexicon, carried, self.cfg)
        if self.trees is None:
            return x.select(*carried, F.when(F.col("features")[FEATURES.index("seed_count")] > 0, 0.9).otherwise(0.1).alias("score"))
        x = self._margin(x)
        if self.calibration is None:
            return x.select(*carried, F.round("p", 6).alias("score"))
        return self.calibration.transform(x).select(*carried, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("calibrated"))), 6).alias("score"))

    def _margin(self, x: DataFrame) -> DataFrame:
        y = self.trees.transform(x.withColumn("features", array_to_vector("features")))
        return y.withColumn("margin", vector_to_array("rawPrediction")[1]).withColumn("p", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "features", "prediction")


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, cfg: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Fit on documents whose label is `usable` (an expression over labels.doc_id)."""
    rows = training_rows(docs, labels, usable, cfg)
    lexicon = induced_lexicon(rows, cfg)
    x = materialise(with_features(rows.coalesce(8), lexicon, ["doc_id", "toxic", "part"], cfg), "toxicity-features")
    seen = {(r.part, r.toxic) for r in x.groupBy("part", "toxic").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= cfg.least_rows).collect()}
    if not {("trees", 0), ("trees", 1)} <= seen:
        return ToxicityModel(lexicon, None, None, cfg)
    ready = x.withColumn("label", F.col("toxic").cast("double")).coalesce(2)
    gbt = GBTClassifier(labelCol="label", featuresCol="features", maxIter=cfg.trees, maxDepth=cfg.depth, stepSize=cfg.step, maxBins=64, seed=7)
    model = ToxicityModel(lexicon, gbt.fit(ready.where("part = 'trees'").select("label", array_to_vector("features").alias("features"))), None, cfg)
    if {y for part, y in seen if part == "calibration"} == {0, 1}:
        iso = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="calibrated")
        model.calibration = iso.fit(model._margin(ready.where("part = 'calibration'")).select("label", "margin"))
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig(), folds: int = 3, held_out: int = 1) -> DataFrame:
    """Fit on labels outside the held-out fold, score all: doc_id, held_out, score, predicted."""
    out = F.coalesce(id_fold("doc_id", folds) == held_out, F.lit(False))
    model = fit_toxicity(docs, labels, ~out, cfg)
    return model.score(docs, ["doc_id"]).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= cfg.threshold).cast("int").alias("predicted"))
