"""Phrase collocations of each language, by contiguous pattern growth.

Texts are lower-cased (A-Z) and split into pieces at punctuation and line ends, pieces into words at
spaces and tabs. A phrase is frequent if it occurs at least `least` times in a language, overlaps
included; a phrase can only be frequent if every shorter phrase inside it is.

Growth follows PrefixSpan, kept to contiguous patterns:

1. Frequent words, then frequent pairs, are counted over all texts: every task counts inside blocks of
   text, and what blocks count is summed by phrase.
2. Every frequent pair is a prefix, and its projection is what follows its occurrences: a pointer into
   the text, kept as the words up to the longest phrase, cut where the chain of frequent pairs ends.
   Equal pointers of a block are one row with a count, and equal ones of all blocks are summed, by
   the whole words, before any prefix is gathered.
3. A prefix is grown by one task: its projection arrives sorted, and a depth-first walk extends the
   prefix to the right, word by word, and gives back what is frequent. A pair's projection is dealt
   out by its next word, so that the commonest pair isn't one task; the walk holds one count a level.

A sieve of `sieve_bits` bits, filled from the frequent words (then pairs), lets the blocks skip most of
what can't be frequent. It has a fixed size, and it only ever lets too much through: counts stay exact
when it is full. It is the only thing that is broadcast.

Then each candidate (frequent, two words or more) is cut after each of its words, both parts look up
their counts, and the lowest of floor(scale * a / (l + r)) is its score, in decimals of 38 digits. A
candidate goes if a longer one that holds it occurs `inside` percent as often or more. The best `top`
of each language are ranked among the best of each share of its phrases, so that no language is
ranked by one task alone.

Defined cases: null texts are empty, a null language is `und` (together with a language of that name);
texts without a word add nothing; a text longer than a block is cut between pieces, and a piece longer
than a block between words, with the next words at hand to finish its phrases; repeated rows count
each; other columns are ignored; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beamframe.llm.common import materialise, small_batches

_LOWER = bytes(b"\n"[0] if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_OWN = b"\r"  # no text holds it after translation: in front of it stand the words that a block counts
COUNTS = "lang string, phrase string, n bigint"
_ARROW = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


@dataclass(frozen=True)
class PhraseConfig:
    least: int = 30
    longest: int = 4
    inside: int = 80
    top: int = 2000
    scale: int = 2_000_000
    block_bytes: int = 3 << 20
    sieve_bits: int = 25


# --- blocks of text -------------------------------------------------------------------------------


def _cut(data: bytes, cfg: PhraseConfig) -> Iterator[bytes]:
    """Parts of one translated text that are at most about a block long."""
    at, size = 0, cfg.block_bytes
    while len(data) - at > size:
        end = data.rfind(b"\n", at, at + size)
        if end > at:
            yield data[at:end]
            at = end
            continue
        end = data.rfind(b" ", at, at + size)
        if end <= at:
            ends = [e for e in (data.find(b" ", at + size), data.find(b"\n", at + size)) if e >= 0]
            if not ends:
                break
            end = min(ends)
        # the words that may finish a phrase begun before the cut
        stop = end
        for _ in range(cfg.longest - 1):
            while data[stop : stop + 1] == b" ":
                stop += 1
            ends = [e for e in (data.find(b" ", stop), data.find(b"\n", stop)) if e >= 0]
            stop = min(ends, default=len(data))
        yield data[at:end] + b" " + _OWN + b" " + data[end:stop]
        at = end
    yield data[at:]


def _blocks(batches: Iterator[pa.RecordBatch], cfg: PhraseConfig) -> Iterator[tuple[str, bytes]]:
    """(language, translated text) of about a block each."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = text.encode().translate(_LOWER)
            for part in [data] if len(data) <= cfg.block_bytes else _cut(data, cfg):
                if _OWN in part:
                    yield lang, part
                    continue
                held.setdefault(lang, []).append(part)
                sizes[lang] = sizes.get(lang, 0) + len(part) + 1
                while sizes and (sizes[lang] >= cfg.block_bytes or sum(sizes.values()) >= 4 * cfg.block_bytes):
                    most = max(sizes, key=sizes.__getitem__)
                    yield most, b"\n".join(held.pop(most))
                    del sizes[most]
                    if most == lang:
                        break
    for lang, parts in held.items():
        yield lang, b"\n".join(parts)


def _numbered(data: bytes) -> tuple[np.ndarray, pa.Array, int]:
    """Word numbers in reading order (-1 between pieces), the words, and how many of the numbers are counted."""
    spaced = pa.array([data.replace(b"\n", b" \n ")], pa.large_binary())
    coded = pc.split_pattern(spaced, b" ").flatten().dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = coded.dictionary
    place = {w: i for i, w in enumerate(words.to_pylist()) if w in (b"", b"\n", _OWN)}
    if b"" in place:
        ids = ids[ids != place[b""]]
    own = len(ids)
    if _OWN in place:
        own = int(np.flatnonzero(ids == place[_OWN])[0])
        ids = np.delete(ids, own)
    if b"\n" in place:
        ids[ids == place[b"\n"]] = -1
    return ids, words, own


def _hashes(lang: str, words: pa.Array) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.to_pylist()), np.uint64, len(words))


def _join_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * np.uint64(0x9E3779B97F4A7C15)) ^ ((b << np.uint64(29)) | (b >> np.uint64(35)))


def _passes(sieve: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    at = h & np.uint64((1 << bits) - 1)
    return (sieve[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _counted(lang: str, words: pa.Array, columns: list[np.ndarray], n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of phrases, given by the numbers of their words, column by column."""
    step = 1 << 16
    for i in range(0, len(n), step):
        parts = [words.take(pa.array(c[i : i + step])) for c in columns]
        joined = parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", words.type))
        m = len(joined)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * m, pa.string()), joined.cast(pa.large_string()).cast(pa.string()), pa.array(n[i : i + m], pa.int64())], schema=_ARROW)


def _count_words(batches: Iterator[pa.RecordBatch], cfg: PhraseConfig) -> Iterator[pa.RecordBatch]:
    """Words of every block, and an empty phrase with the number of all its words."""
    for lang, data in _blocks(batches, cfg):
        ids, words, own = _numbered(data)
        ids = ids[:own]
        n = np.bincount(ids[ids >= 0], minlength=len(words))
        found = np.flatnonzero(n)
        yield from _counted(lang, words, [found], n[found])
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([""]), pa.array([int(n.sum())])], schema=_ARROW)


def _pairs(ids: np.ndarray, words: pa.Array, hashes: np.ndarray, sieve: np.ndarray, cfg: PhraseConfig) -> np.ndarray:
    """Where a pair of words starts that stand in one piece and both pass the sieve."""
    good = _passes(sieve, hashes, cfg.sieve_bits)
    ok = np.zeros(len(ids), bool)
    if len(words):
        ok = (ids >= 0) & good[np.maximum(ids, 0)]
    ok[:-1] &= ok[1:]
    ok[-1:] = False
    return ok


def _count_pairs(batches: Iterator[pa.RecordBatch], sieve: np.ndarray, cfg: PhraseConfig) -> Iterator[pa.RecordBatch]:
    for lang, data in _blocks(batches, cfg):
        ids, words, own = _numbered(data)
        at = np.flatnonzero(_pairs(ids, words, _hashes(lang, words), sieve, cfg)[:own])
        keys, n = np.unique(ids[at] * len(words) + ids[at + 1], return_counts=True)
        yield from _counted(lang, words, [keys // max(1, len(words)), keys % max(1, len(words))], n)


def _project(batches: Iterator[pa.RecordBatch], sieve: np.ndarray, cfg: PhraseConfig) -> Iterator[pa.RecordBatch]:
    """For every occurrence of a pair that passes the sieve: the words from there on, as far as its pairs
    pass, three at least and `longest` at most; equal ones of a block with their count."""
    for lang, data in _blocks(batches, cfg):
        ids, words, own = _numbered(data)
        hashes = _hashes(lang, words)
        v = max(1, len(words))
        inside = np.zeros(len(ids), bool)
        at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        keys, where = np.unique(ids[at] * v + ids[at + 1], return_inverse=True)
        inside[at] = _passes(sieve, _join_hashes(hashes[keys // v], hashes[keys % v]), cfg.sieve_bits)[where] if len(keys) else False
        length = np.ones(len(ids), np.int64)
        chain = inside
        for _ in range(cfg.longest - 1):
            length += chain
            chain = chain & np.append(chain[1:], False)
            # chain now says whether one pair more follows
        length = length[:own]
        for m in range(3, cfg.longest + 1):
            at = np.flatnonzero(length == m)
            key = ids[at]
            for j in range(1, m):
                key = np.unique(key * v + ids[at + j], return_inverse=True)[1].astype(np.int64)
            _, first, n = np.unique(key, return_index=True, return_counts=True)
            yield from _counted(lang, words, [ids[at[first] + j] for j in range(m)], n)


# --- growth ---------------------------------------------------------------------------------------


def _grow(batches: Iterator[pa.RecordBatch], cfg: PhraseConfig) -> Iterator[pa.RecordBatch]:
    """Projections (lang, words, n) in the order of their words -> frequent phrases of three words or more,
    by a depth-first walk: a phrase is counted when its last continuation has passed."""
    open_: list[str] = []  # the prefix that is being grown
    counts: list[int] = []  # occurrences of its first 1, 2, ... words
    lang = None
    found: list[tuple[str, str, int]] = []

    def close(depth: int) -> None:
        while len(open_) > depth:
            n = counts.pop()
            if len(open_) >= 3 and n >= cfg.least:
                found.append((lang, " ".join(open_), n))
            open_.pop()

    for batch in batches:
        for name, words, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            same = 0
            if name == lang:
                while same < len(open_) and same < len(words) and open_[same] == words[same]:
                    same += 1
            close(same)
            lang = name
            for j in range(same):
                counts[j] += n
            for w in words[same:]:
                open_.append(w)
                counts.append(n)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
            found.clear()
    close(0)
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def _bits(batches: Iterator[pa.RecordBatch], cfg: PhraseConfig) -> Iterator[pa.RecordBatch]:
    """(slot, bits) of the sieve for phrases of one or two words."""
    for batch in batches:
        slots: dict[int, int] = {}
        by_lang: dict[str, list[list[bytes]]] = {}
        for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(phrase.encode().split(b" "))
        for lang, phrases in by_lang.items():
            columns = [_hashes(lang, pa.array(c, pa.large_binary())) for c in zip(*phrases, strict=True)]
            at = (columns[0] if len(columns) == 1 else _join_hashes(*columns)) & np.uint64((1 << cfg.sieve_bits) - 1)
            for slot, bit in zip((at >> np.uint64(6)).tolist(), (at & np.uint64(63)).tolist(), strict=True):
                slots[slot] = slots.get(slot, 0) | 1 << bit
        values = np.array(list(slots.values()), np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(slots), pa.int64()), pa.array(values, pa.int64())], names=["slot", "bits"])


def _sieve(frequent: DataFrame, cfg: PhraseConfig):
    """The frequent phrases' bits, broadcast: 2^sieve_bits of them, whatever the input."""
    bits = frequent.select("lang", "phrase").mapInArrow(lambda it: _bits(it, cfg), "slot bigint, bits bigint")
    out = np.zeros(1 << max(0, cfg.sieve_bits - 6), np.int64)
    met = bits.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most a row a slot
    out[met.column("slot").to_numpy()] = met.column("bits").to_numpy()
    return frequent.sparkSession.sparkContext.broadcast(out.view(np.uint64))


def frequent_phrases(docs: DataFrame, cfg: PhraseConfig = PhraseConfig()) -> DataFrame:
    """docs(text, lang) -> lang, phrase, n: all frequent phrases of one to `longest` words, and for every
    language the empty phrase with the number of all its words."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.where("text IS NOT NULL").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")

    def summed(counted: DataFrame) -> DataFrame:
        return counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))

    enough = (F.col("n") >= cfg.least) | (F.col("phrase") == "")
    words = materialise(summed(texts.mapInArrow(lambda it: _count_words(it, cfg), COUNTS)).where(enough), "phrase-words")
    sieve = _sieve(words.where("phrase <> ''"), cfg)
    pairs = materialise(summed(texts.mapInArrow(lambda it: _count_pairs(it, sieve.value, cfg), COUNTS)).where(enough), "phrase-pairs")
    sieve2 = _sieve(pairs, cfg)
    projected = summed(texts.mapInArrow(lambda it: _project(it, sieve2.value, cfg), COUNTS)).select("lang", F.split("phrase", " ").alias("words"), "n")
    dealt = projected.repartition("lang", F.slice("words", 1, 3)).sortWithinPartitions("lang", "words")
    grown = materialise(dealt.mapInArrow(lambda it: _grow(it, cfg), COUNTS), "phrase-grown")
    sieve.unpersist()
    sieve2.unpersist()
    return words.unionByName(pairs).unionByName(grown)


# --- scores ---------------------------------------------------------------------------------------


def collocations(docs: DataFrame, cfg: PhraseConfig = PhraseConfig()) -> DataFrame:
    """docs(text, lang) -> lang, rank, phrase, a, l, r, n, score: the best `top` phrases of each language."""
    known = frequent_phrases(docs, cfg)
    totals = known.where("phrase = ''").select(F.col("lang").alias("t_lang"), F.col("n").alias("total"))
    known = known.where("phrase <> ''")
    words = known.select("lang", "phrase", F.split("phrase", " ").alias("w"), F.col("n").alias("a")).where(F.size("w") >= 2)
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    # every cut of every candidate looks up its two parts
    cuts = words.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    left = known.select(F.col("lang").alias("l_lang"), F.col("phrase").alias("l_phrase"), F.col("n").alias("l"))
    right = known.select(F.col("lang").alias("r_lang"), F.col("phrase").alias("r_phrase"), F.col("n").alias("r"))
    met = cuts.join(left, (F.col("lang") == F.col("l_lang")) & (F.col("first") == F.col("l_phrase"))).join(right, (F.col("lang") == F.col("r_lang")) & (F.col("rest") == F.col("r_phrase")))
    wide = "CAST({} AS DECIMAL(19, 0))"
    score = F.expr(f"({wide.format('a')} * {cfg.scale}) DIV ({wide.format('l')} + {wide.format('r')})").cast("bigint")
    best = met.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("c")).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min("c").alias("c"))
    # the commonest longer candidate that holds a phrase
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    longer = words.where(F.size("w") >= 3).select(F.col("lang").alias("o_lang"), "a", F.explode(spans).alias("o_phrase")).groupBy("o_lang", "o_phrase").agg(F.max("a").alias("o"))
    kept = best.join(longer, (F.col("lang") == F.col("o_lang")) & (F.col("phrase") == F.col("o_phrase")), "left").where(
        F.expr(f"o IS NULL OR {wide.format('o')} * 100 < {wide.format('a')} * {cfg.inside}")
    )
    order = [F.col("c.score").desc(), F.col("a").desc(), F.col("phrase")]
    shares = F.lit(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    share = F.pmod(F.xxhash64("phrase"), shares)
    some = kept.withColumn("_share", share).withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))).where(F.col("_r") <= cfg.top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= cfg.top)
    return ranked.join(totals, F.col("lang") == F.col("t_lang")).select("lang", "rank", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), F.col("total").alias("n"), F.col("c.score").alias("score"))


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
worded AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
occurrences AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM worded, (VALUES (1), (2), (3), (4)) AS s(m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM occurrences GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND f >= 30),
cuts AS (
  SELECT c.lang, c.m, c.phrase, c.a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a // (l.f + r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, a, unnest(flatten(list_transform(range(2, m), lambda j: list_transform(range(1, m - j + 2), lambda i: array_to_string(w[i:i + j - 1], ' '))))) AS phrase
    FROM candidates WHERE m >= 3)
  GROUP BY lang, phrase),
kept AS (SELECT s.* FROM scored s LEFT JOIN held h USING (lang, phrase) WHERE h.a IS NULL OR 100 * h.a < 80 * s.a)
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, score FROM kept JOIN totals USING (lang)
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
QUALIFY row_number() OVER w <= 2000
"""
