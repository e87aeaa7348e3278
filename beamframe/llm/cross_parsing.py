"""Language identification by cross-parsing entropy.

Each language's training text becomes a suffix automaton. A text is parsed greedily against every
automaton: a phrase is the longest match that starts where the last one ended, and a letter the
automaton can't continue with starts the next phrase. The fewer phrases a text needs per letter,
the better that language predicts it; phrases * log2(training length) / letters estimates the
cross entropy in bits per letter.

Languages have training texts of their own lengths and are compared by the length of a code: a phrase
costs log2(own training length), its place, and log2(letters of the alphabet), the letter that ends it.
The language with the shortest code wins. The place alone would make a tiny sample cheap: with 12
letters a phrase costs 3.6 bits, and one or two letters a phrase then beat a well-trained language on
its own text.

Fitting reads a bounded sample of labelled rows (`LangConfig`): at most `sample_docs` rows of a
language, chosen by a hash of id and text, whole, so that an id with many texts counts as many rows. A
row of more than `long_chars` characters is chosen only where its share of the hashes holds no other,
and one of more than `most_chars` never. Rows are taken in a fixed order while all of a language have no
more than its part of `sample_chars` characters, but one at least. A language whose sample has no letter
gets no automaton and is never predicted. There may be at most `max_langs` labels. So rows, characters
and languages that reach the driver are bounded whatever the table holds.

Every language's automaton is built once, by a task of its own, and comes back as arrays; those of all
languages are sent to each Python worker together. Transitions are kept sparse (rows laid over one
another), so that alphabets of thousands of letters take no more room than the automata have edges: about
30 bytes a letter of the sample.

Prediction reads whole texts and shuffles nothing. Texts are cut into blocks that advance through the
automata together, one letter a step; every block but a text's first starts where the block before it
ended, not with a new phrase: blocks are first parsed from a fresh start, then from the true one until
both parses meet, and the difference is corrected, as often as an end still changes.

Defined cases: a null text, an empty one and one without a letter are `und` with score 0; with no
labelled text that has a letter every text is `und`; a text of letters that no language has counts one
phrase a letter everywhere; ties go to the alphabetically first language with score 0; rejected are
`und` and texts whose best code, but for one phrase, is `worst` times as long as coding each letter by
itself (so no trained language tells anything about them, as with texts in another script); repeated rows are predicted each; texts of any
length are read whole; extra columns are ignored; an empty table gives no rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from beamframe.llm.common import id_fold, small_batches

UND = "und"
PAD, SPACE, OTHER = 0, 1, 2  # letter classes: after the end, between words, in no training text


@dataclass(frozen=True)
class LangConfig:
    sample_docs: int = 24  # labelled rows per language, whole
    long_chars: int = 8192  # longer ones are chosen only where a slot holds no other
    most_chars: int = 1 << 20  # longer rows are not learned from
    sample_chars: int = 4 << 20  # of all languages together, each an equal part
    max_langs: int = 1000  # labels
    worst: float = 2.0  # times as long as coding letters one by one: such texts are rejected
    block: int = 1024  # letters of a text that advance as one row
    rows: int = 2048  # rows that advance together


def training_sample(docs: DataFrame, labelled: Column, cfg: LangConfig = LangConfig()) -> list[tuple[str, str]]:
    """(lang, text) pairs of the bounded sample, in a fixed order.

    Only keys go through the shuffle (a grouped minimum, combined before it); at most sample_docs *
    max_langs of them are chosen and broadcast to fetch their texts."""
    rows = docs.where(labelled).select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.where(F.length("text") <= cfg.most_chars).withColumn("key", F.xxhash64("doc_id", "text"))
    least = F.min(F.struct((F.length("text") > cfg.long_chars).alias("last"), F.xxhash64("key", F.lit(17)).alias("h"), "key", F.length("text").alias("size"))).alias("m")
    slots = rows.groupBy("lang", F.pmod(F.xxhash64("key", F.lit(5)), F.lit(cfg.sample_docs))).agg(least).select("lang", "m.*")
    chosen = slots.limit(cfg.sample_docs * cfg.max_langs + 1).collect()
    if len(chosen) > cfg.sample_docs * cfg.max_langs:
        raise ValueError(f"more than {cfg.max_langs} labels of languages")
    if not chosen:
        return []
    left = dict.fromkeys({r.lang for r in chosen}, cfg.sample_chars // len({r.lang for r in chosen}))
    taken: dict[tuple[str, int], int] = {}
    for place, r in enumerate(sorted(chosen, key=lambda r: (r.lang, r.last, r.h))):
        if r.size <= left[r.lang] or not any(lang == r.lang for lang, _ in taken):
            taken[r.lang, r.key] = place
            left[r.lang] -= r.size
    told = docs.sparkSession.createDataFrame(list(taken), "lang string, key bigint")
    got = rows.join(F.broadcast(told), ["lang", "key"]).select("lang", "key", "text").distinct().collect()
    return [(r.lang, r.text) for r in sorted(got, key=lambda r: (taken[r.lang, r.key], r.text))]


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-case text."""
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


def suffix_automaton(symbols: list[int]) -> tuple[int, np.ndarray]:
    """Number of states, and the transitions as rows (state, symbol, next state), by state."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    flat = np.fromiter((v for s, t in enumerate(nxt) for c, d in t.items() for v in (s, c, d)), np.int32)
    return len(nxt), flat.reshape(-1, 3)


class RowTable:
    """Sparse transitions: the rows of all states laid over one another so that no two entries meet.
    State s goes by letter c to `target[base[s] + c]` if `owner[base[s] + c]` is s, else nowhere."""

    def __init__(self, states: int, edges: np.ndarray, width: int):
        """edges: rows (state, letter, next state), by state."""
        size = np.bincount(edges[:, 0], minlength=states)
        begin = np.append(0, np.cumsum(size))
        self.base = np.zeros(states, np.int32)
        used = np.zeros(len(edges) + len(edges) // 8 + 4 * width + 64, bool)
        low, span = width, 256  # every base is at least 0; slots below low are left to the single ones
        for s in np.argsort(-size, kind="stable")[: np.count_nonzero(size > 1)].tolist():
            letters = np.sort(edges[begin[s] : begin[s + 1], 1])
            while True:
                if low + span + width >= len(used):
                    used = np.append(used, np.zeros(len(used) // 2 + span + width, bool))
                free = np.flatnonzero(~used[low : low + span]) + low
                ok = free[~used[free[:, None] - letters[0] + letters].any(1)] if len(free) else free
                if len(ok):
                    break
                low += span
            self.base[s] = ok[0] - letters[0]
            used[self.base[s] + letters] = True
        single = np.flatnonzero(size == 1)
        free = np.flatnonzero(~used[width:])[: len(single)] + width
        free = np.append(free, len(used) + np.arange(len(single) - len(free)))
        self.base[single] = free - edges[begin[single], 1]
        room = max(int(self.base.max(initial=0)) + width, len(used)) + 1
        self.owner, self.target = np.full(room, -1, np.int32), np.zeros(room, np.int32)
        at = self.base[edges[:, 0]] + edges[:, 1]
        self.owner[at], self.target[at] = edges[:, 0], edges[:, 2]


@dataclass
class LanguageTable:
    """One language's automaton: states, the transitions, and by letter the state after a phrase's first one."""

    states: int
    base: np.ndarray
    owner: np.ndarray
    target: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, letters: np.ndarray, width: int) -> LanguageTable:
        n, edges = suffix_automaton(letters.tolist())
        # one more state, from which every letter starts a phrase: the first, and after a letter that
        # the language lacks, which is a phrase of its own
        first = np.full(width, n, np.int32)
        root = edges[edges[:, 0] == 0]
        first[root[:, 1]] = root[:, 2]
        table = RowTable(n + 1, edges, width)
        return cls(n + 1, table.base, table.owner, table.target, first)

    def to_row(self) -> tuple[int, bytes, bytes, bytes, bytes]:
        return self.states, self.base.tobytes(), self.owner.tobytes(), self.target.tobytes(), self.first.tobytes()

    @classmethod
    def from_row(cls, states: int, *arrays: bytes) -> LanguageTable:
        return cls(states, *(np.frombuffer(a, np.int32) for a in arrays))


def _here(letters: list[np.ndarray], width: int) -> list[LanguageTable]:
    return [LanguageTable.of(t, width) for t in letters]


def by_tasks(spark: SparkSession) -> Callable[[list[np.ndarray], int], list[LanguageTable]]:
    """Builds the languages' automata in Spark tasks, one each."""

    def build(letters: list[np.ndarray], width: int) -> list[LanguageTable]:
        if not letters:
            return []

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for no, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    made = LanguageTable.of(np.frombuffer(t, np.int32), width).to_row()
                    yield pa.RecordBatch.from_arrays([pa.array([no], pa.int32()), pa.array([made[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in made[1:])], ["no", "states", "base", "owner", "target", "first"])

        rows = spark.createDataFrame([(i, bytearray(t.astype(np.int32).tobytes())) for i, t in enumerate(letters)], "no int, letters binary")
        spread = rows.repartitionByRange(len(letters), "no")
        got = spread.mapInArrow(run, "no int, states bigint, base binary, owner binary, target binary, first binary").collect()
        return [LanguageTable.from_row(*tuple(r)[1:]) for r in sorted(got, key=lambda r: r.no)]

    return build


class CrossParser:
    """Suffix automata of all languages in one sparse table of steps."""

    def __init__(self, sample: list[tuple[str, str]], cfg: LangConfig, build: Callable[[list[np.ndarray], int], list[LanguageTable]] = _here):
        self.cfg = cfg
        texts = {lang: letters_of("\n".join(t for g, t in sample if g == lang)) for lang in sorted({lang for lang, _ in sample})}
        known = np.unique(np.concatenate([np.zeros(0, np.uint32), *texts.values()]))
        known = np.array([c for c in known.tolist() if c < 0x110000 and chr(c).isalpha()], np.int64)
        letter = np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x33480)])
        self.classes = np.where(letter, OTHER, SPACE).astype(np.int32)
        self.classes[known] = np.arange(3, 3 + len(known))
        self.width = 3 + len(known)
        cleaned = {g: self._fold(t)[0] for g, t in texts.items()}
        cleaned = {g: t for g, t in cleaned.items() if len(t)}
        self.langs = list(cleaned)
        self.bits = np.array([math.log2(max(2, len(t))) for t in cleaned.values()])  # of a place
        self.letter_bits = math.log2(max(2, len(known)))
        self.cost = self.bits + self.letter_bits  # of a phrase
        tables = build(list(cleaned.values()), self.width)
        # laid one behind the other: states and places of a language come after those of the ones before
        states = np.cumsum([0, *(t.states for t in tables)], dtype=np.int64)[:-1].astype(np.int32)
        places = np.cumsum([0, *(len(t.owner) for t in tables)], dtype=np.int64)[:-1].astype(np.int32)
        joined = lambda parts: np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32)
        self.base = joined(t.base + p for t, p in zip(tables, places, strict=True))
        self.owner = joined(np.where(t.owner < 0, -1, t.owner + s) for t, s in zip(tables, states, strict=True))
        self.target = joined(t.target + s for t, s in zip(tables, states, strict=True))
        self.first = joined(t.first + s for t, s in zip(tables, states, strict=True))
        self.starts = [int(s) + t.states - 1 for t, s in zip(tables, states, strict=True)]

    def _fold(self, points: np.ndarray) -> tuple[np.ndarray, int]:
        """Classes of letters with single spaces between words; how many are letters."""
        c = self.classes[np.minimum(points, len(self.classes) - 1)]
        space = c == SPACE
        keep = ~space
        keep[1:] |= space[1:] & ~space[:-1]
        c = c[keep]
        if len(c) and c[0] == SPACE:
            c = c[1:]
        if len(c) and c[-1] == SPACE:
            c = c[:-1]
        return c, int(len(points) - space.sum())

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases [text, language] and letters [text]."""
        n, g, size = len(texts), len(self.langs), self.cfg.block
        counts, letters = np.zeros((n, g), np.int64), np.zeros(n, np.int64)
        rows: list[np.ndarray] = []
        owner: list[int] = []
        for i, t in enumerate(texts):
            if not t:
                continue
            c, letters[i] = self._fold(letters_of(t))
            if letters[i] and g:
                rows += [c[a : a + size] for a in range(0, len(c), size)]
                owner += [i] * (-(-len(c) // size))
            if len(rows) >= self.cfg.rows:
                self._parse(rows, owner, counts)
                rows, owner = [], []
        if rows:
            self._parse(rows, owner, counts)
        return counts, letters

    def _step(self, state: np.ndarray, letter: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States [language, row] after a letter each, and where a phrase began."""
        at = self.base[state] + letter
        new = self.owner[at] != state
        return np.where(new, self.first[offset + letter], self.target[at]), new

    def _parse(self, rows: list[np.ndarray], owner: list[int], counts: np.ndarray) -> None:
        """Adds the phrases of whole texts, given as their blocks in order."""
        size = np.array([len(r) for r in rows])
        order = np.argsort(-size, kind="stable")
        grid = np.zeros((int(size.max()), len(rows)), np.int32)
        for k, j in enumerate(order.tolist()):
            grid[: size[j], k] = rows[j]
        size, own = size[order], np.array(owner)[order]
        place = np.empty(len(rows), np.int64)
        place[order] = np.arange(len(rows))
        alive = np.searchsorted(-size, -np.arange(len(grid)), side="left")  # rows longer than each step
        offset = (np.arange(len(self.starts), dtype=np.int32) * self.width)[:, None]
        fresh = np.repeat(np.array(self.starts, np.int32)[:, None], len(rows), 1)
        state, begun = fresh.copy(), np.zeros(fresh.shape, np.int64)
        for k, m in enumerate(alive.tolist()):
            state[:, :m], new = self._step(state[:, :m], grid[k, :m], offset)
            begun[:, :m] += new
        # blocks after a text's first start from the end of the block before
        later = np.flatnonzero(np.append(False, np.diff(owner) == 0))
        begin = fresh
        while len(later):
            before = state[:, place[later - 1]]
            now = place[later]
            g, c = np.nonzero(before != begin[:, now])
            if not len(g):
                break
            # (language, block) pairs whose start was wrong: both parses side by side until they meet
            col, at = now[c], g * self.width
            true, was = before[g, c], begin[g, col]
            begin = begin.copy() if begin is fresh else begin
            begin[g, col] = true
            lang = g
            for k in range(len(grid)):
                live = np.flatnonzero((size[col] > k) & (true != was))
                ended = np.flatnonzero((size[col] <= k) & (true != was))
                state[lang[ended], col[ended]] = true[ended]
                lang, col, at = lang[live], col[live], at[live]
                if not len(live):
                    break
                letter = grid[k, col]
                true, new = self._step(true[live], letter, at)
                was, old = self._step(was[live], letter, at)
                np.add.at(begun, (lang, col), new.astype(np.int64) - old)
            else:
                apart = np.flatnonzero(true != was)
                state[lang[apart], col[apart]] = true[apart]
        np.add.at(counts, own, begun.T)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, bits per letter of each text, and whether it is rejected. The score is the
        share of its code that the best language saves against the second."""
        counts, letters = self.phrases(texts)
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
        code = counts * self.cost
        best = code.argmin(1)
        low = code.min(1)
        second = np.partition(code, 1, axis=1)[:, 1] if len(self.langs) > 1 else np.maximum(letters * self.cost[0], low)
        score = np.where(letters > 0, 1 - low / np.where(second > 0, second, 1), 0.0)
        bits = np.where(letters > 0, counts[np.arange(len(texts)), best] * self.bits[best] / np.maximum(letters, 1), 0.0)
        rejected = (letters == 0) | (low - self.cost[best] >= self.cfg.worst * letters * self.letter_bits)
        return [self.langs[b] if n else UND for b, n in zip(best.tolist(), letters.tolist(), strict=True)], score, bits, rejected


def predict_languages(docs: DataFrame, sample: list[tuple[str, str]], cfg: LangConfig = LangConfig(), keep: list[str] | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id (or the columns `keep`), lang_pred, score, bits_per_letter, rejected."""
    small_batches(docs.sparkSession)
    carried = keep or ["doc_id"]
    cols = list(dict.fromkeys([*carried, "text"]))
    # bounded by sample_chars
    told = docs.sparkSession.sparkContext.broadcast(CrossParser(sample, cfg, by_tasks(docs.sparkSession)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = told.value
        for b in batches:
            langs, score, bits, rejected = parser.predict(b.column(cols.index("text")).to_pylist())
            out = [pa.array(langs, pa.string()), pa.array(score), pa.array(bits), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays([*(b.column(cols.index(c)) for c in carried), *out], [*carried, "lang_pred", "score", "bits_per_letter", "rejected"])

    schema = StructType([docs.schema[c] for c in carried])
    return docs.select(*cols).mapInArrow(run, schema.add("lang_pred", "string").add("score", "double").add("bits_per_letter", "double").add("rejected", "boolean"))


def identify_languages(docs: DataFrame, cfg: LangConfig = LangConfig(), folds: int = 5) -> DataFrame:
    """Fit on documents outside fold 0, predict all: doc_id, held_out, lang_pred, score, bits_per_letter, rejected."""
    sample = training_sample(docs, id_fold("doc_id", folds) != 0, cfg)
    out = predict_languages(docs, sample, cfg)
    return out.select("doc_id", F.coalesce(id_fold("doc_id", folds) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_letter", "rejected")
