"""Order-preserving packing of token streams by dynamic programming.

Each input partition is one stream of documents in its own order, each followed by the end id.
Cuts may fall at document ends (free), sentence ends (a small penalty) or, where a sentence is
longer than a sequence, inside it (a larger one). A sequence shorter than the limit is padded to it,
unless its length is a power of two. The program minimises padding plus penalties:

    f[j] = penalty[j] + min( limit - b[j] + min_{b[j]-b[i] <= limit} (f[i] + b[i]),
                             min_{b[j]-b[i] a power of two} f[i] ) + sequence cost

The inner minimum runs over a sliding window and is kept in a monotone queue, so the work is linear
in the number of possible cuts. A stream is solved in windows of bounded size: all sequences of a
window but the last few are final, the rest goes into the next window. Nothing is shuffled.

Defined cases: a null text counts as empty and is just the end id; a text longer than a sequence
is cut; repeated rows are packed each; a doc_id of any type is returned as a long (null where it isn't
one); extra columns are ignored; an empty table gives no rows."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamframe.llm.chunked_bpe import check_vocab
from beamframe.llm.common import small_batches
from beamframe.llm.word_bpe import END, default_vocab, word_cache

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


@dataclass(frozen=True)
class PackConfig:
    limit: int = 4096
    eos: int = 2
    sentence_penalty: int = 8
    inside_penalty: int = 64
    sequence_cost: int = 1
    least_power: int = 256  # shortest unpadded sequence inside a stream
    window: int = 1 << 20  # tokens solved at once
    keep_back: int = 8  # last sequences of a window, solved again with the next


def choose_cuts(cuts: np.ndarray, penalty: np.ndarray, cfg: PackConfig) -> tuple[list[int], int]:
    """cuts: increasing positions, the first is the start (0). Returns the chosen positions after
    the start, the last position among them, and the total cost."""
    L, m = cfg.limit, len(cuts)
    b, pen = cuts.tolist(), penalty.tolist()
    powers: dict[int, list[int]] = {}
    p = cfg.least_power
    while p < L:
        want = cuts - p
        at = np.searchsorted(cuts, want)
        hit = np.flatnonzero((want >= 0) & (cuts[np.minimum(at, m - 1)] == want))
        for j, i in zip(hit.tolist(), at[hit].tolist(), strict=True):
            powers.setdefault(j, []).append(i)
        p *= 2
    f, back = [0] * m, [0] * m
    queue: deque[tuple[int, int]] = deque([(b[0], 0)])
    for j in range(1, m):
        low = b[j] - L
        while b[queue[0][1]] < low:
            queue.popleft()
        g, i = queue[0]
        best = g + L - b[j]
        if j in powers:
            for k in powers[j]:
                if f[k] < best:
                    best, i = f[k], k
        best += pen[j] + cfg.sequence_cost
        f[j], back[j] = best, i
        g = best + b[j]
        while queue and queue[-1][0] >= g:
            queue.pop()
        queue.append((g, j))
    out, j = [], m - 1
    while j:
        out.append(b[j])
        j = back[j]
    return out[::-1], f[-1]


def possible_cuts(doc_ends: np.ndarray, sentence_ends: np.ndarray, total: int, cfg: PackConfig) -> tuple[np.ndarray, np.ndarray]:
    """Positions and penalties, with cuts added wherever two neighbours lie too far apart."""
    cuts = np.unique(np.concatenate([[0], doc_ends, sentence_ends, [total]])).astype(np.int64)
    gaps = np.diff(cuts)
    if (wide := np.flatnonzero(gaps > cfg.limit)).size:
        extra = [np.arange(cuts[i] + cfg.limit, cuts[i + 1], cfg.limit) for i in wide]
        cuts = np.unique(np.concatenate([cuts, *extra]))
    free = np.zeros(len(cuts), bool)
    free[np.searchsorted(cuts, doc_ends)] = True
    said = np.zeros(len(cuts), bool)
    said[np.searchsorted(cuts, sentence_ends)] = True
    pen = np.where(free, 0, np.where(said, cfg.sentence_penalty, cfg.inside_penalty))
    pen[0] = 0
    return cuts, pen


def unpadded_tail(start: int, end: int, cfg: PackConfig) -> list[int]:
    """Cuts of a last sequence into powers of two, if their penalties cost less than its padding."""
    n = end - start
    parts = [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]
    if len(parts) < 2 or (len(parts) - 1) * (cfg.inside_penalty + cfg.sequence_cost) >= cfg.limit - n:
        return [end]
    return (start + np.cumsum(parts)).tolist()


class StreamPacker:
    """Packs a stream of (key, ids) documents; ids are uint16 arrays with the end id."""

    def __init__(self, is_end: np.ndarray, cfg: PackConfig):
        self.is_end, self.cfg = is_end, cfg
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple[object, int, int]] = []  # key, ids of the document before the buffer, all its ids
        self.size = 0
        self.n_sequences = 0

    def add(self, key, ids: np.ndarray) -> Iterator[tuple]:
        self.ids.append(ids)
        self.docs.append((key, 0, len(ids)))
        self.size += len(ids)
        if self.size >= self.cfg.window:
            yield from self._solve(False)

    def finish(self) -> Iterator[tuple]:
        if self.size:
            yield from self._solve(True)

    def _solve(self, last: bool) -> Iterator[tuple]:
        cfg = self.cfg
        flat = np.concatenate(self.ids)
        sizes = np.array([n - s for _, s, n in self.docs])
        ends = np.cumsum(sizes)
        begins = ends - sizes
        cuts, pen = possible_cuts(ends, np.flatnonzero(self.is_end[flat]) + 1, len(flat), cfg)
        chosen, _ = choose_cuts(cuts, pen, cfg)
        if last:
            tail_from = chosen[-2] if len(chosen) > 1 else 0
            chosen[-1:] = unpadded_tail(tail_from, chosen[-1], cfg)
        elif len(chosen) > cfg.keep_back:
            chosen = chosen[: -cfg.keep_back]
        bounds = np.array([0, *chosen])
        stop = int(bounds[-1])
        marks = np.unique(np.concatenate([bounds, ends[ends <= stop]]))
        doc = np.searchsorted(ends, marks[:-1], side="right")
        seq = np.searchsorted(bounds, marks[:-1], side="right") - 1
        wide = flat.astype("<u4")
        for a, z, d, s in zip(marks[:-1].tolist(), marks[1:].tolist(), doc.tolist(), seq.tolist(), strict=True):
            key, before, total = self.docs[d]
            yield key, before + a - int(begins[d]), z - a, zlib.crc32(wide[a:z]), total, self.n_sequences + s, a - int(bounds[s])
        self.n_sequences += len(chosen)
        d = int(np.searchsorted(ends, stop, side="right"))
        rest = [(k, s, n) for k, s, n in self.docs[d:]]
        if rest and stop > begins[d]:
            k, s, n = rest[0]
            rest[0] = (k, s + stop - int(begins[d]), n)
        self.docs, self.ids, self.size = rest, [flat[stop:]], len(flat) - stop


def sentence_end_ids(names: list[str]) -> np.ndarray:
    """Whether an id ends a sentence: a word-end token of marks with . ! or ? among them."""
    return np.array([t.endswith(END) and any(c in ".!?" for c in t[: -len(END)]) and not any(c.isalnum() for c in t[: -len(END)]) for t in names])


def pack_documents(docs: DataFrame, vocab: str | None = None, cfg: PackConfig = PackConfig()) -> DataFrame:
    """docs(doc_id, text) -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    sequence_id holds the stream (input partition) in its upper bits."""
    path = vocab or default_vocab()
    check_vocab(path)
    small_batches(docs.sparkSession)
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_cache(path)
        packer = StreamPacker(sentence_end_ids(words.tokens()), cfg)
        stream = TaskContext.get().partitionId() << 33
        eos = np.array([cfg.eos], "<u2").tobytes()

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            cols[5] = pa.array([stream | s for s in cols[5].to_pylist()], pa.int64())
            return pa.RecordBatch.from_arrays(cols, names)

        rows: list[tuple] = []
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows.extend(packer.add(key, np.frombuffer(words.encode(text.as_py() or "") + eos, "<u2")))
            if len(rows) >= 20_000:
                yield batch(rows)
                rows = []
        rows.extend(packer.finish())
        if rows:
            yield batch(rows)

    return docs.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
