"""BPE encoding with content-defined chunk reuse, and exact decoding.

A rolling polynomial hash over the last characters chooses cut points, so that passages shared by
documents give the same chunks wherever they stand. A worker encodes each distinct chunk once and
keeps it in a bounded cache that outlives the task; copies, near copies and shared passages are
looked up. A chunk may cut a word. At such a join the cut pieces of both sides and one more piece on
either side are encoded again by the library: where the new ids begin and end with the ids that the
chunks had for those outer pieces, both encodings agree and the ids between replace the join. If they
don't agree, the window grows to the whole text, which is then encoded by the library alone.

Nothing is shuffled: chunks are shared within a worker, not between workers (shuffling the text of
chunks and their ids would cost more than twice the input), so a passage is encoded once a worker.

Defined cases: null and empty texts have no tokens and hash the empty string; texts of any length
are encoded whole; repeated rows are encoded each; a special token's string inside a text becomes
that token, as in the library; a doc_id of any type is returned as a long (null where it isn't one);
extra columns are ignored; an empty table gives no rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamframe.llm.common import small_batches
from beamframe.llm.word_bpe import _ODD, _SPACE, default_vocab, unreachable_tokens, word_cache


@dataclass(frozen=True)
class ChunkConfig:
    window: int = 32  # characters in the rolling hash, a power of two
    mask_bits: int = 10  # about 1,024 characters a chunk
    min_chars: int = 256
    max_chars: int = 8192
    cache_chars: int = 24_000_000


def cut_points(text: str, cfg: ChunkConfig = ChunkConfig()) -> list[int]:
    """Ends of the chunks of a text; the last is its length."""
    n = len(text)
    if n <= cfg.min_chars:
        return [n] if n else []
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") * np.uint32(2654435761)
    h ^= h >> np.uint32(15)
    m, span = 2246822519, 1
    while span < cfg.window:  # hash of 2k characters from two hashes of k
        nxt = h.copy()
        nxt[span:] += h[:-span] * np.uint32(m)
        h, m, span = nxt, (m * m) & 0xFFFFFFFF, span * 2
    hits = np.flatnonzero((h >> np.uint32(32 - cfg.mask_bits)) == 0) + 1
    ends, last = [], 0
    for p in hits.tolist():
        if p - last < cfg.min_chars:
            continue
        while p - last > cfg.max_chars:
            last += cfg.max_chars
            ends.append(last)
        if p - last >= cfg.min_chars and p < n:
            ends.append(p)
            last = p
    while n - last > cfg.max_chars:
        last += cfg.max_chars
        ends.append(last)
    ends.append(n)
    return ends


@dataclass(frozen=True)
class Chunk:
    """A chunk's pieces: those open at its ends, and between them whole ones with their ids."""

    head: str  # text before the first white space; the whole chunk where it has none
    ids: bytes  # of the whole pieces
    first: str  # whole piece
    last: str
    tail: str  # text after the last white space
    one: bool  # no white space in it


class ChunkEncoder:
    """Encodes texts by cached chunks and repaired joins."""

    def __init__(self, path: str, cfg: ChunkConfig = ChunkConfig()):
        self.words, self.cfg = word_cache(path), cfg
        self.chunks: dict[str, Chunk] = {}
        self.held = 0
        self.encoded = self.reused = self.widened = 0

    def _chunk(self, text: str) -> Chunk:
        if text in self.chunks:
            self.reused += 1
            return self.chunks[text]
        self.encoded += 1
        first = _SPACE.search(text)
        if first is None:
            out = Chunk(text, b"", "", "", "", True)
        else:
            pieces = text.split() if not _ODD.search(text) else [p for p in _SPACE.split(text) if p]
            head = text[: first.start()]
            tail = pieces[-1] if pieces and not _SPACE.match(text[-1]) else ""
            inner = pieces[bool(head) : len(pieces) - bool(tail)]
            out = Chunk(head, b"".join(map(self.words.__getitem__, inner)), inner[0] if inner else "", inner[-1] if inner else "", tail, False)
        self.held += len(text)
        if self.held > self.cfg.cache_chars:
            self.chunks.clear()
            self.held = len(text)
        self.chunks[text] = out
        return out

    def _repaired(self, before: str, joint: str, after: str) -> bytes | None:
        """Ids of the joint between two whole pieces (or the text's ends); None without agreement."""
        got = self.words.library(" ".join(p for p in (before, joint, after) if p))
        left, right = (self.words[p] if p else b"" for p in (before, after))
        if len(got) < len(left) + len(right) or not got.startswith(left) or not got.endswith(right):
            return None
        return got[len(left) : len(got) - len(right)]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian uint16, equal to the library's."""
        out: list[bytes] = []
        before, joint, joined, last = "", "", False, 0  # the whole piece before an open one, the open one
        for end in cut_points(text, self.cfg):
            c = self._chunk(text[last:end])
            last = end
            if c.one:
                joined = joined or bool(joint)
                joint += c.head
                continue
            if joint or c.head:
                joined = joined or bool(joint and c.head)
                piece = joint + c.head
                ids = self._repaired(before, piece, c.first) if joined else self.words[piece]
                if ids is None:
                    self.widened += 1
                    return self.words.library(text)
                out.append(ids)
                before = piece
            out.append(c.ids)
            before, joint, joined = c.last or before, c.tail, False
        if joint:
            ids = self._repaired(before, joint, "") if joined else self.words[joint]
            if ids is None:
                self.widened += 1
                return self.words.library(text)
            out.append(ids)
        return b"".join(out)


@lru_cache(maxsize=2)
def chunk_encoder(path: str, cfg: ChunkConfig) -> ChunkEncoder:
    return ChunkEncoder(path, cfg)


@lru_cache(maxsize=2)
def check_vocab(path: str) -> None:
    if bad := unreachable_tokens(path):
        raise ValueError(f"{len(bad)} tokens, such as {bad[0]!r}, are not made by the merges; this vocabulary needs the library's own encoder")


def encode_texts(docs: DataFrame, vocab: str | None = None, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids array<int>, decoded string: the operator's own outputs."""
    path = vocab or default_vocab()
    check_vocab(path)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = chunk_encoder(path, cfg)
        names = enc.words.tokens()
        for b in batches:
            ids = [np.frombuffer(enc.encode(t or ""), "<u2") for t in b.column(1).to_pylist()]
            text = [" ".join(map(names.__getitem__, i.tolist())) for i in ids]
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(text, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, vocab: str | None = None, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256, n_chunks.

    The digests are taken beside the encoder, so ids and decoded texts never leave the worker."""
    path = vocab or default_vocab()
    check_vocab(path)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = chunk_encoder(path, cfg)
        names, digits = enc.words.tokens(), [str(i) for i in range(enc.words.n_vocab)]
        sha = hashlib.sha256
        for b in batches:
            n, a, d, c = [], [], [], []
            for t in b.column(1):
                t = t.as_py() or ""
                before = enc.encoded + enc.reused
                ids = np.frombuffer(enc.encode(t), "<u2").tolist()
                n.append(len(ids))
                a.append(sha(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                d.append(sha(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                c.append(enc.encoded + enc.reused - before)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string()), pa.array(c, pa.int64())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chunks"])

    return docs.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_chunks bigint")
