"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Vectors are centred and rotated by several rotations learned so that signs lose little (iterative
quantisation); the signs are the code. Codes are split into substrings, each long enough that its values
outnumber the vectors of a block, and each substring is indexed: rows sorted by its value. A query probes,
in every substring, the values within `flips` bits of its own. By the pigeonhole principle this retrieves
every code within substrings * (flips + 1) - 1 bits (and many beyond). What is retrieved and lies within
a Hamming radius of a short code is ranked by exact distance; nothing that qualifies is left out.

How many substrings are needed depends on the data: nearest neighbours of evenly spread vectors share
few bits, those of clustered ones many. Fitting finds the exact neighbours of a few sampled rows in one
pass over the table, and takes as many substrings as retrieve the share `target` of them, and the radius
that keeps nearly all of those. Where `most_substrings` don't retrieve that share, probes may differ by one
bit more; where that does not either (evenly spread vectors of many dimensions), no index would look at
much less than everything, and all queries go the exact way, block by block. Both samples are bounded (`sample_rows`, `tuning_rows`, chosen by hash);
every vector is indexed.

The vectors are cut into blocks of bounded size by a hash of the id, and the queries into chunks; a
block and a chunk meet in one task, which builds the block's index and returns each query's best of that
block, and these are ranked again. Blocks hold equal shares whatever the vectors are, so a crowd of like
vectors makes no task larger, and a task's result grows with its queries alone. The work grows with
queries times vectors; the index leaves a fitted share of it. Equal vectors are one item with its smallest
ids, so many copies of one vector are one entry.

A query that gets fewer than k items this way is compared with all vectors, block by block: an exact
way for the rest.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no
part; null ids take no part; vectors are neighbours only of vectors of the same length, each length
having an index of its own; rows that share an id are one item, the one with the least vector; ties go to
the smaller id; a query with fewer than k candidates gets them all; extra columns are ignored; an empty
table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beamframe.llm.common import materialise, slot_sample_ids

SCORED = "query bigint, item bigint, score double"
RESULT = "query_id bigint, rank int, vec_id bigint, score double"


@dataclass(frozen=True)
class MihConfig:
    k: int = 10
    flips: int = 2  # bits of a substring that probes may differ by
    sample_rows: int = 2048  # for the rotations
    rounds: int = 12  # of learning a rotation
    tuning_rows: int = 256  # whose exact neighbours tell how many substrings are needed
    target: float = 0.97  # share of the sampled neighbours that probing must retrieve
    keep: float = 0.995  # share of the retrieved sampled neighbours that the radius must keep
    most_substrings: int = 192  # beyond: more flips, then the exact way
    most_flips: int = 3
    bits: int = 16  # of a substring, for tables of 2^bits offsets
    short_bits: int = 256  # of the code that the radius is about
    block_rows: int = 32_768
    chunk_queries: int = 32_768
    together: int = 64  # queries that probe at once


def usable(vector: Column) -> Column:
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(x.isNotNull() & ~bad & F.exists(x, lambda v: v != 0), F.lit(False))


def learn_rotations(sample: np.ndarray, bits: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and rotations side by side [dimension, bits]: each is principal axes times an orthogonal
    matrix that brings the data near to the corners of the cube."""
    mean = sample.mean(0)
    x = sample - mean
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    v = x @ axes
    d, out = v.shape[1], []
    while len(out) * d < bits:
        r = np.linalg.qr(np.random.default_rng(len(out)).normal(size=(d, d)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        out.append(axes @ r)
    return mean, np.concatenate(out, 1)[:, :bits]


@dataclass(frozen=True)
class Codes:
    """A fitted index: rotations, substrings of `bits` bits, the radius of the short code."""

    mean: np.ndarray
    rotations: np.ndarray
    bits: int
    substrings: int
    radius: int
    short_bits: int
    flips: int

    def of(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Substring values [row, substring] and short codes [row, word]."""
        x = (vectors - self.mean) @ self.rotations > 0
        own = x[:, : self.substrings * self.bits].reshape(len(x), self.substrings, self.bits)
        values = own @ (1 << np.arange(self.bits, dtype=np.int64))
        short = np.packbits(x[:, : self.short_bits], axis=1)
        return values, np.ascontiguousarray(short).view("<u8")


def masks(bits: int, flips: int) -> np.ndarray:
    """All values with at most `flips` bits set."""
    return np.array([sum(1 << b for b in c) for n in range(flips + 1) for c in combinations(range(bits), n)], np.int64)


class BlockIndex:
    """The substrings' indexes of one block of vectors: its rows in the order of their values, and where
    each value begins."""

    def __init__(self, codes: Codes, ids: np.ndarray, vectors: np.ndarray):
        self.codes, self.ids, self.vectors, self.near = codes, ids, vectors, masks(codes.bits, codes.flips)
        values, self.short = codes.of(vectors)
        self.order = np.argsort(values, axis=0, kind="stable").astype(np.int32)
        self.begin = np.zeros((values.shape[1], (1 << codes.bits) + 1), np.int32)
        for s in range(values.shape[1]):
            np.cumsum(np.bincount(values[:, s], minlength=1 << codes.bits), out=self.begin[s, 1:])

    def probe(self, values: np.ndarray) -> np.ndarray:
        """[query, row]: whether a row's value is within `flips` bits of the query's in some substring."""
        found = np.zeros((len(values), len(self.ids)), bool)
        for s in range(values.shape[1]):
            want = (values[:, s, None] ^ self.near).ravel()
            lo = self.begin[s, want]
            runs = self.begin[s, want + 1] - lo
            hit = np.flatnonzero(runs)
            lo, runs = lo[hit], runs[hit]
            ends = np.cumsum(runs)
            if len(hit):
                rows = np.arange(ends[-1]) + np.repeat(lo - (ends - runs), runs)
                found[np.repeat(hit // len(self.near), runs), self.order[rows, s]] = True
        return found

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int, together: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, ids, distances) of each query's k nearest rows of those retrieved within the radius."""
        for a in range(0, len(query_ids), together):
            values, short = self.codes.of(queries[a : a + together])
            for q, x, code, found in zip(query_ids[a : a + together].tolist(), queries[a : a + together], short, self.probe(values), strict=True):
                rows = np.flatnonzero(found)
                rows = rows[np.bitwise_count(self.short[rows] ^ code).sum(1, dtype=np.int64) <= self.codes.radius]
                yield next(nearest(np.array([q]), x[None], self.ids[rows], self.vectors[rows], k))


def fit(vectors: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]], cfg: MihConfig) -> Codes | None:
    """vectors: the sample of rows; near: sampled vectors, each with its exact nearest ones. None, if the
    target can't be met."""
    bits = cfg.bits
    most = max(cfg.most_substrings * bits, cfg.short_bits)
    mean, rotations = learn_rotations(vectors, most, cfg.rounds)
    every = Codes(mean, rotations, bits, cfg.most_substrings, cfg.short_bits, cfg.short_bits, cfg.flips)
    apart, far = [], []
    for q, x in near:
        if not len(x):
            continue
        v, s = every.of(np.concatenate([q[None], x]))
        apart.append(np.bitwise_count(v[1:] ^ v[0]))
        far.append(np.bitwise_count(s[1:] ^ s[0]).sum(1))
    if not apart:
        return Codes(mean, rotations[:, : max(bits, cfg.short_bits)], bits, 1, cfg.short_bits, cfg.short_bits, cfg.flips)
    for flips in range(cfg.flips, max(cfg.flips, cfg.most_flips) + 1):
        got = np.maximum.accumulate(np.concatenate(apart) <= flips, axis=1)
        enough = np.flatnonzero(got.mean(0) >= cfg.target)
        if len(enough):
            m = int(enough[0]) + 1
            kept = np.concatenate(far)[got[:, m - 1]]
            radius = int(np.quantile(kept, cfg.keep, method="higher")) if len(kept) else cfg.short_bits
            return Codes(mean, rotations[:, : max(m * bits, cfg.short_bits)], bits, m, radius, cfg.short_bits, flips)
    return None


def nearest(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, distances) of each query's k nearest rows, itself included, by exact distance."""
    for q, x in zip(query_ids.tolist(), queries, strict=True):
        d = np.sqrt(np.square(vectors - x).sum(1))
        best = np.lexsort((ids, d))[:k]
        yield q, ids[best], d[best]


def _matrix(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _table(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    flat = lambda a, kind: np.concatenate(a).astype(kind) if a else np.zeros(0, kind)
    return pa.table({"query": flat([np.full(len(i), q) for q, i, _ in rows], np.int64), "item": flat([i for _, i, _ in rows], np.int64), "score": flat([d for *_, d in rows], float)})


def _in_blocks(items: DataFrame, queries: DataFrame, n: int, n_queries: int, k: int, cfg: MihConfig, codes: Codes | None = None) -> DataFrame:
    """items(item, v), queries(query, v) -> query, item, score: each query's k nearest of all items, by the
    index of every block, or exactly without `codes`."""
    blocks, chunks = max(1, -(-n // cfg.block_rows)), max(1, -(-n_queries // cfg.chunk_queries))
    each = lambda m: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(m - 1).cast("bigint")))
    part = lambda c, m, seed: F.pmod(F.xxhash64(F.col(c), F.lit(seed)), F.lit(m))
    held = items.select(part("item", blocks, 3).alias("block"), each(chunks).alias("chunk"), "item", "v")
    asked = queries.select(each(blocks).alias("block"), part("query", chunks, 4).alias("chunk"), "query", "v")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table([])
        ids, vectors = left.column("item").to_numpy(), _matrix(left.column("v"), "<f8")
        query_ids, x = right.column("query").to_numpy(), _matrix(right.column("v"), "<f8")
        if codes is None:
            return _table(list(nearest(query_ids, x, ids, vectors, k)))
        return _table(list(BlockIndex(codes, ids, vectors).nearest(query_ids, x, k, cfg.together)))

    met = held.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInArrow(meet, SCORED)
    return _best(met, k)


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("score", "item")
    return scored.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def _search(items: DataFrame, queries: DataFrame, n_queries: int, dim: int, cfg: MihConfig) -> DataFrame:
    """items(item, v), queries(query, v) of one length -> query, item, score: the nearest k + 1 distinct
    vectors found, the query's own one among them."""
    spark = items.sparkSession
    n = items.count()
    chosen = slot_sample_ids(items, "item", cfg.sample_rows)
    sampled = items.join(F.broadcast(chosen), "item").orderBy("sample_order", "item").select("item", "v").collect()
    double = lambda b: np.frombuffer(b, "<f8")
    tuning = {r.item: r.v for r in sampled[: cfg.tuning_rows]}
    asked = spark.createDataFrame(list(tuning.items()), queries.schema)
    true = _in_blocks(items, asked, n, len(tuning), cfg.k + 1, cfg).where("query <> item").join(items, "item")
    near: dict[int, list[bytes]] = {}
    for r in true.select("query", "v").collect():
        near.setdefault(r.query, []).append(r.v)
    codes = fit(np.array([double(r.v) for r in sampled]).reshape(-1, dim), [(double(tuning[q]), np.array([double(v) for v in near[q]])) for q in sorted(near)], cfg)
    found = materialise(_in_blocks(items, queries, n, n_queries, cfg.k + 1, cfg, codes), "mih-found")
    if codes is None:
        return found
    enough = found.groupBy("query").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > min(cfg.k, n - 1))
    if enough.count() == n_queries:
        return found
    few = materialise(queries.join(enough, "query", "left_anti"), "mih-few")
    rest = _in_blocks(items, few, n, few.count(), cfg.k + 1, cfg)
    return found.join(few.select("query"), "query", "left_anti").unionByName(rest)


def neighbours(vectors: DataFrame, is_query: Column, cfg: MihConfig = MihConfig(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vectors(id, vector) -> query_id, rank, vec_id, score: the nearest found of every query row."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(usable(F.col("v")) & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("v").alias("v"), F.max("q").alias("q"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [np.asarray(x, "<f8").tobytes() for x in b.column(1).to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v, pa.binary()), b.column(2)], ["vec_id", "v", "q"])

    # equal vectors are one item, named by the smallest id; minus zero is packed as zero
    rows = rows.select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"), "q")
    packed = materialise(rows.mapInArrow(pack, "vec_id bigint, v binary, q boolean"), "mih-vectors")
    named = packed.groupBy("v").agg(F.min("vec_id").alias("item"))
    items = materialise(named.select("item", "v", F.octet_length("v").alias("size")), "mih-items")
    member = materialise(packed.join(named, "v").select("vec_id", "item", "q"), "mih-members")
    sizes = sorted(r.size for r in items.select("size").distinct().limit(1001).collect())
    if len(sizes) > 1000:
        raise ValueError("vectors of more than 1000 lengths")
    found = spark.createDataFrame([], SCORED)
    asked = member.where("q").select(F.col("item").alias("query")).distinct()
    for size in sizes:
        own = items.where(F.col("size") == size).select("item", "v")
        queries = materialise(own.withColumnRenamed("item", "query").join(asked, "query"), "mih-queries")
        if n_queries := queries.count():
            found = found.unionByName(_search(own, queries, n_queries, size // 8, cfg))
    # from items back to rows: the k + 1 smallest ids of each item are all that any query can need
    least = member.withColumn("_n", F.row_number().over(Window.partitionBy("item").orderBy("vec_id"))).where(F.col("_n") <= cfg.k + 1).select("item", "vec_id")
    near = _best(found.join(least, "item").select("query", F.col("vec_id").alias("item"), "score"), cfg.k + 1)
    mine = member.where("q").select(F.col("vec_id").alias("query_id"), F.col("item").alias("query"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    out = mine.join(near, "query").select("query_id", F.col("item").alias("vec_id"), "score").where("query_id <> vec_id")
    return out.withColumn("rank", rank).where(F.col("rank") <= cfg.k).select("query_id", "rank", "vec_id", "score")
