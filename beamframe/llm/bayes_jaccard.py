"""N-gram Jaccard join with Bayesian candidate pruning.

A text is the set of its five-word shingles (lower case, split at white space; a shorter text is one
shingle), compared as 64-bit hashes. Texts with equal sets are one node. Nodes get MinHash
signatures; nodes that share a band of them are candidates. A candidate pair's MinHash values are
compared a few at a time, and the pair is dropped as soon as the posterior probability (uniform
prior) that its similarity reaches the threshold falls below the tolerance. What is left is verified
on the whole sets.

Groups of near copies are not expanded into all pairs. First every member of a bucket is compared
with the bucket's hub, the member that shares most buckets, and verified links are labelled by
components. Then, in buckets that still hold more than one label, the members without the commonest
label meet all others inside tasks, in cells of bounded size, by four times as many MinHash values, and
the survivors are verified. So no link between two labels is lost; the only misses are pairs that share no
band (3 in a million at similarity 0.8) or fall to the tolerance.

Links between equal labels are counted, not written: the members of a label meet in cells of bounded size,
each pair in one cell, all pairs there are verified on the whole sets, and a cell returns degrees. Nothing
is missed there. That work, unlike the rows, grows with the square of a label's size.

Result, one row per document: class_id, the smallest doc_id of its class (linked directly or through
others); n_links, its other copies plus the different texts of a similarity that reaches the threshold;
n_copies, documents with the same set; class_size, documents of the class.

Defined cases: null, empty and blank texts have no shingle, link to nothing and are classes of their
own (class_id is their doc_id, n_links 0); repeated rows are copies of each other, and one set; a null doc_id is
returned and counts in its class; extra columns are ignored; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamframe.llm.common import components, held, materialise, small_batches

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class JaccardConfig:
    words: int = 5
    threshold: float = 0.8
    bands: int = 32
    rows: int = 5  # MinHash values in a band
    step: int = 16  # values compared before each look at the posterior
    tolerance: float = 1e-5
    longer: int = 4  # times as many values where pairs are compared inside tasks
    cell: int = 4096  # members of a bucket that meet in one task
    small: int = 64  # buckets up to this share a task with others
    shingles: int = 1 << 20  # of a label's members on one side of a cell

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def long_hashes(self) -> int:
        return self.hashes * self.longer


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash; cleared when it holds `limit` words."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            self[word] = h
        return h


def word_hashes() -> WordHashes:
    return held("shingles", (), WordHashes)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    w = (text or "").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(word_hashes().__getitem__, w), np.uint64, len(w))
    n = max(1, len(h) - words + 1)
    out = np.full(n, min(len(h), words), np.uint64)
    for k in range(min(len(h), words)):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


@lru_cache(maxsize=4)
def _functions(cfg: JaccardConfig) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20_011)
    both = r.integers(0, 1 << 63, (cfg.long_hashes, 2), dtype=np.uint64)
    return both[:, 0].copy(), both[:, 1] * np.uint64(2) + np.uint64(1)


def minhash(shingles: np.ndarray, cfg: JaccardConfig, n: int) -> np.ndarray:
    """Least hash under each of the first n functions."""
    xor, mul = (f[:n] for f in _functions(cfg))
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 512):
        least = np.minimum(least, ((shingles[a : a + 512, None] ^ xor) * mul).min(0))
    return least


def band_keys(least: np.ndarray, cfg: JaccardConfig) -> np.ndarray:
    rows = least.reshape(cfg.bands, cfg.rows)
    out = np.arange(cfg.bands, dtype=np.uint64)
    for k in range(cfg.rows):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return out.view(np.int64)


def signature(least: np.ndarray) -> np.ndarray:
    """16 bits of every MinHash value."""
    return (_mix(least) >> np.uint64(48)).astype("<u2")


@lru_cache(maxsize=4)
def least_matches(cfg: JaccardConfig) -> tuple[tuple[int, int], ...]:
    """(values compared, least matches to go on): below, P(similarity >= threshold | matches) < tolerance.

    With a uniform prior the posterior after m matches of n is P(Binomial(n + 1, threshold) <= m)."""
    out = []
    t = cfg.threshold
    for n in range(cfg.step, cfg.long_hashes + 1, cfg.step):
        total, m = 0.0, -1
        while total < cfg.tolerance:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return tuple(out)


def surviving(left: np.ndarray, right: np.ndarray, cfg: JaccardConfig) -> np.ndarray:
    """Indices of the pairs (rows of left and right signatures) that no look at the posterior drops; all
    values that the signatures have are compared."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int32)
    done = 0
    for n, least in least_matches(cfg):
        if not len(alive) or n > left.shape[1]:
            break
        matches[alive] += (left[alive, done:n] == right[alive, done:n]).sum(1, dtype=np.int32)
        alive = alive[matches[alive] >= least]
        done = n
    return alive


def _binary(values: list) -> pa.Array:
    return pa.array(values, pa.binary())


def describe(docs: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text_hash, k (null without shingles), sig, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sigs, bands = [], [], []
            for t in b.column(2):
                s = shingle_set(t.as_py(), cfg.words)
                if not len(s):
                    keys.append(None)
                    sigs.append(None)
                    bands.append(None)
                    continue
                least = minhash(s, cfg, cfg.hashes)
                keys.append(set_key(s))
                sigs.append(signature(least).tobytes())
                bands.append(band_keys(least, cfg))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _binary(keys), _binary(sigs), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "text_hash", "k", "sig", "bands"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, k binary, sig binary, bands array<bigint>")


def _prune(pairs: DataFrame, nodes: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """pairs(a, b) that survive the comparison of their signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = (np.frombuffer(b"".join(b.column(i).to_pylist()), "<u2").reshape(-1, cfg.hashes) for i in (2, 3))
            keep = pa.array(surviving(left, right, cfg))
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep)], ["a", "b"])

    sig = lambda end: nodes.select(F.col("k").alias(end), F.col("sig").alias(f"sig_{end}"))
    return pairs.join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a binary, b binary")


def chosen_rows(rows: DataFrame) -> DataFrame:
    """Nodes of the described rows: k, doc_id (its smallest), n_copies, sig, bands, and the one row that its
    set is read from (pick_id, pick_hash), with `repeated`, whether that row stands in the table more than once."""
    known = rows.where("k IS NOT NULL")
    pick = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("pick")
    nodes = known.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), pick)
    nodes = nodes.select("k", "doc_id", "n_copies", "sig", "bands", F.col("pick.doc_id").alias("pick_id"), F.col("pick.text_hash").alias("pick_hash"))
    again = known.groupBy("k", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = again.select(F.col("k").alias("_k"), F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    met = nodes.join(again, (F.col("k") == F.col("_k")) & F.col("pick_id").eqNullSafe(F.col("_id")) & (F.col("pick_hash") == F.col("_hash")), "left")
    return met.withColumn("repeated", F.col("_k").isNotNull()).drop("_k", "_id", "_hash")


def _sets(ks: DataFrame, nodes: DataFrame, docs: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """k, s, long_sig of the wanted nodes, a row a node: whole sets and longer signatures, from the texts.

    A node's set is read from one row, chosen by id and hash of the text. Where that row is repeated, its
    texts are grouped first; that is the only shuffle of texts that this may need."""
    wanted = materialise(nodes.select("k", "pick_id", "pick_hash", "repeated").join(ks, "k"), "jaccard-wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sets, sigs = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = shingle_set(t.as_py(), cfg.words)
                if set_key(s) == k:  # another text of that id may share the text's hash
                    keys.append(k)
                    sets.append(s.tobytes())
                    sigs.append(signature(minhash(s, cfg, cfg.long_hashes)).tobytes())
            yield pa.RecordBatch.from_arrays([_binary(keys), _binary(sets), _binary(sigs)], ["k", "s", "long_sig"])

    read = docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64("text").alias("_hash"), "text")

    def met(keys: DataFrame) -> DataFrame:
        # by sorting at every size: the wanted rows grow with the input
        return read.join(keys.hint("merge"), F.col("_id").eqNullSafe(F.col("pick_id")) & (F.col("_hash") == F.col("pick_hash"))).select("k", "text")

    texts = met(wanted.where("NOT repeated"))
    again = wanted.where("repeated")
    if not again.isEmpty():
        texts = texts.unionByName(met(again).groupBy("k", "text").agg(F.count(F.lit(1)).alias("_n")).select("k", "text"))
    return texts.mapInArrow(run, "k binary, s binary, long_sig binary")


def _verify(pairs: DataFrame, sets: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """pairs(a, b) whose sets reach the threshold, with the similarity."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            j = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                either = len(np.union1d(x, y))
                j.append((len(x) + len(y) - either) / either)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(j, pa.float64())], ["a", "b", "similarity"])

    end = lambda e: sets.select(F.col("k").alias(e), F.col("s").alias(f"s_{e}"))
    met = pairs.join(end("b"), "b").join(end("a"), "a").select("a", "b", "s_a", "s_b")
    return met.mapInArrow(exact, "a binary, b binary, similarity double").where(F.col("similarity") >= cfg.threshold).distinct()


def _labels(links: DataFrame, rounds: int = 3) -> DataFrame:
    """k, label of linked nodes: the least node met within a few steps, of the same component."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lab = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("label"))
    for _ in range(rounds - 1):
        met = both.join(lab.select(F.col("a").alias("b"), F.col("label").alias("theirs")), "b").groupBy("a").agg(F.min("theirs").alias("m"))
        lab = lab.join(met, "a").select("a", F.least("label", "m").alias("label"))
    return materialise(lab.select(F.col("a").alias("k"), "label"), "jaccard-labels")


def compare_bucket(keys: list[bytes], label: np.ndarray, common: np.ndarray, asked: np.ndarray, sigs: np.ndarray, band: int, cfg: JaccardConfig) -> list[tuple[bytes, bytes]]:
    """Pairs of an asked row and a row that isn't, with different labels, that survive and share no earlier
    band. Rows of the bucket's commonest label (`common`) are never asked; of two others the lesser asks."""
    base = np.flatnonzero(~asked)
    names = np.array(keys, object)
    out = []
    for i in np.flatnonzero(asked).tolist():
        js = base[(label[base] != label[i]) & (common[base] | (names[base] > keys[i]))]
        js = js[surviving(np.broadcast_to(sigs[i], (len(js), sigs.shape[1])), sigs[js], cfg)]
        same = (sigs[js, : cfg.hashes] == sigs[i, : cfg.hashes]).reshape(-1, cfg.bands, cfg.rows).all(2)
        js = js[~same[:, :band].any(1)]
        out += [(min(keys[i], keys[j]), max(keys[i], keys[j])) for j in js.tolist()]
    return out


def across_cells(members: DataFrame, sets: DataFrame, labels: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """Rows that are compared inside tasks: every member of a bucket with more than one label once a chunk
    of those asked, and the members without the bucket's commonest label, which ask, once a chunk of all.

    So a large group with few strays sends about its own number of rows, whatever its size."""
    half = cfg.cell // 2
    m = members.select("band", "no", "k").join(labels, "k", "left").select("band", "no", "k", F.coalesce("label", "k").alias("label"))
    by_label = m.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = by_label.groupBy("band").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top")).where(F.col("n") > F.col("top.n"))
    mixed = materialise(mixed.select("band", "n", F.col("top.label").alias("common"), (F.col("n") - F.col("top.n")).alias("n_asked")), "jaccard-mixed")
    bins = mixed.agg(F.ceil(F.coalesce(F.sum("n"), F.lit(0)) / F.lit(half)).alias("bins")).first().bins
    chunks = lambda n: F.ceil(F.col(n) / F.lit(half)).cast("int")
    cell = F.when(F.col("n") <= cfg.small, F.pmod(F.xxhash64("band"), F.lit(max(1, bins)))).otherwise(F.col("band"))
    told = mixed.select("band", "common", chunks("n").alias("chunks"), chunks("n_asked").alias("asked_chunks"), cell.alias("cell"))
    rows = materialise(m.join(told, "band").withColumn("is_common", F.col("label") == F.col("common")).drop("common"), "jaccard-mixed-members")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("k"), F.col(n)).cast("int")
    kept = ["cell", "band", "no", "k", "label", "is_common"]
    base = rows.select(*kept, F.lit(False).alias("asked"), part("chunks").alias("x"), every("asked_chunks").alias("y"))
    asked = rows.where(~F.col("is_common")).select(*kept, F.lit(True).alias("asked"), every("chunks").alias("x"), part("asked_chunks").alias("y"))
    return base.unionByName(asked).join(sets.select("k", "long_sig"), "k")


def _across(members: DataFrame, sets: DataFrame, labels: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """Pairs of a bucket with different labels that survive pruning, compared inside tasks."""

    def compare(t: pa.Table) -> pa.Table:
        band, no = t.column("band").to_numpy(), t.column("no").to_numpy()
        keys = t.column("k").to_pylist()
        common, asked = (np.array(t.column(c).to_pylist(), bool) for c in ("is_common", "asked"))
        sigs = np.frombuffer(b"".join(t.column("long_sig").to_pylist()), "<u2").reshape(-1, cfg.long_hashes)
        label = t.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.argsort(band, kind="stable")
        found = []
        for run in np.split(order, np.flatnonzero(np.diff(band[order])) + 1):
            found += compare_bucket([keys[i] for i in run.tolist()], label[run], common[run], asked[run], sigs[run], int(no[run[0]]), cfg)
        return pa.table({"a": _binary([a for a, _ in found]), "b": _binary([b for _, b in found])})

    cells = across_cells(members, sets, labels, cfg)
    return cells.groupBy("cell", "x", "y").applyInArrow(compare, "a binary, b binary").distinct()


def degrees(sets: list[np.ndarray], side: np.ndarray, across: bool, cfg: JaccardConfig) -> np.ndarray:
    """Links of each set to the others (of the other side, if `across`), all pairs verified."""
    out = np.zeros(len(sets), np.int64)
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    right = order[side[order] == side.max()] if across else order
    left = order[side[order] != side.max()] if across else order
    if not len(left) or not len(right):
        return out
    codes = np.unique(np.concatenate([sets[i] for i in [*right.tolist(), *(left.tolist() if across else [])]]), return_inverse=True)[1]
    starts = np.append(0, np.cumsum(size[right]))
    own = starts[-1] + np.append(0, np.cumsum(size[left])) if across else starts
    met = np.zeros(int(codes.max()) + 1, np.uint8)
    lo, hi = np.searchsorted(size[right], [size[left] * cfg.threshold - 1, size[left] / cfg.threshold + 1])
    for n, i in enumerate(left.tolist()):
        a, z = (int(lo[n]) if across else n + 1), int(hi[n])
        if a >= z:
            continue
        mine = codes[own[n] : own[n + 1]]
        met[mine] = 1
        common = np.add.reduceat(met[codes[starts[a] : starts[z]]], starts[a:z] - starts[a], dtype=np.int64)
        met[mine] = 0
        js = right[a:z]
        js = js[common / (size[i] + size[js] - common) >= cfg.threshold]
        out[i] += len(js)
        out[js] += 1
    return out


def _within(sets: DataFrame, labels: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """k, degree: links between nodes of one label, counted inside tasks in every cell where k is."""
    half = cfg.cell // 2
    members = labels.join(sets.select("k", "s"), "k")
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("length(s) div 8")).alias("shingles")).where("n > 1")
    sizes = materialise(sizes, "jaccard-label-sizes")
    share = lambda n, shingles: F.ceil(F.greatest(n / F.lit(half), shingles / F.lit(cfg.shingles)))
    bins = sizes.agg(share(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("shingles"), F.lit(0))).alias("bins")).first().bins
    chunks = share(F.col("n"), F.col("shingles")).cast("int")
    cell = F.when((F.col("n") <= cfg.small) & (chunks == 1), F.pmod(F.xxhash64("label"), F.lit(max(1, bins)))).otherwise(F.xxhash64("label"))
    rows = members.join(sizes.select("label", chunks.alias("chunks"), cell.alias("cell")), "label")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("k", F.lit(7)), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = rows.select("cell", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "k", "label", "s")

    def count(t: pa.Table) -> pa.Table:
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in t.column("s")]
        label, side = t.column("label").combine_chunks().dictionary_encode().indices.to_numpy(), t.column("own").to_numpy()
        across = t.column("x")[0].as_py() != t.column("y")[0].as_py()
        order = np.argsort(label, kind="stable")
        found = np.zeros(len(sets), np.int64)
        for run in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
            if len(run) > 1:
                found[run] = degrees([sets[i] for i in run.tolist()], side[run], across, cfg)
        return pa.table({"k": t.column("k").cast(pa.binary()), "degree": pa.array(found)})

    return cells.groupBy("cell", "x", "y").applyInArrow(count, "k binary, degree bigint")


def similarity_classes(docs: DataFrame, cfg: JaccardConfig = JaccardConfig()) -> DataFrame:
    """docs(doc_id, text) -> per row: doc_id, class_id, n_links, n_copies, class_size, text_hash (xxhash64 of
    the text, to tell rows with one doc_id apart)."""
    small_batches(docs.sparkSession)
    rows = materialise(describe(docs, cfg), "jaccard-rows")
    nodes = materialise(chosen_rows(rows), "jaccard-nodes")
    banded = nodes.select("k", F.posexplode("bands").alias("no", "band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialise(banded.join(shared, "band"), "jaccard-members")

    sets = materialise(_sets(members.select("k").distinct(), nodes, docs, cfg), "jaccard-sets")

    # every member of a bucket against its hub
    central = members.groupBy("k").agg(F.sum("n").alias("c"))
    hubs = members.join(central, "k").groupBy("band").agg(F.max(F.struct("c", "k")).alias("h")).select("band", F.col("h.k").alias("hub"))
    star = members.join(hubs, "band").where("k <> hub").select(F.least("k", "hub").alias("a"), F.greatest("k", "hub").alias("b")).distinct()
    first = materialise(_prune(star, nodes, cfg), "jaccard-star")
    links = materialise(_verify(first, sets, cfg), "jaccard-links")
    labels = _labels(links)

    # pairs with different labels
    second = materialise(_across(members, sets, labels, cfg).join(first, ["a", "b"], "left_anti"), "jaccard-across")
    more = materialise(_verify(second, sets, cfg), "jaccard-more")
    links = links.unionByName(more)

    lab = lambda e: labels.select(F.col("k").alias(e), F.col("label").alias(f"label_{e}"))
    apart = links.join(lab("a"), "a", "left").join(lab("b"), "b", "left").select("a", "b", F.coalesce("label_a", "a").alias("label_a"), F.coalesce("label_b", "b").alias("label_b")).where("label_a <> label_b")
    roots = components(apart.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct())
    counted = apart.select(F.explode(F.array("a", "b")).alias("k"), F.lit(1).cast("bigint").alias("degree"))
    degree = counted.unionByName(_within(sets, labels, cfg)).groupBy("k").agg(F.sum("degree").alias("degree"))
    known = nodes.select("k", "doc_id", "n_copies").join(labels, "k", "left").withColumn("label", F.coalesce("label", "k"))
    known = known.join(roots.select(F.col("node").alias("label"), "component"), "label", "left")
    known = materialise(known.select("k", "doc_id", "n_copies", F.coalesce("component", "label").alias("class")), "jaccard-classes")
    classes = known.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.sum("n_copies").alias("class_size"))
    per_node = known.join(classes, "class").select("k", "class_id", "class_size", "n_copies")
    out = rows.select("doc_id", "text_hash", "k").join(per_node, "k", "left").join(degree, "k", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce(F.col("n_copies") - 1 + F.coalesce("degree", F.lit(0)), F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("class_size", F.lit(1)).alias("class_size"), "text_hash")
