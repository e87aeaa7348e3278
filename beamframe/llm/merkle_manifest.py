"""Merkle manifest of a dataset: one tree of hashes a source, one tree over the sources, proofs and audits.

A row is a leaf: the hash of its fields, `-` for null, else the byte count, `:` and the value. The
leaves of a source ascend by id and get their indices from a global sort: `row_number` inside a piece of
a range of the sort, plus the rows of the source in the ranges before, so that no source is numbered by
one task. Then every level is a DataFrame: indices are floor-divided by the fanout, at most `fanout`
children meet in one sorted array, and their concatenated digests are hashed into the parent. What is
left of a source is its subroot; the subroots, ordered by source, are the leaves of the root's tree.

Proofs come back down the same levels: a parent's path (what stands left and right of it in its run,
level by level up to the root) is joined to its run by index, and every child puts its own siblings in
front. A path is therefore joined once a run and not once a leaf. An audit folds a leaf, as it is now,
with the siblings of its path and compares the result with the root.

Work and skew: texts are hashed where they are read and go no further. Joins and groups are keyed by
(tree, index), which is unique, whatever a source holds; equal rows are spread over the ranges of the
sort. Every level is written to the shared folder once. The driver learns the rows of the largest tree,
the number of trees and the root.

Defined cases: nulls have their own leaves; rows without an id come first in their source, rows without
a source form the first tree; of rows with one id the smaller leaf comes first, and repeated rows are
leaves of their own, with the same digests and different places; extra columns are ignored; an empty
table gives no rows; a tree of one leaf has that leaf as its subroot."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from beamframe.llm.common import materialise
from beamframe.llm.exact_dedup import dense_ranks

SIBLINGS = "array<struct<left:string,right:string>>"


@dataclass(frozen=True)
class ManifestConfig:
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")
    tree: str = "source"
    order: str = "doc_id"
    fanout: int = 3


def digest(c: Column) -> Column:
    """Lower-case hex sha256 of a string's UTF-8 bytes."""
    return F.sha2(c.cast("binary"), 256)


def leaf_hash(fields: list[Column]) -> Column:
    """Hash of all fields, told apart from one another by their byte counts."""
    texts = [f.cast("string") for f in fields]
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)))


def number_leaves(leaves: DataFrame, tree: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Add `tree_id` (rank of the tree's name from 0, null first), `idx` (place in its tree from 0) and `n`
    (leaves of its tree). The second table has a row a tree: its name, tree_id, n."""
    spread = F.xxhash64(F.monotonically_increasing_id())  # equal rows don't all go to one range
    ranked = materialise(leaves.withColumn("_spread", spread).orderBy(F.col(tree), *order, "_spread").drop("_spread").withColumn("_at", F.monotonically_increasing_id()), "leaves")
    ranked = ranked.withColumn("_part", F.shiftright("_at", 33))
    # a row a range and tree that meet
    pieces = materialise(ranked.groupBy("_part", tree).agg(F.count(F.lit(1)).alias("_n")), "pieces")
    sizes = materialise(pieces.groupBy(tree).agg(F.sum("_n").alias("n")), "sizes")
    trees = materialise(dense_ranks(sizes, [tree]).select(F.col(tree).alias("_name"), F.col("name").alias("tree_id"), "n"), "trees")
    earlier = F.sum("_n").over(Window.partitionBy(tree).orderBy("_part")) - F.col("_n")
    places = pieces.withColumn("_before", earlier).join(trees, F.col(tree).eqNullSafe(F.col("_name")))
    places = places.select(F.col("_part").alias("_p"), "_name", "tree_id", "n", "_before")
    within = F.row_number().over(Window.partitionBy("_part", tree).orderBy("_at"))
    numbered = ranked.withColumn("_row", within).join(places, (F.col("_part") == F.col("_p")) & F.col(tree).eqNullSafe(F.col("_name")))
    kept = [c for c in leaves.columns if c != tree]
    return numbered.select(*kept, "tree_id", (F.col("_before") + F.col("_row") - 1).alias("idx"), "n"), trees


def build_levels(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """nodes(tree_id, idx, n, h, item) -> per level the runs (tree_id, idx, n, kids, h), and the trees' tops
    (tree_id, level, h). `item` is carried along at the lowest level only."""
    runs: list[DataFrame] = []
    tops = nodes.where("n = 1").select("tree_id", F.lit(0).alias("level"), "h")
    largest = nodes.agg(F.max("n")).first()[0] or 0
    while largest > 1:
        kids = F.sort_array(F.collect_list(F.struct(*(["idx", "h"] + (["item"] if "item" in nodes.columns else [])))))
        run = nodes.where("n > 1").groupBy("tree_id", F.floor(F.col("idx") / fanout).alias("idx")).agg(F.ceil(F.max("n") / fanout).alias("n"), kids.alias("kids"))
        run = materialise(run.withColumn("h", digest(F.array_join(F.transform("kids", lambda k: k.h), ""))), "level")
        runs.append(run)
        nodes = run.select("tree_id", "idx", "n", "h")
        tops = tops.unionByName(nodes.where("n = 1").select("tree_id", F.lit(len(runs)).alias("level"), "h"))
        largest = -(-largest // fanout)
    return runs, tops


def descend(runs: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Paths of all leaves that stand in a run: tops(tree_id, level, path) -> tree_id, idx, h, item, path."""
    above = None
    for level in range(len(runs) - 1, -1, -1):
        top = tops.where(F.col("level") == level + 1).select("tree_id", F.lit(0).cast("bigint").alias("idx"), "path")
        above = top if above is None else above.select("tree_id", "idx", "path").unionByName(top)
        met = runs[level].select("tree_id", "idx", "kids").join(above, ["tree_id", "idx"])
        own = F.transform(
            "kids",
            lambda k, i: F.struct(
                k.idx.alias("idx"),
                k.h.alias("h"),
                *([k.item.alias("item")] if level == 0 and _has_item(runs[0]) else []),
                F.struct(
                    F.array_join(F.transform(F.slice("kids", 1, i), lambda s: s.h), "").alias("left"),
                    F.array_join(F.transform(F.slice("kids", i + 2, F.size("kids")), lambda s: s.h), "").alias("right"),
                ).alias("beside"),
            ),
        )
        above = met.select("tree_id", "path", F.explode(own).alias("k")).select(
            "tree_id", "k.idx", "k.h", *(["k.item"] if level == 0 and _has_item(runs[0]) else []), F.concat(F.array("k.beside"), "path").alias("path")
        )
    return above


def _has_item(run: DataFrame) -> bool:
    return "item" in run.schema["kids"].dataType.elementType.fieldNames()


def manifest(docs: DataFrame, audit: dict[str, Column], audited: Column, cfg: ManifestConfig = ManifestConfig()) -> DataFrame:
    """One row a row of docs: its order column, leaf, subroot, root, path (siblings from the leaf up to the
    root), and `folded_root`, what the row gives when it is read again; where `audited` holds, with the
    columns of `audit` in place of its own."""
    own = {c: F.col(c) for c in cfg.fields}
    leaf, now = leaf_hash(list(own.values())), leaf_hash(list((own | audit).values()))
    # where nothing changed there is nothing to keep
    leaves = docs.select(F.col(cfg.tree).alias("tree_name"), F.col(cfg.order).alias("key"), leaf.alias("leaf"), F.when(audited, now).alias("now"))
    leaves = leaves.withColumn("now", F.when(F.col("now") != F.col("leaf"), F.col("now")))
    numbered, trees = number_leaves(leaves, "tree_name", ["key", "leaf"])
    nodes = materialise(numbered.select("tree_id", "idx", "n", F.col("leaf").alias("h"), F.struct("key", "now").alias("item")), "nodes")
    runs, tops = build_levels(nodes, cfg.fanout)
    tops = materialise(tops, "subroots")
    # the root's tree: its leaves are the subroots, in the order of their trees
    heads = tops.select(F.lit(0).cast("bigint").alias("tree_id"), F.col("tree_id").alias("idx"), F.lit(trees.count()).alias("n"), "h", F.struct("level").alias("item"))
    root_runs, root_top = build_levels(heads, cfg.fanout)
    root_top = materialise(root_top, "root").select("tree_id", "level", "h", F.array().cast(SIBLINGS).alias("path"))
    alone = heads.where("n = 1").select("tree_id", "idx", "h", "item", F.array().cast(SIBLINGS).alias("path"))
    placed = descend(root_runs, root_top).unionByName(alone) if root_runs else alone
    placed = materialise(placed.select(F.col("idx").alias("tree_id"), F.col("item.level").alias("level"), F.col("h").alias("subroot"), "path"), "placed")
    single = nodes.where("n = 1").join(placed.select("tree_id", "path"), "tree_id").select("tree_id", "idx", "h", "item", "path")
    found = descend(runs, placed).unionByName(single) if runs else single
    # the subroot is what the leaf folds to below the root's tree: its levels are the path's first ones
    depth = F.size("path") - F.lit(len(root_runs))
    fold = lambda start, path: F.aggregate(path, start, lambda acc, s: digest(F.concat(s.left, acc, s.right)))
    root = root_top.first()
    return found.select(
        F.col("item.key").alias(cfg.order),
        F.col("h").alias("leaf"),
        fold(F.col("h"), F.slice("path", F.lit(1), depth)).alias("subroot"),
        F.lit(root.h if root else None).cast("string").alias("root"),
        "path",
        fold(F.coalesce("item.now", "h"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def verify_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents, audited where the id's crc32 is even against texts that lost their line
    feeds: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Rows without an id are not altered."""
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    found = manifest(docs, {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}, even)
    proof = digest(F.array_join(F.transform("path", lambda s: F.concat(s.left, s.right)), ""))
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


# the eight steps of a byte of crc32, low bit first, with the polynomial 0xEDB88320
ORACLE_SQL = r"""
WITH RECURSIVE
fields AS (
  SELECT doc_id, source,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    text, replace(text, chr(10), '') AS cut,
    list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)), lambda r, i: xor(r >> 1, CASE WHEN r % 2 = 1 THEN 3988292384 ELSE 0 END))) AS crc
  FROM documents),
leaves AS (
  SELECT row_number() OVER () AS id, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS now
  FROM fields),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY source) AS n FROM leaves),
nodes AS (
  SELECT 0 AS level, tree, idx, n, leaf AS h FROM placed
  UNION ALL
  SELECT level + 1, tree, idx // 3, max(n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY level, tree, idx // 3),
subroots AS (SELECT tree, h, level FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS level, tree - 1 AS idx, (SELECT count(*) FROM subroots) AS n, h FROM subroots
  UNION ALL
  SELECT level + 1, idx // 3, max(n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM upper WHERE n > 1 GROUP BY level, idx // 3),
climb AS (
  SELECT id, tree, 0 AS level, idx, n, now AS h, '' AS proof FROM placed
  UNION ALL
  SELECT c.id, c.tree, c.level + 1, c.idx // 3, (c.n + 2) // 3,
    sha256(coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx < c.idx), '') || c.h || coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx > c.idx), '')),
    c.proof || coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx <> c.idx), '')
  FROM climb c JOIN nodes s ON s.tree = c.tree AND s.level = c.level AND s.idx // 3 = c.idx // 3
  WHERE c.n > 1 GROUP BY c.id, c.tree, c.level, c.idx, c.n, c.h, c.proof),
climb_root AS (
  SELECT id, 0 AS level, tree - 1 AS idx, (SELECT count(*) FROM subroots) AS n, h, proof FROM climb WHERE n = 1
  UNION ALL
  SELECT c.id, c.level + 1, c.idx // 3, (c.n + 2) // 3,
    sha256(coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx < c.idx), '') || c.h || coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx > c.idx), '')),
    c.proof || coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx <> c.idx), '')
  FROM climb_root c JOIN upper s ON s.level = c.level AND s.idx // 3 = c.idx // 3
  WHERE c.n > 1 GROUP BY c.id, c.level, c.idx, c.n, c.h, c.proof)
SELECT p.doc_id, p.leaf, r.h AS subroot, (SELECT h FROM upper WHERE n = 1) AS root, sha256(c.proof) AS proof_sha256, c.h AS folded_root,
  c.h = (SELECT h FROM upper WHERE n = 1) AS verified
FROM placed p JOIN climb_root c ON c.id = p.id AND c.n = 1 JOIN subroots r ON r.tree = p.tree
"""
