"""Exact dedup by deterministic block naming.

Texts are cut into fixed-size byte blocks. The distinct blocks are sorted, by a 64-bit key of their
bytes and then by the bytes, and their rank is their integer name, so equal blocks have equal names
and different blocks different ones, and names depend on the texts alone, not on partitions or file
order. Then adjacent pairs of names are named the same way, level by level, until each document is one
name; with the byte length and the number of levels it is the document's identity. No hash decides
equality: the key routes blocks to their names, and where two different blocks share one, their bytes
are compared.

Work and skew: distinct keys and pairs are grouped with map-side combining, so copies meet as one
row; sorts are range-partitioned over distinct rows, so no value repeats in them; names travel back in
joins on small rows, which adaptive execution splits when a key is hot. The input is numbered and
written to the shared folder once, and so is every level; only these tables are read again, so lost
executors or a changing file order can't mix rows up.

Defined cases: a null text counts as empty; empty texts are equal to one another; repeated rows are
copies of each other (each is returned); of equal texts the largest doc_id stays, and of its
repeated rows all carry kept = true; extra columns are ignored; an empty table gives no rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beamframe.llm.common import materialise

ALONE = -(1 << 62)  # what an odd last name is paired with


@dataclass(frozen=True)
class BlockNamingConfig:
    block_bytes: int = 4096
    routing_bits: int = 64  # fewer only in tests, to make blocks share a route


def _blocks(body: Column, size: int) -> Column:
    """Array of (pos, block); an empty body is one empty block."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(body) / F.lit(size)).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("pos"), F.substring(body, i * size + 1, F.lit(size)).alias("block")))


def dense_ranks(distinct: DataFrame, order: list[str]) -> DataFrame:
    """Add `name`, the rank from 0 of every distinct row in the order of its columns: ranks inside the
    ranges of a global sort, plus the rows of the ranges before."""
    ranked = materialise(distinct.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    sizes = ranked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # a row per range of the sort
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    offsets = sizes.select("_part", before.alias("_before"))
    return ranked.withColumn("_part", part).join(F.broadcast(offsets), "_part").select(*distinct.columns, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias("name"))


def block_identities(docs: DataFrame, cfg: BlockNamingConfig = BlockNamingConfig()) -> DataFrame:
    """docs(doc_id, text) -> row_id, doc_id, n_bytes, text_sha256, depth, name: equal (depth, n_bytes, name) iff equal texts."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    route = F.xxhash64(F.col("b.block"))
    if cfg.routing_bits < 64:
        route = F.pmod(route, F.lit(1 << cfg.routing_bits))
    # rows get their numbers once, in a table that all else reads
    numbered = materialise(docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", body.alias("body")), "numbered")
    cut = numbered.select(
        "row_id", "doc_id", F.octet_length("body").alias("n_bytes"), F.sha2("body", 256).alias("text_sha256"), F.explode(_blocks(F.col("body"), cfg.block_bytes)).alias("b")
    ).withColumn("route", route)
    # 1. keys of distinct blocks, sorted into names
    distinct = cut.select("route", F.col("b.block").alias("block")).groupBy("route", "block").agg(F.count(F.lit(1)).alias("n"))
    routes = materialise(distinct.groupBy("route").agg(F.count(F.lit(1)).alias("n_blocks")), "block-keys")
    names = dense_ranks(routes, ["route"])
    # 2. one small row per block
    pieces = cut.select("row_id", "doc_id", "n_bytes", F.when(F.col("b.pos") == 0, F.col("text_sha256")).alias("text_sha256"), F.col("b.pos").alias("pos"), "route")
    rows = materialise(pieces.join(names, "route"), "block-rows")
    shared = routes.where("n_blocks > 1").select("route")
    if not shared.isEmpty():
        # different blocks share a key: their bytes are sorted as well
        mine = cut.join(shared, "route", "left_semi").select("row_id", F.col("b.pos").alias("pos"), F.col("b.block").alias("block"), "route")
        exact = dense_ranks(materialise(mine.select("route", "block").distinct(), "shared-blocks"), ["route", "block"])
        fixed = mine.join(exact.select("route", "block", (-1 - F.col("name")).alias("exact")), ["route", "block"]).select("row_id", "pos", "exact")
        rows = materialise(rows.join(fixed, ["row_id", "pos"], "left").withColumn("name", F.coalesce("exact", "name")).drop("exact"), "block-rows")
    heads = rows.where("pos = 0").select("row_id", "doc_id", "n_bytes", "text_sha256")
    level = rows.select("row_id", "pos", "name", F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / F.lit(cfg.block_bytes))).cast("int").alias("left"))
    done = level.where("left = 1").select("row_id", "name", F.lit(0).alias("depth"))
    level = level.where("left > 1")
    depth = 0
    # 3. name adjacent pairs until one name is left
    while not level.isEmpty():
        depth += 1
        pairs = (
            level.groupBy("row_id", (F.col("pos") / 2).cast("int").alias("pos"))
            .agg(F.min(F.struct("pos", "name")).getField("name").alias("a"), F.max(F.struct("pos", "name")).alias("z"), F.count(F.lit(1)).alias("c"), F.max("left").alias("left"))
            .select("row_id", "pos", "a", F.when(F.col("c") == 2, F.col("z.name")).otherwise(F.lit(ALONE)).alias("b"), ((F.col("left") + 1) / 2).cast("int").alias("left"))
        )
        pairs = materialise(pairs, "pairs")
        named = dense_ranks(materialise(pairs.select("a", "b").distinct(), "distinct-pairs"), ["a", "b"])
        nxt = materialise(pairs.join(named, ["a", "b"]).select("row_id", "pos", "name", "left"), "level")
        done = done.unionByName(nxt.where("left = 1").select("row_id", "name", F.lit(depth).alias("depth")))
        level = nxt.where("left > 1")
    return heads.join(done, "row_id")


def exact_dedup(docs: DataFrame, cfg: BlockNamingConfig = BlockNamingConfig()) -> DataFrame:
    """docs(doc_id, text) -> per row: doc_id, keep_id, group_size, kept, text_sha256."""
    ids = materialise(block_identities(docs, cfg), "identities")
    groups = ids.groupBy("depth", "n_bytes", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return ids.join(groups, ["depth", "n_bytes", "name"]).select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256"
    )


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
