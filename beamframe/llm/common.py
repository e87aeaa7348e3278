"""Shared helpers of the training-data operators: samples, folds, graph components."""

from __future__ import annotations

from collections.abc import Callable, Hashable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beamframe.plans.scratch import delete_path, scratch_path, scratch_scope
from beamframe.plans.scratch import stored as materialise

__all__ = ["components", "delete_path", "fold_columns", "held", "id_fold", "materialise", "scratch_path", "scratch_scope", "slot_sample_ids", "small_batches", "table", "unfold_columns"]


_HELD: dict = {}


def held(kind: str, key: Hashable, build: Callable[[], object]):
    """What a Python worker remembers between tasks (an automaton, a cache of words), one thing at a time: a
    worker outlives its stages, and what the last operator remembered makes room for the next one's."""
    if (kind, key) not in _HELD:
        _HELD.clear()
        _HELD[kind, key] = build()
    return _HELD[kind, key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_fold(col: str | Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo folds."""
    c = F.col(col) if isinstance(col, str) else col
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(folds))


def slot_sample_ids(df: DataFrame, id_col: str, slots: int, by: str | None = None) -> DataFrame:
    """At most `slots` ids (per value of `by`): the id of the smallest hash in each hash slot.

    A grouped minimum, so it combines before the shuffle and no group is gathered."""
    h = F.xxhash64(F.col(id_col), F.lit(17))
    keys = ([by] if by else []) + ["_slot"]
    return (
        df.withColumn("_slot", F.pmod(F.xxhash64(F.col(id_col), F.lit(5)), F.lit(slots)))
        .groupBy(*keys)
        .agg(F.min(F.struct(h.alias("h"), F.col(id_col).alias("id"))).alias("_m"))
        .select(*([by] if by else []), F.col("_m.id").alias(id_col), F.col("_m.h").alias("sample_order"))
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b): rows (node, component), component the smallest node.

    Alternates large-star and small-star steps; each round is two aggregations and is written to
    the shared folder. Every node sends its neighbours to the smallest one, so the result is a star.
    Groups are only aggregated by minimum and joined back; none is collected."""
    spark = edges.sparkSession
    cur = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    cur = materialise(cur, "cc")
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low2, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        nxt = materialise(small.where("a <> b").distinct(), "cc")
        # a star forest maps to itself: equal counts and no difference end the loop
        same = nxt.count() == cur.count() and nxt.join(cur, ["a", "b"], "left_anti").isEmpty()
        cur = nxt
        if same:
            break
    else:
        raise RuntimeError("components did not converge")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Lower the session's Arrow batch to `rows`, so that a batch of long texts stays small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows or int(spark.conf.get(key, "10000")) <= 0:
        spark.conf.set(key, str(rows))


def fold_columns(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in one struct, so that no name can clash with an operator's own."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *([F.struct(*others).alias("_others")] if others else []))


def unfold_columns(folded: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the table that `fold_columns` was given."""
    return folded.select(*(c if c in ("doc_id", "text") else F.col("_others").getField(c).alias(c) for c in columns))
