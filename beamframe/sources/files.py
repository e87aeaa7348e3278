"""Reading and writing event data: split runs, side tables, text calibrations, reports."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GAIN_COLUMNS = ("name", "lms_peak", "lms_sigma", "lms_chi2ndf", "g1", "g2", "g3")


def read_segments(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """All segments of a run in a folder, with the file each row came from."""
    return spark.read.option("pathGlobFilter", pattern).parquet(path).withColumn("segment_file", F.input_file_name())


def segment_number(file: Column) -> Column:
    """The number at the end of a segment's name: run_0042.00007.parquet is 7."""
    return F.regexp_extract(file, r"[._](\d+)(?:\.[A-Za-z]+)*$", 1).try_cast("bigint")


def missing_segments(numbers: DataFrame, column: str) -> DataFrame:
    """Numbers between the smallest and the largest that no segment has."""
    span = numbers.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).where("lo IS NOT NULL")
    every = span.select(F.explode(F.sequence("lo", "hi")).alias(column))
    return every.join(numbers.select(column).distinct(), column, "left_anti")


def concat(*tables: DataFrame) -> DataFrame:
    """All rows of tables whose columns may differ."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def every_nth(df: DataFrame, order: str, n: int) -> DataFrame:
    """Rows whose number is a multiple of n: the sampling of a quick look."""
    return df.where(F.col(order) % n == 0)


def write_run(df: DataFrame, path: str, run: str = "run_number", segment: str = "segment") -> None:
    """One folder per run and segment, so that later reads prune by run."""
    df.write.mode("overwrite").partitionBy(run, segment).parquet(path)


def write_table_text(df: DataFrame, path: str, separator: str = "\t") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", separator).csv(path)


def report_json(summary: DataFrame) -> DataFrame:
    """One JSON object per row, for a report file."""
    return summary.select(F.to_json(F.struct(*summary.columns)).alias("value"))


def read_gains(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace columns: name, monitor peak, sigma and chi2, three gains; comments and short lines are skipped."""
    line = F.split(F.trim(F.col("value")), r"\s+")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(line.alias("c")).where(F.size("c") >= len(GAIN_COLUMNS))
    return rows.select(F.get("c", F.lit(0)).alias("name"), *[F.get("c", F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(GAIN_COLUMNS) if i])


def write_gains(gains: DataFrame, path: str) -> None:
    gains.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in GAIN_COLUMNS]).alias("value")).write.mode("overwrite").text(path)


def strip_comments(text: str) -> str:
    """JSON with // and /* */ comments (outside strings) to plain JSON."""
    return re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)


def flatten_json(df: DataFrame, key: str, text: str, depth: int = 6) -> DataFrame:
    """key, path, value: the leaves of JSON objects by dotted path; objects and arrays below `depth` and
    empty ones are leaves."""
    level = df.select(key, F.lit("").alias("path"), F.try_parse_json(F.col(text)).alias("v")).where("v IS NOT NULL")
    leaves = None
    for d in range(depth + 1):
        kind = F.schema_of_variant("v")
        nested = kind.startswith("OBJECT<") & (F.col("v").cast("string") != "{}") if d < depth else F.lit(False)
        flat = level.where(~nested).select(key, F.ltrim(F.col("path"), F.lit(".")).alias("path"), F.col("v").cast("string").alias("value"))
        leaves = flat if leaves is None else leaves.unionByName(flat)
        if d == depth:
            break
        inner = level.where(nested).select(key, "path", F.explode(F.from_json(F.to_json("v"), "map<string,string>")).alias("k", "s"))
        typed = F.coalesce(F.try_parse_json("s"), F.try_parse_json(F.to_json(F.array("s")).substr(F.lit(2), F.length(F.to_json(F.array("s"))) - 2)))
        level = inner.select(key, F.concat_ws(".", "path", "k").alias("path"), typed.alias("v"))
    return leaves


MODULES = "n string, t string, geo struct<x double, y double, sx double, sy double>, daq struct<crate int, slot int, channel int>"


def read_modules(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of modules: name, type, position and size, readout address (null where there is none)."""
    m = spark.read.option("multiLine", True).option("allowComments", True).schema(MODULES).json(path)
    return m.select(F.col("n").alias("name"), F.col("t").alias("type"), "geo.x", "geo.y", "geo.sx", "geo.sy", "daq.crate", "daq.slot", "daq.channel")


def read_pedestals(spark: SparkSession, path: str) -> DataFrame:
    """Text lines `crate slot channel mean rms`; other lines are skipped."""
    c = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(c.alias("c")).where(F.size("c") == 5)
    num = lambda i, kind, name: F.get("c", F.lit(i)).try_cast(kind).alias(name)
    out = rows.select(num(0, "int", "crate"), num(1, "int", "slot"), num(2, "int", "channel"), num(3, "double", "mean"), num(4, "double", "rms"))
    return out.where("crate IS NOT NULL AND slot IS NOT NULL AND channel IS NOT NULL AND mean IS NOT NULL")


def remap(df: DataFrame, column: str, table: dict[int, int]) -> DataFrame:
    """Replace values of a column by a small table; the others stay."""
    if not table:
        return df
    pairs = F.create_map(*[F.lit(v) for kv in sorted(table.items()) for v in kv])
    return df.withColumn(column, F.coalesce(F.try_element_at(pairs, F.col(column)), F.col(column)))


_LAST_COMMA = re.compile(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', re.S)


def parse_config(text: str) -> object:
    """JSON with comments (// to the line's end, /* */) and commas after the last item."""
    keep = lambda m: m[1] or " "
    return json.loads(_LAST_COMMA.sub(keep, strip_comments(text)))


def read_config(spark: SparkSession, path: str) -> object:
    """A configuration file, which is small, from any store that Spark reads."""
    return parse_config(spark.read.text(path, wholetext=True).first().value)
