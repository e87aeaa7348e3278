"""Token counts as delta-maintained rollups.

Changes to a corpus arrive as batches of signed events: an insert adds a document's count, a delete
takes it back, a revision carries the old and the new count (and keys, if they change). A batch is
reduced to additive deltas by source, language and tokenizer version, with map-side combining, and
committed once under its batch id. Deltas are written to a folder of their own; the commit is an empty
file whose name tells the batch and that folder, so it is there or not, whole, and one listing tells all
commits without opening any. Only folders named by commits are read, and of several commits of one batch
(writers that did not know of each other, or came again) one: they hold the same deltas. Totals are the sum
of the committed deltas, so the order of batches does not matter, and a retried, repeated or cut-off batch
changes nothing; a writer that dies, at any point, leaves nothing to be mended.

`compact` sums all commits into a base, with a table of the batches that it holds, and then deletes what the
base has taken over. Readers take the newest base and the commits that are not in it. One process compacts
at a time; commits may go on meanwhile.

Defined cases: a null source, language or version is a key of its own; a null count or text counts as
0 tokens (the document still counts); an op that is null or unknown raises; repeated rows count each;
totals that reach zero documents and tokens are left out; an empty batch commits and adds nothing; deltas
without a commit (their writer died) are not read; extra columns are ignored."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from beamframe.llm.chunked_bpe import check_vocab
from beamframe.llm.common import small_batches
from beamframe.llm.word_bpe import default_vocab, word_cache
from beamframe.plans.scratch import delete_path, file_system

KEYS = ["source", "lang", "tokenizer_version"]
DELTAS = "source string, lang string, tokenizer_version string, docs bigint, tokens bigint"
EVENTS = "op string, source string, lang string, tokenizer_version string, n_tokens bigint, old_source string, old_lang string, old_tokenizer_version string, old_n_tokens bigint"


def count_tokens(docs: DataFrame, vocab: str | None = None, keep: Column | None = None) -> DataFrame:
    """docs(doc_id, text, source, lang) -> doc_id, source, lang, kept (the long column `keep`), n_tokens; whole texts."""
    path = vocab or default_vocab()
    check_vocab(path)
    small_batches(docs.sparkSession)
    schema = StructType([docs.schema["doc_id"]]).add("source", "string").add("lang", "string").add("kept", "long").add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_cache(path)
        for b in batches:
            n = np.array([len(words.encode(t.as_py() or "")) // 2 for t in b.column(4)], np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(n)], schema.names)

    kept = (keep if keep is not None else F.lit(None)).cast("bigint").alias("kept")
    return docs.select("doc_id", F.col("source").cast("string"), F.col("lang").cast("string"), kept, "text").mapInArrow(run, schema)


def deltas(events: DataFrame) -> DataFrame:
    """Additive deltas of a batch of events (op insert, delete or revise; old_* only for revise)."""
    plus = F.struct(*KEYS, F.lit(1).alias("docs"), F.coalesce("n_tokens", F.lit(0)).alias("tokens"))
    minus = F.struct(*KEYS, F.lit(-1).alias("docs"), (-F.coalesce("n_tokens", F.lit(0))).alias("tokens"))
    old = F.struct(*[F.col(f"old_{k}").alias(k) for k in KEYS], F.lit(-1).alias("docs"), (-F.coalesce("old_n_tokens", F.lit(0))).alias("tokens"))
    unknown = F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))).cast("array<struct<source:string,lang:string,tokenizer_version:string,docs:int,tokens:bigint>>")
    signed = F.when(F.col("op") == "insert", F.array(plus)).when(F.col("op") == "delete", F.array(minus)).when(F.col("op") == "revise", F.array(old, plus)).otherwise(unknown)
    return events.select(F.explode(signed).alias("d")).groupBy(*[F.col(f"d.{k}").alias(k) for k in KEYS]).agg(F.sum("d.docs").alias("docs"), F.sum("d.tokens").alias("tokens"))


class TokenRollup:
    """A store of committed deltas in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def _checked(batch_id: str) -> str:
        if not re.fullmatch(r"[\w.-]+", batch_id):
            raise ValueError(f"batch id {batch_id!r} is not a plain name")
        return batch_id

    def _listed(self) -> tuple[str | None, dict[str, list[str]]]:
        """The newest base, and batch id -> folders of its deltas, from the names of the commits."""
        folder, fs = file_system(self.spark, f"{self.path}/commits")
        bases, batches = [], {}
        for status in fs.listStatus(folder) if fs.exists(folder) else []:
            kind, _, rest = status.getPath().getName().partition("~")
            if m := re.fullmatch(r"(.+)~([0-9a-f]{32})\.commit", rest):
                if kind == "base":
                    bases.append((int(m[1]), rest.removesuffix(".commit")))
                else:
                    batches.setdefault(m[1], []).append(rest.removesuffix(".commit"))
        return max(bases, default=(0, None))[1], {b: sorted(f) for b, f in batches.items()}

    def _mark(self, name: str) -> None:
        marker, fs = file_system(self.spark, f"{self.path}/commits/{name}.commit")
        fs.mkdirs(marker.getParent())
        fs.create(marker, False).close()

    def _in_base(self, base: str | None) -> DataFrame:
        return self.spark.read.schema("batch string").parquet(f"{self.path}/bases/{base}/batches") if base else self.spark.createDataFrame([], "batch string")

    def committed(self, batch_id: str) -> bool:
        base, batches = self._listed()
        return self._checked(batch_id) in batches or not self._in_base(base).where(F.col("batch") == batch_id).isEmpty()

    def commit(self, batch_id: str, events: DataFrame) -> bool:
        """Apply a batch once; False if it was there already. A crash before the marker leaves nothing."""
        if self.committed(batch_id):
            return False
        name = f"{batch_id}~{uuid.uuid4().hex}"
        deltas(events).write.parquet(f"{self.path}/deltas/{name}")
        self._mark(f"batch~{name}")
        return True

    def _committed(self, base: str | None, batches: dict[str, list[str]]) -> tuple[DataFrame, list[str]]:
        """All committed deltas, and the batches among them that the base doesn't hold."""
        listed = self.spark.createDataFrame([(b,) for b in batches], "batch string")
        new = sorted(r.batch for r in listed.join(self._in_base(base), "batch", "left_anti").collect()) if base and batches else sorted(batches)
        folders = [f"{self.path}/deltas/{batches[b][0]}" for b in new] + ([f"{self.path}/bases/{base}/totals"] if base else [])
        rows = self.spark.read.schema(DELTAS).parquet(*folders) if folders else self.spark.createDataFrame([], DELTAS)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0"), new

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, docs, tokens over all committed batches."""
        return self._committed(*self._listed())[0]

    def compact(self) -> None:
        """Put all commits into a new base, then delete their files and the bases before."""
        base, batches = self._listed()
        rows, new = self._committed(base, batches)
        name = f"{int(base.split('~')[0]) + 1 if base else 1}~{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/bases/{name}/totals")
        self._in_base(base).unionByName(self.spark.createDataFrame([(b,) for b in new], "batch string")).coalesce(1).write.parquet(f"{self.path}/bases/{name}/batches")
        self._mark(f"base~{name}")
        for folder in (f for b in batches.values() for f in b):
            delete_path(self.spark, f"{self.path}/commits/batch~{folder}.commit")
            delete_path(self.spark, f"{self.path}/deltas/{folder}")
        if base:
            delete_path(self.spark, f"{self.path}/commits/base~{base}.commit")
            delete_path(self.spark, f"{self.path}/bases/{base}")


def events_of(counts: DataFrame, op: str, version: str, n_tokens: str | Column = "n_tokens", old_version: str | None = None, old_n_tokens: Column | None = None) -> DataFrame:
    """counts(source, lang, count columns) as events of one kind; the old keys of a revision are the same
    source and language."""
    revised = op == "revise"
    n = F.col(n_tokens) if isinstance(n_tokens, str) else n_tokens
    text = lambda c: (c if revised else F.lit(None)).cast("string")
    return counts.select(
        F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("tokenizer_version"), n.cast("bigint").alias("n_tokens"),
        text(F.col("source")).alias("old_source"), text(F.col("lang")).alias("old_lang"), text(F.lit(old_version or version)).alias("old_tokenizer_version"),
        (old_n_tokens if old_n_tokens is not None else F.lit(None)).cast("bigint").alias("old_n_tokens"),
    )


def maintain(store: TokenRollup, docs: DataFrame, version: str, vocab: str | None = None) -> DataFrame:
    """A corpus' life in the store: documents are inserted with a rough count (characters / 4), each is
    revised to its true count, and what was inserted under another version is deleted again. The
    second batch is delivered again, as after a retry, and once more after the store was compacted. Only true
    counts of `version` are left."""
    rough = docs.select("source", "lang", F.floor(F.coalesce(F.length("text"), F.lit(0)) / 4).alias("rough"))
    counts = count_tokens(docs, vocab, keep=F.floor(F.coalesce(F.length("text"), F.lit(0)) / 4))
    store.commit("load", events_of(rough, "insert", "rough", "rough"))
    store.commit("load-again", events_of(rough, "insert", version, "rough"))
    revised = events_of(counts, "revise", version, "n_tokens", version, F.col("kept"))
    store.commit("count", revised)
    store.commit("count", revised)
    store.compact()
    store.commit("count", revised)
    store.commit("withdraw", events_of(rough, "delete", "rough", "rough"))
    return store.totals()
