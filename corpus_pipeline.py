"""From raw documents to packed training sequences: five stages, each an operator of the library.

    language    documents that no learned language codes go: no letter, no text, letters of other scripts
    toxicity    documents that score as toxic go
    exact       of equal texts, the row with the largest doc_id stays
    near        of each class of near copies, the document with the smallest doc_id stays
    packing     what is left becomes sequences of at most 4096 tokens

Every stage but the last returns the columns of documents, and works on all that its predecessor kept.

Defined cases: null and empty texts go in the first stage; where several rows share the doc_id and text
that stay, `exact` keeps the one whose other columns have the smallest hash, so one row whatever the
order; where rows of one class share the doc_id that stays, `near` keeps the one whose text has the
smallest hash; rows without a doc_id pass `near`, which can't name one of them to stay, unless their
class has a doc_id; an empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamframe.llm import bayes_jaccard, cross_parsing, exact_dedup, packing, toxicity
from beamframe.llm.common import delete_path, fold_columns, id_fold, scratch_path, scratch_scope, table, unfold_columns


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sample = cross_parsing.training_sample(docs, id_fold("doc_id", 5) != 0)
    folded = fold_columns(docs)
    judged = cross_parsing.predict_languages(folded, sample, keep=folded.columns)
    return unfold_columns(judged.where(~F.col("rejected")), docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cfg = toxicity.ToxicityConfig()
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), id_fold("doc_id", 3) != 1, cfg)
    folded = fold_columns(docs)
    scored = model.score(folded, folded.columns)
    return unfold_columns(scored.where(F.col("score") < cfg.threshold), docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    stay = exact_dedup.exact_dedup(docs).where("kept").select(F.col("doc_id").alias("stay_id"), F.col("text_sha256").alias("stay_sha")).distinct()
    rows = fold_columns(docs).withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    met = rows.join(stay, rows.doc_id.eqNullSafe(stay.stay_id) & (rows.text_sha256 == stay.stay_sha), "left_semi")
    others = [c for c in met.columns if c not in ("doc_id", "text_sha256")]
    one = met.groupBy("doc_id", "text_sha256").agg(F.min_by(F.struct(*others), F.xxhash64(*others)).alias("_row"))
    return unfold_columns(one.select("doc_id", "_row.*"), docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = bayes_jaccard.similarity_classes(docs).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    named = classes.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("text_hash").alias("text_hash"))
    stay = named.unionByName(classes.where("doc_id IS NULL").select("doc_id", "text_hash").distinct()).select(F.col("doc_id").alias("stay_id"), F.col("text_hash").alias("stay_hash"))
    return docs.join(stay, docs.doc_id.eqNullSafe(stay.stay_id) & (F.xxhash64(docs.text) == stay.stay_hash), "left_semi")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("language", language), ("toxicity", toxic), ("exact", exact), ("near", near), ("packing", pack)]
#: the stages learn, hash and tokenize, which SQL can't express; tests compare them with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        before, path = path, scratch_path(spark, f"stage-{name}")
        with scratch_scope():  # what a stage writes for itself goes when its result is written
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            delete_path(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
