"""From documents to packed sequences: toxicity, quality classifier, MinHash near-dedup, packing.

Every stage takes (spark, docs, sf_dir). The first three return rows of docs with the columns of documents; the last returns
the pieces of sequences. Toxicity and quality read the labels beside the documents. Near-duplicates are those of 5-word
shingles with a similarity of 0.8 or more; of each group exactly one row stays, of the smallest doc_id, and a row with a null doc_id
only where no other is in its group. Rows are told apart by doc_id and text, so that rows with one doc_id and unlike texts are judged each for
itself. Rows without words are in no group and stay.

Toxicity and packing judge each row by its text alone: a null or empty text is not toxic and is one piece of one id, repeated rows are
treated alike and packed each, and texts are taken whole, however long. The quality classifier drops null and empty texts. Intermediate tables stay in the
shared folder until barnacle.llm.common.clear() is called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barnacle.llm.common import bounded, fresh_path, stored, table
from barnacle.llm.kneser import quality_filter
from barnacle.llm.neardup import near_duplicates
from barnacle.llm.packing import pack
from barnacle.llm.toxicity import drop_toxic, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return drop_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    key, doc_id = "near_dedup_key", F.col("doc_id").cast("long")
    keyed = docs.withColumn(key, F.xxhash64(doc_id, "text"))
    found = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text")).where("n_shingles > 0").groupBy(F.col("doc_id").alias(key))
    # unlike texts that happen to share a key: none of them is judged
    found = found.agg(F.min("component_id").alias("of"), F.max("component_id").alias("last")).where("of = last").drop("last")
    rows = stored(keyed.groupBy(key).agg(F.min(doc_id).alias("id"), F.count("*").alias("n")).join(found, key))
    first = rows.groupBy("of").agg(F.min(F.struct(F.col("id").isNull(), "id", key)).getField(key).alias("first"))
    rows = stored(rows.join(first, "of").where(f"{key} <> first or n > 1").select(key, (F.col(key) == F.col("first")).alias("stays")))
    one = keyed.join(rows.where("stays"), key, "left_semi").dropDuplicates([key])  # of equal rows
    return keyed.join(rows, key, "left_anti").unionByName(one).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    bounded(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), most=1_000_000)


STAGES = [("toxicity", toxicity), ("quality classifier", quality), ("near-dedup", near_dedup), ("packing", packing)]

#: Compression lengths, a trained language model and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = fresh_path(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
