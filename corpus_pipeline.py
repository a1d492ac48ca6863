"""A training-data pipeline over documents, from quality to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on everything its predecessor kept. All but the
last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import line_dedup, mixing, ngram_join, packing, quality_crf
from lexweave.llm.common import settle, shared_folder, table
from lexweave.llm.queries import tokenizer_path

#: Of the tokens that are left, this share is taken, by weight; no document is taken twice.
MIX = mixing.MixPlan(weights=mixing.PLAN.weights, budget_share=0.9, max_epochs=1, seed=7)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, doesn't reject."""
    model = quality_crf.fit(docs, table(spark, sf_dir, "labels"))
    return quality_crf.score_documents(docs, model).where("predicted = 1").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones; n_chars counts what is left."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: one of the least id. Rows are numbered, as ids may come more than once."""
    rows = settle(docs.withColumn("_row", F.monotonically_increasing_id()))
    found = ngram_join.jaccard_components(rows.where("doc_id is not null").select(F.col("_row").alias("doc_id"), "text"))
    # Texts without words link with nothing; of one id one stays.
    group = [F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("component"), F.when(F.col("n_shingles") == 0, F.col("doc_id")).alias("empty")]
    placed = found.withColumnRenamed("doc_id", "_row").join(rows.select("_row", "doc_id"), "_row")
    kept = placed.groupBy(*group).agg(F.min(F.struct("doc_id", "_row")).alias("least")).select("least._row")
    return rows.join(kept, "_row", "left_semi").select(*docs.columns).union(rows.where("doc_id is null").select(*docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mixture takes of each source; where it takes a document in part, the text is cut there, and n_chars with it.

    Empty and null texts that the prefix passes come along; repeated rows are documents of their own.
    """
    taken = mixing.mix(docs, MIX).where("taken > 0 or tokens = 0")
    text = F.when(F.col("taken") < F.col("tokens"), mixing.cut_to(F.col("text"), F.col("taken"))).otherwise(F.col("text"))
    chars = F.when(F.col("taken") < F.col("tokens"), F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return taken.withColumns({"text": text, "n_chars": chars}).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents in sequences of 1024."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: The classifier and the tokenizer can't be written in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
