"""From raw documents to packed training sequences.

Each stage is one operator of ``meshloom.llm`` on what the stage before it kept. A stage gets
``docs`` with the columns of ``documents`` and returns them; the last returns packed pieces. Between
stages the rows are written as Parquet in the shared folder and read again, so a lost
executor costs a stage's tasks, never the stages before. Nulls, empty and repeated rows are
treated as each operator's docstring says; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.llm.jaccard_join import Join, one_of_each_group, with_group
from meshloom.llm.line_dedup import drop_site_lines, line_keys
from meshloom.llm.mixing import mixed_documents
from meshloom.llm.packing import pack_documents, vocabulary_path
from meshloom.llm.quality import THRESHOLD, fit_quality, with_quality
from meshloom.session import store_once

#: What the pipeline takes for near copies.
NEAR = Join(words=5, num=4, den=5)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose compression score reaches the threshold; the labels are those of the corpus."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_quality(docs, model).filter(F.col("score") >= THRESHOLD).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; n_chars follows the text where lines went.

    Texts that the join would group count as one page, so that near copies don't turn their own text into boilerplate.
    """
    n_chars = F.when(F.col("dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    # The lines are hashed before groups are joined, so no text is moved.
    lines = F.array_distinct(line_keys(F.col("text"))).alias("_lines")
    near = with_group(docs.select("doc_id", "text", F.col("source").alias("_host"), lines), "_page", NEAR)
    return drop_site_lines(docs, pages=near.select("_host", "_page", "_lines")).withColumn("n_chars", n_chars).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words a shingle, similarity 0.8 or more."""
    return one_of_each_group(docs, NEAR)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, by the target weights of their sources."""
    return mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their place in sequences of 2048 tokens."""
    return pack_documents(docs, vocabulary_path())


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: SQL expresses neither the classifier nor the packing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store_once(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
