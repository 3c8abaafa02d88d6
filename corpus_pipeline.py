"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next one's docs. All
but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import scratch
from quillon.llm.bestfit_packing import pack
from quillon.llm.line_similarity_dedup import dedup_lines
from quillon.llm.mil_quality import score, train
from quillon.llm.ngram_overlap_join import one_of_each
from quillon.llm.template_decontamination import clean


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.3 or more; it learns from the labels of the documents given."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["text"])
    return score(spark, row, model).where("score >= 0.3").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that are similar to earlier ones; every document stays, n_chars follows its text."""
    scratch.sweep(spark)
    done = dedup_lines(spark, docs, percent=80).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    scratch.sweep(spark)
    return one_of_each(spark, docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    scratch.sweep(spark)
    return clean(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 1024 tokens."""
    scratch.sweep(spark)
    return pack(spark, docs, size=1024, end_id=2)


STAGES = [("quality", quality), ("line_dedup", lines), ("ngram_jaccard", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: Learned scores and the packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = uuid.uuid4().hex[:12]
    for name, stage in STAGES[:-1]:
        done = stage(spark, docs, sf_dir)
        path = f"{scratch.base(spark)}/quillon-pipeline-{own}-{name}"
        done.write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
