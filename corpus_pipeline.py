"""Training-data pipeline: from raw documents to mixing rates.

quality -> line dedup -> near duplicates -> benchmark decontamination -> mixing weights. Each stage works on all that its
predecessor kept. All but the last return the columns of documents (``text`` and ``n_chars`` follow what was
removed); the last returns a rate for every document that is left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import decontaminate, jaccard_join, line_dedup, mixing, quality
from tokenloom.llm.common import shared_dir, table
from tokenloom.llm.queries import label_domains

# Shares of tokens after the quality stage, which leaves next to no document of the domain low.
TARGETS = {"good": 0.98, "toxic": 0.02}


def _with_text(docs: DataFrame, text: Column, columns: list[str]) -> DataFrame:
    docs = docs.withColumn("text", text)
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("bigint"))
    return docs.select(*columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents scored under 0.5 go."""
    field = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, field).where("score >= 0.5").select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: later copies of repeated line runs go, and documents of which nothing is left."""
    out = line_dedup.dedup(docs)
    out = out.where(~((F.col("n_removed") > 0) & ~F.col("kept").rlike(r"\S")))
    return _with_text(out, F.col("kept"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each group of near duplicates stays."""
    return jaccard_join.dedup(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: words inside occurrences of benchmark windows go, and documents of which nothing is left."""
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    out = found.withColumn("text", decontaminate.without_spans("text", "ranges"))
    out = out.where(~((F.size("ranges") > 0) & ~F.col("text").rlike(r"\S")))
    return _with_text(out, F.col("text"), docs.columns)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: doc_id, n_tokens, domain, posteriors and rate of every document."""
    out = mixing.mix(docs, label_domains(table(spark, sf_dir, "labels")), TARGETS)
    return out.select("doc_id", "n_tokens", "domain", *[F.col("p")[i].alias(f"p_{k}") for i, k in enumerate(sorted(TARGETS))], "rate")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_weights),
]

# The first stage's learned field has no SQL form; tests hold the stages against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/tokenloom-stage{k}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
