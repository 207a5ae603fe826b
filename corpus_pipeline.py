"""A training corpus from documents: toxic and poor documents go, one document of each near-copy group stays, benchmark passages are cut out, the rest is packed.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and works on all rows that the stage before it kept.  All but the last return
the columns of ``docs``.  ``run`` writes each stage's result as Parquet in the
shared folder and reads it back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import decontaminate, jaccard_join, nbsvm, packing, toxicity
from veilspark.llm.common import read, stored
from veilspark.llm.queries import tokenizer_path

#: No SQL expresses the learned stages; tests compare every stage with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the nearest labelled examples call toxic go, each by its own text."""
    return toxicity.keep_clean(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier scores under its threshold go, each by its own text."""
    return nbsvm.keep_good(docs, nbsvm.train(docs, read(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at similarity 0.8 the document of the smallest id stays; documents without words all stay.

    A document is its id: rows that share one stay or go together, and rows
    with a null id, which belong to no group, stay.
    """
    groups = jaccard_join.join(docs, size=5, num=80, den=100, counts=False)
    rejected = groups.where((F.col("component_id") != F.col("doc_id")) & (F.col("n_shingles") > 0)).select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(*docs.columns)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Verified benchmark passages are cut out of the texts; a document of nothing else goes."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_copies", drop_near_copies), ("decontamination", cut_benchmark), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
