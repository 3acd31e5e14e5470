"""The corpus pipeline: documents that pass the quality classifier, one of each group of equal texts, one of each group
of near copies, mixed to target weights, packed into sequences.

Each stage reads all that its predecessor kept, as Parquet; all but the last return the columns of documents.

Defined results: null texts count as empty everywhere. quality scores them like any other and keeps repeated rows alike;
exact keeps one row of all empty and white-space texts, and of rows that repeat an id and a text; near keeps documents
without words and rows without an id, which link with nothing; mixing takes no document without words, and null sources
as one source; packing gives every row its pieces. Ties go to the smaller doc_id, null before any. Further columns stay,
whatever they are called, up to packing. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.common import Scratch
from doclens.llm.exact_dedup import keep_first
from doclens.llm.mixing import mixed_documents
from doclens.llm.ngram_join import keep_representatives
from doclens.llm.packing import pack_documents
from doclens.llm.quality import keep_quality
from doclens.llm.queries import quality_folds, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.3 or more by a classifier learnt from labels."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), *quality_folds(), threshold=0.3)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original, then the smallest doc_id."""
    return keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard similarity of 0.8 on five-word shingles the smallest doc_id."""
    return keep_representatives(docs, n=5, num=80, den=100)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row per pass of the schedule, whole where at least half is taken."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("quality", quality), ("exact_dedup", exact), ("ngram_join", near), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written in the shared folder and read again."""
    scratch, before = Scratch(spark, "pipeline"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)


#: No SQL: the classifier is learnt, components are iterative, tokens and packing are procedural.
ORACLE_SQL = None
QUERIES = {"pipeline": pipeline}
ORACLES: dict[str, str] = {}
