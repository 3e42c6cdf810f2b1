"""A training-data pipeline over the documents table: filter, deduplicate, decontaminate, redact, pack.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the
next stage's docs.  All but the last keep the columns of documents.

Defined cases, for every stage: a null text counts as empty; texts are read whole at any length; equal rows are treated
alike; an empty table gives no rows; columns beyond those of documents stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import decontaminate, jaccard, packing, pii, quality
from sluice.llm.common import fresh, sized, table, written
from sluice.llm.queries import tokenizer_path

#: A document stays if the classifier gives it at least this chance of good quality.
KEEP_QUALITY = 0.3

#: Words a packing worker remembers and bytes it encodes at a time: less than in op9, as the stages before leave executors with a grown heap.
PACK_WORDS, PACK_SLICE = 150_000, 1 << 20


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from all labels; documents scored under KEEP_QUALITY go, a score of exactly that stays; without labels all stay."""
    weights = quality.fit(docs, table(spark, sf_dir, "labels"))
    name = fresh(docs, "quality_score")
    return quality.score(docs, weights, name).where(F.col(name) >= KEEP_QUALITY).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of five-word-shingle near duplicates (similarity 0.8 or more) the smallest doc_id stays; its repeated rows too.

    Rows are known by doc_id: all rows of an id that goes go with it; rows without an id and texts without words stay.
    """
    found = jaccard.near_duplicates(docs, n=5, percent=80)
    gone = written(found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "gone")
    return docs.join(sized(gone, 24 * gone.count()), "doc_id", "left_anti").select(*docs.columns)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts; every document stays."""
    cut = decontaminate.strip_passages(docs, table(spark, sf_dir, "benchmark"))
    return _counted(cut)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every accepted span becomes its kind in brackets; spans that overlap become one; null texts stay null, all rows stay."""
    return _counted(pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequence and place there; an empty or null text is one piece, the end id."""
    return packing.pack_documents(docs, tokenizer_path(), cache=PACK_WORDS, slice_bytes=PACK_SLICE)


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars again the length of the text, where the table has such a column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [("quality", filter_quality), ("near_duplicates", drop_near_duplicates), ("decontaminate", cut_benchmark), ("pii", redact_pii), ("packing", pack)]

#: Training, tokenizing and redaction are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
