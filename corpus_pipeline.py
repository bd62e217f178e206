"""A corpus pipeline of five stages over ``documents``: each works on all rows that the stage before it kept.

1. quality      co-trained classifier; documents it rejects go
2. lines        fuzzy line deduplication; documents left without a line go
3. near_copies  n-gram Jaccard join; one document of each component stays
4. mix          sources mixed to target weights; a document comes as often as the mix draws it
5. pieces       SentencePiece ids of each text that is left
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import line_dedup, mixing, near_join, pieces, quality
from tessella.llm.common import quoted, read, written

#: SQL cannot express a stage that fits a model; the stages are tested one by one against brute force.
ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, taught by ``labels``, does not reject."""
    model = quality.train(docs, read(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = quality.score(docs, model)
    return scored.filter(F.col("quality_score") >= quality.REJECT).select(*quoted(docs))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the lines that no earlier line resembles, and their new lengths; those whose every line went, go."""
    out = line_dedup.dedup_lines(docs)
    left = F.col("n_dropped").eqNullSafe(0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.filter(left).withColumn("n_chars", F.char_length("text").cast("long")).select(*quoted(docs))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_join.one_of_each(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix draws, repeats as rows of their own, written shard by shard in the shuffled order."""
    return mixing.shuffled(mixing.mix(docs)).select(*quoted(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id`` and the pieces of its text."""
    model = pieces.Model.load()
    return pieces.encode(docs.select("doc_id", "text"), model).select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"))


STAGES = [
    ("quality", good_documents),
    ("lines", distinct_lines),
    ("near_copies", one_of_near_copies),
    ("mix", mixed_sources),
    ("pieces", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
