"""A corpus pipeline of five stages over ``documents``; each stage reads what the one before wrote.

Verdicts are joined back by doc_id and a hash of what they were reached from, so that each row has
its own, even where rows share a doc_id or have none.  Repeated rows share a verdict: they pass the
filters together, and of a near-duplicate group one row alone stays.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.llm import packing, pii, quality, simhash, toxicity
from agora.llm.common import row_hash, shared_dir, table, written


def _rows(docs: DataFrame, judged: DataFrame, *read: str, how: str) -> DataFrame:
    """The rows of ``docs`` that are (left_semi) or are not (left_anti) among ``judged`` (doc_id, row)."""
    found = judged.distinct().select(F.col("doc_id").alias("_doc_id"), F.col("row").alias("_row"))
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_doc_id"]) & (row_hash(*read) == found["_row"]), how)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what fails the base rules or lies outside its language's perplexity band.

    Null and empty texts fail; texts of any length are read whole; repeated rows have one verdict; a
    text on a bound of its band stays; other columns, whatever their names, are carried and not
    read; an empty table stays empty.
    """
    judged = quality.judge(docs.withColumn("row", row_hash("lang")), "row")
    return _rows(docs, judged.where("NOT kept").select("doc_id", "row"), "lang", how="left_anti")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the classifier predicts to be toxic.

    Null and empty texts stay; texts of any length are scored whole; repeated rows have one verdict;
    a score of exactly the threshold counts as toxic; other columns, whatever their names, are
    carried and not read; an empty table stays empty.
    """
    judged = toxicity.judge(docs.withColumn("row", row_hash()), table(spark, sf_dir, "labels"), "row")
    return _rows(docs, judged.where("predicted = 1").select("doc_id", "row"), how="left_anti")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of similar texts: one of the least doc_id, rows without doc_id last.

    Null and empty texts are one group; of repeated rows one stays; of rows with equal doc_id and
    other texts the one of the least hash; texts of any length are compared whole; other columns,
    whatever their names, are carried and not read; an empty table stays empty.
    """
    first = written(simhash.similar(docs, words=5).where("first").groupBy("doc_id", "row").agg(F.count("*").alias("n")), "kept")
    kept = _rows(docs, first.select("doc_id", "row"), how="left_semi")
    several = first.where("n > 1").select("doc_id", "row")
    if several.isEmpty():
        return kept
    once = _rows(kept, several, how="left_semi").dropDuplicates(["doc_id", "text"])
    return _rows(kept, several, how="left_anti").unionByName(once)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts tags in the place of personal data.

    Null texts stay null; texts of any length are read whole; repeated rows stay, alike; of spans
    that overlap the first, then the longer, names the tag; other columns, whatever their names, are carried and not read; an
    empty table stays empty.
    """
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 ids.

    Null texts are empty; texts of any length are cut into as many pieces as they need; repeated
    rows each have their own; of plans of one cost the order of positions decides; other columns are
    not read, whatever their names; an empty table gives no pieces.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, size=2048)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic),
    ("SimHash near-dedup", near_dedup),
    ("PII", personal_data),
    ("packing", packed),
]

#: Classifiers, language models and tokenizers are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
