"""Reviews of candidates as tables: the last word counts, empty labels take a review back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The labels that a review may have.
LABELS = ("comment_region", "not_comment_region", "uncertain")


def summary(reviews: DataFrame, key: list[str]) -> DataFrame:
    """Total and count of each label; other labels count in the total only."""
    return reviews.groupBy(*key).agg(F.count("*").alias("total"), *(F.count_if(F.coalesce(F.col("label") == x, F.lit(False))).alias(x) for x in LABELS))


def folded(log: DataFrame, key: list[str], order: str, keeps: list[str] = ()) -> DataFrame:
    """The reviews that a log of them (key, label, ``order``) leaves: the last of each key, none if its label is empty.

    created_at is the time of the first review since one was last taken back; columns of ``keeps``
    fall back to their last value that is not empty in that run.
    """
    empty = F.coalesce(F.col("label"), F.lit("")) == ""
    cut = log.groupBy(*key).agg(F.max(F.when(empty, F.col(order))).alias("_cut"), F.max(order).alias("_last"))
    run = log.join(cut, key).where(~empty & (F.col("_cut").isNull() | (F.col(order) > F.col("_cut"))))
    kept = [F.max_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(order))).alias(c) for c in keeps]
    return run.groupBy(*key).agg(F.max_by("label", order).alias("label"), *kept, F.min(order).alias("created_at"), F.max(order).alias("updated_at"))


def inferred_over(reviews: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Reviews with the labels of ``found`` (key, label) put in as inferred where no person has reviewed."""
    both = reviews.join(found.select(*key, F.col("label").alias("_label")).dropDuplicates(key), key, "full")
    human = F.col("source").isNotNull() & (F.col("source") != "") & (F.col("source") != "inferred")
    put = F.col("_label").isNotNull() & ~F.coalesce(human, F.lit(False))
    return both.select(*key, F.when(put, F.col("_label")).otherwise(F.col("label")).alias("label"), F.when(put, "inferred").otherwise(F.col("source")).alias("source"))


def without_artifacts(items: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """Items whose array of structs ``column`` has null in ``fields``."""

    def cleared(c):
        for field in fields:
            c = c.withField(field, F.lit(None).cast("string"))
        return c

    return items.withColumn(column, F.transform(column, cleared))
