"""Jobs, items and events: state changes as DataFrame to DataFrame, summaries, search and paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.functions.text import search_terms
from agora.session import written


def status_ladder(total: Column, pending: Column, queued: Column, running: Column, completed: Column, failed: Column) -> Column:
    """A job's status from its items' counts; a job without items is pending."""
    done = completed + failed
    return (
        F.when(total == 0, "pending")
        .when((done == total) & (failed == total), "failed")
        .when((done == total) & (failed > 0), "completed_with_errors")
        .when(done == total, "completed")
        .when((running > 0) | (completed > 0) | (failed > 0), "running")
        .when(queued > 0, "queued")
        .otherwise("pending")
    )


def recomputed(items: DataFrame, job: str = "job_id", status: str = "status", detected: str = "ugc_detected") -> DataFrame:
    """Counts and status of each job from its items, summed before the shuffle."""
    count = lambda s: F.count_if(F.col(status) == s)
    out = items.groupBy(job).agg(
        F.count("*").alias("total_urls"),
        *(count(s).alias(f"{s}_count") for s in ("pending", "queued", "running", "completed", "failed")),
        F.count_if(F.coalesce(F.col(detected), F.lit(False))).alias("detected_count"),
    )
    return out.withColumn("status", status_ladder(F.col("total_urls"), *(F.col(f"{s}_count") for s in ("pending", "queued", "running", "completed", "failed"))))


def label_summary(jobs: DataFrame, reviews: DataFrame, job: str = "job_id") -> DataFrame:
    """Every job with its counts of positive and negative labels by source; summed up, then joined."""
    is_ = lambda label, inferred: F.count_if((F.col("label") == label) & ((F.col("source") == "inferred") == inferred))
    counts = reviews.groupBy(job).agg(
        is_("comment_region", False).alias("human_positive"),
        is_("not_comment_region", False).alias("human_negative"),
        is_("comment_region", True).alias("inferred_positive"),
        is_("not_comment_region", True).alias("inferred_negative"),
    )
    return jobs.join(counts, job, "left").na.fill(0, ["human_positive", "human_negative", "inferred_positive", "inferred_negative"])


def item_filter(detected: bool | None = None, labeled: bool | None = None, status: str | None = None) -> Column:
    """The item listing's predicate; an unknown detection counts as not detected."""
    parts = [F.lit(True)]
    if status is not None:
        parts.append(F.col("status") == status)
    if detected is not None:
        parts.append(F.coalesce(F.col("ugc_detected"), F.lit(False)) == detected)
    if labeled is not None:
        parts.append((F.size(F.coalesce("candidate_reviews", F.array())) > 0) == labeled)
    return reduce(Column.__and__, parts)


def search(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows in which each term of the query stands in some column, whatever the case."""
    found = F.lit(True)
    for term in search_terms(query):
        found = found & reduce(Column.__or__, (F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(term.lower()) for c in columns))
    return df.where(found)


def search_joined(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows whose columns, joined by blanks, hold every term."""
    hay = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))
    return df.where(reduce(Column.__and__, (hay.contains(t.lower()) for t in search_terms(query)), F.lit(True)))


def page(df: DataFrame, order: list[Column], limit: int = 100, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, limit))


def claimed(items: DataFrame, most: int, job: str = "job_id", order: str = "row_number") -> DataFrame:
    """The lowest pending rows of each job, at most ``most``."""
    ranked = items.where("status = 'pending'").withColumn("_rank", F.row_number().over(Window.partitionBy(job).orderBy(order)))
    return ranked.where(F.col("_rank") <= most).drop("_rank")


def appended_once(events: DataFrame, fresh: DataFrame) -> DataFrame:
    """Events and fresh ones; of those with equal non-null (job_id, event_key) the first stays, those without key all do."""
    both = events.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    keyed = both.where("event_key IS NOT NULL")
    first = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("job_id", "event_key").orderBy("_new", "created_at", "id"))).where("_rank = 1").drop("_rank")
    return first.unionByName(both.where("event_key IS NULL")).drop("_new")


def upserted(table: DataFrame, fresh: DataFrame, key: list[str], order: str) -> DataFrame:
    """The table with fresh rows in the place of those with the same key; of several the latest."""
    both = table.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(*key).orderBy(F.col("_new").desc(), F.col(order).desc())
    return both.withColumn("_rank", F.row_number().over(last)).where("_rank = 1").drop("_rank", "_new")


def inserted_if_absent(table: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    return table.unionByName(fresh.join(table.select(*key), key, "left_anti").dropDuplicates(key))


def stale_failed(items: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Rows that have run or waited for longer than that are failed."""
    stale = F.col("status").isin("running", "queued") & (F.col("updated_at") < now - F.make_interval(mins=F.lit(minutes)))
    return items.withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows numbered from 1 over ``order``: dealt by ranges, numbered within each, shifted by what came before.

    No task holds more than a range; only the ranges' sizes come together.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = written(spread.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    ahead = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    return held.withColumn("_part", part).join(F.broadcast(ahead), "_part").withColumn("row_number", at + 1 + F.col("_ahead")).drop("_id", "_part", "_ahead")


def combined(parts: list[DataFrame], order: list[str]) -> DataFrame:
    """Items of several jobs as one, numbered anew by job order, then ``order``."""
    both = reduce(DataFrame.unionByName, [p.withColumn("source_ord", F.lit(k)) for k, p in enumerate(parts)])
    return numbered(both, ["source_ord", *order])


def resumed(items: DataFrame) -> DataFrame:
    """Failed rows back to pending without results."""
    failed = F.col("status") == "failed"
    return items.withColumns({"attempts": F.when(failed, 0).otherwise(F.col("attempts")), "error_message": F.when(~failed, F.col("error_message"))}).withColumn("status", F.when(failed, "pending").otherwise(F.col("status")))


def refill(pending: Column, inflight: Column, target: Column) -> Column:
    return F.least(pending, F.greatest(F.lit(0), target - inflight))


def chunk_of(row: Column, size: int = 10_000) -> Column:
    return F.floor((row - 1) / size)


def kept_last(df: DataFrame, key: list[str], order: list[Column], most: int) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_rank") <= most).drop("_rank")


def hotspots(log: DataFrame, key: list[str], failed: Column, running: Column, millis: str = "duration_ms", at: str = "started_at") -> DataFrame:
    """Counts, errors, running ones, times and the last entry of each group of log lines."""
    return log.groupBy(*key).agg(
        F.count("*").alias("calls"),
        F.count_if(running).alias("active"),
        F.count_if(failed).alias("errors"),
        F.sum(millis).alias("total_ms"),
        F.max(millis).alias("max_ms"),
        F.avg(millis).alias("avg_ms"),
        F.max(at).alias("last_seen"),
    )
