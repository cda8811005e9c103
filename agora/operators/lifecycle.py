"""Changes of jobs, items and crawled pages, each as a table in and a table out, and the listings over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.operators.store import numbered

#: Statuses of unfinished items and of jobs that are done, and what a crawl may change of a page.
UNFINISHED = ("pending", "queued", "running")
TERMINAL = ("completed", "completed_with_errors", "failed")
PAGE_FIELDS = ("status", "is_relevant", "relevance_score", "matched_categories", "title", "outbound_links_found", "links_followed", "http_status", "error_message", "crawled_at", "user_state")


def with_statuses(items: DataFrame, statuses: list[str]) -> DataFrame:
    """Items of a set of statuses; blank ones do not count."""
    return items.where(F.col("status").isin([s.strip() for s in statuses if s.strip()]))


def without_statuses(jobs: DataFrame, statuses: list[str]) -> DataFrame:
    return jobs.where(~F.col("status").isin(statuses))


def review_order() -> list[Column]:
    """The listing for manual review: those that need a capture first, then the latest."""
    at = F.coalesce("manual_captured_at", "completed_at", "updated_at", "created_at")
    return [F.when(F.coalesce("manual_capture_required", F.lit(False)), 0).otherwise(1), at.desc(), F.col("row_number")]


def for_review(items: DataFrame) -> DataFrame:
    """Items that need a manual capture or have one."""
    return items.where(F.coalesce("manual_capture_required", F.lit(False)) | F.coalesce(F.col("analysis_source") == "manual_snapshot", F.lit(False)))


def events_since(events: DataFrame, jobs: DataFrame, since: Column, most: int = 100) -> DataFrame:
    """Events after a time with their job's columns, newest first; 1 to 500 of them."""
    return events.where(F.col("created_at") > since).join(jobs, "job_id", "left").orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(max(1, min(500, most)))


def crawled_pages(pages: DataFrame, status: str | None = None, relevant: bool | None = None, least: float | None = None, user_state: str | None = None) -> DataFrame:
    """Pages by status, relevance, score and what a user said of them (``none``: nothing)."""
    if status:
        pages = pages.where(F.col("status") == status)
    if relevant is not None:
        pages = pages.where(F.col("is_relevant") == relevant)
    if least is not None:
        pages = pages.where(F.col("relevance_score") >= least)
    if user_state:
        pages = pages.where(F.col("user_state").isNull() if user_state == "none" else F.col("user_state") == user_state)
    return pages


def promotable(pages: DataFrame, ids: list[int] | None = None, only_training: bool = False, least: float | None = None) -> DataFrame:
    """Pages to make items of: those named, else those marked for training, else those that are relevant; of a least score."""
    chosen = F.col("id").isin(ids) if ids else F.col("include_in_training") if only_training else F.col("is_relevant")
    found = pages.where(F.coalesce(chosen, F.lit(False)))
    return found.where(F.col("relevance_score") >= least) if least and least > 0 else found


def crawl_claimed(pages: DataFrame, most: int) -> DataFrame:
    """Pending pages to fetch next, the shallowest first."""
    return pages.where("status = 'pending'").orderBy("depth", "id").limit(most)


def updated(table: DataFrame, changes: DataFrame, key: str = "id", allowed: tuple[str, ...] = PAGE_FIELDS) -> DataFrame:
    """The table with the columns of ``changes`` (key, ...) that may be changed; rows without a change stay."""
    fields = [c for c in changes.columns if c in allowed and c in table.columns]
    new = changes.select(F.col(key).alias("_key"), F.struct(*fields).alias("_new"))
    joined = table.join(new, F.col(key) == F.col("_key"), "left")
    return joined.select(*(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in table.columns))


def _named(items: DataFrame, ids: DataFrame) -> DataFrame:
    return items.join(ids.select(F.col("id").alias("_named")).distinct(), F.col("id") == F.col("_named"), "left")


def marked_running(items: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """The named items run: one attempt more, started now if they were not before."""
    mine = F.col("_named").isNotNull()
    return _named(items, ids).withColumns({"status": F.when(mine, "running").otherwise(F.col("status")), "attempts": F.col("attempts") + mine.cast("int"), "started_at": F.when(mine, F.coalesce("started_at", now)).otherwise(F.col("started_at")), "updated_at": F.when(mine, now).otherwise(F.col("updated_at"))}).drop("_named")


def marked_completed(items: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Items with the results (id, ugc_detected, best_candidate, access_reason) of their scans.

    The best candidate's score, confidence and kind stand in columns of their own; why a page gave
    nothing is the message of those without a detection.  Of several results of an item one counts.
    """
    new = results.select(F.col("id").alias("_id"), F.struct(*(c for c in results.columns if c != "id")).alias("_r")).dropDuplicates(["_id"])
    mine, r = F.col("_id").isNotNull(), lambda c: F.col(f"_r.{c}")
    put = {
        "status": F.lit("completed"),
        "ugc_detected": F.coalesce(r("ugc_detected"), F.lit(False)),
        "best_score": r("best_candidate.score"),
        "best_confidence": F.nullif(r("best_candidate.confidence"), F.lit("")),
        "best_ugc_type": F.nullif(r("best_candidate.ugc_type"), F.lit("")),
        "error_message": F.when(F.coalesce(r("ugc_detected"), F.lit(False)), "").otherwise(F.coalesce(r("access_reason"), F.lit(""))),
        "completed_at": now,
        "updated_at": now,
    }
    joined = items.join(new, F.col("id") == F.col("_id"), "left")
    return joined.withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in put.items() if c in items.columns}).drop("_id", "_r")


def marked_failed(items: DataFrame, errors: DataFrame, now: Column) -> DataFrame:
    """Items with the errors (id, error) that ended their scans; an empty one is ``Scan failed``."""
    new = errors.select(F.col("id").alias("_id"), F.coalesce(F.nullif("error", F.lit("")), F.lit("Scan failed")).alias("_error")).dropDuplicates(["_id"])
    mine = F.col("_id").isNotNull()
    put = {"status": F.lit("failed"), "error_message": F.col("_error"), "completed_at": now, "updated_at": now}
    return items.join(new, F.col("id") == F.col("_id"), "left").withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in put.items() if c in items.columns}).drop("_id", "_error")


def released(items: DataFrame) -> DataFrame:
    """Queued items that were not started are pending again."""
    return items.withColumn("status", F.when(F.col("status") == "queued", "pending").otherwise(F.col("status")))


def appended(items: DataFrame, records: DataFrame) -> DataFrame:
    """Items with records (job_id, row_number, input_url) put behind those of their jobs, pending and numbered on."""
    last = items.groupBy("job_id").agg(F.max("row_number").alias("_last"))
    order = F.row_number().over(Window.partitionBy("job_id").orderBy("row_number"))
    fresh = records.join(last, "job_id", "left").withColumn("row_number", F.coalesce("_last", F.lit(0)) + order).drop("_last").withColumn("status", F.lit("pending"))
    return items.unionByName(fresh, allowMissingColumns=True)


def reopened(jobs: DataFrame, added: DataFrame) -> DataFrame:
    """Jobs with the numbers of records (job_id, n) put behind them; those that were done are pending again."""
    joined = jobs.join(added, "job_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    done = (F.col("n") > 0) & F.col("status").isin(*TERMINAL)
    return joined.withColumns({"total_urls": F.col("total_urls") + F.col("n"), "status": F.when(done, "pending").otherwise(F.col("status"))}).drop("n")


def replaced(items: DataFrame, records: DataFrame) -> DataFrame:
    """Items with those of the records' jobs gone and the records (job_id, row_number, input_url) pending in their place."""
    jobs = records.select("job_id").distinct()
    return items.join(jobs, "job_id", "left_anti").unionByName(records.withColumn("status", F.lit("pending")), allowMissingColumns=True)


def restarted(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Items of the named jobs (job_id) as they were put in: pending, without results.  One join tells which these are."""
    held = items.join(jobs.select("job_id").distinct().withColumn("_again", F.lit(True)), "job_id", "left")
    kept = {"job_id": F.col("job_id"), "row_number": F.col("row_number"), "status": F.coalesce(F.when(F.col("_again"), "pending"), "status")}
    return held.select(*(kept[c] if c in ("job_id", "row_number") else kept[c].alias(c) if c in kept else F.col(c) if c in ("input_url", "normalized_url") else F.when(F.col("_again").isNull(), F.col(c)).alias(c) for c in items.columns))


def resumed_unfinished(items: DataFrame, salt: str) -> DataFrame:
    """Unfinished items put in anew: new ids (by a hash of the old one and ``salt``), pending, without results."""
    held = [c for c in ("job_id", "row_number", "input_url", "normalized_url") if c in items.columns]
    open_ = F.col("status").isin(*UNFINISHED)
    fresh = items.where(open_).select(F.xxhash64("id", F.lit(salt)).cast(items.schema["id"].dataType).alias("id"), *held, F.lit("pending").alias("status"))
    return items.where(~open_).unionByName(fresh, allowMissingColumns=True)


def deleted(tables: dict[str, DataFrame], jobs: DataFrame) -> dict[str, DataFrame]:
    """Tables without the rows of the named jobs (job_id): a job's items, events and targets go with it."""
    gone = jobs.select("job_id").distinct()
    return {name: df.join(gone, "job_id", "left_anti") for name, df in tables.items()}


def created(records: DataFrame, order: list[str], job_id: str) -> DataFrame:
    """Pending items of a new job, numbered from 1 in ``order``."""
    return numbered(records, order).withColumns({"job_id": F.lit(job_id), "status": F.lit("pending")})


def totals(summaries: DataFrame) -> DataFrame:
    """Sums of all jobs' label counts."""
    counts = [c for c in summaries.columns if c.startswith(("human_", "inferred_"))]
    return summaries.agg(F.count("*").alias("jobs"), *(F.sum(c).alias(c) for c in counts))


def heuristic_summary(candidates: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Counts of candidates by pseudo label (or by detection, where they have none), detected, past the gate, repeating."""
    blank = F.trim(F.coalesce("heuristic_pseudo_label", F.lit(""))) == ""
    label = F.when(blank, F.when(F.coalesce("detected", F.lit(False)), "ugc").otherwise("uncertain")).otherwise(F.trim("heuristic_pseudo_label"))
    held = candidates.withColumn("_label", label)
    return held.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("_label") == "ugc").alias("ugc"),
        F.count_if(F.col("_label") == "not_ugc").alias("not_ugc"),
        F.count_if(~F.col("_label").isin("ugc", "not_ugc")).alias("uncertain"),
        *(F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(n) for c, n in (("detected", "detected"), ("acceptance_gate_passed", "gate_passed"), ("repeated_structure_support", "repeating_structure"))),
    )


def id_list(text: Column) -> Column:
    """The distinct ids of a list by commas and blanks, in its order."""
    return F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), r"[,\s]+"), lambda x: x != ""))


def line_list(text: Column) -> Column:
    """The lines of a text that hold something, trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")


def best_candidate(candidates: Column, best: Column) -> Column:
    """Of candidates (structs) the one that ``best`` names: by key, else by both paths, else the first, else ``best`` itself."""
    by_key = F.try_element_at(F.filter(candidates, lambda c: (best["candidate_key"] != "") & (c["candidate_key"] == best["candidate_key"])), F.lit(1))
    by_path = F.try_element_at(F.filter(candidates, lambda c: c["xpath"].eqNullSafe(best["xpath"]) & c["css_path"].eqNullSafe(best["css_path"])), F.lit(1))
    first = F.try_element_at(candidates, F.lit(1))
    return F.when(best.isNull(), first).otherwise(F.coalesce(by_key, by_path, first, best))
