"""Rows of exports: items, candidate datasets and relevant crawled pages, with their fixed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of an item's export, in order, and where each comes from.
ITEM_TEXTS = ("job_id", "source_job_id", "source_item_id", "source_row_number", "row_number", "input_url", "normalized_url", "final_url", "title", "status", "ugc_detected")
BEST = {"confidence": "best_confidence", "ugc_type": "best_ugc_type", "score": "best_score", "xpath": "best_xpath", "css_path": "best_css_path", "sample_text": "best_sample_text"}
REVIEWS = {"candidate_review_count": "total", "candidate_comment_region_reviews": "comment_region", "candidate_not_comment_reviews": "not_comment_region", "candidate_uncertain_reviews": "uncertain"}
SCAN = ("candidate_selection_mode", "candidate_selection_limit", "candidate_review_artifact_limit", "candidate_heuristic_summary", "heuristic_best_candidate_key", "heuristic_best_candidate_label", "heuristic_best_candidate_reason")
CAPTURE = (
    "analysis_source", "manual_capture_required", "manual_capture_reason", "manual_capture_mode", "manual_html_url", "manual_raw_html_url", "manual_capture_url", "manual_captured_at", "manual_uploaded_screenshot_url", "manual_uploaded_screenshot_path", "screenshot_url", "screenshot_path",
)
ACCESS = ("blocked_by_interstitial", "blocker_type", "access_reason", "frame_count")
LAST = ("created_at", "updated_at", "completed_at", "error_message")
ITEM_FIRST = ["job_id", "row_number", "input_url", "normalized_url", "final_url", "title", "status"]
#: Columns of a dataset's export that come before its features.
DATASET = [
    "dataset_row_id", "job_id", "item_id", "row_number", "candidate_key", "candidate_rank", "normalized_url", "final_url", "hostname", "frame_url", "frame_host", "analysis_source", "manual_captured_at", "item_status", "item_ugc_detected", "candidate_screenshot_url",
    "item_screenshot_url", "item_manual_uploaded_screenshot_url", "human_label", "binary_label", "review_complete_binary", "item_positive_label_count", "item_negative_label_count", "sample_text", "score", "confidence", "ugc_type",
]
CRAWL = ["url", "title", "depth", "relevance_score", "matched_categories"]


def _member(df: DataFrame, path: str) -> Column:
    """A column or a member of a struct, as it is; null where the frame has none."""
    name, _, rest = path.partition(".")
    kinds = dict(df.dtypes)
    if name not in kinds:
        return F.lit(None).cast("string")
    if rest:
        fields = df.schema[name].dataType
        return F.col(path) if rest in getattr(fields, "names", ()) else F.lit(None).cast("string")
    return F.col(f"`{name}`")


def _shown(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def item_records(items: DataFrame) -> DataFrame:
    """One row an item, all values as text and nothing where there is none: 49 columns.

    ``items`` may lack any column; candidates is an array, scan_result and candidate_review_summary
    are structs.
    """
    of = {name: name for name in ITEM_TEXTS} | BEST
    out = {name: _shown(_member(items, path)) for name, path in of.items()}
    out["candidate_count"] = F.when(_member(items, "candidates").isNull(), "0").otherwise(F.size("candidates").cast("string")) if "candidates" in items.columns else F.lit("0")
    out |= {name: _shown(_member(items, f"candidate_review_summary.{path}")) for name, path in REVIEWS.items()}
    out |= {name: _shown(_member(items, f"scan_result.{name}")) for name in SCAN}
    out |= {name: _shown(_member(items, name)) for name in CAPTURE}
    out |= {name: _shown(_member(items, f"scan_result.{name}")) for name in ACCESS}
    out |= {name: _shown(_member(items, name)) for name in LAST}
    return items.select(*(c.alias(name) for name, c in out.items()))


def dataset_records(rows: DataFrame, features: list[str]) -> DataFrame:
    """Candidate rows for CSV: the fixed columns, then the features of the catalog, all as text."""
    return rows.select(*(_shown(_member(rows, c)).alias(c) for c in [*DATASET, *features]))


def crawl_records(pages: DataFrame, least: float = 0.0) -> DataFrame:
    """Relevant pages (url, title, depth, relevance_score, matched_categories: array) of at least a score, for the next scan."""
    kept = pages.where(F.col("is_relevant") & (F.coalesce("relevance_score", F.lit(0.0)) >= least))
    return kept.select("url", F.coalesce("title", F.lit("")).alias("title"), "depth", "relevance_score", F.array_join(F.coalesce("matched_categories", F.array().cast("array<string>")), "|").alias("matched_categories"))
