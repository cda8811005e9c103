"""Evaluation of scored rows (item_id, binary_label, probability): curves, ranks, pages, calibration.

Curves need running counts in order of probability.  A window over all rows would be one task, so
rows are counted within ranges of probability first: ``running_counts`` numbers each range and adds
what lies in the ranges above, which is exact and sorts each range alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.functions.numbers import round6, safe_divide

#: Ranges of probability whose counts are added up.
RANGES = 1024
#: Two-sided 95 % points of Student's t for 1 to 29 degrees of freedom; 1.96 beyond.
T95 = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045)


def labeled(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("binary_label").isin(0, 1))


def running_counts(rows: DataFrame, tie: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows with tp and fp: positives and negatives up to and with the row, by falling probability, then ``tie``."""
    held = labeled(rows).withColumn("_range", F.floor(F.least(F.greatest("probability", F.lit(0.0)), F.lit(1.0)) * (RANGES - 1)).cast("int"))
    sums = held.groupBy(*by, "_range").agg(F.sum("binary_label").alias("p"), F.count("*").alias("n"))
    above = Window.partitionBy(*by).orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
    offsets = sums.select(*by, "_range", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum(F.col("n") - F.col("p")).over(above), F.lit(0)).alias("n0"))
    within = Window.partitionBy(*by, "_range").orderBy(F.col("probability").desc(), tie).rowsBetween(Window.unboundedPreceding, 0)
    out = held.join(offsets if by else F.broadcast(offsets), [*by, "_range"])
    return out.withColumn("tp", F.sum("binary_label").over(within) + F.col("p0")).withColumn("fp", F.sum(1 - F.col("binary_label")).over(within) + F.col("n0"))


def roc_auc(rows: DataFrame, tie: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Area under the ROC curve by trapezoids, a step each row; null without both classes.

    Only negatives move along the false-positive axis, each by 1 / negatives, at the height reached.
    """
    counted = running_counts(rows, tie, by)
    sums = counted.groupBy(*by).agg(F.sum("binary_label").alias("p"), F.sum(1 - F.col("binary_label")).alias("n"), F.sum(F.when(F.col("binary_label") == 0, F.col("tp"))).alias("area"))
    return sums.select(*by, F.when((F.col("p") > 0) & (F.col("n") > 0), round6(F.col("area") / (F.col("p").cast("double") * F.col("n")))).alias("roc_auc"))


def pr_auc(rows: DataFrame, tie: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Area under precision over recall by trapezoids, from recall 0 with precision 1; null without positives."""
    counted = running_counts(rows, tie, by).where("binary_label = 1")
    here = F.col("tp").cast("double") / (F.col("tp") + F.col("fp"))
    rank = F.col("tp") + F.col("fp")
    before = F.when(rank == 1, 1.0).otherwise((F.col("tp") - 1).cast("double") / (rank - 1))
    return counted.groupBy(*by).agg(F.count("*").alias("p"), F.sum((here + before) / 2).alias("area")).select(*by, F.when(F.col("p") > 0, round6(F.col("area") / F.col("p"))).alias("pr_auc"))


def confusion(rows: DataFrame, threshold: float = 0.5, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Counts and precision, recall, F1 and accuracy at a threshold."""
    yes, pos = F.col("probability") >= threshold, F.col("binary_label") == 1
    counts = labeled(rows).groupBy(*by).agg(F.count_if(yes & pos).alias("tp"), F.count_if(yes & ~pos).alias("fp"), F.count_if(~yes & pos).alias("fn"), F.count_if(~yes & ~pos).alias("tn"))
    return rated(counts)


def rated(counts: DataFrame) -> DataFrame:
    p, r = safe_divide(F.col("tp"), F.col("tp") + F.col("fp")), safe_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": round6(p), "recall": round6(r), "f1": round6(safe_divide(2 * p * r, p + r)), "accuracy": round6(safe_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))})


def threshold_curve(rows: DataFrame, steps: int = 100, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Counts and rates at 0, 1/steps, ... 1.

    Each row falls into the last threshold that it reaches; counts are summed up from there, so
    that rows are read once and not once a threshold.  Labels other than 0 and 1 count as true negatives.
    """
    step = F.least(F.floor(F.col("probability") * steps + 1e-9), F.lit(steps)).cast("int")
    sums = rows.groupBy(*by, F.greatest(step, F.lit(-1)).alias("step")).agg(F.count_if(F.col("binary_label") == 1).alias("p"), F.count_if(F.col("binary_label") == 0).alias("n"), F.count("*").alias("every"))
    grid = rows.sparkSession.range(-1, steps + 1).select(F.col("id").cast("int").alias("step"))
    if by:  # a grid for each group
        grid = sums.select(*by).distinct().withColumn("step", F.explode(F.sequence(F.lit(-1), F.lit(steps))))
        grid = grid.join(sums, [*by, "step"], "left").na.fill(0)
    else:
        grid = grid.join(F.broadcast(sums), "step", "left").na.fill(0)
    up = Window.partitionBy(*by).orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0)  # steps + 2 rows
    every = Window.partitionBy(*(by or [F.lit(0)]))
    out = grid.select(*by, "step", F.sum("p").over(up).alias("tp"), F.sum("n").over(up).alias("fp"), F.sum("p").over(every).alias("_p"), F.sum("every").over(every).alias("_all"))
    out = out.withColumn("fn", F.col("_p") - F.col("tp")).withColumn("tn", F.col("_all") - F.col("tp") - F.col("fp") - F.col("fn")).where("step >= 0")
    return rated(out.select(*by, (F.col("step") / steps).alias("threshold"), "tp", "fp", "fn", "tn"))


def best_threshold(curve: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    return curve.groupBy(*by).agg(F.max_by("threshold", F.struct("f1", (-F.col("threshold")).alias("t"))).alias("threshold"), F.max("f1").alias("f1"))


def ranked(rows: DataFrame, tie: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "item_id").orderBy(F.col("probability").desc(), tie)))


def ranking(rows: DataFrame, tie: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Top-1, mean reciprocal rank and recall at 3 over items that are reviewed throughout and have a positive."""
    items = ranked(rows, tie, by).groupBy(*by, "item_id").agg(F.every(F.coalesce(F.col("binary_label").isin(0, 1), F.lit(False))).alias("whole"), F.min(F.when(F.col("binary_label") == 1, F.col("rank"))).alias("first"))
    found = items.where("whole AND first IS NOT NULL")
    out = found.groupBy(*by).agg(F.count("*").alias("eligible_item_count"), F.count_if(F.col("first") == 1).alias("a"), F.sum(1 / F.col("first")).alias("b"), F.count_if(F.col("first") <= 3).alias("c"))
    return out.select(*by, "eligible_item_count", *(round6(safe_divide(F.col(c), F.col("eligible_item_count"))).alias(n) for c, n in (("a", "top_1_accuracy"), ("b", "mean_reciprocal_rank"), ("c", "recall_at_3"))))


def pages(rows: DataFrame, threshold: float = 0.5, accept: float = 0.8, reject: float = 0.2) -> DataFrame:
    """How often pages have a correct candidate, a false one, an over-confident false one, or need review."""
    items = rows.groupBy("item_id").agg(
        F.every(F.coalesce(F.col("binary_label").isin(0, 1), F.lit(False))).alias("whole"),
        F.some(F.col("binary_label") == 1).alias("positive"),
        F.some((F.col("binary_label") == 1) & (F.col("probability") >= threshold)).alias("right"),
        F.max("probability").alias("most"),
    ).where("whole")
    most, neg = F.col("most"), ~F.col("positive")
    sums = items.agg(F.count("*").alias("n"), F.count_if("positive").alias("p"), F.count_if(F.col("positive") & F.col("right")).alias("ok"), F.count_if(neg).alias("neg"), F.count_if(neg & (most >= threshold)).alias("bad"), F.count_if(neg & (most >= accept)).alias("sure"), F.count_if((most < accept) & (most > reject)).alias("review"))
    rate = lambda a, b, n: round6(safe_divide(F.col(a), F.col(b))).alias(n)
    return sums.select(F.col("n").alias("eligible_item_count"), rate("ok", "p", "page_has_correct_candidate_rate"), rate("bad", "neg", "false_positive_page_rate"), rate("review", "n", "manual_review_rate"), rate("sure", "neg", "overconfident_false_positive_page_rate"))


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Mean prediction and share of positives in bins of equal width; empty bins have nulls."""
    held = labeled(rows).withColumn("bin", F.least(F.floor(F.col("probability") * bins), F.lit(bins - 1)).cast("int"))
    sums = held.groupBy("bin").agg(F.count("*").alias("n"), round6(F.avg("probability")).alias("mean_predicted"), round6(F.avg(F.col("binary_label").cast("double"))).alias("fraction_positive"))
    grid = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(F.broadcast(sums), "bin", "left").na.fill(0, ["n"])


def t95(n: Column) -> Column:
    return F.when(n >= 30, 1.96).otherwise(F.element_at(F.array(*map(F.lit, T95)), F.greatest(n - 1, F.lit(1)).cast("int")))


def stat_summary(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Mean, sample deviation and the 95 % interval of the mean."""
    sums = df.groupBy(*key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))
    half = F.when(F.col("n") > 1, t95(F.col("n")) * F.col("std") / F.sqrt("n")).otherwise(0.0)
    return sums.select(*key, "n", round6(F.col("mean")).alias("mean"), round6(F.col("std")).alias("std"), round6(F.col("mean") - half).alias("ci_low"), round6(F.col("mean") + half).alias("ci_high"))
