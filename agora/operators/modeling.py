"""Candidate datasets and models: reviews, vectors, splits, balance, learners and explanations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.functions.hashing import bucket
from agora.functions.numbers import binary_label, number, round6, sigmoid


def reviewed(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """Candidates of ``items`` (item_id, candidates) with the last review of their key; ranks default to the place."""
    last = reviews.withColumn("_n", F.row_number().over(Window.partitionBy("item_id", "candidate_key").orderBy(F.col("updated_at").desc()))).where("_n = 1")
    rows = items.select("item_id", F.posexplode("candidates").alias("_at", "c")).select("item_id", "_at", "c.*")
    rows = rows.withColumn("candidate_rank", F.coalesce("candidate_rank", F.col("_at") + 1)) if "candidate_rank" in rows.columns else rows.withColumn("candidate_rank", F.col("_at") + 1)
    return rows.drop("_at").join(last.select("item_id", "candidate_key", F.col("label").alias("human_label"), F.col("notes").alias("human_notes")), ["item_id", "candidate_key"], "left")


def dataset(candidates: DataFrame) -> DataFrame:
    """Candidate rows with label, row id and their item's counts; complete where each has a binary label."""
    per = Window.partitionBy("item_id")
    out = candidates.withColumns({"binary_label": binary_label(F.col("human_label")), "dataset_row_id": F.concat_ws(":", "item_id", "candidate_key")})
    return out.withColumns({"positive_count": F.sum((F.col("binary_label") == 1).cast("int")).over(per), "candidate_count": F.count("*").over(per)}).withColumn("review_complete", F.count("binary_label").over(per) == F.col("candidate_count"))


def split(rows: DataFrame, host: Column, modulo: int = 5, held: int = 0) -> DataFrame:
    """Rows with their bucket by host and whether they are held out: a host is never on both sides."""
    return rows.withColumn("split_bucket", bucket(host, modulo)).withColumn("held_out", F.col("split_bucket") == held)


def fit_vectorizer(rows: DataFrame, numeric: list[str], categorical: list[str]) -> dict:
    """Population mean and deviation (1 where it is 0) of numbers, sorted values of categories: one pass, small result."""
    sums = [F.avg(number(F.col(c))).alias(f"m_{c}") for c in numeric] + [F.stddev_pop(number(F.col(c))).alias(f"s_{c}") for c in numeric] + [F.array_sort(F.collect_set(c)).alias(f"v_{c}") for c in categorical]
    found = rows.agg(*sums).first()
    return {"numeric": {c: (found[f"m_{c}"] or 0.0, found[f"s_{c}"] or 1.0) for c in numeric}, "categorical": {c: found[f"v_{c}"] for c in categorical}}


def vector(fitted: dict) -> Column:
    """Scaled numbers, then one place for each value of each category; unseen values are all zero."""
    parts = [(number(F.col(c)) - m) / s for c, (m, s) in fitted["numeric"].items()]
    parts += [F.when(F.col(c) == v, 1.0).otherwise(0.0) for c, values in fitted["categorical"].items() for v in values]
    return F.array(*parts)


def dot(vector_: Column, weights: list[float]) -> Column:
    return F.aggregate(F.zip_with(vector_, F.array(*map(F.lit, map(float, weights))), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def predicted(rows: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """Rows with probability (six decimals) and the label by the unrounded one."""
    p = sigmoid(dot(F.col("features"), model["weights"]) + model["bias"])
    return rows.withColumns({"predicted_label": (p >= threshold).cast("int"), "probability": round6(p)})


def contributions(rows: DataFrame, weights: list[float], names: list[str], most: int = 6) -> DataFrame:
    """Each row's largest positive and negative contributions to its score."""
    parts = F.zip_with(F.col("features"), F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("w")) for n, w in zip(names, weights))), lambda x, w: F.struct((x * w["w"]).alias("value"), w["name"].alias("name")))
    top = lambda keep, sign: F.slice(F.array_sort(F.filter(parts, keep), lambda a, b: F.when(a["value"] * sign > b["value"] * sign, -1).when(a["value"] * sign < b["value"] * sign, 1).otherwise(0)), 1, most)
    return rows.withColumns({"top_positive": top(lambda c: c["value"] > 0, 1), "top_negative": top(lambda c: c["value"] < 0, -1)})


def reliance(rows: DataFrame, weights: list[float], names: list[str]) -> DataFrame:
    """Mean and mean absolute contribution of each feature over all rows."""
    spread = rows.select(F.posexplode("features").alias("at", "x"))
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), F.col("at") + 1)
    name = F.element_at(F.array(*map(F.lit, names)), F.col("at") + 1)
    return spread.groupBy(name.alias("feature")).agg(round6(F.avg(F.col("x") * w)).alias("mean_contribution"), round6(F.avg(F.abs(F.col("x") * w))).alias("mean_abs_contribution"))


def balance(rows: DataFrame) -> DataFrame:
    """Counts and shares of the classes and their ratio."""
    sums = rows.agg(F.count_if(F.col("binary_label") == 1).alias("positive"), F.count_if(F.col("binary_label") == 0).alias("negative"))
    less, more, all_ = F.least("positive", "negative"), F.greatest("positive", "negative"), F.col("positive") + F.col("negative")
    return sums.select("positive", "negative", round6(F.coalesce(F.try_divide("positive", all_), F.lit(0.0)).cast("double")).alias("positive_share"), round6(F.coalesce(F.try_divide(more, less), F.lit(0.0)).cast("double")).alias("imbalance_ratio"), F.when(F.col("positive") <= F.col("negative"), "positive").otherwise("negative").alias("minority"))


#: Ranges of hashes within which rows are numbered.
RANGES = 1024


def hash_rank(rows: DataFrame, order: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows with ``hash_rank``, from 1 in each group by a hash of ``order``, and the group's ``n_ranked``.

    Exact without sorting a group in one task: rows are numbered within ranges of hashes, and what
    lies in the ranges before is added.
    """
    held = rows.withColumn("_h", F.xxhash64(order)).withColumn("_range", F.pmod(F.shiftrightunsigned("_h", 54), F.lit(RANGES)).cast("int"))
    sums = held.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
    sums = sums.select(*by, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*by)).alias("n_ranked"))
    within = Window.partitionBy(*by, "_range").orderBy("_h", order)
    return held.join(sums, [*by, "_range"]).withColumn("hash_rank", F.row_number().over(within) + F.col("_before")).drop("_h", "_range", "_before")


def resampled(rows: DataFrame, strategy: str, order: str) -> DataFrame:
    """Training rows by strategy: baseline, class_weighted (a weight column), undersample or oversample.

    Which rows stay or repeat follows a hash of ``order``; class sizes are exact.
    """
    counts = {r[0]: r[1] for r in rows.where("binary_label IN (0, 1)").groupBy("binary_label").count().collect()}
    if len(counts) < 2 or strategy == "baseline":
        return rows.withColumn("weight", F.lit(1.0))
    n, (small, large) = sum(counts.values()), sorted(counts.values())
    in_minor = F.col("binary_label") == min(counts, key=lambda k: (counts[k], 1 - k))
    if strategy == "class_weighted":
        return rows.withColumn("weight", F.when(F.col("binary_label") == 1, n / (2 * counts[1])).otherwise(n / (2 * counts[0])))
    ranked, rank = hash_rank(rows, order, ["binary_label"]), F.col("hash_rank")
    if strategy == "undersample":
        return ranked.where(in_minor | (rank <= small)).drop("hash_rank", "n_ranked").withColumn("weight", F.lit(1.0))
    if strategy == "oversample":
        whole, rest = divmod(large, small)
        times = F.when(in_minor, whole + (rank <= rest).cast("int")).otherwise(1)
        return ranked.withColumn("_k", F.explode(F.sequence(F.lit(1), times))).drop("_k", "hash_rank", "n_ranked").withColumn("weight", F.lit(1.0))
    raise ValueError(f"no strategy named {strategy}")


def class_prefix(rows: DataFrame, fraction: float, order: str) -> DataFrame:
    """The first part of each class by a hash of ``order``, half a row rounded up and at least one."""
    kept = F.greatest(F.lit(1), F.floor(F.col("n_ranked") * fraction + 0.5))
    return hash_rank(rows, order, ["binary_label"]).where(F.col("hash_rank") <= kept).drop("hash_rank", "n_ranked")


def nearest(rows: DataFrame, k: int = 5, most: int = 1 << 15) -> DataFrame:
    """(id, near_id, distance, rank): the ``k`` nearest other rows of (id, features) by Euclidean distance, exactly.

    Rows are dealt into blocks; each pair of blocks is one task's work, which returns the ``k``
    best of either side only, so that neither pairs of rows nor a whole table come together.  There
    are only so many blocks as keep all cores busy or hold a block to ``most`` rows, as each block
    more is a copy of every row.
    """
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // most), min(-(-n // 512), int((2 * cores) ** 0.5) + 1))
    dealt = rows.select("id", "features", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("own"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("id", "features", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).alias("second"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        same = frame["a"].iloc[0] == frame["b"].iloc[0]
        first, second = frame[~frame["second"]], frame if same else frame[frame["second"]]
        for left, right in ((first, second),) if same else ((first, second), (second, first)):
            if not len(left) or not len(right):
                continue
            x, y = np.stack(left["features"]).astype(float), np.stack(right["features"]).astype(float)
            ids, near, squares = left["id"].to_numpy(), right["id"].to_numpy(), (y**2).sum(axis=1)
            step = max(1, (1 << 22) // len(y))
            for at in range(0, len(x), step):
                some = x[at : at + step]
                # by products first, whose error is far below the slack, to tell which rows can be among the nearest
                about = (some**2).sum(axis=1)[:, None] + squares - 2 * some @ y.T
                about[ids[at : at + step, None] == near[None]] = np.inf
                slack = 1e-9 * (1 + squares.max() + (some**2).sum(axis=1))
                bound = np.partition(about, min(k, len(y)) - 1, axis=1)[:, min(k, len(y)) - 1] + slack
                i, j = np.nonzero((about <= bound[:, None]) & np.isfinite(about))
                out.append(pd.DataFrame({"id": ids[at + i], "near_id": near[j], "distance": np.sqrt(((some[i] - y[j]) ** 2).sum(axis=1))}))
        found = pd.concat(out) if out else pd.DataFrame({"id": [], "near_id": [], "distance": []})
        return found.sort_values(["distance", "near_id"]).groupby("id").head(k)

    found = paired.groupBy("a", "b").applyInPandas(compare, "id long, near_id long, distance double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("distance", "near_id"))).where(F.col("rank") <= k)


def blends(rows: DataFrame, extra: int | None = None, k: int = 5, seed: int = 7) -> DataFrame:
    """(id, near_id, copy, alpha): between which two rows each of ``extra`` synthetic ones lies, and where.

    As many as there are rows (id, features) if ``extra`` is not given; each row gives as many as
    any other, or one more.  Which of its ``k`` nearest and how far towards it follow hashes.
    """
    n = rows.count()
    whole, rest = divmod(n if extra is None else extra, max(1, n))
    times = F.lit(whole) + (F.col("hash_rank") <= rest).cast("int")
    spread = hash_rank(rows.select("id"), "id").where(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
    choices = nearest(rows, k).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "near_id"))).alias("near"))  # k each
    at = (1 + F.pmod(F.xxhash64("id", "copy", F.lit(seed)), F.size("near"))).cast("int")
    picked = spread.join(choices, "id").select("id", "copy", F.element_at("near", at)["near_id"].alias("near_id"))
    return picked.withColumn("alpha", F.pmod(F.xxhash64("id", "near_id", "copy", F.lit(seed)), 1000) / 1000.0)


def smote(rows: DataFrame, extra: int | None = None, k: int = 5, seed: int = 7) -> DataFrame:
    """(id, near_id, copy, features): synthetic rows between rows (id, features) of the smaller class, by ``blends``."""
    both = blends(rows, extra, k, seed).join(rows.select("id", "features"), "id").join(rows.select(F.col("id").alias("near_id"), F.col("features").alias("other")), "near_id")
    return both.select("id", "near_id", "copy", F.zip_with("features", "other", lambda a, b: round6(a + (b - a) * F.col("alpha"))).alias("features"))


def smote_rows(rows: DataFrame, numbers: list[str], flags: list[str], categories: list[str], extra: int | None = None, k: int = 5, seed: int = 7) -> DataFrame:
    """Synthetic rows with named values, beside the ids of the two that each lies between.

    ``rows`` (id, features, and the named columns) are of one class.  Numbers lie between, what is
    no number counting as 0; flags and categories are those of the nearer row, a missing flag being
    false and a missing category of the other the first one's.
    """
    names = [*numbers, *flags, *categories]
    other = rows.select(F.col("id").alias("near_id"), *(F.col(c).alias(f"_{c}") for c in names))
    both = blends(rows.select("id", "features"), extra, k, seed).join(rows.select("id", *names), "id").join(other, "near_id")
    first = F.col("alpha") < 0.5
    value = lambda c: number(F.col(c))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    made = {c: round6(value(c) + (value(f"_{c}") - value(c)) * F.col("alpha")) for c in numbers}
    made |= {c: F.when(first, F.coalesce(F.col(c), F.lit(False))).otherwise(F.coalesce(F.col(f"_{c}"), F.lit(False))) for c in flags}
    made |= {c: F.when(first | (text(f"_{c}") == ""), text(c)).otherwise(text(f"_{c}")) for c in categories}
    return both.select(F.concat_ws("::", F.col("id").cast("string"), F.lit("smote"), F.col("copy").cast("string")).alias("dataset_row_id"), F.col("id").alias("source_row_id"), F.col("near_id").alias("neighbor_row_id"), F.round("alpha", 4).alias("alpha"), F.lit("synthetic_smote").alias("analysis_source"), *(v.alias(c) for c, v in made.items()))
