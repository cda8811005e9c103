"""Sampling with replacement by weight, exact in size, without a window over all rows.

Rows lie on a line, each as long as its weight, in the order of a hash of their ids; draws are
points on it.  Places on the line are prefix sums within ranges of hashes plus the sums of the
ranges before.  Rows and draws then meet in cells of equal length, of which each has few of either.
Weights count in steps of ``UNIT``, so that places are exact whatever the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.session import written

UNIT = 2.0**-20
#: Rows that a range or a cell has on average.
CELL_ROWS = 1 << 14


def _unit(*key: Column) -> Column:
    """A number from 0 up to 1, not included, by a hash."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") * F.lit(2.0**-53)


def bootstrap(rows: DataFrame, size: int | None = None, samples: int = 1, seed: int = 0, key: str = "row_id", weight: str = "weight") -> DataFrame:
    """(sample, draw, <key>): ``size`` draws (by default as many as rows) for each sample, by weight, with replacement.

    Weights that are null, not finite or below zero are 0; such rows are never drawn.  Without any
    weight nothing is drawn.  Rows that share a key count each.
    """
    w = F.coalesce(F.nanvl(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    whole = F.when((w > 0) & (w < F.lit(float("inf"))), F.round(w / UNIT).cast("long")).otherwise(F.lit(0).cast("long"))
    base = written(rows.select(F.col(key).alias("_key"), whole.alias("_w"), F.xxhash64(F.lit(seed), key).alias("_h")).where("_w > 0"), "weights")
    n, total = base.agg(F.count("*"), F.sum("_w")).first()
    kind = rows.schema[key].dataType.simpleString()
    spark = rows.sparkSession
    size = rows.count() if size is None else size
    if not n or size <= 0:
        return spark.createDataFrame([], f"sample int, draw long, {key} {kind}")
    ranges = max(1, -(-n // CELL_ROWS))
    cells = max(1, -(-(n + size * samples) // CELL_ROWS))
    width = -(-total // cells)
    ranged = base.withColumn("_r", F.floor((F.col("_h") / 2.0**64 + 0.5) * ranges).cast("int"))
    sums = ranged.groupBy("_r").agg(F.sum("_w").alias("s"))
    starts = sums.select("_r", F.coalesce(F.sum("s").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s0"))  # a row for each range
    ahead = Window.partitionBy("_r").orderBy("_h", "_key").rowsBetween(Window.unboundedPreceding, -1)
    laid = ranged.join(starts, "_r").withColumn("_at", F.col("s0") + F.coalesce(F.sum("_w").over(ahead), F.lit(0)))
    # a row begins in one cell and may go on through others
    spans = laid.select("_key", "_at", F.explode(F.sequence(F.floor(F.col("_at") / width), F.floor((F.col("_at") + F.col("_w") - 1) / width))).alias("_cell"))
    held = spans.select("_cell", "_at", F.lit(0).alias("_kind"), F.lit(None).cast("int").alias("sample"), F.lit(None).cast("long").alias("draw"), "_key")
    draws = spark.range(size * samples).select((F.col("id") % samples).cast("int").alias("sample"), F.floor(F.col("id") / samples).cast("long").alias("draw"))
    draws = draws.withColumn("_at", F.least(F.floor(_unit(F.lit(seed + 1), F.col("sample"), F.col("draw")) * float(total)).cast("long"), F.lit(total - 1)))
    points = draws.select(F.floor(F.col("_at") / width).alias("_cell"), "_at", F.lit(1).alias("_kind"), "sample", "draw", F.lit(None).cast(kind).alias("_key"))
    last = Window.partitionBy("_cell").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = held.unionByName(points).withColumn("_row", F.last(F.when(F.col("_kind") == 0, F.struct("_key")), True).over(last)).where("_kind = 1")
    return found.select("sample", "draw", F.col("_row._key").alias(key))


def class_weighted(rows: DataFrame, label: str = "binary_label", key: str = "row_id", seed: int = 0) -> DataFrame:
    """(draw, <key>): as many rows as there are, drawn so that both classes come out alike."""
    counts = rows.agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("p")).first()
    share = lambda c: counts.n / (2 * c) if c else 1.0
    weights = F.when(F.col(label) == 1, share(counts.p)).otherwise(share(counts.n - counts.p))
    return bootstrap(rows.select(key, weights.alias("weight")), seed=seed, key=key).select("draw", key)
