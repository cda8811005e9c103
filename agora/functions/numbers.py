"""Number functions with the coercions that scores rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import half_up


def round6(x: Column) -> Column:
    return half_up(x, 6)


def ratio(part: Column, whole: Column) -> Column:
    """Three decimals; 0 where there is no whole."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(0.0)).otherwise(half_up(part / whole, 3))


def safe_divide(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def logit(p: Column, least: float = 1e-6) -> Column:
    held = F.least(F.greatest(p, F.lit(least)), F.lit(1 - least))
    return F.ln(held / (1 - held))


def number(x: Column) -> Column:
    """A finite number, else 0."""
    held = x.try_cast("double")
    return F.when(held.isNull() | F.isnan(held) | (F.abs(held) == float("inf")), 0.0).otherwise(held)


def truthy(x: Column) -> Column:
    return F.coalesce(x.cast("boolean"), F.lit(False)).cast("int")


def category(x: Column) -> Column:
    held = F.trim(F.coalesce(x.cast("string"), F.lit("")))
    return F.when(held == "", "__missing__").otherwise(held)


def binary_label(label: Column) -> Column:
    return F.when(label == "comment_region", 1).when(label == "not_comment_region", 0)
