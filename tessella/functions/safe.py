"""Expressions that keep array-library semantics under ANSI SQL: validity, clipping, division, rounding, correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_valid(v: Column) -> Column:
    """Finite and positive. NaN is greater than any number in SQL, so it is excluded by name."""
    return (v > 0) & ~F.isnan(v) & (v < F.lit(float("inf")))


def clip(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(v, F.lit(float(low))), F.lit(float(high)))


def divide(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(otherwise))


def truncate(v: Column) -> Column:
    """Integer part toward zero, as a cast of an array does."""
    return v.cast("long")


def round_scaled(v: Column, digits: int) -> Column:
    """Rounded half away from zero as array libraries and DuckDB do, by scaling. Spark's round() takes the shortest decimal that names
    the number, so that they differ where the product with the scale is a tie, or is none, by an error of the product."""
    return F.round(v * 10.0**digits) / 10.0**digits


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; null where a side does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def join_same(df: DataFrame, other: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """Join on equal keys, a null being equal to a null; the keys come from ``df`` alone."""
    renamed = other.withColumnsRenamed({k: f"{k}__other" for k in keys})
    on = [df[k].eqNullSafe(renamed[f"{k}__other"]) for k in keys]
    return df.join(renamed, on, how).drop(*[f"{k}__other" for k in keys])
