"""Operators on frame sequences (a key, a time order, a value or a vector)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalise(rows: DataFrame, key: str, value: str, out: str = "z") -> DataFrame:
    """(x - mean) / population deviation within a key; 0 where the variance is 0."""
    w = Window.partitionBy(key)
    mean, var = F.avg(value).over(w), F.var_pop(value).over(w)
    return rows.withColumn(out, F.when(var > 0, (F.col(value) - mean) / F.sqrt(var)).otherwise(0.0))


def moving_average(rows: DataFrame, key: str, order: list[str], value: str, m: int, out: str = "ma") -> DataFrame:
    return rows.withColumn(out, F.avg(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(-m, m)))


def smoothed(x: np.ndarray, m: int) -> list[float]:
    """One pass over a series: only the last m smoothed values are looked back at."""
    out = x.tolist()
    if len(out) > 2 * m:
        after = np.lib.stride_tricks.sliding_window_view(x, m + 1).sum(axis=1).tolist()
        for t in range(m, len(out) - m):
            out[t] = (sum(out[t - m : t]) + after[t]) / (2 * m + 1)
    return out


def arma(series: Column, m: int) -> Column:
    """Recursive smoothing of an array: the mean of m smoothed values before and m + 1 values from here on.

    The first and last m values stay as they are.  Time is linear in the values.
    """

    def run(xs: pd.Series) -> pd.Series:
        return xs.map(lambda x: None if x is None else smoothed(np.array(x, float), m))

    return F.pandas_udf(run, "array<double>")(series)


def splice(rows: DataFrame, key: str, order: list[str], value: str, k: int, out: str = "block") -> DataFrame:
    """Blocks of k frames from each frame on; shorter at the end."""
    return rows.withColumn(out, F.collect_list(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(0, k - 1)))


def skip(rows: DataFrame, key: str, order: list[str], value: str, out: str = "held") -> DataFrame:
    """Every second frame takes over the value of the frame before it."""
    w = Window.partitionBy(key).orderBy(*order)
    numbered = rows.withColumn("_n", F.row_number().over(w))
    return numbered.withColumn(out, F.when(F.col("_n") % 2 == 1, F.col(value)).otherwise(F.lag(value).over(w))).drop("_n")


def moments(vectors: DataFrame, vec: str) -> DataFrame:
    """Mean and population variance of each dimension."""
    long = vectors.select(F.posexplode(vec).alias("dim", "x"))
    return long.groupBy("dim").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("var"))


def cut(series: Column, at: Column, half: Column) -> Column:
    """The array without the values at - half .. at + half (1-based)."""
    return F.concat(F.slice(series, F.lit(1), at - half - 1), F.slice(series, at + half + 1, F.greatest(F.size(series) - at - half, F.lit(0))))


def deltas(rows: DataFrame, key: str, order: list[str], value: str, out: str = "delta") -> DataFrame:
    """A value less the one before it; the first stays."""
    return rows.withColumn(out, F.col(value) - F.coalesce(F.lag(value).over(Window.partitionBy(key).orderBy(*order)), F.lit(0)))


def regression(rows: DataFrame, key: str, order: list[str], value: str, reach: int = 2, out: str = "slope") -> DataFrame:
    """The slope of each value of a vector over reach frames on both sides: the sum of k (x[t + k] - x[t - k]) over twice that of k squared.

    The first and last vector of a key are repeated beyond its ends.
    """
    w = Window.partitionBy(key).orderBy(*order)
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    last = F.last(value).over(w.rowsBetween(0, Window.unboundedFollowing))
    sides = [c for k in range(1, reach + 1) for c in (F.coalesce(F.lead(value, k).over(w), last).alias(f"_a{k}"), F.coalesce(F.lag(value, k).over(w), first).alias(f"_b{k}"))]
    near = rows.select("*", *sides)
    times = lambda k: lambda a, b: (a - b) * k
    total = None
    for k in range(1, reach + 1):
        step = F.zip_with(f"_a{k}", f"_b{k}", times(k))
        total = step if total is None else F.zip_with(total, step, lambda a, b: a + b)
    return near.withColumn(out, F.transform(total, lambda v: v / (2 * sum(k * k for k in range(1, reach + 1))))).drop(*[f"_{s}{k}" for s in "ab" for k in range(1, reach + 1)])
