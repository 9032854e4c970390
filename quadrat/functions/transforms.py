"""Transforms of sparse long tables (feature, sample, count): zeros are the absent rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-6


def share(value: Column, total: Column) -> Column:
    """value / total, where a zero total counts as one."""
    return value / F.when(total == 0, F.lit(1)).otherwise(total)


def relative(counts: DataFrame, by: str | list[str] = "sample", value: str = "count", name: str = "p") -> DataFrame:
    """Adds each row's share of its sample's total."""
    over = Window.partitionBy(*([by] if isinstance(by, str) else by))
    return counts.withColumn(name, share(F.col(value).cast("double"), F.sum(value).over(over)))


def clr_floor(rel: DataFrame, n_features: int, value: str = "p", floor: float = EPSILON) -> DataFrame:
    """Centred log-ratio where zeros were replaced by ``floor`` after scaling; absent rows count as ``floor``.

    clr = ln p - (sum ln p + (features absent) ln floor) / features.
    """
    w = Window.partitionBy("sample")
    logs = F.sum(F.log(F.col(value))).over(w)
    absent = F.lit(n_features) - F.count(F.lit(1)).over(w)
    return rel.withColumn("clr", F.log(F.col(value)) - (logs + absent * math.log(floor)) / n_features)


def clr_plus_one(counts: DataFrame, n_features: int) -> DataFrame:
    """Centred log-ratio of count + 1 in samples with zeros, of the counts in others."""
    w = Window.partitionBy("sample")
    present = F.count(F.lit(1)).over(w)
    shift = F.when(present < n_features, 1).otherwise(0)
    log = F.log(F.col("count") + shift)
    return counts.withColumn("clr", log - F.sum(log).over(w) / n_features)


def clr_replaced(rel: DataFrame, n_features: int, value: str = "p") -> DataFrame:
    """Centred log-ratio after multiplicative replacement of zeros by delta = 1 / n_features ** 2."""
    w = Window.partitionBy("sample")
    delta = 1.0 / n_features**2
    absent = F.lit(n_features) - F.count(F.lit(1)).over(w)
    log = F.log(F.col(value) * (1 - absent * delta))
    return rel.withColumn("clr", log - (F.sum(log).over(w) + absent * math.log(delta)) / n_features)


def rclr(rel: DataFrame, value: str = "p", by: str | list[str] = "sample") -> DataFrame:
    """Robust log-ratio: log of positives minus the mean log of positives; zeros stay absent."""
    w = Window.partitionBy(*([by] if isinstance(by, str) else by))
    log = F.log(F.col(value))
    return rel.where(F.col(value) > 0).withColumn("rclr", log - F.avg(log).over(w))


def hellinger(rel: DataFrame, value: str = "p") -> DataFrame:
    return rel.withColumn("hellinger", F.sqrt(value))


def log10_plus_one(value: Column) -> Column:
    return F.log10(value + 1)


def minus_log10(q: Column, digits: int = 3) -> Column:
    """-log10, null for zero and null."""
    return F.round(-F.log10(F.when(q > 0, q)), digits)


def min_max(df: DataFrame, value: str, name: str) -> DataFrame:
    """Scaled to 0 to 1 over the table; a constant column is 0."""
    low, high = (f(value).alias(n) for f, n in ((F.min, "_low"), (F.max, "_high")))
    ends = df.agg(low, high)
    return df.crossJoin(F.broadcast(ends)).withColumn(name, F.when(F.col("_high") > F.col("_low"), (F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(0.0)).drop("_low", "_high")


def z_scores(df: DataFrame, value: str, name: str, by: list[str] | None = None) -> DataFrame:
    """(x - mean) / population deviation; a constant group is 0. Statistics are aggregated, then joined."""
    keys = by or []
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    joined = df.join(stats, keys) if keys else df.crossJoin(F.broadcast(stats))
    return joined.withColumn(name, F.when(F.col("_sd") > 0, (F.col(value) - F.col("_mean")) / F.col("_sd")).otherwise(0.0)).drop("_mean", "_sd")


def prevalence_class(prevalence: Column, cuts: tuple[float, float] = (0.2, 0.5)) -> Column:
    """Right-closed bins of [0, 1] at the cuts."""
    return F.when(prevalence <= cuts[0], "low").when(prevalence <= cuts[1], "medium").otherwise("high")
