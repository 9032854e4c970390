"""Pair tables of distances. Sparse self-joins on the feature give the common parts; totals give the rest.

A feature present in m samples adds m * (m - 1) / 2 rows, so the tables are for sets of
samples of which all pairs are wanted anyway; features in one sample are dropped first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def all_pairs(units: DataFrame, unit: str = "sample") -> DataFrame:
    """(id1, id2) of all pairs with id1 < id2: the output itself is quadratic."""
    a, b = units.select(F.col(unit).alias("id1")).distinct(), units.select(F.col(unit).alias("id2")).distinct()
    return a.join(b, F.col("id1") < F.col("id2"))


def _met(table: DataFrame, unit: str, value: str) -> DataFrame:
    a = table.select("feature", F.col(unit).alias("id1"), F.col(value).alias("v1"))
    b = table.select("feature", F.col(unit).alias("id2"), F.col(value).alias("v2"))
    return a.join(b, "feature").where(F.col("id1") < F.col("id2"))


def bray_curtis(table: DataFrame, unit: str = "sample", value: str = "count") -> DataFrame:
    """(id1, id2, dist) = 1 - 2 sum min(a, b) / (A + B), for all pairs."""
    totals = table.groupBy(unit).agg(F.sum(value).alias("t"))
    common = _met(table, unit, value).groupBy("id1", "id2").agg(F.sum(F.least("v1", "v2")).alias("common"))
    pairs = all_pairs(table, unit).join(common, ["id1", "id2"], "left")
    pairs = pairs.join(totals.select(F.col(unit).alias("id1"), F.col("t").alias("t1")), "id1").join(totals.select(F.col(unit).alias("id2"), F.col("t").alias("t2")), "id2")
    both = F.col("t1") + F.col("t2")
    return pairs.select("id1", "id2", F.when(both > 0, 1 - 2.0 * F.coalesce("common", F.lit(0)) / F.when(both > 0, both)).otherwise(0.0).alias("dist"))


def jaccard(table: DataFrame, unit: str = "sample", value: str = "count", above: float = 0) -> DataFrame:
    """(id1, id2, shared, dist): presence is value > above; two empty sets have distance 0."""
    seen = table.where(F.col(value) > above)
    sizes = seen.groupBy(unit).agg(F.count(F.lit(1)).alias("n"))
    shared = _met(seen, unit, value).groupBy("id1", "id2").agg(F.count(F.lit(1)).alias("shared"))
    n = lambda i: sizes.select(F.col(unit).alias(f"id{i}"), F.col("n").alias(f"n{i}"))
    pairs = all_pairs(table, unit).join(shared, ["id1", "id2"], "left").join(n(1), "id1", "left").join(n(2), "id2", "left").na.fill(0)
    union = F.col("n1") + F.col("n2") - F.col("shared")
    return pairs.select("id1", "id2", "shared", F.when(union > 0, 1 - F.col("shared") / F.when(union > 0, union)).otherwise(0.0).alias("dist"))


def euclidean(table: DataFrame, unit: str, value: str) -> DataFrame:
    """(id1, id2, dist); absent values are 0."""
    x = F.col(value)
    norms = table.groupBy(unit).agg(F.sum(x * x).alias("q"))
    dot = _met(table, unit, value).groupBy("id1", "id2").agg(F.sum(F.col("v1") * F.col("v2")).alias("dot"))
    q = lambda i: norms.select(F.col(unit).alias(f"id{i}"), F.col("q").alias(f"q{i}"))
    pairs = all_pairs(table, unit).join(dot, ["id1", "id2"], "left").join(q(1), "id1").join(q(2), "id2")
    return pairs.select("id1", "id2", F.sqrt(F.greatest(F.col("q1") + F.col("q2") - 2 * F.coalesce("dot", F.lit(0.0)), F.lit(0.0))).alias("dist"))


def cosine_between(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(id1, id2, cosine) between the columns of two tables (id, feature, value) with |cosine| at least ``least``."""
    norm = lambda t, i: t.groupBy("id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias(f"n{i}")).withColumnRenamed("id", f"id{i}")
    dot = a.select("feature", F.col("id").alias("id1"), F.col("value").alias("v1")).join(b.select("feature", F.col("id").alias("id2"), F.col("value").alias("v2")), "feature").groupBy("id1", "id2").agg(F.sum(F.col("v1") * F.col("v2")).alias("dot"))
    both = dot.join(norm(a, 1), "id1").join(norm(b, 2), "id2").where("n1 > 0 and n2 > 0")
    return both.select("id1", "id2", (F.col("dot") / (F.col("n1") * F.col("n2"))).alias("cosine")).where(F.abs("cosine") >= least)


def labelled(pairs: DataFrame, labels: DataFrame, unit: str, columns: list[str]) -> DataFrame:
    """Pair rows with each column of ``labels`` for both ends: <column>_1 and <column>_2."""
    side = lambda i: labels.select(F.col(unit).alias(f"id{i}"), *[F.col(c).alias(f"{c}_{i}") for c in columns])
    return pairs.join(side(1), "id1").join(side(2), "id2")
