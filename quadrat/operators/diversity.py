"""Alpha diversity, patient profiles and accumulation curves of sparse counts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.transforms import relative
from ..streaming.checkpoints import cut

#: Orders whose places are side by side in one row.
ORDERS = 20
#: Rows of places up to which they are broadcast.
PLACES = 200_000


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shannon(counts: DataFrame, keys: list[str], base: float | None = None, value: str = "count") -> DataFrame:
    """(keys, shannon) = -sum p ln p, in one aggregation: ln T - sum(c ln c) / T. Natural logarithm by default."""
    c = F.col(value).cast("double")
    sums = counts.where(F.col(value) > 0).groupBy(*keys).agg(F.sum(c).alias("t"), F.sum(c * F.log(c)).alias("e"))
    return sums.select(*keys, ((F.log("t") - F.col("e") / F.col("t")) / (math.log(base) if base else 1.0)).alias("shannon"))


def hill2(counts: DataFrame, keys: list[str], value: str = "count") -> DataFrame:
    """(keys, hill) = 1 / sum p^2; 0 where the total is 0."""
    c = F.col(value).cast("double")
    sums = counts.groupBy(*keys).agg(F.sum(c).alias("t"), F.sum(c * c).alias("q"))
    return sums.select(*keys, F.when(F.col("q") > 0, F.col("t") * F.col("t") / F.when(F.col("q") > 0, F.col("q"))).otherwise(0.0).alias("hill"))


def gini(counts: DataFrame, n_features: int, value: str = "count") -> DataFrame:
    """(sample, gini) over all features, absent ones as zero.

    With values sorted ascending, gini = 2 sum(i x_i) / (n sum x) - (n + 1) / n; zeros
    take the first places and add nothing, so only the present rows are ranked.
    """
    w = Window.partitionBy("sample").orderBy(value, "feature")
    present = F.count(F.lit(1)).over(Window.partitionBy("sample"))
    placed = counts.withColumn("i", F.row_number().over(w) + n_features - present)
    x = F.col(value).cast("double")
    sums = placed.groupBy("sample").agg(F.sum(F.col("i") * x).alias("ix"), F.sum(x).alias("x"))
    return sums.select("sample", (2 * F.col("ix") / (n_features * F.col("x")) - (n_features + 1) / n_features).alias("gini"))


def mean_relative_profile(counts: DataFrame, by: list[str], sample: str = "sample") -> DataFrame:
    """(by, feature, p): the mean of the samples' relative abundances, samples without the feature as 0."""
    rel = relative(counts, sample)
    n = counts.groupBy(*by).agg(F.countDistinct(sample).alias("n"))
    return rel.groupBy(*by, "feature").agg(F.sum("p").alias("s")).join(n, by).select(*by, "feature", (F.col("s") / F.col("n")).alias("p"))


def summed_profile(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, feature, count, p): summed counts, and their share of the group's total."""
    sums = counts.groupBy(*by, "feature").agg(F.sum("count").alias("count"))
    return relative(sums, by)


def by_taxon(counts: DataFrame, taxonomy: DataFrame, rank: str) -> DataFrame:
    """(sample, rank, count); features without the rank are left out before any total is taken."""
    return counts.join(taxonomy.where(F.col(rank).isNotNull()).select("feature", rank), "feature").groupBy("sample", rank).agg(F.sum("count").alias("count"))


def control_corrected(counts: DataFrame, group: str, controls: list[str]) -> DataFrame:
    """Non-control rows with ``corrected``: count minus the sum over control groups of the feature's mean
    over control samples where it is present, at least 0, cut to a whole number."""
    means = counts.where(F.col(group).isin(controls) & (F.col("count") > 0)).groupBy("feature", group).agg(F.avg("count").alias("m"))
    background = means.groupBy("feature").agg(F.sum("m").alias("background"))
    rest = counts.where(~F.col(group).isin(controls)).join(background, "feature", "left")
    left = F.greatest(F.col("count") - F.coalesce("background", F.lit(0.0)), F.lit(0.0))
    return rest.withColumn("corrected", left.cast("bigint")).drop("background")


def shuffled(units: DataFrame, reps: int, key: str, within: list[str] | None = None, seed: str = "1") -> DataFrame:
    """(rep, within, key, k): a random order of the units, by hash, in every repetition; k from 1."""
    each = units.crossJoin(F.broadcast(units.sparkSession.range(1, reps + 1).select(F.col("id").cast("int").alias("rep"))))
    by = F.md5(F.concat_ws("|", F.lit(seed), "rep", F.col(key).cast("string")).cast("binary"))
    return each.withColumn("k", F.row_number().over(Window.partitionBy("rep", *(within or [])).orderBy(by, key)))


def accumulation(counts: DataFrame, group: str, reps: int, seed: str = "1") -> DataFrame:
    """(group, k, mean, low, high): distinct features after k samples in random order.

    A feature counts from the first sample of an order that has it, so each repetition
    needs one minimum per feature and one running sum over the positions. The orders go to the cells
    by broadcast while they are few: a sample may have a large share of all cells.
    """
    orders = cut(shuffled(counts.select(group, "sample").distinct(), reps, "sample", [group], seed))
    # A cell takes its sample's places in a block of orders as one row, so cells are not repeated for each order.
    block = F.floor((F.col("rep") - 1) / ORDERS)
    places = orders.groupBy(group, "sample", block.alias("_b")).agg(*[F.min(F.when((F.col("rep") - 1) % ORDERS == i, F.col("k"))).alias(f"k{i}") for i in range(min(ORDERS, reps))])
    least = counts.select(group, "sample", "feature").join(maybe_broadcast(places, PLACES), [group, "sample"]).groupBy(group, "feature", "_b").agg(*[F.min(f"k{i}").alias(f"k{i}") for i in range(min(ORDERS, reps))])
    each = least.select(group, "_b", F.posexplode(F.array(*[f"k{i}" for i in range(min(ORDERS, reps))])).alias("_i", "k")).where("k is not null")
    first = each.select(group, (F.col("_b") * ORDERS + F.col("_i") + 1).cast("int").alias("rep"), "k")
    new = first.groupBy(group, "rep", "k").agg(F.count(F.lit(1)).alias("new"))
    full = orders.select(group, "rep", "k").join(new, [group, "rep", "k"], "left")
    run = F.sum(F.coalesce("new", F.lit(0))).over(Window.partitionBy(group, "rep").orderBy("k"))
    seen = full.select(group, "rep", "k", run.alias("seen"))
    return seen.groupBy(group, "k").agg(F.avg("seen").alias("mean"), F.percentile("seen", 0.025).alias("low"), F.percentile("seen", 0.975).alias("high"))
