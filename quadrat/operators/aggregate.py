"""Roll-ups, collapses, attrition tables and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_statistics(counts: DataFrame) -> DataFrame:
    """For each feature: non-zero samples, sum, mean over present samples, largest and smallest."""
    x = F.col("count")
    return counts.groupBy("feature").agg(F.sum(F.when(x != 0, 1).otherwise(0)).alias("n_nonzero"), F.sum(x).alias("total"), F.avg(x).alias("mean"), F.max(x).alias("largest"), F.min(x).alias("smallest"))


def collapse_text(col: Column, most: int = 25) -> Column:
    """Aggregate: sorted distinct non-empty texts joined by ``|``; from the 26th on ``|...``."""
    texts = F.array_sort(F.collect_set(F.nullif(F.trim(col), F.lit(""))))
    head = F.array_join(F.slice(texts, 1, most), "|")
    return F.when(F.size(texts) > most, F.concat(head, F.lit("|..."))).otherwise(head)


def collapse_number(col: str) -> Column:
    """Aggregate: the value if there is only one; else the sum of count-like columns and the mean of others."""
    lower = col.lower()
    adds = "count" in lower or lower.endswith(("_sum", "_degree", "_n"))
    rest = F.sum(col).cast("double") if adds else F.avg(col)
    return F.when(F.countDistinct(col) == 1, F.max(col).cast("double")).otherwise(rest)


def endpoint_features(edges: DataFrame, prefix: str) -> DataFrame:
    """Edge table (a, b, weight) to node features: degree, weight sum, mean, and sum of absolute weights."""
    ends = edges.select(F.col("a").alias("node"), "weight").union(edges.select(F.col("b").alias("node"), "weight"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias(f"{prefix}_degree"), F.sum("weight").alias(f"{prefix}_weight_sum"), F.avg("weight").alias(f"{prefix}_weight_mean"), F.sum(F.abs("weight")).alias(f"{prefix}_abs_weight_sum"))


def first_failing_step(flags: list[str]) -> Column:
    """1-based place of the first 0 among ordered flags; null if none."""
    out = F.lit(None).cast("int")
    for i in range(len(flags), 0, -1):
        out = F.when(F.col(flags[i - 1]) == 0, F.lit(i)).otherwise(out)
    return out


def cumulative_attrition(master: DataFrame, flags: list[str]) -> DataFrame:
    """(step, method, non_target, target): how many rows any of the first methods flagged (0), and the rest."""
    steps = master.sparkSession.createDataFrame([(i + 1, f) for i, f in enumerate(flags)], "step int, method string")
    failed = master.groupBy(first_failing_step(flags).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    total = failed.agg(F.sum("n").alias("all"))
    joined = F.broadcast(steps).join(failed, "step", "left").crossJoin(F.broadcast(total))
    so_far = F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))  # a row for each method
    return joined.select("step", "method", so_far.alias("non_target"), (F.col("all") - so_far).alias("target"))


def flagged_by_method(master: DataFrame, flags: list[str]) -> DataFrame:
    """(method, non_target, target) of each method alone."""
    long = master.unpivot([], flags, "method", "flag")
    return long.groupBy("method").agg(F.sum(F.when(F.col("flag") == 0, 1).otherwise(0)).alias("non_target"), F.sum(F.when(F.col("flag") == 0, 0).otherwise(1)).alias("target"))


def stage_losses(stages: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(by, stage, step, total, lost) along ordered stage columns, summed over the groups."""
    total = stages.groupBy(by).agg(*[F.sum(c).alias(c) for c in columns])
    long = total.unpivot([by], columns, "stage", "total")
    step = F.array_position(F.array(*map(F.lit, columns)), F.col("stage")).cast("int")
    w = Window.partitionBy(by).orderBy("step")
    return long.withColumn("step", step).withColumn("lost", F.lag("total").over(w) - F.col("total"))


def group_percent(df: DataFrame, by: list[str], value: str, name: str = "percent") -> DataFrame:
    """Adds 100 * value / sum of value in the group."""
    return df.withColumn(name, 100.0 * F.col(value) / F.sum(value).over(Window.partitionBy(*by)))


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def top_with_other(totals: DataFrame, key: str, value: str, n: int, other: str = "Other") -> DataFrame:
    """The ``n`` largest keys (ties by key) and the sum of the rest under ``other``."""
    top = totals.orderBy(F.desc(value), F.asc(key)).limit(n).select(key, F.lit(True).alias("_top"))
    return totals.join(F.broadcast(top), key, "left").groupBy(F.when(F.col("_top"), F.col(key)).otherwise(F.lit(other)).alias(key)).agg(F.sum(value).alias(value))


def rank_universe(totals: DataFrame, by: str, key: str, value: str, n: int, extra: DataFrame | None = None) -> DataFrame:
    """(key): the top ``n`` of every group together, and the keys of ``extra``."""
    top = top_per_group(totals, [by], [F.desc(value), F.asc(key)], n).select(key)
    return (top.union(extra.select(key)) if extra is not None else top).distinct()


def cohort_summary(samples: DataFrame, fine: list[str], coarse: list[str], unit: str) -> DataFrame:
    """Distinct units by the fine and by the coarse keys, one under the other."""
    count = lambda keys, level: samples.groupBy(*keys).agg(F.countDistinct(unit).alias("n")).withColumn("level", F.lit(level))
    return count(fine, "fine").unionByName(count(coarse, "coarse"), allowMissingColumns=True)


def dense_codes(df: DataFrame, column: str, name: str, prefix: str, width: int = 1, first: int = 0) -> DataFrame:
    """Adds ``name``: the prefix and the dense order of the column's value, counted from ``first`` and padded to ``width``; null for null.

    Values are ranged and numbered part by part; a row for each part holds where it begins.
    """
    from ..streaming.checkpoints import cut

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = df.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(parts, column).sortWithinPartitions(column)
    placed = cut(ids.select(column, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_k")))
    starts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    number = (F.col("_before") + F.col("_k") + first).cast("string")
    padded = F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number)
    codes = placed.join(F.broadcast(starts), "_part").select(column, F.concat(F.lit(prefix), padded).alias(name))
    return df.join(codes, column, "left")


def suffixed_join(left: DataFrame, right: DataFrame, on: list[str], suffixes: tuple[str, str] = ("_x", "_y"), how: str = "inner") -> DataFrame:
    """A join in which columns that both sides have, but for the keys, get suffixes."""
    both = [c for c in left.columns if c in right.columns and c not in on]
    return left.withColumnsRenamed({c: c + suffixes[0] for c in both}).join(right.withColumnsRenamed({c: c + suffixes[1] for c in both}), on, how)
