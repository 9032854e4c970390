"""Bootstrap draws and spike-ins, reproducible by hash, and power of tests over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the MD5 of the parts: 32 bits."""
    said = F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def bootstrap(units: DataFrame, unit: str, reps: int, n: int, group: str | None = None, seed: str = "1") -> DataFrame:
    """(rep, slot, group, unit, unique_id): ``n`` draws with replacement from each group in every repetition.

    A unit drawn again gets ids ``<unit>__b0``, ``<unit>__b1`` and so on.
    """
    keys = [group] if group else []
    w = Window.partitionBy(*keys)
    listed = units.select(unit, *keys).distinct().withColumn("k", F.row_number().over(w.orderBy(unit)) - 1).withColumn("m", F.count(F.lit(1)).over(w))
    spark = units.sparkSession
    slots = spark.range(reps * n).select((F.col("id") / n).cast("int").alias("rep"), (F.col("id") % n).cast("int").alias("slot"))
    sizes = listed.select(*keys, "m").distinct()
    drawn = slots.crossJoin(F.broadcast(sizes)).withColumn("k", F.floor(uniform(F.lit(seed), "rep", "slot", *keys) * F.col("m")).cast("int"))
    found = drawn.join(listed.drop("m"), [*keys, "k"])
    again = F.row_number().over(Window.partitionBy("rep", *keys, unit).orderBy("slot")) - 1
    return found.select("rep", "slot", *keys, unit, F.concat_ws("__b", F.col(unit).cast("string"), again.cast("string")).alias("unique_id"))


def spike_in(counts: DataFrame, spiked: DataFrame, fold: float) -> DataFrame:
    """Multiplies the spiked features' counts and scales the others so that each sample keeps its total.

    Others are scaled to what is left, floored, and the largest remainders (ties by
    feature) get one more until the total is right. If the spiked counts exceed the
    total, they are scaled down to it in the same way and the others are 0.
    """
    rows = counts.join(spiked.select("feature", F.lit(True).alias("_s")), "feature", "left")
    raised = F.when(F.col("_s"), F.floor(F.col("count") * fold)).otherwise(0)
    w = Window.partitionBy("sample")
    rows = rows.withColumn("_up", raised).withColumn("_total", F.sum("count").over(w)).withColumn("_spiked", F.sum("_up").over(w)).withColumn("_rest", F.sum(F.when(F.col("_s"), 0).otherwise(F.col("count"))).over(w))
    fits = F.col("_spiked") <= F.col("_total")
    target = (
        F.when(F.col("_s") & fits & (F.col("_rest") > 0), F.col("_up").cast("double"))
        .when(F.col("_s"), F.when(F.col("_spiked") > 0, F.col("_up") * F.col("_total") / F.when(F.col("_spiked") > 0, F.col("_spiked"))).otherwise(0.0))
        .when(fits & (F.col("_rest") > 0), F.col("count") * (F.col("_total") - F.col("_spiked")) / F.when(F.col("_rest") > 0, F.col("_rest")))
        .otherwise(0.0)
    )
    rows = rows.withColumn("_t", F.round(target, 9)).withColumn("_f", F.floor("_t"))
    rows = rows.withColumn("_short", F.col("_total") - F.sum("_f").over(w)).withColumn("_place", F.row_number().over(w.orderBy(F.desc(F.col("_t") - F.col("_f")), "feature")))
    return rows.withColumn("spiked_count", (F.col("_f") + F.when(F.col("_place") <= F.col("_short"), 1).otherwise(0)).cast("bigint")).select(*counts.columns, "spiked_count")


def bootstrap_interval(draws: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, mean, low, high): 2.5 and 97.5 percentiles over repetitions."""
    return draws.groupBy(*by).agg(F.avg(value).alias("mean"), F.percentile(value, 0.025).alias("low"), F.percentile(value, 0.975).alias("high"))


def power(tests: DataFrame, by: list[str], p: str, alpha: float = 0.05) -> DataFrame:
    """(by, power, reps): the share of repetitions with p below alpha."""
    return tests.groupBy(*by).agg(F.avg(F.when(F.col(p) < alpha, 1.0).otherwise(0.0)).alias("power"), F.count(F.lit(1)).alias("reps"))


def size_for_power(curve: DataFrame, by: list[str], n: str, least: float = 0.8) -> DataFrame:
    """(by, n_needed, power_at_max, verdict): the least n whose power reaches ``least``."""
    return curve.groupBy(*by).agg(F.min(F.when(F.col("power") >= least, F.col(n))).alias("n_needed"), F.max_by("power", n).alias("power_at_max")).withColumn("verdict", F.when(F.col("n_needed").isNotNull(), "Adequate").otherwise("Underpowered"))


def taxon_power(values: DataFrame, spiked: DataFrame, group: str, first: str, alpha: float = 0.05) -> DataFrame:
    """(power, sensitivity, fdr, reps) of rank tests over values (rep, feature, group, v), adjusted within each repetition.

    Power: repetitions with any significant spiked feature; sensitivity: mean share of the
    spiked features found; fdr: mean share of the other features found.
    """
    from . import stats

    tested = stats.mann_whitney(values, ["rep", "feature"], group, first, "v").withColumn("p", stats.normal_tail2("z"))
    adjusted = stats.benjamini_hochberg(tested, "p", ["rep"], ["feature"])
    marked = adjusted.join(spiked.select("feature", F.lit(1).alias("s")), "feature", "left")
    found = F.when(F.col("q") < alpha, 1.0).otherwise(0.0)
    each = marked.groupBy("rep").agg(F.max(F.when(F.col("s") == 1, found)).alias("any"), F.avg(F.when(F.col("s") == 1, found)).alias("sens"), F.avg(F.when(F.col("s").isNull(), found)).alias("false"))
    return each.agg(F.avg("any").alias("power"), F.avg("sens").alias("sensitivity"), F.avg("false").alias("fdr"), F.count(F.lit(1)).alias("reps"))
