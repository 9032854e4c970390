"""Indicator features: specificity, fidelity and their significance for combinations of groups."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .permute import permuted_labels


def combos(groups: list, singletons_only: bool = False) -> list[int]:
    """Bitmasks of the group combinations tested: all but the full union, or single groups."""
    n = len(groups)
    sizes = [1] if singletons_only else range(1, n)
    return [sum(1 << i for i in c) for k in sizes for c in combinations(range(n), k)]


def indicator_values(profiles: DataFrame, labels: DataFrame, unit: str, label: str, groups: list, singletons_only: bool = False) -> DataFrame:
    """(rep, feature, mask, a, b, stat) of the best combination of each feature, for labels (rep, unit, label).

    a: the share of the feature's summed group means that lies in the combination;
    b: the share of the combination's units in which it is present; stat = sqrt(a b).
    Ties go to the smaller mask. Profiles are sparse (unit, feature, p); absent is 0.
    """
    size = labels.groupBy("rep", label).agg(F.count(F.lit(1)).alias("size"))
    sums = profiles.where("p > 0").join(labels, unit).groupBy("rep", "feature", label).agg(F.sum("p").alias("s"), F.count(F.lit(1)).alias("n"))
    bit = F.call_function("shiftleft", F.lit(1), (F.array_position(F.array(*map(F.lit, groups)), F.col(label)) - 1).cast("int"))
    per = sums.join(F.broadcast(size), ["rep", label]).select("rep", "feature", bit.alias("bit"), (F.col("s") / F.col("size")).alias("mean"), "n")
    sizes = size.select("rep", bit.alias("bit"), "size")
    masks = labels.sparkSession.createDataFrame([(m,) for m in combos(groups, singletons_only)], "mask int")
    inside = lambda df: df.crossJoin(F.broadcast(masks)).where(F.col("mask").bitwiseAND(F.col("bit")) != 0)
    whole = per.groupBy("rep", "feature").agg(F.sum("mean").alias("all"))
    combo_size = inside(sizes).groupBy("rep", "mask").agg(F.sum("size").alias("units"))
    found = inside(per).groupBy("rep", "feature", "mask").agg(F.sum("mean").alias("in_mean"), F.sum("n").alias("in_n"))
    scored = found.join(F.broadcast(combo_size), ["rep", "mask"]).join(whole, ["rep", "feature"])
    a, b = F.col("in_mean") / F.col("all"), F.col("in_n") / F.col("units")
    best = scored.select("rep", "feature", "mask", a.alias("a"), b.alias("b"), F.round(F.sqrt(a * b), 9).alias("stat"))
    top = F.min(F.struct((-F.col("stat")).alias("x"), "mask", "a", "b", "stat")).alias("t")
    return best.groupBy("rep", "feature").agg(top).select("rep", "feature", "t.mask", "t.a", "t.b", "t.stat")


def indicator_test(profiles: DataFrame, units: DataFrame, unit: str, label: str, groups: list, reps: int, block: str | None = None, singletons_only: bool = False, seed: str = "1") -> DataFrame:
    """(feature, mask, a, b, stat, p): p = (1 + permutations with as large a statistic) / (reps + 1)."""
    values = indicator_values(profiles, permuted_labels(units, unit, label, reps, block, seed), unit, label, groups, singletons_only)
    own = values.where("rep = 0").drop("rep")
    other = values.where("rep > 0").select("feature", F.col("stat").alias("s"))
    hits = own.select("feature", "stat").join(other, "feature", "left").groupBy("feature").agg(F.sum(F.when(F.col("s") >= F.col("stat"), 1).otherwise(0)).alias("hits"))
    return own.join(hits, "feature").select("feature", "mask", "a", "b", "stat", ((F.col("hits") + 1) / (reps + 1)).alias("p"))


def decoded_groups(df: DataFrame, groups: list, mask: str = "mask", name: str = "groups") -> DataFrame:
    return df.withColumn(name, F.concat_ws("+", *[F.when(F.col(mask).bitwiseAND(F.lit(1 << i)) != 0, F.lit(str(g))) for i, g in enumerate(groups)]))


def significance_table(isa: DataFrame, alpha: float = 0.05, least: float = 0.5) -> DataFrame:
    """Adds log_p (of q if there, else of p), passes (q < alpha and stat >= least)."""
    metric = F.coalesce("q", "p")
    return isa.withColumn("log_p", F.round(-F.log10(F.when(metric > 0, metric)), 3)).withColumn("passes", (metric < alpha) & (F.col("stat") >= least))


def indicator_power(draws: DataFrame, profiles: DataFrame, spiked: DataFrame, unit: str, groups: list, perms: int, alpha: float = 0.05) -> DataFrame:
    """(power, sensitivity, fdr, reps) of single-group indicator tests over draws (rep, slot, grp, unit), adjusted within each repetition.

    Power: repetitions with any spiked feature found; sensitivity: mean share of them found; fdr: mean share of the found ones that were not spiked.
    """
    from .power import shuffled_labels
    from .stats import benjamini_hochberg

    drawn = draws.select("rep", F.concat_ws("#", "grp", "slot").alias("uid"), unit, "grp")
    labels = shuffled_labels(drawn, ["rep"], "uid", "grp", perms).select(F.concat_ws("#", "rep", "perm").alias("rep"), F.concat_ws("@", "rep", "uid").alias("uid"), "grp")
    values = profiles.select(unit, "feature", "p").join(drawn.select(F.concat_ws("@", "rep", "uid").alias("uid"), unit), unit).select("uid", "feature", "p")
    found = indicator_values(values, labels, "uid", "grp", groups, True).select(F.substring_index("rep", "#", 1).alias("rep"), F.substring_index("rep", "#", -1).cast("int").alias("perm"), "feature", "stat")
    own = found.where("perm = 0").select("rep", "feature", F.col("stat").alias("own"))
    hits = F.sum(F.when((F.col("perm") > 0) & (F.col("stat") >= F.col("own")), 1).otherwise(0))
    tested = found.join(own, ["rep", "feature"]).groupBy("rep", "feature").agg(((1 + hits) / (perms + 1.0)).alias("p"))
    marked = benjamini_hochberg(tested, "p", ["rep"], ["feature"]).join(spiked.select("feature", F.lit(1).alias("s")), "feature", "left")
    sign, planted = (F.col("q") < alpha).cast("double"), F.col("s") == 1
    each = marked.groupBy("rep").agg(F.max(F.when(planted, sign)).alias("any"), F.avg(F.when(planted, sign)).alias("sens"), F.coalesce(F.try_divide(F.sum(F.when(F.col("s").isNull(), sign)), F.sum(sign)), F.lit(0.0)).alias("false"))
    return each.agg(F.avg("any").alias("power"), F.avg("sens").alias("sensitivity"), F.avg("false").alias("fdr"), F.count(F.lit(1)).alias("reps"))


def stratified_test(profiles: DataFrame, units: DataFrame, unit: str, label: str, stratum: str, groups: list, reps: int) -> DataFrame:
    """(stratum, feature, mask, a, b, stat, p, q): single-group tests within each stratum, all strata in one plan, q over the pooled table."""
    from .power import shuffled_labels
    from .stats import benjamini_hochberg

    labels = shuffled_labels(units.select(stratum, unit, label), [stratum], unit, label, reps)
    keyed = labels.select(F.concat_ws("#", stratum, "perm").alias("rep"), unit, label)
    found = indicator_values(profiles, keyed, unit, label, groups, True)
    split = found.select(F.substring_index("rep", "#", 1).alias(stratum), F.substring_index("rep", "#", -1).cast("int").alias("perm"), "feature", "mask", "a", "b", "stat")
    own = split.where("perm = 0").drop("perm")
    other = split.where("perm > 0").select(stratum, "feature", F.col("stat").alias("s"))
    hits = own.select(stratum, "feature", "stat").join(other, [stratum, "feature"], "left").groupBy(stratum, "feature").agg(F.sum(F.when(F.col("s") >= F.col("stat"), 1).otherwise(0)).alias("hits"))
    tested = own.join(hits, [stratum, "feature"]).withColumn("p", (F.col("hits") + 1) / (reps + 1.0)).drop("hits")
    return benjamini_hochberg(tested, "p", [], [stratum, "feature"])


def without_full_union(table: DataFrame, n_groups: int) -> DataFrame:
    """Rows whose combination is not that of all groups."""
    return table.where(F.col("mask") != (1 << n_groups) - 1)


def merged_metrics(table: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """The table with ``metric``: the summary's q where it has one, else the own q, else p. A q is never replaced by null."""
    own = F.col("q") if "q" in table.columns else F.lit(None).cast("double")
    return table.join(summary.select(*keys, F.col("q").alias("_q")), keys, "left").withColumn("metric", F.coalesce("_q", own, "p")).drop("_q")


def combined(one: DataFrame, two: DataFrame, names: tuple[str, str], alpha: float, least: float) -> DataFrame:
    """(feature, <name>_mask, <name>_stat, ..., label): all features of either table, and in which they pass (p < alpha, stat > least), or none."""
    side = lambda df, n: df.select("feature", F.col("mask").alias(f"{n}_mask"), F.col("stat").alias(f"{n}_stat"), ((F.col("p") < alpha) & (F.col("stat") > least)).alias(f"_{n}"))
    both = side(one, names[0]).join(side(two, names[1]), "feature", "full")
    a, b = (F.col(f"_{n}") for n in names)
    return both.withColumn("label", F.when(a & b, "+".join(names)).when(a, names[0]).when(b, names[1]).otherwise("none")).drop(*[f"_{n}" for n in names])


def analysis_summary(table: DataFrame, by: list[str], alpha: float, n: int) -> tuple[DataFrame, DataFrame]:
    """((by, n_features, n_significant), the ``n`` rows of least p, then largest stat, of each)."""
    from .aggregate import top_per_group

    whole = table.groupBy(*by).agg(F.count(F.lit(1)).alias("n_features"), F.sum(F.when(F.col("p") < alpha, 1).otherwise(0)).alias("n_significant"))
    return whole, top_per_group(table, by, [F.col("p").asc(), F.col("stat").desc(), F.col("feature").asc()], n)


def overlay(df: DataFrame, indicators: DataFrame, label: str, allowed: list[str], least: float, alpha: float) -> DataFrame:
    """``df`` (feature, ...) with ``label`` and ``shown``: the label of a feature whose stat and metric pass and whose label is allowed, else Other."""
    good = (F.col("stat") >= least) & (F.col("metric") < alpha) & F.col(label).isin(allowed)
    joined = df.join(indicators.select("feature", label, "stat", "metric"), "feature", "left").withColumn("shown", F.coalesce(good, F.lit(False)))
    return joined.withColumn(label, F.when(F.col("shown"), F.col(label)).otherwise("Other"))
