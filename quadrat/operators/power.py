"""Power by simulation: draws, relabelled nulls, tests inside every simulation, all in one plan.

``keys`` name one simulation (scenario, size, rep); draws are reproducible by hash, like all
of ``resample``. Nothing loops over sizes or repetitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .resample import bootstrap, power


def hybrid_control_size(n: Column, actual: Column | int) -> Column:
    """Controls for ``n`` cases: the number there is while n is not larger, then n."""
    actual = F.lit(actual) if isinstance(actual, int) else actual
    return F.when(n <= actual, actual).otherwise(n)


def scenarios(strata: DataFrame, folds: list[float], most: int) -> DataFrame:
    """(scenario, feature, fold): each stratum's first ``most`` features (by rank) with each fold. ``strata``: (stratum, feature, rank)."""
    chosen = strata.where(F.col("rank") <= most)
    spark = strata.sparkSession
    return chosen.join(F.broadcast(spark.createDataFrame([(f,) for f in folds], "fold double"))).select(F.concat_ws("_x", "stratum", F.col("fold").cast("string")).alias("scenario"), "feature", "fold")


def pooled_null(units: DataFrame, unit: str, reps: int, n: int, seed: str = "1") -> DataFrame:
    """(rep, slot, unit, grp): 2 n draws from all units; the first n count as group 1, the others as group 2, whatever they are."""
    drawn = bootstrap(units.select(unit), unit, reps, 2 * n, None, seed)
    return drawn.select("rep", "slot", unit, F.when(F.col("slot") < n, "1").otherwise("2").alias("grp"))


def within_unit_draws(samples: DataFrame, unit: str, reps: int, n: int, seed: str = "1") -> DataFrame:
    """Units drawn with replacement with all their samples and labels: the sample rows with rep, slot."""
    return bootstrap(samples.select(unit).distinct(), unit, reps, n, None, seed).select("rep", "slot", unit).join(samples, unit)


def spiked_shares(profiles: DataFrame, spiked: DataFrame, unit: str, fold: Column) -> DataFrame:
    """(unit, feature, p): relative abundances with the spiked features multiplied, brought back to a sum of one. ``spiked``: (unit, feature)."""
    marked = profiles.join(spiked.select(unit, "feature", F.lit(1).alias("_s")), [unit, "feature"], "left")
    raised = marked.withColumn("_p", F.col("p") * F.when(F.col("_s") == 1, fold).otherwise(1.0))
    total = F.sum("_p").over(Window.partitionBy(unit))
    return raised.withColumn("p", F.try_divide(F.col("_p"), total)).drop("_s", "_p")


def shuffled_labels(rows: DataFrame, keys: list[str], unit: str, label: str, perms: int, block: str | None = None, seed: str = "1") -> DataFrame:
    """The rows with ``perm``: 0 has the true labels, 1 to ``perms`` have them shuffled within each simulation (and block)."""
    part = [*keys, *([block] if block else [])]
    each = rows.drop(label).join(F.broadcast(rows.sparkSession.range(1, perms + 1).select(F.col("id").cast("int").alias("perm"))))
    by_hash = F.md5(F.concat_ws("|", F.lit(seed), "perm", *[F.col(k).cast("string") for k in keys], F.col(unit).cast("string")).cast("binary"))
    places = each.withColumn("_k", F.row_number().over(Window.partitionBy("perm", *part).orderBy(by_hash, unit)))
    own = rows.select(*part, label, F.row_number().over(Window.partitionBy(*part).orderBy(unit)).alias("_k"))
    moved = places.join(own, [*part, "_k"]).select("perm", *rows.columns)
    return rows.select(F.lit(0).alias("perm"), *rows.columns).union(moved)


def permanova_p(draws: DataFrame, pairs: DataFrame, keys: list[str], perms: int, block: str | None = None, on: list[str] | None = None) -> DataFrame:
    """(keys, r2, p) of draws (keys, uid, item, grp[, block]) with distances (on, id1, id2, dist) between items; a unit drawn twice is at distance 0.

    A label set with every R-squared at most the observed one gives p = 1 / (perms + 1).
    """
    on = on or []
    one = draws.select(*keys, F.col("uid").alias("u1"), F.col("item").alias("i1"))
    two = draws.select(*keys, F.col("uid").alias("u2"), F.col("item").alias("i2"))
    met = one.join(two, keys).where("u1 < u2")
    far = met.join(pairs, [*[met[c] == pairs[c] for c in on], F.least("i1", "i2") == F.col("id1"), F.greatest("i1", "i2") == F.col("id2")], "left").select(*[met[k] for k in keys], "u1", "u2", F.coalesce(F.col("dist") * F.col("dist"), F.lit(0.0)).alias("d2"))
    labels = shuffled_labels(draws.select(*keys, "uid", "grp", *([block] if block else [])), keys, "uid", "grp", perms, block)
    size = draws.groupBy(*keys, "grp").agg(F.count(F.lit(1)).alias("_m"))
    side = lambda i: labels.select(*keys, "perm", F.col("uid").alias(f"u{i}"), F.col("grp").alias(f"g{i}"))
    sums = far.join(side(1), [*keys, "u1"]).join(side(2), [*keys, "perm", "u2"]).groupBy(*keys, "perm", F.when(F.col("g1") == F.col("g2"), F.col("g1")).alias("grp")).agg(F.sum("d2").alias("s"))
    n = size.groupBy(*keys).agg(F.sum("_m").alias("n"))
    whole = sums.join(size, [*keys, "grp"], "left").groupBy(*keys, "perm").agg(F.sum("s").alias("s"), F.coalesce(F.sum(F.col("s") / F.col("_m")), F.lit(0.0)).alias("within")).join(n, keys)
    r2 = whole.select(*keys, "perm", F.round(1 - F.try_divide(F.col("within"), F.col("s") / F.col("n")), 9).alias("r2"))
    own = r2.where("perm = 0").select(*keys, F.col("r2").alias("own"))
    hits = F.sum(F.when((F.col("perm") > 0) & (F.col("r2") >= F.col("own")), 1).otherwise(0))
    return r2.join(own, keys).groupBy(*keys).agg(F.max("own").alias("r2"), ((1 + hits) / (perms + 1.0)).alias("p"))


def permanova_power(tests: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """(by, power, reps, mean_r2, low, high) of permanova_p's rows; low and high hold the middle 95 per cent of R-squared."""
    more = tests.groupBy(*by).agg(F.avg("r2").alias("mean_r2"), F.percentile("r2", 0.025).alias("low"), F.percentile("r2", 0.975).alias("high"))
    return power(tests, by, "p", alpha).join(more, by)


def sizes_of(draws: DataFrame, sizes: list[int]) -> DataFrame:
    """The draws of the largest size as draws of every size: the first ``size`` slots."""
    grid = draws.sparkSession.createDataFrame([(s,) for s in sizes], "size int")
    return draws.join(F.broadcast(grid), F.col("slot") < F.col("size"))


def bray_curtis_within(profiles: DataFrame, keys: list[str], unit: str, value: str = "p") -> DataFrame:
    """(keys, id1, id2, dist) for all pairs of units of one key: the output itself is quadratic in a key's units."""
    totals = profiles.groupBy(*keys, unit).agg(F.sum(value).alias("t"))
    side = lambda df, i, v: df.select(*keys, *([] if v == "t" else ["feature"]), F.col(unit).alias(f"id{i}"), F.col(v).alias(f"v{i}"))
    common = side(profiles, 1, value).join(side(profiles, 2, value), [*keys, "feature"]).where("id1 < id2").groupBy(*keys, "id1", "id2").agg(F.sum(F.least("v1", "v2")).alias("c"))
    pairs = side(totals, 1, "t").join(side(totals, 2, "t"), keys).where("id1 < id2").join(common, [*keys, "id1", "id2"], "left")
    return pairs.select(*keys, "id1", "id2", F.coalesce(1 - F.try_divide(2.0 * F.coalesce("c", F.lit(0.0)), F.col("v1") + F.col("v2")), F.lit(0.0)).alias("dist"))


def permanova_grid(profiles: DataFrame, units: DataFrame, spikes: DataFrame, spiked: str, sizes: list[int], reps: int, perms: int, alpha: float = 0.05, stop: float = 0.995) -> DataFrame:
    """(kind, scenario, size, controls, power, reps, mean_r2, low, high) over kinds of samples, scenarios and sizes of the spiked group.

    ``profiles`` (kind, unit, feature, p) are relative abundances, ``units`` (unit, grp), ``spikes`` (scenario, feature, fold) multiply
    features of the group ``spiked``; a scenario whose feature is null changes nothing. A simulation draws ``size`` units of that group
    and, while no more than there are are asked for, all the others' number, else as many. Kinds, scenarios and
    repetitions are one plan for each size; from the size on whose power reaches ``stop`` a kind and scenario are left out.
    """
    from ..streaming.checkpoints import cut

    held = cut(profiles.join(units, "unit"))
    every = held.join(F.broadcast(spikes.select("scenario").distinct()))  # a row for each scenario
    raised = every.join(spikes.where("feature is not null"), ["scenario", "feature"], "left").withColumn("x", F.col("p") * F.when(F.col("grp") == spiked, F.coalesce("fold", F.lit(1.0))).otherwise(1.0))
    shares = raised.withColumn("p", F.try_divide("x", F.sum("x").over(Window.partitionBy("kind", "scenario", "unit"))))
    pairs = cut(bray_curtis_within(shares.select("kind", "scenario", "unit", "feature", "p"), ["kind", "scenario"], "unit"))
    members = held.select("kind", "unit", "grp").distinct().withColumn("g", F.concat_ws("|", "kind", "grp"))
    others = members.where(F.col("grp") != spiked).groupBy("kind").agg(F.count(F.lit(1)).cast("int").alias("others"))
    most = max(max(sizes), others.agg(F.max("others")).first()[0] or 0)
    drawn = bootstrap(members, "unit", reps, most, "g").join(members.select("g", "kind", "grp").distinct(), "g").join(others, "kind")
    drawn = cut(drawn.select("kind", "rep", "slot", "unit", "grp", "others"))
    open_ = cut(pairs.select("kind", "scenario").distinct())
    found = None
    for size in sorted(sizes):
        controls = hybrid_control_size(F.lit(size), F.col("others"))
        here = drawn.where(F.col("slot") < F.when(F.col("grp") == spiked, F.lit(size)).otherwise(controls)).join(open_, "kind")
        draws = cut(here.select("kind", "scenario", F.lit(size).alias("size"), "rep", F.concat_ws("#", "grp", "slot").alias("uid"), F.col("unit").alias("item"), "grp"))
        tests = cut(permanova_p(draws, pairs, ["kind", "scenario", "size", "rep"], perms, None, ["kind", "scenario"]))
        rows = cut(permanova_power(tests, ["kind", "scenario", "size"], alpha))
        found = rows if found is None else found.unionByName(rows)
        open_ = open_.join(rows.where(F.col("power") >= stop), ["kind", "scenario"], "left_anti")
        if open_.isEmpty():
            break
    return found.join(others, "kind").withColumn("controls", hybrid_control_size(F.col("size"), F.col("others"))).drop("others")


def effect_intervals(profiles: DataFrame, values: DataFrame, units: DataFrame, first: str, reps: int) -> DataFrame:
    """(kind, metric, value, low, high): effects of group ``first`` against the other in every kind of samples, with the middle 95 per cent of bootstrap draws.

    ``profiles`` (kind, unit, feature, p) give the community R-squared, ``values`` (kind, unit, v), one diversity for each unit, Cohen's d
    (pooled deviation) and the difference of medians. A draw takes as many units of each group, with replacement, as there
    are in the kind. Kinds, draws and metrics are one plan. A metric without variance is null.
    """
    from ..streaming.checkpoints import cut

    members = profiles.select("kind", "unit").distinct().join(units, "unit").withColumn("g", F.concat_ws("|", "kind", "grp"))
    sizes = members.groupBy("g").agg(F.count(F.lit(1)).cast("int").alias("m"))
    most = sizes.agg(F.max("m")).first()[0] or 1
    drawn = bootstrap(members, "unit", reps, most, "g").join(sizes, "g").where("slot < m").join(members.select("g", "kind", "grp").distinct(), "g")
    draws = drawn.select("kind", (F.col("rep") + 1).cast("int").alias("rep"), F.concat_ws("#", "grp", "slot").alias("uid"), F.col("unit").alias("item"), "grp")
    own = members.select("kind", F.lit(0).alias("rep"), F.concat_ws("#", F.lit("own"), F.col("unit").cast("string")).alias("uid"), F.col("unit").alias("item"), "grp")
    draws = cut(own.unionByName(draws))
    r2 = permanova_p(draws, cut(bray_curtis_within(profiles, ["kind"], "unit")), ["kind", "rep"], 0, None, ["kind"]).select("kind", "rep", F.lit("permanova_r2").alias("metric"), F.col("r2").alias("value"))
    v = draws.join(values.withColumnRenamed("unit", "item"), ["kind", "item"])
    one, two = F.when(F.col("grp") == first, F.col("v")), F.when(F.col("grp") != first, F.col("v"))
    m = v.groupBy("kind", "rep").agg(*[f(x).alias(f"{n}{k}") for k, x in ((1, one), (2, two)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp), ("d", F.median))])
    pooled = F.sqrt(F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2"), F.col("n1") + F.col("n2") - 2))
    both = m.select("kind", "rep", F.inline(F.array(F.struct(F.lit("shannon_d").alias("metric"), F.try_divide(F.col("m1") - F.col("m2"), pooled).alias("value")), F.struct(F.lit("shannon_median_difference").alias("metric"), (F.col("d1") - F.col("d2")).alias("value")))))
    found = cut(r2.unionByName(both))
    spread = found.where("rep > 0").groupBy("kind", "metric").agg(F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high"))
    return found.where("rep = 0").drop("rep").join(spread, ["kind", "metric"], "left")
