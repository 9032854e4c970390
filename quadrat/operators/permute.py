"""Permutation tests over pair tables. Labels are permuted by hash, so results are reproducible in any engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def permuted_labels(units: DataFrame, unit: str, label: str, reps: int, block: str | None = None, seed: str = "1") -> DataFrame:
    """(rep, unit, label): repetition 0 has the true labels, 1 to ``reps`` shuffled ones, within blocks if given.

    A label moves from the unit at a place in id order to the unit at that place in hash order.
    """
    rows = units.select(unit, label, *([block] if block else []))
    blocks = [block] if block else []
    each = rows.crossJoin(F.broadcast(rows.sparkSession.range(1, reps + 1).select(F.col("id").cast("int").alias("rep"))))
    by_hash = F.md5(F.concat_ws("|", F.lit(seed), "rep", F.col(unit).cast("string")).cast("binary"))
    places = each.withColumn("k", F.row_number().over(Window.partitionBy("rep", *blocks).orderBy(by_hash, unit))).select("rep", unit, *blocks, "k")
    own = rows.withColumn("k", F.row_number().over(Window.partitionBy(*blocks).orderBy(unit))).select(label, *blocks, "k")
    moved = places.join(own, [*blocks, "k"]).select("rep", unit, label)
    return rows.select(F.lit(0).alias("rep"), unit, label).union(moved)


def r_squared(pairs: DataFrame, labels: DataFrame, unit: str, label: str) -> DataFrame:
    """(rep, r2, pseudo_f, n, k) of labels (rep, unit, label): 1 - within / total sums of squared distances.

    Within: for each group the sum over its pairs divided by its size; total: over all
    pairs divided by the number of units.
    """
    size = labels.groupBy("rep", label).agg(F.count(F.lit(1)).alias("size"))
    whole = size.groupBy("rep").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("k"))
    a = labels.select("rep", F.col(unit).alias("id1"), F.col(label).alias("g1"))
    b = labels.select("rep", F.col(unit).alias("id2"), F.col(label).alias("g2"))
    d2 = F.col("dist") * F.col("dist")
    sums = pairs.join(a, "id1").join(b, ["rep", "id2"]).groupBy("rep", F.when(F.col("g1") == F.col("g2"), F.col("g1")).alias("g")).agg(F.sum(d2).alias("s"))
    within = sums.join(size.withColumnRenamed(label, "g"), ["rep", "g"], "left").groupBy("rep").agg(F.sum(F.col("s") / F.col("size")).alias("within"), F.sum("s").alias("s"))
    r2 = 1 - F.coalesce("within", F.lit(0.0)) / (F.col("s") / F.col("n"))
    out = within.join(whole, "rep").select("rep", r2.alias("r2"), F.col("n").cast("bigint").alias("n"), "k")
    f = (F.col("r2") / (F.col("k") - 1)) / ((1 - F.col("r2")) / (F.col("n") - F.col("k")))
    return out.withColumn("pseudo_f", F.when((F.col("k") > 1) & (F.col("n") > F.col("k")) & (F.col("r2") < 1), f))


def p_value(stats: DataFrame, stat: str, digits: int = 9) -> DataFrame:
    """(observed, p, reps): (1 + repetitions at least as large as repetition 0) / (repetitions + 1).

    Statistics are compared to ``digits`` decimals, so the order of summation decides no tie.
    """
    x = F.round(stat, digits)
    observed = stats.where("rep = 0").select(x.alias("_o"))
    joined = stats.crossJoin(F.broadcast(observed))
    hits = F.sum(F.when((F.col("rep") > 0) & (x >= F.col("_o")), 1).otherwise(0))
    reps = F.sum(F.when(F.col("rep") > 0, 1).otherwise(0))
    return joined.agg(F.max("_o").alias("observed"), ((1 + hits) / (reps + 1)).alias("p"), reps.alias("reps"))


def permanova(pairs: DataFrame, units: DataFrame, unit: str, label: str, reps: int, block: str | None = None, seed: str = "1") -> DataFrame:
    """(r2, pseudo_f, n, k, p): one row. ``pairs``: (id1, id2, dist) of all pairs of the units."""
    stats = r_squared(pairs, permuted_labels(units, unit, label, reps, block, seed), unit, label)
    own = stats.where("rep = 0").select("r2", "pseudo_f", "n", "k")
    return own.crossJoin(p_value(stats, "r2").select("p"))


def centre_distances(pairs: DataFrame, units: DataFrame, unit: str, label: str) -> DataFrame:
    """(unit, label, r): distance of each unit to the centroid of its group in the space of the distances.

    r^2 is the mean of the squared distances to the group's members less the sum over the group's pairs divided by
    n^2, so no coordinates are needed. Where distances are not Euclidean it can be negative; its absolute value counts.
    """
    rows = units.select(unit, label)
    a, b = rows.toDF("id1", "g1"), rows.toDF("id2", "g2")
    inside = pairs.join(a, "id1").join(b, "id2").where("g1 = g2").select("id1", "id2", F.col("g1").alias(label), (F.col("dist") * F.col("dist")).alias("d2"))
    own = inside.select(F.explode(F.array("id1", "id2")).alias(unit), "d2").groupBy(unit).agg(F.sum("d2").alias("s"))
    whole = inside.groupBy(label).agg(F.sum("d2").alias("w"))
    size = rows.groupBy(label).agg(F.count(F.lit(1)).alias("m"))
    square = F.coalesce("s", F.lit(0.0)) / F.col("m") - F.coalesce("w", F.lit(0.0)) / (F.col("m") * F.col("m"))
    return rows.join(size, label).join(whole, label, "left").join(own, unit, "left").select(unit, label, F.sqrt(F.abs(square)).alias("r"))


def median_distances(pairs: DataFrame, units: DataFrame, unit: str, label: str, rounds: int = 12) -> DataFrame:
    """(unit, label, r): distance of each unit to the spatial median of its group in the space of the distances.

    The median is a weighted mean of the units, whose weights follow their inverse distances to it (Weiszfeld's steps, ``rounds`` of
    them from the centroid on). The squared distance to a weighted mean is the weighted mean of squared distances less
    the weighted sum over the group's pairs, so each round is a join of the group's pairs with the weights. Its absolute
    value counts, as with centroids.
    """
    from ..streaming.checkpoints import cut

    rows = units.select(unit, label)
    a, b = rows.toDF("id1", "g1"), rows.toDF("id2", "g2")
    inside = pairs.join(a, "id1").join(b, "id2").where("g1 = g2").select("id1", "id2", (F.col("dist") * F.col("dist")).alias("d2"))
    both = cut(inside.select(F.col("id1").alias(unit), F.col("id2").alias("other"), "d2").unionByName(inside.select(F.col("id2").alias(unit), F.col("id1").alias("other"), "d2")))
    weights = rows.join(rows.groupBy(label).agg(F.count(F.lit(1)).alias("m")), label).select(unit, label, (1.0 / F.col("m")).alias("a"))
    for turn in range(rounds + 1):
        own = both.join(weights.select(F.col(unit).alias("other"), "a"), "other").groupBy(unit).agg(F.sum(F.col("a") * F.col("d2")).alias("s"))
        far = weights.join(own, unit, "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
        whole = far.groupBy(label).agg((F.sum(F.col("a") * F.col("s")) / 2).alias("w"))
        far = cut(far.join(whole, label).select(unit, label, F.sqrt(F.abs(F.col("s") - F.col("w"))).alias("r")))
        if turn < rounds:
            near = far.withColumn("i", 1 / F.greatest("r", F.lit(1e-9)))
            weights = near.join(near.groupBy(label).agg(F.sum("i").alias("t")), label).select(unit, label, (F.col("i") / F.col("t")).alias("a"))
    return far


def dispersion_test(pairs: DataFrame, units: DataFrame, unit: str, label: str, reps: int, seed: str = "1", median: bool = False) -> DataFrame:
    """(n, k, f, p): do groups spread alike? F of the distances to the centroids (or medians), against F of their residuals under permuted labels."""
    far = (median_distances if median else centre_distances)(pairs, units, unit, label)
    mean = far.groupBy(label).agg(F.avg("r").alias("mean"))
    values = far.join(mean, label).select(unit, "r", (F.col("r") - F.col("mean")).alias("e"))
    rows = permuted_labels(units.select(unit, label), unit, label, reps, None, seed).join(values, unit)
    y = F.when(F.col("rep") == 0, F.col("r")).otherwise(F.col("e"))
    per = rows.groupBy("rep", label).agg(F.count(F.lit(1)).alias("m"), F.sum(y).alias("s"), F.sum(y * y).alias("q"))
    whole = per.groupBy("rep").agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("m")).alias("b"))
    between, within = F.col("b") - F.col("s") * F.col("s") / F.col("n"), F.col("q") - F.col("b")
    f = F.try_divide(F.try_divide(between, F.col("k") - 1), F.try_divide(within, F.col("n") - F.col("k")))
    stats = whole.select("rep", "n", "k", f.alias("f"))
    return stats.where("rep = 0").select("n", "k", "f").crossJoin(p_value(stats, "f").select("p"))


def jackknife_r2(pairs: DataFrame, units: DataFrame, unit: str, label: str, left_out: str) -> DataFrame:
    """(r2, se, low, high): leave-one-out by ``left_out``; se = sqrt((n - 1) * population variance)."""
    outs = units.select(F.col(left_out).alias("out")).distinct()
    rows = units.crossJoin(F.broadcast(outs)).where(F.col(left_out) != F.col("out")).select(F.col("out").alias("rep"), unit, label)
    stats = r_squared(pairs, rows, unit, label).agg(F.avg("r2").alias("mean"), F.var_pop("r2").alias("v"), F.count(F.lit(1)).alias("m"))
    own = r_squared(pairs, units.select(F.lit(0).alias("rep"), unit, label), unit, label).select("r2")
    se = F.sqrt((F.col("m") - 1) * F.col("v"))
    return own.crossJoin(stats).select("r2", se.alias("se"), (F.col("r2") - 1.96 * se).alias("low"), (F.col("r2") + 1.96 * se).alias("high"))
