"""Rank tests, effect sizes, correlations and false-discovery control, per group, as window aggregates."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def normal_tail2(z: pd.Series) -> pd.Series:
    """Two-sided tail of the normal distribution."""
    return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)) if x == x else None)


def chi2_tail(x: Column, df: int) -> Column:
    """P(X >= x): a finite sum for even degrees of freedom, which grows by two from one or two."""
    if df % 2:
        return _chi2_tail_odd(x, F.lit(df))
    half = x / 2
    terms = [F.pow(half, F.lit(i)) / math.factorial(i) for i in range(df // 2)]
    return F.exp(-half) * sum(terms[1:], terms[0])


@F.pandas_udf(DoubleType())
def _chi2_tail_odd(x: pd.Series, df: pd.Series) -> pd.Series:
    def tail(x: float, df: int) -> float | None:
        if x != x:
            return None
        half = max(x, 0.0) / 2
        return math.erfc(math.sqrt(half)) + sum(half ** (k / 2) * math.exp(-half) / math.gamma(k / 2 + 1) for k in range(1, df, 2))

    return pd.Series([tail(a, int(b)) for a, b in zip(x, df, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def student_tail2(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided tail of Student's t with whole degrees of freedom: the finite trigonometric sums."""

    def tail(t: float, df: float) -> float | None:
        if t != t or df != df or df < 1:
            return None
        df = int(df)
        angle = math.atan(abs(t) / math.sqrt(df))
        sin, cos = math.sin(angle), math.cos(angle)
        term = total = cos if df % 2 else 1.0
        for j in range(1, (df - 1) // 2 if df % 2 else df // 2):
            term *= cos * cos * (2 * j / (2 * j + 1) if df % 2 else (2 * j - 1) / (2 * j))
            total += term
        inside = 2 / math.pi * (angle + (sin * total if df > 1 else 0.0)) if df % 2 else sin * total
        return max(1 - inside, 0.0)

    return pd.Series([tail(a, b) for a, b in zip(t, df, strict=True)], dtype=float)


def average_ranks(df: DataFrame, by: list[str], value: str, name: str = "rank") -> DataFrame:
    """Adds the rank in the group, ties averaged, and ``ties``, the number of equal values."""
    w = Window.partitionBy(*by).orderBy(value)
    peers = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return df.withColumn("ties", peers).withColumn(name, F.rank().over(w) + (F.col("ties") - 1) / 2.0)


def _tie_term(by: list[str], ranked: DataFrame, value: str) -> DataFrame:
    """(by, t): sum of t^3 - t over runs of ties."""
    runs = ranked.groupBy(*by, value).agg(F.count(F.lit(1)).cast("double").alias("t"))
    return runs.groupBy(*by).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("tie_term"))


def mann_whitney(df: DataFrame, by: list[str], group: str, first: str, value: str) -> DataFrame:
    """(by, n1, n2, u, z, rank_biserial): U of group ``first`` against the rest, z with tie and continuity correction.

    Groups in which all values tie have z null.
    """
    ranked = average_ranks(df, by, value)
    one = F.col(group) == first
    sums = ranked.groupBy(*by).agg(F.sum(F.when(one, F.col("rank"))).alias("r1"), F.sum(F.when(one, 1).otherwise(0)).cast("double").alias("n1"), F.sum(F.when(one, 0).otherwise(1)).cast("double").alias("n2"))
    both = sums.where("n1 > 0 and n2 > 0").join(_tie_term(by, ranked, value), by)
    n = F.col("n1") + F.col("n2")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    mean = F.col("n1") * F.col("n2") / 2
    var = F.col("n1") * F.col("n2") / 12 * ((n + 1) - F.col("tie_term") / (n * (n - 1)))
    z = F.when(var > 1e-12, F.greatest(F.abs(u - mean) - 0.5, F.lit(0.0)) / F.sqrt(F.when(var > 1e-12, var)))
    return both.select(*by, F.col("n1").cast("bigint").alias("n1"), F.col("n2").cast("bigint").alias("n2"), u.alias("u"), z.alias("z"), (2 * u / (F.col("n1") * F.col("n2")) - 1).alias("rank_biserial"))


def wilcoxon_signed(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, n, w_plus, w_minus, statistic, z): zero differences are left out, ties share ranks."""
    d = F.round(F.col(a) - F.col(b), 12)
    moved = pairs.select(*by, d.alias("d"), F.abs(d).alias("m")).where("d <> 0")
    ranked = average_ranks(moved, by, "m")
    sums = ranked.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"))
    both = sums.join(_tie_term(by, ranked, "m"), by) if by else sums.crossJoin(_tie_term(by, ranked, "m"))
    n = F.col("n")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("tie_term") / 48
    w = F.least("w_plus", "w_minus")
    return both.select(*by, n.cast("bigint").alias("n"), "w_plus", "w_minus", w.alias("statistic"), F.when(var > 1e-12, (w - n * (n + 1) / 4) / F.sqrt(F.when(var > 1e-12, var))).alias("z"))


def friedman(df: DataFrame, by: list[str], block: str, treatment: str, value: str, treatments: list) -> DataFrame:
    """(by, n, chi2) over blocks that have all treatments; ranks within the block, tie-corrected."""
    k = len(treatments)
    rows = df.where(F.col(treatment).isin(treatments))
    full = rows.groupBy(*by, block).agg(F.countDistinct(treatment).alias("m")).where(F.col("m") == k).drop("m")
    ranked = average_ranks(rows.join(full, [*by, block], "left_semi"), [*by, block], value)
    ties = ranked.groupBy(*by, block, value).agg(F.count(F.lit(1)).cast("double").alias("t")).groupBy(*by).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("tie"))
    sums = ranked.groupBy(*by, treatment).agg(F.sum("rank").alias("r"), F.count(F.lit(1)).cast("double").alias("n")).groupBy(*by).agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.max("n").alias("n"))
    both = sums.join(ties, by) if by else sums.crossJoin(ties)
    raw = 12 * F.col("rr") / (F.col("n") * k * (k + 1)) - 3 * F.col("n") * (k + 1)
    correction = 1 - F.col("tie") / (F.col("n") * k * (k * k - 1))
    return both.select(*by, F.col("n").cast("bigint").alias("n"), F.when(correction > 1e-12, raw / F.when(correction > 1e-12, correction)).alias("chi2"))


def kruskal(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """(by, h, best_group, mean_range): tie-corrected H, the group of largest mean (ties by name), range of means."""
    ranked = average_ranks(df, by, value)
    per = ranked.groupBy(*by, group).agg(F.sum("rank").alias("r"), F.count(F.lit(1)).cast("double").alias("m"), F.avg(value).alias("mean"))
    sums = per.groupBy(*by).agg(F.sum(F.col("r") * F.col("r") / F.col("m")).alias("q"), F.sum("m").alias("n"), F.min(F.struct((-F.col("mean")).alias("x"), F.col(group).alias("g"))).alias("best"), (F.max("mean") - F.min("mean")).alias("mean_range"))
    both = sums.join(_tie_term(by, ranked, value), by)
    n = F.col("n")
    correction = 1 - F.col("tie_term") / (n * n * n - n)
    h = 12 * F.col("q") / (n * (n + 1)) - 3 * (n + 1)
    return both.select(*by, F.when(correction > 1e-12, h / F.when(correction > 1e-12, correction)).alias("h"), F.col("best.g").alias("best_group"), "mean_range")


def t_test(df: DataFrame, by: list[str], group: str, first: str, value: str) -> DataFrame:
    """(by, n1, n2, t, p): Student's test with pooled variance, two-sided."""
    found = two_sample_moments(df, by, group, first, value)
    return found.select(*by, "n1", "n2", "t", student_tail2("t", (F.col("n1") + F.col("n2") - 2).cast("double")).alias("p"))


def two_sample_moments(df: DataFrame, by: list[str], group: str, first: str, value: str, ddof: int = 1) -> DataFrame:
    """(by, n1, n2, mean1, mean2, t, cohens_d, delta_median): pooled t statistic; d with the given degrees of freedom."""
    one, x = F.col(group) == first, F.col(value)
    var = F.var_samp if ddof else F.var_pop
    a, b = F.when(one, x), F.when(~one, x)
    s = df.groupBy(*by).agg(F.count(a).cast("double").alias("n1"), F.count(b).cast("double").alias("n2"), F.avg(a).alias("mean1"), F.avg(b).alias("mean2"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"), var(a).alias("d1"), var(b).alias("d2"), F.median(a).alias("med1"), F.median(b).alias("med2"))
    s = s.where("n1 > 1 and n2 > 1")
    n1, n2 = F.col("n1"), F.col("n2")
    pooled = ((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2")) / (n1 + n2 - 2)
    spread = F.sqrt(((n1 - 1) * F.col("d1") + (n2 - 1) * F.col("d2")) / (n1 + n2 - 2)) if ddof else F.sqrt((F.col("d1") + F.col("d2")) / 2)
    diff = F.col("mean1") - F.col("mean2")
    safe = lambda top, bottom: F.when(bottom > 1e-12, top / F.when(bottom > 1e-12, bottom))
    return s.select(*by, n1.cast("bigint").alias("n1"), n2.cast("bigint").alias("n2"), "mean1", "mean2", safe(diff, F.sqrt(pooled * (1 / n1 + 1 / n2))).alias("t"), safe(diff, spread).alias("cohens_d"), (F.col("med1") - F.col("med2")).alias("delta_median"))


def benjamini_hochberg(df: DataFrame, p: str, family: list[str], order: list[str], name: str = "q") -> DataFrame:
    """Adds the BH-adjusted p within each family: running minimum of p n / rank from the largest p. Null p stays null.

    One family is one window: families are tests per table, not rows of data.
    """
    w = Window.partitionBy(F.col(p).isNull(), *family)
    place = F.row_number().over(w.orderBy(F.col(p).asc(), *order))
    raw = F.col(p) * F.count(p).over(w) / place
    ranked = df.withColumn("_raw", raw).withColumn("_place", place)
    down = w.orderBy(F.desc("_place")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(name, F.when(F.col(p).isNotNull(), F.least(F.min("_raw").over(down), F.lit(1.0)))).drop("_raw", "_place")


def spearman(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id1, id2, n, rho) between columns of two long tables (unit, id, value), over the units that both have."""
    both = a.select("unit", F.col("id").alias("id1"), F.col("value").alias("v1")).join(b.select("unit", F.col("id").alias("id2"), F.col("value").alias("v2")), "unit")
    ranked = average_ranks(average_ranks(both, ["id1", "id2"], "v1", "r1"), ["id1", "id2"], "v2", "r2")
    return ranked.groupBy("id1", "id2").agg(F.count(F.lit(1)).alias("n"), _corr("r1", "r2").alias("rho")).where("rho is not null")


def _corr(a: str, b: str) -> Column:
    """Pearson's r; null for a constant side. Aggregates are computed before any CASE, so the division itself must bear a zero."""
    return F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def pearson_pairs(long: DataFrame) -> DataFrame:
    """(id1, id2, r) for id1 < id2 over a table (unit, id, value)."""
    a = long.select("unit", F.col("id").alias("id1"), F.col("value").alias("v1"))
    b = long.select("unit", F.col("id").alias("id2"), F.col("value").alias("v2"))
    return a.join(b, "unit").where(F.col("id1") < F.col("id2")).groupBy("id1", "id2").agg(_corr("v1", "v2").alias("r"))


def representatives(pairs: DataFrame, ids: DataFrame, above: float = 0.9) -> DataFrame:
    """(id, representative): of columns correlated above ``above`` in absolute value only one is kept.

    A column is dropped if a kept one of smaller id is so correlated with it; its representative is the kept
    column of largest absolute r (ties: smaller id). ``pairs`` has (id1, id2, r) with id1 < id2, ``ids`` every id.
    Each round settles the columns all of whose smaller partners are settled.
    """
    from ..streaming.checkpoints import cut

    close = cut(pairs.where(F.abs("r") > above).select("id1", "id2", F.abs("r").alias("r")))
    state = cut(ids.select("id").distinct().withColumn("kept", F.lit(None).cast("boolean")))
    while not state.where("kept is null").isEmpty():
        smaller = close.join(state.select(F.col("id").alias("id1"), F.col("kept").alias("k1")), "id1")
        seen = smaller.groupBy(F.col("id2").alias("id")).agg(F.bool_or("k1").alias("any"), F.bool_or(F.col("k1").isNull()).alias("open"))
        now = state.join(seen, "id", "left")
        state = cut(now.select("id", F.coalesce("kept", F.when(F.coalesce("any", F.lit(False)), False).when(~F.coalesce("open", F.lit(False)), True)).alias("kept")))
    kept = state.where("kept").select("id")
    both = close.select(F.col("id2").alias("id"), F.col("id1").alias("to"), "r").union(close.select(F.col("id1").alias("id"), F.col("id2").alias("to"), "r"))
    best = both.join(kept.withColumnRenamed("id", "to"), "to", "left_semi").groupBy("id").agg(F.min(F.struct((-F.col("r")).alias("x"), "to")).alias("b"))
    return state.join(best, "id", "left").select("id", F.when(F.col("kept"), F.col("id")).otherwise(F.col("b.to")).alias("representative"))


def batch_adjusted(df: DataFrame, batch: str, feature: str, value: str) -> DataFrame:
    """Adds ``adjusted``: each batch's values moved and scaled to the feature's overall mean and deviation.

    The location and scale part of batch correction, without shrinkage between features.
    """
    stats = lambda keys, s: df.groupBy(*keys).agg(F.avg(value).alias(f"mean{s}"), F.stddev_pop(value).alias(f"sd{s}"))
    joined = df.join(stats([feature, batch], "_b"), [feature, batch]).join(stats([feature], "_f"), feature)
    scaled = F.when(F.col("sd_b") > 0, (F.col(value) - F.col("mean_b")) / F.col("sd_b") * F.col("sd_f") + F.col("mean_f")).otherwise(F.col("mean_f"))
    return joined.withColumn("adjusted", scaled).drop("mean_b", "sd_b", "mean_f", "sd_f")


def combat(df: DataFrame, batch: str, feature: str, value: str, rounds: int = 100, tolerance: float = 1e-4) -> DataFrame:
    """Adds ``adjusted``: values without the batches' locations and scales, which are shrunk towards those of all features.

    Values are standardised by the feature's mean of batches and its pooled deviation; a batch's mean and variance of a
    feature are drawn to the priors that all features of the batch give (normal and inverse gamma) by alternating the two
    posterior means until neither changes by more than ``tolerance`` relative to itself. These need only counts and sums of
    a batch and feature, so each is a row and its rounds an expression. ``value`` must stand for every unit; a feature without
    variance is returned as it is, a batch with one unit of a feature keeps its scale.
    """
    cells = df.groupBy(feature, batch).agg(F.count(value).alias("_n"), F.avg(value).alias("_m"), F.var_pop(value).alias("_v"))
    whole = cells.groupBy(feature).agg(F.sum("_n").alias("_all"), (F.sum(F.col("_n") * F.col("_m")) / F.sum("_n")).alias("_mean"), (F.sum(F.col("_n") * F.col("_v")) / F.sum("_n")).alias("_pool"))
    c = cells.join(whole, feature).where("_pool > 0")
    c = c.withColumns({"_g": (F.col("_m") - F.col("_mean")) / F.sqrt("_pool"), "_d": F.when(F.col("_n") > 1, F.col("_v") / F.col("_pool") * F.col("_n") / F.greatest(F.col("_n") - 1, F.lit(1)))})
    prior = c.groupBy(batch).agg(F.avg("_g").alias("_bar"), F.coalesce(F.var_samp("_g"), F.lit(0.0)).alias("_t2"), F.avg("_d").alias("_dm"), F.coalesce(F.var_samp("_d"), F.lit(0.0)).alias("_dv"))
    prior = prior.withColumns({"_a": F.when(F.col("_dv") > 0, (2 * F.col("_dv") + F.col("_dm") * F.col("_dm")) / F.col("_dv")), "_b": F.when(F.col("_dv") > 0, (F.col("_dm") * F.col("_dv") + F.pow("_dm", F.lit(3.0))) / F.col("_dv"))})
    c = c.join(prior, batch)
    n, g_hat, d_hat = (F.col(x) for x in ("_n", "_g", "_d"))
    around = lambda g: n * F.col("_v") / F.col("_pool") + n * (g_hat - g) * (g_hat - g)

    def turn(state: Column, _: Column) -> Column:
        g = F.try_divide(F.col("_t2") * n * g_hat + state["d"] * F.col("_bar"), F.col("_t2") * n + state["d"])
        g = F.coalesce(g, g_hat)
        d = F.coalesce((0.5 * around(g) + F.col("_b")) / (n / 2 + F.col("_a") - 1), state["d"])
        same = (F.abs(g - state["g"]) <= tolerance * F.abs(state["g"])) & (F.abs(d - state["d"]) <= tolerance * F.abs(state["d"]))
        return F.when(state["done"], state).otherwise(F.struct(g.alias("g"), d.alias("d"), same.alias("done")))

    start = F.struct(g_hat.alias("g"), F.coalesce(d_hat, F.lit(1.0)).alias("d"), d_hat.isNull().alias("done"))
    c = c.withColumn("_s", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, turn))
    c = c.select(feature, batch, "_mean", "_pool", F.col("_s.g").alias("_gs"), F.col("_s.d").alias("_ds"))
    joined = df.join(c.withColumnsRenamed({feature: "_f", batch: "_k"}), (F.col(feature) == F.col("_f")) & (F.col(batch) == F.col("_k")), "left")
    z = (F.col(value) - F.col("_mean")) / F.sqrt("_pool")
    return joined.withColumn("adjusted", F.coalesce((z - F.col("_gs")) / F.sqrt("_ds") * F.sqrt("_pool") + F.col("_mean"), F.col(value).cast("double"))).select(*df.columns, "adjusted")


def aliased_columns(df: DataFrame, columns: list[str], tolerance: float = 1e-7) -> list[str]:
    """Columns that are linear combinations of an intercept and the columns before them.

    Spark computes the cross products; only their small matrix reaches the driver.
    """
    import numpy as np

    names = ["1", *columns]
    col = lambda n: F.lit(1.0) if n == "1" else F.col(n).cast("double")
    sums = df.agg(*[F.sum(col(a) * col(b)).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]).first()
    gram = np.array([[sums[f"{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(names))] for i in range(len(names))])
    kept, out = [0], []
    for j in range(1, len(names)):
        inner = gram[np.ix_(kept, kept)]
        left = gram[j, j] - gram[j, kept] @ np.linalg.lstsq(inner, gram[kept, j], rcond=None)[0]
        if left <= tolerance * max(gram[j, j], 1e-300):
            out.append(names[j])
        else:
            kept.append(j)
    return out
