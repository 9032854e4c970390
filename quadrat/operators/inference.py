"""Sparse networks by neighbourhood selection: a lasso for each feature, and a penalty chosen by stability over subsamples.

A feature's neighbours are the features that a lasso of it on all others keeps. Every regression of a repetition
needs the same cross products, features squared in number, so tasks are blocks of features of one repetition. The
features are those that passed prevalence filters: their number is checked against a bound, that of units is free.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..streaming.checkpoints import cut

#: Units whose cross products one task adds up, and features of one task of regressions.
CHUNK, BLOCK = 2_000, 100


def subsets(units: DataFrame, unit: str, reps: int, size: int | None = None, seed: int = 1) -> DataFrame:
    """(rep, unit): repetition 0 has all units; of the others each has ``size`` of them, by the order of a hash.

    By default ten times the root of their number, but four fifths of up to 144.
    """
    n = units.count()
    if size is None:
        size = int(10 * n**0.5) if n > 144 else int(0.8 * n)
    each = units.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    order = F.row_number().over(Window.partitionBy("rep").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "rep", unit)), unit))
    return units.select(F.lit(0).alias("rep"), unit).unionByName(each.withColumn("k", order).where(F.col("k") <= size).select("rep", unit))


def cross_products(long: DataFrame, chosen: DataFrame, ids: list) -> DataFrame:
    """(rep, chunk, i, n, sum, row): of each repetition and chunk of units, and each feature, its sum and its products with all features.

    ``long`` is (unit, id, value); absent values are 0.
    """
    place = {x: k for k, x in enumerate(ids)}
    p = len(ids)
    drawn = chosen.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy("rep").orderBy("unit")) - 1) / CHUNK))

    def add(key, pdf):
        units = pdf["unit"].astype("category").cat.codes.to_numpy()
        x = np.zeros((units.max() + 1, p))
        x[units, pdf["id"].map(place).to_numpy()] = pdf["value"].to_numpy()
        return pd.DataFrame({"rep": key[0], "chunk": key[1], "i": np.arange(p), "n": len(x), "sum": x.sum(0), "row": list(x.T @ x)})

    return long.join(drawn, "unit").groupBy("rep", "chunk").applyInPandas(add, "rep int, chunk bigint, i int, n bigint, sum double, row array<double>")


def correlations(parts: pd.DataFrame) -> np.ndarray:
    """The correlation matrix from chunks' sums; a constant feature correlates with none."""
    n = parts.drop_duplicates("chunk")["n"].sum()
    total, products = None, None
    for _, chunk in parts.groupby("chunk"):
        chunk = chunk.sort_values("i")
        s, q = chunk["sum"].to_numpy(), np.vstack(chunk["row"])
        total, products = (s, q) if total is None else (total + s, products + q)
    cov = products - np.outer(total, total) / n
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd[sd <= 1e-9 * np.sqrt(np.maximum(np.diag(products), 1e-300))] = np.inf
    r = cov / np.outer(sd, sd)
    np.fill_diagonal(r, 1.0)
    return r


def lassos(r: np.ndarray, targets: np.ndarray, penalties: list[float], tolerance: float = 1e-8, sweeps: int = 1_000):
    """For each penalty, from the largest, the coefficients of each target on all features (columns: targets).

    Coordinate descent for all targets at once; a solution begins at that of the penalty before.
    """
    b = np.zeros((len(r), len(targets)))
    own = np.zeros_like(b, dtype=bool)
    own[targets, np.arange(len(targets))] = True
    for penalty in penalties:
        for _ in range(sweeps):
            moved = 0.0
            for i in range(len(r)):
                z = r[i, targets] - r[i] @ b + b[i]
                new = np.where(own[i], 0.0, np.sign(z) * np.maximum(np.abs(z) - penalty, 0))
                moved = max(moved, np.abs(new - b[i]).max())
                b[i] = new
            if moved <= tolerance:
                break
        yield b.copy()


def neighbourhoods(long: DataFrame, penalties: int = 20, ratio: float = 0.05, reps: int = 20, threshold: float = 0.05, most: int = 3_000, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b, weight, stability) with a < b, and the penalties (k, penalty, instability, chosen).

    ``long`` is (unit, id, value), values absent are 0. Of ``penalties`` between the largest correlation and ``ratio``
    of it the smallest is chosen up to which the instability over ``reps`` subsamples stays within ``threshold``: the
    mean over pairs of 2 f (1 - f), f being the share of subsamples with the edge. An edge is kept if either feature keeps
    the other; its weight is the coefficient of larger size, its stability f. More than ``most`` features are refused.
    """
    ids = [r[0] for r in long.select("id").distinct().orderBy("id").limit(most + 1).collect()]
    if len(ids) > most:
        raise ValueError(f"more than {most} features; filter by prevalence first")
    p = len(ids)
    long = cut(long.select("unit", "id", F.col("value").cast("double").alias("value")))
    products = cut(cross_products(long, subsets(long.select("unit").distinct(), "unit", reps, seed=seed), ids))

    def largest(pdf):
        r = correlations(pdf)
        np.fill_diagonal(r, 0)
        return pd.DataFrame({"top": [float(np.abs(r).max())]})

    top = products.where("rep = 0").groupBy("rep").applyInPandas(largest, "top double").first()
    path = [float(x) for x in np.geomspace(top["top"], top["top"] * ratio, penalties)] if top and top["top"] > 0 else []
    blocks = F.explode(F.sequence(F.lit(0), F.lit(max(0, (p - 1) // BLOCK)))).alias("block")

    def solve(key, pdf):
        targets = np.arange(key[1] * BLOCK, min((key[1] + 1) * BLOCK, p))
        out = []
        for k, b in enumerate(lassos(correlations(pdf), targets, path)):
            i, j = np.nonzero(b)
            out.append(pd.DataFrame({"rep": key[0], "k": k, "i": i, "j": targets[j], "beta": b[i, j]}))
        return pd.concat(out) if out else pd.DataFrame({"rep": [], "k": [], "i": [], "j": [], "beta": []})

    found = products.select("*", blocks).groupBy("rep", "block").applyInPandas(solve, "rep int, k int, i int, j int, beta double")
    edges = found.groupBy("rep", "k", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.max_by("beta", F.struct(F.abs("beta"), "beta")).alias("beta"))
    edges = cut(edges)
    share = edges.where("rep > 0").groupBy("k", "i", "j").agg((F.count(F.lit(1)) / reps).alias("f"))
    pairs = max(1, p * (p - 1) // 2)
    unstable = share.groupBy("k").agg((F.sum(2 * F.col("f") * (1 - F.col("f"))) / pairs).alias("d"))
    by = {r["k"]: r["d"] for r in unstable.collect()}  # a row for each penalty
    worst, rows, best = 0.0, [], 0
    for k, penalty in enumerate(path):
        worst = max(worst, by.get(k, 0.0))
        if worst <= threshold:
            best = k
        rows.append((k, penalty, worst))
    spark = long.sparkSession
    table = spark.createDataFrame([(*r, r[0] == best) for r in rows], "k int, penalty double, instability double, chosen boolean")
    names = spark.createDataFrame(list(enumerate(ids)), f"i int, name {dict(long.dtypes)['id']}")
    own = edges.where((F.col("rep") == 0) & (F.col("k") == best)).join(share.where(F.col("k") == best).select("i", "j", "f"), ["i", "j"], "left")
    own = own.join(names.withColumnRenamed("name", "a"), "i").join(names.toDF("j", "b"), "j")
    return own.select("a", "b", F.col("beta").alias("weight"), F.coalesce("f", F.lit(0.0)).alias("stability")), table
