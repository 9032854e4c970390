"""Correlations of compositions with the strongest pairs left out in turn, for every group and repetition at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.checkpoints import cut

LEAST = 1e-4


def permuted_values(logs: DataFrame, keys: list[str], reps: int, seed: str = "1") -> DataFrame:
    """(keys, rep, unit, id, value): repetition 0 as it is, from 1 on each id's values dealt over the group's units by a hash."""
    each = logs.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))) if reps else logs.withColumn("rep", F.lit(1)).limit(0)
    by_hash = F.md5(F.concat_ws("|", F.lit(seed), "rep", *[F.col(c).cast("string") for c in (*keys, "id", "unit")]))
    places = each.select(*keys, "rep", "unit", "id", F.row_number().over(Window.partitionBy(*keys, "rep", "id").orderBy(by_hash, "unit")).alias("k"))
    own = logs.select(*keys, "id", "value", F.row_number().over(Window.partitionBy(*keys, "id").orderBy("unit")).alias("k"))
    return logs.select(*keys, F.lit(0).alias("rep"), "unit", "id", "value").unionByName(places.join(own, [*keys, "id", "k"]).select(*keys, "rep", "unit", "id", "value"))


def _solved(nodes: DataFrame, left: DataFrame, keys: list[str], kinds: dict[str, str]) -> DataFrame:
    """(keys, s) and the corrections of ids with pairs left out: (keys, id, more), what their left-out partners' variances sum to.

    A variance w obeys c w = t - s + (w of left-out partners), c = d - 2 - (their number), s the sum of all w. So unknown are
    s and the w of ids with left-out pairs, a few for each round; all others enter by their sums of t / c and 1 / c.
    """
    sums = nodes.groupBy(*keys).agg(F.sum(F.col("t") / F.col("c")).alias("a"), F.sum(1 / F.col("c")).alias("b"))
    ends = left.select(*keys, F.col("id1").alias("id"), F.col("id2").alias("other")).unionByName(left.select(*keys, F.col("id2").alias("id"), F.col("id1").alias("other")))
    packed = ends.join(nodes.select(*keys, "id", "t", "c"), [*keys, "id"]).join(sums, keys)

    def solve(pdf):
        ids = sorted(set(pdf["id"]))
        place = {x: k + 1 for k, x in enumerate(ids)}
        m, y = np.eye(len(ids) + 1), np.zeros(len(ids) + 1)
        m[0, 0], y[0] = 1 + pdf["b"].iloc[0], pdf["a"].iloc[0]
        for r in pdf.itertuples():
            k, o = place[r.id], place[r.other]
            m[0, o] -= 1 / r.c
            m[k, 0], y[k] = 1 / r.c, r.t / r.c
            m[k, o] -= 1 / r.c
        w = np.linalg.solve(m, y)
        more = {x: 0.0 for x in ids}
        for r in pdf.itertuples():
            more[r.id] += w[place[r.other]]
        first = {c: pdf[c].iloc[0] for c in keys}
        return pd.DataFrame([{**first, "id": x, "more": v, "s": w[0]} for x, v in more.items()])

    schema = ", ".join(f"{c} {kinds[c]}" for c in (*keys, "id")) + ", more double, s double"
    return packed.groupBy(*keys).applyInPandas(solve, schema)


def excluding_correlations(logs: DataFrame, keys: list[str], reps: int = 0, rounds: int = 10, threshold: float = 0.1, seed: str = "1") -> DataFrame:
    """(keys, rep, id1, id2, rho) for id1 < id2: correlations of the basis values behind compositions.

    ``logs`` (keys, unit, id, value) holds the logarithm of every id's share in every unit of its group. Variances of
    log-ratios sum over an id's partners to a system for the basis variances, right if correlations are few; so in each of
    ``rounds`` the pair of largest |rho| above ``threshold`` that is still in leaves the sums of both its ids, and the
    variances (at least 1e-4) are solved again. An id keeps three partners at least. Groups of under four ids or two units
    give nothing. All groups and repetitions go through the same rounds in one plan.
    """
    every = [*keys, "rep"]
    rows = permuted_values(logs, keys, reps, seed)
    kinds = dict(rows.dtypes)
    x, y = rows.withColumnsRenamed({"id": "id1", "value": "v1"}), rows.withColumnsRenamed({"id": "id2", "value": "v2"})
    ratio = cut(x.join(y, [*every, "unit"]).where("id1 < id2").groupBy(*every, "id1", "id2").agg(F.var_samp(F.col("v1") - F.col("v2")).alias("t")).where("t is not null"))
    ends = lambda df: df.select(*every, F.col("id1").alias("id"), "t").unionByName(df.select(*every, F.col("id2").alias("id"), "t"))
    size = ends(ratio).select(*every, "id").distinct().groupBy(*every).agg(F.count(F.lit(1)).alias("d")).where("d > 3")
    left = None
    for turn in range(rounds + 1):
        held = ratio if left is None else ratio.join(left, [*every, "id1", "id2"], "left_anti")
        nodes = ends(held).groupBy(*every, "id").agg(F.sum("t").alias("t"), F.count(F.lit(1)).alias("m")).join(size, every).withColumn("c", F.col("m") - 1.0)
        if left is None:
            # Without pairs left out the system is even: s is the sum of all t over 2 (d - 1).
            s = nodes.groupBy(*every).agg((F.sum("t") / (2 * (F.first("d") - 1))).alias("s"))
            basis = nodes.join(s, every).select(*every, "id", "m", F.greatest((F.col("t") - F.col("s")) / F.col("c"), F.lit(LEAST)).alias("w"))
        else:
            nodes = cut(nodes)
            solved = cut(_solved(nodes, left, every, kinds))
            plain = nodes.join(left.select(*every).distinct(), every, "left_anti")
            s = solved.select(*every, "s").distinct().unionByName(plain.groupBy(*every).agg((F.sum("t") / (2 * (F.first("d") - 1))).alias("s")))
            basis = nodes.join(s, every).join(solved.select(*every, "id", "more"), [*every, "id"], "left")
            basis = basis.select(*every, "id", "m", F.greatest((F.col("t") - F.col("s") + F.coalesce("more", F.lit(0.0))) / F.col("c"), F.lit(LEAST)).alias("w"))
        both = ratio.join(basis.withColumnsRenamed({"id": "id1", "w": "w1", "m": "m1"}), [*every, "id1"]).join(basis.withColumnsRenamed({"id": "id2", "w": "w2", "m": "m2"}), [*every, "id2"])
        rho = (F.col("w1") + F.col("w2") - F.col("t")) / (2 * F.sqrt(F.col("w1") * F.col("w2")))
        found = cut(both.select(*every, "id1", "id2", "m1", "m2", F.least(F.greatest(rho, F.lit(-1.0)), F.lit(1.0)).alias("rho")))
        if turn == rounds:
            break
        open_ = found if left is None else found.join(left, [*every, "id1", "id2"], "left_anti")
        open_ = open_.where((F.round(F.abs("rho"), 9) > threshold) & (F.least("m1", "m2") > 3))
        new = open_.groupBy(*every).agg(F.min(F.struct((-F.round(F.abs("rho"), 9)).alias("x"), "id1", "id2")).alias("e")).select(*every, "e.id1", "e.id2")
        left = cut(new if left is None else left.unionByName(new))
    return found.select(*every, "id1", "id2", "rho")


def strong_edges(found: DataFrame, keys: list[str], reps: int, p: float = 0.05, least: float = 0.5) -> DataFrame:
    """(keys, a, b, weight, p): pairs of at least ``least`` whose permuted |rho|, to nine digits, reach the own in a share below ``p``."""
    size = F.round(F.abs("rho"), 9)
    own = found.where("rep = 0").select(*keys, "id1", "id2", F.col("rho").alias("weight"), size.alias("o"))
    tested = found.where("rep > 0").join(own, [*keys, "id1", "id2"]).groupBy(*keys, "id1", "id2", "weight").agg(((1 + F.count(F.when(size >= F.col("o"), 1))) / (reps + 1.0)).alias("p"))
    return tested.where((F.col("p") < p) & (F.abs("weight") >= least)).select(*keys, F.col("id1").alias("a"), F.col("id2").alias("b"), "weight", "p")
