"""Ordination and outlier votes. Matrices of samples stay tables of pairs; what the driver solves is as small as the axes and constraints are few."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..streaming.checkpoints import cut


def _numbers(batch, names: list[str]) -> np.ndarray:
    """Array columns of an Arrow batch side by side, a row for each of its rows."""
    blocks = [batch.column(n).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for n in names]
    return np.hstack([*blocks, np.ones((batch.num_rows, 1))])


def _gram(table: DataFrame, names: list[str]) -> np.ndarray:
    """Cross products of the array columns, and of a column of ones after them: a task adds up its rows, the driver gets only sums."""

    def add(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = _numbers(batch, names)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "s"])

    sums = table.select(*names).mapInArrow(add, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    out = np.zeros((sums["i"].max() + 1, sums["j"].max() + 1)) if len(sums) else np.zeros((1, 1))
    out[sums["i"], sums["j"]] = sums["s"]
    return out


def _mapped(table: DataFrame, names: list[str], matrices: dict[str, np.ndarray]) -> DataFrame:
    """(id, arrays): each row's numbers, with a one after them, times small matrices."""

    def turn(batches):
        for batch in batches:
            x = _numbers(batch, names)
            rows = [pa.FixedSizeListArray.from_arrays(pa.array((x @ m).ravel()), m.shape[1]).cast(pa.list_(pa.float64())) for m in matrices.values()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *rows], names=["id", *matrices])

    kind = dict(table.dtypes)["id"]
    return table.select("id", *names).mapInArrow(turn, f"id {kind}, " + ", ".join(f"{n} array<double>" for n in matrices))


def pcoa(pairs: DataFrame, axes: int = 2, block: int = 16, tolerance: float = 1e-9, most: int = 60) -> DataFrame:
    """(id, axis, value, explained): principal coordinates of the pair distances (id1, id2, dist).

    A block of vectors is multiplied by the centred table of -dist^2 / 2 by joining the pairs with it; the blocks so
    far span the space in which the largest eigenvalues are sought, until those of ``axes`` have residuals below
    ``tolerance`` of the first or ``most`` blocks are there. Only sums of cross products, their number independent of
    the samples', reach the driver, and vectors stay with their samples. ``explained`` is the share of the trace. An axis'
    sign makes the sum of its cubes positive. Axes without a positive eigenvalue have zeros.
    """
    sides = [pairs.select(F.col(a).alias("id"), F.col(b).alias("other"), (-0.5 * F.col("dist") * F.col("dist")).alias("a")) for a, b in (("id1", "id2"), ("id2", "id1"))]
    both = cut(sides[0].unionByName(sides[1]))
    ids = both.select("id").distinct()
    begin = F.array(*[F.xxhash64("id", F.lit(k)) / F.lit(float(1 << 63)) for k in range(block)])
    state = cut(ids.select("id", begin.alias("v")))
    n = state.count()
    if not n:
        return ids.select("id", F.lit(1).alias("axis"), F.lit(0.0).alias("value"), F.lit(0.0).alias("explained"))
    trace = -both.agg(F.sum("a")).first()[0] / n
    first = _gram(state, ["v"])
    start = np.vstack([np.eye(block), -first[-1:, :-1] / n])  # centred
    start = start @ _orthonormal(start.T @ first @ start)
    state = _mapped(state, ["v"], {"v": start})
    d = width = start.shape[1]
    names = ["v", "w"]
    while True:
        last = [F.sum(F.col("a") * F.col("x")[k]).alias(f"y{k}") for k in range(width)]
        turned = both.join(state.select(F.col("id").alias("other"), F.slice("v", d - width + 1, width).alias("x")), "other").groupBy("id").agg(*last)
        state = cut(state.join(turned.select("id", F.array(*[f"y{k}" for k in range(width)]).alias("w")), "id"))
        gram = _gram(state, names)
        size = len(gram)
        centre = np.eye(size)
        centre[-1, size - 1 - width : size - 1] -= gram[-1, size - 1 - width : size - 1] / n
        gram = centre.T @ gram @ centre
        v, g = slice(0, d), slice(d, size - 1)
        inner, image = gram[v, v], gram[v, g]
        values, vectors = _largest(inner, (image + image.T) / 2, axes)
        far = [y @ gram[g, g] @ y - 2 * x * (y @ image @ y) + x * x * (y @ inner @ y) for x, y in zip(values, vectors.T, strict=True)]
        small = max(far) <= (tolerance * max(abs(values[0]), 1e-300)) ** 2
        new = np.zeros((size - 1, width))
        new[size - 1 - width :] = np.eye(width)
        new[v] = -np.linalg.solve(inner, gram[v, size - 1 - width : size - 1])
        left = gram[:-1, :-1]
        basis = new @ _orthonormal(new.T @ left @ new, float(np.trace(gram[g, g])))
        if small or basis.shape[1] == 0 or d + basis.shape[1] >= most * block:
            break
        keep = np.eye(size)[:, v]
        state = _mapped(state, names, {"v": np.hstack([keep, centre[:, :-1] @ basis]), "g": centre[:, g]})
        d, width, names = d + basis.shape[1], basis.shape[1], ["v", "g", "w"]
    scale = np.sqrt(np.maximum(values, 0))
    rows = _mapped(state, ["v"], {"x": np.vstack([vectors * scale, np.zeros((1, len(values)))])})
    signs = rows.select(F.posexplode("x").alias("k", "value")).groupBy("k").agg(F.when(F.sum(F.pow("value", F.lit(3.0))) < 0, -1.0).otherwise(1.0).alias("sign"))
    shares = F.array(*[F.lit(float(max(x, 0) / trace) if trace else 0.0) for x in values])
    long = rows.select("id", F.posexplode("x").alias("k", "value")).join(F.broadcast(signs), "k")  # a row for each axis
    return long.select("id", (F.col("k") + 1).alias("axis"), (F.col("value") * F.col("sign")).alias("value"), shares[F.col("k")].alias("explained"))


def _orthonormal(gram: np.ndarray, scale: float | None = None) -> np.ndarray:
    """Combinations of vectors with this Gram matrix that are orthonormal; directions of almost no length go."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    kept = values > 1e-12 * max(scale or values.max(), 1e-300)
    return vectors[:, kept] / np.sqrt(values[kept])


def _largest(inner: np.ndarray, image: np.ndarray, axes: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of ``image`` x = value ``inner`` x, and their x, of length one by ``inner``."""
    half = _orthonormal(inner)
    values, vectors = np.linalg.eigh(half.T @ image @ half)
    order = np.argsort(values)[::-1][:axes]
    return values[order], half @ vectors[:, order]


def constrained_inertia(table: DataFrame, labels: DataFrame, unit: str, label: str) -> DataFrame:
    """(rep, n, k, total, constrained, f) of canonical correspondence analysis with a factor as its constraint.

    ``table`` (unit, feature, value) is sparse with positive values; ``labels`` are (rep, unit, label). Under a factor
    the fitted part of the chi-square table is its group sums, so both inertias are sums over cells and no matrix is
    decomposed: the sum of value^2 / (row sum x column sum), less one.
    """
    row = table.groupBy(unit).agg(F.sum("value").alias("row"))
    column = table.groupBy("feature").agg(F.sum("value").alias("column"))
    inertia = F.sum(F.col("value") * F.col("value") / (F.col("row") * F.col("column"))) - 1
    total = table.join(row, unit).join(column, "feature").agg(inertia.alias("total"))
    grouped = labels.join(table, unit).groupBy("rep", label, "feature").agg(F.sum("value").alias("value"))
    sums = grouped.groupBy("rep", label).agg(F.sum("value").alias("row"))
    fitted = grouped.join(sums, ["rep", label]).join(column, "feature").groupBy("rep").agg(inertia.alias("constrained"))
    size = labels.groupBy("rep", label).agg(F.count(F.lit(1)).alias("m")).groupBy("rep").agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("k"))
    f = F.try_divide(F.try_divide("constrained", F.col("k") - 1), F.try_divide(F.col("total") - F.col("constrained"), F.col("n") - F.col("k")))
    return fitted.join(size, "rep").crossJoin(total).select("rep", "n", "k", "total", "constrained", f.alias("f"))


def outlier_votes(rows: DataFrame, group: str, columns: list[str], sd: float = 3.0, fence: float = 1.5, mad: float = 3.5) -> DataFrame:
    """(row columns, votes, is_outlier): three rules vote on every row within its group, two make an outlier.

    Stands in for an ensemble of learned detectors: any column beyond ``sd`` deviations, beyond the
    quartile fences, or beyond ``mad`` scaled median deviations.
    """
    stats = rows.groupBy(group).agg(*[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"), F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"_q_{c}"))])
    joined = rows.join(F.broadcast(stats), group)
    away = joined.groupBy(group).agg(*[F.median(F.abs(F.col(c) - F.col(f"_q_{c}")[1])).alias(f"_d_{c}") for c in columns])
    joined = joined.join(F.broadcast(away), group)
    any_ = lambda test: F.greatest(*[F.when(test(c), 1).otherwise(0) for c in columns], F.lit(0))
    q = lambda c, i: F.col(f"_q_{c}")[i]
    one = any_(lambda c: F.abs(F.col(c) - F.col(f"_m_{c}")) > sd * F.col(f"_s_{c}"))
    two = any_(lambda c: (F.col(c) < q(c, 0) - fence * (q(c, 2) - q(c, 0))) | (F.col(c) > q(c, 2) + fence * (q(c, 2) - q(c, 0))))
    three = any_(lambda c: (F.col(f"_d_{c}") > 0) & (0.6745 * F.abs(F.col(c) - q(c, 1)) > mad * F.col(f"_d_{c}")))
    votes = one + two + three
    return joined.select(*rows.columns, votes.alias("votes"), (votes >= 2).alias("is_outlier"))


def constrained_axes(table: DataFrame, constraints: DataFrame, unit: str) -> dict[str, DataFrame | list[float]]:
    """Canonical correspondence analysis on continuous constraints, the columns of ``constraints`` besides ``unit``.

    ``table`` (unit, feature, value) is sparse with positive values. With p the table's shares, r and c its row and
    column sums and x the constraints less their means weighted by r, the fitted table has the eigenvalues of
    S w = value M w, where M = sum r x x', S = sum over features of b b' / c, and b = sum p x of the feature. So one
    pass makes sums as many as constraints squared, and nothing is decomposed but those. Returns ``values`` (a list),
    ``sites`` (unit, weight, axis, wa, lc: weighted averages of feature scores, and linear combinations of constraints),
    ``features`` (feature, axis, score) scaled by eigenvalues, and ``variables`` (variable, axis, score: correlations
    with lc). Units without a value for every constraint are left out. Each axis gives the first constraint a
    positive coefficient.
    """
    names = [c for c in constraints.columns if c != unit]
    whole = constraints.dropna().join(table.where("value > 0").select(unit).distinct(), unit, "left_semi")
    cells = cut(table.where("value > 0").join(whole.select(unit), unit, "left_semi").select(unit, "feature", "value"))
    total = F.lit(float(cells.agg(F.sum("value")).first()[0] or 1.0))
    rows = cells.groupBy(unit).agg((F.sum("value") / total).alias("weight"))
    rows = cut(rows.join(whole, unit))
    means = rows.agg(*[F.sum(F.col("weight") * F.col(n)).alias(n) for n in names]).first()
    x = {n: F.col(n) - F.lit(float(means[n] or 0.0)) for n in names}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    m = rows.agg(*[F.sum(F.col("weight") * x[a] * x[b]).alias(f"s{k}") for k, (a, b) in enumerate(pairs)]).first()
    by = cells.join(rows, unit).groupBy("feature").agg((F.sum("value") / total).alias("c"), *[F.sum(F.col("value") / total * x[n]).alias(f"b{k}") for k, n in enumerate(names)])
    by = cut(by)
    s = by.agg(*[F.sum(F.col(f"b{names.index(a)}") * F.col(f"b{names.index(b)}") / F.col("c")).alias(f"s{k}") for k, (a, b) in enumerate(pairs)]).first()
    matrix = lambda found: np.array([[found[pairs.index((names[min(i, j)], names[max(i, j)]))] or 0.0 for j in range(len(names))] for i in range(len(names))])
    values, w = _largest(matrix(m), matrix(s), len(names))
    good = values > 1e-12 * max(values.max(initial=0), 1e-300)
    values, w = values[good], w[:, good]
    w = w * np.where(w[0] < 0, -1, 1)
    combine = lambda terms, k: sum((t * F.lit(float(w[i, k])) for i, t in enumerate(terms)), F.lit(0.0))
    axes = range(len(values))
    spread = lambda columns, *names_: F.inline(F.array(*[F.struct(F.lit(k + 1).alias("axis"), *[c[k].alias(n) for c, n in zip(columns, names_, strict=True)]) for k in axes]))
    # A feature's score is its b combined, over c; scaled by eigenvalues, so averages of scores over units are divided by the value.
    scores = cut(by.select("feature", spread([[combine([F.col(f"b{i}") for i in range(len(names))], k) / F.col("c") for k in axes]], "score")))
    averaged = cells.join(scores, "feature").groupBy(unit, "axis").agg(F.sum(F.col("value") * F.col("score")).alias("sum"), F.sum("value").alias("all"))
    over = F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("axis"))
    lc = rows.select(unit, "weight", spread([[combine(list(x.values()), k) for k in axes]], "lc"))
    sites = averaged.join(lc, [unit, "axis"]).select(unit, "weight", "axis", (F.col("sum") / F.col("all") / over).alias("wa"), "lc")
    mm = matrix(m)
    variables = [(n, k + 1, float((mm @ w)[i, k] / np.sqrt(mm[i, i]))) for i, n in enumerate(names) for k in axes if mm[i, i] > 0]
    spark = table.sparkSession
    return {"values": [float(v) for v in values], "sites": sites, "features": scores, "variables": spark.createDataFrame(variables, "variable string, axis int, score double")}


def fitted_vectors(sites: DataFrame, variables: DataFrame, unit: str, reps: int, seed: int = 1) -> DataFrame:
    """(variable, axis1, axis2, r2, p): directions of a variable's steepest rise over two site axes, by weighted regression.

    ``sites`` is (unit, weight, a1, a2), ``variables`` (unit, variable, value). p counts the permutations of the values, in the
    order of a hash, that fit as well; r2 is compared to nine digits. All repetitions are one plan: they differ in sums only.
    """
    held = variables.join(sites.select(unit), unit, "left_semi")
    own = held.withColumn("k", F.row_number().over(Window.partitionBy("variable").orderBy(unit)))
    numbers = F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep")
    mixed = held.select("variable", unit, numbers)
    order = F.md5(F.concat_ws("|", F.lit(seed), "rep", "variable", unit))
    mixed = mixed.withColumn("k", F.row_number().over(Window.partitionBy("rep", "variable").orderBy(order, unit)))
    all_ = own.select(F.lit(0).alias("rep"), "variable", unit, "value").unionByName(mixed.join(own.select("variable", "k", "value"), ["variable", "k"]).select("rep", "variable", unit, "value"))
    w, a, b, y = (F.col(c) for c in ("weight", "a1", "a2", "value"))
    s = all_.join(sites, unit).groupBy("rep", "variable").agg(*[F.sum(e).alias(n) for n, e in {"w": w, "wa": w * a, "wb": w * b, "wy": w * y, "aa": w * a * a, "bb": w * b * b, "ab": w * a * b, "ay": w * a * y, "by": w * b * y, "yy": w * y * y}.items()])
    dev = lambda xy, x, z: F.col(xy) - F.col(x) * F.col(z) / F.col("w")
    s = s.select("rep", "variable", dev("aa", "wa", "wa").alias("aa"), dev("bb", "wb", "wb").alias("bb"), dev("ab", "wa", "wb").alias("ab"), dev("ay", "wa", "wy").alias("ay"), dev("by", "wb", "wy").alias("by"), dev("yy", "wy", "wy").alias("yy"))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    s = s.withColumn("x", F.try_divide(F.col("bb") * F.col("ay") - F.col("ab") * F.col("by"), det)).withColumn("z", F.try_divide(F.col("aa") * F.col("by") - F.col("ab") * F.col("ay"), det))
    s = cut(s.withColumn("r2", F.try_divide(F.col("x") * F.col("ay") + F.col("z") * F.col("by"), F.col("yy"))))
    first = s.where("rep = 0").withColumnRenamed("r2", "r")
    better = s.where("rep > 0").join(first.select("variable", "r"), "variable").groupBy("variable").agg(F.count(F.when(F.round("r2", 9) >= F.round("r", 9), 1)).alias("m"))
    long = F.sqrt(F.col("x") * F.col("x") + F.col("z") * F.col("z"))
    return first.join(better, "variable", "left").select("variable", F.try_divide("x", long).alias("axis1"), F.try_divide("z", long).alias("axis2"), F.col("r").alias("r2"), ((1 + F.coalesce("m", F.lit(0))) / (reps + 1)).alias("p"))
