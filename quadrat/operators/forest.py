"""Isolation forest: trees grown on hashed subsamples, one bounded group each, and scores of all rows, groups in chunks."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..streaming.checkpoints import cut
from .diversity import maybe_broadcast

#: Rows that are scored together.
CHUNK = 20_000
#: Rows of a task that draws them for every tree.
DRAWN = 10_000
#: Groups whose sizes are broadcast; a join by shuffle would deal a large group's rows to one task.
GROUPS = 100_000


def uniform(*parts) -> float:
    """A number in [0, 1) from the parts' MD5."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 4294967296.0


def usual_depth(n: float) -> float:
    """Mean depth of a search that fails in a binary tree of n rows: how deep a row of a leaf of n would still go."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(x: np.ndarray, seed: str, most: int) -> list[tuple]:
    """(node, feature, threshold, depth): splits by a uniform feature that still varies, at a uniform value of its range.

    Node 1 is the root, 2 k and 2 k + 1 follow from k; a leaf has feature -1 and the depth that its rows get.
    """
    out, open_ = [], [(1, np.arange(len(x)), 0)]
    while open_:
        node, rows, depth = open_.pop()
        low, high = x[rows].min(0), x[rows].max(0)
        varying = np.flatnonzero(high > low)
        if depth >= most or len(rows) <= 1 or not len(varying):
            out.append((node, -1, 0.0, depth + usual_depth(len(rows))))
            continue
        f = int(varying[int(uniform(seed, node, "feature") * len(varying))])
        at = float(low[f] + uniform(seed, node, "value") * (high[f] - low[f]))
        at = at if at > low[f] else float(np.nextafter(low[f], high[f]))
        left = x[rows, f] < at
        out.append((node, f, at, 0.0))
        open_ += [(2 * node, rows[left], depth + 1), (2 * node + 1, rows[~left], depth + 1)]
    return out


def forest(points: DataFrame, columns: list[str], group: str, ident: str, trees: int = 100, sample: int = 256, seed: int = 1) -> DataFrame:
    """(group, tree, sample, nodes): the splits of every tree of every group as one array each.

    A tree gets the ``sample`` rows of its group that come first by a hash of the tree and the row. Before rows are ranked,
    those whose hash is too large to be among them by ten deviations are left out, so a group's size costs no sort. Hashes
    are as many as rows times trees, so rows are dealt to tasks by their number, however few files they lie in.
    """
    sizes = points.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    share = F.least(F.lit(1.0), (sample + 10 * sample**0.5 + 20) / F.col("_n"))
    # The last admitted hash as the eight hex digits that a digest begins with; "g" is above them all.
    bound = F.when(share < 1, F.lower(F.lpad(F.hex(F.floor(share * 4294967296.0).cast("bigint")), 8, "0"))).otherwise("g")
    spread = points.repartition(max(1, -(-points.count() // DRAWN)))
    most = sizes.select(group, bound.alias("_most"))
    each = spread.join(maybe_broadcast(most, GROUPS), group)
    each = each.withColumn("_id", F.col(ident).cast("string")).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    likely = each.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("tree").cast("string"), "_id"))).where(F.substring("_h", 1, 8) <= F.col("_most"))
    rank = F.row_number().over(Window.partitionBy(group, "tree").orderBy("_h", ident))
    drawn = likely.withColumn("_k", rank).where(F.col("_k") <= sample)
    deepest = max(1, int(np.ceil(np.log2(max(2, sample)))))
    kind = dict(points.dtypes)[group]

    def plant(key, pdf):
        pdf = pdf.sort_values("_k")
        nodes = grow(pdf[columns].to_numpy(float), f"{seed}|{key[1]}", deepest)
        return pd.DataFrame({group: [key[0]], "tree": [key[1]], "sample": [len(pdf)], "nodes": [[dict(zip(("node", "feature", "at", "depth"), x, strict=True)) for x in nodes]]})

    schema = f"{group} {kind}, tree int, sample int, nodes array<struct<node: bigint, feature: int, at: double, depth: double>>"
    return drawn.select(group, "tree", "_k", *columns).groupBy(group, "tree").applyInPandas(plant, schema)


def depths(x: np.ndarray, nodes: list) -> np.ndarray:
    """How deep each row goes, all rows a level at a time."""
    table = {int(n["node"]): n for n in nodes}
    place = {n: k for k, n in enumerate(table)}
    feature = np.array([n["feature"] for n in table.values()])
    at = np.array([n["at"] for n in table.values()])
    depth = np.array([n["depth"] for n in table.values()])
    left = np.array([place.get(2 * n, 0) for n in table])
    right = np.array([place.get(2 * n + 1, 0) for n in table])
    here = np.full(len(x), place[1])
    while len(moving := np.flatnonzero(feature[here] >= 0)):
        now = here[moving]
        here[moving] = np.where(x[moving, feature[now]] < at[now], left[now], right[now])
    return depth[here]


def isolation_scores(points: DataFrame, columns: list[str], ident: str, group: str | None = None, trees: int = 100, sample: int = 256, contamination: float | None = None, seed: int = 1) -> DataFrame:
    """(ident, group, score, is_outlier) of every row: 2 to the minus mean depth over the usual depth of the sample.

    All rows in one group if none is named, which are then marked "all". Without ``contamination`` a score above 0.5 makes an
    outlier, else the rows above that quantile of their group. Groups of one row score 0.5 and are no outliers. Rows with a
    null among ``columns`` are left out; equal ids draw alike. Groups are scored in chunks, each beside a copy of its trees.
    """
    rows = points.select(F.col(ident), F.lit("all").alias("group") if group is None else F.col(group).alias("group"), *[F.col(c).cast("double").alias(c) for c in columns]).dropna(subset=columns)
    rows = cut(rows)
    grown = cut(forest(rows, columns, "group", ident, trees, sample, seed))
    chunks = rows.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("m"))
    dealt = rows.join(chunks, "group").withColumn("chunk", F.pmod(F.xxhash64(ident, *columns), F.col("m"))).drop("m")
    copies = grown.join(chunks, "group").select("group", "tree", "sample", "nodes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)).alias("chunk"))
    kinds = dict(rows.dtypes)

    def score(left, right):
        if left.empty:
            return pd.DataFrame({ident: [], "group": [], "score": []})
        x = left[columns].to_numpy(float)
        mean = np.mean([depths(x, n) for n in right.sort_values("tree")["nodes"]], axis=0)
        usual = usual_depth(int(right["sample"].iloc[0]))
        return pd.DataFrame({ident: left[ident], "group": left["group"], "score": 2.0 ** (-mean / usual) if usual else np.full(len(x), 0.5)})

    scored = dealt.groupBy("group", "chunk").cogroup(copies.groupBy("group", "chunk")).applyInPandas(score, f"{ident} {kinds[ident]}, group {kinds['group']}, score double")
    if contamination is None:
        return scored.withColumn("is_outlier", F.col("score") > 0.5)
    scored = cut(scored)
    bar = scored.groupBy("group").agg(F.percentile("score", 1 - contamination).alias("bar"))
    return scored.join(bar, "group").select(ident, "group", "score", (F.col("score") > F.col("bar")).alias("is_outlier"))
