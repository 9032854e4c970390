"""Density clustering: core distances and a minimum spanning tree of mutual reachability by blocks of near rows, then the condensed tree.

Rows are dealt to blocks by place, and only rows go to another block whose box is near enough to hold something for them:
a nearer neighbour, or an edge no dearer than one that their component is known to have. What leaves a task are the few
nearest of each row, or the cheapest edge of each component to another. The tree is condensed in joins, to a row for each core.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..streaming.checkpoints import cut
from .network import components

BLOCK = 1_000
#: Distances that a task holds at once.
CELLS = 2_000_000


def _placed(points: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with ``block``: slabs of the first column, cut by the second, about BLOCK rows in each; larger blocks, of many equal rows, are split by hash."""
    slabs = max(1, int(np.ceil((points.count() / BLOCK) ** (0.5 if len(columns) > 1 else 1))))
    shares = F.array(*[F.lit(k / slabs) for k in range(1, slabs)])
    at = lambda cuts, c: F.size(F.filter(cuts, lambda x: x <= F.col(c)))
    if slabs == 1:
        return points.withColumn("block", F.lit("0"))
    first = points.agg(F.percentile_approx(columns[0], shares, 10_000).alias("_cuts"))  # one row
    dealt = points.crossJoin(F.broadcast(first)).withColumn("_slab", at(F.col("_cuts"), columns[0])).drop("_cuts")
    if len(columns) > 1:
        second = dealt.groupBy("_slab").agg(F.percentile_approx(columns[1], shares, 10_000).alias("_cuts"))
        dealt = dealt.join(F.broadcast(second), "_slab").withColumn("_cell", at(F.col("_cuts"), columns[1])).drop("_cuts")  # a row for each slab
    else:
        dealt = dealt.withColumn("_cell", F.lit(0))
    parts = dealt.groupBy("_slab", "_cell").agg(F.ceil(F.count(F.lit(1)) / (2 * BLOCK)).alias("_m"))
    part = F.pmod(F.xxhash64("id"), F.col("_m"))
    return dealt.join(F.broadcast(parts), ["_slab", "_cell"]).withColumn("block", F.concat_ws("|", "_slab", "_cell", part)).drop("_slab", "_cell", "_m")  # a row for each block


def _boxes(rows: DataFrame, columns: list[str], *more: Column) -> DataFrame:
    return rows.groupBy("block").agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))], *more)


def _length(gaps: list[Column]) -> Column:
    """The steps of _distances in the same order, so rounding never makes a bound larger than the distance it bounds."""
    return F.sqrt(sum((g * g for g in gaps), F.lit(0.0)))


def _apart(columns: list[str], low: str, high: str) -> Column:
    """The least distance from a box or point to the box b: ``low`` and ``high`` are the prefixes of its ends."""
    return _length([F.greatest(F.col(f"b.lo_{c}") - F.col(f"{high}{c}"), F.col(f"{low}{c}") - F.col(f"b.hi_{c}"), F.lit(0.0)) for c in columns])


def _sent(rows: DataFrame, boxes: DataFrame, columns: list[str], within: str, also: Column | None = None, also_row: Column | None = None) -> DataFrame:
    """The rows once for each other block whose box lies ``within`` (a column) of them, ``block`` being that one's.

    Blocks meet first, by the boxes of these rows: there is a row for each block. ``also`` and ``also_row`` are conditions on blocks a and b, on rows r and blocks b.
    """
    own = _boxes(rows, columns, F.max(within).alias("reach")).alias("a")
    near = (F.col("a.block") != F.col("b.block")) & (_apart(columns, "a.lo_", "a.hi_") <= F.col("a.reach"))
    pairs = own.join(F.broadcast(boxes.alias("b")), near if also is None else near & also).select(F.col("a.block").alias("block"), F.struct("b.*").alias("b"))
    met = rows.alias("r").join(pairs.alias("p"), "block").select(*[F.col(f"r.{c}").alias(c) for c in rows.columns if c != "block"], "b")
    met = met.where(_apart(columns, "", "") <= F.col(within))
    return (met if also_row is None else met.where(also_row)).withColumn("block", F.col("b.block")).drop("b")


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(sum((x[:, [k]] - y[:, k]) ** 2 for k in range(x.shape[1])))


def _slices(n: int, beside: int):
    step = max(1, CELLS // max(1, beside))
    return (slice(k, k + step) for k in range(0, n, step))


def core_distances(points: DataFrame, columns: list[str], neighbours: int) -> DataFrame:
    """(id, core): the distance to the nearest row for which ``neighbours`` rows, the row itself among them, are as near."""
    rows = cut(_placed(points.select("id", *columns), columns))
    kind = dict(points.dtypes)["id"]
    out = f"id {kind}, d array<double>"

    def near(left, right):
        x, y = left[columns].to_numpy(float), right[columns].to_numpy(float)
        m = min(neighbours, len(y))
        found = [np.partition(_distances(x[s], y), m - 1, axis=1)[:, :m] for s in _slices(len(x), len(y))]
        return pd.DataFrame({"id": left["id"], "d": [list(d) for f in found for d in f]})

    own = cut(rows.groupBy("block").applyInPandas(lambda pdf: near(pdf, pdf), out))
    # A row's neighbours in its own block bound how far others can be.
    reach = F.when(F.size("d") >= neighbours, F.array_max("d")).otherwise(float("inf"))
    sent = _sent(rows.join(own.select("id", reach.alias("reach")), "id"), _boxes(rows, columns), columns, "reach").drop("reach")
    other = sent.groupBy("block").cogroup(rows.groupBy("block")).applyInPandas(lambda left, right: near(left, right) if len(left) else pd.DataFrame({"id": [], "d": []}, dtype=object), out)
    found = own.union(other).groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("d"))).alias("d"))
    return found.select("id", F.coalesce(F.get("d", F.lit(neighbours - 1)), F.array_max("d")).alias("core"))


def spanning_tree(points: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, w) with a < b: a minimum spanning tree of the largest of distance and both core distances. ``points``: (id, columns, core).

    Each round joins every component to another by its cheapest edge; equal weights are told apart by the ids at the ends, so no
    round closes a circle. Components at least halve in number. A component's edges within blocks, or else the boxes of the
    blocks it fills and of others, bound its cheapest edge, so only rows whose core distance is no larger look further, and no farther.
    """
    placed = cut(_placed(points.select("id", *columns, "core"), columns))
    kind = dict(points.dtypes)["id"]
    labels = points.select("id", F.col("id").alias("component"))
    tree = None
    out = f"component {kind}, w double, a {kind}, b {kind}"

    def cheapest(left, right):
        if not len(left) or (left["component"].nunique() == 1 and (right["component"] == left["component"].iloc[0]).all()):
            return pd.DataFrame({"component": [], "w": [], "a": [], "b": []}, dtype=object)
        ids, ends = np.unique(np.concatenate([left["id"], right["id"]]), return_inverse=True)
        groups, of = np.unique(np.concatenate([left["component"], right["component"]]), return_inverse=True)
        x, y = left[columns].to_numpy(float), right[columns].to_numpy(float)
        i, j, p, q = ends[: len(x)], ends[len(x) :], of[: len(x)], of[len(x) :]
        near, far = left["core"].to_numpy(), right["core"].to_numpy()
        best, found = np.full(len(groups), np.inf), []
        for s in _slices(len(x), len(y)):
            w = np.maximum(_distances(x[s], y), np.maximum(near[s, None], far))
            w[p[s, None] == q] = np.inf
            low = w.min(axis=1)
            np.minimum.at(best, p[s], low)
            good = np.flatnonzero(np.isfinite(low) & (low == best[p[s]]))
            k, e = np.nonzero(w[good] == low[good, None])
            k = good[k]
            found.append(np.array([p[s][k], low[k], np.minimum(i[s][k], j[e]), np.maximum(i[s][k], j[e])]))
        c, w, a, b = np.hstack(found)
        order = np.lexsort((b, a, w, c))
        order = order[np.flatnonzero(np.diff(c[order], prepend=-1))]
        at = lambda names, k: names[k[order].astype(int)]
        return pd.DataFrame({"component": at(groups, c), "w": w[order], "a": at(ids, a), "b": at(ids, b)})

    pure = F.col("a.one") & F.col("b.one") & (F.col("a.component") == F.col("b.component"))
    while True:
        rows = cut(placed.join(labels, "id"))
        boxes = cut(_boxes(rows, columns, (F.min("component") == F.max("component")).alias("one"), F.min("component").alias("component"), F.max("core").alias("core")))
        own = cut(rows.groupBy("block").applyInPandas(lambda pdf: cheapest(pdf, pdf), out))
        known = own.groupBy("component").agg(F.min("w").alias("bound"))
        across = _length([F.greatest(F.col(f"b.hi_{c}") - F.col(f"a.lo_{c}"), F.col(f"a.hi_{c}") - F.col(f"b.lo_{c}")) for c in columns])
        # Components that fill all their blocks: any of their rows and any of a block that holds others.
        filled = boxes.where("one").join(known, "component", "left_anti").alias("a").join(F.broadcast(boxes.alias("b")), ~pure)
        known = cut(known.union(filled.groupBy("a.component").agg(F.min(F.greatest(across, "a.core", "b.core")))))
        seeking = rows.join(known, "component").where("core <= bound").select("block", "id", *columns, "core", "component", "bound")
        seeking = cut(seeking.join(boxes.select("block", "one"), "block"))
        sent = _sent(seeking, boxes, columns, "bound", also_row=~(F.col("b.one") & (F.col("b.component") == F.col("component")))).drop("bound", "one")
        other = sent.groupBy("block").cogroup(rows.groupBy("block")).applyInPandas(cheapest, out)
        chosen = cut(own.union(other).groupBy("component").agg(F.min(F.struct("w", "a", "b")).alias("e")).select("e.*").distinct().select("a", "b", "w"))
        if chosen.isEmpty():
            return tree if tree is not None else chosen
        tree = chosen if tree is None else tree.unionByName(chosen)
        ends = labels.select(F.col("id").alias("a"), F.col("component").alias("ca")), labels.select(F.col("id").alias("b"), F.col("component").alias("cb"))
        joined = components(chosen.join(ends[0], "a").join(ends[1], "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"), F.lit(1.0).alias("weight")))
        labels = cut(labels.join(joined.toDF("component", "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component")))


def reachability_tree(points: DataFrame, columns: list[str], neighbours: int) -> DataFrame:
    """(a, b, w): the spanning tree of all points (id, columns), with equal ones taken together.

    Of equal points ``neighbours`` are enough to tell any core distance. Where there are as many, theirs is zero, so each is
    joined to the one of least id at no distance, and that one stands for them: its edges come first among equal weights.
    """
    few = points.withColumn("_k", F.row_number().over(Window.partitionBy(*columns).orderBy("id"))).where(F.col("_k") <= neighbours).drop("_k")
    few = cut(few)
    alike = points.groupBy(*columns).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= neighbours).drop("_n")
    alike = cut(alike)
    standing = few.join(alike, columns, "left").where("first is null or id = first").select("id", *columns)
    tree = spanning_tree(cut(standing.join(core_distances(few, columns, neighbours), "id")), columns)
    equal = points.join(alike, columns).where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("w"))
    return cut(tree.unionByName(equal))


def fallen_rows(tree: DataFrame, smallest: int) -> DataFrame:
    """(id, core, at): the edge (w, a, b) by which a row comes to a part of ``smallest`` rows or more, if edges are taken in ascending order, and the core of that part.

    A smaller part waits for its cheapest edge. Two that wait for the same edge become one, so a part made in the k-th round has
    more than k rows, and after at most ``smallest`` - 1 rounds the parts left wait, maybe one behind the other, for a core: the
    first part of ``smallest`` rows or more in its place. Cores do not grow here; each holds less than twice ``smallest`` rows.
    """
    links = cut(tree.select(F.col("a").alias("x"), F.col("b").alias("y"), F.struct("w", "a", "b").alias("at"), F.lit(True).alias("open_x"), F.lit(True).alias("open_y")))
    rows = tree.select("a").union(tree.select("b")).distinct().toDF("part")
    if smallest < 2:
        return rows.select(F.col("part").alias("id"), F.col("part").alias("core"), F.lit(None).cast(dict(links.dtypes)["at"]).alias("at"))
    parts = cut(rows.withColumn("members", F.array("part")))
    born = []
    while True:
        ends = [links.where(f"open_{p}").select(F.col(p).alias("part"), F.struct("at", F.col(q).alias("to"), F.col(f"open_{q}").alias("open")).alias("e")) for p, q in ("xy", "yx")]
        waiting = ends[0].unionByName(ends[1]).groupBy("part").agg(F.min("e").alias("e")).select("part", "e.*")
        pairs = waiting.where("open").groupBy("at").agg(F.min("part").alias("into"), F.max("part").alias("gone")).where("into <> gone")
        met = pairs.join(parts.toDF("into", "m"), "into").join(parts.toDF("gone", "g"), "gone").select("at", "into", "gone", F.concat("m", "g").alias("members"))
        met = cut(met.withColumn("open", F.size("members") < smallest))
        if met.isEmpty():
            break
        born.append(met.where("not open").select(F.explode("members").alias("id"), F.col("into").alias("core"), "at"))
        names = met.select(F.explode(F.array("into", "gone")).alias("part"), "into", "open")
        for p in "xy":
            links = links.join(names.toDF(p, "into", "now"), p, "left").withColumns({p: F.coalesce("into", p), f"open_{p}": F.coalesce("now", f"open_{p}")}).drop("into", "now")
        links = cut(links.where("x <> y and (open_x or open_y)"))
        parts = cut(parts.join(names, "part", "left_anti").unionByName(met.where("open").select(F.col("into").alias("part"), "members")))
    waiting = cut(waiting)
    ways = waiting.select("part", "to", "open")
    while not ways.where("open").isEmpty():  # each part looks to where the part before it looks
        beyond = ways.where("open").join(ways.toDF("to", "then", "still"), "to").select("part", F.col("then").alias("to"), F.col("still").alias("open"))
        ways = cut(beyond.unionByName(ways.where("not open")))
    late = parts.join(waiting.select("part", "at"), "part").join(ways.select("part", F.col("to").alias("core")), "part").select(F.explode("members").alias("id"), "core", "at")
    for early in born:
        late = late.unionByName(early)
    return cut(late)


def _merged_cores(pdf: pd.DataFrame) -> pd.DataFrame:
    """Nodes of the hierarchy of cores: these first, then what each edge (w, a, b, x, y) between them makes. Edges stand at the nodes that they end."""
    pdf = pdf.sort_values(["w", "a", "b"], ignore_index=True)
    cores, ends = np.unique(np.concatenate([pdf["x"], pdf["y"]]), return_inverse=True)
    k, n = len(pdf), len(cores)
    root, up = list(range(n + k)), np.full(n + k, -1)

    def top(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    for e, (x, y) in enumerate(zip(ends[:k].tolist(), ends[k:].tolist(), strict=True)):
        for c in (top(x), top(y)):
            root[c] = up[c] = n + e
    depth = np.zeros(n + k, int)
    for c in range(n + k - 2, -1, -1):
        depth[c] = depth[up[c]] + 1
    ended = {c: np.append(pdf[c].to_numpy(object), None)[np.where(up < 0, k, up - n)] for c in ("w", "a", "b")}
    return pd.DataFrame({"node": np.arange(n + k), "core": np.append(cores.astype(object), [None] * k), "up": up, "depth": depth, **ended})


def _densest(pdf: pd.DataFrame) -> pd.DataFrame:
    """(core, node): the node chosen at or above each core's node, if any. ``n`` and ``mass`` hold the rows that fall from a node and what they add."""
    pdf = pdf.sort_values("node", ignore_index=True)
    up, size, mass = pdf["up"].tolist(), pdf["n"].tolist(), pdf["mass"].tolist()
    birth = pdf["birth"].tolist()
    below, final = [0.0] * len(up), [-1] * len(up)
    for c in range(len(up) - 1):  # what is joined stands before what it makes
        size[up[c]] += size[c]
        mass[up[c]] += size[c] * (birth[c] - birth[up[c]])
        below[up[c]] += max(mass[c], below[c])
    for c in range(len(up) - 2, -1, -1):
        final[c] = final[up[c]] if final[up[c]] >= 0 else c if mass[c] >= below[c] else -1
    found = pd.DataFrame({"core": pdf["node"], "node": final})
    return found[pdf["is_core"] & (found["node"] >= 0)]


def condensed_labels(tree: DataFrame, smallest: int) -> DataFrame:
    """(id, cluster): clusters by the excess of mass, from the edges (a, b, w) of a spanning tree; noise is left out or null.

    Of the dendrogram only splits into two parts of ``smallest`` rows or more count; other rows fall out of their cluster. A
    cluster's mass is the sum over its rows of how much denser than its birth they stay; it is chosen if that is at least
    the mass chosen below it. The whole is no cluster. Numbers follow the clusters' first rows.

    Only edges between cores split, so the hierarchy, its masses and the choice are made from a row for each core, at most one
    for ``smallest`` rows of the input, in a task. Rows find the node they fall from by steps that double, in joins.
    """
    spark, kind = tree.sparkSession, dict(tree.dtypes)["a"]
    rows = fallen_rows(tree, smallest)
    density = lambda w: 1 / F.greatest(w, F.lit(1e-12))
    cores = rows.select("id", "core")
    splits = tree.join(cores.toDF("a", "x"), "a").join(cores.toDF("b", "y"), "b").where("x <> y").select("w", "a", "b", "x", "y")
    nodes = splits.withColumn("tree", F.lit(0)).groupBy("tree").applyInPandas(_merged_cores, f"node bigint, core {kind}, up bigint, depth bigint, w double, a {kind}, b {kind}")
    nodes = cut(nodes.select("node", "core", "up", "depth", F.when(F.col("up") >= 0, F.struct("w", "a", "b")).alias("end"), F.when(F.col("up") >= 0, density(F.col("w"))).otherwise(0.0).alias("birth")))
    deepest = nodes.agg(F.max("depth")).first()[0]
    if not deepest:
        return spark.createDataFrame([], f"id {kind}, cluster bigint")
    groups = cut(rows.groupBy("core", "at").agg(F.count(F.lit(1)).alias("n")).join(nodes.where("core is not null").select("core", "node", "end"), "core"))
    steps = [nodes.where("up >= 0").select("node", F.col("up").alias("to"), F.col("end").alias("made"))]
    for _ in range(int(deepest).bit_length() - 1):
        steps.append(cut(steps[-1].select("node", F.col("to").alias("via")).join(steps[-1].toDF("via", "to", "made"), "via").select("node", "to", "made")))
    past = F.coalesce(F.col("at") > F.col("end"), F.lit(False))
    risen = groups.where(past).select("node", "at", "n")
    for step in reversed(steps):
        risen = risen.join(step, "node", "left").select(F.when(F.col("made") < F.col("at"), F.col("to")).otherwise(F.col("node")).alias("node"), "at", "n")
    placed = groups.where(~past).select("node", "at", "n").unionByName(risen).join(nodes.select("node", "birth"), "node")
    added = F.when(F.col("at").isNotNull(), F.col("n") * (density(F.col("at.w")) - F.col("birth")))
    own = placed.groupBy("node").agg(F.sum("n").alias("n"), F.sum(added).alias("mass"))
    table = nodes.select("node", "up", "birth", F.col("core").isNotNull().alias("is_core")).join(own, "node", "left").fillna({"n": 0, "mass": 0.0})
    chosen = table.withColumn("tree", F.lit(0)).groupBy("tree").applyInPandas(_densest, "core bigint, node bigint").join(nodes.select("node", "end"), "node")
    chosen = cut(chosen.join(nodes.select(F.col("node").alias("core"), F.col("core").alias("id")), "core").select(F.col("id").alias("core"), "node", "end"))
    held = cut(rows.join(chosen, "core").where(~past).select("id", "node"))
    first = held.groupBy("node").agg(F.min("id").alias("first"))
    numbers = first.select("node", (F.row_number().over(Window.orderBy("first")) - 1).cast("bigint").alias("cluster"))  # a row for each cluster
    return held.join(numbers, "node").select("id", "cluster")


def density_clusters(points: DataFrame, columns: list[str], ident: str, smallest: int = 5, neighbours: int | None = None) -> DataFrame:
    """(ident, cluster): hierarchical density clusters, -1 for noise; numbers follow the clusters' least ids.

    ``neighbours`` (by default ``smallest``) sets the core distance. Rows with a null among ``columns`` are left out; ids
    must be unique.
    """
    rows = cut(points.select(F.col(ident).alias("id"), *[F.col(c).cast("double").alias(c) for c in columns]).dropna())
    if rows.count() < 2:
        return rows.select(F.col("id").alias(ident), F.lit(-1).cast("bigint").alias("cluster"))
    found = rows.select("id").join(condensed_labels(reachability_tree(rows, columns, neighbours or smallest), smallest), "id", "left")
    return found.select(F.col("id").alias(ident), F.coalesce("cluster", F.lit(-1)).cast("bigint").alias("cluster"))
