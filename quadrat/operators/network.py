"""Topology of weighted undirected graphs given as edge tables (a, b, weight)."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tidy_edges(edges: DataFrame) -> DataFrame:
    """(a, b, weight) with a < b: reversed repeats are summed, loops dropped."""
    return edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").alias("weight"))


def merged(*graphs: DataFrame) -> DataFrame:
    return tidy_edges(reduce(DataFrame.unionByName, graphs))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "weight").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))


def summary(edges: DataFrame) -> DataFrame:
    """(nodes, edges, mean_degree, density, heterogeneity): heterogeneity is the degrees' variance over their mean."""
    d = degrees(edges).agg(F.count(F.lit(1)).alias("nodes"), (F.sum("degree") / 2).cast("bigint").alias("edges"), F.avg("degree").alias("mean_degree"), F.var_pop("degree").alias("v"))
    n = F.col("nodes")
    pairs = F.when(n > 1, n * (n - 1))
    return d.select("nodes", F.coalesce("edges", F.lit(0)).alias("edges"), "mean_degree", (2.0 * F.col("edges") / pairs).alias("density"), (F.col("v") / F.col("mean_degree")).alias("heterogeneity"))


def triangles(edges: DataFrame) -> DataFrame:
    """(x, y, z) with x < y < z. Each edge points to its end of larger degree, which bounds the wedges made of hubs."""
    d = degrees(edges).select("node", "degree")
    placed = edges.join(d.withColumnRenamed("node", "a").withColumnRenamed("degree", "da"), "a").join(d.withColumnRenamed("node", "b").withColumnRenamed("degree", "db"), "b")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    out = placed.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("t"))
    one, two = out.select("s", F.col("t").alias("t1")), out.select("s", F.col("t").alias("t2"))
    wedges = one.join(two, "s").where(F.col("t1") < F.col("t2")).select("s", "t1", "t2")
    closed = wedges.join(edges.select(F.col("a").alias("t1"), F.col("b").alias("t2")), ["t1", "t2"])
    three = F.array_sort(F.array("s", "t1", "t2"))
    return closed.select(three[0].alias("x"), three[1].alias("y"), three[2].alias("z"))


def clustering(edges: DataFrame) -> DataFrame:
    """(node, degree, triangles, clustering); nodes of degree one have 0."""
    ends = triangles(edges).select(F.explode(F.array("x", "y", "z")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("triangles"))
    d = F.col("degree")
    return degrees(edges).join(ends, "node", "left").select("node", "degree", F.coalesce("triangles", F.lit(0)).alias("triangles"), F.when(d > 1, 2.0 * F.coalesce("triangles", F.lit(0)) / F.when(d > 1, d * (d - 1))).otherwise(0.0).alias("clustering"))


def transitivity(edges: DataFrame) -> DataFrame:
    """(transitivity, average_clustering): three times the triangles over the wedges (null without wedges), and the mean over nodes."""
    c = clustering(edges)
    wedges = F.sum(F.col("degree") * (F.col("degree") - 1) / 2)
    return c.agg(F.sum("triangles").alias("t"), wedges.alias("w"), F.avg("clustering").alias("average_clustering")).select(F.when(F.col("w") > 0, F.col("t") / F.when(F.col("w") > 0, F.col("w"))).alias("transitivity"), "average_clustering")


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component): the least node reached, by lowering labels along edges and by their labels' labels.

    Labels are checkpointed each round, so the plan does not grow.
    """
    from ..streaming.checkpoints import cut

    links = both_ways(edges).select("a", "b").distinct()
    labels = links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component"))
    labels = cut(labels)
    for _ in range(most_rounds):
        near = links.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        low = cut(labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("was")))
        jump = low.select(F.col("node").alias("component"), F.col("component").alias("next"))
        labels = cut(low.join(jump, "component").select("node", F.least("component", "next").alias("component"), "was"))
        if labels.where("component <> was").isEmpty():
            return labels.select("node", "component")
    raise RuntimeError("components did not settle")


def component_table(found: DataFrame) -> DataFrame:
    """(node, component_id, component_size, is_largest): ids from 1 by size, ties by least node."""
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("component_size"))
    placed = sizes.withColumn("component_id", F.row_number().over(Window.orderBy(F.desc("component_size"), "component")))  # a row for each component
    return found.join(placed, "component").select("node", "component_id", "component_size", (F.col("component_id") == 1).alias("is_largest"))


def assortativity(edges: DataFrame) -> DataFrame:
    """(assortativity): correlation of the degrees at both ends of edges, in both directions."""
    d = degrees(edges).select("node", "degree")
    ends = both_ways(edges).join(d.withColumnRenamed("node", "a").withColumnRenamed("degree", "da"), "a").join(d.withColumnRenamed("node", "b").withColumnRenamed("degree", "db"), "b")
    varied = (F.min("da") < F.max("da")) & (F.min("db") < F.max("db"))
    return ends.agg(F.when(varied, F.try_divide(F.covar_pop("da", "db"), F.stddev_pop("da") * F.stddev_pop("db"))).alias("assortativity"))


def modularity(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(modularity) of a partition (node, community), weighted."""
    total = edges.agg(F.sum("weight").alias("m"))
    a, b = groups.toDF("a", "ca"), groups.toDF("b", "cb")
    inside = edges.join(a, "a").join(b, "b").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("w"))
    strength = degrees(edges).join(groups, "node").groupBy("community").agg(F.sum("strength").alias("s"))
    each = strength.join(inside, "community", "left").crossJoin(F.broadcast(total))
    return each.agg(F.sum(F.coalesce("w", F.lit(0.0)) / F.col("m") - (F.col("s") / (2 * F.col("m"))) * (F.col("s") / (2 * F.col("m")))).alias("modularity"))


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(node, rank) after a fixed number of weighted rounds; every node here has an edge, so no mass is lost."""
    from ..streaming.checkpoints import cut

    links = both_ways(edges)
    out = links.groupBy("a").agg(F.sum("weight").alias("out"))
    steps = cut(links.join(out, "a").select("a", "b", (F.col("weight") / F.col("out")).alias("part")))
    nodes = steps.select(F.col("a").alias("node")).distinct()
    n = max(nodes.count(), 1)
    ranks = nodes.select("node", F.lit(1.0 / n).alias("rank"))
    for i in range(rounds):
        got = steps.join(ranks.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.sum(F.col("rank") * F.col("part")).alias("got"))
        ranks = got.select("node", ((1 - damping) / n + damping * F.col("got")).alias("rank"))
        if i % 5 == 4:
            ranks = cut(ranks)
    return ranks


def distances_from(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, hops): breadth-first search from all sources at once; a frontier join for each hop, until no node is new."""
    from ..streaming.checkpoints import cut

    links = both_ways(edges).select("a", "b").distinct()
    rings = [cut(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("hops")))]
    for hop in count(1):
        step = rings[-1].select("source", F.col("node").alias("a")).join(links, "a").select("source", F.col("b").alias("node")).distinct()
        ring = cut(step.join(_last_two(rings), ["source", "node"], "left_anti").select("source", "node", F.lit(hop).alias("hops")))
        if ring.isEmpty():
            return reduce(DataFrame.unionByName, rings)
        rings.append(ring)


def _last_two(rings: list[DataFrame]) -> DataFrame:
    """A neighbour of the last ring of a search is in it, in the one before, or new."""
    return reduce(DataFrame.union, [r.select("source", "node") for r in rings[-2:]])


def partial_correlations(precision: DataFrame) -> DataFrame:
    """(i, j, weight) = -theta_ij / sqrt(theta_ii theta_jj) from a precision matrix (i, j, theta), i < j."""
    diagonal = precision.where("i = j").select("i", F.col("theta").alias("own"))
    d = lambda c: diagonal.toDF(c, f"d{c}")
    return precision.where("i < j").join(d("i"), "i").join(d("j"), "j").select("i", "j", (-F.col("theta") / F.sqrt(F.col("di") * F.col("dj"))).alias("weight"))


def co_occurrence(graphs: DataFrame) -> DataFrame:
    """(graph1, graph2, shared, share): of graphs (graph, a, b) each two with common nodes, their number, and its share of all nodes of both."""
    held = graphs.select("graph", F.explode(F.array("a", "b")).alias("node")).distinct()
    sizes = held.groupBy("graph").agg(F.count(F.lit(1)).alias("n"))
    # One row for each node with all its graphs: as many pairs as graphs squared come from it, whatever their edges.
    sets = held.groupBy("node").agg(F.array_sort(F.collect_set("graph")).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("m"))
    pairs = sets.select("g", "m", F.explode("g").alias("graph1")).select("graph1", "m", F.explode("g").alias("graph2")).where("graph1 < graph2").groupBy("graph1", "graph2").agg(F.sum("m").alias("shared"))
    both = pairs.join(sizes.toDF("graph1", "n1"), "graph1").join(sizes.toDF("graph2", "n2"), "graph2")
    return both.select("graph1", "graph2", "shared", (F.col("shared") / (F.col("n1") + F.col("n2") - F.col("shared"))).alias("share"))


def against_null(observed: DataFrame, null: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, observed, null_mean, null_sd, low, high, ratio, p): p is the share of null values at least as large."""
    each = null.join(observed, keys)
    out = each.groupBy(*keys).agg(F.first("observed").alias("observed"), F.avg("value").alias("null_mean"), F.stddev_samp("value").alias("null_sd"), F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high"), F.avg(F.when(F.col("value") >= F.col("observed"), 1.0).otherwise(0.0)).alias("p"))
    return out.withColumn("ratio", F.when(F.col("null_mean") != 0, F.col("observed") / F.when(F.col("null_mean") != 0, F.col("null_mean"))))


def neighbour_centroid(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """(node, x, y): mean position of each node's neighbours."""
    near = both_ways(edges).select(F.col("a").alias("node"), F.col("b").alias("other"))
    return near.join(positions.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def rewired(edges: DataFrame, reps: int, swaps_per_edge: int = 10, seed: int = 1) -> DataFrame:
    """(rep, a, b): graphs of the same degrees, by swaps of the ends of two edges.

    A round deals the edges of each graph to half as many places by hash; the two of least hash at a place
    propose to swap their ends. Proposals that make a loop, an edge that is there or the same edge as
    another proposal are dropped. About a quarter of the edges move in a round, so there are four rounds
    for each swap and edge asked for. Each round is written before the next.
    """
    from ..streaming.checkpoints import cut

    graphs = edges.sparkSession.range(1, reps + 1).select(F.col("id").cast("int").alias("rep"))
    now = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct().join(F.broadcast(graphs)).select("rep", "a", "b"))
    places = max(edges.count() // 2, 1)
    for turn in range(4 * swaps_per_edge):
        dealt = now.withColumn("h", F.md5(F.concat_ws("|", F.lit(seed), F.lit(turn), "rep", "a", "b").cast("binary")))
        pair = dealt.groupBy("rep", (F.conv(F.left("h", F.lit(12)), 16, 10).cast("bigint") % places).alias("place")).agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "a", "b"))), 1, 2).alias("e")).where(F.size("e") == 2)
        one, two = F.col("e")[0], F.col("e")[1]
        crossed = F.right(one["h"], F.lit(1)) < "8"
        c, d = F.when(crossed, two["a"]).otherwise(two["b"]), F.when(crossed, two["b"]).otherwise(two["a"])
        offer = pair.select("rep", "place", one["a"].alias("a"), one["b"].alias("b"), c.alias("c"), d.alias("d")).where("a <> d and b <> c")
        made = offer.select("rep", "place", F.explode(F.array(F.struct(F.least("a", "d").alias("a"), F.greatest("a", "d").alias("b")), F.struct(F.least("b", "c").alias("a"), F.greatest("b", "c").alias("b")))).alias("x")).select("rep", "place", "x.*")
        made = made.join(now.withColumn("there", F.lit(1)), ["rep", "a", "b"], "left")
        often = made.groupBy("rep", "a", "b").agg(F.count(F.lit(1)).alias("n"))
        good = made.join(often, ["rep", "a", "b"]).groupBy("rep", "place").agg(F.sum(F.when(F.col("there").isNull() & (F.col("n") == 1), 1).otherwise(0)).alias("ok")).where("ok = 2").select("rep", "place")
        kept = cut(offer.join(good, ["rep", "place"]))
        gone = kept.select("rep", F.explode(F.array(F.struct("a", "b"), F.struct(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")))).alias("x")).select("rep", "x.*")
        new = kept.select("rep", F.explode(F.array(F.struct(F.least("a", "d").alias("a"), F.greatest("a", "d").alias("b")), F.struct(F.least("b", "c").alias("a"), F.greatest("b", "c").alias("b")))).alias("x")).select("rep", "x.*")
        now = cut(now.join(gone, ["rep", "a", "b"], "left_anti").unionByName(new))
    return now


def null_metrics(graphs: DataFrame) -> DataFrame:
    """(rep, metric, value) of unweighted graphs (rep, a, b): transitivity, average clustering and degree assortativity of each."""
    ends = graphs.select("rep", "a", "b").union(graphs.select("rep", F.col("b").alias("a"), F.col("a").alias("b")))
    d = ends.groupBy("rep", F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    side = lambda c: d.select("rep", F.col("node").alias(c), F.col("degree").alias(f"d{c}"))
    both = ends.join(side("a"), ["rep", "a"]).join(side("b"), ["rep", "b"])
    r = both.groupBy("rep").agg(F.try_divide(F.covar_pop("da", "db"), F.stddev_pop("da") * F.stddev_pop("db")).alias("value")).select("rep", F.lit("assortativity").alias("metric"), "value")
    up = both.where((F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))).select("rep", F.col("a").alias("s"), F.col("b").alias("t"))
    wedges = up.withColumnRenamed("t", "t1").join(up.withColumnRenamed("t", "t2"), ["rep", "s"]).where("t1 < t2")
    met = wedges.join(graphs.select("rep", F.col("a").alias("t1"), F.col("b").alias("t2")), ["rep", "t1", "t2"])
    each = met.select("rep", F.explode(F.array("s", "t1", "t2")).alias("node")).groupBy("rep", "node").agg(F.count(F.lit(1)).alias("t"))
    closed = each.groupBy("rep").agg((F.sum("t") / 3).alias("t"))
    near = d.join(each, ["rep", "node"], "left").groupBy("rep").agg(F.avg(F.coalesce(F.try_divide(2.0 * F.coalesce("t", F.lit(0)), F.col("degree") * (F.col("degree") - 1)), F.lit(0.0))).alias("value"))
    all_ = d.groupBy("rep").agg(F.sum(F.col("degree") * (F.col("degree") - 1) / 2).alias("w")).join(closed, "rep", "left")
    return all_.select("rep", F.lit("transitivity").alias("metric"), F.try_divide(3.0 * F.coalesce("t", F.lit(0)), F.col("w")).alias("value")).union(r).union(near.select("rep", F.lit("average_clustering").alias("metric"), "value"))


def weighted_clustering(edges: DataFrame) -> DataFrame:
    """(node, clustering): the mean over a node's pairs of neighbours of the cube root of the triangle's weights, each over the largest weight."""
    scaled = edges.join(F.broadcast(edges.agg(F.max("weight").alias("m")))).select("a", "b", (F.col("weight") / F.col("m")).alias("w"))
    w = lambda x, y, n: scaled.select(F.col("a").alias(x), F.col("b").alias(y), F.col("w").alias(n))
    each = triangles(edges).join(w("x", "y", "w1"), ["x", "y"]).join(w("x", "z", "w2"), ["x", "z"]).join(w("y", "z", "w3"), ["y", "z"])
    g = each.select(F.explode(F.array("x", "y", "z")).alias("node"), F.cbrt(F.col("w1") * F.col("w2") * F.col("w3")).alias("g")).groupBy("node").agg(F.sum("g").alias("g"))
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    return degrees(edges).join(g, "node", "left").select("node", F.coalesce(F.try_divide(F.coalesce("g", F.lit(0.0)), pairs), F.lit(0.0)).alias("clustering"))


def with_attributes(nodes: DataFrame, *tables: DataFrame) -> DataFrame:
    """The nodes with the columns of every table (node, ...); what a table does not know is null."""
    return reduce(lambda left, right: left.join(right, "node", "left"), tables, nodes).select("node", *[c for t in tables for c in t.columns if c != "node"], *[c for c in nodes.columns if c != "node"])


def membership(graphs: dict[str, DataFrame]) -> DataFrame:
    """(node, graphs, members): in how many graphs a node is, and their names in order."""
    each = reduce(DataFrame.union, [degrees(e).select("node", F.lit(name).alias("graph")) for name, e in graphs.items()])
    return each.groupBy("node").agg(F.count(F.lit(1)).alias("graphs"), F.array_join(F.array_sort(F.collect_set("graph")), "+").alias("members"))


def all_paths(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(source, node, hops, paths): shortest paths from every source (by default every node) and their number.

    All pairs of a component are the output itself; a frontier join and a sum for each hop.
    """
    from ..streaming.checkpoints import cut

    links = cut(both_ways(edges).select("a", "b").distinct())
    start = links.select(F.col("a").alias("node")).distinct() if sources is None else sources
    rings = [cut(start.select(F.col("node").alias("source"), "node", F.lit(0).alias("hops"), F.lit(1.0).alias("paths")))]
    for hop in count(1):
        step = rings[-1].select("source", F.col("node").alias("a"), "paths").join(links, "a").groupBy("source", F.col("b").alias("node")).agg(F.sum("paths").alias("paths"))
        ring = cut(step.join(_last_two(rings), ["source", "node"], "left_anti").select("source", "node", F.lit(hop).alias("hops"), "paths"))
        if ring.isEmpty():
            return reduce(DataFrame.unionByName, rings)
        rings.append(ring)


def path_summary(edges: DataFrame) -> DataFrame:
    """(nodes, mean_hops, diameter) of the largest component."""
    table = component_table(components(edges)).where("is_largest").select("node")
    hops = distances_from(edges, table)
    return hops.agg(F.countDistinct("source").alias("nodes"), F.avg(F.when(F.col("hops") > 0, F.col("hops"))).alias("mean_hops"), F.max("hops").alias("diameter"))


def betweenness(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """(node, betweenness): over all pairs of other nodes the share of their shortest paths that pass through it.

    Dependencies go back from the farthest nodes hop by hop: each hands its own and one more to its predecessors, by their numbers of paths.
    """
    from ..streaming.checkpoints import cut

    links = both_ways(edges).select("a", "b").distinct()
    far = paths.agg(F.max("hops")).first()[0] or 0
    done = None
    below = None
    for hop in range(far, 0, -1):
        at = paths.where(F.col("hops") == hop)
        at = at.join(below, ["source", "node"], "left").na.fill(0.0, ["dep"]) if below is not None else at.withColumn("dep", F.lit(0.0))
        done = at.select("node", "dep") if done is None else done.union(at.select("node", "dep"))
        before = paths.where(F.col("hops") == hop - 1).select("source", F.col("node").alias("b"), F.col("paths").alias("own"))
        step = at.select("source", F.col("node").alias("a"), ((1 + F.col("dep")) / F.col("paths")).alias("part")).join(links, "a").join(before, ["source", "b"])
        below = cut(step.groupBy("source", F.col("b").alias("node")).agg(F.sum(F.col("part") * F.col("own")).alias("dep")))
    nodes = paths.where("hops = 0").select("node")
    if done is None:
        return nodes.select("node", F.lit(0.0).alias("betweenness"))
    return nodes.join(done.groupBy("node").agg((F.sum("dep") / 2).alias("betweenness")), "node", "left").na.fill(0.0)


def eigenvector(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """(node, eigenvector): of the adjacency plus one, by power iterations, then scaled to a largest value of one in each component."""
    from ..streaming.checkpoints import cut

    links = cut(both_ways(edges).select("a", "b").distinct())
    held = links.select(F.col("a").alias("node")).distinct().withColumn("x", F.lit(1.0))
    for i in range(rounds):
        step = links.join(held.select(F.col("node").alias("a"), "x"), "a").select(F.col("b").alias("node"), "x").union(held)
        held = step.groupBy("node").agg(F.sum("x").alias("x"))
        held = cut(held) if i % 6 == 5 else held
    placed = held.join(components(edges), "node")
    top = placed.groupBy("component").agg(F.max("x").alias("m"))
    return placed.join(top, "component").select("node", (F.col("x") / F.col("m")).alias("eigenvector"))


def centralities(edges: DataFrame) -> DataFrame:
    """(node, reached, closeness, betweenness): closeness is (reached - 1) over the sum of hops within the component."""
    paths = all_paths(edges)
    near = paths.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("reached"), F.try_divide(F.count(F.lit(1)) - 1.0, F.sum("hops")).alias("closeness"))
    return near.join(betweenness(edges, paths), "node")


def communities(edges: DataFrame, rounds: int = 6, levels: int = 3) -> DataFrame:
    """(node, community): groups of high modularity by greedy moves, level by level.

    In a round half of the nodes, by hash, may move to the neighbouring community of largest gain in modularity;
    when rounds bring none, communities become the nodes of the next level. A community is named by its least node.
    """
    from ..streaming.checkpoints import cut

    graph = cut(tidy_edges(edges).withColumn("weight", F.col("weight").cast("double")))
    loops = None
    names = cut(degrees(graph).select("node", F.col("node").alias("community")))
    whole = graph.agg(F.sum("weight")).first()[0]
    if not whole:
        return names
    for level in range(levels):
        ends = both_ways(graph)
        strength = ends.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("s"))
        if loops is not None:
            strength = strength.join(loops, "node", "full").select("node", (F.coalesce("s", F.lit(0.0)) + 2 * F.coalesce("loop", F.lit(0.0))).alias("s"))
        state = cut(strength.withColumn("c", F.col("node")))
        moved_any = False
        for turn in range(rounds):
            total = state.groupBy("c").agg(F.sum("s").alias("t"))
            near = ends.join(state.select(F.col("node").alias("b"), "c"), "b").groupBy(F.col("a").alias("node"), "c").agg(F.sum("weight").alias("w"))
            own = state.select("node", F.col("c").alias("own"), "s")
            tried = near.join(own, "node").join(total, "c")
            # Gain of being in c, without the node's own strength there.
            value = F.col("w") - F.col("s") * (F.col("t") - F.when(F.col("c") == F.col("own"), F.col("s")).otherwise(0.0)) / (2 * whole)
            best = tried.withColumn("v", value).groupBy("node").agg(F.min(F.struct((-F.col("v")).alias("x"), "c")).alias("b"), F.max(F.when(F.col("c") == F.col("own"), F.col("v"))).alias("stay"))
            alone = total.withColumnRenamed("c", "own").withColumnRenamed("t", "own_t")
            judged = own.join(best, "node", "left").join(alone, "own")
            stay = F.coalesce("stay", -F.col("s") * (F.col("own_t") - F.col("s")) / (2 * whole))
            go = F.col("b").isNotNull() & (-F.col("b.x") > stay + 1e-9) & (F.pmod(F.xxhash64(F.lit(level), F.lit(turn), "node"), F.lit(2)) == 0)
            after = cut(judged.select("node", "s", F.when(go, F.col("b.c")).otherwise(F.col("own")).alias("c"), F.coalesce(go, F.lit(False)).alias("moved")))
            changed = not after.where("moved").isEmpty()
            moved_any |= changed
            state = after.drop("moved")
            if not changed and turn % 2:
                break
        if not moved_any:
            break
        to = cut(state.join(state.groupBy("c").agg(F.min("node").alias("name")), "c").select("node", "name"))
        names = cut(names.join(to.select(F.col("node").alias("community"), "name"), "community").select("node", F.col("name").alias("community")))
        named = graph.join(to.select(F.col("node").alias("a"), F.col("name").alias("x")), "a").join(to.select(F.col("node").alias("b"), F.col("name").alias("y")), "b").select("x", "y", "weight")
        inside = named.where("x = y").groupBy(F.col("x").alias("node")).agg(F.sum("weight").alias("loop"))
        if loops is not None:
            inside = inside.union(loops.join(to, "node").select(F.col("name").alias("node"), "loop")).groupBy("node").agg(F.sum("loop").alias("loop"))
        loops, graph = cut(inside), cut(tidy_edges(named.select(F.col("x").alias("a"), F.col("y").alias("b"), "weight")))
    return names.join(names.groupBy("community").agg(F.min("node").alias("least")), "community").select("node", F.col("least").alias("community"))


def composition_correlations(logs: DataFrame, reps: int, seed: str = "1") -> DataFrame:
    """(rep, id1, id2, rho) between the unobserved basis values of compositions, from variances of log-ratios.

    ``logs`` (unit, id, value) has the logarithm of every id's share or count in every unit; at least three ids. With few
    strong correlations the variances of an id's log-ratios sum to (d - 2) w + sum of all w, which gives each basis
    variance w (at least 1e-4). In repetitions from 1 on each id's values are permuted over the units by hash.
    Pairs of ids are quadratic, as the output is.
    """
    each = logs.crossJoin(F.broadcast(logs.sparkSession.range(1, reps + 1).select(F.col("id").cast("int").alias("rep"))))
    by_hash = F.md5(F.concat_ws("|", F.lit(seed), "rep", F.col("id").cast("string"), F.col("unit").cast("string")).cast("binary"))
    places = each.select("rep", "unit", "id", F.row_number().over(Window.partitionBy("rep", "id").orderBy(by_hash, "unit")).alias("k"))
    own = logs.select("id", "value", F.row_number().over(Window.partitionBy("id").orderBy("unit")).alias("k"))
    rows = logs.select(F.lit(0).alias("rep"), "unit", "id", "value").union(places.join(own, ["id", "k"]).select("rep", "unit", "id", "value"))
    x, y = rows.toDF("rep", "unit", "id1", "v1"), rows.toDF("rep", "unit", "id2", "v2")
    ratio = x.join(y, ["rep", "unit"]).where("id1 < id2").groupBy("rep", "id1", "id2").agg(F.var_samp(F.col("v1") - F.col("v2")).alias("t"))
    sums = ratio.select("rep", F.explode(F.array("id1", "id2")).alias("id"), "t").groupBy("rep", "id").agg(F.sum("t").alias("t"))
    whole = sums.groupBy("rep").agg(F.sum("t").alias("total"), F.count(F.lit(1)).alias("d")).where("d > 2")
    basis = sums.join(whole, "rep").select("rep", "id", F.greatest((F.col("t") - F.col("total") / (2 * (F.col("d") - 1))) / (F.col("d") - 2), F.lit(1e-4)).alias("w"))
    both = ratio.join(basis.toDF("rep", "id1", "w1"), ["rep", "id1"]).join(basis.toDF("rep", "id2", "w2"), ["rep", "id2"])
    rho = (F.col("w1") + F.col("w2") - F.col("t")) / (2 * F.sqrt(F.col("w1") * F.col("w2")))
    return both.select("rep", "id1", "id2", F.least(F.greatest(rho, F.lit(-1.0)), F.lit(1.0)).alias("rho"))


def composition_edges(logs: DataFrame, reps: int, seed: str = "1") -> DataFrame:
    """(a, b, weight, p): two-sided share of the permuted correlations at least as strong, to nine decimals."""
    found = composition_correlations(logs, reps, seed)
    size = F.round(F.abs("rho"), 9)
    own = found.where("rep = 0").select("id1", "id2", F.col("rho").alias("weight"), size.alias("o"))
    tested = found.where("rep > 0").join(own, ["id1", "id2"]).groupBy("id1", "id2", "weight").agg(((1 + F.sum(F.when(size >= F.col("o"), 1).otherwise(0))) / (reps + 1.0)).alias("p"))
    return tested.select(F.col("id1").alias("a"), F.col("id2").alias("b"), "weight", "p")
