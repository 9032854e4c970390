"""Graphs of parts that share orders, resampling and power, sequences and file formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.transforms import relative
from ..operators import aggregate, distance, filters, network, ordination, permute, resample, sequences, stats
from ..sources.study import PATIENTS_SQL, counts, counts_sql, load, patients
from ..streaming.checkpoints import cut, windowed_totals
from .ecology import _UNITS, REPS, _rounded, _units, bray_sql, permuted_sql, r2_sql
from .registry import Registry

query = Registry()
CB, CT = (f"WITH {counts_sql(level)}" for level in ("brand", "type"))

#: Parts in one order, weighted by the number of orders.
_EDGES = """WITH li AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS k FROM lineitem), ed AS (SELECT x.k AS a, y.k AS b, count(*)::DOUBLE AS weight FROM li x JOIN li y ON x.o = y.o AND x.k < y.k GROUP BY ALL HAVING count(*) >= {t}),
 bw AS (SELECT a, b, weight FROM ed UNION ALL SELECT b, a, weight FROM ed), dg AS (SELECT a AS node, count(*) AS degree, sum(weight) AS strength FROM bw GROUP BY 1)"""
E1 = _EDGES.format(t=2)


#: Lines that a task pairs within their orders; there are about two pairs of parts for each line.
LINES = 200_000


def _pair_parts(lines) -> int:
    """Partitions in proportion to the lines, so that what a task sorts and counts does not grow with the table."""
    return max(1, -(-lines.count() // LINES))


def shared_orders(spark, d, least: int = 2):
    lines = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("k"))
    parts = _pair_parts(lines)
    li = lines.repartition(parts, "o").distinct()
    x, y = li.toDF("o", "a"), li.toDF("o", "b")  # an order has a handful of lines
    pairs = x.join(y, "o").where("a < b").repartition(2 * parts, "a", "b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("weight")).where(F.col("weight") >= least)


@query(f"{E1} SELECT * FROM ed")
def net3_flt31_thresholded_edges(spark, d):
    return filters.edges_above(shared_orders(spark, d, 1), 2)


@query(f"{E1} SELECT node, degree, strength FROM dg")
def net6_degrees(spark, d):
    return network.degrees(shared_orders(spark, d))


@query(f"{E1} SELECT count(*) AS nodes, (SELECT count(*) FROM ed) AS edges, round(avg(degree), 6) AS mean_degree, round(2.0::DOUBLE * (SELECT count(*) FROM ed) / (count(*) * (count(*) - 1)), 6) AS density, round(var_pop(degree) / avg(degree), 6) AS heterogeneity FROM dg")
def net6_summary(spark, d):
    return _rounded(network.summary(shared_orders(spark, d)))


@query(f"{E1} SELECT a AS node, count(*) AS g_degree, sum(weight) AS g_weight_sum, round(avg(weight), 6) AS g_weight_mean, sum(abs(weight)) AS g_abs_weight_sum FROM bw GROUP BY 1")
def agg12_endpoint_features(spark, d):
    return _rounded(aggregate.endpoint_features(shared_orders(spark, d), "g"))


_RECURSIVE = _EDGES.replace("WITH li", "WITH RECURSIVE li")


@query(f"{_RECURSIVE.format(t=2)}, rc AS (SELECT node, node AS root FROM dg UNION SELECT bw.b, rc.root FROM rc JOIN bw ON bw.a = rc.node AND rc.root < bw.b), cp AS (SELECT node, min(root) AS component FROM rc GROUP BY 1), sz AS (SELECT component, count(*) AS component_size FROM cp GROUP BY 1), od AS (SELECT *, row_number() OVER (ORDER BY component_size DESC, component)::INTEGER AS component_id FROM sz) SELECT node, component_id, component_size, component_id = 1 AS is_largest FROM cp JOIN od USING (component)")
def net7_win10_components(spark, d):
    return network.component_table(network.components(cut(shared_orders(spark, d))))


_TRI = f"{E1}, tr AS (SELECT e1.a AS x, e1.b AS y, e2.b AS z FROM ed e1 JOIN ed e2 ON e1.b = e2.a JOIN ed e3 ON e3.a = e1.a AND e3.b = e2.b), tn AS (SELECT node, count(*) AS t FROM (SELECT x AS node FROM tr UNION ALL SELECT y FROM tr UNION ALL SELECT z FROM tr) GROUP BY 1), cl AS (SELECT node, degree, coalesce(t, 0) AS triangles, CASE WHEN degree > 1 THEN 2.0::DOUBLE * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END AS clustering FROM dg LEFT JOIN tn USING (node))"


@query(f"{_TRI} SELECT node, degree, triangles, round(clustering, 6) AS clustering FROM cl")
def net8_clustering(spark, d):
    return _rounded(network.clustering(shared_orders(spark, d)))


@query(f"{_TRI} SELECT round(sum(triangles) / sum(degree * (degree - 1) / 2.0::DOUBLE), 6) AS transitivity, round(avg(clustering), 6) AS average_clustering FROM cl")
def net8_transitivity(spark, d):
    return _rounded(network.transitivity(shared_orders(spark, d)))


@query(f"{_RECURSIVE.format(t=2)}, sr AS (SELECT node FROM dg ORDER BY degree DESC, node LIMIT 5), bf AS (SELECT node AS source, node, 0 AS hops FROM sr UNION SELECT source, bw.b, hops + 1 FROM bf JOIN bw ON bw.a = bf.node WHERE hops < 40) SELECT source, count(*) AS reached, round(avg(hops), 6) AS mean_hops, max(hops) AS eccentricity, round((count(*) - 1) / sum(hops)::DOUBLE, 6) AS closeness FROM (SELECT source, node, min(hops) AS hops FROM bf GROUP BY ALL) GROUP BY 1")
def net9_net10_paths_from_hubs(spark, d):
    """Shortest paths and closeness of the five nodes of largest degree."""
    e = cut(shared_orders(spark, d))
    hubs = network.degrees(e).orderBy(F.desc("degree"), "node").limit(5).select("node")
    hops = network.distances_from(e, hubs)
    return _rounded(hops.groupBy("source").agg(F.count(F.lit(1)).alias("reached"), F.avg("hops").alias("mean_hops"), F.max("hops").alias("eccentricity"), ((F.count(F.lit(1)) - 1) / F.sum("hops")).alias("closeness")))


def pagerank_sql(rounds: int) -> str:
    steps = [f"r{i + 1} AS (SELECT b AS node, 0.15 / (SELECT count(*) FROM dg) + 0.85 * sum(rank * part) AS rank FROM pp JOIN r{i} ON r{i}.node = pp.a GROUP BY 1)" for i in range(rounds)]
    return f"{E1}, pp AS (SELECT a, b, weight / strength AS part FROM bw JOIN dg ON dg.node = bw.a), r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM dg) AS rank FROM dg), {', '.join(x.replace(' AS (', ' AS MATERIALIZED (', 1) for x in steps)} SELECT node, round(rank, 9) AS rank FROM r{rounds}"


@query(pagerank_sql(20))
def net10_pagerank(spark, d):
    """A fixed number of power iterations."""
    return _rounded(network.pagerank(cut(shared_orders(spark, d)), 20), 9)


#: Orders of one customer that are at most DAYS apart: as many nodes as orders, in components no larger than a customer.
DAYS = 90
_NEAR = f"""WITH RECURSIVE ed AS (SELECT x.o_orderkey AS a, y.o_orderkey AS b, 1.0::DOUBLE AS weight FROM orders x JOIN orders y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey AND abs(date_diff('day', x.o_orderdate::DATE, y.o_orderdate::DATE)) <= {DAYS}),
 bw AS (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed), nd AS (SELECT DISTINCT a AS node FROM bw), wk AS (SELECT node AS s, node AS t, 0 AS hops FROM nd UNION SELECT s, b, hops + 1 FROM wk JOIN bw ON a = t WHERE hops < 24), ds AS (SELECT s, t, min(hops) AS hops FROM wk GROUP BY ALL),
 pw AS (SELECT node AS s, node AS t, 0 AS hops FROM nd UNION ALL SELECT pw.s, bw.b, ds.hops FROM pw JOIN bw ON bw.a = pw.t JOIN ds ON ds.s = pw.s AND ds.t = bw.b AND ds.hops = pw.hops + 1), sp AS (SELECT s, t, hops, count(*) AS n FROM pw GROUP BY ALL)"""


def near_orders(spark, d):
    o = load(spark, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))
    x, y = o.toDF("c", "a", "u"), o.toDF("c", "b", "v")  # a customer has a handful of orders
    return x.join(y, "c").where((F.col("a") < F.col("b")) & (F.abs(F.datediff("u", "v")) <= DAYS)).select("a", "b", F.lit(1.0).alias("weight"))


@query(f"""{_NEAR}, ce AS (SELECT s AS node, count(*) AS reached, (count(*) - 1) / sum(hops)::DOUBLE AS closeness FROM ds GROUP BY 1),
 bt AS (SELECT x.t AS node, sum(x.n * y.n / z.n::DOUBLE) / 2 AS betweenness FROM sp x JOIN sp y ON y.s = x.t JOIN sp z ON z.s = x.s AND z.t = y.t AND z.hops = x.hops + y.hops WHERE x.hops > 0 AND y.hops > 0 GROUP BY 1)
 SELECT node, reached, round(closeness, 6) AS closeness, round(coalesce(betweenness, 0), 6) AS betweenness FROM ce LEFT JOIN bt USING (node)""")
def net10_centralities(spark, d):
    """Closeness and betweenness of all orders in the graph of near orders: all pairs of a component."""
    return _rounded(network.centralities(cut(near_orders(spark, d))))


def eigenvector_sql(rounds: int) -> str:
    steps = [f"v{i + 1} AS MATERIALIZED (SELECT node, sum(x) AS x FROM (SELECT b AS node, x FROM bw JOIN v{i} ON v{i}.node = bw.a UNION ALL SELECT node, x FROM v{i}) GROUP BY 1)" for i in range(rounds)]
    return f"{_RECURSIVE.format(t=2)}, rc AS (SELECT node, node AS root FROM dg UNION SELECT bw.b, rc.root FROM rc JOIN bw ON bw.a = rc.node AND rc.root < bw.b), cp AS (SELECT node, min(root) AS component FROM rc GROUP BY 1), v0 AS (SELECT node, 1.0::DOUBLE AS x FROM dg), {', '.join(steps)} SELECT node, round(x / max(x) OVER (PARTITION BY component), 6) AS eigenvector FROM v{rounds} JOIN cp USING (node)"


@query(eigenvector_sql(30))
def net10_eigenvector(spark, d):
    """A fixed number of power iterations, scaled within components."""
    return _rounded(network.eigenvector(cut(shared_orders(spark, d))))


@query(f"{_NEAR}, cp AS (SELECT s AS node, min(t) AS component FROM ds GROUP BY 1), sz AS (SELECT component, count(*) AS n FROM cp GROUP BY 1 ORDER BY n DESC, component LIMIT 1) SELECT any_value(n)::BIGINT AS nodes, round(avg(hops) FILTER (WHERE hops > 0), 6) AS mean_hops, max(hops) AS diameter FROM ds JOIN cp ON cp.node = s JOIN sz USING (component)")
def net9_largest_component_paths(spark, d):
    """Mean path and diameter of the largest component of near orders."""
    return _rounded(network.path_summary(cut(near_orders(spark, d))))


@query(f"{_NEAR}, cp AS (SELECT s AS node, min(t) AS component FROM ds GROUP BY 1) SELECT component, count(DISTINCT s) AS nodes, round(avg(hops) FILTER (WHERE hops > 0), 6) AS mean_hops, max(hops) AS diameter FROM ds JOIN cp ON cp.node = s GROUP BY 1")
def net9_component_paths(spark, d):
    """Mean path and diameter of every component of near orders."""
    e = cut(near_orders(spark, d))
    found = network.components(e)
    hops = network.distances_from(e, found.select("node")).join(found.select(F.col("node").alias("source"), "component"), "source")
    return _rounded(hops.groupBy("component").agg(F.countDistinct("source").alias("nodes"), F.avg(F.when(F.col("hops") > 0, F.col("hops"))).alias("mean_hops"), F.max("hops").alias("diameter")))


@query()
def net11_communities(spark, d):
    """Communities by greedy moves; tested on planted ones."""
    e = cut(shared_orders(spark, d))
    found = cut(network.communities(e))
    return _rounded(found.join(F.broadcast(network.modularity(e, found))))


@query(f"{E1}, t AS (SELECT sum(weight) AS m FROM ed), st AS (SELECT p_brand AS g, sum(strength) AS s FROM dg JOIN part ON p_partkey = node GROUP BY 1), ins AS (SELECT x.p_brand AS g, sum(weight) AS w FROM ed JOIN part x ON x.p_partkey = a JOIN part y ON y.p_partkey = b AND x.p_brand = y.p_brand GROUP BY 1) SELECT round(sum(coalesce(w, 0) / m - (s / (2 * m)) * (s / (2 * m))), 6) AS modularity FROM st LEFT JOIN ins USING (g), t")
def net11_modularity(spark, d):
    """Of the brands as communities."""
    return _rounded(network.modularity(shared_orders(spark, d), load(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("community"))))


@query(f"{E1} SELECT round(corr(x.degree, y.degree), 6) AS assortativity FROM bw JOIN dg x ON x.node = bw.a JOIN dg y ON y.node = bw.b")
def net12_assortativity(spark, d):
    return _rounded(network.assortativity(shared_orders(spark, d)))


def rewired_sql(reps: int, swaps: int) -> str:
    """SQL of network.rewired of ``ed`` as the expression ``rw`` (rep, a, b): a step for each round."""
    steps = [f"pc AS (SELECT greatest(count(*) // 2, 1) AS places FROM ed), w0 AS MATERIALIZED (SELECT rep, a, b FROM ed, (SELECT unnest(range(1, {reps + 1}))::INTEGER AS rep))"]
    for t in range(4 * swaps):
        steps.append(f"""p{t} AS MATERIALIZED (SELECT * FROM (SELECT rep, a, b, md5('1|{t}|' || rep || '|' || a || '|' || b) AS h, ('0x' || left(h, 12))::BIGINT % places AS place FROM w{t}, pc) QUALIFY row_number() OVER (PARTITION BY rep, place ORDER BY h) <= 2),
 o{t} AS MATERIALIZED (SELECT * FROM (SELECT x.rep, x.place, x.a, x.b, CASE WHEN right(x.h, 1) < '8' THEN y.a ELSE y.b END AS c, CASE WHEN right(x.h, 1) < '8' THEN y.b ELSE y.a END AS d FROM p{t} x JOIN p{t} y ON x.rep = y.rep AND x.place = y.place AND x.h < y.h) WHERE a <> d AND b <> c),
 n{t} AS (SELECT rep, place, least(a, d) AS a, greatest(a, d) AS b FROM o{t} UNION ALL SELECT rep, place, least(b, c), greatest(b, c) FROM o{t}),
 g{t} AS (SELECT rep, place FROM (SELECT n.rep, n.place, w.a IS NULL AND count(*) OVER (PARTITION BY n.rep, n.a, n.b) = 1 AS free FROM n{t} n LEFT JOIN w{t} w ON w.rep = n.rep AND w.a = n.a AND w.b = n.b) GROUP BY ALL HAVING bool_and(free)),
 k{t} AS MATERIALIZED (SELECT o.* FROM o{t} o JOIN g{t} USING (rep, place)),
 w{t + 1} AS MATERIALIZED (SELECT w.* FROM w{t} w ANTI JOIN (SELECT rep, a, b FROM k{t} UNION ALL SELECT rep, least(c, d), greatest(c, d) FROM k{t}) z USING (rep, a, b) UNION ALL SELECT rep, least(a, d), greatest(a, d) FROM k{t} UNION ALL SELECT rep, least(b, c), greatest(b, c) FROM k{t})""")
    return ", ".join(steps) + f", rw AS (SELECT * FROM w{4 * swaps})"


#: Null graphs and swaps for each edge of them.
GRAPHS, SWAPS = 100, 3
_NULL = f"""{E1}, {rewired_sql(GRAPHS, SWAPS)}, gr AS MATERIALIZED (SELECT 0 AS rep, a, b FROM ed UNION ALL SELECT * FROM rw), en AS (SELECT rep, a, b FROM gr UNION ALL SELECT rep, b, a FROM gr), dn AS MATERIALIZED (SELECT rep, a AS node, count(*) AS degree FROM en GROUP BY ALL),
 ta AS MATERIALIZED (SELECT x.rep, x.a AS s, x.b AS t, y.b AS u FROM gr x JOIN gr y ON x.rep = y.rep AND x.b = y.a JOIN gr z ON z.rep = x.rep AND z.a = x.a AND z.b = y.b), tc AS (SELECT rep, node, count(*) AS t FROM (SELECT rep, s AS node FROM ta UNION ALL SELECT rep, t FROM ta UNION ALL SELECT rep, u FROM ta) GROUP BY ALL),
 nc AS (SELECT dn.rep, degree, coalesce(t, 0) AS t FROM dn LEFT JOIN tc ON tc.rep = dn.rep AND tc.node = dn.node),
 nm AS (SELECT rep, 'transitivity' AS metric, sum(t) / sum(degree * (degree - 1) / 2.0::DOUBLE) AS value FROM nc GROUP BY 1 UNION ALL SELECT rep, 'average_clustering', avg(CASE WHEN degree > 1 THEN 2.0::DOUBLE * t / (degree * (degree - 1)) ELSE 0 END) FROM nc GROUP BY 1
 UNION ALL SELECT en.rep, 'assortativity', corr(x.degree, y.degree) FROM en JOIN dn x ON x.rep = en.rep AND x.node = en.a JOIN dn y ON y.rep = en.rep AND y.node = en.b GROUP BY 1)"""


@query(f"""{_NULL}, sm AS (SELECT metric, any_value(value) FILTER (WHERE rep = 0) AS observed, avg(value) FILTER (WHERE rep > 0) AS null_mean, stddev_samp(value) FILTER (WHERE rep > 0) AS null_sd, quantile_cont(value, 0.025) FILTER (WHERE rep > 0) AS low, quantile_cont(value, 0.975) FILTER (WHERE rep > 0) AS high FROM nm GROUP BY 1)
 SELECT metric, round(observed, 6) AS observed, round(null_mean, 6) AS null_mean, round(null_sd, 6) AS null_sd, round(low, 6) AS low, round(high, 6) AS high, round((SELECT avg(CASE WHEN nm.value >= sm.observed THEN 1.0 ELSE 0 END) FROM nm WHERE nm.metric = sm.metric AND nm.rep > 0), 6) AS p, round(observed / nullif(null_mean, 0), 6) AS ratio FROM sm""")
def net14_against_null(spark, d):
    """Clustering and assortativity of the graph against those of graphs with the same degrees."""
    e = cut(shared_orders(spark, d))
    null = network.null_metrics(cut(network.rewired(e, GRAPHS, SWAPS)))
    return _rounded(network.against_null(network.null_metrics(e.withColumn("rep", F.lit(0))).select("metric", F.col("value").alias("observed")), null, ["metric"]))


@query(f"{E1} SELECT rep::INTEGER AS rep, node, degree FROM dg, (SELECT unnest(range(1, 4)) AS rep)")
def net13_rewired_degrees(spark, d):
    """Swaps leave every degree as it was."""
    null = network.rewired(cut(shared_orders(spark, d)), 3, 3)
    return null.select("rep", F.explode(F.array("a", "b")).alias("node")).groupBy("rep", "node").agg(F.count(F.lit(1)).alias("degree"))


@query(f"{E1}, {rewired_sql(3, 3)} SELECT * FROM rw")
def net13_rewired_edges(spark, d):
    """The swapped graphs themselves."""
    return network.rewired(cut(shared_orders(spark, d)), 3, 3)


@query(f"{_NULL} SELECT metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM nm WHERE rep > 0 GROUP BY 1")
def net13_null_summary(spark, d):
    """Mean, deviation and interval of each metric over the null graphs."""
    return _rounded(network.null_metrics(cut(network.rewired(cut(shared_orders(spark, d)), GRAPHS, SWAPS))).groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high")))


@query(f"{E1}, cr AS (SELECT node, p_name AS name, p_brand AS label, degree, strength FROM dg LEFT JOIN part ON p_partkey = node) SELECT node, name, label, degree, strength, degree >= 5 AS hub FROM cr")
def net16_node_attributes(spark, d):
    e = shared_orders(spark, d)
    parts = load(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name"), F.col("p_brand").alias("label"))
    return network.with_attributes(network.degrees(e), parts).withColumn("hub", F.col("degree") >= 5)


@query(f"{E1}, mx AS (SELECT max(weight) AS m FROM ed), wt AS (SELECT e1.a AS x, e1.b AS y, e2.b AS z, pow(e1.weight / m * e2.weight / m * e3.weight / m, 1.0 / 3) AS g FROM ed e1 JOIN ed e2 ON e1.b = e2.a JOIN ed e3 ON e3.a = e1.a AND e3.b = e2.b, mx), wn AS (SELECT node, sum(g) AS g FROM (SELECT x AS node, g FROM wt UNION ALL SELECT y, g FROM wt UNION ALL SELECT z, g FROM wt) GROUP BY 1) SELECT node, round(CASE WHEN degree > 1 THEN 2 * coalesce(g, 0) / (degree * (degree - 1)) ELSE 0 END, 6) AS clustering FROM dg LEFT JOIN wn USING (node)")
def net8_weighted_clustering(spark, d):
    return _rounded(network.weighted_clustering(shared_orders(spark, d)))


@query(f"{E1}, g2 AS (SELECT * FROM ed WHERE weight >= 3), mb AS (SELECT 'low' AS graph, node FROM dg UNION ALL SELECT DISTINCT 'high', node FROM (SELECT a AS node FROM g2 UNION ALL SELECT b FROM g2)) SELECT node, count(*) AS graphs, string_agg(graph, '+' ORDER BY graph) AS members FROM mb GROUP BY 1")
def net15_membership(spark, d):
    """Which of two graphs hold each node."""
    e = shared_orders(spark, d)
    return network.membership({"low": e, "high": e.where("weight >= 3")})


_BY_PRIORITY = "WITH li AS (SELECT DISTINCT o_orderpriority AS graph, l_orderkey AS o, l_partkey AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey), pe AS (SELECT x.graph, x.k AS a, y.k AS b, count(*)::DOUBLE AS weight FROM li x JOIN li y ON x.o = y.o AND x.k < y.k GROUP BY ALL)"
URGENT = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


def _by_priority(spark, d):
    """(graph, a, b, weight): parts in one order, a graph for each priority."""
    lines = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("k"))
    parts = _pair_parts(lines)
    graphs = load(spark, d, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_orderpriority").alias("graph"))
    li = lines.repartition(parts, "o").join(graphs.repartition(parts, "o"), "o").select("graph", "o", "k").repartition(parts, "graph", "o").distinct()
    x, y = li.toDF("graph", "o", "a"), li.toDF("graph", "o", "b")
    pairs = x.join(y, ["graph", "o"]).where("a < b").repartition(2 * parts, "graph", "a", "b")
    return pairs.groupBy("graph", "a", "b").agg(F.count(F.lit(1)).cast("double").alias("weight"))


@query(f"{_BY_PRIORITY} SELECT a, b, sum(weight) AS weight FROM pe WHERE graph IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY ALL")
def net15_merged_graphs(spark, d):
    """The graphs of three priorities as one."""
    e = _by_priority(spark, d)
    return network.merged(*[e.where(F.col("graph") == g).select("a", "b", "weight") for g in URGENT])


@query(f"{_BY_PRIORITY}, mb AS (SELECT DISTINCT graph, node FROM (SELECT graph, a AS node FROM pe UNION ALL SELECT graph, b FROM pe)), sz AS (SELECT graph, count(*) AS n FROM mb GROUP BY 1) SELECT x.graph AS graph1, y.graph AS graph2, count(*) AS shared, round(count(*) / (any_value(s.n) + any_value(t.n) - count(*))::DOUBLE, 6) AS share FROM mb x JOIN mb y ON x.node = y.node AND x.graph < y.graph JOIN sz s ON s.graph = x.graph JOIN sz t ON t.graph = y.graph GROUP BY ALL")
def net15_co_occurrence(spark, d):
    """Edges of the graph of graphs: two are joined by the nodes that both have."""
    return _rounded(network.co_occurrence(_by_priority(spark, d)))


@query(f"{E1}, ps AS (SELECT p_partkey AS node, p_size AS x, p_retailprice AS y FROM part) SELECT bw.a AS node, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM bw JOIN ps ON ps.node = bw.b GROUP BY 1")
def net17_neighbour_centroid(spark, d):
    """In the plane of size and price."""
    at = load(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"))
    return _rounded(network.neighbour_centroid(shared_orders(spark, d), at))


@query(f"{CT}, s AS (SELECT patient AS unit, feature AS id, sum(count)::DOUBLE AS v FROM c GROUP BY ALL), m AS (SELECT x.id AS i, y.id AS j, sum(x.v * y.v) AS theta FROM s x JOIN s y ON x.unit = y.unit GROUP BY ALL) SELECT m.i, m.j, round(-theta / sqrt(a.t * b.t), 6) AS weight FROM m JOIN (SELECT i, theta AS t FROM m WHERE i = j) a ON a.i = m.i JOIN (SELECT j, theta AS t FROM m WHERE i = j) b ON b.j = m.j WHERE m.i < m.j")
def net2_partial_correlations(spark, d):
    """The scaling of a symmetric matrix by its diagonal, on the features' cross products."""
    s = counts(spark, d, "type").groupBy(F.col("patient").alias("unit"), F.col("feature").alias("id")).agg(F.sum("count").cast("double").alias("v"))
    a, b = s.toDF("unit", "i", "x"), s.toDF("unit", "j", "y")
    return _rounded(network.partial_correlations(a.join(b, "unit").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("theta"))))


@query(f"{CT}, s AS (SELECT patient AS unit, feature AS id, ln(count) - avg(ln(count)) OVER (PARTITION BY sample) AS v, sample FROM c), cr AS (SELECT x.id AS a, y.id AS b, corr(x.v, y.v) AS weight FROM s x JOIN s y ON x.sample = y.sample AND x.id < y.id GROUP BY ALL) SELECT a, b, round(weight, 6) AS weight, round(1 - weight, 6) AS dist FROM cr WHERE abs(weight) >= 0.1")
def net1_net5_correlation_network(spark, d):
    """Thresholded correlation of log-ratios, in place of sparse inverse covariance."""
    from ..functions.transforms import rclr, relative

    r = rclr(relative(counts(spark, d, "type"))).select(F.col("sample").alias("unit"), F.col("feature").alias("id"), F.col("rclr").alias("value"))
    edges = stats.pearson_pairs(r).select(F.col("id1").alias("a"), F.col("id2").alias("b"), F.col("r").alias("weight"))
    return _rounded(filters.edges_above(edges, 0.1, positive_only=False).withColumn("dist", 1 - F.col("weight")))


_U = "('0x' || left(md5({parts}), 8))::BIGINT / 4294967296.0::DOUBLE"


def boot_sql(reps: int, n: int) -> str:
    """SQL of resample.bootstrap over patients by case as the expression ``bt``."""
    u = _U.format(parts="'1|' || rep || '|' || slot || '|' || grp")
    return f"""ls AS (SELECT patient, "case" AS grp, row_number() OVER (PARTITION BY "case" ORDER BY patient) - 1 AS k, count(*) OVER (PARTITION BY "case") AS m FROM pt),
 sl AS (SELECT (i // {n})::INTEGER AS rep, (i % {n})::INTEGER AS slot FROM (SELECT unnest(range(0, {reps * n})) AS i)), dr AS (SELECT rep, slot, grp, CAST(floor({u} * m) AS INTEGER) AS k FROM sl, (SELECT DISTINCT grp, m FROM ls)),
 bt AS (SELECT rep, slot, dr.grp, patient, patient || '__b' || (row_number() OVER (PARTITION BY rep, dr.grp, patient ORDER BY slot) - 1) AS unique_id FROM dr JOIN ls ON ls.grp = dr.grp AND ls.k = dr.k)"""


def _boot(spark, d, reps, n):
    units = patients(spark, d).select("patient", F.col("case").alias("grp"))
    return resample.bootstrap(units, "patient", reps, n, "grp")


@query(f"WITH {PATIENTS_SQL}, {boot_sql(20, 12)} SELECT * FROM bt")
def res1_win8_bootstrap(spark, d):
    return _boot(spark, d, 20, 12)


_SH = f"{counts_sql('type')}, sh AS (SELECT patient, ln(sum(count)::DOUBLE) - sum(count * ln(count)) / sum(count) AS v FROM (SELECT patient, feature, sum(count) AS count FROM c GROUP BY ALL) GROUP BY 1)"


@query(f"WITH {PATIENTS_SQL}, {_SH}, {boot_sql(30, 10)}, e AS (SELECT rep, (avg(v) FILTER (WHERE grp = 'Cancer') - avg(v) FILTER (WHERE grp = 'Control')) / sqrt((var_samp(v) FILTER (WHERE grp = 'Cancer') + var_samp(v) FILTER (WHERE grp = 'Control')) / 2) AS d FROM bt JOIN sh USING (patient) GROUP BY 1) SELECT 'shannon' AS metric, round(avg(d), 4) AS mean, round(quantile_cont(d, 0.025), 4) AS low, round(quantile_cont(d, 0.975), 4) AS high FROM e")
def sta8_prm9_bootstrap_interval(spark, d):
    """The interval of Cohen's d over draws of as many cases as controls."""
    from ..operators.diversity import shannon

    v = shannon(counts(spark, d, "type").groupBy("patient", "feature").agg(F.sum("count").alias("count")), ["patient"])
    effects = stats.two_sample_moments(_boot(spark, d, 30, 10).join(v, "patient"), ["rep"], "grp", "Cancer", "shannon")
    return _rounded(resample.bootstrap_interval(effects.withColumn("metric", F.lit("shannon")), ["metric"], "cohens_d"), 4)


@query(f"""{CB}, k AS (SELECT sample, feature, count, feature IN ('Brand#1', 'Brand#7') AS s FROM c WHERE sample_type IN ('1-URGENT', '2-HIGH')), u AS (SELECT *, CASE WHEN s THEN floor(count * 3.0) ELSE 0 END AS up FROM k),
 t AS (SELECT *, sum(count) OVER w AS total, sum(up) OVER w AS spiked, sum(CASE WHEN s THEN 0 ELSE count END) OVER w AS rest FROM u WINDOW w AS (PARTITION BY sample)),
 g AS (SELECT *, round(CASE WHEN s AND spiked <= total AND rest > 0 THEN up::DOUBLE WHEN s THEN CASE WHEN spiked > 0 THEN up * total::DOUBLE / spiked ELSE 0 END WHEN spiked <= total AND rest > 0 THEN count * (total - spiked)::DOUBLE / rest ELSE 0 END, 9) AS target FROM t),
 p AS (SELECT *, floor(target) AS low, total - sum(floor(target)) OVER (PARTITION BY sample) AS short, row_number() OVER (PARTITION BY sample ORDER BY target - floor(target) DESC, feature) AS place FROM g)
 SELECT sample, feature, count, CAST(low + CASE WHEN place <= short THEN 1 ELSE 0 END AS BIGINT) AS spiked_count FROM p""")
def res4_res6_spike_in(spark, d):
    """Two features tripled in the samples of two types, the others scaled so that every total stays."""
    c = filters.keep_groups(counts(spark, d, "brand"), "sample_type", ["1-URGENT", "2-HIGH"])
    out = resample.spike_in(c, spark.createDataFrame([("Brand#1",), ("Brand#7",)], "feature string"), 3.0)
    return out.select("sample", "feature", "count", "spiked_count")


@query(f"WITH {PATIENTS_SQL}, {counts_sql('brand')}, s0 AS (SELECT patient, feature, sum(count) AS count FROM c GROUP BY ALL), {bray_sql('s0', 'patient', 'count')}, {boot_sql(15, 8)}, pl AS (SELECT rep, unique_id, patient, grp FROM bt), bp AS (SELECT rep, a.unique_id AS u1, b.unique_id AS u2, a.grp AS g1, b.grp AS g2, coalesce(dist, 0) AS dist FROM pl a JOIN pl b USING (rep) LEFT JOIN bc ON id1 = least(a.patient, b.patient) AND id2 = greatest(a.patient, b.patient) WHERE a.unique_id || a.grp < b.unique_id || b.grp), w AS (SELECT rep, sum(dist * dist) / 16 AS total, sum(CASE WHEN g1 = g2 THEN dist * dist / 8 ELSE 0 END) AS within FROM bp GROUP BY 1) SELECT rep, round(1 - within / total, 6) AS r2 FROM w")
def pwr1_prm9_bootstrap_r2(spark, d):
    """R-squared of case against control over bootstrap draws of patients; distances are computed once."""
    s = counts(spark, d, "brand").groupBy("patient", "feature").agg(F.sum("count").alias("count"))
    pairs = cut(distance.bray_curtis(s, "patient"))
    b = _boot(spark, d, 15, 8).select("rep", "unique_id", "patient", "grp")
    x, y = b.toDF("rep", "u1", "p1", "g1"), b.toDF("rep", "u2", "p2", "g2")
    met = x.join(y, "rep").where(F.concat("u1", "g1") < F.concat("u2", "g2"))
    far = met.join(pairs, (F.least("p1", "p2") == F.col("id1")) & (F.greatest("p1", "p2") == F.col("id2")), "left")
    d2 = F.coalesce("dist", F.lit(0.0)) * F.coalesce("dist", F.lit(0.0))
    sums = far.groupBy("rep").agg((F.sum(d2) / 16).alias("total"), F.sum(F.when(F.col("g1") == F.col("g2"), d2 / 8).otherwise(0.0)).alias("within"))
    return _rounded(sums.select("rep", (1 - F.col("within") / F.col("total")).alias("r2")))


@query("SELECT text AS seq, count(*) AS size FROM documents GROUP BY 1 HAVING count(*) >= 2")
def seq5_dereplicated(spark, d):
    return sequences.dereplicated(load(spark, d, "documents").select(F.col("text").alias("seq")), 2)


_SEQ = "WITH RECURSIVE sq AS (SELECT p_partkey AS id, p_name || ' ' || p_size || ' ' || p_brand AS seq FROM part), cl AS (SELECT seq, min(id) AS class_id FROM sq GROUP BY 1), lk AS (SELECT x.class_id AS a, y.class_id AS b FROM cl x JOIN cl y ON x.class_id <> y.class_id AND abs(length(x.seq) - length(y.seq)) <= 1 AND levenshtein(x.seq, y.seq) <= 1)"


def _sequences(spark, d):
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.col("p_size").cast("string"), "p_brand").alias("seq"))


@query(f"{_SEQ} SELECT id, class_id, (SELECT count(*) FROM lk WHERE a = class_id) AS n_links FROM sq JOIN cl USING (seq)")
def seq8_one_edit_links(spark, d):
    """Each row with its class of equal texts and the number of classes one edit away."""
    return sequences.one_edit_links(_sequences(spark, d))


@query(f"{_SEQ}, rc AS (SELECT class_id AS node, class_id AS root FROM cl UNION SELECT lk.b, rc.root FROM rc JOIN lk ON lk.a = rc.node AND rc.root < lk.b) SELECT id, min(root) AS cluster FROM sq JOIN cl USING (seq) JOIN rc ON node = class_id GROUP BY 1")
def seq8_clusters(spark, d):
    """Clusters of texts that single edits join."""
    return sequences.one_edit_clusters(_sequences(spark, d))


@query("SELECT o_custkey AS query, CASE WHEN max(n) / sum(n)::DOUBLE >= 0.51 THEN arg_max(taxon, (n, taxon)) ELSE 'Unassigned' END AS taxon, round(max(n) / sum(n)::DOUBLE, 6) AS consensus FROM (SELECT o_custkey, o_orderstatus AS taxon, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1")
def seq10_consensus_taxonomy(spark, d):
    return _rounded(sequences.consensus_taxonomy(load(spark, d, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderstatus").alias("taxon"))))


@query("SELECT page_id FROM pages WHERE list_sum(list_transform(string_split(url, ''), lambda c: pow(10.0::DOUBLE, -(ascii(c) - 33) / 10.0::DOUBLE))) <= 0.4 AND length(html) BETWEEN 245 AND 15000")
def seq3_passing(spark, d):
    """Rows of few expected errors and a length within bounds."""
    p = load(spark, d, "pages").select("page_id", F.col("url").alias("quality"), F.col("html").alias("seq"))
    return sequences.pass_filter(p, 0.4, 245, 15000).select("page_id")


@query("SELECT page_id, round(list_sum(list_transform(string_split(url, ''), lambda c: pow(10.0::DOUBLE, -(ascii(c) - 33) / 10.0::DOUBLE))), 8) AS ee FROM pages")
def seq3_expected_errors(spark, d):
    return load(spark, d, "pages").select("page_id", F.round(sequences.expected_errors(F.col("url")), 8).alias("ee"))


#: The leading eigenvectors of a symmetric matrix in SQL: fourteen squarings leave its first; then it is taken out and again.
def _squared(name: str, source: str, rounds: int = 16) -> str:
    out = [f"{name}_0 AS (SELECT g FROM {source})"]
    for k in range(rounds):
        out.append(f"{name}_{k + 1} AS (SELECT list_transform(m, lambda x: list_transform(x, lambda y: y / top)) AS g FROM (SELECT m, list_max(list_transform(m, lambda x: list_max(list_transform(x, lambda y: abs(y))))) AS top FROM (SELECT list_transform(g, lambda x: list_transform(g, lambda y: list_dot_product(x, y))) AS m FROM {name}_{k})))")
    out.append(f"{name}_v AS (SELECT list_transform(v, lambda y: y / sqrt(list_dot_product(v, v))) AS v FROM (SELECT list_transform(g, lambda x: list_sum(list_transform(generate_series(1, len(x)), lambda i: x[i] * (1 + i % 7)))) AS v FROM {name}_{rounds}))")
    return ", ".join(out)


_PCOA = f"""{CB}, {bray_sql('c', 'sample', 'count')}, us AS (SELECT DISTINCT sample AS u FROM c), sq AS (SELECT x.u AS a, y.u AS b, CASE WHEN x.u = y.u THEN 0 ELSE -0.5 * dist * dist END AS a2 FROM us x CROSS JOIN us y LEFT JOIN bc ON id1 = least(x.u, y.u) AND id2 = greatest(x.u, y.u)),
 ce AS (SELECT a, b, a2 - avg(a2) OVER (PARTITION BY a) - avg(a2) OVER (PARTITION BY b) + avg(a2) OVER () AS g FROM sq), rw AS (SELECT a, list(g ORDER BY b) AS r FROM ce GROUP BY 1), g0 AS (SELECT list(r ORDER BY a) AS g, list(a ORDER BY a) AS ids FROM rw),
 tr AS (SELECT sum(g) FILTER (WHERE a = b) AS trace FROM ce), sh AS (SELECT list_transform(g, lambda x, i: list_transform(x, lambda y, j: y + CASE WHEN i = j THEN 5 ELSE 0 END)) AS g FROM g0), {_squared('s1', 'sh')},
 e1 AS (SELECT v, list_dot_product(v, list_transform(g0.g, lambda x: list_dot_product(x, v))) AS value FROM s1_v, g0),
 s2 AS (SELECT list_transform(sh.g, lambda x, i: list_transform(x, lambda y, j: y - (value + 5) * v[i] * v[j])) AS g FROM sh, e1), {_squared('s2', 's2').replace('s2_0 AS', 's2_0 AS', 1)},
 e2 AS (SELECT v, list_dot_product(v, list_transform(g0.g, lambda x: list_dot_product(x, v))) AS value FROM s2_v, g0),
 ax AS (SELECT 1 AS axis, v, value FROM e1 UNION ALL SELECT 2, v, value FROM e2), pt AS (SELECT axis, value, unnest(ids) AS id, unnest(v) AS x FROM ax, g0), sg AS (SELECT axis, CASE WHEN sum(x * x * x) < 0 THEN -1 ELSE 1 END AS sign FROM pt GROUP BY 1)"""


@query(f"{_PCOA} SELECT id, axis, round(sign * x * sqrt(greatest(value, 0)), 5) AS value, round(greatest(value, 0) / trace, 6) AS explained FROM pt JOIN sg USING (axis), tr")
def ord1_pcoa(spark, d):
    """Principal coordinates of all samples."""
    return ordination.pcoa(distance.bray_curtis(counts(spark, d, "brand"))).select("id", "axis", F.round("value", 5).alias("value"), F.round("explained", 6).alias("explained"))


#: Two constraints: mean price and mean discount of a sample's lines. The eigenproblem of two by two in closed form.
_CCA = f"""{CB}, en AS (SELECT c_nationkey || '|' || o_orderpriority AS sample, avg(l_extendedprice)::DOUBLE / 1000 AS price, avg(l_discount)::DOUBLE * 100 AS discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1),
 hl AS (SELECT sample, feature, sqrt(count / sum(count) OVER (PARTITION BY sample)::DOUBLE) AS v FROM c WHERE count > 0), tt AS (SELECT sum(v) AS t FROM hl), rr AS (SELECT sample, sum(v) / any_value(t) AS r FROM hl, tt GROUP BY 1),
 mx AS (SELECT sum(r * price) AS mp, sum(r * discount) AS md FROM rr JOIN en USING (sample)), x AS (SELECT sample, r, price - mp AS x1, discount - md AS x2 FROM rr JOIN en USING (sample), mx), mm AS (SELECT sum(r * x1 * x1) AS m11, sum(r * x1 * x2) AS m12, sum(r * x2 * x2) AS m22 FROM x),
 bb AS (SELECT feature, sum(v) / any_value(t) AS c, sum(v * x1) / any_value(t) AS b1, sum(v * x2) / any_value(t) AS b2 FROM hl JOIN x USING (sample), tt GROUP BY 1), ss AS (SELECT sum(b1 * b1 / c) AS s11, sum(b1 * b2 / c) AS s12, sum(b2 * b2 / c) AS s22 FROM bb),
 qd AS (SELECT *, m11 * m22 - m12 * m12 AS qa, s11 * m22 + s22 * m11 - 2 * s12 * m12 AS qb, s11 * s22 - s12 * s12 AS qc FROM mm, ss), ev AS (SELECT *, axis, (qb + CASE WHEN axis = 1 THEN 1 ELSE -1 END * sqrt(qb * qb - 4 * qa * qc)) / (2 * qa) AS value FROM qd, (SELECT unnest([1, 2]) AS axis)),
 w0 AS (SELECT *, s12 - value * m12 AS u1, -(s11 - value * m11) AS u2 FROM ev), ww AS (SELECT axis, value, m11, m12, m22, CASE WHEN u1 < 0 THEN -1 ELSE 1 END * u1 / sqrt(u1 * u1 * m11 + 2 * u1 * u2 * m12 + u2 * u2 * m22) AS w1, CASE WHEN u1 < 0 THEN -1 ELSE 1 END * u2 / sqrt(u1 * u1 * m11 + 2 * u1 * u2 * m12 + u2 * u2 * m22) AS w2 FROM w0),
 sc AS (SELECT feature, axis, value, (b1 * w1 + b2 * w2) / c AS score FROM bb, ww), wa AS (SELECT sample, axis, sum(v * score) / sum(v) / any_value(value) AS wa FROM hl JOIN sc USING (feature) GROUP BY ALL), st AS (SELECT sample, r AS weight, axis, wa, x1 * w1 + x2 * w2 AS lc FROM x, ww JOIN wa USING (axis) WHERE wa.sample = x.sample)"""
_CCA = _CCA.replace("st AS (SELECT sample, r AS weight, axis, wa, x1 * w1 + x2 * w2 AS lc FROM x, ww JOIN wa USING (axis) WHERE wa.sample = x.sample)", "st AS (SELECT x.sample, r AS weight, ww.axis, wa, x1 * w1 + x2 * w2 AS lc FROM x JOIN wa ON wa.sample = x.sample JOIN ww ON ww.axis = wa.axis)")


def _constrained(spark, d):
    table = relative(counts(spark, d, "brand")).where("p > 0").select("sample", "feature", F.sqrt("p").alias("value"))
    lines = load(spark, d, "lineitem").join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    mean = lambda c: F.avg(c).cast("double")
    env = cut(lines.groupBy(F.concat_ws("|", "c_nationkey", "o_orderpriority").alias("sample")).agg((mean("l_extendedprice") / 1000).alias("price"), (mean("l_discount") * 100).alias("discount")))
    return ordination.constrained_axes(table, env, "sample"), env


@query(f"{_CCA} SELECT sample, axis, round(wa, 4) AS wa, round(lc, 4) AS lc FROM st")
def ord2_site_scores(spark, d):
    """Canonical correspondence analysis on two continuous constraints: scores of the samples on both axes."""
    found, _ = _constrained(spark, d)
    return found["sites"].select("sample", "axis", F.round("wa", 4).alias("wa"), F.round("lc", 4).alias("lc"))


@query(f"{_CCA} SELECT feature, axis, round(score, 5) AS score FROM sc")
def ord2_feature_scores(spark, d):
    found, _ = _constrained(spark, d)
    return found["features"].select("feature", "axis", F.round("score", 5).alias("score"))


@query(f"""{_CCA}, vr AS (SELECT sample, 'price' AS variable, price AS y FROM en WHERE sample IN (SELECT sample FROM x) UNION ALL SELECT sample, 'discount', discount FROM en WHERE sample IN (SELECT sample FROM x)),
 ow AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY sample) AS k FROM vr), px AS (SELECT rep, variable, sample, row_number() OVER (PARTITION BY rep, variable ORDER BY md5('1|' || rep || '|' || variable || '|' || sample), sample) AS k FROM vr, (SELECT unnest(range(1, {REPS + 1}))::INTEGER AS rep)),
 al AS (SELECT 0 AS rep, variable, sample, y FROM vr UNION ALL SELECT rep, px.variable, px.sample, ow.y FROM px JOIN ow ON ow.variable = px.variable AND ow.k = px.k), a2 AS (SELECT sample, any_value(weight) AS w, max(wa) FILTER (WHERE axis = 1) AS a, max(wa) FILTER (WHERE axis = 2) AS b FROM st GROUP BY 1),
 sm AS (SELECT rep, variable, sum(w * a * a) - sum(w * a) * sum(w * a) / sum(w) AS aa, sum(w * b * b) - sum(w * b) * sum(w * b) / sum(w) AS bb, sum(w * a * b) - sum(w * a) * sum(w * b) / sum(w) AS ab, sum(w * a * y) - sum(w * a) * sum(w * y) / sum(w) AS ay, sum(w * b * y) - sum(w * b) * sum(w * y) / sum(w) AS b_y, sum(w * y * y) - sum(w * y) * sum(w * y) / sum(w) AS yy FROM al JOIN a2 USING (sample) GROUP BY ALL),
 xz AS (SELECT *, (bb * ay - ab * b_y) / (aa * bb - ab * ab) AS x, (aa * b_y - ab * ay) / (aa * bb - ab * ab) AS z FROM sm), fr AS (SELECT *, (x * ay + z * b_y) / yy AS r2 FROM xz), bp AS (SELECT axis, (m11 * w1 + m12 * w2) / sqrt(m11) AS price, (m12 * w1 + m22 * w2) / sqrt(m22) AS discount FROM ww)
 SELECT variable, round(x / sqrt(x * x + z * z), 4) AS axis1, round(z / sqrt(x * x + z * z), 4) AS axis2, round(r2, 5) AS r2, round((1 + (SELECT count(*) FROM fr o WHERE o.variable = fr.variable AND o.rep > 0 AND round(o.r2, 9) >= round(fr.r2, 9))) / {REPS + 1}.0::DOUBLE, 6) AS p,
  round((SELECT CASE WHEN variable = 'price' THEN price ELSE discount END FROM bp WHERE axis = 1), 4) AS score1, round((SELECT CASE WHEN variable = 'price' THEN price ELSE discount END FROM bp WHERE axis = 2), 4) AS score2 FROM fr WHERE rep = 0""")
def ord2_fitted_vectors(spark, d):
    """The constraints as arrows: scores, fitted directions over the sample scores, fit and permutation p."""
    found, env = _constrained(spark, d)
    sites = cut(found["sites"].groupBy("sample").agg(F.first("weight").alias("weight"), F.max(F.when(F.col("axis") == 1, F.col("wa"))).alias("a1"), F.max(F.when(F.col("axis") == 2, F.col("wa"))).alias("a2")))
    arrows = ordination.fitted_vectors(sites, env.unpivot("sample", ["price", "discount"], "variable", "value"), "sample", REPS)
    scores = found["variables"].groupBy("variable").agg(*[F.round(F.max(F.when(F.col("axis") == k, F.col("score"))), 4).alias(f"score{k}") for k in (1, 2)])
    return arrows.join(scores, "variable").select("variable", F.round("axis1", 4).alias("axis1"), F.round("axis2", 4).alias("axis2"), F.round("r2", 5).alias("r2"), F.round("p", 6).alias("p"), "score1", "score2")


_FAR = f"""{_UNITS}, {permuted_sql('us', 'sample', 'sample_type', REPS)}, cs AS (SELECT sample_type, count(*) AS m FROM us GROUP BY 1),
 ins AS (SELECT id1, id2, a.sample_type, dist * dist AS d2 FROM bc JOIN us a ON id1 = a.sample JOIN us b ON id2 = b.sample AND a.sample_type = b.sample_type),
 ow AS (SELECT sample, sum(d2) AS s FROM (SELECT id1 AS sample, d2 FROM ins UNION ALL SELECT id2, d2 FROM ins) GROUP BY 1), wh AS (SELECT sample_type, sum(d2) AS w FROM ins GROUP BY 1),
 fr AS (SELECT us.sample, us.sample_type, sqrt(abs(coalesce(s, 0) / m - coalesce(w, 0) / (m * m))) AS r FROM us JOIN cs ON cs.sample_type = us.sample_type LEFT JOIN wh ON wh.sample_type = us.sample_type LEFT JOIN ow ON ow.sample = us.sample)"""


@query(f"{_FAR} SELECT sample_type, count(*) AS n, round(avg(r), 6) AS mean_distance FROM fr GROUP BY 1")
def prm7_dispersion(spark, d):
    """Mean distance of samples to their type's centroid."""
    c = counts(spark, d, "brand")
    far = permute.centre_distances(cut(distance.bray_curtis(c)), _units(c), "sample", "sample_type")
    return _rounded(far.groupBy("sample_type").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean_distance")))


@query(f"""{_FAR}, ce AS (SELECT sample, r, r - avg(r) OVER (PARTITION BY sample_type) AS e FROM fr), yy AS (SELECT rep, pl.sample_type, CASE WHEN rep = 0 THEN r ELSE e END AS y FROM pl JOIN ce USING (sample)),
 pg AS (SELECT rep, sample_type, count(*) AS m, sum(y) AS s, sum(y * y) AS q FROM yy GROUP BY ALL), ft AS (SELECT rep, count(*) AS k, CAST(sum(m) AS BIGINT) AS n, sum(s) AS s1, sum(q) AS q1, sum(s * s / m) AS b FROM pg GROUP BY 1),
 fv AS (SELECT rep, n, k, round(((b - s1 * s1 / n) / (k - 1)) / ((q1 - b) / (n - k)), 9) AS f FROM ft) SELECT n, k, round(f, 4) AS f, round((1 + (SELECT count(*) FROM fv x WHERE x.rep > 0 AND x.f >= fv.f)) / {REPS + 1}.0::DOUBLE, 6) AS p FROM fv WHERE rep = 0""")
def prm7_dispersion_test(spark, d):
    """Whether types spread alike: permuted residuals of the distances to the centroids."""
    c = counts(spark, d, "brand")
    return _rounded(permute.dispersion_test(cut(distance.bray_curtis(c)), _units(c), "sample", "sample_type", REPS)).withColumn("f", F.round("f", 4))


_MEDIAN_ROUNDS = 12
_TO_MEDIAN = f"""{_UNITS}, {permuted_sql('us', 'sample', 'sample_type', REPS)}, ib AS (SELECT id1 AS sample, id2 AS other, dist * dist AS d2 FROM bc JOIN us a ON id1 = a.sample JOIN us b ON id2 = b.sample AND a.sample_type = b.sample_type UNION ALL SELECT id2, id1, dist * dist FROM bc JOIN us a ON id1 = a.sample JOIN us b ON id2 = b.sample AND a.sample_type = b.sample_type),
 w0 AS (SELECT sample, sample_type, 1.0::DOUBLE / count(*) OVER (PARTITION BY sample_type) AS a FROM us), """ + ", ".join(
    f"f{i} AS MATERIALIZED (SELECT sample, sample_type, sqrt(abs(s - sum(a * s) OVER (PARTITION BY sample_type) / 2)) AS r FROM (SELECT w.sample, any_value(w.sample_type) AS sample_type, any_value(w.a) AS a, coalesce(sum(o.a * d2), 0) AS s FROM w{i} w LEFT JOIN ib ON ib.sample = w.sample LEFT JOIN w{i} o ON o.sample = ib.other GROUP BY 1)), w{i + 1} AS (SELECT sample, sample_type, (1 / greatest(r, 1e-9)) / sum(1 / greatest(r, 1e-9)) OVER (PARTITION BY sample_type) AS a FROM f{i})"
    for i in range(_MEDIAN_ROUNDS + 1)
) + f", fr AS (SELECT * FROM f{_MEDIAN_ROUNDS})"


@query(f"{_TO_MEDIAN} SELECT sample_type, count(*) AS n, round(avg(r), 6) AS mean_distance FROM fr GROUP BY 1")
def prm7_median_dispersion(spark, d):
    """Mean distance of samples to their type's spatial median."""
    c = counts(spark, d, "brand")
    far = permute.median_distances(cut(distance.bray_curtis(c)), _units(c), "sample", "sample_type", _MEDIAN_ROUNDS)
    return _rounded(far.groupBy("sample_type").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean_distance")))


@query(f"""{_TO_MEDIAN}, ce AS (SELECT sample, r, r - avg(r) OVER (PARTITION BY sample_type) AS e FROM fr), yy AS (SELECT rep, pl.sample_type, CASE WHEN rep = 0 THEN r ELSE e END AS y FROM pl JOIN ce USING (sample)),
 pg AS (SELECT rep, sample_type, count(*) AS m, sum(y) AS s, sum(y * y) AS q FROM yy GROUP BY ALL), ft AS (SELECT rep, count(*) AS k, CAST(sum(m) AS BIGINT) AS n, sum(s) AS s1, sum(q) AS q1, sum(s * s / m) AS b FROM pg GROUP BY 1),
 fv AS (SELECT rep, n, k, round(((b - s1 * s1 / n) / (k - 1)) / ((q1 - b) / (n - k)), 9) AS f FROM ft) SELECT n, k, round(f, 4) AS f, round((1 + (SELECT count(*) FROM fv x WHERE x.rep > 0 AND x.f >= fv.f)) / {REPS + 1}.0::DOUBLE, 6) AS p FROM fv WHERE rep = 0""")
def prm7_median_dispersion_test(spark, d):
    """Whether types spread alike around their spatial medians."""
    c = counts(spark, d, "brand")
    return _rounded(permute.dispersion_test(cut(distance.bray_curtis(c)), _units(c), "sample", "sample_type", REPS, median=True)).withColumn("f", F.round("f", 4))


@query(f"""{CB}, us AS (SELECT DISTINCT sample, patient, sample_type FROM c), {permuted_sql('us', 'sample', 'sample_type', REPS)}, hl AS (SELECT sample, feature, sqrt(count / sum(count) OVER (PARTITION BY sample)::DOUBLE) AS h FROM c WHERE count > 0),
 rs AS (SELECT sample, sum(h) AS hr FROM hl GROUP BY 1), cl AS (SELECT feature, sum(h) AS hc FROM hl GROUP BY 1), tt AS (SELECT sum(h * h / (hr * hc)) - 1 AS total FROM hl JOIN rs USING (sample) JOIN cl USING (feature)),
 gs AS (SELECT rep, sample_type, feature, sum(h) AS s FROM pl JOIN hl USING (sample) GROUP BY ALL), gr AS (SELECT rep, sample_type, sum(s) AS sr FROM gs GROUP BY ALL), co AS (SELECT rep, sum(s * s / (sr * hc)) - 1 AS constrained FROM gs JOIN gr USING (rep, sample_type) JOIN cl USING (feature) GROUP BY 1),
 nk AS (SELECT rep, count(*) AS n, count(DISTINCT sample_type) AS k FROM pl GROUP BY 1), fv AS (SELECT rep, total, constrained, round((constrained / (k - 1)) / ((total - constrained) / (n - k)), 9) AS f FROM co JOIN nk USING (rep), tt)
 SELECT round(total, 6) AS total, round(constrained, 6) AS constrained, round(constrained / total, 6) AS share, round(f, 4) AS f, round((1 + (SELECT count(*) FROM fv x WHERE x.rep > 0 AND x.f >= fv.f)) / {REPS + 1}.0::DOUBLE, 6) AS p FROM fv WHERE rep = 0""")
def ord2_constrained_inertia(spark, d):
    """Canonical correspondence analysis of Hellinger values on sample type: inertia, its constrained share, permutation test."""
    c = counts(spark, d, "brand")
    table = relative(c).where("p > 0").select("sample", "feature", F.sqrt("p").alias("value"))
    found = cut(ordination.constrained_inertia(table, permute.permuted_labels(_units(c), "sample", "sample_type", REPS), "sample", "sample_type"))
    own = found.where("rep = 0").select("total", "constrained", (F.col("constrained") / F.col("total")).alias("share"), F.round("f", 4).alias("f"))
    return _rounded(own.crossJoin(permute.p_value(found, "f").select("p")))


@query(f"""{CT}, lg AS (SELECT sample AS unit, feature AS id, ln(count) AS value FROM c WHERE count > 0 AND feature IN (SELECT feature FROM c WHERE count > 0 GROUP BY 1 HAVING count(DISTINCT sample) = (SELECT count(DISTINCT sample) FROM c))),
 pc AS (SELECT rep, unit, id, row_number() OVER (PARTITION BY rep, id ORDER BY md5('1|' || rep || '|' || id || '|' || unit), unit) AS k FROM lg, (SELECT unnest(range(1, 100))::INTEGER AS rep)), oc AS (SELECT id, value, row_number() OVER (PARTITION BY id ORDER BY unit) AS k FROM lg),
 rw AS (SELECT 0 AS rep, unit, id, value FROM lg UNION ALL SELECT rep, unit, id, value FROM pc JOIN oc USING (id, k)), tv AS (SELECT x.rep, x.id AS id1, y.id AS id2, var_samp(x.value - y.value) AS t FROM rw x JOIN rw y ON x.rep = y.rep AND x.unit = y.unit AND x.id < y.id GROUP BY ALL),
 ti AS (SELECT rep, id, sum(t) AS ts FROM (SELECT rep, id1 AS id, t FROM tv UNION ALL SELECT rep, id2, t FROM tv) GROUP BY ALL), td AS (SELECT *, count(*) OVER (PARTITION BY rep) AS d, sum(ts) OVER (PARTITION BY rep) AS tot FROM ti), bs AS (SELECT rep, id, greatest((ts - tot / (2 * (d - 1))) / (d - 2), 1e-4) AS w FROM td WHERE d > 2),
 rh AS (SELECT tv.rep, id1, id2, greatest(-1, least(1, (a.w + b.w - t) / (2 * sqrt(a.w * b.w)))) AS rho FROM tv JOIN bs a ON a.rep = tv.rep AND a.id = id1 JOIN bs b ON b.rep = tv.rep AND b.id = id2)
 SELECT o.id1 AS a, o.id2 AS b, round(o.rho, 6) AS weight, round((1 + count(*) FILTER (WHERE round(abs(x.rho), 9) >= round(abs(o.rho), 9))) / 100.0::DOUBLE, 6) AS p FROM rh o JOIN rh x ON x.id1 = o.id1 AND x.id2 = o.id2 AND x.rep > 0 WHERE o.rep = 0 GROUP BY o.id1, o.id2, o.rho""")
def net4_composition_correlations(spark, d):
    """Correlations of compositions with permutation p, over the features that every sample has."""
    c = counts(spark, d, "type").where("count > 0")
    samples = c.agg(F.countDistinct("sample").alias("whole"))
    held = c.groupBy("feature").agg(F.countDistinct("sample").alias("m")).join(samples, F.col("m") == F.col("whole")).select("feature")
    logs = cut(c.join(held, "feature").select(F.col("sample").alias("unit"), F.col("feature").alias("id"), F.log("count").alias("value")))
    return _rounded(network.composition_edges(logs, 99))


@query("""WITH s AS (SELECT p_brand, avg(p_retailprice) AS m, stddev_samp(p_retailprice) AS s, quantile_cont(p_retailprice, 0.25) AS q1, quantile_cont(p_retailprice, 0.5) AS q2, quantile_cont(p_retailprice, 0.75) AS q3 FROM part GROUP BY 1), a AS (SELECT p_brand, median(abs(p_retailprice - q2)) AS d FROM part JOIN s USING (p_brand) GROUP BY 1)
SELECT p_partkey, (abs(p_retailprice - m) > 1.513 * s)::INTEGER + (p_retailprice < q1 - 0.317 * (q3 - q1) OR p_retailprice > q3 + 0.317 * (q3 - q1))::INTEGER + (0.6745 * abs(p_retailprice - q2) > 1.237 * d)::INTEGER AS votes FROM part JOIN s USING (p_brand) JOIN a USING (p_brand)""")
def out1_outlier_votes(spark, d):
    rows = load(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    return ordination.outlier_votes(rows, "p_brand", ["p_retailprice"], 1.513, 0.317, 1.237).select("p_partkey", "votes")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_windowed_totals(spark, d):
    """An extension: the same function takes a stream of events."""
    return windowed_totals(load(spark, d, "events")).withColumn("total", F.round("total", 4))


#: Of two columns and two made of them: a column is aliased where its multiple R-squared on the ones before it is one.
_R2 = "({0} * {0} + {1} * {1} - 2 * {0} * {1} * own) / (1 - own * own) > 1 - 1e-9"


@query(f"""WITH p AS (SELECT p_size AS x, p_retailprice AS y, p_size + p_retailprice AS total, 2 * p_size + 3 AS twice FROM part), r AS (SELECT corr(x, y) AS own, corr(total, x) AS a, corr(total, y) AS b, corr(twice, x) AS c, corr(twice, y) AS e FROM p)
 SELECT 'p_retailprice' AS aliased FROM r WHERE own * own > 1 - 1e-9 UNION ALL SELECT 'total' FROM r WHERE {_R2.format('a', 'b')} UNION ALL SELECT 'twice' FROM r WHERE {_R2.format('c', 'e')}""")
def sta12_aliased_columns(spark, d):
    p = load(spark, d, "part").select("p_size", "p_retailprice", (F.col("p_size") + F.col("p_retailprice")).alias("total"), (2 * F.col("p_size") + 3).alias("twice"))
    return spark.createDataFrame([(c,) for c in stats.aliased_columns(p, p.columns)], "aliased string")


_EFFECTS = f"""WITH {counts_sql('brand')}, {PATIENTS_SQL}, s0 AS (SELECT patient, feature, sum(count) AS count FROM c GROUP BY ALL), {bray_sql('s0', 'patient', 'count')}, pl AS (SELECT 0 AS rep, patient, "case" AS grp FROM pt), {r2_sql('bc', 'patient', 'grp')},
 sh AS (SELECT patient, ln(sum(count)::DOUBLE) - sum(count * ln(count)) / sum(count) AS v FROM s0 GROUP BY 1), mo AS (SELECT count(*) FILTER (WHERE "case" = 'Cancer') AS n1, count(*) FILTER (WHERE "case" <> 'Cancer') AS n2, avg(v) FILTER (WHERE "case" = 'Cancer') - avg(v) FILTER (WHERE "case" <> 'Cancer') AS d, var_samp(v) FILTER (WHERE "case" = 'Cancer') AS v1, var_samp(v) FILTER (WHERE "case" <> 'Cancer') AS v2 FROM sh JOIN pt USING (patient))"""


@query(f"{_EFFECTS} SELECT 'permanova_r2' AS metric, round(r2, 6) AS value FROM r2 UNION ALL SELECT 'shannon_d', round(d / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 4) FROM mo")
def pwr9_effect_sizes(spark, d):
    """Effect sizes of case against control: community R-squared and Cohen's d of diversity, each under its own name."""
    from ..operators import permute
    from ..operators.diversity import shannon

    s = counts(spark, d, "brand").groupBy("patient", "feature").agg(F.sum("count").alias("count"))
    units = patients(spark, d).select("patient", F.col("case").alias("grp"))
    r2 = permute.r_squared(distance.bray_curtis(s, "patient"), units.select(F.lit(0).alias("rep"), "patient", "grp"), "patient", "grp").select(F.lit("permanova_r2").alias("metric"), F.round("r2", 6).alias("value"))
    moments = stats.two_sample_moments(shannon(s, ["patient"]).join(units, "patient").withColumn("all", F.lit(1)), ["all"], "grp", "Cancer", "shannon")
    return r2.union(moments.select(F.lit("shannon_d"), F.round("cohens_d", 4)))
