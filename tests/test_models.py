"""Ordination, network inference, isolation trees, denoising, classification and batch correction against numpy and brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quadrat.operators import denoise, forest, inference, network, ordination, stats
from quadrat.sources import results


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


# --- ordination ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [2, 3, 40])
def test_pcoa_equals_numpy(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 4)) * [4, 2, 1, 1]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) + rng.uniform(0, 0.2, (n, n))
    d = np.triu(d, 1) + np.triu(d, 1).T
    i, j = np.triu_indices(n, 1)
    got = ordination.pcoa(frame(spark, id1=i, id2=j, dist=d[i, j])).toPandas()
    g = -0.5 * d * d
    g = g - g.mean(0) - g.mean(1)[:, None] + g.mean()
    values, vectors = np.linalg.eigh(g)
    top = np.argsort(values)[::-1][: got["axis"].max()]
    want = vectors[:, top] * np.sqrt(np.maximum(values[top], 0))
    want = want * np.where((want**3).sum(0) < -1e-12, -1, 1)
    wide = got.pivot(index="id", columns="axis", values="value").to_numpy()
    assert np.abs(np.abs(wide) - np.abs(want)).max() < 1e-6
    if n > 3:
        assert np.abs(wide - want).max() < 1e-6
    assert np.allclose(got.drop_duplicates("axis").sort_values("axis")["explained"], np.maximum(values[top], 0) / np.trace(g))


def test_pcoa_of_no_pairs_and_of_equal_samples(spark):
    none = spark.createDataFrame([], "id1 string, id2 string, dist double")
    assert ordination.pcoa(none).count() == 0
    same = spark.createDataFrame([("a", "b", 0.0), ("a", "c", 0.0), ("b", "c", 0.0)], "id1 string, id2 string, dist double")
    assert {r["value"] for r in ordination.pcoa(same).collect()} <= {0.0}


def test_constrained_axes_equal_the_decomposition_of_the_fitted_table(spark):
    rng = np.random.default_rng(1)
    n, m, q = 30, 12, 3
    y = rng.poisson(2.0, (n, m)) * rng.uniform(0.5, 1, (n, m))
    y[:, 0] += 0.1
    x = rng.normal(size=(n, q))
    y[:, :4] *= np.exp(x[:, :1])
    p = y / y.sum()
    r, c = p.sum(1), p.sum(0)
    qbar = (p - np.outer(r, c)) / np.sqrt(np.outer(r, c))
    xw = np.sqrt(r)[:, None] * (x - r @ x)
    u, s, vt = np.linalg.svd(xw @ np.linalg.pinv(xw) @ qbar, full_matrices=False)
    i, j = np.nonzero(y)
    table = frame(spark, unit=i, feature=j, value=y[i, j])
    env = frame(spark, unit=np.arange(n), a=x[:, 0], b=x[:, 1], c=x[:, 2])
    found = ordination.constrained_axes(table, env, "unit")
    assert np.allclose(found["values"], s[:q] ** 2)
    lc = found["sites"].toPandas().pivot(index="unit", columns="axis", values="lc").to_numpy()
    wa = found["sites"].toPandas().pivot(index="unit", columns="axis", values="wa").to_numpy()
    scores = found["features"].toPandas().pivot(index="feature", columns="axis", values="score").to_numpy()
    assert np.allclose(np.abs(lc), np.abs(u[:, :q] / np.sqrt(r)[:, None]))
    assert np.allclose(np.abs(scores), np.abs(vt[:q].T / np.sqrt(c)[:, None] * s[:q]))
    assert np.allclose(np.abs(wa), np.abs((qbar @ vt[:q].T) / np.sqrt(r)[:, None] / s[:q]))
    sites = frame(spark, unit=np.arange(n), weight=r, a1=wa[:, 0], a2=wa[:, 1])
    fit = ordination.fitted_vectors(sites, env.unpivot("unit", ["a", "b"], "variable", "value"), "unit", 19).toPandas().set_index("variable")
    w = np.sqrt(r)[:, None]
    z = np.column_stack([np.ones(n), wa[:, :2]])
    for k, name in enumerate("ab"):
        beta = np.linalg.lstsq(w * z, w[:, 0] * x[:, k], rcond=None)[0]
        left = (r * (x[:, k] - z @ beta) ** 2).sum() / (r * (x[:, k] - r @ x[:, k]) ** 2).sum()
        assert math.isclose(fit.loc[name, "r2"], 1 - left, rel_tol=1e-9)
        assert np.allclose(fit.loc[name, ["axis1", "axis2"]].to_numpy(float), beta[1:] / np.linalg.norm(beta[1:]))
    assert fit.loc["a", "p"] == 0.05


# --- network inference -------------------------------------------------------------------------------------------


def test_lassos_meet_their_conditions():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 9))
    x[:, 3] += x[:, 1]
    r = np.corrcoef(x.T)
    for penalty, b in zip((0.4, 0.1, 0.01), inference.lassos(r, np.arange(9), [0.4, 0.1, 0.01]), strict=True):
        slope = r - r @ b
        for k in range(9):
            others, kept = np.arange(9) != k, b[:, k] != 0
            assert b[k, k] == 0 and np.abs(slope[others, k]).max() <= penalty + 1e-6
            assert np.allclose(slope[kept, k], penalty * np.sign(b[kept, k]), atol=1e-6)


def test_neighbourhoods_find_planted_edges(spark):
    rng = np.random.default_rng(0)
    n, p = 200, 8
    x = rng.normal(size=(n, p))
    for k in range(1, p, 2):
        x[:, k] += 1.2 * x[:, k - 1]
    i, j = np.indices(x.shape)
    edges, penalties = inference.neighbourhoods(frame(spark, unit=i.ravel(), id=j.ravel(), value=x.ravel()), penalties=8, ratio=0.1, reps=6)
    assert {(r["a"], r["b"]) for r in edges.collect()} == {(k - 1, k) for k in range(1, p, 2)}
    assert penalties.where("chosen").count() == 1
    with pytest.raises(ValueError, match="more than 3 features"):
        inference.neighbourhoods(frame(spark, unit=i.ravel(), id=j.ravel(), value=x.ravel()), most=3)


def test_cross_products_in_chunks_are_those_of_all_units(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 4))
    i, j = np.indices(x.shape)
    monkeypatch.setattr(inference, "CHUNK", 16)
    chosen = inference.subsets(frame(spark, unit=np.arange(50)), "unit", 1, 30)
    parts = inference.cross_products(frame(spark, unit=i.ravel(), id=j.ravel(), value=x.ravel()), chosen, [0, 1, 2, 3]).toPandas()
    drawn = [r["unit"] for r in chosen.where("rep = 1").collect()]
    assert parts[parts["rep"] == 0]["chunk"].nunique() == 4 and len(drawn) == 30
    assert np.allclose(inference.correlations(parts[parts["rep"] == 0]), np.corrcoef(x.T))
    assert np.allclose(inference.correlations(parts[parts["rep"] == 1]), np.corrcoef(x[drawn].T))


# --- isolation forest --------------------------------------------------------------------------------------------


def plain_depth(row, nodes):
    table, node = {n[0]: n for n in nodes}, 1
    while table[node][1] >= 0:
        _, f, at, _ = table[node]
        node = 2 * node + (row[f] >= at)
    return table[node][3]


def test_isolation_scores_equal_plain_trees(spark):
    import hashlib

    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(60, 2)), [[8, 8]], [[-9, 7]], [[0, 0]], [[0, 0]]])
    rows = frame(spark, id=np.arange(len(x)), g=["u" if k % 3 else "v" for k in range(len(x))], a=x[:, 0], b=x[:, 1])
    rows = rows.unionByName(spark.createDataFrame([(900, "lone", 1.0, 1.0), (901, "u", None, 1.0)], "id bigint, g string, a double, b double"))
    got = {(r["id"], r["group"]): r["score"] for r in forest.isolation_scores(rows, ["a", "b"], "id", "g", trees=7, sample=16).collect()}
    for group in "uv":
        own = [k for k in range(len(x)) if ("u" if k % 3 else "v") == group]
        total = np.zeros(len(own))
        for tree in range(7):
            drawn = sorted(own, key=lambda k: (hashlib.md5(f"1|{tree}|{k}".encode()).hexdigest(), k))[:16]
            nodes = forest.grow(x[drawn], f"1|{tree}", 4)
            total += [plain_depth(x[k], nodes) for k in own]
        want = 2.0 ** (-total / 7 / forest.usual_depth(16))
        assert np.allclose([got[k, group] for k in own], want)
    assert got[900, "lone"] == 0.5 and (901, "u") not in got
    pooled = forest.isolation_scores(rows.where("id < 900"), ["a", "b"], "id", trees=40, sample=32, contamination=0.04).where("is_outlier")
    assert {r["id"] for r in pooled.collect()} >= {60, 61}
    assert forest.isolation_scores(rows.limit(0), ["a", "b"], "id").count() == 0


def test_draws_of_trees_are_dealt_by_rows(spark, monkeypatch):
    """Rows of one file and one group are hashed in as many tasks as their number asks for."""
    monkeypatch.setattr(forest, "DRAWN", 50)
    rows = frame(spark, id=np.arange(500), g=["u"] * 500, a=np.arange(500.0), b=np.arange(500.0) % 7).coalesce(1)
    plan = forest.forest(rows, ["a", "b"], "g", "id", trees=3, sample=16)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition 10, true" in plan


# --- sequences ---------------------------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    seqs = ["".join(rng.choice(list("ACGT"), rng.integers(1, 14))) for _ in range(90)] + ["", "A", "ACGTACGTACGT", "CGTACGTACGT", "ACGTACGTACG"]
    seqs = list(dict.fromkeys(seqs))
    df = frame(spark, id=np.arange(len(seqs)), seq=seqs, size=1)
    for most in (0, 1, 3):
        got = {(r["a"], r["b"], r["d"]) for r in denoise.near_pairs(df, df, most).collect()}
        assert got == {(i, j, d) for i, a in enumerate(seqs) for j, b in enumerate(seqs) if (d := edits(a, b)) <= most}


def test_denoised_equals_greedy_search(spark):
    rng = np.random.default_rng(6)
    true = ["".join(rng.choice(list("ACGT"), 20)) for _ in range(4)]
    reads = []
    for k, s in enumerate(true):
        reads += [s] * (600 >> k)
        for _ in range(80 >> k):
            p = rng.integers(20)
            reads.append(s[:p] + rng.choice(list("ACGT")) + s[p + 1 :] if rng.random() < 0.5 else s[:p] + s[p + 1 :])
    size = pd.Series(reads).value_counts()
    order = sorted(size.index, key=lambda s: (-size[s], s))
    centroids, want = [], {}
    for s in order:
        near = [(edits(s, c), -size[c], c) for c in centroids]
        near = [x for x in near if size[s] * 2 ** (2 * x[0] + 1) <= -x[1]]
        want[s] = (min(near)[2], min(near)[0]) if near else (s, 0)
        if not near:
            centroids.append(s)
    got = {r["seq"]: (r["centroid"], r["d"]) for r in denoise.denoised(frame(spark, seq=[*reads, None]), 1).collect()}
    assert got == want and set(true) <= {c for c, _ in got.values()}
    assert denoise.denoised(spark.createDataFrame([], "seq string")).count() == 0


def test_assigned_equals_best_of_all(spark):
    rng = np.random.default_rng(7)
    centroids = {f"c{k}": "".join(rng.choice(list("ACGT"), 30)) for k in range(5)} | {"twin": "A" * 30, "twin2": "A" * 30}
    reads = []
    for s in list(centroids.values()):
        for e in range(4):
            t = list(s)
            for p in rng.choice(30, e, replace=False):
                t[p] = "G"
            reads.append((f"s{e % 2}", "".join(t)))
    want = {}
    for sample, s in reads:
        share = {c: 1 - edits(s, t) / max(len(s), len(t)) for c, t in centroids.items()}
        best = min(share, key=lambda c: (-share[c], c))
        if share[best] >= 0.93 - 1e-12:
            want[sample, best] = want.get((sample, best), 0) + 1
    got = denoise.assigned(spark.createDataFrame(reads, "sample string, seq string"), spark.createDataFrame(list(centroids.items()), "centroid string, seq string"), 0.93)
    assert {(r["sample"], r["centroid"]): r["count"] for r in got.collect()} == want


def test_classifier_equals_plain_bayes(spark):
    reference = [("x", "ACGTACGTAC"), ("x", "ACGTTTTT"), ("y", "GGGGCCCCGG"), ("z", "ATATATATAT"), (None, "CCCCCCCC")]
    reads = [("r1", "ACGTACG"), ("r2", "GGGCCC"), ("r3", "NNNNNN"), ("r4", "AC"), ("r5", "ATATACGT"), ("r6", None)]
    counts = {}
    for t, s in reference:
        if t:
            for i in range(len(s) - 2):
                counts.setdefault(t, {}).setdefault(s[i : i + 3], 0)
                counts[t][s[i : i + 3]] += 1
    words = len({w for c in counts.values() for w in c})
    gains, taxa = denoise.bayes_model(spark.createDataFrame(reference, "taxon string, seq string"), 3)
    got = {r["id"]: (r["taxon"], r["confidence"]) for r in denoise.bayes_classified(spark.createDataFrame(reads, "id string, seq string"), gains, taxa, 3).collect()}
    for name, s in reads:
        if not s or len(s) < 3:
            assert got[name] == ("Unassigned", 0.0)
            continue
        score = {t: sum(math.log((c.get(s[i : i + 3], 0) + 0.001) / (sum(c.values()) + 0.001 * words)) for i in range(len(s) - 2)) for t, c in counts.items()}
        best = max(score, key=lambda t: (score[t], t))
        share = 1 / sum(math.exp(v - score[best]) for v in score.values())
        assert got[name][0] == (best if share >= 0.7 else "Unassigned") and math.isclose(got[name][1], share, rel_tol=1e-6)


# --- batches, graphs, kept results -------------------------------------------------------------------------------


def test_combat_equals_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(5, 1, (12, 6)) * rng.uniform(0.5, 2, 6)
    batch = np.repeat([0, 1, 2], 4)
    x[batch == 1] = x[batch == 1] * 1.7 + 3
    x[:, 5] = 2.0
    mean = x.mean(0)
    z, pool = np.zeros_like(x), sum(((x[batch == b] - x[batch == b].mean(0)) ** 2).sum(0) for b in range(3)) / 12
    ok = pool > 0
    z[:, ok] = (x[:, ok] - mean[ok]) / np.sqrt(pool[ok])
    want = x.copy()
    for b in range(3):
        s = z[batch == b][:, ok]
        g_hat, d_hat, n = s.mean(0), s.var(0, ddof=1), len(s)
        bar, t2, m, v = g_hat.mean(), g_hat.var(ddof=1), d_hat.mean(), d_hat.var(ddof=1)
        a, c = (2 * v + m * m) / v, (m * v + m**3) / v
        for k in range(ok.sum()):
            g, d = g_hat[k], d_hat[k]
            for _ in range(100):
                g2 = (t2 * n * g_hat[k] + d * bar) / (t2 * n + d)
                d2 = (0.5 * ((s[:, k] - g2) ** 2).sum() + c) / (n / 2 + a - 1)
                done = abs(g2 - g) <= 1e-4 * abs(g) and abs(d2 - d) <= 1e-4 * abs(d)
                g, d = g2, d2
                if done:
                    break
            col = np.flatnonzero(ok)[k]
            want[batch == b, col] = (s[:, k] - g) / np.sqrt(d) * np.sqrt(pool[col]) + mean[col]
    i, j = np.indices(x.shape)
    got = stats.combat(frame(spark, unit=i.ravel(), f=j.ravel(), k=batch[i.ravel()], value=x.ravel()), "k", "f", "value").toPandas()
    assert np.allclose(got.pivot(index="unit", columns="f", values="adjusted").to_numpy(), want)


def test_clustering_of_graphs_and_co_occurrence(spark):
    g = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 1, 3), (1, 3, 4), (2, 1, 2), (2, 5, 6)], "rep int, a int, b int")
    found = {(r["rep"], r["metric"]): r["value"] for r in network.null_metrics(g).collect()}
    assert math.isclose(found[1, "average_clustering"], (1 + 1 + 1 / 3 + 0) / 4) and math.isclose(found[1, "transitivity"], 3 / 5) and found[2, "average_clustering"] == 0
    pair = network.co_occurrence(g.withColumnRenamed("rep", "graph")).first()
    assert (pair["graph1"], pair["graph2"], pair["shared"], round(pair["share"], 6)) == (1, 2, 2, round(2 / 6, 6))


def test_results_are_kept_by_inputs_and_parameters(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(3).write.parquet(source)
    runs = []

    def work():
        runs.append(1)
        return spark.read.parquet(source).select((F.col("id") * 2).alias("x"))

    folder = str(tmp_path / "kept")
    for _ in range(2):
        assert sorted(r["x"] for r in results.cached([source], {"k": 1}, folder, work).collect()) == [0, 2, 4]
    assert len(runs) == 1
    results.cached([source], {"k": 2}, folder, work)
    spark.range(5).write.mode("overwrite").parquet(source)
    assert results.cached([source], {"k": 1}, folder, work).count() == 5 and len(runs) == 3


def test_gml_headers_and_read_statistics(spark, tmp_path):
    nodes = spark.createDataFrame([("a", 1.5), ('b"&', None)], "id string, size double")
    edges = spark.createDataFrame([("a", 'b"&', "x")], "a string, b string, kind string")
    results.write_gml(nodes, edges, str(tmp_path / "gml"))
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "gml")).collect())
    assert text.count("node [") == 2 and text.count("edge [") == 1 and 'label "a" size 1.5' in text and "&quot;&amp;" in text and ' kind "x" ]' in text
    for mode in ("first", "all", "none"):
        headers = []
        for _ in range(2):
            results.append_table(nodes, str(tmp_path / mode), mode)
            headers.append(spark.read.text(str(tmp_path / mode)).where("value like 'id\t%'").count())
        assert {"first": headers[0] == headers[1] > 0, "all": headers[1] == 2 * headers[0] > 0, "none": headers == [0, 0]}[mode]
    (tmp_path / "stats.tsv").write_text("file\treads\ns1_R1.fq\t1,200\ns1_R2.fq\t300\ns2_R1.fq\tx\n")
    got = {r["sample"]: r["reads"] for r in results.read_stats(spark, str(tmp_path / "stats.tsv"), "file", "reads", r"_R[12]\.fq$").collect()}
    assert got == {"s1": 1500, "s2": 0}


# --- density -----------------------------------------------------------------------------------------------------


def plain_clusters(x, k, smallest):
    """All distances, Prim's tree, and clusters as sets of rows split at their longest edge, by recursion."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, k - 1]
    m = np.maximum(d, np.maximum(core[:, None], core))
    inside, edges = {0}, []
    while len(inside) < len(x):
        w, a, b = min((m[i, j], i, j) for i in inside for j in range(len(x)) if j not in inside)
        inside.add(b)
        edges.append((w, a, b))

    def reach(start, own):
        seen, open_ = {start}, [start]
        while open_:
            p = open_.pop()
            for _, a, b in own:
                for u, v in ((a, b), (b, a)):
                    if u == p and v not in seen:
                        seen.add(v)
                        open_.append(v)
        return seen

    def outer(rows, own, birth, whole=False):
        mass, now, left_edges = 0.0, set(rows), list(own)
        while left_edges:
            w, a, b = max(left_edges)
            left_edges.remove((w, a, b))
            left = reach(a, left_edges) & now
            right = now - left
            if len(left) >= smallest and len(right) >= smallest:
                mass += len(now) * (1 / w - birth)
                parts = [outer(s, [e for e in left_edges if e[1] in s], 1 / w) for s in (left, right)]
                below = sum(p[0] for p in parts)
                return (below, parts[0][1] + parts[1][1]) if whole or below > mass else (mass, [set(rows)])
            gone = right if len(left) >= smallest else left if len(right) >= smallest else now
            mass += len(gone) * (1 / w - birth)
            now = now - gone
            left_edges = [e for e in left_edges if e[1] in now and e[2] in now]
        return mass, [] if whole else [set(rows)]

    return outer(set(range(len(x))), edges, 0.0, True)[1]


def test_density_clusters_equal_brute_force(spark, monkeypatch):
    from quadrat.operators import density

    monkeypatch.setattr(density, "BLOCK", 40)
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(c, s, (30, 2)) for c, s in (((0, 0), 0.3), ((3, 0), 0.5), ((3, 2.2), 0.2))] + [rng.uniform(-3, 6, (15, 2))])
    rows = frame(spark, id=np.arange(len(x)), x=x[:, 0], y=x[:, 1])
    got = {r["id"]: r["cluster"] for r in density.density_clusters(rows, ["x", "y"], "id", 6).collect()}
    want = {k: -1 for k in range(len(x))} | {k: min(c) for c in plain_clusters(x, 6, 6) for k in c}
    first = {}
    for k in sorted(got):
        if got[k] >= 0:
            first.setdefault(got[k], k)
    assert {k: first.get(c, -1) for k, c in got.items()} == want and len(first) >= 3
    assert density.density_clusters(rows.limit(0), ["x", "y"], "id").count() == 0
    assert [r["cluster"] for r in density.density_clusters(rows.limit(1), ["x", "y"], "id").collect()] == [-1]


def test_density_clusters_of_one_block(spark):
    """No rows go to another block; ids are strings."""
    from quadrat.operators import density

    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 0.2, (12, 2)) for c in (0, 3)] + [[[9.0, 9.0]]])
    names = [f"s{k:02}" for k in range(len(x))]
    got = {r["id"]: r["cluster"] for r in density.density_clusters(frame(spark, id=names, x=x[:, 0], y=x[:, 1]), ["x", "y"], "id", 5).collect()}
    assert [got[k] for k in names] == [0] * 12 + [1] * 12 + [-1]


def test_equal_rows_make_the_same_tree_from_one_of_them(spark, monkeypatch):
    from quadrat.operators import density

    rng = np.random.default_rng(8)
    x = np.repeat(np.round(rng.normal(size=(25, 2)), 1), [1, 2, 3, 4, 30] * 5, axis=0)
    rows = frame(spark, id=rng.permutation(len(x)), x=x[:, 0], y=x[:, 1])
    whole = density.spanning_tree(rows.join(density.core_distances(rows, ["x", "y"], 4), "id"), ["x", "y"])
    plain, seen = density.spanning_tree, []
    monkeypatch.setattr(density, "spanning_tree", lambda points, columns: seen.append(points.count()) or plain(points, columns))
    got = density.reachability_tree(rows, ["x", "y"], 4)
    edge = lambda df: sorted((r["a"], r["b"], round(r["w"], 12)) for r in df.collect())
    assert edge(got) == edge(whole) and len(edge(got)) == len(x) - 1 and seen[0] <= 5 * (1 + 2 + 3 + 1 + 1)
    same = frame(spark, id=np.arange(9), x=np.ones(9))
    assert edge(density.reachability_tree(same, ["x"], 4)) == [(0, k, 0.0) for k in range(1, 9)]


def test_trees_are_condensed_to_a_row_for_each_core(spark):
    """What one task gets are edges between cores, however many rows there are; rows' edges and cores are those of plain unions."""
    from quadrat.operators import density

    rng = np.random.default_rng(6)
    n, smallest = 150, 4
    before = [k - 1 if k < 60 else int(rng.integers(0, k)) for k in range(1, n)]
    w = np.concatenate([np.arange(59, 0, -1.0), rng.choice([0.0, 0.5, 1.0, 30.0], 31), rng.uniform(0, 60, n - 91)])
    edges = sorted((float(x), min(a, b), max(a, b)) for x, a, b in zip(w, range(1, n), before, strict=True))
    part, at = {k: {k} for k in range(n)}, {}
    for e in edges:
        joined = part[e[1]] | part[e[2]]
        for k in joined:
            part[k] = joined
            if len(joined) >= smallest:
                at.setdefault(k, e)
    tree = frame(spark, a=[e[1] for e in edges], b=[e[2] for e in edges], w=[e[0] for e in edges])
    found = density.fallen_rows(tree, smallest).collect()
    assert {r["id"]: tuple(r["at"]) for r in found} == at
    core = {r["id"]: r["core"] for r in found}
    assert len(set(core.values())) <= n / smallest
    big, splits = {k: {k} for k in range(n)}, set()
    for e in edges:
        a, b = big[e[1]], big[e[2]]
        if min(len(a), len(b)) >= smallest:
            splits.add(e)
        for k in a | b:
            big[k] = a | b
    assert splits == {e for e in edges if core[e[1]] != core[e[2]]} and len(splits) == len(set(core.values())) - 1 > 3


# --- compositions ------------------------------------------------------------------------------------------------


def plain_sparcc(logs, rounds, threshold):
    """The whole system solved anew in every round."""
    d = logs.shape[1]
    t = np.var(logs[:, :, None] - logs[:, None, :], axis=0, ddof=1)
    out = np.zeros((d, d), bool)
    for turn in range(rounds + 1):
        keep = ~out & ~np.eye(d, dtype=bool)
        m = np.diag(keep.sum(1)).astype(float) + keep
        w = np.maximum(np.linalg.solve(m, (t * keep).sum(1)), 1e-4)
        rho = np.clip((w[:, None] + w - t) / (2 * np.sqrt(np.outer(w, w))), -1, 1)
        if turn == rounds:
            return rho
        best = [(-round(abs(rho[i, j]), 9), i, j) for i in range(d) for j in range(i + 1, d) if keep[i, j] and round(abs(rho[i, j]), 9) > threshold and min(keep[i].sum(), keep[j].sum()) > 3]
        if best:
            _, i, j = min(best)
            out[i, j] = out[j, i] = True


def test_excluding_correlations_equal_the_whole_system(spark):
    from quadrat.operators import compositions

    rng = np.random.default_rng(12)
    groups, rows = {}, []
    for g in ("p", "q"):
        basis = rng.normal(0, 1, (60, 8))
        basis[:, 1] = basis[:, 0] + rng.normal(0, 0.2, 60)
        basis[:, 2] = basis[:, 0] + rng.normal(0, 0.3, 60)
        x = np.exp(basis)
        groups[g] = np.log(x / x.sum(1, keepdims=True))
        rows += [(g, u, k, float(groups[g][u, k])) for u in range(60) for k in range(8)]
    rows += [("r", 0, k, 0.0) for k in range(8)]
    df = spark.createDataFrame(rows, "g string, unit int, id int, value double")
    for rounds in (0, 3):
        got = {(r["g"], r["id1"], r["id2"]): r["rho"] for r in compositions.excluding_correlations(df, ["g"], 0, rounds).collect()}
        assert {g for g, _, _ in got} == {"p", "q"}
        for g, logs in groups.items():
            want = plain_sparcc(logs, rounds, 0.1)
            assert all(math.isclose(got[g, i, j], want[i, j], abs_tol=1e-9) for i in range(8) for j in range(i + 1, 8))
    found = compositions.excluding_correlations(df.where("g = 'p'"), ["g"], 19, 3)
    edges = compositions.strong_edges(found, ["g"], 19, 0.06)
    assert {(0, 1), (0, 2)} <= {(r["a"], r["b"]) for r in edges.collect()}


def test_density_rows_go_to_near_blocks_only(spark, monkeypatch):
    """A core distance needs the blocks beside a row's own, not all 36."""
    from quadrat.operators import density

    monkeypatch.setattr(density, "BLOCK", 20)
    sent = []
    plain = density._sent
    monkeypatch.setattr(density, "_sent", lambda *a, **k: sent.append(plain(*a, **k)) or sent[-1])
    x = np.random.default_rng(3).uniform(size=(720, 2))
    found = density.core_distances(frame(spark, id=np.arange(720), x=x[:, 0], y=x[:, 1]), ["x", "y"], 3)
    got = {r["id"]: r["core"] for r in found.collect()}
    want = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), axis=1)[:, 2]
    assert np.allclose([got[k] for k in range(720)], want) and sent[0].count() < 9 * 720


def test_kmers_are_cut_in_one_pass(spark):
    """No row for each place with the whole sequence beside it; letters beyond the basic plane and line feeds count as one."""
    from quadrat.operators import denoise

    texts = ["abcabcab", "a\n\U0001f600b\r\U0001f600cd", "abc", "", None, "é" * 9]
    found = denoise.kmers(frame(spark, id=list(range(6)), seq=texts), 4, "id")
    want = {}
    for i, t in enumerate(texts):
        for k in range(len(t or "") - 3):
            want[i, t[k : k + 4]] = want.get((i, t[k : k + 4]), 0) + 1
    assert {(r["id"], r["kmer"]): r["n"] for r in found.collect()} == want
    assert "sequence(" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("most", [0, 1000])
def test_accumulation_takes_orders_in_blocks(spark, monkeypatch, most):
    """A row for each cell and block of orders, by broadcast and without; 17 orders in blocks of 7."""
    from hashlib import md5

    from quadrat.operators import diversity

    monkeypatch.setattr(diversity, "ORDERS", 7)
    monkeypatch.setattr(diversity, "PLACES", most)
    cells = [(g, f"{g}{s}", f) for g in "xy" for s in range(5) for f in range(9) if (s * 7 + f * 5 + (g == "x")) % 3 == 0]
    g, s, f = zip(*cells, strict=True)
    found = diversity.accumulation(frame(spark, grp=list(g), sample=list(s), feature=list(f)), "grp", 17).collect()
    got = {(r["grp"], r["k"]): r["mean"] for r in found}
    want = {}
    for name in "xy":
        for rep in range(1, 18):
            order = sorted({b for a, b, _ in cells if a == name}, key=lambda b: md5(f"1|{rep}|{b}".encode()).hexdigest())
            for k in range(1, len(order) + 1):
                want[name, k] = want.get((name, k), 0) + len({c for a, b, c in cells if b in order[:k]}) / 17
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
