"""Graph measures, representatives, indicator power and result sinks against plain Python on small fixtures."""

import collections
import itertools
import json

import pytest
from pyspark.sql import functions as F

from quadrat.operators import aggregate, isa, network, power, sequences, stats
from quadrat.sources import readers, results

# Two triangles joined by a path, a separate pair, and a loop.
EDGES = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (5, 6), (6, 7), (5, 7), (10, 11), (4, 4)]


@pytest.fixture(scope="module")
def edges(spark):
    return network.tidy_edges(spark.createDataFrame([(a, b, 1.0) for a, b in EDGES], "a bigint, b bigint, weight double")).cache()


def brute_paths():
    near = collections.defaultdict(set)
    for a, b in EDGES:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    found = {}
    for s in near:
        dist, ways, front = {s: 0}, {s: 1}, [s]
        while front:
            step = collections.Counter()
            for u in front:
                for v in near[u]:
                    if v not in dist:
                        step[v] += ways[u]
            for v, n in step.items():
                dist[v], ways[v] = dist[front[0]] + 1, n
            front = list(step)
        found[s] = (dist, ways)
    return found


def test_centralities_match_brute_force(edges):
    paths = brute_paths()
    want = {}
    for v in paths:
        between = sum(
            paths[s][1][v] * paths[v][1][t] / paths[s][1][t]
            for s, t in itertools.combinations(paths, 2)
            if v not in (s, t) and t in paths[s][0] and v in paths[s][0] and paths[s][0][v] + paths[v][0][t] == paths[s][0][t]
        )
        dist = paths[v][0]
        want[v] = (len(dist), round((len(dist) - 1) / sum(dist.values()), 9), round(between, 9))
    got = {r["node"]: (r["reached"], round(r["closeness"], 9), round(r["betweenness"], 9)) for r in network.centralities(edges).collect()}
    assert got == want
    whole = network.path_summary(edges).first()
    hops = [d for s in range(1, 8) for t, d in paths[s][0].items() if t != s]
    assert (whole["nodes"], whole["diameter"]) == (7, max(hops)) and abs(whole["mean_hops"] - sum(hops) / len(hops)) < 1e-9


def test_communities_find_the_triangles(edges):
    found = {r["node"]: r["community"] for r in network.communities(edges).collect()}
    assert found[1] == found[2] == found[3] == 1 and found[5] == found[6] == found[7] != 1 and found[10] == found[11] == 10


def test_null_graphs_stay_simple_and_keep_degrees(spark):
    ring = [(i, (i + k) % 40) for i in range(40) for k in (1, 2)]
    e = spark.createDataFrame([(a, b, 1.0) for a, b in ring], "a bigint, b bigint, weight double")
    rows = network.rewired(e, 2, 1).collect()
    for rep in (1, 2):
        own = [(r["a"], r["b"]) for r in rows if r["rep"] == rep]
        assert len(own) == len(set(own)) == 80 and all(a < b for a, b in own)
        assert set(collections.Counter(x for p in own for x in p).values()) == {4}
        assert set(own) != {tuple(sorted(p)) for p in ring}


def test_constant_sides_have_no_correlation(spark):
    ring = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0)], "a int, b int, weight double")
    assert network.assortativity(ring).first()[0] is None
    long = spark.createDataFrame([(u, c, float(v)) for c, vs in {"x": (1, 2, 3), "k": (5, 5, 5), "y": (2, 4, 6.5)}.items() for u, v in enumerate(vs)], "unit int, id string, value double")
    got = {(r["id1"], r["id2"]): r["r"] for r in stats.pearson_pairs(long).collect()}
    assert got["k", "x"] is None and got["k", "y"] is None and got["x", "y"] > 0.99
    kept = {r["id"]: r["representative"] for r in stats.representatives(stats.pearson_pairs(long), long.select("id")).collect()}
    assert kept == {"k": "k", "x": "x", "y": "x"}


def test_tails(spark):
    # Standard table values: chi-squared and Student's t at their 5 per cent points.
    df = spark.createDataFrame([(3.841459, 7.814728, 9.487729, 2.228139, 2.570582)], "a double, b double, c double, t10 double, t5 double")
    r = df.select(stats.chi2_tail(F.col("a"), 1), stats.chi2_tail(F.col("b"), 3), stats.chi2_tail(F.col("c"), 4), stats.student_tail2("t10", F.lit(10.0)), stats.student_tail2("t5", F.lit(5.0))).first()
    assert all(abs(x - 0.05) < 1e-6 for x in r)


def test_one_edit(spark):
    seqs = spark.createDataFrame(enumerate(["acgt", "acgt", "acga", "acg", "tttt", "", "t", "gcat"]), "id bigint, seq string")
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in sequences.one_edit_links(seqs).collect()}
    assert got == {0: (0, 2), 1: (0, 2), 2: (2, 2), 3: (3, 2), 4: (4, 0), 5: (5, 1), 6: (6, 1), 7: (7, 0)}
    assert {r["id"]: r["cluster"] for r in sequences.one_edit_clusters(seqs).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5, 7: 7}
    chunks = sequences.chunked(sequences.relabelled(seqs.withColumn("sample", F.lit("s"))), 3).collect()
    assert {r["id"]: r["chunk"] for r in chunks} == {f"s:{i}": i // 3 for i in range(8)}


def test_planted_indicator_has_power(spark):
    units = [(i, "a" if i < 8 else "b") for i in range(16)]
    profiles = spark.createDataFrame([(i, f, p) for i, g in units for f, p in (("planted", 0.6 if g == "a" else 0.0), ("other", 0.4))], "unit int, feature string, p double")
    draws = spark.createDataFrame([(r, s, g, (s + r) % 8 + (8 if g == "b" else 0)) for r in range(3) for s in range(8) for g in "ab"], "rep int, slot int, grp string, unit int")
    got = isa.indicator_power(draws, profiles, spark.createDataFrame([("planted",)], "feature string"), "unit", ["a", "b"], 99).first()
    assert (got["power"], got["sensitivity"], got["reps"]) == (1.0, 1.0, 3)
    strata = spark.createDataFrame([(i, g, s) for i, g in units for s in ("x",)], "unit int, grp string, stratum string")
    own = isa.indicator_values(profiles, strata.select(F.lit(0).alias("rep"), "unit", "grp"), "unit", "grp", ["a", "b"], True)
    both = isa.stratified_test(profiles, strata, "unit", "grp", "stratum", ["a", "b"], 19).join(own.select("feature", F.col("stat").alias("s")), "feature")
    assert both.where("stat = s").count() == 2


def test_hybrid_sizes(spark):
    got = spark.createDataFrame([(3,), (5,), (9,)], "n int").select(power.hybrid_control_size(F.col("n"), 5).alias("m")).collect()
    assert [r["m"] for r in got] == [5, 5, 9]


def test_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("c",)], "x string")
    got = sorted(((r["x"] or "", r["code"]) for r in aggregate.dense_codes(df, "x", "code", "S", 3, 1).collect()), key=str)
    assert got == [("", None), ("a", "S001"), ("b", "S002"), ("b", "S002"), ("c", "S003")]


def test_sinks_and_resumable_runs(spark, tmp_path, edges):
    nodes = spark.createDataFrame([("1", 'a<b & "c"', 0.5), ("2", None, 1.0)], "id string, label string, x double")
    results.write_graphml(nodes, spark.createDataFrame([("1", "2", 3.5)], "a string, b string, weight double"), f"{tmp_path}/g")
    back, links = readers.read_graphml(spark, f"{tmp_path}/g")
    assert {r["id"]: r["data"].get("label") for r in back.collect()} == {"1": 'a<b & "c"', "2": None}
    assert [(r["a"], r["b"], r["data"]["weight"]) for r in links.collect()] == [("1", "2", "3.5")]
    results.write_json(nodes, f"{tmp_path}/j")
    assert sorted(json.loads(r[0])["x"] for r in spark.read.text(f"{tmp_path}/j").collect()) == [0.5, 1.0]
    (tmp_path / "c.json").write_text('{"low": ["f1", "f2"],\n "n": 3}')
    assert results.read_json_config(spark, f"{tmp_path}/c.json") == {"low": ["f1", "f2"], "n": 3}
    ran = []

    def work(df):
        ran.append(sorted({r["chunk"] for r in df.select("chunk").distinct().collect()}))
        return df.withColumn("y", F.col("id") * 2)

    rows = spark.createDataFrame([(i, i % 3) for i in range(9)], "id bigint, chunk int")
    assert results.run_chunks(rows.where("chunk < 2"), "chunk", work, f"{tmp_path}/run").count() == 6
    assert sorted(r["y"] for r in results.run_chunks(rows, "chunk", work, f"{tmp_path}/run").collect()) == [2 * i for i in range(9)]
    assert ran == [[0, 1], [2]]
    assert results.append_once(rows, ["id"], f"{tmp_path}/a").count() == 9
    assert results.append_once(rows.limit(4), ["id"], f"{tmp_path}/a").count() == 9
    manifest, columns, shared = results.audit({"one": rows, "two": rows.union(rows)}, "id")
    assert {(r["name"], r["n_rows"], r["n_repeated"]) for r in manifest.collect()} == {("one", 9, 0), ("two", 18, 9)}
    assert {r["output"] for r in columns.collect()} == {"one_chunk", "two_chunk"} and [r["column"] for r in shared.collect()] == ["chunk"]


def test_metadata_taxonomy_and_lists(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("Sample\tParticipant\tType\n s2 \tp9\tBAL\ns1\tp3\tRinse\n")
    got = {r["Sample"]: (r["sample_code"], r["patient_code"]) for r in results.read_metadata(spark, f"{tmp_path}/m.tsv", "Sample", "Participant").collect()}
    assert got == {"s1": ("S001", "P0"), "s2": ("S002", "P1")}
    assert results.read_metadata(spark, f"{tmp_path}/m.tsv", "Sample", "Participant", ["BAL"]).count() == 1
    (tmp_path / "t.tsv").write_text("Feature ID\tTaxon\nA1;size=4\td__X\n")
    assert results.read_taxonomy(spark, f"{tmp_path}/t.tsv").first()["feature"] == "A1"
    with pytest.raises(ValueError, match="Taxon"):
        results.read_taxonomy(spark, f"{tmp_path}/m.tsv", "Sample")
    found, missing = results.whitelisted(spark, str(tmp_path), ["t", "zz", "m"])
    assert [n for n, _ in found] == ["t", "m"] and missing == ["zz"]
    (tmp_path / "f.fa").write_text(">x desc > more\nac\ngt\n>y\nTT\n")
    assert sorted((r["id"], r["seq"]) for r in readers.read_fasta(spark, f"{tmp_path}/f.fa").collect()) == [("x", "ACGT"), ("y", "TT")]
    results.write_group_fasta(spark.createDataFrame([("x", "AC", "g1")], "id string, seq string, grp string"), f"{tmp_path}/fa", "grp")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/fa/grp=g1").collect()] == [">x", "AC"]


def test_pairs_of_parts_get_partitions_in_proportion_to_the_lines(spark, monkeypatch):
    from quadrat.plans import networks

    monkeypatch.setattr(networks, "LINES", 500)
    data = "/root/testdata/sf0.001"
    parts = -(-spark.read.parquet(f"{data}/lineitem.parquet").count() // 500)
    assert networks.shared_orders(spark, data).rdd.getNumPartitions() == networks._by_priority(spark, data).rdd.getNumPartitions() == 2 * parts > 4


def test_merged_metric_takes_every_value_of_the_summary(spark):
    from quadrat.plans import ecology

    data = "/root/testdata/sf0.001"
    got = {r["feature"]: r["metric"] for r in ecology.isa6_merged_metric(spark, data).collect()}
    blocked = {r["feature"]: round(r["p"], 6) for r in ecology._blocked_isa(spark, data).collect()}
    assert any(p > 0.05 for p in blocked.values()) and {f: got[f] for f in blocked} == blocked
