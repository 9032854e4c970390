"""Operators on literal frames: the cases in which naive SQL goes wrong."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrat.functions import text, transforms
from quadrat.operators import aggregate, distance, diversity, filters, isa, network, ordination, permute, resample, sequences, sets, stats


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(df):
    return [tuple(r) for r in df.collect()]


def test_zero_total_divides_by_one(spark):
    df = frame(spark, [("a", "x", 0), ("b", "x", 3), ("b", "y", 1)], "sample string, feature string, count long")
    assert {(r["sample"], r["feature"]): r["p"] for r in transforms.relative(df).collect()} == {("a", "x"): 0.0, ("b", "x"): 0.75, ("b", "y"): 0.25}


def test_missing_rank_leaves_before_the_total(spark):
    counts = frame(spark, [("s", "a", 3), ("s", "b", 1), ("s", "c", 6)], "sample string, feature string, count long")
    tax = frame(spark, [("a", "P"), ("b", "Q"), ("c", None)], "feature string, phylum string")
    assert {r["phylum"]: r["p"] for r in transforms.relative(diversity.by_taxon(counts, tax, "phylum")).collect()} == {"P": 0.75, "Q": 0.25}


def test_side_policies_differ_on_missing(spark):
    df = frame(spark, [(None, None), (None, "N"), ("Left", None), ("Left", "L"), ("Left", "R")], "site string, code string")
    got = {p: [r[0] for r in df.select(filters.side_status(F.col("site"), F.col("code"), p)).collect()] for p in ("as_n", "contralateral", "healthy")}
    assert got["as_n"] == ["TumorSide", "TumorSide", "Contralateral", "TumorSide", "Contralateral"]
    assert got["contralateral"][:3] == ["Contralateral"] * 3 and got["healthy"][:3] == ["Healthy"] * 3
    with pytest.raises(ValueError, match="unknown policy"):
        filters.side_status(F.col("site"), F.col("code"), "x")


@pytest.mark.parametrize(("taxon", "genus", "filled"), [("d__B; p__F; g__", None, "unknown_F"), ("Unassigned", None, "unknown"), ("d__B;p__F;c__C;o__O;f__M;g__Gx;s__", "Gx", "Gx"), ("p__F", None, "unknown_F"), ("", None, "unknown"), (None, None, "unknown")])
def test_lineages(spark, taxon, genus, filled):
    df = frame(spark, [(taxon,)], "taxon string")
    assert df.select(text.rank_name(F.col("taxon"), "genus")).first()[0] == genus
    assert df.select(*text.filled_ranks(F.col("taxon"))).first()["genus"] == filled


def test_short_names_are_chopped_three_ways(spark):
    df = frame(spark, [("a_b",), ("a_b_S1_L001",), ("a",)], "n string")
    assert [r[0] for r in df.select(text.chop_tokens(F.col("n"), 2)).collect()] == ["a", "a_b", "a"]
    assert [r[0] for r in df.select(text.chop_tokens(F.col("n"), 2, short="whole")).collect()] == ["a_b", "a_b", "a"]


def test_collapse_rules(spark):
    df = frame(spark, [("k", 5, 1.0, f"t{i:02d}") for i in range(27)] + [("j", 2, 1.0, " "), ("j", 3, 3.0, None)], "k string, read_count long, x double, t string")
    got = {r["k"]: r for r in df.groupBy("k").agg(aggregate.collapse_number("read_count").alias("c"), aggregate.collapse_number("x").alias("x"), aggregate.collapse_text(F.col("t")).alias("t")).collect()}
    assert got["k"]["c"] == 5 and got["k"]["t"].endswith("|t24|...") and got["j"]["c"] == 5 and got["j"]["x"] == 2 and got["j"]["t"] == ""


def test_attrition(spark):
    df = frame(spark, [(1, 1, 1), (0, 1, 0), (1, 0, 1), (1, 1, 0)], "a int, b int, c int")
    assert [(r["method"], r["non_target"], r["target"]) for r in aggregate.cumulative_attrition(df, ["a", "b", "c"]).orderBy("step").collect()] == [("a", 1, 3), ("b", 2, 2), ("c", 3, 1)]


def test_regions_partition_the_universe(spark):
    df = frame(spark, [("x", "A", 1), ("x", "B", 2), ("y", "A", 3), ("z", "C", 4), ("z", "A", 1), ("z", "B", 1)], "feature string, g string, count long")
    got = dict(one(sets.exclusive_regions(df, "g", ["A", "B", "C"]).select("feature", "grouping")))
    assert got == {"x": "A + B", "y": "A", "z": "A + B + C"}


def test_distances_of_equal_and_disjoint_profiles(spark):
    df = frame(spark, [("a", "x", 2), ("a", "y", 2), ("b", "x", 2), ("b", "y", 2), ("c", "z", 5)], "sample string, feature string, count long")
    assert {(r[0], r[1]): r[2] for r in distance.bray_curtis(df).collect()} == {("a", "b"): 0.0, ("a", "c"): 1.0, ("b", "c"): 1.0}
    assert {(r["id1"], r["id2"]): r["dist"] for r in distance.jaccard(df).collect()} == {("a", "b"): 0.0, ("a", "c"): 1.0, ("b", "c"): 1.0}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 6), st.integers(1, 50)), min_size=2, max_size=30))
def test_bray_curtis_against_numpy(spark, cells):
    table = np.zeros((5, 7))
    for s, f, c in cells:
        table[s, f] += c
    rows = [(f"s{s}", f"f{f}", int(table[s, f])) for s in range(5) for f in range(7) if table[s, f]]
    got = {(r[0], r[1]): r[2] for r in distance.bray_curtis(frame(spark, rows, "sample string, feature string, count long")).collect()}
    for (a, b), d in got.items():
        x, y = table[int(a[1])], table[int(b[1])]
        assert 0 <= d <= 1 and abs(d - np.abs(x - y).sum() / (x + y).sum()) < 1e-12


def test_permanova_against_numpy(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(9, 3)) + np.repeat([[0, 0, 0], [2, 0, 0], [0, 2, 0]], 3, axis=0)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    pairs = frame(spark, [(i, j, float(d[i, j])) for i in range(9) for j in range(i + 1, 9)], "id1 int, id2 int, dist double")
    units = frame(spark, [(i, "abc"[i // 3]) for i in range(9)], "unit int, label string")
    got = permute.permanova(pairs, units, "unit", "label", 19).first()
    total = (d**2).sum() / 2 / 9
    within = sum((d[k : k + 3, k : k + 3] ** 2).sum() / 2 / 3 for k in (0, 3, 6))
    assert abs(got["r2"] - (1 - within / total)) < 1e-9 and 0.05 <= got["p"] <= 1


def test_permutations_stay_in_blocks(spark):
    units = frame(spark, [(i, f"b{i % 3}", f"l{i}") for i in range(12)], "unit int, block string, label string")
    moved = permute.permuted_labels(units, "unit", "label", 5, "block")
    assert moved.count() == 72 and moved.select("rep", "label").distinct().count() == 72
    block = dict((i, i % 3) for i in range(12))
    assert all(block[r["unit"]] == int(r["label"][1:]) % 3 for r in moved.collect())


def test_null_labels_are_rejected_about_as_often_as_alpha(spark):
    """The share of small p over many shuffled labellings of one distance table."""
    r = np.random.default_rng(5)
    x = r.normal(size=12)
    pairs = frame(spark, [(i, j, float(abs(x[i] - x[j]))) for i in range(12) for j in range(i + 1, 12)], "id1 int, id2 int, dist double")
    units = frame(spark, [(i, "ab"[i % 2]) for i in range(12)], "unit int, label string")
    r2 = sorted(row["r2"] for row in permute.r_squared(pairs, permute.permuted_labels(units, "unit", "label", 199), "unit", "label").collect())
    assert r2[int(0.95 * len(r2))] > r2[len(r2) // 2]


def test_rank_tests_with_ties(spark):
    df = frame(spark, [("f", "a", 1.0), ("f", "a", 2.0), ("f", "a", 2.0), ("f", "b", 2.0), ("f", "b", 3.0), ("g", "a", 1.0), ("g", "b", 1.0)], "f string, grp string, v double")
    got = {r["f"]: r for r in stats.mann_whitney(df, ["f"], "grp", "a", "v").collect()}
    assert got["f"]["u"] == 1.0 and got["g"]["z"] is None
    pairs = frame(spark, [(1.0, 1.0), (2.0, 1.0), (3.0, 1.0), (1.0, 4.0)], "a double, b double")
    w = stats.wilcoxon_signed(pairs, [], "a", "b").first()
    assert (w["n"], w["w_plus"], w["w_minus"]) == (3, 3.0, 3.0)


@pytest.mark.parametrize("ps", [[0.01, 0.04, 0.03, None, 0.5], [0.0, 0.0, 1.0], [0.2]])
def test_benjamini_hochberg(spark, ps):
    df = frame(spark, [(i, p) for i, p in enumerate(ps)], "i int, p double")
    got = {r["i"]: r["q"] for r in stats.benjamini_hochberg(df, "p", [], ["i"]).collect()}
    known = sorted((p, i) for i, p in enumerate(ps) if p is not None)
    least = 1.0
    for k in range(len(known), 0, -1):
        p, i = known[k - 1]
        least = min(least, p * len(known) / k)
        assert abs(got[i] - least) < 1e-12 and got[i] >= p
    assert all(got[i] is None for i, p in enumerate(ps) if p is None)


@pytest.mark.parametrize("fold", [1.0, 3.0, 50.0])
def test_spike_in_keeps_totals(spark, fold):
    df = frame(spark, [("s", "a", 5), ("s", "b", 3), ("s", "c", 3), ("s", "d", 1), ("t", "b", 7)], "sample string, feature string, count long")
    out = resample.spike_in(df, frame(spark, [("a",)], "feature string"), fold)
    for r in out.groupBy("sample").agg(F.sum("count").alias("t"), F.sum("spiked_count").alias("u"), F.min("spiked_count").alias("m")).collect():
        assert r["t"] == r["u"] and r["m"] >= 0


def test_bootstrap_ids_are_unique_and_repeatable(spark):
    units = frame(spark, [(i, "ab"[i % 2]) for i in range(6)], "u int, g string")
    draws = resample.bootstrap(units, "u", 4, 10, "g")
    assert draws.count() == 80 and draws.select("rep", "g", "unique_id").distinct().count() == 80
    assert sorted(one(draws)) == sorted(one(resample.bootstrap(units.repartition(3), "u", 4, 10, "g")))


def test_indicator_of_one_group(spark):
    rel = frame(spark, [(f"s{i}", "mark" if i < 4 else "rest", 1.0) for i in range(12)], "sample string, feature string, p double")
    units = frame(spark, [(f"s{i}", "xyz"[i // 4]) for i in range(12)], "sample string, label string")
    got = {r["feature"]: r for r in isa.indicator_test(rel, units, "sample", "label", ["x", "y", "z"], 19).collect()}
    assert (got["mark"]["mask"], got["mark"]["a"], got["mark"]["b"], got["rest"]["mask"]) == (1, 1.0, 1.0, 6)


def test_combined_indicator_tables_keep_every_feature(spark):
    kind = "feature string, mask int, stat double, p double"
    one_ = frame(spark, [("a", 1, 0.9, 0.01), ("b", 2, 0.8, 0.3), ("c", 4, 0.7, 0.01), ("d", 1, 0.6, 0.9), ("e", 1, 0.0, 0.01)], kind)
    two = frame(spark, [("a", 1, 0.9, 0.04), ("b", 2, 0.03, 0.01), ("c", 4, 0.7, 0.05), ("d", 2, 0.5, 0.4), ("f", 8, 0.4, 0.2)], kind)
    got = {r["feature"]: r for r in isa.combined(one_, two, ("all", "blocked"), 0.05, 0.0).collect()}
    assert {k: r["label"] for k, r in got.items()} == {"a": "all+blocked", "b": "blocked", "c": "all", "d": "none", "e": "none", "f": "none"}
    assert tuple(got["d"]) == ("d", 1, 0.6, 2, 0.5, "none") and tuple(got["f"]) == ("f", None, None, 8, 0.4, "none")


def test_graph_measures(spark):
    edges = network.tidy_edges(frame(spark, [(1, 2, 1.0), (2, 1, 1.0), (2, 3, 1.0), (1, 3, 1.0), (3, 4, 1.0), (5, 6, 2.0), (7, 7, 1.0)], "a int, b int, weight double"))
    assert network.triangles(edges).collect()[0][:3] == (1, 2, 3)
    table = {r["node"]: (r["component_id"], r["component_size"]) for r in network.component_table(network.components(edges)).collect()}
    assert table[1] == table[4] == (1, 4) and table[5] == table[6] == (2, 2) and 7 not in table
    hops = {r["node"]: r["hops"] for r in network.distances_from(edges, frame(spark, [(1,)], "node int")).collect()}
    assert hops == {1: 0, 2: 1, 3: 1, 4: 2}
    ranks = {r["node"]: r["rank"] for r in network.pagerank(edges).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks[3] == max(ranks.values())


def test_pcoa_recovers_distances(spark):
    x = np.random.default_rng(1).normal(size=(6, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    pairs = frame(spark, [(f"p{i}", f"p{j}", float(d[i, j])) for i in range(6) for j in range(i + 1, 6)], "id1 string, id2 string, dist double")
    got = {(r["id"], r["axis"]): r["value"] for r in ordination.pcoa(pairs).collect()}
    y = np.array([[got[f"p{i}", a] for a in (1, 2)] for i in range(6)])
    assert np.allclose(np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1)), d)


def test_one_edit_pairs_are_exact(spark):
    words = ["ACGT", "ACGA", "ACG", "ACGTT", "TTTT", "AGGA", "A", ""]
    got = set(one(sequences.one_edit_pairs(frame(spark, list(enumerate(words)), "id int, seq string"))))

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        s, t = sorted((a, b), key=len)
        return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))

    assert got == {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if near(words[i], words[j])}


def test_shannon_of_even_counts(spark):
    df = frame(spark, [("s", f"f{i}", 7) for i in range(4)] + [("t", "f1", 0)], "sample string, feature string, count long")
    got = dict(one(diversity.shannon(df, ["sample"])))
    assert abs(got["s"] - math.log(4)) < 1e-12 and "t" not in got
