"""Filters, joins, roll-ups, windows, top-k and set operations over the study tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text, transforms
from ..operators import aggregate, filters, sets
from ..sources.study import PATIENTS_SQL, TAXONOMY_SQL, counts, counts_sql, load, patients, taxonomy
from .registry import Registry

query = Registry()
C, CB, CT = (f"WITH {counts_sql(level)}" for level in ("part", "brand", "type"))
TYPES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_TYPES_SQL = ", ".join(f"'{t}'" for t in TYPES)


@query(f"{C} SELECT sample, feature, count FROM c WHERE count > 0")
def src1_flt4_long_counts(spark, d):
    return filters.present(counts(spark, d)).select("sample", "feature", "count")


@query(f"{CT} SELECT sample, feature AS analyte, count FROM c WHERE count <> 0")
def agg16_agg17_pivot_round_trip(spark, d):
    """Wide by feature and back; absent cells come back as zero and are dropped."""
    long = counts(spark, d, "type")
    names = [r[0] for r in long.select("feature").distinct().orderBy("feature").collect()]  # the columns of the wide table
    wide = long.groupBy("sample").pivot("feature", names).agg(F.sum("count")).na.fill(0)
    return wide.unpivot(["sample"], names, "analyte", "count").where("count <> 0")


@query("SELECT doc_id, len(string_split(text, ' ')) AS n_words, round(list_sum(list_transform(string_split(text, ' '), lambda w: coalesce(try_cast(w AS DOUBLE), 0))), 4) AS total FROM documents")
def flt3_numeric_coercion(spark, d):
    """The words of whole texts as numbers, what is none as zero."""
    words = F.split("text", " ", -1)
    return load(spark, d, "documents").select("doc_id", F.size(words).cast("bigint").alias("n_words"), F.round(F.aggregate(F.transform(words, filters.to_number), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(f"{C} SELECT sample_type, count(*) AS n FROM c WHERE sample_type IN ('1-URGENT', '2-HIGH', '5-LOW') AND sample_type NOT IN ('5-LOW') GROUP BY 1")
def flt5_keep_and_drop_groups(spark, d):
    return filters.keep_groups(counts(spark, d), "sample_type", ["1-URGENT", "2-HIGH", "5-LOW"], ["5-LOW"]).groupBy("sample_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"{C}, s AS (SELECT sample FROM c GROUP BY 1 HAVING sum(count) >= 12000) SELECT sample, feature, count FROM c SEMI JOIN s USING (sample)")
def flt6_samples_of_depth(spark, d):
    return filters.samples_of_depth(counts(spark, d), 12000).select("sample", "feature", "count")


@query(f"{C}, t AS (SELECT feature, CAST(sum(count) AS BIGINT) AS total FROM c GROUP BY 1), g AS (SELECT feature, total, 100.0::DOUBLE * total / (SELECT sum(count)::DOUBLE FROM c) AS percent FROM t) SELECT feature, total, round(percent, 6) AS percent FROM g WHERE percent >= 0.06")
def flt7_features_of_share(spark, d):
    return filters.features_of_share(counts(spark, d), 0.06).withColumn("percent", F.round("percent", 6))


@query(f"{C}, s AS (SELECT sample FROM c GROUP BY 1 HAVING sum(count) >= 12000) SELECT DISTINCT feature FROM c SEMI JOIN s USING (sample) WHERE count > 0")
def flt8_features_in_kept_samples(spark, d):
    return filters.present(filters.samples_of_depth(counts(spark, d), 12000)).select("feature").distinct()


#: Ordered method flags: 1 passes, 0 marks a part as non-target.
FLAGS = ["size_ok", "price_ok", "brand_ok", "type_ok"]
_FLAGS_SQL = "f AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 0 ELSE 1 END AS size_ok, CASE WHEN p_retailprice > 1500 THEN 0 ELSE 1 END AS price_ok, CASE WHEN p_brand LIKE '%1' THEN 0 ELSE 1 END AS brand_ok, CASE WHEN lower(p_type) LIKE '%promo%' THEN 0 ELSE 1 END AS type_ok FROM part)"


def flagged_parts(spark, d):
    p = load(spark, d, "part")
    zero = lambda c: F.when(c, 0).otherwise(1)
    return p.select("p_partkey", zero(F.col("p_size") % 7 == 0).alias("size_ok"), zero(F.col("p_retailprice") > 1500).alias("price_ok"), zero(F.col("p_brand").endswith("1")).alias("brand_ok"), zero(text.contains_ignoring_case(F.col("p_type"), "PROMO")).alias("type_ok"))


@query(f"WITH {_FLAGS_SQL} SELECT p_partkey, CASE WHEN price_ok = 0 OR brand_ok = 0 THEN 'mito' ELSE 'micro' END AS label FROM f WHERE size_ok = 1")
def flt9_flt10_decontamination_split(spark, d):
    """Of rows that pass the first method, those that either of two methods flags are split off."""
    rows = flagged_parts(spark, d).where("size_ok = 1")
    return rows.select("p_partkey", F.when((F.col("price_ok") == 0) | (F.col("brand_ok") == 0), "mito").otherwise("micro").alias("label"))


@query(f"WITH {TAXONOMY_SQL}, {counts_sql()} SELECT feature, CAST(sum(count) AS BIGINT) AS total FROM c WHERE feature IN (SELECT feature FROM tx WHERE taxon <> 'Unassigned') GROUP BY 1")
def flt11_jn8_assigned_only(spark, d):
    assigned = taxonomy(spark, d).where("taxon <> 'Unassigned'").select("feature")
    return counts(spark, d).join(assigned, "feature", "left_semi").groupBy("feature").agg(F.sum("count").alias("total"))


@query("SELECT l_orderkey, l_linenumber, round(100.0 * l_quantity / (l_quantity + l_linenumber), 6) AS coverage FROM lineitem WHERE l_quantity > 0 AND l_discount >= 0.05 AND 100.0 * l_quantity / (l_quantity + l_linenumber) >= 51")
def flt12_flt13_identity_and_coverage(spark, d):
    coverage = F.lit(100.0) * F.col("l_quantity") / (F.col("l_quantity") + F.col("l_linenumber"))
    return load(spark, d, "lineitem").where((F.col("l_quantity") > 0) & (F.col("l_discount") >= 0.05) & (coverage >= 51)).select("l_orderkey", "l_linenumber", F.round(coverage, 6).alias("coverage"))


@query(f"{C}, u AS (SELECT count(DISTINCT patient) AS n FROM c), s AS (SELECT feature, count(DISTINCT patient) AS k FROM c WHERE count > 0 GROUP BY 1) SELECT feature, round(k / n::DOUBLE, 6) AS prevalence FROM s, u WHERE k / n::DOUBLE >= 0.6")
def flt14_prevalence_over_patients(spark, d):
    return filters.prevalent(counts(spark, d), "patient", 0.6).withColumn("prevalence", F.round("prevalence", 6))


@query(f"{C}, r AS (SELECT *, count / sum(count) OVER (PARTITION BY sample)::DOUBLE AS p FROM c) SELECT feature, round(max(p), 9) AS max_p FROM r GROUP BY 1 HAVING max(p) >= 0.005")
def flt15_largest_share(spark, d):
    return filters.reaching_share(transforms.relative(counts(spark, d)), 0.005).withColumn("max_p", F.round("max_p", 9))


@query(f"{CB}, n AS (SELECT count(DISTINCT sample) AS n FROM c) SELECT feature, round((sum(count * count::DOUBLE) - sum(count)::DOUBLE * sum(count) / max(n)) / (max(n) - 1), 4) AS variance FROM c, n GROUP BY 1 HAVING (sum(count * count::DOUBLE) - sum(count)::DOUBLE * sum(count) / max(n)) / (max(n) - 1) > 1e-12")
def flt16_varying_features(spark, d):
    c = counts(spark, d, "brand")
    n = c.select("sample").distinct().count()
    return filters.varying(c, n).withColumn("variance", F.round("variance", 4))


@query(f"{C} SELECT feature, max(count) AS max_count FROM c GROUP BY 1 HAVING max(count) >= 100")
def flt17_reaching_count(spark, d):
    return filters.reaching_count(counts(spark, d), 100)


@query(f"{C}, t AS (SELECT patient, sample, CAST(sum(count) AS BIGINT) AS total FROM c GROUP BY ALL) SELECT patient, sample, total FROM t QUALIFY row_number() OVER (PARTITION BY patient ORDER BY total DESC, sample) = 1")
def flt18_deepest_replicate(spark, d):
    totals = counts(spark, d).groupBy("patient", "sample").agg(F.sum("count").alias("total"))
    return filters.deepest_replicate(totals, ["patient"], "total", "sample")


@query("SELECT p_partkey FROM part WHERE (p_size < 10 OR p_retailprice > 950) AND (p_size / 50.0 >= 0.48 OR p_retailprice / 2000.0 >= 0.48)")
def flt19_strong_indicators(spark, d):
    p = load(spark, d, "part").select("p_partkey", (F.col("p_size") < 10).alias("sig1"), (F.col("p_retailprice") > 950).alias("sig2"), (F.col("p_size") / 50.0).alias("stat1"), (F.col("p_retailprice") / 2000.0).alias("stat2"))
    return filters.strong_indicators(p, [("sig1", "stat1"), ("sig2", "stat2")], 0.48).select("p_partkey")


def _sided(spark, d):
    """Customers with a case, a site (null for every fifth) and a side code (null for every seventh)."""
    c = load(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(
        k,
        F.when(F.col("c_mktsegment") == "BUILDING", "Control").when(F.col("c_mktsegment") == "MACHINERY", "Non-Cancer").when(k % 11 == 0, F.lit(None)).otherwise("Cancer").alias("case"),
        F.when(k % 5 == 0, F.lit(None)).when(k % 2 == 0, "Left").otherwise("Right").alias("site"),
        F.when(k % 7 == 0, F.lit(None)).when(k % 3 == 0, "L").when(k % 3 == 1, "R").otherwise("N").alias("code"),
    )


_SIDED_SQL = """s AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Control' WHEN c_mktsegment = 'MACHINERY' THEN 'Non-Cancer' WHEN c_custkey % 11 = 0 THEN NULL ELSE 'Cancer' END AS "case",
 CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'Left' ELSE 'Right' END AS site, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'L' WHEN c_custkey % 3 = 1 THEN 'R' ELSE 'N' END AS code FROM customer)"""


@query(f"""WITH {_SIDED_SQL} SELECT c_custkey,
 CASE WHEN left(coalesce(site, 'N'), 1) = coalesce(code, 'N') THEN 'TumorSide' ELSE 'Contralateral' END AS as_n,
 CASE WHEN site IS NULL OR code IS NULL THEN 'Contralateral' WHEN left(site, 1) = code THEN 'TumorSide' ELSE 'Contralateral' END AS contralateral,
 CASE WHEN site IS NULL OR code IS NULL THEN 'Healthy' WHEN left(site, 1) = code THEN 'TumorSide' ELSE 'Contralateral' END AS healthy,
 CASE WHEN "case" IN ('Control', 'Non-Cancer') THEN 'Control' ELSE 'Cancer' END AS canonical,
 CASE WHEN "case" IS NULL THEN 'Unknown' WHEN "case" IN ('Control', 'Non-Cancer') THEN 'Healthy' WHEN site IS NULL OR code IS NULL OR code NOT IN ('L', 'R') THEN 'Other' WHEN left(site, 1) = code THEN 'TumorSide' ELSE 'Contralateral' END AS status FROM s""")
def flt20_flt21_flt22_sides_and_status(spark, d):
    s = _sided(spark, d)
    side = lambda policy: filters.side_status(F.col("site"), F.col("code"), policy).alias(policy)
    return s.select("c_custkey", side("as_n"), side("contralateral"), side("healthy"), filters.canonical_case(F.col("case")).alias("canonical"), filters.lung_status(F.col("case"), F.col("site"), F.col("code")).alias("status"))


@query(f"""WITH {_SIDED_SQL} SELECT c_custkey FROM s WHERE NOT (coalesce("case", 'x') NOT IN ('Control', 'Non-Cancer') AND left(coalesce(site, 'N'), 1) <> coalesce(code, 'N'))""")
def flt20_without_contralateral(spark, d):
    return filters.without_contralateral(_sided(spark, d), "case", "site", "code").select("c_custkey")


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'BAL' WHEN 'MACHINERY' THEN 'Bronchial Brush' ELSE c_mktsegment END AS sample_type FROM customer")
def flt23_canonical_types(spark, d):
    raw = F.when(F.col("c_mktsegment") == "BUILDING", " bal ").when(F.col("c_mktsegment") == "MACHINERY", "Lung Brush").otherwise(F.col("c_mktsegment"))
    return load(spark, d, "customer").select("c_custkey", filters.canonical_type(raw).alias("sample_type"))


@query("WITH g AS (SELECT p_brand FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) >= 80) SELECT p_brand, count(*) AS n FROM part SEMI JOIN g USING (p_brand) GROUP BY 1")
def flt24_groups_of_size(spark, d):
    return filters.groups_of_size(load(spark, d, "part"), "p_brand", "p_partkey", 80).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("WITH o AS (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')), f AS (SELECT o_custkey FROM o GROUP BY 1 HAVING count(DISTINCT o_orderpriority) >= 2) SELECT o_custkey, count(*) AS n FROM o SEMI JOIN f USING (o_custkey) GROUP BY 1")
def flt25_units_with_both_groups(spark, d):
    rows = filters.units_with_groups(load(spark, d, "orders"), "o_custkey", "o_orderpriority", 2, ["1-URGENT", "2-HIGH"])
    return rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def flt27_complete_cases(spark, d):
    return filters.complete_cases(load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id", "left"), ["quality", "toxic"]).select("doc_id", "quality", "toxic")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE round(l_discount, 2) >= 0.05 AND round(l_tax, 2) <= 0.05")
def flt26_flt28_rounded_thresholds(spark, d):
    return load(spark, d, "lineitem").where((F.round("l_discount", 2) >= 0.05) & (F.round("l_tax", 2) <= 0.05)).select("l_orderkey", "l_linenumber")


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def flt34_distinct_metadata(spark, d):
    return load(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct()


@query("SELECT o_orderkey, upper(o_orderpriority) AS priority FROM orders WHERE o_orderstatus <> 'F'")
def flt32_flt33_passed_upper(spark, d):
    return load(spark, d, "orders").where("o_orderstatus <> 'F'").select("o_orderkey", F.upper("o_orderpriority").alias("priority"))


@query("SELECT unnest(['c_acctbal', 'c_mktsegment', 'c_nationkey']) AS kept")
def flt35_varying_columns(spark, d):
    c = load(spark, d, "customer").withColumn("constant", F.lit(1))
    kept = filters.varying_columns(c, ["c_acctbal", "c_mktsegment", "c_nationkey", "constant"])
    return spark.createDataFrame([(k,) for k in kept], "kept string")


@query(f'WITH {counts_sql()}, {PATIENTS_SQL} SELECT sample, feature, count, "case" FROM c JOIN pt USING (patient)')
def jn1_counts_with_metadata(spark, d):
    return counts(spark, d).join(F.broadcast(patients(spark, d)), "patient").select("sample", "feature", "count", "case")


STAGES = ["raw_reads", "qc_reads", "corrected_reads", "decon_reads", "micro_reads"]
_STAGES_SQL = """st AS (SELECT c_nationkey AS patient, o_orderpriority AS sample_type, c_nationkey || '|' || o_orderpriority AS sample, CAST(count(*) AS BIGINT) AS raw_reads,
 CAST(count(*) FILTER (WHERE l_returnflag <> 'R') AS BIGINT) AS qc_reads, CAST(count(*) FILTER (WHERE l_returnflag <> 'R' AND l_discount < 0.08) AS BIGINT) AS corrected_reads,
 CAST(count(*) FILTER (WHERE l_returnflag <> 'R' AND l_discount < 0.08 AND l_tax < 0.06) AS BIGINT) AS decon_reads, CAST(count(*) FILTER (WHERE l_returnflag <> 'R' AND l_discount < 0.08 AND l_tax < 0.06 AND l_quantity > 10) AS BIGINT) AS micro_reads
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def _stage_reads(spark, d):
    """One row for each sample: reads left after each of the ordered stages."""
    lines = load(spark, d, "lineitem").join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    ok = F.lit(True)
    sums = []
    for name, condition in zip(STAGES, [F.lit(True), F.col("l_returnflag") != "R", F.col("l_discount") < 0.08, F.col("l_tax") < 0.06, F.col("l_quantity") > 10], strict=True):
        ok &= condition
        sums.append(F.count_if(ok).alias(name))
    return lines.groupBy(F.col("c_nationkey").alias("patient"), F.col("o_orderpriority").alias("sample_type"), F.concat_ws("|", "c_nationkey", "o_orderpriority").alias("sample")).agg(*sums)


@query(f"WITH {_STAGES_SQL}, a AS (SELECT sample, raw_reads FROM st), b AS (SELECT sample, qc_reads FROM st WHERE qc_reads > 90), e AS (SELECT sample, micro_reads FROM st WHERE micro_reads > 60) SELECT sample, raw_reads, coalesce(qc_reads, 0) AS qc_reads, coalesce(micro_reads, 0) AS micro_reads, coalesce(qc_reads - micro_reads, 0) AS unassigned FROM a LEFT JOIN b USING (sample) LEFT JOIN e USING (sample)")
def jn2_jn3_agg21_stage_table(spark, d):
    """Stage tables left-joined to the samples; a difference with a missing side is missing before it becomes 0."""
    s = _stage_reads(spark, d)
    joined = s.select("sample", "raw_reads").join(s.where("qc_reads > 90").select("sample", "qc_reads"), "sample", "left").join(s.where("micro_reads > 60").select("sample", "micro_reads"), "sample", "left")
    return joined.withColumn("unassigned", F.col("qc_reads") - F.col("micro_reads")).na.fill(0)


@query(f"WITH {_STAGES_SQL}, l AS (UNPIVOT (SELECT sample_type, CAST(sum(raw_reads) AS BIGINT) AS raw_reads, CAST(sum(qc_reads) AS BIGINT) AS qc_reads, CAST(sum(corrected_reads) AS BIGINT) AS corrected_reads, CAST(sum(decon_reads) AS BIGINT) AS decon_reads, CAST(sum(micro_reads) AS BIGINT) AS micro_reads FROM st GROUP BY 1) ON raw_reads, qc_reads, corrected_reads, decon_reads, micro_reads INTO NAME stage VALUE total), o AS (SELECT *, list_position(['raw_reads', 'qc_reads', 'corrected_reads', 'decon_reads', 'micro_reads'], stage)::INTEGER AS step FROM l) SELECT sample_type, stage, total, step, lag(total) OVER (PARTITION BY sample_type ORDER BY step) - total AS lost FROM o")
def agg20_win7_stage_losses(spark, d):
    return aggregate.stage_losses(_stage_reads(spark, d), "sample_type", STAGES)


@query("SELECT s.s_suppkey, coalesce(n.n_name, 'none') AS home FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey AND n.n_regionkey = 1")
def jn4_left_other_key(spark, d):
    n = load(spark, d, "nation").where("n_regionkey = 1")
    return load(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.lit("none")).alias("home"))


@query("WITH a AS (SELECT l_partkey AS k, count(*) AS lines FROM lineitem GROUP BY 1), b AS (SELECT p_partkey AS k, p_size FROM part WHERE p_size > 25), e AS (SELECT p_partkey AS k, p_retailprice FROM part WHERE p_retailprice > 1200) SELECT k, lines, p_size, p_retailprice FROM a FULL JOIN b USING (k) FULL JOIN e USING (k)")
def jn5_outer_fold(spark, d):
    p = load(spark, d, "part").withColumnRenamed("p_partkey", "k")
    tables = [load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.count(F.lit(1)).alias("lines")), p.where("p_size > 25").select("k", "p_size"), p.where("p_retailprice > 1200").select("k", "p_retailprice")]
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, "k", "outer")
    return out


@query("SELECT n_nationkey, n_name, (SELECT count(*) FROM supplier) AS suppliers FROM nation")
def jn6_one_row_join(spark, d):
    one = load(spark, d, "supplier").agg(F.count(F.lit(1)).alias("suppliers"))
    return load(spark, d, "nation").select("n_nationkey", "n_name").crossJoin(F.broadcast(one))


@query("SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
def jn7_aligned_join(spark, d):
    return load(spark, d, "documents").select("doc_id", "lang").join(load(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@query("SELECT c_custkey FROM customer ANTI JOIN (SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_totalprice > 200000) USING (c_custkey)")
def jn9_anti_join(spark, d):
    big = load(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, d, "customer").select("c_custkey").join(big, "c_custkey", "left_anti")


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 0 ELSE 1 END AS clean FROM documents")
def jn10_membership_flag(spark, d):
    bad = load(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit(0).alias("hit")).distinct()
    return load(spark, d, "documents").select("doc_id").join(bad, "doc_id", "left").select("doc_id", F.coalesce("hit", F.lit(1)).alias("clean"))


@query("SELECT a.n_name AS first, b.n_name AS second, least(a.n_name, b.n_name) || ' vs ' || greatest(a.n_name, b.n_name) AS label FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
def jn11_str13_pairs_in_region(spark, d):
    n = load(spark, d, "nation")
    a, b = (n.select(F.col("n_nationkey").alias(f"k{i}"), F.col("n_name").alias(x), "n_regionkey") for i, x in ((1, "first"), (2, "second")))
    return a.join(b, "n_regionkey").where("k1 < k2").select("first", "second", text.pair_label(F.col("first"), F.col("second")).alias("label"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'pending' END AS status FROM orders")
def jn13_lookup_map(spark, d):
    names = F.create_map(*map(F.lit, ["F", "final", "O", "open"]))
    return load(spark, d, "orders").select("o_orderkey", F.coalesce(F.try_element_at(names, F.col("o_orderstatus")), F.lit("pending")).alias("status"))


@query(f"{CT} SELECT a.patient, a.feature, a.count AS first, b.count AS second FROM c a JOIN c b ON a.patient = b.patient AND a.feature = b.feature AND a.sample_type = '1-URGENT' AND b.sample_type = '2-HIGH'")
def jn14_paired_within_patient(spark, d):
    c = counts(spark, d, "type")
    side = lambda t, n: c.where(F.col("sample_type") == t).select("patient", "feature", F.col("count").alias(n))
    return side("1-URGENT", "first").join(side("2-HIGH", "second"), ["patient", "feature"])


@query(f"{CB} SELECT patient, feature, CAST(sum(count) AS BIGINT) AS total, round(avg(count), 6) AS mean, count(*) AS n, count(DISTINCT sample_type) AS types, min(count) AS least, max(count) AS most, round(median(count), 6) AS median, round(stddev_samp(count), 6) AS sd FROM c GROUP BY ALL")
def agg1_to_agg6_basic(spark, d):
    x = F.col("count")
    return counts(spark, d, "brand").groupBy("patient", "feature").agg(F.sum(x).alias("total"), F.round(F.avg(x), 6).alias("mean"), F.count(F.lit(1)).alias("n"), F.countDistinct("sample_type").alias("types"), F.min(x).alias("least"), F.max(x).alias("most"), F.round(F.median(x), 6).alias("median"), F.round(F.stddev_samp(x), 6).alias("sd"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_orderpriority")
def agg5_value_counts(spark, d):
    return load(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "o_orderpriority")


@query(f"{CB} SELECT sample_type, round(quantile_cont(count::DOUBLE, 0.025), 6) AS low, round(quantile_cont(count::DOUBLE, 0.25), 6) AS q1, round(quantile_cont(count::DOUBLE, 0.75), 6) AS q3, round(quantile_cont(count::DOUBLE, 0.975), 6) AS high FROM c GROUP BY 1")
def agg7_percentiles(spark, d):
    q = lambda p, n: F.round(F.percentile(F.col("count").cast("double"), p), 6).alias(n)
    return counts(spark, d, "brand").groupBy("sample_type").agg(q(0.025, "low"), q(0.25, "q1"), q(0.75, "q3"), q(0.975, "high"))


@query(f"{C}, n AS (SELECT count(DISTINCT sample) AS n FROM c) SELECT feature, round(avg(count) FILTER (WHERE count > 0), 6) AS mean_nonzero, median(count) FILTER (WHERE count > 0) AS median_nonzero, CAST(ceil(sum(count) / max(n)) AS BIGINT) AS mean_all FROM c, n GROUP BY 1")
def agg8_agg9_nonzero_and_all(spark, d):
    c = counts(spark, d)
    n = c.select("sample").distinct().count()
    x = F.when(F.col("count") > 0, F.col("count"))
    return c.groupBy("feature").agg(F.round(F.avg(x), 6).alias("mean_nonzero"), F.median(x).alias("median_nonzero"), F.ceil(F.sum("count") / n).alias("mean_all"))


@query(f"{C} SELECT feature, CAST(count(*) FILTER (WHERE count <> 0) AS BIGINT) AS n_nonzero, CAST(sum(count) AS BIGINT) AS total, round(avg(count), 6) AS mean, max(count) AS largest, min(count) AS smallest FROM c GROUP BY 1")
def agg10_row_statistics(spark, d):
    return aggregate.row_statistics(counts(spark, d)).withColumn("mean", F.round("mean", 6))


@query("""WITH t AS (SELECT p_brand, list_sort(list_distinct(list(trim(p_name)) FILTER (WHERE trim(p_name) <> ''))) AS names, CASE WHEN count(DISTINCT p_size) = 1 THEN max(p_size)::DOUBLE ELSE avg(p_size) END AS p_size, CASE WHEN count(DISTINCT p_size % 3) = 1 THEN max(p_size % 3)::DOUBLE ELSE sum(p_size % 3)::DOUBLE END AS size_count FROM part GROUP BY 1)
SELECT p_brand, CASE WHEN len(names) > 25 THEN array_to_string(names[1:25], '|') || '|...' ELSE array_to_string(names, '|') END AS names, round(p_size, 6) AS p_size, round(size_count, 6) AS size_count FROM t""")
def agg11_polymorphic_collapse(spark, d):
    p = load(spark, d, "part").withColumn("size_count", F.col("p_size") % 3)
    out = p.groupBy("p_brand").agg(aggregate.collapse_text(F.col("p_name")).alias("names"), aggregate.collapse_number("p_size").alias("p_size"), aggregate.collapse_number("size_count").alias("size_count"))
    return out.withColumns({c: F.round(c, 6) for c in ("p_size", "size_count")})


@query("SELECT o_custkey, array_to_string(list_sort(list(o_orderkey)), ',') AS orders, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS kinds FROM orders GROUP BY 1")
def agg13_collect_list_and_set(spark, d):
    return load(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list("o_orderkey")), ",").alias("orders"), F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("kinds"))


@query(f"{CT}, m AS (SELECT feature, sample_type, avg(count) AS mean FROM c GROUP BY ALL) SELECT feature, arg_min(sample_type, (-mean, sample_type)) AS best, round(max(mean), 6) AS mean FROM m GROUP BY 1")
def agg14_agg15_arg_max_group(spark, d):
    means = counts(spark, d, "type").groupBy("feature", "sample_type").agg(F.avg("count").alias("mean"))
    return means.groupBy("feature").agg(F.min_by("sample_type", F.struct(-F.col("mean"), F.col("sample_type"))).alias("best"), F.round(F.max("mean"), 6).alias("mean"))


@query(f"WITH {_FLAGS_SQL}, s AS (SELECT CASE WHEN size_ok = 0 THEN 1 WHEN price_ok = 0 THEN 2 WHEN brand_ok = 0 THEN 3 WHEN type_ok = 0 THEN 4 END AS step, count(*) AS n FROM f GROUP BY 1), m AS (SELECT unnest([1, 2, 3, 4])::INTEGER AS step, unnest(['size_ok', 'price_ok', 'brand_ok', 'type_ok']) AS method) SELECT m.step, method, CAST(sum(coalesce(n, 0)) OVER (ORDER BY m.step) AS BIGINT) AS non_target, CAST((SELECT count(*) FROM part) - sum(coalesce(n, 0)) OVER (ORDER BY m.step) AS BIGINT) AS target FROM m LEFT JOIN s ON m.step = s.step")
def agg18_win6_cumulative_attrition(spark, d):
    return aggregate.cumulative_attrition(flagged_parts(spark, d), FLAGS)


@query(f"WITH {_FLAGS_SQL}, l AS (UNPIVOT f ON size_ok, price_ok, brand_ok, type_ok INTO NAME method VALUE flag) SELECT method, CAST(count(*) FILTER (WHERE flag = 0) AS BIGINT) AS non_target, CAST(count(*) FILTER (WHERE flag <> 0) AS BIGINT) AS target FROM l GROUP BY 1")
def agg19_flagged_by_method(spark, d):
    return aggregate.flagged_by_method(flagged_parts(spark, d), FLAGS)


@query(f"{CT} SELECT sample, feature, round(100.0 * count / sum(count) OVER (PARTITION BY sample), 6) AS percent FROM c")
def agg22_win1_percent_of_sample(spark, d):
    return aggregate.group_percent(counts(spark, d, "type"), ["sample"], "count").select("sample", "feature", F.round("percent", 6).alias("percent"))


@query(f"{CB}, t AS (SELECT feature, CAST(sum(count) AS BIGINT) AS total FROM c GROUP BY 1), k AS (SELECT feature FROM t ORDER BY total DESC, feature LIMIT 8), g AS (SELECT sample_type, CASE WHEN feature IN (SELECT feature FROM k) THEN feature ELSE 'Other' END AS feature, sum(count) AS n FROM c GROUP BY ALL) SELECT sample_type, feature, round(100.0 * n / sum(n) OVER (PARTITION BY sample_type), 6) AS percent FROM g")
def agg23_top1_percent_with_other(spark, d):
    c = counts(spark, d, "brand")
    top = c.groupBy("feature").agg(F.sum("count").alias("total")).orderBy(F.desc("total"), "feature").limit(8).select("feature", F.lit(True).alias("top"))
    named = c.join(F.broadcast(top), "feature", "left").groupBy("sample_type", F.when(F.col("top"), F.col("feature")).otherwise("Other").alias("feature")).agg(F.sum("count").alias("n"))
    return aggregate.group_percent(named, ["sample_type"], "n").select("sample_type", "feature", F.round("percent", 6).alias("percent"))


@query(f'WITH {counts_sql()}, {PATIENTS_SQL}, s AS (SELECT DISTINCT patient, sample, sample_type, "case" FROM c JOIN pt USING (patient)) SELECT sample_type, "case", count(DISTINCT patient) AS n, \'fine\' AS level FROM s GROUP BY ALL UNION ALL SELECT NULL, "case", count(DISTINCT patient), \'coarse\' FROM s GROUP BY ALL')
def agg24_set1_cohort_summary(spark, d):
    s = counts(spark, d).select("patient", "sample", "sample_type").distinct().join(F.broadcast(patients(spark, d)), "patient")
    return aggregate.cohort_summary(s, ["sample_type", "case"], ["case"], "patient").select("sample_type", "case", "n", "level")


@query("SELECT c_custkey, 'P' || (dense_rank() OVER (ORDER BY c_acctbal) - 1) AS code, 'S' || lpad(row_number() OVER (ORDER BY c_name)::VARCHAR, greatest(3, length(row_number() OVER (ORDER BY c_name)::VARCHAR))::INTEGER, '0') AS sample_code FROM customer")
def win2_win3_codes(spark, d):
    """Codes of sorted distinct values, without one window over all of them."""
    c = load(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return aggregate.dense_codes(aggregate.dense_codes(c, "c_acctbal", "code", "P"), "c_name", "sample_code", "S", 3, 1).select("c_custkey", "code", "sample_code")


@query("SELECT l_returnflag || l_linestatus AS k, CASE WHEN sum(l_quantity) >= 1000 THEN printf('%.1fk', sum(l_quantity) / 1000) ELSE CAST(CAST(sum(l_quantity) AS BIGINT) AS VARCHAR) END AS label FROM lineitem GROUP BY 1")
def str8_short_numbers(spark, d):
    return load(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("k")).agg(F.sum("l_quantity").alias("x")).select("k", text.short_number(F.col("x")).alias("label"))


@query("SELECT a.o_custkey, a.n AS n_left, b.n AS n_right FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b USING (o_custkey)".replace("SELECT a.o_custkey,", "SELECT o_custkey,", 1))
def jn15_suffixed_merge(spark, d):
    """Columns of one name on both sides get suffixes."""
    n = lambda s: load(spark, d, "orders").where(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return aggregate.suffixed_join(n("F"), n("O"), ["o_custkey"], ("_left", "_right"), "full")


@query(f"{CB}, t AS (SELECT sample_type, feature, sum(count) AS total FROM c GROUP BY ALL), k AS (SELECT feature FROM t QUALIFY row_number() OVER (PARTITION BY sample_type ORDER BY total DESC, feature) <= 5) SELECT DISTINCT feature FROM (SELECT feature FROM k UNION ALL SELECT 'Brand#11')")
def top2_rank_universe(spark, d):
    totals = counts(spark, d, "brand").groupBy("sample_type", "feature").agg(F.sum("count").alias("total"))
    return aggregate.rank_universe(totals, "sample_type", "feature", "total", 5, spark.createDataFrame([("Brand#11",)], "feature string"))


@query("SELECT c_mktsegment, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY abs(c_acctbal) DESC, c_custkey) <= 5")
def top3_top4_largest_effects(spark, d):
    return aggregate.top_per_group(load(spark, d, "customer").select("c_mktsegment", "c_custkey", "c_acctbal"), ["c_mktsegment"], [F.desc(F.abs("c_acctbal")), F.asc("c_custkey")], 5)


@query(f"{CB}, t AS (SELECT feature, CAST(sum(count) AS BIGINT) AS total FROM c GROUP BY 1), k AS (SELECT * FROM t ORDER BY total DESC, feature LIMIT 10) SELECT coalesce(k.feature, 'Other') AS feature, CAST(sum(t.total) AS BIGINT) AS total FROM t LEFT JOIN k USING (feature) GROUP BY ALL")
def top1_top5_top_with_other(spark, d):
    return aggregate.top_with_other(counts(spark, d, "brand").groupBy("feature").agg(F.sum("count").alias("total")), "feature", "total", 10)


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality NULLS LAST, doc_id")
def top6_top7_nulls_last(spark, d):
    rows = load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id", "left").select("doc_id", "quality")
    return rows.orderBy(F.asc_nulls_last("quality"), "doc_id")


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END AS place FROM orders")
def top8_fixed_order(spark, d):
    return load(spark, d, "orders").select("o_orderkey", text.ordered_position(F.col("o_orderpriority"), ["5-LOW", "1-URGENT"]).alias("place"))


_REGION_SQL = f"""m AS (SELECT feature, bit_or((1 << (list_position([{_TYPES_SQL}], sample_type) - 1))::BIGINT) AS mask, CAST(sum(count) AS BIGINT) AS total FROM c GROUP BY 1),
 l AS (SELECT *, array_to_string(list_filter([{', '.join(f"CASE WHEN mask & {1 << i} <> 0 THEN '{t}' END" for i, t in enumerate(TYPES))}], lambda x: x IS NOT NULL), ' + ') AS grouping FROM m)"""


@query(f"{C}, {_REGION_SQL} SELECT grouping, feature FROM l")
def set3_set5_exclusive_regions(spark, d):
    return sets.exclusive_regions(counts(spark, d), "sample_type", TYPES)


@query(f"{C}, {_REGION_SQL} SELECT grouping, count(*) AS n_features, CAST(sum(total) AS BIGINT) AS total FROM l GROUP BY 1")
def set4_region_sums(spark, d):
    return sets.region_sizes(counts(spark, d), "sample_type", TYPES)


@query(f"{C}, {_REGION_SQL}, w AS (SELECT feature, sample_type, CAST(sum(count) AS BIGINT) AS total FROM c GROUP BY ALL) SELECT w.feature, w.sample_type, w.total, mask FROM w JOIN l USING (feature)")
def set6_upset_rows(spark, d):
    return sets.upset_rows(counts(spark, d), "sample_type", TYPES)


@query(f"{C}, g AS (SELECT feature, bit_or(CASE WHEN sample_type IN ('1-URGENT', '2-HIGH') THEN 1 WHEN sample_type = '3-MEDIUM' THEN 2 ELSE 0 END) AS m FROM c GROUP BY 1) SELECT CASE m WHEN 1 THEN 'Oral' WHEN 2 THEN 'Lung' WHEN 3 THEN 'Oral + Lung' END AS grouping, count(*) AS n FROM g WHERE m > 0 GROUP BY 1")
def set7_composite_regrouping(spark, d):
    rows = sets.regroup(counts(spark, d), "sample_type", {"1-URGENT": "Oral", "2-HIGH": "Oral", "3-MEDIUM": "Lung"})
    return sets.exclusive_regions(rows, "sample_type", ["Oral", "Lung"]).groupBy("grouping").agg(F.count(F.lit(1)).alias("n"))


@query(f"{C}, a AS (SELECT DISTINCT feature FROM c WHERE sample_type = '1-URGENT'), b AS (SELECT DISTINCT feature FROM c WHERE sample_type = '5-LOW') SELECT 'union' AS op, count(*) AS n FROM (FROM a UNION FROM b) UNION ALL SELECT 'both', count(*) FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'only first', count(*) FROM (FROM a EXCEPT FROM b)")
def set2_union_intersection_difference(spark, d):
    c = counts(spark, d)
    ids = lambda t: c.where(F.col("sample_type") == t).select("feature").distinct()
    a, b = ids("1-URGENT"), ids("5-LOW")
    size = lambda df, op: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
    return size(a.union(b).distinct(), "union").union(size(a.intersect(b), "both")).union(size(a.subtract(b), "only first"))


@query("SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1")
def set8_first_by_key(spark, d):
    """First by an explicit order, so that the kept row does not depend on the partitioning."""
    return load(spark, d, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("p_partkey"))


@query("SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_shipmode_like))), ' + ') AS combo FROM (SELECT l_orderkey, l_returnflag || l_linestatus AS l_shipmode_like FROM lineitem) GROUP BY 1")
def set9_combo_labels(spark, d):
    joined = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_set(F.concat("l_returnflag", "l_linestatus")), "+").alias("raw"))
    return joined.select("l_orderkey", text.combo_label(F.col("raw")).alias("combo"))


@query(f"""WITH {TAXONOMY_SQL} SELECT feature, nullif(regexp_extract(taxon, 'd__([^;]*)', 1), '') AS domain, nullif(regexp_extract(taxon, 'p__([^;]*)', 1), '') AS phylum, nullif(regexp_extract(taxon, 'f__([^;]*)', 1), '') AS family,
 CASE WHEN taxon = 'Unassigned' THEN 'unknown' ELSE 'unknown_' || regexp_extract(taxon, 'p__([^;]*)', 1) END AS "order", coalesce(nullif(regexp_extract(taxon, 'p__([^;]*)', 1), ''), 'Unknown') AS positional FROM tx""")
def str1_lineage_ranks(spark, d):
    t = taxonomy(spark, d)
    named = [text.rank_name(F.col("taxon"), r).alias(r) for r in ("domain", "phylum", "family")]
    order = text.filled_ranks(F.col("taxon"))[3]
    return t.select("feature", *named, order, text.rank_name(F.col("taxon"), "phylum", "by_position", "Unknown").alias("positional"))


@query("""SELECT page_id, split_part(url || ';size=3', ';', 1) AS id, nullif(regexp_extract(url, '([^/]+)$', 1), '') AS last, regexp_replace(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS token,
 left(url, 2) AS prefix, upper(left(url, 1)) AS initial, contains(lower(url), 'example') AS has FROM pages""")
def str2_to_str6_ids_and_tokens(spark, d):
    u = F.col("url")
    return load(spark, d, "pages").select(
        "page_id", text.feature_id(F.concat(u, F.lit(";size=3"))).alias("id"), text.sample_from_path(u, "([^/]+)$").alias("last"), text.safe_token(u).alias("token"),
        F.substring(u, 1, 2).alias("prefix"), F.upper(F.substring(u, 1, 1)).alias("initial"), text.contains_ignoring_case(u, "EXAMPLE").alias("has"),
    )


@query("WITH s AS (SELECT event_id, 'a_' || user_id || '_S' || (event_id % 9) || '_L001' AS n FROM events), p AS (SELECT event_id, string_split(n, '_') AS t FROM s) SELECT event_id, array_to_string(t[1:len(t) - 2], '_') AS chopped, t[1] AS first FROM p")
def str3_chopped_names(spark, d):
    name = F.concat(F.lit("a_"), F.col("user_id"), F.lit("_S"), F.col("event_id") % 9, F.lit("_L001"))
    return load(spark, d, "events").select("event_id", text.chop_tokens(name, 2).alias("chopped"), text.chop_tokens(name, 9).alias("first"))


@query("SELECT n_nationkey, n_nationkey::VARCHAR AS k, n_name AS name, CASE WHEN n_nationkey < 1 THEN '***' WHEN n_nationkey < 10 THEN '**' WHEN n_nationkey < 50 THEN '*' ELSE '' END AS stars, CASE WHEN n_nationkey % 2 = 0 THEN 'Unassigned' ELSE n_name END || ' ' || n_name AS label, trim(lower(' ' || n_name || ' ')) AS low FROM nation")
def str7_str9_str10_str12_labels(spark, d):
    n = load(spark, d, "nation")
    m = text.key_values(F.concat(F.lit("k="), "n_nationkey", F.lit(",name="), "n_name"))
    family = F.when(F.col("n_nationkey") % 2 == 0, "").otherwise(F.col("n_name"))
    return n.select("n_nationkey", m["k"].alias("k"), m["name"].alias("name"), text.stars((F.col("n_nationkey") + 1) / 1000.0 - 0.0001).alias("stars"), text.family_genus(family, F.col("n_name")).alias("label"), F.trim(F.lower(F.concat(F.lit(" "), "n_name", F.lit(" ")))).alias("low"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"k\":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}' AS again FROM events")
def jsn1_json_fields(spark, d):
    parsed = F.from_json("props", "k bigint")
    return load(spark, d, "events").select("event_id", parsed["k"].alias("k"), F.to_json(F.struct(parsed["k"].alias("k"))).alias("again"))


@query(f"{C} SELECT feature, round(log10(sum(count) + 1), 6) AS log_total, round(-log10(nullif(least(sum(count) / 1000.0, 1), 0)), 3) AS minus_log, CAST(floor(sum(count) / 7) AS BIGINT) AS floored, CAST(sum(count) // 2 AS BIGINT) AS half, greatest(CAST(sum(count) AS BIGINT) - 500, 0) AS clipped FROM c GROUP BY 1")
def mth1_mth2_mth3_scalars(spark, d):
    t = counts(spark, d).groupBy("feature").agg(F.sum("count").alias("t"))
    x = F.col("t")
    return t.select("feature", F.round(transforms.log10_plus_one(x), 6).alias("log_total"), transforms.minus_log10(F.least(x / 1000.0, F.lit(1.0))).alias("minus_log"), F.floor(x / 7).alias("floored"), F.expr("t div 2").alias("half"), F.greatest(x - 500, F.lit(0)).alias("clipped"))


_R = "r AS (SELECT *, count / sum(count) OVER (PARTITION BY sample)::DOUBLE AS p FROM c), k AS (SELECT count(DISTINCT feature) AS n FROM c)"


@query(f"{CB}, {_R} SELECT sample, feature, round(p, 9) AS p, round(sqrt(p), 9) AS hellinger, round(ln(p) - avg(ln(p)) OVER (PARTITION BY sample), 6) AS rclr FROM r")
def mth4_mth8_mth9_relative_rclr_hellinger(spark, d):
    out = transforms.hellinger(transforms.rclr(transforms.relative(counts(spark, d, "brand"))))
    return out.select("sample", "feature", F.round("p", 9).alias("p"), F.round("hellinger", 9).alias("hellinger"), F.round("rclr", 6).alias("rclr"))


@query(f"{C}, {_R}, n AS (SELECT *, count(*) OVER (PARTITION BY sample) AS m FROM r, k) SELECT sample, feature, round(ln(p) - (sum(ln(p)) OVER w + (n - m) * ln(1e-6)) / n, 6) AS clr_floor, round(ln(count + (m < n)::INTEGER) - sum(ln(count + (m < n)::INTEGER)) OVER w / n, 6) AS clr_one, round(ln(p * (1 - (n - m) / (n * n)::DOUBLE)) - (sum(ln(p * (1 - (n - m) / (n * n)::DOUBLE))) OVER w + (n - m) * ln(1 / (n * n)::DOUBLE)) / n, 6) AS clr_replaced FROM n WINDOW w AS (PARTITION BY sample)")
def mth5_mth6_mth7_clr(spark, d):
    c = counts(spark, d)
    n = c.select("feature").distinct().count()
    rel = transforms.relative(c)
    out = transforms.clr_floor(rel, n).withColumnRenamed("clr", "clr_floor")
    out = transforms.clr_plus_one(out, n).withColumnRenamed("clr", "clr_one")
    out = transforms.clr_replaced(out, n).withColumnRenamed("clr", "clr_replaced")
    return out.select("sample", "feature", *[F.round(x, 6).alias(x) for x in ("clr_floor", "clr_one", "clr_replaced")])


@query("SELECT p_partkey, round((p_retailprice - (SELECT min(p_retailprice) FROM part)) / ((SELECT max(p_retailprice) FROM part) - (SELECT min(p_retailprice) FROM part)), 6) AS scaled, round((p_size - avg(p_size) OVER (PARTITION BY p_brand)) / stddev_pop(p_size) OVER (PARTITION BY p_brand), 6) AS z FROM part")
def mth10_mth12_scaling(spark, d):
    out = transforms.z_scores(transforms.min_max(load(spark, d, "part"), "p_retailprice", "scaled"), "p_size", "z", ["p_brand"])
    return out.select("p_partkey", F.round("scaled", 6).alias("scaled"), F.round("z", 6).alias("z"))


@query(f"{C}, u AS (SELECT count(DISTINCT sample)::DOUBLE AS n FROM c), s AS (SELECT feature, count(DISTINCT sample) / max(n) AS prevalence, sum(count) / max(n) AS abundance FROM c, u GROUP BY 1), q AS (SELECT quantile_cont(abundance, 0.3333) AS a, quantile_cont(abundance, 0.6667) AS b FROM s) SELECT feature, CASE WHEN prevalence <= 0.2 THEN 'low' WHEN prevalence <= 0.5 THEN 'medium' ELSE 'high' END AS prevalence_class, CASE WHEN abundance <= a THEN 'low' WHEN abundance <= b THEN 'medium' ELSE 'high' END AS abundance_class FROM s, q")
def mth11_classes(spark, d):
    c = counts(spark, d)
    n = c.select("sample").distinct().count()
    s = c.groupBy("feature").agg((F.countDistinct("sample") / n).alias("prevalence"), (F.sum("count") / n).alias("abundance"))
    q = s.agg(F.percentile("abundance", 0.3333).alias("a"), F.percentile("abundance", 0.6667).alias("b"))
    x = F.col("abundance")
    return s.crossJoin(F.broadcast(q)).select("feature", transforms.prevalence_class(F.col("prevalence")).alias("prevalence_class"), F.when(x <= F.col("a"), "low").when(x <= F.col("b"), "medium").otherwise("high").alias("abundance_class"))


@query("SELECT doc_id, coalesce(quality, -1) AS quality, CASE WHEN toxic = 1 THEN 'toxic' WHEN toxic = 0 THEN 'clean' ELSE 'unknown' END AS label FROM documents LEFT JOIN labels USING (doc_id)")
def nul1_cnd1_defaults(spark, d):
    rows = load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean").otherwise("unknown").alias("label"))


@query("WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents) SELECT doc_id, array_to_string(w[1:3], ' ') AS head, list_contains(w, 'the') AS has_the, len(w) AS n FROM w")
def arr1_lists(spark, d):
    w = load(spark, d, "documents").select("doc_id", F.split("text", " ").alias("w"))
    return w.select("doc_id", F.array_join(F.slice("w", 1, 3), " ").alias("head"), F.array_contains("w", "the").alias("has_the"), F.size("w").cast("bigint").alias("n"))
