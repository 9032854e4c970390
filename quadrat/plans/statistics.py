"""Rank tests, effect sizes, correlations and multiple testing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.transforms import relative
from ..operators import diversity, stats
from ..sources.study import PATIENTS_SQL, counts, counts_sql, load, patients
from .ecology import SHANNON, _rounded
from .registry import Registry
from .relational import TYPES

query = Registry()
CB, CT = (f"WITH {counts_sql(level)}" for level in ("brand", "type"))


def rank_sql(table: str, by: str, value: str, name: str) -> str:
    """Average ranks as an expression that adds ``rk``."""
    return f"{name} AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY {value}) + (count(*) OVER (PARTITION BY {by}, {value}) - 1) / 2.0::DOUBLE AS rk FROM {table})"


_PF = f"""WITH {counts_sql('brand')}, {PATIENTS_SQL}, s AS (SELECT patient, feature, sum(count) AS count FROM c GROUP BY ALL), x AS (SELECT patient, feature, count / sum(count) OVER (PARTITION BY patient)::DOUBLE AS p FROM s), v AS (SELECT x.*, "case" AS grp FROM x JOIN pt USING (patient))"""
_MW = f"""{rank_sql('v', 'feature', 'p', 'rv')}, ti AS (SELECT feature, sum(t * t * t - t)::DOUBLE AS tie FROM (SELECT feature, p, count(*)::DOUBLE AS t FROM v GROUP BY ALL) GROUP BY 1),
 sm AS (SELECT feature, sum(rk) FILTER (WHERE grp = 'Cancer') AS r1, count(*) FILTER (WHERE grp = 'Cancer') AS n1, count(*) FILTER (WHERE grp <> 'Cancer') AS n2 FROM rv GROUP BY 1),
 mu AS (SELECT feature, n1, n2, r1 - n1 * (n1 + 1) / 2.0::DOUBLE AS u, n1 * n2 / 12.0::DOUBLE * ((n1 + n2 + 1) - tie / ((n1 + n2) * (n1 + n2 - 1))) AS var FROM sm JOIN ti USING (feature)),
 mw AS (SELECT feature, n1, n2, u, greatest(abs(u - n1 * n2 / 2.0::DOUBLE) - 0.5, 0) / sqrt(var) AS z, 2 * u / (n1 * n2) - 1 AS rank_biserial FROM mu)"""


def _patient_values(spark, d):
    s = diversity.summed_profile(counts(spark, d, "brand"), ["patient"])
    return s.join(F.broadcast(patients(spark, d)), "patient").select("patient", "feature", "p", F.col("case").alias("grp"))


@query(f"{_PF}, {_MW} SELECT feature, n1, n2, round(u, 6) AS u, round(z, 6) AS z, round(rank_biserial, 6) AS rank_biserial FROM mw")
def sta1_sta7_win4_mann_whitney(spark, d):
    return _rounded(stats.mann_whitney(_patient_values(spark, d), ["feature"], "grp", "Cancer", "p"))


def tail_sql(z: str) -> str:
    """SQL of stats.normal_tail2: the error function as a series of positive terms."""
    return f"(1 - exp(-({z}) * ({z}) / 2) * list_sum(list_transform(range(0, 120), lambda i: pow(abs({z}) / sqrt(2.0::DOUBLE), 2 * i + 1) / gamma(i + 1.5))))"


def bh_sql(table: str, name: str, family: str = "", order: str = "feature") -> str:
    """SQL of stats.benjamini_hochberg of the column p as the expression ``name``."""
    part = f"PARTITION BY {family}" if family else ""
    return f"""{name}_k AS (SELECT *, row_number() OVER ({part} ORDER BY p, {order}) AS bk, count(*) OVER ({part}) AS bm FROM {table}),
 {name} AS (SELECT * EXCLUDE (bk, bm), least(min(p * bm / bk) OVER ({part} ORDER BY bk DESC ROWS UNBOUNDED PRECEDING), 1) AS q FROM {name}_k)"""


@query(f"{_PF}, {_MW}, pm AS (SELECT *, {tail_sql('z')} AS p FROM mw), {bh_sql('pm', 'bh')} SELECT feature, n1, n2, round(u, 6) AS u, round(z, 6) AS z, round(rank_biserial, 6) AS rank_biserial, round(p, 6) AS p, round(q, 6) AS q FROM bh")
def sta1_sta9_mann_whitney_fdr(spark, d):
    """The same with two-sided normal p and BH q."""
    found = stats.mann_whitney(_patient_values(spark, d), ["feature"], "grp", "Cancer", "p").withColumn("p", stats.normal_tail2("z"))
    return _rounded(stats.benjamini_hochberg(found, "p", [], ["feature"]))


_PAIR = f"""{CT}, {SHANNON.replace('sh AS', 'shx AS')}, pr AS (SELECT a.patient, a.sample_type AS g1, b.sample_type AS g2, a.shannon AS x, b.shannon AS y FROM shx a JOIN shx b ON a.patient = b.patient AND a.sample_type < b.sample_type),
 df AS (SELECT g1, g2, round(x - y, 12) AS d, abs(round(x - y, 12)) AS m FROM pr WHERE round(x - y, 12) <> 0), {rank_sql('df', 'g1, g2', 'm', 'rd')}, ti AS (SELECT g1, g2, sum(t * t * t - t)::DOUBLE AS tie FROM (SELECT g1, g2, m, count(*)::DOUBLE AS t FROM df GROUP BY ALL) GROUP BY ALL),
 sm AS (SELECT g1, g2, count(*) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN rk ELSE 0 END) AS w_minus FROM rd GROUP BY ALL)"""


@query(f"{_PAIR} SELECT g1, g2, n, w_plus, w_minus, least(w_plus, w_minus) AS statistic, round((least(w_plus, w_minus) - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - tie / 48), 6) AS z FROM sm JOIN ti USING (g1, g2)")
def sta2_wilcoxon_paired(spark, d):
    s = diversity.shannon(counts(spark, d, "type"), ["patient", "sample_type"])
    a, b = s.toDF("patient", "g1", "x"), s.toDF("patient", "g2", "y")
    return _rounded(stats.wilcoxon_signed(a.join(b, "patient").where("g1 < g2"), ["g1", "g2"], "x", "y"))


@query(f"""{CT}, f AS (SELECT feature, patient, sample_type, count FROM c ), ok AS (SELECT feature, patient FROM f GROUP BY ALL HAVING count(DISTINCT sample_type) = 5), g AS (SELECT f.* FROM f SEMI JOIN ok USING (feature, patient)), {rank_sql('g', 'feature, patient', 'count', 'rg')},
 ti AS (SELECT feature, sum(t * t * t - t)::DOUBLE AS tie FROM (SELECT feature, patient, count, count(*)::DOUBLE AS t FROM g GROUP BY ALL) GROUP BY 1), sm AS (SELECT feature, sum(r * r) AS rr, max(n) AS n FROM (SELECT feature, sample_type, sum(rk) AS r, count(*) AS n FROM rg GROUP BY ALL) GROUP BY 1), q AS (SELECT feature, n, (12 * rr / (n * 5 * 6.0::DOUBLE) - 3 * n * 6) / (1 - tie / (n * 5 * 24.0::DOUBLE)) AS chi2 FROM sm JOIN ti USING (feature)) SELECT feature, n, round(chi2, 6) AS chi2, round(exp(-chi2 / 2) * (1 + chi2 / 2), 6) AS p FROM q""")
def sta3_friedman(spark, d):
    found = stats.friedman(counts(spark, d, "type"), ["feature"], "patient", "sample_type", "count", TYPES)
    return _rounded(found.withColumn("p", stats.chi2_tail(F.col("chi2"), 4)))


@query(f"""{CB}, {rank_sql('c', 'feature', 'count', 'rc')}, ti AS (SELECT feature, sum(t * t * t - t)::DOUBLE AS tie FROM (SELECT feature, count, count(*)::DOUBLE AS t FROM c GROUP BY ALL) GROUP BY 1), pg AS (SELECT feature, sample_type, sum(rk) AS r, count(*)::DOUBLE AS m, avg(count) AS mean FROM rc GROUP BY ALL), sm AS (SELECT feature, sum(r * r / m) AS q, sum(m) AS n, arg_min(sample_type, (-mean, sample_type)) AS best_group, max(mean) - min(mean) AS mean_range FROM pg GROUP BY 1), hh AS (SELECT feature, (12 * q / (n * (n + 1)) - 3 * (n + 1)) / (1 - tie / (n * n * n - n)) AS h, best_group, mean_range FROM sm JOIN ti USING (feature)) SELECT feature, round(h, 6) AS h, round(exp(-h / 2) * (1 + h / 2), 6) AS p, best_group, round(mean_range, 6) AS mean_range FROM hh""")
def sta4_kruskal(spark, d):
    found = stats.kruskal(counts(spark, d, "brand"), ["feature"], "sample_type", "count")
    return _rounded(found.withColumn("p", stats.chi2_tail(F.col("h"), len(TYPES) - 1)))


_MOM = """mo AS (SELECT feature, count(*) FILTER (WHERE grp = 'Cancer') AS n1, count(*) FILTER (WHERE grp <> 'Cancer') AS n2, avg(p) FILTER (WHERE grp = 'Cancer') AS m1, avg(p) FILTER (WHERE grp <> 'Cancer') AS m2, var_samp(p) FILTER (WHERE grp = 'Cancer') AS v1, var_samp(p) FILTER (WHERE grp <> 'Cancer') AS v2, var_pop(p) FILTER (WHERE grp = 'Cancer') AS w1, var_pop(p) FILTER (WHERE grp <> 'Cancer') AS w2, median(p) FILTER (WHERE grp = 'Cancer') - median(p) FILTER (WHERE grp <> 'Cancer') AS dm FROM v GROUP BY 1)"""


@query(f"{_PF}, {_MOM} SELECT feature, n1, n2, round(m1, 8) AS mean1, round(m2, 8) AS mean2, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)), 5) AS t, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 5) AS cohens_d, round((m1 - m2) / sqrt((w1 + w2) / 2), 5) AS d_population, round(dm, 8) AS delta_median FROM mo")
def sta5_sta6_moments(spark, d):
    v = _patient_values(spark, d)
    own = stats.two_sample_moments(v, ["feature"], "grp", "Cancer", "p")
    other = stats.two_sample_moments(v, ["feature"], "grp", "Cancer", "p", 0).select("feature", F.col("cohens_d").alias("d_population"))
    out = own.join(other, "feature")
    return out.withColumns({**{c: F.round(c, 8) for c in ("mean1", "mean2", "delta_median")}, **{c: F.round(c, 5) for c in ("t", "cohens_d", "d_population")}})


_T_SQL = "(m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2))"


@query(f"{_PF}, {_MOM}, st AS (SELECT feature, n1, n2, {_T_SQL} AS t, n1 + n2 - 2 AS df FROM mo), an AS (SELECT *, atan(abs(t) / sqrt(df)) AS w FROM st) SELECT feature, n1, n2, round(t, 5) AS t, round(CASE WHEN df % 2 = 1 THEN 1 - 2 / pi() * (w + sin(w) * list_sum(list_transform(range(0, (df - 1) // 2), lambda j: exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)) * pow(cos(w), 2 * j + 1)))) ELSE 1 - sin(w) * list_sum(list_transform(range(0, df // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)) * pow(cos(w), 2 * j))) END, 6) AS p FROM an")
def sta5_t_test(spark, d):
    """Student's test; the SQL holds the series for odd and even degrees of freedom."""
    found = stats.t_test(_patient_values(spark, d), ["feature"], "grp", "Cancer", "p")
    return found.select("feature", "n1", "n2", F.round("t", 5).alias("t"), F.round("p", 6).alias("p"))


@query(f"{_PF}, {_MOM}, st AS (SELECT feature, n1, n2, {_T_SQL} AS t, n1 + n2 - 2 AS df FROM mo), an AS (SELECT *, atan(abs(t) / sqrt(df)) AS w FROM st), pv AS (SELECT feature, round(CASE WHEN df % 2 = 1 THEN 1 - 2 / pi() * (w + sin(w) * list_sum(list_transform(range(0, (df - 1) // 2), lambda j: exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)) * pow(cos(w), 2 * j + 1)))) ELSE 1 - sin(w) * list_sum(list_transform(range(0, df // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)) * pow(cos(w), 2 * j))) END, 9) AS p FROM an), rk AS (SELECT *, row_number() OVER (ORDER BY p, feature) AS k, count(*) OVER () AS m FROM pv) SELECT feature, round(p, 6) AS p, round(least(min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 1), 6) AS q FROM rk")
def sta9_agg25_benjamini_hochberg(spark, d):
    """Adjusted p of Student's test over all features."""
    found = stats.t_test(_patient_values(spark, d), ["feature"], "grp", "Cancer", "p")
    return _rounded(stats.benjamini_hochberg(found.select("feature", F.round("p", 9).alias("p")), "p", [], ["feature"]))


_LONG = f"""{CT}, lt AS (SELECT patient AS unit, feature AS id, sum(count)::DOUBLE AS value FROM c GROUP BY ALL), ls AS (SELECT patient AS unit, sample_type AS id, sum(count)::DOUBLE AS value FROM c GROUP BY ALL)"""


def _long(spark, d, key):
    return counts(spark, d, "type").groupBy(F.col("patient").alias("unit"), F.col(key).alias("id")).agg(F.sum("count").cast("double").alias("value"))


@query(f"{_LONG}, b AS (SELECT unit, lt.id AS id1, ls.id AS id2, lt.value AS v1, ls.value AS v2 FROM lt JOIN ls USING (unit)), r AS (SELECT *, rank() OVER (PARTITION BY id1, id2 ORDER BY v1) + (count(*) OVER (PARTITION BY id1, id2, v1) - 1) / 2.0::DOUBLE AS r1, rank() OVER (PARTITION BY id1, id2 ORDER BY v2) + (count(*) OVER (PARTITION BY id1, id2, v2) - 1) / 2.0::DOUBLE AS r2 FROM b) SELECT id1, id2, count(*) AS n, round(corr(r1, r2), 6) AS rho FROM r GROUP BY ALL")
def sta10_spearman(spark, d):
    return _rounded(stats.spearman(_long(spark, d, "feature"), _long(spark, d, "sample_type")))


@query(f"{_LONG} SELECT a.id AS id1, b.id AS id2, round(corr(a.value, b.value), 6) AS r FROM lt a JOIN lt b ON a.unit = b.unit AND a.id < b.id GROUP BY ALL")
def sta11_sta13_pearson_pairs(spark, d):
    return _rounded(stats.pearson_pairs(_long(spark, d, "feature")))


@query(f"{_LONG.replace('WITH', 'WITH RECURSIVE', 1)}, cr AS (SELECT a.id AS id1, b.id AS id2, abs(corr(a.value, b.value)) AS r FROM lt a JOIN lt b ON a.unit = b.unit AND a.id < b.id GROUP BY ALL), od AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM (SELECT DISTINCT id FROM lt)), gr AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS kept UNION ALL SELECT od.k, CASE WHEN EXISTS (SELECT 1 FROM cr WHERE id2 = od.id AND r > 0.9 AND list_contains(gr.kept, id1)) THEN gr.kept ELSE list_append(gr.kept, od.id) END FROM gr JOIN od ON od.k = gr.k + 1), ke AS (SELECT unnest(kept) AS id FROM gr WHERE k = (SELECT max(k) FROM od)), bo AS (SELECT id1 AS id, id2 AS other, r FROM cr UNION ALL SELECT id2, id1, r FROM cr), bs AS (SELECT bo.id, arg_min(other, (-r, other)) AS rep FROM bo JOIN ke ON ke.id = other WHERE r > 0.9 GROUP BY 1) SELECT od.id, CASE WHEN ke.id IS NOT NULL THEN od.id ELSE rep END AS representative FROM od LEFT JOIN ke ON ke.id = od.id LEFT JOIN bs ON bs.id = od.id")
def sta11_representatives(spark, d):
    """Correlated columns reduced to representatives."""
    long = _long(spark, d, "feature")
    return stats.representatives(stats.pearson_pairs(long), long.select("id"), 0.9)


@query(f"{_LONG} SELECT a.unit AS unit1, b.unit AS unit2, round(corr(a.value, b.value), 6) AS r FROM lt a JOIN lt b ON a.id = b.id AND a.unit < b.unit GROUP BY ALL HAVING corr(a.value, b.value) >= 0.5")
def sta13_similar_patients(spark, d):
    """Patients whose vectors of values correlate at 0.5 or more."""
    turned = _long(spark, d, "feature").select(F.col("id").alias("unit"), F.col("unit").alias("id"), "value")
    return _rounded(stats.pearson_pairs(turned).where("r >= 0.5").select(F.col("id1").alias("unit1"), F.col("id2").alias("unit2"), "r"))


@query(f"{CT}, b AS (SELECT feature, sample_type, avg(count) AS mb, stddev_pop(count) AS sb FROM c GROUP BY ALL), f AS (SELECT feature, avg(count) AS mf, stddev_pop(count) AS sf FROM c GROUP BY 1) SELECT sample, c.feature, round((count - mb) / sb * sf + mf, 5) AS adjusted FROM c JOIN b ON b.feature = c.feature AND b.sample_type = c.sample_type JOIN f ON f.feature = c.feature")
def sta14_batch_adjustment(spark, d):
    return stats.batch_adjusted(counts(spark, d, "type"), "sample_type", "feature", "count").select("sample", "feature", F.round("adjusted", 5).alias("adjusted"))


@query(f"WITH {counts_sql('brand')}, r AS (SELECT sample_type, sample, feature, count / sum(count) OVER (PARTITION BY sample)::DOUBLE AS p FROM c), s AS (SELECT sample_type, feature, median(p) AS med, max(p) AS top FROM r GROUP BY ALL) SELECT sample_type, feature, round(med, 8) AS med, round(top, 8) AS top, CASE WHEN top > 0.05 THEN 'major' ELSE 'minor' END AS class FROM s")
def tidy_taxa_by_type(spark, d):
    """The table behind the abundance figures: medians, maxima and the split by maximum."""
    s = relative(counts(spark, d, "brand")).groupBy("sample_type", "feature").agg(F.median("p").alias("med"), F.max("p").alias("top"))
    return s.select("sample_type", "feature", F.round("med", 8).alias("med"), F.round("top", 8).alias("top"), F.when(F.col("top") > 0.05, "major").otherwise("minor").alias("class"))


@query("SELECT lang, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def tidy_labels_by_language(spark, d):
    return load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id").groupBy("lang", "quality").agg(F.count(F.lit(1)).alias("n"))
