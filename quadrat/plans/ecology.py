"""Diversity, distances, profiles, permutation tests, indicators and accumulation curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.transforms import rclr, relative
from ..operators import distance, diversity, isa, permute
from ..sources.study import PATIENTS_SQL, TAXONOMY_SQL, counts, counts_sql, patients, taxonomy
from ..streaming.checkpoints import cut
from .registry import Registry
from .relational import TYPES

query = Registry()
C, CB, CT = (f"WITH {counts_sql(level)}" for level in ("part", "brand", "type"))
REPS = 199


def _rounded(df, digits=6, skip=()):
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double" and c not in skip})


def permuted_sql(units: str, unit: str, label: str, reps: int, block: str | None = None, seed: str = "1") -> str:
    """SQL of permute.permuted_labels as the expressions ``pl`` (rep, unit, label)."""
    part = f"PARTITION BY {block}" if block else ""
    by = f", {block}" if block else ""
    return f"""own AS (SELECT {label}{by}, row_number() OVER ({part} ORDER BY {unit}) AS k FROM {units}),
 places AS (SELECT rep, {unit}{by}, row_number() OVER (PARTITION BY rep{by} ORDER BY md5('{seed}|' || rep || '|' || {unit}), {unit}) AS k FROM {units}, (SELECT unnest(range(1, {reps + 1}))::INTEGER AS rep)),
 pl AS (SELECT 0 AS rep, {unit}, {label} FROM {units} UNION ALL SELECT rep, {unit}, own.{label} FROM places JOIN own USING (k{by}))"""


def r2_sql(pairs: str, unit: str, label: str, labels: str = "pl") -> str:
    """SQL of permute.r_squared as the expression ``r2`` (rep, r2, n, k, pseudo_f)."""
    return f"""sz AS (SELECT rep, {label} AS g, count(*) AS size FROM {labels} GROUP BY ALL), wh AS (SELECT rep, CAST(sum(size) AS BIGINT) AS n, count(*) AS k FROM sz GROUP BY 1),
 ss AS (SELECT a.rep, CASE WHEN a.{label} = b.{label} THEN a.{label} END AS g, sum(dist * dist) AS s FROM {pairs} p JOIN {labels} a ON p.id1 = a.{unit} JOIN {labels} b ON p.id2 = b.{unit} AND a.rep = b.rep GROUP BY ALL),
 wi AS (SELECT ss.rep, sum(s / size) AS within, sum(s) AS s FROM ss LEFT JOIN sz ON ss.rep = sz.rep AND ss.g = sz.g GROUP BY 1),
 r0 AS (SELECT rep, 1 - coalesce(within, 0) / (s / n) AS r2, n, k FROM wi JOIN wh USING (rep)), r2 AS (SELECT *, (r2 / (k - 1)) / ((1 - r2) / (n - k)) AS pseudo_f FROM r0)"""


P_SQL = "(SELECT (1 + count(*) FILTER (WHERE rep > 0 AND round(r2, 9) >= (SELECT round(r2, 9) FROM r2 WHERE rep = 0))) / (count(*) FILTER (WHERE rep > 0) + 1.0) FROM r2)::DOUBLE"
PERM_OUT = f"SELECT round(r2, 6) AS r2, round(pseudo_f, 4) AS pseudo_f, n, k, round({P_SQL}, 6) AS p FROM r2 WHERE rep = 0"


def bray_sql(table: str, unit: str, value: str) -> str:
    """SQL of distance.bray_curtis as the expression ``bc`` (id1, id2, dist)."""
    return f"""tt AS (SELECT {unit} AS u, sum({value}) AS t FROM {table} GROUP BY 1), cm AS (SELECT a.{unit} AS id1, b.{unit} AS id2, sum(least(a.{value}, b.{value})) AS common FROM {table} a JOIN {table} b ON a.feature = b.feature AND a.{unit} < b.{unit} GROUP BY ALL),
 bc AS (SELECT x.u AS id1, y.u AS id2, CASE WHEN x.t + y.t > 0 THEN 1 - 2.0::DOUBLE * coalesce(common, 0) / (x.t + y.t) ELSE 0 END AS dist FROM tt x JOIN tt y ON x.u < y.u LEFT JOIN cm ON cm.id1 = x.u AND cm.id2 = y.u)"""


SHANNON = "sh AS (SELECT patient, sample_type, sample, ln(sum(count)::DOUBLE) - sum(count * ln(count)) / sum(count) AS shannon FROM c WHERE count > 0 GROUP BY ALL)"


@query(f"{C}, {SHANNON} SELECT sample, round(shannon, 6) AS shannon, round(shannon / ln(2), 6) AS shannon2 FROM sh")
def div1_shannon(spark, d):
    s = diversity.shannon(counts(spark, d), ["sample"])
    return s.select("sample", F.round("shannon", 6).alias("shannon"), F.round(F.col("shannon") / F.log(F.lit(2.0)), 6).alias("shannon2"))


@query(f"{C}, {SHANNON} SELECT patient, sample_type, round(avg(shannon), 6) AS shannon FROM sh GROUP BY ALL")
def div2_patient_shannon(spark, d):
    s = diversity.shannon(counts(spark, d), ["patient", "sample_type", "sample"])
    return s.groupBy("patient", "sample_type").agg(F.round(F.avg("shannon"), 6).alias("shannon"))


@query(f"{C} SELECT sample, round(sum(count)::DOUBLE * sum(count) / sum(count::DOUBLE * count), 6) AS hill, round(var_samp(count), 6) AS variance FROM c GROUP BY 1")
def div3_div5_hill_and_variance(spark, d):
    c = counts(spark, d)
    return _rounded(diversity.hill2(c, ["sample"]).join(c.groupBy("sample").agg(F.var_samp("count").alias("variance")), "sample"))


@query(f"{C}, k AS (SELECT count(DISTINCT feature) AS n FROM c), r AS (SELECT sample, count, row_number() OVER (PARTITION BY sample ORDER BY count, feature) + n - count(*) OVER (PARTITION BY sample) AS i, n FROM c, k) SELECT sample, round(2.0::DOUBLE * sum(i * count) / (max(n) * sum(count)) - (max(n) + 1) / max(n)::DOUBLE, 6) AS gini FROM r GROUP BY 1")
def div4_gini(spark, d):
    c = counts(spark, d)
    return _rounded(diversity.gini(c, c.select("feature").distinct().count()))


@query(f"{C}, u AS (SELECT DISTINCT sample_type, sample FROM c), o AS (SELECT *, row_number() OVER (PARTITION BY rep, sample_type ORDER BY md5('1|' || rep || '|' || sample), sample) AS k FROM u, (SELECT unnest(range(1, 21))::INTEGER AS rep)), f AS (SELECT c.sample_type, rep, feature, min(k) AS k FROM (SELECT DISTINCT sample_type, sample, feature FROM c) c JOIN o USING (sample_type, sample) GROUP BY ALL), n AS (SELECT sample_type, rep, k, count(*) AS new FROM f GROUP BY ALL), s AS (SELECT sample_type, rep, k, sum(coalesce(new, 0)) OVER (PARTITION BY sample_type, rep ORDER BY k) AS seen FROM o LEFT JOIN n USING (sample_type, rep, k)) SELECT sample_type, k, round(avg(seen), 6) AS mean, round(quantile_cont(seen::DOUBLE, 0.025), 6) AS low, round(quantile_cont(seen::DOUBLE, 0.975), 6) AS high FROM s GROUP BY ALL")
def div6_collectors_curve(spark, d):
    return _rounded(diversity.accumulation(counts(spark, d), "sample_type", 20))


@query(f"{C}, {bray_sql('c', 'sample', 'count')} SELECT id1, id2, round(dist, 6) AS dist FROM bc")
def dst1_bray_curtis(spark, d):
    return _rounded(distance.bray_curtis(counts(spark, d)))


@query(f"{C}, n AS (SELECT sample, count(*) AS n FROM c WHERE count > 10 GROUP BY 1), a AS (SELECT DISTINCT sample FROM c), s AS (SELECT x.sample AS id1, y.sample AS id2, count(*) AS shared FROM c x JOIN c y ON x.feature = y.feature AND x.sample < y.sample AND x.count > 10 AND y.count > 10 GROUP BY ALL) SELECT x.sample AS id1, y.sample AS id2, coalesce(shared, 0) AS shared, round(1 - coalesce(shared, 0) / (n1.n + n2.n - coalesce(shared, 0))::DOUBLE, 6) AS dist, round(100.0 * coalesce(shared, 0) / (n1.n + n2.n - coalesce(shared, 0)), 6) AS percent FROM a x JOIN a y ON x.sample < y.sample JOIN n n1 ON n1.sample = x.sample JOIN n n2 ON n2.sample = y.sample LEFT JOIN s ON s.id1 = x.sample AND s.id2 = y.sample")
def dst2_dst4_jn12_jaccard_and_percent(spark, d):
    j = distance.jaccard(counts(spark, d), above=10)
    return _rounded(j.withColumn("percent", 100 * (1 - F.col("dist"))))


@query(f"{CB}, r AS (SELECT sample, feature, ln(count) - avg(ln(count)) OVER (PARTITION BY sample) AS v FROM c), q AS (SELECT sample, sum(v * v) AS q FROM r GROUP BY 1), dt AS (SELECT a.sample AS id1, b.sample AS id2, sum(a.v * b.v) AS dot FROM r a JOIN r b ON a.feature = b.feature AND a.sample < b.sample GROUP BY ALL) SELECT x.sample AS id1, y.sample AS id2, round(sqrt(greatest(x.q + y.q - 2 * coalesce(dot, 0), 0)), 5) AS dist FROM q x JOIN q y ON x.sample < y.sample LEFT JOIN dt ON dt.id1 = x.sample AND dt.id2 = y.sample")
def dst3_euclidean_on_rclr(spark, d):
    r = rclr(relative(counts(spark, d, "brand")))
    return _rounded(distance.euclidean(r, "sample", "rclr"), 5)


_LABELS = "lb AS (SELECT DISTINCT sample, patient, sample_type FROM c)"


@query(f"{CB}, {bray_sql('c', 'sample', 'count')}, {_LABELS} SELECT least(a.sample_type, b.sample_type) || ' vs ' || greatest(a.sample_type, b.sample_type) AS label, a.patient = b.patient AS same_patient, count(*) AS n, round(avg(dist), 6) AS mean FROM bc JOIN lb a ON id1 = a.sample JOIN lb b ON id2 = b.sample GROUP BY ALL")
def dst5_dst6_labelled_pairs(spark, d):
    c = counts(spark, d, "brand")
    pairs = distance.labelled(distance.bray_curtis(c), c.select("sample", "patient", "sample_type").distinct(), "sample", ["patient", "sample_type"])
    label = F.concat(F.least("sample_type_1", "sample_type_2"), F.lit(" vs "), F.greatest("sample_type_1", "sample_type_2"))
    return _rounded(pairs.groupBy(label.alias("label"), (F.col("patient_1") == F.col("patient_2")).alias("same_patient")).agg(F.count(F.lit(1)).alias("n"), F.avg("dist").alias("mean")))


@query(f"{CB}, t AS (SELECT sample_type AS id, patient AS feature, sum(count)::DOUBLE AS value FROM c GROUP BY ALL), b AS (SELECT feature AS id, patient AS feature, sum(count)::DOUBLE AS value FROM c GROUP BY ALL), dt AS (SELECT t.id AS id1, b.id AS id2, sum(t.value * b.value) AS dot FROM t JOIN b ON t.feature = b.feature GROUP BY ALL), nt AS (SELECT id, sqrt(sum(value * value)) AS n FROM t GROUP BY 1), nb AS (SELECT id, sqrt(sum(value * value)) AS n FROM b GROUP BY 1) SELECT id1, id2, round(dot / (nt.n * nb.n), 6) AS cosine FROM dt JOIN nt ON nt.id = id1 JOIN nb ON nb.id = id2 WHERE abs(dot / (nt.n * nb.n)) >= 0.7")
def dst7_cosine(spark, d):
    c = counts(spark, d, "brand")
    long = lambda key: c.groupBy(F.col(key).alias("id"), F.col("patient").alias("feature2")).agg(F.sum("count").cast("double").alias("value")).withColumnRenamed("feature2", "feature")
    return _rounded(distance.cosine_between(long("sample_type"), long("feature"), 0.7))


_PROFILE = "rl AS (SELECT *, count / sum(count) OVER (PARTITION BY sample)::DOUBLE AS p FROM c)"


@query(f"{CB}, {_PROFILE}, n AS (SELECT patient, count(DISTINCT sample) AS n FROM c GROUP BY 1) SELECT patient, feature, round(sum(p) / max(n), 9) AS p FROM rl JOIN n USING (patient) GROUP BY ALL")
def pro1_agg2_mean_relative_profile(spark, d):
    return _rounded(diversity.mean_relative_profile(counts(spark, d, "brand"), ["patient"]), 9)


@query(f"{CB}, s AS (SELECT patient, feature, CAST(sum(count) AS BIGINT) AS count FROM c GROUP BY ALL) SELECT patient, feature, count, round(count / sum(count) OVER (PARTITION BY patient)::DOUBLE, 9) AS p FROM s")
def pro2_summed_profile(spark, d):
    return _rounded(diversity.summed_profile(counts(spark, d, "brand"), ["patient"]), 9)


@query(f"WITH {counts_sql()}, {TAXONOMY_SQL}, n AS (SELECT feature, nullif(regexp_extract(taxon, 'p__([^;]*)', 1), '') AS phylum FROM tx), g AS (SELECT sample, phylum, CAST(sum(count) AS BIGINT) AS count FROM c JOIN n USING (feature) WHERE phylum IS NOT NULL GROUP BY ALL) SELECT sample, phylum, count, round(count / sum(count) OVER (PARTITION BY sample)::DOUBLE, 9) AS p FROM g")
def pro3_taxon_profile(spark, d):
    from ..functions.text import rank_name

    named = taxonomy(spark, d).select("feature", rank_name(F.col("taxon"), "phylum").alias("phylum"))
    return _rounded(relative(diversity.by_taxon(counts(spark, d), named, "phylum")), 9)


@query(f"{CB}, m AS (SELECT feature, sample_type, avg(count) AS m FROM c WHERE sample_type IN ('4-NOT SPECIFIED', '5-LOW') AND count > 0 GROUP BY ALL), b AS (SELECT feature, sum(m) / 4 AS b FROM m GROUP BY 1) SELECT sample, feature, CAST(floor(greatest(count - coalesce(b, 0), 0)) AS BIGINT) AS corrected FROM (SELECT c.sample, c.feature, c.count * 4 AS count, b.b * 4 AS b FROM c LEFT JOIN b USING (feature) WHERE sample_type NOT IN ('4-NOT SPECIFIED', '5-LOW'))")
def pro4_control_correction(spark, d):
    """Counts of the kept groups are raised fourfold first, so that something is left after the subtraction."""
    c = counts(spark, d, "brand")
    raised = c.withColumn("count", F.when(F.col("sample_type").isin("4-NOT SPECIFIED", "5-LOW"), F.col("count")).otherwise(F.col("count") * 4))
    return diversity.control_corrected(raised, "sample_type", ["4-NOT SPECIFIED", "5-LOW"]).select("sample", "feature", "corrected")


_UNITS = f"{CB}, {bray_sql('c', 'sample', 'count')}, us AS (SELECT DISTINCT sample, patient, sample_type FROM c)"


def _units(c):
    return c.select("sample", "patient", "sample_type").distinct()


@query(f"{_UNITS}, {permuted_sql('us', 'sample', 'sample_type', REPS)}, {r2_sql('bc', 'sample', 'sample_type')} {PERM_OUT}")
def prm1_prm2_prm5_permanova(spark, d):
    c = counts(spark, d, "brand")
    pairs = permute_pairs(distance.bray_curtis(c))
    return _rounded(permute.permanova(pairs, _units(c), "sample", "sample_type", REPS)).withColumn("pseudo_f", F.round("pseudo_f", 4))


def permute_pairs(pairs):
    """Pairs are read by every repetition, so they are written once; they are few against the counts behind them."""
    return cut(pairs)


@query(f"{_UNITS}, {permuted_sql('us', 'sample', 'sample_type', REPS, 'patient')}, {r2_sql('bc', 'sample', 'sample_type')} {PERM_OUT}")
def prm3_win9_blocked_permanova(spark, d):
    c = counts(spark, d, "brand")
    return _rounded(permute.permanova(permute_pairs(distance.bray_curtis(c)), _units(c), "sample", "sample_type", REPS, "patient")).withColumn("pseudo_f", F.round("pseudo_f", 4))


@query(f"""WITH {counts_sql('brand')}, {PATIENTS_SQL}, s AS (SELECT patient, feature, sum(count) AS count FROM c GROUP BY ALL), {bray_sql('s', 'patient', 'count')}, us AS (SELECT patient, "case" AS grp FROM pt), {permuted_sql('us', 'patient', 'grp', REPS)}, {r2_sql('bc', 'patient', 'grp')} {PERM_OUT}""")
def prm6_patient_permanova(spark, d):
    """Cases are permuted over patients, not over their samples."""
    s = counts(spark, d, "brand").groupBy("patient", "feature").agg(F.sum("count").alias("count"))
    units = patients(spark, d).select("patient", F.col("case").alias("grp"))
    return _rounded(permute.permanova(permute_pairs(distance.bray_curtis(s, "patient")), units, "patient", "grp", REPS)).withColumn("pseudo_f", F.round("pseudo_f", 4))


_PAIRWISE_SQL = f"""{_UNITS}, pr AS (SELECT a.t AS g1, b.t AS g2, a.t || ' vs ' || b.t AS pair FROM (SELECT DISTINCT sample_type AS t FROM us) a JOIN (SELECT DISTINCT sample_type AS t FROM us) b ON a.t < b.t),
 up AS (SELECT pair, sample, patient, sample_type FROM us JOIN pr ON sample_type IN (g1, g2)),
 own AS (SELECT pair, patient, sample_type, row_number() OVER (PARTITION BY pair, patient ORDER BY sample) AS k FROM up),
 places AS (SELECT rep, pair, patient, sample, row_number() OVER (PARTITION BY rep, pair, patient ORDER BY md5('1|' || rep || '|' || sample), sample) AS k FROM up, (SELECT unnest(range(1, {REPS + 1}))::INTEGER AS rep)),
 pl AS (SELECT pair, 0 AS rep, sample, sample_type FROM up UNION ALL SELECT pair, rep, sample, own.sample_type FROM places JOIN own USING (k, pair, patient)),
 sz AS (SELECT pair, rep, sample_type AS g, count(*) AS size FROM pl GROUP BY ALL), wh AS (SELECT pair, rep, sum(size) AS n FROM sz GROUP BY ALL),
 ss AS (SELECT a.pair, a.rep, CASE WHEN a.sample_type = b.sample_type THEN a.sample_type END AS g, sum(dist * dist) AS s FROM bc JOIN pl a ON id1 = a.sample JOIN pl b ON id2 = b.sample AND a.rep = b.rep AND a.pair = b.pair GROUP BY ALL),
 r2 AS (SELECT ss.pair, ss.rep, 1 - sum(s / size) / (sum(s) / max(n)) AS r2 FROM ss JOIN wh USING (pair, rep) LEFT JOIN sz ON sz.pair = ss.pair AND sz.rep = ss.rep AND sz.g = ss.g GROUP BY ALL),
 pv AS (SELECT a.pair, round(a.r2, 6) AS r2, (1 + count(*) FILTER (WHERE round(b.r2, 9) >= round(a.r2, 9))) / {REPS + 1}.0::DOUBLE AS p FROM r2 a JOIN r2 b ON a.pair = b.pair AND a.rep = 0 AND b.rep > 0 GROUP BY a.pair, a.r2),
 rk AS (SELECT *, row_number() OVER (ORDER BY p, pair) AS k, count(*) OVER () AS m FROM pv)
 SELECT pair, r2, round(p, 6) AS p, round(least(min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 1), 6) AS q FROM rk"""


@query(_PAIRWISE_SQL)
def prm4_win5_pairwise_blocked_permanova(spark, d):
    """One test for each pair of sample types, all as one plan: the pair is part of every key."""
    return _pairwise(spark, d, ["pair", "patient"])


@query(_PAIRWISE_SQL.replace("PARTITION BY pair, patient", "PARTITION BY pair").replace("PARTITION BY rep, pair, patient", "PARTITION BY rep, pair").replace("USING (k, pair, patient)", "USING (k, pair)"))
def prm5_pairwise_permanova(spark, d):
    """The same with labels permuted over all samples of a pair."""
    return _pairwise(spark, d, ["pair"])


def _pairwise(spark, d, block):
    from ..operators.stats import benjamini_hochberg

    c = counts(spark, d, "brand")
    pairs = permute_pairs(distance.bray_curtis(c))
    u = _units(c)
    kinds = u.select("sample_type").distinct()
    both = kinds.toDF("g1").join(kinds.toDF("g2"), F.col("g1") < F.col("g2")).withColumn("pair", F.concat_ws(" vs ", "g1", "g2"))
    rows = u.join(F.broadcast(both), (F.col("sample_type") == F.col("g1")) | (F.col("sample_type") == F.col("g2"))).select("pair", "sample", "patient", "sample_type")
    rows = rows.withColumn("block", F.concat_ws("|", *block))
    each = rows.crossJoin(F.broadcast(spark.range(1, REPS + 1).select(F.col("id").cast("int").alias("rep"))))
    from pyspark.sql import Window

    by_hash = F.md5(F.concat_ws("|", F.lit("1"), "rep", "sample").cast("binary"))
    places = each.withColumn("k", F.row_number().over(Window.partitionBy("rep", "block").orderBy(by_hash, "sample"))).select("rep", "pair", "block", "sample", "k")
    own = rows.withColumn("k", F.row_number().over(Window.partitionBy("block").orderBy("sample"))).select("block", "sample_type", "k")
    labels = rows.select(F.lit(0).alias("rep"), "pair", "sample", "sample_type").union(places.join(own, ["block", "k"]).select("rep", "pair", "sample", "sample_type"))
    keyed = labels.select(F.concat_ws("#", "pair", "rep").alias("rep"), "sample", "sample_type")
    r2 = permute.r_squared(pairs, keyed, "sample", "sample_type").select(F.substring_index("rep", "#", 1).alias("pair"), F.substring_index("rep", "#", -1).cast("int").alias("r"), F.round("r2", 9).alias("r2"))
    own2 = r2.where("r = 0").select("pair", F.col("r2").alias("o"))
    p = r2.join(own2, "pair").groupBy("pair").agg(F.round(F.max("o"), 6).alias("r2"), ((1 + F.sum(F.when((F.col("r") > 0) & (F.col("r2") >= F.col("o")), 1).otherwise(0))) / (REPS + 1.0)).alias("p"))
    return _rounded(benjamini_hochberg(p, "p", [], ["pair"]))


@query(f"""{_UNITS}, pl AS (SELECT o.patient AS rep, us.sample, us.sample_type FROM us, (SELECT DISTINCT patient FROM us) o WHERE us.patient <> o.patient UNION ALL SELECT -1, sample, sample_type FROM us), {r2_sql('bc', 'sample', 'sample_type')}, j AS (SELECT sqrt((count(*) - 1) * var_pop(r2)) AS se FROM r2 WHERE rep >= 0) SELECT round(r2, 6) AS r2, round(se, 6) AS se, round(r2 - 1.96 * se, 6) AS low, round(r2 + 1.96 * se, 6) AS high FROM r2, j WHERE rep = -1""")
def prm8_jackknife(spark, d):
    c = counts(spark, d, "brand")
    return _rounded(permute.jackknife_r2(permute_pairs(distance.bray_curtis(c)), _units(c), "sample", "sample_type", "patient"))


_MASKS = ", ".join(str(m) for m in isa.combos(TYPES))
_BIT = "(1 << (list_position([" + ", ".join(f"'{t}'" for t in TYPES) + "], sample_type) - 1))"


def isa_sql(reps: int, block: str | None, masks: str = _MASKS) -> str:
    return f"""{CB}, {_PROFILE}, us AS (SELECT DISTINCT sample, patient, sample_type FROM c), {permuted_sql('us', 'sample', 'sample_type', reps, block)},
 sz AS (SELECT rep, sample_type, {_BIT} AS bit, count(*) AS size FROM pl GROUP BY ALL), pe AS (SELECT pl.rep, feature, pl.sample_type, sum(p) AS s, count(*) AS n FROM rl JOIN pl USING (sample) WHERE p > 0 GROUP BY ALL),
 mn AS (SELECT pe.rep, feature, bit, s / size AS mean, n FROM pe JOIN sz ON pe.rep = sz.rep AND pe.sample_type = sz.sample_type), al AS (SELECT rep, feature, sum(mean) AS total FROM mn GROUP BY ALL),
 mk AS (SELECT unnest([{masks}])::INTEGER AS mask), cs AS (SELECT rep, mask, sum(size) AS units FROM sz, mk WHERE mask & bit <> 0 GROUP BY ALL),
 fd AS (SELECT rep, feature, mask, sum(mean) AS im, sum(n) AS nn FROM mn, mk WHERE mask & bit <> 0 GROUP BY ALL),
 sc AS (SELECT rep, feature, mask, im / total AS a, nn / units::DOUBLE AS b, round(sqrt(im / total * nn / units), 9) AS stat FROM fd JOIN cs USING (rep, mask) JOIN al USING (rep, feature)),
 iv AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY rep, feature ORDER BY stat DESC, mask) = 1),
 it AS (SELECT o.feature, o.mask, o.a, o.b, o.stat, (1 + count(*) FILTER (WHERE x.stat >= o.stat)) / {reps + 1}.0::DOUBLE AS p FROM iv o LEFT JOIN iv x ON x.feature = o.feature AND x.rep > 0 WHERE o.rep = 0 GROUP BY ALL)"""


_ISA_OUT = "SELECT feature, mask, round(a, 6) AS a, round(b, 6) AS b, round(stat, 6) AS stat, round(p, 6) AS p FROM it"


@query(f"{isa_sql(REPS, None)} {_ISA_OUT}")
def isa1_indicator_combinations(spark, d):
    c = counts(spark, d, "brand")
    return _rounded(isa.indicator_test(relative(c).select("sample", "feature", "p"), _units(c), "sample", "sample_type", TYPES, REPS))


@query(f"{isa_sql(REPS, 'patient', ', '.join(str(1 << i) for i in range(5)))} {_ISA_OUT}")
def isa4_blocked_singletons(spark, d):
    c = counts(spark, d, "brand")
    return _rounded(isa.indicator_test(relative(c).select("sample", "feature", "p"), _units(c), "sample", "sample_type", TYPES, REPS, "patient", True))


@query(f"""{isa_sql(REPS, None)}, rk AS (SELECT *, row_number() OVER (ORDER BY p, feature) AS k, count(*) OVER () AS m FROM it), q AS (SELECT *, least(min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 1) AS q FROM rk)
 SELECT feature, array_to_string(list_filter([{', '.join(f"CASE WHEN mask & {1 << i} <> 0 THEN '{t}' END" for i, t in enumerate(TYPES))}], lambda x: x IS NOT NULL), '+') AS groups, round(a * b, 6) AS ab, round(p, 6) AS p, round(q, 6) AS q, round(-log10(q), 3) AS log_p, q < 0.3 AND stat >= 0.5 AS passes FROM q""")
def isa2_isa5_isa8_isa9_indicator_table(spark, d):
    from ..operators.stats import benjamini_hochberg

    c = counts(spark, d, "brand")
    found = isa.indicator_test(relative(c).select("sample", "feature", "p"), _units(c), "sample", "sample_type", TYPES, REPS)
    table = isa.significance_table(isa.decoded_groups(benjamini_hochberg(found, "p", [], ["feature"]), TYPES), 0.3)
    return _rounded(table.select("feature", "groups", (F.col("a") * F.col("b")).alias("ab"), "p", "q", "log_p", "passes"))


_SINGLE = ", ".join(str(1 << i) for i in range(5))
_ALL_ISA, _BLOCKED_ISA = f"({isa_sql(REPS, None)} SELECT * FROM it)", f"({isa_sql(REPS, 'patient', _SINGLE)} SELECT * FROM it)"


def _all_isa(spark, d):
    c = counts(spark, d, "brand")
    return isa.indicator_test(relative(c).select("sample", "feature", "p"), _units(c), "sample", "sample_type", TYPES, REPS)


def _blocked_isa(spark, d):
    c = counts(spark, d, "brand")
    return isa.indicator_test(relative(c).select("sample", "feature", "p"), _units(c), "sample", "sample_type", TYPES, REPS, "patient", True)


_STRATIFIED = f"""{CB}, {_PROFILE}, {PATIENTS_SQL}, us AS (SELECT DISTINCT sample, sample_type, "case" AS status FROM c JOIN pt USING (patient)), own AS (SELECT sample_type, status, row_number() OVER (PARTITION BY sample_type ORDER BY sample) AS k FROM us),
 pc AS (SELECT rep, sample, sample_type, row_number() OVER (PARTITION BY rep, sample_type ORDER BY md5('1|' || rep || '|' || sample_type || '|' || sample), sample) AS k FROM us, (SELECT unnest(range(1, {REPS + 1}))::INTEGER AS rep)),
 pl AS (SELECT 0 AS rep, sample, sample_type, status FROM us UNION ALL SELECT rep, sample, sample_type, status FROM pc JOIN own USING (sample_type, k)), sz AS (SELECT rep, sample_type, status, count(*) AS size FROM pl GROUP BY ALL),
 mn AS (SELECT pl.rep, pl.sample_type, feature, pl.status, any_value(size) AS size, sum(p) / any_value(size) AS mean, count(*) AS n FROM rl JOIN pl USING (sample) JOIN sz ON sz.rep = pl.rep AND sz.sample_type = pl.sample_type AND sz.status = pl.status GROUP BY ALL),
 sc AS (SELECT *, CASE status WHEN 'Cancer' THEN 1 ELSE 2 END AS mask, mean / sum(mean) OVER (PARTITION BY rep, sample_type, feature) AS a, n / size::DOUBLE AS b FROM mn), iv AS (SELECT *, round(sqrt(a * b), 9) AS stat FROM sc QUALIFY row_number() OVER (PARTITION BY rep, sample_type, feature ORDER BY round(sqrt(a * b), 9) DESC, mask) = 1),
 it AS (SELECT o.sample_type, o.feature, o.mask, o.a, o.b, o.stat, (1 + count(*) FILTER (WHERE x.stat >= o.stat)) / {REPS + 1}.0::DOUBLE AS p FROM iv o LEFT JOIN iv x ON x.feature = o.feature AND x.sample_type = o.sample_type AND x.rep > 0 WHERE o.rep = 0 GROUP BY ALL),
 rk AS (SELECT *, row_number() OVER (ORDER BY p, sample_type, feature) AS k, count(*) OVER () AS m FROM it)"""


@query(f"{_STRATIFIED} SELECT sample_type, feature, mask, round(a, 6) AS a, round(b, 6) AS b, round(stat, 6) AS stat, round(p, 6) AS p, round(least(min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 1), 6) AS q FROM rk")
def isa3_stratified_status(spark, d):
    """Case against control within each sample type, bound together."""
    c = counts(spark, d, "brand")
    units = c.select("sample", "patient", "sample_type").distinct().join(patients(spark, d).select("patient", F.col("case").alias("status")), "patient")
    return _rounded(isa.stratified_test(relative(c).select("sample", "feature", "p"), units, "sample", "status", "sample_type", ["Cancer", "Control"], REPS))


@query(f"SELECT a.feature, a.mask, round(a.stat, 6) AS stat, round(coalesce(b.p, a.p), 6) AS metric FROM {_ALL_ISA} a LEFT JOIN {_BLOCKED_ISA} b USING (feature)")
def isa6_merged_metric(spark, d):
    """The blocked test's value takes precedence where it has one."""
    summary = _blocked_isa(spark, d).select("feature", F.col("p").alias("q"))
    return _rounded(isa.merged_metrics(_all_isa(spark, d), summary, ["feature"]).select("feature", "mask", "stat", "metric"))


@query(f"SELECT feature, a.mask AS all_mask, round(a.stat, 6) AS all_stat, b.mask AS blocked_mask, round(b.stat, 6) AS blocked_stat, CASE WHEN a.ok AND b.ok THEN 'all+blocked' WHEN a.ok THEN 'all' WHEN b.ok THEN 'blocked' ELSE 'none' END AS label FROM (SELECT *, p < 0.05 AND stat > 0 AS ok FROM {_ALL_ISA}) a FULL JOIN (SELECT *, p < 0.05 AND stat > 0 AS ok FROM {_BLOCKED_ISA}) b USING (feature)")
def isa7_combined_tables(spark, d):
    """All features of both tests side by side; the label says in which they pass."""
    return _rounded(isa.combined(_all_isa(spark, d), _blocked_isa(spark, d), ("all", "blocked"), 0.05, 0.0))


@query(f"SELECT mask, feature, round(p, 6) AS p, round(stat, 6) AS stat, n_features, n_significant FROM (SELECT *, count(*) OVER (PARTITION BY mask) AS n_features, CAST(sum(CASE WHEN p < 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY mask) AS BIGINT) AS n_significant, row_number() OVER (PARTITION BY mask ORDER BY p, stat DESC, feature) AS k FROM {_ALL_ISA}) WHERE k <= 3")
def isa10_top3_summaries(spark, d):
    """Counts of each combination and its three strongest features."""
    whole, top = isa.analysis_summary(_all_isa(spark, d), ["mask"], 0.05, 3)
    return _rounded(top.join(whole, "mask").select("mask", "feature", "p", "stat", "n_features", "n_significant"))


@query(f"{CB}, f AS (SELECT feature, CAST(sum(count) AS BIGINT) AS total FROM c GROUP BY 1) SELECT feature, total, CASE WHEN ok THEN mask::VARCHAR ELSE 'Other' END AS label, ok AS shown FROM (SELECT f.feature, total, mask, coalesce(i.stat >= 0.4 AND i.p < 0.05 AND mask IN (1, 2, 4, 8, 16), FALSE) AS ok FROM f LEFT JOIN {_BLOCKED_ISA} i ON i.feature = f.feature)")
def flt29_indicator_overlay(spark, d):
    """Labels of indicators that pass, on a table of totals."""
    totals = counts(spark, d, "brand").groupBy("feature").agg(F.sum("count").alias("total"))
    marked = _blocked_isa(spark, d).select("feature", F.col("mask").cast("string").alias("label"), "stat", F.col("p").alias("metric"))
    return isa.overlay(totals, marked, "label", ["1", "2", "4", "8", "16"], 0.4, 0.05).select("feature", "total", "label", "shown")


@query(f"{C}, m AS (SELECT feature, bit_or((1 << (list_position([{', '.join(f"'{t}'" for t in TYPES)}], sample_type) - 1))::BIGINT) AS mask FROM c GROUP BY 1) SELECT feature, mask FROM m WHERE mask <> 31")
def flt30_partial_patterns(spark, d):
    """Features that are not in all groups."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.array_position(F.array(*map(F.lit, TYPES)), F.col("sample_type")) - 1).cast("int"))
    return isa.without_full_union(counts(spark, d).groupBy("feature").agg(F.bit_or(bit).alias("mask")), 5)


@query(f"{C} SELECT DISTINCT sample, patient, sample_type FROM c")
def flt34_sample_metadata(spark, d):
    """The distinct metadata columns of a long table."""
    return counts(spark, d).select("sample", "patient", "sample_type").distinct()
