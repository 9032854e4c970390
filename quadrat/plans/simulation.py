"""Resampling nulls and power over sizes and scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.transforms import relative
from ..operators import distance, isa, power, resample, stats
from ..operators.diversity import shannon, summed_profile
from ..sources.study import PATIENTS_SQL, counts, counts_sql, patients
from ..streaming.checkpoints import cut
from .ecology import _rounded, bray_sql
from .networks import _U, _boot, boot_sql
from .registry import Registry
from .relational import TYPES
from .statistics import bh_sql, rank_sql, tail_sql

query = Registry()
PERMS, SIMS, SIZES = 39, 10, [5, 8]
_SIZES = f"(SELECT unnest({SIZES})::INTEGER AS size)"


def pool_sql(units: str, reps: int, n: int) -> str:
    """SQL of resample.bootstrap without groups as the expression ``bp`` (rep, slot, patient)."""
    u = _U.format(parts="'1|' || rep || '|' || slot")
    return f"""lp AS (SELECT patient, row_number() OVER (ORDER BY patient) - 1 AS k, count(*) OVER () AS m FROM (SELECT DISTINCT patient FROM {units})),
 dp AS (SELECT (i // {n})::INTEGER AS rep, (i % {n})::INTEGER AS slot FROM (SELECT unnest(range(0, {reps * n})) AS i)), ep AS (SELECT rep, slot, CAST(floor({u} * m) AS INTEGER) AS k FROM dp, (SELECT DISTINCT m FROM lp)),
 bp AS (SELECT rep, slot, patient FROM ep JOIN lp USING (k))"""


def permanova_sql(draws: str, pairs: str, keys: list[str], perms: int, block: str | None = None, on: str = "") -> str:
    """SQL of power.permanova_p as the expression ``pt2`` (keys, r2, p)."""
    ks, part = ", ".join(keys), ", ".join([*keys, *([block] if block else [])])
    said = " || '|' || ".join(keys)
    return f"""own AS (SELECT {part}, grp, row_number() OVER (PARTITION BY {part} ORDER BY uid) AS k FROM {draws}),
 pls AS (SELECT perm, {part}, uid, row_number() OVER (PARTITION BY perm, {part} ORDER BY md5('1|' || perm || '|' || {said} || '|' || uid), uid) AS k FROM {draws}, (SELECT unnest(range(1, {perms + 1}))::INTEGER AS perm)),
 lab AS (SELECT 0 AS perm, {ks}, uid, grp FROM {draws} UNION ALL SELECT perm, {ks}, uid, grp FROM pls JOIN own USING ({part}, k)),
 far AS (SELECT {', '.join('x.' + k for k in keys)}, x.uid AS u1, y.uid AS u2, coalesce(dist * dist, 0) AS d2 FROM {draws} x JOIN {draws} y ON {' AND '.join(f'x.{k} = y.{k}' for k in keys)} AND x.uid < y.uid LEFT JOIN {pairs} q ON q.id1 = least(x.item, y.item) AND q.id2 = greatest(x.item, y.item){on}),
 szg AS (SELECT {ks}, grp, count(*) AS gm FROM {draws} GROUP BY ALL), szn AS (SELECT {ks}, sum(gm) AS n FROM szg GROUP BY ALL),
 sms AS (SELECT {', '.join('f.' + k for k in keys)}, a.perm, CASE WHEN a.grp = b.grp THEN a.grp END AS grp, sum(d2) AS s FROM far f JOIN lab a ON {' AND '.join(f'a.{k} = f.{k}' for k in keys)} AND a.uid = f.u1 JOIN lab b ON {' AND '.join(f'b.{k} = f.{k}' for k in keys)} AND b.perm = a.perm AND b.uid = f.u2 GROUP BY ALL),
 wis AS (SELECT {', '.join('sms.' + k for k in keys)}, perm, sum(s) AS s, coalesce(sum(s / gm), 0) AS within FROM sms LEFT JOIN szg ON {' AND '.join(f'szg.{k} = sms.{k}' for k in keys)} AND szg.grp = sms.grp GROUP BY ALL),
 r2s AS (SELECT {ks}, perm, round(1 - within / nullif(s / n, 0), 9) AS r2 FROM wis JOIN szn USING ({ks})),
 pt2 AS (SELECT {ks}, max(r2) FILTER (WHERE perm = 0) AS r2, (1 + count(*) FILTER (WHERE perm > 0 AND r2 >= o)) / {perms + 1}.0::DOUBLE AS p FROM (SELECT *, max(CASE WHEN perm = 0 THEN r2 END) OVER (PARTITION BY {ks}) AS o FROM r2s) GROUP BY ALL)"""


def power_sql(by: str) -> str:
    return f"SELECT {by}, round(avg(CASE WHEN p < 0.05 THEN 1.0::DOUBLE ELSE 0 END), 6) AS power, count(*) AS reps, round(avg(r2), 6) AS mean_r2, round(quantile_cont(r2, 0.025), 6) AS low, round(quantile_cont(r2, 0.975), 6) AS high FROM pt2 GROUP BY ALL"


@query(f"WITH {PATIENTS_SQL}, {pool_sql('pt', 20, 16)} SELECT rep, slot, patient, CASE WHEN slot < 8 THEN '1' ELSE '2' END AS grp FROM bp")
def res2_pooled_null(spark, d):
    """Draws from all patients under random group names."""
    return power.pooled_null(patients(spark, d), "patient", 20, 8)


@query(f"WITH {counts_sql('brand')}, us AS (SELECT DISTINCT patient, sample, sample_type FROM c), {pool_sql('us', 10, 6)}, dr AS (SELECT rep, slot, slot || '#' || sample AS uid, patient, sample, sample_type AS grp FROM bp JOIN us USING (patient)), own AS (SELECT rep, slot, grp, row_number() OVER (PARTITION BY rep, slot ORDER BY uid) AS k FROM dr), pl AS (SELECT 1 AS perm, rep, slot, uid, patient, sample, row_number() OVER (PARTITION BY rep, slot ORDER BY md5('1|1|' || rep || '|' || uid), uid) AS k FROM dr) SELECT 0 AS perm, rep, slot, uid, patient, sample, grp FROM dr UNION ALL SELECT perm, rep, slot, uid, patient, sample, grp FROM pl JOIN own USING (rep, slot, k)")
def res3_within_patient_null(spark, d):
    """Patients drawn with all their samples; the null shuffles types within each drawn patient."""
    drawn = _typed_draws(spark, d, 10, 6)
    return power.shuffled_labels(drawn, ["rep"], "uid", "grp", 1, "slot").select("perm", "rep", "slot", "uid", "patient", "sample", "grp")


def _typed_draws(spark, d, reps, n):
    samples = counts(spark, d, "brand").select("patient", "sample", F.col("sample_type").alias("grp")).distinct()
    drawn = power.within_unit_draws(samples, "patient", reps, n)
    return drawn.withColumn("uid", F.concat_ws("#", "slot", "sample")).select("rep", "slot", "uid", "patient", "sample", "grp")


_SHARES = "s0 AS (SELECT patient, feature, sum(count) AS count FROM c GROUP BY ALL), sp AS (SELECT patient, feature, count / sum(count) OVER (PARTITION BY patient)::DOUBLE AS p FROM s0)"
_SPIKED = "('Brand#1', 'Brand#7', 'Brand#13')"


def spiked_sql(fold: str) -> str:
    return f"""sx AS (SELECT patient, feature, "case" AS grp, p * CASE WHEN "case" = 'Cancer' AND feature IN {_SPIKED} THEN {fold} ELSE 1 END AS x FROM sp JOIN pt USING (patient)), sq AS (SELECT patient, feature, grp, x / sum(x) OVER (PARTITION BY patient) AS p FROM sx)"""


def _spiked(spark, d, fold):
    shares = summed_profile(counts(spark, d, "brand"), ["patient"]).select("patient", "feature", "p")
    features = spark.createDataFrame([("Brand#1",), ("Brand#7",), ("Brand#13",)], "feature string")
    cases = patients(spark, d).where(F.col("case") == "Cancer").select("patient").join(F.broadcast(features))
    return power.spiked_shares(shares, cases, "patient", F.lit(fold))


@query(f"WITH {PATIENTS_SQL}, {counts_sql('brand')}, {_SHARES}, {spiked_sql('3.0')} SELECT patient, feature, round(p, 9) AS p FROM sq")
def res5_renormalised_spike(spark, d):
    return _rounded(_spiked(spark, d, 3.0), 9)


_PWR1 = f"""WITH {PATIENTS_SQL}, {counts_sql('brand')}, {_SHARES}, {spiked_sql('1.5')}, {bray_sql('sq', 'patient', 'p')}, {boot_sql(SIMS, 8)}, dw AS (SELECT size, rep, grp || '#' || slot AS uid, patient AS item, grp FROM bt, {_SIZES} WHERE slot < size)"""


@query(f"{_PWR1}, {permanova_sql('dw', 'bc', ['size', 'rep'], PERMS)} {power_sql('size')}")
def pwr1_permanova_power(spark, d):
    """Case against control with spiked shares: every size and repetition is permuted in one plan."""
    pairs = cut(distance.bray_curtis(_spiked(spark, d, 1.5), "patient", "p"))
    draws = cut(power.sizes_of(_boot(spark, d, SIMS, 8), SIZES).select("size", "rep", F.concat_ws("#", "grp", "slot").alias("uid"), F.col("patient").alias("item"), "grp"))
    return _rounded(power.permanova_power(power.permanova_p(draws, pairs, ["size", "rep"], PERMS), ["size"]))


_TYPED = f"""WITH {counts_sql('brand')}, us AS (SELECT DISTINCT patient, sample, sample_type FROM c), {bray_sql('c', 'sample', 'count')}, {pool_sql('us', 6, 6)}, dt AS (SELECT rep, slot, slot || '#' || sample AS uid, sample AS item, sample_type AS grp FROM bp JOIN us USING (patient))"""


@query(f"{_TYPED}, {permanova_sql('dt', 'bc', ['rep'], PERMS, 'slot')} SELECT round(avg(CASE WHEN p < 0.05 THEN 1.0::DOUBLE ELSE 0 END), 6) AS power, count(*) AS reps, round(avg(r2), 6) AS mean_r2 FROM pt2")
def pwr2_type_permanova_power(spark, d):
    """All sample types at once; labels are permuted within each drawn patient."""
    draws = cut(_typed_draws(spark, d, 6, 6).select("rep", "slot", "uid", F.col("sample").alias("item"), "grp"))
    tests = power.permanova_p(draws, cut(distance.bray_curtis(counts(spark, d, "brand"))), ["rep"], PERMS, "slot")
    return _rounded(tests.agg(F.avg(F.when(F.col("p") < 0.05, 1.0).otherwise(0.0)).alias("power"), F.count(F.lit(1)).alias("reps"), F.avg("r2").alias("mean_r2")))


_PAIRED = f"{_TYPED}, pq AS (SELECT a.t AS g1, b.t AS g2, a.t || ' vs ' || b.t AS pair FROM (SELECT DISTINCT sample_type AS t FROM us) a JOIN (SELECT DISTINCT sample_type AS t FROM us) b ON a.t < b.t), dp2 AS (SELECT pair, rep, slot, uid, item, grp FROM dt JOIN pq ON grp IN (g1, g2))"


@query(f"{_PAIRED}, {permanova_sql('dp2', 'bc', ['pair', 'rep'], PERMS, 'slot')} {power_sql('pair')}")
def pwr2_pairwise_permanova_power(spark, d):
    """Each pair of sample types is a key of the same plan."""
    kinds = spark.createDataFrame([(a, b, f"{a} vs {b}") for a in TYPES for b in TYPES if a < b], "g1 string, g2 string, pair string")
    draws = _typed_draws(spark, d, 6, 6).join(F.broadcast(kinds), (F.col("grp") == F.col("g1")) | (F.col("grp") == F.col("g2")))
    draws = cut(draws.select("pair", "rep", "slot", "uid", F.col("sample").alias("item"), "grp"))
    tests = power.permanova_p(draws, cut(distance.bray_curtis(counts(spark, d, "brand"))), ["pair", "rep"], PERMS, "slot")
    return _rounded(power.permanova_power(tests, ["pair"]))


def mw_sql(table: str, by: str) -> str:
    """SQL of stats.mann_whitney with its p as the expression ``mw`` (by, u, z, rank_biserial, p); the first group is Cancer."""
    return f"""{rank_sql(table, by, 'v', 'rv')}, ti AS (SELECT {by}, sum(t * t * t - t)::DOUBLE AS tie FROM (SELECT {by}, v, count(*)::DOUBLE AS t FROM {table} GROUP BY ALL) GROUP BY ALL),
 sm AS (SELECT {by}, sum(rk) FILTER (WHERE grp = 'Cancer') AS r1, count(*) FILTER (WHERE grp = 'Cancer') AS n1, count(*) FILTER (WHERE grp <> 'Cancer') AS n2 FROM rv GROUP BY ALL),
 mu AS (SELECT {by}, n1, n2, r1 - n1 * (n1 + 1) / 2.0::DOUBLE AS u, n1 * n2 / 12.0::DOUBLE * ((n1 + n2 + 1) - tie / ((n1 + n2) * (n1 + n2 - 1))) AS var FROM sm JOIN ti USING ({by})),
 mz AS (SELECT {by}, u, CASE WHEN var > 1e-12 THEN greatest(abs(u - n1 * n2 / 2.0::DOUBLE) - 0.5, 0) / sqrt(var) END AS z, 2 * u / (n1 * n2) - 1 AS rank_biserial FROM mu), mw AS (SELECT *, {tail_sql('z')} AS p FROM mz)"""


_SH = "sh AS (SELECT patient, ln(sum(count)::DOUBLE) - sum(count * ln(count)) / sum(count) AS v FROM s0 GROUP BY 1)"
_PWR3 = f"WITH {PATIENTS_SQL}, {counts_sql('type')}, {_SHARES}, {_SH}, {boot_sql(30, 12)}, x AS (SELECT size, rep, grp, round(v + CASE WHEN grp = 'Cancer' THEN 0.0005 ELSE 0 END, 9) AS v FROM bt JOIN sh USING (patient), (SELECT unnest([5, 8, 12])::INTEGER AS size) WHERE slot < size), {mw_sql('x', 'size, rep')}"


def _shannon_tests(spark, d):
    v = shannon(counts(spark, d, "type").groupBy("patient", "feature").agg(F.sum("count").alias("count")), ["patient"])
    rows = power.sizes_of(_boot(spark, d, 30, 12), [5, 8, 12]).join(v, "patient").withColumn("v", F.round(F.col("shannon") + F.when(F.col("grp") == "Cancer", 0.0005).otherwise(0.0), 9))
    return stats.mann_whitney(rows, ["size", "rep"], "grp", "Cancer", "v").withColumn("p", stats.normal_tail2("z"))


@query(f"{_PWR3} SELECT size, round(avg(CASE WHEN p < 0.05 THEN 1.0::DOUBLE ELSE 0 END), 6) AS power, count(*) AS reps, round(avg(rank_biserial), 6) AS effect FROM mw GROUP BY 1")
def pwr3_shannon_power_curve(spark, d):
    """Power of a shifted diversity by rank tests over sample sizes: all sizes and repetitions in one plan."""
    tests = _shannon_tests(spark, d)
    return _rounded(resample.power(tests, ["size"], "p").join(tests.groupBy("size").agg(F.avg("rank_biserial").alias("effect")), "size"))


@query(f"{_PWR3}, cv AS (SELECT size, avg(CASE WHEN p < 0.05 THEN 1.0::DOUBLE ELSE 0 END) AS power FROM mw GROUP BY 1) SELECT 'shannon' AS metric, min(size) FILTER (WHERE power >= 0.8) AS n_needed, round(arg_max(power, size), 6) AS power_at_max, CASE WHEN min(size) FILTER (WHERE power >= 0.8) IS NULL THEN 'Underpowered' ELSE 'Adequate' END AS verdict FROM cv")
def pwr10_top9_size_for_power(spark, d):
    """The least size with a power of 0.8 on the curve of the rank tests."""
    curve = resample.power(_shannon_tests(spark, d), ["size"], "p", 0.05).withColumn("metric", F.lit("shannon"))
    return _rounded(resample.size_for_power(curve, ["metric"], "size"))


def wilcoxon_sql(table: str, by: str) -> str:
    """SQL of stats.wilcoxon_signed with its p as the expression ``wx`` (by, z, p) of pairs with columns x and y."""
    return f"""df AS (SELECT {by}, round(x - y, 12) AS d, abs(round(x - y, 12)) AS m FROM {table} WHERE round(x - y, 12) <> 0), {rank_sql('df', by, 'm', 'rd')}, ti AS (SELECT {by}, sum(t * t * t - t)::DOUBLE AS tie FROM (SELECT {by}, m, count(*)::DOUBLE AS t FROM df GROUP BY ALL) GROUP BY ALL),
 sw AS (SELECT {by}, count(*) AS n, least(sum(CASE WHEN d > 0 THEN rk ELSE 0 END), sum(CASE WHEN d < 0 THEN rk ELSE 0 END)) AS w FROM rd GROUP BY ALL),
 wv AS (SELECT {by}, n, w, n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - tie / 48 AS var FROM sw JOIN ti USING ({by})), wz AS (SELECT {by}, CASE WHEN var > 1e-12 THEN (w - n * (n + 1) / 4.0::DOUBLE) / sqrt(var) END AS z FROM wv), wx AS (SELECT *, {tail_sql('z')} AS p FROM wz)"""


def _type_pairs(rows, keys):
    a = rows.select(*keys, F.col("sample_type").alias("g1"), F.col("v").alias("x"))
    b = rows.select(*keys, F.col("sample_type").alias("g2"), F.col("v").alias("y"))
    return a.join(b, keys).where("g1 < g2").withColumn("pair", F.concat_ws(" vs ", "g1", "g2"))


_PWR4 = f"""WITH {counts_sql('type')}, s1 AS (SELECT patient, sample_type, ln(sum(count)::DOUBLE) - sum(count * ln(count)) / sum(count) AS h FROM c GROUP BY ALL), st AS (SELECT patient, sample_type, h + CASE WHEN sample_type = '1-URGENT' THEN 0.001 ELSE 0 END AS v FROM s1), {pool_sql('st', 20, 10)}, dv AS (SELECT rep, slot, sample_type, v FROM bp JOIN st USING (patient)),
 pr AS (SELECT rep, a.sample_type || ' vs ' || b.sample_type AS pair, a.v AS x, b.v AS y FROM dv a JOIN dv b USING (rep, slot) WHERE a.sample_type < b.sample_type), {wilcoxon_sql('pr', 'rep, pair')}, {bh_sql('wx', 'bq', 'rep', 'pair')}"""


@query(f"{_PWR4} SELECT round(avg(hit), 6) AS power_any, round(avg(share), 6) AS mean_share, count(*) AS reps FROM (SELECT rep, max(CASE WHEN q < 0.05 THEN 1.0::DOUBLE ELSE 0 END) AS hit, avg(CASE WHEN q < 0.05 THEN 1.0::DOUBLE ELSE 0 END) AS share FROM bq GROUP BY 1)")
def pwr4_paired_shannon_power(spark, d):
    """Paired rank tests of diversity between all sample types of drawn patients, adjusted within each repetition."""
    s = shannon(counts(spark, d, "type"), ["patient", "sample_type"]).withColumn("v", F.col("shannon") + F.when(F.col("sample_type") == "1-URGENT", 0.001).otherwise(0.0))
    rows = power.within_unit_draws(s, "patient", 20, 10)
    tests = stats.wilcoxon_signed(_type_pairs(rows, ["rep", "slot"]), ["rep", "pair"], "x", "y").withColumn("p", stats.normal_tail2("z"))
    return _rounded(_any_and_share(stats.benjamini_hochberg(tests, "p", ["rep"], ["pair"])))


def _any_and_share(adjusted):
    found = F.when(F.col("q") < 0.05, 1.0).otherwise(0.0)
    each = adjusted.groupBy("rep").agg(F.max(found).alias("hit"), F.avg(found).alias("share"))
    return each.agg(F.avg("hit").alias("power_any"), F.avg("share").alias("mean_share"), F.count(F.lit(1)).alias("reps"))


_PWR5 = f"""WITH {PATIENTS_SQL}, {counts_sql('brand')}, {_SHARES}, {boot_sql(20, 12)}, x AS (SELECT rep, feature, grp, p * CASE WHEN grp = 'Cancer' AND feature IN {_SPIKED} THEN 1.5 ELSE 1 END AS v FROM bt JOIN sp USING (patient)), {mw_sql('x', 'rep, feature')}, {bh_sql('mw', 'bq', 'rep')},
 ev AS (SELECT rep, max(CASE WHEN feature IN {_SPIKED} AND q < 0.05 THEN 1.0::DOUBLE WHEN feature IN {_SPIKED} THEN 0 END) AS hit, avg(CASE WHEN feature IN {_SPIKED} AND q < 0.05 THEN 1.0::DOUBLE WHEN feature IN {_SPIKED} THEN 0 END) AS sens, avg(CASE WHEN feature NOT IN {_SPIKED} AND q < 0.05 THEN 1.0::DOUBLE WHEN feature NOT IN {_SPIKED} THEN 0 END) AS fdr FROM bq GROUP BY 1)"""


@query(f"{_PWR5} SELECT round(avg(hit), 6) AS power, round(avg(sens), 6) AS sensitivity, round(avg(fdr), 6) AS fdr, count(*) AS reps FROM ev")
def pwr5_taxon_power(spark, d):
    """Power, sensitivity and false discoveries of rank tests on spiked features over bootstrap draws."""
    profiles = summed_profile(counts(spark, d, "brand"), ["patient"]).select("patient", "feature", "p")
    spiked = spark.createDataFrame([("Brand#1",), ("Brand#7",), ("Brand#13",)], "feature string")
    drawn = _boot(spark, d, 20, 12).join(profiles, "patient").join(F.broadcast(spiked.withColumn("s", F.lit(1))), "feature", "left")
    raised = F.col("p") * F.when((F.col("s") == 1) & (F.col("grp") == "Cancer"), 1.5).otherwise(1.0)
    return _rounded(resample.taxon_power(drawn.select("rep", "feature", "grp", raised.alias("v")), spiked, "grp", "Cancer"))


_PWR6 = f"""WITH {counts_sql('type')}, rl AS (SELECT patient, sample_type, feature, count / sum(count) OVER (PARTITION BY sample)::DOUBLE * CASE WHEN sample_type = '1-URGENT' AND feature < 'M' THEN 1.2 ELSE 1 END AS v FROM c), {pool_sql('rl', 10, 10)}, dv AS (SELECT rep, slot, feature, sample_type, v FROM bp JOIN rl USING (patient)),
 pr AS (SELECT rep, feature, a.sample_type || ' vs ' || b.sample_type AS pair, a.v AS x, b.v AS y FROM dv a JOIN dv b USING (rep, slot, feature) WHERE a.sample_type < b.sample_type), {wilcoxon_sql('pr', 'rep, feature, pair')}, mp AS (SELECT rep, feature, min(p) AS p FROM wx GROUP BY ALL), {bh_sql('mp', 'bq', 'rep')}"""


@query(f"{_PWR6} SELECT round(avg(hit), 6) AS power_any, round(avg(share), 6) AS mean_share, count(*) AS reps FROM (SELECT rep, max(CASE WHEN q < 0.05 THEN 1.0::DOUBLE ELSE 0 END) AS hit, avg(CASE WHEN q < 0.05 THEN 1.0::DOUBLE ELSE 0 END) AS share FROM bq GROUP BY 1)")
def pwr6_paired_taxon_power(spark, d):
    """The least p over all pairs of sample types stands for a feature; features are adjusted within each repetition."""
    r = relative(counts(spark, d, "type")).withColumn("v", F.col("p") * F.when((F.col("sample_type") == "1-URGENT") & (F.col("feature") < "M"), 1.2).otherwise(1.0))
    rows = power.within_unit_draws(r.select("patient", "sample_type", "feature", "v"), "patient", 10, 10)
    tests = stats.wilcoxon_signed(_type_pairs(rows, ["rep", "slot", "feature"]), ["rep", "feature", "pair"], "x", "y").withColumn("p", stats.normal_tail2("z"))
    least = tests.groupBy("rep", "feature").agg(F.min("p").alias("p"))
    return _rounded(_any_and_share(stats.benjamini_hochberg(least, "p", ["rep"], ["feature"])))


@query("SELECT size::INTEGER AS size, n_cancer, greatest(n_cancer, size)::INTEGER AS n_control FROM (SELECT unnest([5, 10, 15, 20]) AS size), (SELECT count(*)::INTEGER AS n_cancer FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey < 2)")
def pwr8_hybrid_sizes(spark, d):
    """Controls for each size: all there are, or as many as asked for."""
    from ..sources.study import load

    here = load(spark, d, "customer").join(patients(spark, d).where(F.col("case") == "Cancer"), F.col("c_nationkey") == F.col("patient")).agg(F.count(F.lit(1)).cast("int").alias("n_cancer"))
    sizes = spark.createDataFrame([(5,), (10,), (15,), (20,)], "size int")
    return sizes.join(F.broadcast(here)).select("size", "n_cancer", power.hybrid_control_size(F.col("size"), F.col("n_cancer")).cast("int").alias("n_control"))


_STRATA = """fs AS (SELECT feature, count(DISTINCT sample) / (SELECT count(DISTINCT sample) FROM c)::DOUBLE AS prev, sum(count) AS total FROM c GROUP BY 1), fr AS (SELECT *, CASE WHEN prev > 0.5 THEN 'high' WHEN prev > 0.2 THEN 'medium' ELSE 'low' END AS stratum FROM fs), fk AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY total DESC, feature) AS rk FROM fr)"""


@query(f"WITH {counts_sql()}, {_STRATA} SELECT stratum || '_x' || fold AS scenario, feature, fold FROM fk, (SELECT unnest([2.0, 5.0])::DOUBLE AS fold) WHERE rk <= 10")
def pwr8_pwr9_scenarios(spark, d):
    """Features by prevalence, the most abundant of each stratum with each fold."""
    from pyspark.sql import Window

    c = counts(spark, d)
    whole = c.select("sample").distinct().count()
    per = c.groupBy("feature").agg((F.countDistinct("sample") / F.lit(whole)).alias("prev"), F.sum("count").alias("total"))
    named = per.withColumn("stratum", F.when(F.col("prev") > 0.5, "high").when(F.col("prev") > 0.2, "medium").otherwise("low"))
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("total"), "feature")))
    return power.scenarios(ranked.select("stratum", "feature", "rank"), [2.0, 5.0], 10)


@query()
def pwr7_indicator_power(spark, d):
    """Indicator tests inside every repetition: power, sensitivity and false discoveries of spiked features; tested on a planted one."""
    spiked = spark.createDataFrame([("Brand#1",), ("Brand#7",), ("Brand#13",)], "feature string")
    return _rounded(isa.indicator_power(_boot(spark, d, SIMS, 8), _spiked(spark, d, 3.0), spiked, "patient", ["Cancer", "Control"], 199))


_GRID = [5, 9, 16]
_GRID_KEYS = ["kind", "scenario", "size", "rep"]
_GRID_SQL = f"""WITH {PATIENTS_SQL}, {counts_sql('brand')}, sc AS (SELECT unnest(['none', 'moderate', 'strong']) AS scenario, unnest([1.0::DOUBLE, 1.6, 4.0]) AS fold), un AS (SELECT sample_type AS kind, c.patient, feature, "case" AS grp, count / sum(count) OVER (PARTITION BY sample)::DOUBLE AS p FROM c JOIN pt USING (patient)),
 xx AS (SELECT kind, scenario, patient, feature, p * CASE WHEN grp = 'Cancer' AND feature IN {_SPIKED} THEN fold ELSE 1 END AS x FROM un, sc), pp AS (SELECT kind, scenario, patient, feature, x / sum(x) OVER (PARTITION BY kind, scenario, patient) AS p FROM xx),
 cm AS (SELECT a.kind, a.scenario, a.patient AS id1, b.patient AS id2, sum(least(a.p, b.p)) AS c FROM pp a JOIN pp b ON a.kind = b.kind AND a.scenario = b.scenario AND a.feature = b.feature AND a.patient < b.patient GROUP BY ALL), tt AS (SELECT kind, scenario, patient, sum(p) AS t FROM pp GROUP BY ALL),
 bc AS (SELECT x.kind, x.scenario, x.patient AS id1, y.patient AS id2, 1 - 2 * coalesce(c, 0) / (x.t + y.t) AS dist FROM tt x JOIN tt y ON x.kind = y.kind AND x.scenario = y.scenario AND x.patient < y.patient LEFT JOIN cm ON cm.kind = x.kind AND cm.scenario = x.scenario AND id1 = x.patient AND id2 = y.patient),
 me AS (SELECT DISTINCT kind, patient, grp, kind || '|' || grp AS g FROM un), ot AS (SELECT kind, count(*)::INTEGER AS others FROM me WHERE grp <> 'Cancer' GROUP BY 1), ls AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY patient) - 1 AS k, count(*) OVER (PARTITION BY g) AS m FROM me),
 sl AS (SELECT rep, slot FROM (SELECT unnest(range({SIMS}))::INTEGER AS rep), (SELECT unnest(range(25))::INTEGER AS slot)), dr AS (SELECT rep, slot, g, CAST(floor({_U.format(parts="'1|' || rep || '|' || slot || '|' || g")} * m) AS INTEGER) AS k FROM sl, (SELECT DISTINCT g, m FROM ls)),
 bt AS (SELECT rep, slot, kind, grp, patient, others FROM dr JOIN ls USING (g, k) JOIN ot USING (kind)), dw AS (SELECT kind, scenario, size, rep, grp || '#' || slot AS uid, patient AS item, grp FROM bt, (SELECT unnest({_GRID})::INTEGER AS size), sc WHERE slot < CASE WHEN grp = 'Cancer' THEN size ELSE greatest(size, others) END)"""


@query(f"""{_GRID_SQL}, {permanova_sql('dw', 'bc', _GRID_KEYS, PERMS, None, ' AND q.kind = x.kind AND q.scenario = x.scenario')}, pw AS ({power_sql('kind, scenario, size')})
 SELECT kind, scenario, size, greatest(size, others) AS controls, power, reps, mean_r2, low, high FROM pw x JOIN ot USING (kind) WHERE NOT EXISTS (SELECT 1 FROM pw y WHERE y.kind = x.kind AND y.scenario = x.scenario AND y.size < x.size AND y.power >= 0.995)""")
def pwr1_power_grid(spark, d):
    """Every sample type, scenario and size; where the power reaches 0.995 larger sizes are left out."""
    c = counts(spark, d, "brand")
    profiles = relative(c).select(F.col("sample_type").alias("kind"), F.col("patient").alias("unit"), "feature", "p")
    units = patients(spark, d).select(F.col("patient").alias("unit"), F.col("case").alias("grp"))
    spikes = spark.createDataFrame([("none", None, 1.0)] + [(s, f"Brand#{b}", x) for s, x in (("moderate", 1.6), ("strong", 4.0)) for b in (1, 7, 13)], "scenario string, feature string, fold double")
    return _rounded(power.permanova_grid(profiles, units, spikes, "Cancer", _GRID, SIMS, PERMS))


_EFFECT_REPS = 40
_EFFECT_SQL = f"""WITH {PATIENTS_SQL}, {counts_sql('brand')}, un AS (SELECT sample_type AS kind, c.patient, feature, "case" AS grp, count, count / sum(count) OVER (PARTITION BY sample)::DOUBLE AS p FROM c JOIN pt USING (patient)), tt AS (SELECT kind, patient, sum(p) AS t FROM un GROUP BY ALL),
 cm AS (SELECT a.kind, a.patient AS id1, b.patient AS id2, sum(least(a.p, b.p)) AS c FROM un a JOIN un b ON a.kind = b.kind AND a.feature = b.feature AND a.patient < b.patient GROUP BY ALL), bc AS (SELECT x.kind, x.patient AS id1, y.patient AS id2, 1 - 2 * coalesce(c, 0) / (x.t + y.t) AS dist FROM tt x JOIN tt y ON x.kind = y.kind AND x.patient < y.patient LEFT JOIN cm ON cm.kind = x.kind AND id1 = x.patient AND id2 = y.patient),
 me AS (SELECT DISTINCT kind, patient, grp, kind || '|' || grp AS g FROM un), ls AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY patient) - 1 AS k, count(*) OVER (PARTITION BY g) AS m FROM me), sl AS (SELECT rep, slot FROM (SELECT unnest(range({_EFFECT_REPS}))::INTEGER AS rep), (SELECT unnest(range(25))::INTEGER AS slot)),
 dr AS (SELECT rep, slot, g, CAST(floor({_U.format(parts="'1|' || rep || '|' || slot || '|' || g")} * m) AS INTEGER) AS k FROM sl, (SELECT DISTINCT g, m FROM ls) WHERE slot < m),
 dw AS (SELECT kind, 0 AS rep, 'own#' || patient AS uid, patient AS item, grp FROM me UNION ALL SELECT kind, rep + 1, grp || '#' || slot, patient, grp FROM dr JOIN ls USING (g, k))"""


@query(f"""{_EFFECT_SQL}, {permanova_sql('dw', 'bc', ['kind', 'rep'], 0, None, ' AND q.kind = x.kind')}, sh AS (SELECT kind, patient AS item, -sum(p * ln(p)) AS v FROM un WHERE p > 0 GROUP BY ALL),
 mo AS (SELECT kind, rep, count(*) FILTER (WHERE grp = 'Cancer') AS n1, count(*) FILTER (WHERE grp <> 'Cancer') AS n2, avg(v) FILTER (WHERE grp = 'Cancer') - avg(v) FILTER (WHERE grp <> 'Cancer') AS d, var_samp(v) FILTER (WHERE grp = 'Cancer') AS v1, var_samp(v) FILTER (WHERE grp <> 'Cancer') AS v2, median(v) FILTER (WHERE grp = 'Cancer') - median(v) FILTER (WHERE grp <> 'Cancer') AS dm FROM dw JOIN sh USING (kind, item) GROUP BY ALL),
 al AS (SELECT kind, rep, 'permanova_r2' AS metric, r2 AS value FROM pt2 UNION ALL SELECT kind, rep, 'shannon_d', d / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) FROM mo UNION ALL SELECT kind, rep, 'shannon_median_difference', dm FROM mo)
 SELECT kind, metric, round(max(value) FILTER (WHERE rep = 0), 5) AS value, round(quantile_cont(value, 0.025) FILTER (WHERE rep > 0), 5) AS low, round(quantile_cont(value, 0.975) FILTER (WHERE rep > 0), 5) AS high FROM al GROUP BY ALL""")
def pwr9_effect_intervals(spark, d):
    """Effects of case against control in every sample type, with bootstrap intervals."""
    c = counts(spark, d, "brand")
    profiles = relative(c).select(F.col("sample_type").alias("kind"), F.col("patient").alias("unit"), "feature", "p")
    values = shannon(c, ["sample_type", "patient"]).select(F.col("sample_type").alias("kind"), F.col("patient").alias("unit"), F.col("shannon").alias("v"))
    units = patients(spark, d).select(F.col("patient").alias("unit"), F.col("case").alias("grp"))
    return _rounded(power.effect_intervals(profiles, values, units, "Cancer", _EFFECT_REPS), 5)
