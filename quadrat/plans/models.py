"""Denoising, assignment, classification, batch correction, network inference and outlier models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.transforms import rclr, relative
from ..operators import compositions, denoise, density, distance, forest, inference, stats, tidy
from ..sources.study import counts, counts_sql, load
from ..streaming.checkpoints import cut
from .ecology import _rounded, _units, bray_sql
from .registry import Registry
from .relational import _STAGES_SQL, STAGES, TYPES, _stage_reads

query = Registry()

#: Reads of one sequence for each brand, one for each line, its parts' order priority the sample: of 16 lines one has a letter replaced, one lacks a letter.
_READS = """WITH RECURSIVE b0 AS (SELECT o_orderpriority AS sample, translate(md5(p_brand), '0123456789abcdef', 'ACGTACGTACGTACGT') AS s, md5(l_orderkey || '|' || l_linenumber) AS e FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey),
 b1 AS (SELECT sample, s, e[1] AS c, ('0x' || e[2:3])::INTEGER % 32 + 1 AS p FROM b0), rd AS (SELECT sample, CASE c WHEN '0' THEN s[:p - 1] || translate(s[p], 'ACGT', 'CGTA') || s[p + 1:] WHEN '1' THEN s[:p - 1] || s[p + 1:] ELSE s END AS seq FROM b1)"""


def reads(spark, d):
    """(sample, seq) as in the SQL above."""
    rows = load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).join(load(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    e = F.md5(F.concat_ws("|", "l_orderkey", "l_linenumber"))
    rows = rows.select(F.col("o_orderpriority").alias("sample"), F.translate(F.md5("p_brand"), "0123456789abcdef", "ACGTACGTACGTACGT").alias("s"), F.substring(e, 1, 1).alias("c"), (F.conv(F.substring(e, 2, 2), 16, 10).cast("int") % 32 + 1).alias("p"))
    before, after = F.substring("s", F.lit(1), F.col("p") - 1), F.substring("s", F.col("p") + 1, F.lit(32))
    return rows.select("sample", F.when(F.col("c") == "0", F.concat(before, F.translate(F.substring("s", F.col("p"), F.lit(1)), "ACGT", "CGTA"), after)).when(F.col("c") == "1", F.concat(before, after)).otherwise(F.col("s")).alias("seq"))


_KEPT = ", ".join(f"k{i} AS (SELECT seq, size, CASE WHEN count(b) = 0 THEN true WHEN bool_or(kept) THEN false WHEN bool_and(kept IS NOT NULL) THEN true END AS kept FROM (SELECT sz.seq, sz.size, pr.b, o.kept FROM sz LEFT JOIN pr ON pr.a = sz.seq LEFT JOIN k{i - 1} o ON o.seq = pr.b) GROUP BY ALL)" for i in range(1, 8))


@query(f"""{_READS}, sz AS (SELECT seq, count(*) AS size FROM rd GROUP BY 1 HAVING count(*) >= 2), pr AS (SELECT x.seq AS a, y.seq AS b, y.size AS size_b, levenshtein(x.seq, y.seq) AS d FROM sz x JOIN sz y ON x.size * 8 <= y.size AND x.size * pow(2.0, 2 * levenshtein(x.seq, y.seq) + 1) <= y.size),
 k0 AS (SELECT seq, size, NULL::BOOLEAN AS kept FROM sz), {_KEPT}, nr AS (SELECT a, b, d, row_number() OVER (PARTITION BY a ORDER BY d, size_b DESC, b) AS r FROM pr JOIN k7 ON k7.seq = pr.b AND k7.kept)
 SELECT k7.seq, size, CASE WHEN kept THEN k7.seq ELSE b END AS centroid, CASE WHEN kept THEN 0 ELSE d END AS d FROM k7 LEFT JOIN nr ON nr.a = k7.seq AND nr.r = 1""")
def seq6_denoised(spark, d):
    """Every distinct read of at least two copies with the centroid that it is an error of."""
    return denoise.denoised(reads(spark, d), 2)


@query(f"""{_READS}, ce AS (SELECT DISTINCT p_brand AS centroid, translate(md5(p_brand), '0123456789abcdef', 'ACGTACGTACGTACGT') AS s FROM part), un AS (SELECT DISTINCT seq FROM rd),
 sh AS (SELECT seq, centroid, 1 - levenshtein(seq, s) / greatest(length(seq), length(s))::DOUBLE AS share FROM un, ce), bs AS (SELECT seq, arg_max(centroid, share) AS centroid FROM (SELECT * FROM sh WHERE share >= 0.93 ORDER BY centroid) GROUP BY 1)
 SELECT sample, centroid, count(*) AS count FROM rd JOIN bs USING (seq) GROUP BY ALL""")
def seq9_assigned_counts(spark, d):
    """The count table: reads under the brand's sequence that is at least 0.93 like them."""
    named = load(spark, d, "part").select(F.col("p_brand").alias("centroid"), F.translate(F.md5("p_brand"), "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq")).distinct()
    return denoise.assigned(reads(spark, d), named, 0.93)


_K = 4


@query(f"""WITH tr AS (SELECT lang AS taxon, text FROM documents WHERE lang IS NOT NULL), tk AS (SELECT taxon, kmer, count(*) AS n FROM (SELECT taxon, unnest(list_transform(range(1, length(text) - {_K - 2}), lambda i: text[i:i + {_K - 1}])) AS kmer FROM tr WHERE length(text) >= {_K}) GROUP BY ALL),
 vo AS (SELECT count(DISTINCT kmer) AS v FROM tk), tx AS (SELECT taxon, ln(0.001::DOUBLE / (sum(n) + 0.001 * any_value(v))) AS base FROM tk, vo GROUP BY 1),
 rk AS (SELECT id, kmer, count(*) AS n FROM (SELECT id, unnest(list_transform(range(1, length(text) - {_K - 2}), lambda i: text[i:i + {_K - 1}])) AS kmer FROM (SELECT conv_id || '|' || turn AS id, text FROM conversations) WHERE length(text) >= {_K}) GROUP BY ALL), tt AS (SELECT id, sum(n) AS m FROM rk GROUP BY 1),
 gn AS (SELECT id, taxon, sum(rk.n * ln((tk.n + 0.001::DOUBLE) / 0.001::DOUBLE)) AS gain FROM rk JOIN tk USING (kmer) GROUP BY ALL), sc AS (SELECT tt.id, tx.taxon, m * base + coalesce(gain, 0) AS score FROM tt CROSS JOIN tx LEFT JOIN gn ON gn.id = tt.id AND gn.taxon = tx.taxon),
 tp AS (SELECT id, max(score) AS top FROM sc GROUP BY 1), ls AS (SELECT id, 1 / sum(exp(score - top)) AS confidence, arg_max(taxon, (score, taxon)) AS taxon FROM sc JOIN tp USING (id) GROUP BY 1)
 SELECT DISTINCT c.conv_id || '|' || c.turn AS id, CASE WHEN confidence >= 0.7 THEN taxon ELSE 'Unassigned' END AS taxon, round(coalesce(confidence, 0), 6) AS confidence FROM conversations c LEFT JOIN ls ON ls.id = c.conv_id || '|' || c.turn""")
def seq10_bayes_taxonomy(spark, d):
    """The language of every turn by its four-letter strings, learnt from all documents."""
    gains, taxa = denoise.bayes_model(load(spark, d, "documents").select(F.col("lang").alias("taxon"), F.col("text").alias("seq")), _K)
    turns = load(spark, d, "conversations").select(F.concat_ws("|", "conv_id", "turn").alias("id"), F.col("text").alias("seq"))
    return _rounded(denoise.bayes_classified(turns, gains, taxa, _K))


_CT = f"WITH {counts_sql('type')}"


@query(f"""{_CT}, v AS (SELECT sample, sample_type AS k, feature AS f, ln(count + 1.0::DOUBLE) AS x FROM c), ce AS (SELECT f, k, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM v GROUP BY ALL), wh AS (SELECT f, sum(n * m) / sum(n) AS mean, sum(n * v) / sum(n) AS pool FROM ce GROUP BY 1),
 st AS (SELECT f, k, n, v, mean, pool, (m - mean) / sqrt(pool) AS g, CASE WHEN n > 1 THEN v / pool * n / (n - 1) END AS d FROM ce JOIN wh USING (f) WHERE pool > 0), pr AS (SELECT k, avg(g) AS bar, var_samp(g) AS t2, avg(d) AS dm, var_samp(d) AS dv FROM st GROUP BY 1),
 pp AS (SELECT *, (2 * dv + dm * dm) / dv AS a, (dm * dv + dm * dm * dm) / dv AS b FROM pr), it AS (SELECT f, k, mean, pool, list_reduce(list_concat([{{'g': g, 'd': d, 'done': false}}], list_transform(range(100), lambda i: {{'g': 0.0::DOUBLE, 'd': 0.0::DOUBLE, 'done': false}})),
  lambda s, i: CASE WHEN s.done THEN s ELSE list_transform([(t2 * n * g + s.d * bar) / (t2 * n + s.d)], lambda h: list_transform([(0.5 * (n * v / pool + n * (g - h) * (g - h)) + b) / (n / 2.0::DOUBLE + a - 1)], lambda e: {{'g': h, 'd': e, 'done': abs(h - s.g) <= 1e-4 * abs(s.g) AND abs(e - s.d) <= 1e-4 * abs(s.d)}})[1])[1] END) AS s FROM st JOIN pp USING (k))
 SELECT sample, v.f AS feature, round(((x - mean) / sqrt(pool) - s.g) / sqrt(s.d) * sqrt(pool) + mean, 5) AS adjusted FROM v JOIN it ON it.f = v.f AND it.k = v.k""")
def sta14_combat(spark, d):
    """Logarithms of counts without the effects of sample types, shrunk over features."""
    rows = counts(spark, d, "type").select("sample", "sample_type", "feature", F.log(F.col("count") + 1.0).alias("x"))
    return stats.combat(rows, "sample_type", "feature", "x").select("sample", "feature", F.round("adjusted", 5).alias("adjusted"))


@query()
def net1_neighbourhoods(spark, d):
    """Neighbours of every brand in log-ratios of counts (null if it has none), by lassos at the penalty that subsamples find stable; iterative, so without SQL."""
    r = cut(rclr(relative(counts(spark, d, "brand"))).select(F.col("sample").alias("unit"), F.col("feature").alias("id"), F.col("rclr").alias("value")))
    edges = cut(inference.neighbourhoods(r)[0])
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight", "stability"))
    return _rounded(r.select(F.col("id").alias("a")).distinct().join(both, "a", "left"))


@query()
def out1_isolation_forest(spark, d):
    """Scores of all parts by price and size, within their brand and pooled; the tests hold them against plain Python."""
    p = load(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice", "p_size")
    both = forest.isolation_scores(p, ["p_retailprice", "p_size"], "p_partkey", "p_brand").unionByName(forest.isolation_scores(p, ["p_retailprice", "p_size"], "p_partkey"))
    return _rounded(both)


@query()
def clu1_density_clusters(spark, d):
    """Clusters of customers by the mean and the spread of their orders' prices; tested against brute force."""
    o = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.log(F.avg("o_totalprice")).alias("level"), F.log(F.stddev_samp("o_totalprice") + 1).alias("spread"))
    return density.density_clusters(o, ["level", "spread"], "customer", 10)


@query()
def net4_patient_networks(spark, d):
    """For each patient the strong correlations of its features' compositions over its samples (null if there are none), strongest pairs left out in turn; tested on the whole system."""
    c = counts(spark, d, "type").where("count > 0")
    units = c.groupBy("patient").agg(F.countDistinct("sample").alias("whole"))
    held = c.groupBy("patient", "feature").agg(F.countDistinct("sample").alias("m")).join(units, "patient").where("m = whole").select("patient", "feature")
    logs = cut(c.join(held, ["patient", "feature"]).select("patient", F.col("sample").alias("unit"), F.col("feature").alias("id"), F.log("count").alias("value")))
    edges = compositions.strong_edges(compositions.excluding_correlations(logs, ["patient"], 39, 3), ["patient"], 39)
    return _rounded(units.select("patient").join(edges, "patient", "left"))


_CHAIN = " UNION ALL ".join(f"SELECT 'stage::{a}', 'stage::{b}', {b} FROM tt UNION ALL SELECT 'stage::{a}', 'loss::after_{a}', {a} - {b} FROM tt" for a, b in zip(STAGES, STAGES[1:], strict=False))


@query(f"WITH {_STAGES_SQL}, bt AS (SELECT sample_type, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in STAGES)} FROM st GROUP BY 1), tt AS (SELECT {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in STAGES)} FROM bt), lk AS (SELECT 'raw_type::' || sample_type AS source, 'stage::{STAGES[0]}' AS target, {STAGES[0]} AS value FROM bt UNION ALL {_CHAIN} UNION ALL SELECT 'stage::{STAGES[-1]}', 'fin_type::' || sample_type, {STAGES[-1]} FROM bt) SELECT * FROM lk WHERE value > 0")
def tidy_stage_links(spark, d):
    """Links of the flow of reads from sample types through the stages and back."""
    return tidy.stage_links(_stage_reads(spark, d), "sample_type", STAGES)


_PAIR_SHARES = f"WITH {counts_sql('brand')}, us AS (SELECT DISTINCT sample, patient, sample_type FROM c), {bray_sql('c', 'sample', 'count')}"


@query(f"""{_PAIR_SHARES}, lb AS (SELECT id1, id2, dist, a.patient = b.patient AS same, least(a.sample_type, b.sample_type) AS low, greatest(a.sample_type, b.sample_type) AS high FROM bc JOIN us a ON a.sample = id1 JOIN us b ON b.sample = id2)
 SELECT CASE WHEN same THEN 'A: urgent and high' WHEN low = '1-URGENT' THEN 'C: urgent and medium' ELSE 'B: high and medium' END AS contrast, id1, id2, round(dist, 6) AS dist FROM lb WHERE (same AND low = '1-URGENT' AND high = '2-HIGH') OR (NOT same AND low IN ('1-URGENT', '2-HIGH') AND high = '3-MEDIUM')""")
def tidy_contrast_distances(spark, d):
    """Distances by contrast: two types of one patient, and each of them against a third type of other patients."""
    c = counts(spark, d, "brand")
    pairs = tidy.contrast_distances(distance.bray_curtis(c), _units(c), "sample", "patient", "sample_type", {"A: urgent and high": ("1-URGENT", "2-HIGH")}, {"B: high and medium": ("2-HIGH", "3-MEDIUM"), "C: urgent and medium": ("1-URGENT", "3-MEDIUM")})
    return _rounded(pairs)


@query(f"""{_PAIR_SHARES}, lb AS (SELECT a.sample_type AS g1, b.sample_type AS g2, dist FROM bc JOIN us a ON a.sample = id1 JOIN us b ON b.sample = id2 AND a.sample_type <> b.sample_type), mn AS (SELECT least(g1, g2) AS group1, greatest(g1, g2) AS group2, round(avg(dist), 6) AS mean FROM lb GROUP BY ALL)
 SELECT group1, group2, mean FROM mn UNION SELECT group2, group1, mean FROM mn""")
def tidy_pair_matrix(spark, d):
    """Mean distances between sample types as a symmetric matrix in long form."""
    c = counts(spark, d, "brand")
    types = _units(c).select("sample", "sample_type")
    far = distance.bray_curtis(c).join(types.toDF("id1", "g1"), "id1").join(types.toDF("id2", "g2"), "id2").where("g1 <> g2")
    means = far.groupBy(F.least("g1", "g2").alias("group1"), F.greatest("g1", "g2").alias("group2")).agg(F.round(F.avg("dist"), 6).alias("mean"))
    return tidy.pair_matrix(means, "group1", "group2", "mean")


@query(f"""WITH {counts_sql('brand')}, v AS (SELECT sample_type, feature, sample, count / sum(count) OVER (PARTITION BY sample)::DOUBLE AS p FROM c), mo AS (SELECT feature, sample_type, avg(p) AS m, var_samp(p) AS s, count(*) AS n FROM v GROUP BY ALL), al AS (SELECT feature, avg(p) AS m, stddev_samp(p) AS s FROM v GROUP BY 1),
 ef AS (SELECT feature, sample_type, round((mo.m - al.m) / al.s, 6) AS effect, round(exp(-abs(mo.m - al.m) / al.s), 9) AS score FROM mo JOIN al USING (feature)), rk AS (SELECT feature, min(score) AS min_q FROM ef GROUP BY 1 ORDER BY 2, 1 LIMIT 10)
 SELECT feature, round(min_q, 6) AS min_q, {', '.join(f"max(effect) FILTER (WHERE sample_type = '{t}') AS " + chr(34) + t + chr(34) for t in TYPES)} FROM ef JOIN rk USING (feature) GROUP BY ALL""")
def tidy_effect_matrix(spark, d):
    """The ten brands whose share departs most from its mean in any sample type, with their departures in all of them."""
    v = relative(counts(spark, d, "brand"))
    whole = v.groupBy("feature").agg(F.avg("p").alias("mean"), F.stddev_samp("p").alias("sd"))
    each = v.groupBy("feature", "sample_type").agg(F.avg("p").alias("m")).join(whole, "feature")
    away = (F.col("m") - F.col("mean")) / F.col("sd")
    results = each.select("feature", "sample_type", F.round(away, 6).alias("effect"), F.round(F.exp(-F.abs(away)), 9).alias("score"))
    return tidy.effect_matrix(results, "feature", "sample_type", "score", "effect", TYPES, 10).withColumn("min_q", F.round("min_q", 6))
