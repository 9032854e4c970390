"""File formats: each query writes rows of the tables with a sink, reads the files with its reader and returns what came back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distance, network, sequences
from ..sources import readers, results
from ..sources.study import PATIENTS_SQL, TAXONOMY_SQL, counts, counts_sql, load, patients, taxonomy
from ..streaming.checkpoints import scratch
from .ecology import _rounded, bray_sql
from .networks import E1, shared_orders
from .registry import Registry
from .relational import TYPES

query = Registry()
CB, CT = (f"WITH {counts_sql(level)}" for level in ("brand", "type"))
BRANDS = [f"Brand#{i}" for i in range(1, 26)]


@query(f"{CB} SELECT feature, sample, count::DOUBLE AS count FROM c WHERE count <> 0 AND feature IN ({', '.join(repr(b) for b in BRANDS)})")
def src20_header_mixed_counts(spark, d):
    """A wide table with samples as rows, some columns of which are no features."""
    path = f"{scratch(spark, 'wide')}.tsv"
    wide = counts(spark, d, "brand").groupBy("sample").pivot("feature", BRANDS).agg(F.sum("count")).withColumn("note", F.lit("7 and more")).withColumn("total", F.lit(12))
    readers.write_table(wide, path)
    return readers.read_counts(spark, path, "rows", BRANDS)


@query(f"{CT} SELECT feature, patient::VARCHAR AS sample, sum(count)::DOUBLE AS count FROM c GROUP BY ALL")
def src1_flt1_samples_on_columns(spark, d):
    """The same with samples as columns, packed."""
    path = f"{scratch(spark, 'wide')}.csv.gz"
    ids = [str(i) for i in range(25)]
    readers.write_table(counts(spark, d, "type").withColumn("patient", F.col("patient").cast("string")).groupBy("feature").pivot("patient", ids).agg(F.sum("count")), path)
    return readers.read_counts(spark, path)


@query("SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 7 <> 0 THEN round(o_totalprice, 2) END AS price, 'a, \"b\"' AS remark FROM orders")
def src2_src3_snk1_packed_tables(spark, d):
    """Commas and quotes in cells, nulls, a separator and a packing that the suffix names."""
    o = load(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 7 != 0, F.round("o_totalprice", 2)).alias("price"), F.lit('a, "b"').alias("remark"))
    path = f"{scratch(spark, 'orders')}.csv.gz"
    readers.write_table(o, path)
    return readers.read_table(spark, path, "o_orderkey bigint, o_orderpriority string, price double, remark string")


@query("""WITH h AS (SELECT l_orderkey::VARCHAR AS qseqid, l_partkey::VARCHAR AS sseqid, 95.0::DOUBLE + l_partkey % 5 AS pident, l_quantity::INTEGER AS length, (l_quantity + l_orderkey % 40)::INTEGER AS qlen FROM lineitem), k AS (SELECT qseqid, sseqid, pident, 100.0::DOUBLE * length / qlen AS coverage FROM h WHERE qlen > 0 AND pident >= 97 AND 100.0::DOUBLE * length / qlen >= 51)
 SELECT qseqid, sseqid, pident, round(coverage, 6) AS coverage FROM (SELECT DISTINCT * FROM k) QUALIFY row_number() OVER (PARTITION BY qseqid ORDER BY pident DESC, sseqid, coverage) = 1""")
def src4_src5_best_hits(spark, d):
    """Headless hit tables of two folders under one pattern."""
    q, s, n = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_quantity").cast("int")
    zero = [F.lit(0).alias(c) for c in ("mismatch", "gapopen", "qstart", "qend", "sstart", "send", "evalue", "bitscore")]
    li = load(spark, d, "lineitem")
    hits = li.select(q.alias("qseqid"), s.alias("sseqid"), (95.0 + s % 5).alias("pident"), n.alias("length"), (F.col("l_quantity") + q % 40).cast("int").alias("qlen"), *zero, (q % 2).alias("half"))
    top = scratch(spark, "hits")
    for i in (0, 1):
        hits.where(F.col("half") == i).drop("half").write.option("sep", "\t").csv(f"{top}/run{i}")
    return _rounded(readers.best_hits(readers.read_blast6(spark, f"{top}/run*")))


@query("SELECT o_custkey::VARCHAR AS id, min(o_orderpriority) AS label FROM orders GROUP BY 1")
def src6_ragged_fields(spark, d):
    """Lines of two or three fields between heads and blank lines; the first label by text stays."""
    o = load(spark, d, "orders").select(F.concat_ws("\t", F.col("o_custkey").cast("string"), "o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus"))).alias("value"), F.col("o_orderkey") % 50 == 0)
    path = scratch(spark, "ragged")
    o.select("value").union(o.where(o[1]).select(F.lit(""))).union(o.where(o[1]).select(F.lit("SEQUENCE_ID\tlabel"))).write.text(path)
    return readers.read_two_fields(spark, path, ("id", "label"), "sequence_id")


@query("SELECT p_partkey || '||' || p_brand || '||' || CASE WHEN p_size % 2 = 0 THEN '0.0' ELSE '0.5' END AS id, upper(replace(p_name, ' ', '')) || 'ACGT' AS seq FROM part")
def src7_snk3_annotated_fasta(spark, d):
    """Records of several lines under heads that carry a taxon and its consensus."""
    p = load(spark, d, "part")
    path = scratch(spark, "fasta")
    seqs = p.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit("\nac\ngt")).alias("seq"), F.col("p_brand").alias("taxon"), F.when(F.col("p_size") % 2 == 0, 0.0).otherwise(0.5).alias("consensus"))
    readers.write_fasta(seqs, path, results.annotated_header())
    return readers.read_fasta(spark, path).select("id", "seq")


@query("SELECT o_orderpriority AS grp, o_orderkey::VARCHAR AS id, upper(o_orderstatus) AS seq FROM orders")
def snk3_group_fasta(spark, d):
    """A folder for each group, each read by itself."""
    path = scratch(spark, "groups")
    results.write_group_fasta(load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("seq"), F.col("o_orderpriority").alias("grp")), path, "grp")
    out = None
    for kind in TYPES:
        one = readers.read_fasta(spark, f"{path}/grp={kind}").select(F.lit(kind).alias("grp"), "id", "seq")
        out = one if out is None else out.union(one)
    return out


@query(f"""{CT}, s AS (SELECT DISTINCT sample, patient::VARCHAR AS patient, sample_type AS "Type" FROM c WHERE sample_type IN ('1-URGENT', '2-HIGH')) SELECT *, 'S' || lpad(dense_rank() OVER (ORDER BY sample)::VARCHAR, 3, '0') AS sample_code, 'P' || (dense_rank() OVER (ORDER BY patient) - 1) AS patient_code FROM s""")
def src9_metadata(spark, d):
    """Padded cells, rows without a sample and other types in the file; codes of the kept rows."""
    s = counts(spark, d, "type").select(F.concat(F.lit(" "), "sample").alias("sample"), "patient", F.concat("sample_type", F.lit(" ")).alias("Type")).distinct()
    path = f"{scratch(spark, 'metadata')}.tsv"
    readers.write_table(s.union(s.where("patient = 3").withColumn("sample", F.lit(" "))), path)
    return results.read_metadata(spark, path, "sample", "patient", ["1-URGENT", "2-HIGH"])


@query(f"WITH {TAXONOMY_SQL} SELECT feature::VARCHAR AS feature, taxon, CASE WHEN feature % 3 <> 0 THEN feature % 4 / 4.0::DOUBLE END AS consensus FROM tx")
def src10_taxonomy(spark, d):
    """Ids with sizes behind them, a consensus that is no number in places."""
    t = taxonomy(spark, d)
    path = f"{scratch(spark, 'taxonomy')}.tsv"
    shown = F.when(F.col("feature") % 3 != 0, (F.col("feature") % 4 / 4).cast("string")).otherwise("none")
    readers.write_table(t.select(F.concat("feature", F.lit(";size="), F.col("feature") % 9).alias("Feature ID"), F.col("taxon").alias("Taxon"), shown.alias("Consensus")), path)
    return results.read_taxonomy(spark, path)


@query("SELECT 'lib' || o_custkey AS sample, sum(floor(o_totalprice))::BIGINT AS reads FROM orders GROUP BY 1")
def src11_read_stats(spark, d):
    """Numbers with commas, a row for each file of a sample."""
    o = load(spark, d, "orders")
    path = scratch(spark, "reads")
    name = F.concat(F.lit("lib"), "o_custkey", F.lit("_L"), F.col("o_orderkey") % 8, F.lit("_R1.fastq.gz"))
    o.select(name.alias("file"), F.format_number(F.floor("o_totalprice"), 0).alias("num_seqs")).write.option("header", True).option("sep", "\t").csv(path)
    return results.read_stats(spark, path, "file", "num_seqs", r"_L\d+_R[12]\.fastq\.gz$")


@query(f"{E1} SELECT 'node' AS kind, node::VARCHAR AS a, NULL AS b, degree::DOUBLE AS value FROM dg UNION ALL SELECT 'edge', a::VARCHAR, b::VARCHAR, weight FROM ed")
def src12_snk4_graphml(spark, d):
    e = shared_orders(spark, d)
    path = scratch(spark, "graph")
    results.write_graphml(network.degrees(e).select(F.col("node").alias("id"), "degree"), e, path)
    nodes, edges = readers.read_graphml(spark, path)
    return nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), F.col("data")["degree"].cast("double").alias("value")).union(
        edges.select(F.lit("edge"), "a", "b", F.col("data")["weight"].cast("double")))


@query(f"{E1} SELECT x.node || '-' || y.node AS pair, weight FROM ed JOIN dg x ON x.node = a JOIN dg y ON y.node = b")
def snk4_gml(spark, d):
    """Edges of the text, with the labels of the numbers they name."""
    e = shared_orders(spark, d)
    path = scratch(spark, "graph")
    results.write_gml(network.degrees(e).select(F.col("node").alias("id"), "degree"), e, path)
    lines = spark.read.text(path)
    part = lambda pattern: F.regexp_extract("value", pattern, 1)
    nodes = lines.where(F.col("value").startswith("node")).select(part(r"id (-?\d+)").alias("n"), part(r'label "([^"]*)"').alias("label"))
    edges = lines.where(F.col("value").startswith("edge")).select(part(r"source (-?\d+)").alias("s"), part(r"target (-?\d+)").alias("t"), part(r"weight ([\d.]+)").cast("double").alias("weight"))
    return edges.join(nodes.toDF("s", "x"), "s").join(nodes.toDF("t", "y"), "t").select(F.concat_ws("-", "x", "y").alias("pair"), "weight")


@query(f"{CB}, s0 AS (SELECT 'n' || patient AS patient, feature, sum(count) AS count FROM c GROUP BY ALL), {bray_sql('s0', 'patient', 'count')} SELECT id1 AS feature, id2 AS sample, round(dist, 6) AS count FROM bc WHERE dist <> 0 UNION ALL SELECT id2, id1, round(dist, 6) FROM bc WHERE dist <> 0")
def snk2_square_distances(spark, d):
    """Both triangles of a square table of distances between patients."""
    s = counts(spark, d, "brand").groupBy(F.concat(F.lit("n"), "patient").alias("patient"), "feature").agg(F.sum("count").alias("count"))
    path = scratch(spark, "square")
    readers.write_square(distance.bray_curtis(s, "patient"), path)
    return _rounded(readers.read_counts(spark, path))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS status, o_totalprice AS price, o_totalprice > 1000 AS large FROM orders")
def snk5_json_rows(spark, d):
    rows = load(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("status"), F.col("o_totalprice").alias("price"), (F.col("o_totalprice") > 1000).alias("large"))
    path = scratch(spark, "json")
    results.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 3 < 2")
def snk6_appended_once(spark, d):
    """Three calls, the last of which repeats the rows of both before it."""
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    path = scratch(spark, "ledger")
    for part in ("l_orderkey % 3 = 0", "l_orderkey % 3 = 1", "l_orderkey % 3 < 2"):
        out = results.append_once(rows.where(part), ["l_orderkey", "l_linenumber"], path)
    return out


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def snk6_header_of_the_first(spark, d):
    """Two appended tables with column names in the first files only."""
    path = scratch(spark, "appended")
    o = load(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    for half in (0, 1):
        results.append_table(o.where(F.col("o_orderkey") % 2 == half), path)
    back = spark.read.option("sep", "\t").schema("key string, o_orderpriority string").csv(path)
    return back.where("key <> 'o_orderkey'").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT (l_suppkey % 6)::INTEGER AS chunk, l_partkey, sum(l_quantity)::BIGINT AS quantity FROM lineitem GROUP BY ALL")
def snk7_resumed_chunks(spark, d):
    """A run over some chunks, then one over all, which takes those that are left."""
    li = load(spark, d, "lineitem").select((F.col("l_suppkey") % 6).cast("int").alias("chunk"), "l_partkey", "l_quantity")
    work = lambda df: df.groupBy("chunk", "l_partkey").agg(F.sum("l_quantity").cast("bigint").alias("quantity"))
    path = scratch(spark, "chunks")
    results.run_chunks(li.where("chunk < 2"), "chunk", work, path)
    return results.run_chunks(li, "chunk", work, path)


@query("""SELECT 'lines' AS name, count(*) AS n_rows, count(DISTINCT l_partkey) AS n_keys, count(*) - count(DISTINCT l_partkey) AS n_repeated FROM lineitem UNION ALL SELECT 'parts', count(*), count(DISTINCT p_partkey), count(*) - count(DISTINCT p_partkey) FROM part""")
def snk10_audit_manifest(spark, d):
    tables = {"lines": load(spark, d, "lineitem").withColumnRenamed("l_partkey", "key"), "parts": load(spark, d, "part").withColumnRenamed("p_partkey", "key")}
    return results.audit(tables, "key")[0]


@query("SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 6) AS price FROM part WHERE p_size >= 10 GROUP BY 1")
def src14_kept_result(spark, d):
    """The second call reads what the first has kept: its own work would fail."""
    folder, path = scratch(spark, "kept"), f"{d}/part.parquet"
    make = lambda: load(spark, d, "part").where("p_size >= 10").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 6).alias("price"))
    results.cached([path], {"least": 10}, folder, make)
    return results.cached([path], {"least": 10}, folder, lambda: make().select(F.raise_error(F.lit("computed again"))))


@query(f"{CT} SELECT sample_type AS name, feature, sum(count)::DOUBLE AS total FROM c WHERE sample_type IN ('1-URGENT', '3-MEDIUM') GROUP BY ALL")
def src15_listed_tables(spark, d):
    """Of a folder of tables the listed ones; one listed table is not there."""
    top = scratch(spark, "tables")
    c = counts(spark, d, "type")
    for kind in TYPES[:3]:
        readers.write_table(c.where(F.col("sample_type") == kind).select("sample", "feature", "count"), f"{top}/{kind}.tsv")
    found, missing = results.whitelisted(spark, top, ["3-MEDIUM", "1-URGENT", "9-NONE"])
    if missing != ["9-NONE"]:
        raise ValueError(f"missing tables are {missing}")
    out = None
    for name, path in found:
        one = readers.read_table(spark, path).groupBy(F.lit(name).alias("name"), "feature").agg(F.sum(F.col("count").cast("double")).alias("total"))
        out = one if out is None else out.union(one)
    return out


@query(f"""WITH {PATIENTS_SQL} SELECT "case" || ':' || o_orderkey AS id, (row_number() OVER (ORDER BY "case" || ':' || o_orderkey) - 1) // 100 AS chunk FROM orders JOIN customer ON o_custkey = c_custkey JOIN pt ON patient = c_nationkey""")
def seq4_seq12_relabelled_chunks(spark, d):
    """Ids that begin with the sample, in chunks of a hundred records."""
    o = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(patients(spark, d), F.col("c_nationkey") == F.col("patient"))
    reads = o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("seq"), F.col("case").alias("sample"))
    return sequences.chunked(sequences.relabelled(reads), 100).select("id", "chunk")
