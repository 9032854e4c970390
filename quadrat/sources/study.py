"""The study tables as views of the star schema: patients are nations, sample types order priorities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = {"part": "l_partkey", "brand": "p_brand", "type": "p_type"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counts(spark: SparkSession, sf_dir: str, level: str = "part") -> DataFrame:
    """(patient, sample_type, sample, feature, count): a sparse count table, one row for each non-zero cell."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("sample_type"))
    customers = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("patient"))
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    if level != "part":
        parts = load(spark, sf_dir, "part").select("p_partkey", F.col(FEATURES[level]).alias("feature"))
        joined = joined.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    else:
        joined = joined.withColumn("feature", F.col("l_partkey"))
    return joined.groupBy("patient", "sample_type", F.concat_ws("|", "patient", "sample_type").alias("sample"), "feature").agg(F.sum("l_quantity").cast("bigint").alias("count"))


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(patient, name, region, case): two regions are cases, the others controls."""
    n = load(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("patient"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), F.when(F.col("n_regionkey") < 2, "Cancer").otherwise("Control").alias("case"))


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature, taxon): lineages made of part type, brand and name; every tenth part is unassigned."""
    p = load(spark, sf_dir, "part")
    lineage = F.concat(F.lit("d__"), F.col("p_type"), F.lit("; p__"), F.col("p_brand"), F.lit("; f__"), F.col("p_name"))
    return p.select(F.col("p_partkey").alias("feature"), F.when(F.col("p_partkey") % 10 == 0, "Unassigned").otherwise(lineage).alias("taxon"))


#: The same views as common table expressions; {feature} and {join} depend on the level.
_SQL = """c AS (SELECT c_nationkey AS patient, o_orderpriority AS sample_type, c_nationkey || '|' || o_orderpriority AS sample, {feature} AS feature, CAST(sum(l_quantity) AS BIGINT) AS count
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey {join} GROUP BY ALL)"""


def counts_sql(level: str = "part") -> str:
    join = "" if level == "part" else "JOIN part ON l_partkey = p_partkey"
    return _SQL.format(feature=FEATURES[level], join=join)


PATIENTS_SQL = """pt AS (SELECT n_nationkey AS patient, n_name AS name, n_regionkey AS region, CASE WHEN n_regionkey < 2 THEN 'Cancer' ELSE 'Control' END AS "case" FROM nation)"""
TAXONOMY_SQL = """tx AS (SELECT p_partkey AS feature, CASE WHEN p_partkey % 10 = 0 THEN 'Unassigned' ELSE 'd__' || p_type || '; p__' || p_brand || '; f__' || p_name END AS taxon FROM part)"""
