"""Operators on sequences: quality, dereplication, near matches and consensus taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expected_errors(quality: Column, offset: int = 33) -> Column:
    """Sum of 10^(-Q/10) over a quality string."""
    return F.aggregate(F.split(quality, ""), F.lit(0.0), lambda acc, c: acc + F.when(c == "", 0.0).otherwise(F.pow(F.lit(10.0), -(F.ascii(c) - offset) / 10.0)))


def pass_filter(reads: DataFrame, most_errors: float, shortest: int, longest: int) -> DataFrame:
    return reads.where((expected_errors(F.col("quality")) <= most_errors) & F.length("seq").between(shortest, longest))


def dereplicated(reads: DataFrame, least: int = 1) -> DataFrame:
    """(seq, size): distinct sequences that occur at least ``least`` times."""
    return reads.groupBy("seq").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)


def one_edit_pairs(seqs: DataFrame) -> DataFrame:
    """(a, b): pairs of ids (a < b) whose distinct sequences differ by at most one substitution, insertion or deletion.

    Every sequence is filed under hashes of itself and of each of its texts with one character
    left out; two sequences within one edit share such a key, so no pair is missed and
    unrelated ones don't meet. Matches are verified.
    """
    place = F.explode(F.sequence(F.lit(1), F.greatest(F.length("seq"), F.lit(1))))
    cut = seqs.select("id", place.alias("i"), "seq").select("id", F.xxhash64(F.concat(F.substring("seq", F.lit(1), F.col("i") - 1), F.substring("seq", F.col("i") + 1, F.length("seq")))).alias("key"))
    keys = cut.union(seqs.select("id", F.xxhash64("seq").alias("key"))).distinct()
    met = keys.toDF("a", "key").join(keys.toDF("b", "key"), "key").where("a < b").select("a", "b").distinct()
    near = met.join(seqs.toDF("a", "sa"), "a").join(seqs.toDF("b", "sb"), "b")
    return near.where(F.levenshtein("sa", "sb", 1) >= 0).select("a", "b")


def _classes(seqs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seq, class_id) of the distinct sequences, the least id standing for equal ones, and their links (a, b)."""
    classes = seqs.groupBy("seq").agg(F.min("id").alias("class_id"))
    return classes, one_edit_pairs(classes.select(F.col("class_id").alias("id"), "seq"))


def one_edit_links(seqs: DataFrame) -> DataFrame:
    """(id, class_id, n_links) of rows (id, seq): equal sequences share a class, n_links counts the classes one edit away."""
    classes, pairs = _classes(seqs)
    each = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    return seqs.join(classes, "seq").join(each, "class_id", "left").select("id", "class_id", F.coalesce("n", F.lit(0)).alias("n_links"))


def one_edit_clusters(seqs: DataFrame) -> DataFrame:
    """(id, cluster): the least id that single edits reach."""
    from .network import components

    classes, pairs = _classes(seqs)
    found = components(pairs.withColumn("weight", F.lit(1.0)))
    return seqs.join(classes, "seq").join(found.select(F.col("node").alias("class_id"), "component"), "class_id", "left").select("id", F.coalesce("component", "class_id").alias("cluster"))


def relabelled(reads: DataFrame, sample: str = "sample") -> DataFrame:
    """Reads of several samples as one table whose ids begin with the sample: ``sample:id``."""
    return reads.withColumn("id", F.concat_ws(":", F.col(sample), F.col("id")))


def chunked(seqs: DataFrame, size: int) -> DataFrame:
    """Adds ``chunk`` (long): pieces of exactly ``size`` records in the order of their ids, the last one shorter; repeated ids stand in the order of their sequences.

    Records are ranged by id and sequence and numbered part by part; a row for each part holds how many come before it.
    """
    from ..streaming.checkpoints import cut

    parts = int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = seqs.repartitionByRange(parts, "id", "seq").sortWithinPartitions("id", "seq")
    placed = cut(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_k")))
    totals = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = totals.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(starts), "_part").select(*seqs.columns, F.floor((F.col("_before") + F.col("_k")) / size).alias("chunk"))


def consensus_taxonomy(hits: DataFrame, least: float = 0.51) -> DataFrame:
    """(query, taxon, consensus) from hits (query, taxon): the commonest name if its share reaches ``least``, else Unassigned."""
    votes = hits.groupBy("query", "taxon").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("query").agg(F.max(F.struct("n", "taxon")).alias("b"), F.sum("n").alias("m"))
    share = F.col("b.n") / F.col("m")
    return best.select("query", F.when(share >= least, F.col("b.taxon")).otherwise("Unassigned").alias("taxon"), share.alias("consensus"))
