"""Filters and labels of sparse counts and sample metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_number(col: Column) -> Column:
    """Text to double; what is no number is 0."""
    return F.coalesce(col.try_cast("double"), F.lit(0.0))


def present(counts: DataFrame, value: str = "count") -> DataFrame:
    return counts.where(F.col(value) > 0)


def keep_groups(df: DataFrame, col: str, keep: list | None = None, drop: list | None = None) -> DataFrame:
    if keep is not None:
        df = df.where(F.col(col).isin(keep))
    return df.where(~F.col(col).isin(drop)) if drop is not None else df


def samples_of_depth(counts: DataFrame, least: int) -> DataFrame:
    """Rows of samples whose total is at least ``least``; totals are pre-aggregated and semi-joined."""
    deep = counts.groupBy("sample").agg(F.sum("count").alias("t")).where(F.col("t") >= least).select("sample")
    return counts.join(deep, "sample", "left_semi")


def features_of_share(counts: DataFrame, least_percent: float) -> DataFrame:
    """(feature, total, percent) of features with at least that percentage of the grand total."""
    totals = counts.groupBy("feature").agg(F.sum("count").alias("total"))
    everything = counts.agg(F.sum("count").alias("all"))
    return totals.crossJoin(F.broadcast(everything)).select("feature", "total", (F.lit(100.0) * F.col("total") / F.col("all")).alias("percent")).where(F.col("percent") >= least_percent)


def prevalent(counts: DataFrame, unit: str | list[str], least: float, value: str = "count") -> DataFrame:
    """(feature, prevalence): the share of all units in which a feature is present, if at least ``least``."""
    keys = [unit] if isinstance(unit, str) else unit
    units = counts.select(*keys).distinct().agg(F.count(F.lit(1)).alias("units"))
    seen = counts.where(F.col(value) > 0).select("feature", *keys).distinct().groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    return seen.crossJoin(F.broadcast(units)).select("feature", (F.col("n") / F.col("units")).alias("prevalence")).where(F.col("prevalence") >= least)


def reaching_share(rel: DataFrame, least: float, value: str = "p") -> DataFrame:
    """(feature, max_p) of features whose share reaches ``least`` in some sample."""
    return rel.groupBy("feature").agg(F.max(value).alias("max_p")).where(F.col("max_p") >= least)


def varying(counts: DataFrame, n_samples: int, value: str = "count") -> DataFrame:
    """(feature, variance) where the variance over all samples, absent ones as zero, is positive."""
    x = F.col(value).cast("double")
    sums = counts.groupBy("feature").agg(F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    return sums.select("feature", ((F.col("q") - F.col("s") * F.col("s") / n_samples) / (n_samples - 1)).alias("variance")).where(F.col("variance") > 1e-12)


def reaching_count(counts: DataFrame, least: int) -> DataFrame:
    return counts.groupBy("feature").agg(F.max("count").alias("max_count")).where(F.col("max_count") >= least)


def deepest_replicate(totals: DataFrame, group: list[str], total: str, tie: str) -> DataFrame:
    """The row of largest total in each group; ties by the least ``tie``."""
    w = Window.partitionBy(*group).orderBy(F.desc(total), F.asc(tie))
    return totals.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def canonical_case(case: Column) -> Column:
    """Control and Non-Cancer are Control; everything else, also null, is Cancer."""
    return F.when(case.isin("Control", "Non-Cancer"), "Control").otherwise("Cancer")


#: Names by which sample types are known (fixed values).
SAMPLE_TYPES = {"lung brush": "Bronchial Brush", "bronchial brush": "Bronchial Brush", "bal": "BAL", "oral rinse": "Oral Rinse", "skin brush": "Skin Brush", "scope flush": "Scope Flush"}


def canonical_type(col: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SAMPLE_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(col))), col)


def side_status(site: Column, code: Column, missing: str) -> Column:
    """TumorSide if the first letters of tumour site and sample code agree, else Contralateral.

    ``missing`` says what a missing side means: ``as_n`` (null reads as N, so two nulls
    agree), ``contralateral`` or ``healthy``.
    """
    letter = lambda c: F.upper(F.substring(c, 1, 1))
    if missing == "as_n":
        return F.when(letter(F.coalesce(site, F.lit("N"))) == letter(F.coalesce(code, F.lit("N"))), "TumorSide").otherwise("Contralateral")
    if missing not in ("contralateral", "healthy"):
        raise ValueError(f"unknown policy {missing!r}")
    return F.when(site.isNull() | code.isNull(), missing.capitalize()).when(letter(site) == letter(code), "TumorSide").otherwise("Contralateral")


def lung_status(case: Column, site: Column, code: Column) -> Column:
    """TumorSide, Contralateral, Healthy, Other or Unknown."""
    sides = F.create_map(F.lit("Left"), F.lit("L"), F.lit("Right"), F.lit("R"))
    own = F.try_element_at(sides, site)
    return (
        F.when(case.isNull(), "Unknown")
        .when(case.isin("Control", "Non-Cancer"), "Healthy")
        .when(own.isNull() | ~F.coalesce(code.isin("L", "R"), F.lit(False)), "Other")
        .when(own == code, "TumorSide")
        .otherwise("Contralateral")
    )


def without_contralateral(df: DataFrame, case: str, site: str, code: str, missing: str = "as_n") -> DataFrame:
    """Drops contralateral samples of cases."""
    return df.where(~((canonical_case(F.col(case)) == "Cancer") & (side_status(F.col(site), F.col(code), missing) == "Contralateral")))


def groups_of_size(df: DataFrame, group: str, unit: str, least: int) -> DataFrame:
    """Rows of groups with at least ``least`` distinct units."""
    large = df.groupBy(group).agg(F.countDistinct(unit).alias("n")).where(F.col("n") >= least).select(group)
    return df.join(large, group, "left_semi")


def units_with_groups(df: DataFrame, unit: str, group: str, least: int, of: list | None = None) -> DataFrame:
    """Rows of units that have at least ``least`` of the groups (of those in ``of``, if given)."""
    rows = keep_groups(df, group, of)
    full = rows.groupBy(unit).agg(F.countDistinct(group).alias("n")).where(F.col("n") >= least).select(unit)
    return rows.join(full, unit, "left_semi")


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna("any", subset=columns)


def strong_indicators(isa: DataFrame, pairs: list[tuple[str, str]], least: float) -> DataFrame:
    """Rows with some significance flag set and some statistic of at least ``least``; missing is false and 0."""
    flag, stat = F.lit(False), F.lit(False)
    for f, s in pairs:
        flag |= F.coalesce(F.col(f), F.lit(False))
        stat |= F.coalesce(F.col(s), F.lit(0.0)) >= least
    return isa.where(flag & stat)


def edges_above(edges: DataFrame, threshold: float, positive_only: bool = True) -> DataFrame:
    w = F.col("weight")
    return edges.where(w >= threshold if positive_only else F.abs(w) >= threshold)


def varying_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns with more than one distinct value; one aggregate over the table."""
    row = df.agg(*[F.countDistinct(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] > 1]
