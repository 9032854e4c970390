"""Overlap of feature sets across groups. A feature's groups are one bitmask, so all regions come from one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def membership_mask(df: DataFrame, group: str, order: list, key: str = "feature") -> DataFrame:
    """(key, mask): bit i is set if the key occurs in group ``order[i]``. Other groups don't count."""
    bit = F.array_position(F.array(*map(F.lit, order)), F.col(group)) - 1
    rows = df.where(F.col(group).isin(order))
    return rows.groupBy(key).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.cast("int"))).alias("mask"))


def mask_label(mask: Column, order: list, separator: str = " + ") -> Column:
    names = [F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(g)) for i, g in enumerate(order)]
    return F.concat_ws(separator, *names)


def exclusive_regions(df: DataFrame, group: str, order: list, key: str = "feature") -> DataFrame:
    """(grouping, key): the one region of the Venn diagram in which each key lies."""
    return membership_mask(df, group, order, key).select(mask_label(F.col("mask"), order).alias("grouping"), key)


def region_sizes(df: DataFrame, group: str, order: list, key: str = "feature", value: str = "count") -> DataFrame:
    """(grouping, n_features, total) of every non-empty region."""
    totals = df.where(F.col(group).isin(order)).groupBy(key).agg(F.sum(value).alias("total"))
    return exclusive_regions(df, group, order, key).join(totals, key).groupBy("grouping").agg(F.count(F.lit(1)).alias("n_features"), F.sum("total").alias("total"))


def upset_rows(df: DataFrame, group: str, order: list, key: str = "feature", value: str = "count") -> DataFrame:
    """(key, group, total, mask): a row for each feature and group with what it weighs there."""
    weights = df.where(F.col(group).isin(order)).groupBy(key, group).agg(F.sum(value).alias("total"))
    return weights.join(membership_mask(df, group, order, key), key)


def regroup(df: DataFrame, group: str, mapping: dict[str, str]) -> DataFrame:
    """Replaces group names; names that ``mapping`` lacks stay."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(group, F.coalesce(F.try_element_at(pairs, F.col(group)), F.col(group)))
