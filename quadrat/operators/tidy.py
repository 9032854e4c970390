"""The tables behind figures: flows between stages, matrices of effects and of pairs, distances by contrast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage_links(samples: DataFrame, group: str, stages: list[str]) -> DataFrame:
    """(source, target, value) of a flow diagram: groups into the first stage, stage into stage, what each loses, the last stage into groups.

    ``samples`` has a column of reads for each stage. Links without reads are left out.
    """
    by = samples.groupBy(group).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in stages])
    total = by.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in stages])
    link = lambda source, target, value: F.struct(source.alias("source"), target.alias("target"), value.alias("value"))
    stage = lambda c: F.lit(f"stage::{c}")
    ends = [link(F.concat(F.lit("raw_type::"), F.col(group)), stage(stages[0]), F.col(stages[0])), link(stage(stages[-1]), F.concat(F.lit("fin_type::"), F.col(group)), F.col(stages[-1]))]
    chain = [x for a, b in zip(stages, stages[1:], strict=False) for x in (link(stage(a), stage(b), F.col(b)), link(stage(a), F.lit(f"loss::after_{a}"), F.col(a) - F.col(b)))]
    return by.select(F.inline(F.array(*ends))).unionByName(total.select(F.inline(F.array(*chain)))).where("value > 0")


def effect_matrix(results: DataFrame, row: str, column: str, q: str, value: str, columns: list[str], most: int) -> DataFrame:
    """A row for each of the ``most`` rows of least q over all columns (ties by name), with its value in each of ``columns`` and its rank."""
    ranked = results.groupBy(row).agg(F.min(q).alias("_q")).where("_q is not null").orderBy("_q", row).limit(most)
    held = results.join(ranked, row).groupBy(row, "_q").pivot(column, columns).agg(F.first(value))
    return held.withColumnRenamed("_q", "min_q")


def pair_matrix(pairs: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """(first, second, value) with every pair in both directions, as a symmetric matrix has them; equal ends are left out."""
    both = pairs.select(first, second, value).unionByName(pairs.select(F.col(second).alias(first), F.col(first).alias(second), value))
    return both.where(F.col(first) != F.col(second)).distinct()


def contrast_distances(pairs: DataFrame, labels: DataFrame, unit: str, patient: str, status: str, within: dict[str, tuple[str, str]], between: dict[str, tuple[str, str]]) -> DataFrame:
    """(contrast, id1, id2, dist) of pairs (id1, id2, dist): two statuses of one patient, or of two patients; other pairs are left out."""
    side = lambda i: labels.select(F.col(unit).alias(f"id{i}"), F.col(patient).alias(f"p{i}"), F.col(status).alias(f"s{i}"))
    both = pairs.join(side(1), "id1").join(side(2), "id2")
    same, low, high = F.col("p1") == F.col("p2"), F.least("s1", "s2"), F.greatest("s1", "s2")
    name = F.lit(None).cast("string")
    for contrasts, where in ((within, same), (between, ~same)):
        for label, ends in contrasts.items():
            name = F.when(where & (low == min(ends)) & (high == max(ends)), label).otherwise(name)
    return both.select(name.alias("contrast"), "id1", "id2", "dist").where("contrast is not null")
