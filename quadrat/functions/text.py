"""Column functions on ids, lineages and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

RANKS = ("domain", "phylum", "class", "order", "family", "genus", "species")
#: Prefix letters of the ranks in lineage strings such as ``d__Bacteria; p__Firmicutes`` (fixed values).
PREFIXES = ("d", "p", "c", "o", "f", "g", "s")


def feature_id(col: Column) -> Column:
    """The id before ``;`` (``;size=`` and the like go)."""
    return F.trim(F.substring_index(col, ";", 1))


def lineage_parts(taxon: Column, delimiter: str = ";") -> Column:
    return F.transform(F.split(taxon, delimiter), lambda x: F.trim(x))


def rank_name(taxon: Column, rank: str, mode: str = "by_prefix", fill: str | None = None) -> Column:
    """One rank of a lineage.

    ``by_prefix``: the part that begins with the rank's letter and two underscores;
    ``by_position``: the part at the rank's place, without its prefix if it has one.
    Missing and empty names are ``fill``; an unassigned lineage has no ranks.
    """
    k = RANKS.index(rank)
    parts = lineage_parts(taxon)
    if mode == "by_prefix":
        part = F.get(F.filter(parts, lambda x: x.startswith(f"{PREFIXES[k]}__")), F.lit(0))
        name = F.substring(part, F.lit(4), F.length(part))
    elif mode == "by_position":
        name = F.regexp_replace(F.get(parts, F.lit(k)), "^[a-z]__", "")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    name = F.when(taxon != "Unassigned", F.nullif(F.trim(name), F.lit("")))
    return name if fill is None else F.coalesce(name, F.lit(fill))


def filled_ranks(taxon: Column) -> list[Column]:
    """All ranks; a missing one is ``unknown_<last known>``, or ``unknown`` at the top."""
    out: list[Column] = []
    last = F.lit(None).cast("string")
    for r in RANKS:
        name = rank_name(taxon, r)
        out.append(F.coalesce(name, F.concat(F.lit("unknown_"), last), F.lit("unknown")).alias(r))
        last = F.coalesce(name, last)
    return out


def sample_from_path(path: Column, pattern: str = r"([^/]+?)(?:\.[A-Za-z0-9]+)*$") -> Column:
    """The first group of ``pattern``; by default the file name without extensions."""
    return F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))


def chop_tokens(name: Column, n: int, separator: str = "_", short: str = "first") -> Column:
    """Drops the last ``n`` tokens. Names with no more than ``n``: the ``first`` token, or the ``whole`` name."""
    parts = F.split(name, separator)
    kept = F.array_join(F.slice(parts, 1, F.size(parts) - n), separator)
    return F.when(F.size(parts) > n, kept).otherwise(F.get(parts, F.lit(0)) if short == "first" else name)


def safe_token(text: Column) -> Column:
    """Letters, digits and underscores; other runs become one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")


def key_values(text: Column, pair: str = ",", value: str = "=") -> Column:
    """``a=1,b=2`` as a map."""
    return F.str_to_map(text, F.lit(pair), F.lit(value))


def combo_label(text: Column, separator: str = r"\+") -> Column:
    """Parts of a group combination in sorted order, joined by `` + ``."""
    return F.array_join(F.array_sort(F.transform(F.split(text, separator), lambda x: F.trim(x))), " + ")


def pair_label(a: Column, b: Column, separator: str = " vs ") -> Column:
    return F.concat(F.least(a, b), F.lit(separator), F.greatest(a, b))


def stars(q: Column) -> Column:
    """Significance marks at 0.001, 0.01 and 0.05."""
    return F.when(q < 0.001, "***").when(q < 0.01, "**").when(q < 0.05, "*").otherwise("")


def family_genus(family: Column, genus: Column) -> Column:
    named = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("Unassigned"))
    return F.concat_ws(" ", named(family), named(genus))


def contains_ignoring_case(text: Column, part: str) -> Column:
    return F.coalesce(F.lower(text).contains(part.lower()), F.lit(False))


def ordered_position(col: Column, order: list[str]) -> Column:
    """Sort key: place in ``order``, then everything else."""
    return reduce(lambda acc, p: acc.when(col == p[1], p[0]), list(enumerate(order))[1:], F.when(col == order[0], 0)).otherwise(len(order))


def short_number(x: Column) -> Column:
    """From a thousand on in thousands with one decimal, else a whole number; null stays null."""
    return F.when(x >= 1000, F.concat(F.format_string("%.1f", (x / 1000).cast("double")), F.lit("k"))).otherwise(x.cast("bigint").cast("string"))
