"""Merkle manifest of a dataset: a ternary tree for each source, one over the sources, proofs and their folding.

Leaves are dealt by superblock, by default the 729 leaves below one node six levels up. A source's superblocks are reduced by
themselves, their nodes again by superblock, and so on to one subroot; the subroots are reduced in the same way. Back
down, the nodes outside a superblock that its proofs need are cogrouped with its nodes. So no task holds more than
a superblock and one path, however large a source is, and what moves is digests, never texts.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize

FANOUT, LEVELS = 3, 6
PATH = "array<struct<before: string, after: string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(c: Column) -> Column:
    """A value with its length in bytes before it, so that no two rows read alike; ``-`` for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(text: Column) -> Column:
    return F.sha2(F.concat(*(field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), field(text)), 256)


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, source, leaf, and where the ``tampered`` text differs its leaf (else null)."""
    false = F.when(~tampered.eqNullSafe(F.col("text")), leaf_of(tampered))
    return docs.select("doc_id", "source", leaf_of(F.col("text")).alias("leaf"), false.alias("false_leaf"))


def without_line_feeds() -> Column:
    """The tampered text: no line feeds where the CRC-32 of the decimal doc_id is even; a null doc_id leaves the text as it is."""
    even = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0
    return F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))


def placed(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` written in order, nulls first, with ``at``: part number and place in the part, as Spark's increasing ids are made.

    Rows equal in ``order`` are told apart by where they were read, so that even they spread over parts.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    told = df.withColumn("_tie", F.monotonically_increasing_id())
    return materialize(told.repartitionByRange(*keys, F.col("_tie")).sortWithinPartitions(*keys, "_tie").drop("_tie").withColumn("at", F.monotonically_increasing_id()), name)


def numbered_sources(runs: DataFrame) -> DataFrame:
    """source, n, sid: the sources' leaves, and their place in bytewise order, from totals of parts."""
    ordered = placed(runs.groupBy("source").agg(F.sum("k").alias("n")), ["source"], "sources").withColumn("part", F.shiftright("at", 33))
    totals = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("k"), F.min("at").alias("start"))
    offsets = totals.select("part", "start", (F.sum("k").over(W.orderBy("part")) - F.col("k")).alias("before"))  # a row for each part
    return materialize(ordered.join(offsets, "part").select("source", "n", (F.col("before") + F.col("at") - F.col("start")).alias("sid")), "sources")


def numbered_leaves(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The leaves with sid, pos (from 0 in the source, by doc_id, then leaf) and n; and the numbered sources."""
    ordered = placed(materialize(found, "leaves"), ["source", "doc_id", "leaf"], "ordered").withColumn("part", F.shiftright("at", 33))
    runs = materialize(ordered.groupBy("part", "source").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("k")), "runs")
    sources = numbered_sources(runs)
    before = F.sum("k").over(W.partitionBy("source").orderBy("part")) - F.col("k")  # of a source, a row for each part
    runs = runs.select("part", "source", "start", before.alias("before"))
    runs = materialize(runs.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "runs")
    runs = runs.withColumnRenamed("source", "s").withColumnRenamed("part", "p")
    both = ordered.join(runs, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    return both.select("sid", (F.col("before") + F.col("at") - F.col("start")).alias("pos"), "n", "doc_id", "leaf", "false_leaf"), sources


def height(n: int, most: int) -> int:
    """Levels from n nodes to one, ``most`` at most."""
    k = 0
    while n > 1 and k < most:
        n, k = -(-n // FANOUT), k + 1
    return k


def rounds(n: int, block: int) -> int:
    """Reductions by superblock from n nodes to one; at least one."""
    k = 1
    while n > block:
        n, k = -(-n // block), k + 1
    return k


def climb(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level of a superblock, from the given ones to the last."""
    out = [nodes]
    for _ in range(levels):
        nodes = [digest("".join(nodes[i : i + FANOUT])) for i in range(0, len(nodes), FANOUT)]
        out.append(nodes)
    return out


def siblings(tree: list[list[str]], i: int) -> list[dict]:
    """Of node i of the lowest level, what stands before and after it and its ancestors in their runs."""
    path = []
    for level in tree[:-1]:
        k = i % FANOUT
        run = level[i - k : i - k + FANOUT]
        path.append({"before": "".join(run[:k]), "after": "".join(run[k + 1 :])})
        i //= FANOUT
    return path


def fold(node: str, path: list[dict]) -> str:
    for step in path:
        node = digest(step["before"] + node + step["after"])
    return node


def _superblock(pdf: pd.DataFrame, levels: int) -> tuple[pd.DataFrame, list[list[str]]]:
    pdf = pdf.sort_values("pos")
    return pdf, climb(pdf["node"].tolist(), height(int(pdf["n"].iloc[0]), levels))


def block_of(levels: int) -> Column:
    return F.expr(f"pos div {FANOUT**levels}").alias("block")


def reduced(nodes: DataFrame, levels: int) -> DataFrame:
    """sid, pos, n, node: of each superblock of ``nodes`` (the same columns) its one node."""

    def up(key, pdf):
        n = int(pdf["n"].iloc[0])
        return pd.DataFrame({"sid": [key[0]], "pos": [key[1]], "n": [-(-n // FANOUT**levels)], "node": [_superblock(pdf, levels)[1][-1][0]]})

    return nodes.select("sid", "pos", "n", "node", block_of(levels)).groupBy("sid", "block").applyInPandas(up, "sid bigint, pos bigint, n bigint, node string")


def paths(nodes: DataFrame, outer: DataFrame, levels: int) -> DataFrame:
    """sid, pos, path: the siblings on the way from each node to the top, given those of its superblock's node (sid, block, path)."""

    def down(inner, above):
        if inner.empty:
            return pd.DataFrame({"sid": [], "pos": [], "path": []})
        inner, tree = _superblock(inner, levels)
        rest = [dict(x) for x in above["path"].iloc[0]]
        return pd.DataFrame({"sid": inner["sid"], "pos": inner["pos"], "path": [siblings(tree, i) + rest for i in range(len(inner))]})

    left = nodes.select("sid", "pos", "n", "node", block_of(levels)).groupBy("sid", "block")
    return left.cogroup(outer.groupBy("sid", "block")).applyInPandas(down, f"sid bigint, pos bigint, path {PATH}")


def pyramid(nodes: DataFrame, most: int, levels: int, name: str) -> list[DataFrame]:
    """``nodes`` and, round by round, the nodes of their superblocks; trees that are down to one node leave."""
    out = [nodes]
    for _ in range(rounds(most, FANOUT**levels)):
        out.append(materialize(reduced(out[-1] if len(out) == 1 else out[-1].filter("n > 1"), levels), name))
    return out


def descent(trees: list[DataFrame], tops: DataFrame, levels: int, name: str) -> DataFrame:
    """sid, block, path: what the superblocks of the lowest of ``trees`` need from outside; ``tops`` (sid, path) is what the trees' last nodes need."""
    first = [x.filter("n = 1").join(tops, "sid").select("sid", F.col("pos").alias("block"), "path") for x in trees[1:]]
    outer = first[-1]
    for k in range(len(trees) - 2, 0, -1):
        below = materialize(paths(trees[k].filter("n > 1"), outer, levels), name).withColumnRenamed("pos", "block")
        outer = below.unionByName(first[k - 1])
    return outer


def manifest(docs: DataFrame, tampered: Column, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of ``docs``.

    ``levels`` sets the superblock: 3 to that power. The root that folding the row's ``tampered`` text with the original siblings gives is compared with the true one.
    Null sources are a source of their own, null doc_ids come first in it; repeated rows are leaves of
    their own, in any order among equal ones. One row alone is its leaf, subroot and root. An empty table gives
    no rows; other columns are ignored. Texts of any length are hashed by the JVM and don't move.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col("n_chars").cast("long").alias("n_chars"), "text")
    numbered, sources = numbered_leaves(leaves(docs, tampered))
    numbered = materialize(numbered, "numbered")
    sizes = sources.agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("n")).first()
    trees = pyramid(numbered.withColumnRenamed("leaf", "node"), sizes["most"] or 0, levels, "nodes")
    subroots = trees[1].filter("n = 1")
    for more in trees[2:]:
        subroots = subroots.unionByName(more.filter("n = 1"))
    subroots = materialize(subroots.select("sid", F.col("node").alias("subroot")), "subroots")
    tops = subroots.select(F.lit(0).cast("long").alias("sid"), F.col("sid").alias("pos"), F.lit(sizes["n"]).cast("long").alias("n"), F.col("subroot").alias("node"))
    over = pyramid(tops, sizes["n"], levels, "tops")
    root = over[-1].filter("n = 1").select(F.col("node").alias("root"))  # one row
    none = spark.sql(f"SELECT 0L AS sid, CAST(array() AS {PATH}) AS path")
    crown = paths(tops, descent(over, none, levels, "crown"), levels).select(F.col("pos").alias("sid"), "path")
    crown = materialize(crown, "crown")
    outer = descent(trees, crown, levels, "outer").join(subroots, "sid").crossJoin(F.broadcast(root))  # one row

    def finish(inner, above):
        out = {c: [] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root")}
        if len(inner):
            inner, tree = _superblock(inner, levels)
            rest = [dict(x) for x in above["path"].iloc[0]]
            tail = "".join(x["before"] + x["after"] for x in rest)
            for i, (doc_id, leaf, false_leaf) in enumerate(zip(inner["doc_id"], inner["node"], inner["false_leaf"], strict=True)):
                path = siblings(tree, i)
                out["doc_id"].append(None if pd.isna(doc_id) else int(doc_id))
                out["leaf"].append(leaf)
                out["proof_sha256"].append(digest("".join(x["before"] + x["after"] for x in path) + tail))
                out["folded_root"].append(fold(leaf if pd.isna(false_leaf) else false_leaf, path + rest))
            out["subroot"] = [above["subroot"].iloc[0]] * len(inner)
            out["root"] = [above["root"].iloc[0]] * len(inner)
        out["doc_id"] = pd.Series(out["doc_id"], dtype="Int64")
        return pd.DataFrame(out)

    left = numbered.withColumnRenamed("leaf", "node").withColumn("block", block_of(levels)).groupBy("sid", "block")
    done = left.cogroup(outer.groupBy("sid", "block")).applyInPandas(finish, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))
