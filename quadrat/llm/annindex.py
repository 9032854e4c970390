"""Approximate nearest neighbours: coarse cells, product-quantised residuals, exact reranking.

Coarse centroids and the codebooks of the residuals are fitted on a bounded sample; every
vector is then put in its nearest cell and its residual coded, a byte for each subspace.
A query visits its nearest cells, ranks their codes by a table of its distances to the
codewords, and the best are ranked anew by the exact measure on the original vectors.
Vectors are scaled to length one for the index, so the nearest have the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SAMPLE = 20_000
SUBSPACES = 32
#: Rows of the sample and rounds that the codewords of a subspace are fitted with.
CODE_ROWS, CODE_ROUNDS = 8_000, 8
CODEWORDS = 256
BLOCK_ROWS = 4096
BLOCK_QUERIES = 512
RERANK = 200
#: Candidates that a task holds before it drops those that are not among the best of their query.
HELD = 1_000_000
SALTS = 32
#: Part of all rows that a query's nearest cells must hold.
SHARE = 0.7


@dataclass(frozen=True)
class Codebook:
    """centroids: cells x dim; codewords: subspaces x codewords x width (of the padded residual)."""

    centroids: np.ndarray
    codewords: np.ndarray

    def padded(self, x: np.ndarray) -> np.ndarray:
        m, _, width = self.codewords.shape
        return np.pad(x, ((0, 0), (0, m * width - x.shape[1])))

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.argmin(_distances(x, self.centroids), axis=1)

    def codes(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        m, _, width = self.codewords.shape
        residual = self.padded(x - self.centroids[cells]).reshape(len(x), m, width)
        return np.stack([np.argmin(_distances(residual[:, j], self.codewords[j]), axis=1) for j in range(m)], axis=1).astype(np.uint8)

    def tables(self, queries: np.ndarray, cell: int) -> np.ndarray:
        """queries x subspaces x codewords: squared distances of the query's residual parts."""
        m, k, width = self.codewords.shape
        residual = self.padded(queries - self.centroids[cell]).reshape(len(queries), m, width)
        return np.stack([_distances(residual[:, j], self.codewords[j]) for j in range(m)], axis=1)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None, :], 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Lloyd's algorithm from a seeded choice of distinct points; an empty cluster keeps its centre."""
    distinct = np.unique(x, axis=0)
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        near = np.argmin(_distances(x, centres), axis=1)
        count = np.bincount(near, minlength=len(centres))
        order = np.argsort(near, kind="stable")
        full = count > 0
        total = np.zeros_like(centres)
        total[full] = np.add.reduceat(x[order], (np.cumsum(count) - count)[full])
        centres[full] = total[full] / count[full, None]
    return centres


def fit_codebook(sample: np.ndarray, cells: int, subspaces: int = SUBSPACES) -> Codebook:
    centroids = kmeans(sample, cells)
    subspaces = min(subspaces, sample.shape[1])
    width = -(-sample.shape[1] // subspaces)
    residual = sample - centroids[np.argmin(_distances(sample, centroids), axis=1)]
    residual = np.pad(residual, ((0, 0), (0, subspaces * width - residual.shape[1]))).reshape(len(sample), subspaces, width)
    words = []
    for j in range(subspaces):
        found = kmeans(residual[:CODE_ROWS, j], CODEWORDS, CODE_ROUNDS, seed=j + 1)
        words.append(np.concatenate((found, np.repeat(found[:1], CODEWORDS - len(found), axis=0))))
    return Codebook(centroids, np.stack(words))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) without vectors that are null, empty, zero, or hold null or non-finite parts.

    A vector of another length than the most common one can't be compared and is left out too.
    """
    rows = vectors.where("vec_id is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0))
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    return rows.join(F.broadcast(common.select("n")), F.size("embedding") == F.col("n"), "left_semi")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def build_index(rows: DataFrame, cells: int | None = None, sample_rows: int = SAMPLE) -> tuple[DataFrame, Codebook]:
    """((vec_id, cell, code) of every row, the codebook). The sample: the lowest hashes of vec_id.

    The number of cells grows with the square root of the rows, from one up to 4,096.
    """
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("embedding").toPandas()
    if sample.empty:
        return rows.select("vec_id", F.lit(0).alias("cell"), F.lit(b"").alias("code")), Codebook(np.zeros((0, 0)), np.zeros((0, 0, 0)))
    count = rows.count()
    cells = cells or int(max(1, min(4096, count**0.5 / 4, len(sample) / 8)))
    book = fit_codebook(_unit(_matrix(sample["embedding"])), cells)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = _unit(_matrix(b["embedding"]))
                cell = book.cells(x)
                yield pd.DataFrame({"vec_id": b["vec_id"], "cell": cell.astype(np.int32), "code": [c.tobytes() for c in book.codes(x, cell)]})

    return materialize(rows.mapInPandas(code, "vec_id bigint, cell int, code binary"), "ann-index"), book


def _visits(queries: DataFrame, book: Codebook, sizes: np.ndarray, share: float, least: int) -> DataFrame:
    """(query_id, cell, unit vector) for the nearest cells of each query that together hold ``share`` of all rows,
    and at least ``least`` rows; so small tables are searched whole."""
    need = max(share * sizes.sum(), min(least, sizes.sum()))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = _unit(_matrix(b["embedding"]))
            order = np.argsort(_distances(x, book.centroids), axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            take = (before < need) & (sizes[order] > 0)
            q, k = np.nonzero(take)
            yield pd.DataFrame({"query_id": b["vec_id"].to_numpy()[q], "cell": order[q, k].astype(np.int32), "unit": [x[i].tobytes() for i in q]})

    return queries.mapInPandas(visit, "query_id bigint, cell int, unit binary")


def _packed(rows: DataFrame, key: str, fields: list[str], salts: DataFrame, block: int) -> DataFrame:
    """One row for about ``block`` rows of a cell: (cell, lists of the fields). Large cells become several rows."""
    split = rows.join(F.broadcast(salts), "cell").withColumn("salt", F.pmod(F.xxhash64(key), F.ceil(F.col("n") / block)))
    return split.groupBy("cell", "salt").agg(F.collect_list(F.struct(*fields)).alias("held")).select("cell", *[F.col(f"held.{f}").alias(f"{f}s") for f in fields])


def _best(parts: list[pd.DataFrame], most: int) -> pd.DataFrame:
    """Of each query the ``most`` candidates of the least distance, ties to the smaller vec_id."""
    rows = pd.concat(parts, ignore_index=True)
    rows = rows.iloc[np.lexsort((rows["vec_id"], rows["near"], rows["query_id"]))]
    return rows[rows.groupby("query_id", sort=False).cumcount() < most]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, share: float = SHARE, rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query, ties to the smaller vec_id.

    ``queries`` are rows of the same form as ``vectors``; a query's own id is no candidate.
    Repeated ids count once (their first vector by value). No vectors: no rows. Other columns,
    whatever their names, are not read. A larger ``share`` visits more cells; with a share of
    one and ``rerank`` as large as the table the search is exact.
    """
    rows = materialize(usable(vectors).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    asked = rows.join(queries.select("vec_id").distinct(), "vec_id", "left_semi")
    index, book = build_index(rows)
    counts = {r["cell"]: r["n"] for r in index.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each cell
    sizes = np.array([counts.get(c, 0) for c in range(len(book.centroids))], np.int64)
    visits = materialize(_visits(asked, book, sizes, share, 4 * rerank), "visits")
    size_of = lambda df: df.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    blocks = _packed(index, "vec_id", ["vec_id", "code"], size_of(index), BLOCK_ROWS)
    asks = _packed(visits, "query_id", ["query_id", "unit"], size_of(visits), BLOCK_QUERIES)

    # A query's own row is dropped later, hence one more. What a task drops has ``rerank`` better ones in that task.
    most_of_query = max(rerank, k) + 1

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        count = 0
        salt = TaskContext.get().partitionId() % SALTS

        def packed(rows: pd.DataFrame) -> pd.DataFrame:
            """A row for each query."""
            ids, at = np.unique(rows["query_id"].to_numpy(), return_index=True)  # sorted by query
            return pd.DataFrame({"query_id": ids, "salt": np.int32(salt), "nears": np.split(rows["near"].to_numpy(), at[1:]), "vec_ids": np.split(rows["vec_id"].to_numpy(), at[1:])})

        for b in batches:
            for cell, ids, codes, query_ids, units in zip(b["cell"], b["vec_ids"], b["codes"], b["query_ids"], b["units"], strict=True):
                ids, query_ids = np.asarray(ids), np.asarray(query_ids)
                order = np.argsort(ids, kind="stable")
                ids = ids[order]
                code = np.stack([np.frombuffer(c, np.uint8) for c in codes])[order]
                tables = book.tables(np.stack([np.frombuffer(u, np.float64) for u in units]), cell).astype(np.float32)
                near = np.zeros((len(query_ids), len(ids)), np.float32)
                for j in range(code.shape[1]):
                    near += tables[:, j][:, code[:, j]]
                most = min(most_of_query, len(ids))
                best = np.argsort(near, axis=1, kind="stable")[:, :most]  # ids ascend, so ties go to the smaller
                held.append(pd.DataFrame({"query_id": np.repeat(query_ids, most), "vec_id": ids[best].reshape(-1), "near": np.take_along_axis(near, best, 1).reshape(-1)}))
                count += len(held[-1])
                if count > HELD:
                    held = [_best(held, most_of_query)]
                    count = len(held[0])
                    if count > HELD / 2:  # many queries: the merge takes over
                        yield packed(held[0])
                        held, count = [], 0
        if held:
            yield packed(_best(held, most_of_query))

    # Each task passes on its best candidates of a query in one row; they are merged in two steps, so no row of a merge holds more than the best of
    # all tasks of a salt.
    met = blocks.join(asks, "cell").mapInPandas(rank, "query_id bigint, salt int, nears array<float>, vec_ids array<bigint>")
    met = met.select("query_id", "salt", F.filter(F.arrays_zip("nears", "vec_ids"), lambda x: x["vec_ids"] != F.col("query_id")).alias("best"))
    merged = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, rerank).alias("best")
    best = met.groupBy("query_id", "salt").agg(merged).groupBy("query_id").agg(merged)
    pairs = best.select("query_id", F.explode("best.vec_ids").alias("vec_id"))
    right = rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("wanted"))
    exact = pairs.join(rows, "vec_id").join(right.join(asked.select(F.col("vec_id").alias("query_id")), "query_id", "left_semi"), "query_id")

    @F.pandas_udf("double")
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=float)
        x, y = _matrix(a), _matrix(b)
        return pd.Series((x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))))

    scored = exact.select("query_id", "vec_id", cosine("embedding", "wanted").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest_of_every_fiftieth(vectors: DataFrame) -> DataFrame:
    """The five nearest of each vector whose id is divisible by 50, among all others."""
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))
