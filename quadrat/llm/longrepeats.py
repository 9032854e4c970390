"""Removal of every byte that lies in a 200-byte string which also starts elsewhere.

Every 200-byte window has a least 40-byte gram (by hash). Equal windows have the same
one, so windows are dealt out by it: consecutive windows of a document with the same
least gram form a run. Runs whose gram occurs once are unique and are dropped; runs
that occur as a whole more than once are repeats; the windows of the others are compared
with the windows of the runs of the same gram.

This stands in for the suffix arrays that the plan names for this operator: see README.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, is_small, materialize, small_batches, text_key

LENGTH, GRAM = 200, 40
SPAN = LENGTH - GRAM + 1
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
CHUNK = 1 << 22
HOT_RUNS = 2000
OUT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n - 1 modulo 2 ** 64, kept by each worker."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        out = np.ones(max(n, 1 << 16), np.uint64)
        done, step = 1, base
        while done < len(out):
            more = min(done, len(out) - done)
            out[done : done + more] = out[:more] * np.uint64(step)
            done, step = done + more, step * step & MASK
        known = _powers[base] = out
    return known[:n]


BYTES = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64)


class Hashes:
    """Hashes of any stretch of ``raw``: polynomial modulo 2 ** 64 over random byte values, then mixed."""

    def __init__(self, raw: np.ndarray):
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTES[raw] * powers(pow(BASE, -1, 1 << 64), len(raw)), out=self.sums[1:])
        self.powers = powers(BASE, len(raw) + 1)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        z = (self.sums[stop] - self.sums[start]) * self.powers[start] + (stop - start).astype(np.uint64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x, span = np.minimum(x[:-span], x[span:]), span * 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def runs_of(raw: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gram hash, hash of all bytes, first window, windows, weight) of each run of a text's windows.

    The weight is 2 if the gram occurs more than once in the text as a window's least one, else 1.
    """
    if len(raw) < LENGTH:
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    hashes = Hashes(raw)
    at = np.arange(len(raw) - GRAM + 1)
    grams = hashes.of(at, at + GRAM)
    least = sliding_min(grams, SPAN)
    edge = np.full(SPAN - 1, np.uint64(0))
    reach = ~sliding_min(~np.concatenate((edge, least, edge)), SPAN)  # largest least value of the windows around a gram
    chosen = np.sort(grams[grams == reach])
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    count = np.diff(np.append(first, len(least)))
    value = least[first]
    often = np.searchsorted(chosen, value, "right") - np.searchsorted(chosen, value, "left")
    return value, hashes.of(first, first + count + LENGTH - 1), first, count, np.where(often > 1, 2, 1)


def find_runs(docs: DataFrame) -> DataFrame:
    """(gram, whole, doc_id, text_key, first, windows, weight) of all documents."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, texts = (batch.column(i).to_pylist() for i in range(3))
            for start in range(0, len(ids), 500):
                parts = [runs_of(np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8)) for t in texts[start : start + 500]]
                sizes = [len(p[0]) for p in parts]
                repeat = lambda values, start=start, sizes=sizes: pa.array([v for v, n in zip(values[start : start + 500], sizes, strict=True) for _ in range(n)], pa.int64())
                joined = [np.concatenate([p[i] for p in parts]) for i in range(5)]
                if sum(sizes):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(joined[0].view(np.int64)), pa.array(joined[1].view(np.int64)), repeat(ids), repeat(keys), *[pa.array(joined[i].astype(np.int32)) for i in (2, 3, 4)]],
                        names=["gram", "whole", "doc_id", "text_key", "first", "windows", "weight"],
                    )

    return small_batches(docs).select("doc_id", text_key().alias("text_key"), "text").mapInArrow(run, "gram bigint, whole bigint, doc_id bigint, text_key bigint, first int, windows int, weight int")


def _merged(starts: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans that windows at sorted ``starts`` cover."""
    cut = np.flatnonzero(np.diff(starts) > LENGTH) + 1
    return [(int(p[0]), int(p[-1]) + LENGTH) for p in np.split(starts, cut)]


def repeated_windows(texts: list[bytes]) -> list[list[tuple[int, int]]]:
    """For each text the byte spans of windows that occur more than once among all windows of ``texts``."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    hashes = Hashes(raw)
    counts = np.array([max(len(t) - LENGTH + 1, 0) for t in texts])
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])[:-1])).astype(np.int64)
    which = np.repeat(np.arange(len(texts)), counts)
    local = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[which] + local
    found = hashes.of(start, start + LENGTH)
    order = np.argsort(found, kind="stable")
    sorted_ = found[order]
    same = np.zeros(len(found), bool)
    if len(found) > 1:
        twin = sorted_[1:] == sorted_[:-1]
        same[order[1:][twin]] = True
        same[order[:-1][twin]] = True
    cuts = np.cumsum(counts)[:-1]
    return [_merged(l[s]) if s.any() else [] for l, s in zip(np.split(local, cuts), np.split(same, cuts), strict=True)]


SPANS = "gram bigint, whole bigint, spans array<struct<start:int,end:int>>"


def _compare(pieces: DataFrame) -> DataFrame:
    """(gram, whole, spans) of pieces (gram, whole, piece) with repeated windows, gram by gram.

    A piece may come more than once (from repeated rows); it counts once.
    """
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([("gram", pa.int64()), ("whole", pa.int64()), ("spans", kind)])

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], bytes] = {}
        size, last = 0, None

        def done(rows):
            found = [(key, spans) for key, spans in zip(rows, repeated_windows(list(rows.values())), strict=True) if spans]
            if found:
                packed = [[{"start": a, "end": b} for a, b in spans] for _, spans in found]
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in found], pa.int64()), pa.array([k[1] for k, _ in found], pa.int64()), pa.array(packed, kind)], schema=schema)

        for batch in batches:
            for gram, whole, piece in zip(*(batch.column(c).to_pylist() for c in ("gram", "whole", "piece")), strict=True):
                if size > CHUNK and last != gram:
                    yield from done(held)
                    held, size = {}, 0
                last = gram
                held[gram, whole] = piece
                size += len(piece)
        if held:
            yield from done(held)

    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(n, "gram").sortWithinPartitions("gram").mapInArrow(run, SPANS)


def _compare_hot(pieces: DataFrame) -> DataFrame:
    """The same for grams with very many runs: their windows are counted by hash, in pre-aggregated shuffles."""
    schema = pa.schema([("gram", pa.int64()), ("whole", pa.int64()), ("start", pa.int32()), ("window", pa.int64())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram, whole, piece in zip(*(batch.column(c).to_pylist() for c in ("gram", "whole", "piece")), strict=True):
                raw = np.frombuffer(piece, np.uint8)
                at = np.arange(len(raw) - LENGTH + 1)
                found = Hashes(raw).of(at, at + LENGTH).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), gram)), pa.array(np.full(len(at), whole)), pa.array(at.astype(np.int32)), pa.array(found)], schema=schema)

    windows = materialize(pieces.dropDuplicates(["gram", "whole"]).mapInArrow(run, "gram bigint, whole bigint, start int, window bigint"), "windows")
    often = windows.groupBy("gram", "window").count().where("count > 1").select("gram", "window")
    span = F.struct("start", (F.col("start") + LENGTH).cast("int").alias("end"))
    return windows.join(often, ["gram", "window"], "left_semi").groupBy("gram", "whole").agg(F.collect_list(span).alias("spans"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, starts, ends): for each text with repeats the byte spans of all repeated windows; they may overlap."""
    runs = materialize(find_runs(docs), "runs")
    grams = runs.groupBy("gram").agg(F.sum("weight").alias("n")).where("n > 1").select("gram")
    shared = materialize(runs.join(grams, "gram", "left_semi"), "shared")
    discard(runs)
    sorts = materialize(shared.groupBy("gram", "whole").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight"), F.min(F.struct("doc_id", "text_key", "first", "windows")).alias("at")), "sorts")
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    whole = shared.join(sorts.where("n > 1").select("gram", "whole"), ["gram", "whole"], "left_semi").select("doc_id", "text_key", F.array(span(F.col("first"), F.col("first") + F.col("windows") + LENGTH - 1)).alias("spans"))
    # Runs that differ but share a gram: their bytes are fetched, once for each distinct run.
    mixed = sorts.groupBy("gram").agg(F.count(F.lit(1)).alias("runs"), F.max("weight").alias("w")).where("runs > 1 or w > 1").select("gram", "runs")
    wanted = materialize(sorts.join(mixed, "gram").select("gram", "whole", "runs", "n", "at.*"), "wanted")
    by_doc = wanted.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("gram", "whole", "runs", "first", "windows")).alias("cuts"))
    texts = docs.select("doc_id", text_key().alias("text_key"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    near = texts.alias("t").join(by_doc.alias("b"), F.expr("t.doc_id <=> b.doc_id and t.text_key = b.text_key")).select("t.doc_id", "t.text_key", "raw", "cuts")
    each = near.select("raw", F.explode_outer("cuts").alias("c"))
    pieces = materialize(each.select("c.gram", "c.whole", "c.runs", F.expr("substring(raw, c.first + 1, c.windows + 199)").alias("piece")), "pieces")
    found = _compare(pieces.where(F.col("runs") <= HOT_RUNS).drop("runs"))
    hot = pieces.where(F.col("runs") > HOT_RUNS).drop("runs")
    if not hot.isEmpty():
        found = found.unionByName(_compare_hot(hot))
    once = wanted.where("n = 1").select("gram", "whole", "doc_id", "text_key", "first")
    moved = F.transform("spans", lambda s: span(F.col("first") + s["start"], F.col("first") + s["end"]))
    part = found.join(once, ["gram", "whole"]).select("doc_id", "text_key", moved.alias("spans"))
    every = F.flatten(F.collect_list("spans")).alias("spans")
    out = materialize(whole.unionByName(part).groupBy("doc_id", "text_key").agg(every).select("doc_id", "text_key", "spans.start", "spans.end").toDF("doc_id", "text_key", "starts", "ends"), "spans")
    discard(shared, sorts, wanted, pieces)
    return out


def cut_spans(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of ``raw`` without the spans, and the number of maximal removed runs."""
    kept, at, count, open_to = [], 0, 0, -1
    for a, b in sorted(spans):
        if a > open_to:
            count += 1
            kept.append(raw[at:a])
        at = open_to = max(open_to, b)
    kept.append(raw[at:])
    return b"".join(kept), count


def remove_repeats(docs: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document.

    A null text is empty. Repeated rows are repeats of each other. Texts under 200 bytes
    lose nothing. Repeats are judged on the input, and matches don't cross documents.
    """
    by_doc = repeated_spans(docs)
    side = F.broadcast(by_doc) if is_small(by_doc, broadcast_rows // 10) else by_doc
    texts = docs.select("doc_id", text_key().alias("text_key"), "text")
    joined = texts.alias("t").join(side.alias("b"), F.expr("t.doc_id <=> b.doc_id and t.text_key = b.text_key"), "left").select("t.doc_id", "t.text", "b.starts", "b.ends")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, starts, ends in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                kept, count = cut_spans(raw, list(zip(starts or (), ends or (), strict=True)))
                rows.append((doc_id, len(raw), len(raw) - len(kept), count, hashlib.sha256(kept).hexdigest()))
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, OUT)
