"""SimHash fingerprints, and their near pairs by multi-index hashing.

A fingerprint is a row of 64-bit words. It is cut into segments; a table for each
segment holds every fingerprint under its segment value. Each fingerprint enumerates
the Hamming ball of radius one around its own segment values, fetches the matches from
the tables, and the complete distance of each match is verified.

With s segments every pair within 2 s - 1 bits agrees in some segment up to one bit, so
the search is exact for such radii; for larger ones the chance to meet grows with the
number of segments. A scheme with a similarity takes the matches as candidates only: the
exact Jaccard similarity of their distinct shingles decides.

Large groups of near copies are never compared pair by pair. Table entries that nearly
agree form families. A large family is compared with one of its members, the leader;
two members that are not both linked to it can only be similar if they share a shingle
that the leader lacks, or if one is shorter than the leader (``_split_groups``), so only
members that meet by such a shingle are compared further.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast, shuffles_dropped, small_batches, text_key
from .components import connected_components
from .units import in_blocks

SEED = 42
LANES = np.uint64(0x0101010101010101)
ROWS = 255  # what an 8-bit lane can count
#: Sets of at most so many shingles also meet by shingles, since few shingles give fingerprints of uneven distances.
SHORT = 10
BROADCAST_TEXTS = 500_000
#: Groups of at most so many rows are compared pair by pair; larger ones are split first.
GROUP = 64
LEVELS = 6
#: Words of a fingerprint that table rows carry to sift chance matches.
SIFTED = 4
#: Table entries and probes of a fingerprint that are shuffled at once; further tables are joined after.
TOGETHER = 50
#: Shingles of the leaders that a broadcast may hold: 16 MB.
BROADCAST_SHINGLES = 2_000_000


@dataclass(frozen=True)
class Scheme:
    """Words of a fingerprint, shingle length, segment width in bits, and the largest distance that links.

    Each word holds ``64 // segment_bits`` segments, from its lowest bit. With ``similarity``
    (numerator, denominator) fingerprints are of distinct shingles, ``distance`` only admits
    candidates, and those whose sets of shingles are at least so similar link.
    """

    shingle: int
    words: int
    segment_bits: int
    distance: int
    similarity: tuple[int, int] | None = None

    @property
    def batches(self) -> list[range]:
        """The tables, in runs that are joined one after another: what lies on disk follows the fingerprints, not the number of tables."""
        tables, step = len(self.segments), max(1, TOGETHER // (2 + self.segment_bits // 2))
        return [range(k, min(k + step, tables)) for k in range(0, tables, step)]

    @property
    def segments(self) -> list[tuple[int, int]]:
        return [(w, k * self.segment_bits) for w in range(self.words) for k in range(64 // self.segment_bits)]


#: Three words, one 64-bit fingerprint, links at two bits: two segments of 32 bits find every link.
CONTRACT = Scheme(shingle=3, words=1, segment_bits=32, distance=2)


def near_copies_scheme(rows: int, loss: float = 0.002) -> Scheme:
    """Jaccard similarity 0.8 of five-word shingles, for a table of ``rows`` rows.

    Sets of Jaccard similarity 0.8 have cosine 8/9, so each bit differs with chance p = acos(8/9) / pi = 0.151.
    Segments widen with the logarithm of the rows, so chance meetings stay in proportion to the rows, and there are as many
    tables as make such a pair meet but for ``loss``: 20 of 16 bits up to 262,144 rows. ``distance`` admits 5.6 deviations
    above the mean: 84 bits of 320. Sets of at most ten shingles always meet.
    """
    p = math.acos(8 / 9) / math.pi
    bits = max(16, math.ceil(math.log2(max(rows, 1))) - 2)
    meet = (1 - p) ** bits + bits * p * (1 - p) ** (bits - 1)
    tables = math.ceil(math.log(loss) / math.log(1 - meet))
    words = -(-tables // (64 // bits))
    return Scheme(shingle=5, words=words, segment_bits=bits, distance=_admitted(64 * words), similarity=(4, 5))


def _admitted(bits: int) -> int:
    """The mean of differing bits at similarity 0.8 and 5.6 deviations."""
    p = math.acos(8 / 9) / math.pi
    return int(p * bits + 5.6 * math.sqrt(bits * p * (1 - p)))


def shingle_hashes(text: str | None, shingle: int) -> list[int]:
    """XXH64 (seed 42) of each run of ``shingle`` words, repeats included; of all words if they are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)]


LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def remix(h: np.ndarray, word: int) -> np.ndarray:
    """Further independent bits from a 64-bit hash; word 0 is the hash itself. A splitmix64 step."""
    if not word:
        return h
    z = h + np.uint64(0x9E3779B97F4A7C15 * word & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def majority(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For runs of ``lengths`` hashes the word whose bits are set in over half of a run; none: zero.

    Counts eight bits at a time in byte lanes, over stretches of at most 255 hashes.
    """
    out = np.zeros(len(lengths), np.uint64)
    full = np.flatnonzero(lengths)
    if not len(full):
        return out
    size = lengths[full]
    pieces = -(-size // ROWS)
    first = np.concatenate(([0], np.cumsum(pieces)[:-1]))
    within = np.arange(pieces.sum()) - np.repeat(first, pieces)
    cuts = np.repeat(np.concatenate(([0], np.cumsum(size)[:-1])), pieces) + within * ROWS
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & LANES, cuts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        set_ = (counts * 2 > size[:, None]).astype(np.uint8)
        out[full] |= np.ascontiguousarray(set_).view(np.uint64).reshape(-1) << np.uint64(bit)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def meeting_shingles(hashes: np.ndarray, similarity: tuple[int, int]) -> list[int]:
    """Of at most ``SHORT`` sorted shingles the first, as many as make two similar sets share one; of more: none.

    Sets as similar share at least ``similarity`` of either one's shingles, so their least common one is among
    the first that are left when all of those but one are taken from the end.
    """
    n, (part, whole) = len(hashes), similarity
    return hashes[: n + 1 + -n * part // whole].view(np.int64).tolist() if 0 < n <= SHORT else []


def shingle_sets(docs: DataFrame, wanted: DataFrame, scheme: Scheme) -> DataFrame:
    """(text_key, shingles): the distinct shingle hashes of the texts whose key is in ``wanted``, a row for each key."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for start, texts in in_blocks(batch.column(1).to_pylist(), 1 << 20):
                sets = [np.unique(np.array(shingle_hashes(t, scheme.shingle), np.uint64)).view(np.int64) for t in texts]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([keys.slice(start, len(texts)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["text_key", "shingles"])

    rows = small_batches(docs).select(text_key().alias("text_key"), "text").join(maybe_broadcast(wanted, BROADCAST_TEXTS), "text_key", "left_semi")
    return rows.mapInArrow(run, "text_key bigint, shingles array<bigint>").dropDuplicates(["text_key"])


def fingerprints(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """(doc_id, text_key, w0, w1, ...) of every row; no words: zeros. One pass, no shuffle.

    With a similarity also n, set_key (number and digest of the distinct shingles) and short (see ``meeting_shingles``).
    """
    names = [f"w{k}" for k in range(scheme.words)]
    exact = scheme.similarity
    extra = ["n", "set_key", "short"] if exact else []

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in names]
            sets: list[tuple[int, int, list[int]]] = []
            for _, texts in in_blocks(batch.column(2).to_pylist(), 1 << 20):  # a few megabytes of hashes at a time
                hashes = [np.array(shingle_hashes(t, scheme.shingle), np.uint64) for t in texts]
                if exact:
                    hashes = [np.unique(h) for h in hashes]
                    sets += [(len(h), _signed(xxhash.xxh64_intdigest(h.tobytes())), meeting_shingles(h, exact)) for h in hashes]
                flat, count = np.concatenate(hashes), np.array([len(h) for h in hashes], np.int64)
                for k, part in enumerate(parts):
                    part.append(majority(remix(flat, k), count).view(np.int64))
            words = [np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts]
            more = [pa.array([x[0] for x in sets], pa.int64()), pa.array([x[1] for x in sets], pa.int64()), pa.array([x[2] for x in sets], pa.list_(pa.int64()))] if exact else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, words), *more], names=["doc_id", "text_key", *names, *extra])

    rows = small_batches(docs).select("doc_id", text_key().alias("text_key"), "text")
    return rows.mapInArrow(run, ", ".join(["doc_id bigint", "text_key bigint", *(f"{n} bigint" for n in names), *(f"{n} {'array<bigint>' if n == 'short' else 'bigint'}" for n in extra)]))


def _segment(word: Column, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(word, shift).bitwiseAND(F.lit((1 << bits) - 1))


def _key(table: int, value: Column, bits: int) -> Column:
    """Table number and segment value in one long."""
    return value.bitwiseOR(F.lit(table << bits))


def table_rows(prints: DataFrame, scheme: Scheme, ball: bool, *carried: Column, tables: range | None = None) -> DataFrame:
    """(key, carried...) for each of ``tables`` (all, if none are named): the own value, or with ``ball`` also those with one more bit set.

    Of two values that differ in one bit, one has that bit clear, so flipping clear bits finds every such pair. Shingles
    of short sets go with the first table.
    """
    bits, tables = scheme.segment_bits, range(len(scheme.segments)) if tables is None else tables
    own = [_key(t, _segment(F.col(f"w{w}"), shift, bits), bits) for t in tables for w, shift in [scheme.segments[t]]]
    keys = F.concat(F.array(*own), F.col("short")) if scheme.similarity and 0 in tables else F.array(*own)
    rows = prints.select(*carried, F.explode(keys).alias("key"))
    if not ball:
        return rows
    flips = [0, *(1 << b for b in range(bits))]
    each = rows.withColumn("flip", F.explode(F.array(*[F.lit(f).cast("bigint") for f in flips])))
    fresh = each.where(F.col("key").bitwiseAND(F.col("flip")) == 0)
    return fresh.withColumn("key", F.col("key").bitwiseOR(F.col("flip"))).drop("flip")


def _distance(a: str, b: str, words: int) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}w{k}").bitwiseXOR(F.col(f"{b}w{k}"))) for k in range(words)])


def _within_distance(pairs: DataFrame, prints: DataFrame, scheme: Scheme, *more: str) -> DataFrame:
    """The pairs (a, b) of fingerprint ids that are within the scheme's distance; ``more`` columns of both come along as a_, b_."""
    words = [f"w{k}" for k in range(scheme.words)]
    side = lambda x: prints.select(F.col("fp_id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in [*words, *more]])
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(_distance("a_", "b_", scheme.words) <= scheme.distance)
    return near.select("a", "b", *[f"{x}_{c}" for x in "ab" for c in more])


def _fits(scheme: Scheme, a: Column, b: Column) -> Column:
    """Whether sets of these sizes can be similar at all."""
    part, whole = scheme.similarity
    return F.least(a, b) * whole >= F.greatest(a, b) * part


def _similar(pairs: DataFrame, prints: DataFrame, sets: DataFrame, scheme: Scheme) -> DataFrame:
    """The pairs whose sets of shingles are as similar as the scheme asks, by exact count."""
    part, whole = scheme.similarity
    near = _within_distance(pairs, prints, scheme, "n", "text_key").where(_fits(scheme, F.col("a_n"), F.col("b_n")))
    held = lambda x: sets.select(F.col("text_key").alias(f"{x}_text_key"), F.col("shingles").alias(f"{x}_shingles"))
    common = F.size(F.array_intersect("a_shingles", "b_shingles"))
    return near.join(held("a"), "a_text_key").join(held("b"), "b_text_key").where(common * whole >= (F.col("a_n") + F.col("b_n") - common) * part).select("a", "b")


def _sketch(scheme: Scheme) -> tuple[list[Column], Column]:
    """Columns s0, s1, ... that sift chance matches, and the test of them against to_s0, to_s1, ...

    Of several words up to four are carried: of their 256 bits 70 may differ (39 expected at similarity 0.8, deviation
    5.7), which a similar pair exceeds with a chance under one in ten million. Fewer let dense unrelated groups through.
    """
    used = min(scheme.words, SIFTED)
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"to_s{k}"))) for k in range(used)])
    return [F.col(f"w{k}").alias(f"s{k}") for k in range(used)], apart <= (scheme.distance if used == scheme.words else _admitted(64 * used))


def _renamed(rows: DataFrame) -> DataFrame:
    return rows.select("key", *[F.col(c).alias("to_id" if c == "fp_id" else f"to_{c}") for c in rows.columns if c != "key"])


def _by_batches(scheme: Scheme, found: Callable[[range], DataFrame], name: str) -> DataFrame:
    """(a, b): the pairs of all tables, each once; those of each batch of tables are written before the next begins."""
    if len(scheme.batches) == 1:
        return found(scheme.batches[0])
    return reduce(DataFrame.union, [materialize(found(tables), name) for tables in scheme.batches]).distinct()


def _star(prints: DataFrame, scheme: Scheme) -> DataFrame:
    """(a, b): the fingerprints of each table entry against the entry's smallest one, sifted. As many as there are entries at most."""
    return _by_batches(scheme, lambda tables: _star_of(prints, scheme, tables), "met-leaders")


def _star_of(prints: DataFrame, scheme: Scheme, tables: range) -> DataFrame:
    carried, near = _sketch(scheme)
    entries = table_rows(prints, scheme, False, "fp_id", *carried, tables=tables)
    kept = [c for c in entries.columns if c != "key"]
    leaders = entries.groupBy("key").agg(F.min(F.struct(*kept)).alias("l"), F.count(F.lit(1)).alias("n")).where("n > 1")
    leaders = leaders.select("key", *[F.col(f"l.{c}").alias("to_id" if c == "fp_id" else f"to_{c}") for c in kept])
    return entries.join(leaders, "key").where((F.col("fp_id") != F.col("to_id")) & near).select(F.col("fp_id").alias("a"), F.col("to_id").alias("b")).distinct()


def _across(labelled: DataFrame, scheme: Scheme) -> DataFrame:
    """(a, b): the pairs of different components that meet in a table, sifted.

    In a key of many entries the rows of its largest component meet only the rows of others, and with one-word
    fingerprints the key is split by what the rest of the bits must share: of three parts of the other half one is
    equal where at most two bits differ. With a similarity, sets whose sizes rule it out do not meet. The component of
    a fingerprint that stands alone is left null, which costs the shuffle nothing.
    """
    hot = _crowded(labelled, scheme)
    side = None if hot.isEmpty() else maybe_broadcast(hot, BROADCAST_TEXTS)
    return _by_batches(scheme, lambda tables: _across_in(labelled, scheme, tables, side), "met-others")


def _crowded(labelled: DataFrame, scheme: Scheme) -> DataFrame:
    """(key, main): the keys of many entries, of all tables, with their largest component; written, batch by batch."""

    def of(tables: range) -> DataFrame:
        table = table_rows(labelled, scheme, False, "component", tables=tables)
        hot = table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).select("key")
        share = table.join(hot, "key").groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
        return materialize(share.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main")), "hot-keys")

    return reduce(DataFrame.union, [of(tables) for tables in scheme.batches])


def _across_in(labelled: DataFrame, scheme: Scheme, tables: range, side: DataFrame | None) -> DataFrame:
    """The pairs of ``_across`` from some of the tables; ``side`` holds the crowded keys, if there are any.

    Of several words every probe meets the entries outside its key's largest component; those inside it are met by the
    probes of other components alone. So only entries are told apart by key, never the many more probes.
    """
    carried, near = _sketch(scheme)
    carried = [F.col("fp_id"), F.nullif("component", "fp_id").alias("component"), *carried, *([F.col("n").cast("int").alias("n")] if scheme.similarity else [])]
    probes, table = table_rows(labelled, scheme, True, *carried, tables=tables), table_rows(labelled, scheme, False, *carried, tables=tables)
    own = F.coalesce("component", "fp_id")
    apart = near & (own != F.coalesce("to_component", "to_id"))
    if scheme.similarity:
        apart = apart & _fits(scheme, F.col("n"), F.col("to_n"))
    found = lambda x, y, *on: x.join(_renamed(y).withColumnsRenamed({f"to_{c}": c for c in on}), ["key", *on]).where(apart).select("fp_id", "to_id")
    if side is None:
        met = found(probes, table)
    elif scheme.words == 1 and scheme.distance <= 2:
        held, kept = probes.join(side, "key", "left"), table.join(side, "key", "left")
        met = found(held.where("main is null").drop("main"), kept.where("main is null").drop("main"))
        part = F.explode(F.array(*[F.shiftright("other", 11 * j).bitwiseAND(F.lit(2047)).bitwiseOR(F.lit(j << 11)) for j in range(3)]))
        other = F.when(F.shiftrightunsigned("key", scheme.segment_bits) == 0, F.shiftrightunsigned("s0", 32)).otherwise(F.col("s0").bitwiseAND(F.lit((1 << 32) - 1)))
        cut = lambda x: x.where("main is not null").drop("main").withColumn("other", other).withColumn("part", part).drop("other")
        met = met.unionByName(found(cut(held), cut(kept), "part"))
    else:
        outside = table.join(side, "key", "left").where(F.col("main").isNull() | (own != F.col("main"))).drop("main")
        inside = table.join(side, "key").where(own == F.col("main")).drop("main")
        met = found(probes, outside).unionByName(found(probes.join(side, "key").where(own != F.col("main")).drop("main"), inside))
    return met.select(F.least("fp_id", "to_id").alias("a"), F.greatest("fp_id", "to_id").alias("b")).distinct()


def _labelled(prints: DataFrame, grouped: DataFrame) -> DataFrame:
    return prints.join(grouped.withColumnRenamed("node", "fp_id"), "fp_id", "left").withColumn("component", F.coalesce("component", "fp_id"))


def _central(members: DataFrame, scheme: Scheme) -> DataFrame:
    """(fp_id, rank): how many entries share its keys; the members in the middle of a dense group share most."""
    entries = table_rows(members, scheme, False, "fp_id")
    loads = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return entries.join(loads, "key").groupBy("fp_id").agg(F.sum("n").alias("rank"))


def _split_groups(groups: DataFrame, sets: DataFrame, scheme: Scheme) -> tuple[DataFrame, DataFrame]:
    """(links, pairs) of groups (gid, fp_id, text_key, n, rank): similar pairs already found, and pairs to be compared.

    Small groups give all their pairs. Of a large one every member x is compared with the leader m, that of the
    highest rank. Let J(x, y) reach the similarity, and let x not be linked to m. If x and y share no shingle outside
    m, then what they share lies in x and m, so |x - y| + |y - x| >= (that of x and m) - (|m| - |y|); with p / w the
    similarity and c = (w - p) / (w + p) this leaves only y with (|m| - |y|) (1 - c) >= (that of x and m) - c (|x| + |m|).
    Those pairs are found by a join on |m| - |y|. All others share a shingle outside m; as |x and y| >= |x| p / w, they
    share one of the first floor(|x| (w - p) / w) + 1 of such shingles of each. Members that share one form a group of the next level.
    """
    part, whole = scheme.similarity
    groups = materialize(groups.withColumn("mask", F.lit(0).cast("bigint")), "groups")
    none = groups.sparkSession.createDataFrame([], "a bigint, b bigint")
    links, pairs = none, none
    for level in range(LEVELS):
        sizes = groups.groupBy("gid").agg(F.count(F.lit(1)).alias("size"), F.bit_and("mask").alias("all"), F.max(F.struct("rank", "fp_id", "n", "text_key")).alias("leader"))
        sizes = materialize(sizes.where("size > 1 and all = 0"), "group-sizes")
        last = level == LEVELS - 1
        small = groups.join(sizes if last else sizes.where(F.col("size") <= GROUP), "gid", "left_semi").select("gid", "fp_id", "n", "mask")
        other = small.toDF("gid", "to_id", "to_n", "to_mask")
        met = small.join(other, "gid").where((F.col("fp_id") < F.col("to_id")) & (F.col("mask").bitwiseAND(F.col("to_mask")) == 0) & _fits(scheme, F.col("n"), F.col("to_n")))
        pairs = pairs.union(met.select("fp_id", "to_id"))
        big = sizes.where(F.col("size") > GROUP)
        if last or big.isEmpty():
            break
        leaders = big.select("gid", F.col("leader.fp_id").alias("lead"), F.col("leader.n").alias("lead_n"), F.col("leader.text_key").alias("text_key"))
        leaders = materialize(leaders.join(sets, "text_key").select("gid", "lead", "lead_n", F.col("shingles").alias("lead_shingles")), "leaders")
        if (leaders.agg(F.sum("lead_n")).first()[0] or 0) <= BROADCAST_SHINGLES:
            leaders = F.broadcast(leaders)
        seen = groups.join(sets, "text_key").join(leaders, "gid").withColumn("common", F.size(F.array_intersect("shingles", "lead_shingles")))
        linked = F.col("common") * whole >= (F.col("n") + F.col("lead_n") - F.col("common")) * part
        few = F.floor(F.col("n") * (whole - part) / whole).cast("int") + 1
        rest = F.slice(F.array_sort(F.array_except("shingles", "lead_shingles")), F.lit(1), few)
        seen = materialize(seen.select("gid", "fp_id", "text_key", "n", "rank", "mask", "lead", "lead_n", "common", linked.alias("linked"), rest.alias("rest")), "against-leaders")
        links = links.union(seen.where("linked and fp_id <> lead").select("fp_id", "lead"))
        excess = (F.col("n") + F.col("lead_n") - 2 * F.col("common")) * (whole + part) - (F.col("n") + F.col("lead_n")) * (whole - part)
        least, most = F.ceil(excess / (2 * part)).cast("int"), F.floor(F.col("lead_n") - F.col("n") * part / whole).cast("int")
        longer = seen.where(~F.col("linked")).withColumns({"least": least, "most": most}).where("least <= most").select("gid", "fp_id", F.explode(F.sequence("least", "most")).alias("shorter"))
        shorter = seen.select("gid", F.col("fp_id").alias("to_id"), (F.col("lead_n") - F.col("n")).cast("int").alias("shorter")).where("shorter > 0")
        apart = longer.join(shorter, ["gid", "shorter"]).where("fp_id <> to_id")
        pairs = pairs.union(apart.select(F.least("fp_id", "to_id"), F.greatest("fp_id", "to_id")))
        mask = F.when(F.col("linked"), F.col("mask").bitwiseOR(F.lit(1 << level))).otherwise(F.col("mask"))
        groups = materialize(seen.select(F.explode("rest").alias("shingle"), "gid", "fp_id", "text_key", "n", "rank", mask.alias("mask")).select(F.xxhash64("gid", "shingle").alias("gid"), "fp_id", "text_key", "n", "rank", "mask"), "groups")
    return links, pairs.distinct()


def similar_links(prints: DataFrame, scheme: Scheme, docs: DataFrame) -> DataFrame:
    """(a, b): links of fingerprints (fp_id, w0, ..., n, short, text_key) that join every two similar ones that met in a table."""
    families = connected_components(materialize(_within_distance(_star(prints, scheme), prints, scheme), "star"))
    labelled = materialize(_labelled(prints, families), "families")
    across = materialize(_within_distance(_across(labelled, scheme), prints, scheme), "across")
    size = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = labelled.join(size, "component")
    ends = across.select(F.explode(F.array("a", "b")).alias("fp_id")).distinct()
    wanted = members.select("text_key").union(prints.join(ends, "fp_id").select("text_key")).distinct()
    sets = materialize(shingle_sets(docs, wanted, scheme), "shingle-sets")
    rank = _central(members.where(F.col("size") > GROUP), scheme)
    groups = members.join(rank, "fp_id", "left").select(F.col("component").alias("gid"), "fp_id", "text_key", "n", F.coalesce("rank", F.lit(0)).alias("rank"))
    links, pairs = _split_groups(groups, sets, scheme)
    pairs = materialize(pairs.union(across).distinct(), "candidates")
    return materialize(links.union(_similar(pairs, prints, sets, scheme)), "links")


def close_links(prints: DataFrame, scheme: Scheme) -> DataFrame:
    """(a, b): links of fingerprints within the scheme's distance. Those of each table entry with its smallest one first,
    which joins large groups by as many pairs as they have members; then those of different components."""
    first = materialize(_within_distance(_star(prints, scheme), prints, scheme), "star")
    return materialize(_within_distance(_across(_labelled(prints, connected_components(first)), scheme), prints, scheme).union(first), "links")


def link_components(prints: DataFrame, scheme: Scheme, docs: DataFrame | None = None) -> DataFrame:
    """(fp_id, component) of the distinct fingerprints (fp_id, w0, ...) that have a link to another.

    A scheme with a similarity needs ``docs`` and, in ``prints``, the columns n, short and text_key.
    """
    links = similar_links(prints, scheme, docs) if scheme.similarity else close_links(prints, scheme)
    return connected_components(links).select(F.col("node").alias("fp_id"), "component")


def near_copies(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """(doc_id, text_key, w0, ..., component_id): the smallest doc_id that links reach, itself included.

    Rows without words share the zero fingerprint and link like any other. Null ids
    count only if a group has no other. Repeated rows give repeated results.
    """
    words = [f"w{k}" for k in range(scheme.words)]
    rows = materialize(fingerprints(docs, scheme), "fingerprints")
    same = [*words, "n", "set_key"] if scheme.similarity else words
    # Of equal fingerprints (and shingles, where these decide) one goes on; its id is the first word, or a hash where there are several.
    more = [F.min("short").alias("short"), F.min("text_key").alias("text_key")] if scheme.similarity else []
    groups = rows.groupBy(*same).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("count"), *more)
    groups = materialize(groups.withColumn("fp_id", F.col("w0") if scheme.words == 1 else F.xxhash64(*same)), "distinct")
    carried = ["n", "short", "text_key"] if scheme.similarity else []
    found = link_components(groups.select("fp_id", *words, *carried), scheme, docs)
    named = groups.join(found, "fp_id", "left").withColumn("component", F.coalesce("component", "fp_id"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("count").alias("size")).where("size > 1")
    ids = materialize(named.join(least, "component").select(*same, "component_id"), "component-ids")
    joined = rows.join(ids, same, "left")
    return joined.select("doc_id", "text_key", *words, F.coalesce("component_id", "doc_id").alias("component_id"))


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    found = near_copies(docs, CONTRACT)
    return found.select("doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, scheme: Scheme | None = None) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id (ties: smallest text hash).

    Rows that repeat id and text count once. All columns stay as they are. A group whose
    ids are all null keeps one row. Texts without words are copies of each other.
    """
    with shuffles_dropped(docs.sparkSession):
        keep = _kept(docs, scheme or near_copies_scheme(docs.count()))

    def having(side: DataFrame) -> DataFrame:
        side = side.select("id_", "key_")
        return docs.join(side, docs["doc_id"].eqNullSafe(side["id_"]) & (text_key() == side["key_"]), "left_semi")

    return having(keep.where("copies = 1")).unionByName(having(keep.where("copies > 1")).dropDuplicates(["doc_id", "text"]))


def _kept(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """(id_, key_, copies) of the rows that stay, written."""
    found = near_copies(docs, scheme)
    group = F.when(F.col("component_id").isNull(), F.xxhash64(*[f"w{k}" for k in range(scheme.words)]))
    kept = found.groupBy("component_id", group.alias("g")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "text_key")).alias("k"))
    keep = found.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("copies")).join(kept.select(F.col("k.doc_id").alias("id_"), F.col("k.text_key").alias("key_")), F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_key") == F.col("key_")))
    return materialize(keep.select("id_", "key_", "copies"), "kept")
