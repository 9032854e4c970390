"""Benchmark decontamination by winnowing (DataFrame functions only).

Texts become word arrays. Of every ten-word window the smallest hash of its six
five-word grams is kept, with its place; so two equal windows keep the same gram, and a
document and a benchmark that share ten words share a fingerprint. Fingerprints are
joined, and each match is extended around the gram to the whole window, word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_small, materialize, maybe_broadcast, text_key

WINDOW = 10
GRAM = 5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PLACE_BITS = 30
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """A-Z in lower case, other letters as they are; null has no words."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _slots(last: Column) -> Column:
    """0 to ``last``; none below 0."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _with_kept(rows: DataFrame, w: str) -> DataFrame:
    """Adds ``kept``: the gram that each window of the word array ``w`` keeps; neighbours mostly keep the same one.

    A gram is its hash with the place in the low bits. Step by step, since an array that
    is an expression would be computed anew for each of its elements.
    """
    span = WINDOW - GRAM + 1
    gram = lambda i: F.xxhash64(*[F.get(F.col(w), i + k) for k in range(GRAM)])
    grams = F.transform(_slots(F.size(w) - GRAM), lambda i: F.shiftleft(F.shiftright(gram(i), PLACE_BITS), PLACE_BITS).bitwiseOR(i.cast("bigint")))
    kept = F.transform(_slots(F.size("grams") - span), lambda i: F.least(*[F.get(F.col("grams"), i + k) for k in range(span)]))
    return rows.withColumn("grams", grams).withColumn("kept", F.array_distinct(kept)).drop("grams")


def _hash_of(kept: Column) -> Column:
    return F.shiftright(kept, PLACE_BITS)


def _place_of(kept: Column) -> Column:
    return kept.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, length, window): the ten-word windows of each item, or the whole of a shorter one."""
    split = materialize(items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0), "items")
    length = F.least(F.size("w"), F.lit(WINDOW))
    starts = split.select("item_id", "w", length.alias("length"), F.explode(F.sequence(F.lit(0), F.size("w") - length)).alias("i"))
    return starts.select("item_id", "length", F.array_join(F.slice("w", F.col("i") + 1, F.col("length")), " ").alias("window")).distinct()


def _stretches(w: str, n: int) -> Column:
    """(start, words) of every run of ``n`` words."""
    return F.transform(_slots(F.size(w) - n), lambda i: F.struct(i.alias("start"), F.concat_ws(" ", *[F.get(F.col(w), i + k) for k in range(n)]).alias("words")))


def window_hits(docs: DataFrame, windows: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """(doc_id, text_key, start, length, window) of every occurrence of a window in a document."""
    small = is_small(windows, broadcast_rows)
    side = F.broadcast if small else (lambda x: x)
    split = docs.select("doc_id", text_key().alias("text_key"), words(F.col("text")).alias("w"))
    full = windows.where(F.col("length") == WINDOW).select("window", F.split("window", " ").alias("v"))
    prints = _with_kept(full, "v").select("window", F.array_min("kept").alias("kept")).select("window", _hash_of(F.col("kept")).alias("print"), _place_of(F.col("kept")).alias("offset"))
    prints = materialize(prints, "window-prints")
    known = prints.select("print").distinct()
    kept = _with_kept(split, "w")
    # The words around each gram suffice to extend it. explode_outer: a plain one would compute the array twice to test it.
    each = kept.select("doc_id", "text_key", "w", F.explode_outer("kept").alias("kept")).withColumns({"print": _hash_of(F.col("kept")), "place": _place_of(F.col("kept"))})
    first = F.greatest(F.col("place") - (WINDOW - GRAM), F.lit(0))
    around = F.slice("w", first + 1, 2 * WINDOW - GRAM)
    if small:
        matched = each.join(side(known), "print", "left_semi").select("doc_id", "text_key", "print", "place", first.alias("first"), around.alias("around"))
    else:  # the words of grams that match only: first the grams alone, then their documents again
        met = each.select("doc_id", "text_key", "print", "place").join(known, "print", "left_semi")
        again = split.select(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_"), "w").dropDuplicates(["id_", "key_"])
        matched = met.join(again, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_key") == F.col("key_"))).select("doc_id", "text_key", "print", "place", first.alias("first"), around.alias("around"))
    start = F.col("place") - F.col("offset")
    inside = (start >= F.col("first")) & (start + WINDOW <= F.col("first") + F.size("around"))
    same = F.array_join(F.slice("around", F.when(inside, start - F.col("first") + 1).otherwise(1), WINDOW), " ") == F.col("window")
    long = matched.join(side(prints), "print").where(inside & same).select("doc_id", "text_key", start.alias("start"), F.lit(WINDOW).alias("length"), "window")
    # Items of fewer words are one window: every gram of that length is a fingerprint of its own.
    lengths = sorted(r[0] for r in windows.where(F.col("length") < WINDOW).select("length").distinct().collect())  # nine at most
    for n in lengths:
        short = windows.where(F.col("length") == n).select("window", F.xxhash64("window").alias("print"))
        grams = split.select("doc_id", "text_key", F.explode_outer(_stretches("w", n)).alias("g"))
        found = grams.select("doc_id", "text_key", "g.*").where("words is not null").join(side(short), (F.xxhash64("words") == F.col("print")) & (F.col("words") == F.col("window")))
        long = long.unionByName(found.select("doc_id", "text_key", "start", F.lit(n).alias("length"), "window"))
    return long.distinct()


def _covered(spans: Column) -> Column:
    """Places that sorted (start, end) spans cover, each counted once."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["to"]), F.lit(0))).alias("n"), F.greatest(acc["to"], s["end"]).alias("to"))
    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document.

    Null and wordless texts have no words; wordless items have no window. Items that
    repeat an id count as one; a window of an item without id is a hit but lists no item.
    Repeated documents give repeated results; documents of one id and different texts are
    judged each. Without items nothing is contaminated.
    """
    return _verdicts(docs, items).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def _verdicts(docs: DataFrame, items: DataFrame) -> DataFrame:
    windows = materialize(item_windows(items), "windows")
    hits = materialize(window_hits(docs, windows.select("length", "window").distinct()), "hits")
    spans = hits.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("spans"))
    spans = spans.select("doc_id", "text_key", _covered(F.col("spans")).cast("bigint").alias("n_hit"))
    named = hits.select("doc_id", "text_key", "window").distinct().join(windows.where("item_id is not null").select("window", "item_id").distinct(), "window").select("doc_id", "text_key", F.col("item_id").cast("string").alias("item")).distinct()
    named = named.groupBy("doc_id", "text_key").agg(F.array_join(F.sort_array(F.collect_list("item")), ",").alias("items"), F.count(F.lit(1)).alias("n_items"))
    sized = docs.select("doc_id", text_key().alias("text_key"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("bigint").alias("n_words"))
    parts = [sized.select("doc_id", "text_key", "n_words", F.lit(1).alias("copies")), spans, named]
    both = parts[0].unionByName(parts[1], True).unionByName(parts[2], True)
    found = both.groupBy("doc_id", "text_key").agg(F.max("n_words").alias("n_words"), F.sum("copies").cast("int").alias("copies"), F.coalesce(F.max("n_hit"), F.lit(0)).alias("n_hit"), F.coalesce(F.max("n_items"), F.lit(0)).alias("n_items"), F.coalesce(F.max("items"), F.lit("")).alias("items"))
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.select("doc_id", "text_key", "n_words", "n_hit", F.col("n_items").cast("bigint"), F.sha2(F.col("items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """The documents in which no window of an item occurs; all columns as they are."""
    windows = materialize(item_windows(items).select("length", "window").distinct(), "windows")
    bad = materialize(window_hits(docs, windows).select(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_")).distinct(), "contaminated")
    bad = maybe_broadcast(bad, broadcast_rows)
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["id_"]) & (text_key() == bad["key_"]), "left_anti")
