"""Near matches of sequences by seeds, denoising by abundance, assignment to centroids, and a k-mer classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..streaming.checkpoints import cut


def near_pairs(left: DataFrame, right: DataFrame, most: int, also: Column | None = None) -> DataFrame:
    """(a, b, d): ids of ``left`` and ``right`` (id, seq, size) whose sequences are at most ``most`` edits apart.

    A right sequence is cut in ``most`` + 1 equal segments; that many edits leave one of them whole, moved by as many places
    at most. So pairs meet in a join on segment texts, for each length that edits allow, and are verified in a band.
    ``also`` is a condition on size_a and size_b that pairs must meet before they are compared. Nothing is missed; a
    segment that very many sequences share costs their pairs.
    """
    parts = most + 1
    start = lambda i, n: F.floor(i * n / parts).cast("int")
    seg = F.explode(F.sequence(F.lit(0), F.lit(most))).alias("i")
    n = F.length("seq")
    index = right.select("id", "size", "seq", seg).select(F.col("id").alias("b"), F.col("size").alias("size_b"), F.xxhash64(n, "i", F.substring("seq", start(F.col("i"), n) + 1, start(F.col("i") + 1, n) - start(F.col("i"), n))).alias("key"))
    probes = left.select("id", "size", "seq", F.explode(F.sequence(F.greatest(n - most, F.lit(0)), n + most)).alias("n"))
    probes = probes.select("*", seg)
    begin, width = start(F.col("i"), F.col("n")), start(F.col("i") + 1, F.col("n")) - start(F.col("i"), F.col("n"))
    probes = probes.withColumns({"begin": begin, "width": width}).where(F.col("begin") - most <= F.length("seq") - F.col("width"))
    at = F.sequence(F.greatest(F.col("begin") - most, F.lit(0)), F.greatest(F.least(F.col("begin") + most, F.length("seq") - F.col("width")), F.greatest(F.col("begin") - most, F.lit(0))))
    probes = probes.select("*", F.explode(at).alias("at"))
    keys = probes.select(F.col("id").alias("a"), F.col("size").alias("size_a"), F.xxhash64("n", "i", F.substring("seq", F.col("at") + 1, F.col("width"))).alias("key")).distinct()
    met = keys.join(index, "key")
    met = (met if also is None else met.where(also)).select("a", "b").distinct()
    both = met.join(left.select(F.col("id").alias("a"), F.col("seq").alias("sa")), "a").join(right.select(F.col("id").alias("b"), F.col("seq").alias("sb")), "b")
    return both.select("a", "b", F.levenshtein("sa", "sb", most).alias("d")).where("d >= 0")


def denoised(reads: DataFrame, least: int = 3, alpha: float = 2.0) -> DataFrame:
    """(seq, size, centroid, d): distinct sequences of at least ``least`` reads (seq), each with the centroid whose error it is taken for.

    From the most abundant on (ties: the lesser text), a sequence is an error of a centroid d edits away if its size is at most
    the centroid's by 2^(-alpha d - 1); of several the nearest counts, then the larger, then the lesser text. Else it
    is a centroid itself. The largest d that sizes allow bounds the seeds. All whose possible centroids are
    settled are settled together; an error is at least eightfold rarer, so rounds are few.
    """
    sizes = cut(reads.where("seq is not null").groupBy("seq").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least))
    ends = sizes.agg(F.max("size").alias("a"), F.min("size").alias("b"), F.max(F.length("seq")).alias("n")).first()
    most = 0
    while ends["a"] and ends["a"] >= ends["b"] * 2 ** (alpha * (most + 1) + 1) and most < ends["n"]:
        most += 1
    ids = sizes.select(F.col("seq").alias("id"), "seq", "size")
    rare = F.col("size_a") * F.pow(F.lit(2.0), F.lit(alpha + 1)) <= F.col("size_b")
    if most:
        pairs = near_pairs(ids, ids, most, rare).join(ids.select(F.col("id").alias("a"), F.col("size").alias("size_a")), "a").join(ids.select(F.col("id").alias("b"), F.col("size").alias("size_b")), "b")
        pairs = cut(pairs.where((F.col("d") > 0) & (F.col("size_a") * F.pow(F.lit(2.0), alpha * F.col("d") + 1) <= F.col("size_b"))))
        state = cut(sizes.withColumn("kept", F.lit(None).cast("boolean")))
        while not state.where("kept is null").isEmpty():
            above = pairs.join(state.select(F.col("seq").alias("b"), "kept"), "b")
            seen = above.groupBy(F.col("a").alias("seq")).agg(F.bool_or("kept").alias("any"), F.bool_or(F.col("kept").isNull()).alias("open"))
            now = state.join(seen, "seq", "left")
            state = cut(now.select("seq", "size", F.coalesce("kept", F.when(F.coalesce("any", F.lit(False)), False).when(~F.coalesce("open", F.lit(False)), True)).alias("kept")))
        best = pairs.join(state.where("kept").select(F.col("seq").alias("b")), "b", "left_semi").groupBy(F.col("a").alias("seq")).agg(F.min(F.struct("d", (-F.col("size_b")).alias("s"), "b")).alias("x"))
        out = state.join(best, "seq", "left")
        return out.select("seq", "size", F.when(F.col("kept"), F.col("seq")).otherwise(F.col("x.b")).alias("centroid"), F.when(F.col("kept"), 0).otherwise(F.col("x.d")).alias("d"))
    return sizes.select("seq", "size", F.col("seq").alias("centroid"), F.lit(0).alias("d"))


def assigned(reads: DataFrame, centroids: DataFrame, identity: float = 0.999) -> DataFrame:
    """(sample, centroid, count): reads (sample, seq) counted under the centroid (centroid, seq) most like them.

    Identity is one less edits over the longer length; of centroids at ``identity`` or more the one of largest
    identity, then of least name, counts. Reads without one are left out. Distinct sequences are compared once.
    """
    unique = cut(reads.where("seq is not null").groupBy("seq").agg(F.count(F.lit(1)).alias("size")))
    longest = max(unique.agg(F.max(F.length("seq"))).first()[0] or 0, centroids.agg(F.max(F.length("seq"))).first()[0] or 0)
    most = int((1 - identity) * longest + 1e-9)
    to = centroids.select(F.col("centroid").alias("id"), "seq", F.lit(0).alias("size"))
    near = near_pairs(unique.select(F.col("seq").alias("id"), "seq", "size"), to, most).join(to.select(F.col("id").alias("b"), F.col("seq").alias("to")), "b")
    share = 1 - F.col("d") / F.greatest(F.length("a"), F.length("to"), F.lit(1))
    best = near.withColumn("share", share).where(F.col("share") >= identity - 1e-12).groupBy(F.col("a").alias("seq")).agg(F.min(F.struct((-F.col("share")).alias("x"), "b")).alias("best"))
    per = reads.groupBy("sample", "seq").agg(F.count(F.lit(1)).alias("n"))
    return per.join(best.select("seq", F.col("best.b").alias("centroid")), "seq").groupBy("sample", "centroid").agg(F.sum("n").alias("count"))


def kmers(seqs: DataFrame, k: int, *keys: str) -> DataFrame:
    """(keys, kmer, n): how often each string of ``k`` letters occurs in ``seq``; shorter sequences have none.

    One pass over a sequence, each match a letter with those after it ahead: a substring for each place would walk there from the
    beginning, and a row for each place would hold the sequence again.
    """
    found = F.regexp_extract_all("seq", F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1))
    return seqs.where(F.length("seq") >= k).select(*keys, F.explode(found).alias("kmer")).groupBy(*keys, "kmer").agg(F.count(F.lit(1)).alias("n"))


def bayes_model(reference: DataFrame, k: int = 7, alpha: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """Of labelled sequences (taxon, seq): (taxon, kmer, gain) and (taxon, base), logarithms of smoothed probabilities.

    ``base`` is that of a k-mer that the taxon lacks, ``gain`` what one that it has adds to it. Taxa weigh alike.
    """
    counts = cut(kmers(reference.where("taxon is not null"), k, "taxon"))
    vocabulary = counts.select("kmer").distinct().count()
    taxa = counts.groupBy("taxon").agg(F.log(F.lit(alpha) / (F.sum("n") + F.lit(alpha * vocabulary))).alias("base"))
    return counts.select("taxon", "kmer", F.log((F.col("n") + F.lit(alpha)) / F.lit(alpha)).alias("gain")), cut(taxa)


def bayes_classified(reads: DataFrame, gains: DataFrame, taxa: DataFrame, k: int = 7, least: float = 0.7) -> DataFrame:
    """(id, taxon, confidence): the likeliest taxon of each read (id, seq), and its share of all taxa's likelihood.

    Below ``least``, and for reads shorter than ``k``, the taxon is "Unassigned". Only taxa that share a k-mer with a read
    are joined with it; what the others have depends on the read's length alone, and comes from a table of the lengths.
    """
    counts = cut(kmers(reads, k, "id"))
    total = cut(counts.groupBy("id").agg(F.sum("n").alias("m")))
    some = counts.join(gains, "kmer").groupBy("id", "taxon").agg(F.sum(F.col("n") * F.col("gain")).alias("gain"))
    some = cut(some.join(total, "id").join(taxa, "taxon").select("id", "taxon", "m", (F.col("m") * F.col("base")).alias("none"), (F.col("gain") + F.col("m") * F.col("base")).alias("score")))
    listed = taxa.agg(F.collect_list(F.struct("base", "taxon")).alias("all"))  # one row, a number for each taxon
    rest = total.select("m").distinct().crossJoin(F.broadcast(listed)).select("m", F.explode("all").alias("x")).select("m", F.col("x.taxon").alias("taxon"), (F.col("m") * F.col("x.base")).alias("none"))
    rest = rest.groupBy("m").agg(F.max_by("taxon", F.struct("none", "taxon")).alias("other"), F.max("none").alias("top"), F.collect_list("none").alias("nones"))
    best = some.groupBy("id", "m").agg(F.max(F.struct("score", "taxon")).alias("b"), F.collect_list(F.struct("score", "none")).alias("s"))
    near = total.join(best, ["id", "m"], "left").join(rest, "m")
    top = F.greatest(F.coalesce(F.col("b.score"), F.col("top")), F.col("top"))
    add = lambda items, value: F.aggregate(items, F.lit(0.0), lambda a, x: a + F.exp(value(x) - top))
    joined = F.coalesce("s", F.array().cast("array<struct<score:double,none:double>>"))
    likelihood = add(F.col("nones"), lambda x: x) - add(joined, lambda x: x["none"]) + add(joined, lambda x: x["score"])
    found = near.select("id", F.when(F.col("b.score") >= F.col("top"), F.col("b.taxon")).otherwise(F.col("other")).alias("taxon"), (1 / likelihood).alias("confidence"))
    out = reads.select("id").distinct().join(found, "id", "left")
    return out.select("id", F.when(F.col("confidence") >= least, F.col("taxon")).otherwise("Unassigned").alias("taxon"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
