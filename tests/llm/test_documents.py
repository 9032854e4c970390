"""Operators on documents against plain Python, on texts with every awkward case."""

import collections
import hashlib
import re
import time
import zlib

import numpy as np
import pytest
import xxhash

from quadrat.llm import bpe, common, decontaminate, longrepeats, sharding, simhash, tokenstore, units

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, words string"
WORDS = [f"w{i}" for i in range(400)]


def phrase(start, n, step=1):
    return " ".join(WORDS[(start + i * step) % 400] for i in range(n))


LONG = phrase(0, 300)
TEXTS = [
    (1, LONG), (2, LONG), (3, LONG.replace("w50 ", "W50  ").upper()), (4, phrase(100, 40, 3) + " x " + phrase(0, 90)), (5, ""), (6, None), (None, "Only one Ünïcode wörd\n\nhere"),
    (7, "a" * 700), (7, "a" * 700), (8, "tiny"), (9, phrase(7, 2000, 7)), (10, "日本語 " * 60), (11, "tiny"), (12, phrase(0, 299) + " changed"), (13, "one two three four five six seven eight nine ten eleven"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 1, "clash") for i, t in TEXTS], SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, str(type(x)), x if x is not None else 0) for x in r))


def ordered(values):
    return sorted(values, key=lambda r: tuple((x is not None, str(type(x)), x if x is not None else 0) for x in r))


# --- decontamination -------------------------------------------------------------------------------------------

ITEMS = [(1, phrase(20, 12)), (2, phrase(20, 10)), (10, phrase(100, 15, 3)), (3, "Nine TEN eleven"), (4, None), (5, "?!"), (None, phrase(60, 10)), (6, phrase(300, 14)), (2, phrase(7, 11, 7))]


def brute_contamination(texts, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: word.findall((t or "").translate(lower))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = cut(t)
        n = min(len(w), 10)
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    out = []
    for d, t in texts:
        w, hit, found = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                got = windows.get(tuple(w[k : k + n]))
                if got:
                    hit |= set(range(k, k + n))
                    found |= {x for x in got if x is not None}
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return out


def test_contamination_matches_brute_force(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert rows(decontaminate.contamination(docs, items)) == ordered(brute_contamination(TEXTS, ITEMS))


def test_contamination_without_broadcast(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    windows = decontaminate.item_windows(items).select("length", "window").distinct()
    assert rows(decontaminate.window_hits(docs, windows, 0)) == rows(decontaminate.window_hits(docs, windows))


def test_contamination_of_nothing(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert decontaminate.contamination(empty, items).count() == 0
    none = decontaminate.contamination(docs, items.limit(0))
    assert none.where("contaminated or n_hit > 0").count() == 0 and none.count() == len(TEXTS)


def test_drop_contaminated_keeps_columns_and_clean_rows(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    clean = [d for d, *_, bad in brute_contamination(TEXTS, ITEMS) if not bad]
    assert ordered((r[0],) for r in kept.select("doc_id").collect()) == ordered((d,) for d in clean)


# --- token ids and BPE -----------------------------------------------------------------------------------------

HARD = ["", "a  b", "  a", "a ", "\n b", " \nb", "a\u0085 b\x1c c", "don't 's  's", "日本 12½ x▁y", "x" * 3000, " " * 50 + "a", "éü\tß  \r\n q", "<|endoftext|> a", "a\n\nb", "a.\nB", "ab, cd»,\nef*** g!?x h'. i\u00b2, \x00\x00 ok.", "tab\there,\tx", "\nfirst.\nlast\n"]


def test_units_join_to_the_text():
    for t in [*HARD, *[t for _, t in TEXTS if t]]:
        assert "".join(units.split_units(t)) == t
        assert "".join(map(units.unit_of, units.slow_keys(t))) == t


def test_cache_forgets_and_stays_right():
    seen = []
    cache = units.UnitCache(lambda us: [seen.append(u) or u for u in us], str.__add__, 20)
    texts = [*HARD, *[f"word{i}, word{i % 7} x{i}\ny{i}!? z{i}»," for i in range(60)]] * 2
    for i in range(0, len(texts), 5):
        for t, values in zip(texts[i : i + 5], cache.lookup(texts[i : i + 5]), strict=True):
            assert "".join(values) == t
    assert len(cache) < 200


def test_bpe_equals_the_rank_tokenizer():
    import public_tokenizers as p
    import tiktoken

    path = p.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.ByteBpe(path, p.PATTERN)
    other = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for t in [*HARD, *[t for _, t in TEXTS if t]]:
        ids = own.encode(t)
        assert ids == other.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_ranks_are_checked():
    with pytest.raises(ValueError, match="gaps"):
        bpe.serialise_model({b"a": 1})
    with pytest.raises(ValueError, match="without a token"):
        bpe.serialise_model({b"a": 0})


def test_bpe_digests(docs, empty):
    import public_tokenizers as p
    import tiktoken

    path = p.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d, t in TEXTS:
        ids = enc.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows(bpe.bpe_digests(docs, path, p.PATTERN)) == ordered(want)
    assert bpe.bpe_digests(empty, path, p.PATTERN).count() == 0


def test_token_round_trip(docs, empty):
    import public_tokenizers as p
    from tokenizers import Tokenizer

    path = p.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    more = [(20, "before <|endoftext|> after"), (21, "<|endoftext|>"), *((30 + i, t) for i, t in enumerate(HARD))]
    docs = docs.unionByName(docs.sparkSession.createDataFrame([(i, t, "en", "s", 1, "clash") for i, t in more], SCHEMA))
    want, start = [], 0
    for d, text in sorted([*TEXTS, *more], key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert rows(tokenstore.token_round_trip(docs, path, parts=3)) == ordered(want)
    assert tokenstore.token_round_trip(empty, path).count() == 0


def test_planes_round_trip():
    rng = np.random.default_rng(0)
    docs_ = [(i, rng.integers(0, 2**32, n, dtype=np.uint64).astype("<u4")) for i, n in enumerate([0, 5, tokenstore.BLOCK, 1, 2 * tokenstore.BLOCK + 7, 0])]
    import io

    raw = b"".join(tokenstore.file_chunks(docs_, {}))
    assert all((a == b).all() and i == j for (i, a), (j, b) in zip(docs_, tokenstore.read_documents(io.BytesIO(raw)), strict=True))
    flat = np.concatenate([x for _, x in docs_])
    for a, n in ((0, 3), (tokenstore.BLOCK - 2, 5), (len(flat) - 4, 4), (7, 0)):
        assert (tokenstore.read_range(io.BytesIO(raw), a, n) == flat[a : a + n]).all()
    with pytest.raises(ValueError, match="not a token-id file"):
        tokenstore.read_index(io.BytesIO(b"x" * 40))


# --- shards ----------------------------------------------------------------------------------------------------


def test_shards_are_contiguous_and_near_equal(docs, empty):
    found = rows(sharding.shard_documents(docs, 4))
    assert len(found) == len(TEXTS)
    want = ordered((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in TEXTS)
    assert ordered(r[:3] for r in found) == want
    total = sum(r[1] for r in found)
    inorder = sorted(found, key=lambda r: (r[4], r[5]))
    ids = [(r[0] is not None, r[0] or 0) for r in inorder]
    assert ids == sorted(ids)
    offset = 0
    for r in inorder:
        assert r[4] == min(offset * 4 // total, 3)
        offset += r[1]
    for s in {r[4] for r in found}:
        slots = [r[5] for r in inorder if r[4] == s]
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(empty).count() == 0


# --- repeats ---------------------------------------------------------------------------------------------------


def brute_repeats(texts, n=200):
    count = collections.Counter()
    raws = [(d, (t or "").encode()) for d, t in texts]
    for _, b in raws:
        count.update(b[i : i + n] for i in range(len(b) - n + 1))
    out = []
    for d, b in raws:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2000, 1])
def test_repeats_match_brute_force(docs, hot, monkeypatch):
    monkeypatch.setattr(longrepeats, "HOT_RUNS", hot)
    assert rows(longrepeats.remove_repeats(docs)) == ordered(brute_repeats(TEXTS))


def test_repeats_of_nothing(empty):
    assert longrepeats.remove_repeats(empty).count() == 0


# --- SimHash ---------------------------------------------------------------------------------------------------


def brute_simhash(text, k=3):
    w = [x for x in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if x]
    shingles = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_simhash_components(docs, empty):
    prints = [(d, brute_simhash(t)) for d, t in TEXTS]
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                group = [group[j] if g == group[i] else g for g in group]
    want = []
    for i, (d, f) in enumerate(prints):
        ids = [prints[j][0] for j in range(len(prints)) if group[j] == group[i] and prints[j][0] is not None]
        want.append((d, f"{f:016x}", min(ids) if ids else None))
    assert rows(simhash.simhash_components(docs)) == ordered(want)
    assert simhash.simhash_components(empty).count() == 0


@pytest.mark.parametrize("group", [64, 3])
def test_links_of_planted_fingerprints(spark, group, monkeypatch):
    """Chains, both segments, many fingerprints under one segment, and far ones, against all pairs."""
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63 - 1, 40, dtype=np.int64)
    near = [int((np.array([b]).view(np.uint64) ^ np.uint64(m)).view(np.int64)[0]) for b in base for m in (1, 1 << 40, (1 << 5) | (1 << 50), 3 << 30, 7)]
    hot = [int(h) << 32 | 77 for h in rng.integers(0, 2**31, 30)] + [(5 << 32 | 77) ^ (1 << b) for b in range(0, 62, 3)]
    prints = sorted({int(x) for x in base} | set(near) | set(hot))
    df = spark.createDataFrame([(p, p) for p in prints], "fp_id bigint, w0 bigint")
    got = {r["fp_id"]: r["component"] for r in simhash.link_components(df, simhash.CONTRACT).collect()}
    label = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 2 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    linked = {p for p in prints for q in prints if p != q and ((p ^ q) & (2**64 - 1)).bit_count() <= 2}
    assert got == {p: label[p] for p in linked}


def test_near_copies_keep_one_of_each_group(spark, docs):
    words = [f"v{i}" for i in range(3000)]
    texts = [(i, " ".join(words[i * 300 : i * 300 + 300])) for i in range(8)]
    copies = [(100 + i, t.replace(f"v{i * 300 + 150} ", "CHANGED ")) for i, t in texts[:4]] + [(200, texts[5][1]), (201, texts[5][1]), (201, texts[5][1])]
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts + copies], "doc_id bigint, text string, w0 string")
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, _ in texts]
    assert simhash.drop_near_copies(df.limit(0)).count() == 0
    assert simhash.drop_near_copies(docs).where("doc_id = 7").count() == 1


@pytest.mark.parametrize(("size", "shared", "linked"), [(178, 156, False), (180, 160, True), (182, 164, True), (185, 170, True), (9, 8, True)])
def test_near_copies_link_from_similarity_four_fifths(spark, size, shared, linked):
    """Pairs of ``size`` shingles each of which they share ``shared``: 0.78, 0.80, 0.82, 0.85, and 0.80 of short texts."""
    pairs = 60
    docs = []
    for p in range(pairs):
        first = [f"p{p}x{i}" for i in range(size + 4)]
        docs += [(2 * p, " ".join(first)), (2 * p + 1, " ".join([*first[: shared + 4], *[f"q{p}x{i}" for i in range(size - shared)]]))]
    kept = simhash.drop_near_copies(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 2 * pairs, 2 if linked else 1))


def test_large_groups_of_near_copies_lose_no_link(spark, monkeypatch):
    """Copies of one text with up to seven changed, dropped or added words, some of them copies of copies, against all pairs."""
    monkeypatch.setattr(simhash, "GROUP", 8)
    rng = np.random.default_rng(5)
    texts: list[list[str]] = [[f"b{i}" for i in range(120)]]
    for i in range(220):
        words = list(texts[0] if i % 3 else texts[rng.integers(len(texts))])
        for _ in range(int(rng.integers(1, 8))):
            at = int(rng.integers(len(words)))
            words[at : at + int(rng.integers(0, 3))] = [f"c{i}x{at}"] * int(rng.integers(0, 2))
        texts.append(words)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    assert 10 < len(set(label)) < 200
    kept = simhash.drop_near_copies(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label))


def test_wider_tables_for_more_rows():
    few, many = simhash.near_copies_scheme(1000), simhash.near_copies_scheme(10**8)
    assert (few.words, few.segment_bits, few.distance) == (5, 16, 84)
    assert many.segment_bits == 25 and len(many.segments) > 60


@pytest.mark.parametrize("rows", [1000, 10**7, 10**9])
def test_tables_are_joined_in_batches_of_bounded_rows(rows):
    scheme = simhash.near_copies_scheme(rows)
    assert [t for batch in scheme.batches for t in batch] == list(range(len(scheme.segments)))
    assert all(len(batch) * (2 + scheme.segment_bits // 2) <= simhash.TOGETHER for batch in scheme.batches)
    assert len(simhash.CONTRACT.batches) == 1


def _left_join_rows(plan):
    """Rows that the left joins of an executed plan made."""
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return _left_join_rows(plan.executedPlan())
    if "QueryStage" in name:
        return _left_join_rows(plan.plan())
    own = plan.metrics().apply("numOutputRows").value() if "Join" in name and "LeftOuter" in plan.joinType().toString() else 0
    return own + sum(_left_join_rows(plan.children().apply(i)) for i in range(plan.children().size()))


def test_crowded_keys_cost_a_row_for_each_entry_in_every_batch(spark):
    """One crowded key, in the first table: the pairs are those of brute force, and no batch makes a joined row for each probe."""
    scheme, rng = simhash.near_copies_scheme(1000), np.random.default_rng(5)
    tables = len(scheme.segments)
    bits = rng.integers(0, 2, 64 * scheme.words) ^ (rng.random((150, 64 * scheme.words)) < 0.1)
    bits[:, :16] = bits[0, :16]
    prints = [[int.from_bytes(np.packbits(w, bitorder="little").tobytes(), "little", signed=True) for w in row.reshape(scheme.words, 64)] for row in bits]
    component = [0 if i % 2 else i for i in range(150)]
    names = [f"w{k}" for k in range(scheme.words)]
    labelled = common.materialize(spark.createDataFrame([(i, *w, 100 + i % 30, [], component[i]) for i, w in enumerate(prints)], ", ".join(["fp_id bigint", *(f"{w} bigint" for w in names), "n bigint", "short array<bigint>", "component bigint"])), "labelled")
    want, segments = set(), bits.reshape(150, tables, 16)
    for a in range(150):
        for b in range(a + 1, 150):
            met = ((segments[a] != segments[b]).sum(axis=1) <= 1).any() and (bits[a, :256] != bits[b, :256]).sum() <= simhash._admitted(256)
            if met and component[a] != component[b] and min(100 + a % 30, 100 + b % 30) * 5 >= max(100 + a % 30, 100 + b % 30) * 4:
                want.add((a, b))
    found = simhash._across(labelled, scheme)
    assert len(want) > 2000 and sorted(map(tuple, found.collect())) == sorted(want)
    side = simhash._crowded(labelled, scheme)
    assert [r["key"] >> scheme.segment_bits for r in side.collect()] == [0]
    for batch in scheme.batches:
        met = simhash._across_in(labelled, scheme, batch, side)
        met.collect()
        assert _left_join_rows(met._jdf.queryExecution().executedPlan()) == 150 * len(batch)


def test_near_copies_leave_no_shuffle_files(spark):
    """What the stage shuffles is off the disk once it has ended, whether or not the driver collects its garbage."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {str(b) for b in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks.getAllBlocks()) if "shuffle" in str(b)}
    before, own = held(), spark.conf.get(common.SHUFFLES_GO, None)
    simhash.drop_near_copies(spark.createDataFrame([(i, phrase(i % 7 * 50, 60)) for i in range(20)], "doc_id bigint, text string"))
    for _ in range(50):
        if not (left := held() - before):
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(common.SHUFFLES_GO, None) == own


def test_repeated_shingles_count_once(spark):
    """A line repeated in one of two texts changes neither's set of shingles by much."""
    text = phrase(0, 200)
    docs = [(1, text), (2, text + (" " + phrase(190, 10)) * 60)]
    assert [r["doc_id"] for r in simhash.drop_near_copies(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()] == [1]
