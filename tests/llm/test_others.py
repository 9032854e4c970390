"""WARC, pseudonyms, toxicity, the vector index, and the pipeline."""

import datetime
import gzip
import hashlib
import hmac
import io
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.llm import annindex, pii, toxicity, warc

SECRET = pii.Secret("key-of-tests")


# --- WARC ------------------------------------------------------------------------------------------------------

PAGES = [(1, "http://a/1", "x" * 1500), (2, "http://a/2", "x" * 1500), (9, "http://a/9 b", "x" * 1500), (3, None, None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (None, "u", "x" * 1500), (7, "u", "é" * 500), (8, "u", "é" * 500), (9, "http://a/9 b", "x" * 1500)]


def test_warc_round_trip(spark):
    df = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id bigint, url string, html string, digest string")
    want = []
    for page, _, html in PAGES:
        raw = (html or "").encode()
        top = max((p for p, _, h in PAGES if (h or "").encode() == raw and p is not None), default=None)
        revisit = len(raw) >= 1000 and top is not None and page != top
        want.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    got = [tuple(r) for r in warc.warc_round_trip(df).collect()]
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert warc.warc_round_trip(df.limit(0)).count() == 0


def test_warc_reader_verifies():
    good = warc.warc_record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None, False)
    (headers, block), = warc.read_records(io.BytesIO(good))
    assert warc.parse_record(headers, block)["payload"] == b"payload"
    raw = gzip.decompress(good)
    for bad, said in ((gzip.compress(raw.replace(b"payload\r\n", b"pAyload\r\n")), "digest"), (gzip.compress(raw[:-2]), "framing"), (good[:-6], "ends inside"), (gzip.compress(b"hello"), "not a WARC")):
        with pytest.raises(ValueError, match=said):
            list(warc.read_records(io.BytesIO(bad)))


# --- pseudonyms ------------------------------------------------------------------------------------------------


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(digits))) % 10 == 0


VALUES = ["bob.42@mail.example.com", "4111 1111 1111 1111", "4111111111111111", "123-45-6789", "+1 (167) 555-4827", "192.168.0.17", "2024-02-29"]


def test_pseudonyms_keep_formats_link_and_invert(spark):
    found = spark.createDataFrame([(v,) for v in VALUES], "v string").withColumn("k", SECRET.column()).select("v", "k", pii.kind_of(F.col("v")).alias("kind"), pii.pseudonym(F.col("v"), F.col("k")).alias("p"))
    back = found.select("v", "kind", "p", pii.pseudonym(F.col("p"), F.col("k"), undo=True).alias("again")).collect()
    by = {r["v"]: r for r in back}
    assert [by[v]["kind"] for v in VALUES] == ["email", "card", "card", "ssn", "phone", "ip", "date"]
    for r in back:
        assert r["again"] == r["v"] and r["p"] != r["v"]
        assert re.sub(r"\d", "0", re.sub("[a-z]", "a", r["p"])) == re.sub(r"\d", "0", re.sub("[a-z]", "a", r["v"])) or r["kind"] == "ip"
    card, bare = by[VALUES[1]]["p"], by[VALUES[2]]["p"]
    assert card.replace(" ", "") == bare and luhn(bare) and bare[0] == "4"


def test_what_fails_validation_stays(spark):
    texts = ["4111 1111 1111 1112", "999.1.1.1", "2023-02-30", "000-12-3456", "plain words 123", "", None, "version 1.2.3.4.5"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, found string")
    assert [r["text"] for r in pii.pseudonymise(df, SECRET).orderBy("doc_id").collect()] == texts
    report = pii.pii_report(df, SECRET).orderBy("doc_id").collect()
    assert [r["n_found"] for r in report] == [0] * len(texts)


def test_text_around_matches_is_kept(spark):
    text = "4111111111111111 at start, mail a@b.com; again 4111 1111 1111 1111, token = \"0123456789abcdef\" end 10.0.0.1"
    df = spark.createDataFrame([(1, text), (1, text)], "doc_id bigint, text string")
    a, b = (r["text"] for r in pii.pseudonymise(df, SECRET).collect())
    assert a == b and len(a) == len(text) + len(a) - len(text)
    assert re.fullmatch(r"4\d{15} at start, mail [a-z]@b\.com; again 4\d{3} \d{4} \d{4} \d{4}, token = \"[0-9a-z]{16}\" end \d+\.\d+\.\d+\.\d+", a)
    assert "4111" not in a
    assert pii.pseudonymise(df, SECRET).select(F.col("text")).join(df.select("text"), "text").count() == 0
    assert pii.pseudonymise(df.limit(0), SECRET).count() == 0
    undone = pii.pseudonymise(pii.pseudonymise(df, SECRET), SECRET, undo=True).collect()
    assert [r["text"] for r in undone] == [text, text]


LEAKS = [
    "id 12 4111111111111111 end", "order 1234 4111 1111 1111 1111 now", "4111111111111111 12/27", "4111111111111111_x", "card:4111-1111-1111-1111-", "4111111111111111 4242424242424242", "4111111111111111 12abc", "3782 822463 10005",
    "password: hunter2", "Authorization: Bearer abc.def-ghi123", "ünïcode@example.com", "o'brien@x.org", "李雷@ex.com", "+1 (017) 555-7713", "055-555-1234", "9" * 13 + " 1" * 3000 + " a",
]


def test_values_beside_other_characters_are_found_and_come_back(spark):
    df = spark.createDataFrame(list(enumerate(LEAKS)), "doc_id int, text string")
    told = [r["text"] for r in pii.pseudonymise(df, SECRET).orderBy("doc_id").collect()]
    for leak in ("4111111111111111", "4111 1111", "4111-1111", "4242424242424242", "3782 822463", "hunter2", "abc.def", "nïcode", "brien", "李雷", "555-7713", "555-1234"):
        assert not [t for t in told if leak in t], leak
    assert told[0].startswith("id 12 4") and told[2].endswith(" 12/27") and told[6].endswith(" 12abc") and told[-1] == LEAKS[-1]
    card = told[1].removeprefix("order 1234 ").removesuffix(" now")
    assert luhn(card.replace(" ", "")) and card.replace(" ", "") == told[0][6:22]
    again = pii.pseudonymise(pii.pseudonymise(df, SECRET), SECRET, undo=True).orderBy("doc_id").collect()
    assert [r["text"] for r in again] == LEAKS


def test_no_plain_value_is_left_in_the_given_documents(spark):
    """Cards, telephone numbers and local parts found by plain patterns in whole texts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs, SECRET).collect()}
    n = 0
    for r in docs.collect():
        text = r["text"] or ""
        values = re.findall(r"\(?\d{3}\)?[ .\-]\d{3}[ .\-]\d{4}", text) + re.findall(r"[\w.+%'\-]+@[\w\-]+\.[\w.\-]+", text)
        values += [m for m in re.findall(r"(?<!\d)\d(?:[ \-]?\d){12,18}(?!\d)", text) if luhn(re.sub(r"\D", "", m))]
        assert not [v for v in values if v in told[r["doc_id"]]]
        n += len(values)
    assert n > 20


def brute_feistel(symbols, radices, kind):
    """The network in plain Python: ten turns, each adding HMAC digits of one half to the other."""
    half = len(symbols) // 2
    sides, sizes = [list(symbols[:half]), list(symbols[half:])], [radices[:half], radices[half:]]
    for step in range(pii.ROUNDS):
        mine, other = step % 2, sides[1 - step % 2]
        said = f"{kind}|{step}|{','.join(map(str, other))}"
        digests = [hmac.new(SECRET.key.encode(), f"{said}|{j}".encode(), "sha256").hexdigest() for j in range(len(sides[mine]) // 8 + 1)]
        sides[mine] = [(x + int(digests[j // 8][j % 8 * 8 :][:7], 16)) % r for j, (x, r) in enumerate(zip(sides[mine], sizes[mine], strict=True))]
    return sides[0] + sides[1]


def brute_characters(value, kind):
    base = [("0", 10) if c.isdigit() else ("a", 26) if c.islower() else ("A", 26) if c.isupper() else (c, 1) for c in value]
    moved = brute_feistel([ord(c) - ord(b) for c, (b, _) in zip(value, base, strict=True)], [r for _, r in base], kind)
    return "".join(chr(ord(b) + x) for (b, _), x in zip(base, moved, strict=True))


def refilled(form, digits):
    digits = iter(digits)
    return "".join(str(next(digits)) if c.isdigit() else c for c in form)


def brute_pseudonym(kind, value):
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "email":
        local, domain = value.split("@")
        return brute_characters(local, "email") + "@" + domain
    if kind == "card":
        moved = brute_feistel([0, *digits[1:-1]], [1, *[10] * (len(digits) - 2)], "card")
        moved = [digits[0], *moved[1:]]
        total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(moved)))
        return refilled(value, [*moved, -total % 10])
    if kind == "ssn":
        area, group, serial = map(int, value.split("-"))
        a, g, s = brute_feistel([area - (2 if area > 666 else 1), group - 1, serial - 1], [898, 99, 9999], "ssn")
        return f"{a + (2 if a >= 665 else 1):03d}-{g + 1:02d}-{s + 1:04d}"
    if kind == "phone":
        least = [0, 0, 0, 2, 0, 0, 0, 0, 0, 0]
        moved = brute_feistel([d - m for d, m in zip(digits[-10:], least, strict=True)], [10, 10, 10, 8, *[10] * 6], "phone")
        return refilled(value, [*digits[:-10], *[x + m for x, m in zip(moved, least, strict=True)]])
    if kind == "ip":
        return ".".join(map(str, brute_feistel([int(x) for x in value.split(".")], [256] * 4, "ip")))
    if kind == "date":
        day = (datetime.date.fromisoformat(value) - datetime.date(1800, 1, 1)).days
        a, b = brute_feistel([day // 773, day % 773], [189, 773], "date")
        return (datetime.date(1800, 1, 1) + datetime.timedelta(days=a * 773 + b)).isoformat()
    return brute_characters(value, "secret")


LONG_VALUES = [
    ("email", "first.last+tag@mail.example.org"), ("email", "x" * 70 + "9@" + "sub." * 12 + "example.com"), ("card", "4111 1111 1111 1111"), ("card", "378282246310005"), ("ssn", "123-45-6789"), ("ssn", "667-01-0001"),
    ("phone", "+1 (415) 555-2671"), ("phone", "415.555.2671"), ("ip", "192.168.0.255"), ("date", "1999-12-31"), ("date", "2024-02-29"), ("secret", "abcDEF0123+/_-9"), ("secret", "k9" * 300), ("secret", "eyJhbGci.OiJIUzI1.NiJ9xyz"),
]


def test_pseudonyms_match_plain_python(spark):
    """Each kind alone in a text, and all of them in one very long text."""
    put = lambda kind, v: f"Token: \"{v}\"" if kind == "secret" else v
    texts = [f"see {put(k, v)}, then more" for k, v in LONG_VALUES]
    want = [f"see {put(k, brute_pseudonym(k, v))}, then more" for k, v in LONG_VALUES]
    texts, want = [*texts, " ".join(texts * 20)], [*want, " ".join(want * 20)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id bigint, text string, key string, _k string")
    found = pii.pii_report(df, SECRET).orderBy("doc_id").collect()
    assert [r["text"] for r in found] == want
    assert [r["n_found"] for r in found] == [1] * len(LONG_VALUES) + [20 * len(LONG_VALUES)]
    assert [r["text"] for r in pii.pseudonymise(df, SECRET).orderBy("doc_id").collect()] == want


def test_key_is_in_no_plan(spark):
    df = spark.createDataFrame([(1, "a@b.com")], "doc_id bigint, text string")
    plan = pii.pii_report(df, SECRET)._jdf.queryExecution().toString()
    block = SECRET.key.encode().ljust(64, b"\0")
    pads = [bytes(x ^ p for x in block).hex() for p in (0x36, 0x5C)]
    assert not any(k.lower() in plan.lower() for k in (SECRET.key, *pads)) and SECRET.key not in repr(SECRET)


def test_feistel_is_a_permutation(spark):
    all_ = spark.range(189 * 7).withColumn("k", SECRET.column()).select("id", pii.feistel(F.array((F.col("id") / 7).cast("bigint"), F.col("id") % 7), F.array(F.lit(189), F.lit(7)), F.col("k"), "t").alias("m"))
    moved = all_.select((F.col("m")[0] * 7 + F.col("m")[1]).alias("x"))
    assert moved.distinct().count() == 189 * 7 and moved.agg(F.max("x")).first()[0] == 189 * 7 - 1


# --- toxicity --------------------------------------------------------------------------------------------------


def toxic_corpus(n, seed):
    r = random.Random(seed)
    plain = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnpr"]
    out = []
    for i in range(n):
        words = r.choices(plain, k=r.randint(20, 120))
        bad = r.random() < 0.15
        if bad:
            for _ in range(r.randint(1, 6)):
                words.insert(r.randrange(len(words)), r.choice(["vileone", "vileish", "scumlike", "rotten"]))
        out.append((i, " ".join(words), int(bad)))
    return out


def test_the_fit_follows_the_numeric_gradient():
    """The same steps with the slope of the plain likelihood by central differences, and the score of a text by plain sums."""
    rows = toxic_corpus(300, 3)
    corpus = toxicity.numbered(toxicity.text_words(t) for _, t, _ in rows)
    grades = toxicity.draw_grades(corpus, np.array([y for _, _, y in rows]))
    chosen = toxicity.choose_features(corpus, grades)[:6]
    features = [{f for w in toxicity.text_words(t) for f in toxicity.word_features(w)} for _, t, _ in rows]
    names = [corpus.names[k] for k in chosen]
    x = np.array([[f in own for f in names] for own in features], float)
    top = int(grades.max())

    def loss(at):
        w, free = at[: len(names)], at[len(names) :]
        theta = np.concatenate(([-np.inf], np.cumsum(np.concatenate((free[:1], np.exp(free[1:])))), [np.inf]))
        below = lambda k: 1 / (1 + np.exp(-(theta[k] - x @ w)))
        return -np.mean(np.log(below(grades + 1) - below(grades))) + 1e-4 / 2 * w @ w

    at, one, two = np.concatenate((np.zeros(len(names)), [2.0], np.zeros(top - 1))), 0.0, 0.0
    for t in range(1, 41):
        g = np.array([(loss(at + e) - loss(at - e)) / 2e-6 for e in 1e-6 * np.eye(len(at))])
        one, two = 0.9 * one + 0.1 * g, 0.999 * two + 0.001 * g * g
        at = at - 0.05 * (one / (1 - 0.9**t)) / (np.sqrt(two / (1 - 0.999**t)) + 1e-8)
    picked = toxicity.choose_features
    toxicity.choose_features = lambda *_: chosen
    try:
        model = toxicity.fit_grades(corpus, grades, 40)
    finally:
        toxicity.choose_features = picked
    theta = np.cumsum(np.concatenate((at[len(names) : len(names) + 1], np.exp(at[len(names) + 1 :]))))
    want = x @ at[: len(names)]
    got = model.scorer()([t for _, t, _ in rows])
    assert np.abs(got - want).max() < 1e-3
    plain = 1 - 1 / (1 + np.exp(-(theta[None] - want[:, None])))
    assert np.abs(model.probabilities(got) - plain).max() < 1e-3


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_corpus(1200, 1)
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows], "doc_id bigint, text string, severity double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i < 800], "doc_id bigint, quality int, toxic int")
    found = {r["doc_id"]: r for r in toxicity.toxicity_report(docs, labels).collect()}
    held = [(found[i]["toxic"], bool(y)) for i, _, y in rows if i >= 800]
    assert sum(a == b for a, b in held) / len(held) > 0.98
    many = [found[i]["severity"] for i, t, y in rows if y and sum(t.count(w) for w in ("vile", "scum", "rotten")) >= 5]
    one = [found[i]["severity"] for i, t, y in rows if y and sum(t.count(w) for w in ("vile", "scum", "rotten")) == 1]
    assert np.mean(many) > np.mean(one)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and 900 < kept.count() < 1100


def test_toxicity_of_odd_input(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x y"), (3, "word " * 5000)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity.toxicity_report(docs, none).where("not toxic").count() == 4
    assert toxicity.toxicity_report(docs.limit(0), none).count() == 0
    odd = spark.createDataFrame([(None, 1, 1), (1, 1, None), (2, 0, 0), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert toxicity.toxicity_report(docs, odd).count() == 4


def test_thresholds_stay_ordered_and_share_weights():
    r = np.random.default_rng(0)
    words, grades = [], []
    for _ in range(800):
        g = int(r.integers(0, 4))
        words.append({f"n{chr(97 + k)}" for k in r.integers(0, 20, 10)} | {f"bad{chr(97 + k)}" for k in range(g)})
        grades.append(g)
    model = toxicity.fit_grades(toxicity.numbered(words), np.array(grades))
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 3
    scores = model.scorer()([" ".join(w) for w in words])
    expected = model.probabilities(scores).sum(axis=1)
    assert np.corrcoef(expected, grades)[0, 1] > 0.8


# --- vectors ---------------------------------------------------------------------------------------------------


def test_small_tables_are_searched_exactly(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 12)).astype(np.float32)
    x[7] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (701, [0.0] * 12), (702, [float("nan")] * 12), (703, [1.0, None] * 6), (704, []), (None, [1.0] * 12), (5, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = annindex.nearest_of_every_fiftieth(df).orderBy("query_id", "rank").collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 600, 50):
        s = u @ u[q]
        s[q] = -9
        want = sorted(range(600), key=lambda i: (-s[i], i))[:5]
        mine = [r for r in got if r["query_id"] == q]
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(r["score"] - s[r["vec_id"]]) < 1e-12 for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(want))
    assert hits / 60 >= 0.9


@pytest.mark.parametrize("held", [annindex.HELD, 3000])
def test_near_equal_vectors_of_one_cell_are_found(spark, held, monkeypatch):
    """Groups of 300 vectors close together, among as many spread ones: recall at 5 against brute force."""
    monkeypatch.setattr(annindex, "HELD", held)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(10, 64))
    x = np.concatenate((np.repeat(centres, 300, axis=0) + 0.1 * rng.normal(size=(3000, 64)), rng.normal(size=(3000, 64))))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = annindex.nearest_of_every_fiftieth(df.where("vec_id < 3000 or vec_id % 50 > 0")).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    there = np.array([i < 3000 or i % 50 > 0 for i in range(6000)])
    hits = 0
    for q in range(0, 3000, 50):
        s = np.where(there, u @ u[q], -9)
        s[q] = -9
        hits += len(set(np.argsort(-s)[:5]) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert len(got) == 300 and hits / 300 >= 0.97


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in annindex.nearest_of_every_fiftieth(df).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert annindex.nearest_of_every_fiftieth(df.limit(0)).count() == 0


# --- the pipeline ----------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows = toxic_corpus(500, 2)
    text = {i: t for i, t, _ in rows}
    bench = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    clean = [i for i, _, y in rows if not y]
    a, b, c = clean[:3]
    text[b] = text[a]
    text[c] = text[c] + " " + bench
    docs = [(i, text[i], "en", "s", len(text[i])) for i in text] + [(1000, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert a in left and b not in left and c not in left and 1000 in left
    toxic = {i for i, _, y in rows if y}
    assert len(toxic & left) <= 0.05 * len(toxic)
    assert len(left - toxic) >= 0.97 * (len(clean) - 2)
