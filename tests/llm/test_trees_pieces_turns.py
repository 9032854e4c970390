"""SentencePiece by prefixes, the Merkle manifest and conversation repair against the library and plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import public_tokenizers
import pytest
import sentencepiece

from quadrat.llm import dialogue, merkle, pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


# --- SentencePiece -----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def bpe():
    return pieces.PieceBpe(MODEL)


ODD = ["", " ", "  ", "\n", " \n ", "a", "▁", "a▁b", " a  b ", "\t\n x", "<s> </s> <unk> <0x0A>", "\x00", "a\x00b", "é́ ü 梦 漢字 😀👩‍👩‍👧 �", " " * 100, "a" * 3000, "ab " * 500, "x " + " " * 37 + "y", "\r\n\r\n};\r\n", "▁▁▁ ▁a ▁▁", "word. word, (word) \"word\"\nword.\n\nword", "z" * 40_000]


def test_ids_and_texts_equal_the_library(bpe, library):
    rnd = random.Random(5)
    letters = "abcdefghij ▁\n  e tthhee.,()\r;})é梦😀01 "
    texts = ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 120))) for _ in range(1500)]
    known = list(bpe.ids)
    texts += ["".join(rnd.choice(known) for _ in range(rnd.randrange(1, 30))).replace("▁", " ") for _ in range(1500)]
    for text in texts:
        ids = library.encode(text, num_threads=1)
        assert (bpe.encode(text) if text else []) == ids, text[:60]
        assert bpe.decode(ids) == library.decode(ids)


def test_any_ids_decode_as_by_the_library(bpe, library):
    rnd = random.Random(6)
    for _ in range(1500):
        ids = [rnd.randrange(32_000) if rnd.random() < 0.6 else rnd.randrange(3, 259) for _ in range(rnd.randrange(12))]
        assert bpe.decode(ids) == library.decode(ids)


def test_a_piece_that_scores_above_its_parts_is_refused(bpe):
    assert all(bpe.halves[i] is None or max(bpe.made(bpe.halves[i][0]), bpe.made(bpe.halves[i][1])) <= bpe.rank[i] for i in bpe.halves)


def test_digests_of_documents(spark, library):
    texts = [None, *ODD, ODD[13], ODD[13]]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens string")
    for r in pieces.piece_digests(df, MODEL).collect():
        text = texts[r["doc_id"]] or ""
        ids = library.encode(text, num_threads=1)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.piece_digests(df.limit(0), MODEL).count() == 0


def test_all_small_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r["doc_id"]: library.encode(r["text"] or "", num_threads=1) for r in docs.collect()}
    got = {r["doc_id"]: r["ids_sha256"] for r in pieces.piece_digests(docs, MODEL).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for k, v in want.items()}


# --- Merkle manifest ---------------------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(field, (*r[:4], text))))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            run = level[i - i % 3 : i - i % 3 + 3]
            out.append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
            i //= 3
        return out

    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    trees = {s: tree([leaf(r, r[4]) for r in sources[s]]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for j, s in enumerate(order):
        for i, r in enumerate(sources[s]):
            steps, text = path(trees[s], i) + path(top, j), r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf(r, text)
            for before, after in steps:
                node = sha(before + node + after)
            out.append((r[0], leaf(r, r[4]), trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), node, node == top[-1][0]))
    return sorted(out, key=str)


COLUMNS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_equals_plain_python(spark, levels):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, *range(200)]), rnd.choice([None, "", "a", "a", "a", "é", "zz", "Z"]), rnd.choice(["en", None]), rnd.choice([None, 3]), rnd.choice([None, "", "x\ny", "äö\n", "long " * 5_000])) for _ in range(250)]
    rows += [(i, f"s{i}", "en", 1, "one\n") for i in range(20)] + rows[:5] * 3
    df = spark.createDataFrame([(*r, "clash") for r in rows], COLUMNS + ", leaf string")
    got = merkle.manifest(df, merkle.without_line_feeds(), levels).collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(rows)
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_one_row_and_of_none(spark):
    one = [(7, "s", "en", 1, "x")]
    df = spark.createDataFrame(one, COLUMNS)
    assert list(map(tuple, merkle.manifest(df, merkle.without_line_feeds()).collect())) == plain_manifest(one)
    assert merkle.manifest(df.limit(0), merkle.without_line_feeds()).collect() == []


# --- conversation repair -----------------------------------------------------------------------------------------


def plain_audit(turns):
    """The least (cost, audit) over the grammar's states, from the last turn to the first."""
    steps = {"start": {"s": "system", "u": "user"}, "system": {"u": "user"}, "user": {"a": "pair"}, "pair": {"u": "user"}}

    @lru_cache(None)
    def best(i, state, inserts):
        found = [(0, "")] if i == len(turns) and state in ("start", "pair") else []
        if i < len(turns):
            cost, audit = best(i + 1, state, 2)
            found.append((cost + 2, "D" + audit))
            for letter, after in steps[state].items() if turns[i] != "d" else ():
                cost, audit = best(i + 1, after, 2)
                extra = 5 * turns[i].isupper()
                if turns[i].lower() == letter:
                    found.append((cost + extra, "K" + audit))
                elif letter != "s":
                    found.append((cost + extra + 1, "R" + audit))
        if inserts:
            for letter, after in steps[state].items():
                if letter != "s":
                    cost, audit = best(i, after, inserts - 1)
                    found.append((cost + 5, "I" + audit))
        return min(found) if found else (10**9, "")

    return best(0, "start", 2)


def test_alignment_equals_all_edits():
    for n in range(4):
        for turns in itertools.product("suaoSUAd", repeat=n):
            cost, audit, _ = dialogue.align("".join(turns))
            assert (cost, audit) == plain_audit("".join(turns))
    rnd = random.Random(1)
    for _ in range(600):
        turns = "".join(rnd.choice("suaoSUAOd" if rnd.random() < 0.5 else "ua") for _ in range(rnd.randrange(4, 40)))
        cost, audit, _ = dialogue.align(turns)
        assert (cost, audit) == plain_audit(turns)
    assert dialogue.align("uauAad" * 300)[0] > 0


def test_inserted_turns_have_their_places(monkeypatch):
    monkeypatch.setattr(dialogue, "DELETE", 20)
    cost, audit, fate, extra = dialogue.edits("uuua")
    assert set(audit) <= set("KRI") and len(fate) == 4
    assert [x for x in dialogue.edits("u")[3]] == [{"pos": 1, "nth": 0, "role": "a"}]


def plain_repair(rows):
    """rows: (conv_id, turn, role, text) with nulls; the digest row of every conversation."""
    held = {}
    for conv, turn, role, text in rows:
        out = held.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    found = []
    for conv, out in held.items():
        out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in out:
            visible = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
            seen.add((role, text))
        letters = "".join("d" if f in ("blank", "duplicate") else (c.upper() if f == "truncated" else c) for f, c in ((f, r[1][:1] if r[1][:1] in ("s", "u", "a") else "o") for f, r in zip(faults, out, strict=True)))
        cost, audit = plain_audit(letters)
        kept, i = [], 0
        target = len(audit.replace("D", ""))
        for e in audit:
            if e != "D":
                name = ("user", "assistant")[(len(kept) - target % 2) % 2]
                kept.append((out[i][1] if e == "K" else name) + ":" + ("" if e == "I" else out[i][2]))
            i += e != "I"
        turns = [t for t, _, _ in out if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(out))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        found.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(kept))))
    return sorted(found, key=str)


def test_repair_equals_plain_python(spark):
    rnd = random.Random(9)
    texts = ["Yes.", "No!", "Why?", "cut off", " \t\n", None, "", "end.\u0085", "same.", "same.", "é…", "wörd.  ", "long " * 2_000 + "."]
    rows = [(conv, rnd.choice([None, *range(9)]) if rnd.random() < 0.1 else k, rnd.choice(["user", "assistant", "system", None, "", "tool"]) if rnd.random() < 0.2 else ("user", "assistant")[k % 2], rnd.choice(texts)) for conv in [None, *range(40)] for k in range(rnd.randrange(1, 9))]
    rows += [(500, k, ("user", "assistant")[k % 2], f"turn {k}.") for k in range(400)] + [(501, 3, "user", "same.")] * 3
    lone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((lone, 0, "user", "dropped."))
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, audit string")
    got = sorted(map(tuple, dialogue.repair_report(df).collect()), key=str)
    want = plain_repair(rows)
    assert got == want
    assert (lone, 0, 0, 0, 0, 0, 0, "", sha("")) in got
    assert dialogue.repair_report(df.limit(0)).count() == 0
